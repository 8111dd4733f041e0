"""All registered queries by name."""
from __future__ import annotations

from spindlewatch.plans import answers_plan, eval_plan, files_plan, io_plan, labels_plan, more_plan, points_plan, policy_plan, quality_plan, reference_plan, stream_plan, windows_plan

PLANS = [labels_plan, windows_plan, answers_plan, eval_plan, quality_plan, stream_plan, io_plan, reference_plan, policy_plan, points_plan, more_plan, files_plan]


def queries() -> dict:
    return {name: fn for plan in PLANS for name, fn in plan.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for plan in PLANS for name, sql in plan.ORACLE.items()}
