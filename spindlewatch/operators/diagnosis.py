"""Rule scores, root cause, events and the target record of a window, as expressions on its ``stats`` array."""
from __future__ import annotations

from pyspark.sql import DataFrame

from spindlewatch.functions.names import SCORED_CAUSES
from spindlewatch.operators.rulebook import Scoring
from spindlewatch.operators.windows import stage


def with_scores(df: DataFrame, scoring: Scoring = Scoring()) -> DataFrame:
    """Adds ``score_<group>``, ``available_<group>`` and ``signals_<group>``."""
    counts = {}
    for g in SCORED_CAUSES:
        counts[f"available_{g}"] = f"size(filter(stats, s -> s.group = '{g}'))"
        counts[f"_gain_{g}"] = f"filter(filter(stats, s -> s.group = '{g}').contrib, c -> c > 0)"
    df = stage(df, counts)
    scores = {}
    for g in SCORED_CAUSES:
        spread = f"cast(greatest(available_{g}, 1) AS double)"
        raw = f"aggregate(slice(reverse(array_sort(_gain_{g})), 1, {scoring.top_k_per_group}), 0.0D, (a, c) -> a + c)"
        scores[f"signals_{g}"] = f"size(_gain_{g})"
        scores[f"score_{g}"] = f"{raw} / sqrt({spread}) * (0.75D + 0.25D * size(_gain_{g}) / {spread})"
    return stage(df, scores).drop(*[f"_gain_{g}" for g in SCORED_CAUSES])


def with_root_cause(df: DataFrame, scoring: Scoring = Scoring()) -> DataFrame:
    """Adds ``ranked`` (score, cause; best first, ties in cause order), ``root_cause`` and ``max_score``."""
    pairs = ", ".join(f"struct(-score_{g} AS neg, {i} AS i, '{g}' AS cause)" for i, g in enumerate(SCORED_CAUSES))
    df = stage(df, {"ranked": f"transform(array_sort(array({pairs})), p -> struct(-p.neg AS score, p.cause AS cause))"})
    rest = SCORED_CAUSES[:4]
    bar = f"if(available_workload <= 1, {scoring.workload_support_threshold * 0.85!r}D, {scoring.workload_support_threshold!r}D)"
    support = " + ".join(f"cast(score_{g} >= {bar} AS int)" for g in rest)
    present = " + ".join(f"cast(available_{g} > 0 AS int)" for g in rest)
    alone = (
        f"({support}) < least({scoring.workload_min_support}, {present}) AND signals_workload < "
        f"least({scoring.workload_min_feature_signals}, greatest(1, available_workload))"
    )
    cause = (
        f"CASE WHEN ranked[0].score < {scoring.low_threshold!r}D OR ranked[0].score - ranked[1].score < {scoring.margin_threshold!r}D "
        f"THEN 'unknown' WHEN ranked[0].cause = 'workload' AND (available_workload <= 0 OR ({alone})) THEN 'unknown' ELSE ranked[0].cause END"
    )
    return stage(df, {"root_cause": cause, "max_score": "ranked[0].score"})


def events_sql(top_k: int = 3) -> str:
    """The most severe abnormal sensors with a known group, as (feature, type, severity, window_days)."""
    kind = "CASE WHEN s.mode = 'delta' THEN 'spike' WHEN s.direction IN ('high_bad', 'high_warn') THEN 'monotonic_increase' ELSE 'drop' END"
    event = f"struct(s.smart AS feature, {kind} AS type, s.severity AS severity, s.n AS window_days)"
    keyed = (
        "transform(filter(stats, s -> s.current_abnormal AND s.group != 'unknown'), "
        f"s -> struct(-s.severity AS a, -abs(s.deviation_abs) AS b, s.pos AS i, {event} AS e))"
    )
    return f"slice(array_sort({keyed}), 1, {top_k}).e"


def with_target(df: DataFrame) -> DataFrame:
    """The supervised record of a window: events, cause, risk, hardness and confidence; short windows are capped."""
    cap = lambda c, hi: f"if(n_rows < 3, least({c}, {hi}D), {c})"
    df = stage(
        df,
        {
            "events": events_sql(),
            "root_cause": "if(n_rows < 3, 'unknown', root_cause)",
            "risk_hint": cap("least(1.0D, max_score / 2.0D)", 0.30),
            "hardness": cap("least(1.0D, max_score / 2.4D)", 0.30),
            "confidence": cap("least(1.0D, 0.25D + 0.5D * max_score / 2.0D)", 0.35),
        },
    )
    return stage(
        df,
        {
            "near_positive": "risk_hint >= 0.6D",
            "label_noise_risk": "if(root_cause = 'unknown' AND risk_hint > 0.35D, 0.4D, 0.1D)",
        },
    )
