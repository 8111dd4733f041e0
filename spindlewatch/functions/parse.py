"""Reading summaries and raw answers back into typed columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindlewatch.functions.names import SCORED_CAUSES, event_feature
from spindlewatch.functions.scalars import clip01, safe_double

# What a structured summary must contain.
REQUIRED_PREFIXES = [
    "WINDOW:", "DATA_QUALITY:", "RULE_SCORE:", "RULE_TOP2:", "ALLOWED_EVENT_FEATURES:", "ANOMALY_TABLE:", "CAUSE_EVIDENCE:", "RULE_PRED:",
]
TABLE_KEYS = [
    "feat", "src", "mode", "dir", "baseline", "current", "delta_pct", "abnormal_ratio", "persistence", "slope3", "slope14",
    "burst_ratio", "severity", "group",
]
# Shape of a raw answer.
ANSWER_SCHEMA = "root_cause string, risk_hint string, hardness string, confidence string, events array<struct<feature:string,type:string,severity:string>>"


def lines_of(text: Column) -> Column:
    """Trimmed lines. The readers below take this array, so a text is split once however much is read from it."""
    # one plain character is split at without a regular expression
    return F.transform(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: F.trim(x))


def first_line(lines: Column, prefix: str) -> Column:
    """First line that starts with ``prefix``; null if there is none."""
    return F.get(F.filter(lines, lambda x: x.startswith(prefix)), F.lit(0))


def _payload(lines: Column, prefix: str) -> Column:
    return F.coalesce(F.trim(F.regexp_extract(first_line(lines, prefix), r"^[^:]*:(.*)$", 1)), F.lit(""))


def rule_scores(lines: Column) -> Column:
    """The five rule scores of the ``RULE_SCORE:`` line, in cause order; absent ones are 0."""
    line = F.coalesce(first_line(lines, "RULE_SCORE:"), F.lit(""))

    def grab(text):
        number = lambda c: F.regexp_extract(text, c + r"\s*=\s*([0-9]+(?:\.[0-9]+)?)", 1)
        return F.array(*[F.coalesce(number(c).try_cast("double"), F.lit(0.0)) for c in SCORED_CAUSES])

    return F.get(F.transform(F.array(line), grab), F.lit(0))


def top_cause(scores: Column, tie: str = "first") -> Column:
    """Best-scored cause. ``first`` breaks ties by cause order, ``last_name`` by the alphabetically last name."""
    if tie == "last_name":
        pairs = [F.struct(F.get(scores, F.lit(i)).alias("s"), F.lit(c).alias("c")) for i, c in enumerate(SCORED_CAUSES)]
    else:
        pairs = [F.struct(F.get(scores, F.lit(i)).alias("s"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(SCORED_CAUSES)]
    return F.array_max(F.array(*pairs)).c


def top_margin(scores: Column) -> Column:
    s = F.array_sort(scores)
    return F.greatest(F.lit(0.0), F.get(s, F.size(scores) - 1) - F.get(s, F.size(scores) - 2))


def key_values(lines: Column, prefix: str) -> Column:
    """``PREFIX: k=v k=v`` as an array of (feature, value); the last of equal keys counts."""
    tokens = F.filter(F.split(_payload(lines, prefix), r"\s+"), lambda t: F.contains(t, F.lit("=")))
    pairs = F.transform(
        tokens,
        lambda t: F.struct(
            event_feature(F.regexp_extract(t, r"^([^=]*)=", 1)).alias("feature"),
            safe_double(F.regexp_extract(t, r"^[^=]*=(.*)$", 1), 0.0).alias("value"),
        ),
    )
    return F.filter(pairs, lambda p: p.feature != "")


def table_lines(lines: Column) -> Column:
    """Payloads of the rows below ``ANOMALY_TABLE:``, up to the first line that is not a row or says none: one pass over the lines."""
    start = F.struct(F.lit(0).alias("state"), F.array().cast("array<string>").alias("rows"))

    def step(acc, x):
        row = x.startswith("- ") & ~x.rlike(r"(?i)^-\s+none$")
        state = F.when(acc.state == 1, F.when(row, 1).otherwise(2)).when((acc.state == 0) & x.startswith("ANOMALY_TABLE:"), 1).otherwise(acc.state)
        rows = F.when((acc.state == 1) & row, F.concat(acc.rows, F.array(F.trim(F.substr(x, F.lit(3)))))).otherwise(acc.rows)
        return F.struct(state.alias("state"), rows.alias("rows"))

    return F.aggregate(lines, start, step, lambda acc: acc.rows)


def _cell(row: Column, key: str) -> Column:
    return F.trim(F.regexp_extract(row, rf"(?i)(?:^|\|)\s*{key}\s*=([^|]*)", 1))


def anomaly_table(lines: Column) -> Column:
    """Rows of the anomaly table as (feature, persistence, trend_delta, burst_ratio, severity)."""
    rows = F.transform(
        table_lines(lines),
        lambda r: F.struct(
            event_feature(_cell(r, "feat")).alias("feature"),
            clip01(safe_double(_cell(r, "persistence"), 0.0)).alias("persistence"),
            safe_double(_cell(r, "slope14"), 0.0).alias("trend_delta"),
            safe_double(_cell(r, "burst_ratio"), 0.0).alias("burst_ratio"),
            clip01(safe_double(_cell(r, "severity"), 0.0)).alias("severity"),
        ),
    )
    return F.filter(rows, lambda r: r.feature != "")


def allowed_features(lines: Column) -> Column:
    """Features of the ``ALLOWED_EVENT_FEATURES:`` line; without that line, those named in anomaly rows."""
    token = lambda t: (t != "") & (F.lower(t) != "none")
    listed = F.filter(F.split(_payload(lines, "ALLOWED_EVENT_FEATURES:"), r"\s+"), token)
    named = F.transform(
        F.filter(lines, lambda x: x.startswith("- ")),
        lambda x: F.coalesce(
            F.nullif(F.regexp_extract(x, r"(?i)^-\s+(SMART[_\- ]?\d+)\b", 1), F.lit("")),
            F.regexp_extract(x, r"(?i)\bfeat=([^|\s]+)", 1),
        ),
    )
    has_line = F.exists(lines, lambda x: x.startswith("ALLOWED_EVENT_FEATURES:"))
    found = F.when(has_line, listed).otherwise(F.filter(named, lambda t: t != ""))
    return F.array_distinct(F.transform(found, lambda t: event_feature(t)))


def group_signals(lines: Column) -> Column:
    """The ``GROUP_SIGNAL:`` line as (active, available, max_severity) per cause, in cause order."""
    pattern = r"\s*=\s*(\d+)\s*/\s*(\d+)\s*:\s*([0-9]+(?:\.[0-9]+)?)"

    def read(body):
        part = lambda c, i: F.coalesce(F.regexp_extract(body, rf"(?:^|\s){c}{pattern}", i).try_cast("double"), F.lit(0.0))
        one = lambda c: F.struct(part(c, 1).alias("active"), part(c, 2).alias("available"), clip01(part(c, 3)).alias("max_severity"))
        return F.array(*[one(c) for c in SCORED_CAUSES])

    return F.get(F.transform(F.array(_payload(lines, "GROUP_SIGNAL:")), read), F.lit(0))


def missing_blocks(lines: Column) -> Column:
    needed = F.array(*[F.lit(p) for p in REQUIRED_PREFIXES])
    return F.filter(needed, lambda p: ~F.exists(lines, lambda x: F.startswith(x, p)))


def malformed_rows(lines: Column) -> Column:
    """Number of anomaly rows that lack one of the required keys."""
    named = lambda t: F.when(F.contains(t, F.lit("=")), F.lower(F.trim(F.substring_index(t, "=", 1)))).otherwise(F.lit(""))
    keyed = lambda r: F.transform(F.split(r, r"\|"), named)
    need = F.array(*[F.lit(k) for k in TABLE_KEYS])
    return F.size(F.filter(table_lines(lines), lambda r: F.size(F.array_except(need, keyed(r))) > 0))


def json_body(text: Column) -> Column:
    """The object inside a raw answer: code fence removed, first ``{`` to last ``}``; null if there is none."""
    body = F.regexp_extract(F.trim(text), r"(?s)\{.*\}", 0)
    return F.when(body != "", body)
