"""From raw answers to a typed record, a quality score and a feature vector.

Everything is an expression on one row: at most three events, the parsed summary and literal vocabularies.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlewatch.functions import parse
from spindlewatch.functions.names import EVENT_TYPES, ROOT_CAUSES, SCORED_CAUSES, event_feature, event_type, normalize_cause
from spindlewatch.functions.scalars import clip01, half_even_sql, round_half_even, safe_double
from spindlewatch.operators.windows import stage

# Sensors of the default event mapping.
DEFAULT_EVENT_FEATURES = [
    "SMART_1", "SMART_3", "SMART_4", "SMART_5", "SMART_7", "SMART_8", "SMART_9", "SMART_10", "SMART_12", "SMART_187", "SMART_188",
    "SMART_189", "SMART_190", "SMART_191", "SMART_194", "SMART_197",
]
META_DIM = 16


@dataclass(frozen=True)
class EventMapping:
    features: tuple[str, ...] = tuple(DEFAULT_EVENT_FEATURES)
    types: tuple[str, ...] = tuple(EVENT_TYPES)

    @property
    def dim(self) -> int:
        return META_DIM + len(self.features) * len(self.types)


@dataclass(frozen=True)
class AnswerRules:
    rule_gate: float = 0.80
    rule_soft_gate: float = 0.55
    blend: str = "three_stage"
    strict_types: bool = False
    quality_gate: float = 0.0
    severity_sum_gate: float = 0.0
    require_rule_match: bool = False
    whitelist: bool = False
    strict_allowed: bool = False
    min_events: int = 0


def parse_answers(df: DataFrame, raw: str = "raw_text", repaired: str | None = None) -> DataFrame:
    """Adds ``record`` and ``parse_source``: the direct text, else the repaired text, else a default record.

    Bodies and records are columns of their own, so each text is parsed once.
    """
    second = F.col(repaired) if repaired else F.lit(None).cast("string")
    df = df.withColumns({"_b1": parse.json_body(F.col(raw)), "_b2": parse.json_body(second)})
    read = lambda c: F.from_json(c, parse.ANSWER_SCHEMA, {"mode": "PERMISSIVE"})
    keys = lambda c: F.coalesce(F.size(F.json_object_keys(c)), F.lit(0)) > 0
    df = df.withColumns({"_ok1": keys(F.col("_b1")), "_ok2": keys(F.col("_b2"))})
    default = F.lit('{"root_cause":"unknown","risk_hint":"0","hardness":"0","confidence":"0","events":[]}')
    body = F.when(F.col("_ok1"), F.col("_b1")).when(F.col("_ok2"), F.col("_b2")).otherwise(default)
    source = F.when(F.col("_ok1"), "direct").when(F.col("_ok2"), "repair").otherwise("default")
    return df.withColumns({"record": read(body), "parse_source": source}).drop("_b1", "_b2", "_ok1", "_ok2")


def _unit(c: Column, digits: int = 2) -> Column:
    return round_half_even(clip01(safe_double(c, 0.0)), digits)


def default_derived(df: DataFrame) -> DataFrame:
    """near_positive and label_noise_risk from cause and risk."""
    return stage(
        df,
        {
            "near_positive": "risk_hint >= 0.6D",
            "label_noise_risk": "if(root_cause = 'unknown' AND risk_hint > 0.35D, 0.4D, 0.1D)",
        },
    )


def normalize(df: DataFrame, mapping: EventMapping | None = None, rules: AnswerRules = AnswerRules(), summary: str = "summary_text") -> DataFrame:
    """Cleans an answer against its summary: events, blended cause, quality score, event gates and rule agreement."""
    return blend(prepare(df, mapping, rules, summary), rules)


#: What ``blend`` reads besides the cleaned values.
_READY = ["_cause", "_top", "_tops", "_topg"]


def prepare(df: DataFrame, mapping: EventMapping | None = None, rules: AnswerRules = AnswerRules(), summary: str = "summary_text") -> DataFrame:
    """The part of ``normalize`` that reads texts. Of the rules it follows strict_types, strict_allowed and whitelist only, so
    several rules that agree on these can be blended from one stored result."""
    text = F.col("_lines")
    mapped = list(mapping.features) if mapping else []
    df = df.withColumn("_lines", parse.lines_of(F.col(summary)))
    df = df.withColumns(
        {
            "_cause": normalize_cause(F.col("record.root_cause")),
            "risk_hint": _unit(F.col("record.risk_hint")),
            "hardness": _unit(F.col("record.hardness")),
            "confidence": _unit(F.col("record.confidence")),
            "_kv_p": parse.key_values(text, "ANOMALY_PERSISTENCE:"),
            "_kv_t": parse.key_values(text, "TREND_DELTA:"),
            "_tab": parse.anomaly_table(text),
            "_allowed": parse.allowed_features(text),
            "_scores": parse.rule_scores(text),
            "_groups": parse.group_signals(text),
            "_mapped": F.array(*[F.lit(m) for m in mapped]).cast("array<string>"),
            "_raw": F.coalesce(F.expr("filter(record.events, e -> e IS NOT NULL)"), F.expr("filter(record.events, e -> false)")),
        }
    )
    df = df.withColumn(
        "_ev",
        F.transform(
            F.slice(F.coalesce("_raw", F.expr("from_json('[]', 'array<struct<feature:string,type:string,severity:string>>')")), 1, 3),
            lambda e: F.struct(
                event_feature(e["feature"], mapped).alias("feature"),
                event_type(e["type"]).alias("type"),
                clip01(safe_double(e["severity"], 0.0)).alias("severity"),
            ),
        ),
    )
    last = lambda arr, field: f"get(reverse(filter({arr}, t -> t.feature = e.feature)), 0).{field}"
    df = stage(
        df,
        {
            "llm_event_count": "coalesce(size(_raw), 0)",
            "_ev": "transform(_ev, e -> named_struct('feature', e.feature, 'type', e.type, 'severity', e.severity, "
            f"'p', greatest(0.0D, least(1.0D, coalesce({last('_tab', 'persistence')}, {last('_kv_p', 'value')}, 0.0D))), "
            f"'t', coalesce({last('_tab', 'trend_delta')}, {last('_kv_t', 'value')}, 0.0D), "
            f"'b', coalesce({last('_tab', 'burst_ratio')}, 0.0D)))",
        },
    )
    kind = "e.type"
    if rules.strict_types:
        # Burst 1.35, falling trend -0.03, persistent rise 0.55
        kind = (
            "CASE WHEN e.b >= 1.35D THEN 'spike' WHEN e.t <= -0.03D THEN 'drop' WHEN e.t > 0 THEN 'monotonic_increase' "
            "WHEN e.t < 0 THEN 'drop' WHEN e.type = '' THEN 'monotonic_increase' ELSE e.type END"
        )
    unlisted = "size(_allowed) > 0 AND NOT array_contains(_allowed, e.feature)"
    unmapped = "size(_mapped) > 0 AND NOT array_contains(_mapped, e.feature)"
    drop = f"({unlisted})" if rules.strict_allowed else f"(({unlisted}) AND ({unmapped}))"
    if rules.whitelist:
        drop += f" OR ({unmapped})"
    # An event on a sensor outside the allowed list keeps 85 % of its severity
    df = stage(
        df,
        {
            "_ev": f"transform(_ev, e -> named_struct('feature', e.feature, 'type', {kind}, 'severity', {half_even_sql('e.severity', 2)}, "
            f"'miss', {unlisted}, 'persistence', {half_even_sql('e.p', 2)}, 'trend_delta', {half_even_sql('e.t', 3)}))"
        },
    )
    df = stage(df, {"_ev": f"filter(_ev, e -> e.feature != '' AND e.type != '' AND NOT ({drop}))"})
    df = stage(
        df,
        {
            "_ev": "transform(_ev, e -> named_struct('feature', e.feature, 'type', e.type, 'severity', if(e.miss, e.severity * 0.85D, e.severity), "
            "'persistence', e.persistence, 'trend_delta', e.trend_delta))"
        },
    )
    df = stage(
        df,
        {
            "events": f"transform(_ev, e -> named_struct('feature', e.feature, 'type', e.type, 'severity', {half_even_sql('e.severity', 2)}, "
            "'persistence', e.persistence, 'trend_delta', e.trend_delta))"
        },
    )
    df = df.withColumn("_top", parse.top_cause(F.col("_scores")))
    causes = ", ".join(f"'{c}'" for c in SCORED_CAUSES)
    df = stage(df, {"_topg": f"get(_groups, array_position(array({causes}), _top) - 1)", "_tops": "array_max(_scores)"})
    return df.drop(*[c for c in df.columns if c.startswith("_") and c not in _READY])


def blend(df: DataFrame, rules: AnswerRules) -> DataFrame:
    """Cause, scores and gates from what ``prepare`` read; no text is read here."""
    hi = max(0.0, rules.rule_gate)
    soft = min(max(0.0, rules.rule_soft_gate), hi)
    three = rules.blend != "hard_gate"
    if three:
        # Confidence and risk that keep a dissenting answer, or accept the rule
        cause = (
            f"CASE WHEN _tops >= {hi!r}D THEN _top WHEN _tops >= {soft!r}D THEN CASE WHEN _cause = _top THEN _top "
            "WHEN _cause != 'unknown' AND confidence >= 0.80D AND risk_hint >= 0.75D THEN _cause "
            "WHEN confidence >= 0.62D AND risk_hint >= 0.55D THEN _top ELSE 'unknown' END ELSE 'unknown' END"
        )
    else:
        cause = f"if(_tops >= {hi!r}D, _top, 'unknown')"
    df = stage(df, {"_blended": cause, "_n": "cast(size(events) AS double)"})
    base = "least(confidence, risk_hint) * (1.0D - if(_blended = 'unknown' AND risk_hint > 0.35D, 0.4D, 0.1D))"
    persist = "coalesce(try_divide(aggregate(events.persistence, 0.0D, (a, p) -> a + p), _n), 0.0D)"
    rising = "coalesce(try_divide(cast(size(filter(events, e -> e.trend_delta > 0)) AS double), _n), 0.0D)"
    df = stage(df, {"_q": f"greatest(0.0D, least(1.0D, 0.75D * ({base}) + 0.20D * {persist} + 0.05D * {rising}))"})
    df = stage(df, {"llm_q_score": half_even_sql("_q", 4)})
    gates = []
    if rules.quality_gate > 0:
        gates.append(f"llm_q_score < {rules.quality_gate!r}D")
    if rules.require_rule_match:
        gates.append("_blended != _top")
    none = " OR ".join(gates) or "false"
    df = stage(df, {"events": f"if({none}, slice(events, 1, 0), events)"})
    if rules.severity_sum_gate > 0:
        total = "aggregate(events.severity, 0.0D, (a, s) -> a + s)"
        df = stage(df, {"events": f"if({total} < {rules.severity_sum_gate!r}D, slice(events, 1, 0), events)"})
    if rules.min_events > 0:
        df = stage(df, {"events": f"if(size(events) < {rules.min_events}, slice(events, 1, 0), events)"})
    relaxed = "_blended"
    if three:
        # The two relaxations towards the rule's cause
        strong = (
            f"_tops >= {soft * 0.75!r}D AND size(events) >= 1 AND coalesce(array_max(events.severity), 0.0D) >= 0.70D AND llm_q_score >= 0.35D"
        )
        grouped = (
            f"cast(_topg.active AS int) >= 1 AND _topg.max_severity >= 0.60D AND llm_q_score >= 0.25D AND _tops >= {soft * 0.55!r}D"
        )
        relaxed = f"if(_blended = 'unknown' AND (({strong}) OR ({grouped})), _top, _blended)"
    df = stage(df, {"root_cause": relaxed, "llm_mapped_event_count": "size(events)", "llm_rule_top_cause": "_top"})
    df = stage(df, {"_ratio": "coalesce(try_divide(cast(llm_mapped_event_count AS double), llm_event_count), 0.0D)"})
    df = stage(
        df,
        {
            "llm_rule_match": "root_cause = llm_rule_top_cause",
            "llm_rule_top_score": half_even_sql("_tops", 4),
            "llm_mapped_event_ratio": half_even_sql("_ratio", 4),
        },
    )
    df = default_derived(df)
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def with_vector(df: DataFrame, mapping: EventMapping = EventMapping()) -> DataFrame:
    """Adds ``z``: one-hot cause, ten summary values, then the largest severity per (sensor, event type)."""
    feats = "array(" + ", ".join(f"'{f}'" for f in mapping.features) + ")"
    types = "array(" + ", ".join(f"'{t}'" for t in mapping.types) + ")"
    nt, ne = len(mapping.types), len(mapping.features) * len(mapping.types)
    df = stage(
        df,
        {
            "_m": f"filter(transform(events, e -> named_struct('f', array_position({feats}, e.feature), 't', array_position({types}, e.type), "
            "'s', e.severity, 'p', e.persistence, 'd', greatest(0.0D, least(1.0D, e.trend_delta)))), m -> m.f > 0 AND m.t > 0)"
        },
    )
    total = lambda f: f"aggregate(_m.{f}, 0.0D, (a, x) -> a + x)"
    df = stage(
        df,
        {
            "_k": f"transform(_m, m -> named_struct('i', cast((m.f - 1) * {nt} + m.t - 1 AS int), 'w', if(m.s > 0, m.s, 1.0D)))",
            "_cnt": "cast(size(_m) AS double)",
            "_ms": "coalesce(array_max(_m.s), 0.0D)",
            "_mp": "coalesce(array_max(_m.p), 0.0D)",
            "_as": f"coalesce(try_divide({total('s')}, size(_m)), 0.0D)",
            "_ap": f"coalesce(try_divide({total('p')}, size(_m)), 0.0D)",
            "_at": f"coalesce(try_divide({total('d')}, size(_m)), 0.0D)",
        },
    )
    onehot = ", ".join(f"if(root_cause = '{c}', 1.0D, 0.0D)" for c in ROOT_CAUSES)
    meta = (
        f"array({onehot}, risk_hint, hardness, label_noise_risk, confidence, if(near_positive, 1.0D, 0.0D), least(1.0D, _cnt / 10.0D), _ms, "
        "least(1.0D, 0.6D * _as + 0.4D * _ap), if(_mp > 0, least(1.0D, 0.5D * _mp), 0.0D), least(1.0D, _at))"
    )
    slots = f"transform(sequence(0, {ne - 1}), i -> coalesce(array_max(filter(_k, k -> k.i = i).w), 0.0D))"
    df = stage(df, {"z": f"concat({meta}, {slots})"})
    return df.drop("_m", "_k", "_cnt", "_ms", "_mp", "_as", "_ap", "_at")


def _fill(text: Column, template: str) -> Column:
    def body(lines):
        allowed = F.array_join(parse.allowed_features(lines), " ")
        listed = F.replace(F.lit(template), F.lit("{allowed_features}"), F.when(allowed == "", "none").otherwise(allowed))
        return F.replace(listed, F.lit("{summary}"), text)

    # the lines are bound once, as what reads them does so several times
    return F.get(F.transform(F.array(parse.lines_of(text)), body), F.lit(0))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def reference_messages(references: Column, template: str) -> Column:
    """One user/assistant pair per usable reference; none for no references. They do not depend on the window, so a table's
    references can be written out once for all of its windows."""
    usable = F.filter(references, lambda r: r.summary_text.isNotNull() & (r.summary_text != "") & r.target_json.isNotNull())
    shots = F.flatten(F.transform(usable, lambda r: F.array(_message("user", _fill(r.summary_text, template)), _message("assistant", r.target_json))))
    return F.coalesce(shots, F.array().cast("array<struct<role:string,content:string>>"))


def prompt_messages(summary: Column, references: Column, system: str, template: str, written: bool = False) -> Column:
    """Chat messages: system text, one user/assistant pair per reference, then the window itself.

    ``references`` is an array of (summary_text, target_json) structs, or with ``written`` what ``reference_messages`` made of it;
    ``template`` has {summary} and {allowed_features}.
    """
    shots = references if written else reference_messages(references, template)
    return F.concat(F.array(_message("system", F.lit(system))), shots, F.array(_message("user", _fill(summary, template))))
