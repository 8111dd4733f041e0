"""Rules that turn numeric windows into diagnostics: per-sensor rules, scoring thresholds and layered profiles."""
from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlewatch.functions.names import canonical_name


@dataclass(frozen=True)
class Rule:
    label: str = ""
    direction: str = "high_bad"
    group: str = "unknown"
    min_abs_delta: float = 1.0
    min_pct_delta: float = 0.10
    weight: float = 0.70
    mode: str = "level"
    min_points: int = 3
    cap: float = 1.0
    cooldown_days: int = 0


RULE_FIELDS = list(asdict(Rule()))

# Rules for sensors without an entry of their own.
DEFAULT_RAW = Rule()
DEFAULT_NORMALIZED = Rule(direction="low_bad", min_pct_delta=0.02)

# Label, direction, group, min_abs_delta, min_pct_delta, weight, mode, min_points, cap, cooldown_days.
SENSOR_RULES = {
    "smart_5_raw": Rule("SMART 5 Reallocated Sector Count(raw)", "high_bad", "media", 1.0, 0.20, 1.30, "level", 4, 1.0, 0),
    "smart_197_raw": Rule("SMART 197 Current Pending Sector(raw)", "high_bad", "media", 1.0, 0.20, 1.20, "level", 4, 1.0, 0),
    "smart_198_raw": Rule("SMART 198 Offline Uncorrectable(raw)", "high_bad", "media", 1.0, 0.20, 1.20, "level", 4, 1.0, 0),
    "smart_199_raw": Rule("SMART 199 UDMA CRC Error Count(raw)", "high_bad", "interface", 1.0, 0.20, 1.10, "level", 4, 1.0, 0),
    "smart_188_raw": Rule("SMART 188 Command Timeout(raw)", "high_bad", "interface", 1.0, 0.20, 1.10, "level", 4, 1.0, 0),
    "smart_194_raw": Rule("SMART 194 Temperature(raw)", "high_bad", "temperature", 2.0, 0.08, 1.00, "level", 4, 1.0, 1),
    "smart_192_raw": Rule("SMART 192 Power-off Retract Count(raw)", "high_bad", "power", 1.0, 0.15, 1.00, "level", 4, 1.0, 0),
    "smart_193_raw": Rule("SMART 193 Load/Unload Cycle Count(raw)", "high_bad", "power", 1.0, 0.15, 1.00, "level", 4, 1.0, 0),
    "smart_9_raw": Rule("SMART 9 Power-on Hours(raw)", "high_warn", "workload", 6.0, 0.30, 0.55, "delta", 6, 0.9, 1),
    "smart_5_normalized": Rule("SMART 5 Normalized Health", "low_bad", "media", 1.0, 0.02, 1.20, "level", 4, 1.0, 0),
    "smart_197_normalized": Rule("SMART 197 Normalized Health", "low_bad", "media", 1.0, 0.02, 1.20, "level", 4, 1.0, 0),
    "smart_198_normalized": Rule("SMART 198 Normalized Health", "low_bad", "media", 1.0, 0.02, 1.10, "level", 4, 1.0, 0),
    "smart_199_normalized": Rule("SMART 199 Normalized Health", "low_bad", "interface", 1.0, 0.02, 1.00, "level", 4, 1.0, 0),
    "smart_194_normalized": Rule("SMART 194 Normalized Health", "low_bad", "temperature", 1.0, 0.02, 1.00, "level", 4, 1.0, 0),
}


@dataclass(frozen=True)
class Scoring:
    """Scoring thresholds."""

    top_k_per_group: int = 3
    low_threshold: float = 0.30
    margin_threshold: float = 0.08
    abnormal_multiplier: float = 1.00
    watch_multiplier: float = 0.45
    watch_ratio_threshold: float = 0.20
    watch_severity_threshold: float = 0.15
    recency_horizon_days: int = 14
    workload_support_threshold: float = 0.10
    workload_min_support: int = 1
    workload_min_feature_signals: int = 1


def default_source(feature: str) -> str:
    """Which default family (raw or normalized) a sensor belongs to."""
    return "normalized" if canonical_name(feature).endswith("_normalized") else "raw"


def rule_for(feature: str, rules: dict[str, Rule] | None = None) -> Rule:
    key = canonical_name(feature)
    known = SENSOR_RULES if rules is None else rules
    if key in known:
        return known[key]
    return replace(DEFAULT_NORMALIZED if default_source(feature) == "normalized" else DEFAULT_RAW, label=key or feature)


def _literal(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "\\'") + "'"
    return f"{v!r}D" if isinstance(v, float) else str(v)


def rules_sql(features: list[str], rules: dict[str, Rule] | None = None) -> str:
    """The rules of the given sensors as a literal array of structs, so that wide rows fan out without a join (SQL text)."""
    items = []
    for i, feature in enumerate(features):
        values = {"pos": i, "feature": feature, "src": default_source(feature), **asdict(rule_for(feature, rules))}
        items.append("named_struct(" + ", ".join(f"'{k}', {_literal(v)}" for k, v in values.items()) + ")")
    return "array(" + ", ".join(items) + ")"


def merge_layers(layers: list[DataFrame], key: str = "feature", fields: list[str] | None = None) -> DataFrame:
    """Field-by-field overlay of rule or policy tables, the last non-null layer winning.

    Every layer has one row per key. One tagged union and one aggregation replace a chain of outer joins.
    """
    fields = fields or [c for c in layers[0].columns if c != key]
    tagged = None
    for rank, layer in enumerate(layers):
        part = layer.select(key, *[F.col(f) if f in layer.columns else F.lit(None).alias(f) for f in fields], F.lit(rank).alias("_rank"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("_rank"))).alias(f) for f in fields])
