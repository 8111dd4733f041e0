"""Gates on cached vectors: model policies, variants and the temporal rewrite."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindlewatch.functions.names import ROOT_CAUSES, model_key, normalize_cause_list
from spindlewatch.functions.scalars import clip01, safe_double, to_bool
from spindlewatch.operators.windows import stage
from spindlewatch.session import checked_broadcast

# Named dimension sets and the default dimensions of the dense pack.
KEEP_PRESETS = {
    "event_top3_plus_meta": [6, 7, 9, 11, 12, 13, 16, 34, 46],
    "event_top8_plus_meta": [6, 7, 9, 11, 12, 13, 46, 34, 16, 25, 31, 55, 28, 37],
}
DENSE_DIMS = "60,61,62,63,64,65,66,67,68,69"
VARIANT_META_DIMS = [6, 7, 9, 11, 12, 13]
# Names accepted for the leading sixteen dimensions.
META_NAMES = {
    **{f"{p}_{c}": i for p in ("root", "root_cause") for i, c in enumerate(["media", "interface", "temperature", "power", "workload", "unknown"])},
    "risk_hint": 6, "hardness": 7, "label_noise_risk": 8, "confidence": 9, "near_positive": 10, "mapped_event_count": 11,
    "event_count_norm": 11, "max_event_severity": 12, "severity_persistence": 13, "persistence": 14, "trend_positive": 15,
}
POLICY_SCHEMA = (
    "model_key string, enabled boolean, min_q_score double, min_rule_match boolean, min_mapped_event_ratio double, "
    "drop_unknown_root boolean, allowed_root_causes array<string>, llm_scale_alpha double, gate_mode string, soft_min_weight double, "
    "keep_dims array<int>, dense_meta_pack boolean, dense_meta_scale double, dense_meta_dims array<int>, fallback string"
)
# What a policy says when it says nothing.
POLICY_DEFAULT = {
    "enabled": True, "min_q_score": 0.0, "min_rule_match": False, "min_mapped_event_ratio": 0.0, "drop_unknown_root": False,
    "allowed_root_causes": [], "llm_scale_alpha": 1.0, "gate_mode": "hard", "soft_min_weight": 0.0, "keep_dims": "all",
    "dense_meta_pack": False, "dense_meta_scale": 1.0, "dense_meta_dims": DENSE_DIMS, "fallback": "nollm",
}


def keep_dims(spec, dim: int) -> list[int] | None:
    """Dimensions named by a preset, a comma list, a number or a list; None means all."""
    if spec is None or (isinstance(spec, str) and spec.strip().lower() in ("", "all")):
        return None
    if isinstance(spec, str):
        key = spec.strip().lower()
        if key in KEEP_PRESETS:
            return [d for d in KEEP_PRESETS[key] if d < dim]
        tokens = [t.strip() for t in key.split(",")]
        found = [int(t) for t in tokens if t.lstrip("+-").isdigit()]
        if not found and "," not in key:
            return None
    else:
        found = [int(t) for t in spec if str(t).lstrip("+-").isdigit()]
    inside = sorted({d for d in found if 0 <= d < dim})
    return inside if inside or not isinstance(spec, str) or "," in spec else None


def semantic_dims(event_keys: list[str], meta_keys: list[str], features: list[str], types: list[str], meta_dim: int = 16) -> list[int]:
    """Dimensions by name: ``all_meta``, meta names or numbers; ``SMART_5``, ``SMART_5:spike``, ``SMART_5:all``, ``all_events``."""
    out: list[int] = []
    if not meta_keys:
        out += [d for d in VARIANT_META_DIMS if d < meta_dim]
    for key in (k.strip().lower() for k in meta_keys):
        if key in ("all_meta", "meta_all"):
            out = list(range(meta_dim))
            break
        d = int(key) if key.isdigit() else META_NAMES.get(key, -1)
        if 0 <= d < meta_dim:
            out.append(d)
    slot = {(f, t): meta_dim + i * len(types) + j for i, f in enumerate(features) for j, t in enumerate(types)}
    for key in (k.strip() for k in event_keys):
        name, _, kind = key.partition(":")
        everything = name.lower() in ("all_events", "events_all")
        want = name.upper().replace("-", "_").replace(" ", "_")
        kind = kind.strip().lower()
        out += [d for (f, t), d in slot.items() if (everything or f == want) and kind in ("", "all", "*", t)]
    return list(dict.fromkeys(out))


# Words of a policy that mean yes and no.
YES_WORDS = ["1", "true", "yes", "y", "on"]
NO_WORDS = ["0", "false", "no", "n", "off"]


def policy_flag(value, default: bool) -> bool:
    """A policy's yes or no, also as text; an empty or unknown word leaves the default."""
    word = str(value).strip().lower()
    return word in YES_WORDS if word in YES_WORDS + NO_WORDS else bool(default)


def policy_causes(value) -> list[str]:
    """Allowed causes from a list or text with commas, each once; what is no cause counts as unknown."""
    words = value.split(",") if isinstance(value, str) else list(value or [])
    causes = [w if w in ROOT_CAUSES else "unknown" for w in (str(x).strip().lower() for x in words)]
    return list(dict.fromkeys(causes))


def policy_table(spark: SparkSession, policies: dict[str, dict], dim: int) -> DataFrame:
    """One validated row per model key. ``policies`` maps a model to its overrides; ``default`` applies to all."""
    clip = lambda v: min(1.0, max(0.0, float(v or 0.0)))
    rows = []
    for name, override in policies.items():
        if name == "default":
            continue
        p = {**POLICY_DEFAULT, **policies.get("default", {}), **override}
        key = "".join(ch for ch in name.lower() if ch.isascii() and ch.isalnum())
        mode = str(p["gate_mode"]).strip().lower()
        rows.append(
            (
                key, policy_flag(p["enabled"], POLICY_DEFAULT["enabled"]), clip(p["min_q_score"]), policy_flag(p["min_rule_match"], POLICY_DEFAULT["min_rule_match"]), clip(p["min_mapped_event_ratio"]),
                policy_flag(p["drop_unknown_root"], POLICY_DEFAULT["drop_unknown_root"]), policy_causes(p["allowed_root_causes"]), clip(p["llm_scale_alpha"]), mode if mode in ("hard", "soft") else "hard",
                clip(p["soft_min_weight"]), keep_dims(p["keep_dims"], dim), policy_flag(p["dense_meta_pack"], POLICY_DEFAULT["dense_meta_pack"]), clip(p["dense_meta_scale"]),
                keep_dims(p["dense_meta_dims"], dim), p["fallback"] if p["fallback"] in ("nollm", "zero") else "nollm",
            )
        )
    return spark.createDataFrame(rows, POLICY_SCHEMA)


def join_cache(rows: DataFrame, cache: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """Left join of a cache on its key; a miss gets a zero vector and ``cache_hit`` = false."""
    joined = rows.join(cache.withColumn("cache_hit", F.lit(True)), keys, "left")
    zero = F.array_repeat(F.lit(0.0), dim)
    return joined.withColumns({"z": F.coalesce("z", zero), "cache_hit": F.coalesce("cache_hit", F.lit(False))})


def cache_misses(rows: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Keys without a cache row."""
    return rows.select(*keys).join(cache.select(*keys), keys, "left_anti")


def gate_signals(df: DataFrame) -> DataFrame:
    """The cleaned signals every gate reads (``g_*``)."""
    num = lambda c: safe_double(F.col(c), 0.0) if c in df.columns else F.lit(0.0)
    conf, risk, noise = clip01(num("confidence")), clip01(num("risk_hint")), clip01(num("label_noise_risk"))
    q = clip01(num("llm_q_score")) if "llm_q_score" in df.columns else F.least(conf, risk) * (1.0 - noise)
    if "llm_mapped_event_ratio" in df.columns:
        ratio = clip01(num("llm_mapped_event_ratio"))
    else:
        ratio = clip01(num("llm_mapped_event_count") / F.when(num("llm_event_count") > 0, num("llm_event_count")).otherwise(1.0))
    match = to_bool(F.col("llm_rule_match")) if "llm_rule_match" in df.columns else F.lit(False)
    root = F.col("root_cause_pred") if "root_cause_pred" in df.columns else F.col("root_cause")
    return df.withColumns(
        {
            "g_q": q, "g_ratio": ratio, "g_match": match, "g_root": normalize_cause_list(root), "g_conf": conf, "g_risk": risk,
            "g_hard": clip01(num("hardness")), "g_events": clip01(num("llm_event_count") / 3.0),
            "g_mapped": clip01(num("llm_mapped_event_count") / 3.0), "g_top": clip01(num("llm_rule_top_score")),
        }
    )


def apply_policy(cache: DataFrame, policy: DataFrame, model: str = "model") -> DataFrame:
    """Gates every vector by its model's policy: ``z`` scaled and masked, ``kept``, ``weight`` and the ``drop_*`` flags.

    The policy registry has one row per model key and is broadcast after its size was checked; models without a policy pass as is.
    """
    df = gate_signals(cache).withColumn("model_key", model_key(F.col(model)))
    df = df.join(checked_broadcast(policy), "model_key", "left")
    df = stage(
        df,
        {
            "enabled": "coalesce(enabled, true)",
            "soft": "coalesce(gate_mode, 'hard') = 'soft'",
            "_floor": "coalesce(soft_min_weight, 0.0D)",
            "_alpha": "coalesce(llm_scale_alpha, 1.0D)",
            "_minq": "coalesce(min_q_score, 0.0D)",
            "_minr": "coalesce(min_mapped_event_ratio, 0.0D)",
            "_need": "coalesce(min_rule_match, false)",
            "_noun": "coalesce(drop_unknown_root, false)",
            "_only": "size(coalesce(allowed_root_causes, array())) > 0",
        },
    )
    df = stage(
        df,
        {
            "drop_root_unknown": "enabled AND _noun AND g_root = 'unknown'",
            "drop_root_cause": "enabled AND _only AND NOT array_contains(allowed_root_causes, g_root)",
            "drop_q": "enabled AND _minq > 0 AND g_q < _minq",
            "drop_rule": "enabled AND _need AND NOT g_match",
            "drop_map": "enabled AND _minr > 0 AND g_ratio < _minr",
        },
    )
    ramp = lambda v, lo: f"greatest(0.0D, least(1.0D, ({v} - {lo}) / greatest(1.0D - {lo}, 1e-6D)))"
    weight = (
        f"if(_minq > 0, {ramp('g_q', '_minq')}, g_q) * if(_minr > 0, {ramp('g_ratio', '_minr')}, 1.0D) * if(_need AND NOT g_match, 0.0D, 1.0D) "
        "* if(drop_root_unknown OR drop_root_cause, 0.0D, 1.0D) * _alpha"
    )
    df = stage(df, {"_w": weight, "_hard": "enabled AND NOT (drop_root_unknown OR drop_root_cause OR drop_q OR drop_rule OR drop_map)"})
    df = stage(df, {"_w": "if(_w > 0, least(1.0D, greatest(_w, _floor)), 0.0D)"})
    df = stage(df, {"weight": "CASE WHEN enabled AND soft THEN _w WHEN _hard THEN _alpha ELSE 1.0D END", "soft_weight": "if(enabled AND soft, _w, 1.0D)", "kept": "if(enabled AND soft, _w > 0, _hard)"})
    signals = "array(g_q, g_ratio, if(g_match, 1.0D, 0.0D), g_conf, g_risk, g_hard, g_events, g_mapped, if(g_root != 'unknown', 1.0D, 0.0D), g_top)"
    df = stage(
        df,
        {
            "_pack": f"if(coalesce(dense_meta_pack, false) AND coalesce(dense_meta_scale, 1.0D) > 0, transform({signals}, s -> s * dense_meta_scale), NULL)",
            "_at": "coalesce(dense_meta_dims, cast(array() AS array<int>))",
        },
    )
    # order: weight, keep-dims, dense pack on top, and a dropped row ends up all zero
    value = (
        "CASE WHEN NOT kept THEN 0.0D WHEN _pack IS NOT NULL AND array_contains(_at, i) THEN get(_pack, cast((array_position(_at, i) - 1) % 10 AS int)) "
        "WHEN keep_dims IS NOT NULL AND NOT array_contains(keep_dims, i) THEN 0.0D ELSE coalesce(v, 0.0D) * weight END"
    )
    df = stage(df, {"z": f"transform(z, (v, i) -> {value})"})
    drop = [c for c in df.columns if c.startswith(("_", "g_"))]
    return df.drop(*drop, *[c for c in policy.columns if c not in ("model_key", "enabled")], "soft")


def gate_report(gated: DataFrame, by: list[str]) -> DataFrame:
    """Totals per group: kept, dropped and the number of rows every condition rejects."""
    return gated.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("kept").alias("kept"),
        F.count_if(~F.col("kept")).alias("dropped"),
        *[F.count_if(f"drop_{r}").alias(f"dropped_{r}") for r in ("q", "rule", "map", "root_unknown", "root_cause")],
        F.avg("soft_weight").alias("mean_weight"),
    )


def cache_variant(
    cache: DataFrame,
    q_gate: float = 0.0,
    severity_sum_gate: float = 0.0,
    rule_top: DataFrame | None = None,
    keys: tuple[str, ...] = ("disk", "day"),
    dims: list[int] | None = None,
    event_dims: list[int] | None = None,
    dim: int = 64,
    compact: bool = False,
    root: str = "root_cause",
) -> DataFrame:
    """A gated copy of a cache. Rows that fail keep their key and get a zero vector; ``reason`` names the first failed gate.

    ``rule_top`` (keys, ``rule_top``) asks for agreement with the rules; ``dims`` are the kept dimensions in output order (all when
    None), ``event_dims`` those whose severities are summed.
    """
    df = cache
    if rule_top is not None:
        df = df.join(rule_top.select(*keys, "rule_top"), list(keys), "left")
    df = df.withColumns(
        {
            "_root": F.lower(F.trim(F.coalesce(F.col(root), F.lit("unknown")))),
            "_q": F.least(safe_double(F.col("confidence"), 0.0), safe_double(F.col("risk_hint"), 0.0))
            * (1.0 - clip01(safe_double(F.col("label_noise_risk"), 0.0))),
        }
    )
    summed = "slice(z, 17, size(z))" if dims is None else "array(" + ", ".join(f"z[{d}]" for d in (event_dims or [])) + ")"
    total = f"aggregate(transform({summed}, v -> coalesce(cast(v AS double), 0.0D)), 0.0D, (a, v) -> a + v)"
    rule = "false"
    if rule_top is not None:
        rule = "rule_top IS NULL OR _root != rule_top"
    reason = (
        f"CASE WHEN _root = 'unknown' THEN 'unknown' WHEN _q < {q_gate!r}D THEN 'q' WHEN {rule} THEN 'rule' "
        f"WHEN {total} < {severity_sum_gate!r}D THEN 'severity' ELSE 'kept' END"
    )
    df = stage(df, {"reason": reason})
    if rule_top is not None:
        df = stage(df, {"missing_rule": "reason = 'rule' AND rule_top IS NULL"})
    if dims is None:
        body = "transform(z, v -> if(reason = 'kept', coalesce(v, 0.0D), 0.0D))"
    elif compact:
        body = f"transform(array({', '.join(map(str, dims))}), d -> if(reason = 'kept', coalesce(get(z, d), 0.0D), 0.0D))"
    else:
        kept = f"array({', '.join(map(str, dims))})"
        body = f"transform(z, (v, i) -> if(reason = 'kept' AND array_contains({kept}, i), coalesce(v, 0.0D), 0.0D))"
    df = stage(df, {"z": body})
    return df.drop("_root", "_q", *(["rule_top"] if rule_top is not None else []))


def variant_report(variant: DataFrame, by: list[str] = ()) -> DataFrame:
    reasons = ["unknown", "q", "rule", "severity"]
    missing = F.count_if("missing_rule") if "missing_rule" in variant.columns else F.lit(0).cast("bigint")
    out = variant.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("reason") == "kept").alias("kept"),
        *[F.count_if(F.col("reason") == r).alias(f"drop_{r}") for r in reasons],
        missing.alias("missing_rule_key"),
    )
    return out.withColumn("kept_ratio", F.coalesce(F.try_divide(F.col("kept"), F.col("total")), F.lit(0.0)))


# rows after which the oldest value of a span-7 average has less weight than a double can hold next to it
EMA_MEMORY = 160


def ema_sql(values: str, span: int) -> str:
    a = 2.0 / (span + 1.0)
    return f"aggregate(slice({values}, 2, size({values})), get({values}, 0), (p, v) -> {a!r}D * v + {1.0 - a!r}D * p)"


def temporal_dense(cache: DataFrame, rules: DataFrame | None = None, streak_cap: int = 7, disk: str = "disk", day: str = "day") -> DataFrame:
    """Replaces ``z`` by 14 features that carry the disk's recent history.

    ``rules`` (disk, day, rule_top, rule_margin) adds rule margin and agreement. Averages fold the last rows of a disk inside a
    bounded frame; the streak of known causes is the distance to the last unknown one.
    """
    df = cache
    if rules is not None:
        df = df.join(rules.select(disk, day, "rule_top", "rule_margin", F.lit(True).alias("has_rule")), [disk, day], "left")
    else:
        df = stage(df, {"rule_top": "cast(NULL AS string)", "rule_margin": "cast(NULL AS double)", "has_rule": "false"})
    root = "root_cause_pred" if "root_cause_pred" in cache.columns else "root_cause"
    df = df.withColumns(
        {
            "_risk": clip01(safe_double(F.col("risk_hint"), 0.0)),
            "_conf": clip01(safe_double(F.col("confidence"), 0.0)),
            "_noise": clip01(safe_double(F.col("label_noise_risk"), 0.0)),
            "_root": F.lower(F.trim(F.coalesce(F.col(root), F.lit("unknown")))),
        }
    )
    df = stage(df, {"_q": "least(_risk, _conf) * (1.0D - _noise)"})
    w = Window.partitionBy(disk).orderBy(day)
    recent = w.rowsBetween(-(EMA_MEMORY - 1), 0)
    df = df.withColumns(
        {
            "_risks": F.collect_list("_risk").over(recent),
            "_qs": F.collect_list("_q").over(recent),
            "_n": F.row_number().over(w),
        }
    )
    df = df.withColumn("_reset", F.max(F.when(F.col("_root") == "unknown", F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = stage(
        df,
        {
            "_streak": f"least(_n - coalesce(_reset, 0), {streak_cap}) / cast({max(streak_cap, 1)} AS double)",
            **{f"_r{s}": ema_sql("_risks", s) for s in (3, 7)},
            **{f"_q{s}": ema_sql("_qs", s) for s in (3, 7)},
            "_agree": "CASE WHEN rule_top IS NULL THEN 0.5D WHEN _root = rule_top THEN 1.0D ELSE 0.0D END",
            "_margin": "if(has_rule, greatest(0.0D, least(1.0D, coalesce(rule_margin, 0.0D))), 0.0D)",
            "_sev": "greatest(0.0D, least(1.0D, coalesce(get(z, 12), 0.0D)))",
            "_map": "greatest(0.0D, least(1.0D, coalesce(get(z, 11), 0.0D)))",
        },
    )
    dense = "array(_risk, _conf, _q, _r3, _r7, _q3, _q7, _risk - _r3, _q - _q3, _streak, _sev, _map, _margin, _agree)"
    df = stage(df, {"z": dense, "has_rule": "coalesce(has_rule, false)"})
    return df.drop("rule_top", "rule_margin", *[c for c in df.columns if c.startswith("_")])


def place_dense(dense: DataFrame, original: DataFrame, keys: list[str], dims: list[int], preserve: bool) -> DataFrame:
    """Writes a dense vector into given dimensions of the original one, keeping or zeroing the rest."""
    at = f"array({', '.join(map(str, dims))})"
    joined = original.join(dense.select(*keys, F.col("z").alias("_dense")), keys)
    rest = "coalesce(v, 0.0D)" if preserve else "0.0D"
    return stage(joined, {"z": f"transform(z, (v, i) -> if(array_contains({at}, i), get(_dense, cast(array_position({at}, i) - 1 AS int)), {rest}))"}).drop("_dense")
