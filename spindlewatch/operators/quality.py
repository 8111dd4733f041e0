"""Feature contracts, mappings and quality reports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindlewatch.functions.names import ROOT_CAUSES, model_key_joined, smart_name
from spindlewatch.functions.ordered import running
from spindlewatch.operators.windows import stage
from spindlewatch.session import checked_broadcast

# Coverage thresholds tried in this order.
COVERAGE_STEPS = [0.99, 0.95, 0.9, 0.8, 0.5]


def feature_contract_stats(daily: DataFrame, features: list[str], model: str = "model") -> DataFrame:
    """Rows, failures, non-null counts and variance per (model, feature).

    Aggregates the wide rows per model and turns the result into rows, so that rows are never multiplied by features.
    """
    aggs = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("failure") == 1).alias("fail_rows")]
    for i, f in enumerate(features):
        x = F.col(f)
        aggs += [F.count(x).alias(f"_n{i}"), F.var_samp(x).alias(f"_v{i}"), F.count_if(x.isNotNull() & (F.col("failure") == 1)).alias(f"_f{i}")]
    wide = daily.groupBy(model).agg(*aggs)
    items = [f"named_struct('pos', {i}, 'feature', '{f}', 'nonnull', _n{i}, 'variance', coalesce(_v{i}, 0.0D), 'fail_nonnull', _f{i})" for i, f in enumerate(features)]
    out = wide.selectExpr(model, "rows", "fail_rows", f"inline(array({', '.join(items)}))")
    return stage(out, {"ratio": "nonnull / cast(rows AS double)"})


def choose_contract(stats: DataFrame, min_features: int, min_variance: float = 0.0, steps: list[float] = COVERAGE_STEPS, model: str = "model") -> DataFrame:
    """Features per model at the strictest coverage that keeps ``min_features`` of them, else the best-covered ones.

    One row per model holds all its features in an array (as many as there are sensor columns).
    """
    df = stats.groupBy(model).agg(F.array_sort(F.collect_list(F.struct("pos", "feature", "ratio", "variance"))).alias("_f"))
    tries = ", ".join(f"{t!r}D" for t in steps)
    passing = f"filter(_f, f -> f.ratio >= t AND f.variance >= {min_variance!r}D)"
    df = stage(df, {"_step": f"get(filter(array({tries}), t -> size({passing}) >= {min_features}), 0)"})
    ranked = "slice(reverse(array_sort(transform(_f, f -> struct(f.ratio AS r, f.variance AS v, -f.pos AS p)))), 1, {0}).p"
    top = f"filter(_f, f -> f.ratio > 0 AND array_contains({ranked.format(max(min_features, 1))}, -f.pos))"
    only = f"filter(_f, f -> array_contains({ranked.format(1)}, -f.pos))"
    df = stage(
        df,
        {
            "picked": f"CASE WHEN _step IS NOT NULL THEN filter(_f, f -> f.ratio >= _step AND f.variance >= {min_variance!r}D) "
            f"WHEN size({top}) > 0 THEN {top} ELSE {only} END",
            "used_threshold": "coalesce(_step, 0.0D)",
            "mode": "if(_step IS NULL, 'topk_backstop', 'threshold')",
        },
    )
    return df.select(model, "used_threshold", "mode", F.col("picked.feature").alias("features"))


def common_spelling(df: DataFrame, model: str = "model") -> DataFrame:
    """Most common raw spelling per model key; spellings are counted first, so the final grouping is small."""
    counted = df.groupBy(model_key_joined(F.col(model)).alias("key"), model).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy("key").agg(F.sum("_n").alias("rows"), F.min_by(model, F.struct(-F.col("_n"), F.col(model))).alias("model"))


def suffix_match(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Model keys found exactly or as the unique suffix of a known key.

    A key's suffixes after each ``_`` are enumerated, so the non-equi match becomes an equi-join.
    """
    parts = "transform(sequence(0, size(split({0}, '_')) - 1), i -> array_join(slice(split({0}, '_'), i + 1, size(split({0}, '_'))), '_'))"
    k = stage(known.select(F.col("key").alias("known")).distinct(), {"suffix": f"explode({parts.format('known')})"})
    w = stage(wanted.select(F.col("key").alias("wanted")).distinct(), {"suffix": f"explode({parts.format('wanted')})"})
    longer = w.where("suffix = wanted").join(k, "suffix").select("wanted", "known")
    shorter = w.join(k.where("suffix = known"), "suffix").select("wanted", "known")
    hits = longer.union(shorter).distinct()
    return hits.groupBy("wanted").agg(F.count(F.lit(1)).alias("_n"), F.min("known").alias("known")).where("_n = 1").drop("_n")


def sensor_presence(stats: DataFrame, model: str = "model") -> DataFrame:
    """Largest presence ratio of every SMART id per model."""
    return stats.groupBy(model, smart_name(F.col("feature")).alias("sensor")).agg(F.max("ratio").alias("presence"))


def rank_event_features(
    presence: DataFrame, rule_weights: DataFrame, seeds: list[str], min_presence: float, max_features: int, model: str = "model"
) -> DataFrame:
    """Event features per model by presence·(1 + weight·grouped) + seed bonus.

    ``rule_weights`` (sensor, weight, grouped) holds the sensors a rule or seed names; they stay candidates at any presence.
    """
    df = presence.join(checked_broadcast(rule_weights), "sensor", "left")
    seed = F.col("sensor").isin(list(seeds))
    score = F.col("presence") * (1.0 + F.coalesce("weight", F.lit(0.70)) * F.when(F.col("grouped"), 1.0).otherwise(0.35)) + F.when(seed, 0.05).otherwise(0.0)
    df = df.withColumn("score", score).where((F.col("presence") >= min_presence) | F.col("weight").isNotNull() | seed)
    sid = F.regexp_extract("sensor", r"(\d+)$", 1).try_cast("int")
    w = Window.partitionBy(model).orderBy(F.col("score").desc(), F.col("presence").desc(), sid)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_features).select(model, "sensor", "score", "rank")


def backfill_event_features(ranked: DataFrame, models: DataFrame, rule_weights: DataFrame, seeds: list[str], min_features: int, max_features: int, model: str = "model") -> DataFrame:
    """(model, sensor, rank): ranked features, then ruled sensors by weight, then seeds, until a model has min_features; never more than max_features.

    A model without any ranked feature gets all ruled sensors before that limit counts; ties of weight go to the smaller sensor number.
    rule_weights (sensor, weight) has a row for each ruled sensor only, so models times rules is a short list.
    """
    sid = F.regexp_extract("sensor", r"(\d+)$", 1).try_cast("int")
    ruled = rule_weights.where("weight IS NOT NULL").select("sensor", F.row_number().over(Window.partitionBy().orderBy(F.desc("weight"), sid)).alias("place"))
    order = F.array_sort(F.collect_list(F.struct("place", "sensor")))
    rules = F.coalesce(ruled.agg(F.transform(order, lambda x: x["sensor"]).alias("a")).scalar(), F.array().cast("array<string>"))
    own = models.select(model).distinct().join(ranked, model, "left").groupBy(model).agg(F.array_sort(F.collect_list(F.when(F.col("sensor").isNotNull(), F.struct("rank", "sensor")))).alias("_o"))
    out = own.withColumns({"_have": F.transform("_o", lambda x: x["sensor"]), "_rules": rules})
    fill = "slice(array_except({0}, _have), 1, greatest(0, {1} - size(_have)))"
    many = f"IF(size(_have) = 0 AND {min_features} <= 0, size(_rules), {max(0, min_features)})"
    out = stage(out, {"_have": f"concat(_have, {fill.format('_rules', many)})"})
    seeded = "array(" + ", ".join(f"'{s}'" for s in seeds) + ")" if seeds else "cast(array() AS array<string>)"
    out = stage(out, {"_have": f"concat(_have, {fill.format(seeded, f'IF(size(_have) = 0 AND {min_features} <= 0, {len(seeds)}, {max(0, min_features)})')})"})
    out = stage(out, {"_have": f"slice(_have, 1, {max_features})"} if max_features > 0 else {})
    return out.select(model, F.posexplode("_have").alias("rank", "sensor")).withColumn("rank", F.col("rank") + 1)


def missing_features(present: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return present.select(*keys).distinct().join(parent.select(keys[-1]).distinct(), keys[-1], "left_anti")


def nearest_rank(df: DataFrame, value: str, by: list[str], probs: dict[str, float], ranges: int | None = None) -> DataFrame:
    """Exact nearest-rank quantiles at round((n-1)·p) with ties to even.

    Equal values are one row with a count, and running counts find the value that covers each rank.
    """
    per = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    run = running(per, value, {"_hi": F.col("_c")}, within=list(by), ranges=ranges)
    total = per.groupBy(*by).agg(F.sum("_c").alias("_n"))
    run = run.join(total, by) if by else run.withColumn("_n", total.scalar())
    pos = lambda p: F.least(F.greatest(F.rint((F.col("_n") - 1) * p), F.lit(0.0)), F.col("_n") - 1.0)
    return run.groupBy(*by).agg(*[F.min(F.when(F.col("_hi") > pos(p), F.col(value))).alias(name) for name, p in probs.items()])


def cache_quality(cache: DataFrame, windows: DataFrame, by: str = "model", keys: tuple[str, ...] = ("disk", "day")) -> DataFrame:
    """Quality of a cache per model: unknown and mapped ratios, event density, parse rates, coverage and rule agreement.

    ``windows`` (by, keys, rule_top) are the windows that could have been answered.
    """
    tops = windows.select(*keys, F.col("rule_top"), F.lit(True).alias("_w"))
    df = cache.join(tops, list(keys), "left")
    share = lambda cond: F.avg(F.coalesce(cond, F.lit(False)).cast("double"))
    counted = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_rows"),
        share(F.col("root_cause") == "unknown").alias("unknown_ratio"),
        F.avg("llm_mapped_event_ratio").alias("mapped_event_ratio"),
        F.avg(F.col("llm_event_count").cast("double")).alias("event_density"),
        share(F.col("parse_source") == "repair").alias("parse_repair_rate"),
        share(F.col("parse_source") == "default").alias("parse_default_rate"),
        F.coalesce(F.avg(F.when(F.col("rule_top").isNotNull(), (F.col("root_cause") == F.col("rule_top")).cast("double"))), F.lit(0.0)).alias("rule_match_ratio"),
    )
    totals = windows.groupBy(by).agg(F.count(F.lit(1)).alias("window_total"))
    quant = nearest_rank(cache, "llm_q_score", [by], {"q_score_q10": 0.1, "q_score_q50": 0.5, "q_score_q90": 0.9})
    out = counted.join(totals, by, "left").join(quant, by)
    return out.withColumn("cache_coverage", F.try_divide(F.col("total_rows"), F.col("window_total")))


def alignment(pairs: DataFrame) -> DataFrame:
    """Agreement of answers (``pred``) with rules (``truth``) over common windows."""
    share = lambda c: F.avg(c.cast("double"))
    unknown_p, unknown_t, same = F.col("pred") == "unknown", F.col("truth") == "unknown", F.col("pred") == F.col("truth")
    valid = F.lit(True)
    for c in ("risk_hint", "hardness", "confidence"):
        valid = valid & F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False))
    return pairs.agg(
        F.count(F.lit(1)).alias("overlap_rows"), F.count_if(F.col("parse_source") == "default").alias("parse_fail_count"),
        share(F.col("parse_source") != "default").alias("parse_success_rate"), share(valid).alias("meta_valid_rate"),
        share(unknown_p).alias("unknown_ratio"), share(unknown_t).alias("rule_unknown_ratio"),
        (share(unknown_p) - share(unknown_t)).alias("unknown_overshoot"), share(same).alias("overall_match_rate"),
        F.count_if(~unknown_t).alias("non_unknown_total"), F.avg(F.when(~unknown_t, same.cast("double"))).alias("non_unknown_match_rate"),
    )


def cause_confusion(pairs: DataFrame) -> DataFrame:
    """Truth by prediction, one column per cause."""
    return pairs.groupBy("truth").agg(*[F.count_if(F.col("pred") == c).alias(c) for c in ROOT_CAUSES])


def transitions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two caches side by side, with ``transition`` old->new."""
    cols = ["root_cause", "confidence", "risk_hint"]
    joined = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in cols]).join(new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in cols]), keys)
    return joined.withColumn("transition", F.concat_ws("->", "old_root_cause", "new_root_cause"))


def first_per_transition(pairs: DataFrame, keys: list[str], n: int) -> DataFrame:
    w = Window.partitionBy("transition").orderBy(*keys)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def transition_report(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("transition").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"{side}_{c}").alias(f"{side}_{c}") for side in ("old", "new") for c in ("confidence", "risk_hint")]
    )
