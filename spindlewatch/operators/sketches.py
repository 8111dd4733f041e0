"""Stored quantile sketches: one per day (and group), written once and merged over any range of days."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a sketch; its rank error is below RANK_ERROR with great odds, whatever was merged.
SKETCH_K, RANK_ERROR = 400, 0.015


def daily_sketches(df: DataFrame, day: str, values: list[str], by: list[str] = ()) -> DataFrame:
    """by, day, feature, n, sketch: each value's sketch per day; nulls and values that are no number don't count."""
    long = df.select(*by, day, F.explode(F.array(*[F.struct(F.lit(v).alias("feature"), F.col(v).cast("double").alias("x")) for v in values])).alias("v")).select(*by, day, "v.*")
    usable = long.where(F.col("x").isNotNull() & ~F.isnan("x"))
    return usable.groupBy(*by, day, "feature").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("x", SKETCH_K).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, sketch: all sketches of a group as one."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))


def quantiles(sketches: DataFrame, probs: list[float]) -> DataFrame:
    """A row per sketch and probability: prob and quantile."""
    q = F.array(*[F.struct(F.lit(p).alias("prob"), F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias("quantile")) for p in probs])
    return sketches.withColumn("_q", F.explode(q)).select(*[c for c in sketches.columns if c != "sketch"], "_q.*")
