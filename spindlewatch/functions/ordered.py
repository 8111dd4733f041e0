"""Whole-table order without a single-task window.

A running value over all rows is split in two: ranges of the order key carry their own window, and a small table with one
row per range carries the totals of everything before it. Sliding row frames use overlapping tiles.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_RANGES = 4096


def range_bounds(df: DataFrame, key: str, ranges: int | None = None) -> list:
    """Split points of a numeric order key by approximate quantiles: a driver value of at most MAX_RANGES numbers.

    Without a number, there are twice as many ranges as shuffle partitions, at least 64.
    """
    if ranges is None:
        ranges = max(64, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = min(ranges, MAX_RANGES)
    probs = [i / ranges for i in range(1, ranges)]
    row = df.select(F.percentile_approx(F.col(key), probs, ranges * 20).alias("b")).first()
    return sorted(set(row.b or []))


def with_range(df: DataFrame, key: str, ranges: int | None = None, name: str = "_range") -> DataFrame:
    """Adds the number of split points below the key, which is monotone in it. Two steps of about √n comparisons find it."""
    bounds = range_bounds(df, key, ranges)
    if not bounds:
        return df.withColumn(name, F.lit(0))
    size = math.isqrt(len(bounds) - 1) + 1
    blocks = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col(key)))
    df = df.withColumn("_block", below(F.array(*[F.lit(b[0]) for b in blocks])) - 1)
    inside = F.get(F.array(*[F.array(*[F.lit(b) for b in block]) for block in blocks]), F.col("_block"))
    return df.withColumn(name, F.when(F.col("_block") < 0, 0).otherwise(F.col("_block") * size + below(inside))).drop("_block")


def running(
    df: DataFrame,
    key: str,
    sums: dict[str, Column],
    within: list[str] = (),
    exclusive: bool = False,
    ranges: int | None = None,
    tie: list[str] = (),
) -> DataFrame:
    """Adds running sums over the unique order ``key`` (ties broken by ``tie``), optionally per ``within`` group.

    ``exclusive`` leaves the row itself out. Groups in ``within`` may be hot: each is cut into ranges as well.
    """
    work = with_range(df, key, ranges)
    for name, expr in sums.items():
        work = work.withColumn(f"_m_{name}", expr)
    group = [*within, "_range"]
    totals = work.groupBy(*group).agg(*[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    frame = Window.partitionBy(*group).orderBy(key, *tie).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    offsets = F.broadcast(offsets) if not within else offsets  # one row per range, at most MAX_RANGES
    local = work.select("*", *[F.coalesce(F.sum(f"_m_{n}").over(frame), F.lit(0)).alias(f"_l_{n}") for n in sums])
    joined = local.join(offsets, group)
    out = joined.select(*[c for c in df.columns], *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])
    return out


def running_extremes(
    df: DataFrame, key: str, measures: dict[str, tuple[str, Column]], within: list[str] = (), exclusive: bool = True, ranges: int | None = None
) -> DataFrame:
    """Like ``running`` for ``max``, ``min`` and ``last`` (the last non-null value); null while nothing was seen."""
    fold = {"max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
    work = with_range(df, key, ranges)
    for name, (_, expr) in measures.items():
        work = work.withColumn(f"_m_{name}", expr)
    group = [*within, "_range"]
    tail = lambda n: F.max_by(f"_m_{n}", F.when(F.col(f"_m_{n}").isNotNull(), F.col(key)))
    totals = work.groupBy(*group).agg(
        *[(tail(n) if kind == "last" else fold[kind](f"_m_{n}")).alias(f"_t_{n}") for n, (kind, _) in measures.items()]
    )
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, *[fold[kind](f"_t_{n}").over(before).alias(f"_o_{n}") for n, (kind, _) in measures.items()])
    frame = Window.partitionBy(*group).orderBy(key).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    local = work.select("*", *[fold[kind](f"_m_{n}").over(frame).alias(f"_l_{n}") for n, (kind, _) in measures.items()])
    joined = local.join(offsets if within else F.broadcast(offsets), group)
    pick = {"max": F.greatest, "min": F.least, "last": F.coalesce}
    return joined.select(*df.columns, *[pick[kind](f"_l_{n}", f"_o_{n}").alias(n) for n, (kind, _) in measures.items()])


def row_numbers(df: DataFrame, key: str, name: str = "n", ranges: int | None = None, tie: list[str] = ()) -> DataFrame:
    """1-based position of every row in the whole-table order."""
    return running(df, key, {name: F.lit(1).cast("bigint")}, ranges=ranges, tie=tie)


def previous(df: DataFrame, key: str, value: str, name: str, default=None, steps: int = 1, ranges: int | None = None) -> DataFrame:
    """``lag`` over the whole-table order: numbers the rows, then tiles them with an overlap of ``steps``."""
    numbered = row_numbers(df, key, "_rn", ranges)
    tiled = overlap_tiles(numbered, F.col("_rn"), 50_000, steps)
    w = Window.partitionBy("_tile").orderBy("_rn")
    out = tiled.withColumn(name, F.lag(value, steps, default).over(w))
    return out.where("_own").drop("_tile", "_own", "_rn")


def overlap_tiles(df: DataFrame, position: Column, size: int, lookback: int) -> DataFrame:
    """Cuts an integer axis into tiles of ``size``; a tile also gets the last ``lookback`` positions before it (``_own`` = false)."""
    pos = position.cast("bigint")
    tile = F.floor(pos / F.lit(size)).cast("bigint")
    reach = F.floor((pos + F.lit(lookback)) / F.lit(size)).cast("bigint")
    return (
        df.withColumn("_home", tile)
        .withColumn("_tile", F.explode(F.sequence(F.col("_home"), reach)))
        .withColumn("_own", F.col("_tile") == F.col("_home"))
        .drop("_home")
    )
