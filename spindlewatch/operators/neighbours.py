"""Neighbours within a radius by grid cells.

Cells have side r/√d, so points of one cell are always neighbours. Counting cells settles most points; only points of thinly filled
cells are compared with others, and there are fewer than k of those per cell. Filled cells are salted, so no task holds one.
"""
from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT_ROWS = 20_000
PAIR_ROWS = 1_000


def cell_of(coords: list[str], side: float) -> Column:
    return F.array(*[F.floor(F.col(c) / F.lit(side)).cast("bigint") for c in coords])


def offsets(d: int, reach: int) -> Column:
    """All cell offsets within ``reach`` as a literal array ((2·reach + 1)^d entries)."""
    return F.array(*[F.array(*[F.lit(x).cast("bigint") for x in o]) for o in itertools.product(range(-reach, reach + 1), repeat=d)])


def shifted(cell: Column, offset: Column) -> Column:
    return F.zip_with(cell, offset, lambda a, b: a + b)


def distance2(a: list[Column], b: list[Column]) -> Column:
    out = F.lit(0.0)
    for x, y in zip(a, b):
        out = out + (x - y) * (x - y)
    return out


def sparse_neighbours(points: DataFrame, id_col: str, coords: list[str], radius: float, k: int, by: list[str] = ()) -> DataFrame:
    """(id, by, ``seen``): the exact number of points within ``radius``, the point itself included, for every point that lives in
    a cell of fewer than ``k`` points; all other points have at least ``k``."""
    d = len(coords)
    side = radius / math.sqrt(d)
    reach = math.ceil(math.sqrt(d))
    pts = points.select(*by, id_col, *coords).withColumn("_cell", cell_of(coords, side))
    cells = pts.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    salts = cells.withColumn("_salts", F.ceil(F.col("_n") / F.lit(SALT_ROWS)).cast("int"))
    thin = pts.join(cells.where(F.col("_n") < k).select(*by, "_cell"), [*by, "_cell"])
    asks = thin.select(*by, F.col(id_col).alias("_id"), *[F.col(c).alias(f"_q_{c}") for c in coords],
                       F.explode(F.transform(offsets(d, reach), lambda o: shifted(F.col("_cell"), o))).alias("_cell"))
    # only existing cells are asked; a filled cell is asked once per salt
    asks = asks.join(salts.drop("_n"), [*by, "_cell"]).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    answers = pts.join(salts.drop("_n"), [*by, "_cell"])
    answers = answers.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.col("_salts")).cast("int")).drop("_salts")
    near = distance2([F.col(f"_q_{c}") for c in coords], [F.col(c) for c in coords]) <= radius * radius
    pairs = asks.join(answers, [*by, "_cell", "_salt"]).where(near)
    return pairs.groupBy(*by, "_id").agg(F.count(F.lit(1)).alias("seen")).withColumnRenamed("_id", id_col)


def distance_outliers(points: DataFrame, id_col: str, coords: list[str], radius: float, k: int, by: list[str] = ()) -> DataFrame:
    """Outlier when the point and its neighbours within ``radius`` are fewer than ``k`` (so k = 1 has none)."""
    seen = sparse_neighbours(points, id_col, coords, radius, k, by)
    return points.select(*by, id_col).join(seen, [*by, id_col], "left").select(*by, id_col, F.coalesce(F.col("seen") < k, F.lit(False)).alias("outlier"))


def range_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, coords: list[str], radius: float, by: list[str] = ()) -> DataFrame:
    """Pairs of two tables within ``radius`` (cells of side ``radius``, adjacent cells only). The output is as large as the answer.

    The two sides of a filled cell are dealt into blocks of about PAIR_ROWS rows, and every block of one side meets every block of the other.
    """
    d = len(coords)
    lhs = left.select(*by, F.col(left_id).alias("_l"), *[F.col(c).alias(f"_a_{c}") for c in coords], cell_of(coords, radius).alias("_home"))
    lhs = lhs.withColumn("_cell", F.explode(F.transform(offsets(d, 1), lambda o: shifted(F.col("_home"), o)))).drop("_home")
    rhs = right.select(*by, F.col(right_id).alias("_r"), *coords, cell_of(coords, radius).alias("_cell"))
    blocks = lambda df, name: df.groupBy(*by, "_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(PAIR_ROWS)).cast("int").alias(name))
    cells = blocks(lhs, "_ls").join(blocks(rhs, "_rs"), [*by, "_cell"])  # only cells that both sides reach
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lhs = lhs.join(cells, [*by, "_cell"]).withColumn("_lb", own("_l", "_ls")).withColumn("_rb", every("_rs")).drop("_ls", "_rs")
    rhs = rhs.join(cells, [*by, "_cell"]).withColumn("_rb", own("_r", "_rs")).withColumn("_lb", every("_ls")).drop("_ls", "_rs")
    d2 = distance2([F.col(f"_a_{c}") for c in coords], [F.col(c) for c in coords])
    pairs = lhs.join(rhs, [*by, "_cell", "_lb", "_rb"]).withColumn("distance", F.sqrt(d2)).where(F.col("distance") <= radius)
    return pairs.select(*by, F.col("_l").alias(left_id), F.col("_r").alias(right_id), "distance")


def neighbour_pairs(points: DataFrame, id_col: str, coords: list[str], radius: float, by: list[str] = ()) -> DataFrame:
    """Every pair of one table's points within ``radius`` once: ``id_col`` < ``other_id``."""
    other = points.select(*by, F.col(id_col).alias("other_id"), *coords)
    return range_pairs(points, other, id_col, "other_id", coords, radius, by).where(F.col(id_col) < F.col("other_id"))
