"""Coresets by merge and reduce: blocks of points are reduced to weighted points, groups of those are merged and reduced again.

A reduction draws points one after the other with odds of weight times squared distance to the nearest one drawn (D² sampling) and gives
every drawn point the weight of those nearest to it. Weights are counts, so each node of the tree weighs what its block holds. Draws are
functions of (seed, level, node) and of the rows in their order, so a repeated task draws the same.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlewatch.session import cut_lineage

NODE = "level int, node long, point long, weight long, vector array<double>"


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    return np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * (a @ b.T))


def drawn(points: np.ndarray, weight: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Places of ``size`` points by D² sampling; fewer, if the rest lies on points that were drawn."""
    odds, picked, near = weight.astype(float), [], np.full(len(points), np.inf)
    while len(picked) < min(size, len(points)) and odds.sum() > 0:
        step = np.cumsum(odds)
        picked.append(int(np.searchsorted(step, rng.random() * step[-1], side="right").clip(0, len(points) - 1)))
        near = np.minimum(near, squared(points, points[picked[-1:]])[:, 0])
        near[picked[-1]] = 0.0
        odds = weight * near
    return np.array(picked, np.int64)


def reduced(points: np.ndarray, weight: np.ndarray, size: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Weighted points that stand for all: the drawn ones, each with the weight of those nearest to it."""
    if len(points) <= size:
        return points, weight
    picked = drawn(points, weight, size, rng)
    own = squared(points, points[picked]).argmin(axis=1)
    return points[picked], np.bincount(own, weight, len(picked)).astype(np.int64)


def _reduction(size: int, seed: int, level: int):
    def reduce(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["part", "point"], kind="stable")
        node = int(frame["node"].iloc[0])
        points, weight = reduced(np.array(frame["vector"].tolist(), float), frame["weight"].to_numpy(np.int64), size, np.random.default_rng([seed, level, node & 0x7FFFFFFF]))
        return pd.DataFrame({"level": np.int32(level), "node": np.int64(node), "point": np.arange(len(points)), "weight": weight, "vector": list(points)})

    return reduce


def coreset_tree(points: DataFrame, id_col: str, vector: str, size: int, block_rows: int, fan: int = 8, seed: int = 1) -> DataFrame:
    """level, node, point, weight, vector of every node of the tree, up to the one that stands for all points.

    A leaf is a block of ``block_rows`` consecutive ids, so ids must be unique and dense; an inner node merges ``fan`` nodes, at most
    ``fan * size`` weighted points. Points without id or vector, or with a null component, take no part. No points give no rows.
    """
    usable = points.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))
    node = F.floor(F.col(id_col) / F.lit(block_rows)).cast("bigint")
    rows = usable.select(node.alias("node"), node.alias("part"), F.col(id_col).cast("bigint").alias("point"), F.lit(1).cast("bigint").alias("weight"), F.col(vector).cast("array<double>").alias("vector"))
    level, levels = 0, []
    while True:
        current = cut_lineage(rows.groupBy("node").applyInPandas(_reduction(size, seed, level), NODE))
        levels.append(current)
        ends = current.agg(F.min("node").alias("a"), F.max("node").alias("b")).first()
        if ends["a"] == ends["b"]:
            break
        rows = current.select(F.floor(F.col("node") / F.lit(fan)).cast("bigint").alias("node"), F.col("node").alias("part"), "point", "weight", "vector")
        level += 1
    whole = levels[0]
    for more in levels[1:]:
        whole = whole.unionByName(more)
    return whole


def top_level(tree: DataFrame) -> DataFrame:
    """The coreset of all points: at most ``size`` rows."""
    return tree.where(F.col("level") == tree.agg(F.max("level")).scalar())


def weighted_centres(points: np.ndarray, weight: np.ndarray, k: int, seed: int, tries: int = 5, rounds: int = 25) -> np.ndarray:
    """k centres by D² seeding and Lloyd's rounds on weighted points; the cheapest of some tries."""
    best, least = points[:0], np.inf
    for t in range(tries):
        centres = points[drawn(points, weight, k, np.random.default_rng([seed, t]))]
        for _ in range(rounds):
            own = squared(points, centres).argmin(axis=1)
            held = np.bincount(own, weight, len(centres))
            moved = np.stack([np.bincount(own, weight * points[:, j], len(centres)) for j in range(points.shape[1])], axis=1)
            new = np.where(held[:, None] > 0, moved / np.maximum(held, 1)[:, None], centres)
            if np.allclose(new, centres, rtol=0, atol=1e-12):
                break
            centres = new
        cost = float((weight * squared(points, centres).min(axis=1)).sum())
        if cost < least:
            best, least = centres, cost
    return best


def coreset_centres(tree: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """centre, weight, vector: k-means on the coreset of all points; one task with at most ``size`` rows."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("point", kind="stable")
        points, weight = np.array(frame["vector"].tolist(), float), frame["weight"].to_numpy(float)
        centres = weighted_centres(points, weight, k, seed)
        held = np.bincount(squared(points, centres).argmin(axis=1), weight, len(centres)).astype(np.int64)
        return pd.DataFrame({"centre": np.arange(len(centres), dtype=np.int32), "weight": held, "vector": list(centres)})

    return top_level(tree).groupBy("level").applyInPandas(fit, "centre int, weight long, vector array<double>")


def nearest_centres(points: DataFrame, id_col: str, vector: str, centres: DataFrame) -> DataFrame:
    """id, centre and squared distance of every point with a whole vector; the k centres travel with the task."""
    rows = centres.orderBy("centre").collect()  # k rows
    table = np.array([r["vector"] for r in rows], float)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame) and len(table):
                far = squared(np.array(frame["vector"].tolist(), float), table)
                own = far.argmin(axis=1)
                yield pd.DataFrame({id_col: frame[id_col], "centre": own.astype(np.int32), "distance2": far[np.arange(len(own)), own]})

    usable = points.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))
    return usable.select(F.col(id_col).cast("bigint").alias(id_col), F.col(vector).cast("array<double>").alias("vector")).mapInPandas(assign, f"{id_col} long, centre int, distance2 double")
