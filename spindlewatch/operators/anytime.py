"""Anytime outlier scores from a hierarchy of micro-clusters.

The space between given bounds is halved again and again, one dimension after the other, so depth d has up to 2^d cells and a cell at
depth d lies in one at depth d - 1. A node keeps how many points it has and their sums over all dimensions. Points are counted once, at
the deepest level; the levels above are sums of those, as sums are additive. A point's score at a depth is its distance from the mean of
the other points of its node, so it can be read after any number of steps down.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlewatch.operators.windows import stage
from spindlewatch.session import checked_broadcast, cut_lineage


def cell_path(vector: str, dims: int, depth: int, low: float, high: float) -> Column:
    """One character per step: whether the point is in the upper half of its cell along dimension (step mod dims)."""
    steps = []
    for s in range(depth):
        width = (high - low) / 2 ** (s // dims)
        x = F.get(vector, F.lit(s % dims)) - F.lit(low)
        inside = x - F.floor(x / F.lit(width)) * F.lit(width)
        steps.append(F.when(inside >= F.lit(width / 2), "1").otherwise("0"))
    return F.concat(*steps) if steps else F.lit("")


def cluster_tree(points: DataFrame, vector: str, dims: int, depth: int, low: float, high: float) -> DataFrame:
    """path (its length is the depth), n, sums of every node that has points; points with a whole vector of ``dims`` components count."""
    leaf = points.groupBy(cell_path(vector, dims, depth, low, high).alias("path")).agg(F.count("*").alias("n"), F.array(*[F.sum(F.get(vector, F.lit(i))) for i in range(dims)]).alias("sums"))
    leaf = cut_lineage(leaf)
    up = leaf.withColumn("path", F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda d: F.substr("path", F.lit(1), d))))
    return up.groupBy("path").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(dims)]).alias("sums"))


def usable(points: DataFrame, id_col: str, vector: str, dims: int) -> DataFrame:
    whole = F.col(vector).isNotNull() & (F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return points.where(F.col(id_col).isNotNull()).where(whole).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector"))


def anytime_scores(
    points: DataFrame, id_col: str, vector: str, dims: int, depth: int, low: float = -1.0, high: float = 1.0, least_rows: int = 2, score_k: int = 2, confidence_k: int = 2, threshold: float = 0.07
) -> DataFrame:
    """id, depth, score, aggregate, confidence, outlier of every point at every depth from 0 on.

    In a node with fewer than ``least_rows`` points the descent ends and what was found above stays; a point alone in the table has no rows.
    The aggregate is the mean of the last ``score_k`` scores, the confidence exp(-mean change) * exp(-mean) of the last ``confidence_k`` ones
    and 0 at depth 0. An outlier has aggregate / confidence above the threshold; without confidence, any aggregate above 0.
    """
    rows = usable(points, id_col, vector, dims)
    rows = rows.withColumn("path", cell_path("vector", dims, depth, low, high))
    tree = cut_lineage(cluster_tree(rows.select("vector"), "vector", dims, depth, low, high))
    leaf = tree.where(F.length("path") == depth).select(F.col("path").alias("leaf"))
    # every leaf with its nodes from the root down: depth + 1 rows of one array each
    steps = leaf.select("leaf", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda d: F.substr("leaf", F.lit(1), d))).alias("depth", "path"))
    ways = steps.join(tree, "path").groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "n", "sums"))).alias("way"))
    rows = rows.join(checked_broadcast(cut_lineage(ways), 4_096), rows["path"] == ways["leaf"])
    others = lambda w: F.zip_with("vector", w["sums"], lambda x, s: x - (s - x) / (w["n"] - 1))
    far = lambda w: F.sqrt(F.aggregate(others(w), F.lit(0.0), lambda a, d: a + d * d))
    raw = F.transform("way", lambda w: F.when((w["n"] >= least_rows) & (w["n"] > 1), far(w)))
    rows = rows.select("id", raw.alias("raw"))
    # nodes only get smaller on the way down, so the scores that exist come first
    rows = rows.select("id", F.posexplode("raw").alias("depth", "_"), F.filter("raw", lambda x: x.isNotNull()).alias("scores"))
    rows = rows.withColumn("at", F.least(F.col("depth"), F.size("scores") - 1)).where("at >= 0")
    mean = lambda a: f"aggregate({a}, 0.0D, (s, x) -> s + x) / size({a})"
    last = lambda k: f"slice(scores, greatest(1, at + 2 - {k}), least(at + 1, {k}))"
    changes = f"transform(sequence(greatest(1, at + 2 - {confidence_k}), at), i -> abs(get(scores, i) - get(scores, i - 1)))"
    rows = stage(rows, {"score": "get(scores, at)", "_last": last(score_k), "_recent": last(confidence_k), "_changes": f"IF(at > 0, {changes}, cast(array() AS array<double>))"})
    rows = stage(rows, {"aggregate": mean("_last"), "confidence": f"IF(at = 0, 0.0D, exp(-({mean('_changes')})) * exp(-({mean('_recent')})))"})
    flag = F.expr(f"IF(confidence > 0, aggregate / confidence > {threshold!r}D, aggregate > 0)")
    return rows.select("id", "depth", "score", "aggregate", "confidence", flag.alias("outlier"))
