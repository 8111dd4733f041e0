"""Connected components by alternating stars; every round is two joins on stored edges, and edges never leave the executors."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlewatch.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest id reachable) for the nodes of edges (a, b) other than roots themselves. No edges give no rows.

    A large star hangs all larger neighbours of a node on its smallest one, a small star the smaller ones; this ends with one star per
    component after logarithmically many rounds. The join of a hub's edges with its one minimum can be split by adaptive execution.
    """
    current = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    seen = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        current = stage(small.where("u > v").distinct(), "edges")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
