"""Measures of a clustering for every window, over all dimensions of a vector.

All measures follow from two small tables per window: counts per (cluster, class), and count, sum and square sum of the points per cluster
and per class. Both are one aggregation with map-side combine, so a window may be of any size.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlewatch.operators.windows import stage


def _gap2(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def centroids(points: DataFrame, by: list[str], vector: str, dims: int) -> DataFrame:
    """n and centre of each group."""
    sums = [F.sum(F.get(vector, F.lit(i))) for i in range(dims)]
    out = points.groupBy(*by).agg(F.count("*").alias("n"), F.array(*sums).alias("_s"))
    return out.withColumn("centre", F.transform("_s", lambda s: s / F.col("n"))).drop("_s")


def nearest_in_window(points: DataFrame, centres: DataFrame, window: str, vector: str) -> DataFrame:
    """Adds cluster and d2, the nearest centre (window, id, centre) of the point's window; the smaller id on ties. A window has few centres."""
    lists = centres.groupBy(window).agg(F.collect_list(F.struct("id", "centre")).alias("_c"))
    best = F.array_min(F.transform("_c", lambda c: F.struct(_gap2(vector, c["centre"]).alias("d2"), c["id"].alias("id"))))
    return points.join(lists, window).withColumn("_b", best).select(*points.columns, F.col("_b.id").alias("cluster"), F.col("_b.d2").alias("d2"))


def count_measures(assigned: DataFrame, window: str, cluster: str = "cluster", klass: str = "class") -> DataFrame:
    """window, n, f1_p, purity, f1_r, rand, van_dongen, homogeneity, completeness, v_measure of the points with a cluster and a class."""
    table = assigned.where(F.col(cluster).isNotNull() & F.col(klass).isNotNull()).groupBy(window, F.col(cluster).alias("k"), F.col(klass).alias("c")).agg(F.count("*").alias("n"))
    rows = table.groupBy(window, "k").agg(F.sum("n").alias("a"), F.max("n").alias("top"))
    cols = table.groupBy(window, "c").agg(F.sum("n").alias("b"), F.max("n").alias("top"))
    total = table.groupBy(window).agg(F.sum("n").alias("total"))
    met = table.join(rows.select(window, "k", "a"), [window, "k"]).join(cols.select(window, "c", "b"), [window, "c"]).join(total, window)
    met = stage(met, {"p": "n / a", "r": "n / b", "f1": "2.0D * n / (a + b)"})
    best = met.groupBy(window, "k").agg(F.max_by(F.struct("f1", "p"), F.struct("n", -F.col("c"))).alias("x")).groupBy(window).agg(F.avg("x.f1").alias("f1_p"), F.avg("x.p").alias("purity"))
    by_class = met.groupBy(window, "c").agg(F.max("f1").alias("f")).groupBy(window).agg(F.avg("f").alias("f1_r"))
    two = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2.0)
    cells = met.groupBy(window).agg(two("n").alias("m"), (-F.sum(F.col("n") / F.col("total") * F.log("p"))).alias("h_ck"), (-F.sum(F.col("n") / F.col("total") * F.log("r"))).alias("h_kc"), F.first("total").alias("total"))
    entropy = lambda c: (-F.sum(F.col(c) / F.col("total") * F.log(F.col(c) / F.col("total"))))
    side1 = rows.join(total, window).groupBy(window).agg(two("a").alias("m2"), F.sum("top").alias("fc"), entropy("a").alias("h_k"))
    side2 = cols.join(total, window).groupBy(window).agg(two("b").alias("m1"), F.sum("top").alias("hc"), entropy("b").alias("h_c"))
    out = cells.join(side1, window).join(side2, window).join(best, window).join(by_class, window)
    out = stage(
        out,
        {
            "_pairs": "total * (total - 1.0D) / 2.0D", "homogeneity": "IF(h_c > 0, 1.0D - h_ck / h_c, 1.0D)", "completeness": "IF(h_k > 0, 1.0D - h_kc / h_k, 1.0D)",
            "van_dongen": "(fc + hc) / (2.0D * total)",
        },
    )
    out = stage(out, {"rand": "IF(_pairs > 0, (_pairs - m1 - m2 + 2.0D * m) / _pairs, 1.0D)", "v_measure": "coalesce(try_divide(2.0D * homogeneity * completeness, homogeneity + completeness), 0.0D)"})
    return out.select(window, F.col("total").alias("n"), "f1_p", "purity", "f1_r", "rand", "van_dongen", "homogeneity", "completeness", "v_measure")


def space_measures(assigned: DataFrame, window: str, vector: str, dims: int, cluster: str = "cluster", klass: str = "class") -> DataFrame:
    """window, ssq (squared distances to the assigned centre, d2), bss and bss_gt (between clusters and between classes), bss_ratio."""
    ssq = assigned.groupBy(window).agg(F.sum("d2").alias("ssq"))
    mean = centroids(assigned, [window], vector, dims).select(window, F.col("centre").alias("_mean"))

    def between(side: str, name: str) -> DataFrame:
        own = centroids(assigned, [window, side], vector, dims).join(mean, window)
        return own.groupBy(window).agg(F.sum(F.col("n") * _gap2("centre", "_mean")).alias(name))

    out = ssq.join(between(cluster, "bss"), window).join(between(klass, "bss_gt"), window)
    return out.withColumn("bss_ratio", F.try_divide("bss", "bss_gt"))


def long_form(measures: DataFrame, window: str) -> DataFrame:
    """One row per window and measure."""
    names = [c for c in measures.columns if c != window]
    return measures.select(window, *[F.col(c).cast("double").alias(c) for c in names]).unpivot([window], names, "measure", "value")
