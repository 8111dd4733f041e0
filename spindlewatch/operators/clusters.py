"""Clustering on micro-clusters: points are summarised per grid cell first, everything after works on cells."""
from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlewatch.operators.neighbours import cell_of, distance2, offsets, shifted
from spindlewatch.session import cut_lineage


MAX_CLUSTERS = 10_000


def as_array(table: DataFrame, *fields: str) -> Column:
    """A table of cluster summaries as one scalar array; its size is checked, rows of points never take this way."""
    if table.limit(MAX_CLUSTERS + 1).count() > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    return table.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("a")).scalar()


def micro_clusters(points: DataFrame, coords: list[str], side: float, by: list[str] = (), age: Column | None = None, decay: float = 1.0) -> DataFrame:
    """(cell, n, weight, ls, ss, centre) per cell: counts, linear and squared sums; ``weight`` fades with ``decay`` per unit of age."""
    w = F.lit(1.0) if age is None else F.pow(F.lit(decay), age)
    df = points.withColumns({"cell": cell_of(coords, side), "_w": w})
    out = df.groupBy(*by, "cell").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_w").alias("weight"),
        F.array(*[F.sum(F.col("_w") * F.col(c)) for c in coords]).alias("ls"),
        F.array(*[F.sum(F.col("_w") * F.col(c) * F.col(c)) for c in coords]).alias("ss"),
    )
    return out.withColumn("centre", F.transform("ls", lambda s: s / F.col("weight")))


def horizon(buckets: DataFrame, bucket: str, start: int, end: int) -> DataFrame:
    """Micro-clusters of a time horizon from those per (time bucket, cell): sums are additive."""
    return _added(buckets.where(F.col(bucket).between(start, end)), ["cell"])


def horizons(buckets: DataFrame, bucket: str, h: int) -> DataFrame:
    """The horizon of every bucket that has points: micro-clusters of the ``h`` buckets up to it, as ``horizon`` and cell."""
    ends = F.explode(F.sequence(F.col(bucket), F.col(bucket) + h - 1))
    out = _added(buckets.withColumn("horizon", ends), ["horizon", "cell"])
    return out.join(buckets.select(F.col(bucket).alias("horizon")).distinct(), "horizon", "left_semi")


def _added(buckets: DataFrame, by: list[str]) -> DataFrame:
    d = "size(any_value(ls))"
    add = lambda c: F.expr(f"transform(sequence(0, {d} - 1), i -> aggregate(collect_list({c}), 0.0D, (a, x) -> a + x[i]))")
    out = buckets.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), add("ls").alias("ls"), add("ss").alias("ss"))
    return out.withColumn("centre", F.transform("ls", lambda s: s / F.col("weight")))


def kmeans_centres(micro: DataFrame, k: int, seed: int = 1, iterations: int = 20) -> list[list[float]]:
    """Weighted k-means on micro-cluster centres; returns the k centres (a model, bounded by k)."""
    data = micro.select(array_to_vector("centre").alias("features"), F.col("weight"))
    model = KMeans(k=k, seed=seed, maxIter=iterations, weightCol="weight").fit(data)
    return [list(map(float, c)) for c in model.clusterCenters()]


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Connected components of an undirected graph (``src``, ``dst``): smallest node of each component as ``component``.

    Every round takes the smallest label around and then jumps to that label's own label, so rounds grow with the logarithm of the
    longest chain. Labels are checkpointed each round.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(nodes.select(F.col(node), F.col(node).alias("component")).distinct())
    while True:
        around = both.join(labels, F.col("dst") == F.col(node)).groupBy("src").agg(F.min("component").alias("_m"))
        step = labels.join(around, F.col(node) == F.col("src"), "left").select(node, F.col("component").alias("_old"), F.least("component", F.coalesce("_m", "component")).alias("_new"))
        own = step.select(F.col(node).alias("_key"), F.col("_new").alias("_jump"))
        step = step.join(own, F.col("_new") == F.col("_key"), "left")
        step = cut_lineage(step.select(node, "_old", F.least("_new", F.coalesce("_jump", "_new")).alias("component")))
        labels = step.select(node, "component")
        if step.where("_old != component").isEmpty():
            return labels


def dbscan(micro: DataFrame, eps: float, min_weight: float, dims: int) -> DataFrame:
    """DBSCAN over micro-clusters: (cell, cluster, core). Border clusters join the smallest neighbouring cluster; noise has none.

    A centre has at most one partner per fine cell around it, so the neighbour join is linear in the number of cells.
    """
    node = micro.select("cell", "weight", "centre", F.transform("centre", lambda x: F.floor(x / F.lit(eps)).cast("bigint")).alias("_big"))
    asks = node.select(F.col("cell").alias("a"), F.col("centre").alias("_ca"), F.explode(F.transform(offsets(dims, 1), lambda o: shifted(F.col("_big"), o))).alias("_big"))
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    d2 = distance2([at("_ca", i) for i in range(dims)], [at("centre", i) for i in range(dims)])
    near = cut_lineage(asks.join(node, "_big").where(d2 <= eps * eps).select("a", F.col("cell").alias("b"), "weight"))
    core = near.groupBy("a").agg(F.sum("weight").alias("_w")).where(F.col("_w") >= min_weight).select(F.col("a").alias("cell"))
    core = cut_lineage(core)
    links = near.join(core.select(F.col("cell").alias("a")), "a").join(core.select(F.col("cell").alias("b")), "b")
    comp = components(core, links.select(F.col("a").alias("src"), F.col("b").alias("dst")), "cell")
    border = near.join(comp.select(F.col("cell").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("cluster"))
    out = micro.select("cell").join(border.withColumnRenamed("a", "cell"), "cell", "left").join(core.withColumn("core", F.lit(True)), "cell", "left")
    own = comp.select("cell", F.col("component").alias("_own"))
    return out.join(own, "cell", "left").select("cell", F.coalesce("_own", "cluster").alias("cluster"), F.coalesce("core", F.lit(False)).alias("core"))


def density_grid(micro: DataFrame, cells_total: int, decay: float = 0.998, dense: float = 3.0, sparse: float = 0.8) -> DataFrame:
    """Classifies decayed cells as dense, transitional or sparse and joins neighbouring cells to clusters.

    Thresholds are dense/(N(1 - decay)) and sparse/(N(1 - decay)) for N cells in the space. Dense cells that touch form a cluster; a
    transitional cell joins the smallest cluster it touches.
    """
    scale = 1.0 / (cells_total * (1.0 - decay))
    kind = F.when(F.col("weight") >= dense * scale, "dense").when(F.col("weight") <= sparse * scale, "sparse").otherwise("transitional")
    cells = cut_lineage(micro.select("cell", "weight", kind.alias("kind")))
    d = F.size("cell")
    moves = F.flatten(F.transform(F.sequence(F.lit(0), d - 1), lambda i: F.array(
        F.transform("cell", lambda x, j: F.when(j == i, x + 1).otherwise(x)), F.transform("cell", lambda x, j: F.when(j == i, x - 1).otherwise(x)))))
    touch = cells.select(F.col("cell").alias("a"), F.col("kind").alias("ka"), F.explode(moves).alias("cell")).join(cells, "cell")
    links = touch.where("ka = 'dense' AND kind = 'dense'").select(F.col("a").alias("src"), F.col("cell").alias("dst"))
    comp = components(cells.where("kind = 'dense'"), links, "cell")
    edge = touch.where("ka = 'transitional'").join(comp, "cell").groupBy("a").agg(F.min("component").alias("_e")).withColumnRenamed("a", "cell")
    out = cells.join(comp, "cell", "left").join(edge, "cell", "left")
    return out.select("cell", "weight", "kind", F.coalesce("component", "_e").alias("cluster"))


def nearest(df: DataFrame, coords: list[str], centres: DataFrame, name: str = "cluster") -> DataFrame:
    """Adds the nearest centre (``name``) and ``d2``. ``centres`` (id, centre) is one bounded array, read as a scalar."""
    df = df.withColumn("_cs", as_array(centres, "id", "centre"))
    point = F.array(*[F.col(c) for c in coords])
    gap = lambda c: F.aggregate(F.zip_with(point, c.centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("_cs", lambda c: F.struct(gap(c).alias("d2"), c.id.alias("id"))))
    return df.withColumn("_best", best).select(*df.columns[:-1], F.col("_best.id").alias(name), F.col("_best.d2").alias("d2"))


def centroids(df: DataFrame, coords: list[str], by: str) -> DataFrame:
    return df.groupBy(F.col(by).alias("id")).agg(F.array(*[F.avg(c) for c in coords]).alias("centre"), F.count(F.lit(1)).alias("n"))


# ---- measures -----------------------------------------------------------------------------------------------------------------


def ssq(assigned: DataFrame, klass: str = "class") -> DataFrame:
    """Sum of squared distances to the nearest centre; noise (class -1) does not count."""
    return assigned.where(F.col(klass) != -1).agg(F.sum("d2").alias("ssq"))


def contingency(df: DataFrame, cluster: str = "cluster", klass: str = "class") -> DataFrame:
    """Counts per (cluster, class); points in no cluster are cluster -1. The table is clusters × classes, so what follows is small."""
    return df.groupBy(F.coalesce(F.col(cluster), F.lit(-1)).alias("cluster"), F.col(klass).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def membership_matrix(table: DataFrame, classes: list) -> DataFrame:
    return table.groupBy("cluster").agg(*[F.coalesce(F.sum(F.when(F.col("class") == c, F.col("n"))), F.lit(0)).alias(f"class_{c}") for c in classes])


def _margins(table: DataFrame) -> DataFrame:
    rows = table.groupBy("cluster").agg(F.sum("n").alias("a"))
    cols = table.groupBy("class").agg(F.sum("n").alias("b"))
    return table.join(rows, "cluster").join(cols, "class").withColumn("total", table.agg(F.sum("n")).scalar())


def f1_purity(table: DataFrame) -> DataFrame:
    """F1 by cluster (its best class), purity, and F1 by class (its best cluster)."""
    m = _margins(table).where("class != -1 AND cluster != -1")
    m = m.withColumns({"p": F.col("n") / F.col("a"), "r": F.col("n") / F.col("b")}).withColumn("f1", F.lit(2.0) * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
    best = m.groupBy("cluster").agg(F.max_by(F.struct("f1", "p"), F.struct(F.col("n"), -F.col("class"))).alias("x"))
    by_class = m.groupBy("class").agg(F.max("f1").alias("f"))
    out = best.agg(F.avg("x.f1").alias("f1_p"), F.avg("x.p").alias("purity"))
    return out.withColumn("f1_r", by_class.agg(F.avg("f")).scalar())


def entropies(table: DataFrame, clusters: int, classes: int) -> DataFrame:
    """Cross entropies, homogeneity, completeness, V-measure and normalised mutual information (base-10 logarithms).

    ``clusters`` counts the found clusters; the points outside are one more. Measures out of range are -1.
    """
    m = _margins(table)
    log_k, log_c = math.log10(clusters + 1), math.log10(classes) if classes > 1 else 1.0
    inside = m.agg(
        (-F.sum(F.col("n") / F.col("total") * F.log10(F.col("n") / F.col("a"))) / log_k).alias("_fc_cross"),
        (-F.sum(F.col("n") / F.col("total") * F.log10(F.col("n") / F.col("b"))) / log_c).alias("_gt_cross"),
        (F.sum(F.col("n") / F.col("total") * F.log10(F.col("n") * F.col("total") / (F.col("a") * F.col("b").cast("double")))) / log_c).alias("_mutual"),
    )
    h = lambda side, c, base: (
        m.select(side, c, "total").distinct().agg(-F.sum(F.col(c) / F.col("total") * F.log10(F.col(c) / F.col("total"))) / base).scalar()
    )
    df = inside.withColumns({"_fc": h("cluster", "a", log_k), "_gt": h("class", "b", log_c)})
    df = df.withColumns(
        {
            "_h": F.when(F.col("_fc") == 0, 1.0).otherwise(1.0 - F.col("_fc_cross") / F.col("_fc")),
            "completeness": F.when(F.col("_gt") == 0, 1.0).otherwise(1.0 - F.col("_gt_cross") / F.col("_gt")),
        }
    )
    df = df.withColumn("_v", F.try_divide(2.0 * F.col("_h") * F.col("completeness"), F.col("_h") + F.col("completeness")))
    return df.select(
        (1.0 - F.col("_fc_cross")).alias("fc_cross_entropy"), (1.0 - F.col("_gt_cross")).alias("gt_cross_entropy"),
        F.when(F.col("_h").between(0, 1), F.col("_h")).otherwise(-1.0).alias("homogeneity"), "completeness",
        F.when((F.col("_v") > 1) | (F.col("_h") < 0), -1.0).otherwise(F.col("_v")).alias("v_measure"),
        F.coalesce(F.try_divide(2.0 * F.col("_mutual"), F.col("_fc") + F.col("_gt")), F.lit(1.0)).alias("var_information"),
    )


def pair_statistics(table: DataFrame) -> DataFrame:
    """Rand statistic and van Dongen measure."""
    two = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2.0)
    rows = table.groupBy("cluster").agg(F.sum("n").alias("a"), F.max("n").alias("top")).agg(two("a").alias("m2"), F.sum("top").alias("fc"))
    cols = table.groupBy("class").agg(F.sum("n").alias("b"), F.max("n").alias("top")).agg(two("b").alias("m1"), F.sum("top").alias("hc"))
    one = lambda df: df.select(F.struct(*df.columns)).scalar()
    df = table.agg(F.sum("n").alias("total"), two("n").alias("m")).withColumns({"_r": one(rows), "_c": one(cols)}).select("*", "_r.*", "_c.*")
    big = F.col("total").cast("double") * (F.col("total") - 1) / 2.0
    return df.select(((big - F.col("m1") - F.col("m2") + 2.0 * F.col("m")) / big).alias("rand"), ((F.col("fc") + F.col("hc")) / (2.0 * F.col("total"))).alias("van_dongen"))


def separation(df: DataFrame, coords: list[str], cluster: str = "cluster", klass: str = "class") -> DataFrame:
    """Between-cluster sum of squares for clusters and for classes, and their ratio; the overall centre is the mean."""
    mean = df.agg(F.array(*[F.avg(c) for c in coords])).scalar()

    def bss(side):
        c = centroids(df, coords, side).withColumn("_m", mean)
        gap = F.aggregate(F.zip_with("centre", "_m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        return c.agg(F.sum(F.col("n") * gap).alias("v"))

    out = bss(cluster).withColumnRenamed("v", "bss").withColumn("bss_gt", bss(klass).scalar())
    return out.withColumn("bss_ratio", F.try_divide("bss", "bss_gt"))


def coverage_measures(df: DataFrame, coords: list[str], spheres: DataFrame, klass: str = "class") -> DataFrame:
    """Precision, recall and redundancy of sphere clusters (id, centre, radius): which points lie in at least one, or several."""
    df = df.withColumn("_s", as_array(spheres, "centre", "radius"))
    point = F.array(*[F.col(c) for c in coords])
    gap = lambda s: F.aggregate(F.zip_with(point, s.centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
    df = df.withColumn("_k", F.size(F.filter("_s", lambda s: F.sqrt(gap(s)) <= s.radius)))
    real, hit = F.col(klass) != -1, F.col("_k") > 0
    share = lambda a, b: F.coalesce(F.try_divide(F.count_if(a), F.count_if(b)), F.lit(0.0))
    return df.agg(share(hit & real, hit).alias("gprecision"), share(hit & real, real).alias("grecall"), share(F.col("_k") > 1, F.lit(True)).alias("redundancy"))


def silhouette(df: DataFrame, coords: list[str], cluster: str = "cluster") -> DataFrame:
    """Mean silhouette on squared distances, rescaled to [0, 1].

    The mean squared distance of a point to a cluster follows from the cluster's count, sum and square sum, so no pair is formed.
    """
    sq = sum((F.col(c) * F.col(c) for c in coords[1:]), F.col(coords[0]) * F.col(coords[0]))
    parts = df.groupBy(F.col(cluster).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in coords]).alias("s"), F.sum(sq).alias("q"))
    df = df.withColumns({"_sq": sq, "_c": as_array(parts, "id", "n", "s", "q")})
    point = F.array(*[F.col(c) for c in coords])
    dot = lambda c: F.aggregate(F.zip_with(point, c.s, lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    gap = lambda c, m: (c.n * F.col("_sq") - 2.0 * dot(c) + c.q) / m
    own = F.filter("_c", lambda c: c.id == F.col(cluster))
    other = F.filter("_c", lambda c: c.id != F.col(cluster))
    df = df.withColumns(
        {
            "_a": F.get(F.transform(own, lambda c: F.when(c.n > 1, gap(c, F.greatest(c.n - 1, F.lit(1))))), F.lit(0)),
            "_b": F.array_min(F.transform(other, lambda c: gap(c, c.n))),
        }
    )
    score = F.when(F.col("_a").isNull(), 0.0).otherwise(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")))
    return df.agg(((F.avg(score) + 1.0) / 2.0).alias("silhouette"))
