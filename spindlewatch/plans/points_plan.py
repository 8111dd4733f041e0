"""Queries over points with all their dimensions: coresets, sliding outliers, anytime scores, random features."""
from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from spindlewatch.functions.scalars import r4
from spindlewatch.operators import anytime, coresets, lifetimes, projections
from spindlewatch.operators.sampling import uniform
from spindlewatch.plans.bridge import table

DIMS = 64
BLOCK, SIZE, FAN, CENTRES, FACTOR = 256, 96, 4, 8, 1.1
SLOT, SLOTS, RADIUS, LEAST, SAMPLE, SEED = 25, 8, 1.25, 8, 60, 1
DEPTH, LOW, HIGH = 6, -1.0, 1.0
LATENT = 5


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")


# ---- coresets ----------------------------------------------------------------------------------------------------------------


def tree(spark, sf):
    return coresets.coreset_tree(vectors(spark, sf), "vec_id", "vector", SIZE, BLOCK, FAN)


def q_coreset_weights(spark, sf):
    """What every node of the tree weighs, and whether it is as small as it should be."""
    return tree(spark, sf).groupBy("level", "node").agg(F.sum("weight").alias("weight"), (F.count("*") <= SIZE).alias("small"))


def q_coreset_cost(spark, sf):
    """Points, weight, and whether the centres of the coreset cost at most FACTOR times those of k-means on all points."""
    points = vectors(spark, sf)
    centres = coresets.coreset_centres(tree(spark, sf), CENTRES)
    cost = coresets.nearest_centres(points, "vec_id", "vector", centres).agg(F.count("*").alias("points"), F.sum("distance2").alias("own"))
    full = KMeans(k=CENTRES, seed=SEED, maxIter=25).fit(points.select(array_to_vector("vector").alias("features"))).summary.trainingCost
    return cost.withColumn("weight", centres.agg(F.sum("weight")).scalar()).select("points", "weight", (F.col("own") <= FACTOR * full).alias("close"))


# ---- outliers ----------------------------------------------------------------------------------------------------------------


def counted(spark, sf, sample=0):
    rows = lifetimes.slotted(vectors(spark, sf), "vec_id", "vector", SLOT)
    return lifetimes.neighbour_counts(rows, RADIUS, SLOTS, LEAST, sample, uniform(["id"], SEED))


def q_sliding(spark, sf):
    """The outliers of every window."""
    return lifetimes.window_counts(counted(spark, sf), SLOTS).where(F.col("neighbours") < LEAST).select("window", F.col("id").alias("vec_id"), F.col("neighbours").cast("bigint").alias("neighbours"))


def q_lifetimes(spark, sf):
    out = lifetimes.lifetime_outliers(lifetimes.window_counts(counted(spark, sf), SLOTS), LEAST)
    return out.select(F.col("id").alias("vec_id"), "windows", "outlier_windows", "first_outlier", "last_outlier", F.col("least").cast("bigint").alias("least"), F.col("most").cast("bigint").alias("most"))


def q_sampled(spark, sf):
    out = lifetimes.sampled_outliers(counted(spark, sf, SAMPLE), SLOTS, SLOT, LEAST)
    return out.select(F.col("id").alias("vec_id"), "window", F.col("exact").cast("bigint").alias("exact"), r4(F.col("estimate")).alias("estimate"), "outlier", "estimated_outlier")


def q_anytime(spark, sf):
    out = anytime.anytime_scores(vectors(spark, sf), "vec_id", "vector", DIMS, DEPTH, LOW, HIGH, least_rows=3, threshold=8.0)
    return out.select(F.col("id").alias("vec_id"), F.col("depth").cast("bigint").alias("depth"), *[r4(F.col(c)).alias(c) for c in ("score", "aggregate", "confidence")], "outlier")


# ---- attributes --------------------------------------------------------------------------------------------------------------
WEIGHTS, OFFSETS = projections.relu_weights(SEED, LATENT, DIMS), projections.rbf_centres(SEED, LATENT)


def q_relu(spark, sf):
    return vectors(spark, sf).withColumn("z", projections.relu_features("vector", WEIGHTS)).select("vec_id", *[r4(F.get("z", F.lit(i))).alias(f"z{i}") for i in range(LATENT)])


def q_rbf(spark, sf):
    """The class is one of the components; the sum of 64 components of a unit vector is shrunk, so that no exponential overflows."""
    rows = vectors(spark, sf).withColumn("x", F.concat(F.transform("vector", lambda v: v / 64.0), F.array(F.col("label") / 10.0)))
    out = rows.withColumn("z", projections.rbf_features("x", [c / 64.0 for c in OFFSETS]))
    return out.select("vec_id", *[r4(F.get("z", F.lit(i))).alias(f"z{i}") for i in range(LATENT)])


def q_select(spark, sf):
    """Columns of the order lines by their places: 1 and 2 and 5 to 7 as inputs, 4 as output."""
    return projections.select_attributes(table(spark, sf, "lineitem"), "1-2,5-7", "4")


def q_numeric(spark, sf):
    return projections.numeric_attributes(table(spark, sf, "lineitem"), "l_returnflag")


# ---- SQL twins ---------------------------------------------------------------------------------------------------------------
_R = lambda e, n: f"round({e},4)+0.0::DOUBLE AS {n}"
_V = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_SLOTTED = f"""WITH {_V}, s AS (SELECT vec_id, v, (row_number() OVER (ORDER BY vec_id)-1)//{SLOT} AS slot FROM e), la AS (SELECT max(slot) AS last FROM s),
nb AS (SELECT a.vec_id AS id, a.slot, b.vec_id AS other, b.slot AS t FROM s a JOIN s b ON abs(a.slot-b.slot)<{SLOTS} AND a.vec_id<>b.vec_id AND list_distance(a.v,b.v)<={RADIUS}),
wi AS (SELECT vec_id AS id, slot, unnest(range(slot, slot+{SLOTS})) AS w FROM s),
wc AS (SELECT wi.id, wi.slot, w, 1+count(nb.id) AS neighbours FROM wi JOIN la ON w<=last LEFT JOIN nb ON nb.id=wi.id AND t>w-{SLOTS} AND t<=w GROUP BY ALL)"""
_U = f"(('0x'||substr(md5('{SEED}|'||{{0}}),1,13))::BIGINT::DOUBLE/{2**52}.0::DOUBLE)"
_SAMPLED = f"""{_SLOTTED}, sl AS (SELECT DISTINCT slot FROM s),
sa AS (SELECT sl.slot AS home, c.vec_id, c.slot AS t, 1+(SELECT count(*) FROM nb WHERE nb.id=c.vec_id AND nb.t>=c.slot AND nb.t<sl.slot) AS n FROM sl JOIN s c ON c.slot<sl.slot AND c.slot>sl.slot-{SLOTS}),
sb AS (SELECT home, vec_id FROM sa WHERE n>={LEAST} QUALIFY row_number() OVER (PARTITION BY home ORDER BY {_U.format('vec_id')}, vec_id)<={SAMPLE}),
sc AS (SELECT home, count(*) AS size FROM sb GROUP BY home),
sh AS (SELECT s.vec_id AS id, coalesce((SELECT count(*) FROM sb JOIN nb ON nb.id=s.vec_id AND nb.other=sb.vec_id WHERE sb.home=s.slot)/(SELECT size FROM sc WHERE sc.home=s.slot)::DOUBLE,0) AS share FROM s),
es AS (SELECT wc.id, w, neighbours, 1.0::DOUBLE+(SELECT count(*) FROM nb WHERE nb.id=wc.id AND nb.t>=wc.slot AND nb.t<=w)+share*(SELECT count(*) FROM s WHERE s.slot>w-{SLOTS} AND s.slot<wc.slot) AS est FROM wc JOIN sh USING (id))"""
_CELL = "||".join(f"CASE WHEN v[{s % DIMS + 1}]-({LOW}) >= 2*floor((v[{s % DIMS + 1}]-({LOW}))/2)+1 THEN '1' ELSE '0' END" for s in range(DEPTH))
_ANY = f"""WITH {_V}, p AS (SELECT vec_id, v, {_CELL} AS path FROM e), d AS (SELECT vec_id, v, unnest(range({DEPTH + 1})) AS depth, path FROM p),
q AS (SELECT vec_id, v, depth, left(path, depth) AS cell FROM d), c AS (SELECT depth, cell, count(*) AS n FROM q GROUP BY ALL),
m AS (SELECT depth, cell, list(total ORDER BY i) AS sums FROM (SELECT depth, cell, i, sum(x) AS total FROM (SELECT depth, cell, unnest(v) AS x, unnest(range({DIMS})) AS i FROM q) GROUP BY ALL) GROUP BY ALL),
f AS (SELECT vec_id, depth, n, CASE WHEN n>=3 THEN list_distance(v, list_transform(list_zip(sums, v), lambda z: (z[1]-z[2])/(n-1))) END AS raw FROM q JOIN c USING (depth, cell) JOIN m USING (depth, cell)),
g AS (SELECT vec_id, list(raw ORDER BY depth) FILTER (raw IS NOT NULL) AS sc FROM f GROUP BY vec_id),
h AS (SELECT vec_id, depth, least(depth, len(sc)-1) AS lv, sc FROM g, (SELECT unnest(range({DEPTH + 1})) AS depth)),
i AS (SELECT vec_id, depth, sc[lv+1] AS score, CASE WHEN lv=0 THEN sc[1] ELSE (sc[lv]+sc[lv+1])/2 END AS aggregate, CASE WHEN lv=0 THEN 0.0::DOUBLE ELSE exp(-abs(sc[lv+1]-sc[lv]))*exp(-(sc[lv]+sc[lv+1])/2) END AS confidence FROM h)"""
_dot = lambda w: f"list_inner_product(v, [{','.join(repr(x) for x in w)}]::DOUBLE[])"

QUERIES = {
    "coreset_weights": q_coreset_weights, "coreset_kmeans_cost": q_coreset_cost, "sliding_distance_outliers": q_sliding, "lifetime_outliers": q_lifetimes,
    "sampled_inlier_outliers": q_sampled, "anytime_outlier_scores": q_anytime, "relu_features": q_relu, "rbf_features": q_rbf,
    "select_attributes": q_select, "numeric_attributes": q_numeric,
}
ORACLE = {
    "coreset_weights": f"""WITH l AS (SELECT unnest(range(16)) AS level), n AS (SELECT level, vec_id//({BLOCK}*({FAN}**level)::BIGINT) AS node FROM embeddings, l),
      k AS (SELECT level FROM n GROUP BY level HAVING min(node)<max(node) UNION ALL SELECT min(level) FROM (SELECT level FROM n GROUP BY level HAVING min(node)=max(node)))
      SELECT level::INT AS level, node, count(*) AS weight, true AS small FROM n SEMI JOIN k USING (level) GROUP BY ALL""",
    "coreset_kmeans_cost": "SELECT count(*) AS points, count(*) AS weight, true AS close FROM embeddings",
    "sliding_distance_outliers": f"{_SLOTTED} SELECT w AS window, id AS vec_id, neighbours FROM wc WHERE neighbours<{LEAST}",
    "lifetime_outliers": f"""{_SLOTTED} SELECT id AS vec_id, count(*) AS windows, count(*) FILTER (neighbours<{LEAST}) AS outlier_windows, min(w) FILTER (neighbours<{LEAST}) AS first_outlier,
      max(w) FILTER (neighbours<{LEAST}) AS last_outlier, min(neighbours) AS least, max(neighbours) AS most FROM wc GROUP BY id""",
    "sampled_inlier_outliers": f"{_SAMPLED} SELECT id AS vec_id, w AS window, neighbours AS exact, {_R('est', 'estimate')}, neighbours<{LEAST} AS outlier, est<{LEAST} AS estimated_outlier FROM es",
    "anytime_outlier_scores": f"{_ANY} SELECT vec_id, depth, {_R('score', 'score')}, {_R('aggregate', 'aggregate')}, {_R('confidence', 'confidence')}, CASE WHEN confidence>0 THEN aggregate/confidence>8.0 ELSE aggregate>0 END AS outlier FROM i",
    "relu_features": f"WITH {_V} SELECT vec_id, {', '.join(_R(f'greatest(0.0::DOUBLE,{_dot(w)})', f'z{k}') for k, w in enumerate(WEIGHTS))} FROM e",
    "rbf_features": f"WITH {_V} SELECT vec_id, {', '.join(_R(f'exp(-(list_sum(v)/64.0::DOUBLE+label/10.0::DOUBLE-65*({c!r}::DOUBLE/64.0::DOUBLE)))', f'z{k}') for k, c in enumerate(OFFSETS))} FROM e",
    "select_attributes": "SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_linenumber FROM lineitem",
    "numeric_attributes": "SELECT * EXCLUDE (l_linestatus, l_shipdate) FROM lineitem",
}
