"""Coresets, sliding outliers and anytime scores against brute force, with all dimensions; random features and attribute lists."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindlewatch.operators import anytime, coresets, lifetimes, projections
from spindlewatch.operators.sampling import uniform


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    return np.concatenate([rng.normal(size=(220, 6)) * 0.3 + c for c in (0.0, 2.0, 5.0)] + [rng.normal(size=(40, 6)) * 4])[rng.permutation(700)]


def frame(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)] + list(extra), "vec_id long, vector array<double>")


def test_coreset_keeps_weight_and_cost(spark, cloud):
    points = frame(spark, cloud, [(900, None), (None, [0.0] * 6), (901, [None] * 6)])
    tree = coresets.coreset_tree(points, "vec_id", "vector", 40, 100, 3)
    sums = {(r["level"], r["node"]): (r["w"], r["n"]) for r in tree.groupBy("level", "node").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()}
    assert {k: w for k, (w, _) in sums.items() if k[0] == 0} == {(0, i): 100 for i in range(7)}
    assert [w for k, (w, _) in sorted(sums.items()) if k[0] == 1] == [300, 300, 100] and sums[2, 0][0] == 700 and max(n for _, n in sums.values()) <= 40
    centres = coresets.coreset_centres(tree, 3)
    cost = coresets.nearest_centres(points.where("vec_id is not null"), "vec_id", "vector", centres).agg(F.sum("distance2"), F.count("*")).first()
    full = coresets.weighted_centres(cloud, np.ones(700), 3, 1, tries=20)
    assert cost[1] == 700 and cost[0] <= 1.2 * coresets.squared(cloud, full).min(axis=1).sum()
    again = coresets.coreset_tree(points.repartition(5), "vec_id", "vector", 40, 100, 3)
    key = ["level", "node", "point", "weight"]
    assert sorted(map(tuple, tree.select(*key, "vector").collect())) == sorted(map(tuple, again.select(*key, "vector").collect()))
    assert coresets.coreset_tree(points.where("false"), "vec_id", "vector", 4, 10).count() == 0


def test_equal_points_fill_no_coreset(spark):
    tree = coresets.coreset_tree(frame(spark, np.ones((50, 2))), "vec_id", "vector", 5, 50)
    assert [(r["weight"], list(r["vector"])) for r in tree.collect()] == [(50, [1.0, 1.0])]


@pytest.mark.parametrize("slot_rows, slots", [(1, 20), (10, 4), (25, 1), (400, 3)])
def test_sliding_windows_of_outliers(spark, cloud, slot_rows, slots):
    x, radius, k = cloud[:230], 1.0, 6
    points = frame(spark, x, [(900, None), (901, [0.0, None] + [0.0] * 4)]).withColumn("vec_id", F.col("vec_id") * 3 + 7)
    counted = lifetimes.neighbour_counts(lifetimes.slotted(points, "vec_id", "vector", slot_rows), radius, slots)
    got = {(r["id"], r["window"]): r["neighbours"] for r in lifetimes.window_counts(counted, slots).collect()}
    near = coresets.squared(x, x) <= radius * radius
    slot = np.arange(len(x)) // slot_rows
    want = {}
    for e in range(int(slot.max()) + 1):
        inside = np.flatnonzero((slot > e - slots) & (slot <= e))
        for i in inside.tolist():
            want[i * 3 + 7, e] = int(near[i, inside].sum())
    assert got == want
    life = {r["id"]: r for r in lifetimes.lifetime_outliers(lifetimes.window_counts(counted, slots), k).collect()}
    for i in range(len(x)):
        own = {e: n for (j, e), n in want.items() if j == i * 3 + 7}
        out = [e for e, n in own.items() if n < k]
        r = life[i * 3 + 7]
        assert (r["windows"], r["outlier_windows"], r["first_outlier"], r["least"], r["most"]) == (len(own), len(out), min(out, default=None), min(own.values()), max(own.values()))


def test_sampled_safe_inliers_find_the_outliers(spark, cloud):
    counted = lifetimes.neighbour_counts(lifetimes.slotted(frame(spark, cloud), "vec_id", "vector", 25), 1.0, 8, 6, 60, uniform(["id"], 1))
    rows = lifetimes.sampled_outliers(counted, 8, 25, 6).toPandas()
    exact = lifetimes.window_counts(counted, 8).toPandas()
    assert len(rows) == len(exact) and rows.outlier.sum() == (exact.neighbours < 6).sum() > 100
    found = (rows.outlier & rows.estimated_outlier).sum()
    assert found / rows.outlier.sum() >= 0.9 and found / rows.estimated_outlier.sum() >= 0.9
    assert counted.agg(F.max("sample_size")).first()[0] == 60


def test_anytime_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (120, 3))
    got = {(r["id"], r["depth"]): r for r in anytime.anytime_scores(frame(spark, x, [(900, None), (901, [0.1, 0.2])]), "vec_id", "vector", 3, 5, least_rows=3, threshold=2.0).collect()}
    assert len(got) == 120 * 6

    def cell(p, depth):
        low, high, path = np.full(3, -1.0), np.full(3, 1.0), ""
        for s in range(depth):
            j, middle = s % 3, (low[s % 3] + high[s % 3]) / 2
            path += "1" if p[j] >= middle else "0"
            low[j], high[j] = (middle, high[j]) if p[j] >= middle else (low[j], middle)
        return path

    for i in range(120):
        scores = []
        for depth in range(6):
            others = [j for j in range(120) if j != i and cell(x[j], depth) == cell(x[i], depth)]
            if len(others) >= 2:
                scores.append(float(np.linalg.norm(x[i] - x[others].mean(axis=0))))
            r, recent = got[i, depth], scores[-2:]
            confidence = math.exp(-abs(scores[-1] - scores[-2])) * math.exp(-sum(recent) / 2) if len(scores) > 1 else 0.0
            assert np.allclose([r["score"], r["aggregate"], r["confidence"]], [scores[-1], sum(recent) / len(recent), confidence])
            assert r["outlier"] == (r["aggregate"] / confidence > 2.0 if confidence else r["aggregate"] > 0)
    assert anytime.anytime_scores(frame(spark, x[:1]), "vec_id", "vector", 3, 2).count() == 0


def test_random_features(spark):
    weights, centres = projections.relu_weights(7, 4, 3), projections.rbf_centres(7, 2)
    assert weights == projections.relu_weights(7, 4, 3) != projections.relu_weights(8, 4, 3) and len({x for w in weights for x in w}) == 12
    df = spark.createDataFrame([(1, [0.5, -1.0, 2.0]), (2, [None, 1.0, 1.0]), (3, None)], "vec_id long, v array<double>")
    got = {r["vec_id"]: r for r in df.select("vec_id", projections.relu_features("v", weights).alias("a"), projections.rbf_features("v", centres).alias("b")).collect()}
    assert np.allclose(got[1]["a"], np.maximum(0, np.array(weights) @ [0.5, -1.0, 2.0])) and np.allclose(got[1]["b"], [math.exp(-(1.5 - 3 * c)) for c in centres])
    assert got[2]["a"] is got[2]["b"] is got[3]["a"] is got[3]["b"] is None
    drawn = [projections.normal_value(1, i) for i in range(4_000)]
    assert abs(np.mean(drawn)) < 0.06 and abs(np.std(drawn) - 1) < 0.05


def test_attribute_lists(spark):
    df = spark.createDataFrame([(1, "x", 2.0, True, 3)], "a int, b string, c double, d boolean, e int")
    assert projections.select_attributes(df, "1,3-5", "3,2").columns == ["a", "c", "d", "e", "b"]
    assert projections.numeric_attributes(df).columns == ["a", "c", "e"] and projections.numeric_attributes(df, "b").columns == ["a", "b", "c", "e"]
    with pytest.raises(ValueError):
        projections.select_attributes(df, "4-6")
