"""Brute-force and property checks on small, skewed fixtures."""
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindlewatch.functions import ordered
from spindlewatch.operators import clusters, drift, gate, guards, metrics, models, neighbours, sampling, sequences
from spindlewatch.plans.answers_plan import DIM, cache
from spindlewatch.plans.registry import queries


def test_running_over_hot_ranges(spark):
    rng = random.Random(1)
    keys = rng.sample(range(100_000), 900) + list(range(500_000, 500_600))
    rows = [(k, "hot" if i % 3 else f"g{i % 7}", rng.randint(0, 9)) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k int, g string, v int")
    got = ordered.running(df, "k", {"s": F.col("v"), "n": F.lit(1)}, within=["g"], exclusive=True, ranges=16).toPandas().sort_values("k")
    want = pd.DataFrame(rows, columns=["k", "g", "v"]).sort_values("k")
    want["s"] = want.groupby("g").v.cumsum() - want.v
    want["n"] = want.groupby("g").cumcount()
    assert got[["k", "s", "n"]].values.tolist() == want[["k", "s", "n"]].values.tolist()


def test_previous_and_extremes(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else float((i * 7) % 13)) for i in range(300)], "k int, v double")
    got = ordered.running_extremes(df, "k", {"hi": ("max", F.col("v")), "last": ("last", F.col("v"))}, ranges=8).toPandas().sort_values("k")
    values = [None if i % 4 == 0 else float((i * 7) % 13) for i in range(300)]
    for i, row in enumerate(got.itertuples()):
        seen = [v for v in values[:i] if v is not None]
        assert (None if pd.isna(row.hi) else row.hi) == (max(seen) if seen else None)
        assert (None if pd.isna(row.last) else row.last) == (seen[-1] if seen else None)
    lagged = ordered.previous(df, "k", "v", "p", ranges=8).toPandas().sort_values("k").p
    assert [None if pd.isna(v) else v for v in lagged] == [None, *values[:-1]]


@pytest.mark.parametrize("k", [1, 3, 6])
def test_outliers_with_a_hot_cell(spark, monkeypatch, k):
    monkeypatch.setattr(neighbours, "SALT_ROWS", 20)  # forces several salts in the crowded cell
    rng = np.random.default_rng(2)
    pts = np.concatenate([rng.normal(0, 0.004, (150, 2)), rng.uniform(-1, 1, (250, 2)), [[5.0, 5.0]]])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id int, x double, y double")
    got = {r.id: r.outlier for r in neighbours.distance_outliers(df, "id", ["x", "y"], 0.1, k).collect()}
    d2 = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(axis=2)
    want = {i: bool((d2[i] <= 0.1 * 0.1).sum() < k) for i in range(len(pts))}
    assert got == want
    assert k > 1 or not any(got.values())


def test_range_pairs(spark):
    rng = np.random.default_rng(3)
    pts = rng.uniform(-1, 1, (200, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "a int, x double, y double")
    got = {(r.a, r.b) for r in neighbours.range_pairs(df, df.withColumnRenamed("a", "b"), "a", "b", ["x", "y"], 0.15).collect()}
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(axis=2))
    assert got == {(i, j) for i in range(200) for j in range(200) if d[i, j] <= 0.15}


def test_all_pairs_of_one_table_with_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PAIR_ROWS", 20)  # forces several blocks on both sides of the crowded cell
    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.normal(0.07, 0.004, (150, 2)), rng.uniform(-1, 1, (150, 2)), [[0.5, 0.5]] * 3])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "a int, x double, y double")
    pairs = [(r.a, r.other_id) for r in neighbours.neighbour_pairs(df, "a", ["x", "y"], 0.15).collect()]
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(axis=2))
    assert sorted(pairs) == [(i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)) if d[i, j] <= 0.15]


def test_every_vector_has_a_horizon(spark, sf):
    out = queries()["micro_clusters_horizons"](spark, sf).groupBy("horizon").agg(F.sum("n").alias("n")).collect()
    n = [min(b + 1, 3) * 100 for b in range(5)]  # 500 vectors in buckets of 100
    assert {r.horizon: r.n for r in out} == dict(enumerate(n))


def test_neighbours_of_all_labels(spark, sf):
    pairs = queries()["distance_self_join"](spark, sf)
    label = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label")
    assert pairs.join(label, "vec_id").select("label").distinct().count() == 10


def _relative_by_rows(rows, width):
    """(mae, rmse, relative mae, relative rmse) after each row: the reference's sums, one row after the other."""
    t, p = (np.array([r[j : j + 2] for r in rows], float) for j in (0, 2))
    base = np.array([t[i] - t[max(0, i + 1 - width) : i + 1].mean(axis=0) for i in range(len(rows))])
    for i in range(len(rows)):
        e, m = (abs(x[max(0, i + 1 - width) : i + 1]) for x in (t - p, base))
        with np.errstate(all="ignore"):
            yield e.mean(), np.sqrt((e * e).mean()), (e.sum(axis=0) / m.sum(axis=0)).mean(), np.sqrt((e * e).sum(axis=0) / (m * m).sum(axis=0)).mean()


def test_multi_target_against_the_running_mean(spark):
    rng = np.random.default_rng(6)
    rows = [(float(i + rng.normal()), float(rng.normal()), float(i), 0.0) for i in range(400)]  # the first target's mean moves
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, t1 double, t2 double, p1 double, p2 double")
    got = metrics.multi_target_relative(df, ["t1", "t2"], ["p1", "p2"], "k", ranges=8).first()
    assert got.instances == 400
    assert np.allclose((got.relative_mae, got.relative_rmse), list(_relative_by_rows(rows, 400))[-1][2:])
    part = metrics.multi_target_windowed(df, ["t1", "t2"], ["p1", "p2"], "k", 30, ranges=8).toPandas().sort_values("k")
    assert part.n.tolist() == list(range(1, 401))
    assert np.allclose(part[["mae", "rmse", "relative_mae", "relative_rmse"]].values[1:].astype(float), list(_relative_by_rows(rows, 30))[1:])


def test_components_of_a_long_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(60)], "node int")
    edges = spark.createDataFrame([(i, i + 1) for i in range(59) if i != 29], "src int, dst int")
    got = {r.node: r.component for r in clusters.components(nodes, edges).collect()}
    assert got == {i: 0 if i < 30 else 30 for i in range(60)}


@pytest.mark.parametrize("method", [m for m in drift.METHODS if m not in ("gma", "page_hinkley", "cusum")])
def test_detectors_see_a_jump(method):
    rng = random.Random(4)
    params = {"rddm": {"min_n": 30}, "ensemble": {"methods": ("ddm", "hddm_a", "adwin")}}.get(method, {})
    detector = drift.METHODS[method](**params)
    calm = [detector.update(float(rng.random() < 0.1))[2] for _ in range(600)]
    storm = [detector.update(float(rng.random() < 0.7))[2] for _ in range(400)]
    assert any(storm)
    assert sum(calm) <= 20


@pytest.mark.parametrize("method,params", [("cusum", {}), ("page_hinkley", {}), ("gma", {"threshold": 0.2})])
def test_sum_detectors_see_a_jump(method, params):
    detector = drift.METHODS[method](**params)
    assert not any(detector.update(0.0)[2] for _ in range(300))
    assert any(detector.update(1.0)[2] for _ in range(300))


def test_batches_do_not_matter(spark):
    rng = random.Random(5)
    rows = [(i % 3, i, float(rng.random() < (0.1 if i < 1500 else 0.6))) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, i int, x double")
    one = {(r.k, r.i): (r.estimation, r.change) for r in drift.detect_drift(df, ["k"], "i", "x", "ddm").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        many = {(r.k, r.i): (r.estimation, r.change) for r in drift.detect_drift(df, ["k"], "i", "x", "ddm").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert one == many
    assert any(c for _, c in one.values())


def test_policy_identity_and_variant_rows(spark, sf):
    c = cache(spark, sf)
    models_of = [r.model for r in c.select("model").distinct().collect()]
    same = gate.apply_policy(c, gate.policy_table(spark, {m: {} for m in models_of}, DIM)).select("disk", "day", "z", "kept")
    joined = c.select("disk", "day", F.col("z").alias("z0")).join(same, ["disk", "day"])
    assert joined.where("NOT kept OR z0 != z").count() == 0
    off = gate.apply_policy(c, gate.policy_table(spark, {m: {"enabled": False} for m in models_of}, DIM))
    assert off.where("kept OR exists(z, v -> v != 0)").count() == 0
    out = gate.cache_variant(c, 0.2, 0.5, dims=None)
    assert out.count() == c.count()
    assert out.where("reason != 'kept' AND exists(z, v -> v != 0)").count() == 0


def test_keep_dims():
    assert gate.keep_dims("all", 64) is None and gate.keep_dims("", 64) is None
    assert gate.keep_dims("3, 1,3,99", 64) == [1, 3] and gate.keep_dims("5", 64) == [5] and gate.keep_dims("99", 64) is None
    assert gate.keep_dims([2, "1", "x"], 64) == [1, 2]
    assert gate.semantic_dims(["SMART_9:drop", "SMART_5"], ["all_meta"], ["SMART_5", "SMART_9"], ["up", "drop"]) == [*range(16), 19, 16, 17]


def test_global_counts_are_sums(spark):
    rows = [(d, (d * 7 + i) % 2, (d + i * i) % 2) for d in range(5) for i in range(20)]
    df = spark.createDataFrame(rows, "eval_day int, true_class int, pred_class int")
    local = metrics.confusion(df, ["eval_day"])
    last = metrics.cumulative(local).orderBy(F.desc("eval_day")).first()
    assert [last.tp, last.fp, last.tn, last.fn] == list(metrics.confusion(df).first())


def test_auc_of_an_empty_class_and_ties(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", 0.4, 1), ("b", 0.5, 1), ("b", 0.5, 0), ("b", 0.1, 0)], "g string, s double, y int")
    got = {r.g: r.auc for r in metrics.auc(df, "s", "y", ["g"]).collect()}
    assert got == {"a": 1.0, "b": 0.75}


def test_drift_evaluation(spark):
    rows = [(i, i in (7, 25), i in (5, 6), i in (3, 12)) for i in range(30)]
    df = spark.createDataFrame(rows, "n int, change boolean, warning boolean, true_change boolean")
    r = metrics.drift_evaluation(df).first()
    assert (r.detected, r.true_changes, r.found_changes, r.mean_delay) == (2, 2, 2, (4 + 13) / 2)


def test_poisson_mean_and_determinism(spark):
    df = spark.range(20_000).withColumn("label", (F.col("id") % 2).cast("int"))
    a = sampling.poisson_weights(df, ["id"], "label", F.lit(12.0), 6.0)
    means = {r.label: r.m for r in a.groupBy("label").agg(F.avg("weight").alias("m")).collect()}
    assert abs(means[1] - 6.0) < 0.1 and abs(means[0] - 0.5) < 0.05
    b = sampling.poisson_weights(df.repartition(3), ["id"], "label", F.lit(12.0), 6.0)
    assert a.exceptAll(b).isEmpty()


def test_quotas_with_more_days_than_windows(spark):
    counts = spark.createDataFrame([(d, 5) for d in range(10)], "day int, n int")
    got = sampling.day_quotas(counts, 4).collect()
    assert sum(r.quota for r in got) == 4 and {r.quota for r in got} == {0, 1}


def test_mllib_learners(spark):
    rng = random.Random(6)
    rows = [(i // 100, float(x := rng.random()), float(rng.random()), int(x > 0.5)) for i in range(300)]
    df = spark.createDataFrame(rows, "chunk int, a double, b double, y int")
    for kind, params in [("stump", {}), ("tree", {}), ("boosting", {"maxIter": 3}), ("logistic", {}), ("svm", {"maxIter": 5}), ("mlp", {"layers": [2, 3, 2], "seed": 1})]:
        out = models.test_then_train(df, "chunk", [1, 2], ["a", "b"], "y", kind, **params)
        assert out.count() == 200
        if kind == "stump":
            assert out.where("prediction = y").count() > 180


def test_reachability_sees_nothing(spark):
    df = spark.createDataFrame([(1, 0.5, 0.9), (2, 0.6, 0.8)], "eval_day int, recall double, acc double")
    r = guards.reachability(df, df, ["recall", "acc"]).first()
    assert (r.changed_days, r.max_abs_diff, r.reachable) == (0, 0.0, False)


def test_impute_constant_and_mode(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, "a"), (4, "b"), (5, None)], "k int, v string")
    got = [r.v for r in sequences.impute_nominal(df, "k", "v", "mode", ["a", "b"]).orderBy("k").collect()]
    assert got == [None, "b", "a", "b", "b"]


def test_first_failure_ends_a_disk(spark):
    from spindlewatch.operators import labels

    daily = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-03"), ("b", "2024-01-03")], "disk string, day string")
    failures = spark.createDataFrame([("a", "2024-01-02"), ("a", "2024-01-04")], "disk string, fail_day string")
    assert sorted(map(tuple, labels.drop_after_failure(daily, failures).select("disk", "day").collect())) == [("a", "2024-01-01"), ("b", "2024-01-03")]


def test_long_keys_match(spark):
    from spindlewatch.operators import quality

    key = "_".join(["x"] * 104 + ["end"])
    known = spark.createDataFrame([(key,)], "key string")
    assert quality.suffix_match(known, known).collect()[0].known == key


def test_policy_text_values(spark):
    from spindlewatch.operators import gate

    p = gate.policy_table(spark, {"m": {"allowed_root_causes": "media, Power,odd", "dense_meta_pack": "false", "min_rule_match": "yes"}}, 8).first()
    assert ["media", "power", "unknown"] in [list(v) for v in p if isinstance(v, list)]
    assert [v for v in p if isinstance(v, bool)][-1] is False
