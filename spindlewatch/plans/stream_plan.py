"""Queries over drift detection, clusters, outliers and models."""
from __future__ import annotations

from pyspark.sql import functions as F

from spindlewatch.functions.scalars import r4
from spindlewatch.operators import clusters, drift, metrics, models, neighbours
from spindlewatch.operators.windows import stage
from spindlewatch.plans.bridge import daily, daily_sql, day_range, table
from spindlewatch.plans.eval_plan import _PRED, predictions


def _round(df, names):
    return df.withColumns({n: r4(F.col(n)) for n in names})


# ---- drift -------------------------------------------------------------------------------------------------------------------
PARAMS = {"page_hinkley": {"threshold": 3.0}, "cusum": {"threshold": 3.0}, "gma": {"threshold": 0.02}, "adwin": {"delta": 0.3},
          "ddm": {"warning": 1.0, "drift": 1.5}, "rddm": {"warning": 1.0, "drift": 1.5}, "ewma": {}, "stepd": {"drift": 0.05, "warning": 0.1}}


def errors(spark, sf):
    """Error stream per model: is an event an error, in event order."""
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return ev.select((F.col("user_id") % 4).alias("model_no"), "event_id", (F.col("event_type") == "error").cast("double").alias("x"))


def _q_drift(method):
    def q(spark, sf):
        out = drift.detect_drift(errors(spark, sf), ["model_no"], "event_id", "x", method, **PARAMS.get(method, {}))
        return out.select("model_no", "event_id", r4(F.col("estimation")).alias("estimation"), "warning", "change")

    return q


def q_drift_eval(spark, sf):
    out = drift.detect_drift(errors(spark, sf), ["model_no"], "event_id", "x", "cusum", **PARAMS["cusum"])
    out = out.withColumn("true_change", F.col("event_id") % 1000 == 500)
    return _round(metrics.drift_evaluation(out, "event_id", ["model_no"]), ["mean_delay"])


def q_segments(spark, sf):
    out = drift.segments(drift.detect_drift(errors(spark, sf), ["model_no"], "event_id", "x", "cusum", **PARAMS["cusum"]), ["model_no"], "event_id")
    return out.groupBy("model_no", "segment").agg(F.count(F.lit(1)).alias("n"), r4(F.avg("x")).alias("error_rate"))


# ---- clusters and outliers ---------------------------------------------------------------------------------------------------
XY, SIDE, EPS, MU = ["x", "y"], 0.04, 0.06, 8.0


def points(spark, sf):
    """Embeddings as points: two dimensions, the label as ground truth."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(XY)], F.col("label").alias("class"))


def assigned(spark, sf):
    p = points(spark, sf)
    return clusters.nearest(p, XY, clusters.centroids(p, XY, "class"))


def q_outliers(spark, sf):
    p = points(spark, sf).withColumn("tile", F.floor(F.col("vec_id") / 200).cast("bigint"))
    return neighbours.distance_outliers(p, "vec_id", XY, 0.05, 6, ["tile"])


def q_range_join(spark, sf):
    p = points(spark, sf)
    a = p.where("class < 2").select("vec_id", *XY)
    b = p.where("class = 2").select(F.col("vec_id").alias("other_id"), *XY)
    return neighbours.range_pairs(a, b, "vec_id", "other_id", XY, 0.03).withColumn("distance", r4(F.col("distance")))


def q_neighbours(spark, sf):
    """All points with all points; ``distance_range_join`` is the form with two tables, here of some labels each."""
    return neighbours.neighbour_pairs(points(spark, sf), "vec_id", XY, 0.03).withColumn("distance", r4(F.col("distance")))


def micro(spark, sf):
    return clusters.micro_clusters(points(spark, sf), XY, SIDE)


_text = lambda c: F.concat_ws(",", F.transform(c, lambda v: v.cast("string")))


def q_micro(spark, sf):
    p = points(spark, sf)
    m = clusters.micro_clusters(p, XY, SIDE, age=F.floor(F.col("vec_id") / 100), decay=0.5)
    return m.select(_text("cell").alias("cell"), "n", r4(F.col("weight")).alias("weight"), r4(F.get("ls", F.lit(0))).alias("ls0"), r4(F.get("ss", F.lit(1))).alias("ss1"))


def q_horizon(spark, sf):
    p = points(spark, sf).withColumn("bucket", F.floor(F.col("vec_id") / 100).cast("bigint"))
    m = clusters.horizon(clusters.micro_clusters(p, XY, SIDE, by=["bucket"]), "bucket", 1, 3)
    return m.select(_text("cell").alias("cell"), "n", r4(F.get("ls", F.lit(0))).alias("ls0"), r4(F.get("ss", F.lit(1))).alias("ss1"))


def q_horizons(spark, sf):
    """The last three buckets at every bucket; ``micro_clusters_horizon`` is one fixed horizon."""
    p = points(spark, sf).withColumn("bucket", F.floor(F.col("vec_id") / 100).cast("bigint"))
    m = clusters.horizons(clusters.micro_clusters(p, XY, SIDE, by=["bucket"]), "bucket", 3)
    return m.select("horizon", _text("cell").alias("cell"), "n", r4(F.get("ls", F.lit(0))).alias("ls0"), r4(F.get("ss", F.lit(1))).alias("ss1"))


def q_dbscan(spark, sf):
    out = clusters.dbscan(micro(spark, sf), EPS, MU, 2)
    return out.select(_text("cell").alias("cell"), _text("cluster").alias("cluster"), "core")


def q_denstream(spark, sf):
    m = clusters.micro_clusters(points(spark, sf), XY, SIDE, age=F.floor(F.col("vec_id") / 100), decay=0.8)
    out = clusters.dbscan(m.where("weight >= 0.5"), EPS, MU / 2, 2)
    return out.select(_text("cell").alias("cell"), _text("cluster").alias("cluster"), "core")


def q_dstream(spark, sf):
    m = clusters.micro_clusters(points(spark, sf), XY, SIDE, age=F.floor(F.col("vec_id") / 100), decay=0.9)
    out = clusters.density_grid(m, 40, 0.9, 6.0, 2.0)
    return out.select(_text("cell").alias("cell"), r4(F.col("weight")).alias("weight"), "kind", _text("cluster").alias("cluster"))


def q_kmeans(spark, sf):
    """k-means over weighted micro-clusters, judged by SSQ of the points."""
    centres = clusters.kmeans_centres(micro(spark, sf), 8)
    rows = spark.createDataFrame(list(enumerate(centres)), "id int, centre array<double>")
    return clusters.ssq(clusters.nearest(points(spark, sf), XY, rows))


def q_ssq(spark, sf):
    return _round(clusters.ssq(assigned(spark, sf)), ["ssq"])


def table_of(spark, sf):
    return clusters.contingency(assigned(spark, sf))


def q_membership(spark, sf):
    return clusters.membership_matrix(table_of(spark, sf), list(range(10)))


def q_f1(spark, sf):
    return _round(clusters.f1_purity(table_of(spark, sf)), ["f1_p", "purity", "f1_r"])


def q_entropy(spark, sf):
    out = clusters.entropies(table_of(spark, sf), 10, 10)
    return _round(out, out.columns)


def q_pairs(spark, sf):
    return _round(clusters.pair_statistics(table_of(spark, sf)), ["rand", "van_dongen"])


def q_separation(spark, sf):
    return _round(clusters.separation(assigned(spark, sf), XY), ["bss", "bss_gt", "bss_ratio"])


def q_general(spark, sf):
    p = points(spark, sf)
    spheres = clusters.centroids(p, XY, "class").withColumn("radius", F.lit(0.1))
    return _round(clusters.coverage_measures(p, XY, spheres), ["gprecision", "grecall", "redundancy"])


def q_silhouette(spark, sf):
    return _round(clusters.silhouette(assigned(spark, sf), XY), ["silhouette"])


# ---- models ------------------------------------------------------------------------------------------------------------------


def q_gaussian(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_discount", "l_quantity")
    return _round(models.gaussian(li, "l_discount", ["l_returnflag"], "l_quantity"), ["weight", "mean", "variance"])


def q_quantiles(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity")
    out = models.quantile_summary(li, "l_quantity", [0.25, 0.5, 0.75], ["l_returnflag"])
    return out.select("l_returnflag", *[F.get("quantiles", F.lit(i)).alias(f"q{p}") for i, p in enumerate((25, 50, 75))])


def q_split(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus", (F.col("o_totalprice") > 250000).alias("expensive"))
    return _round(models.split_merit(o, "expensive", "o_orderstatus", ["o_orderpriority"]), ["info_gain", "gini_gain"])


def q_variance(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_quantity") > 25).alias("big"), (F.col("l_extendedprice") / 1000).alias("k"))
    return _round(models.variance_reduction(li, "big", "k", ["l_returnflag"]), ["variance_reduction", "sd_reduction"])


def q_majority(spark, sf):
    return models.majority(table(spark, sf, "orders").select("o_custkey", "o_orderstatus"), "o_orderstatus", ["o_custkey"])


def q_labelset(spark, sf):
    df = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return models.majority(df.withColumn("labels", F.concat_ws("", "quality", "toxic")), "labels", ["lang"])


NB = ["l_quantity", "l_discount"]


def q_bayes(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", *NB)
    stats = models.naive_bayes_fit(li, "l_returnflag", NB)
    out = models.naive_bayes_predict(li, stats, "l_returnflag", NB)
    return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r4(F.avg("prediction_score")).alias("mean_score"))


def q_preq_bayes(delay):
    def q(spark, sf):
        ev = table(spark, sf, "events").select("event_id", (F.col("event_type") == "error").cast("int").alias("klass"), "value", (F.col("user_id") % 7).cast("double").alias("u"))
        out = models.prequential_naive_bayes(ev, "event_id", "klass", ["value", "u"], 200, delay)
        return out.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.count("prediction").alias("scored"), r4(F.avg("prediction_score")).alias("mean_score"))

    return q


def scored_events(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "value", "user_id")
    return ev.select("event_id", (F.col("event_type") == "error").cast("int").alias("klass"), "value", (F.col("user_id") % 7).cast("double").alias("u"))


def q_preq_cv(mode):
    def q(spark, sf):
        out = models.prequential_folds(scored_events(spark, sf), "event_id", "klass", ["value", "u"], 250, 4, mode)
        return out.groupBy("fold", "chunk").agg(F.count(F.lit(1)).alias("n"), F.count("prediction").alias("scored"), r4(F.avg("prediction_score")).alias("mean_score"))

    return q


def q_holdout(spark, sf):
    out = models.periodic_holdout(scored_events(spark, sf), "event_id", "klass", ["value", "u"], 200, 250)
    return out.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), r4(F.avg((F.col("prediction") == F.col("klass")).cast("double"))).alias("accuracy"), r4(F.avg("prediction_score")).alias("mean_score"))


def q_active_windowed(spark, sf):
    ev = table(spark, sf, "events").select("event_id", (F.col("value") < 5).cast("double").alias("q"), ((F.col("event_type") == "error") == (F.col("value") > 30)).cast("double").alias("hit"))
    out = metrics.sliding(ev, "event_id", {"accuracy": F.col("hit"), "label_cost": F.col("q")}, 300)
    return out.select("n", r4(F.col("accuracy")).alias("accuracy"), r4(F.col("label_cost")).alias("label_cost"))


def q_multinomial(spark, sf):
    out = models.multinomial_bayes(table(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id", "text", "lang")
    return out.groupBy("lang", "prediction").agg(F.count(F.lit(1)).alias("n"))


def member_scores(spark, sf):
    """Three stand-in members voting on daily rows."""
    p = predictions(spark, sf).select("disk", "day", "failure", "vote_1", "smart_199_raw")
    p = stage(p, {"a": "vote_1", "b": "least(1.0D, coalesce(smart_199_raw, 0.0D) / 60.0D)", "c": "0.2D"})
    return p.select("disk", "day", "failure", F.expr("inline(array(named_struct('member', 'a', 'p', a), named_struct('member', 'b', 'p', b), named_struct('member', 'c', 'p', c)))"))


def _weights(spark, sf, rule):
    s = member_scores(spark, sf)
    s = s.withColumns({"error2": F.pow(F.when(F.col("failure") == 1, 1.0 - F.col("p")).otherwise(F.col("p")), 2), "mser": F.lit(0.25),
                       "wrong": (F.col("p") > 0.5).cast("int") != F.col("failure")})
    return models.member_weights(s, "member", rule, beta=0.999)


def q_weights(spark, sf):
    out = None
    for rule in ("accuracy_weighted", "accuracy_updated", "majority"):
        part = _weights(spark, sf, rule).select("member", F.lit(rule).alias("rule"), r4(F.col("weight")).alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out


def q_vote(spark, sf):
    s = member_scores(spark, sf)
    votes = s.select("disk", "day", "member", F.expr("inline(array(named_struct('class', 0, 'vote', 1.0D - p), named_struct('class', 1, 'vote', p)))"))
    out = models.weighted_vote(votes, _weights(spark, sf, "accuracy_updated"), ["disk", "day"], "member")
    return out.select("disk", "day", F.col("prediction").cast("bigint").alias("prediction"), r4(F.col("mass")).alias("mass"))


def q_transfer(spark, sf):
    p = predictions(spark, sf).select("disk", "day", (F.unix_date("day").cast("bigint") * 1000000 + F.col("disk_no")).alias("seq"), "failure", "vote_1", "smart_199_raw")
    p = stage(p, {"old": "array(1.0D - vote_1, vote_1)", "new": "array(0.5D, least(1.0D, coalesce(smart_199_raw, 0.0D) / 60.0D))"})
    out = models.transfer_votes(p, "seq", "failure", "old", "new", 0.99)
    return out.select("disk", "day", r4(F.col("theta")).alias("theta"), *[r4(F.get("votes", F.lit(i))).alias(f"vote_{i}") for i in (0, 1)])


def ratings(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("int").alias("user"), F.col("l_partkey").cast("int").alias("item"), F.col("l_quantity").alias("rating"), "l_orderkey"
    )


def q_baseline(spark, sf):
    out = models.baseline_ratings(ratings(spark, sf), high=50.0)
    return out.groupBy("user").agg(F.count(F.lit(1)).alias("n"), r4(F.avg("prediction")).alias("mean_prediction"), r4(F.avg(F.abs(F.col("rating") - F.col("prediction")))).alias("mae"))


def q_als(spark, sf):
    out = models.factor_ratings(ratings(spark, sf), 4, 3)
    return out.agg(F.count(F.lit(1)).alias("n"), (F.sqrt(F.avg(F.pow(F.col("rating") - F.col("prediction"), 2))) < 50).alias("rmse_in_range"))


def q_running_rmse(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value", F.lit(20.0).alias("guess"))
    return models.running_rmse(ev, "event_id", "value", "guess").select("event_id", r4(F.col("rmse")).alias("rmse"))


def q_knn(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.expr("transform(slice(embedding, 1, 8), v -> cast(v AS double))").alias("v"), "label")
    return models.knn_recent(e, "vec_id", "v", "label", 5, 100)


def q_anomaly(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_discount")
    out = None
    for bound in ("cantelli", "chebyshev", "gauss"):
        s = models.odds_ratio_anomaly(li, ["l_quantity", "l_extendedprice", "l_discount"], bound, ["l_returnflag"])
        part = s.groupBy("l_returnflag").agg(r4(F.avg("anomaly_score")).alias("mean_score"), r4(F.min("anomaly_score")).alias("min_score")).withColumn("bound", F.lit(bound))
        out = part if out is None else out.unionByName(part)
    return out


def q_forest(spark, sf):
    """Weighted forest per day on the as-of sets; judged only by what it covers, as trees differ between engines."""
    from spindlewatch.operators import labels, sampling

    d = daily(spark, sf)
    feats = ["smart_5_raw", "smart_199_raw", "smart_194_raw", "smart_192_raw"]
    sets = sampling.poisson_weights(labels.asof_sets(d, 30, 7, 5, end=day_range(spark, sf)[1]), ["disk", "day"], "label", F.lit(2.0))
    sets = sets.withColumn("weight", F.when(F.col("split") == "test", 1.0).otherwise(F.col("weight").cast("double")))
    # two classes also on a day whose train rows are of one
    sets = sets.withColumn("label", F.col("label").cast("double").alias("label", metadata={"ml_attr": {"type": "nominal", "vals": ["0", "1"]}}))
    out = models.train_per_day(sets, feats, "label", None, "forest", "weight", numTrees=10, maxDepth=4, seed=1)
    return out.groupBy("asof_day").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction").isin(0.0, 1.0)).alias("judged"))


# ---- SQL twins ---------------------------------------------------------------------------------------------------------------
_R = lambda e, n: f"round({e},4)+0.0::DOUBLE AS {n}"
_ES = "es AS (SELECT user_id%4 AS model_no, event_id, (event_type='error')::INT::DOUBLE AS x, row_number() OVER (PARTITION BY user_id%4 ORDER BY event_id) AS i FROM events)"


def _fold(init: str, lets: list[str], out: str) -> str:
    """A detector as a recursive query: ``init`` is the restart state, ``lets`` are columns computed one after the other."""
    src = "SELECT es.model_no, es.event_id, es.i, es.x, CASE WHEN r.chg THEN s0 ELSE r.st END AS s FROM r JOIN es ON es.model_no=r.model_no AND es.i=r.i+1"
    src = src.replace("s0", init)
    for let in lets:
        src = f"SELECT *, {let} FROM ({src})"
    return f"""WITH RECURSIVE {_ES}, r AS (SELECT DISTINCT model_no, -1::BIGINT AS event_id, 0::BIGINT AS i, {init} AS st, 0.0::DOUBLE AS est, false AS warn, false AS chg FROM es
      UNION ALL SELECT model_no, event_id, i, {out} FROM ({src})) SELECT model_no, event_id, {_R('est', 'estimation')}, warn AS warning, chg AS change FROM r WHERE i>0"""


_S = lambda **kw: "{" + ",".join(f"'{k}':{v}" for k, v in kw.items()) + "}"
_D = "::DOUBLE"
_MEAN = ["s.n+1 AS n", "s.mean+(x-s.mean)/n AS mean"]


def _sum_fold(total: str, thr: float) -> str:
    init = _S(n=f"0.0{_D}", mean=f"0.0{_D}", t=f"0.0{_D}")
    return _fold(init, [*_MEAN, f"{total} AS t", f"n+1>=30 AND t>{thr}{_D} AS c"], f"{_S(n='n', mean='mean', t='t')}, mean, false, c")


_DDM = _fold(
    _S(n=f"0.0{_D}", mean=f"0.0{_D}", bp=f"1e9{_D}", bs=f"1e9{_D}"),
    [*_MEAN, "sqrt(greatest(0.0::DOUBLE,mean*(1-mean))/n) AS sd", "n+1>=30 AND mean+sd<=s.bp+s.bs AS better", "CASE WHEN better THEN mean ELSE s.bp END AS bp", "CASE WHEN better THEN sd ELSE s.bs END AS bs",
     "n+1>30 AND mean+sd>bp+1.5::DOUBLE*bs AS c", "n+1>=30 AND NOT c AND mean+sd>bp+1.0::DOUBLE*bs AS w"],
    f"{_S(n='n', mean='mean', bp='bp', bs='bs')}, mean, w, c",
)
_EWMA = _fold(
    _S(n=f"0.0{_D}", t=f"0.0{_D}", z=f"0.0{_D}"),
    ["s.n+1 AS n", "s.t+x AS t", "t/n AS p", "s.z+0.2::DOUBLE*(x-s.z) AS z", "sqrt(greatest(0.0::DOUBLE,p*(1-p)*0.2::DOUBLE*(1-pow(0.8::DOUBLE,2*n))/1.8::DOUBLE)) AS sd",
     "(3.97::DOUBLE-6.56::DOUBLE*p+48.73::DOUBLE*pow(p,3)-330.13::DOUBLE*pow(p,5)+848.18::DOUBLE*pow(p,7))*sd AS lim", "n+1>30 AND z>p+lim AS c", "n+1>=30 AND NOT c AND z>p+0.5::DOUBLE*lim AS w"],
    f"{_S(n='n', t='t', z='z')}, p, w, c",
)
_EDDM = _fold(
    _S(rows="0::BIGINT", n=f"0.0{_D}", mean=f"0.0{_D}", sp=f"0.0{_D}", pk=f"0.0{_D}", last="0::BIGINT", w="false"),
    ["s.rows+1 AS rows", "x=1 AS hit", "CASE WHEN hit THEN rows-s.last END AS gap", "CASE WHEN hit THEN s.n+1 ELSE s.n END AS n", "CASE WHEN hit THEN s.mean+(gap-s.mean)/n ELSE s.mean END AS mean",
     "CASE WHEN hit THEN s.sp+(gap-mean)*(gap-s.mean) ELSE s.sp END AS sp", "CASE WHEN hit THEN mean+2*sqrt(sp/n) END AS lv", "CASE WHEN hit AND lv>s.pk AND rows+1>30 THEN lv ELSE s.pk END AS pk", "CASE WHEN hit THEN rows ELSE s.last END AS last",
     "coalesce(hit AND lv<=s.pk AND rows+1>30 AND n>30 AND s.pk>0 AND lv/nullif(s.pk,0)<0.9::DOUBLE,false) AS c", "coalesce(CASE WHEN hit THEN NOT c AND lv<=s.pk AND rows+1>30 AND n>30 AND s.pk>0 AND lv/nullif(s.pk,0)<0.95::DOUBLE ELSE s.w END,false) AS w"],
    f"{_S(rows='rows', n='n', mean='mean', sp='sp', pk='pk', last='last', w='w')}, mean, w, c",
).replace("CASE WHEN r.chg THEN {'rows':0::BIGINT,'n':0.0::DOUBLE,'mean':0.0::DOUBLE,'sp':0.0::DOUBLE,'pk':0.0::DOUBLE,'last':0::BIGINT,'w':false}", "CASE WHEN r.chg THEN {'rows':0::BIGINT,'n':0.0::DOUBLE,'mean':0.0::DOUBLE,'sp':0.0::DOUBLE,'pk':0.0::DOUBLE,'last':0::BIGINT,'w':r.warn}")
_apart = lambda k, conf: f"sqrt((n-{k})/(2*{k}*n)*ln(2/{conf}::DOUBLE))"
_wd = lambda k: f"sqrt(ln(1/0.001::DOUBLE)/(2*{k}))"
_HDDMA = _fold(
    _S(n=f"0.0{_D}", c=f"0.0{_D}", ln=f"0.0{_D}", lc=f"0.0{_D}", hn=f"0.0{_D}", hc=f"0.0{_D}"),
    ["s.n+1 AS n", "s.c+x AS c", "c/n AS m", "CASE WHEN s.ln=0 THEN n ELSE s.ln END AS ln0", "CASE WHEN s.ln=0 THEN c ELSE s.lc END AS lc0", "CASE WHEN s.hn=0 THEN n ELSE s.hn END AS hn0", "CASE WHEN s.hn=0 THEN c ELSE s.hc END AS hc0",
     f"lc0/ln0+{_wd('ln0')}>=m+{_wd('n')} AS lo", f"hc0/hn0-{_wd('hn0')}<=m-{_wd('n')} AS hi", "CASE WHEN lo THEN n ELSE ln0 END AS ln", "CASE WHEN lo THEN c ELSE lc0 END AS lc", "CASE WHEN hi THEN n ELSE hn0 END AS hn", "CASE WHEN hi THEN c ELSE hc0 END AS hc",
     f"ln<n AND m-lc/ln>={_apart('ln', 0.001)} AS ch", f"NOT ch AND ln<n AND m-lc/ln>={_apart('ln', 0.005)} AS w", f"NOT ch AND hn<n AND hc/hn-m>={_apart('hn', 0.001)} AS dn"],
    f"CASE WHEN dn THEN {_S(n=f'0.0{_D}', c=f'0.0{_D}', ln=f'0.0{_D}', lc=f'0.0{_D}', hn=f'0.0{_D}', hc=f'0.0{_D}')} ELSE {_S(n='n', c='c', ln='ln', lc='lc', hn='hn', hc='hc')} END, m, w, ch",
)
_bl = lambda m, q, a, b: [f"CASE WHEN {m}<0 THEN x ELSE 0.05::DOUBLE*x+0.95::DOUBLE*{m} END AS {a}", f"CASE WHEN {m}<0 THEN 1.0::DOUBLE ELSE 0.05::DOUBLE*0.05::DOUBLE+0.95::DOUBLE*0.95::DOUBLE*{q} END AS {b}"]
_HDDMW = _fold(
    _S(tm=f"-1.0{_D}", ts=f"0.0{_D}", ed=f"1e300{_D}", am=f"-1.0{_D}", asq=f"0.0{_D}", bm=f"-1.0{_D}", bs=f"0.0{_D}"),
    [*_bl("s.tm", "s.ts", "tm", "ts"), "tm+sqrt(ts*ln(1/0.001::DOUBLE)/2) AS e", "e<s.ed AS b", "CASE WHEN b THEN e ELSE s.ed END AS ed", "CASE WHEN b THEN tm ELSE s.am END AS am", "CASE WHEN b THEN ts ELSE s.asq END AS asq",
     *_bl("s.bm", "s.bs", "b0", "b1"), "CASE WHEN b THEN -1.0::DOUBLE ELSE b0 END AS bm", "CASE WHEN b THEN 0.0::DOUBLE ELSE b1 END AS bs",
     "am>=0 AND bm>=0 AND bm-am>sqrt((asq+bs)*ln(1/0.001::DOUBLE)/2) AS ch", "NOT ch AND am>=0 AND bm>=0 AND bm-am>sqrt((asq+bs)*ln(1/0.005::DOUBLE)/2) AS w"],
    f"{_S(tm='tm', ts='ts', ed='ed', am='am', asq='asq', bm='bm', bs='bs')}, tm, w, ch",
)
_CUSUM = _sum_fold("greatest(0.0::DOUBLE,s.t+x-mean-0.005::DOUBLE)", 3.0)
_PT = "pt AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label AS class FROM embeddings)"
_AS = f"""{_PT}, ce AS (SELECT class AS id, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM pt GROUP BY class),
asg AS (SELECT p.*, c.id AS cluster, (x-cx)*(x-cx)+(y-cy)*(y-cy) AS d2 FROM pt p, ce c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY (x-cx)*(x-cx)+(y-cy)*(y-cy), c.id)=1)"""
_CT = f"{_AS}, ct AS (SELECT cluster, class, count(*) AS n, sum(count(*)) OVER (PARTITION BY cluster) AS a, sum(count(*)) OVER (PARTITION BY class) AS b, sum(count(*)) OVER () AS t FROM asg GROUP BY cluster, class)"
_CELL = f"floor(x/{SIDE}::DOUBLE)::BIGINT AS i, floor(y/{SIDE}::DOUBLE)::BIGINT AS j"


def _dbscan_sql(weight: str, floor_w: float, mu: float) -> str:
    return f"""WITH RECURSIVE {_PT}, mc AS (SELECT {_CELL}, sum({weight}) AS w, sum({weight}*x)/sum({weight}) AS cx, sum({weight}*y)/sum({weight}) AS cy FROM pt GROUP BY ALL HAVING sum({weight})>={floor_w}),
      nb AS (SELECT [a.i,a.j] AS a, [b.i,b.j] AS b, b.w FROM mc a JOIN mc b ON (a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)<={EPS}::DOUBLE*{EPS}::DOUBLE),
      co AS (SELECT a FROM nb GROUP BY a HAVING sum(w)>={mu}), lk AS (SELECT a, b FROM nb WHERE a IN (SELECT a FROM co) AND b IN (SELECT a FROM co)),
      cc AS (SELECT a AS node, a AS comp FROM co UNION SELECT lk.b, cc.comp FROM cc JOIN lk ON lk.a=cc.node), cp AS (SELECT node, min(comp) AS comp FROM cc GROUP BY node),
      bd AS (SELECT a, min(comp) AS comp FROM nb JOIN cp ON cp.node=nb.b GROUP BY a)
      SELECT m.i||','||m.j AS cell, coalesce(array_to_string(coalesce(cp.comp,bd.comp),','),'') AS cluster, co.a IS NOT NULL AS core FROM mc m LEFT JOIN co ON co.a=[m.i,m.j] LEFT JOIN cp ON cp.node=[m.i,m.j] LEFT JOIN bd ON bd.a=[m.i,m.j]"""


_NBS = "nb AS (SELECT l_returnflag AS k, count(*) AS r, {} FROM lineitem GROUP BY 1)".format(", ".join(f"avg({f}) AS m{i}, var_samp({f}) AS v{i}" for i, f in enumerate(NB)))
_LD = lambda x, m, v: f"(-0.5::DOUBLE*ln(2.0::DOUBLE*pi()*{v})-({x}-{m})*({x}-{m})/(2.0::DOUBLE*{v}))"


def _preq(delay: int) -> str:
    ld = lambda x, i: f"CASE WHEN v{i}>0 THEN {_LD(x, f'm{i}', f'v{i}')} ELSE CASE WHEN {x}=m{i} THEN 0.0::DOUBLE ELSE -700.0::DOUBLE END END"
    st = ", ".join(f"sum({c}) AS s{i}, sum({c}*{c}) AS q{i}" for i, c in enumerate(("value", "u")))
    return f"""WITH e AS (SELECT event_id, (event_type='error')::INT AS k, value, (user_id%7)::DOUBLE AS u, (row_number() OVER (ORDER BY event_id)-1)//200 AS chunk FROM events),
      m0 AS (SELECT t.chunk, k, count(*) AS n, {st} FROM (SELECT DISTINCT chunk FROM e) t JOIN e ON e.chunk<t.chunk-{delay} GROUP BY ALL),
      m AS (SELECT *, {', '.join(f's{i}/n AS m{i}, CASE WHEN n>1 THEN greatest(0.0::DOUBLE,(q{i}-s{i}*s{i}/n)/(n-1)) ELSE 0.0::DOUBLE END AS v{i}' for i in (0, 1))}, sum(n) OVER (PARTITION BY chunk) AS tot FROM m0),
      s AS (SELECT e.chunk, e.event_id, max(ln(m.n/m.tot)+{ld('value', 0)}+{ld('u', 1)}) AS sc FROM e LEFT JOIN m ON m.chunk=e.chunk GROUP BY ALL)
      SELECT chunk, count(*) AS n, count(sc) AS scored, {_R('avg(sc)', 'mean_score')} FROM s GROUP BY chunk"""


_LDX = lambda x, i: f"CASE WHEN v{i}>0 THEN {_LD(x, f'm{i}', f'v{i}')} ELSE CASE WHEN {x}=m{i} THEN 0.0::DOUBLE ELSE -700.0::DOUBLE END END"
_STX = ", ".join(f"sum({c}) AS s{i}, sum({c}*{c}) AS q{i}" for i, c in enumerate(("value", "u")))
_MVX = ", ".join(f"s{i}/n AS m{i}, CASE WHEN n>1 THEN greatest(0.0::DOUBLE,(q{i}-s{i}*s{i}/n)/(n-1)) ELSE 0.0::DOUBLE END AS v{i}" for i in (0, 1))
_UNI = lambda keys: f"(('0x'||substr(md5('1|'||{keys}),1,13))::BIGINT::DOUBLE/{2**52}.0::DOUBLE)"


def _folds_sql(mode: str) -> str:
    test = {"cv": "ef.fold=f", "split": "ef.fold<>f", "bootstrap": "true"}[mode]
    train = {"cv": "fold<>f", "split": "fold=f", "bootstrap": "true"}[mode]
    copies = "(SELECT count(*) FROM pt WHERE ps<=pu*exp(1.0::DOUBLE))" if mode == "bootstrap" else "1"
    return f"""WITH e AS (SELECT event_id, (event_type='error')::INT AS k, value, (user_id%7)::DOUBLE AS u, (row_number() OVER (ORDER BY event_id)-1)//250 AS chunk, floor({_UNI('event_id')}*4)::INT AS f FROM events),
      pt AS (SELECT (SELECT sum(exp(-lgamma(j+1))) FROM (SELECT unnest(range(0,i+1)) AS j)) AS ps FROM (SELECT unnest(range(0,30)) AS i)),
      ef0 AS (SELECT e.*, fold, {_UNI("event_id||'|'||fold")} AS pu FROM e, (SELECT unnest(range(0,4)) AS fold)), ef AS (SELECT *, {copies} AS cp FROM ef0),
      tn AS (SELECT chunk, fold, k, value, u, unnest(range(0,cp)) AS c FROM ef WHERE {train}),
      m0 AS (SELECT t.chunk, tn.fold, k, count(*) AS n, {_STX} FROM (SELECT DISTINCT chunk FROM e) t JOIN tn ON tn.chunk<t.chunk GROUP BY ALL), m AS (SELECT *, {_MVX}, sum(n) OVER (PARTITION BY chunk, fold) AS tot FROM m0),
      s AS (SELECT ef.fold, ef.chunk, ef.event_id, max(ln(m.n/m.tot)+{_LDX('value', 0)}+{_LDX('u', 1)}) AS sc FROM ef LEFT JOIN m ON m.chunk=ef.chunk AND m.fold=ef.fold WHERE {test} GROUP BY ALL)
      SELECT fold::INT AS fold, chunk, count(*) AS n, count(sc) AS scored, {_R('avg(sc)', 'mean_score')} FROM s GROUP BY ALL"""


_HOLD = f"""WITH e AS (SELECT event_id, (event_type='error')::INT AS k, value, (user_id%7)::DOUBLE AS u, row_number() OVER (ORDER BY event_id) AS rn FROM events), r AS (SELECT *, (rn-201)//250 AS chunk FROM e WHERE rn>200),
      m0 AS (SELECT t.chunk+1 AS chunk, k, count(*) AS n, {_STX} FROM (SELECT DISTINCT chunk FROM r) t JOIN r ON r.chunk<=t.chunk GROUP BY ALL), m AS (SELECT *, {_MVX}, sum(n) OVER (PARTITION BY chunk) AS tot FROM m0),
      s AS (SELECT m.chunk, e.event_id, e.k AS y, m.k, ln(m.n/m.tot)+{_LDX('value', 0)}+{_LDX('u', 1)} AS sc FROM e JOIN m ON e.rn<=200), b AS (SELECT chunk, event_id, any_value(y) AS y, arg_max(k,(sc,-k)) AS p, max(sc) AS sc FROM s GROUP BY ALL)
      SELECT chunk, count(*) AS n, {_R('avg((p=y)::INT)', 'accuracy')}, {_R('avg(sc)', 'mean_score')} FROM b GROUP BY chunk"""
_MS = f"""{_PRED}, ms AS (SELECT disk, day, failure, unnest(['a','b','c']) AS member, unnest([vote_1, least(1.0::DOUBLE,coalesce(smart_199_raw,0.0::DOUBLE)/60.0::DOUBLE), 0.2::DOUBLE]) AS p FROM pr),
mw AS (SELECT member, avg(pow(CASE WHEN failure=1 THEN 1.0::DOUBLE-p ELSE p END,2)) AS mse, count(*) FILTER ((p>0.5)::INT<>failure) AS err FROM ms GROUP BY member)"""
_RT = "rt AS (SELECT o_custkey::INT AS \"user\", l_partkey::INT AS item, l_quantity AS rating FROM lineitem JOIN orders ON l_orderkey=o_orderkey)"


def _anom(bound: str) -> str:
    def p(f):
        g, v = f"abs({f}-m_{f})", f"d_{f}*d_{f}"
        body = {
            "cantelli": f"2.0::DOUBLE*{v}/nullif({v}+{g}*{g},0)",
            "chebyshev": f"CASE WHEN {g}>d_{f} THEN {v}/({g}*{g}) ELSE 1.0::DOUBLE END",
            "gauss": f"CASE WHEN {g}*{g}>4.0::DOUBLE*{v}/3.0::DOUBLE THEN 4.0::DOUBLE*{v}/(9.0::DOUBLE*{g}*{g}) ELSE 1.0::DOUBLE-{g}/sqrt(3.0::DOUBLE*{v}) END",
        }[bound]
        q = f"least(1.0::DOUBLE-1e-6::DOUBLE,greatest(1e-6::DOUBLE,coalesce({body},1.0::DOUBLE)))"
        return f"(ln({q})-ln(1.0::DOUBLE-{q}))"

    fs = ["l_quantity", "l_extendedprice", "l_discount"]
    st = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS d_{f}" for f in fs)
    return f"SELECT l_returnflag, '{bound}' AS bound, {_R('avg(sc)', 'mean_score')}, {_R('min(sc)', 'min_score')} FROM (SELECT l.l_returnflag, ({'+'.join(p(f) for f in fs)})/3.0::DOUBLE AS sc FROM lineitem l JOIN (SELECT l_returnflag, {st} FROM lineitem GROUP BY 1) s USING (l_returnflag)) GROUP BY 1"


QUERIES = {
    **{f"drift_{m}": _q_drift(m) for m in drift.METHODS},
    "drift_evaluation": q_drift_eval,
    "drift_segments": q_segments,
    "distance_outliers": q_outliers,
    "distance_range_join": q_range_join,
    "distance_self_join": q_neighbours,
    "micro_clusters_decayed": q_micro,
    "micro_clusters_horizon": q_horizon,
    "micro_clusters_horizons": q_horizons,
    "dbscan_micro_clusters": q_dbscan,
    "denstream_clusters": q_denstream,
    "dstream_density_grid": q_dstream,
    "kmeans_weighted": q_kmeans,
    "cluster_ssq": q_ssq,
    "cluster_membership_matrix": q_membership,
    "cluster_f1_purity": q_f1,
    "cluster_entropies": q_entropy,
    "cluster_pair_statistics": q_pairs,
    "cluster_separation": q_separation,
    "cluster_coverage": q_general,
    "cluster_silhouette": q_silhouette,
    "gaussian_estimator": q_gaussian,
    "quantile_summary": q_quantiles,
    "split_merit": q_split,
    "variance_reduction": q_variance,
    "majority_class": q_majority,
    "majority_label_set": q_labelset,
    "naive_bayes": q_bayes,
    "prequential_naive_bayes": q_preq_bayes(0),
    "prequential_delayed": q_preq_bayes(2),
    "prequential_cross_validation": q_preq_cv("cv"),
    "prequential_split_validation": q_preq_cv("split"),
    "prequential_bootstrap_validation": q_preq_cv("bootstrap"),
    "periodic_holdout": q_holdout,
    "active_windowed_accuracy": q_active_windowed,
    "multinomial_naive_bayes": q_multinomial,
    "ensemble_weights": q_weights,
    "weighted_vote": q_vote,
    "transfer_votes": q_transfer,
    "recommender_baseline": q_baseline,
    "recommender_factors": q_als,
    "recommender_running_rmse": q_running_rmse,
    "knn_recent_window": q_knn,
    "odds_ratio_anomaly": q_anomaly,
    "forest_per_day": q_forest,
}
ORACLE = {
    "drift_ddm": _DDM,
    "drift_ewma": _EWMA,
    "drift_page_hinkley": _sum_fold("(1-0.0001::DOUBLE)*s.t+(x-mean-0.005::DOUBLE)", 3.0),
    "drift_cusum": _CUSUM,
    "drift_eddm": _EDDM,
    "drift_hddm_a": _HDDMA,
    "drift_hddm_w": _HDDMW,
    "drift_segments": f"""WITH d AS MATERIALIZED ({_CUSUM}), s AS (SELECT d.model_no, d.event_id, coalesce(sum(change::INT) OVER (PARTITION BY d.model_no ORDER BY d.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS segment FROM d)
      SELECT s.model_no, segment, count(*) AS n, {_R("avg((event_type='error')::INT)", 'error_rate')} FROM s JOIN events USING (event_id) GROUP BY ALL""",
    "drift_evaluation": f"""WITH d0 AS MATERIALIZED ({_CUSUM}), d AS (SELECT *, event_id%1000=500 AS tc FROM d0), g AS (SELECT *, coalesce(sum(tc::INT) OVER (PARTITION BY model_no ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS seg FROM d),
      a AS (SELECT model_no, seg, count(*) AS r, count(*) FILTER (change) AS det, count(*) FILTER (tc) AS tr, min(event_id) AS f, min(event_id) FILTER (change) AS h, min(event_id) FILTER (warning) AS w FROM g GROUP BY ALL)
      SELECT model_no, sum(r)::BIGINT AS instances, sum(det)::BIGINT AS detected, count(*) FILTER (seg>0 AND w IS NOT NULL AND (h IS NULL OR w<=h)) AS warned_changes, sum(tr)::BIGINT AS true_changes, count(*) FILTER (seg>0 AND h IS NOT NULL) AS found_changes,
      round(coalesce(coalesce(sum(h-f+1) FILTER (seg>0 AND h IS NOT NULL),0)/nullif(sum(tr)::DOUBLE,0),0.0::DOUBLE),4)+0.0::DOUBLE AS mean_delay FROM a GROUP BY model_no""",
    "drift_gma": _sum_fold("0.99::DOUBLE*s.t+(1.0::DOUBLE-0.99::DOUBLE)*(x-mean)", 0.02),
    "distance_outliers": f"""WITH {_PT}, p AS (SELECT *, vec_id//200 AS tile FROM pt), c AS (SELECT a.tile, a.vec_id, count(*) AS n FROM p a JOIN p b ON a.tile=b.tile AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=0.05::DOUBLE*0.05::DOUBLE GROUP BY ALL)
      SELECT tile, vec_id, n<6 AS outlier FROM c""",
    "distance_range_join": f"""WITH {_PT}, d AS (SELECT a.vec_id, b.vec_id AS other_id, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS distance FROM pt a JOIN pt b ON a.class<2 AND b.class=2) SELECT vec_id, other_id, {_R('distance', 'distance')} FROM d WHERE distance<=0.03""",
    "micro_clusters_decayed": f"WITH {_PT}, w AS (SELECT *, pow(0.5::DOUBLE,vec_id//100) AS w FROM pt) SELECT floor(x/{SIDE}::DOUBLE)::BIGINT||','||floor(y/{SIDE}::DOUBLE)::BIGINT AS cell, count(*) AS n, {_R('sum(w)', 'weight')}, {_R('sum(w*x)', 'ls0')}, {_R('sum(w*y*y)', 'ss1')} FROM w GROUP BY 1",
    "micro_clusters_horizon": f"WITH {_PT} SELECT floor(x/{SIDE}::DOUBLE)::BIGINT||','||floor(y/{SIDE}::DOUBLE)::BIGINT AS cell, count(*) AS n, {_R('sum(x)', 'ls0')}, {_R('sum(y*y)', 'ss1')} FROM pt WHERE vec_id//100 BETWEEN 1 AND 3 GROUP BY 1",
    "distance_self_join": f"""WITH {_PT}, d AS (SELECT a.vec_id, b.vec_id AS other_id, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS distance FROM pt a JOIN pt b ON a.vec_id<b.vec_id) SELECT vec_id, other_id, {_R('distance', 'distance')} FROM d WHERE distance<=0.03""",
    "micro_clusters_horizons": f"WITH {_PT}, h AS (SELECT DISTINCT vec_id//100 AS horizon FROM pt) SELECT horizon, floor(x/{SIDE}::DOUBLE)::BIGINT||','||floor(y/{SIDE}::DOUBLE)::BIGINT AS cell, count(*) AS n, {_R('sum(x)', 'ls0')}, {_R('sum(y*y)', 'ss1')} FROM pt JOIN h ON vec_id//100 BETWEEN horizon-2 AND horizon GROUP BY ALL",
    "dbscan_micro_clusters": _dbscan_sql("1.0::DOUBLE", 0.0, MU),
    "denstream_clusters": _dbscan_sql("pow(0.8::DOUBLE,vec_id//100)", 0.5, MU / 2),
    "dstream_density_grid": f"""WITH RECURSIVE {_PT}, g AS (SELECT {_CELL}, sum(pow(0.9::DOUBLE,vec_id//100)) AS w FROM pt GROUP BY ALL), k AS (SELECT *, [i,j] AS c, CASE WHEN w>=6.0/(40*(1-0.9::DOUBLE)) THEN 'dense' WHEN w<=2.0/(40*(1-0.9::DOUBLE)) THEN 'sparse' ELSE 'transitional' END AS kind FROM g),
      t AS (SELECT a.c AS a, a.kind AS ka, b.c AS b, b.kind AS kb FROM k a JOIN k b ON abs(a.i-b.i)+abs(a.j-b.j)=1), cc AS (SELECT c AS node, c AS comp FROM k WHERE kind='dense' UNION SELECT t.b, cc.comp FROM cc JOIN t ON t.a=cc.node AND ka='dense' AND kb='dense'),
      cp AS (SELECT node, min(comp) AS comp FROM cc GROUP BY node), ed AS (SELECT a, min(comp) AS comp FROM t JOIN cp ON cp.node=t.b WHERE ka='transitional' GROUP BY a)
      SELECT k.i||','||k.j AS cell, {_R('w', 'weight')}, kind, coalesce(array_to_string(coalesce(cp.comp,ed.comp),','),'') AS cluster FROM k LEFT JOIN cp ON cp.node=k.c LEFT JOIN ed ON ed.a=k.c""",
    "cluster_ssq": f"WITH {_AS} SELECT {_R('sum(d2)', 'ssq')} FROM asg WHERE class<>-1",
    "cluster_membership_matrix": f"WITH {_AS} SELECT cluster, {', '.join(f'count(*) FILTER (class={c}) AS class_{c}' for c in range(10))} FROM asg GROUP BY cluster",
    "cluster_f1_purity": f"""WITH {_CT}, f AS (SELECT *, n/a AS p, n/b AS r, 2.0::DOUBLE*(n/a)*(n/b)/(n/a+n/b) AS f1 FROM ct), g AS (SELECT f1, p FROM f QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, class)=1)
      SELECT {_R('avg(f1)', 'f1_p')}, {_R('avg(p)', 'purity')}, (SELECT round(avg(m),4)+0.0::DOUBLE FROM (SELECT max(f1) AS m FROM f GROUP BY class)) AS f1_r FROM g""",
    "cluster_entropies": f"""WITH {_CT}, i AS (SELECT -sum(n/t*log10(n/a))/log10(11) AS fcx, -sum(n/t*log10(n/b)) AS gtx, sum(n/t*log10(n*t/(a*b))) AS mu FROM ct), hh AS (SELECT (SELECT -sum(a/t*log10(a/t))/log10(11) FROM (SELECT DISTINCT cluster, a, t FROM ct)) AS fc, (SELECT -sum(b/t*log10(b/t)) FROM (SELECT DISTINCT class, b, t FROM ct)) AS gt),
      z AS (SELECT *, 1-fcx/fc AS h, 1-gtx/gt AS c FROM i, hh)
      SELECT {_R('1-fcx', 'fc_cross_entropy')}, {_R('1-gtx', 'gt_cross_entropy')}, {_R('CASE WHEN h BETWEEN 0 AND 1 THEN h ELSE -1 END', 'homogeneity')}, {_R('c', 'completeness')}, {_R('CASE WHEN 2*h*c/(h+c)>1 OR h<0 THEN -1 ELSE 2*h*c/(h+c) END', 'v_measure')}, {_R('2*mu/(fc+gt)', 'var_information')} FROM z""",
    "cluster_pair_statistics": f"""WITH {_CT}, m AS (SELECT any_value(t)::DOUBLE AS t, sum(n*(n-1)/2.0::DOUBLE) AS m FROM ct), r AS (SELECT sum(a*(a-1)/2.0::DOUBLE) AS m2, sum(mx) AS fc FROM (SELECT a, max(n) AS mx FROM ct GROUP BY cluster, a)), c AS (SELECT sum(b*(b-1)/2.0::DOUBLE) AS m1, sum(mx) AS hc FROM (SELECT b, max(n) AS mx FROM ct GROUP BY class, b))
      SELECT {_R('(t*(t-1)/2.0-m1-m2+2.0*m)/(t*(t-1)/2.0)', 'rand')}, {_R('(fc+hc)/(2.0*t)', 'van_dongen')} FROM m, r, c""",
    "cluster_separation": f"""WITH {_AS}, g AS (SELECT avg(x) AS gx, avg(y) AS gy FROM asg), b AS (SELECT sum(n*((x-gx)*(x-gx)+(y-gy)*(y-gy))) AS v FROM (SELECT avg(x) AS x, avg(y) AS y, count(*) AS n FROM asg GROUP BY cluster), g), t AS (SELECT sum(n*((x-gx)*(x-gx)+(y-gy)*(y-gy))) AS v FROM (SELECT avg(x) AS x, avg(y) AS y, count(*) AS n FROM asg GROUP BY class), g)
      SELECT {_R('b.v', 'bss')}, {_R('t.v', 'bss_gt')}, {_R('b.v/t.v', 'bss_ratio')} FROM b, t""",
    "cluster_coverage": f"""WITH {_AS}, k AS (SELECT vec_id, p.class, count(*) FILTER (sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy))<=0.1) AS k FROM pt p, ce GROUP BY ALL)
      SELECT {_R('count(*) FILTER (k>0 AND class<>-1)/(count(*) FILTER (k>0))::DOUBLE', 'gprecision')}, {_R('count(*) FILTER (k>0 AND class<>-1)/(count(*) FILTER (class<>-1))::DOUBLE', 'grecall')}, {_R('count(*) FILTER (k>1)/count(*)::DOUBLE', 'redundancy')} FROM k""",
    "cluster_silhouette": f"""WITH {_AS}, d AS (SELECT a.vec_id, a.cluster AS own, b.cluster AS c, sum((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS s, count(*) AS n FROM asg a JOIN asg b ON true GROUP BY ALL),
      e AS (SELECT vec_id, max(CASE WHEN c=own AND n>1 THEN s/(n-1) END) AS a, min(CASE WHEN c<>own THEN s/n END) AS b FROM d GROUP BY vec_id) SELECT {_R('(avg(CASE WHEN a IS NULL THEN 0 ELSE (b-a)/greatest(a,b) END)+1)/2', 'silhouette')} FROM e""",
    "gaussian_estimator": f"WITH g AS (SELECT l_returnflag, sum(l_quantity) AS w, sum(l_quantity*l_discount) AS s, sum(l_quantity*l_discount*l_discount) AS q FROM lineitem GROUP BY 1) SELECT l_returnflag, {_R('w', 'weight')}, {_R('s/w', 'mean')}, {_R('(q-s*s/w)/(w-1)', 'variance')} FROM g",
    "quantile_summary": "SELECT l_returnflag, quantile_disc(l_quantity,0.25) AS q25, quantile_disc(l_quantity,0.5) AS q50, quantile_disc(l_quantity,0.75) AS q75 FROM lineitem GROUP BY 1",
    "split_merit": f"""WITH c AS (SELECT o_orderpriority, o_totalprice>250000 AS br, o_orderstatus AS k, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT *, sum(n) OVER (PARTITION BY o_orderpriority, br) AS b, sum(n) OVER (PARTITION BY o_orderpriority) AS t, sum(n) OVER (PARTITION BY o_orderpriority, k) AS kt FROM c),
      i AS (SELECT o_orderpriority, -sum(n/t*log2(n/b)) AS h, 1-sum(n*n/(b*t)) AS g FROM b GROUP BY 1), p AS (SELECT o_orderpriority, -sum(kt/t*log2(kt/t)) AS h, 1-sum((kt/t)*(kt/t)) AS g FROM (SELECT DISTINCT o_orderpriority, k, kt, t FROM b) GROUP BY 1)
      SELECT o_orderpriority, {_R('p.h-i.h', 'info_gain')}, {_R('p.g-i.g', 'gini_gain')} FROM p JOIN i USING (o_orderpriority)""",
    "variance_reduction": f"""WITH b AS (SELECT l_returnflag, l_quantity>25 AS br, count(*) AS n, var_pop(l_extendedprice/1000) AS v FROM lineitem GROUP BY ALL), w AS (SELECT l_returnflag, count(*) AS n, var_pop(l_extendedprice/1000) AS v FROM lineitem GROUP BY 1)
      SELECT w.l_returnflag, {_R('any_value(w.v)-sum(b.n*b.v)/any_value(w.n)', 'variance_reduction')}, {_R('sqrt(any_value(w.v))-sum(b.n*sqrt(b.v))/any_value(w.n)', 'sd_reduction')} FROM w JOIN b USING (l_returnflag) GROUP BY 1""",
    "majority_class": "WITH c AS (SELECT o_custkey, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, arg_min(s,(-n,s)) AS majority, sum(n)::BIGINT AS n FROM c GROUP BY 1",
    "majority_label_set": "WITH c AS (SELECT lang, quality||''||toxic AS s, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL) SELECT lang, arg_min(s,(-n,s)) AS majority, sum(n)::BIGINT AS n FROM c GROUP BY 1",
    "naive_bayes": f"""WITH {_NBS}, t AS (SELECT sum(r) AS t FROM nb), b AS (SELECT l.*, row_number() OVER () AS id FROM lineitem l), s AS (SELECT id, any_value(l_returnflag) AS l_returnflag, max(ln(r/t)+{_LD('l_quantity', 'm0', 'v0')}+{_LD('l_discount', 'm1', 'v1')}) AS sc FROM b, nb, t GROUP BY id)
      SELECT l_returnflag, count(*) AS n, {_R('avg(sc)', 'mean_score')} FROM s GROUP BY 1""",
    "prequential_naive_bayes": _preq(0),
    "prequential_delayed": _preq(2),
    "prequential_cross_validation": _folds_sql("cv"),
    "prequential_split_validation": _folds_sql("split"),
    "prequential_bootstrap_validation": _folds_sql("bootstrap"),
    "periodic_holdout": _HOLD,
    "active_windowed_accuracy": "SELECT row_number() OVER (ORDER BY event_id) AS n, round(avg(((event_type='error')=(value>30))::INT) OVER w,4)+0.0::DOUBLE AS accuracy, round(avg((value<5)::INT) OVER w,4)+0.0::DOUBLE AS label_cost FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 299 PRECEDING AND CURRENT ROW)",
    "multinomial_naive_bayes": """WITH w AS (SELECT doc_id, lang, unnest(regexp_split_to_array(lower(text),'[^\\p{L}\\p{Nd}]+')) AS word FROM documents), b AS (SELECT doc_id, lang, word, count(*) AS c FROM w WHERE word<>'' GROUP BY ALL),
      t AS (SELECT word, lang AS k, sum(c) AS c FROM b GROUP BY ALL), n AS (SELECT k, sum(c) AS t FROM t GROUP BY k), p AS (SELECT lang AS k, count(*) AS p FROM documents GROUP BY 1), v AS (SELECT count(DISTINCT word) AS v FROM t),
      s AS (SELECT b.doc_id, b.lang, n.k, sum(b.c*ln((coalesce(t.c,0)+1.0::DOUBLE)/(n.t+v.v)))+any_value(ln(p.p)) AS g FROM b CROSS JOIN n CROSS JOIN v JOIN p ON p.k=n.k LEFT JOIN t ON t.word=b.word AND t.k=n.k GROUP BY ALL)
      SELECT lang, prediction, count(*) AS n FROM (SELECT doc_id, lang, arg_max(k,(g,k)) AS prediction FROM s GROUP BY ALL) GROUP BY ALL""",
    "ensemble_weights": f"WITH {_MS} SELECT member, 'accuracy_weighted' AS rule, {_R('greatest(0.25::DOUBLE-mse,0.0::DOUBLE)', 'weight')} FROM mw UNION ALL SELECT member, 'accuracy_updated', {_R('1.0::DOUBLE/(0.25::DOUBLE+mse+1e-9::DOUBLE)', 'weight')} FROM mw UNION ALL SELECT member, 'majority', {_R('pow(0.999::DOUBLE,err)', 'weight')} FROM mw",
    "weighted_vote": f"""WITH {_MS}, v AS (SELECT disk, day, sum((1.0::DOUBLE-p)/((1.0::DOUBLE-p)+p)/(0.25::DOUBLE+mse+1e-9::DOUBLE)) AS m0, sum(p/((1.0::DOUBLE-p)+p)/(0.25::DOUBLE+mse+1e-9::DOUBLE)) AS m1 FROM ms JOIN mw USING (member) GROUP BY ALL)
      SELECT disk, day, CASE WHEN round(m1,9)>round(m0,9) THEN 1 ELSE 0 END::BIGINT AS prediction, {_R('greatest(m0,m1)', 'mass')} FROM v""",
    "transfer_votes": f"""WITH {_PRED}, e AS (SELECT *, pow(0.99::DOUBLE,coalesce(sum(((vote_1>1.0::DOUBLE-vote_1)::INT<>failure)::INT) OVER (ORDER BY day, disk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)) AS th FROM pr)
      SELECT disk, day, {_R('th', 'theta')}, {_R('th*(1.0::DOUBLE-vote_1)+0.5::DOUBLE', 'vote_0')}, {_R('th*vote_1+least(1.0::DOUBLE,coalesce(smart_199_raw,0.0::DOUBLE)/60.0::DOUBLE)', 'vote_1')} FROM e""",
    "recommender_baseline": f"""WITH {_RT}, p AS (SELECT "user", rating, least(50.0::DOUBLE,greatest(1.0::DOUBLE,avg(rating) OVER (PARTITION BY "user")-avg(rating) OVER ()+avg(rating) OVER (PARTITION BY item))) AS p FROM rt) SELECT "user", count(*) AS n, {_R('avg(p)', 'mean_prediction')}, {_R('avg(abs(rating-p))', 'mae')} FROM p GROUP BY 1""",
    "recommender_running_rmse": f"SELECT event_id, {_R('sqrt(avg((value-20)*(value-20)) OVER (ORDER BY event_id))', 'rmse')} FROM events",
    "knn_recent_window": """WITH v AS (SELECT vec_id, label, list_transform(embedding[1:8], lambda e: e::DOUBLE) AS v, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings), d AS (SELECT a.vec_id, b.label AS l, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.v,b.v), lambda z: (z[1]-z[2])*(z[1]-z[2]))), b.n) AS r FROM v a JOIN v b ON b.n BETWEEN a.n-100 AND a.n-1),
      c AS (SELECT vec_id, l, count(*) AS c FROM d WHERE r<=5 GROUP BY ALL), p AS (SELECT vec_id, arg_min(l,(-c,l)) AS prediction FROM c GROUP BY vec_id) SELECT v.vec_id, v.label, prediction FROM v LEFT JOIN p USING (vec_id)""",
    "odds_ratio_anomaly": " UNION ALL ".join(_anom(b) for b in ("cantelli", "chebyshev", "gauss")),
}
