"""Queries over delayed evaluation, evaluators, fusion grids and guards."""
from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from spindlewatch.functions.scalars import r4
from spindlewatch.operators import delayed, guards, metrics
from spindlewatch.operators.windows import stage
from spindlewatch.plans.answers_plan import CACHE_SQL, cache
from spindlewatch.plans.bridge import daily, daily_sql, day_range, table

# the SQL twins state the evaluation days of the given tables; the queries take theirs from the table (eval_days)
START, END, WAIT, LABEL = "2024-01-11", "2024-01-31", 10, 5


def predictions(spark, sf):
    """Votes of a stand-in model: the error level of the day (D19 before judging)."""
    df = daily(spark, sf).select("disk", "disk_no", "day", "model", "failure", "smart_5_raw", "smart_199_raw")
    return stage(df, {"vote_1": "least(1.0D, coalesce(smart_5_raw, 0.0D) / 60.0D)"}).withColumn("vote_0", 1.0 - F.col("vote_1"))


def eval_days(spark, sf):
    """First and last evaluation: the queues fill for WAIT days without one, and the last day is judged on the day after it."""
    first, last = day_range(spark, sf)
    return (None, None) if first is None else (first + timedelta(days=WAIT), last + timedelta(days=1))


def trace(spark, sf, threshold=0.5, exact=False):
    return delayed.delay_trace(predictions(spark, sf), WAIT, *eval_days(spark, sf), threshold, exact)


def _round(df, names):
    return df.withColumns({n: r4(F.col(n)) for n in names})


def _big(df, names):
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def _q_trace(threshold, exact):
    def q(spark, sf):
        df = trace(spark, sf, threshold, exact).drop("model")
        return _round(_big(df, ["true_class", "pred_class", "queue_size", "credit"]), ["vote_0", "vote_1", "threshold"])

    return q


def q_trace_regression(spark, sf):
    preds = predictions(spark, sf).withColumn("prediction", F.col("vote_1"))
    df = delayed.delay_trace_regression(preds, WAIT, LABEL, *eval_days(spark, sf))
    return _round(_big(df.drop("model"), ["queue_size"]), ["truth", "prediction"])


def q_daily_simple(spark, sf):
    df = metrics.simple_metrics(metrics.confusion(trace(spark, sf), ["eval_day"]))
    return _round(df, ["recall", "precision", "acc", "fpr", "f1"])


FULL = ["accuracy", "false_alarm_rate", "precision_c0", "precision_c1", "recall_c0", "recall_c1", "kappa", "precision", "recall", "f1_c0", "f1_c1", "f1"]


def daily_counts(spark, sf, by=("eval_day",), threshold=0.5):
    credit = F.sum(F.col("credit").cast("bigint")).alias("credit")
    return metrics.confusion(trace(spark, sf, threshold), list(by), extra=[credit])


def q_local(spark, sf):
    df = metrics.full_metrics(daily_counts(spark, sf))
    return _round(df.withColumns({"days_before": F.try_divide(F.col("credit"), F.col("tp")), "reason": metrics.undefined_reason()}), [*FULL, "days_before"])


def q_global(spark, sf):
    cum = metrics.cumulative(daily_counts(spark, sf), columns=[*metrics.COUNTS, "credit"])
    return _round(metrics.full_metrics(cum).drop("credit"), FULL)


def q_run_summary(spark, sf):
    df = metrics.full_metrics(daily_counts(spark, sf, ("model", "eval_day")))
    df = df.withColumn("days_before", F.try_divide(F.col("credit"), F.col("tp")))
    return _round(metrics.run_summary(df, ["model"]), ["days_before", "fp", "fpr", "precision", "recall", "f1"])


def q_mean_daily(spark, sf):
    df = metrics.simple_metrics(metrics.confusion(trace(spark, sf), ["model", "eval_day"]))
    return _round(metrics.mean_metrics(df, ["model"]), ["recall", "precision", "f1", "acc", "fpr"])


def events_scored(spark, sf):
    """One scored row per event: is it an error, and how large is its value. The order is the event number."""
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    return ev.select(
        F.col("event_id").alias("seq"), (F.col("event_type") == "error").cast("int").alias("true_class"),
        (F.col("value") > 30).cast("int").alias("pred_class"), F.col("value").alias("score"),
    )


def q_kappas(spark, sf):
    out = metrics.ordered_kappas(events_scored(spark, sf), "seq")
    return out.select("instances", *[r4(F.col(c)).alias(c) for c in ("p0", "kappa_temporal", "kappa_m")])



def _hit():
    return (F.col("true_class") == F.col("pred_class")).cast("double")


def q_sliding(spark, sf):
    df = metrics.sliding(events_scored(spark, sf), "seq", {"accuracy": _hit(), "positives": F.col("true_class").cast("double")}, 500)
    return df.select("n", r4(F.col("accuracy")).alias("accuracy"), r4(F.col("positives")).alias("positives"))


def q_curve(spark, sf):
    df = metrics.learning_curve(events_scored(spark, sf), "seq", {"accuracy": _hit()}, 250)
    return df.select("checkpoint", r4(F.col("accuracy")).alias("accuracy"))


def q_fading(spark, sf):
    return _round(metrics.fading(events_scored(spark, sf), "seq", {"accuracy": _hit()}, 0.999, 100), ["accuracy"])


def q_ewma(spark, sf):
    return _round(metrics.ewma(events_scored(spark, sf), "seq", {"accuracy": _hit()}, 0.01, 100), ["accuracy"])


def quality_scores(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    doc = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return lab.join(doc, "doc_id").withColumn("score", F.col("n_chars") / (F.col("n_chars") + 1000.0))


_AUC = ["auc", "scored_auc", "class_ratio"]


def q_auc(spark, sf):
    return _round(metrics.auc(quality_scores(spark, sf), "score", "quality"), _AUC)


def q_auc_lang(spark, sf):
    return _round(metrics.auc(quality_scores(spark, sf), "score", "quality", ["lang"]), _AUC)


def q_auc_tiles(spark, sf):
    df = events_scored(spark, sf).withColumn("tile", F.floor(F.col("seq") / 1000).cast("bigint"))
    return _round(metrics.auc(df, "score", "true_class", ["tile"]), _AUC)


def q_gmean(spark, sf):
    df = metrics.imbalance_metrics(metrics.confusion(trace(spark, sf), ["model"]))
    return _round(df, ["gmean", "recall"])


def q_regression(spark, sf):
    df = predictions(spark, sf)
    df = df.select((F.unix_date("day").cast("bigint") * 1000000 + F.col("disk_no")).alias("seq"), "vote_1", "failure", "smart_199_raw")
    df = df.withColumns({"truth": F.col("failure") * 0.5, "seq": F.col("seq")})
    out = metrics.regression(df, "truth", "vote_1", "seq", LABEL)
    return _round(out, ["mae", "rmse", "relative_mae", "relative_rmse", "mae_failures", "mse_failures", "error_days"])


def q_sliding_regression(spark, sf):
    df = predictions(spark, sf).select((F.unix_date("day").cast("bigint") * 1000000 + F.col("disk_no")).alias("seq"), "vote_1", "failure")
    # errors in whole basis points, so that sums are exact in any order
    err = F.floor(F.abs(F.col("failure") - F.col("vote_1")) * 10000.0 + F.lit(0.5))
    out = metrics.sliding(df, "seq", {"mae": err, "mse": err * err}, 200)
    return out.select("n", r4(F.col("mae")).alias("mae_bp"), r4(F.sqrt("mse")).alias("rmse_bp"))


def q_multilabel(spark, sf):
    df = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    df = stage(df, {"truth": "array(quality, toxic)", "pred": "array(if(n_chars > 400, 1, 0), if(n_chars % 7 = 0, 1, 0))"})
    return _round(metrics.multi_label(df, by=["lang"]), ["exact_match", "accuracy", "hamming", "precision", "recall", "f_measure"])


def q_multitarget(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax")
    li = stage(li, {"t1": "l_quantity", "p1": "25.0D", "t2": "l_discount * 100.0D", "p2": "l_tax * 100.0D"})
    a = metrics.multi_target(li, ["t1", "t2"], ["p1", "p2"], ["l_returnflag"])
    b = metrics.multi_target(li, ["t1", "t2"], ["p1", "p2"], ["l_returnflag"], relative=True).select("l_returnflag", F.col("rmse").alias("relative_rmse"))
    return _round(a.join(b, "l_returnflag"), ["mae", "rmse", "relative_rmse"])


def _two_targets(spark, sf):
    """Two targets per event in event order: its value in cents and its user."""
    ev = table(spark, sf, "events").select("event_id", "event_type", "value", "user_id")
    return stage(ev, {"t1": "floor(value * 100.0D + 0.5D)", "p1": "2000.0D", "t2": "cast(user_id % 50 AS double)", "p2": "25.0D"})


def q_multitarget_relative(spark, sf):
    """Errors relative to the running mean; ``relative_rmse`` of ``multi_target_metrics`` divides by the spread around the final mean."""
    out = metrics.multi_target_relative(_two_targets(spark, sf), ["t1", "t2"], ["p1", "p2"], "event_id", ["event_type"])
    return _round(out, ["relative_mae", "relative_rmse"])


def q_multitarget_windowed(spark, sf):
    out = metrics.multi_target_windowed(_two_targets(spark, sf), ["t1", "t2"], ["p1", "p2"], "event_id", 1000)
    return _round(out.select("event_id", "mae", "rmse", "relative_mae", "relative_rmse"), ["mae", "rmse", "relative_mae", "relative_rmse"])


def q_folds(spark, sf):
    ev = events_scored(spark, sf).withColumn("fold", F.col("seq") % 5).withColumn("tile", F.floor(F.col("seq") / 1000).cast("bigint"))
    curve = ev.groupBy("fold", "tile").agg(F.avg(_hit()).alias("accuracy"))
    return _round(metrics.fold_summary(curve, ["tile"], ["accuracy"]), ["accuracy_mean", "accuracy_std"])


def fused(spark, sf):
    tr = trace(spark, sf).select("eval_day", "model", "disk", F.col("source_day").alias("day"), "true_class", "pred_class")
    return guards.fuse_trace(tr, cache(spark, sf), ["disk", "day"])


GRID = {"q": [0.05, 0.15, 0.25], "risk": [0.1, 0.2], "map_thr": [0.3, 0.9], "rule": [0.2, 0.45], "noise_max": [0.6, 0.2]}


def q_fusion(spark, sf):
    out = guards.fusion_grid(fused(spark, sf), GRID)
    return _round(out, ["recall", "precision", "f1", "acc", "fpr", "d_recall", "d_acc"])


def model_days(spark, sf, threshold):
    return metrics.simple_metrics(metrics.confusion(trace(spark, sf, threshold), ["model", "eval_day"]))


def _percent(df):
    return df.withColumns({c: F.col(c) * 100.0 for c in ("recall", "precision", "acc", "f1", "fpr")})


def status(spark, sf):
    return guards.model_status(_percent(model_days(spark, sf, 0.4)), _percent(model_days(spark, sf, 0.6)))


_ST = ["llm_recall_mean", "nollm_recall_mean", "llm_acc_mean", "nollm_acc_mean", "delta_recall", "delta_acc"]


def q_status(spark, sf):
    return _round(status(spark, sf), _ST)


def q_lock(spark, sf):
    return _round(guards.baseline_lock(status(spark, sf)).select("model", "acc_guard_floor", "recall_target_floor"), ["acc_guard_floor", "recall_target_floor"])


def q_compare(spark, sf):
    return _round(guards.comparison_summary(status(spark, sf)), ["mean_delta_recall"])


def q_reach(spark, sf):
    day = lambda t: _percent(metrics.simple_metrics(metrics.confusion(trace(spark, sf, t), ["eval_day"])))
    out = guards.reachability(day(0.4), day(0.6), ["recall", "acc"])
    return _round(out, ["run_recall", "run_acc", "zero_recall", "zero_acc", "max_abs_diff"])


THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7]


def threshold_runs(spark, sf):
    """Recall and accuracy per model and vote threshold: judged once, counted per threshold."""
    tr = trace(spark, sf)
    grid = tr.selectExpr("*", f"explode(array({', '.join(f'{t}D' for t in THRESHOLDS)})) AS h").withColumn("pred_class", (F.col("vote_1") >= F.col("h")).cast("int"))
    return guards.threshold_grid(metrics.confusion(grid, ["model", "h", "eval_day"]), ["model", "h"])


def q_threshold_grid(spark, sf):
    return _round(threshold_runs(spark, sf), ["recall", "acc"])


def q_pick(spark, sf):
    return _round(guards.pick_feasible(threshold_runs(spark, sf), ["model"], F.lit(20.0), F.lit(90.0), ["h"]), ["recall", "acc"])


def grid_rows(spark, sf):
    base = _percent(model_days(spark, sf, 0.6)).groupBy("model").agg(F.avg("recall").alias("recall"), F.avg("acc").alias("acc"))
    grid = threshold_runs(spark, sf).withColumns({"q_gate": F.col("h"), "kept": F.when(F.col("h") > 0.65, 0).otherwise(1)})
    return guards.grid_summary(grid, base, ["model"])


def q_grid_summary(spark, sf):
    return _round(_big(grid_rows(spark, sf), ["kept"]), ["recall", "acc", "base_recall", "base_acc", "delta_recall", "delta_acc"])


def q_best(spark, sf):
    out = guards.suggest_policy(guards.best_combination(grid_rows(spark, sf).where("NOT degenerate"), ["model"], ["h"]))
    return _round(out.select("model", "h", "enabled", "fallback", "min_q_score", "delta_recall", "delta_acc"), ["delta_recall", "delta_acc"])


def q_top_two(spark, sf):
    out = guards.top_two(grid_rows(spark, sf), ["model"], ["h"]).select("model", "h", "rank", "risk", "recall", "acc")
    return _round(_big(out, ["rank"]), ["recall", "acc"])


def q_seeds(spark, sf):
    """Seeds are five disjoint shares of the disks."""
    tr = trace(spark, sf).withColumn("seed", F.expr("cast(substring(disk, 6) AS bigint) % 5"))
    runs = _percent(metrics.simple_metrics(metrics.confusion(tr, ["model", "seed"])))
    return _round(guards.seed_stability(runs, ["model"], 20.0, 80.0), ["recall_mean", "acc_mean"])


# ---- SQL twins ---------------------------------------------------------------------------------------------------------------
_R = lambda e, n: f"round({e},4)+0.0::DOUBLE AS {n}"
_PRED = f"""{daily_sql()},
pr AS (SELECT *, least(1.0::DOUBLE, coalesce(smart_5_raw,0.0::DOUBLE)/60.0::DOUBLE) AS vote_1, row_number() OVER (PARTITION BY disk ORDER BY day) AS i FROM daily),
ff AS (SELECT disk, day AS f, i AS fi FROM pr WHERE failure=1)"""


def _trace_sql(threshold=0.5, exact=False) -> str:
    pred = "CASE WHEN vote_1>1.0::DOUBLE-vote_1 THEN 1 ELSE 0 END" if threshold == 0.5 else f"CASE WHEN vote_1>={threshold}::DOUBLE THEN 1 ELSE 0 END"
    if exact:
        leave = "(i+max(greatest(day+1,DATE '%s')-DATE '1970-01-01'-i) OVER (PARTITION BY disk ORDER BY day))::INT+DATE '1970-01-01'" % START
    else:
        leave = f"day+{WAIT}"
    return f"""{_PRED},
qa AS (SELECT *, {leave} AS lv, {pred} AS pred_class, 1.0::DOUBLE-vote_1 AS vote_0 FROM pr),
ev AS (SELECT unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY))::DATE AS e),
qb AS (SELECT e, qa.*, CASE WHEN EXISTS(SELECT 1 FROM ff WHERE ff.disk=qa.disk AND f>=qa.day AND f<e) THEN 1 ELSE 0 END AS true_class FROM qa JOIN ev ON e>day AND e<=lv),
qc AS (SELECT *, row_number() OVER (PARTITION BY disk, e ORDER BY day) AS k, count(*) OVER (PARTITION BY disk, e) AS qs FROM qb),
qd AS (SELECT *, min(CASE WHEN true_class=pred_class THEN k END) OVER (PARTITION BY disk, e) AS c, min(CASE WHEN true_class=1 THEN k END) OVER (PARTITION BY disk, e) AS a FROM qc),
qe AS (SELECT *, min(CASE WHEN k>a AND true_class=0 THEN k END) OVER (PARTITION BY disk, e) AS b FROM qd),
qf AS (SELECT *, CASE WHEN b IS NOT NULL AND (c IS NULL OR c>=b) THEN b-1 WHEN c IS NOT NULL THEN c ELSE qs END AS pick FROM qe),
tr AS (SELECT e-1 AS eval_day, day AS source_day, disk, model, true_class, pred_class, vote_0, vote_1, qs AS queue_size, {threshold}::DOUBLE AS threshold,
  CASE WHEN c IS NOT NULL AND (b IS NULL OR c<b) AND true_class=1 THEN qs-pick+1 ELSE 0 END AS credit FROM qf WHERE k=pick)"""


_CM = "count(*) FILTER (true_class=1 AND pred_class=1) AS tp, count(*) FILTER (true_class=0 AND pred_class=1) AS fp, count(*) FILTER (true_class=0 AND pred_class=0) AS tn, count(*) FILTER (true_class=1 AND pred_class=0) AS fn"
_d = lambda a, b: f"CASE WHEN ({b})=0 THEN 0.0::DOUBLE ELSE ({a})/({b})::DOUBLE END"
_n = lambda a, b: f"({a})/nullif(({b})::DOUBLE,0)"


def _simple(src: str, name: str) -> str:
    return f"""{name}0 AS (SELECT *, {_d('tp', 'tp+fn')} AS recall, {_d('tp', 'tp+fp')} AS precision, {_d('tp+tn', 'tp+fp+tn+fn')} AS acc, {_d('fp', 'fp+tn')} AS fpr FROM {src}),
{name} AS (SELECT *, {_d('2.0::DOUBLE*precision*recall', 'precision+recall')} AS f1 FROM {name}0)"""


def _full(src: str, name: str) -> str:
    return f"""{name}0 AS (SELECT *, tp+fp+tn+fn AS instances, {_n('100.0::DOUBLE*(tp+tn)', 'tp+fp+tn+fn')} AS accuracy, {_n('100.0::DOUBLE*fp', 'fp+tn')} AS false_alarm_rate, {_n('100.0::DOUBLE*tn', 'tn+fn')} AS precision_c0,
  {_n('100.0::DOUBLE*tp', 'tp+fp')} AS precision_c1, {_n('100.0::DOUBLE*tn', 'tn+fp')} AS recall_c0, {_n('100.0::DOUBLE*tp', 'tp+fn')} AS recall_c1,
  ((tp+fp)::DOUBLE*(tp+fn)+(tn+fn)::DOUBLE*(tn+fp))/((tp+fp+tn+fn)::DOUBLE*(tp+fp+tn+fn)) AS pc FROM {src}),
{name}1 AS (SELECT *, (accuracy-100.0::DOUBLE*pc)/nullif(1.0::DOUBLE-pc,0) AS kappa, (precision_c0+precision_c1)/2.0::DOUBLE AS precision, (recall_c0+recall_c1)/2.0::DOUBLE AS recall,
  2.0::DOUBLE*precision_c0*recall_c0/nullif(precision_c0+recall_c0,0) AS f1_c0, 2.0::DOUBLE*precision_c1*recall_c1/nullif(precision_c1+recall_c1,0) AS f1_c1 FROM {name}0),
{name} AS (SELECT *, 2.0::DOUBLE*precision*recall/nullif(precision+recall,0) AS f1 FROM {name}1)"""


_EV = "es AS (SELECT event_id AS seq, CASE WHEN event_type='error' THEN 1 ELSE 0 END AS true_class, CASE WHEN value>30 THEN 1 ELSE 0 END AS pred_class, value AS score, CASE WHEN (event_type='error')=(value>30) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit, row_number() OVER (ORDER BY event_id) AS n FROM events)"
_SC = "qs AS (SELECT l.quality AS t, d.lang, d.n_chars/(d.n_chars+1000.0::DOUBLE) AS s FROM labels l JOIN documents d USING (doc_id))"


def _auc_sql(src: str, by: str = "") -> str:
    grp, on = (f"{by},", f"AND b.{by}=a.{by}") if by else ("", "")
    tail = f"GROUP BY {by}" if by else ""
    same = f"USING ({by})" if by else "ON true"
    return f"""ag AS (SELECT {grp} s, count(*) FILTER (t=1) AS p, count(*) FILTER (t=0) AS g FROM {src} GROUP BY ALL),
ab AS (SELECT {grp} s, p, g, coalesce(sum(p) OVER w,0) AS pa, coalesce(sum(p*s) OVER w,0) AS psa, coalesce(sum(g*s) OVER w,0) AS nsa FROM ag WINDOW w AS ({'PARTITION BY ' + by if by else ''} ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ac AS (SELECT {grp} sum(p)::BIGINT AS positives, sum(g)::BIGINT AS negatives, sum(g*(pa+p/2.0::DOUBLE)) AS a, sum(g*(psa+p*s/2.0::DOUBLE)) AS plus, sum(p*nsa) AS ov, sum(g*s) AS r FROM ab {tail})
SELECT {grp} positives, negatives, round(CASE WHEN positives=0 OR negatives=0 THEN 1.0::DOUBLE ELSE a/(positives::DOUBLE*negatives) END,4)+0.0::DOUBLE AS auc,
 round(CASE WHEN positives=0 OR negatives=0 THEN 1.0::DOUBLE ELSE (plus-(positives*r-ov))/(positives::DOUBLE*negatives) END,4)+0.0::DOUBLE AS scored_auc, round(positives/nullif(negatives::DOUBLE,0),4)+0.0::DOUBLE AS class_ratio FROM ac"""


def _md(t: float, name: str) -> str:
    """Daily metrics per model at a threshold (percent) as CTE ``name``."""
    inner = _trace_sql(t)
    return f"{name} AS (WITH {inner}, cm AS (SELECT model, eval_day, {_CM} FROM tr GROUP BY ALL), {_simple('cm', 'sm')} SELECT model, eval_day, recall*100.0::DOUBLE AS recall, acc*100.0::DOUBLE AS acc FROM sm)"


_STATUS = f"""{_md(0.4, 'ra')}, {_md(0.6, 'rb')},
sa AS (SELECT model, avg(recall) AS llm_recall_mean, avg(acc) AS llm_acc_mean FROM ra GROUP BY model), sb AS (SELECT model, avg(recall) AS nollm_recall_mean, avg(acc) AS nollm_acc_mean FROM rb GROUP BY model),
ss AS (SELECT *, llm_recall_mean-nollm_recall_mean AS delta_recall, llm_acc_mean-nollm_acc_mean AS delta_acc, CASE WHEN llm_recall_mean>=nollm_recall_mean AND llm_acc_mean>=nollm_acc_mean-1.0 THEN 'PASS' ELSE 'FALLBACK' END AS status,
  CASE WHEN llm_recall_mean>=nollm_recall_mean AND llm_acc_mean>=nollm_acc_mean-1.0 THEN 'llm_enabled' ELSE 'nollm' END AS action FROM sa JOIN sb USING (model))"""
_TG = f"""{_trace_sql(0.5)}, tg AS (SELECT model, h, eval_day, true_class, CASE WHEN vote_1>=h THEN 1 ELSE 0 END AS pred_class FROM tr, (SELECT unnest([{','.join(f'{t}::DOUBLE' for t in THRESHOLDS)}]) AS h)),
tc AS (SELECT model, h, eval_day, {_CM} FROM tg GROUP BY ALL), {_simple('tc', 'ts')}, th AS (SELECT model, h, avg(recall)*100.0::DOUBLE AS recall, avg(acc)*100.0::DOUBLE AS acc FROM ts GROUP BY model, h)"""
_GS = f"""{_TG}, {_md(0.6, 'rb')}, bb AS (SELECT model, avg(recall) AS base_recall, avg(acc) AS base_acc FROM rb GROUP BY model),
gs AS (SELECT *, h AS q_gate, CASE WHEN h>0.65 THEN 0 ELSE 1 END AS kept, recall-base_recall AS delta_recall, acc-base_acc AS delta_acc, acc>=base_acc-1.0 AS pass_acc_guard, h>0.65 AS degenerate FROM th JOIN bb USING (model))"""
_GRID_SQL = ", ".join(f"(SELECT unnest([{','.join(f'{v}::DOUBLE' for v in vs)}]) AS {k})" for k, vs in GRID.items())
_FUSE = f"""{CACHE_SQL}, ff AS (SELECT disk, day AS f, 0 AS fi FROM daily WHERE failure=1), trc AS (WITH {_trace_sql(0.5)} SELECT * FROM tr),
fu AS (SELECT t.eval_day, t.true_class, t.pred_class, coalesce(c.q,0.0::DOUBLE) AS sq, coalesce(c.rk,0.0::DOUBLE) AS srk, coalesce(c.cf,0.0::DOUBLE) AS scf, coalesce(c.ratio,0.0::DOUBLE) AS srt, coalesce(c.noise,0.0::DOUBLE) AS snz, coalesce(c.ts,0.0::DOUBLE) AS sts, coalesce(c.rc,'unknown') AS src
  FROM trc t LEFT JOIN cz c ON c.disk=t.disk AND c.day=t.source_day),
fg AS (SELECT g.*, fu.*, pred_class=1 OR (sq>=g.q AND srk>=g.risk AND srt>=g.map_thr AND snz<=g.noise_max AND src<>'unknown' AND (sts>=g.rule OR scf>=g.risk)) AS p FROM fu, (SELECT * FROM {_GRID_SQL}) g),
fc AS (SELECT q, risk, map_thr, rule, noise_max, eval_day, count(*) FILTER (true_class=1 AND p) AS tp, count(*) FILTER (true_class=0 AND p) AS fp, count(*) FILTER (true_class=0 AND NOT p) AS tn, count(*) FILTER (true_class=1 AND NOT p) AS fn FROM fg GROUP BY ALL),
{_simple('fc', 'fs')}, bc AS (SELECT eval_day, {_CM} FROM fu GROUP BY eval_day), {_simple('bc', 'bs')},
ba AS (SELECT avg(recall)*100.0::DOUBLE AS br, avg(acc)*100.0::DOUBLE AS bacc FROM bs),
fm AS (SELECT q, risk, map_thr, rule, noise_max, avg(recall)*100.0::DOUBLE AS recall, avg(precision)*100.0::DOUBLE AS precision, avg(f1)*100.0::DOUBLE AS f1, avg(acc)*100.0::DOUBLE AS acc, avg(fpr)*100.0::DOUBLE AS fpr FROM fs GROUP BY ALL)"""
_SEQ = "rg AS (SELECT *, (day-DATE '1970-01-01')::BIGINT*1000000+disk_no AS seq, failure*0.5::DOUBLE AS y FROM pr)"

QUERIES = {
    "delay_trace": _q_trace(0.5, False),
    "delay_trace_threshold": _q_trace(0.4, False),
    "delay_trace_exact_queue": _q_trace(0.5, True),
    "delay_trace_regression": q_trace_regression,
    "daily_metrics": q_daily_simple,
    "classification_metrics_local": q_local,
    "classification_metrics_global": q_global,
    "run_summary": q_run_summary,
    "mean_daily_metrics": q_mean_daily,
    "kappa_temporal_and_majority": q_kappas,
    "windowed_accuracy": q_sliding,
    "learning_curve": q_curve,
    "fading_accuracy": q_fading,
    "ewma_accuracy": q_ewma,
    "auc_overall": q_auc,
    "auc_by_language": q_auc_lang,
    "auc_windows": q_auc_tiles,
    "imbalance_metrics": q_gmean,
    "regression_metrics": q_regression,
    "regression_windowed": q_sliding_regression,
    "multi_label_metrics": q_multilabel,
    "multi_target_metrics": q_multitarget,
    "multi_target_relative": q_multitarget_relative,
    "multi_target_windowed": q_multitarget_windowed,
    "fold_mean_and_std": q_folds,
    "or_fusion_grid": q_fusion,
    "model_status": q_status,
    "baseline_lock": q_lock,
    "comparison_summary": q_compare,
    "reachability_guard": q_reach,
    "vote_threshold_grid": q_threshold_grid,
    "vote_threshold_pick": q_pick,
    "grid_summary": q_grid_summary,
    "policy_suggestion": q_best,
    "top_two_configurations": q_top_two,
    "seed_stability": q_seeds,
}
_TWO = "SELECT event_id, event_type, floor(value*100.0::DOUBLE+0.5::DOUBLE)::DOUBLE AS t1, 2000.0::DOUBLE AS p1, (user_id%50)::DOUBLE AS t2, 25.0::DOUBLE AS p2 FROM events"
_TRC = f"eval_day, source_day, disk, true_class::BIGINT AS true_class, pred_class::BIGINT AS pred_class, {_R('vote_0', 'vote_0')}, {_R('vote_1', 'vote_1')}, queue_size, threshold, credit::BIGINT AS credit"
ORACLE = {
    "delay_trace": f"WITH {_trace_sql(0.5)} SELECT {_TRC} FROM tr",
    "delay_trace_threshold": f"WITH {_trace_sql(0.4)} SELECT {_TRC} FROM tr",
    "delay_trace_exact_queue": f"WITH {_trace_sql(0.5, True)} SELECT {_TRC} FROM tr",
    "delay_trace_regression": f"""WITH {_PRED}, ev AS (SELECT unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY))::DATE AS e),
      q AS (SELECT e, pr.*, (SELECT max(fi) FROM ff WHERE ff.disk=pr.disk AND fi BETWEEN pr.i AND pr.i+{LABEL} AND f<e) AS seen, row_number() OVER (PARTITION BY disk, e ORDER BY day) AS k, count(*) OVER (PARTITION BY disk, e) AS qs FROM pr JOIN ev ON e>day AND e<=day+{WAIT})
      SELECT e-1 AS eval_day, disk, day AS source_day, round(coalesce(1.0::DOUBLE-(seen-i)/{LABEL + 1}.0::DOUBLE,0.0::DOUBLE),4)+0.0::DOUBLE AS truth, {_R('vote_1', 'prediction')}, qs AS queue_size FROM q WHERE k=1""",
    "daily_metrics": f"WITH {_trace_sql()}, cm AS (SELECT eval_day, {_CM} FROM tr GROUP BY eval_day), {_simple('cm', 'sm')} SELECT eval_day, tp, fp, tn, fn, {', '.join(_R(c, c) for c in ('recall', 'precision', 'acc', 'fpr', 'f1'))} FROM sm",
    "classification_metrics_local": f"""WITH {_trace_sql()}, cm AS (SELECT eval_day, {_CM}, sum(credit)::BIGINT AS credit FROM tr GROUP BY eval_day), {_full('cm', 'fm')}
      SELECT eval_day, tp, fp, tn, fn, credit, instances, {', '.join(_R(c, c) for c in FULL)}, round(credit/nullif(tp::DOUBLE,0),4)+0.0::DOUBLE AS days_before,
      CASE WHEN tp+fp=0 THEN 'UNDEFINED: TP+FP=0' WHEN tp+fn=0 THEN 'UNDEFINED: TP+FN=0' END AS reason FROM fm""",
    "classification_metrics_global": f"""WITH {_trace_sql()}, c0 AS (SELECT eval_day, {_CM} FROM tr GROUP BY eval_day),
      cm AS (SELECT eval_day, {', '.join(f'(sum({c}) OVER (ORDER BY eval_day))::BIGINT AS {c}' for c in ('tp', 'fp', 'tn', 'fn'))} FROM c0), {_full('cm', 'fm')} SELECT eval_day, tp, fp, tn, fn, instances, {', '.join(_R(c, c) for c in FULL)} FROM fm""",
    "run_summary": f"""WITH {_trace_sql()}, cm AS (SELECT model, eval_day, {_CM}, sum(credit) AS credit FROM tr GROUP BY ALL), {_full('cm', 'fm')},
      rs AS (SELECT model, avg(credit/nullif(tp::DOUBLE,0)) AS days_before, avg(fp) AS fp, avg(false_alarm_rate) AS fpr, avg(precision_c1) AS precision, avg(recall_c1) AS recall, count(*) AS days FROM fm WHERE recall_c1 IS NOT NULL GROUP BY model)
      SELECT model, days, {', '.join(_R(c, c) for c in ('days_before', 'fp', 'fpr', 'precision', 'recall'))}, round(2.0::DOUBLE*precision*recall/nullif(precision+recall,0),4)+0.0::DOUBLE AS f1 FROM rs""",
    "mean_daily_metrics": f"WITH {_trace_sql()}, cm AS (SELECT model, eval_day, {_CM} FROM tr GROUP BY ALL), {_simple('cm', 'sm')} SELECT model, {', '.join(_R(f'avg({c})*100.0::DOUBLE', c) for c in ('recall', 'precision', 'f1', 'acc', 'fpr'))} FROM sm GROUP BY model",
    "kappa_temporal_and_majority": f"""WITH {_EV}, k AS (SELECT *, coalesce(lag(true_class) OVER (ORDER BY n),0) AS l, CASE WHEN 2*sum(true_class) OVER (ORDER BY n)>n THEN 1 ELSE 0 END AS m FROM es),
      a AS (SELECT count(*) AS instances, avg(hit) AS p0, avg(CASE WHEN l=true_class THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS pt, avg(CASE WHEN m=true_class THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS pm FROM k)
      SELECT instances, {_R('p0', 'p0')}, {_R('(p0-pt)/(1.0::DOUBLE-pt)', 'kappa_temporal')}, {_R('(p0-pm)/(1.0::DOUBLE-pm)', 'kappa_m')} FROM a""",
    "windowed_accuracy": f"WITH {_EV} SELECT n, round(avg(hit) OVER w,4)+0.0::DOUBLE AS accuracy, round(avg(true_class::DOUBLE) OVER w,4)+0.0::DOUBLE AS positives FROM es WINDOW w AS (ORDER BY n ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)",
    "learning_curve": f"WITH {_EV}, c AS (SELECT n, avg(hit) OVER (ORDER BY n) AS a FROM es) SELECT n AS checkpoint, {_R('a', 'accuracy')} FROM c WHERE n%250=0",
    "fading_accuracy": f"WITH {_EV}, c AS (SELECT unnest(range(100,(SELECT count(*) FROM es)+1,100)) AS checkpoint) SELECT checkpoint, round(sum(hit*pow(0.999::DOUBLE,checkpoint-n))/sum(pow(0.999::DOUBLE,checkpoint-n)),4)+0.0::DOUBLE AS accuracy FROM c JOIN es ON n<=checkpoint GROUP BY checkpoint",
    "ewma_accuracy": f"WITH {_EV}, c AS (SELECT unnest(range(100,(SELECT count(*) FROM es)+1,100)) AS checkpoint) SELECT checkpoint, round(sum(hit*0.01::DOUBLE*pow(0.99::DOUBLE,checkpoint-n)),4)+0.0::DOUBLE AS accuracy FROM c JOIN es ON n<=checkpoint GROUP BY checkpoint",
    "auc_overall": f"WITH {_SC}, {_auc_sql('qs')}",
    "auc_by_language": f"WITH {_SC}, {_auc_sql('qs', 'lang')}",
    "auc_windows": f"WITH qs AS (SELECT event_id//1000 AS tile, value AS s, CASE WHEN event_type='error' THEN 1 ELSE 0 END AS t FROM events), {_auc_sql('qs', 'tile')}",
    "imbalance_metrics": f"WITH {_trace_sql()}, cm AS (SELECT model, {_CM} FROM tr GROUP BY model) SELECT *, round(sqrt({_n('tp', 'tp+fn')}*{_n('tn', 'tn+fp')}),4)+0.0::DOUBLE AS gmean, round({_n('tp', 'tp+fn')},4)+0.0::DOUBLE AS recall FROM cm",
    "regression_metrics": f"""WITH {_PRED}, {_SEQ}, rm AS (SELECT *, coalesce(avg(y) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0.0::DOUBLE) AS m FROM rg)
      SELECT count(*) AS instances, count(*) FILTER (y>0) AS failures, {_R('avg(abs(y-vote_1))', 'mae')}, {_R('sqrt(avg((y-vote_1)*(y-vote_1)))', 'rmse')}, {_R('sum(abs(y-vote_1))/sum(abs(y-m))', 'relative_mae')}, {_R('sqrt(sum((y-vote_1)*(y-vote_1))/sum((y-m)*(y-m)))', 'relative_rmse')},
      {_R('avg(abs(y-vote_1)) FILTER (y>0)', 'mae_failures')}, {_R('avg((y-vote_1)*(y-vote_1)) FILTER (y>0)', 'mse_failures')}, round(avg(vote_1-y) FILTER (y>0)*{LABEL + 1}.0::DOUBLE,4)+0.0::DOUBLE AS error_days FROM rm""",
    "regression_windowed": f"WITH {_PRED}, {_SEQ}, rn AS (SELECT row_number() OVER (ORDER BY seq) AS n, floor(abs(failure-vote_1)*10000.0::DOUBLE+0.5::DOUBLE)::BIGINT AS e FROM rg) SELECT n, round(avg(e) OVER w,4)+0.0::DOUBLE AS mae_bp, round(sqrt(avg(e*e) OVER w),4)+0.0::DOUBLE AS rmse_bp FROM rn WINDOW w AS (ORDER BY n ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)",
    "multi_label_metrics": f"""WITH m AS (SELECT lang, quality AS t1, toxic AS t2, CASE WHEN n_chars>400 THEN 1 ELSE 0 END AS p1, CASE WHEN n_chars%7=0 THEN 1 ELSE 0 END AS p2 FROM labels JOIN documents USING (doc_id)),
      x AS (SELECT *, (t1*p1+t2*p2)::DOUBLE AS i, t1+t2 AS t, p1+p2 AS p, (t1=p1)::INT+(t2=p2)::INT AS c FROM m)
      SELECT lang, round(avg((c=2)::INT),4)+0.0::DOUBLE AS exact_match, round(avg({_d('i', 't+p-i')}),4)+0.0::DOUBLE AS accuracy, round(avg(c/2.0::DOUBLE),4)+0.0::DOUBLE AS hamming, round(avg({_d('i', 'p')}),4)+0.0::DOUBLE AS precision, round(avg({_d('i', 't')}),4)+0.0::DOUBLE AS recall, round(avg({_d('2*i', 't+p')}),4)+0.0::DOUBLE AS f_measure FROM x GROUP BY lang""",
    "multi_target_metrics": f"""WITH x AS (SELECT l_returnflag, l_quantity AS t1, 25.0::DOUBLE AS p1, l_discount*100.0::DOUBLE AS t2, l_tax*100.0::DOUBLE AS p2 FROM lineitem)
      SELECT l_returnflag, count(*) AS instances, {_R('(avg(abs(t1-p1))+avg(abs(t2-p2)))/2.0::DOUBLE', 'mae')}, {_R('(sqrt(avg((t1-p1)*(t1-p1)))+sqrt(avg((t2-p2)*(t2-p2))))/2.0::DOUBLE', 'rmse')},
      {_R('(sqrt(avg((t1-p1)*(t1-p1)))/stddev_pop(t1)+sqrt(avg((t2-p2)*(t2-p2)))/stddev_pop(t2))/2.0::DOUBLE', 'relative_rmse')} FROM x GROUP BY l_returnflag""",
    "multi_target_relative": f"""WITH x AS ({_TWO}), m AS (SELECT *, avg(t1) OVER w AS m1, avg(t2) OVER w AS m2 FROM x WINDOW w AS (PARTITION BY event_type ORDER BY event_id))
      SELECT event_type, count(*) AS instances, {_R('(sum(abs(t1-p1))/sum(abs(t1-m1))+sum(abs(t2-p2))/sum(abs(t2-m2)))/2.0::DOUBLE', 'relative_mae')},
      {_R('(sqrt(sum((t1-p1)**2)/sum((t1-m1)**2))+sqrt(sum((t2-p2)**2)/sum((t2-m2)**2)))/2.0::DOUBLE', 'relative_rmse')} FROM m GROUP BY event_type""",
    "multi_target_windowed": f"""WITH x AS ({_TWO}), m AS (SELECT *, avg(t1) OVER w AS m1, avg(t2) OVER w AS m2 FROM x WINDOW w AS (ORDER BY event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)),
      y AS (SELECT event_id, {', '.join(f'avg(abs(t{i}-p{i})) OVER w AS e{i}, avg(abs(t{i}-m{i})) OVER w AS a{i}, avg((t{i}-p{i})**2) OVER w AS s{i}, avg((t{i}-m{i})**2) OVER w AS q{i}' for i in (1, 2))}
        FROM m WINDOW w AS (ORDER BY event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW))
      SELECT event_id, {_R('(e1+e2)/2.0::DOUBLE', 'mae')}, {_R('sqrt((s1+s2)/2.0::DOUBLE)', 'rmse')}, {_R('(e1/nullif(a1,0)+e2/nullif(a2,0))/2.0::DOUBLE', 'relative_mae')}, {_R('(sqrt(s1/nullif(q1,0))+sqrt(s2/nullif(q2,0)))/2.0::DOUBLE', 'relative_rmse')} FROM y""",
    "fold_mean_and_std": f"WITH {_EV}, c AS (SELECT seq%5 AS fold, seq//1000 AS tile, avg(hit) AS a FROM es GROUP BY ALL) SELECT tile, {_R('avg(a)', 'accuracy_mean')}, {_R('stddev_samp(a)', 'accuracy_std')} FROM c GROUP BY tile",
    "or_fusion_grid": f"WITH {_FUSE} SELECT q, risk, map_thr, rule, noise_max, {', '.join(_R(c, c) for c in ('recall', 'precision', 'f1', 'acc', 'fpr'))}, {_R('recall-br', 'd_recall')}, {_R('acc-bacc', 'd_acc')}, acc>=bacc-1.0::DOUBLE AS pass_acc_guard FROM fm, ba",
    "model_status": f"WITH {_STATUS} SELECT model, status, action, {', '.join(_R(c, c) for c in _ST)} FROM ss",
    "baseline_lock": f"WITH {_STATUS} SELECT model, {_R('nollm_acc_mean-1.0::DOUBLE', 'acc_guard_floor')}, {_R('nollm_recall_mean', 'recall_target_floor')} FROM ss",
    "comparison_summary": f"WITH {_STATUS} SELECT count(*) AS models, count(*) FILTER (status='PASS') AS enabled, {_R('avg(delta_recall)', 'mean_delta_recall')}, arg_min(model,(-delta_recall,model)) AS best_model, arg_min(model,(delta_recall,model)) AS worst_model FROM ss",
    "reachability_guard": f"""WITH ra AS (WITH {_trace_sql(0.4)}, cm AS (SELECT eval_day, {_CM} FROM tr GROUP BY ALL), {_simple('cm', 'sm')} SELECT eval_day, recall*100.0::DOUBLE AS recall, acc*100.0::DOUBLE AS acc FROM sm),
      rb AS (WITH {_trace_sql(0.6)}, cm AS (SELECT eval_day, {_CM} FROM tr GROUP BY ALL), {_simple('cm', 'sm')} SELECT eval_day, recall*100.0::DOUBLE AS recall, acc*100.0::DOUBLE AS acc FROM sm),
      m AS (SELECT (SELECT avg(recall) FROM ra) AS run_recall, (SELECT avg(acc) FROM ra) AS run_acc, (SELECT avg(recall) FROM rb) AS zero_recall, (SELECT avg(acc) FROM rb) AS zero_acc, (SELECT count(*) FROM ra JOIN rb USING (eval_day) WHERE abs(ra.recall-rb.recall)+abs(ra.acc-rb.acc)>1e-9) AS changed_days)
      SELECT {', '.join(_R(c, c) for c in ('run_recall', 'run_acc', 'zero_recall', 'zero_acc'))}, changed_days, {_R('greatest(abs(run_recall-zero_recall),abs(run_acc-zero_acc))', 'max_abs_diff')}, greatest(abs(run_recall-zero_recall),abs(run_acc-zero_acc))>1e-9 OR changed_days>0 AS reachable FROM m""",
    "vote_threshold_grid": f"WITH {_TG} SELECT model, h, {_R('recall', 'recall')}, {_R('acc', 'acc')} FROM th",
    "vote_threshold_pick": f"""WITH {_TG}, p AS (SELECT *, CASE WHEN acc>=90 AND recall>=20 THEN 0 WHEN acc>=90 THEN 1 ELSE 2 END AS t FROM th)
      SELECT model, h, {_R('recall', 'recall')}, {_R('acc', 'acc')}, CASE t WHEN 0 THEN 'feasible' WHEN 1 THEN 'acc_guard' ELSE 'best_effort' END AS tier FROM p QUALIFY row_number() OVER (PARTITION BY model ORDER BY t, recall DESC, acc DESC, h)=1""",
    "grid_summary": f"WITH {_GS} SELECT model, h, q_gate, kept::BIGINT AS kept, {', '.join(_R(c, c) for c in ('recall', 'acc', 'base_recall', 'base_acc', 'delta_recall', 'delta_acc'))}, pass_acc_guard, degenerate FROM gs",
    "policy_suggestion": f"""WITH {_GS}, b AS (SELECT * FROM gs WHERE NOT degenerate QUALIFY row_number() OVER (PARTITION BY model ORDER BY pass_acc_guard DESC, delta_recall DESC, delta_acc DESC, h)=1)
      SELECT model, h, pass_acc_guard AND delta_recall>=0 AS enabled, CASE WHEN pass_acc_guard AND delta_recall>=0 THEN 'zero' ELSE 'nollm' END AS fallback, CASE WHEN pass_acc_guard AND delta_recall>=0 THEN h ELSE 0.0::DOUBLE END AS min_q_score, {_R('delta_recall', 'delta_recall')}, {_R('delta_acc', 'delta_acc')} FROM b""",
    "top_two_configurations": f"""WITH {_GS} SELECT model, h, row_number() OVER (PARTITION BY model ORDER BY pass_acc_guard DESC, recall DESC, acc DESC, h) AS rank, CASE WHEN pass_acc_guard THEN 'ok' ELSE 'acc_below_guard' END AS risk, {_R('recall', 'recall')}, {_R('acc', 'acc')} FROM gs QUALIFY rank<=2""",
    "seed_stability": f"""WITH {_trace_sql()}, cm AS (SELECT model, substr(disk,6)::BIGINT%5 AS seed, {_CM} FROM tr GROUP BY ALL), {_simple('cm', 'sm')}, m AS (SELECT model, avg(recall*100.0::DOUBLE) AS r, avg(acc*100.0::DOUBLE) AS a, count(*) AS seeds FROM sm GROUP BY model)
      SELECT model, {_R('r', 'recall_mean')}, {_R('a', 'acc_mean')}, seeds, r>=20 AND a>=80 AS stable FROM m""",
}
