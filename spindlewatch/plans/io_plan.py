"""Queries that go through files and streams: what is written is read back and reported."""
from __future__ import annotations

from pyspark.sql import functions as F

from spindlewatch.functions.scalars import fixed_sql, r4
from spindlewatch.operators import drift, metrics
from spindlewatch.operators.windows import feature_stats, stage
from spindlewatch.plans.answers_plan import CACHE_SQL, DIM, cache
from spindlewatch.plans.bridge import FEATURES, daily, daily_sql, table
from spindlewatch.plans.eval_plan import _PRED, FULL, ORACLE as EVAL_ORACLE, daily_counts, predictions, trace
from spindlewatch.plans.labels_plan import _FD, TAIL, last_day
from spindlewatch.plans.stream_plan import ORACLE as STREAM_ORACLE, PARAMS
from spindlewatch.plans.windows_plan import ORACLE as WINDOW_ORACLE
from spindlewatch.operators import labels
from spindlewatch.session import work_dir
from spindlewatch.sources import readers, writers
from spindlewatch.streaming import jobs


def q_daily_csv(spark, sf):
    """Snapshots written as one CSV file per day and read back by day range."""
    out = work_dir(spark, "daily-csv")
    d = daily(spark, sf).select(F.date_format("day", "yyyy-MM-dd").alias("date"), "model", F.col("disk").alias("serial_number"), "failure", *FEATURES)
    d.repartition("date").withColumn("p", F.col("date")).write.partitionBy("p").csv(out, header=True)
    # the day folders stand in for day files: the reader takes one path per day
    files = [f"{out}/p={r.date}" for r in d.select("date").distinct().orderBy("date").collect()]  # one row per day
    raw = readers._by_header(spark, files, {})
    return raw.select(
        F.col("serial_number").alias("disk"), F.to_date("date").alias("day"), F.col("failure").cast("bigint").alias("failure"),
        *[r4(readers.safe_double(F.col(c))).alias(c) for c in FEATURES],
    )


def q_sets_parquet(spark, sf):
    out = work_dir(spark, "sets")
    writers.write_sets(labels.asof_sets(daily(spark, sf), 30, 7, 5, end=last_day(spark, sf, TAIL)), out)
    back = spark.read.parquet(out)
    return back.groupBy("asof_day", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))


def q_cache_json(spark, sf):
    out = work_dir(spark, "cache")
    writers.write_rows(writers.cache_rows(cache(spark, sf).select("disk", "day", "z", "root_cause", "confidence"), as_columns=True, dim=DIM), out)
    back = readers.read_cache(spark, out, DIM + 2)
    return back.select("disk", "day", "root_cause", r4(F.col("confidence")).alias("confidence"), F.size("z").cast("bigint").alias("dim"), r4(F.aggregate("z", F.lit(0.0), lambda a, v: a + v)).alias("z_sum"))


def q_append_missing(spark, sf):
    out = work_dir(spark, "append")
    d = daily(spark, sf).select("disk", "day", "failure")
    writers.append_missing(d.where("day < '2024-01-16'"), out, ["disk", "day"])
    writers.append_missing(d, out, ["disk", "day"])
    return spark.read.parquet(out).groupBy("disk").agg(F.count(F.lit(1)).alias("days"), F.sum("failure").alias("failures"))


def q_trace_csv(spark, sf):
    out = work_dir(spark, "trace")
    tr = trace(spark, sf).select("eval_day", F.when(F.col("queue_size") > 3, F.col("source_day")).alias("source_day"), F.col("disk").alias("serial_number"), "true_class", "pred_class", "vote_0", "vote_1", "threshold")
    tr.write.csv(out, header=True)
    back = readers.read_trace(spark, out)
    return back.select("eval_day", "source_day", "disk", F.col("true_class").cast("bigint").alias("true_class"), r4(F.col("vote_1")).alias("vote_1"))


def q_log(spark, sf):
    """Daily metrics written as a text log per model and parsed back."""
    out = work_dir(spark, "log")
    df = metrics.full_metrics(daily_counts(spark, sf, ("model", "eval_day")))
    shown = {"classified instances": "instances", "classifications correct (percent)": "accuracy", "TP": "tp", "FP": "fp", "TN": "tn", "FN": "fn",
             "Recall for class 1 (percent)": "recall_c1"}
    for c in ("accuracy", "recall_c1"):
        df = stage(df, {f"_{c}": f"coalesce({fixed_sql(c, 4)}, 'NaN')"})
    line = lambda n, c: F.concat(F.lit(f"  {n}: "), F.col(f"_{c}" if c in ("accuracy", "recall_c1") else c).cast("string"))
    body = F.concat_ws("\n", *[line(n, c) for n, c in shown.items()])
    text = F.concat(F.date_format("eval_day", "yyyy-MM-dd"), F.lit("\nIndex 0\nVotes\nGlobal Measurements\n"), body, F.lit("\nLocal Measurements\n"), body, F.lit("\nModel measurements\n  leaves: 3"))
    df.select("model", text.alias("value")).write.partitionBy("model").text(out)
    back = readers.read_evaluation_log(spark, out + "/*")
    return back.select(F.col("date").alias("eval_day"), *[F.col(f"l_{c}").cast("bigint").alias(c.lower()) for c in ("TP", "FP", "TN", "FN")],
                       r4(F.col("g_clf_corrct")).alias("accuracy"), r4(F.col("l_Recall_c1")).alias("recall_c1"))


# ---- streams -----------------------------------------------------------------------------------------------------------------


def events_stream(spark, sf):
    stream = jobs.table_stream(spark, sf, "events", table(spark, sf, "events").schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def q_stream_drift(spark, sf):
    ev = events_stream(spark, sf).select((F.col("user_id") % 4).alias("model_no"), "event_id", (F.col("event_type") == "error").cast("double").alias("x"))
    out = jobs.run_to_table(jobs.detect_drift_stream(ev, "model_no", "event_id", "x", "cusum", **PARAMS["cusum"]), work_dir(spark, "stream-drift"))
    return out.select("model_no", "event_id", r4(F.col("estimation")).alias("estimation"), "warning", "change")


def q_stream_dedup(spark, sf):
    ev = events_stream(spark, sf).select("ts", "user_id", "event_type")
    twice = ev.unionByName(ev.where("event_type = 'click'"))
    out = jobs.run_to_table(jobs.drop_late_duplicates(twice, ["user_id", "event_type", "ts"], late="60 days"), work_dir(spark, "stream-dedup"))
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def q_stream_labels(spark, sf):
    ev = events_stream(spark, sf)
    p = ev.where("event_type = 'click'").select(F.col("user_id").alias("disk"), "ts", "event_id")
    f = ev.where("event_type = 'error' AND value > 60").select(F.col("user_id").alias("disk"), F.col("ts").alias("fail_ts"))
    out = jobs.run_to_table(jobs.delayed_labels(p, f, 2), work_dir(spark, "stream-labels"))
    return out.where("true_class = 1").groupBy("event_id").agg(F.count(F.lit(1)).alias("failures"))


def q_stream_ingest(spark, sf):
    src, store, out = (work_dir(spark, n) for n in ("days", "store", "asof"))
    daily(spark, sf).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    jobs.ingest_days(stream, store, out, work_dir(spark, "state"), 30, 7, 5).awaitTermination()
    return spark.read.parquet(out).groupBy("asof_day", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))


def q_stream_windows(spark, sf):
    """Sliding windows of a stream, followed by the batch statistics operator; windows the watermark has closed."""
    src = work_dir(spark, "windows")
    daily(spark, sf).withColumn("ts", F.col("day").cast("timestamp")).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    win = jobs.sliding_windows(stream, FEATURES, late="1 day")
    out = jobs.run_to_table(feature_stats(win, FEATURES).select("disk", "day", "feature", "n", "n_rows", "status", "severity"), work_dir(spark, "stream-windows"))
    return out.where("n > 0").select("disk", "day", "feature", F.col("n").cast("bigint").alias("n"), F.col("n_rows").cast("bigint").alias("n_rows"), "status", r4(F.col("severity")).alias("severity"))


def q_phases(spark, sf):
    d = daily(spark, sf).select("day", jobs.transfer_phase(F.col("day"), "2024-01-11", "2024-01-21").alias("phase"))
    return d.groupBy("phase").agg(F.count(F.lit(1)).alias("rows"), F.min("day").alias("first_day"))


_R = lambda e, n: f"round({e},4)+0.0::DOUBLE AS {n}"
QUERIES = {
    "daily_csv_round_trip": q_daily_csv,
    "asof_sets_partitioned": q_sets_parquet,
    "cache_json_round_trip": q_cache_json,
    "append_with_resume": q_append_missing,
    "trace_csv_round_trip": q_trace_csv,
    "evaluation_log_scan": q_log,
    "stream_drift_cusum": q_stream_drift,
    "stream_deduplicate": q_stream_dedup,
    "stream_delayed_labels": q_stream_labels,
    "stream_daily_ingestion": q_stream_ingest,
    "stream_sliding_windows": q_stream_windows,
    "transfer_phases": q_phases,
}
_SETS = f"WITH {_FD} SELECT asof_day, split, count(*) AS n, sum(label)::BIGINT AS positives FROM st GROUP BY ALL"
_LOG = EVAL_ORACLE["run_summary"]
ORACLE = {
    "daily_csv_round_trip": f"WITH {daily_sql()} SELECT disk, day, failure::BIGINT AS failure, {', '.join(_R(c, c) for c in FEATURES)} FROM daily",
    "asof_sets_partitioned": _SETS,
    "cache_json_round_trip": f"WITH {CACHE_SQL} SELECT disk, day, rc AS root_cause, {_R('cf', 'confidence')}, {DIM + 2}::BIGINT AS dim, {_R('list_sum(z)', 'z_sum')} FROM cz",
    "append_with_resume": f"WITH {daily_sql()} SELECT disk, count(*) AS days, sum(failure)::BIGINT AS failures FROM daily GROUP BY disk",
    "trace_csv_round_trip": EVAL_ORACLE["delay_trace"].rsplit("SELECT", 1)[0] + f"SELECT eval_day, CASE WHEN queue_size>3 THEN source_day ELSE eval_day END AS source_day, disk, true_class::BIGINT AS true_class, {_R('vote_1', 'vote_1')} FROM tr",
    "evaluation_log_scan": _LOG.rsplit("rs AS", 1)[0].rstrip().rstrip(",") + f" SELECT eval_day, tp, fp, tn, fn, {_R('accuracy', 'accuracy')}, {_R('recall_c1', 'recall_c1')} FROM fm",
    "stream_drift_cusum": STREAM_ORACLE["drift_cusum"],
    "stream_deduplicate": "SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, ts FROM events) GROUP BY 1",
    "stream_delayed_labels": "SELECT p.event_id, count(*) AS failures FROM events p JOIN events f ON f.user_id=p.user_id AND f.event_type='error' AND f.value>60 AND f.ts BETWEEN p.ts AND p.ts+INTERVAL 2 DAY WHERE p.event_type='click' GROUP BY 1",
    "stream_daily_ingestion": _SETS + " HAVING asof_day<=DATE '2024-01-30'",
    "stream_sliding_windows": WINDOW_ORACLE["window_feature_stats"].rsplit("SELECT disk, day, feature", 1)[0] + f"SELECT disk, day, feature, n, n_rows, status, {_R('severity', 'severity')} FROM st WHERE day<(SELECT max(day) FROM daily)-1",
    "transfer_phases": f"WITH {daily_sql()} SELECT CASE WHEN day<'2024-01-11' THEN 'source' WHEN day<'2024-01-21' THEN 'target_test' ELSE 'target_test_train' END AS phase, count(*) AS rows, min(day) AS first_day FROM daily GROUP BY 1",
}
