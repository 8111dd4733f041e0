"""Queries that go through the remaining readers and writers: what is derived from the tables is written and read back."""
from __future__ import annotations

from pyspark.sql import functions as F

from spindlewatch.functions.names import canonical_feature
from spindlewatch.functions.scalars import r4
from spindlewatch.operators import metrics
from spindlewatch.plans.answers_plan import CACHE_SQL, DIM, cache
from spindlewatch.plans.bridge import daily, daily_sql, table
from spindlewatch.plans.eval_plan import _CM, _simple, _trace_sql, trace
from spindlewatch.session import work_dir
from spindlewatch.sources import readers, writers

POINT_DIMS = 8


def q_failures(spark, sf):
    """Failure labels of two models."""
    out = work_dir(spark, "failures")
    rows = daily(spark, sf).where("failure = 1").select(F.col("disk_no").alias("disk_id"), "model", F.concat(F.col("day").cast("string"), F.lit(" 13:45:00")).alias("failure_time"))
    rows.write.csv(out, header=True)
    return readers.read_failures(spark, out, ["hi7", "mc1"])


def q_window_text(spark, sf):
    """A text per disk and day, written as JSON lines."""
    out = work_dir(spark, "texts")
    text = F.concat(F.lit("WINDOW: "), "disk", F.lit("\n"), F.lit('"quoted"'))
    rows = daily(spark, sf).select(F.col("disk").alias("disk_id"), F.date_format("day", "yyyy-MM-dd").alias("window_end_time"), text.alias("summary_text"), F.lit("v2").alias("summary_schema"), F.col("model").alias("rule_model_key"))
    writers.write_rows(rows, out)
    back = readers.read_window_text(spark, out)
    return back.select("disk", "day", "summary_text", "summary_schema", "rule_model_key", F.col("rule_vendor").isNull().alias("no_vendor"))


def q_eval_csv(spark, sf):
    """Daily metrics with empty dates among them, which are left out."""
    out = work_dir(spark, "metrics")
    df = metrics.simple_metrics(metrics.confusion(trace(spark, sf), ["eval_day"]))
    date = F.when(F.dayofmonth("eval_day") % 4 > 0, F.date_format("eval_day", "yyyy-MM-dd"))
    df.select(date.alias("date"), F.col("recall").alias("l_Recall_c1"), F.col("acc").alias("l_clf_corrct"), F.when(F.col("tp") > 0, F.col("tp")).alias("l_TP")).write.csv(out, header=True)
    back = readers.read_eval_csv(spark, out)
    return back.select(F.to_date("date").alias("day"), *[r4(F.col(c)).alias(c.lower()) for c in ("l_Recall_c1", "l_clf_corrct", "l_TP")])


def _points(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(*[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(POINT_DIMS)], F.col("label").alias("class"))


def q_points(spark, sf):
    out = work_dir(spark, "points")
    _points(spark, sf).write.csv(out)
    back = readers.read_points(spark, out, POINT_DIMS, True)
    return back.groupBy("class").agg(F.count("*").alias("n"), *[r4(F.sum(f"x{i}")).alias(f"x{i}") for i in range(POINT_DIMS)])


def q_points_stream(spark, sf):
    """The same points as a stream that is written to files."""
    out, sink = work_dir(spark, "points"), work_dir(spark, "points-sink")
    _points(spark, sf).write.csv(out)
    query = writers.write_stream(readers.read_points(spark, out, POINT_DIMS, True, streaming=True).where("x0 > 0"), sink, work_dir(spark, "points-state"))
    query.awaitTermination()
    return spark.read.parquet(sink).groupBy("class").agg(F.count("*").alias("n"), r4(F.sum("x0")).alias("x0"))


def q_ratings(spark, sf):
    """Ratings as separated text with a fourth column that is ignored, and some that are no number."""
    out = work_dir(spark, "ratings")
    rating = F.when(F.col("l_linenumber") == 7, "none").otherwise(F.col("l_quantity").cast("string"))
    table(spark, sf, "lineitem").select((F.col("l_orderkey") % 100).alias("u"), (F.col("l_partkey") % 50).alias("i"), rating.alias("r"), F.col("l_tax")).write.option("sep", "\t").csv(out)
    back = readers.read_ratings(spark, out)
    return back.groupBy("user").agg(F.count("*").alias("rows"), F.count("rating").alias("rated"), r4(F.avg("rating")).alias("mean"))


def q_append_checked(spark, sf):
    """Two halves appended; a frame with other columns is refused."""
    out = work_dir(spark, "checked")
    d = daily(spark, sf).select("disk", "day", "failure")
    even = F.dayofmonth("day") % 2 == 0
    writers.write_rows(d.where(even), out, "parquet")
    writers.append_checked(d.where(~even), out)
    refused = False
    try:
        writers.append_checked(d.withColumnRenamed("failure", "failed"), out)
    except ValueError:
        refused = True
    return spark.read.parquet(out).groupBy("disk").agg(F.count("*").alias("days"), F.sum("failure").alias("failures")).withColumn("refused", F.lit(refused))


def q_cache_dimension(spark, sf):
    """A cache of lists read back without naming the dimension."""
    out = work_dir(spark, "cache-lists")
    writers.write_rows(writers.cache_rows(cache(spark, sf).select("disk", "day", "z", "risk_hint")), out)
    back = readers.read_cache(spark, out)
    return back.select("disk", "day", F.size("z").cast("bigint").alias("dim"), r4(F.aggregate("z", F.lit(0.0), lambda a, v: a + v)).alias("z_sum"))


#: Spellings of a sensor, by the event's user: the number goes where the braces are.
SPELLINGS = {"r_{}": "raw", "N-{}": "normalized", "smart {} RAW": "raw", "SMART_{}_normalized": "normalized", "smart{}": "raw", "raw{}": "raw", "temperature_{}_x": None}


def q_canonical(spark, sf):
    """Odd spellings of sensors under their canonical names."""
    number = (F.col("user_id") % 250).cast("string")
    spelt = F.lit(None).cast("string")
    for i, s in enumerate(SPELLINGS):
        before, after = s.split("{}")
        spelt = F.when(F.col("event_id") % len(SPELLINGS) == i, F.concat(F.lit(before), number, F.lit(after))).otherwise(spelt)
    rows = table(spark, sf, "events").select("event_id", "user_id", spelt.alias("spelling"))
    return rows.select("event_id", "spelling", canonical_feature(F.col("spelling")).alias("sensor"))


# ---- SQL twins ---------------------------------------------------------------------------------------------------------------
_R = lambda e, n: f"round({e},4)+0.0::DOUBLE AS {n}"
_P = f"p AS (SELECT {', '.join(f'embedding[{i + 1}]::DOUBLE AS x{i}' for i in range(POINT_DIMS))}, label AS class FROM embeddings)"
_SPELT = "CASE event_id%{} {} END".format(len(SPELLINGS), " ".join(f"WHEN {i} THEN '{s.split('{}')[0]}'||(user_id%250)||'{s.split('{}')[1]}'" for i, s in enumerate(SPELLINGS)))
_NAMED = "CASE event_id%{} {} END".format(len(SPELLINGS), " ".join(f"WHEN {i} THEN " + (f"'smart_'||(user_id%250)||'_{k}'" if k else f"'{s.split('{}')[0]}'||(user_id%250)||'{s.split('{}')[1]}'") for i, (s, k) in enumerate(SPELLINGS.items())))

QUERIES = {
    "failure_labels_round_trip": q_failures, "window_text_round_trip": q_window_text, "metric_table_round_trip": q_eval_csv, "points_csv_round_trip": q_points,
    "points_stream_round_trip": q_points_stream, "ratings_round_trip": q_ratings, "append_checked_round_trip": q_append_checked, "cache_dimension_inferred": q_cache_dimension,
    "canonical_sensor_names": q_canonical,
}
ORACLE = {
    "failure_labels_round_trip": f"WITH {daily_sql()} SELECT 's'||disk_no AS disk, model, day AS fail_day FROM daily WHERE failure=1 AND model IN ('hi7','mc1')",
    "window_text_round_trip": f"""WITH {daily_sql()} SELECT disk, day, 'WINDOW: '||disk||chr(10)||'"quoted"' AS summary_text, 'v2' AS summary_schema, model AS rule_model_key, true AS no_vendor FROM daily""",
    "metric_table_round_trip": f"""WITH {_trace_sql()}, cm AS (SELECT eval_day, {_CM} FROM tr GROUP BY ALL), {_simple('cm', 'sm')}
      SELECT eval_day AS day, {_R('recall', 'l_recall_c1')}, {_R('acc', 'l_clf_corrct')}, CASE WHEN tp>0 THEN tp::DOUBLE END AS l_tp FROM sm WHERE day(eval_day)%4>0""",
    "points_csv_round_trip": f"WITH {_P} SELECT class, count(*) AS n, {', '.join(_R(f'sum(x{i})', f'x{i}') for i in range(POINT_DIMS))} FROM p GROUP BY class",
    "points_stream_round_trip": f"WITH {_P} SELECT class, count(*) AS n, {_R('sum(x0)', 'x0')} FROM p WHERE x0>0 GROUP BY class",
    "ratings_round_trip": f"""SELECT (l_orderkey%100)::INT AS "user", count(*) AS rows, count(*) FILTER (l_linenumber<>7) AS rated, {_R('avg(l_quantity) FILTER (l_linenumber<>7)', 'mean')} FROM lineitem GROUP BY 1""",
    "append_checked_round_trip": f"WITH {daily_sql()} SELECT disk, count(*) AS days, sum(failure)::BIGINT AS failures, true AS refused FROM daily GROUP BY disk",
    "cache_dimension_inferred": f"WITH {CACHE_SQL} SELECT disk, day, {DIM}::BIGINT AS dim, {_R('list_sum(z)', 'z_sum')} FROM cz",
    "canonical_sensor_names": f"SELECT event_id, {_SPELT} AS spelling, {_NAMED} AS sensor FROM events",
}
