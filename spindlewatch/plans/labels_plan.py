"""Queries over as-of labels and training sets."""
from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from spindlewatch.functions.scalars import r4
from spindlewatch.operators import labels
from spindlewatch.plans.bridge import FEATURES, daily, daily_sql, day_range

W, L, A = 30, 7, 5  # days positives stay, days negatives stay, label days
TAIL = 11  # as-of days after the last day of the table: their sets have no test rows; the SQL twins end there on the given tables


def last_day(spark, sf, more=0):
    last = day_range(spark, sf)[1]
    return last and last + timedelta(days=more)


def q_label_interval(spark, sf):
    df = labels.with_fail_days(daily(spark, sf), A)
    end = F.lit("2024-12-31").cast("date")
    return df.select(
        "disk", "day", labels.label_asof(end, F.col("fail_days")).cast("bigint").alias("label"),
        r4(labels.target_asof(end, F.col("fail_days"), F.col("day"), A)).alias("target"),
    )


def failures(spark, sf):
    """First failure per disk, as a label table of its own (D3)."""
    return daily(spark, sf).where("failure = 1").groupBy("disk").agg(F.min("day").alias("fail_day"))


def q_label_join(spark, sf):
    base = daily(spark, sf).select("disk", "day")
    return labels.label_with_failures(base, failures(spark, sf), A).select("disk", "day", F.col("label").cast("bigint").alias("label"))


def q_asof_sets(spark, sf):
    sets = labels.asof_sets(daily(spark, sf), W, L, A, end=last_day(spark, sf, TAIL))
    return sets.select("asof_day", "disk", "day", "split", F.col("label").cast("bigint").alias("label"))


def q_imbalance(spark, sf):
    sets = labels.asof_sets(daily(spark, sf), W, L, A, end=last_day(spark, sf, TAIL))
    out = labels.imbalance(sets.where("split = 'train' OR split = 'test'"))
    return out.withColumn("ratio", r4(F.col("ratio")))


def q_asof_no_history(spark, sf):
    sets = labels.asof_sets(daily(spark, sf), W, L, A, end=last_day(spark, sf, TAIL), keep_history=False)
    return sets.groupBy("asof_day", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))


def q_asof_regression(spark, sf):
    sets = labels.asof_sets(daily(spark, sf), W, L, A, end=last_day(spark, sf, TAIL), regression=True)
    return sets.groupBy("asof_day").agg(F.count(F.lit(1)).alias("n"), r4(F.sum("label")).alias("target_sum"))


def q_asof_forget_no(spark, sf):
    sets = labels.asof_sets(daily(spark, sf), W, L, A, start=last_day(spark, sf, -5), end=last_day(spark, sf), forget=False)
    return sets.groupBy("asof_day").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))


def q_asof_forget_no_all(spark, sf):
    """Every as-of day of the table; ``asof_sets_forget_nothing`` has the last six, as its SQL twin."""
    sets = labels.asof_sets(daily(spark, sf), W, L, A, end=last_day(spark, sf), forget=False)
    return sets.groupBy("asof_day").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))


def q_metadata(spark, sf):
    return labels.disk_metadata(daily(spark, sf))


def q_metadata_merge(spark, sf):
    d = daily(spark, sf)
    old, new = d.where("day < '2024-01-16'"), d.where("day >= '2024-01-16'")
    return labels.merge_metadata(labels.disk_metadata(old), labels.disk_metadata(new))


def q_drop_after_failure(spark, sf):
    df = labels.drop_after_failure(daily(spark, sf), failures(spark, sf))
    return labels.mark_failures(df, failures(spark, sf)).select("disk", "day", F.col("failure").cast("bigint").alias("failure"))


def q_failed_disks(spark, sf):
    d = daily(spark, sf).where("failure = 1")
    return labels.failed_disks(d.where("day < '2024-01-16'"), d.where("day >= '2024-01-16'"))


_FD = f"""{daily_sql()},
fl AS (SELECT disk, day AS f FROM daily WHERE failure=1),
cal AS (SELECT unnest(generate_series((SELECT min(day) FROM daily), DATE '2024-02-10', INTERVAL 1 DAY))::DATE AS asof_day),
ex AS (SELECT c.asof_day, d.*, CASE WHEN c.asof_day=d.day THEN 'test' ELSE 'train' END AS split,
  (SELECT count(*)>0 FROM fl WHERE fl.disk=d.disk AND fl.f BETWEEN d.day AND d.day+{A} AND fl.f<=c.asof_day)::BIGINT AS label,
  coalesce((SELECT 1.0::DOUBLE-(max(fl.f)-d.day)/{A + 1}.0::DOUBLE FROM fl WHERE fl.disk=d.disk AND fl.f BETWEEN d.day AND d.day+{A} AND fl.f<=c.asof_day),0.0::DOUBLE) AS target
  FROM daily d JOIN cal c ON c.asof_day BETWEEN d.day AND d.day+{W - 1}),
st AS (SELECT * FROM ex WHERE split='test' OR label=1 OR day > asof_day-{L})"""
_F1 = "ff AS (SELECT disk, min(day) AS fail_day FROM daily WHERE failure=1 GROUP BY disk)"

QUERIES = {
    "label_interval_window": q_label_interval,
    "label_interval_join": q_label_join,
    "asof_train_test_sets": q_asof_sets,
    "asof_imbalance_ratio": q_imbalance,
    "asof_sets_without_history": q_asof_no_history,
    "asof_regression_targets": q_asof_regression,
    "asof_sets_forget_nothing": q_asof_forget_no,
    "asof_sets_forget_nothing_all_days": q_asof_forget_no_all,
    "disk_metadata": q_metadata,
    "disk_metadata_upsert": q_metadata_merge,
    "drop_rows_after_failure": q_drop_after_failure,
    "failed_disk_union": q_failed_disks,
}
ORACLE = {
    "label_interval_window": f"""WITH {_FD} SELECT d.disk, d.day, (count(f)>0)::BIGINT AS label,
      round(coalesce(1.0::DOUBLE-(max(f)-d.day)/{A + 1}.0::DOUBLE,0.0::DOUBLE),4)+0.0::DOUBLE AS target
      FROM daily d LEFT JOIN fl ON fl.disk=d.disk AND f BETWEEN d.day AND d.day+{A} GROUP BY d.disk, d.day""",
    "label_interval_join": f"""WITH {daily_sql()}, {_F1} SELECT d.disk, d.day, coalesce(fail_day BETWEEN d.day AND d.day+{A},false)::BIGINT AS label
      FROM daily d LEFT JOIN ff USING (disk)""",
    "asof_train_test_sets": f"WITH {_FD} SELECT asof_day, disk, day, split, label FROM st",
    "asof_imbalance_ratio": f"""WITH {_FD} SELECT asof_day, count(*) FILTER (label=0) AS negatives, count(*) FILTER (label=1) AS positives,
      CASE WHEN count(*) FILTER (label=1)=0 THEN 1000.0::DOUBLE ELSE round(count(*) FILTER (label=0)/(count(*) FILTER (label=1))::DOUBLE,4)+0.0::DOUBLE END AS ratio
      FROM st GROUP BY asof_day""",
    "asof_sets_without_history": f"""WITH {_FD} SELECT asof_day, split, count(*) AS n, sum(label)::BIGINT AS positives FROM st
      WHERE split='test' OR failure=1 GROUP BY ALL""",
    "asof_regression_targets": f"WITH {_FD} SELECT asof_day, count(*) AS n, round(sum(target),4)+0.0::DOUBLE AS target_sum FROM st GROUP BY asof_day",
    "asof_sets_forget_nothing": f"""WITH {daily_sql()}, cal AS (SELECT unnest(generate_series(DATE '2024-01-25', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS asof_day),
      fl AS (SELECT disk, day AS f FROM daily WHERE failure=1)
      SELECT asof_day, count(*) AS n, sum((SELECT count(*)>0 FROM fl WHERE fl.disk=d.disk AND fl.f BETWEEN d.day AND d.day+{A} AND fl.f<=c.asof_day)::BIGINT)::BIGINT AS positives
      FROM daily d JOIN cal c ON d.day<=c.asof_day GROUP BY asof_day""",
    "asof_sets_forget_nothing_all_days": f"""WITH {daily_sql()}, cal AS (SELECT DISTINCT day AS asof_day FROM daily), fl AS (SELECT disk, day AS f FROM daily WHERE failure=1)
      SELECT asof_day, count(*) AS n, sum((SELECT count(*)>0 FROM fl WHERE fl.disk=d.disk AND fl.f BETWEEN d.day AND d.day+{A} AND fl.f<=c.asof_day)::BIGINT)::BIGINT AS positives
      FROM daily d JOIN cal c ON d.day<=c.asof_day GROUP BY asof_day""",
    "disk_metadata": f"""WITH {daily_sql()} SELECT disk, model, count(*) AS collect_days, min(day) AS start_date, min(day) FILTER (failure=1) AS failed_date
      FROM daily GROUP BY disk, model""",
    "drop_rows_after_failure": f"""WITH {daily_sql()}, {_F1} SELECT d.disk, d.day, coalesce(fail_day=d.day,false)::BIGINT AS failure
      FROM daily d LEFT JOIN ff USING (disk) WHERE fail_day IS NULL OR d.day<=fail_day""",
    "failed_disk_union": f"WITH {daily_sql()} SELECT DISTINCT disk FROM daily WHERE failure=1",
}
ORACLE["disk_metadata_upsert"] = ORACLE["disk_metadata"]
