"""Queries whose days follow the table: the same events, moved to other days, give the same rows on the moved days."""
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

DAYS = 400  # over a leap day, into another year


@pytest.fixture(scope="module")
def moved(spark, sf, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("moved"))
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {DAYS} DAYS")).write.parquet(f"{out}/events.parquet")
    return out


def rows(spark, sf, name, days=()):
    df = entry.queries()[name](spark, sf)
    return sorted(tuple(v - timedelta(days=DAYS) if c in days else v for c, v in zip(df.columns, r)) for r in df.fillna(-1.0).collect())


@pytest.mark.parametrize("name", ["delay_trace", "delay_trace_exact_queue", "delay_trace_regression", "vote_threshold_grid", "mean_daily_metrics"])
def test_evaluation_days_follow_the_table(spark, sf, moved, name):
    want = rows(spark, sf, name)
    assert want and rows(spark, moved, name, ("eval_day", "source_day")) == want


ASOF = ["asof_train_test_sets", "asof_imbalance_ratio", "asof_sets_without_history", "asof_regression_targets", "asof_sets_forget_nothing", "asof_sets_partitioned"]


@pytest.mark.parametrize("name", ASOF)
def test_asof_days_follow_the_table(spark, sf, moved, name):
    want = rows(spark, sf, name)
    assert want and rows(spark, moved, name, ("asof_day", "day")) == want


def test_forgetting_nothing_reports_every_day(spark, sf):
    assert len(rows(spark, sf, "asof_sets_forget_nothing_all_days")) == 30


def test_forest_of_every_day(spark, sf):
    got = rows(spark, sf, "forest_per_day")
    assert len(got) == 30 and got[0][2] == 0  # nothing to train on before the first day
    assert all(n == judged for _, n, judged in got[1:])
