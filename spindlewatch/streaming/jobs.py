"""Structured Streaming jobs: daily ingestion, sliding windows, delayed labels, late data and stateful drift detection."""
from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spindlewatch.functions.scalars import safe_double
from spindlewatch.operators import labels
from spindlewatch.operators.drift import METHODS


def ingest_days(stream: DataFrame, store: str, out: str, checkpoint: str, window_days: int = 30, negative_days: int = 7, label_days: int = 20):
    """Day-at-a-time ingestion: every micro-batch stores its rows and writes the as-of sets of its days.

    The stored table is the state, partitioned by day and batch: a repeated batch overwrites its own rows only, so a day may come in
    several batches and a restart gives the same result. All as-of days that the rows of a batch can reach are written again.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        first, last = rows.agg(F.min("day"), F.max("day")).first()
        if first is not None:
            rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(store)
            stored = spark.read.schema(rows.schema.add("batch", "long")).parquet(store).drop("batch")
            end = stored.where(F.col("day") <= F.date_add(F.lit(last), window_days)).agg(F.max("day")).first()[0]
            history = stored.where((F.col("day") >= F.date_sub(F.lit(first), window_days - 1)) & (F.col("day") <= F.lit(end)))
            sets = labels.asof_sets(history, window_days, negative_days, label_days, start=first, end=end)
            sets.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("asof_day", "split").parquet(out)
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sliding_windows(stream: DataFrame, features: list[str], time: str = "ts", window_days: int = 30, late: str = "2 days") -> DataFrame:
    """Window rows per disk and day in the shape the window statistics read (``points``, ``n_rows``, ``start_day``).

    ``late`` bounds how long a window waits for data; the state of a window is the disk's rows in it.
    """
    vals = F.array(*[safe_double(F.col(f), finite=True) for f in features])
    point = F.struct(F.unix_date(F.to_date(time)).alias("d"), vals.alias("x"))
    grouped = (
        stream.withWatermark(time, late)
        .groupBy("disk", F.window(time, f"{window_days} days", "1 day").alias("w"))
        .agg(F.array_sort(F.collect_list(point)).alias("points"), F.max(time).alias("_last"))
    )
    # a window is reported for the disk's own last day only, like one window per row
    own = grouped.where(F.to_date("_last") == F.date_sub(F.to_date("w.end"), 1))
    return own.select("disk", F.to_date("_last").alias("day"), "points", F.size("points").alias("n_rows"),
                      F.date_from_unix_date(F.get("points", F.lit(0)).d).alias("start_day"), F.lit(0).cast("bigint").alias("_tile"))


def delayed_labels(predictions: DataFrame, failures: DataFrame, wait_days: int, late: str = "1 day") -> DataFrame:
    """Left join of two streams: a prediction (disk, ts) waits up to ``wait_days`` for a failure (disk, fail_ts) of its disk."""
    p = predictions.withWatermark("ts", late).alias("p")
    f = failures.withWatermark("fail_ts", late).alias("f")
    near = (F.col("f.fail_ts") >= F.col("p.ts")) & (F.col("f.fail_ts") <= F.col("p.ts") + F.expr(f"INTERVAL {wait_days} DAYS"))
    joined = p.join(f, (F.col("p.disk") == F.col("f.disk")) & near, "left")
    return joined.select("p.*", "f.fail_ts", F.col("f.fail_ts").isNotNull().cast("int").alias("true_class"))


def drop_late_duplicates(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "2 days") -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def detect_drift_stream(stream: DataFrame, key: str, order: str, value: str, method: str = "ddm", **params) -> DataFrame:
    """Drift detection with one detector per key in the state store; rows of a micro-batch are taken in ``order``."""
    types = dict(stream.dtypes)
    schema = f"{key} {types[key]}, {order} {types[order]}, {value} double, estimation double, warning boolean, change boolean"

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        detector = pickle.loads(state.get[0]) if state.exists else METHODS[method](**params)
        rows = pd.concat(list(batches)).sort_values(order)
        out = [detector.update(x) for x in rows[value]]
        state.update((pickle.dumps(detector),))
        flags = pd.DataFrame(out, columns=["estimation", "warning", "change"], index=rows.index)
        yield pd.concat([rows[[key, order, value]], flags], axis=1)

    base = stream.select(key, order, F.col(value).cast("double").alias(value))
    return base.groupBy(key).applyInPandasWithState(fold, schema, "detector binary", "append", GroupStateTimeout.NoTimeout)


def transfer_phase(day: Column, target_start: str, train_start: str) -> Column:
    """Phase of a transfer run: source only, then testing on the target, then testing and training on it."""
    return F.when(day < F.lit(target_start).cast("date"), "source").when(day < F.lit(train_start).cast("date"), "target_test").otherwise("target_test_train")


def run_to_table(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is available into a table and reads it back."""
    spark = df.sparkSession
    query = df.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start(f"{folder}/table")
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/table")


def table_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
