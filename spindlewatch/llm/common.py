"""Helpers shared by the operators of this folder."""
from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewatch.session import work_dir

ARROW_BYTES = 8 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches close at 8 MB, so long texts can't fill a Python worker. A smaller setting of the session stays."""
    set_now = spark.conf.get(BATCH_KEY, str(ARROW_BYTES))
    if not set_now.isdigit() or int(set_now) > ARROW_BYTES:
        spark.conf.set(BATCH_KEY, str(ARROW_BYTES))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet below the shared folder of spark.checkpoint.dir and reads it back; later plans start from there."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


NO_ESTIMATE = 1 << 60


def plan_bytes(df: DataFrame, text: str = "text") -> int:
    """Catalyst's estimate of the size of df, from file sizes, without a job; where it has none, the bytes of the texts are added up."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < NO_ESTIMATE else int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def lower_ascii(text: str | Column) -> Column:
    """Null counts as empty; only A-Z change."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, UPPER.lower())


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column of an Arrow batch and the offsets of its rows, without copying; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def texts(column: pa.Array) -> Iterator[bytes]:
    """The rows of a string column as UTF-8 bytes; null counts as empty."""
    data, offsets = utf8(column)
    view = data[offsets[0] : offsets[-1]].tobytes()
    offsets = offsets - offsets[0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield view[a:b]


#: Documents of a part are numbered in 16 bits.
PART_ROWS = 65_535


def parts(batch: pa.RecordBatch, text: int, part_bytes: int, part_rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most part_rows rows, which close when their texts (column number text) reach part_bytes."""
    _, offsets = utf8(batch.column(text))
    a = 0
    while a < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[a] + part_bytes, side="left"))
        end = min(max(end, a + 1), a + part_rows, batch.num_rows)
        yield batch.slice(a, end - a)
        a = end


def trim() -> None:
    """Gives freed memory back to the system; a Python worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if give_back is not None:
        give_back(0)


def worker_memory(owner: str, key: tuple, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task for one operator: vocabularies and bounded caches, never results.

    A worker outlives the stages of a pipeline, so what another operator kept is given up first.
    """
    held = sys.modules.setdefault("_spindlewatch_worker", types.ModuleType("_spindlewatch_worker")).__dict__.setdefault("held", {})
    if held and owner not in held:
        held.clear()
        trim()
    own = held.setdefault(owner, {})
    if key not in own:
        own[key] = make()
    return own[key]


def rank_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds name, the 0-based place of a row in the whole order: ranges are numbered apart and one offset per range is added.

    df must be stored or small, as its ranges are stored before they are numbered.
    """
    from pyspark.sql import Window

    cols = df.columns
    ranged = stage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").count()
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_inner", inner).join(before.select("_range", "_before"), "_range").select(*cols, (F.col("_before") + F.col("_inner")).cast("long").alias(name))
