"""Writers: training sets by day, text and cache rows, resumable and checked appends, streams to files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sets(sets: DataFrame, path: str) -> None:
    """As-of sets partitioned by day and split. A rebalance keeps files even: hot days are split, small ones joined."""
    even = sets.hint("rebalance", "asof_day", "split")
    even.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("asof_day", "split").parquet(path)


def write_rows(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    df.write.mode(mode).format(fmt).save(path)


def cache_rows(cache: DataFrame, as_columns: bool = False, dim: int = 0) -> DataFrame:
    """Cache rows for an exchange file: key names and the vector as ``z_llm`` or as ``z_llm_i`` columns."""
    z = [F.get("z", F.lit(i)).alias(f"z_llm_{i}") for i in range(dim)] if as_columns else [F.col("z").alias("z_llm")]
    rest = [c for c in cache.columns if c not in ("disk", "day", "z")]
    return cache.select(F.col("disk").alias("disk_id"), F.date_format("day", "yyyy-MM-dd").alias("window_end_time"), *z, *rest)


def append_missing(df: DataFrame, path: str, keys: list[str], fmt: str = "parquet") -> None:
    """Resumable append: keys that are already stored are skipped."""
    spark = df.sparkSession
    try:
        done = spark.read.format(fmt).load(path).select(*keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    todo = df if done is None else df.join(done, keys, "left_anti")
    todo.write.mode("append").format(fmt).save(path)


def append_checked(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append that refuses other columns than the stored ones."""
    have = df.sparkSession.read.format(fmt).load(path).schema
    want = [(f.name, f.dataType) for f in have.fields]
    if [(f.name, f.dataType) for f in df.schema.fields] != want:
        raise ValueError(f"columns differ: {df.schema.simpleString()} instead of {have.simpleString()}")
    df.write.mode("append").format(fmt).save(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True):
    writer = df.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)


def shuffled(df: DataFrame, keys: list[str], seed: int = 1) -> DataFrame:
    """The rows in a seeded random order, kept in memory and on disk."""
    from spindlewatch.operators.sampling import uniform

    return df.orderBy(uniform(keys, seed)).persist()


def write_day_files(rows: DataFrame, path: str, day: str = "date", date_format: str = "%Y-%m-%d") -> DataFrame:
    """Writes one CSV file per day below a folder, named after the day, and returns (day, file, rows); it is written once that is computed.

    A task streams the days of its partition, one after the other; an attempt that is repeated writes the same files again. Nulls are empty.
    """
    import pyarrow as pa

    names = rows.columns
    text = rows.select(F.col(day).cast("date").alias("_day"), *[F.col(f"`{c}`").cast("string").alias(c) for c in names])

    def run(batches):
        from pyarrow import csv, fs

        store, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        store.create_dir(base, recursive=True)
        out, writer, current, n = None, None, None, 0

        def close():
            writer.close()
            out.close()
            return pa.RecordBatch.from_pylist([{"day": current, "file": f"{base}/{current.strftime(date_format)}.csv", "rows": n}], schema=pa.schema([("day", pa.date32()), ("file", pa.string()), ("rows", pa.int64())]))

        for batch in batches:
            days = batch.column(0).to_pylist()
            at = 0
            while at < len(days):
                end = at
                while end < len(days) and days[end] == days[at]:
                    end += 1
                if days[at] != current:
                    if writer is not None:
                        yield close()
                    current, n = days[at], 0
                    out = store.open_output_stream(f"{base}/{current.strftime(date_format)}.csv", compression=None)
                    writer = csv.CSVWriter(out, pa.schema([(c, pa.string()) for c in names]), write_options=csv.WriteOptions(quoting_style="needed"))
                writer.write_batch(pa.RecordBatch.from_arrays(batch.slice(at, end - at).columns[1:], names=names))
                n, at = n + end - at, end
        if writer is not None:
            yield close()

    return text.where("_day IS NOT NULL").repartition("_day").sortWithinPartitions("_day").mapInArrow(run, "day date, file string, rows long")
