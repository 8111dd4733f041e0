"""Readers for daily snapshots, label tables, text windows, caches, traces, metric tables and evaluation logs."""
from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewatch.functions.names import resolve_columns, sensor_columns
from spindlewatch.functions.scalars import parse_day, safe_double
from spindlewatch.operators.windows import stage

# Metric names of an evaluation log and their short column names.
CLASSIFICATION_METRICS = {
    "classified instances": "clf_insts",
    "classifications correct (percent)": "clf_corrct",
    "Kappa Statistic (percent)": "Kappa",
    "Kappa Temporal Statistic (percent)": "Kappa_temp",
    "Kappa M Statistic (percent)": "Kappa_M",
    "TP": "TP",
    "FP": "FP",
    "TN": "TN",
    "FN": "FN",
    "False Alarm Rate (percent)": "FAR",
    "Average Days before Failure": "Days",
    "F1 Score (percent)": "F1_score",
    "F1 Score for class 0 (percent)": "F1_score_c0",
    "F1 Score for class 1 (percent)": "F1_score_c1",
    "Precision (percent)": "Precision",
    "Precision for class 0 (percent)": "Precision_c0",
    "Precision for class 1 (percent)": "Precision_c1",
    "Recall (percent)": "Recall",
    "Recall for class 0 (percent)": "Recall_c0",
    "Recall for class 1 (percent)": "Recall_c1",
}
REGRESSION_METRICS = {
    "classified instances": "clf_insts",
    "mean absolute error": "mean_abs_err",
    "root mean squared error": "sqr_mean_err",
    "relative mean absolute error": "rel_mean_abs_err",
    "relative root mean squared error": "rel_sqr_mean_err",
    "mean absolute error for failures": "mean_err_failed",
    "root mean squared error for failures": "sqr_err_failed",
    "average error days before failures": "avg_err_days",
    "num failures": "TP",
}


def day_files(path: str, start: str, days: int, date_format: str = "%Y-%m-%d") -> list[str]:
    """One file per day: the scan of a day range is a list of paths."""
    first = datetime.date.fromisoformat(start)
    return [f"{path.rstrip('/')}/{(first + datetime.timedelta(days=i)).strftime(date_format)}.csv" for i in range(days)]


def _by_header(spark: SparkSession, files: list[str], options: dict) -> DataFrame:
    """Reads files of equal header together and unites the groups by name; one line per file is looked at while planning."""
    groups: dict[tuple, list[str]] = {}
    for f in files:
        groups.setdefault(tuple(spark.read.options(header=True).csv(f).columns), []).append(f)
    out = None
    for columns, members in groups.items():
        schema = ", ".join(f"`{c}` string" for c in columns)
        part = spark.read.schema(schema).options(header=True, **options).csv(members)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_smart_daily(
    spark: SparkSession, path: str, start: str, days: int, date_format: str = "%Y-%m-%d", models: list[str] | None = None, columns: list[str] | None = None
) -> DataFrame:
    """HDD snapshots ``YYYY-MM-DD.csv``: disk, day, model, failure and sensors as doubles under canonical names."""
    raw = _by_header(spark, day_files(path, start, days, date_format), {})
    if models:
        raw = raw.where(F.col("model").isin(models))
    wanted = {c: s for c, s in resolve_columns(sensor_columns(raw.columns)).items() if columns is None or c in columns}
    return raw.select(
        F.col("serial_number").alias("disk"), parse_day(F.col("date")).alias("day"), "model", F.coalesce(F.col("failure").try_cast("int"), F.lit(0)).alias("failure"),
        *[safe_double(F.col(f"`{s}`")).alias(c) for c, s in wanted.items()],
    )


def read_ssd_daily(
    spark: SparkSession, path: str, start: str, days: int, failures: DataFrame | None = None, models: list[str] | None = None, columns: list[str] | None = None
) -> DataFrame:
    """SSD snapshots ``YYYYMMDD.csv`` with ``\\N`` for null: rows with a null are dropped, rows after a disk's failure too."""
    from spindlewatch.operators.labels import drop_after_failure, mark_failures

    raw = _by_header(spark, day_files(path, start, days, "%Y%m%d"), {"nullValue": "\\N"})
    if models:
        raw = raw.where(F.col("model").isin(models))
    wanted = {c: s for c, s in resolve_columns(sensor_columns(raw.columns)).items() if columns is None or c in columns}
    df = raw.select(F.concat(F.lit("s"), "disk_id").alias("disk"), parse_day(F.col("ds")).alias("day"), "model",
                    *[safe_double(F.col(f"`{s}`")).alias(c) for c, s in wanted.items()]).dropna("any")
    if failures is None:
        return df.withColumn("failure", F.lit(0))
    return mark_failures(drop_after_failure(df.withColumn("failure", F.lit(0)), failures), failures)


def read_failures(spark: SparkSession, path: str, models: list[str] | None = None) -> DataFrame:
    """SSD failure labels: disk, model and the day of failure."""
    raw = spark.read.schema("disk_id string, model string, failure_time string").csv(path, header=True)
    if models:
        raw = raw.where(F.col("model").isin(models))
    return raw.select(F.concat(F.lit("s"), "disk_id").alias("disk"), "model", F.to_date(F.col("failure_time").try_cast("timestamp")).alias("fail_day"))


def read_window_text(spark: SparkSession, path: str, max_windows: int | None = None, fmt: str = "json") -> DataFrame:
    schema = "disk_id string, window_end_time string, summary_text string, summary_schema string, rule_profile_id string, rule_medium string, rule_vendor string, rule_model_key string"
    df = spark.read.schema(schema).format(fmt).load(path)
    df = df.withColumnsRenamed({"disk_id": "disk"}).withColumn("day", parse_day(F.col("window_end_time")))
    return df if max_windows is None else df.limit(max_windows)


# Fields of a cache row besides its vector.
CACHE_FIELDS = {
    "parse_source": "string", "root_cause": "string", "hardness": "double", "near_positive": "boolean", "label_noise_risk": "double",
    "risk_hint": "double", "confidence": "double", "root_cause_pred": "string", "llm_q_score": "double", "llm_rule_match": "boolean",
    "llm_rule_top_cause": "string", "llm_rule_top_score": "double", "llm_mapped_event_ratio": "double", "llm_event_count": "int",
    "llm_mapped_event_count": "int",
}


def read_cache(spark: SparkSession, path: str, dim: int | None = None, fmt: str = "json") -> DataFrame:
    """A vector cache with one array column ``z`` of ``dim`` doubles, from a ``z_llm`` list or from ``z_llm_i`` columns.

    Without ``dim`` it is the longest list, or one more than the largest i of the columns.
    """
    raw = spark.read.format(fmt).load(path) if fmt != "json" else spark.read.option("primitivesAsString", False).json(path)
    if dim is None and "z_llm" in raw.columns:
        dim = raw.agg(F.max(F.size("z_llm"))).first()[0] or 0
    elif dim is None:
        dim = 1 + max((int(c.removeprefix("z_llm_")) for c in raw.columns if re.fullmatch(r"z_llm_\d+", c)), default=-1)
    if dim == 0:
        z = F.array().cast("array<double>")
    elif "z_llm" in raw.columns:
        z = F.expr(f"transform(sequence(0, {dim - 1}), i -> coalesce(cast(get(z_llm, i) AS double), 0.0D))")
    else:
        z = F.array(*[F.coalesce(safe_double(F.col(f"z_llm_{i}")), F.lit(0.0)) if f"z_llm_{i}" in raw.columns else F.lit(0.0) for i in range(dim)])
    kept = [F.col(c).cast(t).alias(c) for c, t in CACHE_FIELDS.items() if c in raw.columns]
    return raw.select(F.col("disk_id").cast("string").alias("disk"), parse_day(F.col("window_end_time").cast("string")).alias("day"), z.alias("z"), *kept)


def read_eval_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily metric table; rows without a date are dropped, metrics are doubles."""
    raw = spark.read.csv(path, header=True)
    return raw.where(F.col("date").isNotNull()).select("date", *[safe_double(F.col(f"`{c}`")).alias(c) for c in raw.columns if c != "date"])


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Delay trace; a missing source day is the evaluation day, unreadable classes are 0."""
    raw = spark.read.csv(path, header=True)
    df = stage(raw, {"source_day": "coalesce(nullif(nullif(trim(source_day), ''), 'nan'), eval_day)"})
    number = lambda c: F.coalesce(F.col(c).try_cast("double").cast("int"), F.lit(0)).alias(c)
    rest = [safe_double(F.col(c)).alias(c) for c in ("vote_0", "vote_1", "threshold") if c in raw.columns]
    return df.select(parse_day(F.col("eval_day")).alias("eval_day"), parse_day(F.col("source_day")).alias("source_day"), F.col("serial_number").alias("disk"),
                     number("true_class"), number("pred_class"), *rest)


def read_points(spark: SparkSession, path: str, dims: int, has_class: bool = False, streaming: bool = False, header: bool = False) -> DataFrame:
    """Numeric points from CSV, with a class as last column if there is one; as a stream or a table."""
    schema = ", ".join(f"x{i} double" for i in range(dims)) + (", class int" if has_class else "")
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).option("header", header).csv(path)


def read_ratings(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(user, item, rating) from separated text; further columns are ignored."""
    return spark.read.schema("user int, item int, rating double").option("sep", sep).option("mode", "PERMISSIVE").csv(path)


def read_evaluation_log(spark: SparkSession, path: str, regression: bool = False) -> DataFrame:
    """Metric table from text logs: one row per day with ``g_`` (global) and ``l_`` (local) columns.

    A day's block begins at a line that begins with a full date. A file is one log, read whole and cut at those lines.
    """
    names = REGRESSION_METRICS if regression else CLASSIFICATION_METRICS
    logs = spark.read.text(path, wholetext=True)
    marked = F.regexp_replace("value", r"(?m)^(\d{4}-\d{2}-\d{2})\b", "\u0001$1")
    blocks = logs.select(F.explode(F.split(marked, "\u0001")).alias("v"))
    df = blocks.withColumn("date", parse_day(F.regexp_extract("v", r"^(\d{4}-\d{2}-\d{2})", 1))).where("date IS NOT NULL")
    df = df.withColumns(
        {
            "g": F.regexp_extract("v", r"(?s)Global Measurements\s*\n(.*?)(?:Local Measurements|$)", 1),
            "l": F.regexp_extract("v", r"(?s)Local Measurements\s*\n(.*?)(?:Model measurements|$)", 1),
        }
    )
    pick = lambda side, name: safe_double(F.regexp_extract(side, rf"(?m)^\s*{re.escape(name)}\s*[:=]\s*(\S+)\s*$", 1))
    return df.select("date", *[pick(side, n).alias(f"{side}_{short}") for side in ("g", "l") for n, short in names.items()])
