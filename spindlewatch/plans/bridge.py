"""Device telemetry derived from the driver tables, once as DataFrames and once as SQL text for the comparison engine."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# sensor name -> event type it is averaged from
SENSORS = {
    "smart_5_raw": "error",
    "smart_199_raw": "click",
    "smart_194_raw": "view",
    "smart_192_raw": "purchase",
    "smart_9_raw": "signup",
}
FEATURES = list(SENSORS)
MODELS = ["hi7", "ST3000DM001", "WDC WD30EFRX", "mc1"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily snapshots: one row per disk and day with five sensors and a failure flag (D1)."""
    ev = table(spark, sf, "events").select("ts", "user_id", "event_type", "value")
    cents = F.round(F.col("value") * 100).cast("bigint")
    hit = lambda t: F.col("event_type") == t
    agg = ev.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        *[F.sum(F.when(hit(t), cents)).alias(f"_s_{s}") for s, t in SENSORS.items()],
        *[F.count(F.when(hit(t), 1)).alias(f"_n_{s}") for s, t in SENSORS.items()],
    )
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("user_id") % 4 + 1).cast("int"))
    mean = lambda s: F.try_divide(F.col(f"_s_{s}"), F.lit(100.0) * F.col(f"_n_{s}")).alias(s)
    return agg.select(
        F.col("user_id").alias("disk_no"),
        F.concat(F.lit("disk-"), F.col("user_id").cast("string")).alias("disk"),
        "day",
        model.alias("model"),
        (F.coalesce(F.col("_s_smart_5_raw"), F.lit(0)) > 20000).cast("int").alias("failure"),
        *[mean(s) for s in SENSORS],
    )


def day_range(spark: SparkSession, sf: str) -> tuple:
    """First and last day of the daily table, as dates; none of an empty one."""
    return table(spark, sf, "events").select(F.to_date("ts").alias("day")).agg(F.min("day"), F.max("day")).first()


_MODEL_SQL = "CASE user_id % 4 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODELS)) + " END"


def daily_sql() -> str:
    """CTE ``daily``; queries open with ``WITH`` + this."""
    parts = []
    for s, t in SENSORS.items():
        parts.append(
            f"sum(round(value*100)::BIGINT) FILTER (event_type='{t}') / (100.0::DOUBLE * nullif(count(*) FILTER (event_type='{t}'),0)) AS {s}"
        )
    return f"""daily AS (
  SELECT user_id AS disk_no, 'disk-' || user_id AS disk, CAST(ts AS DATE) AS day, {_MODEL_SQL} AS model,
    CASE WHEN coalesce(sum(round(value*100)::BIGINT) FILTER (event_type='error'),0) > 20000 THEN 1 ELSE 0 END AS failure,
    {', '.join(parts)}
  FROM events GROUP BY user_id, CAST(ts AS DATE))"""
