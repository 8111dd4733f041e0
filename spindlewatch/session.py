"""Session helpers shared by tests, bench and jobs."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "8", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own configuration."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spindlewatch")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPINDLEWATCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for tables and stream state of one run."""
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="spindlewatch-work-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder the cluster names; a local session without one gets its own folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured is not None:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spindlewatch-cp-"))
    return df.checkpoint(eager=True)


def checked_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast only after counting that the side has at most ``max_rows`` rows; otherwise leave the join to Catalyst."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
