"""Labels as of a day, and the training sets that were known on that day."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindlewatch.functions.ordered import overlap_tiles
from spindlewatch.operators.windows import TILE_DAYS


def with_fail_days(daily: DataFrame, label_days: int, disk: str = "disk", day: str = "day", failure: str = "failure") -> DataFrame:
    """Adds ``fail_days``: the disk's failure days within the next ``label_days`` days (at most label_days + 1 entries).

    A forward range frame over the table itself replaces the interval join with a failure table: one shuffle by (disk, tile).
    """
    base = daily.withColumn("_ahead", -F.unix_date(day))
    tiled = overlap_tiles(base, F.col("_ahead"), TILE_DAYS, label_days)
    frame = Window.partitionBy(disk, "_tile").orderBy("_ahead").rangeBetween(-label_days, 0)
    hits = F.array_sort(F.collect_set(F.when(F.col(failure) == 1, F.col(day))).over(frame))
    return tiled.withColumn("fail_days", hits).where("_own").drop("_own", "_tile", "_ahead")


def label_asof(asof: Column, fail_days: Column) -> Column:
    """1 if one of the coming failures was already seen on ``asof``."""
    return F.exists(fail_days, lambda f: f <= asof).cast("int")


def target_asof(asof: Column, fail_days: Column, day: Column, label_days: int) -> Column:
    """Regression target as of a day: 1 on the failure day, falling linearly before it; the latest seen failure counts."""
    seen = F.array_max(F.filter(fail_days, lambda f: f <= asof))
    return F.coalesce(1.0 - F.datediff(seen, day) / F.lit(label_days + 1.0), F.lit(0.0))


def label_with_failures(
    daily: DataFrame, failures: DataFrame, label_days: int, disk: str = "disk", day: str = "day", fail_day: str = "fail_day"
) -> DataFrame:
    """Interval join with a separate failure table: label 1 for f - label_days <= day <= f.

    The interval is turned into an equi-join on (disk, day): each failure expands to its label_days + 1 days first.
    """
    spread = failures.select(
        F.col(disk), F.explode(F.sequence(F.date_sub(fail_day, label_days), F.col(fail_day))).alias(day), F.lit(1).alias("_hit")
    ).distinct()
    return daily.join(spread, [disk, day], "left").withColumn("label", F.coalesce(F.col("_hit"), F.lit(0))).drop("_hit")


def asof_sets(
    daily: DataFrame,
    window_days: int = 30,
    negative_days: int = 7,
    label_days: int = 20,
    start=None,
    end=None,
    keep_history: bool = True,
    forget: bool = True,
    regression: bool = False,
    disk: str = "disk",
    day: str = "day",
) -> DataFrame:
    """Rows of every as-of day's set: ``asof_day``, ``split`` (test on the day itself, else train) and ``label``.

    Positives stay ``window_days`` days, negatives the newest ``negative_days`` (today included). Without ``keep_history`` only
    rows that failed on their own day stay; without ``forget`` rows never leave. ``start``/``end`` bound the as-of days.
    """
    df = with_fail_days(daily, label_days, disk, day)
    first = F.col(day) if start is None else F.greatest(F.col(day), F.lit(start).cast("date"))
    life = F.date_add(F.col(day), window_days - 1) if forget else F.lit(end).cast("date")
    last = life if end is None else F.least(life, F.lit(end).cast("date"))
    # a row reaches at most window_days as-of days
    df = df.where(first <= last).withColumn("asof_day", F.explode(F.sequence(first, last)))
    value = target_asof(F.col("asof_day"), F.col("fail_days"), F.col(day), label_days) if regression else label_asof(F.col("asof_day"), F.col("fail_days"))
    df = df.withColumn("label", value)
    today = F.col("asof_day") == F.col(day)
    fresh = F.col(day) > F.date_sub(F.col("asof_day"), negative_days)
    keep = (F.col("label") > 0) | fresh if forget else F.lit(True)
    if not keep_history:
        keep = keep & (F.col("failure") == 1)
    return df.where(today | keep).withColumn("split", F.when(today, "test").otherwise("train")).drop("fail_days")


def imbalance(sets: DataFrame, by: str = "asof_day") -> DataFrame:
    """Negatives, positives and their ratio per set; 1000 when there is no positive."""
    neg, pos = F.count_if(F.col("label") == 0), F.count_if(F.col("label") > 0)
    counted = sets.groupBy(by).agg(neg.alias("negatives"), pos.alias("positives"))
    return counted.withColumn("ratio", F.coalesce(F.try_divide(F.col("negatives"), F.col("positives")), F.lit(1000.0)))


def disk_metadata(daily: DataFrame, disk: str = "disk", day: str = "day") -> DataFrame:
    """First day, number of days and first failure of every disk."""
    return daily.groupBy(disk, "model").agg(
        F.count(F.lit(1)).alias("collect_days"),
        F.min(day).alias("start_date"),
        F.min(F.when(F.col("failure") == 1, F.col(day))).alias("failed_date"),
    )


def merge_metadata(old: DataFrame, new: DataFrame, disk: str = "disk") -> DataFrame:
    """Upsert: adds the days of a new batch to the stored metadata."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.groupBy(disk, "model").agg(
        F.sum("collect_days").alias("collect_days"), F.min("start_date").alias("start_date"), F.min("failed_date").alias("failed_date")
    )


def drop_after_failure(daily: DataFrame, failures: DataFrame, disk: str = "disk", day: str = "day", fail_day: str = "fail_day") -> DataFrame:
    """Removes rows of a disk after its first failure day; a failure without a day removes nothing."""
    first = failures.groupBy(disk).agg(F.min(fail_day).alias("_f"))
    joined = daily.join(first, disk, "left")
    return joined.where(F.col("_f").isNull() | (F.col("_f") >= F.col(day))).drop("_f")


def mark_failures(daily: DataFrame, failures: DataFrame, disk: str = "disk", day: str = "day", fail_day: str = "fail_day") -> DataFrame:
    """Sets ``failure`` to 1 on the day named in the failure table."""
    marks = failures.select(disk, F.col(fail_day).alias(day), F.lit(1).alias("_f")).distinct()
    return daily.drop("failure").join(marks, [disk, day], "left").withColumn("failure", F.coalesce("_f", F.lit(0))).drop("_f")


def failed_disks(old: DataFrame, new: DataFrame, disk: str = "disk") -> DataFrame:
    """Append and de-duplicate the list of failed disks."""
    return old.select(disk).union(new.select(disk)).dropDuplicates([disk])
