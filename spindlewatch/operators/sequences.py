"""Operators that read earlier rows: lagged labels, imputation, running weights."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindlewatch.functions.ordered import previous, running, running_extremes


def lagged_labels(df: DataFrame, key: str, label: str, lags: int, by: str) -> DataFrame:
    """The last ``lags`` labels of a group as extra features."""
    w = Window.partitionBy(by).orderBy(key)
    return df.withColumns({f"{label}_lag{k}": F.lag(label, k).over(w) for k in range(1, lags + 1)})


def no_change(df: DataFrame, key: str, label: str, default: int = 0) -> DataFrame:
    """Predicts the previous row's class."""
    return previous(df, key, label, "prediction", default)


def impute_numeric(df: DataFrame, key: str, column: str, strategy: str, constant: float = 0.0, ranges: int | None = None) -> DataFrame:
    """Replaces nulls by what the rows before say: ``last``, ``mean``, ``max``, ``min`` (all starting from 0) or ``constant``."""
    x = F.col(column)
    if strategy == "constant":
        return df.withColumn(column, F.coalesce(x, F.lit(constant)))
    if strategy == "mean":
        df = running(df, key, {"_s": F.coalesce(x, F.lit(0.0)), "_n": x.isNotNull().cast("bigint")}, exclusive=True, ranges=ranges)
        return df.withColumn(column, F.coalesce(x, F.try_divide(F.col("_s"), F.col("_n")), F.lit(0.0))).drop("_s", "_n")
    df = running_extremes(df, key, {"_v": (strategy, x)}, ranges=ranges)
    zero = F.lit(0.0)
    value = {"last": F.coalesce("_v", zero), "max": F.greatest("_v", zero), "min": F.least("_v", zero)}[strategy]
    return df.withColumn(column, F.coalesce(x, value)).drop("_v")


def impute_nominal(df: DataFrame, key: str, column: str, strategy: str, values: list[str] = (), ranges: int | None = None) -> DataFrame:
    """Replaces nulls by the last value or the most frequent one so far (of the known ``values``; the first on ties)."""
    x = F.col(column)
    if strategy == "last":
        df = running_extremes(df, key, {"_v": ("last", x)}, ranges=ranges)
        return df.withColumn(column, F.coalesce(x, F.col("_v"))).drop("_v")
    counts = {f"_c{i}": (x == v).cast("bigint") for i, v in enumerate(values)}
    df = running(df, key, {k: F.coalesce(v, F.lit(0)) for k, v in counts.items()}, exclusive=True, ranges=ranges)
    best = F.array_max(F.array(*[F.struct(F.col(f"_c{i}").alias("n"), F.lit(-i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(values)]))
    return df.withColumn(column, F.coalesce(x, F.when(best.n > 0, best.v))).drop(*counts)


def source_weight(df: DataFrame, key: str, error: Column, w: float, ranges: int | None = None) -> DataFrame:
    """Weight of the source model: w to the number of its errors before the row."""
    df = running(df, key, {"_e": error.cast("bigint")}, exclusive=True, ranges=ranges)
    return df.withColumn("theta", F.pow(F.lit(w), F.col("_e"))).drop("_e")
