"""Active learning with a budget that feeds back, by chunks and for several partitions of a stream at once.

Within a chunk the threshold stands still, so a chunk is known by the counts of its uncertainties (rounded to STEPS of one). A scan over
these small rows, one partition at a time, carries the threshold and what was spent from chunk to chunk; the rows then look up the
threshold of their chunk.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlewatch.functions.ordered import row_numbers
from spindlewatch.operators.sampling import normal, uniform
from spindlewatch.session import checked_broadcast

STEPS = 1_000
#: Uncertainties above this never fall below a threshold; thresholds stay between the two limits.
LEAST_THRESHOLD, MOST = 1e-6, 10.0
SCANNED = "part long, chunk long, threshold double, allowed boolean, asked long, seen long"


def strategies(posterior: Column, classes: int, keys: list[str], budget: float, fixed: float, seed: int) -> dict[str, tuple[Column, bool]]:
    """What is compared with the threshold, by strategy, and whether the threshold moves; a row is asked for when it lies below."""
    ask = lambda wanted: F.when(wanted, 0.0).otherwise(MOST)
    spread = 1.0 + normal(keys, seed)
    return {
        "fixed": (ask(posterior < fixed), False),
        "variable": (posterior, True),
        "randomised": (F.when(spread == 0, MOST).otherwise(posterior / spread), True),
        "selective": (ask(uniform(keys, seed, "s") < budget / (budget + F.abs(posterior - 1.0 / classes))), False),
    }


def scan(histogram: pd.DataFrame, budget: float, step: float, moves: bool, initial: int) -> pd.DataFrame:
    """Chunks of one partition in order: threshold, whether the budget allows to ask, rows asked for and seen up to the chunk's end.

    The first ``initial`` chunks are asked for whole and don't count as spent. After a chunk that the budget allows, the threshold falls by
    step for each row asked for and rises by step for each other one.
    """
    rows, threshold, spent, counted, asked, seen = [], 1.0, 0, 0, 0, 0
    for turn, (chunk, own) in enumerate(histogram.sort_values("chunk").groupby("chunk", sort=False)):
        n = int(own["n"].sum())
        here, allowed, current = n, True, threshold
        if turn >= initial:
            allowed = counted == 0 or spent / counted < budget
            here = int(own.loc[own["value"] < threshold, "n"].sum()) if allowed else 0
            spent, counted = spent + here, counted + n
            if moves and allowed:
                threshold = float(np.clip(threshold * (1 - step) ** here * (1 + step) ** (n - here), LEAST_THRESHOLD, MOST))
        else:
            current = float("inf")
        asked, seen = asked + here, seen + n
        rows.append((int(own["part"].iloc[0]), int(chunk), current, allowed, asked, seen))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SCANNED.split(", ")])


def scanner(budget: float, step: float, moves: bool, initial: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda frame: scan(frame, budget, step, moves, initial)


def with_budget(
    df: DataFrame, order: str, posterior: Column, part: Column, chunk_rows: int, strategy: str = "variable", budget: float = 0.1, fixed: float = 0.9, step: float = 0.01,
    classes: int = 2, initial: int = 0, seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """The rows with part, chunk, queried; and the scanned chunks (part, chunk, threshold, allowed, asked, seen).

    ``order`` is a unique key; chunks hold ``chunk_rows`` rows of the whole order, and a partition sees its rows of each. A null posterior
    counts as 0, the most uncertain. Uncertainties are rounded to thousandths.
    """
    value, moves = strategies(F.coalesce(posterior, F.lit(0.0)), classes, [order], budget, fixed, seed)[strategy]
    value = F.greatest(F.lit(0.0), F.least(F.lit(MOST), F.round(F.coalesce(value, F.lit(0.0)) * STEPS) / STEPS))
    rows = row_numbers(df.withColumns({"part": part.cast("bigint"), "_value": value}), order, "_n")
    rows = rows.withColumn("chunk", F.floor((F.col("_n") - 1) / F.lit(chunk_rows)).cast("bigint")).drop("_n")
    histogram = rows.groupBy("part", "chunk", F.col("_value").alias("value")).agg(F.count("*").alias("n"))
    chunks = histogram.groupBy("part").applyInPandas(scanner(budget, step, moves, initial), SCANNED)
    limits = checked_broadcast(chunks.select("part", "chunk", "threshold", "allowed"))
    queried = F.col("allowed") & (F.col("_value") < F.col("threshold"))
    return rows.join(limits, ["part", "chunk"]).withColumn("queried", queried).drop("_value", "threshold", "allowed"), chunks
