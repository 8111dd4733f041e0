"""Outliers of a sliding count window, by the neighbours each point has in the slots around it.

The order of the points is cut into slots; a window is the last ``slots`` slots, so it slides by a slot. A point lives through ``slots``
windows. What decides in each of them is how many neighbours it has in every slot that shares a window with its own: 2 * slots - 1 counts,
found in one pass. Tiles of ``slots`` slots get the slots before and after them as well, so a point is sent to three tiles, and a slot is
compared with the slots around it by one product of matrices over all dimensions.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlewatch.functions.ordered import row_numbers
from spindlewatch.operators.coresets import squared

COUNTS = "id long, slot long, before array<int>, after array<int>, estimate_share double, sample_size int"


def slotted(points: DataFrame, order: str, vector: str, slot_rows: int) -> DataFrame:
    """id, slot, vector of the points with a whole vector, numbered in the order of a unique key."""
    usable = points.where(F.col(order).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))
    numbered = row_numbers(usable.select(F.col(order).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector")), "id", "_n")
    return numbered.select("id", F.floor((F.col("_n") - 1) / F.lit(slot_rows)).cast("bigint").alias("slot"), "vector")


def neighbour_counts(rows: DataFrame, radius: float, slots: int, k: int = 0, sample: int = 0, draw: Column | None = None) -> DataFrame:
    """Per point of slotted rows: its neighbours within the radius (without itself) in its own slot and the slots before and after it.

    ``before`` counts the slots from slots - 1 back to 1 back, ``after`` its own slot and the slots - 1 after it. With a sample size, the
    share of sampled safe inliers among the slots before that are its neighbours: a safe inlier has at least k neighbours, itself
    included, from its own slot up to the one before the point's, and the ``sample`` ones with the least ``draw`` are taken.
    """
    home = F.floor(F.col("slot") / F.lit(slots)).cast("bigint")
    tiles = rows.withColumn("_draw", F.lit(0.0) if draw is None else draw).withColumn("tile", F.explode(F.array(home - 1, home, home + 1)))

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in COUNTS.split(", ")]
        frame = frame.sort_values(["slot", "id"], kind="stable")
        tile, slot = int(frame["tile"].iloc[0]), frame["slot"].to_numpy()
        own = [s for s in range(tile * slots, (tile + 1) * slots) if (slot == s).any()]
        if not own:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in names})
        ids, x, u = frame["id"].to_numpy(), np.array(frame["vector"].tolist(), float), frame["_draw"].to_numpy(float)
        first, last = own[0] - slots + 1, own[-1] + slots - 1
        begin = np.searchsorted(slot, np.arange(first, last + 2))
        at = lambda s: slice(begin[s - first], begin[s - first + 1])
        seen: dict[tuple[int, int], np.ndarray] = {}

        def near(s: int, t: int) -> np.ndarray:
            """Which points of slot t are neighbours of those of slot s."""
            found = squared(x[at(s)], x[at(t)]) <= radius * radius
            if s == t:
                np.fill_diagonal(found, False)
            return found

        def n(s: int, t: int) -> np.ndarray:
            if (s, t) not in seen:
                both = near(s, t)
                seen[s, t], seen[t, s] = both.sum(axis=1), both.sum(axis=0)
            return seen[s, t]

        out = []
        for s in own:
            size = begin[s - first + 1] - begin[s - first]
            before = np.stack([n(s, t) for t in range(s - slots + 1, s)], axis=1) if slots > 1 else np.zeros((size, 0), int)
            after = np.stack([n(s, t) for t in range(s, s + slots)], axis=1)
            share, taken = np.zeros(size), 0
            if sample:
                safe, odds = [], []
                for t in range(s - slots + 1, s):
                    if begin[t - first + 1] > begin[t - first]:
                        good = 1 + sum(n(t, v) for v in range(t, s)) >= k
                        safe.append(np.arange(at(t).start, at(t).stop)[good])
                        odds.append(u[at(t)][good])
                safe, odds = (np.concatenate(c) if c else np.zeros(0) for c in (safe, odds))
                some = safe[np.lexsort((ids[safe.astype(int)], odds))[:sample]].astype(int)
                taken = len(some)
                if taken:
                    share = (squared(x[at(s)], x[some]) <= radius * radius).sum(axis=1) / taken
            out.append(pd.DataFrame({"id": ids[at(s)], "slot": s, "before": list(before.astype(np.int32)), "after": list(after.astype(np.int32)), "estimate_share": share, "sample_size": np.int32(taken)}))
        return pd.concat(out, ignore_index=True)

    return tiles.groupBy("tile").applyInPandas(count, COUNTS)


def window_counts(counted: DataFrame, slots: int) -> DataFrame:
    """id, slot, window (the slot it ends with), neighbours: 1 for the point itself and its neighbours in that window.

    A window that begins before the first slot or would end after the last one is shorter or left out.
    """
    last = counted.agg(F.max("slot")).scalar()
    rows = counted.select("id", "slot", "before", "after", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda o: o)).alias("age", "_o")).drop("_o")
    add = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    # at age o the window has the slots from slots - 1 - o before the point's own to o after it
    back = F.when(F.col("age") < slots - 1, add(F.expr(f"slice(before, cast(age + 1 AS int), {max(1, slots - 1)})"))).otherwise(0) if slots > 1 else F.lit(0)
    rows = rows.withColumn("neighbours", 1 + back + add(F.expr("slice(after, 1, cast(age + 1 AS int))")))
    return rows.select("id", "slot", (F.col("slot") + F.col("age")).alias("window"), "age", "neighbours").where(F.col("window") <= last)


def lifetime_outliers(windows: DataFrame, k: float) -> DataFrame:
    """Per point: windows, outlier_windows (fewer than k points within the radius, itself included), first_outlier, last_outlier, least and most neighbours."""
    out = F.col("neighbours") < k
    return windows.groupBy("id").agg(
        F.count("*").alias("windows"), F.count_if(out).alias("outlier_windows"), F.min(F.when(out, F.col("window"))).alias("first_outlier"),
        F.max(F.when(out, F.col("window"))).alias("last_outlier"), F.min("neighbours").alias("least"), F.max("neighbours").alias("most"),
    )


def sampled_outliers(counted: DataFrame, slots: int, slot_rows: int, k: float) -> DataFrame:
    """id, window, exact, estimate, outlier, estimated_outlier per window of a point.

    The estimate has the point, its neighbours from its own slot on, and the share of sampled safe inliers that are its neighbours, times
    the rows of the window before its slot.
    """
    last = counted.agg(F.max("slot")).scalar()
    exact = window_counts(counted, slots).withColumnRenamed("neighbours", "exact")
    ages = counted.select("id", F.col("slot").alias("_slot"), "after", "estimate_share")
    rows = exact.join(ages, "id")
    ahead = F.aggregate(F.expr("slice(after, 1, cast(age + 1 AS int))"), F.lit(0), lambda s, x: s + x)
    still = F.greatest(F.lit(0), F.least(F.col("_slot"), F.lit(slots - 1) - F.col("age"))) * slot_rows  # all slots but the last are full
    rows = rows.withColumn("estimate", 1.0 + ahead + F.col("estimate_share") * still)
    return rows.where(F.col("window") <= last).select("id", "window", "exact", "estimate", (F.col("exact") < k).alias("outlier"), (F.col("estimate") < k).alias("estimated_outlier"))
