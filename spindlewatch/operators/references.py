"""Reference examples: a greedy choice per cause with a bonus for new disks and days, its coverage, and the gate that reads it.

The choice is sequential, but needs few rows. Every record of a pool that can win a pick is among the pool's best ones, however many there
are, since a pick makes one disk and one day old and takes one record away. With P picks in all:

* of one disk (or one day) only the P best can win: their days (disks) differ, so P-1 earlier picks spoil at most P-1 of them, and one
  that is left has the same disk bonus, a full day bonus and at least the score;
* among 4P² + 4P records there are 2P + 2 with different disks and days, as no disk or day has more than P; earlier picks spoil two each,
  so one is left with both bonuses and at least the score of whatever comes later.

So Spark ranks within (pool, disk), (pool, day) and pool, and the greedy pass sees at most 4P² + 4P rows of each of eight pools.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindlewatch.functions.names import ROOT_CAUSES
from spindlewatch.operators.sampling import reference_score

# The bonuses of a disk or day that no example has yet, and how many rows a window needs.
NEW_DISK, NEW_DAY, LEAST_ROWS = 0.05, 0.03, 3
#: Causes that a gate asks for by kind of device.
REQUIRED_CAUSES = {
    "hdd": ["media", "interface", "temperature", "power", "unknown"],
    "ssd": ["media", "interface", "temperature", "power", "workload", "unknown"],
}
KNOWN, ANY = "known", "any"
PICKED = "pick int, phase string, disk string, day date, root_cause string, score double"


def distinct_examples(examples: DataFrame) -> DataFrame:
    """disk, day, n_rows, cause (as given, lower case), root_cause (one of the six), score; of rows that share a key the best one."""
    given = F.coalesce(F.lower(F.trim("root_cause")), F.lit("unknown"))
    known = F.when(given.isin(ROOT_CAUSES), given).otherwise("unknown")
    score = F.round(reference_score(), 9)
    rows = examples.select("disk", "day", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), given.alias("given"), known.alias("root_cause"), F.coalesce(score, F.lit(0.0)).alias("score"))
    best = F.max(F.struct("score", "n_rows", "root_cause", "given")).alias("r")
    return rows.groupBy("disk", "day").agg(best).select("disk", "day", "r.n_rows", "r.given", "r.root_cause", "r.score")


def candidates(records: DataFrame, picks: int) -> DataFrame:
    """The records that can win one of ``picks`` picks, by pool: a cause, all known causes, or any."""
    pools = F.array_compact(F.array(F.when(F.col("n_rows") >= LEAST_ROWS, F.col("root_cause")), F.when(F.col("given") != "unknown", F.lit(KNOWN)), F.lit(ANY)))
    rows = records.withColumn("pool", F.explode(pools))
    for keys, most in ((["pool", "disk"], picks), (["pool", "day"], picks), (["pool"], 4 * picks * picks + 4 * picks)):
        w = Window.partitionBy(*keys).orderBy(F.desc("score"), "disk", "day")
        rows = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
    return rows


def _greedy(frame: pd.DataFrame, per_cause: int, min_known: int) -> pd.DataFrame:
    """The picks in order, from at most a few thousand candidates."""
    frame = frame.sort_values(["score", "disk", "day"], ascending=[False, True, True], na_position="first", kind="stable")
    pools = {name: list(rows.itertuples(index=False)) for name, rows in frame.groupby("pool", sort=False)}
    disks, days, keys, out = set(), set(), set(), []

    def pick(pool: str, n: int, phase: str) -> None:
        left = pools.get(pool, [])
        for _ in range(n):
            if not left:
                return
            worth = [r.score + ((NEW_DISK if r.disk and r.disk not in disks else 0.0) + (NEW_DAY if pd.notna(r.day) and r.day not in days else 0.0)) for r in left]
            best = left.pop(worth.index(max(worth)))
            disks.add(best.disk)
            days.add(best.day)
            if (best.disk, best.day) not in keys:
                keys.add((best.disk, best.day))
                out.append((len(out) + 1, phase, best.disk, best.day, best.root_cause, best.score, best.given))

    for cause in ROOT_CAUSES:
        pick(cause, per_cause, "cause")
    if not out:
        pick(ANY, per_cause, ANY)
    pick(KNOWN, max(0, min_known - sum(r[-1] != "unknown" for r in out)), KNOWN)
    return pd.DataFrame([r[:-1] for r in out], columns=[c.split()[0] for c in PICKED.split(", ")])


def diverse_references(examples: DataFrame, per_cause: int = 1, min_per_cause: int = 1, min_known: int = 3, legacy: bool = False) -> DataFrame:
    """pick, phase, disk, day, root_cause, score of the chosen examples.

    Each cause in turn gets its best windows of at least three rows, where a new disk adds 0.05 and a new day 0.03 to the score; if that
    finds none, the best of all windows; then known causes until ``min_known`` of them are chosen, where one chosen before uses up its turn.
    Ties go to the higher score, then disk and day. Without a disk or day there is no bonus for it.
    """
    per_cause = max(1, per_cause) if legacy else max(1, per_cause, min_per_cause)
    picks = len(ROOT_CAUSES) * per_cause + max(0, min_known) + per_cause
    few = candidates(distinct_examples(examples), picks)
    return few.groupBy(F.lit(1).alias("_all")).applyInPandas(lambda frame: _greedy(frame, per_cause, max(0, min_known)), PICKED)


def reference_quality(examples: DataFrame, chosen: DataFrame) -> DataFrame:
    """cause, pool_records, selected, missing (a known cause without an example), selected_examples, known_ratio; six rows."""
    count = lambda df, name: df.groupBy(F.col("root_cause").alias("cause")).agg(F.count("*").alias(name))
    spark = examples.sparkSession
    causes = spark.createDataFrame([(c,) for c in ROOT_CAUSES], "cause string")
    out = causes.join(count(distinct_examples(examples), "pool_records"), "cause", "left").join(count(chosen, "selected"), "cause", "left").fillna(0)
    everything = Window.partitionBy()  # six rows
    total, known = F.sum("selected").over(everything), F.sum(F.when(F.col("cause") != "unknown", F.col("selected")).otherwise(0)).over(everything)
    return out.withColumns({"missing": (F.col("selected") == 0) & (F.col("cause") != "unknown"), "selected_examples": total, "known_ratio": F.round(F.coalesce(F.try_divide(known, total), F.lit(0.0)), 6)})


def gate_decisions(references: DataFrame, required: dict[str, list[str]] = REQUIRED_CAUSES, minimum: int = 1) -> DataFrame:
    """profile, mode (auto, off, force), missing (causes with too few examples, in the order asked for), used (how many examples go on).

    Off uses none, force all, auto all unless a required cause is missing. An unknown required cause is an error.
    """
    for causes in required.values():
        if wrong := [c for c in causes if c not in ROOT_CAUSES]:
            raise ValueError(f"no such cause: {wrong[0]}")
    given = F.lower(F.trim("root_cause"))
    cause = F.when(given.isin(ROOT_CAUSES), given).otherwise("unknown")
    counts = references.agg(F.count("*").alias("n"), *[F.count_if(cause == c).alias(c) for c in ROOT_CAUSES])
    asked = references.sparkSession.createDataFrame([(p, list(dict.fromkeys(c)), m) for p, c in required.items() for m in ("auto", "off", "force")], "profile string, required array<string>, mode string")
    have = F.create_map(*[x for c in ROOT_CAUSES for x in (F.lit(c), F.col(c))])
    out = counts.withColumn("have", have).join(F.broadcast(asked))  # one row with a few
    missing = F.filter("required", lambda c: F.element_at("have", c) < minimum)
    used = F.when(F.col("mode") == "off", 0).when((F.col("mode") == "auto") & (F.size(missing) > 0), 0).otherwise(F.col("n"))
    return out.select("profile", "mode", F.array_join(missing, ",").alias("missing"), used.cast("bigint").alias("used"))
