"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, target over size. The whole part is certain; the fractional parts
are rounded by pairs: mass (words) moves at random from one document of a pair to the other until the share of one is integral, which
keeps every expectation and the sum of words. A block of documents leaves at most one open share; open shares meet again in groups of
FANOUT blocks, level by level, until a source has one. Its share is taken in words, so that a source meets its target to the word, or
rounded to a whole copy at random.

Random numbers follow from the seed and the keys of a block, so reruns and retried tasks agree.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindlewatch.llm.common import WORD, rank_rows, stage
from spindlewatch.llm.cuckoo import orderable
from spindlewatch.session import checked_broadcast

BLOCK_ROWS = 2_000
FANOUT = 1_000
CAP = 2.0
TOLERANCE = 1e-9
DEALT = "doc_id long, size long, source string, source_size long, target double, copies long, share double, block long, open boolean"


def targets(sizes: DataFrame, weights: list[float], budget: float = 1.5, cap: float = CAP) -> DataFrame:
    """sizes (source, source_size, n) with target: weights repeat over the sources by code point, null last.

    All sources share budget times the whole size by weight; those above cap times their own size stop there and the excess is shared
    again by weight among the rest, until none is above.
    """
    ranked = stage(rank_rows(sizes, [F.col("source").asc_nulls_last()], "_place"), "sources")
    pick = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod("_place", F.lit(len(weights))) + 1).cast("int"))
    weighted = ranked.select("source", "source_size", "n", pick.alias("_weight"), (F.col("source_size") * F.lit(float(cap))).alias("_cap"))
    total = float(weighted.agg(F.sum("source_size")).first()[0] or 0) * budget
    level = None  # target per weight of the sources that are not stopped; it only rises
    while True:
        stopped = F.col("_cap") <= F.col("_weight") * F.lit(level) if level is not None else F.lit(False)
        held, free, n = weighted.agg(F.sum(F.when(stopped, F.col("_cap"))), F.sum(F.when(~stopped, F.col("_weight"))), F.count(F.when(stopped, 1))).first()
        if not free:
            break
        raised = (total - (held or 0.0)) / free
        if level is not None and raised <= level * (1 + 1e-12):
            break
        level = raised
    target = F.least("_cap", F.col("_weight") * F.lit(level or 0.0))
    return weighted.select("source", "source_size", "n", target.alias("target"))


def _rng(*key) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=16).digest(), "little"))


def pivot(size: np.ndarray, share: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Shares after rounding by pairs, all integral but for one at most, and the index of that one (-1: none)."""
    share, open_, draws = share.astype(float).tolist(), -1, rng.random(len(share)).tolist()
    size = size.tolist()
    for i in range(len(share)):
        if size[i] == 0 or share[i] < TOLERANCE or share[i] > 1 - TOLERANCE:
            share[i] = float(round(share[i]))
            continue
        if open_ < 0:
            open_ = i
            continue
        j, a, b = open_, float(size[open_]), float(size[i])
        up = min((1 - share[j]) * a, share[i] * b)  # words that j can win from i
        down = min(share[j] * a, (1 - share[i]) * b)
        moved = up if draws[i] * (up + down) < down else -down
        share[j] += moved / a
        share[i] -= moved / b
        open_ = -1
        for k in (j, i):
            if TOLERANCE < share[k] < 1 - TOLERANCE:
                open_ = k
            else:
                share[k] = float(round(share[k]))
    return np.array(share), open_


def _round(frame: pd.DataFrame, seed: int, level: int) -> pd.DataFrame:
    frame = frame.sort_values(["size", "doc_id"], ignore_index=True)
    source = frame["source"].iloc[0]
    share, open_ = pivot(frame["size"].to_numpy(), frame["share"].to_numpy(), _rng(seed, level, None if pd.isna(source) else source, int(frame["block"].iloc[0])))
    frame["share"] = share
    frame["open"] = np.arange(len(frame)) == open_
    return frame


def rounder(seed: int, level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda frame: _round(frame, seed, level)


def mix(docs: DataFrame, weights: list[float], budget: float = 1.5, cap: float = CAP, seed: int = 17, cut_last: bool = True, block_rows: int = BLOCK_ROWS, fanout: int = FANOUT) -> DataFrame:
    """Per row of docs: doc_id, size, source, source_size, target, copies, taken.

    size counts words; copies is how often the whole document is taken, taken how many words. With cut_last, the last open document of
    a source gives the leading words of its share; without, it is taken whole or not, at random. Null text has size 0 and takes no
    words; null source is a source of its own, the last; repeated rows are rounded apart; an empty table gives no rows; a source without
    words has target 0.
    """
    keyed = stage(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    aims = stage(targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, budget, cap), "targets")
    side = checked_broadcast(aims.withColumnRenamed("source", "_source"))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(expected + TOLERANCE)
    blocks = F.greatest(F.floor(F.col("n") / block_rows), F.lit(1))
    dealt = keyed.join(side, keyed["source"].eqNullSafe(side["_source"])).select(
        "doc_id", "size", "source", "source_size", "target", whole.cast("long").alias("copies"), F.greatest(expected - whole, F.lit(0.0)).alias("share"),
        F.pmod(F.xxhash64("doc_id", "size"), blocks).alias("block"), F.lit(False).alias("open"),
    )
    done, level = [], 0
    largest = int(aims.agg(F.max("n")).first()[0] or 0) // block_rows + 1
    while True:
        dealt = stage(dealt.groupBy("source", "block").applyInPandas(rounder(seed, level), DEALT), f"shares-{level}")
        if largest <= 1:
            break
        done.append(dealt.where(~F.col("open")))
        dealt, level, largest = dealt.where("open").withColumn("block", F.floor(F.col("block") / fanout)), level + 1, -(-largest // fanout)
    done.append(dealt)
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "source"), F.lit(1_000_003)) / 1_000_003.0
    last = F.when(F.col("open"), F.lit(0) if cut_last else (chance < F.col("share")).cast("long")).otherwise(F.round("share").cast("long"))
    copies = (F.col("copies") + last).cast("long")
    part = F.when(F.col("open") & F.lit(cut_last), F.round(F.col("share") * F.col("size"))).otherwise(0).cast("long")
    return rows.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size") + part).alias("taken"))


def mixed(docs: DataFrame, weights: list[float], budget: float = 1.5, cap: float = CAP, seed: int = 17) -> DataFrame:
    """The rows of docs, each as often as the mix takes it whole; all columns stay.

    Rows that agree in doc_id, size and source share their copies; the first ones by text and the other columns get one more if need be.
    """
    plan = mix(docs, weights, budget, cap, seed, cut_last=False)
    plan = plan.groupBy(F.col("doc_id").alias("id"), F.col("size").alias("words"), F.col("source").alias("origin")).agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), words.alias("own_words"), F.col("source").alias("own_origin"))
    same = own["own_id"].eqNullSafe(plan["id"]) & (own["own_words"] == plan["words"]) & own["own_origin"].eqNullSafe(plan["origin"])
    met = own.join(plan, same)
    single = met.where("n = 1").select("row", F.col("copies").alias("take"))
    turn = F.row_number().over(Window.partitionBy("own_id", "own_origin", "own_words").orderBy("row.text", *[F.col(f"row.`{c}`") for c in orderable(docs)]))
    share = F.floor(F.col("copies") / F.col("n")) + (turn <= F.col("copies") % F.col("n")).cast("long")
    rows = single.unionByName(met.where("n > 1").select("row", share.alias("take"))).where("take > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("take").cast("int"))).alias("turn")).select("row.*")
