"""Exact top-k by inner product with buckets of similar length.

Vectors are grouped by length (powers of STEP). A query's first scores come from the longest vectors; what a vector must reach is then a
cosine, the k-th score over both lengths, and a query goes only to buckets where that is at most 1. A task meets a block of queries, which
need about the same length, with a share of a bucket, chunk by chunk. Before any product is made, each chunk is pruned for each query: where
the cosine is high, the coordinate on which the query is strongest bounds the candidates; where it is low, their length does. Products are
made for what is left only, in groups of queries that keep nearly the same rows; they are integers, and a bound drops a vector only if its
product is surely smaller, so ties are kept.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindlewatch.llm.common import stage

STEP = 1.1
CHUNK = 2_048
QUERY_BLOCK = 512
SHARE_ROWS = 16_384
COORDINATE_FROM = 0.5
TOGETHER = 64
SLACK = 1e-9
NONE = -(1 << 62)
FOUND = "query_id long, vec_id long, score long"


def quantised(rows: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id and floor(scale * x) of every component; vectors that are null, empty or hold null or non-finite components are left out."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(finite).select("vec_id", F.transform(vector, lambda x: F.floor(F.lit(scale) * x)).alias("v"))


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Integer products; by floating point where that is exact."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * q.shape[1] < 2**53:
        return (q.astype(float) @ p.astype(float).T).astype(np.int64)
    return q @ p.T


class Chunk:
    """Rows in order of falling length, with their order by any coordinate of their directions."""

    def __init__(self, ids: np.ndarray, p: np.ndarray):
        lengths = np.sqrt((p.astype(float) ** 2).sum(1))
        order = np.argsort(-lengths, kind="stable")
        self.ids, self.p, self.lengths = ids[order], p[order], lengths[order]
        self.unit = self.p / np.maximum(self.lengths, 1e-300)[:, None]
        self.by: dict[int, np.ndarray] = {}

    def by_coordinate(self, f: int) -> np.ndarray:
        if f not in self.by:
            self.by[f] = np.argsort(self.unit[:, f], kind="stable")
        return self.by[f]


def bounds(q: np.ndarray, length: np.ndarray, least: np.ndarray, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every query (its length, and the score to reach): the order to read the chunk in (-1: by length, else a coordinate), first and last place."""
    n = len(chunk.ids)
    order, first, end = np.full(len(q), -1), np.zeros(len(q), np.int64), np.full(len(q), n)
    known = np.flatnonzero((least > 0) & (length > 0))
    need = least[known] / length[known]  # length of a vector in the query's direction
    end[known] = np.searchsorted(-chunk.lengths, -need * (1 - SLACK), side="right")
    cosine = need / chunk.lengths[0] if chunk.lengths[0] else np.full(len(known), 2.0)
    tight = (cosine >= COORDINATE_FROM) & (cosine <= 1)
    for i, cos in zip(known[tight].tolist(), cosine[tight].tolist()):
        f = int(np.argmax(np.abs(q[i])))
        c = q[i, f] / length[i]
        spread = np.sqrt(max(0.0, 1 - cos * cos)) * np.sqrt(max(0.0, 1 - c * c)) + SLACK
        # the cap of unit vectors at that cosine or more around the query spans this range of the coordinate; it may hold an end of the axis
        low = -1.0 - SLACK if c <= -cos else c * cos - spread
        high = 1.0 + SLACK if c >= cos else c * cos + spread
        x = chunk.unit[chunk.by_coordinate(f), f]
        a, b = int(np.searchsorted(x, low, side="left")), int(np.searchsorted(x, high, side="right"))
        if b - a < end[i]:
            order[i], first[i], end[i] = f, a, b
    return order, first, end


def _merge(best: list, ids: np.ndarray, scores: np.ndarray, k: int) -> list:
    """The k best of those so far and the new ones; ties to the smaller id."""
    if len(ids) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= edge
        ids, scores = ids[keep], scores[keep]
    ids, scores = np.concatenate([best[0], ids]), np.concatenate([best[1], scores])
    order = np.lexsort((ids, -scores))[:k]
    return [ids[order], scores[order]]


def visit(q: np.ndarray, ids: np.ndarray, length: np.ndarray, floor: np.ndarray, best: list, chunk: Chunk, k: int) -> int:
    """Takes the best of a chunk into ``best``, prunes first, and returns how many products were made."""
    least = np.array([max(float(f), float(b[1][-1]) if len(b[1]) == k else -np.inf) for f, b in zip(floor, best)])
    order, first, end = bounds(q, length, least, chunk)
    live = np.flatnonzero(end > first)
    live = live[np.lexsort((end[live], first[live], order[live]))]
    made = 0
    for f in np.unique(order[live]).tolist():
        rows = np.arange(len(chunk.ids)) if f < 0 else chunk.by_coordinate(f)
        own = live[order[live] == f]
        for at in range(0, len(own), TOGETHER):
            some = own[at : at + TOGETHER]
            a, b = int(first[some].min()), int(end[some].max())
            scores = _products(q[some], chunk.p[rows[a:b]])
            made += scores.size
            for j, i in enumerate(some.tolist()):
                near = np.flatnonzero((scores[j] >= least[i]) & (chunk.ids[rows[a:b]] != ids[i]))
                if len(near):
                    best[i] = _merge(best[i], chunk.ids[rows[a + near]], scores[j, near], k)
    return made


def _answer(asked: pd.DataFrame, own: pd.DataFrame, k: int) -> pd.DataFrame:
    """A block of queries meets a share of a bucket, its chunks in turn."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    if asked.empty or own.empty:
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in names})
    dims = int(asked["dims"].iloc[0])
    stacked = lambda frame: np.concatenate([np.asarray(x, np.int64) for x in frame["v"]]).reshape(-1, dims)
    ids, q, floor = asked["query_id"].to_numpy(), stacked(asked), asked["floor"].to_numpy(float)
    floor[floor <= NONE] = -np.inf
    length = np.sqrt((q.astype(float) ** 2).sum(1))
    best = [[np.zeros(0, np.int64), np.zeros(0, np.int64)] for _ in ids]
    own = own.sort_values("length", ascending=False, kind="stable")
    for a in range(0, len(own), CHUNK):
        some = own.iloc[a : a + CHUNK]
        visit(q, ids, length, floor, best, Chunk(some["vec_id"].to_numpy(), stacked(some)), k)
    out = [(np.full(len(b[0]), i), *b) for i, b in zip(ids, best)]
    return pd.DataFrame(dict(zip(names, (np.concatenate(c).astype(np.int64) for c in zip(*out)))))


def _met(asked: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """The best rows of each group (block, bucket, share, dims) that has queries and rows."""
    keys = ["block", "bucket", "share", "dims"]
    left = asked.select(*keys, "query_id", "v", "floor")
    right = own.select(*[F.col(c).alias(f"_{c}") for c in keys], "vec_id", "v", "length")
    return left.groupBy(*keys).cogroup(right.groupBy(*[f"_{c}" for c in keys])).applyInPandas(lambda a, b: _answer(a, b, k), FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)


def search(rows: DataFrame, queries: DataFrame, k: int, scale: float = 64.0, share_rows: int = SHARE_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For every query (vec_id, embedding): query_id, rank, vec_id, score of its k best rows; all, if there are fewer.

    Rows with the query's own vec_id are no candidates. Vectors of other dimension have no product with it. Ties go to the smaller vec_id;
    a repeated row is a candidate each time, a repeated query is answered once; of different queries with one vec_id the least by
    components is asked; rows without vec_id take no part. Empty tables give no rows.
    """
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    bucket = F.when(F.col("length") > 0, F.floor(F.log("length") / F.lit(float(np.log(STEP))))).otherwise(-(1 << 20)).cast("int")
    sized = lambda df: df.select("vec_id", "v", F.size("v").alias("dims"), length.alias("length")).withColumn("bucket", bucket)
    own = sized(quantised(rows.where("vec_id is not null"), scale))
    own = stage(own, "vectors")
    counts = stage(own.groupBy("dims", "bucket").agg(F.count("*").alias("n")), "buckets")  # a few hundred rows: lengths in steps of a tenth
    counts = counts.withColumn("shares", F.ceil(F.col("n") / F.lit(share_rows)).cast("int"))
    own = own.join(F.broadcast(counts.select("dims", "bucket", "shares")), ["dims", "bucket"]).withColumn("share", F.pmod(F.xxhash64("vec_id"), F.col("shares")).cast("int"))
    asked = quantised(queries.where("vec_id is not null"), scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = stage(sized(asked).select(F.col("vec_id").alias("query_id"), "v", "dims", "length"), "queries")
    # first scores: one share of the longest bucket that has k rows or more, besides the query
    filled = counts.where(F.col("n") > k).groupBy("dims").agg(F.max("bucket").alias("bucket"))
    blocks = max(1, -(-asked.count() // query_block))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    start = asked.join(F.broadcast(filled), "dims").withColumns({"share": F.lit(0), "block": block, "floor": F.lit(NONE)})
    top_rows = own.join(F.broadcast(filled), ["dims", "bucket"]).where("share = 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    least = _ranked(_met(start, top_rows, k), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    # a query goes to the buckets that can reach its k-th score; blocks are made of queries that need about the same length
    need = F.when((F.col("floor") > 0) & (F.col("length") > 0), F.floor(F.log(F.col("floor") / F.col("length") * (1 - SLACK)) / F.lit(float(np.log(STEP)))) - 1).otherwise(-(1 << 21)).cast("int")
    known = stage(asked.join(least, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(NONE))).withColumn("need", need), "needs")
    sizes = known.groupBy("dims", "need").agg(F.ceil(F.count("*") / F.lit(query_block)).cast("int").alias("blocks"))
    sizes = sizes.join(F.broadcast(counts.select("dims", "bucket", "shares")), "dims").where("bucket >= need")  # (needed length, bucket): steps of a tenth on both sides
    sizes = stage(sizes, "pairs").withColumnRenamed("need", "_need").withColumnRenamed("dims", "_dims")
    wide = known.join(sizes, (known["need"] == sizes["_need"]) & (known["dims"] == sizes["_dims"]))
    block = F.concat_ws(".", "need", F.pmod(F.xxhash64("query_id"), F.col("blocks")))
    left = wide.select("query_id", "v", "floor", "dims", "bucket", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    names = sizes.select(F.col("_dims").alias("dims"), "bucket", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.concat_ws(".", "_need", b))).alias("block"))
    right = own.join(names, ["dims", "bucket"])
    return _ranked(_met(left, right, k), k).select("query_id", "rank", "vec_id", "score")
