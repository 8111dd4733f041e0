"""Ranked lexical search by dense products of blocks.

Items are cut into groups of a bounded number of (item, term) pairs; only a group's vocabulary travels to the tasks. Documents are read
once a group: each keeps its number of terms and the counts of the vocabulary's terms, stored. Then tiles of items meet tiles of documents:

* an item tile has a compact vocabulary of its own, cut into parts; a part's matrix holds the weights of its terms (items x terms);
* a document tile is the matrix of impacts of these terms (terms x documents);
* their product in float64 is exact, as a part has so few terms that its sums stay below 2^53; parts are added as 64-bit integers.

A task keeps the k best of each item over all its tiles; whatever equals the k-th score stays until ids decide, so ties are safe.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindlewatch.llm.common import bounded_batches, stage, texts

GROUP_TERMS = 1 << 16
ITEM_TILE = 256
TERM_TILE = 1_024
DOCUMENT_TILE = 1_024
SLICE_BYTES = 4 << 20
EXACT = 1 << 53
LARGEST_IMPACT = 1_000_000
#: Letters and digits of ASCII, lower-cased, and all bytes of longer characters belong to terms; any other byte separates them.
TERM_BYTES = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
RANKED = "item int, doc_id long, score long"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in its order, in lists of bounded length."""
    clean = text.translate(TERM_BYTES)
    at = 0
    while at < len(clean):
        end = clean.find(b" ", at + SLICE_BYTES) if len(clean) - at > SLICE_BYTES else -1
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and each distinct term of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                found = sorted({t for some in terms_of(text) for t in some})
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array([t.decode() for t in found], pa.string())], names=["item_id", "term"])

    named = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return named.mapInArrow(run, "item_id long, term string").distinct()


def grouped(pairs: DataFrame, group_terms: int) -> DataFrame:
    """Adds part and turn: a group (part, turn) has at most group_terms pairs besides those of its last item."""
    sizes = pairs.groupBy("item_id").agg(F.count("*").alias("_terms"))
    parts = max(1, math.ceil(pairs.count() / group_terms))
    own = sizes.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int"))
    before = F.sum("_terms").over(Window.partitionBy("part").orderBy("item_id").rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("turn", F.floor(F.coalesce(before, F.lit(0)) / F.lit(group_terms)).cast("int"))
    return pairs.join(own.drop("_terms"), "item_id")


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document its number of terms and the counts of the terms that the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            sizes, terms, counts, offsets = [], [], [], [0]
            for text in texts(batch.column(1)):
                n, found = 0, Counter()
                for words in terms_of(text):
                    n += len(words)
                    found.update(map(get, words))
                found.pop(None, None)
                sizes.append(n)
                terms += found.keys()
                counts += found.values()
                offsets.append(len(terms))
            at = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, POSTINGS)


class ItemTile:
    """Some items with the terms they have, in parts whose sums are exact."""

    def __init__(self, first: int, lists: list[np.ndarray], weights: np.ndarray, term_tile: int):
        self.first, self.n = first, len(lists)
        flat = np.concatenate(lists)
        row = np.repeat(np.arange(self.n), [len(x) for x in lists])
        self.vocabulary = np.unique(flat)
        width = min(term_tile, max(1, (EXACT - 1) // (int(weights[self.vocabulary].max(initial=1)) * LARGEST_IMPACT + 1)))
        column = np.searchsorted(self.vocabulary, flat)
        self.parts = []
        for a in range(0, len(self.vocabulary), width):
            here = (column >= a) & (column < a + width)
            self.parts.append((a, min(width, len(self.vocabulary) - a), row[here], column[here] - a, weights[flat[here]].astype(float)))

    def scores(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        """Items x documents of a document tile, whose entries are (term, doc, impact)."""
        column = np.minimum(np.searchsorted(self.vocabulary, term), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[column] == term)
        column, doc, impact = column[known], doc[known], impact[known].astype(float)
        total = np.zeros((self.n, n_docs), np.int64)
        for begin, width, rows, columns, weights in self.parts:
            left = np.zeros((self.n, width))
            left[rows, columns] = weights
            here = (column >= begin) & (column < begin + width)
            right = np.zeros((width, n_docs))
            right[column[here] - begin, doc[here]] = impact[here]
            total += (left @ right).astype(np.int64)
        return total


def keep_best(best: tuple[np.ndarray, np.ndarray], ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of both, equal scores by id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= edge], scores[scores >= edge]
    ids, scores = np.concatenate([best[0], ids]), np.concatenate([best[1], scores])
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _ranked(found: DataFrame, lists: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int, tiles: tuple[int, int, int]) -> DataFrame:
    """Of every task the k best documents of each item."""
    item_tile, term_tile, document_tile = tiles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [ItemTile(a, lists[a : a + item_tile], weights, term_tile) for a in range(0, len(lists), item_tile)]
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in lists]
        for whole in batches:
            for a in range(0, whole.num_rows, document_tile):
                batch = whole.slice(a, document_tile)
                ids, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
                size = np.diff(np.asarray(batch.column(2).offsets))
                term, count = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
                doc = np.repeat(np.arange(len(ids)), size)
                m = 100 - 50 + (50 * n * n_docs) // n_terms
                impact = (1_000_000_000 * count) // (1_000 * count + 20 * m[doc])
                for tile in items:
                    scores = tile.scores(term, doc, impact, len(ids))
                    for i in np.flatnonzero(scores.max(axis=1) > 0).tolist():
                        own = best[tile.first + i]
                        least = own[1][-1] if len(own[1]) == k else 1
                        near = np.flatnonzero(scores[i] >= least)
                        if len(near):
                            best[tile.first + i] = keep_best(own, ids[near], scores[i, near], k)
        item = np.repeat(np.arange(len(best), dtype=np.int32), [len(b[0]) for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))], names=["item", "doc_id", "score"])

    return found.mapInArrow(run, RANKED)


def top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id"))
    return rows.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int, group_terms: int = GROUP_TERMS, tiles: tuple[int, int, int] = (ITEM_TILE, TERM_TILE, DOCUMENT_TILE)) -> DataFrame:
    """item_id, rank, doc_id, score: for each item (item_id, text) the k best rows of docs (doc_id, text) with a score above 0.

    Null texts have no terms. An item_id that occurs again has the terms of all its texts; items without id or without terms give no rows.
    Rows without doc_id take no part and are not counted; a repeated row is a document each time. Equal scores go by doc_id. Empty tables
    give no rows, other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    named = docs.where("doc_id is not null").select("doc_id", "text")
    pairs = stage(grouped(stage(item_terms(items), "item-terms"), group_terms), "item-groups")
    results = []
    for group in pairs.select("part", "turn").distinct().orderBy("part", "turn").collect():  # one row per group
        own = pairs.where((F.col("part") == group["part"]) & (F.col("turn") == group["turn"])).select("item_id", "term").toPandas()  # bounded by group_terms
        vocabulary = {t.encode(): i for i, t in enumerate(sorted(set(own["term"])))}
        names, lists = [], []
        for item, some in own.groupby("item_id")["term"]:
            names.append(int(item))
            lists.append(np.array(sorted(vocabulary[t.encode()] for t in some), np.int64))
        found = stage(postings(named, vocabulary), "postings")
        totals = found.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.sum("n").alias("terms")).first()
        if not totals["n"]:
            break
        holding = found.select(F.explode("terms").alias("term")).groupBy("term").count().toPandas()  # at most the group's vocabulary
        df = np.zeros(len(vocabulary), np.int64)
        df[holding["term"]] = holding["count"]
        weights = np.array([math.floor(1_000 * math.log((2 * totals["n"] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        ranked = _ranked(found.where(F.size("terms") > 0), lists, weights, totals["n"], totals["terms"], k, tiles)
        shares = math.isqrt(len(found.inputFiles()))
        if shares > 1:  # many tasks: their lists meet in shares before they meet in whole
            ranked = top(ranked.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(shares))), ["item", "share"], k).select("item", "doc_id", "score")
        item_id = F.element_at(F.lit(names), F.col("item") + 1).cast("long")
        results.append(stage(top(ranked, ["item"], k).select(item_id.alias("item_id"), "rank", "doc_id", "score"), "ranked"))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole
