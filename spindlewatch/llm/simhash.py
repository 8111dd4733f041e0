"""SimHash near duplicates by multi-index hashing.

Equal fingerprints are one class from the start. A 64-bit fingerprint has two segments of 32 bits; fingerprints at DISTANCE 3 or less have
a segment in which they differ in at most one bit. Every fingerprint stands in a table by each segment, and asks the tables for the small
ball around its segment: the segment itself and, as one of two segments that differ in a bit has it set, the segment with each of its set
bits cleared. What meets in a table entry is verified over all 64 bits.

A fingerprint asks under one key as table row and under some 16 more a segment, so a table entry holds the rows and those that ask. An entry
that could hold more than ENTRY_ROWS is indexed again, by the two halves of its members' other segment; there 48 of 64 bits are fixed but
for a bit or two, so its entries are bounded by what is left. An entry yields the edges of a spanning forest of its links, not all pairs.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlewatch.llm.common import LOWER_BYTES, bounded_batches, stage, texts
from spindlewatch.llm.components import components
from spindlewatch.session import checked_broadcast

SHINGLE = 3
SEED = 42
DISTANCE = 3
SEGMENT = 32
HALF = 16
ENTRY_ROWS = 4_096
SMALL_ENTRY = 24
SLICE_BYTES = 4 << 20
HASH_BLOCK = 1 << 16
PRINTS = "doc_id long, print long"
ENTRIES = "k0 long, k1 int, side int, print long, rid long"
EDGES = "a long, b long"
#: What a row in a table entry is: 0 has the key itself, the bits tell at which index it asks with a bit cleared.
ASKS_SEGMENT, ASKS_HALF = 1, 2


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, repeats included, in arrays of bounded length; with fewer words, of the whole sequence."""
    import xxhash

    hashed, clean, at, held, short = xxhash.xxh64_intdigest, text.translate(LOWER_BYTES), 0, [], True
    while at < len(clean):
        end = clean.find(b" ", at + SLICE_BYTES) if len(clean) - at > SLICE_BYTES else -1
        end = len(clean) if end < 0 else end
        words, at = held + clean[at:end].split(), end
        if len(words) < width:
            held = words
            continue
        held, short = words[len(words) - width + 1 :], False
        line = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size + 1) - size - 1
        begins, ends = start[: len(words) - width + 1].tolist(), (start + size)[width - 1 :].tolist()
        for a in range(0, len(begins), HASH_BLOCK):
            some = zip(begins[a : a + HASH_BLOCK], ends[a : a + HASH_BLOCK])
            yield np.fromiter((hashed(line[b:e], SEED) for b, e in some), np.uint64)
    if short and held:
        yield np.array([hashed(b" ".join(held), SEED)], np.uint64)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes; no word gives 0."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, width):
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(((2 * ones > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def prints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint of every row, as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.fromiter((fingerprint(t, width) for t in texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PRINTS)


def ball(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and keys of the values themselves and of the values with one of their set bits cleared, and whether a bit was."""
    rows, keys = [np.arange(len(values))], [values]
    for b in range(bits):
        on = np.flatnonzero(values >> b & 1)
        rows.append(on)
        keys.append(values[on] ^ (1 << b))
    asks = np.concatenate([np.zeros(len(values), np.int32), np.ones(sum(map(len, rows[1:])), np.int32)])
    return np.concatenate(rows), np.concatenate(keys), asks


def segments(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two segments of fingerprints."""
    bits = own.view(np.uint64)
    return tuple((bits >> np.uint64(SEGMENT * s) & np.uint64((1 << SEGMENT) - 1)).astype(np.int64) for s in (0, 1))


def table_key(segment: int) -> Column:
    """The key of a fingerprint's own entry in the table of a segment."""
    return F.shiftrightunsigned("print", SEGMENT * segment).bitwiseAND(F.lit((1 << SEGMENT) - 1)) + F.lit(segment << SEGMENT)


def _first_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(print, rid) under all keys of the first index."""
    for batch in batches:
        own, rid = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        for s, values in enumerate(segments(own)):
            rows, keys, asks = ball(values, SEGMENT)
            yield pa.RecordBatch.from_arrays([pa.array(keys + (s << SEGMENT)), pa.array(np.zeros(len(rows), np.int32)), pa.array(asks * ASKS_SEGMENT), pa.array(own[rows]), pa.array(rid[rows])], names=["k0", "k1", "side", "print", "rid"])


def _second_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of an entry of the first index under the halves of their other segment."""
    for batch in batches:
        k0, side, own, rid = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2, 3, 4))
        low, high = segments(own)
        other = np.where(k0 >> SEGMENT == 0, high, low)
        for t in (0, 1):
            rows, keys, asks = ball(other >> (HALF * t) & ((1 << HALF) - 1), HALF)
            k1 = (keys + (t << HALF) + 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(k0[rows]), pa.array(k1), pa.array(side[rows] | asks * ASKS_HALF), pa.array(own[rows]), pa.array(rid[rows])], names=["k0", "k1", "side", "print", "rid"])


def _near(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.bitwise_count(p ^ q) <= DISTANCE


def _small_entries(entry: np.ndarray, side: np.ndarray, own: np.ndarray, rid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within entries of at most SMALL_ENTRY rows, which stand together: each row with the next, the second next and so on."""
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, SMALL_ENTRY):
        at = np.flatnonzero(entry[d:] == entry[:-d]) if d < len(entry) else np.zeros(0, np.int64)
        if not len(at):
            break
        at = at[(side[at] & side[at + d] == 0) & _near(own[at], own[at + d])]
        one.append(rid[at])
        two.append(rid[at + d])
    return np.concatenate(one), np.concatenate(two)


def _large_entry(side: np.ndarray, own: np.ndarray, rid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of one entry: from every row reached to the rows not reached yet."""
    open_, one, two = np.arange(len(own)), [], []
    while len(open_):
        waiting, open_ = [open_[0]], open_[1:]
        while waiting and len(open_):
            x = waiting.pop()
            met = (side[open_] & side[x] == 0) & _near(own[open_], own[x])
            if met.any():
                found = open_[met]
                one.append(np.full(len(found), rid[x]))
                two.append(rid[found])
                waiting += found.tolist()
                open_ = open_[~met]
    return (np.concatenate(one), np.concatenate(two)) if one else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def entry_links(k0: np.ndarray, k1: np.ndarray, side: np.ndarray, own: np.ndarray, rid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of whole entries that stand together; two rows that both ask at one index don't meet there."""
    fresh = np.concatenate([[True], (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])])
    begin = np.flatnonzero(fresh)
    size = np.diff(begin, append=len(k0))
    entry, each = np.repeat(np.arange(len(begin)), size), np.repeat(size, size)
    small = np.flatnonzero((each > 1) & (each <= SMALL_ENTRY))
    found = [_small_entries(entry[small], side[small], own[small], rid[small])]
    for i in np.flatnonzero(size > SMALL_ENTRY).tolist():
        at = slice(begin[i], begin[i] + size[i])
        found.append(_large_entry(side[at], own[at], rid[at]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the entries of a partition, which is sorted by key; an entry that goes on in the next batch waits for it."""
    waiting: list[list[np.ndarray]] = []

    def told(columns: list[np.ndarray]) -> pa.RecordBatch:
        k0, k1, side, own, rid = columns
        a, b = entry_links(k0, k1, side, own.view(np.uint64), rid)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        last = (own[0] == own[0][-1]) & (own[1] == own[1][-1])
        if waiting and last.all() and own[0][0] == waiting[-1][0][-1] and own[1][0] == waiting[-1][1][-1]:
            waiting.append(own)
            continue
        start = int(np.argmax(last))
        whole = [np.concatenate(c) for c in zip(*waiting, [c[:start] for c in own])]
        if len(whole[0]):
            yield told(whole)
        waiting = [[c[start:] for c in own]]
    if waiting:
        yield told([np.concatenate(c) for c in zip(*waiting)])


def links(sets: DataFrame, entry_rows: int = ENTRY_ROWS) -> DataFrame:
    """Pairs (a, b) of ids of sets (print, rid) that connect all fingerprints at DISTANCE or less; sets must be stored."""
    rows = sets.select("print", "rid").mapInArrow(_first_index, ENTRIES)
    # an entry holds the rows of its key and of 32 neighbours at most, so one of them is large where the entry is
    keys = sets.select(F.explode(F.array(table_key(0), table_key(1))).alias("k0"))
    large = stage(keys.groupBy("k0").agg(F.count("*").alias("n")).where(F.col("n") > entry_rows // (SEGMENT + 1)).select("k0"), "large-keys")
    if not large.isEmpty():

        def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k0 = batch.column(0).to_numpy(zero_copy_only=False)
                at, near, _ = ball(k0 & ((1 << SEGMENT) - 1), SEGMENT)
                yield pa.RecordBatch.from_arrays([pa.array(near + (k0[at] >> SEGMENT << SEGMENT))], names=["k0"])

        dense = checked_broadcast(stage(large.mapInArrow(around, "k0 long").distinct(), "large-entries"))
        again = rows.join(dense, "k0", "left_semi").select("k0", "k1", "side", "print", "rid").mapInArrow(_second_index, ENTRIES)
        rows = rows.join(dense, "k0", "left_anti").select("k0", "k1", "side", "print", "rid").unionByName(again)
    return rows.repartition("k0", "k1").sortWithinPartitions("k0", "k1", "side", "print").mapInArrow(_links, EDGES)


def classes(docs: DataFrame, width: int = SHINGLE, entry_rows: int = ENTRY_ROWS) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 lowercase hex digits), component_id.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; the shingles of a text count with repeats, a text of fewer words is one shingle
    and one without words (or null) has fingerprint zero, which links like any other. Rows without doc_id are left out, as a component
    can't be named by them; repeated rows are linked; an empty table gives no rows; other columns are ignored.
    """
    own = stage(prints(docs.where("doc_id is not null"), width), "prints")
    sets = stage(own.groupBy("print").agg(F.min("doc_id").alias("rid")), "print-sets")
    labels = components(stage(links(sets, entry_rows).distinct(), "print-links"))
    named = sets.join(labels, sets["rid"] == labels["node"], "left").select("print", F.coalesce("root", "rid").alias("component_id"))
    return own.join(named, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
