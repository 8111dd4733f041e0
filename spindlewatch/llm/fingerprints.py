"""Which fingerprints of a document do other documents have as well?

Documents are handled in batches. A batch sends each distinct fingerprint once to the bucket of its leading bits, packed in sorted
blocks; a bucket tells every batch which of them have another owner. So a fingerprint that very many documents share costs its bucket
one entry per batch, and the documents themselves are not moved.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from spindlewatch.llm.common import parts, texts, trim, utf8

LARGEST_COUNT = 65_535
PART_BYTES = 3 << 20
SENT_ROWS = 16
SENT = "bucket int, batch long, kind int, tokens binary, docs binary, counts binary, mixed binary, own_docs binary, own_sets binary"
BACK = "batch long, kind int, tokens binary, docs binary, counts binary, shared int, own_docs binary, own_sets binary"


def spread(values: np.ndarray) -> bytes:
    """Rising 64-bit numbers as differences, byte by byte of their places, which compresses well."""
    return np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def gathered(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def mixed_bits(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def send(batches: Iterator[pa.RecordBatch], buckets: int, make: Callable, by_set: bool, part_bytes: int) -> Iterator[pa.RecordBatch]:
    """A batch of (doc_id, text): every distinct fingerprint goes to its bucket, the documents of those that several have to the batch."""
    import hashlib

    from pyspark import TaskContext

    schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32())] + [(c, pa.binary()) for c in ("tokens", "docs", "counts", "mixed", "own_docs", "own_sets")])
    part, number = TaskContext.get().partitionId(), 0
    for batch in (p for whole in batches for p in parts(whole, 1, part_bytes)):
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        name, number = (part << 24) + number, number + 1
        if by_set:
            sets = [make(t) for t in texts(batch.column(1))]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            short = np.array([int.from_bytes(d[:8], "little") for d in digests], np.uint64)
            sizes = np.array([len(s) for s in sets], np.int64)
            token, doc = np.concatenate(sets), np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
            del sets
        else:
            data, offsets = utf8(batch.column(1))
            token, doc = make(data[offsets[0] : offsets[-1]], offsets - offsets[0])
            digests, short, sizes, doc = [bytes(16)] * len(ids), ids.view(np.uint64), np.bincount(doc, minlength=len(ids)), doc.astype(np.uint16)
        order = np.argsort(token, kind="stable")
        token, doc = token[order], doc[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        count = np.diff(first, append=len(token))
        rows = [(name % buckets, name, 1, ids.tobytes(), b"".join(digests), sizes.tobytes(), None, None, None)]
        if len(token):
            own = short[doc]
            mixed = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
            unique, lead = token[first], doc[first]
            # the documents of a shingle that several here have wait with their batch; its bucket needs one entry
            several = count > 1
            inside = np.repeat(several, count)
            rows.append((name % buckets, name, 2, spread(unique[several]), doc[inside].tobytes(), count[several].astype("<u4").tobytes(), None, None, None))
            del own, inside, token, doc
            bucket = (unique >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                at = slice(cuts[b], cuts[b + 1])
                here = np.unique(lead[at])
                counts = np.minimum(count[at], LARGEST_COUNT).astype("<u2").tobytes()
                rows.append((b, name, 0, spread(unique[at]), lead[at].tobytes(), counts, np.packbits(mixed[at]).tobytes(), here.tobytes(), short[here].tobytes()))
                if len(rows) >= SENT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        trim()


def count(frame: pd.DataFrame) -> pd.DataFrame:
    """A bucket: tells every batch which of its fingerprints another owner has too, and how often they occur."""
    names = [c.split()[0] for c in BACK.split(", ")]
    kept = frame[frame["kind"] > 0].assign(shared=0)
    sent = frame[frame["kind"] == 0]
    rows = []
    if len(sent):
        tokens = [gathered(x) for x in sent["tokens"]]
        docs = [np.frombuffer(x, np.uint16) for x in sent["docs"]]
        sets = [np.frombuffer(s, np.uint64)[np.searchsorted(np.frombuffer(o, np.uint16), d)] for s, o, d in zip(sent["own_sets"], sent["own_docs"], docs)]
        counts = [np.frombuffer(x, "<u2") for x in sent["counts"]]
        mixed = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(d)).astype(bool) for x, d in zip(sent["mixed"], docs)]
        sizes = np.array([len(d) for d in docs])
        token = np.concatenate(tokens)
        order = np.argsort(token, kind="stable")
        token = token[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(first, append=len(token))
        del token
        own = np.concatenate(sets)[order]
        common = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
        del own, sets
        common |= np.maximum.reduceat(np.concatenate(mixed)[order].astype(np.uint8), first).astype(bool)
        total = np.minimum(np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), first), LARGEST_COUNT) * common
        back = np.empty(len(order), np.int32)
        back[order] = np.repeat(total, length)
        del order
        at = 0
        for batch, t, d, n, size in zip(sent["batch"], tokens, docs, counts, sizes):
            df = back[at : at + size]
            at += size
            for shared in (0, 1):
                these = (df > 0) & ((n > 1) == bool(shared))
                if these.any():
                    rows.append((batch, 0, spread(t[these]), d[these].tobytes(), df[these].astype("<u2").tobytes(), shared, None, None))
    trim()
    return pd.concat([kept[names], pd.DataFrame(rows, columns=names)], ignore_index=True).astype({"batch": "int64", "kind": "int32", "shared": "int32"})


def gather(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """A batch: ids, set sizes and set digests of its documents; fingerprint, document and frequency of what is shared."""
    head = frame[frame["kind"] == 1].iloc[0]
    ids, n = np.frombuffer(head["tokens"], np.int64), np.frombuffer(head["counts"], np.int64)
    sets = [head["docs"][16 * i : 16 * i + 16] for i in range(len(ids))]
    token, doc, count = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    back = frame[frame["kind"] == 0]
    for t, d, c in back.loc[back["shared"] == 0, ["tokens", "docs", "counts"]].itertuples(index=False):
        token.append(gathered(t))
        doc.append(np.frombuffer(d, np.uint16).astype(np.int64))
        count.append(np.frombuffer(c, "<u2").astype(np.int64))
    own, several = frame[frame["kind"] == 2], back[back["shared"] == 1]
    if len(own) and len(several):
        unique, uses = gathered(own.iloc[0]["tokens"]), np.frombuffer(own.iloc[0]["counts"], "<u4").astype(np.int64)
        df = np.zeros(len(unique), np.int64)
        for t, c in several[["tokens", "counts"]].itertuples(index=False):
            df[np.searchsorted(unique, gathered(t))] = np.frombuffer(c, "<u2")
        each = np.repeat(df, uses)
        token.append(np.repeat(unique, uses)[each > 0])
        doc.append(np.frombuffer(own.iloc[0]["docs"], np.uint16).astype(np.int64)[each > 0])
        count.append(each[each > 0])
    token, doc, count = np.concatenate(token), np.concatenate(doc), np.concatenate(count)
    return ids, n, sets, token, doc, count


def shared_fingerprints(docs: DataFrame, buckets: int, make: Callable, by_set: bool, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows for gather(), to be grouped by batch.

    by_set: make gives the sorted distinct fingerprints of a text, and documents with equal sets are one owner. Otherwise it gives, for
    the bytes of many texts and their offsets, the distinct pairs of fingerprint and text, and documents with equal doc_id are one owner. A document is known by its place in a
    part of its partition; rows are sorted there, so that a task that is run again numbers them alike.
    """
    sent = docs.select("doc_id", "text").sortWithinPartitions("doc_id", "text").mapInArrow(lambda batches: send(batches, buckets, make, by_set, part_bytes), SENT)
    return sent.groupBy("bucket").applyInPandas(count, BACK)
