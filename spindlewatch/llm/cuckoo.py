"""Exact duplicates by a cuckoo-filter index.

Rows are addressed by the SHA-256 of their normalised text. Every bucket of the digest space has a cuckoo filter of 16-bit fingerprints
and the content it stands for: full digest and byte length, held at the slot of the fingerprint. A fingerprint that is not found proves
a new text; one that is found is only a hint and is verified against the content of its two slots groups. Digests can be inserted and
deleted; a filter that finds no place doubles and is rebuilt from the stored keys, so an overflow loses nothing.

Copies are added up before a bucket sees them (per digest and task), so a group of copies of any size costs a bucket a few rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from spindlewatch.llm.common import lower_ascii, plan_bytes, stage

SLOTS = 4
MAX_KICKS = 200
BUCKET_BYTES = 8 << 20
ENTRY = "_digest binary, _length int, keep_id long, group_size long"


class CuckooIndex:
    """A filter with partial-key cuckoo hashing whose slots also hold the stored keys and their values.

    ``filter[g]`` holds up to SLOTS fingerprints of slot group g; ``content[g]`` the (digest, length, value) that each stands for.
    """

    def __init__(self, groups: int = 64):
        self.live = 0
        self._clear(groups)

    def _clear(self, groups: int) -> None:
        self.groups = groups
        self.filter: list[list[int]] = [[] for _ in range(groups)]
        self.content: list[list[tuple[bytes, int, list]]] = [[] for _ in range(groups)]

    def _home(self, digest: bytes) -> tuple[int, int]:
        return int.from_bytes(digest[8:12], "little") & (self.groups - 1), int.from_bytes(digest[12:14], "little")

    def _other(self, group: int, print_: int) -> int:
        return group ^ ((print_ * 0x5BD1E995 + 1) & (self.groups - 1))

    def _find(self, digest: bytes, length: int) -> tuple[int, int] | None:
        group, print_ = self._home(digest)
        for g in (group, self._other(group, print_)):
            if print_ in self.filter[g]:  # a hit: maybe of another text
                for slot, (key, size, _) in enumerate(self.content[g]):
                    if key == digest and size == length:
                        return g, slot
        return None

    def get(self, digest: bytes, length: int) -> list | None:
        found = self._find(digest, length)
        return None if found is None else self.content[found[0]][found[1]][2]

    def insert(self, digest: bytes, length: int, value: list) -> None:
        """Adds a digest that is not live."""
        entry, (group, print_) = (digest, length, value), self._home(digest)
        self.live += 1
        for g in (group, self._other(group, print_)):
            if len(self.filter[g]) < SLOTS:
                self.filter[g].append(print_)
                self.content[g].append(entry)
                return
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            print_, self.filter[group][slot] = self.filter[group][slot], print_
            entry, self.content[group][slot] = self.content[group][slot], entry
            group = self._other(group, print_)
            if len(self.filter[group]) < SLOTS:
                self.filter[group].append(print_)
                self.content[group].append(entry)
                return
        self._resize(entry)

    def _resize(self, homeless: tuple[bytes, int, list]) -> None:
        stored = [e for group in self.content for e in group] + [homeless]
        self.live -= len(stored)
        self._clear(self.groups * 2)
        for entry in stored:
            self.insert(*entry)

    def delete(self, digest: bytes, length: int) -> bool:
        """Removes a live digest; False if it is not there."""
        found = self._find(digest, length)
        if found is None:
            return False
        del self.filter[found[0]][found[1]], self.content[found[0]][found[1]]
        self.live -= 1
        return True

    def entries(self) -> Iterator[tuple[bytes, int, list]]:
        for group in self.content:
            yield from group


def _add(index: CuckooIndex, digests, lengths, ids, sizes) -> None:
    for digest, length, keep, size in zip(digests, lengths, ids, sizes):
        keep = None if keep is None or keep != keep else int(keep)
        value = index.get(digest, length)
        if value is None:
            index.insert(digest, length, [keep, size])
        else:
            value[0] = keep if value[0] is None or keep is not None and keep > value[0] else value[0]
            value[1] += size


def _frame(index: CuckooIndex) -> pd.DataFrame:
    rows = [(d, n, v[0], v[1]) for d, n, v in index.entries()]
    frame = pd.DataFrame(rows, columns=["_digest", "_length", "keep_id", "group_size"])
    return frame.astype({"_length": "int32", "keep_id": "Int64", "group_size": "int64"})


def addressed(docs: DataFrame) -> DataFrame:
    """docs with the content address of its normalised text; null text counts as empty."""
    text = lower_ascii("text")
    return docs.withColumns({"_digest": F.unhex(F.sha2(text.cast("binary"), 256)), "_length": F.octet_length(text)})


def index(rows: DataFrame, buckets: int, removed: DataFrame | None = None) -> DataFrame:
    """Live digests of rows (doc_id, _digest, _length, n) with their largest id and number of rows, by bucket.

    removed (_digest, _length) are deleted after all insertions: none of their rows stays.
    """

    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Copies that one batch holds become one row."""
        for f in frames:
            f = f.assign(doc_id=f["doc_id"].astype("Int64"))
            yield f.groupby(["_bucket", "_digest", "_length", "_gone"], as_index=False, sort=False).agg(keep_id=("doc_id", "max"), group_size=("n", "sum"))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        store = CuckooIndex()
        live = frame[~frame["_gone"]]
        _add(store, live["_digest"], live["_length"], live["keep_id"].astype(object).where(live["keep_id"].notna(), None), live["group_size"])
        for digest, length in frame.loc[frame["_gone"], ["_digest", "_length"]].itertuples(index=False):
            store.delete(digest, length)
        return _frame(store)

    bucket = F.pmod(F.conv(F.hex(F.substring("_digest", 1, 4)), 16, 10).cast("long"), F.lit(buckets)).cast("int").alias("_bucket")
    arrived = rows.select(bucket, "_digest", "_length", F.lit(False).alias("_gone"), "doc_id", "n")
    if removed is not None:
        gone = removed.select(bucket, "_digest", "_length", F.lit(True).alias("_gone"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n"))
        arrived = arrived.unionByName(gone)
    combined = arrived.mapInPandas(combine, "_bucket int, _digest binary, _length int, _gone boolean, keep_id long, group_size long")
    return combined.groupBy("_bucket").applyInPandas(fill, ENTRY)


def duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest doc_id stays; a
    null doc_id is smaller than any. Of repeated rows (same doc_id and text) one is kept. Other columns don't matter; an empty table
    gives no rows.
    """
    buckets = max(1, plan_bytes(docs) // BUCKET_BYTES)
    own = stage(addressed(docs.select("doc_id", "text")).groupBy("doc_id", "_digest", "_length").agg(F.count("*").alias("n")), "digests")
    live = index(own, buckets)
    copy = F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_copy")
    rows = own.join(live, ["_digest", "_length"]).select("doc_id", "keep_id", "group_size", "_digest", copy)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))


def orderable(docs: DataFrame) -> list[str]:
    """Columns that have an order."""
    return [f.name for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]


def deduplicate(docs: DataFrame) -> DataFrame:
    """The kept rows of docs, with all their columns. Of rows with equal doc_id and text the first one by all columns stays."""
    kept = duplicates(docs).where("kept").select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("digest"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), F.unhex(F.sha2(lower_ascii("text").cast("binary"), 256)).alias("own_digest"))
    found = own.join(kept, own["own_id"].eqNullSafe(kept["id"]) & (own["own_digest"] == kept["digest"]))
    order = [F.col(f"row.`{c}`") for c in orderable(docs)]
    place = F.row_number().over(Window.partitionBy("own_id", "own_digest").orderBy(*order))
    return found.withColumn("place", place).where("place = 1").select("row.*")
