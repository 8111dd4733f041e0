"""Best-fit packing of token sequences by minimum bin slack.

Pieces of at most ``capacity`` tokens are counted by length. The counts are bounded by the capacity, whatever the input, so the
combinations are found on them: per sequence a bitset subset-sum over the lengths still available (bit s: a combination of s tokens
exists) gives the fullest feasible one, which is then removed, as often as its lengths last. Every piece learns its sequence from its
place among the pieces of its length; those places come from blocks of pieces and their counts, so a length that many pieces share
never meets in one task.

Defined cases: null text is empty and has the end token alone; repeated rows are packed as often as they occur; an empty table packs
to no rows; other columns are ignored; ties of equal pieces take any order, which does not change a row.
"""
from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindlewatch.llm.common import bounded_batches, parts, stage, texts, worker_memory

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"
KNOWN_WORDS = 300_000
KNOWN_RUNS = 200_000
PART_BYTES = 2 << 20
BLOCK_PIECES = 4_000


#: Latin letters and then ASCII punctuation other than the apostrophe: such a word is one run of each to this kind of vocabulary.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class WordEncoder:
    """Token ids of whole texts. White space never reaches a token of this kind of vocabulary, so words are encoded once and remembered.

    Plain words go to the vocabulary's merges at once; all others take the whole chain of its normalisation and splitting.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.known: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def _run(self, run: str) -> bytes:
        ids = self.runs.get(run)
        if ids is None:
            merged = self.tokenizer.model.tokenize(run if run.isascii() else self.bytewise(run)[0][0])
            ids = self.runs[run] = array("I", [t.id for t in merged]).tobytes()
        return ids

    def _learn(self, words: list[bytes]) -> None:
        rest = []
        if len(self.runs) > KNOWN_RUNS:
            self.runs.clear()
        for word in words:
            plain = PLAIN.fullmatch(word.decode())
            if plain is None:
                rest.append(word)
            else:
                letters, marks = plain.groups()
                self.known[word] = self._run(letters.lower()) + self._run(marks) if marks else self._run(letters.lower())
        for at in range(0, len(rest), 5_000):
            some = rest[at : at + 5_000]
            for word, found in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                self.known[word] = np.array(found.ids, "<u4").tobytes()

    def encode(self, documents: list[bytes]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids per document. The words of one batch are known together, so the memory has a bound."""
        split = [d.split() for d in documents]
        missing = list({w for words in split for w in words}.difference(self.known))
        if len(self.known) + len(missing) > KNOWN_WORDS:
            self.known.clear()
            missing = list({w for words in split for w in words})
        self._learn(missing)
        get = self.known.__getitem__
        for words in split:
            yield b"".join(map(get, words))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: only documents longer than the capacity are cut."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = worker_memory("packing", ("words", tokenizer), lambda: WordEncoder(tokenizer)), np.array([end_id], "<u4").tobytes()
        for batch in (p for whole in batches for p in parts(whole, 1, PART_BYTES)):
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(list(texts(batch.column(1))))):
                ids += end
                for n, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    out.append((doc_id, n, start // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How often each length is taken by the fullest combination that fits; of equally full ones, that of the longest pieces."""
    reach, trail, mask = 1, [], (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, step = min(counts[length], capacity // length), 1
        while left and not reach >> capacity & 1:
            take = min(step, left)
            trail.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left, step = left - take, step * 2
    total, taken = reach.bit_length() - 1, {}
    for length, take, before in reversed(trail):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + take
            total -= length * take
    return taken


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Combinations and how many sequences each fills, until no piece is left."""
    left, plan = {length: n for length, n in counts.items() if n}, []
    while left:
        combination = fullest(left, capacity)
        times = min(left[length] // n for length, n in combination.items())
        plan.append((times, combination))
        for length, n in combination.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return plan


def slots(plan: list[tuple[int, dict[int, int]]]) -> pd.DataFrame:
    """For each length, ranges of its pieces: the first piece, the first sequence, how many a sequence takes, where they begin in it."""
    rows, sequence, used = [], 0, {}
    for times, combination in plan:
        at = 0
        for length, n in sorted(combination.items(), reverse=True):
            first = used.get(length, 0)
            rows.append((length, first, sequence, n, at))
            used[length] = first + n * times
            at += n * length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "uses", "at"]).sort_values(["length", "first"], ignore_index=True)


def places(rows: DataFrame) -> DataFrame:
    """Adds place: the number of a piece among those of its length, from 0."""
    n = rows.count()
    blocks = max(1, n // BLOCK_PIECES)
    blocked = rows.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"))
    inside = Window.partitionBy("length", "_block").orderBy("doc_id", "piece", "start", "ids_crc32")
    earlier = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocked.groupBy("length", "_block").count().withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    numbered = blocked.withColumn("_inner", F.row_number().over(inside) - 1)
    return numbered.join(before.drop("count"), ["length", "_block"]).select(*rows.columns, (F.col("_before") + F.col("_inner")).cast("long").alias("place"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of docs with the sequence that holds them and their offset there."""
    rows = stage(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most one row per length
    ranges = slots(minimum_bin_slack(counts, capacity))
    length, first, sequence, uses, at = (ranges[c].to_numpy(np.int64) for c in ranges)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = np.searchsorted(length, np.arange(capacity + 2))
        for frame in frames:
            own, rank = frame["length"].to_numpy(), frame["place"].to_numpy()
            row = np.empty(len(frame), np.int64)
            for value in np.unique(own):
                these = own == value
                a, b = starts[value], starts[value + 1]
                row[these] = a + np.searchsorted(first[a:b], rank[these], side="right") - 1
            inner = rank - first[row]
            frame["sequence_id"] = sequence[row] + inner // uses[row]
            frame["offset"] = at[row] + inner % uses[row] * own
            yield frame.drop(columns="place")

    columns = [c.split()[0] for c in PIECES.split(", ")]
    return places(rows).select(*columns, "place").mapInPandas(place, PACKED)
