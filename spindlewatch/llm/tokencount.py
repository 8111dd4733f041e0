"""Token counts of the sections of a document, from one encoding of the whole document.

The tokens of a byte-level vocabulary cover the text's bytes without gaps, so the running sum of their byte lengths gives every token's
span. The spans are joined with the sections' intervals by binary search on the borders. A token that crosses a border is allocated by a
named rule: ``start`` (the section of its first byte), ``end`` (of its last byte), ``majority`` (most bytes, the earlier one on a tie)
or ``split`` (to each section the share of its bytes).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spindlewatch.llm.common import bounded_batches, texts, worker_memory

#: A longer run of white space is encoded apart: the library's pattern engine recurses over it.
LONG_BLANK = 4_096
RULES = ("start", "end", "majority", "split")
COUNTED = "doc_id long, section int, start_byte long, n_bytes long, tokens double, crossing long, doc_tokens long"


def line_borders(text: bytes) -> np.ndarray:
    """Sections are lines, each with its line feed; the borders include 0 and the end."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.unique(np.concatenate([[0], ends, [len(text)]]))


def attribute(starts: np.ndarray, ends: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section between two borders, and how many tokens of it cross one of its borders."""
    n = len(borders) - 1
    first = np.searchsorted(borders, starts, side="right") - 1
    last = np.searchsorted(borders, ends, side="left") - 1
    crosses = first != last
    plain = np.bincount(first[~crosses], minlength=n).astype(float)
    touched = np.zeros(n, np.int64)
    for t in np.flatnonzero(crosses):
        a, b = first[t], last[t]
        touched[a : b + 1] += 1
        share = np.minimum(borders[a + 1 : b + 2], ends[t]) - np.maximum(borders[a : b + 1], starts[t])
        if rule == "start":
            plain[a] += 1
        elif rule == "end":
            plain[b] += 1
        elif rule == "majority":
            plain[a + int(np.argmax(share))] += 1
        else:
            plain[a : b + 1] += share / share.sum()
    return plain, touched


def encode(coder, text: str) -> list[int]:
    """All tokens of a text, also where it has very long runs of white space.

    The splitting pattern takes white space up to the last character before other text as one piece, and no piece reaches into it from
    the left; so the text can be cut before such a run and before its last character, or at the end of a run that ends the text.
    """
    import regex

    out, at = [], 0
    for run in regex.finditer(rf"\s{{{LONG_BLANK},}}", text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += coder.encode_ordinary(text[at : run.start()])
        out += coder._encode_single_piece(text[run.start() : end])
        at = end
    return out + coder.encode_ordinary(text[at:]) if out else coder.encode_ordinary(text[at:])


def coder_of(ranks: str, pattern: str) -> tuple:
    """The encoder of a vocabulary file and the byte length of each of its tokens."""
    import base64

    import tiktoken

    with open(ranks, "rb") as f:
        pieces = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(pieces.values()) + 1, np.int64)
    for piece, rank in pieces.items():
        size[rank] = len(piece)
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=pieces, special_tokens={}), size


def section_tokens(docs: DataFrame, ranks: str, pattern: str, rule: str = "majority", borders=line_borders) -> DataFrame:
    """Per section of each row of docs: doc_id, section (from 0), start_byte, n_bytes, tokens, crossing, doc_tokens.

    ranks is a vocabulary file of base64 pieces and ranks, pattern its splitting pattern. Null or empty text has one empty section
    without tokens; repeated rows are counted each; an empty table gives no rows; other columns are ignored; null ids are kept.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, size = worker_memory("tokencount", (ranks, pattern), lambda: coder_of(ranks, pattern))
        for batch in batches:
            ids, parts = batch.column(0).to_pylist(), [[] for _ in range(7)]
            for doc_id, text in zip(ids, texts(batch.column(1))):
                tokens = np.array(encode(coder, text.decode()), np.int64)
                ends = np.cumsum(size[tokens])
                edges = borders(text) if text else np.array([0, 0])
                if len(tokens):
                    counts, crossing = attribute(ends - size[tokens], ends, edges, rule)
                else:
                    counts, crossing = np.zeros(1), np.zeros(1, np.int64)
                n = len(counts)
                for part, values in zip(parts, ([doc_id] * n, range(n), edges[:-1], np.diff(edges), counts, crossing, [len(tokens)] * n)):
                    part.extend(values)
            if ids:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(p, k) for p, k in zip(parts, kinds)], names=[c.split()[0] for c in COUNTED.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, COUNTED)
