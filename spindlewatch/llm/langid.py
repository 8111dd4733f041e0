"""Language identification by unigram pieces with all segmentations summed.

Every language has probabilities for the pieces of a fixed public vocabulary. A word's probability is the sum over all ways to cut it
into pieces, computed by a forward recursion over its characters; a text's is the product over its words. The probabilities are fitted
by expectation maximisation with forward and backward sums on the word counts of a bounded sample of labelled rows (SAMPLE_ROWS per
language); prediction reads every whole text. Words are scored together, by length, and remembered by a worker up to KNOWN_WORDS.

Words are runs of letters, lower-cased; a run of more than LONGEST_WORD letters counts as words of that many. A character that no piece
covers has the same small probability in every language. Pieces are found by 64-bit hashes of all short substrings at once.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlewatch.llm.common import bounded_batches, stage, texts, worker_memory
from spindlewatch.llm.fingerprints import mixed_bits

SAMPLE_ROWS = 1_500
ROUNDS = 2
SMOOTHING = 0.05
UNKNOWN = 1e-8
KNOWN_WORDS = 150_000
LONGEST_WORD = 4_096
GROUP_CELLS = 1 << 19
GROUP_BYTES = 1 << 20
FEW_WORDS = 128
BASE = 0x9E3779B97F4A7C15
FILTER_BITS = 20
UNDETERMINED = "und"
PREDICTED = "doc_id long, lang_pred string, score double"


@dataclass
class Model:
    """Languages in order and, for every piece (rows; then unknown and none), the probability in each."""

    languages: list[str]
    weights: np.ndarray
    vocabulary: str


class Pieces:
    """Piece numbers of a sentencepiece vocabulary and the lookups of words in it."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.n = len(names)
        self.widest = max(map(len, names))
        keys = np.array([self.key(np.array([[ord(c) + 1 for c in name]], np.uint64))[0] for name in names], np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("pieces with equal hashes")
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order.astype(np.int32)
        self.likely = np.zeros(1 << FILTER_BITS, bool)
        self.likely[self.keys >> np.uint64(64 - FILTER_BITS)] = True

    @staticmethod
    def key(letters: np.ndarray) -> np.ndarray:
        """Hashes of whole rows of letters."""
        total = np.zeros(len(letters), np.uint64)
        for j in range(letters.shape[1]):
            total = total * np.uint64(BASE) + letters[:, j]
        return mixed_bits(total + np.uint64(letters.shape[1]))

    def lookup(self, words: list[str]) -> np.ndarray:
        """For words of one length: the piece that ends at each character with each length; n is an unknown character, n + 1 no piece."""
        length = len(words[0])
        wide = min(self.widest, length)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length).astype(np.uint64) + np.uint64(1)
        found = np.full((len(words), length, wide), self.n + 1, np.int32)
        total = np.zeros_like(letters)
        for k in range(1, wide + 1):  # hashes of the k characters that end at each place, from those of k - 1
            total[:, k - 1 :] += letters[:, : length - k + 1] * np.uint64(pow(BASE, k - 1, 1 << 64))
            key = mixed_bits(total[:, k - 1 :] + np.uint64(k))
            row, at = np.nonzero(self.likely[key >> np.uint64(64 - FILTER_BITS)])
            own = key[row, at]
            place = np.minimum(np.searchsorted(self.keys, own), self.n - 1)
            hit = self.keys[place] == own
            found[row[hit], at[hit] + k - 1, k - 1] = self.ids[place[hit]]
        single = found[:, :, 0]
        single[single == self.n + 1] = self.n
        return found


def by_length(words: list[str], widest: int) -> Iterator[tuple[list[int], list[str]]]:
    """Places and words of groups of one length and bounded size."""
    places: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(len(w), []).append(i)
    for length, where in places.items():
        step = max(1, GROUP_CELLS // (length * min(length, widest)))
        for at in range(0, len(where), step):
            some = where[at : at + step]
            yield some, [words[i] for i in some]


def forward(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logarithm of the probability of each word in each language, over all segmentations."""
    m, length, wide = found.shape
    alpha = np.zeros((m, length + 1, weights.shape[1]))
    alpha[:, 0] = 1.0
    scale = np.zeros(m)
    for i in range(1, length + 1):
        near = min(wide, i)
        if m <= FEW_WORDS:  # few long words: all pieces that end here at once
            alpha[:, i] = (alpha[:, i - near : i][:, ::-1] * weights[found[:, i - 1, :near]]).sum(axis=1)
        else:
            for k in range(1, near + 1):
                alpha[:, i] += alpha[:, i - k] * weights[found[:, i - 1, k - 1]]
        low = alpha[:, i].min(axis=1) < 1e-90
        if low.any():  # keep the sums of long words within range
            up = 1.0 / np.maximum(alpha[low, i].max(axis=1), 1e-290)
            alpha[low, max(0, i - wide) : i + 1] *= up[:, None, None]
            scale[low] -= np.log(up)
    return np.log(np.maximum(alpha[:, length], 1e-300)) + scale[:, None]


def _sums(found: np.ndarray, weights: np.ndarray, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the segmentations of what stands before (or from) each place, each with the logarithm of its own scale."""
    m, length, wide = found.shape
    sums, scale = np.zeros((m, length + 1)), np.zeros((m, length + 1))
    start = length if backward else 0
    sums[:, start] = 1.0
    for step in range(1, length + 1):
        i = length - step if backward else step
        for k in range(1, min(wide, step) + 1):
            j, last = (i + k, i + k) if backward else (i - k, i)
            sums[:, i] += sums[:, j] * weights[found[:, last - 1, k - 1]]
        if step % 8 == 0:  # what the next places can reach goes back to about 1
            near = slice(i, min(length, i + wide) + 1) if backward else slice(max(0, i - wide), i + 1)
            most = sums[:, near].max(axis=1)
            up = 1.0 / np.where(most > 0, most, 1.0)
            sums[:, near] *= up[:, None]
            scale[:, near] -= np.log(up)[:, None]
        if step < length:
            following = i - 1 if backward else i + 1
            scale[:, following] = scale[:, i]
    return sums, scale


def expected(found: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in the words of one language, over all segmentations."""
    m, length, wide = found.shape
    (alpha, a), (beta, b) = _sums(found, weights, False), _sums(found, weights, True)
    whole = alpha[:, length]
    each = np.divide(counts, whole, out=np.zeros(m), where=whole > 0)
    uses = np.zeros(len(weights))
    for i in range(1, length + 1):
        for k in range(1, min(wide, i) + 1):
            own = found[:, i - 1, k - 1]
            shift = np.exp(np.minimum(a[:, i - k] + b[:, i] - a[:, length], 700.0))
            uses += np.bincount(own, alpha[:, i - k] * weights[own] * beta[:, i] * each * shift, len(weights))
    return uses


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased, with the mark of a word's beginning."""
    import regex

    return regex.findall(rf"\p{{L}}{{1,{LONGEST_WORD}}}", text.lower())


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _word_counts(docs: DataFrame, sample_rows: int) -> tuple[DataFrame, list[str]]:
    """Words of a bounded sample of labelled rows by language; which rows is decided by their ids alone."""
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    rows = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    languages = sorted(rows)
    share = F.lit(None).cast("double")
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_rows / rows[lang]))).otherwise(share)
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                found.update((lang, w) for w in words_of(text.decode()))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], names=["lang", "word", "n"])

    counted = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return stage(counted, "words"), languages


def fit(docs: DataFrame, vocabulary: str, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> Model:
    """A model of the languages among the labelled rows that are not held out."""
    bounded_batches(docs.sparkSession)
    counted, languages = _word_counts(docs, sample_rows)
    size = Pieces(vocabulary).n
    weights = np.full((size + 2, max(1, len(languages))), 1.0 / size)
    weights[size:] = [[UNKNOWN], [0.0]]
    for _ in range(rounds if languages else 0):
        current = weights

        def step(frames: Iterator[pd.DataFrame], current=current) -> Iterator[pd.DataFrame]:
            pieces, sums = worker_memory("langid", ("pieces", vocabulary), lambda: Pieces(vocabulary)), np.zeros_like(current)
            for frame in frames:
                for lang, own in frame.groupby("lang"):
                    column = languages.index(lang)
                    n = own["n"].to_numpy(float)
                    for places, words in by_length(["▁" + w for w in own["word"]], pieces.widest):
                        sums[:, column] += expected(pieces.lookup(words), current[:, column], n[places])
            piece, column = np.nonzero(sums[: pieces.n])
            yield pd.DataFrame({"piece": piece, "language": column, "n": sums[piece, column]})

        found = counted.mapInPandas(step, "piece int, language int, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()  # at most vocabulary times languages
        uses = np.full((size, len(languages)), SMOOTHING)
        uses[found["piece"], found["language"]] += found["n"]
        weights = np.vstack([uses / uses.sum(axis=0), current[size:]])
    return Model(languages, weights, vocabulary)


class Scorer:
    """Scores texts of one model and remembers up to KNOWN_WORDS words; a worker keeps one from task to task."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, worker_memory("langid", ("pieces", model.vocabulary), lambda: Pieces(model.vocabulary))
        self.known: dict[str, int] = {}
        self.scores = np.zeros((KNOWN_WORDS, len(model.languages)))

    def learn(self, words: set[str]) -> dict[str, int]:
        """Places of all these words in scores; more than it remembers are scored for this call alone, behind the others."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known.clear()
            new = list(words)
            self.scores = np.zeros((max(KNOWN_WORDS, len(new)), len(self.model.languages)))
        base = len(self.known)
        for places, some in by_length(["▁" + w for w in new], self.pieces.widest):
            self.scores[base + np.array(places)] = forward(self.pieces.lookup(some), self.model.weights)
        self.known.update(zip(new, range(base, base + len(new))))
        return self.known

    def totals(self, texts_: list[bytes]) -> list[np.ndarray | None]:
        """The logarithms of the probabilities of each text; None without a word."""
        split = [words_of(t.decode()) for t in texts_]
        place = self.learn({w for words in split for w in words}).__getitem__
        return [self.scores[list(map(place, words))].sum(axis=0) if words else None for words in split]

    def __call__(self, column: pa.Array) -> tuple[list[str], list[float]]:
        """Language and share of every text of a batch; texts go together up to GROUP_BYTES, a longer one in slices."""
        names, shares, some, size = [], [], [], 0

        def tell(totals: list[np.ndarray | None]) -> None:
            for total in totals:
                if total is None or not self.model.languages:
                    names.append(UNDETERMINED)
                    shares.append(0.0)
                    continue
                odds = np.exp(total - total.max())
                best = int(np.argmax(total))
                names.append(self.model.languages[best])
                shares.append(float(odds[best] / odds.sum()))

        for text in texts(column):
            if size + len(text) > GROUP_BYTES and some:
                tell(self.totals(some))
                some, size = [], 0
            if len(text) > GROUP_BYTES:
                parts = [t for t in (self.totals([s])[0] for s in slices(text)) if t is not None]
                tell([np.sum(parts, axis=0) if parts else None])
            else:
                some.append(text)
                size += len(text)
        if some:
            tell(self.totals(some))
        return names, shares


def slices(text: bytes) -> Iterator[bytes]:
    """A long text in slices that end after a byte of ASCII that is no letter; without one, after a whole character."""
    at = 0
    while at < len(text):
        end = min(len(text), at + GROUP_BYTES)
        if end < len(text):
            near = max(text.rfind(c, at + GROUP_BYTES // 2, end) for c in (b" ", b"\n", b".", b","))
            end = near + 1 if near >= 0 else end
            while end < len(text) and text[end] & 0xC0 == 0x80:
                end += 1
        yield text[at:end]
        at = end


def scorer(model: Model) -> Scorer:
    """The worker's scorer; one of another model is given up."""
    held, key = worker_memory("langid", ("scorer",), dict), (model.vocabulary, tuple(model.languages), model.weights.tobytes())
    if key not in held:
        held.clear()
        held[key] = Scorer(model)
    return held[key]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score (the language's share of the text's probability).

    Null text and text without a letter are undetermined with score 0; so is all text if no language was learned. Ties go to the first
    language by name. Repeated rows are predicted each, an empty table gives no rows, null ids are kept, other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in batches:
            names, shares = score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(shares, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, PREDICTED)


def keep(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, with all their columns, whose language has at least this share; no shuffle."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in batches:
            names, shares = score(batch.column(at))
            yield batch.filter(pa.array([n != UNDETERMINED and s >= least for n, s in zip(names, shares)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
