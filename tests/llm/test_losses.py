"""What must not be lost or overwritten: long blanks and words, many rows in a batch, clashing columns, retried writers, hot keys, pipeline rows."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("spindlewatch.llm")

from pyspark.sql import functions as F  # noqa: E402

from spindlewatch.llm import cuckoo, langid, mixing, ngramjoin, packing, suffixes, tokencount, warc  # noqa: E402
from spindlewatch.llm.common import parts, stage  # noqa: E402
from spindlewatch.llm.queries import vocabulary  # noqa: E402

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sig tau ups".split()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def coder():
    import public_tokenizers

    return tokencount.coder_of(vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_encoding_around_long_blanks(monkeypatch):
    own, size = coder()
    assert size[tokencount.encode(own, "a" + " " * 1_000_000 + "b")].sum() == 1_000_002
    monkeypatch.setattr(tokencount, "LONG_BLANK", 4)
    rng = random.Random(1)
    pieces = [" ", "  ", "\n", "\t", "a", "b!", "'s", "7", "é", " " * 9, "　", " ", "\x85", "\x1c", "\r\n"]
    for _ in range(3_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert tokencount.encode(own, text) == own.encode_ordinary(text), repr(text)


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_sections_one_by_one(spark, rule):
    import public_tokenizers

    rng = random.Random(2)
    texts = [None, "", "\n", "one line", "a\n\n\nb", "é\nü  \n  x"] + ["".join(rng.choice(["a b", " ", "\n", "\n\n", "word ", "   ", "Ünder"]) for _ in range(40)) for _ in range(15)]
    docs = spark.createDataFrame([(i, t, 5, "s") for i, t in enumerate(texts)], "doc_id long, text string, tokens int, section string")
    got = {(r["doc_id"], r["section"]): (r["start_byte"], r["n_bytes"], r["tokens"], r["crossing"], r["doc_tokens"]) for r in tokencount.section_tokens(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, rule).collect()}
    own, size = coder()
    want = {}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        lines = re.findall(rb"[^\n]*\n|[^\n]+", data) or [b""]
        starts = [sum(map(len, lines[:k])) for k in range(len(lines) + 1)]
        counts, crossing, at, ids = [0.0] * len(lines), [0] * len(lines), 0, own.encode_ordinary(text or "")
        for token in ids:
            a, b = at, at + int(size[token])
            inside = [max(0, min(b, starts[k + 1]) - max(a, starts[k])) for k in range(len(lines))]
            touched = [k for k, n in enumerate(inside) if n]
            if len(touched) > 1:
                for k in touched:
                    crossing[k] += 1
            if rule == "split":
                for k in touched:
                    counts[k] += inside[k] / (b - a)
            else:
                counts[{"start": touched[0], "end": touched[-1], "majority": max(touched, key=lambda k: (inside[k], -k))}[rule]] += 1
            at = b
        for k, line in enumerate(lines):
            want[i, k] = (starts[k], len(line), counts[k], crossing[k], len(ids))
    assert set(got) == set(want)
    for k, (start, n, count, cross, whole) in want.items():
        assert got[k][:2] == (start, n) and got[k][3:] == (cross, whole) and math.isclose(got[k][2], count, abs_tol=1e-9)


def test_expected_uses_of_long_words():
    pieces = langid.Pieces(vocabulary("piece_bpe_32k.model"))
    weights = np.full(pieces.n + 2, 1.0 / pieces.n)
    weights[-2:] = [langid.UNKNOWN, 0.0]
    for words in (["▁the", "▁cat"], ["▁" + "internationalisation" * 4] * 2, ["▁" + "ab" * 1_500]):
        found = pieces.lookup(words)
        uses = langid.expected(found, weights, np.ones(len(words)))
        length = np.full(len(weights), 0.0)
        for row, at, k in zip(*np.nonzero(found <= pieces.n)):
            length[found[row, at, k]] = k + 1
        assert np.isclose((uses * length).sum(), sum(map(len, words)), rtol=1e-6)  # the pieces of every word cover it once
    few, many = pieces.lookup(["▁internationalisation"]), pieces.lookup(["▁internationalisation"] * 200)
    both = np.stack([weights, weights], axis=1)
    assert np.allclose(langid.forward(few, both)[0], langid.forward(many, both)[7])


def test_pieces_are_found_by_their_hashes():
    import sentencepiece

    pieces, model = langid.Pieces(vocabulary("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    names = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ids = {n: i for i, n in enumerate(names)}
    for word in ("▁wonderful", "▁straße", "▁日本語", "▁x"):
        found = pieces.lookup([word])[0]
        for i in range(1, len(word) + 1):
            for k in range(1, min(pieces.widest, len(word)) + 1):
                want = ids.get(word[i - k : i], pieces.n if k == 1 else pieces.n + 1) if k <= i else pieces.n + 1
                assert found[i - 1, k - 1] == want


def test_words_above_48_letters_are_learned(spark):
    rows = [(i, " ".join(["ta" * 30, "ka" * 31][j % 2] for j in range(8)) if i % 2 else " ".join(["schung" * 10, "einer" * 13][j % 2] for j in range(8)), ["bb", "aa"][i % 2]) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, vocabulary("piece_bpe_32k.model"))
    got = langid.predict(docs, model).collect()
    assert all(r["lang_pred"] == ["bb", "aa"][r["doc_id"] % 2] and r["score"] > 0.99 for r in got)
    long_ = spark.createDataFrame([(1, "ta" * 600_000), (2, "12 " * 500_000 + "einer" * 20)], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(long_, model).collect()} == {1: "aa", 2: "bb"}


def test_parts_of_a_batch():
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(9)), pa.array(["aaaa", None, "bb", "", "c" * 30, "d", "e", "f", "gg"])], names=["i", "t"])
    found = [p.column(0).to_pylist() for p in parts(batch.slice(1), 1, 4, 3)]
    assert sum(found, []) == list(range(1, 9)) and max(map(len, found)) <= 3
    assert [p.num_rows for p in parts(batch, 1, 1 << 20)] == [9] and not list(parts(batch.slice(0, 0), 1, 5))


@pytest.fixture()
def whole_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "0")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_more_rows_than_16_bits_in_a_batch(spark, whole_batches):
    n = 70_000
    ids = spark.range(n).coalesce(1)
    text = F.when(F.col("id") % 10_000 == 7, F.concat(F.lit("one two three four five six seven eight nine ten "), F.lit("x y z " * 9))).otherwise(F.concat(F.lit("w"), "id"))
    docs = stage(ids.select(F.col("id").alias("doc_id"), text.alias("text")).coalesce(1), "short-rows")
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.classes(docs).collect()}
    assert len(got) == n and all(c == (7 if i % 10_000 == 7 else i) for i, c in got.items())
    cut = {r["doc_id"]: r["n_removed"] for r in suffixes.dedup(docs).collect()}
    size = len("one two three four five six seven eight nine ten " + "x y z " * 9)
    assert len(cut) == n and all(c == (size if i % 10_000 == 7 and i != 7 else 0) for i, c in cut.items())


def removed(texts):
    first = {}
    for i in sorted(texts):
        for p in range(len(texts[i]) - 49):
            first.setdefault(texts[i][p : p + 50], i)
    out = {}
    for i, b in texts.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        out[i] = int(gone.sum())
    return out


@pytest.mark.parametrize("hot, windows", [(3, 1 << 17), (20_000, 64)])
def test_hot_anchors_and_small_sorts(spark, monkeypatch, hot, windows):
    monkeypatch.setattr(suffixes, "HOT_ANCHOR", hot)
    monkeypatch.setattr(suffixes, "SORT_WINDOWS", windows)
    rng = np.random.default_rng(6)
    phrase = "this phrase of sixty letters stands in very many documents ok"
    text = lambda n: " ".join(rng.choice(WORDS, n))
    rows = [(i, f"{text(6)} {phrase} {text(7)} {phrase[10:45]} {text(3)}") for i in range(40)] + [(100, "q" * 300), (101, "q" * 120 + "r"), (102, rows_text := text(60)), (103, rows_text[13:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["n_removed"] for r in suffixes.dedup(docs).collect()}
    assert got == removed({i: t.encode() for i, t in rows}) and sum(v > 0 for v in got.values()) > 35


def test_a_hot_list_is_split(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "PAIRS_AT_ONCE", 3)
    monkeypatch.setattr(ngramjoin, "SHARD_TOKENS", 500)
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(base[: i % 4 + 60] + [f"e{i}"] + base[i % 4 + 60 :])) for i in range(50)]
    got = ngramjoin.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 50


def test_callers_columns_stay(spark):
    rows = [(1, "Alpha beta", "en", "a", "mine", 7, 1), (2, "alpha BETA", "en", "a", "yours", 8, 2), (3, None, None, None, "none", 9, 3), (3, "", "de", "b", "other", 9, 4), (3, "", "de", "a", "other", 9, 5), (None, "x y z", "en", "a", "n", 1, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _digest string, _size int, _n int")
    kept = sorted(map(tuple, cuckoo.deduplicate(docs).collect()), key=str)
    assert kept == sorted([rows[1], rows[2], rows[5]], key=str) and cuckoo.deduplicate(docs).columns == docs.columns
    again = sorted(map(tuple, cuckoo.deduplicate(docs.repartition(7)).collect()), key=str)
    assert kept == again
    out = [tuple(r) for r in mixing.mixed(docs, [3, 1, 2]).collect()]
    assert set(out) <= set(rows) and len(out) >= 2 and mixing.mixed(docs, [3, 1, 2]).columns == docs.columns


def test_distributed_deletion(spark):
    docs = spark.createDataFrame([(i, f"text {i % 50}") for i in range(300)], "doc_id long, text string")
    own = cuckoo.addressed(docs).withColumn("n", F.lit(1).cast("long"))
    gone = own.where("doc_id % 50 < 20").select("_digest", "_length").distinct()
    live = cuckoo.index(own.select("doc_id", "_digest", "_length", "n"), 4, gone).collect()
    assert sorted((r["keep_id"], r["group_size"]) for r in live) == [(250 + k, 6) for k in range(20, 50)]


def shared_targets(sizes, weights, budget, cap):
    """Sources in order, the excess of those above their cap shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total, stopped = {s: weights[i % len(weights)] for i, s in enumerate(order)}, budget * sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in order if s not in stopped)
        left = total - sum(cap * sizes[s] for s in stopped)
        out = {s: cap * sizes[s] if s in stopped else left * weight[s] / free for s in order} if free else {s: cap * sizes[s] for s in order}
        above = {s for s in order if s not in stopped and out[s] > cap * sizes[s]}
        if not above:
            return out
        stopped |= above


@pytest.mark.parametrize("block_rows, fanout", [(2_000, 1_000), (5, 2)])
def test_targets_and_levels_of_the_mix(spark, block_rows, fanout):
    rng = random.Random(3)
    rows = [(i, " ".join(WORDS[: rng.randint(0, 20)]), rng.choice(["b", "a", "ä", "c", "aa", None, "z", "z", "z"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix(docs, [3, 1, 2], block_rows=block_rows, fanout=fanout).toPandas()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = shared_targets(sizes, [3, 1, 2], 1.5, 2.0)
    for s, own in plan.groupby(plan.source.fillna("")):
        key = None if s == "" else s
        assert np.allclose(own.target, want[key]) and abs(own.taken.sum() - want[key]) <= 1 and (own.taken <= 2 * own["size"]).all()


def test_blocks_of_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 7)
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 3, 5, 9, 30])))) for i in range(200)], "doc_id long, text string")
    found = packing.pack(docs, vocabulary("word_bpe_49k.json"), 32, 1).toPandas()
    placed = found.sort_values(["sequence_id", "offset"])
    ends = (placed.offset + placed.length).groupby(placed.sequence_id).shift(fill_value=0)
    assert (ends == placed.offset).all() and (placed.offset + placed.length).max() <= 32 and found.sequence_id.nunique() <= 1.15 * found.length.sum() / 32 + 1


def test_small_payloads_and_stale_archives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "tiny"), (2, "u", "tiny"), (3, "u", "long enough to share"), (5, None, "long enough to share"), (4, "v", "long enough to share"), (4, "v", "long enough to share")], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages, 10).collect())
    assert got == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3), (4, "revisit", 3), (5, "revisit", 3)]
    folder = f"file://{tmp_path}"
    written = stage(warc.write(pages, folder), "archives")
    (tmp_path / "part-000000-99-0000.warc.zst").write_bytes(warc.archive([warc.record("response", 77, 0, "u", b"x", warc.base32_sha1(b"x"), 1, None)]))
    assert warc.read(spark, folder).count() == 7 and sorted(r["page_id"] for r in warc.read(spark, folder, written).collect()) == [1, 2, 3, 4, 4, 5]


def test_pipeline_rows(spark):
    """Every stage against plain Python on its own input: copies, near copies, null ids, repeated rows and columns with clashing names."""
    import corpus_pipeline

    rng, sounds = np.random.default_rng(1), {"aa": ["ta", "ka", "ri", "mo"], "bb": ["sch", "ung", "ein", "er"]}
    text = lambda lang, n=40: " ".join("".join(rng.choice(sounds[lang], 3)) for _ in range(n))
    rows = [(i, text(["aa", "bb"][i % 2]), ["aa", "bb"][i % 2], f"s{i % 3}", f"d{i}", i) for i in range(120)]
    base = text("aa", 120).split()
    rows[8] = (8, " ".join(base), *rows[8][2:])
    rows += [(200 + k, " ".join([*base[:20], f"extra{'abcdefgh'[k]}", *base[20:]]), "aa", "s1", "near", 1) for k in range(8)]
    rows += [(300, rows[3][1].upper(), "bb", "s0", "copy", 2), (301, "12 34", "aa", "s0", "none", 3), (302, None, None, None, "null", 4), (None, rows[5][1] + " mokata", "bb", "s2", "id", 5), rows[9], rows[9]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _digest string, n int")
    stages = dict(corpus_pipeline.STAGES)
    read = lambda df: sorted(map(tuple, df.collect()), key=str)

    spoken = stage(stages["language_id"](spark, docs, ""), "t1")
    assert read(spoken) == sorted([r for r in rows if r[0] not in (301, 302)], key=str)
    unique = stage(stages["exact_dedup"](spark, spoken, ""), "t2")
    best = {}
    for r in read(spoken):
        key = r[1].translate(LOWER)
        best[key] = max([best[key], r], key=lambda x: (-1 if x[0] is None else x[0])) if key in best else r
    assert read(unique) == sorted(best.values(), key=str)
    apart = stage(stages["ngram_join"](spark, unique, ""), "t3")
    shingles = {r[0]: {tuple(r[1].translate(LOWER).split()[i : i + 5]) for i in range(len(r[1].split()) - 4)} for r in best.values() if r[0] is not None}
    root = {i: i for i in shingles}
    for _ in range(3):
        for a in root:
            for b in root:
                if a < b and 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert read(apart) == sorted([r for r in best.values() if r[0] is None or root[r[0]] == r[0]], key=str) and apart.count() < unique.count() - 6
    mixed = stage(stages["source_mix"](spark, apart, ""), "t4")
    sizes = Counter()
    for r in read(apart):
        sizes[r[3]] += len(r[1].split())
    taken = Counter()
    for r in read(mixed):
        taken[r[3]] += len(r[1].split())
    want = shared_targets(sizes, [3, 1, 2], 1.5, 2.0)
    assert set(read(mixed)) <= set(read(apart)) and all(abs(taken[s] - want[s]) <= 121 for s in sizes) and max(Counter(read(mixed)).values()) <= 2
    packed = stages["packing"](spark, mixed, "").toPandas()
    copies = Counter(r[0] for r in read(mixed))
    assert Counter(None if x != x else int(x) for x in packed.loc[packed.piece == 0, "doc_id"].astype(float)) == copies
