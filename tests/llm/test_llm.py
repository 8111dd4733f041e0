"""Operators of the training-data pipeline against brute force on small tables with nulls, ties, repeated rows and clashing columns."""
import hashlib
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("spindlewatch.llm")

from spindlewatch.llm import cuckoo, langid, mixing, ngramjoin, packing, suffixes, tokencount, topk, urlfilter, warc  # noqa: E402
from spindlewatch.llm.queries import RULES, vocabulary  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _digest string, n long, label int, share double"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sig tau ups".split()


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None, "x", 1, 2, 0.5) for i, t, lang, source in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    base, passage = text(90), text(25)
    out = [(1, base, "en", "b"), (2, base.upper(), "en", "a"), (3, base + " tail end", "en", None), (4, None, None, "b"), (5, "", "en", "a"), (6, "  \n", "en", "a")]
    out += [(7, text(40) + " " + passage + " " + text(40), "de", "c"), (8, passage + " " + text(60), "de", "c"), (9, "one two", "en", "c"), (10, "One  two", "en", "c"), (11, "ß" * 9_000, None, "a")]
    return out + [(12 + k, base.replace("alpha", "omega", k % 3) + f" extra{k}", "en", "b") for k in range(20)]


def test_packing(spark, rows):
    docs = documents(spark, rows + rows[:1])
    found = packing.pack(docs, vocabulary("word_bpe_49k.json"), 64, 1).toPandas()
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for doc_id, text, *_ in rows:
        ids = coder.encode(text or "", add_special_tokens=False).ids + [1]
        want = [(k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64)]
        own = found[found.doc_id == doc_id].sort_values("piece")
        assert sorted(set(own[["piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))) == want
        assert len(own) == len(want) * (2 if doc_id == 1 else 1)
    placed = found.sort_values(["sequence_id", "offset"])
    ends = (placed.offset + placed.length).groupby(placed.sequence_id).shift(fill_value=0)
    assert (ends == placed.offset).all() and (placed.offset + placed.length).max() <= 64
    assert found.sequence_id.nunique() <= 1.1 * found.length.sum() / 64 + 1
    assert packing.pack(docs.where("false"), vocabulary("word_bpe_49k.json")).count() == 0


def test_minimum_bin_slack_is_full_where_it_can_be():
    plan = packing.minimum_bin_slack({60: 2, 40: 1, 25: 2, 15: 1}, 100)
    assert sum(t for t, _ in plan) == 3 and sorted(sum(n * u for n, u in c.items()) for _, c in plan)[-1] == 100


def test_url_rules(spark):
    urls = [(1, "HTTP://Blog.Example.COM/en/x?q#f"), (2, "https://www.example.com/en/"), (3, "https://example.com"), (4, None), (5, "nothing"), (6, "x://a.net/es/1"), (6, "x://a.net/es/1"), (None, "x://evilexample.com/en/"), (7, "x://b.org/")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in urls], "page_id long, url string, html string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted((tuple(r) for r in urlfilter.judge(pages, rules).collect()), key=str)
    want = [
        (1, "blog.example.com", "/en/x", "example.com/en/", "block"), (2, "www.example.com", "/en/", "www.example.com/en/", "allow"), (3, "example.com", "", None, "allow"), (4, "", "", None, "allow"),
        (5, "", "", None, "allow"), (6, "a.net", "/es/1", "net/es/", "block"), (6, "a.net", "/es/1", "net/es/", "block"), (None, "evilexample.com", "/en/", "com/", "allow"), (7, "b.org", "/", None, "allow"),
    ]
    assert got == sorted(want, key=str)
    assert urlfilter.judge(pages, rules.where("false")).where("verdict = 'allow'").count() == len(urls)
    assert urlfilter.judge(pages.where("false"), rules).count() == 0


def test_warc_round_trip(spark):
    pages = [(3, "u", "same"), (1, "v\r\nX: y", "same"), (2, None, None), (4, "w", ""), (None, "n", "same"), (5, "p", "é" * 50_000), (3, "u", "same")]
    df = spark.createDataFrame([(*p, "r") for p in pages], "page_id long, url string, html string, record_type string")
    got = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str)
    first = {"same": 1, "": 2, "é" * 50_000: 5}
    want = [(i, len((h or "").encode()), warc.base32_sha1((h or "").encode()), *(("response", None) if i == first[h or ""] else ("revisit", first[h or ""]))) for i, _, h in pages]
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.where("false")).count() == 0


def test_archive_is_readable():
    records = [warc.record("response", i, 0, "u", b"x" * i, "D", i, None) for i in range(30)]
    assert [block for _, block in warc.parse(warc.archive(records))] == [b"x" * i for i in range(30)]


def test_cuckoo_index_inserts_deletes_and_grows():
    store, keys = cuckoo.CuckooIndex(2), [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(3_000)]
    for i, k in enumerate(keys):
        store.insert(k, i, [i, 1])
    assert store.live == 3_000 and all(store.get(k, i) == [i, 1] for i, k in enumerate(keys))
    assert all(store.delete(k, i) for i, k in enumerate(keys) if i % 2) and not store.delete(keys[1], 1)
    assert [store.get(k, i) is None for i, k in enumerate(keys)] == [bool(i % 2) for i in range(3_000)]


def test_exact_duplicates(spark, rows):
    own = rows + [(None, "", "en", "a"), rows[0]]
    got = cuckoo.duplicates(documents(spark, own)).toPandas()
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t, *_ in own:
        groups.setdefault(lower(t), []).append(i)
    assert len(got) == len(own) and got.kept.sum() == len(groups)
    for r in got.itertuples():
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(groups[text]) and r.keep_id == max(i for i in groups[text] if i is not None)
    assert cuckoo.deduplicate(documents(spark, own)).count() == len(groups)
    assert cuckoo.duplicates(documents(spark, [])).count() == 0


def test_section_tokens(spark, rows):
    import public_tokenizers

    df = documents(spark, rows + [(99, "a\n\nbb  \n cc", "en", "a")])
    for rule in tokencount.RULES:
        got = tokencount.section_tokens(df, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, rule).toPandas()
        sums = got.groupby("doc_id").agg(tokens=("tokens", "sum"), whole=("doc_tokens", "first"), size=("n_bytes", "sum"))
        assert np.allclose(sums.tokens, sums.whole) and sums["size"].to_dict()[7] == len(rows[6][1].encode())
    assert got[got.doc_id == 99].n_bytes.tolist() == [2, 1, 5, 3] and got[got.doc_id == 4].tokens.tolist() == [0.0]


def test_repeated_strings(spark, rows):
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    first = {}
    for i in sorted(texts):
        for p in range(len(texts[i]) - 49):
            first.setdefault(texts[i][p : p + 50], i)
    want = {}
    for i, b in texts.items():
        gone = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p + 1 : p + 51] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])
        want[i] = (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    got = suffixes.dedup(documents(spark, rows + [(None, rows[0][1], "en", "a"), rows[6]])).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        assert tuple(r)[1:] == (want[r.doc_id] if r.doc_id else (len(texts[1]), 0, 0, hashlib.sha256(texts[1]).hexdigest()))


def test_hash_compared_sort():
    data = np.frombuffer(b"abab" * 40 + b"abac" * 20, np.uint8)
    s, at = suffixes.Suffixes(data), np.arange(len(data) - 50)
    order = s.sort(at, np.zeros(len(at), np.int64))
    cut = [data[p : p + 50].tobytes() for p in at[order]]
    assert cut == sorted(cut) and sorted(order) == list(range(len(at)))


def test_ngram_join(spark, rows):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = ngramjoin.classes(documents(spark, rows + rows[:1])).collect()
    assert sorted(map(tuple, got)) == sorted((i, len(sets[i]), root[i]) for i in [*sets, 1])
    assert ngramjoin.classes(documents(spark, [])).count() == 0


def test_ngram_join_of_many_edited_copies(spark):
    """Copies with few and many edits from a small vocabulary, so that edited shingles are shared too and most pairs stay below the threshold."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(100)]
    rows, sets = [], {}
    for i in range(60):
        words = list(base)
        for at in rng.integers(0, 20, rng.integers(0, 7)) * 5:
            words[at] = rng.choice(WORDS[:2])
        rows.append((i, " ".join(words[: 100 - i % 3]), "en", "a"))
        sets[i] = {tuple(rows[-1][1].split()[k : k + 5]) for k in range(96 - i % 3)}
    root = {i: i for i in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    assert 1 < len(set(root.values())) < len(sets)
    got = ngramjoin.classes(documents(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted((i, len(sets[i]), root[i]) for i in sets)


def test_mix(spark, rows):
    docs = documents(spark, rows + [(40 + i, " ".join(WORDS), "en", f"s{i % 4}") for i in range(60)])
    plan = mixing.mix(docs, [3, 1, 2]).toPandas()
    size = plan.groupby("source", dropna=False)["size"].sum()
    assert abs(plan.groupby("source", dropna=False).target.first().sum() - 1.5 * size.sum()) < 1e-6
    by = plan.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.target - by.taken) <= 1).all() and (plan.taken <= 2 * plan["size"]).all() and (by.target <= 2 * size + 1e-9).all()
    key = ["doc_id", "taken"]
    assert sorted(plan[key].itertuples(index=False)) == sorted(mixing.mix(docs, [3, 1, 2]).toPandas()[key].itertuples(index=False))
    assert mixing.mix(docs.where("false"), [1]).count() == 0 and mixing.mixed(docs, [3, 1, 2]).columns == docs.columns


def test_language(spark):
    rng, sounds = np.random.default_rng(1), {"aa": ["ta", "ka", "ri", "mo"], "bb": ["sch", "ung", "ein", "er"]}
    text = lambda lang: " ".join("".join(rng.choice(sounds[lang], 3)) for _ in range(30))
    rows = [(i, text(lang), lang, "s") for i in range(120) for lang in [["aa", "bb"][i % 2]]]
    docs = documents(spark, rows + [(500, None, "aa", "s"), (501, "12 !", "aa", "s"), (None, text("bb"), "bb", "s")])
    got = langid.predict(docs, langid.fit(docs, vocabulary("piece_bpe_32k.model"))).toPandas()
    pred = dict(zip(got.doc_id, got.lang_pred))
    assert all(pred[i] == lang for i, _, lang, _ in rows) and pred[500] == pred[501] == "und" and len(got) == len(rows) + 3
    assert got.score.between(0, 1).all()


def test_forward_sums_all_segmentations():
    found = np.array([[[0, 9, 9], [1, 2, 9], [0, 3, 4]]], np.int32)
    w = np.zeros((10, 1))
    w[:5, 0] = [0.5, 0.25, 0.125, 0.1, 0.05]
    # a|b|a + ab|a + a|ba + aba
    assert np.isclose(np.exp(langid.forward(found, w))[0, 0], 0.5 * 0.25 * 0.5 + 0.125 * 0.5 + 0.5 * 0.1 + 0.05)


def test_topk(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, (rng.normal(size=8) * (1 + i % 5)).tolist()) for i in range(400)] + [(400 + i, [0.5] * 8) for i in range(30)]
    bad = [(900, None), (920, [None] * 8), (940, [float("nan")] * 8), (960, []), (None, [1.0] * 8), (980, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors + bad], "vec_id long, embedding array<float>, rank int, score int")
    q = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors}
    want = []
    for i in (x for x in q if x % 20 == 0):
        best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:20]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    for share_rows, query_block in ((topk.SHARE_ROWS, topk.QUERY_BLOCK), (40, 3)):
        got = topk.search(df, df.where("vec_id % 20 = 0"), 20, share_rows=share_rows, query_block=query_block).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk.search(df.where("false"), df, 5).count() == 0


def test_pipeline_keeps_columns(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.stage(out, "test")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()


def test_chunks_are_pruned_before_they_are_multiplied():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 12)) * 40
    rows = (centres[rng.integers(0, 40, 6_000)] * rng.lognormal(0, 1, 6_000)[:, None] + rng.normal(size=(6_000, 12))).astype(np.int64)
    q, ids = rows[:200], np.arange(200)
    length = np.sqrt((q.astype(float) ** 2).sum(1))
    best, made, orders = [[np.zeros(0, np.int64), np.zeros(0, np.int64)] for _ in ids], 0, set()
    by_length = np.argsort(-(rows.astype(float) ** 2).sum(1))
    for a in range(0, 6_000, 32):
        some = by_length[a : a + 32]
        chunk = topk.Chunk(some, rows[some])
        least = np.array([float(b[1][-1]) if len(b[1]) == 5 else -np.inf for b in best])
        orders |= {bool(o >= 0) for o in topk.bounds(q, length, least, chunk)[0]}
        made += topk.visit(q, ids, length, np.full(200, -np.inf), best, chunk, 5)
    scores = q @ rows.T
    scores[ids, ids] = -(1 << 62)
    for i in range(200):
        order = np.lexsort((np.arange(6_000), -scores[i]))[:5]
        assert best[i][0].tolist() == order.tolist() and best[i][1].tolist() == scores[i, order].tolist()
    assert made < 0.2 * 200 * 6_000 and orders == {True, False}
