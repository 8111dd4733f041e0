"""Ranked search, SimHash classes and hard negatives against brute force, with nulls, ties, repeated rows and clashing columns."""
import math
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("spindlewatch.llm")

from pyspark.sql import functions as F  # noqa: E402

from spindlewatch.llm import lexical, negatives, simhash  # noqa: E402
from spindlewatch.llm.common import stage  # noqa: E402

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, rank int, term string, n long, print long, item string"
WORDS = "Alpha beta gamma delta eps zeta eta theta iota Kappa lam mu nu xi Ä9 omi pi rho sig tau ups phi".split()


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 9, "t", 1, 2, "x") for i, t in rows], DOCS)


def ranked(docs, items, k):
    terms = [(i, [w.translate(LOWER) for w in re.findall(TERM, t or "")]) for i, t in docs if i is not None]
    n_docs, total = sum(1 for _, t in terms if t), sum(len(t) for _, t in terms)
    df = Counter(w for _, t in terms for w in set(t))
    out = []
    for item in sorted({i for i, _ in items if i is not None}):
        asked = {w.translate(LOWER) for i, t in items if i == item for w in re.findall(TERM, t or "")}
        rows = []
        for doc_id, t in terms:
            tf, m = Counter(t), 50 + (50 * len(t) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 20 * m)) for w in asked if tf[w])
            if score > 0:
                rows.append((-score, doc_id))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(rows)[:k])]
    return out


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    rows = [(1, None), (2, ""), (3, "?! \n"), (None, text(20)), (4, "Ä9 ä9 É"), (5, "x" * 70_000 + " beta"), (6, text(9_000))]
    rows += [(10 + k, text(int(rng.integers(3, 40)))) for k in range(120)]
    return rows + [(300 + k, "beta, gamma; DELTA") for k in range(30)] + rows[7:10]


@pytest.mark.parametrize("group_terms, tiles", [(1 << 16, (256, 1024, 1024)), (12, (3, 4, 16))])
def test_ranked_search(spark, texts, group_terms, tiles):
    items = [(1, "beta GAMMA beta"), (2, None), (3, "..."), (4, " ".join(WORDS)), (5, "nothing here"), (None, "beta"), (6, "delta"), (6, "pi-rho"), (7, "ä9 Ä9")]
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id int, score int")
    docs = documents(spark, texts)
    got = sorted(tuple(r) for r in lexical.search(docs.repartition(5), asked, 12, group_terms, tiles).select("item_id", "rank", "doc_id", "score").collect())
    assert got == ranked(texts, items, 12)
    assert lexical.search(docs.where("false"), asked, 12).count() == 0 and lexical.search(docs, asked.where("false"), 12).count() == 0


def test_parts_stay_exact():
    n = 5_000
    weights = np.full(n, 1 << 29, np.int64)
    tile = lexical.ItemTile(0, [np.arange(n)], weights, n)
    assert len(tile.parts) > 1 and all(width * (1 << 29) * lexical.LARGEST_IMPACT < 1 << 53 for _, width, *_ in tile.parts)
    impact = np.full(n, 999_999)
    assert tile.scores(np.arange(n), np.zeros(n, np.int64), impact, 1)[0, 0] == n * (1 << 29) * 999_999


def print_of(text):
    import xxhash

    words = [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_of(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("slice_bytes", [4 << 20, 50])
def test_fingerprints(texts, slice_bytes, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE_BYTES", slice_bytes)
    for _, text in [*texts[:40], (0, "one"), (0, "One TWO"), (0, "a b c\td"), (0, "a b c d " * 40)]:
        assert simhash.fingerprint((text or "").encode()) == print_of(text)


def test_simhash_classes(spark, texts):
    rng = np.random.default_rng(8)
    long_ = [str(x) for x in rng.integers(0, 10**6, 400)]
    rows = texts[:30] + [(400 + k, " ".join(long_[:200] + [f"e{k}"] + long_[200:])) for k in range(60)] + [(500, "A b"), (501, "a  B"), (502, "z")]
    prints = {i: print_of(t) for i, t in rows if i is not None}
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.classes(documents(spark, rows + rows[5:7])).collect()}
    want = classes_of(prints)
    assert got == {i: (prints[i], want[i]) for i in prints} and 1 < len(set(want.values())) < len(want) - 30
    assert simhash.classes(documents(spark, rows)).count() == len(rows) - 1 and simhash.classes(documents(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize("entry_rows", [4_096, 66])
def test_all_links_of_planted_fingerprints(spark, entry_rows):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)] + [0, (1 << 64) - 1]
    prints = {}
    for b in base[:12] + base[-2:]:  # around each some at distances 1 to 6, and chains
        for _ in range(14):
            p = b
            for bit in rng.choice(64, int(rng.integers(0, 7)), replace=False).tolist():
                p ^= 1 << bit
            prints.setdefault(p, len(prints) + 1)
    half = base[0] & 0xFFFFFFFF  # one segment that many different fingerprints share
    for x in rng.integers(0, 1 << 32, 300).tolist():
        prints.setdefault(x << 32 | half, len(prints) + 1)
        prints.setdefault((x ^ 5) << 32 | half, len(prints) + 1)
        prints.setdefault((x ^ (1 << 20)) << 32 | half ^ (1 << 7), len(prints) + 1)
    sets = spark.createDataFrame([(p - (1 << 64) if p >= 1 << 63 else p, i) for p, i in prints.items()], "print long, rid long")
    by_id = {i: p for p, i in prints.items()}
    edges = [tuple(r) for r in simhash.links(stage(sets, "sets"), entry_rows).collect()]
    assert all((by_id[a] ^ by_id[b]).bit_count() <= 3 for a, b in edges)
    want, root = classes_of(by_id), {i: i for i in by_id}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: find(i) for i in by_id} == want


def test_a_large_entry_yields_a_forest():
    own = np.array([x << 3 for x in range(8)] + [255 << 40, (255 << 40) + 1], np.uint64)
    a, b = simhash._large_entry(np.zeros(10, np.int32), own, np.arange(10))
    assert len(a) == 8 and {int(x) for x in np.concatenate([a, b])} == set(range(10))


def mined(rows, k_pos=5, k_neg=5, percent=80):
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault((i, label, tuple(math.floor(256 * x) for x in v)), None)
    points = list(good)
    out = []
    for a in [p for p in points if p[0] % 10 == 0]:
        score = lambda p: sum(x * y for x, y in zip(a[2], p[2]))
        others = [p for p in points if p[0] != a[0] and len(p[2]) == len(a[2])]
        positives = sorted((-score(p), p[0]) for p in others if p[1] == a[1])[:k_pos]
        for s, positive in positives:
            near = sorted((-score(p), p[0]) for p in others if p[1] != a[1] and percent * -s <= 100 * score(p) <= 100 * -s)[:k_neg]
            out += [(a[0], positive, r + 1, n, -s, -t) for r, (t, n) in enumerate(near)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 6)) * np.array([1, 1, 2, 3, 1, 4])[:, None][rng.integers(0, 6, 8)]
    rows = [(k, [float(x) for x in centres[k % 8] + 0.25 * rng.normal(size=6)], int(rng.integers(0, 3)) if k % 5 else k % 8 % 3) for k in range(700)]
    rows += [(1_000 + k, [1.0, 0.0, 0.5, 0.0, 0.0, 0.0], k % 2) for k in range(120)]  # one vector that many rows share
    rows += [(2_000, None, 1), (2_001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2_010, [float("nan")] * 6, 1), (2_020, [float("inf")] * 6, 0), (2_030, [], 0), (2_040, [0.1] * 6, None)]
    rows += [(None, [0.1] * 6, 1), (2_050, [0.0] * 6, 1), (2_051, [0.0] * 6, 2), (2_060, [1.0, 2.0], 1), (2_061, [1.0, 2.0], 1), (2_062, [1.0, 1.8], 2)]
    return rows


@pytest.mark.parametrize("leaf_rows", [16, 1_024])
def test_hard_negatives(spark, vectors, leaf_rows):
    frame = spark.createDataFrame([(i, v, l, "n", 3, "b") for i, v, l in vectors + vectors[:9]], "vec_id long, embedding array<double>, label int, node string, ask int, block string")
    found = negatives.mine(frame, frame.where("vec_id % 10 = 0"), fanout=4, candidates=24, leaf_rows=leaf_rows)
    got = sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == mined(vectors) and len(got) > 500
    assert negatives.mine(frame.where("false"), frame.where("false")).count() == 0


def test_siblings_are_eliminated(spark, vectors):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").where("size(embedding) = 6")
    tree = negatives.grow(negatives.packed_rows(frame, 256.0), 4, 24, 16)
    leaves = tree.rows.select("node").distinct().count()
    ask = [F.lit(0).alias("ask"), F.lit(False).alias("same"), "label", "dims", "v", F.lit(60_000).cast("long").alias("low"), F.lit(90_000).cast("long").alias("high"), F.lit(0).alias("block"), F.lit("").alias("node")]
    asks = stage(tree.rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("anchor_id"), *ask), "asks")
    seen = negatives.visits(asks, tree).count()
    assert leaves > 30 and 0 < seen < 0.7 * leaves * asks.count()
