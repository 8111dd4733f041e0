"""Similarity self-join of documents on word shingles by vertical partitioning.

A document's set are the 64-bit fingerprints of its distinct shingles. Copies of one set are one class from the start.

1. Counting. Batches of documents send every shingle once to the bucket of its fingerprint and learn which shingles other sets have as
   well, and how many. A set in which more shingles are its own than a partner may miss has no partner; only the rest goes on.
2. The global order of shingles is (frequency, fingerprint). Linked sets share a shingle of their prefixes in this order. Prefix lists
   give candidate pairs in rounds: a list's members are compared with few of them (first its lead, the one with the fewest shingles of its own, then by a hash of the id,
   GROWTH times as many each round) and only across components found so far, so that a group of near copies is joined without all its
   pairs. A list skips pairs that would have too few shingles from there on, were this their first common one; in the list of the one
   that is the first, every pair that could add a link between two components is compared in the end.
3. The order is cut into FRAGMENTS fragments of equal weight. A task counts the overlaps of candidate pairs within one fragment; the
   partial overlaps are summed per pair and compared with the threshold.

Links are joined by connected components. Frequencies only order the shingles; counts of all shingles enter the overlap.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlewatch.llm.common import LOWER_BYTES, bounded_batches, plan_bytes, stage
from spindlewatch.llm.components import components
from spindlewatch.llm.fingerprints import LARGEST_COUNT, gather, mixed_bits, shared_fingerprints

SHINGLE = 5
FRAGMENTS = 16
BUCKET_BYTES = 8 << 20
SHARD_TOKENS = 32_000_000
PAIRS_AT_ONCE = 20_000
FIRST_CENTRES = 2
GROWTH = 4
SHINGLED = "doc_id long, n_shingles long, set binary, tokens array<long>, counts array<int>"


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted fingerprints of the distinct shingles; with fewer words the whole sequence is one, without words there is none."""
    import xxhash

    words = text.translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mixed_bits(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def most_missing(n: np.ndarray, percent: int) -> np.ndarray:
    """Length of the prefix: n less the smallest overlap with a partner, plus one."""
    return n - (n * percent + 99) // 100 + 1


def _collect(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A batch: every document with its size and set; the shared shingles in order only where a partner is possible."""
    ids, n, sets, token, doc, count = gather(frame)
    shared = np.bincount(doc, minlength=len(ids))
    live = (n - shared) < most_missing(n, percent)
    live &= n > 0
    keep = live[doc]
    token, doc, count = token[keep], doc[keep], count[keep]
    order = np.lexsort((token, count, doc))
    token, doc, count = token[order].view(np.int64), doc[order], count[order]
    cut = np.searchsorted(doc, np.arange(len(ids) + 1))
    lists = [token[cut[i] : cut[i + 1]] if live[i] else None for i in range(len(ids))]
    counts = [count[cut[i] : cut[i + 1]].astype(np.int32) if live[i] else None for i in range(len(ids))]
    return pd.DataFrame({"doc_id": ids, "n_shingles": n, "set": [s if k else None for s, k in zip(sets, n)], "tokens": lists, "counts": counts})


def shingled(docs: DataFrame, percent: int, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set (digest; null if empty), and for sets that may have partners the shingles that others have, rare ones first."""
    bounded_batches(docs.sparkSession)
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan_bytes(docs) // BUCKET_BYTES, 1)

    back = shared_fingerprints(docs, buckets, lambda text: shingles(text, width), by_set=True)
    return back.groupBy("batch").applyInPandas(lambda frame: _collect(frame, percent), SHINGLED)


def _fragments(sets: DataFrame) -> DataFrame:
    """rid, fragment, packed shingles: the global order (frequency, fingerprint) cut into FRAGMENTS of equal weight."""
    weight = sets.select(F.explode("counts").alias("df")).groupBy("df").count().toPandas()  # one row per frequency, at most LARGEST_COUNT
    held = np.zeros(LARGEST_COUNT + 1)
    held[weight["df"]] = weight["count"]
    before, total = np.concatenate([[0], np.cumsum(held)[:-1]]), max(1.0, held.sum())

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for rid, tokens, counts in frame.itertuples(index=False):
                t, df = np.asarray(tokens, np.int64).view(np.uint64), np.asarray(counts)
                place = (before[df] + t.astype(float) / 2.0**64 * held[df]) / total
                part = np.minimum((place * FRAGMENTS).astype(int), FRAGMENTS - 1)
                rows += [(rid, f, np.sort(t[part == f]).tobytes()) for f in np.unique(part).tolist()]
            yield pd.DataFrame(rows, columns=["rid", "fragment", "packed"])

    return stage(sets.select("rid", "tokens", "counts").mapInPandas(cut, "rid long, fragment int, packed binary"), "fragments")


def _partial(pairs: pd.DataFrame, segments: pd.DataFrame) -> pd.DataFrame:
    """Overlap of each pair within one fragment."""
    packed = {r: np.frombuffer(p, np.uint64) for r, p in zip(segments["rid"], segments["packed"])}
    rows = []
    for a, group in pairs.groupby("a"):
        left = packed.get(a)
        if left is None:
            continue
        for b, na, nb in group[["b", "na", "nb"]].itertuples(index=False):
            right = packed.get(b)
            if right is not None:
                at = np.searchsorted(left, right)
                common = int((left[np.minimum(at, len(left) - 1)] == right).sum())
                if common:
                    rows.append((a, b, na, nb, common))
    return pd.DataFrame(rows, columns=["a", "b", "na", "nb", "common"]).astype("int64")


def overlaps(pairs: DataFrame, segments: DataFrame, shards: int) -> DataFrame:
    """Common shingles of each pair (a, b, na, nb): partial counts by fragment, summed."""
    pairs = stage(pairs, "pairs")
    # a list that meets very many others is sent to several shards with some of them each
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PAIRS_AT_ONCE)).alias("salts")).where("salts > 1")
    if salts.isEmpty():
        sharded = pairs.withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards)).cast("int"))
    else:
        salt = F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1).cast("long")))
        sharded = stage(pairs.join(salts, "a", "left").withColumn("shard", F.pmod(F.xxhash64("a", salt), F.lit(shards)).cast("int")).drop("salts"), "shards")
    wanted = sharded.select("shard", F.explode(F.array("a", "b")).alias("rid")).distinct()
    left = sharded.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    right = segments.join(wanted, "rid").select(F.col("shard").alias("_shard"), F.col("fragment").alias("_fragment"), "rid", "packed")
    counted = left.groupBy("shard", "fragment").cogroup(right.groupBy("_shard", "_fragment")).applyInPandas(_partial, "a long, b long, na long, nb long, common long")
    return counted.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))


def _links(sets: DataFrame, percent: int) -> DataFrame | None:
    """Components among different sets: node, root; None if nothing is linked."""
    prefix = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    usable = (prefix - (F.col("n") - F.size("tokens"))).cast("int")
    own = (F.col("n") - F.size("tokens")) / F.col("n")
    lists = sets.select(F.posexplode(F.slice("tokens", F.lit(1), F.greatest(usable, F.lit(1)))).alias("i", "token"), "rid", "n", F.size("tokens").alias("s"), F.struct(own.alias("own"), "rid").alias("rank"))
    lists = lists.withColumn("left", F.col("s") - F.col("i")).drop("i")  # shingles from this one on, in the whole order
    busy = lists.groupBy("token").agg(F.count("*").alias("m"), F.min("rank").alias("lead")).where("m > 1").select("token", "m", F.col("lead.rid").alias("lead"))
    chance = F.pmod(F.xxhash64("rid", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    # the member with the fewest shingles of its own leads its list and is compared first; in a group of near copies that is the original
    postings = stage(lists.drop("rank").join(busy, "token").withColumn("h", F.when(F.col("rid") == F.col("lead"), -1.0).otherwise(chance)).drop("lead"), "postings")
    largest = postings.agg(F.max("m")).first()[0]
    if largest is None:
        return None
    segments = _fragments(sets)
    shards = max(1, int(sets.agg(F.sum(F.size("tokens"))).first()[0]) // SHARD_TOKENS)
    labels, low, high, last = None, float("-inf"), 0.0, False
    while not last:
        last = high >= largest
        own = postings if labels is None else postings.join(labels, postings["rid"] == labels["node"], "left").drop("node")
        own = own.withColumn("label", F.col("rid") if labels is None else F.coalesce("root", "rid"))
        live = own.groupBy("token").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("token")
        own = stage(own.join(live, "token").select("token", "rid", "n", "left", "m", "h", "label"), "lists")
        centres = own.where((F.col("h") >= low / F.col("m")) & (F.col("h") < high / F.col("m"))).select("token", F.col("rid").alias("c"), F.col("n").alias("cn"), F.col("left").alias("cleft"), F.col("h").alias("ch"), F.col("label").alias("cl"))
        later = (F.col("h") > F.col("ch")) | ((F.col("h") == F.col("ch")) & (F.col("rid") > F.col("c")))
        # in the list of its first common shingle a pair has no more in common than the smaller number of shared shingles from there on
        near = (F.greatest("n", "cn") * percent <= F.least("n", "cn") * 100) & ((100 + percent) * F.least("left", "cleft") >= percent * (F.col("n") + F.col("cn")))
        met = own.join(centres, "token").where(later & (F.col("label") != F.col("cl")) & near)
        pairs = met.select(F.col("c").alias("a"), F.col("rid").alias("b"), F.col("cn").alias("na"), F.col("n").alias("nb")).distinct()
        common = overlaps(pairs, segments, shards)
        linked = common.where((100 + percent) * F.col("common") >= percent * (F.col("na") + F.col("nb"))).select("a", "b")
        if labels is not None:  # links between components found before
            one, two = labels.select(F.col("node").alias("a"), F.col("root").alias("ra")), labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
            linked = linked.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        linked = stage(linked, "links")
        if not linked.isEmpty():
            found = components(linked)
            if labels is None:
                labels = found
            else:
                up = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
                moved = labels.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
                labels = stage(moved.unionByName(found), "labels")
        elif own.isEmpty():
            break
        postings = own.where(F.col("m") > high).drop("label")  # lists in one component stay so, and shorter ones have been compared whole
        low, high = high, max(float(FIRST_CENTRES), high * GROWTH)
    return labels


def classes(docs: DataFrame, percent: int = 80, width: int = SHINGLE) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. Two documents link when 100 * intersection >= percent * union of their
    sets; component_id is the smallest doc_id reachable by links. With fewer words than width the whole sequence is one shingle; a null
    text or one without words has an empty set, links with nothing and is its own component. Rows without doc_id are left out, as a
    component can't be named by them; repeated rows are linked; an empty table gives no rows; other columns are ignored.
    """
    rows = stage(shingled(docs.where("doc_id is not null"), percent, width), "shingles")
    sets = rows.where("tokens is not null").groupBy("set").agg(F.min("doc_id").alias("rid"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"), F.first("counts").alias("counts"))
    labels = _links(stage(sets.drop("set"), "sets"), percent)
    named = rows.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("component_id"))
    if labels is not None:
        named = named.join(labels, named["component_id"] == labels["node"], "left").select("set", F.coalesce("root", "component_id").alias("component_id"))
    met = rows.select("doc_id", "n_shingles", "set").join(named, "set", "left")
    return met.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
