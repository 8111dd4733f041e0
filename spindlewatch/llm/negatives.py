"""Hard negatives by a multiway hyperplane tree with distance ranges.

The tree is grown level by level over all rows: a node with too many of them chooses split points from a sample of its own (candidates far
from each other), and each row goes to the nearest one. For every child the node keeps the least and the largest distance from each split
point to the rows of that child, with the range of their lengths and labels. A node whose sample has one point only stays a leaf.

A search asks for the best rows whose inner product with the anchor is in a window. Length ranges turn the window into an annulus around the
anchor; a child is left out if for some split point its range of distances does not meet that of the annulus (triangle inequality, with
SLACK for rounding). What an anchor's own leaf holds raises the window's lower end first. Leaves are searched exactly, in blocks of asks
and rows; products are integers.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindlewatch.llm.common import bounded_batches, stage

FANOUT = 12
CANDIDATES = 96
LEAF_ROWS = 1_024
BLOCK_ROWS = 4_096
BLOCK_ASKS = 512
ASKS_AT_ONCE = 256
SLACK = 1e-9
LOWEST, HIGHEST = -(1 << 62), 1 << 62
ROW = "vec_id long, label long, dims int, length2 double, v binary, node string"
ASK = "anchor_id long, ask int, same boolean, label long, dims int, v binary, low long, high long, block int, node string"
ASK_COLUMNS = [c.split()[0] for c in ASK.split(", ")]
HIT = "anchor_id long, ask int, vec_id long, score long"


def matrix(packed: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<i8").reshape(len(packed), dims)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of all rows of a and b; by floating point where that is exact."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def squares(a: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a.astype(float), a.astype(float))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, squares(a)[:, None] + squares(b)[None] - 2.0 * products(a, b)))


def packed_rows(rows: DataFrame, scale: float) -> DataFrame:
    """vec_id, label, dims, squared length and floor(scale * x) of every component as packed 64-bit numbers, once for each different row."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(F.size("embedding") > 0).where(finite)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, size = lists.flatten().to_numpy(zero_copy_only=False), np.diff(np.asarray(lists.offsets))
            whole, at = np.floor(scale * flat).astype("<i8"), np.cumsum(np.concatenate([[0], size]))
            data = [whole[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
            length2 = np.add.reduceat(whole.astype(float) ** 2, at[:-1]) if len(size) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int32()), pa.array(length2), pa.array(data, pa.binary())], names=["vec_id", "label", "dims", "length2", "v"])

    named = usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("x"))
    return named.mapInArrow(run, "vec_id long, label long, dims int, length2 double, v binary").distinct()


# ---- the tree ----------------------------------------------------------------------------------------------------------------


def chosen(sample: np.ndarray, fanout: int) -> np.ndarray:
    """Split points of a sample: the first row, then always the one farthest from those before; equal points are taken once."""
    sample = np.unique(sample, axis=0)
    picked, far = [0], distances(sample, sample[:1])[:, 0]
    while len(picked) < min(fanout, len(sample)) and far.max() > 0:
        picked.append(int(np.argmax(far)))
        far = np.minimum(far, distances(sample, sample[picked[-1]][None])[:, 0])
    return sample[picked]


def _splits(open_rows: DataFrame, fanout: int, candidates: int, level: int) -> DataFrame:
    """node, splits (packed split points, n of them) from a sample of about ``candidates`` rows of each node, by a hash of the id."""
    place = F.pmod(F.xxhash64("vec_id", F.lit(level)), F.lit(1 << 30)) / float(1 << 30)
    sample = open_rows.where(place < F.lit(float(candidates)) / F.col("rows"))

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        points = chosen(matrix(frame["v"], int(frame["dims"].iloc[0])), fanout)
        return pd.DataFrame({"node": [frame["node"].iloc[0]], "n": [len(points)], "splits": [points.tobytes()]})

    return sample.groupBy("node").applyInPandas(choose, "node string, n int, splits binary").where("n > 1")


def _assign(key, rows: pd.DataFrame, splits: pd.DataFrame) -> pd.DataFrame:
    """Rows of a node, moved to their children, with their distances to the split points."""
    if rows.empty or splits.empty:
        return pd.DataFrame({c: pd.Series(dtype=object) for c in ("vec_id", "label", "dims", "length2", "v", "node", "far")})
    dims = int(rows["dims"].iloc[0])
    far = distances(matrix(rows["v"], dims), matrix([splits["splits"].iloc[0]], dims * int(splits["n"].iloc[0])).reshape(-1, dims))
    child = np.argmin(far, axis=1)
    return rows[["vec_id", "label", "dims", "length2", "v"]].assign(node=[f"{n}.{c}" for n, c in zip(rows["node"], child)], far=list(far))


class Tree:
    """Stored rows with their leaves, and the inner nodes: node, n, splits, and for each child its ranges."""

    def __init__(self, rows: DataFrame, nodes: DataFrame | None):
        self.rows, self.nodes = rows, nodes


def grow(rows: DataFrame, fanout: int, candidates: int, leaf_rows: int) -> Tree:
    """Splits nodes until every one has at most leaf_rows rows or can't be split; a root for each number of dimensions."""
    closed, nodes, level = [], None, 0
    current = stage(rows.select("vec_id", "label", "dims", "length2", "v", F.col("dims").cast("string").alias("node")), "rows")
    while True:
        sizes = current.groupBy("node").agg(F.count("*").alias("rows"))
        open_ = stage(current.join(sizes.where(F.col("rows") > leaf_rows), "node"), "open")
        if open_.isEmpty():
            closed.append(current)
            break
        splits = stage(_splits(open_, fanout, candidates, level), "splits")
        closed.append(current.join(splits, "node", "left_anti"))
        salts = F.ceil(F.col("rows") / F.lit(BLOCK_ROWS)).cast("int")
        left = open_.join(splits.select("node"), "node", "left_semi").withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(-1)), salts).cast("int"))
        sized = open_.groupBy("node").agg(F.first("rows").alias("rows")).join(splits, "node")
        right = sized.select(F.col("node").alias("_node"), "n", "splits", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
        moved = stage(left.groupBy("node", "salt").cogroup(right.groupBy("_node", "_salt")).applyInPandas(_assign, f"{ROW}, far array<double>"), "children")
        parent, child = F.regexp_extract("node", r"^(.*)\.\d+$", 1), F.regexp_extract("node", r"(\d+)$", 1).cast("int")
        told = moved.select(parent.alias("node"), child.alias("child"), "label", "length2", "far")
        each = [F.min(F.get("far", F.lit(i))).alias(f"near{i}") for i in range(fanout)] + [F.max(F.get("far", F.lit(i))).alias(f"far{i}") for i in range(fanout)]
        spans = told.groupBy("node", "child").agg(F.min("label").alias("label0"), F.max("label").alias("label1"), F.min("length2").alias("short"), F.max("length2").alias("long"), *each)
        near, far = F.array(*[f"near{i}" for i in range(fanout)]), F.array(*[f"far{i}" for i in range(fanout)])
        spans = spans.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("child", "label0", "label1", "short", "long", near.alias("near"), far.alias("far")))).alias("c"))
        lists = [F.col(f"c.{name}").alias(name) for name in ("child", "label0", "label1", "short", "long")]
        lists += [F.flatten(F.transform(f"c.{name}", lambda x: F.slice(x, F.lit(1), F.col("n")))).alias(name) for name in ("near", "far")]
        here = stage(splits.join(spans, "node").select("node", "n", "splits", *lists), "nodes")
        nodes = here if nodes is None else nodes.unionByName(here)
        current = moved.drop("far")
        level += 1
    whole = closed[0]
    for more in closed[1:]:
        whole = whole.unionByName(more)
    return Tree(stage(whole, "leaves"), None if nodes is None else stage(nodes, "tree"))


# ---- the search --------------------------------------------------------------------------------------------------------------


def survivors(asks: pd.DataFrame, node: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Places of asks and of a node's children that may hold what they ask for."""
    dims, n = int(asks["dims"].iloc[0]), int(node["n"])
    a = matrix(asks["v"], dims)
    to = distances(a, np.frombuffer(node["splits"], "<i8").reshape(n, dims))
    size2 = squares(a)[:, None]
    low = np.where(asks["low"] == LOWEST, -np.inf, asks["low"].astype(float))[:, None]
    high = np.where(asks["high"] == HIGHEST, np.inf, asks["high"].astype(float))[:, None]
    short, long_ = np.asarray(node["short"])[None], np.asarray(node["long"])[None]
    outer2 = size2 + long_ - 2 * low
    outer, inner = np.sqrt(np.maximum(0.0, outer2)), np.sqrt(np.maximum(0.0, size2 + short - 2 * high))
    slack = SLACK * (1.0 + size2 + long_)
    alive = (outer2 >= -slack) & (low <= np.sqrt(size2 * long_) * (1 + SLACK) + SLACK)
    near, far = (np.asarray(node[c], float).reshape(-1, n) for c in ("near", "far"))
    for i in range(n):
        d = to[:, i : i + 1]
        room = SLACK * (1.0 + d + np.where(np.isinf(outer), 0.0, outer) + far[None, :, i])
        alive &= (near[None, :, i] <= d + outer + room) & (far[None, :, i] >= np.maximum(d - outer, inner - d) - room)
    label, label0, label1 = asks["label"].to_numpy()[:, None], np.asarray(node["label0"])[None], np.asarray(node["label1"])[None]
    alive &= np.where(asks["same"].to_numpy(bool)[:, None], (label0 <= label) & (label <= label1), (label0 != label) | (label1 != label))
    return np.nonzero(alive)


def _descend(key, asks: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    """A block of asks at a node moves on to the children that are left."""
    if asks.empty or nodes.empty:
        return asks.iloc[:0]
    node = nodes.iloc[0]
    at, child = survivors(asks, node)
    return asks.iloc[at].assign(node=[f"{node['_node']}.{c}" for c in np.asarray(node["child"])[child]])


def visits(asks: DataFrame, tree: Tree) -> DataFrame:
    """Every ask with the leaves that may hold what it asks for."""
    active = asks.withColumn("node", F.col("dims").cast("string"))
    if tree.nodes is None:
        return active
    done = []
    while True:
        known = tree.nodes.select("node")
        done.append(active.join(known, "node", "left_anti").select(*asks.columns))
        inner = active.join(known, "node", "left_semi").select(*asks.columns)
        there = inner.select("node", F.col("block").alias("_block")).distinct().join(tree.nodes, "node").withColumnRenamed("node", "_node")
        active = stage(inner.groupBy("node", "block").cogroup(there.groupBy("_node", "_block")).applyInPandas(_descend, ASK), "visits")
        if active.isEmpty():
            break
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole


def best_of(asks: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Exactly: of every ask the k best rows of a block that it may take. All asks of a block are answered by one product."""
    dims = int(asks["dims"].iloc[0])
    own, label, ids = matrix(rows["v"], dims), rows["label"].to_numpy(), rows["vec_id"].to_numpy()
    of_anchor = asks.drop_duplicates("anchor_id")
    place = pd.Series(np.arange(len(of_anchor)), index=of_anchor["anchor_id"])[asks["anchor_id"]].to_numpy()
    scores = products(matrix(of_anchor["v"], dims), own)
    columns = [asks[c].to_numpy()[:, None] for c in ("anchor_id", "same", "label", "low", "high")]
    found = []
    for a in range(0, len(asks), ASKS_AT_ONCE):
        anchor, same, of, low, high = (c[a : a + ASKS_AT_ONCE] for c in columns)
        s = scores[place[a : a + ASKS_AT_ONCE]]
        at, row = np.nonzero(((label[None] == of) == same) & (s >= low) & (s <= high) & (ids[None] != anchor))
        s = s[at, row]
        order = np.lexsort((ids[row], -s, at))
        at, row, s = at[order], row[order], s[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        turn = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
        keep = turn < k
        found.append((at[keep] + a, ids[row[keep]], s[keep]))
    at, row_ids, s = (np.concatenate(c) for c in zip(*found))
    return pd.DataFrame({"anchor_id": asks["anchor_id"].to_numpy()[at], "ask": asks["ask"].to_numpy()[at], "vec_id": row_ids, "score": s})


def searched(asked: DataFrame, tree: Tree, k: int) -> DataFrame:
    """The k best rows of each ask in the leaves that it names, with their rank."""
    blocks = tree.rows.groupBy("node").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("parts"))
    wanted = asked.join(blocks, "node")
    left = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    there = wanted.select("node", F.col("block").alias("_block"), "parts").distinct()
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    right = tree.rows.join(there, "node").select(F.col("node").alias("_node"), "_block", part.alias("_part"), "vec_id", "label", "v")

    def answer(key, asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if asks.empty or rows.empty:
            return pd.DataFrame({"anchor_id": np.zeros(0, np.int64), "ask": np.zeros(0, np.int32), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        return best_of(asks, rows, k)

    hits = left.groupBy("node", "block", "part").cogroup(right.groupBy("_node", "_block", "_part")).applyInPandas(answer, HIT)
    place = F.row_number().over(Window.partitionBy("anchor_id", "ask").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)


def best_rows(asks: DataFrame, own_leaf: DataFrame, tree: Tree, k: int) -> DataFrame:
    """anchor_id, ask, vec_id, score, rank: of each ask the k best rows whose product is in [low, high]; asks must be stored."""
    if tree.nodes is not None:  # what the anchor's own leaf has raises the lower end of the window
        at_home = searched(asks.join(own_leaf, "anchor_id").select(*ASK_COLUMNS), tree, k)
        least = at_home.where(F.col("rank") == k).select("anchor_id", "ask", F.col("score").alias("least"))
        asks = stage(asks.join(least, ["anchor_id", "ask"], "left").withColumn("low", F.greatest("low", F.coalesce("least", "low"))).withColumn("node", F.lit("")).select(*ASK_COLUMNS), "asks")
    else:
        asks = asks.withColumn("node", F.lit("")).select(*ASK_COLUMNS)
    return stage(searched(stage(visits(asks, tree), "leaf-visits"), tree, k), "best-rows")


def mine(
    rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 5, percent: int = 80, scale: float = 256.0,
    fanout: int = FANOUT, candidates: int = CANDIDATES, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows and anchors (vec_id, embedding, label).

    A score is the integer product of floor(scale * x). An anchor's positives are its n_positives best other rows of the same label; for
    each the n_negatives best rows of another label with percent * positive_score <= 100 * negative_score <= 100 * positive_score. Ties go
    to the smaller vec_id. Rows without id, label or vector or with a null or non-finite component take no part, nor do anchors; a row that
    is there again counts once; of different anchors with one id the least by label and components counts; vectors of other dimension have
    no product. Negative positive scores leave no negatives. An empty table gives no rows.
    """
    bounded_batches(rows.sparkSession)
    tree = grow(packed_rows(rows, scale), fanout, candidates, leaf_rows)
    own = packed_rows(anchors, scale).groupBy("vec_id").agg(F.min(F.struct("label", "v", "dims")).alias("r"))
    own = stage(own.select(F.col("vec_id").alias("anchor_id"), "r.label", "r.v", "r.dims"), "anchors")
    leaf = stage(own.join(tree.rows.select("vec_id", F.col("v").alias("_v"), F.col("label").alias("_label"), "node"), (F.col("anchor_id") == F.col("vec_id")) & (F.col("v") == F.col("_v")) & (F.col("label") == F.col("_label"))).select("anchor_id", "node"), "own-leaves")
    block = F.pmod(F.xxhash64("anchor_id"), F.lit(max(1, -(-own.count() // BLOCK_ASKS)))).cast("int").alias("block")
    first = own.select("anchor_id", F.lit(0).alias("ask"), F.lit(True).alias("same"), "label", "dims", "v", F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high"), block)
    positives = best_rows(first, leaf, tree, n_positives)
    # the smallest whole score with 100 * score >= percent * positive score
    least = F.expr(f"score * {percent} div 100 + CASE WHEN score * {percent} % 100 > 0 THEN 1 ELSE 0 END")
    window = positives.select("anchor_id", F.col("rank").alias("ask"), F.col("vec_id").alias("positive_id"), F.col("score").alias("high"), least.alias("low")).where("low <= high")
    second = stage(window.join(own, "anchor_id").select("anchor_id", "ask", F.lit(False).alias("same"), "label", "dims", "v", "low", "high", block), "negative-asks")
    negatives = best_rows(second, leaf, tree, n_negatives)
    named = positives.select("anchor_id", F.col("rank").alias("ask"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(named, ["anchor_id", "ask"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
