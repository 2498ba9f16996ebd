"""Exact top-k search by inner product: KD-trees per shard, searched best box first."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stash

#: Points of a leaf; vectors of a shard; queries of a block.
LEAF, SHARD, BLOCK = 64, 16384, 8192
#: A place that no candidate has taken, and where sums of products are no longer exact as 64-bit floats.
FREE, EXACT = np.iinfo(np.int64).min, 2.0**53


@dataclass
class Tree:
    """A KD-tree: points in the order of leaves; of each node, parents first, its tight box, smallest id and children, -1 for a
    leaf, whose number `right` has then."""

    points: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def __post_init__(self):
        first, n = self.starts[:-1], len(self.left)
        dim = self.points.shape[1]
        self.low, self.high, self.least = np.zeros((n, dim)), np.zeros((n, dim)), np.zeros(n, np.int64)
        if not len(self.ids):
            return
        leaves = np.flatnonzero(self.left < 0)
        at = self.right[leaves]
        self.low[leaves] = np.minimum.reduceat(self.points, first)[at]
        self.high[leaves] = np.maximum.reduceat(self.points, first)[at]
        self.least[leaves] = np.minimum.reduceat(self.ids, first)[at]
        for i in np.flatnonzero(self.left >= 0)[::-1]:
            l, r = self.left[i], self.right[i]  # noqa: E741
            self.low[i], self.high[i], self.least[i] = np.minimum(self.low[l], self.low[r]), np.maximum(self.high[l], self.high[r]), min(self.least[l], self.least[r])


def build(points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
    """Median splits along the widest side of the tight box; points equal in all sides split by id."""
    order = np.lexsort((ids,))
    points, ids = points[order], ids[order]
    todo, parts, left, right = [(np.arange(len(ids)), -1)], [], [], []
    while todo:
        i, parent = todo.pop()
        if parent >= 0:  # the left one comes first
            (left if left[parent] == -2 else right)[parent] = len(left)
        if len(i) > leaf:
            p = points[i]
            wide = p.max(axis=0) - p.min(axis=0)
            side = int(np.argmax(wide))
            by = i[np.argsort(p[:, side], kind="stable")] if wide[side] else i
            todo += [(by[len(by) // 2 :], len(left)), (by[: len(by) // 2], len(left))]
            left.append(-2)
            right.append(-2)
        else:
            left.append(-1)
            right.append(len(parts))
            parts.append(np.sort(i))
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    at = np.concatenate(parts)
    return Tree(points[at], ids[at], starts, np.array(left, np.int32), np.array(right, np.int32))


class Search:
    """The k best of a block of queries so far, over the trees that were searched.

    Rows of scores and found are in order of rank; FREE marks places that no candidate has.
    """

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.whole, self.queries, self.k = ids, queries, queries.astype(np.float64), k
        self.up, self.down = np.maximum(self.queries, 0), np.minimum(self.queries, 0)
        self.scores = np.full((len(ids), k), FREE)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.visits = self.opened = 0

    def add(self, tree: Tree) -> None:
        """Search a tree from its root, each query its best boxes first.

        A box's bound is the product of the query with the box's best corner. A query goes down to the children of
        a node unless its bound is below the query's kth score so far, which carries over from tree to tree, or only
        reaches it with larger ids. Of the leaves that are left, it goes in each step to the next best, twice as many as
        before, while they pass the kth score. Queries that come to the same box are multiplied with it at once.
        """
        if not len(tree.ids) or not len(self.ids) or not self.queries.shape[1]:
            if len(tree.ids) and len(self.ids):
                self._take(np.arange(len(self.ids)), tree, slice(0, len(tree.ids)), False)
            return
        size = float(np.abs(self.queries).max(initial=0)) * max(float(np.abs(tree.low).max()), float(np.abs(tree.high).max())) * self.queries.shape[1]
        if size >= 2.0**63:
            raise OverflowError("scores don't fit 64 bits")
        exact = size < EXACT
        slack = 0.0 if exact else size * 1e-12
        nodes, alive, leaves, columns = np.zeros(1, np.int64), np.ones((len(self.ids), 1), bool), [], []
        while len(nodes):
            bound = self.up @ tree.high[nodes].T + self.down @ tree.low[nodes].T + slack
            kth = self.scores[:, -1:].astype(np.float64)
            alive &= (bound > kth) | (bound == kth) & (tree.least[nodes] < self.found[:, -1:])
            self.opened += int(alive.sum())
            leaf = tree.left[nodes] < 0
            leaves.append(nodes[leaf])
            columns.append(np.where(alive[:, leaf], bound[:, leaf], -np.inf))
            inner = ~leaf & alive.any(axis=0)
            nodes, alive = np.concatenate([tree.left[nodes[inner]], tree.right[nodes[inner]]]).astype(np.int64), np.concatenate([alive[:, inner]] * 2, axis=1)
        leaves, bounds = np.concatenate(leaves), np.concatenate(columns, axis=1)
        order = np.argsort(-bounds, axis=1, kind="stable")
        at, step, going = 0, 2, np.arange(len(self.ids))
        while len(going) and at < order.shape[1]:
            boxes = order[going, at : at + step]
            near = np.take_along_axis(bounds[going], boxes, axis=1)
            kth, last = self.scores[going, -1:].astype(np.float64), self.found[going, -1:]
            need = (near > kth) | (near == kth) & (tree.least[leaves[boxes]] < last)
            need &= near > -np.inf
            q, b = going[np.nonzero(need)[0]], boxes[need]
            by = np.argsort(b, kind="stable")
            self.visits += len(b)
            for part in np.split(by, np.flatnonzero(np.diff(b[by])) + 1) if len(by) else []:
                n = tree.right[leaves[b[part[0]]]]
                self._take(q[part], tree, slice(tree.starts[n], tree.starts[n + 1]), exact)
            self._settle()
            going = going[near[:, -1] >= self.scores[going, -1].astype(np.float64)]  # later boxes have lower bounds
            at, step = at + step, step * 2

    def _take(self, who: np.ndarray, tree: Tree, rows: slice, exact: bool) -> None:
        if exact:
            score = (self.queries[who] @ tree.points[rows].T.astype(np.float64)).astype(np.int64)
        else:
            score = self.whole[who].astype(np.int64) @ tree.points[rows].T.astype(np.int64)
        i, j = np.nonzero((score >= self.scores[who, -1:]) & (tree.ids[rows] != self.ids[who][:, None]))
        self.got = [*getattr(self, "got", []), (who[i], score[i, j], tree.ids[rows][j])]
        if not self.queries.shape[1]:
            self._settle()

    def _settle(self) -> None:
        got, self.got = getattr(self, "got", []), []
        if got:
            self._merge(*map(np.concatenate, zip(*got, strict=True)))

    def _merge(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        rows = np.unique(q)
        if not len(rows):
            return
        q = np.concatenate([q, np.repeat(rows, self.k)])
        score = np.concatenate([score, self.scores[rows].ravel()])
        ids = np.concatenate([ids, self.found[rows].ravel()])
        order = np.lexsort((ids, ~score, q))
        q = q[order]
        first = np.searchsorted(q, rows)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < self.k
        self.scores[q[keep], rank[keep]] = score[order][keep]
        self.found[q[keep], rank[keep]] = ids[order][keep]


def whole_parts(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v) with v = floor(scale * x) as an array of long; null, non-finite and null-id rows left out."""
    v = F.col("v")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("id").isNotNull() & v.isNotNull() & ok).select("id", F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x)).alias("v"))


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query picks, the k rows with the highest inner product.

    Components count as floor(scale * x). A query's own id is no candidate; ties go to smaller ids; fewer
    than k candidates are all returned. Null vectors and vectors that hold null, NaN or infinity take no part, as do
    null ids. Rows that repeat an id count as often as they come, as candidates and as queries.
    Vectors with fewer components than the longest count as if zeros followed; so an empty one scores 0 with all. Scores
    are exact; where their sums may pass 64 bits it raises. An empty table gives an empty result. Other columns are ignored.

    Vectors are dealt by hash into shards of about SHARD rows, each of which becomes a KD-tree, packed
    in one row. Queries form blocks, also packed; a task takes a block past one tree after the
    other, with the kth scores found so far, so that later trees are mostly left out. Blocks are
    dealt to tasks, and each block meets each tree once: rows moved are blocks times shards.
    """
    spark = vectors.sparkSession
    rows = stash(whole_parts(vectors, id_col, vec_col, scale), "vectors")
    total, dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    shards, queries = max(1, -(-total // SHARD)), rows.filter(is_query(F.col("id")))
    n_queries = queries.count()
    # Small sets of queries still give every core a block.
    blocks = max(1, -(-n_queries // BLOCK), min(spark.sparkContext.defaultParallelism, n_queries // 256))

    def matrix(vectors):
        out = np.zeros((len(vectors), dim), np.int64)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def narrow(points):
        """(bytes of a number, the numbers)."""
        size = next(k for k in (2, 4, 8) if k == 8 or not points.size or max(-int(points.min()), int(points.max())) < 1 << (8 * k - 1))
        return size, points.astype(f"<i{size}").tobytes()

    def pack(key, pdf):
        t = build(matrix(pdf["v"]), pdf["id"].to_numpy(np.int64))
        size, points = narrow(t.points)
        return pd.DataFrame({"shard": [int(key[0])], "wide": [size], "points": [points], "ids": [t.ids.tobytes()], "starts": [t.starts.tobytes()], "nodes": [np.stack([t.left, t.right]).tobytes()]})

    spread = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    trees = rows.withColumn("shard", spread).groupBy("shard").applyInPandas(pack, "shard int, wide int, points binary, ids binary, starts binary, nodes binary")
    trees = stash(trees, "trees")
    asked = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(blocks)).cast("int"))

    def pack_queries(key, pdf):
        order = np.argsort(pdf["id"].to_numpy(np.int64), kind="stable")
        return pd.DataFrame({"block": [int(key[0])], "q_ids": [pdf["id"].to_numpy(np.int64)[order].tobytes()], "q_points": [matrix(pdf["v"])[order].tobytes()]})

    packed = asked.groupBy("block").applyInPandas(pack_queries, "block int, q_ids binary, q_points binary")
    # Each block of queries goes to each shard: the stated set of queries against all rows, in blocks.
    packed = stash(packed, "queries")
    empty = F.lit(None).cast("binary")
    tree = ("points", "ids", "starts", "nodes")
    each = trees.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "shard", "wide", *tree, empty.alias("q_ids"), empty.alias("q_points"))
    lead = packed.select("block", F.lit(0).alias("kind"), F.lit(-1).alias("shard"), F.lit(0).alias("wide"), *[empty.alias(c) for c in tree], "q_ids", "q_points")
    dealt = lead.unionByName(each).repartition(blocks, "block").sortWithinPartitions("block", "kind", "shard")

    def search(batches):
        now, state = None, None

        def flush():
            q, rank = np.nonzero(state.scores > FREE)
            got = pa.array(state.scores[q, rank])
            return pa.RecordBatch.from_arrays([pa.array(state.ids[q]), pa.array((rank + 1).astype(np.int32)), pa.array(state.found[q, rank]), got], ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                x = {c: batch.column(c)[r].as_py() for c in ("block", "kind", "wide")}
                if x["kind"] == 0:
                    if state is not None:
                        yield flush()
                    now, ids = x["block"], np.frombuffer(batch.column("q_ids")[r].as_py(), np.int64)
                    state = Search(ids, np.frombuffer(batch.column("q_points")[r].as_py(), np.int64).reshape(len(ids), dim), k)
                elif state is not None and x["block"] == now:
                    ids, starts = (np.frombuffer(batch.column(c)[r].as_py(), np.int64) for c in ("ids", "starts"))
                    points = np.frombuffer(batch.column("points")[r].as_py(), f"<i{x['wide']}").reshape(len(ids), dim)
                    state.add(Tree(points, ids, starts, *np.frombuffer(batch.column("nodes")[r].as_py(), np.int32).reshape(2, -1)))
        if state is not None:
            yield flush()

    return dealt.mapInArrow(search, "query_id long, rank int, vec_id long, score long")
