"""Exact top-k by inner product: one KD-tree per shard, searched best first.

Rows are dealt into shards of bounded size. In a shard, median splits of the widest dimension end in
leaves with tight bounding boxes. The largest inner product that a query can have in a box bounds a
subtree; subtrees are visited best bound first until the bound falls below the k-th score. That k-th
score travels: a first pass searches each query in one shard and its k-th scores start the second pass
over all other shards. A shard's rows move once a pass and the queries stream past them. Scores are
integers: in doubles where these hold every sum, in Python integers elsewhere, so results are exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept
from .shards import EXACT, SCALE, every_shard, integers, long_columns, meet, numbers, vector_rows

SHARD_ROWS = 16_384
LEAF_ROWS = 64
# Relative room that a bound gets for the rounding of doubles.
SLACK = 1e-9


class Tree:
    """Nodes in arrays; children of inner nodes by number, leaves as row ranges of ``order``."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(points))
        self.low, self.high, self.child, self.rows = [], [], [], []
        self._grow(points, 0, len(points), leaf_rows)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.points = points[self.order]

    def _grow(self, points: np.ndarray, a: int, b: int, leaf_rows: int) -> int:
        me = len(self.child)
        own = points[self.order[a:b]]
        low, high = own.min(axis=0), own.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.child.append(None)
        self.rows.append((a, b))
        width = high - low
        if b - a > leaf_rows and width.size and width.max() > 0:
            d = int(np.argmax(width))
            middle = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, d], middle)]
            left = self._grow(points, a, a + middle, leaf_rows)
            right = self._grow(points, a + middle, b, leaf_rows)
            self.child[me] = (left, right)
        return me

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product of each query with any point of each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


class Shard:
    """Tree over a shard's integer vectors; sums that doubles can't hold are taken over Python integers."""

    def __init__(self, rows: dict[str, np.ndarray]):
        with np.errstate(over="ignore"):
            points = np.floor(SCALE * rows["v"])
        self.tree = Tree(np.clip(points, -1e300, 1e300))
        order = self.tree.order
        self.ids, self.rids, self.raw = rows["id"][order], rows["rid"][order], rows["v"][order]
        self.largest = np.abs(points).max(axis=0) if len(points) else np.zeros(points.shape[1])

    def scores(self, a: int, b: int, raw: np.ndarray, query: np.ndarray, small: bool) -> np.ndarray:
        return self.tree.points[a:b] @ query if small else integers(self.raw[a:b]) @ integers(raw)


def search(shard: Shard, raw: np.ndarray, own: np.ndarray, k: int, floor: list) -> list[list[tuple[int, int]]]:
    """Best (score, -id) of each query in a shard, no worse than ``floor``; row ``own`` is left out."""
    tree, out = shard.tree, []
    with np.errstate(over="ignore", invalid="ignore"):
        queries = np.floor(SCALE * raw)
        size = np.abs(queries) @ shard.largest
        bounds = tree.bounds(np.clip(queries, -1e300, 1e300))
    for q in range(len(queries)):
        small = bool(size[q] < EXACT)
        # An upper end that overflows or isn't a number prunes nothing.
        bound = bounds[q] if small else np.where(np.isfinite(bounds[q]) & np.isfinite(size[q]), bounds[q] + SLACK * size[q], np.inf)
        best: list[tuple[int, int]] = []  # heap, worst first
        kth = floor[q] if floor[q] is not None else -np.inf
        queue = [(-bound[0], 0)]
        while queue and -queue[0][0] >= kth:
            _, node = heapq.heappop(queue)
            if tree.child[node]:
                for c in tree.child[node]:
                    if bound[c] >= kth:
                        heapq.heappush(queue, (-bound[c], c))
                continue
            a, b = tree.rows[node]
            scores = shard.scores(a, b, raw[q], queries[q], small)
            for i in np.flatnonzero((scores >= kth).astype(bool)):
                if shard.rids[a + i] == own[q]:
                    continue
                item = (int(scores[i]), -int(shard.ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
                if len(best) == k:
                    kth = max(kth, best[0][0])
        out.append(best)
    return out


def top_k(df: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", every: int = 50, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """For each row whose id is divisible by ``every``: its k best other rows, as query_id, rank, vec_id, score.

    Scores are inner products of floor(256 x), exact for all finite components; one beyond a 64-bit integer among the results is
    an error. Ties go to the smaller id. Rows with a null id, a null vector, or a null or non-finite component
    take no part. Vectors are compared with those of their own length. Rows that repeat an id are rows
    of their own; a query leaves out its own row only. An empty table gives no rows.
    """
    rows = kept(vector_rows(df, vec_id, vector).withColumn("rid", F.monotonically_increasing_id()))
    n = max(1, -(-rows.count() // shard_rows))
    place = lambda salt: F.pmod(F.xxhash64(F.lit(salt), F.col("rid")), F.lit(n)).cast("int")
    shards = rows.withColumn("shard", place("shard"))
    queries = rows.filter(F.col("id") % every == 0)

    def visit(shard: Shard, b: pa.RecordBatch, vectors: np.ndarray) -> pa.RecordBatch:
        out = {"query": [], "query_id": [], "vec_id": [], "score": []}
        own, ids = numbers(b, "rid"), numbers(b, "id")
        for best, i, rid in zip(search(shard, vectors, own, k, b.column("floor").to_pylist()), ids.tolist(), own.tolist()):
            for score, other in best:
                for name, x in zip(out, (rid, i, -other, score)):
                    out[name].append(x)
        return long_columns(out)

    shape = "query long, query_id long, vec_id long, score long"
    # A first pass searches each query in one shard; the k-th scores found there start the second pass over the others.
    home = place("home")
    at_home = kept(meet(shards, queries.withColumn("floor", F.lit(None).cast("long")), home, Shard, visit, shape))
    kth = at_home.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k).select(F.col("query").alias("rid"), F.col("kth").alias("floor"))
    again = queries.join(kth, "rid", "left").withColumn("home", home).withColumn("to", every_shard(n)).filter("to != home").drop("home")
    found = at_home.union(meet(shards, again.select("dim", "rid", "id", "v", "floor", "to"), F.col("to"), Shard, visit, shape))

    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
