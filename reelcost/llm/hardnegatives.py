"""Hard negatives by a vertical scan of vector columns.

Rows are dealt into shards of bounded size. A task gathers a shard's rows into one array per dimension,
ordered by label, and then streams the anchors past it. For an anchor the dimensions are read in order of
its own falling magnitude: every step adds a few columns to the scores of the candidates left in the
bitmap, and the largest and smallest that the unread dimensions can still add, from the columns' minima
and maxima in each label, bound each final score. A first scan keeps candidates of the anchor's label that
can still be among its best; the best of all shards are its positives. A second scan turns each positive into
a window of scores and keeps candidates of other labels that can still fall into one of the windows and be among
the first there. Columns are exhausted for the few that stay, so all scores are exact.

Anchors, the stated query set, are copied once to every shard; shard rows move once a scan.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept
from .shards import EXACT, SCALE, every_shard, integers, long_columns, meet, numbers, vector_rows

SHARD_ROWS = 16_384
# Dimensions that are read between two looks at the bounds.
STEP = 8


class Cut(NamedTuple):
    """Share of the positive's score that a negative has, in hundredths: both ends are in."""

    low: int = 50
    high: int = 95


class Columns:
    """One shard: an array per dimension, rows ordered by label, with minima and maxima by label."""

    def __init__(self, rows: dict[str, np.ndarray]):
        labels, ids, rids, vectors = (rows[c] for c in ("label", "id", "rid", "v"))
        order = np.lexsort((rids, labels))
        self.raw, self.ids, self.rids = vectors[order], ids[order], rids[order]
        self.labels, starts = np.unique(labels[order], return_index=True)
        self.starts = np.append(starts, len(order))
        self.with_values(np.floor(SCALE * self.raw))
        self.largest = np.abs(self.columns).max(axis=1) if len(order) else np.zeros(vectors.shape[1])
        self._exact: Columns | None = None

    def with_values(self, values: np.ndarray) -> None:
        self.columns = np.ascontiguousarray(values.T)
        cut = self.starts[:-1]
        self.low, self.high = (np.array([f(self.columns[:, a:b], axis=1) for a, b in zip(cut, self.starts[1:])]) for f in (np.min, np.max))

    def ready_for(self, raw: np.ndarray) -> tuple[Columns, np.ndarray]:
        """Columns and query in doubles when no sum can leave the integers that these hold, else in Python integers."""
        with np.errstate(over="ignore", invalid="ignore"):
            query = np.floor(SCALE * raw)
            if np.abs(query) @ self.largest < EXACT:
                return self, query
        if self._exact is None:
            self._exact = Columns.__new__(Columns)
            self._exact.__dict__.update(self.__dict__)
            self._exact.with_values(integers(self.raw))
        return self._exact, integers(raw)

    def of_label(self, label: int) -> np.ndarray:
        at = np.searchsorted(self.labels, label)
        return np.arange(*self.starts[at : at + 2]) if at < len(self.labels) and self.labels[at] == label else np.empty(0, np.int64)

    def scan(self, query: np.ndarray, rows: np.ndarray, groups: np.ndarray, keep: Callable, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
        """Rows that ``keep(lower, upper)`` leaves of ``rows`` and their scores.

        ``groups`` are the labels (by number) whose minima and maxima bound the unread dimensions.
        """
        order = np.argsort(-np.abs(query), kind="stable")
        q = query[order]
        ends = q * self.low[groups].min(axis=0)[order], q * self.high[groups].max(axis=0)[order]
        least, most = (np.append(np.cumsum(f(*ends)[::-1])[::-1], 0) for f in (np.minimum, np.maximum))
        part = np.zeros(len(rows), dtype=query.dtype)
        for at in range(0, max(1, len(q)), step):
            stop = min(at + step, len(q))
            whole = len(rows) == self.columns.shape[1]
            for d in range(at, stop):
                column = self.columns[order[d]]
                part = part + q[d] * (column if whole else column[rows])
            left = keep(part + least[stop], part + most[stop])
            if not left.all():
                rows, part = rows[left], part[left]
            if not len(rows):
                break
        return rows, part


def kth_largest(values: np.ndarray, k: int):
    return np.sort(values)[-k] if values.dtype == object else np.partition(values, len(values) - k)[len(values) - k]


def best_of(k: int) -> Callable:
    """Keeps what can still be one of the k best."""

    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        if len(lower) <= k:
            return np.ones(len(lower), dtype=bool)
        return (upper >= kth_largest(lower, k)).astype(bool)

    return keep


def in_windows(windows: list[tuple[int, int]], k: int) -> Callable:
    """Keeps what can still be one of the k best in one of the windows (both ends in)."""

    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        left = np.zeros(len(lower), dtype=bool)
        for low, high in windows:
            open_ = ((upper >= low) & (lower <= high)).astype(bool)
            sure = lower[open_ & ((lower >= low) & (upper <= high)).astype(bool)]
            if len(sure) > k:
                open_ &= (upper >= kth_largest(sure, k)).astype(bool)
            left |= open_
        return left

    return keep


def window_of(score: int, cut: Cut) -> tuple[int, int]:
    """Whole scores s with cut.low * score <= 100 s <= cut.high * score."""
    return -(-cut.low * score // 100), cut.high * score // 100


def first(ids: np.ndarray, rids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The k first (score, id, row) by falling score, then id, then row."""
    if len(scores) > k:
        near = (scores >= kth_largest(scores, k)).astype(bool)
        ids, rids, scores = ids[near], rids[near], scores[near]
    found = sorted(zip((-int(s) for s in scores), ids.tolist(), rids.tolist()))[:k]
    return [(-s, i, r) for s, i, r in found]


def _best(found: DataFrame, by: list[str], k: int, id_: str, row: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), id_, row)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, positives: int = 5, negatives: int = 3, cut: Cut = Cut(), every: int = 50, relabel: Column | None = None,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """The first negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by ``every``; scores are inner products of floor(256 x). An anchor's
    positives are its best other rows of the same label, its negatives rows of other labels whose score
    lies in the positive's window; ties go to the smaller id. ``relabel`` replaces the label of each row.
    Rows with a null id, label or vector, or a null or non-finite component take no part, nor do vectors of
    another length than the anchor's. Rows that repeat an id are rows of their own: an anchor leaves out
    its own row only. An empty table gives no rows. Scores are exact; one beyond a 64-bit integer among
    the results is an error.
    """
    taking_part = vector_rows(df, vec_id, vector, label=(F.col(label) if relabel is None else relabel).cast("long"))
    rows = kept(taking_part.withColumn("rid", F.monotonically_increasing_id()))
    n_shards = max(1, -(-rows.count() // shard_rows))
    shards = rows.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(n_shards)).cast("int"))
    anchors = rows.filter(F.col("id") % every == 0)

    def nearest(columns: Columns, b: pa.RecordBatch, vectors: np.ndarray) -> pa.RecordBatch:
        out = {"anchor": [], "positive_id": [], "positive": [], "score": []}
        for rid, own, raw_query in zip(numbers(b, "rid").tolist(), numbers(b, "label").tolist(), vectors):
            rows_ = columns.of_label(own)
            rows_ = rows_[columns.rids[rows_] != rid]
            if len(rows_):
                at, query = columns.ready_for(raw_query)
                left, scores = at.scan(query, rows_, np.searchsorted(at.labels, [own]), best_of(positives))
                for score, i, r in first(at.ids[left], at.rids[left], scores, positives):
                    for name, x in zip(out, (rid, i, r, score)):
                        out[name].append(x)
        return long_columns(out)

    near = meet(shards, anchors, every_shard(n_shards), Columns, nearest, "anchor long, positive_id long, positive long, score long")
    chosen = kept(_best(near, ["anchor"], positives, "positive_id", "positive"))
    # At most ``positives`` windows an anchor, in the order of their ranks.
    wanted = chosen.groupBy(F.col("anchor").alias("rid")).agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("windows"))
    asking = anchors.join(wanted, "rid").select("dim", "rid", "id", "label", "v", F.col("windows.rank").alias("ranks"), F.col("windows.score").alias("scores"))

    def inside(columns: Columns, b: pa.RecordBatch, vectors: np.ndarray) -> pa.RecordBatch:
        out = {"anchor": [], "place": [], "negative_id": [], "negative": [], "score": []}
        for rid, own, ranks, scores, raw_query in zip(numbers(b, "rid").tolist(), numbers(b, "label").tolist(), b.column("ranks").to_pylist(), b.column("scores").to_pylist(), vectors):
            windows = [(rank, *window_of(s, cut)) for rank, s in zip(ranks, scores)]
            windows = [w for w in windows if w[1] <= w[2]]
            other = np.flatnonzero(columns.labels != own)
            if windows and len(other):
                at, query = columns.ready_for(raw_query)
                mine = at.of_label(own)
                rows_ = np.delete(np.arange(len(at.ids)), mine)
                left, found = at.scan(query, rows_, other, in_windows([w[1:] for w in windows], negatives))
                for rank, low, high in windows:
                    ok = ((found >= low) & (found <= high)).astype(bool)
                    for score, i, r in first(at.ids[left[ok]], at.rids[left[ok]], found[ok], negatives):
                        for name, x in zip(out, (rid, rank, i, r, score)):
                            out[name].append(x)
        return long_columns(out)

    met = meet(shards, asking, every_shard(n_shards), Columns, inside, "anchor long, place long, negative_id long, negative long, score long")
    ranked = _best(met, ["anchor", "place"], negatives, "negative_id", "negative").withColumnRenamed("score", "negative_score")
    pairs = chosen.select("anchor", "positive_id", F.col("rank").cast("long").alias("place"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id"))
    return ranked.join(pairs, ["anchor", "place"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
