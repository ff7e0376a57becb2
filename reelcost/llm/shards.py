"""Shards of vector rows that queries stream past, and integer components of any size."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
# Sums of integers below this are exact in doubles.
EXACT = 2.0**53


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as Python integers, exact for every finite x."""
    flat = [int(x) * SCALE if abs(x) > 2.0**52 else math.floor(SCALE * x) for x in vectors.ravel().tolist()]
    return np.array([*flat, None], dtype=object)[:-1].reshape(vectors.shape)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.RecordBatch]]:
    """Stretches of rows of one (shard, dim, kind)."""
    for b in batches:
        keys = [np.asarray(b.column(n)) for n in ("shard", "dim", "kind")]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if b.num_rows else []
        cuts = [0, *change, b.num_rows]
        for x, y in zip(cuts, cuts[1:]):
            if y > x:
                yield tuple(int(k[x]) for k in keys), b.slice(x, y - x)


def numbers(b: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(b.column(name))


def matrix(b: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.asarray(b.column("v").flatten(), dtype=np.float64).reshape(b.num_rows, dim)


def vector_rows(df: DataFrame, vec_id: str, vector: str, **columns: Column) -> DataFrame:
    """(id, v, dim, ...) of the rows that take part: neither id nor vector nor one of ``columns`` null, all components finite."""
    raw = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), *[c.alias(n) for n, c in columns.items()])
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return raw.dropna(subset=["id", *columns]).filter(fine).withColumn("dim", F.size("v"))


def every_shard(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def meet(shards: DataFrame, queries: DataFrame, at: Column, build: Callable, answer: Callable, shape: str) -> DataFrame:
    """``answer(build(rows of a shard), queries, their vectors)`` for each shard and stretch of queries of one length of vectors.

    ``shards`` has shard, dim, rid and v; ``queries`` has dim, rid and v, and goes to the shards ``at`` names. Shard rows come
    first in their partition and are held as arrays; queries stream past in Arrow batches. ``build`` gets a dictionary of the
    columns of ``shards``.
    """
    own = [c for c in shards.columns if c not in ("shard", "dim", "rid", "v")]
    extra = [c for c in queries.columns if c not in ("dim", "rid", "v") and c not in own]
    missing = lambda df, names: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
    mine = shards.select("shard", F.lit(0).alias("kind"), "dim", "rid", "v", *own, *missing(queries, extra))
    theirs = queries.select(at.alias("shard"), F.lit(1).alias("kind"), "dim", "rid", "v", *[F.col(c) if c in queries.columns else F.lit(None).cast(shards.schema[c].dataType).alias(c) for c in own], *extra)
    dealt = mine.union(theirs).repartition("shard").sortWithinPartitions("shard", "dim", "kind", "rid")

    def visit(batches):
        rows, key, built = [], None, None
        for (shard, dim, kind), b in runs(batches):
            if key != (shard, dim):
                rows, key, built = [], (shard, dim), None
            if kind == 0:
                rows.append({"v": matrix(b, dim), **{c: numbers(b, c) for c in ("rid", *own)}})
            elif rows:
                built = built if built is not None else build({c: np.concatenate([r[c] for r in rows]) for c in rows[0]})
                yield answer(built, b, matrix(b, dim))

    return dealt.mapInArrow(visit, shape)


def long_columns(columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in columns.items()})
