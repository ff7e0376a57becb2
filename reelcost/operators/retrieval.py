"""Document chunks and exact vector search."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.ordered import top_rows
from ..core.sizing import join_stats, pin_if_small
from ..functions.expr import dot

QUERY_BATCH = 2_000  # query vectors sent to every task at a time


def clean_text(c: str | Column) -> Column:
    """NUL to blank, blanks and tabs squeezed, at most one empty line, trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(c, "\\x00", " ")
    s = F.regexp_replace(s, "[ \\t]+", " ")
    s = F.regexp_replace(s, "\\n{3,}", "\n\n")
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def clean_pages(df: DataFrame, text: str) -> DataFrame:
    """Cleaned texts; pages that are empty afterwards go."""
    return df.withColumn(text, clean_text(text)).filter(F.col(text).isNotNull() & (F.col(text) != ""))


def chunk_texts(df: DataFrame, text: str, size: int, overlap: int, out: str = "chunk_text") -> DataFrame:
    """Overlapping character windows over the whole text; the last one may be short.

    Adds ``chunk`` (from 0), ``start`` and ``end``. The window after one that reaches the end of
    the text is not produced.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk size")
    n, step = F.length(text), size - overlap
    last = F.when(n > size, F.ceil((n - size) / step)).otherwise(F.lit(0)).cast("int")
    rows = df.filter(F.length(text) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("chunk") * step
    return rows.withColumns(
        {"start": start, "end": F.least(start + size, n), out: F.substring(F.col(text), start + 1, F.lit(size))}
    ).drop(text)


def chunk_id(file: str | Column, page: str | Column, chunk: str | Column) -> Column:
    cols = [F.col(c) if isinstance(c, str) else c for c in (file, page, chunk)]
    return F.format_string("%s:p%s:c%s", *[c.cast("string") for c in cols])


def unit_vector(v: str | Column) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def check_dimension(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Fail in the tasks when a vector has another length."""
    note = F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(vector).cast("string"))
    return df.withColumn(vector, F.when(F.size(vector) == dim, F.col(vector)).otherwise(F.raise_error(note)))


def _batch_scores(vectors: DataFrame, vec_id: str, vector: str, ids: list, matrix: np.ndarray, k: int, query_type: T.DataType, query_id: str) -> DataFrame:
    """Best ``k`` rows per query and batch: one matrix product per Arrow batch."""

    def score(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            sims = np.vstack(pdf[vector].to_numpy()).astype(float) @ matrix.T
            keys = pdf[vec_id].to_numpy()
            order = np.lexsort((np.broadcast_to(keys, sims.T.shape), -np.round(sims.T, 12)), axis=-1)[:, :k]
            take = order.shape[1]
            yield pd.DataFrame(
                {query_id: np.repeat(np.array(ids, dtype=object), take), vec_id: keys[order].ravel(), "score": np.take_along_axis(sims.T, order, 1).ravel()}
            )

    schema = T.StructType([T.StructField(query_id, query_type), vectors.schema[vec_id], T.StructField("score", T.DoubleType())])
    return vectors.select(vec_id, vector).mapInPandas(score, schema)


def top_matches(
    vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", query_id: str = "query_id", vector: str = "embedding", cosine: bool = True
) -> DataFrame:
    """Exact k best vectors per query by cosine (or inner product), with rank from 1.

    Queries go to the tasks in bounded batches; each batch of vectors keeps only its own k best
    before the shuffle. Equal scores are ordered by id.
    """
    prep = lambda df: df.withColumn(vector, unit_vector(vector)) if cosine else df
    base, q = prep(vectors.select(vec_id, vector)), prep(queries.select(query_id, vector))
    q_type = queries.schema[query_id].dataType
    small, fits = pin_if_small(q, QUERY_BATCH)
    if fits:
        rows = small.collect()
        found = _batch_scores(base, vec_id, vector, [r[0] for r in rows], np.array([r[1] for r in rows], dtype=float), k, q_type, query_id) if rows else None
    else:
        # More queries than fit: hash them into parts and scan the vectors once per part.
        parts = -(-q.count() // (QUERY_BATCH // 2))
        tagged = q.withColumn("__part", F.pmod(F.xxhash64(query_id), F.lit(parts)))
        found = None
        for p in range(parts):
            rows = tagged.filter(F.col("__part") == p).collect()
            if rows:
                one = _batch_scores(base, vec_id, vector, [r[0] for r in rows], np.array([r[1] for r in rows], dtype=float), k, q_type, query_id)
                found = one if found is None else found.unionByName(one)
    if found is None:
        return base.sparkSession.createDataFrame([], T.StructType([queries.schema[query_id], vectors.schema[vec_id], *T.StructType.fromDDL("score double, rank int").fields]))
    return top_rows(found, [query_id], [F.desc(F.round("score", 12)), F.asc(vec_id)], k, rank="rank")


def attach_chunks(matches: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Chunk rows of the matches, ranks kept; unknown ids are skipped."""
    return matches.join(chunks, key, "inner")


def assemble_context(matches: DataFrame, query_id: str = "query_id", text: str = "text", sep: str = "\n\n") -> DataFrame:
    """Ranked texts of each query (its k matches) in one string, with the source list."""
    parts = F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("t"))))
    return matches.groupBy(query_id).agg(F.array_join(F.transform(parts, lambda p: p["t"]), sep).alias("context"), F.count(F.lit(1)).alias("n_chunks"))


def answer_mode(matches: DataFrame, queries: DataFrame, question: str, keywords: Sequence[str], query_id: str = "query_id", floor: float = 0.25) -> DataFrame:
    """``grounded`` when the best similarity reaches the floor, else by keyword ``domain`` or ``general``."""
    best = matches.groupBy(query_id).agg(F.max("score").alias("top_score"))
    got = join_stats(queries.select(query_id, question), best, [query_id])
    near = F.coalesce(F.col("top_score") >= floor, F.lit(False))
    word = F.coalesce(F.lower(question).rlike("|".join(keywords)), F.lit(False))
    return got.select(query_id, "top_score", F.when(near, "grounded").when(word, "domain").otherwise("general").alias("mode"))


def chunk_by_id(chunks: DataFrame, ids: Sequence, key: str = "chunk_id") -> DataFrame:
    return chunks.filter(F.col(key).isin(list(ids)))
