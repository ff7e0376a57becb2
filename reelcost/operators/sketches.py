"""Stored sketches of a measure per key, merged later without its rows: an opt-in where approximate answers do.

A month's sketches are written once. Quantiles and distinct counts of any span of months, and of any coarser key, come
from merging them, so the work grows with keys and months and not with rows. Exact answers are those of `core.quantiles`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.sizing import join_stats, materialise

QUANTILE_K = 4096
DISTINCT_BITS = 14


def rank_error(k: int = QUANTILE_K) -> float:
    """Rank error of a quantile as a share of the rows, kept with 99 % confidence, merges included."""
    return 2.296 / k**0.9021


def distinct_error(bits: int = DISTINCT_BITS) -> float:
    """Relative standard error of a distinct count."""
    return 1.04 / 2 ** (bits / 2)


def sketch_measures(
    df: DataFrame, keys: Sequence[str], measures: Sequence[str] = (), identities: Sequence[str] = (), k: int = QUANTILE_K, bits: int = DISTINCT_BITS
) -> DataFrame:
    """One row per key with ``n_rows``, ``<measure>_sketch`` for quantiles and ``<identity>_ids`` for distinct counts.

    NULLs do not count. A sketch has a bounded size whatever the key holds, and is built before the shuffle.
    """
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.kll_sketch_agg_double(F.col(m).cast("double"), F.lit(k)).alias(f"{m}_sketch") for m in measures],
        *[F.hll_sketch_agg(i, F.lit(bits)).alias(f"{i}_ids") for i in identities],
    )


def merge_sketches(sketches: DataFrame, keys: Sequence[str], k: int = QUANTILE_K) -> DataFrame:
    """Sketches of coarser keys from stored ones."""
    cols = [c for c in sketches.columns if c not in keys]
    return sketches.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"),
        *[F.kll_merge_agg_double(c, F.lit(k)).alias(c) for c in cols if c.endswith("_sketch")],
        *[F.hll_union_agg(c).alias(c) for c in cols if c.endswith("_ids")],
    )


def sketch_answers(
    sketches: DataFrame, keys: Sequence[str], quantiles: Mapping[str, tuple[str, float]], distinct: Mapping[str, str] | None = None
) -> DataFrame:
    """``{name: (measure, probability)}`` and ``{name: identity}`` answered from sketches; NULL for a key without values."""
    def value(measure, p):
        held = F.kll_sketch_get_n_double(f"{measure}_sketch") > 0
        return F.when(held, F.kll_sketch_get_quantile_double(f"{measure}_sketch", F.lit(float(p))))

    return sketches.select(
        *keys,
        "n_rows",
        *[value(m, p).alias(name) for name, (m, p) in quantiles.items()],
        *[F.hll_sketch_estimate(f"{i}_ids").alias(name) for name, i in (distinct or {}).items()],
    )


def rank_interval(df: DataFrame, answers: DataFrame, keys: Sequence[str], quantiles: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Answers with ``<name>_error``: how far the exact share of rows around the answer is from its probability, 0 if it covers it."""
    # Sketches draw at random, so an answer must not be computed twice.
    answers = materialise(answers)
    rows = join_stats(df.select(*keys, *{m for m, _ in quantiles.values()}), answers.select(*keys, *quantiles), keys, null_safe=True)
    counted = rows.groupBy(*keys).agg(
        *[F.avg((F.col(m) < F.col(name)).cast("double")).alias(f"__l_{name}") for name, (m, _) in quantiles.items()],
        *[F.avg((F.col(m) <= F.col(name)).cast("double")).alias(f"__h_{name}") for name, (m, _) in quantiles.items()],
    )
    out = join_stats(answers, counted, keys, null_safe=True)
    errors = {
        f"{name}_error": F.greatest(F.lit(0.0), F.col(f"__l_{name}") - p, p - F.col(f"__h_{name}")) for name, (_, p) in quantiles.items()
    }
    return out.select(*answers.columns, *[e.alias(name) for name, e in errors.items()])
