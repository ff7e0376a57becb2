"""Exact interpolated quantiles per group that stay bounded when a group is huge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizing import is_small, join_stats, materialise

SKETCH_ACCURACY = 20_000
# Rows of a group whose values one task may hold.
GROUP_ROWS = 100_000


def group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    specs: Mapping[str, tuple[Column, float]],
    two_pass: bool | None = None,
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """One row per group with ``{alias: quantile}``; NULLs are ignored, NULL keys kept.

    Small inputs, and groups of at most ``GROUP_ROWS`` rows, use the built-in exact ``percentile``, whose state grows with
    the number of distinct values. Larger ones take two passes: a mergeable sketch brackets each wanted
    rank, then the rows below the bracket are only counted and the few inside are ranked.
    """
    by = list(by)
    aggs = [F.percentile(c.cast("double"), F.lit(float(p))).alias(a) for a, (c, p) in specs.items()]
    if two_pass is None and not is_small(df) and by:
        return _by_size(df, by, specs, aggs, accuracy)
    if two_pass is None:
        two_pass = not is_small(df)
    if not two_pass:
        return df.groupBy(*by).agg(*aggs)
    return _bracketed(df, by, specs, accuracy)


def _by_size(df, by, specs, aggs, accuracy):
    """Few large groups are bracketed; millions of small ones must not each keep a sketch."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    listed = sizes.agg(F.count(F.when(F.col("__n") <= GROUP_ROWS, 1)), F.count(F.when(F.col("__n") > GROUP_ROWS, 1))).first()
    if not listed[1]:
        return df.groupBy(*by).agg(*aggs)
    if not listed[0]:
        return _bracketed(df, by, specs, accuracy)
    large = materialise(sizes.filter(F.col("__n") > GROUP_ROWS).select(*by))
    few = join_stats(df, large, by, how="left_anti", null_safe=True).groupBy(*by).agg(*aggs)
    return few.unionByName(_bracketed(join_stats(df, large, by, how="left_semi", null_safe=True), by, specs, accuracy))


def _bracketed(df, by, specs, accuracy):
    slack = 2.0 / accuracy
    flat = df.select(*by, *[c.cast("double").alias(f"__v{i}") for i, (c, _) in enumerate(specs.values())])
    probs = [p for _, p in specs.values()]
    sketch = flat.groupBy(*by).agg(
        *[
            F.percentile_approx(
                f"__v{i}", [max(0.0, p - slack), min(1.0, p + slack)], accuracy
            ).alias(f"__b{i}")
            for i, p in enumerate(probs)
        ],
        *[F.count(f"__v{i}").alias(f"__n{i}") for i in range(len(probs))],
    )
    tagged = join_stats(flat, sketch, by, null_safe=True)
    lo = [F.col(f"__b{i}")[0] for i in range(len(probs))]
    hi = [F.col(f"__b{i}")[1] for i in range(len(probs))]
    val = [F.col(f"__v{i}") for i in range(len(probs))]
    below = tagged.groupBy(*by).agg(
        *[F.count(F.when(val[i] < lo[i], 1)).alias(f"__c{i}") for i in range(len(probs))],
        *[F.first(f"__n{i}").alias(f"__n{i}") for i in range(len(probs))],
        # Nearest values beyond the bracket, for ranks that touch its edge in tiny groups.
        *[F.max(F.when(val[i] < lo[i], val[i])).alias(f"__x{i}") for i in range(len(probs))],
        *[F.min(F.when(val[i] > hi[i], val[i])).alias(f"__y{i}") for i in range(len(probs))],
    )
    # One row a group, which the steps below and the result read.
    below = materialise(below)
    inside = tagged.select(
        *by,
        F.explode(
            F.filter(
                F.array(
                    *[
                        F.struct(
                            F.lit(i).alias("i"),
                            F.when(val[i].between(lo[i], hi[i]), val[i]).alias("v"),
                        )
                        for i in range(len(probs))
                    ]
                ),
                lambda s: s["v"].isNotNull(),
            )
        ).alias("__s"),
    )
    counted = inside.groupBy(*by, F.col("__s.i").alias("__i"), F.col("__s.v").alias("__v")).agg(
        F.count(F.lit(1)).alias("__k")
    )
    base = below.select(
        *by,
        F.posexplode(
            F.array(*[F.struct(*[F.col(f"__{k}{i}").alias(k) for k in "cnxy"]) for i in range(len(probs))])
        ).alias("__i", "__m"),
    ).select(*by, "__i", *[F.col(f"__m.{k}").alias(f"__{k}") for k in "cnxy"])
    placed = join_stats(counted, base, [*by, "__i"], how="inner", null_safe=True)
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("__i") + 1)
    # At most a 4/accuracy share of the group's rows reaches this window.
    w = Window.partitionBy(*by, "__i").orderBy("__v")
    upto = F.col("__c") + F.sum("__k").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rank = (F.col("__n") - 1) * prob
    placed = placed.select(*by, "__i", "__v", "__c", "__x", "__y", upto.alias("__u"), rank.alias("__r"))

    def at(k):
        found = F.min(F.when(F.col("__u") > k("__r"), F.col("__v")))
        return F.when(k(F.first("__r")) < F.first("__c"), F.first("__x")).otherwise(F.coalesce(found, F.first("__y")))

    picked = placed.groupBy(*by, "__i").agg(
        F.first("__r").alias("__r"),
        at(F.floor).alias("__a"),
        at(F.ceil).alias("__z"),
    )
    part = F.col("__r") - F.floor("__r")
    picked = picked.withColumn("__q", F.col("__a") + part * (F.col("__z") - F.col("__a")))
    wide = picked.groupBy(*by).agg(
        *[F.max(F.when(F.col("__i") == i, F.col("__q"))).alias(a) for i, a in enumerate(specs)]
    )
    # Groups whose every value is NULL are absent above; keep them with NULL quantiles.
    return join_stats(below.select(*by), wide, by, null_safe=True) if by else wide


def group_medians(df: DataFrame, by: Sequence[str], cols: Mapping[str, Column], **kw) -> DataFrame:
    return group_quantiles(df, by, {a: (c, 0.5) for a, c in cols.items()}, **kw)
