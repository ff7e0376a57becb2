"""Joins, set operations, de-duplication, ordering and point lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.ordered import neighbours, top_rows
from ..core.sizing import join_stats


def second_last_rows(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Second-to-last row per key, or the only one.

    Ranking stops at two rows per key, which Spark does before the shuffle.
    """
    two = top_rows(df, key, [F.desc(o) for o in order], 2, rank="__rank")
    best = two.groupBy(*key).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns]), "__rank").alias("__row"))
    return best.select("__row.*")


def align_quality(
    df: DataFrame, quality: Sequence[str], reel: str = "reel_id", order: Sequence[str] = ("ts",), shift: int = -1
) -> DataFrame:
    """Attach the laboratory values of the following reel to every process row."""
    lab = second_last_rows(df.select(reel, *order, *[q for q in quality if q not in order]), [reel], order)
    lab = lab.select((F.col(reel) + shift).alias(reel), *quality)
    return df.drop(*quality).join(lab, reel, "left")


def outer_match(left: DataFrame, right: DataFrame, key: str, value: str, count: str) -> DataFrame:
    """Full outer comparison: missing counts are zero, a missing value is taken from the other side."""
    a = left.select(key, F.col(value).alias("value_0"), F.col(count).alias("n_0"))
    b = right.select(key, F.col(value).alias("value_1"), F.col(count).alias("n_1"))
    return a.join(b, key, "full_outer").select(
        key,
        F.coalesce("n_0", F.lit(0)).alias("n_0"),
        F.coalesce("n_1", F.lit(0)).alias("n_1"),
        F.coalesce("value_0", "value_1").alias("value_0"),
        F.coalesce("value_1", "value_0").alias("value_1"),
    )


def with_keys_of(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_semi")


def without_keys_of(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_anti")


def nearest_in_time(
    left: DataFrame, right: DataFrame, ts: str, right_ts: str, values: Sequence[str], part: Sequence[str] = (), blocks: int | None = None
) -> DataFrame:
    """Each left row gets the values at the nearest right time; the earlier one wins a tie.

    Both sides are put in one time order and the last right row before and the first after a
    left row are carried over, so there is no range join and a busy period splits into blocks.
    """
    payload = F.struct(F.col(right_ts).alias("t"), *[F.col(v) for v in values])
    r = right.select(*part, F.col(right_ts).alias(ts), payload.alias("__hit"), F.lit(0).alias("__side"))
    both = left.withColumn("__side", F.lit(1)).unionByName(r, allowMissingColumns=True)
    filled = neighbours(both, part, [ts, "__side"], {"__b": F.col("__hit")}, {"__a": F.col("__hit")}, blocks)
    near = filled.filter(F.col("__side") == 1)
    gap = lambda c: F.abs(F.unix_micros(F.col(ts)) - F.unix_micros(F.col(f"{c}.t")))
    pick = F.when(F.col("__a").isNull() | (gap("__b") <= gap("__a")), F.col("__b")).otherwise(F.col("__a"))
    return near.withColumn("__p", pick).select(*left.columns, F.col("__p.t").alias(right_ts), *[F.col(f"__p.{v}") for v in values])


def nearest_row(df: DataFrame, at: str, ts: str = "ts", ties: Sequence[str] = (), warn_minutes: float = 240.0) -> DataFrame:
    """The row closest to a point in time with its distance and a tolerance flag."""
    gap = F.abs(F.unix_micros(F.col(ts)) - F.unix_micros(F.lit(at).cast("timestamp"))) / 60e6
    out = df.withColumn("time_diff_minutes", gap).orderBy("time_diff_minutes", ts, *ties).limit(1)
    return out.withColumn("far_away", F.col("time_diff_minutes") > warn_minutes)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def keys_only_in_first(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return top_rows(df, keys, [F.desc(o) for o in order])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key tuple; NULLs in the keys compare as equal."""
    return top_rows(df, keys, [F.asc(o) for o in order])


def subtract_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    means = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
    return join_stats(df, means, []).select(
        *[(F.col(c) - F.col(f"__m_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def join_on_row_key(parts: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Column-wise union of tables that describe the same rows."""
    return reduce(lambda a, b: a.join(b, list(key), "inner"), parts)


def best_and_worst(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Label with the lowest and with the highest score per key; the smaller label wins a tie."""
    low = F.min(F.struct(F.col(score), F.col(label)))
    high = F.max(F.struct(F.col(score), (-F.col(label)).alias("__neg"), F.col(label)))
    return df.groupBy(*keys).agg(low[label].alias("best"), high[label].alias("worst"))


def latest_rows(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", ties: Sequence[str] = ()) -> DataFrame:
    if not keys:
        return df.orderBy(F.desc(ts), *[F.desc(t) for t in ties]).limit(1)
    return keep_last(df, keys, [ts, *ties])


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
