"""Resampling, segments, exponential means, lag designs, splits and rolling statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.ordered import bounded_frames, row_index, running_sums
from ..core.orderstats import Windows
from ..core.sizing import block_count, join_stats, written
from ..functions.expr import truthy


def resample_mean(
    df: DataFrame, ts: str, width: str, cols: Sequence[str], keys: Sequence[str] = (), fill_gaps: bool = False
) -> DataFrame:
    """Mean per fixed time bin; with ``fill_gaps`` every bin between a key's first and last one appears."""
    bins = df.groupBy(*keys, F.window(ts, width).alias("__w")).agg(*[F.avg(c).alias(c) for c in cols])
    bins = bins.select(*keys, F.col("__w.start").alias("bin"), *cols)
    if not fill_gaps:
        return bins
    ends = bins.groupBy(*keys).agg(F.min("bin").alias("__a"), F.max("bin").alias("__z"))
    every = ends.select(*keys, F.explode(F.sequence("__a", "__z", F.expr(f"INTERVAL {width}"))).alias("bin"))
    return every.join(bins, [*keys, "bin"], "left")


def segments(
    df: DataFrame, part: Sequence[str], order: Sequence[str], grade: str, ts: str = "ts", max_gap_hours: float = 12.0,
    peek: Mapping[str, str] | None = None, blocks: int | None = None,
) -> DataFrame:
    """Segment number per machine: a new one starts on a grade change or after a longer gap.

    ``peek`` adds the following row's value of a column in the same pass. ``__start`` is
    true on the first row of a segment, ``__end`` on its last one.
    """
    peek = peek or {}

    def exprs(w):
        def apart(there, gap):
            none = there(F.lit(1)).over(w).isNull()
            return none | ~F.col(grade).eqNullSafe(there(grade).over(w)) | truthy(gap > max_gap_hours * 3600 * 1e6)

        now = F.unix_micros(ts)
        new = apart(F.lag, now - F.unix_micros(F.lag(ts).over(w)))
        end = apart(F.lead, F.unix_micros(F.lead(ts).over(w)) - now)
        nxt = {a: F.lead(c).over(w) for a, c in peek.items()}
        return {"__start": new, "__end": end, **nxt}

    blocks = blocks or block_count(df)
    marked = bounded_frames(df, part, order, 1, 1, exprs, blocks)
    if blocks > 1:
        # Block boundaries, carries and running sums all read it.
        marked = written(marked)
    return running_sums(marked, part, order, {"segment": F.col("__start").cast("long")}, blocks)


def segment_ewm(
    df: DataFrame, part: Sequence[str], order: Sequence[str], grade: str, col: str, ts: str = "ts", half_life_minutes: float = 120.0,
    max_gap_hours: float = 12.0, out: str = "ewm", blocks: int | None = None,
) -> DataFrame:
    """Time-decayed mean per segment; the first value is the mean of the first two rows.

    A segment is cut into slices of 60 half-lives, in which running sums relative to the slice start
    stay far from overflow. A slice gets the sums of all earlier ones from the last slice that has
    values, so a value counts until newer ones outweigh it, however long ago it was. Segments
    within one slice, known by their ends, get nothing from others and stay out of that step.
    """
    blocks = blocks or block_count(df)
    seg = segments(df, part, order, grade, ts, max_gap_hours, {"__next": col}, blocks)
    if blocks > 1:
        seg = written(seg)
    half = half_life_minutes * 60e6
    slice_len = 60 * half
    t = F.unix_micros(ts)
    own = F.floor(t / slice_len)
    sliced = seg.withColumn("__at", own)
    weight = F.when(F.col(col).isNotNull(), F.pow(F.lit(2.0), (t - F.col("__at") * slice_len) / half))
    keys = [*part, "segment", "__at"]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = sliced.select("*", F.sum(F.col(col) * weight).over(w).alias("__sx"), F.sum(weight).over(w).alias("__sw"))

    # One row a slice. Over 17 slices a weight falls below the smallest double, so 18 rows back hold all that counts.
    totals = sliced.groupBy(*keys).agg(F.sum(F.col(col) * weight).alias("x"), F.sum(weight).alias("w"), F.bool_or("__start").alias("s"), F.bool_or("__end").alias("e"))
    totals = totals.filter(~(F.col("s") & F.col("e")))
    segment = Window.partitionBy(*part, "segment")
    recent = F.collect_list(F.when(F.col("w").isNotNull(), F.struct("__at", "x", "w"))).over(segment.orderBy("__at").rowsBetween(-18, 0))
    listed = totals.select(*keys, "w", recent.alias("recent"))
    decayed = lambda f: F.aggregate("recent", F.lit(0.0), lambda s, e: s + e[f] * F.pow(F.lit(2.0), -60.0 * (F.col("__at") - e["__at"])))
    state = F.when(F.col("w").isNotNull(), F.struct(F.col("__at").alias("at"), decayed("x").alias("x"), decayed("w").alias("w")))
    before = segment.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    carry = listed.withColumn("__state", state).select(*keys, F.last("__state", ignorenulls=True).over(before).alias("__c"))
    if blocks > 1:
        carry = written(carry)
    got = join_stats(sums, carry, keys, null_safe=True)
    fade = F.pow(F.lit(2.0), -60.0 * (F.col("__at") - F.col("__c.at")))
    total = lambda own, old: F.col(own) + F.coalesce(F.col(old) * fade, F.lit(0.0))
    mean = F.when(F.col("__sw").isNull(), F.try_divide("__c.x", "__c.w")).otherwise(F.try_divide(total("__sx", "__c.x"), total("__sw", "__c.w")))
    soft = F.when(F.col("__start") & ~F.col("__end"), (F.col(col) + F.col("__next")) / 2).otherwise(mean)
    return got.select(*df.columns, "segment", soft.alias(out))


def lag_design(
    df: DataFrame, part: Sequence[str], order: Sequence[str], target: str, inputs: Sequence[str], input_lags: Sequence[int],
    target_lags: Sequence[int] = range(1, 6), blocks: int | None = None,
) -> DataFrame:
    """Lagged inputs and target values as columns; rows with a missing value go."""
    wanted = {f"{c}_lag{k}": (c, k) for c in inputs for k in input_lags}
    wanted |= {f"{target}_lag{k}": (target, k) for k in target_lags}
    reach = max([k for _, k in wanted.values()], default=0)
    got = bounded_frames(
        df, part, order, reach, 0, lambda w: {a: (F.lag(c, k).over(w) if k else F.col(c)) for a, (c, k) in wanted.items()}, blocks
    )
    return got.dropna(subset=[target, *wanted])


def chronological_split(df: DataFrame, order: Sequence[str], share: float = 0.8, out: str = "is_train", blocks: int | None = None) -> DataFrame:
    """First ``share`` of the rows in time order for training, the rest for the test."""
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    numbered = join_stats(row_index(df, [], order, "__rn", blocks), n, [])
    return numbered.withColumn(out, F.col("__rn") <= F.floor(F.col("__n") * share)).select(*df.columns, out)


def time_folds(df: DataFrame, order: Sequence[str], folds: int = 5, out: str = "test_fold", blocks: int | None = None) -> DataFrame:
    """Number of the fold that tests a row (0: training only).

    Fold ``k`` trains on all rows with a smaller number, so the training set grows.
    """
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    numbered = join_stats(row_index(df, [], order, "__rn", blocks), n, [])
    size = F.floor(F.col("__n") / (folds + 1))
    lead_in = F.col("__n") - folds * size
    fold = F.greatest(F.lit(0), F.floor((F.col("__rn") - 1 - lead_in) / size) + 1).cast("int")
    return numbered.withColumn(out, fold).select(*df.columns, out)


def rolling_stats(
    df: DataFrame, group: str, ts: str, col: str, window_seconds: int, tail: float = 0.025
) -> DataFrame:
    """Trailing time-window mean, deviation, median and tail quantiles per group and time.

    Equal (group, time, value) rows are counted first. Times are cut into slices of the window's width; a slice and
    the one before it hold all windows that end in it, and one order-statistic structure answers them all.
    """
    counted = df.filter(F.col(col).isNotNull() & F.col(ts).isNotNull()).groupBy(group, ts, F.col(col).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    width = window_seconds * 1_000_000
    timed = counted.withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("__own", F.floor(F.col("__t") / width))
    dealt = timed.withColumn("__at", F.explode(F.array("__own", F.col("__own") + 1)))
    names = ["n", "mean", "std", "median", "p_low", "p_high"]

    def stats(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("__t", "ascending"), ("__v", "ascending")])
        t, v, n, own = (rows.column(c).to_numpy() for c in ("__t", "__v", "__n", "__own"))
        # One result per time: its last row's window.
        last = np.flatnonzero((np.append(t[1:] != t[:-1], True)) & (own == rows.column("__at").to_numpy()))
        high, low = last + 1, np.searchsorted(t, t[last] - width, side="right")
        center = v.mean() if len(v) else 0.0
        d = (v - center).astype(np.longdouble)
        # One running sum at a time: only its values at the windows' ends are kept.
        sums = (np.concatenate([[0], np.cumsum(x)]) for x in (n, d * n, d * d * n))
        count, s, q = (x[high] - x[low] for x in sums)
        del d
        with np.errstate(divide="ignore", invalid="ignore"):
            var = np.maximum(q - s * s / count, 0) / (count - 1)
        std = pa.array(np.sqrt(var.astype(float)), mask=count < 2)
        w = Windows(v, n)
        found = [pa.array(count), pa.array((center + s / count).astype(float)), std, *[pa.array(w.quantile(low, high, p)) for p in (0.5, tail, 1 - tail)]]
        return pa.table([*[rows.column(c).take(pa.array(last)) for c in (group, ts)], *found], names=[group, ts, *names])

    shape = T.StructType([df.schema[group], df.schema[ts], *[T.StructField(x, T.LongType() if x == "n" else T.DoubleType()) for x in names]])
    return dealt.groupBy(group, "__at").applyInArrow(stats, shape)


def first_differences(df: DataFrame, cols: Sequence[str], part: Sequence[str], order: Sequence[str], blocks: int | None = None) -> DataFrame:
    got = bounded_frames(df, part, order, 1, 0, lambda w: {f"__d_{c}": F.col(c) - F.lag(c).over(w) for c in cols}, blocks)
    return got.select(*[F.col(f"__d_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def scale_to_range(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Min–max value per column (``x_scaled``) and the range itself (``x_range``)."""
    by = list(by)
    ends = df.groupBy(*by).agg(*[e for c in cols for e in (F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}"))])
    got = join_stats(df, ends, by, null_safe=True)
    new = {}
    for c in cols:
        span = F.col(f"__hi_{c}") - F.col(f"__lo_{c}")
        new[f"{c}_scaled"] = F.try_divide(F.col(c) - F.col(f"__lo_{c}"), span)
        new[f"{c}_range"] = span
    return got.select(*df.columns, *[v.alias(k) for k, v in new.items()])


def group_size_and_mean(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Row count and means of the group next to every row."""
    stats = df.groupBy(*by).agg(F.count(F.lit(1)).alias("group_size"), *[F.avg(c).alias(f"{c}_mean") for c in cols])
    return join_stats(df, stats, by, null_safe=True)

