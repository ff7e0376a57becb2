"""Outlier flags and imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.ordered import bounded_frames, neighbours, row_index
from ..core.orderstats import Windows, median_deviations, medians
from ..core.quantiles import group_medians, group_quantiles
from ..core.sizing import join_stats
from ..functions.expr import truthy


def _bad(c: str, low: float, high: float, null_is_bad: bool) -> Column:
    v = F.col(c)
    test = truthy((v < low) | (v > high))
    return test | v.isNull() if null_is_bad else test


def impute_outside_limits(
    df: DataFrame, limits: Mapping[str, tuple[float, float]], group: str = "grade", null_is_bad: bool = True
) -> DataFrame:
    """Replace values outside inclusive limits by the median of all values of the group.

    All columns share one statistics pass and one projection. Rows without a group keep NULL
    where a value was bad.
    """
    for c, (lo, hi) in limits.items():
        if lo > hi:
            raise ValueError(f"{c}: low must not exceed high")
    num = df.withColumns({c: F.col(c).try_cast("double") for c in limits})
    med = group_medians(num.filter(F.col(group).isNotNull()), [group], {f"__m_{c}": F.col(c) for c in limits})
    joined = join_stats(num, med, [group])
    fixed = {c: F.when(_bad(c, *b, null_is_bad), F.col(f"__m_{c}")).otherwise(F.col(c)) for c, b in limits.items()}
    return joined.select(*[fixed[c].alias(c) if c in fixed else F.col(c) for c in df.columns])


def fill_with_group_median(df: DataFrame, cols: Sequence[str], group: str = "grade") -> DataFrame:
    med = group_medians(df.filter(F.col(group).isNotNull()), [group], {f"__m_{c}": F.col(c) for c in cols})
    joined = join_stats(df, med, [group])
    return joined.select(*[F.coalesce(c, f"__m_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def flag_robust_z(df: DataFrame, c: str, threshold: float = 3.5, by: Sequence[str] = (), out: str = "outlier") -> DataFrame:
    """0.6745 · |x − median| / MAD above the threshold; nothing is flagged where MAD is zero."""
    by = list(by)
    med = group_medians(df, by, {"__med": F.col(c)})
    dev = join_stats(df, med, by, null_safe=True).withColumn("__dev", F.abs(F.col(c) - F.col("__med")))
    mad = group_medians(dev, by, {"__mad": F.col("__dev")})
    z = F.try_divide(0.6745 * F.col("__dev"), F.col("__mad"))
    return join_stats(dev, mad, by, null_safe=True).withColumn(out, truthy(z > threshold)).drop("__med", "__dev", "__mad")


def flag_outside_quantiles(
    df: DataFrame, c: str, low: float, high: float, spread: float = 0.0, by: Sequence[str] = (), out: str = "outlier"
) -> DataFrame:
    """Outside the two quantiles, widened by ``spread`` times their distance."""
    by = list(by)
    q = group_quantiles(df, by, {"__lo": (F.col(c), low), "__hi": (F.col(c), high)})
    pad = (F.col("__hi") - F.col("__lo")) * spread
    test = (F.col(c) < F.col("__lo") - pad) | (F.col(c) > F.col("__hi") + pad)
    return join_stats(df, q, by, null_safe=True).withColumn(out, truthy(test)).drop("__lo", "__hi")


def flag_iqr(df: DataFrame, c: str, by: Sequence[str] = (), out: str = "outlier") -> DataFrame:
    return flag_outside_quantiles(df, c, 0.25, 0.75, 1.5, by, out)


def flag_percentile_clip(df: DataFrame, c: str, share: float = 0.01, by: Sequence[str] = (), out: str = "outlier") -> DataFrame:
    return flag_outside_quantiles(df, c, share, 1 - share, 0.0, by, out)


def flag_rolling_robust_z(
    df: DataFrame, c: str, window: int, part: Sequence[str], order: Sequence[str], threshold: float = 3.5,
    out: str = "outlier", blocks: int | None = None, block_rows: int = 100_000,
) -> DataFrame:
    """Robust z against the median and MAD of the trailing ``window`` rows; unset until the window is full of values.

    Rows are cut into blocks along ``order``, each with the ``window`` - 1 rows before it, and one order-statistic
    structure per block answers all windows. A MAD of zero under a non-zero deviation is an infinite score.
    """

    columns = df.columns

    def flags(values: np.ndarray) -> np.ndarray:
        n = len(values)
        found = np.zeros(n, dtype=bool)
        gaps = np.concatenate([[0], np.cumsum(np.isnan(values))])
        high = np.arange(window, n + 1)
        high = high[gaps[high] == gaps[high - window]]
        if len(high):
            stats, low = Windows(values), high - window
            med = medians(stats, low, high)
            dev, mad = np.abs(values[high - 1] - med), median_deviations(stats, low, high, med)
            with np.errstate(divide="ignore", invalid="ignore"):
                found[high - 1] = np.where(mad > 0, 0.6745 * dev / mad > threshold, dev > 0)
        return found

    def judge(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("__rn")
        # Missing values are NULL here; a NaN counts as missing too.
        values = np.asarray(rows.column("__v").to_numpy(zero_copy_only=False), dtype=float)
        own = pc.equal(rows.column("__at"), rows.column("__own"))
        return rows.append_column(out, pa.array(flags(values))).filter(own).select([*columns, out])

    numbered = row_index(df, part, order, "__rn", blocks)
    own = F.floor((F.col("__rn") - 1) / max(block_rows, window))
    ahead = F.floor((F.col("__rn") - 1 + window - 1) / max(block_rows, window))
    dealt = numbered.withColumns({"__v": F.col(c).cast("double"), "__own": own, "__to": ahead}).withColumn("__at", F.explode(F.sequence("__own", "__to"))).drop("__to")
    return dealt.groupBy(*part, "__at").applyInArrow(judge, T.StructType([*df.schema.fields, T.StructField(out, T.BooleanType())]))


def flag_hampel(
    df: DataFrame, c: str, part: Sequence[str], order: Sequence[str], window: int = 24, n_sigma: float = 3.0,
    out: str = "outlier", blocks: int | None = None,
) -> DataFrame:
    """Deviation from a centred rolling median against the rolling median of those deviations."""
    back, ahead = window // 2, (window - 1) // 2 if window % 2 else window // 2 - 1

    def rolling(col, name):
        def exprs(w):
            frame = w.rowsBetween(-back, ahead)
            return {name: F.when(F.count(col).over(frame) == window, F.percentile(col, F.lit(0.5)).over(frame))}

        return exprs

    med = bounded_frames(df, part, order, back, ahead, rolling(F.col(c), "__med"), blocks)
    dev = med.withColumn("__dev", F.abs(F.col(c) - F.col("__med")))
    mad = bounded_frames(dev, part, order, back, ahead, rolling(F.col("__dev"), "__mad"), blocks)
    test = F.when(F.col("__mad") > 0, F.col("__dev") / (1.4826 * F.col("__mad")) > n_sigma).otherwise(
        F.when(F.col("__mad") == 0, F.col("__dev") > 0)
    )
    return mad.withColumn(out, truthy(test)).drop("__med", "__dev", "__mad")


def impute_flagged(
    df: DataFrame, c: str, flag: str, method: str = "median", group: str | None = None, value: float | None = None,
    order: Sequence[str] = (), part: Sequence[str] = (), blocks: int | None = None,
) -> DataFrame:
    """Null flagged values, then fill nulls.

    ``median`` uses the unflagged values, ``median_by_group`` the group's original values,
    ``ffill`` the last unflagged value in time order, ``constant`` a fixed value.
    """
    kept = F.when(~truthy(F.col(flag)), F.col(c))
    if method == "median":
        med = group_medians(df, [], {"__m": kept})
        return join_stats(df, med, []).withColumn(c, F.coalesce(kept, "__m")).drop("__m")
    if method == "median_by_group":
        if group is None:
            raise ValueError("median_by_group needs a group")
        med = group_medians(df, [group], {"__m": F.col(c)})
        return join_stats(df, med, [group]).withColumn(c, F.coalesce(kept, "__m")).drop("__m")
    if method == "ffill":
        return neighbours(df, part, order, {"__f": kept}, blocks=blocks).withColumn(c, F.col("__f")).drop("__f")
    if method == "constant":
        if value is None:
            raise ValueError("constant needs a value")
        return df.withColumn(c, F.coalesce(kept, F.lit(value)))
    raise ValueError(f"unknown method: {method}")


def fill_in_order(
    df: DataFrame, cols: Sequence[str], part: Sequence[str], order: Sequence[str], how: str = "ffill", blocks: int | None = None
) -> DataFrame:
    """``ffill``, ``bfill`` or both in turn (forward first)."""
    if how not in ("ffill", "bfill", "both"):
        raise ValueError(f"unknown fill: {how}")
    last = {f"__l_{c}": F.col(c) for c in cols} if how != "bfill" else {}
    nxt = {f"__f_{c}": F.col(c) for c in cols} if how != "ffill" else {}
    got = neighbours(df, part, order, last, nxt, blocks)
    pick = {c: F.coalesce(*[F.col(n) for n in (f"__l_{c}", f"__f_{c}") if n in (*last, *nxt)]) for c in cols}
    return got.select(*[pick[c].alias(c) if c in pick else F.col(c) for c in df.columns])


def replace_by_grade_rules(
    df: DataFrame, c: str, rules: Mapping[str, Column], group: str = "grade", other: float = 0.0
) -> DataFrame:
    """Per listed grade: bad values become the grade mean, then missing ones the mean of the result.

    Values of grades without a rule become ``other``.
    """
    bad = F.lit(False)
    for g, test in rules.items():
        bad = bad | (truthy(F.col(group) == g) & truthy(test))
    known = df.filter(F.col(group).isin(list(rules)))
    # The second mean follows from the counts: replaced values sit exactly at the first mean.
    stats = known.groupBy(group).agg(F.avg(c).alias("__mean"), F.sum(F.when(~bad, F.col(c))).alias("__s"), F.count(c).alias("__n"), F.count(F.when(bad, F.col(c))).alias("__b"))
    second = F.try_divide(F.coalesce("__s", F.lit(0.0)) + F.col("__b") * F.col("__mean"), F.col("__n"))
    stats = stats.select(group, "__mean", second.alias("__mean2"))
    listed = truthy(F.col(group).isin(list(rules)))
    value = F.when(~listed, F.lit(other)).when(bad & F.col(c).isNotNull(), F.col("__mean")).when(F.col(c).isNull(), F.col("__mean2")).otherwise(F.col(c))
    return join_stats(df, stats, [group]).withColumn(c, value).drop("__mean", "__mean2")


def keep_range_else_group_mean(df: DataFrame, c: str, low: float, high: float, group: str = "grade") -> DataFrame:
    means = df.groupBy(group).agg(F.avg(c).alias("__mean"))
    fixed = F.when(F.col(c).between(low, high), F.col(c)).otherwise(F.col("__mean"))
    return join_stats(df, means, [group]).withColumn(c, fixed).drop("__mean")


def template_row(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row of column medians; columns the table lacks are zero."""
    have = [c for c in cols if c in df.columns]
    med = group_medians(df, [], {c: F.col(c).try_cast("double") for c in have})
    return med.select(*[F.col(c) if c in have else F.lit(0.0).alias(c) for c in cols])
