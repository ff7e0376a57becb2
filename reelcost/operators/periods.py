"""Date ranges, period labels and calendar helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.sizing import join_stats

BASELINE, TARGET = "historic", "current"


def in_range(ts: str, start: str, end: str, closed: str = "both") -> Column:
    """Range test on the raw time column, so that it reaches the file scan.

    ``closed="both"`` takes whole dates up to and including ``end``; ``"left"`` is half-open.
    """
    lo = F.lit(start).cast("timestamp")
    hi = F.lit(end).cast("timestamp")
    if closed == "both":
        hi = (F.to_date(F.lit(end)) + F.expr("INTERVAL 1 DAY")).cast("timestamp")
    elif closed != "left":
        raise ValueError("closed must be 'both' or 'left'")
    return (F.col(ts) >= lo) & (F.col(ts) < hi)


def label_periods(
    df: DataFrame, ts: str, target: tuple[str, str], baseline: tuple[str, str], out: str = "period"
) -> DataFrame:
    """Keep rows of the two inclusive ranges; the baseline label wins where they overlap."""
    is_base, is_target = in_range(ts, *baseline), in_range(ts, *target)
    return df.filter(is_base | is_target).withColumn(
        out, F.when(is_base, F.lit(BASELINE)).otherwise(F.lit(TARGET))
    )


def label_last_weeks(df: DataFrame, ts: str, out: str = "period") -> DataFrame:
    """Label the latest calendar week and the week before it; correct across a year end."""
    week = F.date_trunc("week", F.col(ts))
    newest = df.agg(F.max(week).alias("__wk"))
    both = join_stats(df.withColumn("__w", week), newest, [])
    label = F.when(F.col("__w") == F.col("__wk"), F.lit(TARGET)).when(
        F.col("__w") == F.col("__wk") - F.expr("INTERVAL 7 DAYS"), F.lit(BASELINE)
    )
    return both.withColumn(out, label).filter(F.col(out).isNotNull()).drop("__w", "__wk")


def calendar_parts(df: DataFrame, ts: str) -> DataFrame:
    """Date, ISO week, month and year; ``iso_year`` is the year that belongs to the week."""
    t = F.col(ts)
    return df.select(
        "*",
        F.to_date(t).alias("date"),
        F.weekofyear(t).alias("week"),
        F.month(t).alias("month"),
        F.year(t).alias("year"),
        F.extract(F.lit("YEAROFWEEK"), t).alias("iso_year"),
    )


def default_ranges(df: DataFrame, ts: str) -> DataFrame:
    """One row of default comparison ranges, derived from the latest time.

    The target is the last Monday to Friday, the baseline the four weeks before it, the
    prediction range the next Monday to Friday. All ranges are inclusive.
    """
    top = df.agg(F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))
    day = F.to_date("max_ts")
    friday = F.date_sub(day, F.pmod(F.weekday(day) - 4, F.lit(7)))
    monday = F.next_day(day, "MON")
    return top.select(
        "min_ts",
        "max_ts",
        F.date_sub(friday, 4).alias("target_start"),
        friday.alias("target_end"),
        F.date_sub(friday, 33).alias("baseline_start"),
        F.date_sub(friday, 5).alias("baseline_end"),
        monday.alias("next_start"),
        F.date_add(monday, 4).alias("next_end"),
    )


def combined_range(ranges: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Smallest range that covers several ``(start, end)`` column pairs."""
    starts, ends = zip(*pairs)
    if len(pairs) == 1:
        return ranges.select(F.col(starts[0]).alias("start"), F.col(ends[0]).alias("end"))
    return ranges.select(F.least(*starts).alias("start"), F.greatest(*ends).alias("end"))


def date_calendar(ranges: DataFrame, start: str, end: str, step: str = "day", out: str = "at") -> DataFrame:
    """All points from ``start`` to ``end`` (inclusive) in steps of day, week, month or hour."""
    if step not in ("day", "week", "month", "hour"):
        raise ValueError(f"unknown step: {step}")
    jump = "INTERVAL 7 DAY" if step == "week" else f"INTERVAL 1 {step.upper()}"
    lo, hi = F.col(start).cast("timestamp"), F.col(end).cast("timestamp")
    return ranges.select(F.explode(F.sequence(lo, hi, F.expr(jump))).alias(out))


def replace_component_by_group_mean(
    df: DataFrame,
    group: str,
    component: str,
    totals: Sequence[str],
    mean_over: Column | None = None,
) -> DataFrame:
    """Swap one cost component for its group mean and carry the change into the totals.

    ``mean_over`` limits the rows that form the mean, for example to the baseline period.
    """
    value = F.col(component) if mean_over is None else F.when(mean_over, F.col(component))
    means = df.groupBy(group).agg(F.avg(value).alias("__mean"))
    joined = join_stats(df, means, [group])
    shift = F.col("__mean") - F.col(component)
    return joined.select(
        *[
            (F.col(c) + shift).alias(c) if c in totals else F.col("__mean").alias(c) if c == component else F.col(c)
            for c in df.columns
        ]
    )
