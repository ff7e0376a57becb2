"""Grouped means, period comparisons and mix/price decomposition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.quantiles import group_quantiles
from ..core.sizing import join_stats
from .periods import BASELINE, TARGET, calendar_parts

AXES = {
    "grade": ["grade"],
    "day": ["date"],
    "week": ["year", "week"],
    "month": ["year", "month"],
    "year": ["year"],
    "period": ["period"],
}


def unpivot_measures(df: DataFrame, keys: Sequence[str], measures: Sequence[str], name="cost", value="value") -> DataFrame:
    return df.unpivot(list(keys), list(measures), name, value)


def clean_label(col: str | Column, *suffixes: str) -> Column:
    """Drop the given literal pieces from a measure label."""
    c = F.col(col) if isinstance(col, str) else col
    for s in suffixes:
        c = F.replace(c, F.lit(s), F.lit(""))
    return c


def grouped_means(
    df: DataFrame,
    axis: str,
    measures: Sequence[str],
    split_by: Sequence[str] = (),
    ts: str = "ts",
    reel: str = "reel_id",
    by_measure: bool = False,
    percent: bool = False,
) -> DataFrame:
    """Mean of one or more measures and row count along a time, grade or period axis.

    With ``by_measure`` the result has one row per measure. The wide means are formed first
    and only that small table is unpivoted, so rows are never multiplied before the shuffle.
    """
    if axis not in AXES:
        raise ValueError(f"unknown axis: {axis}")
    keys = [*AXES[axis], *split_by]
    src = calendar_parts(df, ts) if axis in ("day", "week", "month", "year") else df
    scale = 100.0 if percent else 1.0
    out = src.groupBy(*keys).agg(
        *[(F.avg(m) * scale).alias(m) for m in measures], F.count(reel).alias("n")
    )
    return unpivot_measures(out, [*keys, "n"], measures) if by_measure else out


def period_comparison(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    reel: str = "reel_id",
    period: str = "period",
) -> DataFrame:
    """Current and previous mean per key and measure with their difference, in one shuffle."""
    now, before = F.col(period) == TARGET, F.col(period) == BASELINE
    wide = df.groupBy(*keys).agg(
        F.count(F.when(now, F.col(reel))).alias("n"),
        *[F.avg(F.when(now, F.col(m))).alias(f"__c_{m}") for m in measures],
        *[F.avg(F.when(before, F.col(m))).alias(f"__p_{m}") for m in measures],
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit(m).alias("cost"),
                F.col(f"__c_{m}").alias("current_cost"),
                F.col(f"__p_{m}").alias("previous_cost"),
            )
            for m in measures
        ]
    )
    return (
        wide.filter(F.col("n") > 0)
        .select(*keys, "n", F.inline(pairs))
        .withColumn("delta_cost", F.col("current_cost") - F.col("previous_cost"))
    )


def drilldown(
    df: DataFrame,
    level: int,
    components: Sequence[str],
    total: str,
    grade: str = "grade",
    total_label: str = "TOTAL",
    **kw,
) -> DataFrame:
    """Cost comparison at one level of detail.

    0 by component, 1 the total, 2 the total by grade, 3 components and total by grade,
    4 sub-components of one component and its own sum by grade (pass that sum as ``total``).
    """
    relabel = F.when(F.col("cost") == total, F.lit(total_label)).otherwise(F.col("cost"))
    if level in (0, 1):
        out = period_comparison(df, [], components if level == 0 else [total], **kw).withColumn(grade, F.lit("ALL"))
    elif level == 2:
        out = period_comparison(df, [grade], [total], **kw)
    elif level in (3, 4):
        out = period_comparison(df, [grade], [total, *components], **kw).filter(F.col("current_cost").isNotNull())
    else:
        raise ValueError("level must be 0 to 4")
    return out.withColumn("cost", relabel).select(grade, "cost", "n", "current_cost", "previous_cost", "delta_cost")


def drilldown_levels(
    df: DataFrame,
    components: Sequence[str],
    total: str,
    grade: str = "grade",
    reel: str = "reel_id",
    period: str = "period",
) -> DataFrame:
    """Levels 0 to 3 together from a single pass with a rollup over the grade."""
    now, before = F.col(period) == TARGET, F.col(period) == BASELINE
    measures = [total, *components]
    wide = df.rollup(grade).agg(
        F.grouping(grade).alias("__all"),
        F.count(F.when(now, F.col(reel))).alias("n"),
        *[F.avg(F.when(now, F.col(m))).alias(f"__c_{m}") for m in measures],
        *[F.avg(F.when(before, F.col(m))).alias(f"__p_{m}") for m in measures],
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit("TOTAL" if m == total else m).alias("cost"),
                F.col(f"__c_{m}").alias("current_cost"),
                F.col(f"__p_{m}").alias("previous_cost"),
            )
            for m in measures
        ]
    )
    is_total = F.col("cost") == "TOTAL"
    level = (
        F.when((F.col("__all") == 1) & ~is_total, 0)
        .when((F.col("__all") == 1) & is_total, 1)
        .when(is_total, 2)
        .otherwise(3)
    )
    return (
        wide.filter(F.col("n") > 0)
        .select(F.when(F.col("__all") == 1, F.lit("ALL")).otherwise(F.col(grade)).alias(grade), "__all", "n", F.inline(pairs))
        .select(
            level.alias("level"), grade, "cost", "n", "current_cost", "previous_cost",
            (F.col("current_cost") - F.col("previous_cost")).alias("delta_cost"),
        )
    )


def weighted_average(df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str = "weighted") -> DataFrame:
    both = F.when(F.col(value).isNotNull() & F.col(weight).isNotNull(), F.col(weight))
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * both), F.sum(F.col(weight))).alias(out))


def match_period_grades(df: DataFrame, value: str, grade: str = "grade", reel: str = "reel_id", period: str = "period") -> DataFrame:
    """Previous and current count and mean per grade, as a full outer comparison.

    A grade made in one period only counts as zero in the other and keeps its own cost.
    """
    now, before = F.col(period) == TARGET, F.col(period) == BASELINE
    c0, c1 = F.avg(F.when(before, F.col(value))), F.avg(F.when(now, F.col(value)))
    return df.groupBy(grade).agg(
        F.count(F.when(before, F.col(reel))).alias("n_0"),
        F.count(F.when(now, F.col(reel))).alias("n_1"),
        F.coalesce(c0, c1).alias("cost_0"),
        F.coalesce(c1, c0).alias("cost_1"),
    )


def decompose_cost_change(per_grade: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Split the change of the average cost into a mix and a price part that add up to it."""
    q0, q1 = F.sum("n_0"), F.sum("n_1")
    sums = per_grade.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("cost_0") * F.col("n_0")), q0).alias("avg_cost_0"),
        F.try_divide(F.sum(F.col("cost_1") * F.col("n_1")), q1).alias("avg_cost_1"),
        F.try_divide(F.sum(F.col("cost_0") * F.col("n_1")), q1).alias("__mix"),
    )
    mix = F.col("__mix") - F.col("avg_cost_0")
    price = F.col("avg_cost_1") - F.col("__mix")
    return sums.select(
        *by,
        "avg_cost_0",
        "avg_cost_1",
        (F.col("avg_cost_1") - F.col("avg_cost_0")).alias("total_change"),
        mix.alias("mix_effect"),
        price.alias("cost_effect"),
        (mix + price).alias("reconciliation_sum"),
    )


def mix_effect(df: DataFrame, value: str, grades: Sequence[str] | None = None, grade: str = "grade", **kw) -> DataFrame:
    src = df if grades is None else df.filter(F.col(grade).isin(list(grades)))
    return decompose_cost_change(match_period_grades(src, value, grade, **kw))


def overall_table(df: DataFrame, total: str, overprocessing: str, grade: str = "grade", **kw) -> DataFrame:
    """One-row summary: total cost, its change, both effects and the overprocessing mean."""
    base = drilldown(df, 1, [], total, grade, **kw)
    over = drilldown(df, 1, [], overprocessing, grade, total_label="AVERAGE", **kw)
    eff = mix_effect(df, total, grade=grade)
    return (
        base.crossJoin(eff.select("mix_effect", "cost_effect"))
        .crossJoin(over.select(F.col("current_cost").alias("over")))
        .select(
            grade,
            F.col("cost").alias("component"),
            F.round("current_cost", 1).alias("cost"),
            "n",
            F.round("delta_cost", 1).alias("delta"),
            F.round("mix_effect", 1).alias("delta_mix_effect"),
            F.round("cost_effect", 1).alias("delta_cost_effect"),
            F.round("over", 1).alias("overprocessing"),
        )
    )


def grade_table(df: DataFrame, total: str, overprocessing: str, grade: str = "grade", **kw) -> DataFrame:
    """Rounded comparison by grade; both measures come from the same pass."""
    both = period_comparison(df, [grade], [total, overprocessing], **kw)
    pick = lambda c, m: F.max(F.when(F.col("cost") == m, F.col(c)))
    return both.groupBy(grade, "n").agg(
        F.round(pick("current_cost", total), 1).alias("cost"),
        F.round(pick("delta_cost", total), 1).alias("delta"),
        F.round(pick("current_cost", overprocessing), 1).alias("overprocessing"),
    )


def component_table(df: DataFrame, components: Sequence[str], total: str, grade: str = "grade", **kw) -> DataFrame:
    """Rounded level-3 comparison with one ``cost__x`` and ``delta__x`` column per component."""
    labels = [*components, "TOTAL"]
    long = drilldown(df, 3, components, total, grade, **kw)
    return long.groupBy(grade, "n").agg(
        *[F.round(F.max(F.when(F.col("cost") == c, F.col("current_cost"))), 1).alias(f"cost__{c}") for c in labels],
        *[F.round(F.max(F.when(F.col("cost") == c, F.col("delta_cost"))), 1).alias(f"delta__{c}") for c in labels],
    )


def limits_to_long(limits: DataFrame, grade: str = "grade", limits_col: str = "limits") -> DataFrame:
    """``map<property, struct<target, min>>`` per grade to (grade, property, variable, value)."""
    by_prop = limits.select(grade, F.explode(limits_col).alias("property", "__l"))
    return by_prop.select(
        grade,
        "property",
        F.inline(
            F.array(
                F.struct(F.lit("target").alias("variable"), F.col("__l.target").alias("value")),
                F.struct(F.lit("min").alias("variable"), F.col("__l.min").alias("value")),
            )
        ),
    )


def limits_wide(long_limits: DataFrame, grade: str = "grade") -> DataFrame:
    return long_limits.groupBy(grade, "property").pivot("variable", ["target", "min"]).agg(F.first("value", True))


def strength_rows(
    df: DataFrame, limits: DataFrame, properties: Sequence[str], grade: str = "grade", reel: str = "reel_id", period: str = "period"
) -> DataFrame:
    """Quality values per reel in long form next to the limits of their grade; complete rows only."""
    long = unpivot_measures(df.select(reel, grade, period, *properties), [reel, grade, period], properties, "property")
    return join_stats(long, limits, [grade, "property"]).dropna()


def overprocessing(
    df: DataFrame,
    limits: DataFrame,
    properties: Sequence[str],
    coefficients: Mapping[str, float],
    basis_weight: str,
    starch_price: float,
    key: Sequence[str] = ("reel_id",),
    grade: str = "grade",
) -> DataFrame:
    """Excess quality over the limits per reel, one column set per property plus the mean.

    Everything is computed inside the row, so no shuffle follows the limits lookup.
    """
    flat = limits.groupBy(grade).agg(
        *[
            F.first(F.when(F.col("property") == p, F.col(v)), True).alias(f"__{v}_{p}")
            for p in properties
            for v in ("min", "target")
        ]
    )
    rows = join_stats(df, flat, [grade])
    pct, std, cost = {}, {}, {}
    for p in properties:
        lo, hi = F.col(f"__min_{p}"), F.col(f"__target_{p}")
        whole = F.col(p).isNotNull() & lo.isNotNull() & hi.isNotNull() & F.col(basis_weight).isNotNull()
        pct[p] = F.when(whole, F.try_divide(F.col(p) - lo, lo))
        std[p] = F.when(whole, F.try_divide(F.col(p) - (lo + hi) / 2, (hi - lo) / 2))
        starch = (F.col(p) - lo) * F.lit(coefficients[p]) * 1000
        cost[p] = F.when(whole, F.try_divide(starch, F.col(basis_weight)) * starch_price / 1000)

    def mean(parts):
        vals = [F.coalesce(c, F.lit(0.0)) for c in parts]
        cnt = [c.isNotNull().cast("int") for c in parts]
        return F.try_divide(reduce(lambda a, b: a + b, vals), reduce(lambda a, b: a + b, cnt))

    def total(parts):
        any_set = reduce(lambda a, b: a | b, [c.isNotNull() for c in parts])
        return F.when(any_set, reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in parts]))

    over = [F.when(s.isNotNull(), F.greatest(s - 1, F.lit(0.0))) for s in std.values()]
    under = [F.when(s.isNotNull(), F.greatest(-s - 1, F.lit(0.0))) for s in std.values()]
    return rows.select(
        *key,
        *[pct[p].alias(f"over_pct_{p}") for p in properties],
        *[std[p].alias(f"over_std_{p}") for p in properties],
        mean(list(pct.values())).alias("over_pct"),
        mean(list(std.values())).alias("over_std"),
        mean(list(cost.values())).alias("over_cost"),
        total(over).alias("over_score"),
        total(under).alias("under_score"),
    )


def lab_performance(df: DataFrame, properties: Sequence[str], periods: Column, grade: str = "grade") -> DataFrame:
    """Mean and sample deviation per property, grade and period; ``periods`` is an array of labels,
    since a row may belong to the baseline and to a month."""
    tagged = df.select(grade, *properties, F.explode(periods).alias("period"))
    wide = tagged.groupBy(grade, "period").agg(
        *[F.struct(F.avg(p).alias("mean"), F.stddev_samp(p).alias("sd")).alias(p) for p in properties]
    )
    long = wide.unpivot([grade, "period"], list(properties), "property", "__s")
    return long.select(grade, "period", "property", F.col("__s.mean").alias("mean"), F.col("__s.sd").alias("sd"))


def error_metrics(
    df: DataFrame, pairs: Mapping[str, tuple[str, str]], by: Sequence[str] = ()
) -> DataFrame:
    """MAE, RMSE, R² and MAPE per target; ``pairs`` maps a name to (actual, predicted).

    Pairs with a null are ignored. R² needs two rows and a spread in the actual values.
    """
    aggs = []
    for name, (actual, pred) in pairs.items():
        ok = F.col(actual).isNotNull() & F.col(pred).isNotNull()
        a = F.when(ok, F.col(actual))
        e = F.when(ok, F.col(actual) - F.col(pred))
        n = F.count(e)
        spread = F.var_pop(a) * n
        r2 = F.when((n >= 2) & (spread > 0), 1 - F.sum(e * e) / spread)
        aggs.append(
            F.struct(
                n.alias("n"),
                F.avg(F.abs(e)).alias("mae"),
                F.sqrt(F.avg(e * e)).alias("rmse"),
                r2.alias("r2"),
                (F.avg(F.abs(F.try_divide(e, F.col(actual)))) * 100).alias("mape"),
            ).alias(name)
        )
    wide = df.groupBy(*by).agg(*aggs)
    long = wide.unpivot(list(by), list(pairs), "target", "__m")
    return long.select(*by, "target", "__m.*")


def pivot_metric(long: DataFrame, keys: Sequence[str], label: str, value: str, labels: Sequence[str], digits: int = 1) -> DataFrame:
    return long.groupBy(*keys).agg(
        *[F.round(F.max(F.when(F.col(label) == x, F.col(value))), digits).alias(x) for x in labels]
    )


def condition_stats(df: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Mean, deviation, count, median and standard error per key and variable."""
    wide = df.groupBy(*keys).agg(
        *[
            F.struct(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("count")).alias(v)
            for v in variables
        ]
    )
    med = group_quantiles(df, keys, {f"__m_{v}": (F.col(v), 0.5) for v in variables})
    both = join_stats(wide, med, keys, null_safe=True)
    parts = F.array(
        *[
            F.struct(
                F.lit(v).alias("variable"),
                F.col(v)["mean"].alias("mean"),
                F.col(v)["std"].alias("std"),
                F.col(v)["count"].alias("count"),
                F.col(f"__m_{v}").alias("median"),
                F.try_divide(F.col(v)["std"], F.sqrt(F.col(v)["count"])).alias("stderr"),
            )
            for v in variables
        ]
    )
    return both.select(*keys, F.inline(parts))


def operating_ranges(df: DataFrame, features: Sequence[str], best: Column) -> DataFrame:
    """Mean of every feature over the rows of the best cluster."""
    wide = df.filter(best).agg(*[F.avg(f).alias(f) for f in features])
    return wide.unpivot([], list(features), "feature", "value")


def cluster_labels(
    df: DataFrame, cluster: str, cost: str, best: int, acceptable: Sequence[int], period: str = "period", q: float = 0.65
) -> DataFrame:
    """Upper cost quantile and a CURRENT / BEST / OK / BAD label per cluster."""
    stats = df.groupBy(cluster).agg(F.count(F.when(F.col(period) != TARGET, 1)).alias("__old"))
    quant = group_quantiles(df, [cluster], {"cost_quantile": (F.col(cost), q)})
    label = (
        F.when(F.col("__old") == 0, "CURRENT")
        .when(F.col(cluster) == best, "BEST")
        .when(F.col(cluster).isin(list(acceptable)), "OK")
        .otherwise("BAD")
    )
    return join_stats(stats, quant, [cluster]).select(cluster, "cost_quantile", label.alias("label"))


def components_by_total(df: DataFrame, components: Sequence[str]) -> DataFrame:
    wide = df.agg(*[F.sum(c).alias(c) for c in components])
    return wide.unpivot([], list(components), "cost", "total").orderBy(F.desc("total"))


def top_by_peak(long: DataFrame, label: str, value: str, k: int) -> DataFrame:
    """The ``k`` labels whose value reaches the largest magnitude."""
    return long.groupBy(label).agg(F.max(F.abs(value)).alias("peak")).orderBy(F.desc("peak"), label).limit(k)


def top_fraction(
    long: DataFrame, keys: Sequence[str], label: str, value: str, fraction: float
) -> DataFrame:
    """The largest ``ceil(n * fraction)`` entries per key by magnitude (at least one) with a direction.

    ``long`` is an attribution table: one row per key and variable.
    """
    w = Window.partitionBy(*keys)
    ranked = long.select(
        "*",
        F.row_number().over(w.orderBy(F.desc(F.abs(value)), F.col(label))).alias("rank"),
        F.count(F.lit(1)).over(w).alias("__n"),
    )
    keep = F.greatest(F.lit(1), F.ceil(F.col("__n") * fraction))
    way = F.when(F.col(value) > 0, "up").when(F.col(value) < 0, "down").otherwise("flat")
    return ranked.filter(F.col("rank") <= keep).withColumn("direction", way).drop("__n")


def extreme_contributions(long: DataFrame, value: str, n: int, label: str) -> DataFrame:
    """The ``n`` largest and the ``n`` smallest contributions."""
    up = long.orderBy(F.desc(value), label).limit(n).withColumn("side", F.lit("top_increase"))
    down = long.orderBy(F.asc(value), label).limit(n).withColumn("side", F.lit("top_decrease"))
    return up.unionByName(down)


def component_narrative(drill: DataFrame, grade: str = "grade", total_label: str = "TOTAL") -> DataFrame:
    """Average change per component and the grade where the change peaks each way."""
    rows = drill.filter((F.col("cost") != total_label) & F.col("delta_cost").isNotNull())
    priced = F.when(F.col("current_cost") > 0, F.col("delta_cost"))
    tie = F.struct(F.col("delta_cost"), F.col(grade))
    low = F.struct(F.col("delta_cost"), F.col(grade))
    out = rows.groupBy("cost").agg(F.avg(priced).alias("avg_change"), F.max(tie).alias("__u"), F.min(low).alias("__d"))
    return out.filter(F.col("avg_change").isNotNull()).select(
        "cost",
        "avg_change",
        F.abs("avg_change").alias("abs_change"),
        F.col(f"__u.{grade}").alias("grade_of_largest_rise"),
        F.col("__u.delta_cost").alias("largest_rise"),
        F.col(f"__d.{grade}").alias("grade_of_largest_fall"),
        F.col("__d.delta_cost").alias("largest_fall"),
    )


def drilldown_sentence(grade: str = "grade") -> Column:
    """A comparison row in words: component, grade, new cost, and how it compares with the earlier one."""
    money = lambda c: F.concat(F.format_string("%.2f", c), F.lit(" €/t"))
    scope = F.when(F.upper(grade) == "ALL", F.lit("overall")).otherwise(F.concat(F.lit("on "), F.coalesce(grade, F.lit("no grade"))))
    level = F.when(F.col("current_cost").isNull(), F.lit("not known")).otherwise(money("current_cost"))
    move = F.when(F.col("delta_cost") > 0, F.lit("up by ")).otherwise(F.lit("down by "))
    moved = F.when(F.col("delta_cost") == 0, F.lit(", as before")).otherwise(F.concat(F.lit(", "), move, money(F.abs("delta_cost"))))
    return F.concat(F.initcap("cost"), F.lit(" "), scope, F.lit(": "), level, F.when(F.col("delta_cost").isNull(), F.lit("")).otherwise(moved))


def density_histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram normalised to a probability density."""
    ends = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(col).alias("total"))
    rows = join_stats(df.select(col).filter(F.col(col).isNotNull()), ends, [])
    width = (F.col("hi") - F.col("lo")) / bins
    slot = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(col) - F.col("lo"), width))).cast("int")
    counted = rows.groupBy(F.coalesce(slot, F.lit(0)).alias("bin"), "lo", "hi", "total").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("left"),
        "n",
        F.try_divide(F.col("n"), F.col("total") * width).alias("density"),
    )


def density_grid(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Two-dimensional equal-width density."""
    src = df.select(x, y).dropna()
    ends = src.agg(
        F.min(x).alias("xl"), F.max(x).alias("xh"), F.min(y).alias("yl"), F.max(y).alias("yh"), F.count(F.lit(1)).alias("total")
    )
    rows = join_stats(src, ends, [])
    wx, wy = (F.col("xh") - F.col("xl")) / bins, (F.col("yh") - F.col("yl")) / bins
    bx = F.coalesce(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(x) - F.col("xl"), wx))), F.lit(0)).cast("int")
    by = F.coalesce(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(y) - F.col("yl"), wy))), F.lit(0)).cast("int")
    counted = rows.groupBy(bx.alias("x_bin"), by.alias("y_bin"), "xl", "xh", "yl", "yh", "total").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("x_bin", "y_bin", "n", F.try_divide(F.col("n"), F.col("total") * wx * wy).alias("density"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().filter(F.col(col).isNotNull())


def distinct_counts(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Distinct counts per key, each through a (key, value) pre-aggregation so a hot key spreads out."""
    out = None
    for c in cols:
        part = df.select(*keys, c).distinct().groupBy(*keys).agg(F.count(c).alias(f"n_{c}"))
        out = part if out is None else (join_stats(out, part, keys, null_safe=True) if keys else out.crossJoin(part))
    return out


def representative_row(
    df: DataFrame, measures: Sequence[str], in_period: Column, grade: str = "grade", ts: str = "ts", ties: Sequence[str] = ()
) -> DataFrame:
    """Mean of the measures in the period per grade, else the latest row of that grade (flagged)."""
    key = F.struct(F.col(ts), *[F.col(t) for t in ties])
    out = df.groupBy(grade).agg(
        F.count(F.when(in_period, 1)).alias("__n"),
        *[F.avg(F.when(in_period, F.col(m))).alias(f"__a_{m}") for m in measures],
        F.max_by(F.struct(*measures), key).alias("__last"),
    )
    return out.select(
        grade,
        (F.col("__n") == 0).alias("used_latest"),
        *[F.when(F.col("__n") > 0, F.col(f"__a_{m}")).otherwise(F.col(f"__last.{m}").cast("double")).alias(m) for m in measures],
    )


def mean_differences(df: DataFrame, variables: Sequence[str], baseline: Column, target: Column) -> DataFrame:
    """Baseline mean, target mean and their difference per variable; variables empty on a side are skipped."""
    wide = df.agg(
        *[
            F.struct(F.avg(F.when(baseline, F.col(v))).alias("baseline_mean"), F.avg(F.when(target, F.col(v))).alias("target_mean")).alias(v)
            for v in variables
        ]
    )
    long = wide.unpivot([], list(variables), "variable", "__s").select("variable", "__s.*")
    return long.dropna().withColumn("delta", F.col("target_mean") - F.col("baseline_mean"))
