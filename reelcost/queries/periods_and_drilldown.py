"""Period labels, calendars, comparisons and decompositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core.session import load
from ..operators import drilldown as D
from ..operators import periods as P
from .base import BASELINE_RANGE, COMPONENTS, TARGET_RANGE, events, labelled, query, reel_lines, rounded, with_labels, with_reels

UNPIVOT = """long AS (SELECT grade, period, reel_id, 'material_cost' AS cost, material_cost AS value FROM labelled
 UNION ALL SELECT grade, period, reel_id, 'tax_cost', tax_cost FROM labelled
 UNION ALL SELECT grade, period, reel_id, 'rebate_cost', rebate_cost FROM labelled
 UNION ALL SELECT grade, period, reel_id, 'handling_cost', handling_cost FROM labelled)"""
TOTALS = "tot AS (SELECT grade, period, reel_id, 'TOTAL' AS cost, total_cost AS value FROM labelled)"


def compare_sql(source: str, grade: str) -> str:
    """Mean per period, joined from the current side."""
    g = "'ALL'" if grade == "ALL" else grade
    return f"""(SELECT c.grade, c.cost, c.n, round(c.v, 6) AS current_cost, round(p.v, 6) AS previous_cost, round(c.v - p.v, 6) AS delta_cost
 FROM (SELECT {g} AS grade, cost, avg(value) AS v, count(reel_id) AS n FROM {source} WHERE period = 'current' GROUP BY 1, 2) c
 LEFT JOIN (SELECT {g} AS grade, cost, avg(value) AS v FROM {source} WHERE period = 'historic' GROUP BY 1, 2) p
 ON c.grade = p.grade AND c.cost = p.cost)"""


CMP = ("current_cost", "previous_cost", "delta_cost")


@query("period_labels", with_labels("SELECT period, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM labelled GROUP BY period"))
def _(spark, sf):
    return labelled(spark, sf).groupBy("period").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query(
    "period_labels_overlap",
    with_reels("""SELECT CASE WHEN CAST(ts AS DATE) BETWEEN DATE '2000-06-01' AND DATE '2000-12-31' THEN 'historic' ELSE 'current' END AS period,
 count(*) AS n FROM reels WHERE CAST(ts AS DATE) BETWEEN DATE '2000-06-01' AND DATE '2001-06-30' GROUP BY 1"""),
)
def _(spark, sf):
    return (
        P.label_periods(reel_lines(spark, sf), "ts", ("2000-10-01", "2001-06-30"), ("2000-06-01", "2000-12-31"))
        .groupBy("period").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "latest_week_labels",
    """SELECT period, count(*) AS n, round(avg(value), 6) AS mean_value FROM (
 SELECT value, CASE date_diff('day', date_trunc('week', ts), (SELECT date_trunc('week', max(ts)) FROM events))
   WHEN 0 THEN 'current' WHEN 7 THEN 'historic' END AS period FROM events) WHERE period IS NOT NULL GROUP BY period""",
)
def _(spark, sf):
    out = P.label_last_weeks(events(spark, sf), "ts").groupBy("period").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")
    )
    return rounded(out, "mean_value")


@query(
    "calendar_parts",
    """SELECT CAST(o_orderdate AS DATE) AS date, CAST(weekofyear(o_orderdate) AS INT) AS week, CAST(month(o_orderdate) AS INT) AS month,
 CAST(year(o_orderdate) AS INT) AS year, CAST(isoyear(o_orderdate) AS INT) AS iso_year, count(*) AS n FROM orders GROUP BY ALL""",
)
def _(spark, sf):
    parts = P.calendar_parts(load(spark, sf, "orders").select("o_orderdate"), "o_orderdate")
    return parts.groupBy("date", "week", "month", "year", "iso_year").agg(F.count(F.lit(1)).alias("n"))


_RANGES_SQL = """b AS (SELECT min(ts) AS min_ts, max(ts) AS max_ts, CAST(max(ts) AS DATE) AS d FROM events),
 f AS (SELECT *, CAST(d - CAST((isodow(d) + 2) % 7 AS INT) AS DATE) AS fri FROM b)"""


@query(
    "default_comparison_ranges",
    f"""WITH {_RANGES_SQL} SELECT min_ts, max_ts, fri - 4 AS target_start, fri AS target_end, fri - 33 AS baseline_start, fri - 5 AS baseline_end,
 CAST(d + CAST(8 - isodow(d) AS INT) AS DATE) AS next_start, CAST(d + CAST(12 - isodow(d) AS INT) AS DATE) AS next_end FROM f""",
)
def _(spark, sf):
    return P.default_ranges(events(spark, sf), "ts")


@query(
    "combined_comparison_range",
    f'WITH {_RANGES_SQL} SELECT least(fri - 4, fri - 33) AS "start", greatest(fri, fri - 5) AS "end" FROM f',
)
def _(spark, sf):
    ranges = P.default_ranges(events(spark, sf), "ts")
    return P.combined_range(ranges, [("target_start", "target_end"), ("baseline_start", "baseline_end")])


for _step, _iv in (("day", "1 DAY"), ("week", "7 DAY"), ("month", "1 MONTH"), ("hour", "1 HOUR")):

    @query(
        f"date_calendar_by_{_step}",
        f"""SELECT CAST(unnest(generate_series(lo, hi, INTERVAL {_iv})) AS TIMESTAMP) AS at
 FROM (SELECT date_trunc('day', min(ts)) AS lo, date_trunc('day', max(ts)) AS hi FROM events)""",
    )
    def _(spark, sf, step=_step):
        ends = events(spark, sf).agg(F.date_trunc("day", F.min("ts")).alias("lo"), F.date_trunc("day", F.max("ts")).alias("hi"))
        return P.date_calendar(ends, "lo", "hi", step)


@query(
    "component_replaced_by_grade_mean",
    with_labels("""SELECT grade, period, round(avg(total_cost), 6) AS total_cost, round(avg(tax_cost), 6) AS tax_cost FROM (
 SELECT l.grade, period, total_cost - l.tax_cost + m.tax_cost AS total_cost, m.tax_cost FROM labelled l
 JOIN (SELECT grade, avg(tax_cost) AS tax_cost FROM labelled WHERE period = 'historic' GROUP BY grade) m ON l.grade = m.grade) GROUP BY grade, period"""),
)
def _(spark, sf):
    out = P.replace_component_by_group_mean(
        labelled(spark, sf), "grade", "tax_cost", ["total_cost"], F.col("period") == P.BASELINE
    )
    return rounded(
        out.groupBy("grade", "period").agg(F.avg("total_cost").alias("total_cost"), F.avg("tax_cost").alias("tax_cost")),
        "total_cost", "tax_cost",
    )


_AXIS_SQL = {
    "grade": "grade",
    "day": "CAST(ts AS DATE) AS date",
    "week": "CAST(year(ts) AS INT) AS year, CAST(weekofyear(ts) AS INT) AS week",
    "month": "CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month",
    "year": "CAST(year(ts) AS INT) AS year",
    "period": "period",
}
for _axis, _cols in _AXIS_SQL.items():

    @query(
        f"grouped_means_by_{_axis}",
        with_labels(f"SELECT {_cols}, round(avg(total_cost), 6) AS total_cost, count(reel_id) AS n FROM labelled GROUP BY ALL"),
    )
    def _(spark, sf, axis=_axis):
        return rounded(D.grouped_means(labelled(spark, sf), axis, ["total_cost"]), "total_cost")


@query(
    "grouped_means_split_by_period_and_grade",
    with_labels("SELECT CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, period, grade, round(avg(total_cost), 6) AS total_cost, count(reel_id) AS n FROM labelled GROUP BY ALL"),
)
def _(spark, sf):
    return rounded(D.grouped_means(labelled(spark, sf), "month", ["total_cost"], ["period", "grade"]), "total_cost")


@query(
    "grouped_means_by_component_and_grade",
    with_labels(f", {UNPIVOT} SELECT period, grade, cost, round(avg(value), 6) AS value, count(reel_id) AS n FROM long GROUP BY ALL"),
)
def _(spark, sf):
    return rounded(D.grouped_means(labelled(spark, sf), "period", COMPONENTS, ["grade"], by_measure=True), "value")


@query(
    "unpivoted_costs",
    with_labels(f", {UNPIVOT} SELECT grade, period, replace(cost, '_cost', '') AS cost, count(*) AS n, round(sum(value), 4) AS total FROM long GROUP BY ALL"),
)
def _(spark, sf):
    long = D.unpivot_measures(labelled(spark, sf), ["grade", "period"], COMPONENTS)
    out = long.withColumn("cost", D.clean_label("cost", "_cost")).groupBy("grade", "period", "cost")
    return rounded(out.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total", digits=4)


@query("weighted_average_cost", with_labels("SELECT grade, round(sum(total_cost * qty) / sum(qty), 6) AS weighted FROM labelled GROUP BY grade"))
def _(spark, sf):
    return rounded(D.weighted_average(labelled(spark, sf), ["grade"], "total_cost", "qty"), "weighted")


_MATCH = """prev AS (SELECT grade, avg(total_cost) AS c, count(reel_id) AS n FROM labelled WHERE period = 'historic' GROUP BY grade),
 cur AS (SELECT grade, avg(total_cost) AS c, count(reel_id) AS n FROM labelled WHERE period = 'current' GROUP BY grade),
 m AS (SELECT coalesce(p.grade, q.grade) AS grade, coalesce(p.n, 0) AS n_0, coalesce(q.n, 0) AS n_1, coalesce(p.c, q.c) AS cost_0, coalesce(q.c, p.c) AS cost_1
 FROM prev p FULL JOIN cur q ON p.grade = q.grade)"""


@query("matched_period_grades", with_labels(f", {_MATCH} SELECT grade, n_0, n_1, round(cost_0, 6) AS cost_0, round(cost_1, 6) AS cost_1 FROM m"))
def _(spark, sf):
    return rounded(D.match_period_grades(labelled(spark, sf), "total_cost"), "cost_0", "cost_1")


_EFFECT_COLS = ("avg_cost_0", "avg_cost_1", "total_change", "mix_effect", "cost_effect", "reconciliation_sum")
_EFFECT_SQL = """e AS (SELECT sum(cost_0 * n_0) / sum(n_0) AS a0, sum(cost_1 * n_1) / sum(n_1) AS a1, sum(cost_0 * n_1) / sum(n_1) AS am FROM m)
 SELECT round(a0, 6) AS avg_cost_0, round(a1, 6) AS avg_cost_1, round(a1 - a0, 6) AS total_change, round(am - a0, 6) AS mix_effect,
 round(a1 - am, 6) AS cost_effect, round(a1 - a0, 6) AS reconciliation_sum FROM e"""


@query("mix_and_cost_effect", with_labels(f", {_MATCH}, {_EFFECT_SQL}"))
def _(spark, sf):
    return rounded(D.mix_effect(labelled(spark, sf), "total_cost"), *_EFFECT_COLS)


@query(
    "mix_and_cost_effect_of_latest_week",
    """WITH l AS (SELECT user_id AS grade, event_id AS reel_id, value AS total_cost, CASE date_diff('day', date_trunc('week', ts), (SELECT date_trunc('week', max(ts)) FROM events))
   WHEN 0 THEN 'current' WHEN 7 THEN 'historic' END AS period FROM events), labelled AS (SELECT * FROM l WHERE period IS NOT NULL), """
    + _MATCH + ", " + _EFFECT_SQL,
)
def _(spark, sf):
    df = P.label_last_weeks(events(spark, sf), "ts").withColumnsRenamed({"user_id": "grade", "event_id": "reel_id", "value": "total_cost"})
    return rounded(D.mix_effect(df, "total_cost"), *_EFFECT_COLS)


for _level, _name, _src, _grade in (
    (0, "drilldown_by_component", "long", "ALL"),
    (1, "drilldown_total", "tot", "ALL"),
    (2, "drilldown_by_grade", "tot", "grade"),
    (3, "drilldown_by_grade_and_component", "(SELECT * FROM tot UNION ALL SELECT * FROM long)", "grade"),
):

    @query(_name, with_labels(f", {UNPIVOT}, {TOTALS} SELECT * FROM {compare_sql(_src, _grade)}"))
    def _(spark, sf, level=_level):
        return rounded(D.drilldown(labelled(spark, sf), level, COMPONENTS, "total_cost"), *CMP)


@query(
    "drilldown_of_sub_components",
    with_labels(f""", s AS (SELECT grade, period, reel_id, 'charges' AS cost, tax_cost + rebate_cost AS value FROM labelled
 UNION ALL SELECT grade, period, reel_id, 'tax_cost', tax_cost FROM labelled UNION ALL SELECT grade, period, reel_id, 'rebate_cost', rebate_cost FROM labelled)
 SELECT * FROM {compare_sql('s', 'grade')}"""),
)
def _(spark, sf):
    df = labelled(spark, sf).withColumn("charges_cost", F.col("tax_cost") + F.col("rebate_cost"))
    return rounded(D.drilldown(df, 4, ["tax_cost", "rebate_cost"], "charges_cost", total_label="charges"), *CMP)


@query(
    "drilldown_all_levels",
    with_labels(f""", {UNPIVOT}, {TOTALS} SELECT 0 AS level, * FROM {compare_sql('long', 'ALL')} UNION ALL SELECT 1, * FROM {compare_sql('tot', 'ALL')}
 UNION ALL SELECT 2, * FROM {compare_sql('tot', 'grade')} UNION ALL SELECT 3, * FROM {compare_sql('long', 'grade')}"""),
)
def _(spark, sf):
    return rounded(D.drilldown_levels(labelled(spark, sf), COMPONENTS, "total_cost"), *CMP)


_OV = "CASE WHEN period = 'current' THEN {} END"


@query(
    "overall_summary_table",
    with_labels(f""", {_MATCH}, e AS (SELECT sum(cost_0 * n_0) / sum(n_0) AS a0, sum(cost_1 * n_1) / sum(n_1) AS a1, sum(cost_0 * n_1) / sum(n_1) AS am FROM m),
 t AS (SELECT avg({_OV.format('total_cost')}) AS c, avg(CASE WHEN period = 'historic' THEN total_cost END) AS p, avg({_OV.format('qty')}) AS o,
 count({_OV.format('reel_id')}) AS n FROM labelled)
 SELECT 'ALL' AS grade, 'TOTAL' AS component, round(c, 1) AS cost, n, round(c - p, 1) AS delta, round(am - a0, 1) AS delta_mix_effect,
 round(a1 - am, 1) AS delta_cost_effect, round(o, 1) AS overprocessing FROM t, e"""),
)
def _(spark, sf):
    return D.overall_table(labelled(spark, sf), "total_cost", "qty")


@query(
    "grade_summary_table",
    with_labels(f"""SELECT grade, count({_OV.format('reel_id')}) AS n, round(avg({_OV.format('total_cost')}), 1) AS cost,
 round(avg({_OV.format('total_cost')}) - avg(CASE WHEN period = 'historic' THEN total_cost END), 1) AS delta,
 round(avg({_OV.format('qty')}), 1) AS overprocessing FROM labelled GROUP BY grade"""),
)
def _(spark, sf):
    return D.grade_table(labelled(spark, sf), "total_cost", "qty")


_CT = ["material_cost", "tax_cost", "rebate_cost", "handling_cost", "total_cost"]
_CT_SQL = ", ".join(
    f"round(avg({_OV.format(c)}), 1) AS cost__{'TOTAL' if c == 'total_cost' else c}, "
    f"round(avg({_OV.format(c)}) - avg(CASE WHEN period = 'historic' THEN {c} END), 1) AS delta__{'TOTAL' if c == 'total_cost' else c}"
    for c in _CT
)


@query("component_summary_table", with_labels(f"SELECT grade, count({_OV.format('reel_id')}) AS n, {_CT_SQL} FROM labelled GROUP BY grade"))
def _(spark, sf):
    return D.component_table(labelled(spark, sf), COMPONENTS, "total_cost")


_LIMITS_SQL = """lim AS (SELECT p_brand AS grade, 'qty' AS property, avg(p_size) AS target, min(p_size) + 4.0 AS min FROM part GROUP BY p_brand
 UNION ALL SELECT p_brand, 'material_cost', avg(p_retailprice) * 2, CASE WHEN p_brand <> 'Brand#7' THEN avg(p_retailprice) END FROM part GROUP BY p_brand)"""


def part_limits_map(spark, sf):
    """Nested limits per grade, derived from the part table; one grade lacks a minimum."""
    stats = load(spark, sf, "part").groupBy(F.col("p_brand").alias("grade")).agg(
        F.avg("p_size").alias("qt"), (F.min("p_size") + F.lit(4.0)).alias("qm"), (F.avg("p_retailprice") * 2).alias("mt"), F.avg("p_retailprice").alias("mm")
    )
    return stats.select(
        "grade",
        F.create_map(
            F.lit("qty"), F.struct(F.col("qt").alias("target"), F.col("qm").alias("min")),
            F.lit("material_cost"),
            F.struct(F.col("mt").alias("target"), F.when(F.col("grade") != "Brand#7", F.col("mm")).alias("min")),
        ).alias("limits"),
    )


@query(
    "grade_limits_long",
    f"""WITH {_LIMITS_SQL} SELECT grade, property, 'target' AS variable, round(target, 6) AS value FROM lim
 UNION ALL SELECT grade, property, 'min', round(min, 6) FROM lim""",
)
def _(spark, sf):
    return rounded(D.limits_to_long(part_limits_map(spark, sf)), "value")


@query("grade_limits_wide", f"WITH {_LIMITS_SQL} SELECT grade, property, round(target, 6) AS target, round(min, 6) AS min FROM lim")
def _(spark, sf):
    return rounded(D.limits_wide(D.limits_to_long(part_limits_map(spark, sf))), "target", "min")


@query(
    "strength_rows_with_limits",
    with_labels(f""", {_LIMITS_SQL}, l AS (SELECT reel_id, grade, period, 'qty' AS property, qty AS value FROM labelled
 UNION ALL SELECT reel_id, grade, period, 'material_cost', material_cost FROM labelled)
 SELECT l.grade, l.period, l.property, count(*) AS n, round(avg(value - min), 6) AS mean_margin, count(CASE WHEN value >= target THEN 1 END) AS n_above_target
 FROM l JOIN lim ON l.grade = lim.grade AND l.property = lim.property WHERE min IS NOT NULL AND target IS NOT NULL AND value IS NOT NULL GROUP BY ALL"""),
)
def _(spark, sf):
    limits = D.limits_wide(D.limits_to_long(part_limits_map(spark, sf)))
    rows = D.strength_rows(labelled(spark, sf), limits, ["qty", "material_cost"])
    out = rows.groupBy("grade", "period", "property").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("value") - F.col("min")).alias("mean_margin"),
        F.count(F.when(F.col("value") >= F.col("target"), 1)).alias("n_above_target"),
    )
    return rounded(out, "mean_margin")


def _op_sql(p, coef):
    return f"""SELECT r.reel_id, r.line_no, r.part_id, r.supp_id, '{p}' AS property, ({p} - min) / min AS pct,
 ({p} - (min + target) / 2) / ((target - min) / 2) AS std, ({p} - min) * {coef} * 1000 / grammage * 434.22 / 1000 AS cost
 FROM reels r JOIN lim ON r.grade = lim.grade AND lim.property = '{p}' WHERE min IS NOT NULL"""


@query(
    "overprocessing_kpis",
    with_reels(f""", {_LIMITS_SQL}, m AS ({_op_sql('qty', 0.5)} UNION ALL {_op_sql('material_cost', 0.01)}),
 a AS (SELECT reel_id, line_no, part_id, supp_id, max(CASE WHEN property = 'qty' THEN pct END) AS over_pct_qty, max(CASE WHEN property = 'material_cost' THEN pct END) AS over_pct_material_cost,
 max(CASE WHEN property = 'qty' THEN std END) AS over_std_qty, max(CASE WHEN property = 'material_cost' THEN std END) AS over_std_material_cost,
 avg(pct) AS over_pct, avg(std) AS over_std, avg(cost) AS over_cost, sum(greatest(std - 1, 0)) AS over_score, sum(greatest(-std - 1, 0)) AS under_score
 FROM m GROUP BY ALL) SELECT reel_id, line_no, part_id, supp_id, {', '.join(f'round({c}, 3) + 0.0 AS {c}' for c in ['over_pct_qty', 'over_pct_material_cost', 'over_std_qty', 'over_std_material_cost', 'over_pct', 'over_std', 'over_cost', 'over_score', 'under_score'])} FROM a"""),
)
def _(spark, sf):
    limits = D.limits_wide(D.limits_to_long(part_limits_map(spark, sf)))
    out = D.overprocessing(
        reel_lines(spark, sf), limits, ["qty", "material_cost"], {"qty": 0.5, "material_cost": 0.01}, "grammage", 434.22,
        key=["reel_id", "line_no", "part_id", "supp_id"],
    )
    return rounded(out, *[c for c in out.columns if "over" in c or "under" in c], digits=3)


@query(
    "lab_performance_by_period",
    with_reels("""SELECT grade, period, property, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM (
 SELECT grade, 'baseline' AS period, unnest(['qty', 'material_cost']) AS property, unnest([qty, material_cost]) AS v FROM reels WHERE year(ts) = 2000
 UNION ALL SELECT grade, strftime(ts, '%Y-%m'), unnest(['qty', 'material_cost']), unnest([qty, material_cost]) FROM reels) GROUP BY ALL"""),
)
def _(spark, sf):
    month = F.date_format("ts", "yyyy-MM")
    tags = F.filter(F.array(F.when(P.in_range("ts", *BASELINE_RANGE), F.lit("baseline")), month), lambda x: x.isNotNull())
    return rounded(D.lab_performance(reel_lines(spark, sf), ["qty", "material_cost"], tags), "mean", "sd")


_METRIC_SQL = """SELECT grade, '{t}' AS target, count(*) AS n, round(avg(abs({a} - {p})), 6) AS mae, round(sqrt(avg(({a} - {p}) * ({a} - {p}))), 6) AS rmse,
 round(1 - sum(({a} - {p}) * ({a} - {p})) / (var_pop({a}) * count(*)), 6) AS r2, round(avg(abs(({a} - {p}) / {a})) * 100, 6) AS mape FROM labelled GROUP BY grade"""


@query(
    "model_error_metrics",
    with_labels(_METRIC_SQL.format(t="cost", a="total_cost", p="(1.1 * material_cost)") + " UNION ALL " + _METRIC_SQL.format(t="material", a="material_cost", p="(handling_cost * 100)")),
)
def _(spark, sf):
    df = labelled(spark, sf).withColumns({"p1": F.col("material_cost") * 1.1, "p2": F.col("handling_cost") * 100})
    out = D.error_metrics(df, {"cost": ("total_cost", "p1"), "material": ("material_cost", "p2")}, ["grade"])
    return rounded(out, "mae", "rmse", "r2", "mape")


@query(
    "performance_table",
    with_labels("""SELECT grade, period, round(stddev_samp(qty), 1) AS qty, round(stddev_samp(material_cost), 1) AS material_cost FROM labelled GROUP BY grade, period"""),
)
def _(spark, sf):
    perf = D.lab_performance(labelled(spark, sf).withColumnRenamed("period", "p0"), ["qty", "material_cost"], F.array("p0"))
    return D.pivot_metric(perf, ["grade", "period"], "property", "sd", ["qty", "material_cost"])


@query(
    "working_condition_stats",
    with_labels("""SELECT grade, period, variable, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(v) AS count, round(median(v), 6) AS median,
 round(stddev_samp(v) / sqrt(count(v)), 6) AS stderr FROM (SELECT grade, period, unnest(['qty', 'tax_cost']) AS variable, unnest([qty, tax_cost]) AS v FROM labelled) GROUP BY ALL"""),
)
def _(spark, sf):
    out = D.condition_stats(labelled(spark, sf), ["grade", "period"], ["qty", "tax_cost"])
    return rounded(out, "mean", "std", "median", "stderr")


@query(
    "operating_ranges",
    with_labels("""SELECT unnest(['qty', 'material_cost', 'tax_cost']) AS feature, unnest([round(avg(qty), 6), round(avg(material_cost), 6), round(avg(tax_cost), 6)]) AS value
 FROM labelled WHERE period = 'historic' AND grade = 'Brand#3'"""),
)
def _(spark, sf):
    best = (F.col("period") == P.BASELINE) & (F.col("grade") == "Brand#3")
    return rounded(D.operating_ranges(labelled(spark, sf), ["qty", "material_cost", "tax_cost"], best), "value")


@query(
    "cluster_status_labels",
    with_labels("""SELECT grammage AS cluster, round(quantile_cont(total_cost, 0.65), 6) AS cost_quantile, CASE WHEN count(CASE WHEN period <> 'current' THEN 1 END) = 0 THEN 'CURRENT'
 WHEN grammage = 3 THEN 'BEST' WHEN grammage IN (3, 5, 8) THEN 'OK' ELSE 'BAD' END AS label FROM labelled GROUP BY grammage"""),
)
def _(spark, sf):
    df = labelled(spark, sf).withColumnRenamed("grammage", "cluster")
    return rounded(D.cluster_labels(df, "cluster", "total_cost", 3, [3, 5, 8]), "cost_quantile")


@query(
    "components_ordered_by_total",
    with_labels("""SELECT unnest(['material_cost', 'tax_cost', 'rebate_cost', 'handling_cost']) AS cost,
 unnest([round(sum(material_cost), 2), round(sum(tax_cost), 2), round(sum(rebate_cost), 2), round(sum(handling_cost), 2)]) AS total FROM labelled"""),
)
def _(spark, sf):
    return rounded(D.components_by_total(labelled(spark, sf), COMPONENTS), "total", digits=2)


_DELTA3 = f", {UNPIVOT}, d AS (SELECT * FROM {compare_sql('long', 'grade')})"


def _component_deltas(spark, sf):
    return rounded(D.period_comparison(labelled(spark, sf), ["grade"], COMPONENTS), *CMP)


@query("labels_with_largest_peak", with_labels(f"{_DELTA3} SELECT cost, max(abs(delta_cost)) AS peak FROM d GROUP BY cost ORDER BY peak DESC, cost LIMIT 3"))
def _(spark, sf):
    return D.top_by_peak(_component_deltas(spark, sf), "cost", "delta_cost", 3)


@query(
    "top_fraction_of_contributions",
    with_labels(f"""{_DELTA3} SELECT cost, grade, delta_cost, CAST(r AS INT) AS rank, CASE WHEN delta_cost > 0 THEN 'up' WHEN delta_cost < 0 THEN 'down' ELSE 'flat' END AS direction
 FROM (SELECT *, row_number() OVER (PARTITION BY cost ORDER BY abs(delta_cost) DESC, grade) AS r, count(*) OVER (PARTITION BY cost) AS c FROM d)
 WHERE r <= greatest(1, ceil(c * 0.2))"""),
)
def _(spark, sf):
    out = D.top_fraction(_component_deltas(spark, sf), ["cost"], "grade", "delta_cost", 0.2)
    return out.select("cost", "grade", "delta_cost", "rank", "direction")


@query(
    "extreme_contributions",
    with_labels(f"""{_DELTA3}, g AS (SELECT grade || '/' || cost AS label, delta_cost FROM d)
 (SELECT label, delta_cost, 'top_increase' AS side FROM g ORDER BY delta_cost DESC, label LIMIT 5) UNION ALL (SELECT label, delta_cost, 'top_decrease' FROM g ORDER BY delta_cost, label LIMIT 5)"""),
)
def _(spark, sf):
    g = _component_deltas(spark, sf).select(F.concat_ws("/", "grade", "cost").alias("label"), "delta_cost")
    return D.extreme_contributions(g, "delta_cost", 5, "label")


@query(
    "component_narrative_numbers",
    with_labels(f"""{_DELTA3} SELECT cost, round(avg(CASE WHEN current_cost > 0 THEN delta_cost END), 6) AS avg_change, round(abs(avg(CASE WHEN current_cost > 0 THEN delta_cost END)), 6) AS abs_change,
 arg_max(grade, delta_cost) AS grade_of_largest_rise, max(delta_cost) AS largest_rise, arg_min(grade, delta_cost) AS grade_of_largest_fall, min(delta_cost) AS largest_fall
 FROM d WHERE delta_cost IS NOT NULL GROUP BY cost"""),
)
def _(spark, sf):
    return rounded(D.component_narrative(_component_deltas(spark, sf)), "avg_change", "abs_change")


@query(
    "drilldown_sentences",
    with_labels(f"""{_DELTA3} SELECT grade, cost, upper(cost[1]) || lower(cost[2:]) || CASE WHEN upper(grade) = 'ALL' THEN ' overall: ' ELSE ' on ' || coalesce(grade, 'no grade') || ': ' END
 || CASE WHEN current_cost IS NULL THEN 'not known' ELSE printf('%.2f €/t', current_cost) END
 || CASE WHEN delta_cost IS NULL THEN '' WHEN delta_cost = 0 THEN ', as before' WHEN delta_cost > 0 THEN printf(', up by %.2f €/t', delta_cost) ELSE printf(', down by %.2f €/t', -delta_cost) END AS sentence FROM d"""),
)
def _(spark, sf):
    return _component_deltas(spark, sf).select("grade", "cost", D.drilldown_sentence().alias("sentence"))


@query(
    "cost_histogram",
    with_reels(""", e AS (SELECT min(qty) AS lo, max(qty) AS hi, count(*) AS total FROM reels),
 b AS (SELECT CAST(least(9, floor((qty - lo) / ((hi - lo) / 10))) AS INT) AS bin, lo, hi, total FROM reels, e)
 SELECT bin, round(lo + bin * (hi - lo) / 10, 6) AS "left", count(*) AS n, round(count(*) / (total * (hi - lo) / 10), 6) AS density FROM b GROUP BY bin, lo, hi, total"""),
)
def _(spark, sf):
    return rounded(D.density_histogram(reel_lines(spark, sf), "qty"), "left", "density")


@query(
    "joint_density_grid",
    with_reels(""", e AS (SELECT min(qty) AS xl, max(qty) AS xh, min(grammage) AS yl, max(grammage) AS yh, count(*) AS total FROM reels),
 b AS (SELECT CAST(least(9, floor((qty - xl) / ((xh - xl) / 10))) AS INT) AS x_bin, CAST(least(9, floor((grammage - yl) / ((yh - yl) / 10))) AS INT) AS y_bin, e.* FROM reels, e)
 SELECT x_bin, y_bin, count(*) AS n, round(count(*) / (any_value(total) * ((any_value(xh) - any_value(xl)) / 10) * ((any_value(yh) - any_value(yl)) / 10)), 8) AS density FROM b GROUP BY x_bin, y_bin"""),
)
def _(spark, sf):
    return rounded(D.density_grid(reel_lines(spark, sf), "qty", "grammage"), "density", digits=8)


@query("distinct_grades", with_reels("SELECT DISTINCT grade FROM reels"))
def _(spark, sf):
    return D.distinct_values(reel_lines(spark, sf), "grade")


@query("distinct_counts_by_grade", with_reels("SELECT grade, count(DISTINCT reel_id) AS n_reel_id, count(DISTINCT supp_id) AS n_supp_id FROM reels GROUP BY grade"))
def _(spark, sf):
    return D.distinct_counts(reel_lines(spark, sf), ["grade"], ["reel_id", "supp_id"])


@query(
    "representative_rows",
    with_reels("""SELECT grade, count(CASE WHEN sel THEN 1 END) = 0 AS used_latest,
 CASE WHEN count(CASE WHEN sel THEN 1 END) > 0 THEN round(avg(CASE WHEN sel THEN qty END), 6) ELSE arg_max(qty, (ts, reel_id, line_no, part_id, supp_id)) END AS qty,
 round(CASE WHEN count(CASE WHEN sel THEN 1 END) > 0 THEN avg(CASE WHEN sel THEN total_cost END) ELSE arg_max(total_cost, (ts, reel_id, line_no, part_id, supp_id)) END, 6) AS total_cost
 FROM (SELECT *, CAST(ts AS DATE) BETWEEN DATE '2001-10-20' AND DATE '2001-12-31' AND supp_id < 20 AS sel FROM reels) GROUP BY grade"""),
)
def _(spark, sf):
    sel = P.in_range("ts", "2001-10-20", "2001-12-31") & (F.col("supp_id") < 20)
    out = D.representative_row(reel_lines(spark, sf), ["qty", "total_cost"], sel, ties=["reel_id", "line_no", "part_id", "supp_id"])
    return rounded(out, "qty", "total_cost")


@query(
    "extreme_group_mean_differences",
    with_labels("""SELECT unnest(['qty', 'tax_cost']) AS variable, unnest([round(avg(b1), 6), round(avg(b2), 6)]) AS baseline_mean, unnest([round(avg(t1), 6), round(avg(t2), 6)]) AS target_mean,
 unnest([round(avg(t1) - avg(b1), 6), round(avg(t2) - avg(b2), 6)]) AS delta FROM (SELECT CASE WHEN period = 'historic' THEN qty END AS b1, CASE WHEN period = 'current' THEN qty END AS t1,
 CASE WHEN period = 'historic' THEN tax_cost END AS b2, CASE WHEN period = 'current' THEN tax_cost END AS t2 FROM labelled)"""),
)
def _(spark, sf):
    df = labelled(spark, sf).withColumn("empty", F.lit(None).cast("double"))
    out = D.mean_differences(df, ["qty", "tax_cost", "empty"], F.col("period") == P.BASELINE, F.col("period") == P.TARGET)
    return rounded(out, "baseline_mean", "target_mean", "delta")
