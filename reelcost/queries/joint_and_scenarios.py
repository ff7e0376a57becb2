"""Joint distributions, what-if scenarios and recommendations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..core.session import load
from ..operators import attribution as AT
from ..operators import drilldown as D
from ..operators import joint as JT
from ..operators import recommend as RC
from ..operators import scenario as SC
from ..operators import tcopula as TC
from ..operators.periods import BASELINE, TARGET
from .base import COMPONENTS, TIES, events, labelled, query, reel_lines, rounded, with_labels, with_reels

KEYS = ["reel_id", "line_no", "part_id", "supp_id"]
K = ", ".join(KEYS)
VARS = ["qty", "grammage", "handling_cost"]


def joint_rows(spark, sf):
    return reel_lines(spark, sf).select(*KEYS, "grade", *VARS)


def joint_model(spark, sf):
    return JT.fit_joint(joint_rows(spark, sf), VARS, min_rows=50)


_KNOTS = """kn AS (SELECT grade, variable, x, n, (sum(n) OVER w - n / 2) / sum(n) OVER (PARTITION BY grade, variable) AS u FROM (
 SELECT grade, variable, x, count(*) AS n FROM (SELECT grade, unnest(['qty', 'grammage', 'handling_cost']) AS variable, unnest([qty, CAST(grammage AS DOUBLE), handling_cost]) AS x FROM reels) GROUP BY ALL) WINDOW w AS (PARTITION BY grade, variable ORDER BY x))"""


@query("marginal_distribution_knots", with_reels(f", {_KNOTS} SELECT grade, variable, round(x, 6) AS x, n, round(u, 9) AS u FROM kn"))
def _(spark, sf):
    df = joint_rows(spark, sf).withColumn("grammage", F.col("grammage").cast("double"))
    return rounded(rounded(JT.marginal_knots(JT.value_counts(df, VARS)), "x"), "u", digits=9)


@query(
    "marginal_bandwidths",
    with_reels("""SELECT grade, variable, count(*) AS n_rows, round(greatest(1.06 * stddev_samp(x) * pow(count(*), -0.2), 0.001), 6) AS bandwidth, min(x) AS lowest, max(x) AS highest
 FROM (SELECT grade, unnest(['qty', 'grammage']) AS variable, unnest([qty, CAST(grammage AS DOUBLE)]) AS x FROM reels) GROUP BY ALL"""),
)
def _(spark, sf):
    df = joint_rows(spark, sf).withColumn("grammage", F.col("grammage").cast("double"))
    out = JT.marginal_bands(JT.marginal_knots(JT.value_counts(df, ["qty", "grammage"])))
    return rounded(out.select("grade", "variable", "n_rows", "bandwidth", "lowest", "highest"), "bandwidth")


@query("copula_correlations")
def _(spark, sf):
    m = joint_model(spark, sf)
    return m.corr.select("grade", "n_rows", F.get("corr", F.lit(1)).alias("qty_grammage"), F.get("corr", F.lit(2)).alias("qty_handling"), "logdet")


@query("row_feasibility")
def _(spark, sf):
    df = joint_rows(spark, sf)
    return JT.feasibility(df, JT.fit_joint(df, VARS, min_rows=50), KEYS)


@query("joint_samples")
def _(spark, sf):
    s = JT.sample_joint(joint_model(spark, sf), spark, 200, seed=3)
    return s.groupBy("grade").agg(F.count(F.lit(1)).alias("n"), F.avg("qty").alias("qty"), F.avg("handling_cost").alias("handling_cost"))


@query("conditional_summaries")
def _(spark, sf):
    df = joint_rows(spark, sf)
    return JT.conditional_summary(df, JT.fit_joint(df, VARS, min_rows=50), ["qty"], ["grammage", "handling_cost"], KEYS)


@query("conditional_joint_draws")
def _(spark, sf):
    df = joint_rows(spark, sf)
    d = JT.conditional_draws(df, JT.fit_joint(df, VARS, min_rows=50), ["qty", "handling_cost"], ["grammage"], KEYS, 5, 1)
    return d.groupBy(*KEYS).agg(F.avg("qty").alias("qty"), F.avg("handling_cost").alias("handling_cost"))


@query("conditional_ranges")
def _(spark, sf):
    m = joint_model(spark, sf)
    return JT.conditional_bounds(joint_rows(spark, sf), m, "qty").select(*KEYS, "qty_low", "qty_high", "qty_mode")


@query("t_copula_fit")
def _(spark, sf):
    return JT.fit_t_copula(joint_rows(spark, sf), VARS, min_rows=50)[1]


@query("t_copula_conditional_quantiles")
def _(spark, sf):
    df = joint_rows(spark, sf)
    m, _ = JT.fit_t_copula(df, VARS, min_rows=50)
    return JT.t_conditional_quantiles(df, m, "qty", ["grammage", "handling_cost"]).select(*KEYS, "q05", "q50", "q95")


@query("t_copula_row_density")
def _(spark, sf):
    df = joint_rows(spark, sf)
    m, _ = JT.fit_t_copula(df, VARS, min_rows=50)
    return TC.t_log_likelihood(df, m).select(*KEYS, "loglik")


@query("t_copula_samples")
def _(spark, sf):
    m, _ = JT.fit_t_copula(joint_rows(spark, sf), VARS, min_rows=50)
    s = TC.t_sample_joint(m, spark, 2000, seed=3)
    return s.groupBy("grade").agg(F.count(F.lit(1)).alias("n"), F.avg("qty").alias("qty"), F.avg("handling_cost").alias("handling_cost"))


@query("t_copula_conditional_draws")
def _(spark, sf):
    df = joint_rows(spark, sf)
    m, _ = JT.fit_t_copula(df, VARS, min_rows=50)
    d = TC.t_conditional_draws(df, m, ["qty", "handling_cost"], ["grammage"], KEYS, 5, 1)
    return d.groupBy(*KEYS).agg(F.avg("qty").alias("qty"), F.avg("handling_cost").alias("handling_cost"))


@query("t_copula_conditional_summaries")
def _(spark, sf):
    df = joint_rows(spark, sf)
    m, _ = JT.fit_t_copula(df, VARS, min_rows=50)
    return TC.t_conditional_summary(df, m, "qty", ["grammage", "handling_cost"], KEYS)


@query(
    "kernel_density_curve",
    with_reels(""", s AS (SELECT 0.2 * stddev_samp(qty) AS bw, min(qty) AS lo, max(qty) AS hi, count(*) AS n, quantile_cont(qty, 0.025) AS p025, median(qty) AS p500, quantile_cont(qty, 0.975) AS p975 FROM reels),
 c AS (SELECT qty AS x, count(*) AS k FROM reels GROUP BY qty), g AS (SELECT CAST(i AS INT) AS i, lo + (hi - lo) * i / 499.0 AS at FROM s, range(500) r(i))
 SELECT g.i, round(any_value(g.at), 6) AS at, round(sum(k * exp(-0.5 * pow((g.at - c.x) / bw, 2))) / (any_value(bw) * sqrt(2 * pi()) * any_value(n)), 9) AS density, any_value(p025) AS p025, any_value(p500) AS p500, any_value(p975) AS p975 FROM g, c, s GROUP BY g.i"""),
)
def _(spark, sf):
    return rounded(rounded(JT.density_curve(reel_lines(spark, sf), "qty"), "at"), "density", digits=9)


@query("reference_row_of_grade", with_reels(f"SELECT {K}, 'latest_grade' AS selection_mode FROM reels WHERE grade = 'Brand#5' ORDER BY ts DESC, reel_id DESC, line_no DESC, part_id DESC, supp_id DESC LIMIT 1"))
def _(spark, sf):
    return SC.reference_row(reel_lines(spark, sf), grade="Brand#5", ties=TIES).select(*KEYS, "selection_mode")


@query(
    "reference_row_near_time",
    """SELECT event_id, 'nearest_timestamp' AS selection_mode, round(abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-20 07:30:00')) / 6e7, 6) AS time_diff_minutes, false AS time_warning
 FROM events ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-20 07:30:00')) LIMIT 1""",
)
def _(spark, sf):
    out = SC.reference_row(events(spark, sf), at="2024-01-20 07:30:00", ties=["event_id"])
    return rounded(out.select("event_id", "selection_mode", "time_diff_minutes", "time_warning"), "time_diff_minutes")


CHANGES = [SC.Change("qty", "relative", 0.1), SC.Change("tax_cost", "delta", -5.0), SC.Change("qty", "delta", 1.0), SC.Change("rebate_cost", "absolute", 12.0)]


@query("changes_applied", with_reels(f"SELECT {K}, round(qty * 1.1 + 1, 6) AS qty, round(tax_cost - 5 + 1e-9, 6) AS tax_cost, CAST(12.0 AS DOUBLE) AS rebate_cost FROM reels"))
def _(spark, sf):
    out = SC.apply_changes(reel_lines(spark, sf), CHANGES).select(*KEYS, "qty", "tax_cost", "rebate_cost")
    return rounded(rounded(out, "qty"), "tax_cost", nudge=1e-9)


def scenarios(spark, sf):
    """Scenario steps derived from the regions: one scenario per region."""
    r = load(spark, sf, "region").select("r_regionkey")
    step = lambda i, v, m, x: F.struct(F.lit(i).alias("seq"), F.lit(v).alias("variable"), F.lit(m).alias("mode"), x.alias("value"))
    k = F.col("r_regionkey")
    return r.select(
        F.col("r_regionkey").alias("scenario_id"),
        F.inline(F.array(step(2, "qty", "delta", k * 1.0), step(1, "qty", "relative", k * 0.1), step(1, "tax_cost", "absolute", k + 0.5))),
    )


@query(
    "scenarios_applied_to_rows",
    with_reels("SELECT scenario_id, grade, count(*) AS n, round(avg(qty * (1 + scenario_id * 0.1) + scenario_id), 6) AS qty, round(avg(scenario_id + 0.5), 6) AS tax_cost FROM reels, (SELECT r_regionkey AS scenario_id FROM region) GROUP BY ALL"),
)
def _(spark, sf):
    out = SC.apply_scenarios(reel_lines(spark, sf), scenarios(spark, sf), ["qty", "tax_cost"], [*KEYS, "grade"])
    return rounded(out.groupBy("scenario_id", "grade").agg(F.count(F.lit(1)).alias("n"), F.avg("qty").alias("qty"), F.avg("tax_cost").alias("tax_cost")), "qty", "tax_cost")


def cost(g):
    return 2.0 * g("qty") + 0.01 * g("qty") * g("tax_cost")


@query(
    "scenario_simulation",
    with_reels(f""", s AS (SELECT *, qty * 1.1 + 1 AS q, tax_cost - 5 AS t FROM reels) SELECT {K}, round(2 * qty + 0.01 * qty * tax_cost + 1e-8, 5) AS baseline_prediction, round(2 * q + 0.01 * q * t + 1e-8, 5) AS scenario_prediction,
 round(2 * q + 0.01 * q * t - (2 * qty + 0.01 * qty * tax_cost) + 1e-8, 5) AS difference, 'not model inputs: rebate_cost' AS note FROM s"""),
)
def _(spark, sf):
    out = SC.simulate(reel_lines(spark, sf), CHANGES, cost, ["qty", "tax_cost"], KEYS)
    return rounded(out, "baseline_prediction", "scenario_prediction", "difference", digits=5, nudge=1e-8)


@query("changes_calibrated_to_history")
def _(spark, sf):
    df = joint_rows(spark, sf)
    m = JT.fit_joint(df, VARS, min_rows=50)
    todo = [SC.Change("qty", "relative", 0.5), SC.Change("handling_cost", "delta", 1.0)]
    out = SC.calibrate(df, m, todo)
    return out.select(*KEYS, "qty", "qty_requested", "qty_low", "qty_high", "qty_clipped", "handling_cost", "handling_cost_clipped")


def strength(g):
    return g("qty") + 0.2 * g("grammage")


@query("control_sweep")
def _(spark, sf):
    df = joint_rows(spark, sf)
    m = JT.fit_joint(df, VARS, min_rows=50)
    return SC.sweep_control(df, m, "qty", KEYS, lambda g: 3 * g("qty"), strength, 25.0, likelihood_weight=1e-5)


@query("controls_swept_in_turn")
def _(spark, sf):
    df = joint_rows(spark, sf)
    m = JT.fit_joint(df, VARS, min_rows=50)
    return SC.sweep_controls_in_turn(df, m, ["qty", "handling_cost"], KEYS, lambda g: 3 * g("qty") + g("handling_cost"), strength, 25.0)


@query("control_response_curve")
def _(spark, sf):
    df = joint_rows(spark, sf)
    out = SC.response_curve(df, JT.fit_joint(df, VARS, min_rows=50), "qty", KEYS, lambda g: 3 * g("qty"), strength)
    return out.groupBy("step").agg(F.avg("qty").alias("qty"), F.avg("cost").alias("cost"), F.avg("strength").alias("strength"))


_DRV = "dv AS (SELECT unnest(['material_cost', 'tax_cost', 'rebate_cost', 'handling_cost']) AS variable, unnest([avg(material_cost) FILTER (period = 'historic'), avg(tax_cost) FILTER (period = 'historic'), avg(rebate_cost) FILTER (period = 'historic'), avg(handling_cost) FILTER (period = 'historic')]) AS b, unnest([avg(material_cost) FILTER (period = 'current'), avg(tax_cost) FILTER (period = 'current'), avg(rebate_cost) FILTER (period = 'current'), avg(handling_cost) FILTER (period = 'current')]) AS t FROM labelled)"
_SHAPS = "sh AS (SELECT unnest(['material_cost', 'tax_cost', 'rebate_cost', 'handling_cost']) AS variable, unnest([avg(abs(material_cost - 1500)), avg(abs(tax_cost - 60)), avg(abs(rebate_cost - 70)), avg(abs(handling_cost - 9.5))]) AS mean_abs_shap, unnest([avg(material_cost - 1500), avg(tax_cost - 60), avg(rebate_cost - 70), avg(handling_cost - 9.5)]) AS mean_shap FROM labelled)"


def _drivers(spark, sf):
    """Component changes between the periods and deviations from set points as model evidence."""
    df = labelled(spark, sf)
    diff = D.mean_differences(df, COMPONENTS, F.col("period") == BASELINE, F.col("period") == TARGET)
    points = {"material_cost": 1500, "tax_cost": 60, "rebate_cost": 70, "handling_cost": 9.5}
    long = df.select(*[(F.col(c) - F.lit(float(v))).alias(c) for c, v in points.items()]).unpivot([], COMPONENTS, "variable", "shap")
    return diff.select("variable", F.col("delta").alias("contribution")), diff, AT.shap_ranking(long)


@query(
    "joint_variable_set",
    with_labels(f", {_DRV}, {_SHAPS}, a AS (SELECT 'qty' AS variable, 0 AS source, 1 AS place FROM labelled GROUP BY ALL UNION ALL SELECT variable, 1, CAST(row_number() OVER (ORDER BY t - b DESC) AS INT) FROM dv UNION ALL SELECT variable, 2, CAST(row_number() OVER (ORDER BY mean_abs_shap DESC) AS INT) FROM sh)"
    " SELECT variable, source, place FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY source, place) AS r FROM a) WHERE r = 1 ORDER BY source, place LIMIT 4"),
)
def _(spark, sf):
    drivers, _, shap = _drivers(spark, sf)
    rank = lambda df, c: df.select("variable", F.row_number().over(Window.orderBy(F.desc(c))).alias("place"))
    asked = labelled(spark, sf).agg(F.lit("qty").alias("variable"), F.lit(1).alias("place"))
    return SC.joint_variable_set([asked, rank(drivers, "contribution"), rank(shap, "mean_abs_shap")], [*COMPONENTS, "qty"], 4)


KNOWLEDGE = [
    ("material_cost", "actionable", "set by purchasing", "decrease", "high"),
    ("tax_cost", "indirect", "follows the price", "increase", "medium"),
    ("rebate_cost", "indicator only", "outcome", "review", "high"),
    ("handling_cost", "actionable", "route choice", "review", "low"),
]
_KN = "kn(variable, classification, recommended_direction, confidence) AS (VALUES ('material_cost', 'actionable', 'decrease', 'high'), ('tax_cost', 'indirect', 'increase', 'medium'), ('rebate_cost', 'indicator only', 'review', 'high'), ('handling_cost', 'actionable', 'review', 'low'))"


def knowledge(spark):
    return spark.createDataFrame(KNOWLEDGE, "variable string, classification string, engineering_reason string, recommended_direction string, confidence string")


_REC = f"""{_DRV}, {_SHAPS}, {_KN}, e AS (SELECT dv.variable, t - b AS contribution, mean_abs_shap, mean_shap, classification, confidence,
 CASE recommended_direction WHEN 'decrease' THEN 'reduce_or_optimize' WHEN 'increase' THEN 'restore_or_increase' WHEN 'review' THEN 'review' END AS kd, CASE WHEN mean_shap > 0 THEN 'reduce_or_optimize' WHEN mean_shap < 0 THEN 'restore_or_increase' END AS sd,
 CASE variable WHEN 'material_cost' THEN 1.0 WHEN 'tax_cost' THEN 0.35 * 0.65 WHEN 'rebate_cost' THEN 0.0 ELSE 0.3 END AS w, CASE variable WHEN 'material_cost' THEN 0.3 WHEN 'tax_cost' THEN 0.08 WHEN 'rebate_cost' THEN 0.0 ELSE 0.1 END AS fb
 FROM dv JOIN sh USING (variable) JOIN kn USING (variable)),
 d AS (SELECT *, kd <> sd AND kd <> 'review' AND sd <> 'review' AS cf, greatest(abs(contribution) * mean_abs_shap, fb) AS ps FROM e),
 r AS (SELECT *, CASE WHEN cf THEN 'review' ELSE coalesce(kd, sd) END AS direction, ps * w AS fs FROM d)"""


@query(
    "recommendations",
    with_labels(f""", {_REC} SELECT variable, direction, coalesce(cf, false) AS has_conflict, round(ps, 5) AS priority_score, round(fs, 5) AS final_score,
 CASE WHEN direction = 'review' AND (classification NOT LIKE '%actionable%' OR confidence NOT IN ('high', 'medium')) THEN NULL WHEN direction = 'review' THEN 'review' ELSE 'relative' END AS suggested_mode,
 CASE WHEN direction = 'reduce_or_optimize' THEN -0.05 WHEN direction = 'restore_or_increase' THEN 0.05 WHEN classification LIKE '%actionable%' AND confidence IN ('high', 'medium') THEN 0.0 END::DOUBLE AS suggested_value
 FROM r WHERE classification NOT LIKE '%indicator%' ORDER BY fs DESC, ps DESC, abs(contribution) DESC LIMIT 3"""),
)
def _(spark, sf):
    drivers, diff, shap = _drivers(spark, sf)
    out = RC.build_recommendations(drivers, diff, shap, knowledge(spark), 3)
    return rounded(out.select("variable", "direction", "has_conflict", "priority_score", "final_score", "suggested_mode", "suggested_value"), "priority_score", "final_score", digits=5)


@query(
    "actionable_and_secondary_drivers",
    with_labels(f", {_DRV}, {_KN} SELECT variable, classification, CASE WHEN classification LIKE '%actionable%' THEN 'actionable' ELSE 'secondary' END AS kind FROM dv JOIN kn USING (variable) WHERE classification LIKE '%actionable%' OR classification LIKE '%indirect%'"),
)
def _(spark, sf):
    return RC.split_actionable(_drivers(spark, sf)[0], knowledge(spark))


_CLS = "CASE p_size % 5 WHEN 0 THEN 'indicator' WHEN 1 THEN 'actionable' WHEN 2 THEN 'indirect' WHEN 3 THEN 'indirect indicator actionable' ELSE 'other' END"
_CONF = "CASE p_partkey % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'medium-ish' WHEN 2 THEN 'low' ELSE '' END"


@query(
    "actionability_weights",
    f"""WITH c AS (SELECT p_partkey, p_size % 5 AS s, p_partkey % 4 AS k FROM part)
 SELECT p_partkey, round(CASE s WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.35 WHEN 3 THEN 0.20 ELSE 0.25 END::DOUBLE * CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.65 WHEN 2 THEN 0.3 ELSE 0.5 END, 6) AS weight,
 CAST(CASE s WHEN 1 THEN CASE k WHEN 0 THEN 0.30 WHEN 1 THEN 0.20 WHEN 2 THEN 0.10 ELSE 0.15 END WHEN 2 THEN CASE k WHEN 0 THEN 0.12 WHEN 1 THEN 0.08 WHEN 2 THEN 0.04 ELSE 0.05 END WHEN 3 THEN CASE k WHEN 0 THEN 0.12 WHEN 1 THEN 0.08 WHEN 2 THEN 0.04 ELSE 0.05 END ELSE 0 END AS DOUBLE) AS score,
 s IN (1, 2) AS recommendable FROM c""",
)
def _(spark, sf):
    cls, conf = F.expr(_CLS), F.expr(_CONF)
    out = load(spark, sf, "part").select(
        "p_partkey", RC.actionability_weight(cls, conf).alias("weight"), RC.knowledge_score(cls, conf).alias("score"), RC.is_recommendable(cls).alias("recommendable")
    )
    return rounded(out, "weight", "score")


@query(
    "directions_and_conflicts",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN 'reduce_or_optimize' WHEN p_size < 25 THEN 'restore_or_increase' END AS a,
 CASE p_partkey % 4 WHEN 0 THEN 'reduce_or_optimize' WHEN 1 THEN 'restore_or_increase' WHEN 2 THEN 'review' END AS b,
 coalesce(CASE WHEN p_size > 25 THEN 0 WHEN p_size < 25 THEN 1 END <> CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 END, false) AS conflict FROM part""",
)
def _(spark, sf):
    a = RC.direction_from_sign(F.col("p_size") - 25)
    b = RC.direction_from_knowledge(F.expr("CASE p_partkey % 4 WHEN 0 THEN ' Decrease' WHEN 1 THEN 'increase' WHEN 2 THEN 'review' ELSE 'none' END"))
    return load(spark, sf, "part").select("p_partkey", a.alias("a"), b.alias("b"), RC.directions_conflict(a, b).alias("conflict"))


@query(
    "knowledge_json_parsed",
    """SELECT p_partkey, p_type AS variable, 'actionable' AS classification, 'Size ' || p_size AS engineering_reason, 'increase' AS recommended_direction, 'high' AS confidence FROM part WHERE p_partkey % 7 <> 0
 UNION ALL SELECT p_partkey, 'x', '', '', '', '' FROM part WHERE p_partkey % 7 <> 0""",
)
def _(spark, sf):
    body = F.concat(
        F.lit('{"variables":[{"variable":" '), "p_type", F.lit(' ","classification":"Actionable ","engineering_reason":"Size '), F.col("p_size").cast("string"),
        F.lit('","recommended_direction":"Increase","confidence":"HIGH"},{"variable":"x"},{"variable":" "}]}'),
    )
    text = F.when(F.col("p_partkey") % 7 == 0, F.lit("not json {")).when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return RC.parse_knowledge(load(spark, sf, "part").select("p_partkey", text.alias("t")), "t", ("p_partkey",))
