"""Linear statistics, clusters and attribution."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..core.session import load
from ..core.sizing import join_stats
from ..operators import attribution as AT
from ..operators import clusters as CL
from ..operators import linear as L
from ..operators import mixtures as MX
from ..operators import opaque as OP
from ..operators import sketches as SK
from ..operators import timeseries as TS
from ..operators.periods import BASELINE, TARGET
from ..sources.files import scratch_path, write_parquet
from .base import events, labelled, query, reel_lines, rounded, with_labels, with_reels

KEYS = ["reel_id", "line_no", "part_id", "supp_id"]
K = ", ".join(KEYS)
FEATS = ["qty", "tax_cost", "rebate_cost"]


@query(
    "standardised_measures",
    with_reels(f"SELECT {K}, round((qty - avg(qty) OVER w) / stddev_pop(qty) OVER w, 6) AS qty, round((material_cost - avg(material_cost) OVER w) / stddev_pop(material_cost) OVER w, 6) AS material_cost FROM reels WINDOW w AS (PARTITION BY grade)"),
)
def _(spark, sf):
    df = reel_lines(spark, sf).select(*KEYS, "grade", "qty", "material_cost")
    return rounded(L.standardise(df, ["qty", "material_cost"], ["grade"]).drop("grade"), "qty", "material_cost")


@query(
    "column_products",
    with_reels("SELECT grade, count(*) AS n, round(sum(qty), 4) AS s0, round(sum(tax_cost), 4) AS s1, round(sum(qty * qty), 3) AS p00, round(sum(qty * tax_cost), 3) AS p01, round(sum(tax_cost * tax_cost), 2) AS p11 FROM reels GROUP BY grade"),
)
def _(spark, sf):
    m = L.moments(reel_lines(spark, sf), ["qty", "tax_cost"], ["grade"])
    p = lambda i: F.get("products", F.lit(i))
    return m.select(
        "grade", "n", F.round(F.get("sums", F.lit(0)), 4).alias("s0"), F.round(F.get("sums", F.lit(1)), 4).alias("s1"), F.round(p(0), 3).alias("p00"), F.round(p(1), 3).alias("p01"), F.round(p(3), 2).alias("p11")
    )


@query("pls_scores_of_grade")
def _(spark, sf):
    df = reel_lines(spark, sf)
    model = L.fit_pls(df, [*FEATS, "handling_cost"], "total_cost", 3, ["grade"])
    return L.pls_scores(df, model, [*FEATS, "handling_cost"], 3, ["grade"]).select("grade", *KEYS, "pls_1", "pls_2", "pls_3")


@query("pls_score_moments", with_reels("SELECT grade, count(*) AS n, 0.0::DOUBLE AS mean_1, 0.0::DOUBLE AS mean_2, 0.0::DOUBLE AS cross_12 FROM reels GROUP BY grade"))
def _(spark, sf):
    # Scores of a group have zero mean and are uncorrelated, whatever the library.
    df = reel_lines(spark, sf)
    model = L.fit_pls(df, [*FEATS, "handling_cost"], "total_cost", 2, ["grade"])
    s = L.pls_scores(df, model, [*FEATS, "handling_cost"], 2, ["grade"])
    return rounded(
        s.groupBy("grade").agg(
            F.count(F.lit(1)).alias("n"), F.avg("pls_1").alias("mean_1"), F.avg("pls_2").alias("mean_2"), F.avg(F.col("pls_1") * F.col("pls_2")).alias("cross_12")
        ),
        "mean_1", "mean_2", "cross_12",
    )


@query("groupwise_pls_scores")
def _(spark, sf):
    df = reel_lines(spark, sf)
    model = L.fit_pls(df.filter(F.col("grade") != "Brand#9"), FEATS, "total_cost", 2, ["grade"])
    world = L.fit_pls(df, FEATS, "total_cost", 2)
    out = L.pls_scores(df, model, FEATS, 2, ["grade"], fallback=world)
    return out.groupBy("grade").agg(F.count("pls_1").alias("n"), F.stddev_pop("pls_1").alias("sd_1"), F.stddev_pop("pls_2").alias("sd_2"))


@query("dominant_loadings")
def _(spark, sf):
    model = L.fit_pls(reel_lines(spark, sf), [*FEATS, "handling_cost"], "total_cost", 3, ["grade"])
    return L.dominant_loadings(L.pls_loadings(model, [*FEATS, "handling_cost"], ["grade"]), ["grade"])


def folded(spark, sf):
    return TS.time_folds(events(spark, sf), ["ts", "event_id"], 5).withColumns(
        {"hour": F.hour("ts").cast("double"), "k": F.get_json_object("props", "$.k").try_cast("double"), "u": F.col("user_id").cast("double")}
    )


@query("pls_component_choice")
def _(spark, sf):
    return L.pls_component_choice(folded(spark, sf), ["hour", "k", "u"], "value", "test_fold")


@query("ridge_penalty_scores")
def _(spark, sf):
    return L.ridge_cv(folded(spark, sf), ["hour", "k", "u"], "value", "test_fold")[0]


@query("ridge_coefficients")
def _(spark, sf):
    return L.ridge_cv(folded(spark, sf), ["hour", "k", "u"], "value", "test_fold")[1]


@query("feature_set_scores")
def _(spark, sf):
    names = F.array(F.lit("hour"), F.lit("k"), F.lit("u"))
    sets = events(spark, sf).select("event_type").distinct().select(
        F.col("event_type").alias("id"), F.when(F.col("event_type") == "view", F.slice(names, 1, 2)).when(F.col("event_type") == "click", F.slice(names, 2, 2)).otherwise(names).alias("features")
    )
    return L.score_feature_sets(folded(spark, sf), sets, ["hour", "k", "u"], "value", "test_fold")


@query(
    "effective_coefficients",
    with_reels("SELECT unnest(['qty', 'tax_cost', 'rebate_cost']) AS feature, unnest([round(3.0, 4), round(avg(2 * tax_cost), 4), round(0.5 * avg(qty), 4)]) AS coef FROM reels"),
)
def _(spark, sf):
    f = lambda g: g("tax_cost") * g("tax_cost") + 0.5 * F.lit(1.0) * g("rebate_cost") * F.col("qty") + 3 * g("qty")
    return rounded(L.effective_coefficients(reel_lines(spark, sf), f, FEATS), "coef", digits=4)


@query(
    "correlation_edges",
    with_reels("""SELECT * FROM (SELECT unnest(['material_cost', 'material_cost', 'tax_cost']) AS a, unnest(['tax_cost', 'rebate_cost', 'rebate_cost']) AS b,
 unnest([round(abs(corr(material_cost, tax_cost)), 6), round(abs(corr(material_cost, rebate_cost)), 6), round(abs(corr(tax_cost, rebate_cost)), 6)]) AS weight FROM reels) WHERE weight >= 0.1"""),
)
def _(spark, sf):
    return rounded(L.correlation_edges(reel_lines(spark, sf), ["material_cost", "tax_cost", "rebate_cost"], 0.1), "weight")


_BINS = """e AS (SELECT list_distinct([quantile_cont(qty, 0.2), quantile_cont(qty, 0.4), quantile_cont(qty, 0.6), quantile_cont(qty, 0.8)]) AS eq,
 list_distinct([quantile_cont(tax_cost, 0.2), quantile_cont(tax_cost, 0.4), quantile_cont(tax_cost, 0.6), quantile_cont(tax_cost, 0.8)]) AS et FROM reels),
 bn AS (SELECT *, CAST(len(list_filter(eq, lambda x: x <= qty)) AS INT) AS qb, CAST(len(list_filter(et, lambda x: x <= tax_cost)) AS INT) AS tb FROM reels, e)"""


def binned(spark, sf):
    return L.quantile_bins(reel_lines(spark, sf).withColumns({"qb": F.col("qty"), "tb": F.col("tax_cost")}), ["qb", "tb"])


@query("quantile_bins", with_reels(f", {_BINS} SELECT {K}, qb, tb FROM bn"))
def _(spark, sf):
    return binned(spark, sf).select(*KEYS, "qb", "tb")


@query(
    "chi_square_screening",
    with_reels(f""", {_BINS}, c AS (SELECT qb, tb, count(*) AS n FROM bn GROUP BY ALL), r AS (SELECT qb, sum(n) AS a FROM c GROUP BY qb), s AS (SELECT tb, sum(n) AS b FROM c GROUP BY tb), t AS (SELECT sum(n) AS t FROM c)
 SELECT 'qb' AS feature, round(sum((coalesce(n, 0) - a * b / t) * (coalesce(n, 0) - a * b / t) / (a * b / t)), 4) AS statistic, CAST((count(DISTINCT qb) - 1) * (count(DISTINCT tb) - 1) AS INT) AS dof
 FROM (SELECT qb, tb, a, b, t, n FROM r CROSS JOIN s CROSS JOIN t LEFT JOIN c USING (qb, tb))"""),
)
def _(spark, sf):
    return rounded(L.chi_square_screen(binned(spark, sf), ["qb"], "tb").drop("p_value"), "statistic", digits=4)


@query("conditional_bin_shares", with_reels(f", {_BINS} SELECT qb, tb, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY qb), 6) AS probability FROM bn GROUP BY qb, tb"))
def _(spark, sf):
    return rounded(L.conditional_shares(binned(spark, sf), "qb", "tb"), "probability")


@query(
    "predicted_component_costs",
    with_reels(f"SELECT {K}, round(1.5 + 2 * qty, 6) AS pred_steam, round(146.46 * (material_cost * (1 - tax_cost / 100) - 1 - rebate_cost) / material_cost, 6) AS pred_fibre, round(1.5 + 2 * qty + 146.46 * (material_cost * (1 - tax_cost / 100) - 1 - rebate_cost) / material_cost, 6) AS pred_total FROM reels"),
)
def _(spark, sf):
    df = reel_lines(spark, sf).select(
        *KEYS, "qty", F.col("material_cost").alias("basis_weight"), F.col("tax_cost").alias("moisture"), F.lit(1.0).alias("starch_bottom"), F.col("rebate_cost").alias("starch_top")
    )
    out = L.predict_costs(
        df, {"steam": L.linear_predictor({"qty": 2.0}, 1.5), "fibre": L.fibre_predictor()},
        {"steam": ["qty"], "fibre": ["basis_weight", "moisture", "starch_bottom", "starch_top"]},
    )
    return rounded(out.select(*KEYS, "pred_steam", "pred_fibre", "pred_total"), "pred_steam", "pred_fibre", "pred_total")


@query("mixture_with_min_size")
def _(spark, sf):
    out, _ = CL.mixture_with_min_size(labelled(spark, sf), ["qty", "tax_cost"], ["grade"], min_size=20, k_max=10)
    return out.groupBy("grade", "cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("total_cost").alias("total_cost"))


@query("mixture_choice")
def _(spark, sf):
    return CL.mixture_with_min_size(labelled(spark, sf), ["qty", "tax_cost"], ["grade"], min_size=20, k_max=10)[1]


@query("mixture_selection_criteria")
def _(spark, sf):
    fits = MX.mixtures(labelled(spark, sf), ["qty", "tax_cost"], ["grade"], k_min=1, replicates=20)
    return fits.select("grade", "k", "n", "bic", "icl", "stability", "min_size", "steps")


@query("operating_state_clusters")
def _(spark, sf):
    out = CL.cluster_by_period(labelled(spark, sf), FEATS, "total_cost")
    return out.groupBy("grade", "period", "cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("total_cost").alias("total_cost"))


def clustered(spark, sf):
    """Labelled rows with a given cluster number, so that later steps have a fixed input."""
    return labelled(spark, sf).withColumn("cluster", (F.col("grammage") % 4).cast("int"))


_CLU = "cl AS (SELECT *, CAST(grammage % 4 AS INT) AS cluster FROM labelled)"


@query(
    "extreme_cluster_rows",
    with_labels(f""", {_CLU}, m AS (SELECT grade, period, cluster, avg(total_cost) AS c FROM cl GROUP BY ALL), d AS (SELECT grade, avg(CASE WHEN period = 'current' THEN total_cost END) - avg(CASE WHEN period = 'historic' THEN total_cost END) AS d FROM cl GROUP BY grade),
 p AS (SELECT m.grade, period, CASE WHEN (d > 0) = (period = 'historic') THEN arg_min(cluster, c) ELSE arg_max(cluster, c) END AS cluster FROM m JOIN d USING (grade) GROUP BY m.grade, period, d)
 SELECT grade, period, cluster, count(*) AS n, round(avg(total_cost), 6) AS total_cost, round(avg(total_cost - 2 * qty), 6) AS unknown FROM cl JOIN p USING (grade, period, cluster) GROUP BY ALL"""),
)
def _(spark, sf):
    out = CL.with_unexplained(CL.extreme_clusters(clustered(spark, sf), "total_cost"), "total_cost", 2 * F.col("qty"))
    out = out.groupBy("grade", "period", "cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("total_cost").alias("total_cost"), F.avg("unknown").alias("unknown"))
    return rounded(out, "total_cost", "unknown")


_ACC = f"""{_CLU}, l AS (SELECT grade, cluster, unnest(['qty', 'tax_cost']) AS property, unnest([qty, tax_cost]) AS v FROM cl),
 lim AS (SELECT p_brand AS grade, 'qty' AS property, CAST(min(p_size) + 3.0 AS DOUBLE) AS mn FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'tax_cost', CAST(0 AS DOUBLE) FROM part GROUP BY 1),
 a AS (SELECT grade, cluster, property, round(quantile_cont(v, 0.1), 2) AS percentile, count(v) AS count FROM l GROUP BY ALL)"""


def _acceptable(spark, sf):
    part = load(spark, sf, "part").groupBy(F.col("p_brand").alias("grade")).agg((F.min("p_size") + 3.0).alias("qty"), F.lit(0.0).alias("tax_cost"))
    limits = part.unpivot(["grade"], ["qty", "tax_cost"], "property", "min")
    df = clustered(spark, sf)
    return df, CL.acceptable_clusters(df, limits, ["qty", "tax_cost"], 90, by=["grade"])


@query(
    "acceptable_clusters",
    with_labels(f""", {_ACC} SELECT grade, cluster, property, percentile, count, mn AS min, percentile >= mn AS valid, min(CAST(percentile >= mn AND count > 1 AS INT)) OVER (PARTITION BY grade, cluster) = 1 AS acceptable FROM a JOIN lim USING (grade, property)"""),
)
def _(spark, sf):
    return _acceptable(spark, sf)[1]


@query(
    "best_cluster",
    with_labels(f""", {_ACC}, ok AS (SELECT grade, cluster FROM a JOIN lim USING (grade, property) GROUP BY ALL HAVING min(CAST(percentile >= mn AND count > 1 AS INT)) = 1)
, md AS (SELECT grade, cluster, median(total_cost) AS m FROM cl JOIN ok USING (grade, cluster) GROUP BY ALL)
 SELECT grade, cluster, round(m, 6) AS median_cost FROM md QUALIFY row_number() OVER (PARTITION BY grade ORDER BY m, cluster) = 1"""),
)
def _(spark, sf):
    df, acc = _acceptable(spark, sf)
    return rounded(CL.best_cluster(df, "total_cost", acc.filter("acceptable"), by=["grade"]), "median_cost")


_KS = """u AS (SELECT grade, {v} AS v, count(*) FILTER (period = 'historic') AS a, count(*) FILTER (period = 'current') AS b FROM labelled GROUP BY ALL),
 r AS (SELECT grade, sum(a) OVER (PARTITION BY grade ORDER BY v) / sum(a) OVER (PARTITION BY grade) - sum(b) OVER (PARTITION BY grade ORDER BY v) / sum(b) OVER (PARTITION BY grade) AS d FROM u),
 s AS (SELECT grade, max(abs(d)) AS statistic FROM r GROUP BY grade),
 n AS (SELECT grade, count(*) FILTER (period = 'historic') AS n_a, count(*) FILTER (period = 'current') AS n_b, avg({v}) FILTER (period = 'historic') AS mean_a, avg({v}) FILTER (period = 'current') AS mean_b FROM labelled GROUP BY grade)"""


# Share of sample orders that stay closer than the statistic, one more row of the joint sample at a time.
_KS_P = """k0 AS (SELECT grade, statistic, CAST(n_a AS BIGINT) AS n, CAST(n_b AS BIGINT) AS m, CAST(round(statistic * n_a * n_b) AS BIGINT) AS h, n_a, n_b, mean_a, mean_b FROM s JOIN n USING (grade)),
 w(grade, k, i, v) AS (SELECT grade, 0, CAST(0 AS BIGINT), 1.0::DOUBLE FROM k0 WHERE h > 0
  UNION ALL SELECT grade, k, i, sum(v) FROM (SELECT w.grade, w.k + 1 AS k, w.i + d AS i, w.v * CASE d WHEN 1 THEN w.i + 1 ELSE w.k + 1 - w.i END / (w.k + 1) AS v, n, m, h FROM w JOIN k0 USING (grade), (VALUES (0), (1)) t(d))
   WHERE i <= n AND k - i <= m AND abs(i * m - (k - i) * n) < h GROUP BY grade, k, i),
 p AS (SELECT k0.grade, any_value(statistic) AS statistic, any_value(n_a) AS n_a, any_value(n_b) AS n_b, any_value(mean_a) AS mean_a, any_value(mean_b) AS mean_b, 1 - coalesce(max(w.v), 0) AS p_value
  FROM k0 LEFT JOIN w ON w.grade = k0.grade AND w.k = n + m GROUP BY k0.grade)"""


def _ks(value, select):
    return with_labels(f", {_KS.format(v=value)}, {_KS_P} {select}").replace("WITH ", "WITH RECURSIVE ", 1)


@query("two_sample_ks_statistic", _ks("total_cost", "SELECT grade, round(statistic, 9) AS statistic, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(p_value, 7) AS p_value FROM p"))
def _(spark, sf):
    out = CL.ks_two_sample(labelled(spark, sf), "total_cost", F.col("period") == BASELINE, ["grade"])
    return rounded(rounded(rounded(out, "mean_a", "mean_b"), "statistic", digits=9), "p_value", digits=7)


@query("benchmark_savings", _ks("handling_cost", "SELECT grade, round(p_value, 6) AS p_value, round(CASE WHEN p_value < 0.05 THEN mean_a - mean_b ELSE 0 END, 6) AS savings FROM p"))
def _(spark, sf):
    ks = CL.ks_two_sample(labelled(spark, sf), "handling_cost", F.col("period") == BASELINE, ["grade"])
    return rounded(CL.benchmark_savings(ks).select("grade", "p_value", "savings"), "p_value", "savings")


def model(g):
    """A cost model with an interaction."""
    return 2.0 * g("qty") + 0.01 * g("qty") * g("tax_cost") + 0.5 * g("rebate_cost")


_V = "(2.0 * {0} + 0.01 * {0} * {1} + 0.5 * {2})"
_MEANS = """m AS (SELECT grade, avg(qty) FILTER (period = 'historic') AS a1, avg(qty) FILTER (period = 'current') AS a2, avg(tax_cost) FILTER (period = 'historic') AS b1, avg(tax_cost) FILTER (period = 'current') AS b2,
 avg(rebate_cost) FILTER (period = 'historic') AS c1, avg(rebate_cost) FILTER (period = 'current') AS c2, avg(total_cost) FILTER (period = 'historic') AS t1, avg(total_cost) FILTER (period = 'current') AS t2 FROM labelled GROUP BY grade)"""


def _phi(i):
    """Shapley value of feature i written out over its coalitions."""
    names, others, parts = "abc", [j for j in range(3) if j != i], []
    for mask in range(4):
        on = [others[b] for b in range(2) if mask >> b & 1]
        w = {0: "1.0/3", 1: "1.0/6", 2: "1.0/3"}[len(on)]
        val = lambda s: _V.format(*[f"{names[j]}{2 if j in s else 1}" for j in range(3)])
        parts.append(f"{w} * ({val([*on, i])} - {val(on)})")
    return " + ".join(parts)


_PHI = f"{_MEANS}, ph AS (SELECT grade, unnest(['qty', 'tax_cost', 'rebate_cost']) AS variable, unnest([{_phi(0)}, {_phi(1)}, {_phi(2)}]) AS contribution, unnest([a1, b1, c1]) AS value_1, unnest([a2, b2, c2]) AS value_2 FROM m)"


def pairs(spark, sf):
    return AT.mean_pairs(labelled(spark, sf), FEATS, ["grade"], extra=["total_cost"])


@query(
    "shapley_exact",
    with_labels(f", {_PHI} SELECT grade, variable, round(contribution, 6) AS contribution FROM ph UNION ALL SELECT grade, 'unknown', round(t2 - t1 - ({_V.format('a2', 'b2', 'c2')} - {_V.format('a1', 'b1', 'c1')}), 6) FROM m"),
)
def _(spark, sf):
    return rounded(AT.shapley_exact(pairs(spark, sf), ["grade"], FEATS, model, "total_cost"), "contribution")


@query(
    "shapley_sampled_total",
    with_labels(f", {_MEANS} SELECT grade, round({_V.format('a2', 'b2', 'c2')} - {_V.format('a1', 'b1', 'c1')}, 6) AS total FROM m"),
)
def _(spark, sf):
    # Whatever the drawn orders, contributions add up to the model's change.
    c = AT.shapley_sampled(pairs(spark, sf), ["grade"], FEATS, model, 50)
    return rounded(c.groupBy("grade").agg(F.sum("contribution").alias("total")), "total")


@query("shapley_sampled")
def _(spark, sf):
    return AT.shapley_sampled(pairs(spark, sf), ["grade"], FEATS, model, 200)


_SPREAD = "sp AS (SELECT unnest(['qty', 'tax_cost', 'rebate_cost']) AS variable, unnest([stddev_samp(qty), stddev_samp(tax_cost), stddev_samp(rebate_cost)]) AS std, unnest([quantile_cont(qty, 0.05), quantile_cont(tax_cost, 0.05), quantile_cont(rebate_cost, 0.05)]) AS p05, unnest([quantile_cont(qty, 0.95), quantile_cont(tax_cost, 0.95), quantile_cont(rebate_cost, 0.95)]) AS p95 FROM labelled)"
_REL = f"""{_PHI}, {_SPREAD}, rl AS (SELECT *, value_2 - value_1 AS delta, abs(value_2 - value_1) / std AS delta_over_std, abs(value_2 - value_1) / (p95 - p05) AS delta_over_range, abs(contribution) AS abs_contribution,
 abs(value_2 - value_1) / std >= 0.05 AND abs(value_2 - value_1) / (p95 - p05) >= 0.01 AS keep FROM ph JOIN sp USING (variable))"""
_RCOLS = ["delta", "delta_over_std", "delta_over_range", "contribution", "abs_contribution"]


def _relevance(spark, sf):
    p = pairs(spark, sf)
    c = AT.shapley_exact(p, ["grade"], FEATS, model)
    return AT.relevance(p, c, AT.feature_spread(labelled(spark, sf), FEATS), ["grade"], FEATS, 0.05, 0.01)


@query("driver_relevance", with_labels(f", {_REL} SELECT grade, variable, keep, {', '.join(f'round({c}, 6) AS {c}' for c in _RCOLS)} FROM rl"))
def _(spark, sf):
    return rounded(_relevance(spark, sf).select("grade", "variable", "keep", *_RCOLS), *_RCOLS)


@query(
    "relevant_drivers_top",
    with_labels(f", {_REL} SELECT grade, variable, round(abs_contribution, 6) AS abs_contribution FROM (SELECT *, row_number() OVER (PARTITION BY grade ORDER BY abs_contribution DESC, variable) AS r FROM rl WHERE keep) WHERE r <= 2"),
)
def _(spark, sf):
    return rounded(AT.keep_relevant(_relevance(spark, sf), ["grade"], 2).select("grade", "variable", "abs_contribution"), "abs_contribution")


@query(
    "relative_contributions",
    with_labels(f", {_PHI} SELECT grade, variable, round(contribution / abs(sum(contribution) OVER (PARTITION BY grade)), 5) AS contribution, round(value_2 - value_1, 6) AS value_change FROM ph"),
)
def _(spark, sf):
    p = pairs(spark, sf)
    out = AT.relative_contributions(AT.shapley_exact(p, ["grade"], FEATS, model), p, ["grade"], FEATS)
    return rounded(rounded(out, "contribution", digits=5), "value_change")


@query(
    "driver_priority",
    with_labels(f", {_REL} SELECT grade, variable, round(abs_contribution * least(coalesce(delta_over_std, 0), 1) * least(coalesce(delta_over_range, 0), 1), 6) AS priority_score FROM rl WHERE keep"),
)
def _(spark, sf):
    out = AT.priority_score(_relevance(spark, sf).filter("keep"))
    return rounded(out.select("grade", "variable", "priority_score"), "priority_score")


@query(
    "top_driver_variables",
    with_labels(f", {_REL} SELECT grade, variable FROM rl QUALIFY row_number() OVER (PARTITION BY grade ORDER BY abs_contribution * least(coalesce(delta_over_std, 0), 1) * least(coalesce(delta_over_range, 0), 1) DESC, variable) <= 2"),
)
def _(spark, sf):
    return AT.top_driver_variables(AT.priority_score(_relevance(spark, sf)), 2, by=["grade"])


COEFS = {"qty": 1.5, "tax_cost": -0.2}


@query(
    "linear_shap_values",
    with_reels(f"""SELECT {K}, grade, unnest(['qty', 'tax_cost']) AS variable, round(1.5 * avg(qty) OVER w - 0.2 * avg(tax_cost) OVER w + 4, 5) AS base_value,
 unnest([round((qty - min(qty) OVER w) / (max(qty) OVER w - min(qty) OVER w), 6), round((tax_cost - min(tax_cost) OVER w) / (max(tax_cost) OVER w - min(tax_cost) OVER w), 6)]) AS value,
 unnest([round((qty - avg(qty) OVER w) * 1.5, 5), round((tax_cost - avg(tax_cost) OVER w) * -0.2, 5)]) AS shap, unnest([round((max(qty) OVER w - min(qty) OVER w) * 1.5, 5), round((max(tax_cost) OVER w - min(tax_cost) OVER w) * 0.2, 5)]) AS rank
 FROM reels WINDOW w AS (PARTITION BY grade)"""),
)
def _(spark, sf):
    out = AT.linear_shap(reel_lines(spark, sf), KEYS, COEFS, ["grade"], 4.0)
    return rounded(rounded(out, "base_value", "shap", "rank", digits=5), "value")


@query("linear_shap_adds_up", with_reels(f"SELECT {K}, round(1.5 * qty - 0.2 * tax_cost + 4 + 1e-9, 6) AS prediction FROM reels"))
def _(spark, sf):
    out = AT.linear_shap(reel_lines(spark, sf), KEYS, COEFS, ["grade"], 4.0)
    out = out.withColumn("row_id", F.struct(*KEYS)).groupBy(*KEYS).agg((F.first("base_value") + F.sum("shap")).alias("prediction"))
    return rounded(out, "prediction", nudge=1e-9)


@query("sampled_shap_values")
def _(spark, sf):
    out = AT.sampled_shap(reel_lines(spark, sf), KEYS, FEATS, model, permutations=10)
    return out.groupBy("grade", "variable").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("shap")).alias("mean_abs_shap"))


# A small ensemble of trees: (feature, threshold, value up to it, value above or a further tree).
TREES = [
    ("qty", 25.0, ("tax_cost", 60.0, 10.0, 35.0), ("rebate_cost", 40.0, 70.0, 55.0)),
    ("tax_cost", 30.0, -5.0, ("qty", 10.0, 4.0, ("rebate_cost", 90.0, 12.0, 20.0))),
]


def _tree_sql(tree) -> str:
    return f"CASE WHEN {tree[0]} <= {tree[1]} THEN {_tree_sql(tree[2])} ELSE {_tree_sql(tree[3])} END" if isinstance(tree, tuple) else str(tree)


def tree_model():
    """Predicts rows of FEATS with all trees at once."""

    def one(tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        return np.where(x[:, FEATS.index(tree[0])] <= tree[1], one(tree[2], x), one(tree[3], x))

    return lambda x: sum(one(t, x) for t in TREES)


_TREES = " + ".join(f"({_tree_sql(t)})" for t in TREES)


@query("opaque_predictions", with_reels(f"SELECT {K}, CAST({_TREES} AS DOUBLE) AS pred_cost FROM reels"))
def _(spark, sf):
    out = OP.predict_opaque(reel_lines(spark, sf), {"pred_cost": (OP.OpaqueModel("trees", tree_model), FEATS)})
    return out.select(*KEYS, "pred_cost")


@query("opaque_shap_adds_up", with_reels(f"SELECT {K}, CAST({_TREES} AS DOUBLE) AS prediction, 0.0::DOUBLE AS left_over FROM reels"))
def _(spark, sf):
    out = AT.opaque_shap(reel_lines(spark, sf), KEYS, FEATS, OP.OpaqueModel("trees", tree_model))
    sums = out.groupBy(*KEYS).agg(F.first("prediction").alias("prediction"), (F.first("prediction") - F.first("base_value") - F.sum("shap")).alias("left_over"))
    return rounded(sums, "prediction", "left_over")


@query(
    "shap_long_table",
    with_reels(f"SELECT {K}, unnest(['qty', 'tax_cost']) AS feature, unnest([qty, round(tax_cost + 1e-9, 6)]) AS feature_value, unnest([round(1.5 * qty + 1e-9, 6), round(0.2 * tax_cost + 1e-9, 6)]) AS shap_value FROM reels"),
)
def _(spark, sf):
    df = reel_lines(spark, sf).withColumns({"shap_qty": 1.5 * F.col("qty"), "shap_tax_cost": 0.2 * F.col("tax_cost")})
    return rounded(AT.shap_table(df, KEYS, ["qty", "tax_cost"]), "feature_value", "shap_value", nudge=1e-9)


_SR = "sr AS (SELECT grade AS g, unnest(['qty', 'tax_cost', 'rebate_cost']) AS variable, unnest([avg(abs(qty - 25)), avg(abs(tax_cost - 50)), avg(abs(rebate_cost - 70))]) AS mean_abs_shap, unnest([avg(qty - 25), avg(tax_cost - 50), avg(rebate_cost - 70)]) AS mean_shap FROM reels GROUP BY grade)"


def _ranking(spark, sf):
    df = reel_lines(spark, sf).select(F.col("grade").alias("g"), (F.col("qty") - 25).alias("qty"), (F.col("tax_cost") - 50).alias("tax_cost"), (F.col("rebate_cost") - 70).alias("rebate_cost"))
    return AT.shap_ranking(df.unpivot(["g"], FEATS, "variable", "shap"), by=["g"])


@query("shap_ranking", with_reels(f", {_SR} SELECT g, variable, round(mean_abs_shap, 6) AS mean_abs_shap, round(mean_shap, 6) AS mean_shap FROM sr"))
def _(spark, sf):
    return rounded(_ranking(spark, sf), "mean_abs_shap", "mean_shap")


@query(
    "shap_top_with_other",
    with_reels(f""", {_SR}, k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY mean_abs_shap DESC, variable) AS r FROM sr)
 SELECT g, CASE WHEN r < 2 THEN variable ELSE 'other' END AS variable, CAST(least(r, 2) AS INT) AS place, round(sum(mean_abs_shap), 6) AS mean_abs_shap FROM k GROUP BY ALL"""),
)
def _(spark, sf):
    return rounded(AT.top_with_other(_ranking(spark, sf), 2, by=["g"]), "mean_abs_shap")


# Sketches are random, so the SQL gives the exact figures, and that every error stays within three times its bound.
_STORED = {"p10": ("total_cost", 0.1), "p50": ("total_cost", 0.5), "p99": ("total_cost", 0.99)}


@query(
    "quantiles_from_stored_sketches",
    with_reels("SELECT grade, count(*) AS n_rows, round(min(total_cost), 6) AS lowest, round(max(total_cost), 6) AS highest, true AS p10_ok, true AS p50_ok, true AS p99_ok, true AS parts_ok FROM reels GROUP BY grade"),
)
def _(spark, sf):
    k, df = 512, reel_lines(spark, sf).withColumn("month", F.date_format("ts", "yyyy-MM"))
    path = scratch_path(spark, "sketches")
    write_parquet(SK.sketch_measures(df, ["grade", "month"], ["total_cost"], ["part_id"], k), path)
    merged = SK.merge_sketches(spark.read.parquet(path), ["grade"], k)
    ends = {"lowest": ("total_cost", 0.0), "highest": ("total_cost", 1.0)}
    answers = SK.sketch_answers(merged, ["grade"], {**_STORED, **ends}, {"parts": "part_id"})
    checked = SK.rank_interval(df, answers, ["grade"], _STORED)
    exact = df.groupBy("grade").agg(F.countDistinct("part_id").alias("exact"))
    out = join_stats(checked, exact, ["grade"])
    good = [(F.col(f"{q}_error") <= 3 * SK.rank_error(k)).alias(f"{q}_ok") for q in _STORED]
    parts = F.abs(F.col("parts") - F.col("exact")) <= 3 * SK.distinct_error() * F.col("exact")
    return rounded(out.select("grade", "n_rows", "lowest", "highest", *good, parts.alias("parts_ok")), "lowest", "highest")
