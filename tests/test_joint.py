import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reelcost.core import sizing
from reelcost.functions import student
from reelcost.functions.expr import normal_cdf, normal_quantile
from reelcost.operators import joint as JT
from reelcost.operators import tcopula as TC


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    n = 600
    z = rng.multivariate_normal([0, 0, 0], [[1, 0.7, 0.2], [0.7, 1, 0.1], [0.2, 0.1, 1]], n)
    pdf = pd.DataFrame({"grade": np.where(np.arange(n) % 3 == 0, "b", "a"), "id": np.arange(n), "x": np.round(z[:, 0] * 2 + 50, 1), "y": np.exp(z[:, 1] / 3), "w": z[:, 2]})
    return pdf, spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def model(data):
    return JT.fit_joint(data[1], ["x", "y", "w"], min_rows=100)


def midranks(v):
    u, c = np.unique(v, return_counts=True)
    return u, (np.cumsum(c) - c / 2) / len(v)


def ppf(spark, u):
    df = spark.createDataFrame([(float(a),) for a in np.ravel(u)], "u double")
    return np.array([r[0] for r in df.select(normal_quantile("u")).collect()]).reshape(np.shape(u))


def test_normal_functions(spark):
    df = spark.createDataFrame([(x,) for x in (-5.0, -1.96, -0.3, 0.0, 0.5, 3.0)], "x double")
    for r in df.select("x", normal_cdf("x").alias("p"), normal_quantile(normal_cdf("x")).alias("b")).collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), rel=2e-7)
        assert r.b == pytest.approx(r.x, abs=1e-5)


def test_student_functions():
    assert student.cdf(np.array([2.015]), 5)[0] == pytest.approx(0.95, abs=1e-5)
    assert student.quantile(np.array([0.025, 0.5, 0.999]), 10) == pytest.approx([-2.22814, 0.0, 4.14370], abs=1e-4)
    p = np.array([1e-6, 0.2, 0.77])
    assert student.cdf(student.quantile(p, 2), 2) == pytest.approx(p, rel=1e-5)


def test_knots_and_large_table_lookup_agree(spark, data, model, monkeypatch):
    pdf, df = data
    probe = df.withColumn("x2", F.col("x") + 0.03)
    small = JT.interpolate_knots(probe, model.knots, {"u": ("x", "x2")}).select("id", F.round("u", 9)).orderBy("id").collect()
    monkeypatch.setattr(JT, "_curves", lambda *a: None)
    large = JT.interpolate_knots(probe, model.knots, {"u": ("x", "x2")}).select("id", F.round("u", 9)).orderBy("id").collect()
    assert small == large
    a = pdf[pdf.grade == "a"]
    want = np.interp(a.x + 0.03, *midranks(a.x))
    got = dict(small)
    assert np.allclose([got[i] for i in a.id], want)


def lw_corr(z):
    n, k = z.shape
    x = z - z.mean(axis=0)
    emp = x.T @ x / n
    mu = np.trace(emp) / k
    beta = ((np.square(x).sum(axis=1) ** 2).sum() / n - (emp**2).sum()) / (k * n)
    delta = ((emp - mu * np.eye(k)) ** 2).sum() / k
    s = min(beta, delta) / delta
    c = (1 - s) * emp + s * mu * np.eye(k)
    d = np.sqrt(np.diag(c))
    return c / np.outer(d, d)


def test_correlation_and_likelihood_match_brute_force(spark, data, model):
    pdf, df = data
    a = pdf[pdf.grade == "a"].reset_index(drop=True)
    z = np.column_stack([ppf(spark, np.clip(np.interp(a[c], *midranks(a[c])), 1e-6, 1 - 1e-6)) for c in "xyw"])
    want = lw_corr(z)
    row = model.corr.filter("grade = 'a'").first()
    assert np.allclose(np.array(row.corr).reshape(3, 3), want, atol=1e-9)
    inv = np.linalg.inv(want)
    ll = -0.5 * np.linalg.slogdet(want)[1] - 0.5 * (np.einsum("ij,jk,ik->i", z, inv, z) - (z**2).sum(axis=1))
    for c in "xyw":
        v = a[c].to_numpy()
        bw = 1.06 * v.std(ddof=1) * len(v) ** -0.2
        k = np.exp(-0.5 * ((v[:, None] - v[None, :]) / bw) ** 2).sum(axis=1) / (len(v) * bw * math.sqrt(2 * math.pi))
        ll += np.log(k)
    got = {r.id: r.loglik for r in JT.log_likelihood(df, model).collect()}
    assert np.allclose([got[i] for i in a.id], ll, atol=1e-4)


def test_conditional_bounds_match_brute_force(spark, data, model):
    pdf, df = data
    rows = df.filter("grade = 'a'").limit(4)
    got = JT.conditional_bounds(rows, model, "y", step=0.01).toPandas()
    a = pdf[pdf.grade == "a"]
    corr = np.array(model.corr.filter("grade = 'a'").first().corr).reshape(3, 3)
    inv = np.linalg.inv(corr)
    q1, q9 = np.quantile(a.y, [0.01, 0.99])
    span = max(q9 - q1, 1.0)
    grid = q1 - 0.05 * span + 0.01 * np.arange(int((q9 - q1 + 0.1 * span) / 0.01 + 1e-9) + 1)
    v = a.y.to_numpy()
    bw = 1.06 * v.std(ddof=1) * len(v) ** -0.2
    lm = np.log(np.exp(-0.5 * ((grid[:, None] - v) / bw) ** 2).sum(axis=1))
    zs = ppf(spark, np.clip(np.interp(grid, *midranks(a.y)), 1e-6, 1 - 1e-6))
    for _, r in got.iterrows():
        zx, zw = (float(ppf(spark, np.clip(np.interp([r[c]], *midranks(a[c])), 1e-6, 1 - 1e-6))[0]) for c in "xw")
        zz = np.column_stack([np.full_like(zs, zx), zs, np.full_like(zs, zw)])
        lp = -0.5 * (np.einsum("ij,jk,ik->i", zz, inv, zz) - (zz**2).sum(axis=1)) + lm
        p = np.exp(lp - lp.max())
        cdf = np.concatenate([[0], np.cumsum((p[1:] + p[:-1]) / 2 * np.diff(grid))])
        lo, hi = np.interp([0.1, 0.9], cdf / cdf[-1], grid)
        assert (r.y_low, r.y_high, r.y_mode) == pytest.approx((lo, hi, grid[p.argmax()]), abs=2e-3)


def test_many_grades_use_the_joined_grid(data, model, monkeypatch):
    rows = data[1].filter("id < 6")
    one = JT.conditional_bounds(rows, model, "y").orderBy("id").collect()
    monkeypatch.setattr(JT, "TABLE_CELLS", 1)
    assert JT.conditional_bounds(rows, model, "y").orderBy("id").collect() == one


def test_samples_and_conditionals_follow_the_fit(spark, data, model):
    s = JT.sample_joint(model, spark, 3000, seed=5).filter("grade = 'a'").toPandas()
    a = data[0][data[0].grade == "a"]
    assert len(s) == 3000
    assert s[["x", "y"]].corr(method="spearman").iloc[0, 1] == pytest.approx(a[["x", "y"]].corr(method="spearman").iloc[0, 1], abs=0.06)
    rows = data[1].filter("id in (1, 2)")
    summ = JT.conditional_summary(rows, model, ["y"], ["x", "w"], ["id"]).toPandas()
    assert ((summ.q05 < summ.q50) & (summ.q50 < summ.q95)).all()
    d = JT.conditional_draws(rows, model, ["y"], ["x", "w"], ["id"], 2000, 3).groupBy("id").agg(F.avg("y").alias("m")).toPandas()
    both = summ.merge(d, on="id")
    assert np.allclose(both["mean"], both["m"], atol=0.03)


def test_feasibility_rejects_gaps_and_small_grades_get_no_model(spark, data, model):
    bad = spark.createDataFrame([("a", 50.0, None, 0.0, 1)], "grade string, x double, y double, w double, id int")
    with pytest.raises(Exception, match="missing values in y"):
        JT.feasibility(bad, model, ["id"]).collect()
    with pytest.raises(ValueError, match="not enough"):
        JT.require_model(JT.fit_joint(data[1], ["x", "y"], min_rows=300), ["b"])


def test_t_copula_picks_degrees_of_freedom(data):
    model, table = JT.fit_t_copula(data[1], ["x", "y", "w"], nu_grid=(2, 5, 50), min_rows=100)
    best = {r.grade: r.nu for r in model.corr.collect()}
    assert best["a"] == 50 and table.count() == 6
    q = JT.t_conditional_quantiles(data[1].limit(5), model, "y", ["x", "w"]).toPandas()
    assert ((q.q05 < q.q50) & (q.q50 < q.q95)).all()


def test_density_curve(data):
    pdf, df = data
    got = JT.density_curve(df, "y", points=50).orderBy("i").toPandas()
    v = pdf.y.to_numpy()
    bw = 0.2 * v.std(ddof=1)
    want = np.exp(-0.5 * ((got["at"].to_numpy()[:, None] - v) / bw) ** 2).sum(axis=1) / (len(v) * bw * math.sqrt(2 * math.pi))
    assert np.allclose(got.density, want)
    assert got.p500.iloc[0] == pytest.approx(np.median(v))
    assert sizing.BROADCAST_ROWS > 0


def test_density_in_a_gap_follows_the_nearest_value_on_each_side(spark):
    pdf = pd.DataFrame({"grade": "a", "id": range(6000), "x": [float(v) for v in [0, 1, 2, 98, 99, 100] for _ in range(1000)]})
    pdf["y"] = np.random.default_rng(5).normal(size=len(pdf))
    model = JT.fit_joint(spark.createDataFrame(pdf), ["x", "y"], min_rows=100)
    # A narrower kernel, as on far more rows, leaves a gap that none of the values reaches into.
    model.bands = model.bands.withColumns({"bandwidth": F.lit(1.0), "origin": F.col("lowest") - 11.0})
    probe = spark.createDataFrame([("a", float(v)) for v in (30, 45, 50, 55, 70, -30, 130)], "grade string, x double")
    got = {r.x: r.l for r in JT.log_marginals(probe, model, {"l": ("x", "x")}).collect()}
    values = np.array([0, 1, 2, 98, 99, 100.0])
    for x, have in got.items():
        parts = np.log(1000) - 0.5 * (x - values) ** 2
        want = np.logaddexp.reduce(parts) - math.log(6000 * math.sqrt(2 * math.pi))
        assert have == pytest.approx(want, abs=1e-6)


def test_points_of_a_sweep_stay_in_their_row(spark, monkeypatch):
    from reelcost.operators import scenario as SC

    knots = spark.range(30_000).selectExpr("'g' AS grade", "'x' AS variable", "CAST(id AS DOUBLE) AS x", "id / 30000 AS u")
    assert len(JT._curves(knots, "grade", "x", "u")["g", "x"][0]) == 30_000
    rows = spark.range(160).selectExpr("id", "IF(id % 2 = 0, 'a', 'b') AS grade", "CAST(id % 13 + IF(id = 158, 90, 0) AS DOUBLE) AS x", "CAST(id % 13 + id % 7 AS DOUBLE) AS y")
    model = JT.fit_joint(rows, ["x", "y"], min_rows=50)
    sweep = lambda: SC.sweep_control(rows, model, "x", ["id"], lambda g: 2 * g("x"), lambda g: g("x") + g("y"), 9.0, steps=6, likelihood_weight=3.0, step=0.5)
    assert "explode(sequence" not in sweep()._jdf.queryExecution().analyzed().toString()
    one = sweep().orderBy("id").toPandas()
    monkeypatch.setattr(SC, "likelihood_along", lambda *a: None)
    two = sweep().orderBy("id").toPandas()
    assert (one["feasible"] == two["feasible"]).all() and one["loglik"].notna().all()
    for c in ("low", "high", "control_best", "objective", "loglik"):
        assert np.allclose(one[c], two[c], rtol=1e-9, atol=1e-9)


def test_points_of_a_sweep_are_compared_in_arrays(spark, monkeypatch):
    """No lambda function runs over the points, and missing values and NaN come where ranks have them."""
    from reelcost.operators import scenario as SC

    rows = spark.range(120).selectExpr("id", "IF(id % 9 = 8, 'none', 'a') AS grade", "CAST(id % 13 AS DOUBLE) AS x", "CAST(id % 13 + id % 7 AS DOUBLE) AS y")
    model = JT.fit_joint(rows.filter("grade = 'a'"), ["x", "y"], min_rows=50)
    odd = lambda g: F.when(F.col("id") % 5 == 1, F.lit(None)).when((F.col("id") % 5 == 2) & (g("x") > 6), F.lit(float("nan"))).otherwise(g("x"))
    strength = lambda g: F.when((F.col("id") % 7 == 3) & (g("x") > 5), F.lit(None)).when((F.col("id") % 7 == 4) & (g("x") > 5), F.lit(float("nan"))).otherwise(g("x"))
    for steps, options in ((6, {"closeness": 0.5}), (6, {"maximise_strength": True}), (300, {"likelihood_weight": 2.0})):
        swept = SC.sweep_control(rows, model, "x", ["id"], lambda g: -2 * odd(g), strength, 4.0, steps=steps, step=0.5, **options)
        plan = swept._jdf.queryExecution().optimizedPlan().toString()
        assert "transform(" not in plan and "explode(" not in plan
        with monkeypatch.context() as m:
            m.setattr(SC, "likelihood_along", lambda *a: None)
            # Every point a row of its own, its likelihood of no weight if there is none.
            other = SC.sweep_control(rows, model, "x", ["id"], lambda g: -2 * odd(g), strength, 4.0, steps=steps, step=0.5, **{"likelihood_weight": 1e-300} | options)
            want = {r.id: r for r in other.collect()}
        got = {r.id: r for r in swept.collect()}
        assert len(got) == len(want) == 120 and any(r.control_best is None for r in got.values()) and any(r.feasible for r in got.values())
        for i, r in got.items():
            assert r.feasible == want[i].feasible
            for c in ("low", "high", "control_best", "strength", "cost", "objective"):
                assert (r[c] is None) == (want[i][c] is None) and (r[c] is None or r[c] == pytest.approx(want[i][c], rel=1e-9, abs=1e-9, nan_ok=True)), (options, i, c)


def test_many_knots_go_to_the_rows_of_their_grade(spark, data, model, monkeypatch):
    """Rows are not sorted with the knots, and a row's points are no rows of their own."""
    pdf, df = data
    gaps = df.withColumns({"grade": F.when(F.col("id") % 50 != 7, F.when(F.col("id") % 50 != 9, F.col("grade")).otherwise("none")), "y": F.when(F.col("id") % 50 != 11, F.col("y"))})
    fit = JT.fit_t_copula(df, ["x", "y", "w"], min_rows=100)[0]

    def results():
        summary = JT.conditional_summary(gaps, model, ["x", "w"], ["y"], ["id"])
        draws = JT.conditional_draws(gaps, model, ["x", "w"], ["y"], ["id"], 3, 1)
        tails = JT.t_conditional_quantiles(gaps, fit, "x", ["y", "w"]).select("id", "q05", "q50", "q95")
        spread = TC.t_conditional_summary(gaps, fit, "x", ["y"], ["id"])
        got = [summary.orderBy("target", "id"), draws.orderBy("id", "draw"), tails.orderBy("id"), spread.orderBy("id")]
        return [g.toPandas() for g in got]

    small = results()
    assert small[0]["mean"].isna().any() and small[1]["x"].isna().any()
    monkeypatch.setattr(JT, "CURVE_KNOTS", 5)
    monkeypatch.setattr(JT, "neighbours", lambda *a: pytest.fail("rows are sorted with the knots"))
    for a, b in zip(small, results()):
        pd.testing.assert_frame_equal(a, b, rtol=1e-9)
    refit = JT.fit_t_copula(df, ["x", "y", "w"], min_rows=100)[0]
    a, b = (np.array([r[0] for r in m.corr.orderBy("grade").select("corr").collect()]) for m in (fit, refit))
    assert np.allclose(a, b)


def test_more_knots_than_a_task_may_hold(spark, data, model, monkeypatch):
    pdf, df = data
    want = JT.conditional_summary(df, model, ["x"], ["y"], ["id"]).orderBy("id").toPandas()
    monkeypatch.setattr(JT, "CURVE_KNOTS", 5)
    monkeypatch.setattr(JT, "TASK_KNOTS", 5)
    pd.testing.assert_frame_equal(want, JT.conditional_summary(df, model, ["x"], ["y"], ["id"]).orderBy("id").toPandas(), rtol=1e-6)
