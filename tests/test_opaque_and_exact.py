"""Opaque models, their sampled SHAP values, and the exact two-sample test."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reelcost.core.session import ship_package
from reelcost.functions.kolmogorov import exact_p
from reelcost.operators import attribution as AT
from reelcost.operators import clusters as CL
from reelcost.operators import opaque as OP


def test_exact_p_against_all_orders():
    for n, m in itertools.product(range(1, 7), range(1, 7)):
        far = []
        for chosen in itertools.combinations(range(n + m), n):
            i = j = d = 0
            for k in range(n + m):
                i, j = (i + 1, j) if k in chosen else (i, j + 1)
                d = max(d, abs(i * m - j * n))
            far.append(d)
        for d in {0, *far}:
            assert exact_p(n, m, d / (n * m)) == pytest.approx(sum(x >= d for x in far) / len(far), abs=1e-12)
    assert exact_p(10_000, 9_999, 0.02) == pytest.approx(0.0359, abs=5e-4)


def test_p_value_is_exact_for_small_samples_and_the_series_beyond(spark):
    ship_package(spark)
    df = spark.range(40).select((F.col("id") * 7 % 31).cast("double").alias("x"), (F.col("id") % 3 == 0).alias("a"), (F.col("id") % 2).alias("g"))
    exact = {r["g"]: r for r in CL.ks_two_sample(df, "x", F.col("a"), ["g"]).collect()}
    series = {r["g"]: r for r in CL.ks_two_sample(df, "x", F.col("a"), ["g"], exact_rows=3).collect()}
    for g in (0, 1):
        assert exact[g]["p_value"] == pytest.approx(exact_p(exact[g]["n_a"], exact[g]["n_b"], exact[g]["statistic"]))
        assert exact[g]["p_value"] != series[g]["p_value"] and abs(exact[g]["p_value"] - series[g]["p_value"]) < 0.25
    assert CL.ks_two_sample(df.filter("a"), "x", F.col("a")).first()["p_value"] is None


@pytest.fixture(scope="module")
def steps():
    # Tasks can't import this module, so the loader is a function of a function.
    return lambda: lambda x: np.where(x[:, 0] > 0.5, 10.0, 0.0) + np.where((x[:, 1] > 0) & (x[:, 0] > 0), 4.0, 1.0) + x[:, 2]


@pytest.fixture(scope="module")
def rows(spark):
    ship_package(spark)
    r = np.random.default_rng(9)
    pdf = pd.DataFrame({"grade": np.where(np.arange(240) % 6 == 0, "few", "many"), "id": range(240), "a": r.normal(size=240), "b": r.normal(size=240), "c": r.normal(size=240)})
    return pdf, spark.createDataFrame(pdf).repartition(3)


def test_opaque_predictions(spark, rows, steps):
    pdf, df = rows
    gap = df.unionByName(spark.createDataFrame([("few", 900, None, 1.0, 1.0)], df.schema))
    got = {r["id"]: r["p"] for r in OP.predict_opaque(gap, {"p": (OP.OpaqueModel("steps", steps), ["a", "b", "c"]), "q": (OP.OpaqueModel("first", lambda: lambda x: x[:, 0]), ["c"])}).collect()}
    want = steps()(pdf[["a", "b", "c"]].to_numpy())
    assert np.allclose([got[i] for i in range(240)], want) and got[900] is None
    assert OP.predict_opaque(df.limit(0), {"p": (OP.OpaqueModel("steps", steps), ["a", "b", "c"])}).count() == 0


def test_opaque_shap_adds_up_and_matches_the_expression_form(rows, steps):
    pdf, df = rows
    model = OP.OpaqueModel("steps", steps)
    out = AT.opaque_shap(df, ["id"], ["a", "b", "c"], model, permutations=12, min_background=60).toPandas()
    assert len(out) == 3 * 240 and set(out["variable"]) == {"a", "b", "c"}
    sums = out.groupby("id").agg(prediction=("prediction", "first"), base=("base_value", "first"), shap=("shap", "sum"))
    assert np.allclose(sums["prediction"] - sums["base"], sums["shap"])
    assert np.allclose(sums["prediction"].sort_index(), steps()(pdf[["a", "b", "c"]].to_numpy()))
    # An additive model has the same values in any order, so both forms agree on the same pairs.
    linear = OP.OpaqueModel("linear", lambda: lambda x: 2 * x[:, 0] - 3 * x[:, 1])
    one = AT.opaque_shap(df, ["id"], ["a", "b"], linear, seed=4).toPandas().set_index(["id", "variable"])["shap"]
    two = AT.sampled_shap(df, ["id"], ["a", "b"], lambda g: 2 * g("a") - 3 * g("b"), seed=4).toPandas().set_index(["id", "variable"])["shap"]
    assert np.allclose(one.sort_index(), two.sort_index())


def test_draws_of_shap_values_stay_in_their_row(spark):
    rows = spark.range(50).selectExpr("id", "'g' AS grade", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 5 AS DOUBLE) AS b")
    one = AT.sampled_shap(rows, ["id"], ["a", "b"], lambda g: g("a") * g("b"), permutations=4)
    two = AT.opaque_shap(rows, ["id"], ["a", "b"], OP.OpaqueModel("product", lambda: lambda x: x[:, 0] * x[:, 1]), permutations=4)
    for out in (one, two):
        assert "explode(" not in out._jdf.queryExecution().toString()
    means = two.groupBy("id").agg(F.sum("shap").alias("s"), F.first("base_value").alias("base"), F.first("prediction").alias("p")).collect()
    assert len(means) == 50 and all(abs(r.p - r.base - r.s) < 1e-9 and r.p == (r.id % 7) * (r.id % 5) for r in means)


def test_each_draw_of_a_sampled_shap_value_has_its_own_order(spark):
    rows = spark.range(400).selectExpr("id", "'g' AS grade", "IF(id < 8, 2.0D, 0.0D) AS a", "IF(id < 8, 3.0D, 0.0D) AS b", "0.0D AS c")
    for features in (["a", "b"], ["b", "a", "c"]):
        out = AT.sampled_shap(rows, ["id"], features, lambda g: g("a") * g("b"), background=400, permutations=400)
        got = out.filter("id < 8").groupBy("id").pivot("variable").sum("shap").collect()
        # Along one order a or b would have all of it.
        assert len(got) == 8 and all(2.4 < r.a < 3.6 and 2.4 < r.b < 3.6 and 5.3 < r.a + r.b <= 6.0 for r in got)
        assert len({round(r.a - r.b, 9) for r in got}) > 1
    places = spark.range(5).select(*[AT._places(n, F.xxhash64("id")).alias(f"p{n}") for n in (1, 3, 7)]).collect()
    assert all(sorted(r[i]) == list(range(n)) for r in places for i, n in enumerate((1, 3, 7)))
