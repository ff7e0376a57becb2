"""Small fixtures for semantics that the SQL checks do not reach, and the combined flows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reelcost.operators import attribution as AT
from reelcost.operators import clusters as CL
from reelcost.operators import derive as B
from reelcost.operators import drilldown as D
from reelcost.operators import filters as FL
from reelcost.operators import joint as JT
from reelcost.operators import scenario as SC
from reelcost.operators import tags as A
from reelcost.operators import timeseries as TS
from reelcost.plans import flows
from reelcost.queries import base, catalogue
from reelcost.sources import files as S


def test_wrapped_header_file(spark, tmp_path):
    lines = ["Time\tflow of", "\tpump", "\tsteam", "\tx", "\tl/min\t\tbar", "\tA\tB\tA"]
    rows = ["2024-01-01 00:00:00\t1.5\tx\t3", "bad\t2", "2024-01-01 00:02:00\t4\t5\t6\t7"]
    (tmp_path / "t.tsv").write_text("\n".join(lines + rows))
    df, meta = S.read_wrapped_header(spark, str(tmp_path / "t.tsv"))
    assert df.columns == ["Time", "A", "B", "A__1"]
    got = sorted((r.A, r.B, r.A__1) for r in df.collect() if r.A != 2)
    assert got == [(1.5, None, 3.0), (4.0, 5.0, 6.0)] and df.filter("Time is null").count() == 1
    assert [(m.tag, m.unit) for m in meta.collect()] == [("Time", "datetime"), ("A", "l/min"), ("B", ""), ("A__1", "bar")]


def test_array_series_explode(spark):
    s = spark.createDataFrame([("t1", [1, 2], [0.5, 0.7], "bar")], "TagName string, TimeStamp array<int>, Value array<double>, Units string")
    assert [tuple(r) for r in A.explode_series(s).collect()] == [(1, "t1", 0.5, "bar"), (2, "t1", 0.7, "bar")]


def test_feature_order_and_missing_inputs(spark):
    assert B.feature_order(["water_flow", "fibre_weight"]) == ["water_flow_predryer", "water_flow_afterdryer", "water_flow", "starch_uptake", "fibre_weight"]
    assert B.raw_inputs(["inv_rod_pressure_top"]) == ["rod_pressure_top"]
    df = spark.createDataFrame([(1.0,)], "starch_top double")
    with pytest.raises(ValueError, match="starch_bottom"):
        B.create_features(df, ["starch_uptake"])
    assert B.create_features(df, ["starch_uptake"], errors="ignore").columns == ["starch_top"]


def test_grade_of_one_period_goes_to_the_mix(spark):
    rows = [("a", "historic", 10.0, 1), ("a", "current", 10.0, 2), ("b", "current", 30.0, 3)]
    df = spark.createDataFrame(rows, "grade string, period string, total double, reel_id int")
    e = D.mix_effect(df, "total").first()
    assert (e.mix_effect, e.cost_effect) == pytest.approx((10.0, 0.0)) and e.reconciliation_sum == pytest.approx(e.total_change)


def test_ks_of_same_and_disjoint_samples(spark):
    df = spark.range(200).select((F.col("id") % 50).cast("double").alias("x"), (F.col("id") < 100).alias("s"))
    one = CL.ks_two_sample(df, "x", F.col("s")).first()
    assert one.statistic == 0 and one.p_value == 1
    apart = CL.ks_two_sample(df.withColumn("x", F.col("x") + F.when(F.col("s"), 100).otherwise(0)), "x", F.col("s"), blocks=4).first()
    assert apart.statistic == 1 and apart.p_value < 1e-6


def test_adjusted_rand(spark):
    df = spark.range(30).select((F.col("id") % 3).alias("a"), ((F.col("id") + 1) % 3).alias("b"))
    assert CL.adjusted_rand(df, "a", "b") == pytest.approx(1.0)


def test_shapley_variants_agree(spark):
    pairs = spark.createDataFrame([("g", 1.0, 3.0, 2.0, 5.0, 4.0, 4.0)], "grade string, a_1 double, a_2 double, b_1 double, b_2 double, c_1 double, c_2 double")
    cost = lambda g: g("a") * g("b") + g("c")
    exact = {r.variable: r.contribution for r in AT.shapley_exact(pairs, ["grade"], ["a", "b", "c"], cost).collect()}
    assert exact == pytest.approx({"a": 7.0, "b": 6.0, "c": 0.0})
    drawn = {r.variable: r.contribution for r in AT.shapley_sampled(pairs, ["grade"], ["a", "b", "c"], cost, 400).collect()}
    assert sum(drawn.values()) == pytest.approx(13.0) and drawn["a"] == pytest.approx(7.0, abs=0.3)
    with pytest.raises(ValueError):
        AT.shapley_exact(pairs, ["grade"], list("abcdefghijklmnop"), cost)


def test_unknown_mode_and_missing_value(spark):
    df = spark.createDataFrame([(None, 2.0)], "x double, y double")
    got = SC.apply_changes(df, [SC.Change("x", "delta", 1), SC.Change("y", "relative", 0.5)]).first()
    assert (got.x, got.y, got.skipped) == (None, 3.0, ["x"])
    with pytest.raises(ValueError, match="unknown mode"):
        SC.apply_changes(df, [SC.Change("x", "double", 1)])


def test_diagnosis_and_what_if(spark, sf):
    rows = base.reel_lines(spark, sf)
    got = flows.diagnosis(rows, base.TARGET_RANGE, base.BASELINE_RANGE, base.COMPONENTS, "total_cost", ["Brand#1", "Brand#2"])
    levels = {r["level"] for r in got["levels"].select("level").distinct().collect()}
    assert levels == {0, 1, 2, 3}
    e = got["effects"].first()
    assert e.reconciliation_sum == pytest.approx(e.total_change)
    one = rows.filter("grade in ('Brand#1', 'Brand#2')")
    res = flows.what_if(
        one, one, [SC.Change("qty", "relative", 3.0)], lambda g: 2 * g("qty"), ["qty"], ["reel_id", "line_no"], ["qty", "grammage"], min_rows=20, step=0.5
    )
    assert res.filter("scenario_prediction > 2 * qty_high + 1e-6 or qty_high < qty_low").isEmpty() and not res.isEmpty()


def test_registered_names_match(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 200
    assert not e.entry(spark).isEmpty()


def test_time_decayed_mean_outlasts_long_gaps(spark):
    start = pd.Timestamp("2024-01-01")
    minutes = [0, 1, 2, 119, 121, 300, 5000, 5001]
    values = [1.0, 2.0, 1.5, None, None, None, None, 4.0]
    pdf = pd.DataFrame({"m": 1, "id": range(len(minutes)), "ts": [start + pd.Timedelta(minutes=m) for m in minutes], "g": "x"})
    df = spark.createDataFrame(pdf).join(spark.createDataFrame(list(enumerate(values)), "id long, v double"), "id")
    out = TS.segment_ewm(df, ["m"], ["ts", "id"], "g", "v", half_life_minutes=1.0, max_gap_hours=1000.0)
    got = {r.id: r.ewm for r in out.collect()}
    for i in range(1, len(minutes)):
        seen = [(2.0 ** ((m - minutes[i])), v) for m, v in zip(minutes[: i + 1], values) if v is not None]
        top = max(m for m, v in zip(minutes[: i + 1], values) if v is not None)
        w = [2.0 ** (m - top) for m, v in zip(minutes[: i + 1], values) if v is not None]
        assert got[i] == pytest.approx(sum(a * v for a, (_, v) in zip(w, seen)) / sum(w), rel=1e-12)


def test_windows_are_open_and_may_span_days(spark):
    t = lambda s: pd.Timestamp(s)
    df = spark.createDataFrame(pd.DataFrame({"id": range(5), "ts": [t("2024-01-01 23:00"), t("2024-01-02 00:00"), t("2024-01-03 05:00"), t("2024-01-04 00:00"), t("2024-01-05")]}))
    stops = spark.createDataFrame(pd.DataFrame({"start": [t("2024-01-01 23:00")], "end": [t("2024-01-04 00:00")]}))
    assert sorted(r.id for r in FL.exclude_windows(df, stops).collect()) == [0, 3, 4]
    assert FL.exclude_windows(df, stops.limit(0)).count() == 5


def test_sweep_keeps_rows_without_bounds(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"grade": "a", "id": range(300), "x": rng.normal(size=300), "y": rng.normal(size=300)})
    df = spark.createDataFrame(pdf)
    model = JT.fit_joint(df, ["x", "y"], min_rows=100)
    rows = df.filter("id < 3").unionByName(spark.createDataFrame([("new", 900, 0.0, 0.0)], "grade string, id long, x double, y double"))
    best = SC.sweep_control(rows, model, "x", ["id"], lambda c: c("x") * 2, lambda c: c("x") + 100, 0.0, steps=4)
    got = {r.id: r for r in best.collect()}
    assert set(got) == {0, 1, 2, 900}
    assert got[900].feasible is False and got[900].cost is None
    assert all(got[i].feasible and got[i].control_best == got[i].low for i in (0, 1, 2))


def test_cluster_queries_read_all_grades(spark, sf):
    queries = catalogue()[0]
    lines = {r["grade"]: r["count"] for r in base.reel_lines(spark, sf).groupBy("grade").count().collect()}
    assert len(lines) > 1
    assert {r["grade"]: r["count"] for r in queries["pls_scores_of_grade"](spark, sf).groupBy("grade").count().collect()} == lines
    rows = {r["grade"]: r["count"] for r in base.labelled(spark, sf).groupBy("grade").count().collect()}
    for name in ("mixture_with_min_size", "operating_state_clusters"):
        found = {}
        for r in queries[name](spark, sf).collect():
            found[r["grade"]] = found.get(r["grade"], 0) + r["n"]
        assert found == rows, name
    criteria = queries["mixture_selection_criteria"](spark, sf)
    assert {r["grade"] for r in criteria.select("grade").distinct().collect()} == set(rows) and criteria.agg(F.max("k")).first()[0] == 10


def test_mismatch_runs_across_blocks_sort_the_rows_once(spark):
    import random

    from reelcost.operators import reels as W

    rnd = random.Random(5)
    rows = [("ab"[i % 2], i, rnd.choice([10.0, 20.0, None]) if rnd.random() < 0.3 else 10.0, 10 if (i // 40) % 2 else 20) for i in range(400)]
    df = spark.createDataFrame(rows, "m string, t long, cat double, gram int")
    out = W.mismatch_runs(W.smooth_isolated(df, "cat", "gram", ["m"], ["t"], 6), "cat", "gram", ["m"], ["t"], 6)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = {}
    for m in "ab":
        own, smooth = [r for r in rows if r[0] == m], []
        for i, (_, _, c, g) in enumerate(own):
            p = own[i - 1][2] if i else None
            smooth.append(p if p is not None and c is not None and c != p and c != g else c)
        wrong = [c != float(r[3]) for c, r in zip(smooth, own)]
        for i, r in enumerate(own):
            a = next((j + 1 for j in range(i, -1, -1) if wrong[j] != wrong[i]), 0)
            z = next((j for j in range(i, len(own)) if wrong[j] != wrong[i]), len(own))
            want[r[1]] = (smooth[i], wrong[i], i == 0 or own[i - 1][3] != r[3], z - a if wrong[i] else 0, i - a + 1 if wrong[i] else 0)
    assert {r.t: (r.cat, r.mismatch, r.new_batch, r.run_length, r.run_pos) for r in out.collect()} == want


def test_segment_mean_in_blocks_reads_its_input_a_few_times(spark):
    start = pd.Timestamp("2024-01-01")
    n = 600
    pdf = pd.DataFrame({"m": [i % 3 for i in range(n)], "id": range(n), "ts": [start + pd.Timedelta(hours=i + 15 * (i // 90)) for i in range(n)], "g": [i // 200 for i in range(n)], "v": [float(i * 7 % 11) for i in range(n)]})
    plain = spark.createDataFrame(pdf).repartition(2)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = plain.mapInArrow(counted, plain.schema)
    args = (["m"], ["ts", "id"], "g", "v")
    # Slices of 60 minutes and of 7,200, of which segments fill many or are a part.
    for half in (1.0, 120.0):
        read.value = 0
        got = {r.id: (r.segment, r.ewm) for r in TS.segment_ewm(df, *args, half_life_minutes=half, blocks=3).collect()}
        assert read.value <= 4 * n
        want = {r.id: (r.segment, r.ewm) for r in TS.segment_ewm(plain, *args, half_life_minutes=half, blocks=1).collect()}
        assert len(want) == n and got.keys() == want.keys()
        for i, (segment, ewm) in want.items():
            assert got[i][0] == segment and got[i][1] == pytest.approx(ewm, rel=1e-12)
