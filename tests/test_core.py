"""Block-wise primitives give the same answers as plain windows and exact aggregates."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reelcost.core import ordered as O
from reelcost.core.quantiles import group_quantiles
from reelcost.core.session import load
from reelcost.core.sizing import join_stats, pin_if_small


def skewed(spark, n=4000, seed=3):
    """A third of the rows share one key, and one time stamp is very frequent."""
    rng = np.random.default_rng(seed)
    k = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 9, n))
    t = rng.integers(0, 500, n)
    t[rng.random(n) < 0.3] = 250
    x = np.where(rng.random(n) < 0.2, None, np.round(rng.normal(size=n), 2))
    pdf = pd.DataFrame({"k": k, "t": t, "i": np.arange(n), "x": x})
    return spark.createDataFrame(pdf, "k int, t int, i long, x double")


def same(a, b, cols):
    pa = a.select(*cols).toPandas().sort_values(cols).reset_index(drop=True)
    pb = b.select(*cols).toPandas().sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(pa, pb, check_dtype=False)


def test_blocks_never_decrease_along_the_order(spark):
    df = O.with_blocks(skewed(spark), ["t", "i"], 16).orderBy("t", "i").toPandas()
    assert (df[O.BLK].diff().dropna() >= 0).all()
    assert df[O.BLK].nunique() > 10
    assert df[df.t == 250][O.BLK].nunique() > 2
    assert df.groupby(O.BLK).size().max() < len(df) / 5


@pytest.mark.parametrize("part", [["k"], []])
def test_running_sum_and_row_index(spark, part):
    df = skewed(spark)
    w = Window.partitionBy(*part).orderBy("t", "i")
    plain = df.select("i", F.row_number().over(w).alias("rn"), F.sum(F.coalesce("x", F.lit(0.0))).over(w).alias("s"))
    cut = O.running_sums(df, part, ["t", "i"], {"s": F.col("x"), "rn": F.lit(1)}, blocks=11)
    same(plain.withColumn("s", F.round("s", 6)), cut.withColumn("s", F.round("s", 6)), ["i", "rn", "s"])


@pytest.mark.parametrize("part", [["k"], []])
def test_fills_across_blocks(spark, part):
    df = skewed(spark)
    one = O.neighbours(df, part, ["t", "i"], {"a": F.col("x")}, {"b": F.col("x")}, blocks=1)
    many = O.neighbours(df, part, ["t", "i"], {"a": F.col("x")}, {"b": F.col("x")}, blocks=13)
    same(one, many, ["i", "a", "b"])


def test_bounded_frames_copy_enough_rows(spark):
    df = skewed(spark)

    def exprs(w):
        return {"l2": F.lag("x", 2).over(w), "n1": F.lead("x").over(w), "m": F.count("x").over(w.rowsBetween(-5, 3))}

    one = O.bounded_frames(df, ["k"], ["t", "i"], 5, 3, exprs, blocks=1)
    many = O.bounded_frames(df, ["k"], ["t", "i"], 5, 3, exprs, blocks=7, block_rows=40)
    same(one, many, ["i", "l2", "n1", "m"])
    with pytest.raises(ValueError):
        O.bounded_frames(df, ["k"], ["t", "i"], 50, 0, exprs, blocks=7, block_rows=40)


def test_time_frames_in_slices(spark):
    df = skewed(spark).withColumn("ts", F.timestamp_seconds(F.col("t") * 60))
    exprs = lambda w: {"n": F.count("x").over(w), "med": F.percentile("x", F.lit(0.5)).over(w)}
    same(O.time_frames(df, ["k"], "ts", 1800, exprs, 1), O.time_frames(df, ["k"], "ts", 1800, exprs, 5), ["i", "n", "med"])


@pytest.mark.parametrize("by", [["k"], []])
@pytest.mark.parametrize("accuracy", [20, 100, 20000])
def test_two_pass_quantiles_are_exact(spark, by, accuracy):
    df = skewed(spark)
    specs = {"q10": (F.col("x"), 0.1), "med": (F.col("x"), 0.5), "q99": (F.col("x"), 0.99), "hi": (F.col("t"), 1.0), "lo": (F.col("t"), 0.0)}
    one = group_quantiles(df, by, specs, two_pass=False)
    two = group_quantiles(df, by, specs, two_pass=True, accuracy=accuracy)
    cols = [*by, *specs]
    r = lambda d: d.select(*by, *[F.round(c, 9).alias(c) for c in specs])
    same(r(one), r(two), cols)


def test_two_pass_quantiles_keep_groups_without_values(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0), (None, 4.0)], "k int, x double")
    got = {r.k: r.m for r in group_quantiles(df, ["k"], {"m": (F.col("x"), 0.5)}, two_pass=True).collect()}
    assert got == {1: None, 2: 3.0, None: 4.0}


def test_bounded_fetch_and_shuffle_join_agree(spark):
    df = skewed(spark)
    stats = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert pin_if_small(stats, 100)[1] and not pin_if_small(stats, 3)[1]
    same(join_stats(df, stats, ["k"]), join_stats(df, stats, ["k"], max_rows=3), ["i", "k", "n"])


def test_top_rows_trims_before_the_shuffle(spark):
    df = skewed(spark)
    top = O.top_rows(df, ["k"], [F.desc("t"), F.desc("i")], 2)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert top.groupBy("k").count().filter("count <> 2").isEmpty()


def test_load_turns_nan_into_null(spark, tmp_path):
    spark.createDataFrame([(float("nan"),), (1.0,)], "x double").write.parquet(f"{tmp_path}/t.parquet")
    assert sorted(r.x is None for r in load(spark, str(tmp_path), "t").collect()) == [False, True]


def test_small_groups_of_a_large_table_keep_no_sketch(spark, monkeypatch):
    from reelcost.core import quantiles as Q

    bracketed = Q._bracketed
    monkeypatch.setattr(Q, "is_small", lambda df: False)
    monkeypatch.setattr(Q, "_bracketed", lambda *a: pytest.fail("a sketch for each small group"))
    df = spark.range(300).selectExpr("id % 100 AS g", "CAST(id AS DOUBLE) AS v")
    assert {r.g: r.m for r in Q.group_medians(df, ["g"], {"m": F.col("v")}).collect()} == {g: g + 100.0 for g in range(100)}
    monkeypatch.setattr(Q, "_bracketed", bracketed)
    monkeypatch.setattr(Q, "GROUP_ROWS", 2)
    mixed = spark.createDataFrame([(None, 5.0), (0, 1.0), (0, 2.0), (0, 9.0), (1, 4.0), (None, 6.0), (2, None), (2, None), (2, None)], "g int, v double")
    assert {r.g: r.m for r in Q.group_medians(mixed, ["g"], {"m": F.col("v")}).collect()} == {None: 5.5, 0: 2.0, 1: 4.0, 2: None}
