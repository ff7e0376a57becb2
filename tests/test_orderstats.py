"""Order statistics of moving windows against sorting each window."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from reelcost.core import orderstats as OS
from reelcost.operators import impute as IM
from reelcost.operators import timeseries as TS


def test_windows_against_sorting():
    r = np.random.default_rng(0)
    for _ in range(200):
        n = int(r.integers(1, 40))
        v, weights = np.round(r.normal(size=n), int(r.integers(0, 3))), r.integers(1, 4, n)
        low = r.integers(0, n, 20)
        high = np.array([r.integers(a + 1, n + 1) for a in low])
        k = np.array([r.integers(0, b - a) for a, b in zip(low, high)])
        w, x = OS.Windows(v), r.normal(size=20).round(1)
        assert (w.kth(low, high, k) == [np.sort(v[a:b])[c] for a, b, c in zip(low, high, k)]).all()
        assert (w.below(low, high, x) == [(v[a:b] <= y).sum() for a, b, y in zip(low, high, x)]).all()
        got = OS.Windows(v, weights).quantile(low, high, 0.3)
        assert np.allclose(got, [np.quantile(np.repeat(v[a:b], weights[a:b]), 0.3) for a, b in zip(low, high)])
        med = OS.medians(w, low, high)
        assert np.allclose(med, [np.median(v[a:b]) for a, b in zip(low, high)])
        assert (OS.median_deviations(w, low, high, med) == [np.median(abs(v[a:b] - c)) for a, b, c in zip(low, high, med)]).all()


def test_time_does_not_grow_with_the_window():
    v = np.random.default_rng(1).normal(size=60_000)
    took = []
    for width in (100, 10_000):
        start = time.process_time()
        high = np.arange(width, len(v) + 1)
        w = OS.Windows(v)
        OS.median_deviations(w, high - width, high, OS.medians(w, high - width, high))
        took.append(time.process_time() - start)
    assert took[1] < 4 * took[0]


def series(spark, n=400):
    r = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": [None if i % 50 == 7 else "ab"[i % 2] for i in range(n)], "id": range(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(r.integers(0, 200, n), unit="min"), "v": np.round(r.normal(size=n), 1)})
    pdf.loc[r.random(n) < 0.02, "v"] = np.nan
    pdf.loc[::37, "v"] = 9.0
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).withColumn("n", F.lit("x"))
    return pdf, df.repartition(3)


def test_rolling_robust_z_against_each_window(spark):
    pdf, df = series(spark)
    for window, block in ((7, 100_000), (10, 16), (5, 1)):
        got = {r["id"]: r["outlier"] for r in IM.flag_rolling_robust_z(df, "v", window, ["k"], ["id"], block_rows=block).collect()}
        want = {}
        for _, g in pdf.groupby("k", dropna=False):
            g = g.sort_values("id")
            for j, (i, v) in enumerate(zip(g["id"], g["v"])):
                part = g["v"].to_numpy()[max(0, j - window + 1) : j + 1]
                want[i] = False
                if len(part) == window and not np.isnan(part).any():
                    med = np.median(part)
                    mad = np.median(abs(part - med))
                    want[i] = bool(0.6745 * abs(v - med) / mad > 3.5 if mad > 0 else abs(v - med) > 0)
        assert got == want and any(want.values())
    assert IM.flag_rolling_robust_z(df.limit(0), "v", 5, ["k"], ["id"]).count() == 0


def test_rolling_statistics_against_each_window(spark):
    pdf, df = series(spark)
    got = {(r["k"], r["ts"]): r for r in TS.rolling_stats(df, "k", "ts", "v", 1800).collect()}
    own = pdf.dropna(subset=["v"])
    keys = set()
    for k, g in own.groupby("k", dropna=False):
        for t in set(g["ts"]):
            x = g[(g["ts"] <= t) & (g["ts"] > t - pd.Timedelta(minutes=30))]["v"].to_numpy()
            r = got[None if pd.isna(k) else k, t.to_pydatetime()]
            keys.add((r["k"], r["ts"]))
            assert r["n"] == len(x) and np.isclose(r["mean"], x.mean()) and np.isclose(r["median"], np.median(x))
            assert np.isclose(r["p_low"], np.quantile(x, 0.025)) and np.isclose(r["p_high"], np.quantile(x, 0.975))
            assert r["std"] is None if len(x) < 2 else np.isclose(r["std"], x.std(ddof=1), atol=1e-9)
    assert keys == set(got)


def test_levels_hold_no_more_than_they_need():
    w = OS.Windows(np.arange(1000.0), np.ones(1000, int))
    assert all(count.dtype == np.int32 and weight is count for count, weight, _ in w.levels)
    w = OS.Windows(np.arange(4.0), np.array([1, 2**31, 1, 1]))
    assert w.kth([0], [4], [2**31]).tolist() == [1.0] and w.kth([0], [4], [2**31 + 1]).tolist() == [2.0]
