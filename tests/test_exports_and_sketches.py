import numpy as np
import pytest
from pyspark.sql import functions as F

from reelcost.operators import sketches as SK
from reelcost.sources import files as S

HEAD = ["Time\tflow of", "\tpump", "\tsteam", "\tx", "\tl/min\t\tbar"]


def write(path, tags, rows):
    path.write_text("\n".join([*HEAD, "\t" + "\t".join(tags), *rows]) + "\n")


def test_exports_of_different_tags_across_splits(spark, tmp_path):
    rows = [f"2024-01-01 00:{m // 60:02d}:{m % 60:02d}\t{m}\t{m / 2}\t{-m}" for m in range(900)]
    write(tmp_path / "a.tsv", ["A", "B", "A"], rows)
    write(tmp_path / "b.tsv", ["C", "A"], ["2024-02-01 00:00:00\t7", "2024-02-01 00:01:00\tx\t8\t9", "", "broken"])
    (tmp_path / "c.tsv").write_text("one\ntwo\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "2048")
    try:
        df, meta = S.read_wrapped_headers(spark, str(tmp_path))
        got = df.withColumn("file", F.substring_index("file", "/", -1)).collect()
        tags = {(r.file.rsplit("/", 1)[-1], r.tag, r.unit, r.description) for r in meta.collect()}
    finally:
        spark.conf.set(key, before)
    assert df.columns[:2] == ["file", "Time"] and sorted(df.columns[2:]) == ["A", "A__1", "B", "C"]
    a = sorted((r.A, r.B, r.A__1, r.C) for r in got if r.file == "a.tsv")
    assert a == [(float(m), m / 2, float(-m), None) for m in range(900)]
    b = [(r.Time is None, r.C, r.A, r.B) for r in got if r.file == "b.tsv"]
    assert sorted(b, key=str) == sorted([(False, 7.0, None, None), (False, None, 8.0, None), (True, None, None, None), (True, None, None, None)], key=str)
    assert ("b.tsv", "C", "l/min", "flow of") in tags and ("a.tsv", "A__1", "bar", "steam") in tags and not [t for t in tags if t[0] == "c.tsv"]


def test_no_header_is_an_error(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("one\ntwo\n")
    with pytest.raises(ValueError, match="header lines"):
        S.read_wrapped_headers(spark, str(tmp_path))


def test_unique_names():
    assert S.unique_names(["a", " a", "", "b", "a", ""]) == ["a", "a__1", "Unnamed", "b", "a__2", "Unnamed__1"]
    assert S.unique_names([]) == []


def test_merged_sketches_keep_their_bounds(spark):
    rng = np.random.default_rng(3)
    n = 30_000
    grade = np.where(rng.random(n) < 0.7, "hot", "b")
    x = np.round(rng.lognormal(size=n), 2)
    rows = [(str(g), int(i % 12), None if i % 50 == 0 else float(v), int(v * 10)) for i, (g, v) in enumerate(zip(grade, x))]
    df = spark.createDataFrame([*rows, ("empty", 0, None, None)], "grade string, month int, x double, part long").repartition(7)
    k, names = 512, {"a": ("x", 0.05), "b": ("x", 0.5), "c": ("x", 0.98), "low": ("x", 0.0), "high": ("x", 1.0)}
    stored = SK.sketch_measures(df, ["grade", "month"], ["x"], ["part"], k)
    answers = SK.sketch_answers(SK.merge_sketches(stored, ["grade"], k), ["grade"], names, {"parts": "part"})
    got = {r.grade: r for r in SK.rank_interval(df, answers, ["grade"], names).collect()}
    for g in ("hot", "b"):
        held = np.array([r[2] for r in rows if r[0] == g and r[2] is not None])
        r = got[g]
        assert r.n_rows == sum(q[0] == g for q in rows) and (r.low, r.high) == (held.min(), held.max())
        for name, (_, p) in names.items():
            below, upto = (held < r[name]).mean(), (held <= r[name]).mean()
            assert r[f"{name}_error"] == pytest.approx(max(0.0, below - p, p - upto))
            assert r[f"{name}_error"] <= 3 * SK.rank_error(k)
        exact = len({q[3] for q in rows if q[0] == g})
        assert abs(r.parts - exact) <= 3 * SK.distinct_error() * exact
    assert got["empty"].n_rows == 1 and got["empty"].b is None and got["empty"].parts == 0
