"""Imputation, outliers, reel shaping and ordered windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core.session import load
from ..operators import derive as B
from ..operators import impute as C
from ..operators import reels as W
from ..operators import timeseries as TS
from .base import TIES, events, query, reel_lines, rounded, with_reels

KEYS = ["reel_id", "line_no", "part_id", "supp_id"]
K = ", ".join(KEYS)
ORDER = ["ts", *TIES]
OB = "ORDER BY ts, reel_id, line_no, part_id, supp_id"


@query(
    "values_outside_limits_imputed",
    with_reels(f""", m AS (SELECT grade, median(qty) AS mq, median(tax_cost) AS mt FROM reels GROUP BY grade)
 SELECT {K}, CASE WHEN qty BETWEEN 5 AND 40 THEN qty ELSE mq END AS qty, round(CASE WHEN tax_cost BETWEEN 1 AND 100 THEN tax_cost ELSE mt END + 1e-9, 6) AS tax_cost FROM reels JOIN m USING (grade)"""),
)
def _(spark, sf):
    out = C.impute_outside_limits(reel_lines(spark, sf), {"qty": (5, 40), "tax_cost": (1, 100)})
    return rounded(out.select(*KEYS, "qty", "tax_cost"), "tax_cost", nudge=1e-9)


@query(
    "limits_imputed_keeping_missing",
    with_reels(f""", r AS (SELECT *, nullif(qty, 13) AS q FROM reels), m AS (SELECT grade, median(q) AS mq FROM r GROUP BY grade)
 SELECT {K}, CASE WHEN q < 5 OR q > 40 THEN mq ELSE q END AS q FROM r JOIN m USING (grade)"""),
)
def _(spark, sf):
    df = reel_lines(spark, sf).withColumn("q", F.nullif("qty", F.lit(13.0)))
    return C.impute_outside_limits(df, {"q": (5, 40)}, null_is_bad=False).select(*KEYS, "q")


@query(
    "missing_filled_with_group_median",
    with_reels(f""", r AS (SELECT *, nullif(qty, 13) AS q FROM reels), m AS (SELECT grade, median(q) AS mq FROM r GROUP BY grade) SELECT {K}, coalesce(q, mq) AS q FROM r JOIN m USING (grade)"""),
)
def _(spark, sf):
    df = reel_lines(spark, sf).withColumn("q", F.nullif("qty", F.lit(13.0)))
    return C.fill_with_group_median(df, ["q"]).select(*KEYS, "q")


_MAD = """m AS (SELECT event_type AS g, median(value) AS med FROM events GROUP BY 1), d AS (SELECT e.*, abs(value - med) AS dev FROM events e JOIN m ON e.event_type = m.g),
 k AS (SELECT event_type AS g, median(dev) AS mad FROM d GROUP BY 1)"""


@query("robust_z_outliers_by_group", f"WITH {_MAD} SELECT event_id, coalesce(0.6745 * dev / nullif(mad, 0) > 3.5, false) AS outlier FROM d JOIN k ON d.event_type = k.g")
def _(spark, sf):
    return C.flag_robust_z(events(spark, sf), "value", by=["event_type"]).select("event_id", "outlier")


@query(
    "robust_z_outliers_global",
    "WITH m AS (SELECT median(value) AS med FROM events), d AS (SELECT *, abs(value - med) AS dev FROM events, m), k AS (SELECT median(dev) AS mad FROM d) SELECT event_id, 0.6745 * dev / mad > 3.5 AS outlier FROM d, k",
)
def _(spark, sf):
    return C.flag_robust_z(events(spark, sf), "value").select("event_id", "outlier")


_QUART = "q AS (SELECT {g} AS g, quantile_cont(value, {lo}) AS lo, quantile_cont(value, {hi}) AS hi FROM events GROUP BY 1)"


@query(
    "iqr_outliers_by_group",
    f"WITH {_QUART.format(g='event_type', lo=0.25, hi=0.75)} SELECT event_id, value < lo - 1.5 * (hi - lo) OR value > hi + 1.5 * (hi - lo) AS outlier FROM events JOIN q ON event_type = g",
)
def _(spark, sf):
    return C.flag_iqr(events(spark, sf), "value", ["event_type"]).select("event_id", "outlier")


@query(
    "iqr_outliers_global_two_pass",
    f"WITH {_QUART.format(g='1', lo=0.25, hi=0.75)} SELECT event_id, value < lo - 1.5 * (hi - lo) OR value > hi + 1.5 * (hi - lo) AS outlier FROM events, q",
)
def _(spark, sf):
    from ..core.quantiles import group_quantiles
    from ..core.sizing import join_stats

    e = events(spark, sf)
    q = group_quantiles(e, [], {"lo": (F.col("value"), 0.25), "hi": (F.col("value"), 0.75)}, two_pass=True, accuracy=200)
    pad = 1.5 * (F.col("hi") - F.col("lo"))
    flag = (F.col("value") < F.col("lo") - pad) | (F.col("value") > F.col("hi") + pad)
    return join_stats(e, q, []).select("event_id", flag.alias("outlier"))


for _name, _share in (("percentile_clip_outliers", 0.01), ("strict_percentile_clip_outliers", 0.001)):

    @query(
        _name,
        f"WITH {_QUART.format(g='1', lo=_share, hi=1 - _share)} SELECT event_id, value < lo OR value > hi AS outlier FROM events, q",
    )
    def _(spark, sf, share=_share):
        return C.flag_percentile_clip(events(spark, sf), "value", share).select("event_id", "outlier")


_ROLL = """b AS (SELECT event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn, event_type FROM events),
 w AS (SELECT a.event_id, any_value(a.value) AS v, any_value(a.rn) AS rn, list(c.value) AS vals FROM b a JOIN b c ON a.event_type = c.event_type AND c.rn BETWEEN a.rn - 10 AND a.rn GROUP BY a.event_id),
 s AS (SELECT *, list_aggregate(vals, 'median') AS med FROM w),
 z AS (SELECT *, list_aggregate(list_transform(vals, lambda x: abs(x - med)), 'median') AS mad FROM s)"""


@query(
    "rolling_robust_z_outliers",
    f"WITH {_ROLL} SELECT event_id, rn >= 11 AND CASE WHEN mad > 0 THEN 0.6745 * abs(v - med) / mad > 3.5 ELSE abs(v - med) > 0 END AS outlier FROM z",
)
def _(spark, sf):
    out = C.flag_rolling_robust_z(events(spark, sf), "value", 11, ["event_type"], ["ts", "event_id"])
    return out.select("event_id", "outlier")


@query(
    "hampel_outliers",
    """WITH b AS (SELECT event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn, event_type FROM events),
 m AS (SELECT a.event_id, a.event_type, a.rn, abs(a.value - CASE WHEN count(c.value) = 24 THEN median(c.value) END) AS dev FROM b a JOIN b c ON a.event_type = c.event_type AND c.rn BETWEEN a.rn - 12 AND a.rn + 11
  GROUP BY a.event_id, a.event_type, a.rn, a.value),
 k AS (SELECT a.event_id, a.dev, CASE WHEN count(c.dev) = 24 THEN median(c.dev) END AS mad FROM m a JOIN m c ON a.event_type = c.event_type AND c.rn BETWEEN a.rn - 12 AND a.rn + 11 GROUP BY a.event_id, a.dev)
 SELECT event_id, coalesce(dev / (1.4826 * nullif(mad, 0)) > 3, false) AS outlier FROM k""",
)
def _(spark, sf):
    return C.flag_hampel(events(spark, sf), "value", ["event_type"], ["ts", "event_id"]).select("event_id", "outlier")


def flagged(spark, sf):
    return events(spark, sf).withColumn("bad", F.col("value") > 60)


@query("flagged_imputed_by_median", "SELECT event_id, CASE WHEN value > 60 THEN (SELECT median(value) FROM events WHERE value <= 60) ELSE value END AS value FROM events")
def _(spark, sf):
    return C.impute_flagged(flagged(spark, sf), "value", "bad").select("event_id", "value")


@query(
    "flagged_imputed_by_group_median",
    "WITH m AS (SELECT event_type AS g, median(value) AS med FROM events GROUP BY 1) SELECT event_id, CASE WHEN value > 60 THEN med ELSE value END AS value FROM events JOIN m ON event_type = g",
)
def _(spark, sf):
    return C.impute_flagged(flagged(spark, sf), "value", "bad", "median_by_group", "event_type").select("event_id", "value")


@query(
    "flagged_imputed_by_last_value",
    "SELECT event_id, last_value(CASE WHEN value <= 60 THEN value END IGNORE NULLS) OVER (ORDER BY ts, event_id) AS value FROM events",
)
def _(spark, sf):
    return C.impute_flagged(flagged(spark, sf), "value", "bad", "ffill", order=["ts", "event_id"]).select("event_id", "value")


@query("flagged_imputed_by_constant", "SELECT event_id, CASE WHEN value > 60 THEN 1.5 ELSE value END AS value FROM events")
def _(spark, sf):
    return C.impute_flagged(flagged(spark, sf), "value", "bad", "constant", value=1.5).select("event_id", "value")


_GAPPY = "g AS (SELECT event_id, ts, event_type, CASE WHEN user_id % 4 = 0 THEN value END AS a, CASE WHEN user_id % 7 = 0 THEN value END AS b FROM events)"


def gappy(spark, sf):
    e = events(spark, sf)
    return e.select(
        "event_id", "ts", "event_type", F.when(F.col("user_id") % 4 == 0, F.col("value")).alias("a"), F.when(F.col("user_id") % 7 == 0, F.col("value")).alias("b")
    )


_FF = "last_value({c} IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id)"
_BF = "first_value({c} IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
for _how, _a in (("ffill", _FF), ("bfill", _BF), ("both", f"coalesce({_FF}, {_BF})")):

    @query(f"filled_in_order_{_how}", f"WITH {_GAPPY} SELECT event_id, {_a.format(c='a')} AS a, {_a.format(c='b')} AS b FROM g")
    def _(spark, sf, how=_how):
        return C.fill_in_order(gappy(spark, sf), ["a", "b"], ["event_type"], ["ts", "event_id"], how).select("event_id", "a", "b")


@query("forward_filled_in_blocks", f"WITH {_GAPPY} SELECT event_id, {_FF.format(c='a')} AS a, {_FF.format(c='b')} AS b FROM g")
def _(spark, sf):
    return C.fill_in_order(gappy(spark, sf), ["a", "b"], ["event_type"], ["ts", "event_id"], "ffill", blocks=9).select("event_id", "a", "b")


@query(
    "grade_rules_replaced_by_mean",
    with_reels(f""", r AS (SELECT *, nullif(qty, 13) AS q FROM reels), m1 AS (SELECT grade, avg(q) AS m FROM r GROUP BY grade),
 s AS (SELECT r.*, CASE WHEN (r.grade = 'Brand#1' AND q > 40) OR (r.grade = 'Brand#2' AND q < 10) THEN m ELSE q END AS q1 FROM r JOIN m1 ON r.grade = m1.grade),
 m2 AS (SELECT grade, avg(q1) AS m FROM s GROUP BY grade)
 SELECT {K}, round(CASE WHEN s.grade IN ('Brand#1', 'Brand#2') THEN coalesce(q1, m2.m) ELSE 0 END, 6) AS q FROM s JOIN m2 ON s.grade = m2.grade"""),
)
def _(spark, sf):
    df = reel_lines(spark, sf).withColumn("q", F.nullif("qty", F.lit(13.0)))
    return rounded(C.replace_by_grade_rules(df, "q", {"Brand#1": F.col("q") > 40, "Brand#2": F.col("q") < 10}).select(*KEYS, "q"), "q")


@query(
    "range_kept_else_grade_mean",
    with_reels(f", m AS (SELECT grade, avg(qty) AS mean FROM reels GROUP BY grade) SELECT {K}, round(CASE WHEN qty BETWEEN 10 AND 30 THEN qty ELSE mean END, 6) AS qty FROM reels JOIN m USING (grade)"),
)
def _(spark, sf):
    return rounded(C.keep_range_else_group_mean(reel_lines(spark, sf), "qty", 10, 30).select(*KEYS, "qty"), "qty")


@query("template_of_medians", "SELECT median(l_quantity) AS l_quantity, median(l_extendedprice) AS l_extendedprice, 0.0::DOUBLE AS absent FROM lineitem")
def _(spark, sf):
    return C.template_row(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "absent"])


_TURN = f"""q2 AS (SELECT *, row_number() OVER (PARTITION BY reel_id ORDER BY ts DESC, line_no DESC, part_id DESC, supp_id DESC) AS r, count(*) OVER (PARTITION BY reel_id) AS c, avg(tax_cost) OVER (PARTITION BY reel_id) AS mt FROM reels),
 t AS (SELECT {K}, ts, qty, grammage, mt FROM q2 WHERE r = least(2, c))"""


@query("turnup_rows_last", with_reels(f", {_TURN} SELECT {K}, qty, round(mt + 1e-9, 6) AS tax_cost FROM t"))
def _(spark, sf):
    df = reel_lines(spark, sf).select(*ORDER, "qty", "tax_cost")
    return rounded(W.turnup_rows(df, ["qty"], ["tax_cost"], order=ORDER).select(*KEYS, "qty", "tax_cost"), "tax_cost", nudge=1e-9)


@query("turnup_rows_median", with_reels("SELECT reel_id, median(qty) AS qty, round(avg(tax_cost) + 1e-9, 6) AS tax_cost FROM reels GROUP BY reel_id"))
def _(spark, sf):
    return rounded(W.turnup_rows(reel_lines(spark, sf), ["qty", "tax_cost"], ["tax_cost"], "median"), "tax_cost", nudge=1e-9)


_UNIQ = f"{_TURN}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qty, grammage ORDER BY ts, reel_id) AS k FROM t) WHERE k = 1)"


def _split(spark, sf):
    df = reel_lines(spark, sf).select(*ORDER, "qty", "grammage")
    turn = W.turnup_rows(df, ["qty"], order=ORDER)
    return W.split_turnup_continuous(df, turn, ["qty", "grammage"])


@query("turnup_unique_by_quality", with_reels(f", {_UNIQ} SELECT reel_id, qty, grammage FROM u"))
def _(spark, sf):
    return _split(spark, sf)[0].select("reel_id", "qty", "grammage")


@query("continuous_rows_of_unique_reels", with_reels(f", {_UNIQ} SELECT {K} FROM reels WHERE reel_id IN (SELECT reel_id FROM u)"))
def _(spark, sf):
    return _split(spark, sf)[1].select(*KEYS)


@query("dropped_duplicate_reels", with_reels(f", {_UNIQ} SELECT reel_id FROM t WHERE reel_id NOT IN (SELECT reel_id FROM u)"))
def _(spark, sf):
    return _split(spark, sf)[2].select("reel_id")


_SNAP = """sn AS (SELECT *, CASE WHEN least(abs(qty - 10), abs(qty - 20), abs(qty - 30), abs(qty - 40)) <= 3 THEN
 CASE least(abs(qty - 10), abs(qty - 20), abs(qty - 30), abs(qty - 40)) WHEN abs(qty - 10) THEN 10.0 WHEN abs(qty - 20) THEN 20.0 WHEN abs(qty - 30) THEN 30.0 ELSE 40.0 END ELSE CAST(gram AS DOUBLE) END AS cat
 FROM (SELECT *, CAST(floor(grammage / 10) * 10 AS INT) AS gram, CAST(CAST(3000 + part_id % 3 AS INT) * 1000 + CAST(floor(grammage / 10) * 10 AS INT) AS VARCHAR) AS grade_id FROM reels) x)"""
_RUNS = f"""{_SNAP}, sm AS (SELECT *, CASE WHEN p IS NOT NULL AND cat <> p AND cat <> gram THEN p ELSE cat END AS c2 FROM (SELECT *, lag(cat) OVER (PARTITION BY machine {OB}) AS p FROM sn) y),
 mm AS (SELECT *, c2 <> gram AS mismatch, row_number() OVER (PARTITION BY machine {OB}) AS rn FROM sm),
 ch AS (SELECT *, (lag(mismatch) OVER (PARTITION BY machine ORDER BY rn)) IS DISTINCT FROM mismatch AS chg, (lag(gram) OVER (PARTITION BY machine ORDER BY rn)) IS DISTINCT FROM gram AS new_batch FROM mm),
 ru AS (SELECT *, sum(CAST(chg AS INT)) OVER (PARTITION BY machine ORDER BY rn) AS run FROM ch),
 rl AS (SELECT *, CASE WHEN mismatch THEN count(*) OVER (PARTITION BY machine, run) ELSE 0 END AS run_length, CASE WHEN mismatch THEN row_number() OVER (PARTITION BY machine, run ORDER BY rn) ELSE 0 END AS run_pos FROM ru),
 cl AS (SELECT *, CASE WHEN NOT mismatch THEN 'match' WHEN new_batch AND run_pos = 1 THEN 'batch_start_ok' WHEN run_length >= 3 THEN 'grammage_wrong' ELSE 'check' END AS grammage_check FROM rl)"""


def grammage_rows(spark, sf):
    df = reel_lines(spark, sf).select("machine", "ts", *KEYS, "qty", "grammage")
    gram = (F.floor(F.col("grammage") / 10) * 10).cast("int")
    return df.withColumns(
        {"gram": gram, "grade_id": ((F.lit(3000) + F.col("part_id") % 3) * 1000 + gram).cast("string")}
    ).drop("grammage")


TARGETS = [10, 20, 30, 40]


@query("grammage_snapped_to_targets", with_reels(f", {_SNAP} SELECT {K}, cat FROM sn"))
def _(spark, sf):
    return grammage_rows(spark, sf).select(*KEYS, W.snap_to_targets("qty", TARGETS, 3, "gram").alias("cat"))


@query("isolated_categories_smoothed", with_reels(f", {_RUNS} SELECT {K}, c2 AS cat FROM sm"))
def _(spark, sf):
    df = grammage_rows(spark, sf).withColumn("cat", W.snap_to_targets("qty", TARGETS, 3, "gram"))
    return W.smooth_isolated(df, "cat", "gram", ["machine"], ORDER).select(*KEYS, "cat")


_RUNCOLS = [*KEYS, "mismatch", "new_batch", "run_length", "run_pos", "grammage_check"]


def _runs(spark, sf, blocks=None):
    df = grammage_rows(spark, sf).withColumn("cat", W.snap_to_targets("qty", TARGETS, 3, "gram"))
    sm = W.smooth_isolated(df, "cat", "gram", ["machine"], ORDER, blocks)
    return W.mismatch_runs(sm, "cat", "gram", ["machine"], ORDER, blocks).withColumn("grammage_check", W.grammage_check())


@query("grammage_mismatch_runs", with_reels(f", {_RUNS} SELECT {', '.join(_RUNCOLS)} FROM cl"))
def _(spark, sf):
    return _runs(spark, sf).select(*_RUNCOLS)


@query("grammage_mismatch_runs_in_blocks", with_reels(f", {_RUNS} SELECT {', '.join(_RUNCOLS)} FROM cl"))
def _(spark, sf):
    return _runs(spark, sf, blocks=5).select(*_RUNCOLS)


@query(
    "grade_ids_repaired",
    with_reels(f""", {_RUNS}, se AS (SELECT grade_id AS g, min((ts, reel_id, line_no, part_id, supp_id)) AS f FROM cl GROUP BY 1),
 s1 AS (SELECT left(g, 4) AS h, right(g, 3) AS t, arg_min(g, f) AS same FROM se GROUP BY ALL), s2 AS (SELECT right(g, 3) AS t, arg_min(g, f) AS anyg FROM se GROUP BY ALL),
 wr AS (SELECT *, grammage_check IN ('grammage_wrong', 'batch_start_ok') AS wrong, lpad(CAST(CAST(c2 AS INT) AS VARCHAR), 3, '0') AS t FROM cl)
 SELECT {K}, CASE WHEN wrong THEN coalesce(same, anyg, left(grade_id, length(grade_id) - 3) || wr.t) ELSE grade_id END AS grade_id, CASE WHEN wrong THEN CAST(c2 AS INT) ELSE gram END AS gram
 FROM wr LEFT JOIN s1 ON s1.h = left(grade_id, 4) AND s1.t = wr.t LEFT JOIN s2 ON s2.t = wr.t"""),
)
def _(spark, sf):
    out = W.repair_grammage(grammage_rows(spark, sf), "qty", "gram", TARGETS, ["machine"], ORDER, tolerance=3, fix_batch_start=True)
    return out.select(*KEYS, "grade_id", "gram")


@query(
    "break_edge_reels",
    with_reels(f"""SELECT DISTINCT reel_id FROM (SELECT reel_id, line_no - 4 AS code, qty * 2 AS power, lag(line_no - 4) OVER (PARTITION BY machine {OB}) AS p, lead(qty * 2) OVER (PARTITION BY machine {OB}) AS n FROM reels)
 WHERE (code = 0 AND p <> 0) OR (power > 95 AND n < 50)"""),
)
def _(spark, sf):
    df = reel_lines(spark, sf).withColumns({"code": F.col("line_no") - 4, "power": F.col("qty") * 2})
    df = df.withColumn("power", F.when(F.col("power").between(50, 95), 50.0).otherwise(F.col("power")))
    return W.break_edges(df, "code", "power", "reel_id", ["machine"], ORDER)


@query(
    "measures_kept_at_transitions",
    with_reels(f"SELECT {K}, CASE WHEN n IS DISTINCT FROM grade THEN qty END AS qty FROM (SELECT *, lead(grade) OVER (PARTITION BY machine {OB}) AS n FROM reels)"),
)
def _(spark, sf):
    return W.keep_at_transitions(reel_lines(spark, sf), ["qty"], "grade", ["machine"], ORDER).select(*KEYS, "qty")


@query("bounds_per_column", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity <= 45 THEN l_quantity END AS l_quantity, CASE WHEN l_tax <= 0.06 AND l_tax >= 0.01 THEN l_tax END AS l_tax FROM lineitem")
def _(spark, sf):
    df = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    return B.null_beyond(df, ["l_quantity", "l_tax"], low={"l_tax": 0.01}, high=[45, 0.06])


@query("resampled_means", "SELECT event_type, CAST(time_bucket(INTERVAL '6 hours', ts) AS TIMESTAMP) AS bin, round(avg(value), 6) AS value FROM events GROUP BY ALL")
def _(spark, sf):
    return rounded(TS.resample_mean(events(spark, sf), "ts", "6 HOURS", ["value"], ["event_type"]), "value")


@query(
    "resampled_means_with_empty_bins",
    """WITH b AS (SELECT user_id, CAST(time_bucket(INTERVAL '1 day', ts) AS TIMESTAMP) AS bin, round(avg(value), 6) AS value FROM events GROUP BY ALL),
 e AS (SELECT user_id, unnest(generate_series(min(bin), max(bin), INTERVAL 1 DAY)) AS bin FROM b GROUP BY user_id) SELECT user_id, CAST(e.bin AS TIMESTAMP) AS bin, value FROM e LEFT JOIN b USING (user_id, bin)""",
)
def _(spark, sf):
    return rounded(TS.resample_mean(events(spark, sf), "ts", "1 DAY", ["value"], ["user_id"], fill_gaps=True), "value")


_SEG = """sg AS (SELECT *, sum(CAST(st AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM (
 SELECT *, lag(ts) OVER w IS NULL OR lag(CAST(value > 60 AS INT)) OVER w IS DISTINCT FROM CAST(value > 60 AS INT) OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 12 * 3600000000 AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) x)"""


def graded_events(spark, sf):
    return events(spark, sf).withColumn("g", (F.col("value") > 60).cast("int"))


@query("segments_by_grade_and_gap", f"WITH {_SEG} SELECT event_id, CAST(segment AS BIGINT) AS segment FROM sg")
def _(spark, sf):
    df = graded_events(spark, sf).select("event_id", "user_id", "ts", "g")
    return TS.segments(df, ["user_id"], ["ts", "event_id"], "g").select("event_id", "segment")


_EWM = f"""WITH {_SEG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, segment ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id, segment) AS c, lead(value) OVER (PARTITION BY user_id, segment ORDER BY ts, event_id) AS nx FROM sg),
 e AS (SELECT a.event_id, any_value(a.k) AS k, any_value(a.c) AS c, any_value(a.value) AS v, any_value(a.nx) AS nx, sum(b.value * pow(0.5, (epoch_us(a.ts) - epoch_us(b.ts)) / 7200000000.0)) / sum(pow(0.5, (epoch_us(a.ts) - epoch_us(b.ts)) / 7200000000.0)) AS m
 FROM r a JOIN r b ON a.user_id = b.user_id AND a.segment = b.segment AND b.k <= a.k GROUP BY a.event_id)
 SELECT event_id, round(CASE WHEN k = 1 AND c >= 2 THEN (v + nx) / 2 ELSE m END, 6) AS ewm FROM e"""


@query("segment_time_decayed_mean", _EWM)
def _(spark, sf):
    df = graded_events(spark, sf).select("event_id", "user_id", "ts", "g", "value")
    out = TS.segment_ewm(df, ["user_id"], ["ts", "event_id"], "g", "value")
    return rounded(out.select("event_id", "ewm"), "ewm")


@query(
    "lagged_design",
    """SELECT * FROM (SELECT event_id, value, user_id, lag(user_id, 2) OVER w AS user_id_lag2, user_id AS user_id_lag0, lag(value, 1) OVER w AS value_lag1, lag(value, 3) OVER w AS value_lag3
 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) WHERE user_id_lag2 IS NOT NULL AND value_lag3 IS NOT NULL""",
)
def _(spark, sf):
    out = TS.lag_design(events(spark, sf), ["event_type"], ["ts", "event_id"], "value", ["user_id"], [0, 2], [1, 3])
    return out.select("event_id", "value", "user_id", "user_id_lag2", "user_id_lag0", "value_lag1", "value_lag3")


@query("chronological_split", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) <= floor(0.8 * (SELECT count(*) FROM events)) AS is_train FROM events")
def _(spark, sf):
    return TS.chronological_split(events(spark, sf).select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "is_train")


@query(
    "time_ordered_folds",
    """SELECT event_id, CAST(greatest(0, floor((rn - 1 - (n - 5 * (n // 6))) / (n // 6)) + 1) AS INT) AS test_fold FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events)""",
)
def _(spark, sf):
    return TS.time_folds(events(spark, sf).select("event_id", "ts"), ["ts", "event_id"], 5).select("event_id", "test_fold")


_RSTAT = """SELECT a.event_type, a.ts, count(*) AS n, round(avg(b.value) + 1e-9, 6) AS mean, round(stddev_samp(b.value), 5) AS std, round(median(b.value), 6) AS median,
 round(quantile_cont(b.value, 0.025), 6) AS p_low, round(quantile_cont(b.value, 0.975), 6) AS p_high FROM events a JOIN events b ON a.event_type = b.event_type AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 7 DAY
 GROUP BY ALL"""


@query("rolling_lab_statistics", _RSTAT)
def _(spark, sf):
    out = TS.rolling_stats(events(spark, sf), "event_type", "ts", "value", 7 * 86400)
    return rounded(rounded(rounded(out, "median", "p_low", "p_high"), "mean", nudge=1e-9), "std", digits=5)


@query("first_differences", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id), 6) AS value FROM events")
def _(spark, sf):
    out = TS.first_differences(events(spark, sf), ["value"], ["event_type"], ["ts", "event_id"])
    return rounded(out.select("event_id", "value"), "value")


@query(
    "change_points_nulled_and_back_filled",
    """WITH c AS (SELECT *, CASE WHEN (lag(g) OVER w IS DISTINCT FROM g) AND abs(value - lag(value, 2) OVER w) < abs(value - lead(value) OVER w) THEN NULL ELSE value END AS v
 FROM (SELECT *, CAST(value > 60 AS INT) AS g FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
 SELECT event_id, first_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM c""",
)
def _(spark, sf):
    part, order = ["event_type"], ["ts", "event_id"]
    nulled = W.change_point_nulling(graded_events(spark, sf), "value", "g", part, order)
    return C.fill_in_order(nulled, ["value"], part, order, "bfill").select("event_id", "value")


@query(
    "scaled_to_group_range",
    "SELECT event_id, round((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 6) AS value_scaled, round(max(value) OVER w - min(value) OVER w, 6) AS value_range FROM events WINDOW w AS (PARTITION BY event_type)",
)
def _(spark, sf):
    out = TS.scale_to_range(events(spark, sf).select("event_id", "event_type", "value"), ["value"], ["event_type"])
    return rounded(out.select("event_id", "value_scaled", "value_range"), "value_scaled", "value_range")


@query("group_size_and_mean", "SELECT event_id, count(*) OVER w AS group_size, round(avg(value) OVER w, 6) AS value_mean FROM events WINDOW w AS (PARTITION BY user_id)")
def _(spark, sf):
    out = TS.group_size_and_mean(events(spark, sf), ["user_id"], ["value"])
    return rounded(out.select("event_id", "group_size", "value_mean"), "value_mean")
