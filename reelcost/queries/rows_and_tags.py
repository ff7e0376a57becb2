"""Sources, tag tables, filters, joins and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core.session import load
from ..operators import filters as R
from ..operators import relate as J
from ..operators import tags as A
from ..operators.periods import BASELINE, TARGET
from ..sources import files as S
from .base import events, labelled, query, reel_lines, rounded, with_labels, with_reels


@query(
    "monthly_files_union",
    """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(CASE WHEN strftime(o_orderdate, '%Y-%m') >= '2000-03' THEN o_custkey END) AS n_cust
 FROM orders GROUP BY 1""",
)
def _(spark, sf):
    # Files before a month lack a column, and the list names a month without a file.
    o = load(spark, sf, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    root = S.scratch_path(spark, "months")
    S.write_parquet(o.filter("month < '2000-03'").drop("o_custkey"), root, ["month"])
    o.filter("month >= '2000-03'").write.mode("append").partitionBy("month").parquet(root)
    months = [r["month"] for r in o.select("month").distinct().collect()]
    back = S.read_months(spark, root, ["1990-01", *sorted(months)])
    out = back.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.count("o_custkey").alias("n_cust"))
    return rounded(out, "total", digits=2)


@query("pruned_column_read", "SELECT l_orderkey, l_shipdate, l_quantity FROM lineitem")
def _(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity")


@query("delimited_dictionary_read", "SELECT p_partkey AS TagNumber, p_name AS Name, p_brand AS Measure FROM part")
def _(spark, sf):
    path = S.scratch_path(spark, "dictionary")
    src = load(spark, sf, "part").select(F.col("p_partkey").alias("TagNumber"), F.col("p_name").alias("Name"), F.col("p_brand").alias("Measure"))
    src.write.csv(path, sep=";", header=True)
    return S.read_delimited(spark, path, "TagNumber bigint, Name string, Measure string")


# Years from 1996 on have a third tag, which stands before the second one; one reading of a reel is no number.
_EXPORT = """SELECT year(l_shipdate) AS year, count(*) AS n, count(CASE WHEN l_linenumber <> 7 THEN 1 END) AS n_flow, round(sum(CASE WHEN l_linenumber <> 7 THEN l_quantity END), 2) AS flow,
 round(sum(l_extendedprice), 2) AS power, round(sum(CASE WHEN year(l_shipdate) >= 1996 THEN l_tax END), 2) AS dose, min(CAST(l_shipdate AS TIMESTAMP)) AS first_time FROM lineitem GROUP BY ALL"""


def exported_years(spark, sf):
    """Lines of order data as one sensor export a year, each with its own wrapped header."""
    li = load(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate"))
    late = F.col("year") >= 1996
    flow = F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.format_string("%.2f", F.col("l_quantity").cast("double")))
    power, dose = (F.format_string("%.2f", F.col(c).cast("double")) for c in ("l_extendedprice", "l_tax"))
    line = F.concat_ws("\t", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), flow, F.when(late, dose), power)
    heads = li.select("year").distinct().withColumn("late", late)
    texts = [("Time\tflow to",) * 2, ("\tpress",) * 2, ("\tpower of", "\tdose of\tpower of"), ("\trefiner", "\tstarch"), ("\tl/min\tkW", "\tl/min\tkg/t\tkW"), ("\tFLOW\tPOWER", "\tFLOW\tDOSE\tPOWER")]
    head = F.array(*[F.when(F.col("late"), b).otherwise(a) for a, b in texts])
    first = heads.select("year", F.posexplode(head).alias("n", "line"))
    rows = first.unionByName(li.select("year", F.lit(S.HEADER_LINES).alias("n"), line.alias("line")))
    path = S.scratch_path(spark, "exports")
    # One file a year: its header has to come first.
    rows.repartition("year").sortWithinPartitions("year", "n").select("year", "line").write.partitionBy("year").text(path)
    return S.read_wrapped_headers(spark, f"{path}/year=*")


@query("wrapped_header_files", _EXPORT)
def _(spark, sf):
    rows, _ = exported_years(spark, sf)
    year = F.regexp_extract("file", r"year=(\d+)", 1).cast("bigint")
    out = rows.groupBy(year.alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.count("FLOW").alias("n_flow"), F.sum("FLOW").alias("flow"), F.sum("POWER").alias("power"),
        F.sum("DOSE").alias("dose"), F.min("Time").alias("first_time"),
    )
    return rounded(out, "flow", "power", "dose", digits=2)


@query(
    "wrapped_header_tags",
    """SELECT DISTINCT year(l_shipdate) AS year, unnest(CASE WHEN year(l_shipdate) >= 1996 THEN ['Time', 'FLOW', 'DOSE', 'POWER'] ELSE ['Time', 'FLOW', 'POWER'] END) AS tag,
 unnest(CASE WHEN year(l_shipdate) >= 1996 THEN ['datetime', 'l/min', 'kg/t', 'kW'] ELSE ['datetime', 'l/min', 'kW'] END) AS unit FROM lineitem""",
)
def _(spark, sf):
    _, meta = exported_years(spark, sf)
    return meta.select(F.regexp_extract("file", r"year=(\d+)", 1).cast("bigint").alias("year"), "tag", "unit")


@query("parquet_write_and_read_back", "SELECT * FROM supplier")
def _(spark, sf):
    path = S.scratch_path(spark, "supplier")
    S.write_parquet(load(spark, sf, "supplier"), path)
    return spark.read.parquet(path)


def series(spark, sf):
    """Event values as a long tag series with one value per hour and tag."""
    return events(spark, sf).select(
        F.date_trunc("hour", "ts").alias("hour"), "event_id", F.col("event_type").alias("tag"), "value",
        F.when(F.col("event_type") == "purchase", "EUR").otherwise("s").alias("unit"),
    )


@query(
    "tag_series_pivoted",
    """SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, arg_max(value, event_id) FILTER (event_type = 'view') AS "view", arg_max(value, event_id) FILTER (event_type = 'purchase') AS purchase,
 arg_max(value, event_id) FILTER (event_type = 'error') AS error FROM events WHERE event_type IN ('view', 'purchase', 'error') GROUP BY 1""",
)
def _(spark, sf):
    return A.series_to_wide(series(spark, sf), ["view", "purchase", "error"], "hour", order="event_id")


@query("tag_unit_table", "SELECT DISTINCT event_type AS tag, CASE WHEN event_type = 'purchase' THEN 'EUR' ELSE 's' END AS unit FROM events")
def _(spark, sf):
    return A.tag_units(series(spark, sf))


def tag_dictionary(spark, sf):
    """Names for tags, taken from the event types; one of them has no number."""
    return events(spark, sf).select(
        F.col("event_type").alias("Tags"), F.concat(F.lit("Sensor "), "event_type").alias("Name"),
        F.when(F.col("event_type") != "signup", F.length("event_type")).alias("TagNumber"),
    ).distinct()


@query(
    "tags_renamed_wide",
    """SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS "Wedge Time", arg_max(value, event_id) FILTER (event_type = 'view') AS "Sensor view" FROM events WHERE event_type IN ('view', 'signup') GROUP BY 1""",
)
def _(spark, sf):
    wide = A.series_to_wide(series(spark, sf), ["view", "signup"], "hour", order="event_id")
    return A.rename_tags(wide, tag_dictionary(spark, sf), "hour")


@query(
    "tags_renamed_long",
    "SELECT 'Sensor ' || event_type AS name, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE event_type <> 'signup' GROUP BY event_type",
)
def _(spark, sf):
    out = A.rename_tags_long(series(spark, sf), tag_dictionary(spark, sf))
    return rounded(out.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total", digits=2)


def glossary(spark, sf):
    """Feature list made of column names found in the data: nation names do not match, two columns do."""
    li = load(spark, sf, "lineitem").select(F.array(F.lit("l_tax"), F.lit("l_quantity"), F.lit("l_discount")).alias("a")).distinct()
    return li.select(F.explode("a").alias("Feature")).union(load(spark, sf, "nation").select("n_name"))


@query("columns_aligned_to_glossary", "SELECT l_quantity, l_tax FROM lineitem")
def _(spark, sf):
    return A.align_columns(load(spark, sf, "lineitem"), glossary(spark, sf), ["l_discount"])


@query("glossary_without_dropped", "SELECT n_name AS \"Feature\" FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 1) UNION ALL SELECT unnest(['l_tax', 'l_quantity', 'l_discount'])")
def _(spark, sf):
    gone = load(spark, sf, "nation").filter(F.col("n_regionkey") == 1).select(F.col("n_name").alias("Feature"))
    return A.glossary_features(glossary(spark, sf), gone)


@query("cleaned_column_names", 'SELECT s_suppkey AS "key__no_", s_name AS "_supplier_name" FROM supplier')
def _(spark, sf):
    df = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("key [no]"), F.col("s_name").alias("<supplier name"))
    return A.clean_column_names(df)


@query(
    "metadata_upsert",
    """SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS load_seq, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS c_name FROM customer""",
)
def _(spark, sf):
    cur = load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", F.lit(1).alias("load_seq"))
    new = cur.filter(F.col("c_custkey") % 3 == 0).withColumns({"c_name": F.upper("c_name"), "load_seq": F.lit(2)})
    return A.upsert_latest(cur, new, "c_custkey", "load_seq")


@query(
    "labels_made_unique",
    """SELECT p_partkey, CASE WHEN k = 1 THEN p_name ELSE p_name || '__' || (k - 1) END AS unique_label FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)""",
)
def _(spark, sf):
    return A.unique_labels(load(spark, sf, "part"), "p_name", ["p_partkey"]).select("p_partkey", "unique_label")


@query(
    "descriptions_cleaned",
    """SELECT p_partkey, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) || ' (' || (p_size + 1) || ')' AS text FROM part""",
)
def _(spark, sf):
    raw = F.concat(F.lit(" .."), "p_name", F.lit("  12-345-AB01 "), F.lit("​~^"), F.col("p_size").cast("string"), F.lit(" "))
    return load(spark, sf, "part").select("p_partkey", A.clean_description(raw).alias("text"))


@query(
    "document_texts_cleaned",
    r"""WITH a AS (SELECT doc_id, regexp_replace(text, '\p{C}', '', 'g') AS s FROM documents),
 b AS (SELECT doc_id, CASE WHEN regexp_matches(s, '\s*~\^\d+\s*$') THEN s ELSE s END AS s FROM a),
 c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(s, '\b\d+-\d+-[A-Z0-9]+(?:-[A-Z0-9]+)?\b', '', 'g'), '\s+', ' ', 'g')) AS s FROM b),
 d AS (SELECT doc_id, trim(regexp_replace(s, '\s*:\s*$', '')) AS s FROM c)
 SELECT doc_id, length(x) AS n, md5(x) AS digest FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(s, '^\.+\s*', ''), '\s*\.+$', '')) AS x FROM d)""",
)
def _(spark, sf):
    x = A.clean_description("text")
    return load(spark, sf, "documents").select("doc_id", F.length(x).cast("bigint").alias("n"), F.md5(x).alias("digest"))


@query(
    "distinct_texts_translated",
    "SELECT p_partkey, coalesce(CASE WHEN p_type IN ('PROMO', 'LARGE') THEN lower(p_type) END, p_type) AS p_type FROM part",
)
def _(spark, sf):
    part = load(spark, sf, "part")
    words = part.filter(F.col("p_type").isin("PROMO", "LARGE")).select(F.col("p_type").alias("source"), F.lower("p_type").alias("target")).distinct()
    return A.translate_distinct(part, "p_type", words).select("p_partkey", "p_type")


@query(
    "numeric_coercion",
    """SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'bad' ELSE CAST(user_id AS VARCHAR) END AS DOUBLE) AS x, CAST(value AS FLOAT) AS value FROM events""",
)
def _(spark, sf):
    df = events(spark, sf).select("event_id", "value", F.when(F.col("event_type") == "error", "bad").otherwise(F.col("user_id").cast("string")).alias("x"))
    return A.coerce_numeric(A.coerce_numeric(df, ["x"]), ["value"], "float").select("event_id", "x", "value")


@query(
    "table_summary",
    """WITH t AS (SELECT l_partkey % 50 AS k, CASE WHEN l_quantity > 40 THEN NULL WHEN l_quantity > 30 THEN 999999.0 ELSE l_quantity END AS q FROM lineitem)
 SELECT 'lines' AS name, count(*) AS n_rows, 2 AS n_cols, round(count(CASE WHEN q IS NULL THEN 1 END) * 100.0 / (count(*) * 2), 6) AS missing_pct, 0.0::DOUBLE AS infinite_pct,
 round(count(CASE WHEN q = 999999.0 THEN 1 END) * 100.0 / (count(*) * 2), 6) AS sentinel_pct, count(*) - (SELECT count(*) FROM (SELECT DISTINCT k, q FROM t)) AS duplicate_rows FROM t""",
)
def _(spark, sf):
    q = F.col("l_quantity")
    df = load(spark, sf, "lineitem").select(
        (F.col("l_partkey") % 50).alias("k"), F.when(q > 40, None).when(q > 30, 999999.0).otherwise(q).alias("q")
    )
    return rounded(A.summarize_table(df, "lines"), "missing_pct", "infinite_pct", "sentinel_pct")


@query(
    "tables_compared_before_and_after",
    """WITH s AS (SELECT l_quantity, l_tax FROM lineitem), f AS (SELECT * FROM s WHERE l_quantity < 20)
 SELECT 'Before cut' AS name, count(*) AS n_rows, 2 AS n_cols, 0.0::DOUBLE AS missing_pct, 0.0::DOUBLE AS infinite_pct, 0.0::DOUBLE AS sentinel_pct, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM s)) AS duplicate_rows FROM s
 UNION ALL SELECT 'After cut', count(*), 2, 0.0, 0.0, 0.0, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM f)) FROM f""",
)
def _(spark, sf):
    df = load(spark, sf, "lineitem").select("l_quantity", "l_tax")
    return rounded(A.compare_tables(df, df.filter(F.col("l_quantity") < 20), "cut"), "missing_pct", "infinite_pct", "sentinel_pct")


@query("table_description", "SELECT count(*) AS n_rows, 6 AS n_cols, min(ts) AS min_ts, max(ts) AS max_ts FROM events")
def _(spark, sf):
    return A.describe_table(events(spark, sf), "ts")


@query("rows_without_breaks", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R'")
def _(spark, sf):
    df = load(spark, sf, "lineitem").withColumn("sheet_off", (F.col("l_returnflag") == "R").cast("int"))
    return R.drop_breaks(df).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("rows_without_zero_grade", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey % 10 <> 0 OR l_suppkey = 50")
def _(spark, sf):
    g = F.when(F.col("l_suppkey") != 50, F.col("l_suppkey") % 10)
    return R.drop_zero_grades(load(spark, sf, "lineitem").withColumn("grade", g)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("measure_nulled_for_grades", with_reels("SELECT grade, count(CASE WHEN grade NOT IN ('Brand#1', 'Brand#2') THEN qty END) AS n FROM reels GROUP BY grade"))
def _(spark, sf):
    return R.null_for_grades(reel_lines(spark, sf), "qty", ["Brand#1", "Brand#2"]).groupBy("grade").agg(F.count("qty").alias("n"))


@query("empty_columns_removed", "SELECT s_suppkey, s_acctbal FROM supplier")
def _(spark, sf):
    df = load(spark, sf, "supplier").select("s_suppkey", F.lit(None).cast("double").alias("nothing"), "s_acctbal")
    return R.remove_empty_columns(df)


@query("rows_with_missing_dropped", "SELECT l_orderkey, l_tax, l_discount FROM lineitem WHERE l_tax <> 0 AND l_discount <> 0")
def _(spark, sf):
    df = load(spark, sf, "lineitem").select("l_orderkey", F.nullif("l_tax", F.lit(0.0)).alias("l_tax"), F.nullif("l_discount", F.lit(0.0)).alias("l_discount"))
    return R.drop_missing(df, ["l_tax", "l_discount"])


@query("sentinels_replaced", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity BETWEEN 5 AND 45 THEN l_quantity END AS q FROM lineitem")
def _(spark, sf):
    q = F.when(F.col("l_quantity") > 45, 999999.0).when(F.col("l_quantity") < 5, -999999.0).otherwise(F.col("l_quantity"))
    return R.replace_sentinels(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", q.alias("q")))


@query(
    "process_rows_in_range",
    with_reels("SELECT reel_id, ts, qty FROM reels WHERE CAST(ts AS DATE) BETWEEN DATE '1998-02-01' AND DATE '1998-04-30' AND grade = 'Brand#11'"),
)
def _(spark, sf):
    return R.process_rows(reel_lines(spark, sf), "1998-02-01", "1998-04-30", grade="Brand#11", columns=["reel_id", "ts", "qty"])


@query(
    "process_rows_of_reel",
    with_reels("SELECT reel_id, line_no, part_id, qty FROM reels WHERE reel_id = (SELECT max(l_orderkey) FROM lineitem)"),
)
def _(spark, sf):
    newest = load(spark, sf, "lineitem").agg(F.max("l_orderkey")).first()[0]
    return R.process_rows(reel_lines(spark, sf), reel=newest, columns=["reel_id", "line_no", "part_id", "qty"])


@query("snapshot_half_open_range", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-03 06:00:00' AND ts < TIMESTAMP '2024-01-05'")
def _(spark, sf):
    return R.snapshot_rows(events(spark, sf), start="2024-01-03 06:00:00", end="2024-01-05", columns=["event_id", "ts"])


@query("snapshot_at_exact_time", with_reels("SELECT reel_id, qty FROM reels WHERE ts = TIMESTAMP '1999-07-01'"))
def _(spark, sf):
    return R.snapshot_rows(reel_lines(spark, sf), at="1999-07-01", columns=["reel_id", "qty", "ts"]).drop("ts")


# A stop after every order, the longer the dearer the order; the dearest ones reach into the next day.
_STOPS = "(SELECT o_orderdate AS s, o_orderdate + to_microseconds(CAST(floor(o_totalprice * 173160) AS BIGINT)) AS e FROM orders)"


@query(
    "maintenance_windows_excluded",
    f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM {_STOPS} w WHERE l_shipdate > w.s AND l_shipdate < w.e)",
)
def _(spark, sf):
    end = F.timestamp_micros(F.unix_micros("o_orderdate") + F.floor(F.col("o_totalprice") * 173160))
    stops = load(spark, sf, "orders").select(F.col("o_orderdate").alias("start"), end.alias("end"))
    return R.exclude_windows(load(spark, sf, "lineitem"), stops, "l_shipdate").select("l_orderkey", "l_linenumber", "l_partkey")


@query("grade_subset_by_list", with_reels("SELECT grade, count(*) AS n FROM reels WHERE grade IN ('Brand#3', 'Brand#4') GROUP BY grade"))
def _(spark, sf):
    return R.grade_subset(reel_lines(spark, sf), ["Brand#3", "Brand#4"]).groupBy("grade").agg(F.count(F.lit(1)).alias("n"))


@query("grade_subset_by_table", with_reels("SELECT grade, count(*) AS n FROM reels WHERE grade IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) > 80) GROUP BY grade"))
def _(spark, sf):
    keep = load(spark, sf, "part").groupBy(F.col("p_brand").alias("grade")).count().filter("count > 80")
    return R.grade_subset(reel_lines(spark, sf), keep).groupBy("grade").agg(F.count(F.lit(1)).alias("n"))


@query("times_parsed_bad_dropped", "SELECT event_id, date_trunc('second', ts) AS at FROM events WHERE event_type <> 'error'")
def _(spark, sf):
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return R.parse_times(events(spark, sf).select("event_id", text.alias("t")), "t", "at").drop("t")


_SECOND = """q2 AS (SELECT *, row_number() OVER (PARTITION BY reel_id ORDER BY ts DESC, line_no DESC, part_id DESC, supp_id DESC) AS r, count(*) OVER (PARTITION BY reel_id) AS c FROM reels)"""


@query("second_last_row_per_reel", with_reels(f", {_SECOND} SELECT reel_id, line_no, part_id, supp_id, qty FROM q2 WHERE r = least(2, c)"))
def _(spark, sf):
    return J.second_last_rows(reel_lines(spark, sf).select("reel_id", "ts", "line_no", "part_id", "supp_id", "qty"), ["reel_id"], ["ts", "line_no", "part_id", "supp_id"]).drop("ts")


@query(
    "quality_of_next_reel_aligned",
    with_reels(f""", {_SECOND}, lab AS (SELECT reel_id - 1 AS reel_id, qty, tax_cost FROM q2 WHERE r = least(2, c))
 SELECT p.reel_id, p.line_no, p.part_id, p.supp_id, lab.qty, round(lab.tax_cost + 1e-9, 6) AS tax_cost FROM reels p LEFT JOIN lab ON p.reel_id = lab.reel_id"""),
)
def _(spark, sf):
    out = J.align_quality(reel_lines(spark, sf), ["qty", "tax_cost"], order=["ts", "line_no", "part_id", "supp_id"])
    return rounded(out.select("reel_id", "line_no", "part_id", "supp_id", "qty", "tax_cost"), "tax_cost", nudge=1e-9)


_GRADE_SIDES = """a AS (SELECT user_id AS grade, avg(value) AS v, count(*) AS n FROM events WHERE day(ts) < 3 GROUP BY 1),
 b AS (SELECT user_id AS grade, avg(value) AS v, count(*) AS n FROM events WHERE day(ts) BETWEEN 3 AND 4 GROUP BY 1)"""


def grade_sides(spark, sf):
    e = events(spark, sf).withColumn("d", F.dayofmonth("ts"))
    side = lambda c: e.filter(c).groupBy(F.col("user_id").alias("grade")).agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n"))
    return side(F.col("d") < 3), side(F.col("d").between(3, 4))


@query(
    "periods_outer_matched",
    f"""WITH {_GRADE_SIDES} SELECT coalesce(a.grade, b.grade) AS grade, coalesce(a.n, 0) AS n_0, coalesce(b.n, 0) AS n_1, round(coalesce(a.v, b.v), 6) AS value_0, round(coalesce(b.v, a.v), 6) AS value_1
 FROM a FULL JOIN b ON a.grade = b.grade""",
)
def _(spark, sf):
    return rounded(J.outer_match(*grade_sides(spark, sf), "grade", "v", "n"), "value_0", "value_1")


@query("keys_in_both_periods", f"WITH {_GRADE_SIDES} SELECT grade FROM a INTERSECT SELECT grade FROM b")
def _(spark, sf):
    return J.common_keys(*grade_sides(spark, sf), "grade")


@query("keys_only_in_first_period", f"WITH {_GRADE_SIDES} SELECT grade FROM a EXCEPT SELECT grade FROM b")
def _(spark, sf):
    return J.keys_only_in_first(*grade_sides(spark, sf), "grade")


@query("period_self_comparison", with_labels("""SELECT c.grade, round(c.v, 6) AS now_cost, round(p.v, 6) AS old_cost FROM (SELECT grade, avg(total_cost) AS v FROM labelled WHERE period = 'current' GROUP BY grade) c
 LEFT JOIN (SELECT grade, avg(total_cost) AS v FROM labelled WHERE period = 'historic' GROUP BY grade) p ON c.grade = p.grade"""))
def _(spark, sf):
    m = labelled(spark, sf).groupBy("period", "grade").agg(F.avg("total_cost").alias("v"))
    now = m.filter(F.col("period") == TARGET).select("grade", F.col("v").alias("now_cost"))
    old = m.filter(F.col("period") == BASELINE).select("grade", F.col("v").alias("old_cost"))
    return rounded(now.join(old, "grade", "left"), "now_cost", "old_cost")


@query(
    "rows_of_chosen_groups",
    with_labels("SELECT l.grade, l.period, count(*) AS n FROM labelled l JOIN (SELECT DISTINCT grade, period, grammage FROM labelled WHERE qty > 49) k USING (grade, period, grammage) GROUP BY ALL"),
)
def _(spark, sf):
    df = labelled(spark, sf)
    keys = df.filter(F.col("qty") > 49).select("grade", "period", "grammage").distinct()
    return df.join(keys, ["grade", "period", "grammage"], "inner").groupBy("grade", "period").agg(F.count(F.lit(1)).alias("n"))


@query("rows_with_listed_reels", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, sf):
    keys = load(spark, sf, "orders").filter(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("l_orderkey"))
    return J.with_keys_of(load(spark, sf, "lineitem"), keys, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("rows_without_listed_reels", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, sf):
    keys = load(spark, sf, "orders").filter(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("l_orderkey"))
    return J.without_keys_of(load(spark, sf, "lineitem"), keys, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


_HOURLY = "h AS (SELECT date_trunc('hour', ts) AS hour_at, avg(value) AS temp FROM events WHERE event_type = 'signup' GROUP BY 1)"
_NEAR = f"""WITH {_HOURLY}, l AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase'),
 c AS (SELECT event_id, ts, hour_at, temp FROM l ASOF JOIN h ON l.ts >= h.hour_at UNION ALL SELECT event_id, ts, hour_at, temp FROM l ASOF JOIN h ON l.ts <= h.hour_at)
 SELECT event_id, arg_min(hour_at, (abs(epoch_us(ts) - epoch_us(hour_at)), hour_at)) AS hour_at, round(arg_min(temp, (abs(epoch_us(ts) - epoch_us(hour_at)), hour_at)), 6) AS temp FROM c GROUP BY event_id"""


def _nearest(spark, sf, blocks=None):
    e = events(spark, sf)
    hourly = e.filter(F.col("event_type") == "signup").groupBy(F.date_trunc("hour", "ts").alias("hour_at")).agg(F.avg("value").alias("temp"))
    left = e.filter(F.col("event_type") == "purchase").select("event_id", "ts")
    return rounded(J.nearest_in_time(left, hourly, "ts", "hour_at", ["temp"], blocks=blocks).drop("ts"), "temp")


@query("nearest_hourly_value", _NEAR)
def _(spark, sf):
    return _nearest(spark, sf)


@query("nearest_hourly_value_in_blocks", _NEAR)
def _(spark, sf):
    return _nearest(spark, sf, blocks=6)


@query(
    "nearest_row_to_time",
    """SELECT event_id, ts, round(abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 12:00:00')) / 6e7, 6) AS time_diff_minutes, abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 12:00:00')) / 6e7 > 240 AS far_away
 FROM events ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 12:00:00')) LIMIT 1""",
)
def _(spark, sf):
    out = J.nearest_row(events(spark, sf).select("event_id", "ts"), "2024-01-10 12:00:00", ties=["event_id"])
    return rounded(out, "time_diff_minutes")


@query("periods_unioned", "SELECT event_id, value FROM events WHERE day(ts) = 2 UNION ALL SELECT event_id, value FROM events WHERE day(ts) = 9")
def _(spark, sf):
    e = events(spark, sf).select("event_id", "value", "ts")
    return J.union_all([e.filter(F.dayofmonth("ts") == d).drop("ts") for d in (2, 9)])


@query("last_row_per_reel", with_reels("SELECT reel_id, line_no, part_id, qty FROM (SELECT *, row_number() OVER (PARTITION BY reel_id ORDER BY ts DESC, line_no DESC, part_id DESC, supp_id DESC) AS r FROM reels) WHERE r = 1"))
def _(spark, sf):
    df = reel_lines(spark, sf).select("reel_id", "ts", "line_no", "part_id", "supp_id", "qty")
    return J.keep_last(df, ["reel_id"], ["ts", "line_no", "part_id", "supp_id"]).select("reel_id", "line_no", "part_id", "qty")


@query(
    "first_row_per_quality_tuple",
    """SELECT t, d, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, nullif(l_tax, 0) AS t, nullif(l_discount, 0) AS d, row_number() OVER (PARTITION BY nullif(l_tax, 0), nullif(l_discount, 0)
 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1""",
)
def _(spark, sf):
    df = load(spark, sf, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", F.nullif("l_tax", F.lit(0.0)).alias("t"), F.nullif("l_discount", F.lit(0.0)).alias("d"))
    return J.keep_first(df, ["t", "d"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]).drop("l_shipdate")


@query("first_row_per_time", "SELECT o_orderdate AS at, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def _(spark, sf):
    df = load(spark, sf, "orders").select(F.col("o_orderdate").alias("at"), "o_orderkey")
    return J.keep_first(df, ["at"], ["o_orderkey"])


@query("column_means_subtracted", "SELECT event_id, round(value - (SELECT avg(value) FROM events), 6) AS value FROM events")
def _(spark, sf):
    return rounded(J.subtract_means(events(spark, sf).select("event_id", "value"), ["value"]), "value")


@query("columns_joined_on_row_key", "SELECT event_id, value, user_id, event_type FROM events WHERE value > 5")
def _(spark, sf):
    e = events(spark, sf)
    return J.join_on_row_key([e.select("event_id", "value"), e.select("event_id", "user_id"), e.filter("value > 5").select("event_id", "event_type")], ["event_id"])


@query("multi_key_sort", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def _(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(F.desc("o_orderpriority"), F.asc("o_totalprice"))


@query(
    "best_and_worst_group",
    with_labels("SELECT grade, period, arg_min(grammage, (v, grammage)) AS best, arg_max(grammage, (v, -grammage)) AS worst FROM (SELECT grade, period, grammage, avg(total_cost) AS v FROM labelled GROUP BY ALL) GROUP BY grade, period"),
)
def _(spark, sf):
    m = labelled(spark, sf).groupBy("grade", "period", "grammage").agg(F.avg("total_cost").alias("v"))
    return J.best_and_worst(m, ["grade", "period"], "v", "grammage")


@query("latest_row", "SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def _(spark, sf):
    return J.latest_rows(events(spark, sf).select("event_id", "ts", "value"), ties=["event_id"])


@query("latest_row_per_group", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def _(spark, sf):
    return J.latest_rows(events(spark, sf).select("user_id", "event_id", "ts"), ["user_id"], ties=["event_id"])


@query("top_rows_by_score", "SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 25")
def _(spark, sf):
    return J.top_n(load(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), [F.desc("p_size"), F.desc("p_retailprice"), F.asc("p_partkey")], 25)
