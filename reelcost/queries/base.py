"""Registry of demonstration queries and the stand-in tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.session import load
from ..operators.periods import label_periods

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TARGET_RANGE = ("2001-01-01", "2001-12-31")
BASELINE_RANGE = ("2000-01-01", "2000-12-31")
COMPONENTS = ["material_cost", "tax_cost", "rebate_cost", "handling_cost"]
TIES = ["reel_id", "line_no", "part_id", "supp_id"]


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def reel_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Process rows: order lines with the part's brand as the grade."""
    li = load(spark, sf, "lineitem")
    pa = load(spark, sf, "part")
    q = F.col("l_quantity")
    rows = li.join(pa, li.l_partkey == pa.p_partkey).select(
        F.col("l_orderkey").alias("reel_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supp_id"),
        F.col("p_brand").alias("grade"),
        F.col("p_type").alias("paper_type"),
        F.col("p_size").alias("grammage"),
        F.col("l_linestatus").alias("machine"),
        F.col("l_shipdate").alias("ts"),
        q.alias("qty"),
        (F.col("l_extendedprice") / q).alias("material_cost"),
        (F.col("l_extendedprice") * F.col("l_tax") / q).alias("tax_cost"),
        (F.col("l_extendedprice") * F.col("l_discount") / q).alias("rebate_cost"),
        (F.col("p_retailprice") / 100).alias("handling_cost"),
    )
    return rows.withColumn(
        "total_cost", F.col("material_cost") + F.col("tax_cost") + F.col("rebate_cost") + F.col("handling_cost")
    )


REELS = """reels0 AS (SELECT l_orderkey AS reel_id, l_linenumber AS line_no, l_partkey AS part_id, l_suppkey AS supp_id,
  p_brand AS grade, p_type AS paper_type, p_size AS grammage, l_linestatus AS machine, CAST(l_shipdate AS TIMESTAMP) AS ts,
  l_quantity AS qty, l_extendedprice / l_quantity AS material_cost, l_extendedprice * l_tax / l_quantity AS tax_cost,
  l_extendedprice * l_discount / l_quantity AS rebate_cost, p_retailprice / 100 AS handling_cost
  FROM lineitem JOIN part ON l_partkey = p_partkey),
reels AS (SELECT *, material_cost + tax_cost + rebate_cost + handling_cost AS total_cost FROM reels0)"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return label_periods(reel_lines(spark, sf), "ts", TARGET_RANGE, BASELINE_RANGE)


LABELLED = (
    REELS
    + """,
labelled AS (SELECT *, CASE WHEN CAST(ts AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' THEN 'historic' ELSE 'current' END AS period
  FROM reels WHERE CAST(ts AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2001-12-31')"""
)


def with_reels(sql: str) -> str:
    return f"WITH {REELS} {sql}"


def with_labels(sql: str) -> str:
    return f"WITH {LABELLED} {sql}"


def rounded(df: DataFrame, *cols: str, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Round for comparison; ``nudge`` moves exact decimal halves off the rounding edge."""
    return df.select(
        *[(F.round(F.col(c) + F.lit(nudge), digits) + F.lit(0.0)).alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events")
