"""Derived columns on order lines, which stand in for machine rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core.session import load
from ..functions import expr as X
from ..operators import derive as B
from .base import query, reel_lines, rounded, with_reels

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
K = ", ".join(KEYS)


def lines(spark, sf):
    return load(spark, sf, "lineitem")


@query(
    "sheet_off_flag",
    f"SELECT {K}, CAST(CASE WHEN l_linenumber - 4 > 0 THEN 1 ELSE 0 END AS TINYINT) AS sheet_off FROM lineitem",
)
def _(spark, sf):
    df = lines(spark, sf).withColumn("code", F.col("l_linenumber") - 4)
    return B.sheet_off(df, "code", "l_quantity").select(*KEYS, "sheet_off")


@query(
    "speed_draws",
    f"""SELECT {K}, round((l_quantity / nullif(l_tax, 0) - 1) * 100, 4) AS draw_a, round((l_extendedprice / nullif(l_quantity, 0) - 1) * 100, 4) AS draw_b FROM lineitem""",
)
def _(spark, sf):
    out = B.draws(lines(spark, sf), {"draw_a": ("l_quantity", "l_tax"), "draw_b": ("l_extendedprice", "l_quantity")})
    return rounded(out.select(*KEYS, "draw_a", "draw_b"), "draw_a", "draw_b", digits=4)


@query(
    "starch_application",
    f"""WITH a AS (SELECT *, l_quantity / 100 * l_extendedprice * 60 AS area FROM lineitem)
 SELECT {K}, round(area, 3) AS area_m2_h, round(l_tax + l_discount, 6) AS slurry_fw, round((l_tax + l_discount) * 1000000 / nullif(area, 0), 4) AS application_ml_fw FROM a""",
)
def _(spark, sf):
    out = B.starch_application(lines(spark, sf), "l_quantity", "l_extendedprice", {"fw": ("l_tax", "l_discount")})
    out = out.select(*KEYS, "area_m2_h", "slurry_fw", "application_ml_fw")
    return rounded(rounded(rounded(out, "area_m2_h", digits=3), "slurry_fw"), "application_ml_fw", digits=4)


@query(
    "pumping_flags",
    f"SELECT {K}, CAST(l_quantity > 25 AS TINYINT) AS pump_1, CAST(l_extendedprice > 25 AS TINYINT) AS pump_2 FROM lineitem",
)
def _(spark, sf):
    out = B.pumping_flags(lines(spark, sf), {"pump_1": "l_quantity", "pump_2": "l_extendedprice"}, 25)
    return out.select(*KEYS, "pump_1", "pump_2")


@query("zone_sums", f"SELECT {K}, round(l_tax + nullif(l_discount, 0), 6) AS zones FROM lineitem")
def _(spark, sf):
    df = lines(spark, sf).withColumn("l_discount", F.when(F.col("l_discount") != 0, F.col("l_discount")))
    return rounded(B.zone_sums(df, {"zones": ["l_tax", "l_discount"]}).select(*KEYS, "zones"), "zones")


@query("long_fibre_fraction", f"SELECT {K}, round(l_tax / nullif(l_discount, 0) * 100, 6) AS fraction FROM lineitem")
def _(spark, sf):
    return rounded(B.percent_ratios(lines(spark, sf), {"fraction": ("l_tax", "l_discount")}).select(*KEYS, "fraction"), "fraction")


@query(
    "steam_balance",
    f"""SELECT {K}, round(l_quantity - (l_tax + l_discount), 6) AS steam_rest, round(l_quantity - (l_tax + l_discount) + (l_tax + l_discount) + l_extendedprice, 4) AS steam_total FROM lineitem""",
)
def _(spark, sf):
    out = B.steam_balance(lines(spark, sf), "l_quantity", ["l_tax", "l_discount"], "l_extendedprice").select(*KEYS, "steam_rest", "steam_total")
    return rounded(rounded(out, "steam_rest"), "steam_total", digits=4)


@query(
    "specific_consumption_rates",
    f"""SELECT {K}, round(l_tax * 0.025 / l_quantity * 1000, 6) AS bentonite, round(l_discount / l_quantity * 1000, 6) AS defoamer FROM lineitem""",
)
def _(spark, sf):
    out = lines(spark, sf).select(
        *KEYS, B.specific_rate("l_tax", "l_quantity", 0.025).alias("bentonite"), B.specific_rate("l_discount", "l_quantity").alias("defoamer")
    )
    return rounded(out, "bentonite", "defoamer")


@query("threshold_gated_flow", f"SELECT {K}, CASE WHEN l_quantity >= 20 THEN l_quantity ELSE 0.0 END AS gated FROM lineitem")
def _(spark, sf):
    return lines(spark, sf).select(*KEYS, B.gated("l_quantity", F.col("l_quantity") >= 20).alias("gated"))


@query(
    "drive_loads_per_tonne",
    f"SELECT {K}, round((l_tax + l_discount + l_extendedprice) * 1000 / l_quantity, 3) AS load FROM lineitem",
)
def _(spark, sf):
    out = lines(spark, sf).select(*KEYS, B.load_per_tonne(["l_tax", "l_discount", "l_extendedprice"], "l_quantity", 1000).alias("load"))
    return rounded(out, "load", digits=3)


_STEAM = """m AS (SELECT median(CASE WHEN l_quantity BETWEEN 0 AND 10 THEN l_quantity END) AS med FROM lineitem),
 s AS (SELECT *, CASE WHEN l_quantity BETWEEN 0 AND 10 THEN l_quantity ELSE med END AS cond FROM lineitem, m)"""


@query("in_range_median_repair", f"WITH {_STEAM} SELECT {K}, cond AS l_quantity FROM s")
def _(spark, sf):
    return B.repair_from_median(lines(spark, sf), "l_quantity", 0, 10).select(*KEYS, "l_quantity")


@query(
    "steam_per_tonne",
    f"""WITH {_STEAM} SELECT {K}, round((((l_extendedprice + l_tax) * 0.788 - cond) * 1.02 - 0.5938 / 24) / greatest(l_linenumber * 20.0, 45.0) * 1000, 2) AS steam_kwh_t FROM s""",
)
def _(spark, sf):
    df = lines(spark, sf).withColumn("rate", F.col("l_linenumber") * 20.0)
    out = B.steam_per_tonne(df, "l_extendedprice", "l_tax", "l_quantity", "rate").select(*KEYS, "steam_kwh_t")
    return rounded(out, "steam_kwh_t", digits=2)


@query(
    "fibre_balance_per_tonne",
    f"""SELECT {K}, round((((l_extendedprice * l_tax / 100 + l_quantity * l_discount / 100) * 0.06 - (l_extendedprice + l_quantity) * l_tax / 1000 * 0.06
 - l_quantity * 0.0174) * 1.5688 - 23.1) * 1.1 / l_linenumber, 4) + 0.0 AS fibre_t_t FROM lineitem""",
)
def _(spark, sf):
    out = B.fibre_balance(lines(spark, sf), [("l_extendedprice", "l_tax"), ("l_quantity", "l_discount")], "l_tax", "l_quantity", "l_linenumber")
    return rounded(out.select(*KEYS, "fibre_t_t"), "fibre_t_t", digits=4)


@query(
    "priced_consumptions",
    f"""SELECT {K}, round(l_tax * 146.46, 6) AS fibre_cost, round(l_discount * 0.11366, 6) AS electricity_cost, round(nullif(l_quantity, 7) * 0.08903, 6) AS steam_cost,
 round(l_tax * 146.46 + l_discount * 0.11366 + nullif(l_quantity, 7) * 0.08903, 6) AS combined_cost FROM lineitem""",
)
def _(spark, sf):
    df = lines(spark, sf).withColumn("steam", F.nullif("l_quantity", F.lit(7.0)))
    out = B.price_consumptions(df, {"fibre": "l_tax", "electricity": "l_discount", "steam": "steam"})
    cols = ["fibre_cost", "electricity_cost", "steam_cost", "combined_cost"]
    return rounded(out.select(*KEYS, *cols), *cols)


@query(
    "turnup_unit_costs",
    f"""SELECT {K}, round(coalesce(nullif(l_tax, 0), 0) * 0.00084, 8) AS sizing_agent_cost, round(l_discount * 0.3, 6) AS dry_strength_agent_cost, round(nullif(l_quantity, 7) * 0.08903, 6) AS steam_cost,
 round(coalesce(l_tax, 0) * 0.00084 + l_discount * 0.3, 6) AS chemicals_cost, round(coalesce(nullif(l_quantity, 7), 0) * 0.08903, 6) AS aggregated_cost,
 round(coalesce(l_tax, 0) * 0.00084 + l_discount * 0.3 + coalesce(nullif(l_quantity, 7), 0) * 0.08903, 6) AS combined_cost FROM lineitem""",
)
def _(spark, sf):
    df = lines(spark, sf).withColumns({"steam": F.nullif("l_quantity", F.lit(7.0)), "siz": F.nullif("l_tax", F.lit(0.0))})
    out = B.turnup_costs(df, {"sizing_agent": "siz", "dry_strength_agent": "l_discount", "steam": "steam"}, ["sizing_agent", "dry_strength_agent"])
    cols = ["dry_strength_agent_cost", "steam_cost", "chemicals_cost", "aggregated_cost", "combined_cost"]
    return rounded(rounded(out.select(*KEYS, "sizing_agent_cost", *cols), *cols), "sizing_agent_cost", digits=8)


@query(
    "area_cost_by_grade_number",
    f"SELECT {K}, round(l_quantity * l_extendedprice * l_tax / nullif(1 - CAST(right(CAST(1000 + l_partkey AS VARCHAR), 3) AS INT), 0) + 1e-8, 4) + 0.0 AS area_cost FROM lineitem",
)
def _(spark, sf):
    df = lines(spark, sf).withColumn("grade_id", (F.col("l_partkey") + 1000).cast("double").cast("string"))
    df = df.withColumn("grade_id", F.concat((F.col("l_partkey") + 1000).cast("string"), F.lit(".0")))
    return rounded(df.select(*KEYS, B.area_cost("l_quantity", "l_extendedprice", "l_tax", "grade_id").alias("area_cost")), "area_cost", digits=4, nudge=1e-8)


@query(
    "sentinel_encoded_ratio",
    f"""SELECT {K}, round(CASE WHEN l_tax = 0 AND l_quantity - 10 > 0 THEN 999999.0 WHEN l_tax = 0 AND l_quantity - 10 < 0 THEN -999999.0 ELSE (l_quantity - 10) / nullif(l_tax, 0) END, 6) AS r FROM lineitem""",
)
def _(spark, sf):
    return rounded(lines(spark, sf).select(*KEYS, X.sentinel_ratio(F.col("l_quantity") - 10, "l_tax").alias("r")), "r")


@query(
    "cost_allocated_by_flow_share",
    f"""SELECT {K}, round(l_extendedprice * l_quantity / (l_quantity + l_tax + coalesce(nullif(l_discount, 0), 0)) + 1e-8, 4) AS dryer, round(l_extendedprice * l_tax / (l_quantity + l_tax + l_discount) + 1e-8, 4) AS kitchen,
 round(l_extendedprice * nullif(l_discount, 0) / (l_quantity + l_tax + l_discount) + 1e-8, 4) AS heater FROM lineitem""",
)
def _(spark, sf):
    df = lines(spark, sf).withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    out = B.allocate_by_share(df, "l_extendedprice", {"dryer": "l_quantity", "kitchen": "l_tax", "heater": "l_discount"})
    return rounded(out.select(*KEYS, "dryer", "kitchen", "heater"), "dryer", "kitchen", "heater", digits=4, nudge=1e-8)


@query(
    "concentration_retention_fibre",
    f"""SELECT {K}, round(l_tax / nullif(l_discount + l_tax, 0), 6) AS concentration, round(1 - l_tax / (l_quantity * 10), 8) AS retention,
 round(l_extendedprice * (1 - l_tax / 100) - (l_discount + l_tax), 6) AS fibre FROM lineitem""",
)
def _(spark, sf):
    out = lines(spark, sf).select(
        *KEYS, B.concentration("l_tax", "l_discount").alias("concentration"), B.retention("l_tax", "l_quantity").alias("retention"),
        B.fibre_weight("l_extendedprice", "l_tax", X.strict_sum(["l_discount", "l_tax"])).alias("fibre"),
    )
    return rounded(rounded(out, "concentration", "fibre"), "retention", digits=8)


@query(
    "grade_split_and_whitelist",
    f"""SELECT {K}, CAST((l_partkey + 500) % 1000 AS INT) AS grammage, CAST((l_partkey + 500) // 1000 AS VARCHAR) AS paper_type FROM lineitem
 WHERE (l_partkey + 500) % 1000 IN (85, 90, 95, 100, 110, 500, 700) AND (l_partkey + 500) // 1000 IN (1, 2)""",
)
def _(spark, sf):
    df = lines(spark, sf).withColumn("g", F.col("l_partkey") + 500)
    return B.split_grade(df, "g", [85, 90, 95, 100, 110, 500, 700], ["1", "2"]).select(*KEYS, "grammage", "paper_type")


@query("one_hot_paper_type", with_reels("SELECT reel_id, line_no, part_id, supp_id, CAST(paper_type = 'PROMO' AS INT) AS \"PROMO\", CAST(paper_type = 'LARGE' AS INT) AS \"LARGE\" FROM reels"))
def _(spark, sf):
    return B.one_hot(reel_lines(spark, sf), "paper_type", ["PROMO", "LARGE"]).select("reel_id", "line_no", "part_id", "supp_id", "PROMO", "LARGE")


_FEATURE_SRC = """f0 AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 1000 AS basis_weight, l_quantity AS speed_pd1, l_quantity * 10 AS reel_width, l_tax * 100 AS moisture,
 l_discount * 100 AS moisture_predryer, l_tax AS starch_top, l_discount AS starch_bottom, l_tax AS rod_pressure_top, l_quantity / 100 AS concentration_1, l_tax AS concentration_2 FROM lineitem)"""


@query(
    "named_features_with_dependencies",
    f"""WITH {_FEATURE_SRC} SELECT {K}, round(starch_top + starch_bottom + 1e-11, 6) AS starch_uptake, round(basis_weight * (1 - moisture / 100) - (starch_top + starch_bottom) + 1e-11, 6) AS fibre_weight,
 round(starch_top / nullif(concentration_2, 0) + starch_bottom / concentration_1 + 1e-11, 6) AS diluted_starch,
 round(basis_weight * speed_pd1 * reel_width * (starch_top / nullif(concentration_2, 0) + starch_bottom / concentration_1) * 60 / 1e10 + 1e-11, 8) AS water_into_afterdryer,
 round(basis_weight * speed_pd1 * reel_width * (65 - moisture_predryer) * 60 / 1e10 + 1e-11, 8) AS water_flow_predryer,
 round(CASE WHEN abs(rod_pressure_top) > 1e-9 THEN 1 / rod_pressure_top END + 1e-11, 6) AS inv_rod_pressure_top, round(rod_pressure_top * rod_pressure_top + 1e-11, 6) AS square_rod_pressure_top FROM f0""",
)
def _(spark, sf):
    src = lines(spark, sf).select(
        *KEYS, (F.col("l_extendedprice") / 1000).alias("basis_weight"), F.col("l_quantity").alias("speed_pd1"), (F.col("l_quantity") * 10).alias("reel_width"),
        (F.col("l_tax") * 100).alias("moisture"), (F.col("l_discount") * 100).alias("moisture_predryer"), F.col("l_tax").alias("starch_top"),
        F.col("l_discount").alias("starch_bottom"), F.col("l_tax").alias("rod_pressure_top"), (F.col("l_quantity") / 100).alias("concentration_1"), F.col("l_tax").alias("concentration_2"),
    )
    wanted = ["fibre_weight", "water_into_afterdryer", "water_flow_predryer", "inv_rod_pressure_top", "square_rod_pressure_top"]
    cols = ["starch_uptake", "diluted_starch", *wanted]
    out = B.create_features(src, wanted, keep=[*KEYS, *cols])
    small = ["water_into_afterdryer", "water_flow_predryer"]
    return rounded(rounded(out, *[c for c in cols if c not in small], nudge=1e-11), *small, digits=8, nudge=1e-11)


@query(
    "safe_inverse_and_square",
    f"SELECT {K}, round(CASE WHEN abs(l_discount) > 0.015 THEN 1 / l_discount END, 6) AS inv, round(l_discount * l_discount, 6) AS sq FROM lineitem",
)
def _(spark, sf):
    return rounded(lines(spark, sf).select(*KEYS, X.safe_inverse("l_discount", 0.015).alias("inv"), F.pow("l_discount", F.lit(2)).alias("sq")), "inv", "sq")


@query(
    "area_normalised_indices",
    f"""SELECT {K}, round(l_tax * 1e5 / (l_quantity * l_linenumber * 60), 6) AS steam_sqm, round(l_tax * 1e5 / (l_quantity * l_linenumber * 60) * 1000 / l_extendedprice, 6) AS steam_index,
 round(146.46 * l_tax + 0.08903 * l_quantity, 6) AS cost FROM lineitem""",
)
def _(spark, sf):
    out = B.area_indices(lines(spark, sf), {"steam": ("l_tax", 1000.0)}, "l_quantity", "l_linenumber", "l_extendedprice")
    out = out.withColumn("cost", B.composite_cost({"fibre": "l_tax", "steam": "l_quantity"}, B.UNIT_PRICES))
    return rounded(out.select(*KEYS, "steam_sqm", "steam_index", "cost"), "steam_sqm", "steam_index", "cost")


@query(
    "impossible_values_nulled_by_name",
    f"SELECT {K}, nullif(l_tax, 0) AS l_tax, CASE WHEN l_discount - 0.05 >= 0 THEN round(l_discount - 0.05, 6) END AS flow, CASE WHEN l_quantity - 25 <= 0 THEN l_quantity - 25 END AS vacuum FROM lineitem",
)
def _(spark, sf):
    df = lines(spark, sf).select(*KEYS, "l_tax", F.round(F.col("l_discount") - 0.05, 6).alias("flow"), (F.col("l_quantity") - 25).alias("vacuum"))
    return B.null_by_name(df, {"positive": ["tax"], "non_negative": ["flow", "power"], "non_positive": ["vacuum"]}, skip=KEYS)


@query(
    "bounds_nulling_with_cross_rule",
    f"SELECT {K}, CASE WHEN l_quantity BETWEEN 5 AND 40 THEN l_quantity END AS l_quantity, CASE WHEN l_discount >= 0.02 AND NOT (l_linenumber > 5) THEN l_discount END AS l_discount FROM lineitem",
)
def _(spark, sf):
    out = B.null_outside(lines(spark, sf), {"l_quantity": (5, 40), "l_discount": (0.02, None)}, {"l_discount": F.col("l_linenumber") > 5})
    return out.select(*KEYS, "l_quantity", "l_discount")


@query("columns_dropped_by_pattern", f"SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax, l_shipdate FROM lineitem")
def _(spark, sf):
    return B.drop_matching(lines(spark, sf), names=["l_linenumber"], parts=["FLAG", "status", "discount"])


@query("bounded_value_or_zero", f"SELECT {K}, CASE WHEN l_quantity BETWEEN 10 AND 30 THEN l_quantity ELSE 0.0 END AS q FROM lineitem")
def _(spark, sf):
    return lines(spark, sf).select(*KEYS, B.keep_between("l_quantity", 10, 30).alias("q"))


@query("values_capped_at_mean", f"SELECT {K}, round(least(l_quantity, (SELECT avg(l_quantity) FROM lineitem)), 6) AS l_quantity FROM lineitem")
def _(spark, sf):
    return rounded(B.cap_at_mean(lines(spark, sf), "l_quantity").select(*KEYS, "l_quantity"), "l_quantity")


@query("column_selection", f"SELECT l_orderkey, l_quantity FROM lineitem")
def _(spark, sf):
    return B.select_columns(lines(spark, sf), ["l_orderkey", "l_quantity"])
