"""Derived columns: flags, ratios, consumptions, unit costs and named features."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.quantiles import group_quantiles
from ..core.sizing import join_stats
from ..functions.expr import col, filled_sum, ratio, safe_inverse, strict_sum, truthy

# Prices per tonne of consumption unit (per gram, kilogram, kilowatt-hour or tonne).
UNIT_PRICES = {
    "retention_aid": 4.08 / 1000,
    "bentonite_1": 0.28 / 1000,
    "bentonite_2": 0.28 / 1000,
    "fixative_2": 3.58 / 1000,
    "deaerator": 1.53 / 1000,
    "starch": 434.22 / 1000,
    "defoamer": 4.22 / 1000,
    "sizing_agent": 0.84 / 1000,
    "dry_strength_agent": 0.30,
    "sodium_hydroxide": 0.30 / 1000,
    "electricity": 113.66 / 1000,
    "steam": 89.03 / 1000,
    "fibre": 146.46,
}


def sheet_off(df: DataFrame, break_code: str, pump_power: str, min_power: float = 50.0, out: str = "sheet_off") -> DataFrame:
    """1 while the sheet is off: a break code is set or the machine is shut during a break."""
    broken = truthy(F.col(break_code) > 0)
    shut = broken & truthy(F.col(pump_power) < min_power)
    return df.withColumn(out, (broken | shut).cast("tinyint")).drop(break_code)


def draws(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Relative speed differences in percent; ``pairs`` maps a name to (speed, reference speed)."""
    return df.withColumns({name: (ratio(a, b) - 1) * 100 for name, (a, b) in pairs.items()})


def starch_application(df: DataFrame, width_cm: str, speed: str, sides: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Area per hour, slurry per side and millilitres per square metre."""
    area = F.col(width_cm) / 100 * F.col(speed) * 60
    out = {"area_m2_h": area}
    for side, (water, starch) in sides.items():
        out[f"slurry_{side}"] = F.col(water) + F.col(starch)
        out[f"application_ml_{side}"] = ratio((F.col(water) + F.col(starch)) * 1_000_000, area)
    return df.withColumns(out)


def pumping_flags(df: DataFrame, flows: Mapping[str, str], threshold: float = 50.0) -> DataFrame:
    return df.withColumns({name: truthy(F.col(c) > threshold).cast("tinyint") for name, c in flows.items()})


def zone_sums(df: DataFrame, sums: Mapping[str, Sequence[str]]) -> DataFrame:
    """Sums over zones; NULL when a zone is missing."""
    return df.withColumns({name: strict_sum(cols) for name, cols in sums.items()})


def percent_ratios(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    return df.withColumns({name: ratio(a, b) * 100 for name, (a, b) in pairs.items()})


def steam_balance(df: DataFrame, total: str, users: Sequence[str], waste: str, rest: str = "steam_rest", out: str = "steam_total") -> DataFrame:
    """What is left of the total after the named users, and the total with waste steam added."""
    left = F.col(total) - strict_sum(users)
    return df.withColumn(rest, left).withColumn(out, F.col(rest) + strict_sum(users) + F.col(waste))


def specific_rate(dose: str | Column, rate: str | Column, density: float = 1.0, scale: float = 1000.0) -> Column:
    """Dose per tonne: dose × density / production rate × scale."""
    return ratio(col(dose) * density, rate) * scale


def gated(value: str | Column, test: Column) -> Column:
    """Value where the test holds, zero where it fails, NULL where the value is missing."""
    v = col(value)
    return v * F.when(truthy(test), 1.0).otherwise(0.0)


def load_per_tonne(loads: Sequence[str | Column], rate: str, scale: float = 1.0) -> Column:
    """Sum of drive loads over the production rate."""
    return ratio(strict_sum(loads) * scale, rate)


def repair_from_median(df: DataFrame, c: str, low: float, high: float) -> DataFrame:
    """Values outside the range become the median of the values inside it."""
    inside = F.when(F.col(c).between(low, high), F.col(c))
    med = group_quantiles(df, [], {"__med": (inside, 0.5)})
    return join_stats(df, med, []).withColumn(c, F.coalesce(inside, "__med")).drop("__med")


def floored(c: str | Column, floor: float) -> Column:
    """At least ``floor``; a missing value counts as below it."""
    return F.when(truthy(col(c) > floor), col(c)).otherwise(F.lit(floor))


def steam_per_tonne(df: DataFrame, steam: str, waste: str, condensate: str, rate: str, out: str = "steam_kwh_t") -> DataFrame:
    """Net steam per tonne with a repaired condensate credit and a floored production rate."""
    # Steam enthalpy, line loss, daily credit and the lowest production rate used.
    enthalpy, loss, credit, lowest_rate = 0.788, 1.02, 0.5938 / 24, 45.0
    fixed = repair_from_median(df, condensate, 0, 10)
    net = ((F.col(steam) + F.col(waste)) * enthalpy - F.col(condensate)) * loss - credit
    return fixed.withColumn(out, ratio(net, floored(rate, lowest_rate)) * 1000)


def fibre_balance(
    df: DataFrame, flows: Sequence[tuple[str, str]], white_water: str, returns: str, rate: str, out: str = "fibre_t_t"
) -> DataFrame:
    """Fibre per tonne from stock flows minus white-water solids and returns.

    ``flows`` lists (flow, consistency in percent) pairs.
    """
    # Minutes to hours, calibration slope and offset, loss factor, return consistency.
    hours, slope, offset, loss, return_share = 60 / 1000, 1.5688, 23.1, 1.1, 1.74 / 100
    demand = strict_sum([F.col(f) * F.col(c) / 100 for f, c in flows]) * hours
    solids = strict_sum([f for f, _ in flows]) * F.col(white_water) / 1000 * hours
    balance = demand - solids - F.col(returns) * return_share
    return df.withColumn(out, ratio((balance * slope - offset) * loss, rate))


def price_consumptions(
    df: DataFrame, consumptions: Mapping[str, str], total: str = "combined_cost", prices: Mapping[str, float] | None = None,
    fill: Sequence[str] = (), suffix: str = "_cost",
) -> DataFrame:
    """Cost column per consumption and their sum.

    The sum is NULL when a part is, except that parts named in ``fill`` count as zero.
    """
    prices = UNIT_PRICES if prices is None else prices
    parts = {f"{name}{suffix}": F.col(c) * F.lit(float(prices[name])) for name, c in consumptions.items()}
    soft = {f"{name}{suffix}" for name in fill}
    addends = [F.coalesce(v, F.lit(0.0)) if k in soft else v for k, v in parts.items()]
    return df.withColumns({**parts, total: strict_sum(addends)})


def turnup_costs(
    df: DataFrame, consumptions: Mapping[str, str], chemicals: Sequence[str], prices: Mapping[str, float] | None = None
) -> DataFrame:
    """Unit costs of a turn-up row: chemicals and totals are sums that skip missing parts."""
    prices = UNIT_PRICES if prices is None else prices
    parts = {f"{n}_cost": F.col(c) * F.lit(float(prices[n])) for n, c in consumptions.items()}
    parts = {k: F.coalesce(v, F.lit(0.0)) if k.removesuffix("_cost") in chemicals else v for k, v in parts.items()}
    chem = filled_sum([v for k, v in parts.items() if k.removesuffix("_cost") in chemicals])
    other = filled_sum([v for k, v in parts.items() if k.removesuffix("_cost") not in chemicals])
    return df.withColumns({**parts, "chemicals_cost": chem, "aggregated_cost": other, "combined_cost": chem + other})


def area_cost(rate: str, unit_cost: str, weight: str, grade: str) -> Column:
    """Rate × cost × weight over one minus the last three digits of the grade id."""
    digits = F.replace(F.col(grade).cast("string"), F.lit(".0"), F.lit(""))
    tail = F.substring(digits, -3, 3).try_cast("int")
    return ratio(F.col(rate) * F.col(unit_cost) * F.col(weight), 1 - tail)


def allocate_by_share(df: DataFrame, cost: str, flows: Mapping[str, str]) -> DataFrame:
    """Split a cost over its users in proportion to their flows; missing flows count as zero in the sum."""
    whole = filled_sum(list(flows.values()))
    return df.withColumns({name: ratio(F.col(cost) * F.col(f), whole) for name, f in flows.items()})


def concentration(solids: str, water: str) -> Column:
    return ratio(F.col(solids), F.col(water) + F.col(solids))


def retention(white_water: str, headbox: str) -> Column:
    return 1 - ratio(F.col(white_water), F.col(headbox) * 10)


def fibre_weight(weight: str, moisture_pct: str, starch: str | Column) -> Column:
    return F.col(weight) * (1 - F.col(moisture_pct) / 100) - col(starch)


def split_grade(df: DataFrame, grade_id: str, grammages: Sequence[int] | None = None, types: Sequence[str] | None = None) -> DataFrame:
    """Grammage and paper type from the grade number, with optional whitelists."""
    out = df.withColumns(
        {"grammage": F.pmod(F.col(grade_id), F.lit(1000)).cast("int"), "paper_type": F.floor(F.col(grade_id) / 1000).cast("string")}
    )
    if grammages is not None:
        out = out.filter(F.col("grammage").isin(list(grammages)))
    if types is not None:
        out = out.filter(F.col("paper_type").isin(list(types)))
    return out


def one_hot(df: DataFrame, c: str, values: Sequence[str]) -> DataFrame:
    return df.withColumns({str(v): truthy(F.col(c) == v).cast("int") for v in values})


def per_area(value: str | Column, speed: str, width: str, scale: float = 1e5) -> Column:
    """Hourly amount over the hourly paper area (speed × width × 60)."""
    return ratio(col(value) * scale, F.col(speed) * F.col(width) * 60)


def area_indices(df: DataFrame, amounts: Mapping[str, tuple[str | Column, float]], speed: str, width: str, weight: str) -> DataFrame:
    """``x_sqm`` per area and ``x_index`` (per area, scaled, over the basis weight) per amount."""
    out = {}
    for name, (amount, scale) in amounts.items():
        sqm = per_area(amount, speed, width)
        out[f"{name}_sqm"] = sqm
        out[f"{name}_index"] = ratio(sqm * scale, weight)
    return df.withColumns(out)


def composite_cost(terms: Mapping[str, str | Column], prices: Mapping[str, float]) -> Column:
    return strict_sum([col(c) * F.lit(float(prices[n])) for n, c in terms.items()])


RULES = {
    "positive": lambda c: c <= 0,
    "non_negative": lambda c: c < 0,
    "non_positive": lambda c: c > 0,
}


def null_by_name(df: DataFrame, patterns: Mapping[str, Sequence[str]], skip: Sequence[str] = ()) -> DataFrame:
    """Null impossible values of all columns whose name contains a pattern of a rule in ``RULES``."""
    cols = []
    for c in df.columns:
        v = F.col(f"`{c}`")
        if c not in skip:
            for rule, parts in patterns.items():
                if any(p.lower() in c.lower() for p in parts):
                    bad = RULES[rule](F.col(f"`{c}`"))
                    v = F.when(~truthy(bad), v)
        cols.append(v.alias(c))
    return df.select(*cols)


def null_outside(df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]], cross: Mapping[str, Column] | None = None) -> DataFrame:
    """Null values outside their bounds; ``cross`` nulls a column where a test on other columns holds."""
    out = {}
    for c, (lo, hi) in bounds.items():
        ok = F.lit(True)
        if lo is not None:
            ok = ok & (F.col(c) >= lo)
        if hi is not None:
            ok = ok & (F.col(c) <= hi)
        out[c] = F.when(ok, F.col(c))
    for c, bad in (cross or {}).items():
        out[c] = F.when(~truthy(bad), out.get(c, F.col(c)))
    return df.withColumns(out)


def drop_matching(df: DataFrame, names: Sequence[str] = (), parts: Sequence[str] = ()) -> DataFrame:
    gone = [c for c in df.columns if c in names or any(p.lower() in c.lower() for p in parts)]
    return df.drop(*gone)


def keep_between(c: str, low: float, high: float, other: float = 0.0) -> Column:
    return F.when(F.col(c).between(low, high), F.col(c)).otherwise(F.lit(other))


def cap_at_mean(df: DataFrame, c: str) -> DataFrame:
    mean = df.agg(F.avg(c).alias("__mean"))
    return join_stats(df, mean, []).withColumn(c, F.when(F.col(c).isNotNull(), F.least(c, "__mean"))).drop("__mean")


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


@dataclass(frozen=True)
class Feature:
    """A derived column: what it reads from the table, which features it builds on, its expression."""

    raw: tuple[str, ...]
    expr: Callable[[], Column]
    needs: tuple[str, ...] = ()


def _evaporated(moisture_loss: Column) -> Column:
    # Fixed value: basis weight × speed × width to tonnes per hour.
    return F.col("basis_weight") * F.col("speed_pd1") * F.col("reel_width") * moisture_loss * 60 / 1e10


_SHEET = ("basis_weight", "speed_pd1", "reel_width")
_STARCH = ("starch_top", "starch_bottom")
_TANKS = ("concentration_2", "concentration_1")
_DEWATERING = ("dewatering_shoe_press", "dewatering_suction_roll", "dewatering_top_wire_zone_2", "dewatering_press_total", "dewatering_first_press")

FEATURES: dict[str, Feature] = {
    "starch_uptake": Feature(_STARCH, lambda: strict_sum(_STARCH)),
    "fibre_weight": Feature(
        ("basis_weight", "moisture"), lambda: fibre_weight("basis_weight", "moisture", "starch_uptake"), ("starch_uptake",)
    ),
    # Fixed value: 35 % dryness left after the press.
    "water_flow_predryer": Feature((*_SHEET, "moisture_predryer"), lambda: _evaporated(100 - 35 - F.col("moisture_predryer"))),
    "water_flow_afterdryer": Feature(
        (*_SHEET, "moisture_sizer", "moisture_actual"), lambda: _evaporated(F.col("moisture_sizer") - F.col("moisture_actual"))
    ),
    "water_flow": Feature(
        (), lambda: strict_sum(["water_flow_predryer", "water_flow_afterdryer"]), ("water_flow_predryer", "water_flow_afterdryer")
    ),
    "diluted_starch": Feature((*_STARCH, *_TANKS), lambda: ratio("starch_top", "concentration_2") + ratio("starch_bottom", "concentration_1")),
    "diluted_starch_index": Feature(
        ("starch_flow_2", "starch_flow_1", *_TANKS, "production_rate"),
        lambda: ratio(ratio("starch_flow_2", "concentration_2") + ratio("starch_flow_1", "concentration_1"), "production_rate"),
    ),
    "water_into_afterdryer": Feature(_SHEET, lambda: _evaporated(F.col("diluted_starch")), ("diluted_starch",)),
    "water_out_of_afterdryer": Feature(
        (*_SHEET, "moisture", "moisture_predryer"), lambda: _evaporated(F.col("moisture") - F.col("moisture_predryer"))
    ),
    "inv_rod_pressure_bottom": Feature(("rod_pressure_bottom",), lambda: safe_inverse("rod_pressure_bottom")),
    "inv_rod_pressure_top": Feature(("rod_pressure_top",), lambda: safe_inverse("rod_pressure_top")),
    "square_rod_pressure_bottom": Feature(("rod_pressure_bottom",), lambda: F.pow(F.col("rod_pressure_bottom").try_cast("double"), 2)),
    "square_rod_pressure_top": Feature(("rod_pressure_top",), lambda: F.pow(F.col("rod_pressure_top").try_cast("double"), 2)),
    "dewatering": Feature(_DEWATERING, lambda: filled_sum(_DEWATERING)),
}


def feature_order(requested: Sequence[str], registry: Mapping[str, Feature] = FEATURES) -> list[str]:
    """Requested features behind everything they need, each once."""
    unknown = [f for f in requested if f not in registry]
    if unknown:
        raise ValueError(f"unknown features: {', '.join(unknown)}")
    order: dict[str, None] = {}
    stack = [(f, False) for f in reversed(requested)]
    while stack:
        name, ready = stack.pop()
        if name in order:
            continue
        if ready:
            order[name] = None
        else:
            stack.append((name, True))
            stack.extend((n, False) for n in reversed(registry[name].needs))
    return list(order)


def raw_inputs(requested: Sequence[str], registry: Mapping[str, Feature] = FEATURES) -> list[str]:
    """Table columns that the requested features and their needs read."""
    return list(dict.fromkeys(c for f in feature_order(requested, registry) for c in registry[f].raw))


def create_features(
    df: DataFrame, requested: Sequence[str], keep: Sequence[str] | None = None, errors: str = "raise",
    registry: Mapping[str, Feature] = FEATURES,
) -> DataFrame:
    """Add named features with their dependencies; columns that exist already stay as they are.

    ``errors="ignore"`` leaves out features whose inputs are missing.
    """
    out = df
    for name in feature_order(requested, registry):
        if name in out.columns:
            continue
        feature = registry[name]
        missing = [c for c in (*feature.raw, *feature.needs) if c not in out.columns]
        if missing and errors == "raise":
            raise ValueError(f"{name} needs missing columns: {', '.join(missing)}")
        if not missing:
            out = out.withColumn(name, feature.expr())
    return out if keep is None else out.select(*[c for c in keep if c in out.columns])


def bounds_for(cols: Sequence[str], bound: float | Sequence[float] | Mapping[str, float] | None) -> dict[str, float | None]:
    """One bound per column from a number, a list in column order, or a mapping."""
    if bound is None or isinstance(bound, (int, float)):
        return dict.fromkeys(cols, bound)
    if isinstance(bound, Mapping):
        return {c: bound.get(c) for c in cols}
    return dict(zip(cols, bound, strict=False))


def null_beyond(df: DataFrame, cols: Sequence[str], low=None, high=None) -> DataFrame:
    """Null values below ``low`` or above ``high``, each given as number, list or mapping."""
    lo, hi = bounds_for(cols, low), bounds_for(cols, high)
    return null_outside(df, {c: (lo.get(c), hi.get(c)) for c in cols})
