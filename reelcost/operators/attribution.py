"""Attribution of cost changes to process variables."""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.ordered import top_rows
from ..core.quantiles import group_quantiles
from ..core.sizing import join_stats
from .linear import Predict
from .opaque import OpaqueModel
from .periods import BASELINE, TARGET

EXACT_LIMIT = 15
POINTS = 1 << 18  # rows that one call of an opaque model predicts for SHAP values


def mean_pairs(df: DataFrame, features: Sequence[str], keys: Sequence[str], period: str = "period", extra: Sequence[str] = ()) -> DataFrame:
    """Baseline (``x_1``) and target (``x_2``) means per key, for keys present on both sides."""
    base, target = F.col(period) == BASELINE, F.col(period) == TARGET
    cols = [*features, *extra]
    wide = df.groupBy(*keys).agg(
        F.count(F.when(base, 1)).alias("__n1"), F.count(F.when(target, 1)).alias("__n2"),
        *[F.avg(F.when(base, F.col(c))).alias(f"{c}_1") for c in cols],
        *[F.avg(F.when(target, F.col(c))).alias(f"{c}_2") for c in cols],
    )
    return wide.filter((F.col("__n1") > 0) & (F.col("__n2") > 0)).drop("__n1", "__n2")


def _switched(predict: Predict, features: Sequence[str], mask: Column) -> Column:
    """Model cost with the features of the mask taken from the second row."""
    bit = {f: mask.bitwiseAND(1 << i) != 0 for i, f in enumerate(features)}
    return predict(lambda f: F.when(bit[f], F.col(f"{f}_2")).otherwise(F.col(f"{f}_1")) if f in bit else F.col(f))


def _long(sums: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    return sums.unpivot(list(keys), list(features), "variable", "contribution")


def model_change(pairs: DataFrame, keys: Sequence[str], predict: Predict) -> DataFrame:
    """Model cost of both rows and their difference."""
    one, two = predict(lambda f: F.col(f"{f}_1")), predict(lambda f: F.col(f"{f}_2"))
    return pairs.select(*keys, one.alias("cost_1"), two.alias("cost_2"), (two - one).alias("delta_cost"))


def shapley_exact(
    pairs: DataFrame, keys: Sequence[str], features: Sequence[str], predict: Predict, cost: str | None = None
) -> DataFrame:
    """Exact Shapley contributions of a cost change, over all coalitions of features.

    Every coalition's cost is used once, with its weight for each feature, so one map-side
    sum per pair is all that is shuffled. With ``cost`` an ``unknown`` row holds the part of the
    observed change that the model does not explain.
    """
    n = len(features)
    if n > EXACT_LIMIT:
        raise ValueError(f"{n} features mean 2^{n} coalitions; use shapley_sampled beyond {EXACT_LIMIT}")
    size = F.bit_count("__mask")
    fact = math.factorial
    joined = F.array(*[F.lit(fact(r - 1) * fact(n - r) / fact(n) if r else 0.0) for r in range(n + 1)])
    absent = F.array(*[F.lit(fact(r) * fact(n - r - 1) / fact(n) if r < n else 0.0) for r in range(n + 1)])
    rows = pairs.withColumn("__mask", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
    rows = rows.select(
        *keys, "__mask", _switched(predict, features, F.col("__mask")).alias("__v"), F.get(joined, size).alias("__in"), F.get(absent, size).alias("__out")
    )
    share = lambda i: F.when(F.col("__mask").bitwiseAND(1 << i) != 0, F.col("__in")).otherwise(-F.col("__out"))
    sums = rows.groupBy(*keys).agg(*[F.sum(F.col("__v") * share(i)).alias(f) for i, f in enumerate(features)])
    out = _long(sums, keys, features)
    return out if cost is None else out.unionByName(unexplained(pairs, keys, predict, cost))


def unexplained(pairs: DataFrame, keys: Sequence[str], predict: Predict, cost: str) -> DataFrame:
    change = predict(lambda f: F.col(f"{f}_2")) - predict(lambda f: F.col(f"{f}_1"))
    rest = F.col(f"{cost}_2") - F.col(f"{cost}_1") - change
    return pairs.select(*keys, F.lit("unknown").alias("variable"), rest.alias("contribution"))


def _random_order(n: int, seed: int, m: Column) -> Column:
    """Numbers of ``n`` features in the random order of permutation ``m``."""
    hashed = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.xxhash64(F.lit(seed), m, i).alias("h"), i.alias("i")))
    return F.transform(F.array_sort(hashed), lambda s: s["i"])


def shapley_sampled(
    pairs: DataFrame, keys: Sequence[str], features: Sequence[str], predict: Predict, permutations: int = 500, seed: int = 0,
    cost: str | None = None,
) -> DataFrame:
    """Monte Carlo Shapley contributions from random feature orders.

    Orders come from hashes, so a rerun or a retried task draws the same ones. Along one order
    the costs telescope: each prefix cost counts for the feature that joined and against the next.
    """
    n = len(features)
    drawn = pairs.withColumn("__m", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn("__o", _random_order(n, seed, F.col("__m")))
    steps = drawn.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n))))
    mask = F.aggregate(F.slice("__o", 1, F.col("__k")), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.expr("1L") * F.pow(F.lit(2.0), i).cast("long")))
    steps = steps.withColumn("__mask", mask)
    steps = steps.select(*keys, "__o", "__k", _switched(predict, features, F.col("__mask")).alias("__v"))
    pos = lambda i: F.array_position("__o", F.lit(i))
    sign = lambda i: F.when(pos(i) == F.col("__k"), 1.0).when(pos(i) == F.col("__k") + 1, -1.0).otherwise(0.0)
    sums = steps.groupBy(*keys).agg(*[(F.sum(F.col("__v") * sign(i)) / permutations).alias(f) for i, f in enumerate(features)])
    out = _long(sums, keys, features)
    return out if cost is None else out.unionByName(unexplained(pairs, keys, predict, cost))


def feature_spread(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Sample deviation and the 5 % and 95 % quantiles per feature (zero deviation for a single value)."""
    num = df.select(*[F.col(f).try_cast("double").alias(f) for f in features])
    sd = num.agg(*[F.when(F.count(f) > 1, F.stddev_samp(f)).when(F.count(f) == 1, 0.0).alias(f) for f in features])
    q = group_quantiles(num, [], {f"{p}_{f}": (F.col(f), v) for f in features for p, v in (("lo", 0.05), ("hi", 0.95))})
    both = sd.crossJoin(q)
    rows = F.array(*[F.struct(F.lit(f).alias("variable"), F.col(f).alias("std"), F.col(f"lo_{f}").alias("p05"), F.col(f"hi_{f}").alias("p95")) for f in features])
    return both.select(F.inline(rows))


def relevance(
    pairs: DataFrame,
    contributions: DataFrame,
    spread: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    min_over_std: float = 0.25,
    min_over_range: float = 0.05,
    min_abs: float | Mapping[str, float] | None = None,
) -> DataFrame:
    """Diagnostics per key and variable: change relative to the usual spread, and a keep flag."""
    rows = F.array(*[F.struct(F.lit(f).alias("variable"), F.col(f"{f}_1").alias("value_1"), F.col(f"{f}_2").alias("value_2")) for f in features])
    values = pairs.select(*keys, F.inline(rows))
    got = join_stats(join_stats(values, spread, ["variable"]), contributions, [*keys, "variable"], null_safe=True)
    delta = F.col("value_2") - F.col("value_1")
    width = F.col("p95") - F.col("p05")
    got = got.withColumns(
        {
            "delta": delta,
            "abs_delta": F.abs(delta),
            "delta_over_std": F.when(F.col("std") > 0, F.abs(delta) / F.col("std")),
            "delta_over_range": F.when(width > 0, F.abs(delta) / width),
            "contribution": F.coalesce("contribution", F.lit(0.0)),
        }
    )
    small = F.coalesce(F.col("delta_over_std") < min_over_std, F.lit(False)) | F.coalesce(F.col("delta_over_range") < min_over_range, F.lit(False))
    if isinstance(min_abs, Mapping):
        for f, limit in min_abs.items():
            small = small | ((F.col("variable") == f) & (F.col("abs_delta") < limit))
    elif min_abs is not None:
        small = small | (F.col("abs_delta") < min_abs)
    unseen = F.col("std").isNull() & F.col("p05").isNull()
    return got.withColumns({"abs_contribution": F.abs("contribution"), "keep": unseen | ~F.coalesce(small, F.lit(False))})


def keep_relevant(diagnostics: DataFrame, keys: Sequence[str], top_n: int | None = None) -> DataFrame:
    kept = diagnostics.filter("keep")
    return kept if top_n is None else top_rows(kept, keys, [F.desc("abs_contribution"), F.asc("variable")], top_n)


def relative_contributions(contributions: DataFrame, pairs: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Contribution over the absolute total per key, with the change of the variable."""
    total = contributions.groupBy(*keys).agg(F.sum("contribution").alias("__t"))
    rows = F.array(*[F.struct(F.lit(f).alias("variable"), (F.col(f"{f}_2") - F.col(f"{f}_1")).alias("value_change")) for f in features])
    change = pairs.select(*keys, F.inline(rows))
    got = join_stats(join_stats(contributions, total, keys, null_safe=True), change, [*keys, "variable"], null_safe=True)
    return got.select(*keys, "variable", F.try_divide("contribution", F.abs("__t")).alias("contribution"), "value_change")


def priority_score(diagnostics: DataFrame) -> DataFrame:
    """Absolute contribution damped by small changes."""
    damp = lambda c: F.least(F.coalesce(F.col(c), F.lit(0.0)), F.lit(1.0))
    return diagnostics.withColumn("priority_score", F.col("abs_contribution") * damp("delta_over_std") * damp("delta_over_range"))


def linear_shap(df: DataFrame, keys: Sequence[str], coefs: Mapping[str, float], by: Sequence[str] = (), intercept: float = 0.0) -> DataFrame:
    """(x − mean) · coefficient per row and feature, long form.

    The background is all rows (of the group): its means come from one aggregate. ``value`` is
    the feature scaled to its range, ``rank`` the spread of its contributions, and
    ``base_value`` plus a row's contributions is the prediction.
    """
    by = list(by)
    feats = list(coefs)
    stats = df.groupBy(*by).agg(
        *[e for f in feats for e in (F.avg(f).alias(f"__m_{f}"), F.min(f).alias(f"__lo_{f}"), F.max(f).alias(f"__hi_{f}"))]
    )
    got = join_stats(df, stats, by, null_safe=True)
    base = sum((F.col(f"__m_{f}") * float(c) for f, c in coefs.items()), F.lit(float(intercept)))
    span = lambda f: F.col(f"__hi_{f}") - F.col(f"__lo_{f}")
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("variable"),
                F.try_divide(F.col(f) - F.col(f"__lo_{f}"), span(f)).alias("value"),
                ((F.col(f) - F.col(f"__m_{f}")) * float(c)).alias("shap"),
                (span(f) * abs(float(c))).alias("rank"),
            )
            for f, c in coefs.items()
        ]
    )
    return got.select(*keys, *[b for b in by if b not in keys], base.alias("base_value"), F.inline(rows))


POOL_GRADES = 2_000  # grades whose background rows may be broadcast


def _with_background(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], grade: str, background: int, explained: int | None, min_background: int, seed: int
) -> DataFrame:
    """Each explained row (``x_2``) with the background rows of its grade, or of all grades, as the array ``__pool`` of feature structs."""
    h = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *[F.col(k) for k in keys])
    data = df.dropna(subset=list(features))
    to_explain = data
    if explained is not None:
        to_explain = top_rows(data.withColumn("__h", h("explain")), [grade], [F.asc("__h"), *[F.asc(k) for k in keys]], explained).drop("__h")
    pool = top_rows(data.withColumn("__h", h("background")), [grade], [F.asc("__h"), *[F.asc(k) for k in keys]], background, rank="__r")
    whole = data.withColumn("__h", h("all")).orderBy("__h", *keys).limit(background)
    w = Window.orderBy("__h", *keys)  # at most ``background`` rows
    whole = whole.select(F.row_number().over(w).alias("__r"), *features)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__r", *features))), lambda s: F.struct(*[s[f].alias(f) for f in features]))
    own = pool.groupBy(grade).agg(listed.alias("__own"))
    rows = join_stats(to_explain.select(*keys, grade, *[F.col(f).alias(f"{f}_2") for f in features]), own, [grade], max_rows=POOL_GRADES)
    rows = join_stats(rows, whole.agg(listed.alias("__all")), [])
    return rows.withColumn("__pool", F.when(F.size("__own") >= min_background, F.col("__own")).otherwise(F.col("__all"))).drop("__own", "__all")


LISTED_ORDERS = 6  # features whose orders are all listed


def _places(n: int, h: Column) -> Column:
    """Places of ``n`` features in a random order, from a hash."""
    if n <= LISTED_ORDERS:
        listed = [list(p) for p in itertools.permutations(range(n))]
        return F.get(F.lit(listed), F.pmod(h, F.lit(len(listed))).cast("int"))
    hashed = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.xxhash64(h, i).alias("h"), i.alias("i")))
    return F.transform(F.array_sort(hashed), lambda s: s["i"])


def _drawn(d: Column, keys: Sequence[str], seed: int) -> Column:
    """The background row of draw ``d``."""
    return F.element_at("__pool", (F.pmod(F.xxhash64(F.lit(seed), d, *keys), F.size("__pool")) + 1).cast("int"))


def sampled_shap(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], predict: Predict, grade: str = "grade", background: int = 200,
    explained: int | None = None, min_background: int = 30, permutations: int = 20, seed: int = 0,
) -> DataFrame:
    """Sampled Shapley values of a model's prediction against rows of the same grade.

    Every complete row is explained unless ``explained`` asks for so many a grade. Background rows
    (a sample: ``background``) are drawn per grade by hash order, which trims every grade before the shuffle. Grades with too few background rows use rows of all grades. Each
    permutation pairs an explained row with one background row and a random order of the features of its own, inside the row; values of rows with equal keys are added.
    """
    features = list(features)
    n = len(features)
    rows = _with_background(df, keys, features, grade, background, explained, min_background, seed)
    drawn = lambda d: F.struct(_drawn(d, keys, seed).alias("x"), _places(n, F.xxhash64(F.lit(seed), F.lit("order"), d, *keys)).alias("at"))

    def cost(k: int, s: Column) -> Column:
        # The first k features of the draw's order come from the explained row.
        switched = lambda i, f: F.when(F.get(s["at"], F.lit(i)) < k, F.col(f"{f}_2")).otherwise(s["x"][f]) if k else s["x"][f]
        at = {f: switched(i, f) for i, f in enumerate(features)}
        return predict(lambda f: at.get(f, F.col(f))).cast("double")

    def shares(s: Column) -> Column:
        step = lambda i: F.get(s["c"], F.get(s["at"], F.lit(i)) + 1) - F.get(s["c"], F.get(s["at"], F.lit(i)))
        return F.struct(*[step(i).alias(f"s{i}") for i in range(n)])

    # The last point of every draw is the explained row itself.
    rows = rows.withColumn("__all", predict(lambda f: F.col(f"{f}_2") if f in features else F.col(f)).cast("double"))
    draws = F.transform(F.sequence(F.lit(1), F.lit(permutations)), drawn)
    costs = F.transform(draws, lambda s: F.struct(s["at"].alias("at"), F.array(*[cost(k, s) for k in range(n)], F.col("__all")).alias("c")))
    rows = rows.withColumn("__s", F.transform(costs, shares))
    total = lambda i: F.aggregate("__s", F.lit(0.0), lambda a, s: a + s[f"s{i}"])
    rows = rows.select(*keys, grade, *[total(i).alias(f"__t{i}") for i in range(n)])
    means = rows.groupBy(*keys, grade).agg(*[F.sum(F.col(f"__t{i}") / permutations).alias(f) for i, f in enumerate(features)])
    return means.unpivot([*keys, grade], features, "variable", "shap")


def opaque_shap(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], model: OpaqueModel, grade: str = "grade", background: int = 200,
    explained: int | None = None, min_background: int = 30, permutations: int = 20, seed: int = 0,
) -> DataFrame:
    """``sampled_shap`` of a model that only predicts batches: one row per row and variable, with its base value and prediction.

    A row's draws stay with it: the points of its permutations (features switched one after another from the background
    row to the explained one) are made and averaged inside the Arrow batch, a bounded number of them in one call of
    the model. A row's values add up to its prediction less its base value, the mean prediction of the background rows it
    was paired with. Rows with equal keys are one.
    """
    features = list(features)
    n = len(features)
    rows = _with_background(df, keys, features, grade, background, explained, min_background, seed)
    ids = [*keys, *[c for c in [grade] if c not in keys]]
    every = F.sequence(F.lit(1), F.lit(permutations))
    one = F.flatten(F.transform(F.transform(every, lambda d: _drawn(d, keys, seed)), lambda s: F.array(*[s[f].cast("double") for f in features])))
    order = F.transform(every, lambda d: F.xxhash64(F.lit(seed), F.lit("order"), d, *keys))
    ready = rows.select(*ids, one.alias("__x"), order.alias("__o"), *[F.col(f"{f}_2").cast("double").alias(f"{f}_2") for f in features])

    def explain(batches):
        predict = model.loaded()
        step = max(1, POINTS // (permutations * (n + 1)))
        for whole in batches:
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                one = b.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                two = np.column_stack([b.column(f"{f}_2").to_numpy(zero_copy_only=False) for f in features]).repeat(permutations, axis=0)
                turns = _orders(b.column("__o").flatten().to_numpy().view(np.uint64), n)
                place = np.empty_like(turns)
                np.put_along_axis(place, turns, np.arange(n)[None, :].repeat(len(turns), 0), axis=1)
                # Point j of a draw has the first j features of its order from the explained row.
                points = np.where(place[:, None, :] < np.arange(n + 1)[None, :, None], two[:, None, :], one[:, None, :])
                cost = np.asarray(predict(points.reshape(-1, n)), dtype=float).reshape(len(turns), n + 1)
                found = np.column_stack([cost[:, 0], cost[:, -1], np.take_along_axis(np.diff(cost, axis=1), place, axis=1)])
                found = found.reshape(b.num_rows, permutations, n + 2).mean(axis=1)
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in ids], *[pa.array(x) for x in found.T.copy()]], names=[*ids, *names])

    names = ["base_value", "prediction", *[f"__s{i}" for i in range(n)]]
    shape = T.StructType([*[ready.schema[i] for i in ids], *[T.StructField(c, T.DoubleType()) for c in names]])
    means = ready.mapInArrow(explain, shape).groupBy(*ids).agg(*[F.avg(c).alias(c) for c in names])
    shares = F.array(*[F.struct(F.lit(f).alias("variable"), F.col(f"__s{i}").alias("shap")) for i, f in enumerate(features)])
    return means.select(*ids, "base_value", "prediction", F.inline(shares))


def _orders(h: np.ndarray, n: int) -> np.ndarray:
    """A random order of ``n`` features per hash."""
    with np.errstate(over="ignore"):
        x = h[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.argsort(x ^ (x >> np.uint64(31)), axis=1, kind="stable")


def shap_table(df: DataFrame, keys: Sequence[str], features: Sequence[str], prefix: str = "shap_") -> DataFrame:
    """Row × feature × value × contribution from a wide table with one ``shap_x`` column per feature."""
    rows = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("feature_value"), F.col(f"{prefix}{f}").alias("shap_value")) for f in features]
    )
    return df.select(*keys, F.inline(rows))


def shap_ranking(long: DataFrame, feature: str = "variable", value: str = "shap", by: Sequence[str] = ()) -> DataFrame:
    return long.groupBy(*by, feature).agg(F.avg(F.abs(value)).alias("mean_abs_shap"), F.avg(value).alias("mean_shap"))


def top_with_other(ranking: DataFrame, n: int, feature: str = "variable", by: Sequence[str] = ()) -> DataFrame:
    """The ``n − 1`` strongest features and the sum of the rest as ``other`` (one row per feature comes in)."""
    w = Window.partitionBy(*by).orderBy(F.desc("mean_abs_shap"), feature)
    ranked = ranking.withColumn("__rk", F.row_number().over(w))
    name = F.when(F.col("__rk") < n, F.col(feature)).otherwise("other")
    place = F.least(F.col("__rk"), F.lit(n))
    return ranked.groupBy(*by, name.alias(feature), place.alias("place")).agg(F.sum("mean_abs_shap").alias("mean_abs_shap"))


def top_driver_variables(diagnostics: DataFrame, n: int = 7, order: str = "priority_score", by: Sequence[str] = ()) -> DataFrame:
    """Names of the strongest drivers, per slice of ``by``, by priority, signed or absolute contribution."""
    if by:
        return top_rows(diagnostics, list(by), [F.desc(order), F.col("variable")], n).select(*by, "variable")
    return diagnostics.orderBy(F.desc(order), "variable").limit(n).select("variable")
