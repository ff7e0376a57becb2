"""Linear statistics from one distributed aggregate of sums and products."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.quantiles import group_quantiles
from ..core.sizing import join_stats

Predict = Callable[[Callable[[str], Column]], Column]


def standardise(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(x − mean) / population deviation, overall or per group; a constant column becomes zero."""
    by = list(by)
    stats = df.groupBy(*by).agg(*[e for c in cols for e in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))])
    got = join_stats(df, stats, by, null_safe=True)
    scaled = {
        c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}")) for c in cols
    }
    return got.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def moments(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), center: Mapping[str, float] | None = None) -> DataFrame:
    """Per group: ``n``, ``sums`` and ``products`` (k×k, row by row) of the columns over complete rows.

    Values are shifted by a common centre first, which keeps the products accurate and lets
    the moments of groups be added up.
    """
    center = center or {}
    x = [F.col(c).cast("double") - float(center.get(c, 0.0)) for c in cols]
    complete = df.dropna(subset=list(cols)).select(*by, *[v.alias(f"__x{i}") for i, v in enumerate(x)])
    k = len(cols)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    agg = complete.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"__x{i}").alias(f"__s{i}") for i in range(k)],
        *[F.sum(F.col(f"__x{i}") * F.col(f"__x{j}")).alias(f"__p{i}_{j}") for i, j in upper],
    )
    cells = [F.col(f"__p{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)]
    return agg.select(*by, "n", F.array(*[F.col(f"__s{i}") for i in range(k)]).alias("sums"), F.array(*cells).alias("products"))


def column_means(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return {c: float(row[c] or 0.0) for c in cols}


def centered(n: float, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and centred sum-of-products matrix."""
    k = len(sums)
    p = np.asarray(products, dtype=float).reshape(k, k)
    mean = np.asarray(sums, dtype=float) / n
    return mean, p - n * np.outer(mean, mean)


def pls_from_moments(xx: np.ndarray, xy: np.ndarray, n_components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """PLS for one target from X'X and X'y: rotations, loadings and inner coefficients.

    The sign of a component is fixed by its largest loading, which is made positive.
    """
    s, c = xx.copy(), xy.copy()
    w_all, p_all, q_all = [], [], []
    for _ in range(n_components):
        size = np.linalg.norm(c)
        if size < 1e-12:
            break
        w = c / size
        tt = float(w @ s @ w)
        if tt < 1e-12:
            break
        p = s @ w / tt
        if p[np.argmax(np.abs(p))] < 0:
            w, p = -w, -p
        q = float(c @ w) / tt
        s = s - tt * np.outer(p, p)
        c = c - tt * q * p
        w_all.append(w)
        p_all.append(p)
        q_all.append(q)
    k = len(xy)
    if not w_all:
        return np.zeros((k, 0)), np.zeros((k, 0)), np.zeros(0)
    w, p = np.column_stack(w_all), np.column_stack(p_all)
    return w @ np.linalg.inv(p.T @ w), p, np.array(q_all)


PLS_SCHEMA = "n long, coefs array<array<double>>, intercepts array<double>, loadings array<array<double>>, beta array<double>, beta0 double"


def fit_pls(
    df: DataFrame, features: Sequence[str], target: str, n_components: int = 4, by: Sequence[str] = (), min_rows: int = 2
) -> DataFrame:
    """One PLS model row per group: raw-scale score coefficients, loadings and prediction weights.

    The data is read once for the means and once for the products; the small algebra runs
    per group inside tasks.
    """
    cols = [*features, target]
    center = column_means(df, cols)
    shift = np.array([center[c] for c in cols])
    mom = moments(df, cols, by, center)
    k = len(features)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for rec in pdf.to_dict("records"):
                n = rec["n"]
                most = int(min(n_components, n - 1, k))
                if n < min_rows or most < 1:
                    continue
                mean, ss = centered(n, rec["sums"], rec["products"])
                mean = mean + shift
                sd = np.sqrt(np.maximum(np.diag(ss), 0.0) / n)
                sd[sd == 0] = 1.0
                unit = ss / np.outer(sd, sd)
                rot, load, q = pls_from_moments(unit[:k, :k], unit[:k, k], most)
                coefs = rot / sd[:k, None]
                beta = (rot @ q) / sd[:k] * sd[k]
                rows.append(
                    {
                        **{b: rec[b] for b in by},
                        "n": n,
                        "coefs": [list(c) for c in coefs.T],
                        "intercepts": list(-(mean[:k] @ coefs)),
                        "loadings": [list(c) for c in load.T],
                        "beta": list(beta),
                        "beta0": float(mean[k] - mean[:k] @ beta),
                    }
                )
            yield pd.DataFrame(rows, columns=[*by, "n", "coefs", "intercepts", "loadings", "beta", "beta0"])

    schema = T.StructType([*[mom.schema[b] for b in by], *T.StructType.fromDDL(PLS_SCHEMA).fields])
    return mom.mapInPandas(solve, schema)


def _vector(features: Sequence[str]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features])


def _linear(values: Column, coefs: Column, start: Column) -> Column:
    return F.aggregate(F.zip_with(values, coefs, lambda a, b: a * b), start, lambda s, v: s + v)


def pls_scores(
    df: DataFrame,
    model: DataFrame,
    features: Sequence[str],
    n_components: int,
    by: Sequence[str] = (),
    fallback: DataFrame | None = None,
    unknown_group: str = "global",
    prefix: str = "pls",
) -> DataFrame:
    """Add the component scores of each row's group model.

    Groups without a model use the global ``fallback``; with ``unknown_group="null"`` their
    scores stay NULL, with ``"error"`` a task fails on them. Missing components are NULL. All
    other columns pass through.
    """
    if unknown_group not in ("global", "null", "error"):
        raise ValueError(f"unknown rule: {unknown_group}")
    slim = model.select(*by, F.col("coefs").alias("__c"), F.col("intercepts").alias("__i"))
    got = join_stats(df, slim, by)
    if fallback is not None and unknown_group == "global":
        got = join_stats(got, fallback.select(F.col("coefs").alias("__gc"), F.col("intercepts").alias("__gi")), [])
        got = got.withColumns({"__c": F.coalesce("__c", "__gc"), "__i": F.coalesce("__i", "__gi")})
    if unknown_group == "error":
        fail = F.raise_error(F.concat(F.lit("no model for group "), F.concat_ws("/", *[F.col(b).cast("string") for b in by])))
        got = got.withColumn("__c", F.when(F.col("__c").isNull(), fail).otherwise(F.col("__c")))
    x = _vector(features)
    scores = {f"{prefix}_{a + 1}": _linear(x, F.get("__c", F.lit(a)), F.get("__i", F.lit(a))) for a in range(n_components)}
    return got.select(*df.columns, *[v.alias(k) for k, v in scores.items()])


def pls_loadings(model: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Loadings in long form: (group, component, feature, weight)."""
    names = F.array(*[F.lit(f) for f in features])
    per = model.select(*by, F.posexplode("loadings").alias("c", "w"))
    flat = per.select(*by, (F.col("c") + 1).alias("component"), F.explode(F.arrays_zip(names.alias("feature"), F.col("w").alias("weight"))).alias("z"))
    return flat.select(*by, "component", F.col("z.feature").alias("feature"), F.col("z.weight").alias("weight"))


def dominant_loadings(loadings: DataFrame, by: Sequence[str] = (), share: float = 0.8) -> DataFrame:
    """Features whose absolute loading exceeds a share of the component's largest."""
    keys = [*by, "component"]
    peak = loadings.groupBy(*keys).agg(F.max(F.abs("weight")).alias("__peak"))
    got = join_stats(loadings, peak, keys, null_safe=True)
    return got.filter(F.abs("weight") > F.col("__peak") * share).drop("__peak")


def fold_moments(df: DataFrame, cols: Sequence[str], fold: str) -> tuple[dict[int, tuple], np.ndarray]:
    """Moments per fold number (a handful of k×k matrices) and the common centre."""
    center = column_means(df, cols)
    rows = moments(df, cols, [fold], center).collect()
    return {int(r[fold]): (r["n"], np.array(r["sums"]), np.array(r["products"])) for r in rows}, np.array([center[c] for c in cols])


def _add(parts):
    return reduce(lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2]), parts)


def expanding_splits(by_fold: Mapping[int, tuple]) -> list[tuple[tuple, tuple]]:
    """(training moments, test moments) of folds that train on everything before them."""
    return [(_add([by_fold[g] for g in by_fold if g < f]), by_fold[f]) for f in sorted(by_fold) if f > 0]


def held_out_rmse(test: tuple, beta: np.ndarray, beta0: float) -> float:
    """RMSE of a linear model from the test moments; the last column is the target."""
    n, s, p = test
    k = len(beta)
    p = p.reshape(k + 1, k + 1)
    a = np.concatenate([-beta, [1.0]])
    sse = a @ p @ a - 2 * beta0 * (a @ s) + n * beta0 * beta0
    return float(np.sqrt(max(sse, 0.0) / n))


def ridge_from_moments(train: tuple, alpha: float) -> tuple[np.ndarray, float]:
    """Ridge on standardised inputs, returned on the raw (shifted) scale."""
    n, s, p = train
    mean, ss = centered(n, s, p)
    k = len(s) - 1
    sd = np.sqrt(np.maximum(np.diag(ss)[:k], 0.0) / n)
    sd[sd == 0] = 1.0
    a = ss[:k, :k] / np.outer(sd, sd) + alpha * np.eye(k)
    beta = np.linalg.solve(a, ss[:k, k] / sd) / sd
    return beta, float(mean[k] - mean[:k] @ beta)


def _pls_model(train: tuple, n_components: int) -> tuple[np.ndarray, float]:
    n, s, p = train
    mean, ss = centered(n, s, p)
    k = len(s) - 1
    sd = np.sqrt(np.maximum(np.diag(ss), 0.0) / n)
    sd[sd == 0] = 1.0
    unit = ss / np.outer(sd, sd)
    rot, _, q = pls_from_moments(unit[:k, :k], unit[:k, k], n_components)
    beta = (rot @ q) / sd[:k] * sd[k]
    return beta, float(mean[k] - mean[:k] @ beta)


def pls_component_choice(df: DataFrame, features: Sequence[str], target: str, fold: str, max_components: int = 20) -> DataFrame:
    """Mean cross-validated RMSE for 1 to ``max_components`` components (folds 1…k, each left out once)."""
    by_fold, _ = fold_moments(df, [*features, target], fold)
    rows = []
    for a in range(1, min(max_components, len(features)) + 1):
        errs = [
            held_out_rmse(by_fold[f], *_pls_model(_add([by_fold[g] for g in by_fold if g != f]), a)) for f in by_fold
        ]
        rows.append((a, float(np.mean(errs))))
    return df.sparkSession.createDataFrame(rows, "n_components int, rmse double")


def ridge_cv(
    df: DataFrame, features: Sequence[str], target: str, fold: str, alphas: Sequence[float] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Ridge with expanding time folds: (RMSE per penalty, coefficients refitted on all rows).

    ``fold`` is 0 for rows that only train. Every fit uses the per-fold moments, so the data is
    read once whatever the number of penalties and folds.
    """
    # Twenty penalties from 10 to 1000 on a log grid.
    alphas = np.logspace(1, 3, 20) if alphas is None else np.asarray(alphas, dtype=float)
    by_fold, center = fold_moments(df, [*features, target], fold)
    splits = expanding_splits(by_fold)
    scores = [(float(a), float(np.mean([held_out_rmse(te, *ridge_from_moments(tr, a)) for tr, te in splits]))) for a in alphas]
    best = min(scores, key=lambda r: r[1])[0]
    beta, beta0 = ridge_from_moments(_add(list(by_fold.values())), best)
    beta0 = beta0 + center[-1] - center[:-1] @ beta
    spark = df.sparkSession
    table = [(f, float(b)) for f, b in zip(features, beta)] + [("(intercept)", float(beta0))]
    return spark.createDataFrame(scores, "alpha double, rmse double"), spark.createDataFrame(table, "feature string, coef double")


def score_feature_sets(
    df: DataFrame, candidates: DataFrame, features: Sequence[str], target: str, fold: str, alpha: float = 10.0, weight: float = 0.1
) -> DataFrame:
    """Cross-validated ridge RMSE plus a collinearity penalty for given feature subsets.

    ``candidates`` has ``id`` and ``features`` (array of names); subsets are scored in parallel
    from blocks of the same moments.
    """
    by_fold, _ = fold_moments(df, [*features, target], fold)
    splits = expanding_splits(by_fold)
    total = _add(list(by_fold.values()))
    pos = {f: i for i, f in enumerate(features)}
    k = len(features) + 1

    def block(m, idx):
        n, s, p = m
        return n, s[idx], p.reshape(k, k)[np.ix_(idx, idx)].ravel()

    def score(frames):
        for pdf in frames:
            out = []
            for cid, names in zip(pdf["id"], pdf["features"]):
                idx = np.array([*[pos[f] for f in names], k - 1])
                errs = [held_out_rmse(block(te, idx), *ridge_from_moments(block(tr, idx), alpha)) for tr, te in splits]
                _, ss = centered(*block(total, idx))
                xs = ss[:-1, :-1]
                d = np.sqrt(np.diag(xs))
                d[d == 0] = 1.0
                eig = np.linalg.eigvalsh(np.atleast_2d(xs / np.outer(d, d)))
                penalty = float(np.log(eig.max() / (eig.min() + 1e-8)))
                rmse = float(np.mean(errs))
                out.append((cid, rmse, penalty, rmse + weight * penalty))
            yield pd.DataFrame(out, columns=["id", "rmse", "penalty", "score"])

    schema = T.StructType([candidates.schema["id"], *T.StructType.fromDDL("rmse double, penalty double, score double").fields])
    return candidates.select("id", "features").mapInPandas(score, schema)


def effective_coefficients(df: DataFrame, predict: Predict, features: Sequence[str], relative_step: float = 1e-4) -> DataFrame:
    """Mean central difference of a model's predictions per feature, with steps relative to its deviation."""
    sd = df.agg(*[F.stddev_pop(f).alias(f) for f in features])
    steps = sd.select(*[(F.when(F.col(f) > 0, F.col(f)).otherwise(1.0) * relative_step).alias(f"__h_{f}") for f in features])
    got = join_stats(df, steps, [])

    def moved(f, sign):
        return predict(lambda c: F.col(c) + sign * F.col(f"__h_{f}") if c == f else F.col(c))

    wide = got.agg(*[F.avg((moved(f, 1) - moved(f, -1)) / (2 * F.col(f"__h_{f}"))).alias(f) for f in features])
    return wide.unpivot([], list(features), "feature", "coef")


def correlation_edges(df: DataFrame, cols: Sequence[str], threshold: float) -> DataFrame:
    """Column pairs whose absolute Pearson correlation reaches the threshold; one pass for all pairs."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    wide = df.agg(*[F.corr(a, b).alias(f"__{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.abs(f"__{i}").alias("weight")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(rows)).filter(F.col("weight") >= threshold)


def quantile_bins(df: DataFrame, cols: Sequence[str], bins: int = 5) -> DataFrame:
    """Ordinal quantile bins 0…bins−1 per column; a value on an inner edge belongs to the upper bin."""
    specs = {f"__e{i}_{j}": (F.col(c), j / bins) for i, c in enumerate(cols) for j in range(1, bins)}
    edges = group_quantiles(df, [], specs)
    got = join_stats(df, edges, [])
    # Repeated edges (very frequent values) count once.
    binned = {
        c: F.when(
            F.col(c).isNotNull(),
            F.size(F.filter(F.array_distinct(F.array(*[F.col(f"__e{i}_{j}") for j in range(1, bins)])), lambda e: e <= F.col(c))),
        )
        for i, c in enumerate(cols)
    }
    return got.select(*[binned[c].alias(c) if c in binned else F.col(c) for c in df.columns])


def chi_square_screen(df: DataFrame, evidence: Sequence[str], target: str) -> DataFrame:
    """Pearson independence test of each binned column against the binned target."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import ChiSquareTest

    data = VectorAssembler(inputCols=list(evidence), outputCol="__f").transform(df.dropna(subset=[*evidence, target]))
    res = ChiSquareTest.test(data.select("__f", F.col(target).cast("double").alias("__y")), "__f", "__y", True)
    names = F.array(*[F.lit(e) for e in evidence])
    return res.select(
        F.get(names, F.col("featureIndex")).alias("feature"),
        F.col("statistic"),
        F.col("degreesOfFreedom").cast("int").alias("dof"),
        F.col("pValue").alias("p_value"),
    )


def conditional_shares(df: DataFrame, evidence: str, target: str) -> DataFrame:
    """P(target bin | evidence bin) from the joint counts."""
    joint = df.dropna(subset=[evidence, target]).groupBy(evidence, target).agg(F.count(F.lit(1)).alias("n"))
    whole = joint.groupBy(evidence).agg(F.sum("n").alias("__t"))
    return join_stats(joint, whole, [evidence]).select(evidence, target, "n", (F.col("n") / F.col("__t")).alias("probability"))


def linear_predictor(coefs: Mapping[str, float], intercept: float = 0.0) -> Predict:
    """Model as a column expression."""
    return lambda get: reduce(lambda a, b: a + b, [get(f) * F.lit(float(c)) for f, c in coefs.items()], F.lit(float(intercept)))


def fibre_predictor(price: float = 146.46) -> Predict:
    """Closed fibre cost formula from basis weight, moisture and starch uptake."""

    def cost(get):
        dry = get("basis_weight") * (1 - get("moisture") / 100)
        return price * (dry - get("starch_bottom") - get("starch_top")) / get("basis_weight")

    return cost


def predict_costs(
    df: DataFrame, models: Mapping[str, Predict], inputs: Mapping[str, Sequence[str]], total: str | Callable | None = "sum"
) -> DataFrame:
    """Score component models on every row and combine them by sum, mean or a function of the columns."""
    missing = sorted({c for cols in inputs.values() for c in cols if c not in df.columns})
    if missing:
        raise ValueError(f"missing model inputs: {', '.join(missing)}")
    parts = {name: predict(F.col) for name, predict in models.items()}
    out = df.withColumns({f"pred_{n}": c for n, c in parts.items()})
    made = [F.col(f"pred_{n}") for n in parts]
    if total is None:
        return out
    if callable(total):
        return out.withColumn("pred_total", total({n: F.col(f"pred_{n}") for n in parts}))
    added = reduce(lambda a, b: a + b, made)
    if total not in ("sum", "mean"):
        raise ValueError(f"unknown total: {total}")
    return out.withColumn("pred_total", added / len(made) if total == "mean" else added)
