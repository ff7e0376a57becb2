"""Joint distribution of process variables per grade: marginals, copulas, conditional ranges."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.ordered import bounded_frames, neighbours, running_sums
from ..core.quantiles import group_medians, group_quantiles
from ..core.session import ensure_checkpoint_dir
from ..core.sizing import MAX_BLOCKS, block_count, counted_blocks, join_stats, materialise, pin_if_small
from ..functions import boundtable, student
from ..functions.expr import normal_cdf, normal_quantile, standard_normal_cdf, standard_normal_quantile
from .linear import centered

EPS = 1e-6
KDE_STEPS = 8  # grid steps per bandwidth
KDE_REACH = 10  # bandwidths beyond which a kernel is zero in double precision
CURVE_GRADES = 500  # grades whose factors may be sent to every task
TABLE_CELLS = 10_000  # cells of bound tables that may be sent to every task
CURVE_KNOTS = 1_000_000  # knots of a variable (16 bytes each) that may be sent to every task
TASK_KNOTS = 32_000_000  # knots of a grade (16 bytes each) that a task of its rows may hold
PACK_KNOTS = 512  # knots in one row on their way to a task
KDE_CELLS = 200_000  # grid cells of a variable that may be broadcast
ALONG_POINTS = 1 << 14  # points of rows whose likelihood is worked out at a time


@dataclass
class JointModel:
    """Fitted tables. ``knots``: (grade, variable, x, n, u); ``bands``: (grade, variable, n_rows,
    bandwidth, origin, lowest, highest, n_low, n_high); ``corr``: (grade, n_rows, corr, inv, logdet)."""

    grade: str
    cols: list[str]
    knots: DataFrame
    bands: DataFrame
    corr: DataFrame
    data: DataFrame
    _kde: DataFrame | None = None
    _gaps: DataFrame | None = None

    @property
    def kde(self) -> DataFrame:
        if self._kde is None:
            self._kde = kernel_table(self)
        return self._kde

    @property
    def gaps(self) -> DataFrame:
        if self._gaps is None:
            self._gaps = gap_table(self)
        return self._gaps


def complete_rows(df: DataFrame, cols: Sequence[str], keep: Sequence[str], fill: bool = False, grade: str = "grade") -> DataFrame:
    """Numeric columns without gaps: incomplete rows go, or gaps become the grade's median."""
    num = df.select(*keep, *[F.col(c).try_cast("double").alias(c) for c in cols if c not in keep])
    if not fill:
        return num.dropna(subset=list(cols))
    med = group_medians(num, [grade], {f"__m_{c}": F.col(c) for c in cols})
    got = join_stats(num, med, [grade])
    return got.select(*keep, *[F.coalesce(c, f"__m_{c}").alias(c) for c in cols if c not in keep]).dropna(subset=list(cols))


def value_counts(df: DataFrame, cols: Sequence[str], grade: str = "grade") -> DataFrame:
    """Rows per grade, variable and distinct value."""
    long = df.unpivot([grade], list(cols), "variable", "x").filter(F.col("x").isNotNull())
    return long.groupBy(grade, "variable", "x").agg(F.count(F.lit(1)).alias("n"))


def marginal_knots(counts: DataFrame, grade: str = "grade", min_rows: int = 5, blocks: int | None = None) -> DataFrame:
    """Mid-rank distribution function at every distinct value per grade and variable."""
    totals = counts.groupBy(grade, "variable").agg(F.sum("n").alias("__t")).filter(F.col("__t") >= max(5, min_rows))
    ran = running_sums(counts, [grade, "variable"], ["x"], {"__cum": F.col("n")}, blocks)
    got = join_stats(ran, totals, [grade, "variable"], how="inner")
    return got.select(grade, "variable", "x", "n", ((F.col("__cum") - F.col("n") / 2) / F.col("__t")).alias("u"))


def marginal_bands(knots: DataFrame, grade: str = "grade") -> DataFrame:
    """Kernel bandwidth 1.06·σ·n^(−1/5) (at least 0.001) and the ends of each marginal."""
    mean = knots.groupBy(grade, "variable").agg(
        F.sum("n").alias("n_rows"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("__m"),
        F.min("x").alias("lowest"), F.max("x").alias("highest"), F.min_by("n", "x").alias("n_low"), F.max_by("n", "x").alias("n_high"),
    )
    dev = join_stats(knots, mean, [grade, "variable"]).groupBy(grade, "variable").agg(
        F.sum(F.pow(F.col("x") - F.col("__m"), 2) * F.col("n")).alias("__ss")
    )
    got = join_stats(mean, dev, [grade, "variable"])
    sd = F.sqrt(F.col("__ss") / (F.col("n_rows") - 1))
    bw = F.greatest(F.when(sd > 0, 1.06 * sd * F.pow("n_rows", F.lit(-0.2))).otherwise(0.1), F.lit(1e-3))
    return got.select(
        grade, "variable", "n_rows", bw.alias("bandwidth"), (F.col("lowest") - (KDE_REACH + 1) * bw).alias("origin"), "lowest", "highest", "n_low", "n_high"
    )


def _curves(table: DataFrame, grade: str, a: str, b: str) -> dict | None:
    """Knots as sorted arrays per grade and variable when there are at most ``CURVE_KNOTS``."""
    # Counted first: a fetch that finds too many would send them all to the driver.
    if table.count() > CURVE_KNOTS:
        return None
    rows = table.select(grade, "variable", a, b).toPandas().sort_values([a, b])
    return {k: (v[a].to_numpy(float), v[b].to_numpy(float)) for k, v in rows.groupby([grade, "variable"], sort=False)}


def rows_of(keys: pd.Series):
    """Each key of a batch with the places of its rows; missing keys have none."""
    codes, found = pd.factorize(keys)
    order = np.argsort(codes, kind="stable")
    at = np.searchsorted(codes[order], np.arange(len(found) + 1))
    for i, key in enumerate(found):
        yield key, order[at[i] : at[i + 1]]


def _lookup(curves: dict, variable: str):
    @F.pandas_udf("double")
    def lookup(g: pd.Series, x: pd.Series) -> pd.Series:
        res, at = np.full(len(x), np.nan), x.to_numpy(dtype=float)
        for key, hit in rows_of(g):
            if (key, variable) in curves:
                res[hit] = np.interp(at[hit], *curves[key, variable])
        return pd.Series(res).where(x.notna().to_numpy())

    return lookup


def beside_curves(
    df: DataFrame, knots: DataFrame, variables: Sequence[str], inputs: Mapping[str, Column], work: Callable, made: Sequence[str],
    grade: str = "grade", source: str = "x", target: str = "u",
) -> DataFrame | None:
    """Add the columns ``made``: what ``work(curves, values)`` gives for rows of one grade, NaN for NULL.

    The grade's knots go to the tasks of its rows, packed and ahead of them; rows stream past, so a task holds the
    curves of one grade and one batch. ``curves`` has (sources, targets) of each variable with knots, ``values`` an array for each
    of ``inputs``. None when a grade has more than ``TASK_KNOTS`` knots of the variables.
    """
    table = knots.filter(F.col("variable").isin(list(variables)) & F.col(grade).isNotNull()).select(grade, "variable", F.col(source).alias("a"), F.col(target).alias("b"))
    most, grades = table.groupBy(grade).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.count(F.lit(1))).first()
    if (most or 0) > TASK_KNOTS:
        return None
    parallel = df.sparkSession.sparkContext.defaultParallelism
    # Few parts a grade: each gets the grade's knots.
    salts = max(1, min(8, math.ceil(4 * parallel / max(grades, 1))))
    fields = T.StructType([df.schema[grade], *T.StructType.fromDDL("__variable string, __a binary, __b binary").fields])

    def pack(frames):
        for pdf in frames:
            rows = []
            for (key, variable), own in pdf.groupby([grade, "variable"], sort=False):
                a, b = own["a"].to_numpy(float), own["b"].to_numpy(float)
                rows += [(key, variable, a[i : i + PACK_KNOTS].tobytes(), b[i : i + PACK_KNOTS].tobytes()) for i in range(0, len(a), PACK_KNOTS)]
            yield pd.DataFrame(rows, columns=fields.names)

    packed = table.mapInPandas(pack, fields).select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"), F.lit(0).alias("__side"))
    made = list(made)
    names = {f"__in_{i}": c.cast("double") for i, c in enumerate(inputs.values())}
    rows = df.withColumns(names).withColumn("__side", F.lit(1))
    # Part of the rows by a hash, so a task run again reads the same ones.
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(F.lit("part"), *[f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)], *names), F.lit(salts)).cast("int"))
    both = rows.unionByName(packed, allowMissingColumns=True)
    parts = max(1, min(2 * grades * salts, 16 * parallel))
    both = both.repartition(parts, grade, "__salt").sortWithinPartitions(grade, "__salt", "__side")
    keep, given = df.columns, list(zip(inputs, names))

    def run(batches):
        at, found, curves = None, {}, None
        for batch in batches:
            g = batch.column(grade).to_pandas()
            side, salt = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__side", "__salt"))
            code = pd.factorize(g)[0]
            cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(salt) != 0) | (np.diff(side) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(side)]):
                if i == j:
                    continue
                own, key = batch.slice(i, j - i), (g.iloc[i] if code[i] >= 0 else None, salt[i])
                if key != at:
                    at, found, curves = key, {}, None
                if side[i] == 0:
                    for v, a, b in zip(*(own.column(c).to_pylist() for c in ("__variable", "__a", "__b"))):
                        found.setdefault(v, []).append((np.frombuffer(a), np.frombuffer(b)))
                    continue
                if curves is None:
                    curves = {}
                    for v, pieces in found.items():
                        a, b = (np.concatenate(x) for x in zip(*pieces))
                        order = np.lexsort((b, a))
                        curves[v] = a[order], b[order]
                    found = {}
                values = {n: pc.fill_null(own.column(c), math.nan).to_numpy(zero_copy_only=False) for n, c in given}
                res = np.asarray(work(curves, values), dtype=float)
                added = [pa.array(res[:, k], mask=np.isnan(res[:, k])) for k in range(len(made))]
                yield pa.RecordBatch.from_arrays([*[own.column(c) for c in keep], *added], names=[*keep, *made])

    return both.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in made]]))


def interpolate_knots(
    df: DataFrame, knots: DataFrame, at: Mapping[str, tuple[str, str]], grade: str = "grade", source: str = "x", target: str = "u"
) -> DataFrame:
    """Linear interpolation of knots per grade, flat beyond the ends.

    ``at`` maps an output name to (variable, input column). A variable's knots are sent to all
    tasks as arrays when small; large ones go to the tasks of their grade's rows, all variables at once. Where even those
    are too many, they are put in one order with the rows, and the knots on both sides of a row are carried to it.
    """
    tables = {v: knots.filter(F.col("variable") == v) for v, _ in at.values()}
    curves = {v: _curves(t, grade, source, target) for v, t in tables.items()}
    large = {out: v for out, (v, _) in at.items() if curves[v] is None}
    if large:
        def lookups(found, values):
            none = np.full(len(next(iter(values.values()))), np.nan)
            return np.column_stack([np.interp(values[out], *found[v]) if v in found else none for out, v in large.items()])

        got = beside_curves(df, knots, list(set(large.values())), {out: F.col(at[out][1]) for out in large}, lookups, list(large), grade, source, target)
        if got is not None:
            df, at = got, {out: a for out, a in at.items() if out not in large}
    # The rows that have to be sorted come first, the lookups then share one Python step.
    for out, (variable, col) in sorted(at.items(), key=lambda a: curves[a[1][0]] is not None):
        if curves[variable] is not None:
            # NaN leaves a Pandas UDF as NULL.
            df = df.withColumn(out, _lookup(curves[variable], variable)(F.col(grade), F.col(col).cast("double")))
            continue
        keep, table = df.columns, tables[variable]
        blocks = min(MAX_BLOCKS, block_count(df) - 1 + counted_blocks(table))
        pts = table.select(grade, F.col(source).alias("__k"), F.struct(F.col(source).alias("a"), F.col(target).alias("b")).alias("__pt"), F.lit(0).alias("__side"))
        both = df.withColumns({"__k": F.col(col).cast("double"), "__side": F.lit(1)}).unionByName(pts, allowMissingColumns=True)
        near = neighbours(both, [grade], ["__k", "__side"], {"__lo": F.col("__pt")}, {"__hi": F.col("__pt")}, blocks)
        near = near.filter(F.col("__side") == 1)
        lo, hi = F.col("__lo"), F.col("__hi")
        share = F.try_divide(F.col("__k") - lo["a"], hi["a"] - lo["a"])
        value = F.when(lo.isNull(), hi["b"]).when(hi.isNull(), lo["b"]).otherwise(lo["b"] + F.coalesce(share, F.lit(0.0)) * (hi["b"] - lo["b"]))
        df = near.select(*keep, F.when(F.col("__k").isNotNull(), value).alias(out))
    return df


def _clip(u: Column) -> Column:
    return F.when(u.isNotNull(), F.least(F.greatest(u, F.lit(EPS)), F.lit(1 - EPS)))


def _score():
    """Clipped normal quantile as a Pandas UDF; it runs in the same Python step as the lookup."""

    @F.pandas_udf("double")
    def score(u: pd.Series) -> pd.Series:
        return pd.Series(standard_normal_quantile(np.clip(u.to_numpy(dtype=float), EPS, 1 - EPS)))

    return score


def normal_scores(df: DataFrame, model_knots: DataFrame, cols: Sequence[str], grade: str = "grade", prefix: str = "z_") -> DataFrame:
    """Normal scores ``z_x`` of the columns under their grade's marginals."""
    got = interpolate_knots(df, model_knots, {f"{prefix}{c}": (c, c) for c in cols}, grade)
    return got.withColumns({f"{prefix}{c}": _score()(F.col(f"{prefix}{c}")) for c in cols})


def shrunk_correlation(n: int, sums: np.ndarray, products: np.ndarray, fourth: float, third: np.ndarray) -> np.ndarray:
    """Ledoit–Wolf covariance, scaled to a correlation, from power sums.

    ``fourth`` is the sum of ‖z‖⁴ and ``third`` the sum of ‖z‖²·z, both uncentred.
    """
    k = len(sums)
    raw = products.reshape(k, k)
    m, ss = centered(n, sums, products)
    emp = ss / n
    mm = float(m @ m)
    quart = fourth + 4 * m @ raw @ m + n * mm * mm - 4 * float(m @ third) + 2 * mm * float(np.trace(raw)) - 4 * mm * float(m @ sums)
    mu = float(np.trace(emp)) / k
    sq = float((emp**2).sum())
    beta = (quart / n - sq) / (k * n)
    delta = (sq - 2 * mu * float(np.trace(emp)) + k * mu * mu) / k
    beta = min(max(beta, 0.0), delta)
    share = 0.0 if beta == 0 else beta / delta
    cov = (1 - share) * emp + share * mu * np.eye(k)
    d = np.sqrt(np.diag(cov))
    d[d == 0] = 1.0
    corr = cov / np.outer(d, d)
    return (corr + corr.T) / 2


def fit_correlation(scores: DataFrame, zcols: Sequence[str], grade: str = "grade") -> DataFrame:
    """Correlation, inverse and log determinant per grade from one aggregate over the scores."""
    k = len(zcols)
    norm2 = sum((F.col(z) * F.col(z) for z in zcols), F.lit(0.0))
    rows = scores.dropna(subset=list(zcols)).withColumn("__q", norm2)
    agg = rows.groupBy(grade).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array(*[F.sum(z) for z in zcols]).alias("s"),
        F.array(*[F.sum(F.col(a) * F.col(b)) for a in zcols for b in zcols]).alias("p"),
        F.sum(F.col("__q") * F.col("__q")).alias("q4"),
        F.array(*[F.sum(F.col("__q") * F.col(z)) for z in zcols]).alias("q3"),
    )

    def solve(frames):
        for pdf in frames:
            out = []
            for r in pdf.to_dict("records"):
                corr = shrunk_correlation(r["n_rows"], np.array(r["s"]), np.array(r["p"]), r["q4"], np.array(r["q3"]))
                sign, logdet = np.linalg.slogdet(corr)
                if sign <= 0:
                    raise ValueError(f"correlation of grade {r[grade]} is not positive definite")
                out.append((r[grade], r["n_rows"], corr.ravel().tolist(), np.linalg.inv(corr).ravel().tolist(), float(logdet)))
            yield pd.DataFrame(out, columns=[grade, "n_rows", "corr", "inv", "logdet"])

    schema = T.StructType([agg.schema[grade], *T.StructType.fromDDL("n_rows long, corr array<double>, inv array<double>, logdet double").fields])
    return agg.mapInPandas(solve, schema)


def fit_joint(df: DataFrame, cols: Sequence[str], grade: str = "grade", min_rows: int = 200, fill: bool = False) -> JointModel:
    """Gaussian copula per grade with empirical marginals; grades with too few complete rows get no model."""
    cols = list(cols)
    data = complete_rows(df, cols, [grade], fill, grade)
    # The value counts are the only pass over the rows for all marginals.
    counts = materialise(value_counts(data, cols, grade), costly=True)
    knots = materialise(marginal_knots(counts, grade, min_rows, counted_blocks(counts)))
    data = join_stats(data, knots.select(grade).distinct(), [grade], how="left_semi")
    scores = normal_scores(data, knots, cols, grade)
    corr = materialise(fit_correlation(scores, [f"z_{c}" for c in cols], grade))
    return JointModel(grade, cols, knots, materialise(marginal_bands(knots, grade)), corr, data)


def require_model(model: JointModel, grades: Sequence[str]) -> None:
    """Fail when one of the listed grades had too few rows for a model."""
    have = {r[0] for r in model.corr.filter(F.col(model.grade).isin(list(grades))).select(model.grade).collect()}
    missing = sorted(set(grades) - have)
    if missing:
        raise ValueError(f"not enough complete rows for a joint model: {', '.join(missing)}")


def kernel_sums(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Kernel sum and slope on a grid: points (keys, x, n, bandwidth, origin) → (keys, cell, f, d).

    A point reaches only the grid cells within ten bandwidths. Each batch adds its points up
    before anything is shuffled.
    """
    keys = list(keys)

    def spread(frames):
        width = KDE_REACH * KDE_STEPS
        for pdf in frames:
            parts = []
            for key, g in pdf.groupby(keys, sort=False, dropna=False):
                bw = float(g["bandwidth"].iloc[0])
                step = bw / KDE_STEPS
                at = (g["x"].to_numpy() - float(g["origin"].iloc[0])) / step
                cell = np.floor(at).astype(np.int64)
                frac, n = at - cell, g["n"].to_numpy(dtype=float)
                base = cell.min() - width
                size = int(cell.max() - base + width + 2)
                f, d = np.zeros(size), np.zeros(size)
                for j in range(-width, width + 2):
                    dist = (j - frac) / KDE_STEPS
                    w = n * np.exp(-0.5 * dist * dist)
                    np.add.at(f, cell - base + j, w)
                    np.add.at(d, cell - base + j, -dist / bw * w)
                hit = np.flatnonzero(f)
                key = key if isinstance(key, tuple) else (key,)
                parts.append(pd.DataFrame({**dict(zip(keys, key)), "cell": base + hit, "f": f[hit], "d": d[hit]}))
            yield pd.concat(parts) if parts else pd.DataFrame(columns=[*keys, "cell", "f", "d"])

    schema = T.StructType([*[points.schema[k] for k in keys], *T.StructType.fromDDL("cell long, f double, d double").fields])
    return points.mapInPandas(spread, schema).groupBy(*keys, "cell").agg(F.sum("f").alias("f"), F.sum("d").alias("d"))


def kernel_table(model: JointModel) -> DataFrame:
    """Per grid cell the density sum and slope at both of its ends."""
    keys = [model.grade, "variable"]
    points = join_stats(model.knots.select(*keys, "x", "n"), model.bands.select(*keys, "bandwidth", "origin"), keys)
    sums = kernel_sums(points, keys)
    ends = sums.select(*keys, "cell", F.struct("f", "d").alias("l"), F.lit(None).cast("struct<f:double,d:double>").alias("r")).unionByName(
        sums.select(*keys, (F.col("cell") - 1).alias("cell"), F.lit(None).cast("struct<f:double,d:double>").alias("l"), F.struct("f", "d").alias("r"))
    )
    table = ends.groupBy(*keys, "cell").agg(F.max("l").alias("l"), F.max("r").alias("r")).dropna()
    return materialise(table)


def gap_table(model: JointModel) -> DataFrame:
    """Per grade and variable the gaps between neighbouring values that no kernel reaches into.

    A gap is more than ten bandwidths wide and the bandwidth follows the deviation of all n values, so
    there are fewer than n^0.47 / 2 of them (about 7,600 in a thousand million rows): one array a marginal.
    """
    keys = [model.grade, "variable"]
    ahead = lambda w: {"hi": F.lead("x").over(w), "n_hi": F.lead("n").over(w)}
    steps = bounded_frames(model.knots.select(*keys, "x", "n"), keys, ["x"], 0, 1, ahead, counted_blocks(model.knots))
    wide = join_stats(steps, model.bands.select(*keys, "bandwidth"), keys).filter(F.col("hi") - F.col("x") > KDE_REACH * F.col("bandwidth"))
    return materialise(wide.groupBy(*keys).agg(F.collect_list(F.struct(F.col("x").alias("lo"), F.col("n").alias("n_lo"), "hi", "n_hi")).alias("gaps")))


def log_marginals(df: DataFrame, model: JointModel, at: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Log kernel density of values: ``at`` maps an output name to (variable, input column).

    The density comes from its grid by cubic interpolation with exact slopes. Beyond the grid
    only the outermost value matters, in a gap between values the nearest one on each side.
    """
    g = model.grade
    for out, (variable, col) in at.items():
        keep = df.columns
        band = model.bands.filter(F.col("variable") == variable).drop("variable")
        gaps = model.gaps.filter(F.col("variable") == variable).drop("variable")
        got = join_stats(join_stats(df, band, [g]), gaps, [g])
        x, bw = F.col(col).cast("double"), F.col("bandwidth")
        pos = (x - F.col("origin")) / (bw / KDE_STEPS)
        got = got.withColumns({"cell": F.floor(pos), "__t": pos - F.floor(pos)})
        table = model.kde.filter(F.col("variable") == variable).drop("variable")
        got = join_stats(got, table, [g, "cell"], max_rows=KDE_CELLS)
        t, h = F.col("__t"), bw / KDE_STEPS
        f0, f1, d0, d1 = F.col("l.f"), F.col("r.f"), F.col("l.d") * h, F.col("r.d") * h
        dens = f0 + t * (d0 + t * (3 * (f1 - f0) - 2 * d0 - d1 + t * (2 * (f0 - f1) + d0 + d1)))
        scale = F.log(F.col("n_rows") * bw * math.sqrt(2 * math.pi))
        one = lambda value, n: F.log(n) - 0.5 * F.pow((x - value) / bw, 2)
        gap = F.get(F.filter("gaps", lambda s: (s["lo"] < x) & (x < s["hi"])), F.lit(0))
        below, above = one(gap["lo"], gap["n_lo"]), one(gap["hi"], gap["n_hi"])
        inside = F.greatest(below, above) + F.log1p(F.exp(-F.abs(below - above)))
        outside = F.when(x < F.col("lowest"), one(F.col("lowest"), F.col("n_low"))).otherwise(one(F.col("highest"), F.col("n_high")))
        far = F.when(gap.isNull(), outside).otherwise(inside)
        df = got.select(*keep, (F.when(dens > 0, F.log(dens)).otherwise(far) - scale).alias(out))
    return df


def _quadratic(zs: list[Column], matrix: Column) -> Column:
    k = len(zs)
    return sum((zs[i] * zs[j] * F.get(matrix, F.lit(i * k + j)) for i in range(k) for j in range(k)), F.lit(0.0))


def log_likelihood(df: DataFrame, model: JointModel, out: str = "loglik", scores: bool = False) -> DataFrame:
    """Joint log density of rows: Gaussian copula part plus the log marginals."""
    keep = df.columns
    z = normal_scores(df, model.knots, model.cols, model.grade)
    lm = log_marginals(z, model, {f"__lm_{c}": (c, c) for c in model.cols})
    got = join_stats(lm, model.corr.select(model.grade, "inv", "logdet"), [model.grade])
    zs = [F.col(f"z_{c}") for c in model.cols]
    copula = -0.5 * F.col("logdet") - 0.5 * (_quadratic(zs, F.col("inv")) - sum((a * a for a in zs), F.lit(0.0)))
    total = copula + sum((F.col(f"__lm_{c}") for c in model.cols), F.lit(0.0))
    extra = [f"z_{c}" for c in model.cols] if scores else []
    return got.select(*keep, *extra, total.alias(out))


def _log_density(x: np.ndarray, m: dict) -> np.ndarray:
    """Log kernel density of one grade's marginal as ``log_marginals`` defines it."""
    bw, h = m["bandwidth"], m["bandwidth"] / KDE_STEPS
    t = (x - m["origin"]) / h
    cell = np.floor(t)
    t -= cell
    i = np.minimum(np.searchsorted(m["cell"], cell), len(m["cell"]) - 1) if m["cell"][-1] - m["cell"][0] >= len(m["cell"]) else _nearby(cell - m["cell"][0], len(m["cell"]))
    f0, d0, f1, d1 = (e[i] for e in m["ends"])
    d0 *= h
    d1 *= h
    dens = np.where(m["cell"][i] == cell, f0 + t * (d0 + t * (3 * (f1 - f0) - 2 * d0 - d1 + t * (2 * (f0 - f1) + d0 + d1))), 0.0)
    shift = np.log(m["n_rows"] * bw * math.sqrt(2 * math.pi))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.log(dens) - shift
    out_of_reach = ~(dens > 0)
    if out_of_reach.any():
        out[out_of_reach] = _far_log_density(x[out_of_reach], m) - shift
    return out


def _nearby(i: np.ndarray, n: int) -> np.ndarray:
    """Places in a table without holes; some place for those beyond it."""
    return np.clip(np.nan_to_num(i), 0, n - 1).astype(np.int64)


def _far_log_density(x: np.ndarray, m: dict) -> np.ndarray:
    """Log kernel sum where no kernel reaches: of the outermost value, or of the nearest one on each side of a gap."""
    one = lambda value, n: np.log(n) - 0.5 * ((x - value) / m["bandwidth"]) ** 2
    far = np.where(x < m["lowest"], one(m["lowest"], m["n_low"]), one(m["highest"], m["n_high"]))
    if len(m["gaps"]):
        lo, n_lo, hi, n_hi = np.moveaxis(m["gaps"][np.maximum(np.searchsorted(m["gaps"][:, 0], x) - 1, 0)], -1, 0)
        below, above = one(lo, n_lo), one(hi, n_hi)
        far = np.where((lo < x) & (x < hi), np.maximum(below, above) + np.log1p(np.exp(-np.abs(below - above))), far)
    return far


def _marginals(model: JointModel, variable: str) -> dict | None:
    """Bands, grid and gaps of a variable per grade when the grid is small."""
    g = model.grade
    cells = model.kde.filter(F.col("variable") == variable).select(g, "cell", "l.f", "l.d", F.col("r.f").alias("f1"), F.col("r.d").alias("d1")).limit(KDE_CELLS + 1).toArrow()
    if cells.num_rows > KDE_CELLS:
        return None
    out = {r[g]: r.asDict() | {"gaps": np.empty((0, 4))} for r in model.bands.filter(F.col("variable") == variable).collect()}
    for r in model.gaps.filter(F.col("variable") == variable).collect():
        out[r[g]]["gaps"] = np.array(sorted((s["lo"], s["n_lo"], s["hi"], s["n_hi"]) for s in r["gaps"]), dtype=float)
    for key, own in cells.to_pandas().sort_values("cell").groupby(g):
        out[key] |= {"cell": own["cell"].to_numpy(float), "ends": own[["f", "d", "f1", "d1"]].to_numpy(float).T}
    return {key: m for key, m in out.items() if "cell" in m}


def likelihood_along(df: DataFrame, model: JointModel, variable: str) -> tuple[DataFrame, list[str], Callable] | None:
    """``log_likelihood`` of rows with the variable at other points, for use inside tasks.

    Only the variable's own score and density change along the points, so the rest is a few numbers a row: the rows with
    these, their columns' names and ``along(grades, numbers, x)`` for points ``x`` (rows by points), NaN where it isn't known. None when the
    variable's knots or grid are too large to be sent to the tasks.
    """
    g, k, f = model.grade, len(model.cols), model.cols.index(variable)
    others = [c for c in model.cols if c != variable]
    curves, marginals = _curves(model.knots.filter(F.col("variable") == variable), g, "x", "u"), _marginals(model, variable)
    if curves is None or marginals is None:
        return None
    keep = df.columns
    z = normal_scores(df, model.knots, others, g)
    lm = log_marginals(z, model, {f"__lm_{c}": (c, c) for c in others})
    got = join_stats(lm, model.corr.select(g, F.col("inv").alias("__inv"), F.col("logdet").alias("__det")), [g])
    at = lambda a, b: F.get("__inv", F.lit(model.cols.index(a) * k + model.cols.index(b)))
    zs = {c: F.col(f"z_{c}") for c in others}
    quad = sum((zs[a] * zs[b] * at(a, b) for a in others for b in others), F.lit(0.0)) - sum((v * v for v in zs.values()), F.lit(0.0))
    rest = -0.5 * F.col("__det") - 0.5 * quad + sum((F.col(f"__lm_{c}") for c in others), F.lit(0.0))
    pull = sum((at(variable, c) * zs[c] for c in others), F.lit(0.0))

    def along(grades: pd.Series, numbers: Sequence[np.ndarray], x: np.ndarray) -> np.ndarray:
        rest, pull, own = numbers
        whole = ~np.isnan(x[:, 0] + x[:, -1] + rest + pull + own)
        res = np.full(x.shape, np.nan)
        step = max(1, ALONG_POINTS // x.shape[1])
        for key, every in rows_of(grades):
            every = every[whole[every]]
            if (key, variable) not in curves or key not in marginals:
                continue
            for hit in (every[i : i + step] for i in range(0, len(every), step)):
                at = x[hit]
                z = standard_normal_quantile(np.clip(np.interp(at, *curves[key, variable]), EPS, 1 - EPS))
                res[hit] = rest[hit, None] - 0.5 * (own[hit, None] - 1) * z * z - pull[hit, None] * z + _log_density(at, marginals[key])
        return res

    names = ["__rest", "__pull", "__own"]
    return got.select(*keep, *[c.alias(n) for c, n in zip((rest, pull, F.get("__inv", F.lit(f * k + f))), names)]), names, along


def feasibility(df: DataFrame, model: JointModel, keys: Sequence[str]) -> DataFrame:
    """Log likelihood and finite flag per row; a row with a gap in a model variable is an error."""
    gap = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in model.cols]))
    note = F.concat(F.lit("missing values in "), F.array_join(gap, ", "))
    first = model.cols[0]
    checked = df.withColumn(first, F.when(F.size(gap) > 0, F.raise_error(note).cast("double")).otherwise(F.col(first)))
    got = log_likelihood(checked, model)
    good = F.col("loglik").isNotNull() & ~F.isnan("loglik") & (F.abs("loglik") != float("inf"))
    return got.select(*keys, *[c for c in [model.grade] if c not in keys], "loglik", good.alias("is_valid"))


def _unit(seed: int, j: int, *keys: str) -> Column:
    """A number in (0, 1) that depends on seed, number and keys alone, so a task run again gives the same."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(j), *keys), 11) + 0.5) / float(1 << 53)


def _noise(seed: int, j: int, *keys: str) -> Column:
    """A standard normal number of the same kind."""
    return normal_quantile(_unit(seed, j, *keys))


def sample_joint(model: JointModel, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """``n`` draws per grade from the fitted joint distribution."""
    k, g = len(model.cols), model.grade
    schema = T.StructType([model.corr.schema[g], T.StructField("chol", T.ArrayType(T.DoubleType()))])

    def factor(frames):
        for pdf in frames:
            rows = [np.linalg.cholesky(np.array(c).reshape(k, k)).ravel().tolist() for c in pdf["corr"]]
            yield pd.DataFrame({g: pdf[g], "chol": rows})

    chol, fits = pin_if_small(model.corr.select(model.grade, "corr").mapInPandas(factor, schema), CURVE_GRADES)
    noise = spark.range(n).select(F.col("id").alias("draw"), *[_noise(seed, j, "id").alias(f"__e{j}") for j in range(k)])
    draws = noise.crossJoin(F.broadcast(chol)) if fits else noise.crossJoin(chol)
    z = lambda i: sum((F.get("chol", F.lit(i * k + j)) * F.col(f"__e{j}") for j in range(i + 1)), F.lit(0.0))
    us = draws.select("draw", model.grade, *[_clip(normal_cdf(z(i))).alias(f"__u_{c}") for i, c in enumerate(model.cols)])
    got = interpolate_knots(us, model.knots, {c: (c, f"__u_{c}") for c in model.cols}, model.grade, "u", "x")
    return got.select("draw", model.grade, *model.cols)


def _conditional_blocks(model: JointModel, targets: Sequence[str], given: Sequence[str]) -> DataFrame:
    """Per grade: regression weights of the targets' scores on the given ones, and their covariance."""
    k, key_col = len(model.cols), model.grade
    t = [model.cols.index(c) for c in targets]
    g = [model.cols.index(c) for c in given]
    schema = T.StructType([model.corr.schema[key_col], *T.StructType.fromDDL("weights array<double>, cov array<double>").fields])

    def solve(frames):
        for pdf in frames:
            out = []
            for key, c in zip(pdf[key_col], pdf["corr"]):
                r = np.array(c).reshape(k, k)
                cov, w = r[np.ix_(t, t)], np.zeros((len(t), len(g)))
                if g:
                    w = np.linalg.solve(r[np.ix_(g, g)], r[np.ix_(g, t)]).T
                    cov = cov - w @ r[np.ix_(g, t)]
                cov = (cov + cov.T) / 2
                np.fill_diagonal(cov, np.maximum(np.diag(cov), 1e-9))
                out.append((key, w.ravel().tolist(), cov.ravel().tolist()))
            yield pd.DataFrame(out, columns=[key_col, "weights", "cov"])

    return model.corr.select(model.grade, "corr").mapInPandas(solve, schema)


def conditional_scores(df: DataFrame, model: JointModel, targets: Sequence[str], given: Sequence[str]) -> DataFrame:
    """Add ``mu_t`` and ``var_t`` of each target's normal score given other variables of the row."""
    keep = df.columns
    z = normal_scores(df, model.knots, given, model.grade)
    got = join_stats(z, _conditional_blocks(model, targets, given), [model.grade])
    m, n = len(targets), len(given)
    mu = lambda i: sum((F.get("weights", F.lit(i * n + j)) * F.col(f"z_{c}") for j, c in enumerate(given)), F.lit(0.0))
    return got.select(
        *keep,
        *[mu(i).alias(f"mu_{t}") for i, t in enumerate(targets)],
        *[F.get("cov", F.lit(i * m + i)).alias(f"var_{t}") for i, t in enumerate(targets)],
        F.col("cov").alias("score_cov"),
    )


def image_stats(u: np.ndarray, curve: tuple, n: int) -> np.ndarray:
    """Mean and variance of a row's points beyond the first ``n`` under a quantile function, then the first ``n``."""
    x = np.interp(np.clip(u, EPS, 1 - EPS), *curve)
    tail = x[:, n:] - x[:, n : n + 1]
    mean = tail.mean(axis=1)
    return np.column_stack([x[:, n] + mean, np.square(tail - mean[:, None]).mean(axis=1), x[:, :n]])


def image_names(n: int) -> list[str]:
    return ["mean", "var", *[f"q{i}" for i in range(n)]]


def image_type(n: int) -> str:
    return ", ".join(f"{c} double" for c in image_names(n))


def summed_images(rows: DataFrame, keys: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """One row per key tuple from ``__s``; rows with equal keys are one with all their points."""
    return rows.groupBy(*keys).agg(
        F.avg("__s.mean").alias("mean"), F.sqrt(F.avg("__s.var") + F.var_pop("__s.mean")).alias("std"),
        *[F.max(f"__s.q{j}").alias(f"q{round(q * 100):02d}") for j, q in enumerate(quantiles)],
    )


def normal_images(variable: str, ps: Sequence[float], n: int) -> Callable:
    """``image_stats`` of rows of one grade whose score is normal with ``mu`` and ``var``."""
    zq = standard_normal_quantile(np.array(ps))

    def work(curves, values):
        mu, sd = values["mu"], np.sqrt(values["var"])
        res, hit = np.full((len(mu), 2 + n), np.nan), np.flatnonzero(~np.isnan(mu))
        if variable in curves and len(hit):
            res[hit] = image_stats(standard_normal_cdf(mu[hit, None] + sd[hit, None] * zq), curves[variable], n)
        return res

    return work


def _images(curves: dict, variable: str, ps: Sequence[float], n: int):
    zq = standard_normal_quantile(np.array(ps))

    @F.pandas_udf(image_type(n))
    def images(g: pd.Series, mu: pd.Series, var: pd.Series) -> pd.DataFrame:
        mu, sd = mu.to_numpy(dtype=float), np.sqrt(var.to_numpy(dtype=float))
        res = np.full((len(mu), 2 + n), np.nan)
        for key, hit in rows_of(g):
            hit = hit[~np.isnan(mu[hit])]
            if (key, variable) in curves and len(hit):
                res[hit] = image_stats(standard_normal_cdf(mu[hit, None] + sd[hit, None] * zq), curves[key, variable], n)
        return pd.DataFrame(res, columns=["mean", "var", *[f"q{i}" for i in range(n)]])

    return images


def conditional_summary(
    df: DataFrame, model: JointModel, targets: Sequence[str], given: Sequence[str], keys: Sequence[str],
    quantiles: Sequence[float] = (0.05, 0.5, 0.95), points: int = 200,
) -> DataFrame:
    """Mean, deviation and quantiles of each target given other variables, per row.

    Quantiles are exact images of normal quantiles. Mean and deviation come from ``points``
    evenly spaced probabilities, so repeated runs agree. A row's points stay in its batch unless a grade has
    more than ``TASK_KNOTS`` knots of the target. Rows with equal keys are one.
    """
    if f"{model.grade}" not in keys:
        keys = [*keys, model.grade]
    cond = conditional_scores(df, model, targets, given)
    ps = [*quantiles, *[(i + 0.5) / points for i in range(points)]]
    zq = F.array(*[F.lit(float(z)) for z in standard_normal_quantile(np.array(ps))])
    out = None
    for t in targets:
        curves = _curves(model.knots.filter(F.col("variable") == t), model.grade, "u", "x")
        if curves is not None:
            images = _images(curves, t, ps, len(quantiles))
            one = summed_images(cond.select(*keys, images(model.grade, f"mu_{t}", f"var_{t}").alias("__s")), keys, quantiles).withColumn("target", F.lit(t))
            out = one if out is None else out.unionByName(one)
            continue
        stats = image_names(len(quantiles))
        given_rows = cond.select(*keys, f"mu_{t}", f"var_{t}")
        near = beside_curves(
            given_rows, model.knots, [t], {"mu": F.col(f"mu_{t}"), "var": F.col(f"var_{t}")}, normal_images(t, ps, len(quantiles)), stats, model.grade, "u", "x"
        )
        if near is not None:
            one = summed_images(near.select(*keys, F.struct(*stats).alias("__s")), keys, quantiles).withColumn("target", F.lit(t))
            out = one if out is None else out.unionByName(one)
            continue
        spread = cond.select(*keys, F.posexplode(zq).alias("__i", "__z"), F.col(f"mu_{t}"), F.col(f"var_{t}"))
        at = spread.withColumn("__u", _clip(normal_cdf(F.col(f"mu_{t}") + F.sqrt(f"var_{t}") * F.col("__z"))))
        x = interpolate_knots(at, model.knots, {"__x": (t, "__u")}, model.grade, "u", "x")
        tail = F.when(F.col("__i") >= len(quantiles), F.col("__x"))
        one = x.groupBy(*keys).agg(
            F.avg(tail).alias("mean"), F.stddev_pop(tail).alias("std"),
            *[F.max(F.when(F.col("__i") == j, F.col("__x"))).alias(f"q{round(q * 100):02d}") for j, q in enumerate(quantiles)],
        ).withColumn("target", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


def conditional_draws(
    df: DataFrame, model: JointModel, targets: Sequence[str], given: Sequence[str], keys: Sequence[str], n: int, seed: int = 0
) -> DataFrame:
    """``n`` joint draws of the targets per row, given other variables of the row; rows with equal keys get equal draws."""
    m = len(targets)
    cond = conditional_scores(df, model, targets, given)
    draws = cond.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))

    @F.pandas_udf(", ".join(f"u{i} double" for i in range(m)))
    def images(g: pd.Series, *values: pd.Series) -> pd.DataFrame:
        x = np.column_stack([v.to_numpy(dtype=float) for v in values])
        mu, cov, noise = x[:, :m], x[:, m : m + m * m], x[:, m + m * m :]
        whole, res = ~np.isnan(x).any(axis=1), np.full(mu.shape, np.nan)
        for _, hit in rows_of(g):
            hit = hit[whole[hit]]
            if len(hit):
                # Rows of one grade share the covariance.
                w, v = np.linalg.eigh(cov[hit[0]].reshape(m, m))
                z = mu[hit] + standard_normal_quantile(noise[hit]) @ (v * np.sqrt(np.maximum(w, 1e-12))).T
                res[hit] = np.clip(standard_normal_cdf(z), EPS, 1 - EPS)
        return pd.DataFrame(res, columns=[f"u{i}" for i in range(m)])

    values = [*[F.col(f"mu_{t}") for t in targets], *[F.get("score_cov", F.lit(i)) for i in range(m * m)], *[_unit(seed, j, *keys, "draw") for j in range(m)]]
    made = draws.withColumn("__p", images(F.col(model.grade), *values))
    us = made.select(*keys, *[c for c in [model.grade] if c not in keys], "draw", *[F.col(f"__p.u{i}").alias(f"__u_{t}") for i, t in enumerate(targets)])
    got = interpolate_knots(us, model.knots, {t: (t, f"__u_{t}") for t in targets}, model.grade, "u", "x")
    return got.select(*keys, *[c for c in [model.grade] if c not in keys], "draw", *targets)


def control_grid(
    model: JointModel, variable: str, step: float = 0.01, pad: float = 0.05, low: float | None = None, high: float | None = None,
    non_negative: bool = False, pre_expand: float = 0.0,
) -> DataFrame:
    """Grid of a variable per grade (from its 1–99 % envelope) with score and log marginal at every point."""
    g = model.grade
    table = model.knots.filter(F.col("variable") == variable)
    if table.limit(CURVE_KNOTS + 1).count() <= CURVE_KNOTS:
        env = table.groupBy(g).agg(F.percentile("x", F.lit(0.01), F.col("n")).alias("a"), F.percentile("x", F.lit(0.99), F.col("n")).alias("z"))
    else:
        env = group_quantiles(model.data, [g], {"a": (F.col(variable), 0.01), "z": (F.col(variable), 0.99)})
    span = F.greatest(F.col("z") - F.col("a"), F.lit(1.0))

    def clamp(lo, hi):
        if non_negative:
            lo = F.greatest(lo, F.lit(0.0))
        if low is not None:
            lo = F.greatest(lo, F.lit(float(low)))
        if high is not None:
            hi = F.least(hi, F.lit(float(high)))
        return lo, hi

    env = env.withColumns(dict(zip(("lo", "hi"), clamp(F.col("a") - pad * span, F.col("z") + pad * span))))
    env = env.withColumn("hi", F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + max(1.0, step)))
    base = F.col("hi") - F.col("lo")
    env = env.withColumns(dict(zip(("lo", "hi"), clamp(F.col("lo") - pre_expand * base, F.col("hi") + pre_expand * base))))
    n = F.floor((F.col("hi") - F.col("lo")) / step + 1e-9).cast("int")
    pts = env.select(g, "lo", F.posexplode(F.transform(F.sequence(F.lit(0), n), lambda i: F.col("lo") + i * step)).alias("i", "s"))
    z = normal_scores(pts.withColumn(variable, F.col("s")), model.knots, [variable], g)
    lm = log_marginals(z, model, {"lm": (variable, variable)})
    return lm.groupBy(g).agg(F.array_sort(F.collect_list(F.struct("i", "s", F.col(f"z_{variable}").alias("z"), "lm"))).alias("grid"))


def conditional_bounds(
    df: DataFrame, model: JointModel, variable: str, q_low: float = 0.10, q_high: float = 0.90, post_expand: float = 0.0,
    step: float = 0.01, **grid_options,
) -> DataFrame:
    """Lower bound, upper bound and mode of a variable given the others of each row.

    Given the rest of a row, the log density along the variable depends on one number of the row. Bounds
    and mode as functions of that number are tabulated once per grade (``boundtable``, error below 1e-7 of exact integration
    over the grid), so a row costs a lookup and a cubic, whatever the grid's step. Tables of many grades are joined by grade and cell.
    """
    keep, f = df.columns, model.cols.index(variable)
    others = [c for c in model.cols if c != variable]
    g, k = model.grade, len(model.cols)
    z = normal_scores(df, model.knots, others, g)
    z = join_stats(z, model.corr.select(g, F.col("inv").alias("__inv")), [g])
    pull = sum((F.get("__inv", F.lit(f * k + model.cols.index(c))) * F.col(f"z_{c}") for c in others), F.lit(0.0))
    rows = z.select(*keep, pull.alias("__h"))
    grid = control_grid(model, variable, step, **grid_options)
    curves = join_stats(grid, model.corr.select(g, "inv"), [g], how="inner")
    # Scores are clipped, so the row's number is bounded by the model alone.
    top = float(standard_normal_quantile(np.array([1 - EPS]))[0]) * (1 + 1e-9)

    def tabulate(frames):
        for pdf in frames:
            for key, cells, inv in zip(pdf[g], pdf["grid"], pdf["inv"]):
                s, zs, lm = (np.array([float(x[name]) for x in cells]) for name in ("s", "z", "lm"))
                inv = np.array(inv, dtype=float).reshape(k, k)
                reach = top * float(np.abs(np.delete(inv[f], f)).sum())
                found = boundtable.table(s, zs, lm - 0.5 * (inv[f, f] - 1) * zs * zs, q_low, q_high, reach)
                yield pd.DataFrame({g: [key] * len(found), "__cell": [c.cell for c in found], "__s0": s[0], "__s1": s[-1], "__lo": [c.low for c in found], "__hi": [c.high for c in found], "__mode": [c.mode for c in found]})

    shape = T.StructType([df.schema[g], *T.StructType.fromDDL("__cell long, __s0 double, __s1 double, __lo array<array<double>>, __hi array<array<double>>, __mode array<array<double>>").fields])
    parts = 4 * df.sparkSession.sparkContext.defaultParallelism
    ensure_checkpoint_dir(df.sparkSession)
    tables = curves.repartition(parts, g).mapInPandas(tabulate, shape).checkpoint()
    grow = lambda: F.lit(float(post_expand)) * F.greatest(F.col("__high") - F.col("__low"), F.lit(float(step)))

    def ends(mode: Column) -> list[Column]:
        known = F.col("__low").isNotNull()
        low = F.when(known, F.greatest("__s0", F.col("__low") - grow()))
        high = F.when(known, F.least("__s1", F.col("__high") + grow()))
        return [low.alias(f"{variable}_low"), high.alias(f"{variable}_high"), mode.alias(f"{variable}_mode")]

    cells = tables.limit(TABLE_CELLS + 1).toArrow()
    if cells.num_rows <= TABLE_CELLS:
        got = rows.withColumn("__b", _bounds(_bound_arrays(cells.to_pandas(), g))(F.col(g), F.col("__h")))
        got = got.select(*keep, *[F.col(f"__b.{c}").alias(f"__{c}") for c in BOUNDS])
        return got.select(*keep, *ends(F.col("__mode")))
    got = join_stats(rows.withColumn("__cell", F.floor(F.col("__h") / boundtable.WIDTH)), tables, [g, "__cell"], max_rows=TABLE_CELLS)
    h = F.col("__h")
    piece = lambda name, end: F.coalesce(F.get(F.filter(name, lambda p: h < F.get(p, F.lit(end))), F.lit(0)), F.element_at(name, -1))
    got = got.withColumns({"__pl": piece("__lo", 1), "__ph": piece("__hi", 1), "__pm": piece("__mode", 0)})

    def curve(name: str) -> Column:
        a, b, va, vb, da, db = (F.get(name, F.lit(i)) for i in range(6))
        wide = b - a
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (h - a) / wide))
        return va + t * (wide * da + t * (3 * (vb - va) - wide * (2 * da + db) + t * (2 * (va - vb) + wide * (da + db))))

    got = got.withColumns({"__low": curve("__pl"), "__high": curve("__ph")})
    return got.select(*keep, *ends(F.get("__pm", F.lit(1))))


BOUNDS = ("low", "high", "mode", "s0", "s1")


def _bound_arrays(cells: pd.DataFrame, grade: str) -> dict:
    """Per grade: first and last cell, ends of the grid, pieces of both bounds and turns and values of the mode, along the row's number."""
    out = {}
    for key, own in cells.sort_values("__cell").groupby(grade):
        low, high = (np.array([list(p) for x in own[c] for p in x], dtype=float).T for c in ("__lo", "__hi"))
        mode = [(min(float(p[0]), (c + 1) * boundtable.WIDTH), float(p[1])) for c, x in zip(own["__cell"], own["__mode"]) for p in x]
        out[key] = (own["__cell"].iloc[0], own["__cell"].iloc[-1], own["__s0"].iloc[0], own["__s1"].iloc[0], low, high, *np.array(mode).T)
    return out


def _bounds(curves: dict):
    @F.pandas_udf(", ".join(f"{c} double" for c in BOUNDS))
    def bounds(g: pd.Series, h: pd.Series) -> pd.DataFrame:
        h = h.to_numpy(dtype=float)
        res = np.full((len(h), len(BOUNDS)), np.nan)
        for key, hit in rows_of(g):
            if key not in curves:
                continue
            first, last, s0, s1, low, high, turns, modes = curves[key]
            cell = np.floor(h[hit] / boundtable.WIDTH)
            hit = hit[(cell >= first) & (cell <= last)]
            x = h[hit]
            for j, pieces in enumerate((low, high)):
                a, b, va, vb, da, db = pieces[:, np.minimum(np.searchsorted(pieces[1], x, side="right"), pieces.shape[1] - 1)]
                wide = b - a
                t = np.clip((x - a) / wide, 0.0, 1.0)
                res[hit, j] = va + t * (wide * da + t * (3 * (vb - va) - wide * (2 * da + db) + t * (2 * (va - vb) + wide * (da + db))))
            res[hit, 2] = modes[np.minimum(np.searchsorted(turns, x, side="right"), len(modes) - 1)]
            res[hit, 3], res[hit, 4] = s0, s1
        return pd.DataFrame(res, columns=list(BOUNDS))

    return bounds


def density_curve(df: DataFrame, variable: str, grade: str | None = None, factor: float = 0.2, points: int = 500) -> DataFrame:
    """Gaussian kernel density on an even grid (bandwidth ``factor``·σ) with the 2.5, 50 and 97.5 % quantiles.

    Every batch adds its kernels over the grid, so only ``points`` partial sums per group are shuffled.
    """
    by = [grade] if grade else []
    data = df.select(*by, F.col(variable).cast("double").alias("x")).dropna(subset=["x"])
    counts = data.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("n"))
    stats = data.groupBy(*by).agg(F.count("x").alias("n_rows"), F.stddev_samp("x").alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    got = join_stats(counts, stats, by, null_safe=True)

    def add_up(frames):
        for pdf in frames:
            parts = []
            for key, g in pdf.groupby(by, dropna=False) if by else [((), pdf)]:
                if not len(g):
                    continue
                r = g.iloc[0]
                bw = max(float(r["sd"]) * factor, 1e-12) if r["sd"] == r["sd"] else 1e-12
                grid = np.linspace(r["lo"], r["hi"], points)
                total = np.zeros(points)
                xs, ns = g["x"].to_numpy(), g["n"].to_numpy(dtype=float)
                for i in range(0, len(xs), 2000):
                    d = (grid[:, None] - xs[None, i : i + 2000]) / bw
                    total += np.exp(-0.5 * d * d) @ ns[i : i + 2000]
                key = key if isinstance(key, tuple) else (key,)
                part = pd.DataFrame({"i": np.arange(points), "at": grid, "part": total / (bw * math.sqrt(2 * math.pi) * float(r["n_rows"]))})
                parts.append(part.assign(**dict(zip(by, key)))[[*by, "i", "at", "part"]])
            yield pd.concat(parts) if parts else pd.DataFrame(columns=[*by, "i", "at", "part"])

    schema = T.StructType([*[got.schema[b] for b in by], *T.StructType.fromDDL("i int, at double, part double").fields])
    curve = got.mapInPandas(add_up, schema).groupBy(*by, "i").agg(F.first("at").alias("at"), F.sum("part").alias("density"))
    q = group_quantiles(data, by, {"p025": (F.col("x"), 0.025), "p500": (F.col("x"), 0.5), "p975": (F.col("x"), 0.975)})
    return join_stats(curve, q, by, null_safe=True)


NU_GRID = (2, 3, 4, 5, 7, 10, 15, 20, 30, 50)


def fit_t_copula(df: DataFrame, cols: Sequence[str], grade: str = "grade", nu_grid: Sequence[float] = NU_GRID, min_rows: int = 200) -> tuple[JointModel, DataFrame]:
    """Student-t copula per grade: degrees of freedom with the best pseudo-likelihood and their correlation.

    All candidates share two passes over the probability scores: sums for the correlations,
    then the likelihoods.
    """
    cols = list(cols)
    model = fit_joint(df, cols, grade, min_rows)
    k = len(cols)
    us = interpolate_knots(model.data, model.knots, {f"__u_{c}": (c, c) for c in cols}, grade)
    us = us.select(grade, *[_clip(F.col(f"__u_{c}")).alias(f"__u_{c}") for c in cols]).dropna().persist(StorageLevel.MEMORY_AND_DISK)
    names = [f"__u_{c}" for c in cols]

    def sums(frames):
        for pdf in frames:
            parts = []
            for key, g in pdf.groupby(grade):
                u = g[names].to_numpy()
                for nu in nu_grid:
                    z = student.quantile(u, nu)
                    q = np.square(z).sum(axis=1)
                    parts.append((key, float(nu), len(z), z.sum(axis=0).tolist(), (z.T @ z).ravel().tolist(), float(q @ q), (q @ z).tolist()))
            yield pd.DataFrame(parts, columns=[grade, "nu", "n", "s", "p", "q4", "q3"])

    part_schema = T.StructType([us.schema[grade], *T.StructType.fromDDL("nu double, n long, s array<double>, p array<double>, q4 double, q3 array<double>").fields])
    added = us.mapInPandas(sums, part_schema).groupBy(grade, "nu").agg(
        F.sum("n").alias("n"), F.sum("q4").alias("q4"),
        F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(k)]).alias("s"),
        F.array(*[F.sum(F.get("p", F.lit(i))) for i in range(k * k)]).alias("p"),
        F.array(*[F.sum(F.get("q3", F.lit(i))) for i in range(k)]).alias("q3"),
    )

    def correlate(frames):
        for pdf in frames:
            out = []
            for r in pdf.to_dict("records"):
                c = shrunk_correlation(r["n"], np.array(r["s"]), np.array(r["p"]), r["q4"], np.array(r["q3"]))
                w, v = np.linalg.eigh(c)
                c = (v * np.maximum(w, 1e-8)) @ v.T
                d = np.sqrt(np.diag(c))
                c = c / np.outer(d, d)
                out.append((r[grade], r["nu"], r["n"], c.ravel().tolist(), np.linalg.inv(c).ravel().tolist(), float(np.linalg.slogdet(c)[1])))
            yield pd.DataFrame(out, columns=[grade, "nu", "n_rows", "corr", "inv", "logdet"])

    corr_schema = T.StructType([us.schema[grade], *T.StructType.fromDDL("nu double, n_rows long, corr array<double>, inv array<double>, logdet double").fields])
    fits = materialise(added.mapInPandas(correlate, corr_schema))
    listed = fits.groupBy(grade).agg(F.collect_list(F.struct("nu", "inv", "logdet")).alias("fits"))
    small, few = pin_if_small(listed, CURVE_GRADES)
    known = {r[grade]: [f.asDict() for f in r["fits"]] for r in small.collect()} if few else {}
    tagged = us if few else join_stats(us, listed, [grade], how="inner")

    def likelihood(frames):
        for pdf in frames:
            parts = []
            for key, g in pdf.groupby(grade):
                u = g[names].to_numpy()
                for fit in known[key] if few else g["fits"].iloc[0]:
                    nu, inv = fit["nu"], np.array([float(x) for x in fit["inv"]]).reshape(k, k)
                    z = student.quantile(u, nu)
                    q = np.einsum("ij,jk,ik->i", z, inv, z)
                    c = math.lgamma((nu + k) / 2) - math.lgamma(nu / 2) - k / 2 * math.log(nu * math.pi) - 0.5 * fit["logdet"]
                    ll = c - 0.5 * (nu + k) * np.log1p(q / nu) - student.log_density(z, nu).sum(axis=1)
                    parts.append((key, float(nu), float(ll.sum())))
            yield pd.DataFrame(parts, columns=[grade, "nu", "ll"])

    ll_schema = T.StructType([us.schema[grade], *T.StructType.fromDDL("nu double, ll double").fields])
    ll = tagged.mapInPandas(likelihood, ll_schema).groupBy(grade, "nu").agg(F.sum("ll").alias("copula_loglik"))
    table = materialise(join_stats(fits, ll, [grade, "nu"]))
    us.unpersist()
    best = table.groupBy(grade).agg(F.max_by("nu", "copula_loglik").alias("nu"))
    chosen = join_stats(table, best, [grade, "nu"], how="left_semi")
    model.corr = chosen.select(grade, "n_rows", "corr", "inv", "logdet", "nu")
    return model, table.select(grade, "nu", "copula_loglik")


def by_fit(work, k: int, width: int, type_: str | None = None, after=None):
    """UDF of (grade, correlation, nu, values...): ``work(correlation, nu, values)`` for the rows of each grade in a batch.

    It gives ``width`` numbers a row, passed through ``after(grade, numbers)`` if given; rows without a fit or with a gap
    in a value have none.
    """
    type_ = type_ or ", ".join(f"p{i} double" for i in range(width))

    @F.pandas_udf(type_)
    def run(g: pd.Series, corr: pd.Series, nu: pd.Series, *values: pd.Series) -> pd.DataFrame:
        x = np.column_stack([v.to_numpy(dtype=float) for v in values])
        nu = nu.to_numpy(dtype=float)
        whole = ~(np.isnan(x).any(axis=1) | np.isnan(nu))
        res = np.full((len(x), width), np.nan)
        for key, hit in rows_of(g):
            hit = hit[whole[hit]]
            if len(hit):
                # Rows of one grade share the fit: one factorisation and one product each per batch.
                made = work(np.asarray(corr.iloc[hit[0]], dtype=float).reshape(k, k), float(nu[hit[0]]), x[hit])
                res[hit] = made if after is None else after(key, made)
        return pd.DataFrame(res, columns=[c.split()[0] for c in type_.split(", ")])

    return run


def t_conditional_quantiles(
    df: DataFrame, model: JointModel, target: str, given: Sequence[str], quantiles: Sequence[float] = (0.05, 0.5, 0.95)
) -> DataFrame:
    """Quantiles of a target given other variables of the row under the t copula."""
    g, keep = model.grade, df.columns
    k, j = len(model.cols), model.cols.index(target)
    idx = [model.cols.index(c) for c in given]
    us = interpolate_knots(df, model.knots, {f"__u_{c}": (c, c) for c in given}, g)
    got = join_stats(us.withColumns({f"__u_{c}": _clip(F.col(f"__u_{c}")) for c in given}), model.corr.select(g, "corr", "nu"), [g])

    def images(r, v, u):
        zg = student.quantile(u, v).reshape(u.shape)
        b = np.linalg.solve(r[np.ix_(idx, idx)], r[idx, j])
        left = max(float(r[j, j] - b @ r[idx, j]), 0.0)
        quad = (zg * np.linalg.solve(r[np.ix_(idx, idx)], zg.T).T).sum(axis=1)
        scale = np.sqrt((v + quad) / (v + len(idx)) * left)
        t = (zg @ b)[:, None] + scale[:, None] * student.quantile(np.asarray(quantiles), v + len(idx))
        return np.clip(student.cdf(t.ravel(), v), EPS, 1 - EPS).reshape(t.shape)

    got = got.withColumn("__p", by_fit(images, k, len(quantiles))(F.col(g), F.col("corr"), F.col("nu"), *[F.col(f"__u_{c}") for c in given]))
    cols = {f"q{round(q * 100):02d}": i for i, q in enumerate(quantiles)}
    got = got.withColumns({f"__q{i}": F.col(f"__p.p{i}") for i in cols.values()})
    done = interpolate_knots(got, model.knots, {n: (target, f"__q{i}") for n, i in cols.items()}, g, "u", "x")
    return done.select(*keep, *cols)
