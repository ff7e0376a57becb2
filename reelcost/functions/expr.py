"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL = 999999.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NULL for NaN and infinities."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ratio(num: str | Column, den: str | Column) -> Column:
    """Division that gives NULL on a zero denominator."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def sentinel_ratio(num: str | Column, den: str | Column) -> Column:
    """Division whose infinities become ±999999; 0/0 is NULL."""
    n, d = col(num).cast("double"), col(den).cast("double")
    return F.when((d == 0) & (n != 0), F.signum(n) * SENTINEL).otherwise(F.try_divide(n, d))


def sentinel_encode(c: str | Column) -> Column:
    c = col(c)
    return F.when(c == float("inf"), SENTINEL).when(c == float("-inf"), -SENTINEL).otherwise(c)


def sentinel_decode(c: str | Column) -> Column:
    return F.when(~col(c).isin(SENTINEL, -SENTINEL), col(c))


def safe_inverse(c: str | Column, eps: float = 1e-9) -> Column:
    c = col(c).try_cast("double")
    return F.when(F.abs(c) > eps, F.try_divide(F.lit(1.0), c))


def strict_sum(cols: Sequence[str | Column]) -> Column:
    """NULL when any part is NULL."""
    return reduce(lambda a, b: a + b, [col(c) for c in cols])


def filled_sum(cols: Sequence[str | Column]) -> Column:
    """NULL parts count as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in cols])


def truthy(c: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(c, F.lit(False))


# Coefficients of the rational approximation of erfc by W. J. Cody in the
# form published by Numerical Recipes (relative error below 1.2e-7).
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def normal_cdf(c: str | Column) -> Column:
    """Standard normal distribution function."""
    x = col(c)
    z = F.abs(x) / (2.0**0.5)
    t = 1.0 / (1.0 + 0.5 * z)
    poly = reduce(lambda acc, k: acc * t + k, reversed(ERFC[:-1]), F.lit(ERFC[-1]))
    tail = 0.5 * t * F.exp(-z * z + poly)
    return F.when(x >= 0, 1.0 - tail).otherwise(tail)


def standard_normal_cdf(x: np.ndarray) -> np.ndarray:
    """The same function on arrays, for use inside tasks."""
    z = np.abs(x) / (2.0**0.5)
    t = 1.0 / (1.0 + 0.5 * z)
    poly = np.full_like(t, ERFC[-1])
    for k in reversed(ERFC[:-1]):
        poly = poly * t + k
    tail = 0.5 * t * np.exp(-z * z + poly)
    return np.where(x >= 0, 1.0 - tail, tail)


# Coefficients of P. J. Acklam's rational approximation of the inverse normal
# distribution function (relative error below 1.15e-9).
ACKLAM_A = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
ACKLAM_B = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
ACKLAM_C = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
ACKLAM_D = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]
ACKLAM_LOW = 0.02425


def normal_quantile(p: str | Column) -> Column:
    """Inverse standard normal distribution function as an expression; NULL outside (0, 1)."""
    p = col(p)
    horner = lambda ks, x: reduce(lambda acc, k: acc * x + k, ks[1:], F.lit(ks[0]))
    low, high = ACKLAM_LOW, 1 - ACKLAM_LOW
    r = (p - 0.5) * (p - 0.5)
    mid = horner(ACKLAM_A, r) * (p - 0.5) / horner(ACKLAM_B, r)
    ql = F.sqrt(-2.0 * F.log(F.when((p > 0) & (p < low), p)))
    qh = F.sqrt(-2.0 * F.log(1.0 - F.when((p < 1) & (p > high), p)))
    return (
        F.when((p <= 0) | (p >= 1), F.lit(None))
        .when(p < low, horner(ACKLAM_C, ql) / horner(ACKLAM_D, ql))
        .when(p <= high, mid)
        .otherwise(-horner(ACKLAM_C, qh) / horner(ACKLAM_D, qh))
    )


def standard_normal_quantile(p: np.ndarray) -> np.ndarray:
    """The same function on arrays, for use inside tasks."""
    p = np.asarray(p, dtype=float)
    q = p - 0.5
    r = q * q
    out = np.asarray(_polynomial(ACKLAM_A, r) * q / _polynomial(ACKLAM_B, r))
    far = (p < ACKLAM_LOW) | (p > 1 - ACKLAM_LOW)
    if far.any():
        ends = p[far]
        with np.errstate(invalid="ignore", divide="ignore"):
            t = np.sqrt(-2.0 * np.log(np.minimum(ends, 1 - ends)))
            tail = _polynomial(ACKLAM_C, t) / _polynomial(ACKLAM_D, t)
        out[far] = np.where(ends < ACKLAM_LOW, tail, -tail)
    return out


def _polynomial(coefs: Sequence[float], x: np.ndarray) -> np.ndarray:
    """``np.polyval`` in place."""
    y = 0.0 * x + coefs[0]
    for c in coefs[1:]:
        y *= x
        y += c
    return y


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two numeric arrays in double precision."""
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
