"""Exact p-value of the two-sample Kolmogorov–Smirnov statistic."""

from __future__ import annotations

import math

import numpy as np


def exact_p(n: int, m: int, statistic: float) -> float:
    """Probability that two samples of ``n`` and ``m`` rows of one distribution without ties are at least this far apart.

    Orders of the joint sample are lattice paths from (0, 0) to (n, m). The share of paths to (i, j) that never leave
    the band |i / n - j / m| < statistic follows from those to (i - 1, j) and (i, j - 1), one diagonal i + j at a time, so
    the work is at most the number of lattice points in the band and nothing overflows.
    """
    whole = math.lcm(n, m)
    # Distances are multiples of 1 / lcm, so the statistic is read as a whole number of them.
    limit = round(statistic * whole)
    if limit <= 0:
        return 1.0
    a, b = whole // n, whole // m
    share = np.array([1.0])
    first = 0  # number of rows of the first sample at the first place of ``share``
    for k in range(1, n + m + 1):
        # Band: -limit < i a - (k - i) b < limit, and both samples long enough.
        low = max(0, k - m, (k * b - limit) // (a + b) + 1)
        high = min(n, k, -((-k * b - limit) // (a + b)) - 1)
        if low > high:
            return 1.0
        i = np.arange(low, high + 1)
        padded = np.concatenate([[0.0], share, [0.0]])
        at = np.clip(i - first + 1, 0, len(padded) - 1)
        before = np.clip(i - first, 0, len(padded) - 1)
        share, first = padded[before] * (i / k) + padded[at] * ((k - i) / k), low
    return float(min(1.0, max(0.0, 1.0 - share[0])))
