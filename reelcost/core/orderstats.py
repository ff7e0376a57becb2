"""Order statistics of moving windows without sorting each window.

The rows of a block get their rank among the block's values. A wavelet matrix splits the ranks bit by bit and keeps, per
bit, how many rows (or how much weight) before each position have a zero there. The k-th smallest value of any stretch
of rows then takes one look per bit, for all windows at once, whatever their width: O(log n) a row.
"""

from __future__ import annotations

import numpy as np


class Windows:
    """k-th smallest values of stretches ``[low, high)`` of ``values``; ``weights`` count a row several times."""

    def __init__(self, values: np.ndarray, weights: np.ndarray | None = None):
        n = len(values)
        order = np.argsort(values, kind="stable")
        self.sorted = np.asarray(values)[order]
        current = np.empty(n, np.int64)
        current[order] = np.arange(n)
        weight = np.ones(n, np.int64) if weights is None else np.asarray(weights, np.int64)
        self.total = np.concatenate([[0], np.cumsum(weight)])
        # Counts need the bits of their largest value only; rows that all count once share them with the weights.
        alone = bool((weight == 1).all())
        kind = np.int32 if max(n, int(self.total[-1])) < 2**31 else np.int64
        current, weight = current.astype(kind), weight.astype(kind)
        self.levels = []
        for b in range(max(1, int(n - 1).bit_length()) - 1, -1, -1):
            zero = (current >> b & 1) == 0
            count = self._sums(zero, kind)
            self.levels.append((count, count if alone else self._sums(np.where(zero, weight, kind(0)), kind), int(count[-1])))
            current, weight = (np.concatenate([x[zero], x[~zero]]) for x in (current, weight))

    @staticmethod
    def _sums(x: np.ndarray, kind: type) -> np.ndarray:
        out = np.zeros(len(x) + 1, kind)
        np.cumsum(x, out=out[1:], dtype=kind)
        return out

    def weight(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.total[high] - self.total[low]

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Value at place ``k`` (from 0, weights counted) of each stretch, which must be longer than ``k``."""
        low, high, k = (np.asarray(x, np.int64) for x in (low, high, k))
        rank = np.zeros(len(k), np.int64)
        for count, weight, zeros in self.levels:
            mine = weight[high] - weight[low]
            left = k < mine
            a, b = count[low], count[high]
            low, high = np.where(left, a, zeros + low - a), np.where(left, b, zeros + high - b)
            k = np.where(left, k, k - mine)
            rank = rank << 1 | ~left
        return self.sorted[rank]

    def quantile(self, low: np.ndarray, high: np.ndarray, p: float) -> np.ndarray:
        """Linear interpolation between the two order statistics around place p * (weight - 1)."""
        place = p * (self.weight(low, high) - 1)
        down, up = np.floor(place), np.ceil(place)
        a, b = self.kth(low, high, down), self.kth(low, high, up)
        return np.where(down == up, a, (up - place) * a + (place - down) * b)

    def below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Rows of each stretch with a value at most ``value`` (weights don't count)."""
        low, high = np.asarray(low, np.int64), np.asarray(high, np.int64)
        limit, rows = np.searchsorted(self.sorted, value, side="right"), high - low
        found = np.zeros(len(limit), np.int64)
        for (count, _, zeros), b in zip(self.levels, range(len(self.levels) - 1, -1, -1)):
            one = (limit >> b & 1).astype(bool)
            a, c = count[low], count[high]
            found += np.where(one, c - a, 0)
            low, high = np.where(one, zeros + low - a, a), np.where(one, zeros + high - c, c)
        return np.where(limit >= 1 << len(self.levels), rows, found)


def medians(w: Windows, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    n = high - low
    return (w.kth(low, high, (n - 1) // 2) + w.kth(low, high, n // 2)) / 2


def kth_deviation(w: Windows, low: np.ndarray, high: np.ndarray, center: np.ndarray, k: np.ndarray) -> np.ndarray:
    """k-th smallest (from 0) |value - center| of each stretch of unweighted rows.

    Values up to the centre, downwards, and values above it, upwards, are two sorted lists; a binary search finds how many
    of the first k + 1 deviations come from the lower one.
    """
    n = high - low
    under = w.below(low, high, center)
    over = n - under
    lower = lambda i: center - w.kth(low, high, np.clip(under - 1 - i, 0, n - 1))
    upper = lambda i: w.kth(low, high, np.clip(under + i, 0, n - 1)) - center
    need = k + 1
    a, b = np.maximum(0, need - over), np.minimum(need, under)
    while (a < b).any():
        middle = (a + b) // 2
        # More of the lower list are among them while its next value is nearer than the last one taken above.
        more = (a < b) & (lower(middle) < upper(need - middle - 1))
        a, b = np.where(more, middle + 1, a), np.where(more, b, np.where(a < b, middle, b))
    last_lower = np.where(a > 0, lower(a - 1), -np.inf)
    last_upper = np.where(need - a > 0, upper(need - a - 1), -np.inf)
    return np.maximum(last_lower, last_upper)


def median_deviations(w: Windows, low: np.ndarray, high: np.ndarray, center: np.ndarray) -> np.ndarray:
    n = high - low
    return (kth_deviation(w, low, high, center, (n - 1) // 2) + kth_deviation(w, low, high, center, n // 2)) / 2
