"""Ranks, order statistics and partial sums of any stretch of a sequence (numpy).

The sequence is held as a wavelet matrix over the places of its values in sorted order: for each bit
of the place, highest first, how many of the values before a position have a 0 there. A question about
a stretch follows it down the bits, so it costs as many steps as a place has bits, whatever the
length of the stretch, and all positions are asked at once.
"""

from __future__ import annotations

import numpy as np


class Stretches:
    """Finite values in order; stretches are [left, right) arrays of positions."""

    def __init__(self, values: np.ndarray, sums: bool = False):
        self.values, place = np.unique(values, return_inverse=True)
        self.bits = max(1, int(max(len(self.values) - 1, 1)).bit_length())
        self.zeros, self.sums = [], []
        held = np.asarray(values, np.longdouble)
        for b in reversed(range(self.bits)):
            one = (place >> b) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(one == 0)]))
            if sums:  # of the values with a 0; long doubles, as differences are taken
                self.sums.append(np.concatenate([[np.longdouble(0)], np.cumsum(np.where(one == 0, held, 0))]))
            order = np.argsort(one, kind="stable")
            place, held = place[order], held[order]

    def _down(self, zeros: np.ndarray, left: np.ndarray, right: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretch among the values that have a 1 (or a 0) at this bit."""
        l0, r0 = zeros[left], zeros[right]
        return np.where(one, zeros[-1] + left - l0, l0), np.where(one, zeros[-1] + right - r0, r0)

    def below(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray, equal: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Number of values < ``limit`` (or <= with ``equal``) in each stretch, and their sum if sums are held."""
        place = np.searchsorted(self.values, limit, "right" if equal else "left")
        all_ = place >= 1 << self.bits
        count, total = np.zeros(len(left), np.int64), np.zeros(len(left), np.longdouble)
        for i, b in enumerate(reversed(range(self.bits))):
            zeros = self.zeros[i]
            one = (((place >> b) & 1) == 1) | all_
            count += np.where(one, zeros[right] - zeros[left], 0)
            if self.sums:
                total += np.where(one, self.sums[i][right] - self.sums[i][left], 0)
            left, right = self._down(zeros, left, right, one)
        count += np.where(all_, right - left, 0)  # every value, also the one with all bits set
        if self.sums and all_.any():
            total += np.where(all_, (right - left) * np.longdouble(self.values[-1]), 0)
        return count, total.astype(float)

    def kth(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value with ``k`` (from 0) smaller ones before it in sorted order of each stretch."""
        place = np.zeros(len(left), np.int64)
        for zeros, b in zip(self.zeros, reversed(range(self.bits))):
            n0 = zeros[right] - zeros[left]
            one = k >= n0
            left, right = self._down(zeros, left, right, one)
            k = np.where(one, k - n0, k)
            place |= one.astype(np.int64) << b
        return self.values[np.minimum(place, len(self.values) - 1)]

    def quantile(self, left: np.ndarray, right: np.ndarray, q: float) -> np.ndarray:
        """Linear interpolation between the two nearest order statistics; stretches must not be empty."""
        at = q * (right - left - 1)
        low = np.floor(at).astype(np.int64)
        a = self.kth(left, right, low)
        b = self.kth(left, right, np.minimum(low + 1, right - left - 1))
        return np.where(at == low, a, (low + 1 - at) * a + (at - low) * b)


def windows(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The known values, and the stretch of them among the last ``n`` rows of each row."""
    known = ~np.isnan(values)
    before = np.concatenate([[0], np.cumsum(known)])
    rows = np.arange(len(values))
    return values[known], before[np.maximum(rows - n + 1, 0)], before[rows + 1]


def rolling_rank(values: np.ndarray, n: int, need: int) -> np.ndarray:
    """Share of the last n values below each value, equal ones counting half, plus half a value."""
    held, left, right = windows(values, n)
    count = right - left
    ok = ~np.isnan(values) & (count >= need)
    out = np.full(len(values), np.nan)
    if ok.any():
        s, left, right, x = Stretches(held), left[ok], right[ok], values[ok]
        below, _ = s.below(left, right, x)
        upto, _ = s.below(left, right, x, equal=True)
        out[ok] = (below + 0.5 * (upto - below) + 0.5) / count[ok]
    return out


def rolling_quantile(values: np.ndarray, n: int, need: int, q: float) -> np.ndarray:
    """Quantile of the known values of the last n rows, NaN with fewer than ``need`` of them."""
    held, left, right = windows(values, n)
    ok = right - left >= max(need, 1)
    out = np.full(len(values), np.nan)
    if ok.any():
        out[ok] = Stretches(held).quantile(left[ok], right[ok], q)
    return out


def rolling_tail(values: np.ndarray, n: int, need: int, qs: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level: the rolling quantile, and the mean of the values at or below it."""
    held, left, right = windows(values, n)
    ok = right - left >= max(need, 1)
    s = Stretches(held, sums=True) if ok.any() else None
    out = []
    for q in qs:
        limit, mean = np.full(len(values), np.nan), np.full(len(values), np.nan)
        if s is not None:
            limit[ok] = s.quantile(left[ok], right[ok], q)
            count, total = s.below(left[ok], right[ok], limit[ok], equal=True)
            with np.errstate(all="ignore"):
                mean[ok] = np.where(count > 0, total / count, np.nan)
        out.append((limit, mean))
    return out
