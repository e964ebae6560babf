"""Questions about ranges of an ordered array, many at once: in time logarithmic in its length each, and memory in proportion to it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Kth = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def kth_smallest(rank: np.ndarray) -> Kth:
    """A function (from, to, k) that gives the k-th smallest, from 0, of ``rank[from:to]``; ranks are 0 to n - 1, once each.

    A wavelet matrix: the ranks sorted stably by each bit, highest first, with the running number of zero bits.
    """
    levels, now = [], rank.astype(np.int64)
    for bit in range(max(1, int(len(rank) - 1).bit_length()) - 1, -1, -1):
        zero = (now >> bit) & 1 == 0
        levels.append((bit, np.concatenate([[0], np.cumsum(zero)]).astype(np.int32)))
        now = np.concatenate([now[zero], now[~zero]])

    def ask(low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        low, high, k, out = low.copy(), high.copy(), k.copy(), np.zeros(len(k), np.int64)
        for bit, zeros in levels:
            a, b = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            left = k < b - a
            out |= np.where(left, 0, 1 << bit)
            k = np.where(left, k, k - (b - a))
            low, high = np.where(left, a, zeros[-1] + low - a), np.where(left, b, zeros[-1] + high - b)
        return out

    return ask


def percentile_of(ranked: np.ndarray, kth: Kth, low: np.ndarray, high: np.ndarray, q: float) -> np.ndarray:
    """Exact percentiles of ranges by linear interpolation at rank q * (n - 1), as Spark has them; NaN for empty ranges.

    ``ranked`` are the values in order, ``kth`` is :func:`kth_smallest` of their ranks.
    """
    out, some = np.full(len(low), np.nan), np.flatnonzero(high > low)
    position = (high - low - 1)[some] * q
    below, above = np.floor(position), np.ceil(position)
    x, y = (ranked[kth(low[some], high[some], p.astype(np.int64))] for p in (below, above))
    with np.errstate(invalid="ignore"):
        between = (above - position) * x + (position - below) * y
    out[some] = np.where((below == above) | (x == y), x, between)
    return out


def first_above(rank: np.ndarray, least: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The first place of each range [low, high) with a rank of ``least`` or more; -1 where there is none."""
    tree = [rank.astype(np.int64)]
    while len(tree[-1]) > 1:
        t = tree[-1] if len(tree[-1]) % 2 == 0 else np.append(tree[-1], -1)
        tree.append(np.maximum(t[::2], t[1::2]))
    at, level = low.astype(np.int64), np.full(len(low), -1)
    # Up: nothing from the range's begin to the node is large enough.
    for h, t in enumerate(tree):
        rows = np.flatnonzero((level < 0) & ((at % 2 == 1) | (h == len(tree) - 1)))
        hit = np.append(t, -1)[np.minimum(at[rows], len(t))] >= least[rows]
        level[rows[hit]] = h
        at[rows[~hit]] += 1
        at[level < 0] >>= 1
    # Down, to the first half that has one.
    for h in range(len(tree) - 2, -1, -1):
        rows = np.flatnonzero(level > h)
        at[rows] *= 2
        at[rows] += tree[h][at[rows]] < least[rows]
    return np.where((level >= 0) & (at < high), at, -1)
