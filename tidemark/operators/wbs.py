"""Wild binary segmentation with the Lepage statistic (location and scale, from
ranks).  Random numbers come from a generator seeded by the data's place, so a
run repeats exactly whatever the partitioning."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from tidemark.functions.numeric import average_ranks


def lepage_splits(x: np.ndarray, least: int) -> np.ndarray:
    """The statistic for each split point (index of the left part's last value);
    -inf where a side is shorter than ``least``."""
    n = len(x)
    left = np.arange(1, n, dtype=float)
    right = n - left
    centred = average_ranks(x) - (n + 1) / 2
    place = np.cumsum(centred)[:-1]
    scale = np.cumsum(centred**2)[:-1]
    var_u = left * right * (n + 1) / 12
    var_m = left * right * (n + 1) * (n * n - 4) / 180
    ok = (var_u >= 1e-8) & (var_m >= 1e-8)
    with np.errstate(divide="ignore", invalid="ignore"):
        stat = np.where(ok, place**2 / var_u + (scale - left * (n * n - 1) / 12) ** 2 / var_m, 0.0)
    return np.where((left >= least) & (right >= least), stat, -np.inf)


#: Windows compared at once times the length of the series, at most.
BLOCK = 1 << 20


def _splits_of(x: np.ndarray, order: np.ndarray, tied: bool, start: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest statistic, and its place, in each window of ``size`` values
    from ``start``; ``order`` (repeated for as many windows) sorts all of x, and so,
    less the others, each window."""
    rows, all_of_x = len(start), order[: len(x)]
    inside = (all_of_x >= start[:, None]) & (all_of_x < start[:, None] + np.int32(size))
    at = order[np.flatnonzero(inside)].reshape(rows, size)
    if tied:
        i, v = np.arange(size), x[at]
        new = v[:, 1:] != v[:, :-1]
        edge = np.ones((rows, 1), bool)
        first = np.maximum.accumulate(np.where(np.hstack([edge, new]), i, 0), 1)
        last = np.minimum.accumulate(np.where(np.hstack([new, edge]), i, size - 1)[:, ::-1], 1)[:, ::-1]
        sorted_ranks = (first + last) / 2 - (size - 1) / 2
    else:
        sorted_ranks = np.broadcast_to(np.arange(size) - (size - 1) / 2, at.shape)
    centred = np.empty(rows * size)
    centred[at + (np.arange(rows) * size - start)[:, None]] = sorted_ranks
    centred = centred.reshape(rows, size)
    left = np.arange(least, size - least + 1, dtype=float)
    both = left * (size - left) * (size + 1) / 12
    place = np.cumsum(centred, 1)[:, least - 1 : size - least]
    scale = np.cumsum(np.square(centred, out=centred), 1)[:, least - 1 : size - least]
    stats = place**2 / both + (scale - left * (size * size - 1) / 12) ** 2 / (both * (size * size - 4) / 15)
    k = np.argmax(stats, 1)
    return stats[np.arange(len(k)), k], start + k + least - 1


def _largest(x: np.ndarray, lo: int, hi: int, draws: int, least: int, rng: np.random.Generator) -> tuple[float, int]:
    """Over ``draws`` random windows of x[lo] to x[hi]; windows drawn twice are
    looked at once, those of a length together."""
    x, n = x[lo : hi + 1], hi - lo + 1
    size = rng.integers(2 * least, n + 1, draws)
    start = rng.integers(0, n - size + 1)
    _, drawn = np.unique(size * n + start, return_index=True)
    size, start = size[drawn], start[drawn]
    start, order = start.astype(np.int32), np.argsort(x, kind="stable").astype(np.int32)
    tied = bool((np.diff(x[order]) == 0).any())
    stats, places = np.empty(len(size)), np.empty(len(size), np.int64)
    ends = np.flatnonzero(np.diff(size, append=-1)) + 1
    step = max(1, BLOCK // n)
    order = np.tile(order, min(step, int(np.diff(ends, prepend=0).max())))
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        for i in range(a, b, step):
            s = slice(i, min(i + step, b))
            stats[s], places[s] = _splits_of(x, order, tied, start[s], int(size[a]), least)
    top = np.flatnonzero(stats == stats.max())
    k = top[np.argmin(drawn[top])]
    return float(stats[k]), lo + int(places[k])


def grid(longest: int, least: int = 10) -> list[int]:
    """Lengths that thresholds are simulated for, in series of up to ``longest``."""
    near = range(2 * least, min(longest, 500) + 1, 10)
    return sorted({*near, *(n for n in (1000, 2000, 5000, 10000) if 500 < n <= longest)})


def between(length: int, lengths: list[int], value: Callable[[int], float]) -> float:
    """The value at this length, interpolated; beyond the last length, its value."""
    j = bisect_left(lengths, length)
    near = lengths[max(0, j - 1) : j + 1]
    return float(np.interp(length, near, [value(n) for n in near]))


def noise_maximum(length: int, rep: int, draws: int = 10000, least: int = 10, seed: int = 123) -> float:
    """The largest statistic of one simulated series of noise."""
    rng = np.random.default_rng([seed, length, draws, least, rep])
    return _largest(rng.standard_normal(length), 0, length - 1, draws, least, rng)[0]


@lru_cache(maxsize=256)
def threshold(length: int, draws: int, alpha: float, least: int, reps: int, seed: int = 123) -> float:
    """Quantile of the largest statistic for noise of this length."""
    return float(np.quantile([noise_maximum(length, rep, draws, least, seed) for rep in range(reps)], 1 - alpha))


def segment(
    x: np.ndarray, q: float = 1.0, draws: int = 10000, alpha: float = 0.05, least: int = 10, prune: bool = True, reps: int = 200, seed: int = 123,
    limits: dict[int, float] | None = None
) -> list[int]:
    """Places (index of the last value before a change), ascending.  ``limits``
    has the threshold of each length of the grid; without it they are simulated
    here as they are needed.  Lengths between are interpolated, longer ones have
    the last."""
    lengths = grid(len(x), least)
    value = limits.get if limits else lambda n: threshold(n, draws, alpha, least, reps, seed)
    limit = lambda n: q * between(n, lengths, value)
    found, todo = [], [(0, len(x) - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo + 1 < 2 * least:
            continue
        best, at = _largest(x, lo, hi, draws, least, np.random.default_rng([seed, lo, hi]))
        if at >= 0 and best > limit(hi - lo + 1):
            found.append(at)
            todo += [(lo, at), (at + 1, hi)]
    found.sort()
    if not prune:
        return found
    kept = []
    for i, at in enumerate(found):
        lo = found[i - 1] + 1 if i else 0
        hi = (found[i + 1] if i + 1 < len(found) else len(x)) - 1
        if hi - lo + 1 >= 2 * least and _largest(x, lo, hi, draws, least, np.random.default_rng([seed, lo, hi, 1]))[0] > limit(hi - lo + 1):
            kept.append(at)
    return kept
