"""Numerical routines that Spark has no expression for: quantiles, ranks, unit
root statistics, local regression.  Plain NumPy, used inside grouped kernels."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def chi2_one_quantile(p: float) -> float:
    """Quantile of the chi-squared distribution with one degree of freedom."""
    return _NORMAL.inv_cdf((1 + p) / 2) ** 2


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties sharing their mean."""
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(counts)
    return (last - (counts - 1) / 2.0)[inverse]


#: MacKinnon (1994) response surface for one series, by regression
#: (n: none, c: constant, ct: trend, ctt: quadratic trend).
TAU_STAR = {"n": -1.04, "c": -1.61, "ct": -2.89, "ctt": -3.21}
TAU_MIN = {"n": -19.04, "c": -18.83, "ct": -16.18, "ctt": -17.17}
TAU_MAX = {"n": math.inf, "c": 2.74, "ct": 0.7, "ctt": 0.54}
TAU_SMALL = {"n": (0.6344, 1.2378, 0.032496), "c": (2.1659, 1.4412, 0.038269), "ct": (3.2512, 1.6047, 0.049588), "ctt": (4.0003, 1.658, 0.048288)}
TAU_LARGE = {
    "n": (0.4797, 0.93557, -0.06999, 0.033066), "c": (1.7339, 0.93202, -0.12745, -0.010368), "ct": (2.5261, 0.61654, -0.37956, -0.060285),
    "ctt": (3.0778, 0.49529, -0.41477, -0.059359)
}


def mackinnon_p(stat: float, regression: str = "c") -> float:
    """Approximate p-value of a unit root t statistic."""
    if stat > TAU_MAX[regression]:
        return 1.0
    if stat < TAU_MIN[regression]:
        return 0.0
    powers = TAU_SMALL[regression] if stat <= TAU_STAR[regression] else TAU_LARGE[regression]
    return _NORMAL.cdf(sum(c * stat**i for i, c in enumerate(powers)))


def trend_terms(n: int, regression: str) -> np.ndarray:
    t = np.arange(1, n + 1, dtype=float)
    return np.column_stack([np.ones(n), t, t * t])[:, : {"n": 0, "c": 1, "ct": 2, "ctt": 3}[regression]]


def unit_root_t(y: np.ndarray, lags: int = 1, regression: str = "c") -> tuple[float, int]:
    """t statistic of the level in a Dickey-Fuller regression with ``lags``
    lagged differences, and the number of observations used."""
    d = np.diff(y)
    n = len(d) - lags
    x = np.column_stack([y[lags:-1], *(d[lags - j : len(d) - j] for j in range(1, lags + 1)), trend_terms(n, regression)])
    target = d[lags:]
    free = n - x.shape[1]
    if free <= 0:
        return math.nan, n
    beta, _, rank, _ = np.linalg.lstsq(x, target, rcond=None)
    if rank < x.shape[1]:
        return math.nan, n
    rest = target - x @ beta
    var = rest @ rest / free * np.linalg.inv(x.T @ x)[0, 0]
    return (float(beta[0] / math.sqrt(var)), n) if var > 0 else (math.nan, n)


def unit_root_windows(y: np.ndarray, lags: int, regression: str) -> np.ndarray:
    """The statistic for each row of a matrix of equally long windows, from
    batched normal equations."""
    y = y - y.mean(1, keepdims=True) if regression != "n" else y
    d = np.diff(y, axis=1)
    n = d.shape[1] - lags
    terms = trend_terms(n, regression)
    if terms.shape[1] > 1:
        terms = terms / np.maximum(np.abs(terms).max(0), 1)
    cols = [y[:, lags:-1], *(d[:, lags - j : d.shape[1] - j] for j in range(1, lags + 1))]
    x = np.concatenate([np.stack(cols, 2), np.broadcast_to(terms, (len(y), *terms.shape))], 2)
    gram = np.einsum("wij,wik->wjk", x, x)
    scale = np.sqrt(np.maximum(np.einsum("wii->wi", gram), 1e-300))
    inverse = np.linalg.pinv(gram / scale[:, :, None] / scale[:, None, :], hermitian=True) / scale[:, :, None] / scale[:, None, :]
    target = d[:, lags:]
    beta = np.einsum("wjk,wk->wj", inverse, np.einsum("wij,wi->wj", x, target))
    rest = target - np.einsum("wij,wj->wi", x, beta)
    var = (rest**2).sum(1) / max(n - x.shape[2], 1) * inverse[:, 0, 0]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((var > 0) & (n > x.shape[2]), beta[:, 0] / np.sqrt(var), np.nan)


def window_statistics(walks: np.ndarray, least: int, lags: int = 1) -> np.ndarray:
    """The unit root statistics (with a constant) of all windows of at least ``least``
    points of each row: rows by windows.  A window's normal equations are differences of
    running sums over its row, shared by all windows, so that none is summed anew; where
    so little is left unexplained that differences can't tell it, the window is fitted
    by itself."""
    walks = np.atleast_2d(np.asarray(walks, float))
    y = walks - walks.mean(1, keepdims=True)
    n = y.shape[1]
    begin, end = (np.concatenate(x) for x in zip(*[(np.arange(n - size + 1), np.arange(size, n + 1)) for size in range(least, n + 1)], strict=True))
    d = np.diff(y, axis=1)
    # a row of the regression for each point from the second plus lags on
    level = [y[:, lags:-1], *(d[:, lags - j : d.shape[1] - j] for j in range(1, lags + 1)), np.ones_like(d[:, lags:])]
    columns = np.stack([*level, d[:, lags:]], 2)
    sums = np.concatenate([np.zeros((len(y), 1, lags + 3, lags + 3)), np.cumsum(columns[:, :, :, None] * columns[:, :, None, :], 1)], 1)
    first, last = begin, end - 1 - lags  # regression rows of a window
    free = last - first - (lags + 2)
    gram = sums[:, last] - sums[:, first]
    x, cross, total = gram[..., :-1, :-1], gram[..., :-1, -1], gram[..., -1, -1]
    scale = np.sqrt(np.maximum(np.einsum("rwii->rwi", x), 1e-300))
    with np.errstate(all="ignore"):
        inverse = np.linalg.pinv(x / scale[..., :, None] / scale[..., None, :], hermitian=True) / scale[..., :, None] / scale[..., None, :]
        beta = np.einsum("rwjk,rwk->rwj", inverse, cross)
        rest = total - np.einsum("rwj,rwj->rw", beta, cross)
        var = rest / np.maximum(free, 1) * inverse[..., 0, 0]
        out = np.where((var > 0) & (free > 0), beta[..., 0] / np.sqrt(var), np.nan)
    doubtful = ~(rest > 1e-6 * total) & (free > 0)
    for size in np.unique((end - begin)[doubtful.any(0)]).tolist():
        r, w = np.nonzero(doubtful & (end - begin == size))
        out[r, w] = unit_root_windows(walks[r[:, None], begin[w][:, None] + np.arange(size)], lags, "c")
    return out


def explosive_statistics(walks: np.ndarray, least: int, lags: int = 1, at_once: int = 1 << 16) -> np.ndarray:
    """For each row the largest right-tailed unit root statistic over all windows of at
    least ``least`` points (Phillips, Shi and Yu); none: nan."""
    walks = np.atleast_2d(np.asarray(walks, float))
    m = walks.shape[1] - least + 1
    if m < 1:
        return np.full(len(walks), np.nan)
    step = max(1, at_once // (m * (m + 1) // 2))
    best = [np.where(np.isfinite(t := window_statistics(walks[i : i + step], least, lags)), t, -np.inf).max(1) for i in range(0, len(walks), step)]
    found = np.concatenate(best) if best else np.zeros(0)
    return np.where(np.isfinite(found), found, np.nan)


def explosive_statistic(y: np.ndarray, least: int, lags: int = 1) -> float:
    """As ``explosive_statistics``, for one series."""
    return float(explosive_statistics(y, least, lags)[0])


def explosive_critical(n: int, least: int, reps: int, seed: int, level: float = 0.95) -> float:
    """Critical value for random walks of n points with a drift of 1/n."""
    rng = np.random.default_rng([seed, n, least])
    walks = np.cumsum(rng.standard_normal((reps, n)) + 1.0 / n, axis=1)
    return float(np.quantile(explosive_statistics(walks, least, 0), level))


def local_regression(x: np.ndarray, y: np.ndarray, frac: float = 0.25, robust: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Cleveland's local linear fit with tricube weights, and ``robust`` further
    rounds with bisquare weights on the residuals.  Sorted by x."""
    order = np.argsort(x, kind="stable")
    x, y = x[order].astype(float), y[order].astype(float)
    n = len(x)
    k = min(n, max(2, int(frac * n + 1e-10)))
    trust, fitted = np.ones(n), np.zeros(n)
    left = 0
    spans = np.zeros(n, np.int64)
    for i in range(n):
        while left + k < n and x[i] - x[left] > x[left + k] - x[i]:
            left += 1
        spans[i] = left
    for turn in range(robust + 1):
        for i in range(n):
            s = slice(spans[i], spans[i] + k)
            gap = x[s] - x[i]
            reach = max(abs(gap[0]), abs(gap[-1]))
            if reach > 0:
                w = np.where(
                    np.abs(gap) >= 0.999 * reach, 0.0, np.where(np.abs(gap) <= 0.001 * reach, 1.0, (1 - np.minimum(np.abs(gap) / reach, 1) ** 3) ** 3)
                ) * trust[s]
            else:
                w = trust[s].copy()
            total = w.sum()
            if total <= 0:
                fitted[i] = y[i]
                continue
            w /= total
            centre = w @ gap
            spread = w @ (gap - centre) ** 2
            if math.sqrt(spread) > 0.001 * (x[-1] - x[0]):
                w = w * (1 - centre * (gap - centre) / spread)
            fitted[i] = w @ y[s]
        if turn < robust:
            rest = np.abs(y - fitted)
            scale = 6 * np.median(rest)
            if scale <= 0:
                break
            u = rest / scale
            trust = np.where(u <= 0.001, 1.0, np.where(u >= 0.999, 0.0, (1 - np.minimum(u, 1) ** 2) ** 2))
    return x, fitted
