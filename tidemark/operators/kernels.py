"""Sequential change detectors as single-pass kernels.

A kernel holds the state of one series; ``step`` takes the next number and says
whether a change is detected now, with its direction and score.  Batch and
stream run the same objects: they are plain, picklable state.  ``on`` says what
a kernel is fed: first differences or levels.
"""

from __future__ import annotations

import bisect
import math
from collections import deque
from dataclasses import dataclass, field

import numpy as np

from tidemark.functions.numeric import chi2_one_quantile

NATIVE, VALUE, ADAPTIVE = "native_cpd", "native_cpd_e_value", "native_cpd_adaptive"
MEAN, LEVEL, SEGMENT = "inferred_cpd_mean_shift", "inferred_cpd_level_shift", "inferred_cpd_segment_mean"

#: (direction, score)
Event = tuple[int, float]


def sign(x: float) -> int:
    return (x > 0) - (x < 0) if math.isfinite(x) else 0


@dataclass
class Kernel:
    q: float = 1.0
    on = "diff"
    source = NATIVE

    def step(self, x: float) -> Event | None:
        raise NotImplementedError


@dataclass
class Cusum(Kernel):
    """Two one-sided sums of differences beyond the allowance ``nu``."""

    h: float = 0.03
    nu: float = 5e-5
    up: float = 0.0
    down: float = 0.0

    def step(self, x):
        self.up = max(0.0, self.up + x - self.nu)
        self.down = max(0.0, self.down - x - self.nu)
        score = max(self.up, self.down)
        if score <= self.q * self.h:
            return None
        way = 1 if self.up >= self.down else -1
        self.up = self.down = 0.0
        return way, score


@dataclass
class _Running(Kernel):
    """Detectors that compare with a running mean and variance, which start from
    a warm-up and begin anew at a change."""

    warmup: int = 20
    first: list[float] = field(default_factory=list)
    mean: float = 0.0
    var: float = 0.0
    n: int = 0

    def begin(self):
        """Called once the warm-up is over."""

    def judge(self, z: float, sigma: float) -> Event | None:
        raise NotImplementedError

    def step(self, x):
        if len(self.first) < self.warmup:
            self.first.append(x)
            if len(self.first) == self.warmup:
                self.mean, self.var, self.n = float(np.mean(self.first)), float(np.var(self.first)), self.warmup
                self.begin()
            return None
        sigma = math.sqrt(max(self.var, 1e-8))
        event = self.judge(x - self.mean, sigma)
        if event:
            self.mean, self.var, self.n = x, sigma * sigma, 1
            return event
        self.n += 1
        before = x - self.mean
        self.mean += before / self.n
        self.var = ((self.n - 1) * self.var + before * (x - self.mean)) / self.n
        return None


@dataclass
class CusumLs(_Running):
    warmup: int = 30
    drift: float = 0.003
    k: float = 5.0
    up: float = 0.0
    down: float = 0.0

    def judge(self, z, sigma):
        self.up = max(0.0, self.up + z - self.drift)
        self.down = min(0.0, self.down + z + self.drift)
        score = max(self.up, -self.down)
        if score <= self.q * self.k * sigma:
            return None
        way = 1 if self.up >= -self.down else -1
        self.up = self.down = 0.0
        return way, score


@dataclass
class Sprt(_Running):
    """One cumulative sum between two limits."""

    drift: float | None = 0.0
    k: float = 30.0
    g: float = 0.0

    def begin(self):
        if self.drift is None:
            self.drift = 0.5 * math.sqrt(self.var)

    def judge(self, z, sigma):
        self.g += z - self.drift
        if abs(self.g) <= self.q * self.k * sigma:
            return None
        g, self.g = self.g, 0.0
        return sign(g), abs(g)


@dataclass
class Gma(_Running):
    """Geometric moving average."""

    lam: float = 0.9
    k: float = 2.0
    g: float = 0.0

    def judge(self, z, sigma):
        self.g = self.lam * self.g + (1 - self.lam) * z
        if abs(self.g) <= self.q * self.k * sigma:
            return None
        g, self.g = self.g, 0.0
        return sign(g), abs(g)


class Sums:
    """Prefix sums of a growing segment, doubled in size when full."""

    def __init__(self):
        self.n = 0
        self.s = np.zeros(64)
        self.s2 = np.zeros(64)

    def add(self, x: float) -> None:
        if self.n + 1 >= len(self.s):
            self.s, self.s2 = (np.concatenate([a, np.zeros(len(a))]) for a in (self.s, self.s2))
        self.s[self.n + 1] = self.s[self.n] + x
        self.s2[self.n + 1] = self.s2[self.n] + x * x
        self.n += 1

    def best_split(self, window: int | None, least_left: int, least_right: int, floor: float, strict: bool) -> tuple[float, float]:
        """Largest two-sample statistic over all splits, and right minus left mean."""
        first = max(0, self.n - 1 - window) if window is not None else 0
        left = np.arange(max(first + 1, least_left), self.n - least_right + 1)
        if not len(left):
            return -math.inf, 0.0
        right = self.n - left
        a, b = self.s[left], self.s[self.n] - self.s[left]
        ma, mb = a / left, b / right
        var = (self.s2[left] - a * ma) / np.maximum(left - 1, 1)
        ok = var > floor if strict else var >= floor
        if not ok.any():
            return -math.inf, 0.0
        stat = np.where(ok, (ma - mb) ** 2 / (np.where(ok, var, 1.0) * (1.0 / left + 1.0 / right)), -np.inf)
        i = int(np.argmax(stat))
        return float(stat[i]), float(mb[i] - ma[i])


@dataclass
class Glr(Kernel):
    """Generalised likelihood ratio of a shift in mean at any earlier place."""

    window: int | None = None
    init_len: int = 20
    min_right_len: int = 5
    sums: Sums = field(default_factory=Sums)
    source = MEAN

    def step(self, x):
        self.sums.add(x)
        stat, gap = self.sums.best_split(self.window, self.init_len, self.min_right_len, 1e-8, False)
        if stat <= self.q * chi2_one_quantile(0.9999):
            return None
        self.sums = Sums()
        return sign(gap), stat


@dataclass
class BrandtGlr(Kernel):
    """A window's mean against all that has left it."""

    window: int = 10
    alpha: float = 1e-4
    buffer: deque = field(default_factory=deque)
    n: int = 0
    s: float = 0.0
    s2: float = 0.0
    inside: float = 0.0
    on = "level"
    source = MEAN

    def statistic(self, y: float, least: int = 5, floor: float = 0.0) -> float | None:
        """The statistic after y, 0 while there is too little; None: no variance."""
        self.buffer.append(y)
        self.inside += y
        if len(self.buffer) > self.window:
            old = self.buffer.popleft()
            self.n, self.s, self.s2, self.inside = self.n + 1, self.s + old, self.s2 + old * old, self.inside - old
        if len(self.buffer) < self.window or self.n < least:
            return 0.0
        mean = self.s / self.n
        var = (self.s2 - self.s * mean) / max(self.n - 1, 1)
        if (abs(var) <= floor) if floor == 0.0 else (var <= floor):
            return None
        self.gap = self.inside / self.window - mean
        return self.window * self.gap**2 / var

    def restart(self, y: float) -> None:
        self.n, self.s, self.s2, self.inside = 0, 0.0, 0.0, y
        self.buffer = deque([y])

    def step(self, x):
        if self.window < 2:
            return None
        stat = self.statistic(x)
        if stat is None or stat <= chi2_one_quantile(1 - self.alpha) * 10 * self.q:
            return None
        way = sign(self.gap)
        self.restart(x)
        return way, stat


@dataclass
class Shewhart(Kernel):
    """``c_lim`` consecutive points outside limits set by the segment's first
    ``window`` points; the next segment begins at the first of those."""

    window: int = 24
    c_lim: int = 5
    k: float = 10.0
    base: list[float] = field(default_factory=list)
    mean: float = 0.0
    sd: float = 0.0
    run: list[float] = field(default_factory=list)
    on = "level"
    source = LEVEL

    def step(self, x):
        event = self._take(x)
        if event:
            # the points of the run are the new segment's first; none of them can complete another run
            again, self.base, self.run = self.run, [], []
            for y in again:
                self._take(y)
        return event

    def _take(self, y):
        if len(self.base) < self.window:
            self.base.append(y)
            if len(self.base) == self.window:
                self.mean, self.sd = float(np.mean(self.base)), float(np.std(self.base, ddof=1)) if self.window > 1 else math.nan
            return None
        if not abs(y - self.mean) > self.q * self.k * self.sd:
            self.run = []
            return None
        self.run.append(y)
        if len(self.run) < self.c_lim:
            return None
        return sign(y - self.mean), abs(y - self.mean) / max(self.sd, 1e-8)


@dataclass
class EDetector(Kernel):
    """Mean of betting capitals on standardised differences."""

    vol_window: int = 30
    warmup: int = 50
    lambda_grid: tuple = (0.01, 0.02, 0.05, 0.1)
    clip: float = 5.0
    two_sided: bool = True
    recent: deque = field(default_factory=deque)
    t: int = -1
    capital: list[float] | None = None
    source = VALUE

    def __post_init__(self):
        grid = set(self.lambda_grid)
        self.bets = sorted(grid | {-v for v in grid}) if self.two_sided else list(self.lambda_grid)

    def standardised(self, x: float, least: int, epsilon: float) -> float:
        self.t += 1
        self.recent.append(x)
        if len(self.recent) > self.vol_window:
            self.recent.popleft()
        n = len(self.recent)
        if n < max(least, 2):
            return math.nan
        mean = sum(self.recent) / n
        size = math.sqrt(sum([(v - mean) * (v - mean) for v in self.recent]) / (n - 1))
        return max(-self.clip, min(self.clip, x / (size + epsilon)))

    def wager(self, z: float) -> tuple[float, float]:
        """(mean capital, the bet that gained most)"""
        if self.capital is None:
            self.capital = [1.0] * len(self.bets)
        self.capital = [math.exp(b * z - 0.5 * b * b) * max(c, 1.0) for b, c in zip(self.bets, self.capital, strict=True)]
        return sum(self.capital) / len(self.bets), self.bets[self.capital.index(max(self.capital))]

    def step(self, x):
        z = self.standardised(x, self.vol_window, 1e-8)
        if self.t < max(self.warmup, self.vol_window) or math.isnan(z):
            return None
        mean, best = self.wager(z)
        if mean <= math.exp(self.q):
            return None
        self.capital = None
        return sign(best) or sign(z), mean


@dataclass
class SsrCusum(Kernel):
    """CUSUM of signed sequential ranks: invariant to scale."""

    zeta: float = 0.25
    h0: float = 10.0
    sizes: list[float] = field(default_factory=list)
    i: int = 0
    up: float = 0.0
    down: float = 0.0

    def score(self, x: float) -> float:
        rank = bisect.bisect_right(self.sizes, abs(x)) + 1
        bisect.insort(self.sizes, abs(x))
        i = self.i + 1
        xi = (1 if x >= 0 else -1) * rank * math.sqrt(6.0 / ((2 * i + 1) * (i + 1)))
        self.up = max(0.0, self.up + xi - self.zeta)
        self.down = min(0.0, self.down + xi + self.zeta)
        return max(self.up, -self.down)

    def restart(self) -> None:
        self.sizes, self.i, self.up, self.down = [], 0, 0.0, 0.0

    def step(self, x):
        score = self.score(x)
        if score <= self.q * self.h0:
            self.i += 1
            return None
        way = 1 if self.up >= -self.down else -1
        self.restart()
        return way, score


#: Fixed values of the adaptive detector: priors of the variance estimate.
ALPHA_UP, BETA_UP, ALPHA_DOWN, BETA_DOWN = 12.0, 15.0, 16.3, 15.0


@dataclass
class AdaptiveCusum(Kernel):
    """Likelihood ratio sums for eight directions of change (mean up, down or
    same; variance up, down or same), with parameters estimated as they go.
    A direction's state is its sum, its points, their sum and squares, and the
    estimates of mean and variance."""

    h0: float = 10.0
    vol_window: int = 30
    warmup: int | None = None
    rho_mu: float = 0.25
    s: float = 1.0
    eta: float = 4.0
    rho_theta_up: float = 1.05
    rho_theta_down: float = 1 / 1.05
    recent: deque = field(default_factory=deque)
    state: list[tuple[float, ...]] | None = None
    source = ADAPTIVE
    M = (1, 1, 1, -1, -1, -1, 0, 0)
    V = (1, -1, 0, 1, -1, 0, 1, -1)

    def start(self, m: int, v: int) -> tuple[float, float]:
        return m * self.rho_mu, self.rho_theta_up if v > 0 else self.rho_theta_down if v < 0 else 1.0

    def spread(self) -> float:
        r = self.recent
        n = len(r)
        mean = sum(r) / n
        return (sum([v * v for v in r]) - n * mean * mean) / max(n - 1, 1)

    def score(self, x: float) -> tuple[float, int]:
        """(largest sum, its direction)"""
        if self.state is None:
            self.state = [(0.0, 0, 0.0, 0.0, *self.start(m, v)) for m, v in zip(self.M, self.V, strict=True)]
        state, best, at = [], -1.0, 0
        for i, ((c, n, s, q, mu, theta), m, v) in enumerate(zip(self.state, self.M, self.V, strict=True)):
            d = x - mu
            c += 0.5 * (x * x - d * d / theta - math.log(theta))
            if c > 0:
                n, s = n + 1, s + x
                if m:
                    pull = (m * self.s + s) / (self.eta + n)
                    mu = max(self.rho_mu, pull) if m > 0 else min(-self.rho_mu, pull)
                d = x - mu
                q += d * d
                if v > 0:
                    theta = max(self.rho_theta_up, (BETA_UP + q / 2) / (ALPHA_UP - 1 + n / 2))
                elif v < 0:
                    theta = min(self.rho_theta_down, (BETA_DOWN + q / 2) / (ALPHA_DOWN - 1 + n / 2))
            else:
                c, n, s, q = 0.0, 0, 0.0, 0.0
                mu, theta = self.start(m, v)
            if c > best:
                best, at = c, i
            state.append((c, n, s, q, mu, theta))
        self.state = state
        return best, at

    def step(self, x):
        self.recent.append(x)
        if len(self.recent) <= self.vol_window:
            return None
        self.recent.popleft()
        z = x / math.sqrt(max(self.spread(), 1e-8))
        score, best = self.score(z)
        if score <= self.q * self.h0:
            return None
        self.state = None
        return int(self.M[best]) or sign(x), score


@dataclass
class SegmentBeam(Kernel):
    """Segmentations scored by an information criterion, the best ``M`` kept.
    A segmentation is (its open segment's sums, closed segments' residuals and
    sizes, change places).  ``answer`` gives the best one's change places under
    the rule that a segment closed by the last bar has no successor yet."""

    M: int = 3
    split_top_k: int = 5
    min_seg_len: int = 10
    t: int = -1
    beam: list = field(default_factory=lambda: [(0.0, 0.0, 0, 0.0, 0, 0, ())])
    recent: deque = field(default_factory=deque)  # the last values, as many as a segment has at least
    around: dict = field(default_factory=dict)  # of each change place of the beam: values before and from it on
    on = "level"
    source = SEGMENT

    @staticmethod
    def rest(s: float, s2: float, n: int) -> float:
        if n <= 1:
            return 1e-8
        mean = s / n
        return max(s2 - 2 * mean * s + n * mean * mean, 1e-8)

    def cost(self, rss: float, n: int, segments: int) -> float:
        return n * math.log(max(rss, 1e-8) / n) + self.q * 2 * segments * math.log(n) if n > 1 else math.inf

    def step(self, x):
        self.t += 1
        self.recent.append(x)
        if len(self.recent) > self.min_seg_len:
            self.recent.popleft()
        for _, right in self.around.values():
            if len(right) < self.min_seg_len:
                right.append(x)
        grown = []
        for s, s2, n, rss, total, segments, places in self.beam:
            h = (s + x, s2 + x * x, n + 1, rss, total, segments, places)
            grown.append((self.cost(rss + self.rest(*h[:3]), total + h[2], segments + 1), h))
        for _, (s, s2, n, rss, total, segments, places) in sorted(grown, key=lambda g: g[0])[: self.split_top_k]:
            if n >= self.min_seg_len:
                h = (0.0, 0.0, 0, rss + self.rest(s, s2, n), total + n, segments + 1, (*places, self.t + 1))
                grown.append((self.cost(h[3], h[4], h[5]), h))
        best: dict = {}
        for cost, h in sorted(grown, key=lambda g: g[0]):
            best.setdefault((h[6], h[2]), (cost, h))
            if len(best) == self.M:
                break
        self.beam = [h for _, h in best.values()]
        self.costs = [c for c, _ in best.values()]
        alive = {p for h in self.beam for p in h[6]}
        if self.around.keys() != alive:  # a place comes in only where the next value begins
            self.around = {p: self.around.get(p) or (tuple(self.recent), []) for p in sorted(alive)}
        return None

    def direction(self, place: int) -> int:
        """Sign of the change at a place of the beam: ``direction_around`` of all values."""
        left, right = (np.array(side) for side in self.around[place])
        return sign(float(right.mean() - left.mean())) if len(left) >= 2 and len(right) >= 2 else 0

    def answer(self) -> tuple[int, ...]:
        if self.t + 1 < 2 * self.min_seg_len:
            return ()
        # the last bar opens no segment: one dated after it is no change yet, and segmentations that then agree are one
        seen: dict = {}
        for cost, (s, s2, n, rss, total, segments, places) in zip(self.costs, self.beam, strict=True):
            places = tuple(p for p in places if p <= self.t)
            score = cost if n == 0 else self.cost(rss + self.rest(s, s2, n), total + n, segments + 1)
            seen.setdefault((places, n), (score, places))
        return min(seen.values(), key=lambda v: v[0])[1]


KERNELS: dict[str, type[Kernel]] = {
    "cusum": Cusum, "cusum_ls": CusumLs, "sprt": Sprt, "gma": Gma, "glr": Glr, "brandt_glr": BrandtGlr, "shewhart": Shewhart,
    "recursive_param_seg": SegmentBeam, "e_detector": EDetector, "ssr_cusum": SsrCusum, "adaptive_cusum": AdaptiveCusum,
}


def make(method: str, q: float = 1.0, **options) -> Kernel:
    name = method.lower()
    if name not in KERNELS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join([*KERNELS, 'wbs_lepage'])}")
    return KERNELS[name](q=q, **options)


def direction_around(values: np.ndarray, at: int, reach: int) -> int:
    """Sign of the mean of ``reach`` values from ``at`` less that of the ones before."""
    left, right = values[max(0, at - reach) : at], values[at : at + reach]
    return sign(float(right.mean() - left.mean())) if len(left) >= 2 and len(right) >= 2 else 0
