"""The market-state machine: changes of direction, exceptions, fixed extremes,
1-2-3 trends and their phases, one row per bar, using only bars seen so far.

Both sides of the market are one code: side +1 looks at highs, side -1 at lows
turned over, so that "further out" is always "larger".
"""

from __future__ import annotations

import bisect
import math
from collections import deque
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import kernels
from tidemark.plans.order import spread

KIND = {1: "high", -1: "low"}
NAN = math.nan


@dataclass(frozen=True)
class Extreme:
    side: int
    idx: int
    value: float
    after: int = 0  # extremes of the other side before it


@dataclass(frozen=True)
class Trend:
    side: int = 0
    confirmed: bool = False
    point2: Extreme | None = None
    point3: Extreme | None = None
    candidate: tuple[int, Extreme, Extreme] | None = None

    @property
    def name(self) -> str:
        return "no_trend" if not self.side else ("uptrend" if self.side > 0 else "downtrend") + ("" if self.confirmed else "_question")

    @property
    def code(self) -> float:
        return self.side * (1.0 if self.confirmed else 0.5)


#: A bar that is furthest out on some side: its number and how far out it is.
Mark = tuple[int, float]


class Reach:
    """For each side the bars that are further out than all later ones: the first
    of them from some bar on is the furthest since then.  What no later question
    can ask for is forgotten, so that the length doesn't grow with the series."""

    def __init__(self):
        self.left: dict[int, list[Mark]] = {1: [], -1: []}
        self.most = 64

    def push(self, i: int, high: float, low: float) -> None:
        for side, out in ((1, high), (-1, -low)):
            stack = self.left[side]
            while stack and stack[-1][1] < out:
                stack.pop()
            stack.append((i, out))

    def furthest(self, side: int, start: int) -> Mark | None:
        """The first bar from ``start`` on that is furthest out, up to now."""
        stack = self.left[side]
        at = bisect.bisect_left(stack, start, key=lambda m: m[0])
        return stack[at] if at < len(stack) else None

    def forget(self, asked: list[tuple[int, int]]) -> None:
        """Keep what questions (side, first bar) lead to: an answer's bar is where
        the next question about the other side begins, or the bar after it."""
        keep: dict[int, set[int]] = {1: set(), -1: set()}
        seen: set[tuple[int, int]] = set()
        for side, start in asked:
            while (m := self.furthest(side, start)) is not None and (side, m[0]) not in seen:
                seen.add((side, m[0]))
                keep[side].add(m[0])
                keep[-side].add(self.furthest(-side, m[0])[0])  # there is one: this bar is no further back than the last
                side, start = -side, m[0] + 1
        self.left = {side: [m for m in stack if m[0] in keep[side]] for side, stack in self.left.items()}
        self.most = max(64, 2 * (len(self.left[1]) + len(self.left[-1])))


@dataclass
class Structure:
    """What a reset forgets."""

    tail: list[Extreme] = field(default_factory=list)  # the last three extremes
    triples: dict = field(default_factory=lambda: {1: None, -1: None})  # the latest that held its ground before the last extreme
    counts: dict = field(default_factory=lambda: {1: 0, -1: 0})
    fixed: dict = field(default_factory=lambda: {1: None, -1: None})
    running: dict = field(default_factory=lambda: {1: None, -1: None})
    barred: dict = field(default_factory=lambda: {1: -1, -1: -1})
    exception: int = 1
    direction: int = 0
    status: int = 0
    trend: Trend = field(default_factory=Trend)

    def add(self, new: Extreme) -> None:
        """An extreme of the other side: the one before it is final now."""
        for side in (1, -1):
            self.triples[side] = self.triple(side) or self.triples[side]
        self.counts[new.side] += 1
        self.tail = [*self.tail[-2:], replace(new, after=self.counts[-new.side])]

    def triple(self, side: int) -> tuple[Extreme, Extreme] | None:
        """Points 2 and 3 of the last three extremes, if they keep their ground."""
        if len(self.tail) < 3:
            return None
        a, b, c = self.tail
        return (b, c) if c.side == -side and b.side == side and a.side == -side and side * (c.value - a.value) >= 0 else None


class Machine:
    """One series' machine.  ``step`` takes a bar and returns its state row.  Its
    memory is bounded: bars that can still become an extreme, the last few
    extremes, and the last ``lag`` bars."""

    def __init__(self, method: str = "cusum", q: float = 1.0, options: dict | None = None, lag: int = 0, reset_on_change: bool = False):
        self.method, self.q, self.lag, self.reset_on_change = method, q, lag, reset_on_change
        self.detector = kernels.make(method, q, **(options or {}))
        self.i = -1
        self.reach = Reach()
        self.bar: tuple = ()  # high, low of this bar
        self.recent: deque = deque(maxlen=max(lag, 0) + 2)  # ts, close
        self.waiting: list[tuple] = []  # (place, direction, source, score) not yet confirmed
        self.dated: set[int] = set()  # change places already reported by a segmentation
        self.change: tuple | None = None  # of the latest place
        self.confirmed_at: int | None = None
        self.s = Structure()
        self.before: dict | None = None
        self.moves = (0, 0.0, 0.0)  # count, mean, squares of close differences of the regime
        self.best: tuple | None = None  # (side, place of point 3) and the furthest price since

    def now(self, side: int) -> Mark:
        return self.i, self.bar[0] if side > 0 else -self.bar[1]

    def since(self, side: int, start: int) -> Mark:
        """The furthest bar from ``start``; this one where there is none, or where it
        is the series' first, which is how the indicator is defined."""
        m = self.reach.furthest(side, max(0, start))
        return m if m and m[0] else self.now(side)

    def then(self, i: int) -> tuple:
        """ts and close of one of the last bars."""
        return self.recent[i - self.i - 1]

    # -- changes -----------------------------------------------------------

    def changes(self, i: int, close: float) -> list[tuple]:
        """(place, direction, source, score) confirmed on this bar."""
        k = self.detector
        if isinstance(k, kernels.SegmentBeam):
            k.step(close)
            out = []
            for place in k.answer():
                if place not in self.dated and self.lag <= 0:
                    self.dated.add(place)
                    out.append((i, k.direction(place), k.source, NAN))
            return out
        x = close if k.on == "level" else close - self.then(i - 1)[1] if i else NAN
        if x == x and (event := k.step(x)):
            self.waiting.append((i, event[0], k.source, event[1]))
        ready = [e for e in self.waiting if i - e[0] >= self.lag]
        self.waiting = [e for e in self.waiting if i - e[0] < self.lag]
        return ready

    # -- extremes ----------------------------------------------------------

    def anchor(self, d: int) -> None:
        s = self.s
        if d and s.fixed[-d] is None:
            s.fixed[-d] = self.reach.furthest(-d, 0)
            s.running[d] = self.since(d, s.fixed[-d][0] + 1)

    def judge(self, d: int) -> int:
        """Exception and status: the direction, turned over while price runs
        against it."""
        s, was = self.s, self.s.direction
        if not d:
            return 0
        beyond = lambda side: s.fixed[side] is not None and self.now(side)[1] >= s.fixed[side][1]
        if s.exception < 0:
            if was * d == -1 or was and beyond(was):
                s.exception = 1
        elif was in (0, d) and beyond(-d):
            s.exception = -1
        return d * s.exception

    def push(self, side: int) -> None:
        if self.s.running[side] is None or self.now(side)[1] >= self.s.running[side][1]:
            self.s.running[side] = self.now(side)

    def fix(self, side: int) -> None:
        """Keep an alternating list: of one side's successive extremes the outer."""
        s = self.s
        at, out = s.fixed[side] = s.running[side]
        last = s.tail[-1] if s.tail else None
        if last is None or last.side != side and last.idx != at:
            s.add(Extreme(side, at, side * out))
        elif last.side == side and side * (side * out - last.value) >= 0:
            s.tail[-1] = replace(last, idx=at, value=side * out)

    def turn(self, status: int) -> bool:
        s, was, fixed = self.s, self.s.status, False
        if was:
            self.push(was)
            if status == -was:
                self.fix(was)
                fixed = True
                s.running[-was] = self.since(-was, s.fixed[was][0] + 1)
        elif status and s.running[status] is None:
            other = s.fixed[-status]
            s.running[status] = self.since(status, other[0] + 1 if other and other[0] else 0)
        if status:
            self.push(status)
        s.status = status
        return fixed

    def forget(self) -> None:
        """Bars that no later extreme or trend can begin at."""
        if len(self.reach.left[1]) + len(self.reach.left[-1]) <= self.reach.most:
            return
        s = self.s
        marks = [(side, m) for kept in (s.fixed, s.running) for side, m in kept.items()]
        asked = [(-side, m[0] + 1) for side, m in marks if m is not None]
        if self.reset_on_change or any(m is None for _, m in marks):
            asked += [(1, 0), (-1, 0)]
        thirds = [*s.tail, *[t[1] for t in s.triples.values() if t], *([s.trend.point3] if s.trend.side else [])]
        asked += [(-e.side, e.idx) for e in thirds] + [(-side, m[0]) for side, m in marks if m is not None]
        self.reach.forget(asked)

    # -- trend -------------------------------------------------------------

    def candidate(self, side: int) -> tuple[Extreme, Extreme] | None:
        """Points 2 and 3 of the latest triple that keeps its ground.  An earlier one
        would be barred as well."""
        for t in (self.s.triple(side), self.s.triples[side]):
            if t and t[1].idx > self.s.barred[side]:
                return t
        return None

    def follow(self, i: int) -> Trend:
        s, (high, low) = self.s, self.bar
        found = {side: self.candidate(side) for side in (1, -1)}
        stop, reach = {1: low, -1: high}, {1: high, -1: low}
        now, broken = s.trend, False
        if now.confirmed and now.side * (stop[now.side] - now.point3.value) <= 0:
            s.barred[now.side] = max(s.barred[now.side], now.point3.idx)
            now, broken = Trend(), True
        shaped = []
        for side, pair in found.items():
            if pair is None:
                continue
            p2, p3 = pair
            if i > p3.idx and side * (stop[side] - p3.value) <= 0:
                s.barred[side] = max(s.barred[side], p3.idx)
                continue
            gone = side * (reach[side] - p2.value) >= 0 and i > p3.idx and not broken
            shaped.append(Trend(side, gone, p2, p3, (side, p2, p3)))
        latest = max(shaped, key=lambda t: t.point3.idx, default=None)
        triggered = max((t for t in shaped if t.confirmed), key=lambda t: t.point3.idx, default=None)
        if now.confirmed:
            fresher = triggered is not None and triggered.side == now.side and triggered.point3.idx > now.point3.idx
            s.trend = triggered if fresher else replace(now, candidate=latest.candidate if latest else None)
        else:
            s.trend = triggered or latest or Trend()
        return s.trend

    def quality(self, i: int, t: Trend) -> tuple[float, float, float]:
        span = abs(t.point2.value - t.point3.value) if t.confirmed else 0.0
        if not span or t.point3.idx > i:
            return NAN, NAN, NAN
        key = (t.side, t.point3.idx)
        if self.best is None or self.best[0] != key:
            self.best = (key, self.reach.furthest(t.side, t.point3.idx)[1])
        else:
            self.best = (key, max(self.best[1], self.now(t.side)[1]))
        later = self.s.counts[t.side] - t.point3.after
        return abs(t.side * self.best[1] - t.point3.value) / span, float(max(2, 1 + later)), float(i - t.point3.idx)

    # -- a bar -------------------------------------------------------------

    def volatility(self, start: int, i: int, moved: bool) -> float:
        if moved:
            self.moves = (0, 0.0, 0.0)
        for j in range(start + 1 if moved else i, i + 1):
            if j > start:
                n, mean, squares = self.moves
                x = self.then(j)[1] - self.then(j - 1)[1]
                gap = x - mean
                self.moves = (n + 1, mean + gap / (n + 1), squares + gap * (x - mean - gap / (n + 1)))
        n, _, squares = self.moves
        return math.sqrt(max(squares, 0.0) / (n - 1)) if n > 1 else 0.0

    def step(self, ts, open_: float, high: float, low: float, close: float) -> dict:
        i = self.i = self.i + 1
        self.bar = (high, low)
        self.recent.append((ts, close))
        self.reach.push(i, high, low)
        new = self.changes(i, close)
        moved = bool(new)
        if new:
            self.confirmed_at = i
            for e in new:
                if self.change is None or e[0] >= self.change[0]:
                    self.change = e
            if self.reset_on_change:
                self.s = Structure()
        s = self.s
        start, d, source, score = self.change or (0, 0, None, NAN)
        self.anchor(d)
        status = self.judge(d)
        switched = i > 0 and status != s.status
        fixed = self.turn(status)
        t = self.follow(i)
        dynamic, movements, since3 = self.quality(i, t)
        shown = s.tail[-1] if fixed and s.tail else None
        price = lambda side, m: NAN if m is None else side * m[1]
        top, bottom = price(1, s.fixed[1]), price(-1, s.fixed[-1])
        width = top - bottom
        position = (close - bottom) / width if width == width and width != 0 else NAN
        last = new[-1] if new else None
        p2, p3 = (t.point2.value, t.point3.value) if t.side else (NAN, NAN)
        c2, c3 = (t.candidate[1], t.candidate[2]) if t.candidate else (None, None)
        leg = status or d
        was = self.before
        row = {
            "timestamp": ts, "Open": open_, "High": high, "Low": low, "Close": close, "detector_method": self.method, "detector_q": float(self.q),
            "cpd_direction_source": source, "cpd_direction_score": score, "cpd_confirm_event": bool(new),
            "cpd_confirmed_position": last[0] if last else None, "cpd_confirmed_timestamp": self.then(last[0])[0] if last else None,
            "cpd_confirmed_direction": last[1] if last else None, "cpd_confirmed_direction_source": last[2] if last else None, "cpd_confirmed_score": last[3] if last else NAN,
            "direction": d, "excep": s.exception, "status": status, "status_switch": switched, "new_extremum_confirmed": fixed,
            "confirmed_extremum_kind": KIND[shown.side] if shown else None, "confirmed_extremum_idx": shown.idx if shown else None,
            "confirmed_extremum_value": shown.value if shown else NAN, "confirmed_extremum_confirmed_at": ts if shown else None,
            "current_trend": t.name, "current_trend_code": t.code,
            "current_phase": phase_name(t.side, leg), "trend_candidate": "no_candidate" if not t.candidate else "uptrend_candidate" if t.candidate[0] > 0 else "downtrend_candidate",
            "trend_age": was["trend_age"] + 1 if was and was["current_trend"] == t.name else 0,
            "trend_dynamic": dynamic, "trend_lifetime_movements": movements, "trend_lifetime_bars_since_point3": since3,
            "position": position, "delta_position": position - was["position"] if was else NAN,
            "distance_to_high": close - top, "distance_to_low": close - bottom, "distance_to_point2": close - p2, "distance_to_point3": close - p3,
            "dist_point2_pct": (close - p2) / close if close else NAN, "dist_point3_pct": (close - p3) / close if close else NAN,
            "time_since_last_cpd": i - start if self.change else i + 1, "time_since_last_cpd_confirm": i + 1 if self.confirmed_at is None else i - self.confirmed_at,
            "regime_volatility": self.volatility(start, i, moved),
            "point2": p2, "point3": p3, "point2_idx": t.point2.idx if t.side else None, "point3_idx": t.point3.idx if t.side else None,
            "candidate_point2": c2.value if c2 else NAN, "candidate_point3": c3.value if c3 else NAN, "candidate_point2_idx": c2.idx if c2 else None, "candidate_point3_idx": c3.idx if c3 else None,
            "last_max": top, "last_min": bottom, "temp_max": price(1, s.running[1]), "temp_min": price(-1, s.running[-1]),
            "num_confirmed_extrema": s.counts[1] + s.counts[-1], "regime_start_idx": start,
        }
        s.direction = d
        self.before = {c: row[c] for c in ("current_trend", "trend_age", "position")}
        self.forget()
        return row


def phase_name(side: int, leg: int) -> str:
    if not side:
        return "no_phase"
    way = "up" if side > 0 else "down"
    return f"{way}_phase_unknown" if not leg else f"{way}_movement" if leg == side else f"{way}_correction"


#: Fields of a state row and their types.
STATE = (
    "timestamp timestamp, Open double, High double, Low double, Close double, detector_method string, detector_q double, cpd_direction_source string, cpd_direction_score double, cpd_confirm_event boolean, "
    "cpd_confirmed_position long, cpd_confirmed_timestamp timestamp, cpd_confirmed_direction int, cpd_confirmed_direction_source string, cpd_confirmed_score double, direction int, excep int, status int, status_switch boolean, "
    "new_extremum_confirmed boolean, confirmed_extremum_kind string, confirmed_extremum_idx long, confirmed_extremum_value double, confirmed_extremum_confirmed_at timestamp, current_trend string, current_trend_code double, "
    "current_phase string, trend_candidate string, trend_age long, trend_dynamic double, trend_lifetime_movements double, trend_lifetime_bars_since_point3 double, position double, delta_position double, distance_to_high double, "
    "distance_to_low double, distance_to_point2 double, distance_to_point3 double, dist_point2_pct double, dist_point3_pct double, time_since_last_cpd long, time_since_last_cpd_confirm long, regime_volatility double, point2 double, "
    "point3 double, point2_idx long, point3_idx long, candidate_point2 double, candidate_point3 double, candidate_point2_idx long, candidate_point3_idx long, last_max double, last_min double, temp_max double, temp_min double, "
    "num_confirmed_extrema long, regime_start_idx long"
)
FIELDS = [f.split()[0] for f in STATE.split(", ")]
TYPES = dict(f.split() for f in STATE.split(", "))
PANDAS = {"long": "Int64", "int": "Int32", "double": "float64", "boolean": "bool", "timestamp": "datetime64[ns]", "string": "object"}


def state_frame(rows: list[dict], symbol: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=FIELDS).astype({c: PANDAS[t] for c, t in TYPES.items()})
    doubles = [c for c, t in TYPES.items() if t == "double"]
    out[doubles] = out[doubles].replace([np.inf, -np.inf], np.nan)
    out.insert(0, "symbol", symbol)
    return out


def clean_bars(bars: DataFrame, log_price: bool = False) -> DataFrame:
    """symbol, ts, open, high, low, close: complete rows, of one ts the last
    (the largest ``input_order``, if there is one); logarithms on request, of
    rows with positive prices only."""
    price = ["open", "high", "low", "close"]
    rows = bars.filter(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in price))
    rank = Window.partitionBy("symbol", "ts").orderBy(*( [F.desc("input_order")] if "input_order" in bars.columns else [F.desc(c) for c in price]))
    rows = rows.withColumn("_r", F.row_number().over(rank)).filter("_r = 1").drop("_r")
    if log_price:
        rows = rows.filter(" AND ".join(f"{c} > 0" for c in price)).withColumns({c: F.ln(c) for c in price})
    return rows


def market_state(
    bars: DataFrame, method: str = "cusum", q: float = 1.0, options: dict | None = None, lag: int = 0, reset_on_change: bool = False
) -> DataFrame:
    """A state row per bar: ``symbol`` and the 57 fields.  One pass a series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        m = Machine(method, q, options, lag, reset_on_change)
        rows = [m.step(*r) for r in pdf[["ts", "open", "high", "low", "close"]].itertuples(index=False, name=None)]
        return nullable(state_frame(rows, pdf["symbol"].iloc[0]))

    out = spread(clean_bars(bars).select("symbol", "ts", "open", "high", "low", "close"), "symbol").groupBy("symbol").applyInPandas(run, "symbol string, " + STATE)
    return out


def nullable(df: pd.DataFrame) -> pd.DataFrame:
    """NaN stands for nothing: null in Spark."""
    doubles = df.select_dtypes("float64").columns
    return df.assign(**{c: df[c].astype("Float64") for c in doubles})


def core_vector(state: DataFrame) -> DataFrame:
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    close = F.when(F.col("Close") != 0, F.col("Close"))
    return state.select(
        "symbol", "timestamp", "current_trend", "current_phase", "position",
        finite(F.col("distance_to_point2") / close).alias("dist_point2_pct"), finite(F.col("distance_to_point3") / close).alias("dist_point3_pct"), "time_since_last_cpd",
    )


# -- structural shape -------------------------------------------------------

POINTS = "symbol string, ts timestamp, idx long, open double, high double, low double, close double, num_confirmed_extrema long, confirmed boolean, first_high boolean, h1 double, h1_idx long, h2 double, h2_idx long, l1 double, l1_idx long, l2 double, l2_idx long, e0_idx long, e3_idx long, median_gap double"
#: Columns of the shape table beside prices.
DIAGNOSTICS = [
    "direction", "excep", "status", "current_trend", "current_trend_code", "current_phase", "trend_candidate", "new_extremum_confirmed",
    "confirmed_extremum_kind", "confirmed_extremum_idx", "confirmed_extremum_value", "cpd_confirm_event", "time_since_last_cpd",
    "time_since_last_cpd_confirm"
]
FEATURES = [
    "starts_high", "high1", "high2", "low1", "low2", "high_change", "low_change", "expansion", "range_pos", "upper_break", "lower_break",
    "structure_dir", "range_pct", "last_width_pct", "move_age", "high_speed", "low_speed", "extrema_freq"
]


def shape_points(
    bars: DataFrame, method: str = "cusum", q: float = 1.0, options: dict | None = None, lag: int = 0, reset_on_change: bool = False
) -> DataFrame:
    """Per bar the last four alternating extremes known by then, with the state
    machine's diagnostics."""
    extra = ", ".join(f"{c} {TYPES[c]}" for c in DIAGNOSTICS)
    names = [f.split()[0] for f in POINTS.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        m = Machine(method, q, options, lag, reset_on_change)
        known: list[Extreme] = []
        rows, states = [], []
        for i, bar in enumerate(pdf[["ts", "open", "high", "low", "close"]].itertuples(index=False, name=None)):
            state = m.step(*bar)
            states.append(state)
            new = state["new_extremum_confirmed"] and state["confirmed_extremum_idx"] is not None
            if new:
                e = Extreme(
                    1 if state["confirmed_extremum_kind"] == "high" else -1, state["confirmed_extremum_idx"], state["confirmed_extremum_value"]
                )
                last = known[-1] if known else None
                if last is None or last.side != e.side:
                    known.append(e)
                elif last.idx != e.idx and e.side * (e.value - last.value) >= 0:
                    known[-1] = e
            four = known[-4:]
            points = [None] * 11
            if len(four) == 4 and sum(e.side for e in four) == 0:
                (h1, h2), (l1, l2) = (sorted((e for e in four if e.side == side), key=lambda e: e.idx) for side in (1, -1))
                gaps = np.diff([e.idx for e in known[-64:]])
                gaps = gaps if (gaps > 0).sum() >= 20 else np.diff([e.idx for e in known])
                gaps = gaps[gaps > 0][-20:]
                points = [four[0].side > 0, h1.value, h1.idx, h2.value, h2.idx, l1.value, l1.idx, l2.value, l2.idx, four[0].idx, four[3].idx]
                points.append(float(np.median(gaps)) if len(gaps) else None)
            else:
                points.append(None)
            rows.append((pdf["symbol"].iloc[0], bar[0], i, *bar[1:], len(known), bool(new), *points))
        out = pd.DataFrame(rows, columns=names)
        long = [c for c in names if c.endswith("_idx")]
        out = out.astype({c: "Int64" for c in long} | {c: "float64" for c in ("h1", "h2", "l1", "l2", "median_gap")} | {"first_high": "boolean"})
        more = state_frame(states, "")[DIAGNOSTICS]
        return nullable(pd.concat([out, more], axis=1))

    return spread(clean_bars(bars).select("symbol", "ts", "open", "high", "low", "close"), "symbol").groupBy("symbol").applyInPandas(run, f"{POINTS}, {extra}")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) >= 1e-12, a / b)


def with_features(points: DataFrame) -> DataFrame:
    """The 18 shape features as expressions over the four points."""
    c = F.col
    has = c("h1").isNotNull()
    high_gap, low_gap = c("h2_idx") - c("h1_idx"), c("l2_idx") - c("l1_idx")
    dh, dl = c("h2") - c("h1"), c("l2") - c("l1")
    top, bottom = F.greatest("h1", "h2"), F.least("l1", "l2")
    upper = c("h1") + _ratio(dh, high_gap) * (c("idx") - c("h1_idx"))
    lower = c("l1") + _ratio(dl, low_gap) * (c("idx") - c("l1_idx"))
    flag = lambda x: x.cast("double")
    return points.withColumns({
        "has_structural_window": has, "starts_high": flag(c("first_high")), "high1": c("h1"), "high2": c("h2"), "low1": c("l1"), "low2": c("l2"),
        "high_change": dh, "low_change": dl, "expansion": dh - dl, "range_pos": _ratio(c("close") - bottom, top - bottom),
        "upper_break": flag(c("close") > upper), "lower_break": flag(c("close") < lower), "structure_dir": dh + dl, "range_pct": F.when(has, top - bottom), "last_width_pct": c("h2") - c("l2"),
        "move_age": _ratio(c("idx") - c("e3_idx"), c("median_gap")), "high_speed": _ratio(F.abs(dh), high_gap), "low_speed": _ratio(F.abs(dl), low_gap), "extrema_freq": _ratio(F.lit(4.0), c("e3_idx") - c("e0_idx")),
    })


def with_lags(rows: DataFrame, n_lags: int, decay: float | None = None) -> DataFrame:
    """Add ``lag<k>_<feature>``: the features of the k-th confirmed window before
    the latest one (rows with ``confirmed`` and ``has_structural_window``), times
    decay ** k."""
    w = Window.partitionBy("symbol").orderBy("ts")
    snap = F.when(F.col("confirmed") & F.col("has_structural_window"), F.struct(*FEATURES))
    marks = rows.withColumn("_snap", snap).withColumn("_n", F.count("_snap").over(w))
    # the k-th snapshot before the latest: lag among snapshot rows, carried forward to bars
    among = Window.partitionBy("symbol", F.col("_snap").isNotNull()).orderBy("ts")
    for k in range(1, n_lags + 1):
        held = F.when(F.col("_snap").isNotNull(), F.lag("_snap", k).over(among))
        marks = marks.withColumn(f"_held{k}", held)
        marks = marks.withColumn(f"_lag{k}", F.last(f"_held{k}", True).over(w))
        weight = 1.0 if decay is None else float(decay) ** k
        marks = marks.withColumns({f"lag{k}_{f}": F.when(F.col("_n") > k, F.col(f"_lag{k}.{f}") * weight) for f in FEATURES})
    return marks.drop("_snap", "_n", *[f"_{x}{k}" for k in range(1, n_lags + 1) for x in ("held", "lag")])


def shape_state(bars: DataFrame, n_lags: int = 0, decay: float | None = None, **machine) -> DataFrame:
    """A shape row per bar: prices, 18 features, diagnostics and, for each lag,
    the features of that many confirmed windows ago, weighted by decay ** lag."""
    rows = with_features(shape_points(bars, **machine))
    if n_lags:
        rows = with_lags(rows, n_lags, decay)
    return rows.drop("first_high", "h1", "h2", "l1", "l2", "h1_idx", "h2_idx", "l1_idx", "l2_idx", "e0_idx", "e3_idx", "median_gap", "confirmed")
