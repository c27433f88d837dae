"""The same kernels on streams: rows in, events or state rows out, with a state per
symbol whose size doesn't grow with the series.

A symbol's kernel lives in a value state of the RocksDB store (made the session's
provider where another one is set by default); what the state machine has to
remember of past bars is told in ``operators.structure``.  With ``expire_ms`` a
symbol that is silent for so long (processing time) is forgotten, and begins anew
if it comes back.

Late rows: a row whose ts is not after the symbol's last one is dropped, since
every state is a function of the rows in order.  Rows without a value are passed
over.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import kernels, sampling
from tidemark.operators.structure import STATE, Machine, nullable, state_frame

LIVE_EVENTS = (
    "symbol string, ts timestamp, idx long, direction int, direction_source string, score double, change_ts timestamp, retracted boolean"
)
EVENT_COLUMNS = [f.split()[0] for f in LIVE_EVENTS.split(", ")]
LIVE_SAMPLES = "symbol string, ts timestamp, method string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Feed:
    """What is kept of one symbol."""

    last_ts = None
    i = -1

    def fresh(self, pdf: pd.DataFrame) -> Iterator[tuple]:
        """Rows after the last one, in order; of equal ts the first."""
        for row in pdf.sort_values("ts", kind="stable").itertuples(index=False, name=None):
            if self.last_ts is None or row[0] > self.last_ts:
                self.last_ts = row[0]
                self.i += 1
                yield row

    def take(self, symbol: str, pdf: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError


class DetectFeed(Feed):
    columns = ["ts", "value"]

    def __init__(self, method: str, q: float, options: dict):
        self.kernel, self.last = kernels.make(method, q, **options), None

    def take(self, symbol, pdf):
        k, rows = self.kernel, []
        for ts, value in self.fresh(pdf.dropna(subset=["value"])):
            x = value if k.on == "level" else math.nan if self.last is None else value - self.last
            self.last = value
            if math.isfinite(x) and (e := k.step(float(x))):
                rows.append((symbol, ts, self.i, e[0], k.source, e[1], None, False))
        return event_frame(rows)


class SegmentFeed(Feed):
    """A segmentation looks back: what a batch of rows changes in the set of
    changes is emitted, and what no longer holds is taken back."""

    columns = ["ts", "value"]

    def __init__(self, method: str, q: float, options: dict):
        self.kernel = kernels.make(method, q, **options)
        self.stamps: dict[int, object] = {}  # ts of the beam's change places
        self.told: dict[int, tuple] = {}  # place: ts and direction as emitted last

    def take(self, symbol, pdf):
        k = self.kernel
        for ts, value in self.fresh(pdf.dropna(subset=["value"])):
            k.step(float(value))
            if self.i in k.around:
                self.stamps[self.i] = ts
            self.stamps = {p: t for p, t in self.stamps.items() if p in k.around}
        now = {p: (self.stamps[p], k.direction(p)) for p in k.answer()}
        gone = [(symbol, self.last_ts, self.i, told[1], k.source, None, told[0], True) for p, told in self.told.items() if now.get(p) != told]
        new = [(symbol, self.last_ts, self.i, found[1], k.source, None, found[0], False) for p, found in now.items() if self.told.get(p) != found]
        self.told = now
        return event_frame(gone + new)


class SampleFeed(Feed):
    columns = ["ts", "x", "thr"]

    def __init__(self, method: str, b2b: int, options: dict):
        self.sampler, self.method, self.b2b, self.run, self.limit = sampling.SAMPLERS[method](**options), method, b2b, 0, math.inf

    def take(self, symbol, pdf):
        rows, s = [], self.sampler
        for ts, x, limit in self.fresh(pdf):
            self.limit = float(limit) if limit is not None and math.isfinite(limit) else self.limit
            if x is None or not math.isfinite(x) or (stat := s.stat(float(x))) is None:
                continue
            if not stat > max(0.0, self.limit):
                self.run = 0
                s.below()
                continue
            self.run += 1
            if self.run >= self.b2b:
                self.run = 0
                s.fired(float(x))
                rows.append((symbol, ts, self.method))
        return pd.DataFrame(rows, columns=["symbol", "ts", "method"]).astype({"ts": "datetime64[ns]"})


class StateFeed(Feed):
    columns = ["ts", "open", "high", "low", "close"]

    def __init__(self, machine: dict):
        self.machine = Machine(**machine)

    def take(self, symbol, pdf):
        return nullable(state_frame([self.machine.step(*bar) for bar in self.fresh(pdf.dropna())], symbol))


def event_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=EVENT_COLUMNS).astype({"ts": "datetime64[ns]", "score": float, "change_ts": "datetime64[ns]", "retracted": bool})


class PerSymbol(StatefulProcessor):
    """A feed per symbol in a value state, and a timer that forgets it."""

    def __init__(self, start: Callable[[], Feed], columns: list[str], expire_ms: int | None):
        self.start, self.columns, self.expire_ms = start, columns, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("feed", "data binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        feed = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else self.start()
        out = feed.take(key[0], pd.concat([pdf[self.columns] for pdf in rows]))
        self.state.update((pickle.dumps(feed),))
        if self.expire_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.expire_ms)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def per_symbol(stream: DataFrame, start: Callable[[], Feed], columns: list[str], schema: str, expire_ms: int | None) -> DataFrame:
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in conf.get(key):
        conf.set(key, ROCKS)
    return stream.select("symbol", *columns).groupBy("symbol").transformWithStateInPandas(
        PerSymbol(start, columns, expire_ms), schema, "Append", "None" if expire_ms is None else "ProcessingTime"
    )


def stream_detect(stream: DataFrame, method: str, q: float = 1.0, expire_ms: int | None = None, **options) -> DataFrame:
    """Events of a stream of symbol, ts, value, as ``operators.detect.detect``
    finds them in a table.  A segmentation's changes are dated (``change_ts``) and may be
    retracted; those emitted and not retracted are the table's after each batch.
    Wild binary segmentation needs the whole series."""
    kernel = kernels.make(method, q, **options)
    feed = SegmentFeed if isinstance(kernel, kernels.SegmentBeam) else DetectFeed
    return per_symbol(stream, lambda: feed(method, q, options), feed.columns, LIVE_EVENTS, expire_ms)


def stream_samples(stream: DataFrame, method: str, b2b: int = 1, expire_ms: int | None = None, **options) -> DataFrame:
    """Sampled events of a stream of symbol, ts, x, thr.  Gaps of the threshold are
    filled forward only: before its first value nothing fires."""
    if method not in sampling.SAMPLERS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(sampling.SAMPLERS)}")
    return per_symbol(stream, lambda: SampleFeed(method, b2b, options), SampleFeed.columns, LIVE_SAMPLES, expire_ms)


def stream_market_state(stream: DataFrame, expire_ms: int | None = None, **machine) -> DataFrame:
    """A state row per bar of a stream of symbol, ts, open, high, low, close."""
    return per_symbol(stream, lambda: StateFeed(machine), StateFeed.columns, "symbol string, " + STATE, expire_ms)
