"""Folds over very long series: one series is the work of many tasks.

A fold's state after a row is a function of the state before it, which seems to
leave one task per series.  But sums that are held above nought, and begin anew at
an event, forget where they came from: two runs over the same rows from different
states agree from the first row on at which both are at nought or fire.  So

1. series are cut into blocks, and every block is run from a guess of its state
   (nothing gathered yet; running means from the sums of the blocks before it);
2. a block whose guess isn't what the block before it came out with is run again
   from that, in rounds, until all agree.  Running means are no part of what must
   agree: every run of a block takes them from the sums.

The steps are the kernels' own, so the events are those of a single pass, whatever
the blocks; only the rounds (two or three, as a rule) depend on how soon runs agree.
At worst, where nothing is ever forgotten, there are as many rounds as blocks.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import kernels, sampling
from tidemark.plans.order import halo_blocks
from tidemark.plans.shared import checkpointed

EVENT = "ts timestamp, idx long, direction int, score double"


class DetectFold:
    """A detector that forgets: value is a level, fed by differences."""

    def __init__(self, method: str, q: float, options: dict):
        self.kernel = kernels.make(method, q, **options)

    def carried(self) -> bytes:
        return pickle.dumps(self.kernel)

    def resume(self, carried: bytes) -> None:
        self.kernel = pickle.loads(carried)

    def feed(self, pdf: pd.DataFrame) -> list[tuple]:
        out, last = [], None
        for ts, i, own, value in zip(pdf["ts"], pdf["_i"].tolist(), pdf["_own"].tolist(), pdf["x"].tolist(), strict=True):
            x, last = math.nan if last is None else value - last, value
            if own and math.isfinite(x) and (e := self.kernel.step(x)):
                out.append((ts, i, e[0], e[1] if math.isfinite(e[1]) else None))
        return out


class SampleFold:
    """A sampler: x against thr."""

    def __init__(self, method: str, b2b: int, options: dict, n: int = 0, total: float = 0.0):
        self.sampler, self.b2b, self.run = sampling.SAMPLERS[method](**options), b2b, 0
        if isinstance(self.sampler, sampling.PageHinkley) and n:
            self.sampler.n, self.sampler.mean = n, total / n

    def carried(self) -> bytes:
        return pickle.dumps((self.run, self.sampler.up, self.sampler.down))

    def resume(self, carried: bytes) -> None:
        self.run, self.sampler.up, self.sampler.down = pickle.loads(carried)

    def feed(self, pdf: pd.DataFrame) -> list[tuple]:
        out, s = [], self.sampler
        for ts, i, own, x, limit in zip(pdf["ts"], pdf["_i"].tolist(), pdf["_own"].tolist(), pdf["x"].tolist(), pdf["thr"].tolist(), strict=True):
            if not own or (stat := s.stat(x)) is None:
                continue
            if not stat > limit:
                self.run = 0
                s.below()
                continue
            self.run += 1
            if self.run >= self.b2b:
                self.run = 0
                s.fired(x)
                out.append((ts, i, 0, stat))
        return out


def fold(rows: DataFrame, start: Callable[[int, float], object], size: int, look_back: int = 0) -> tuple[DataFrame, int]:
    """(symbol, ts, idx, direction, score) of a fold over symbol, ts, x (and thr), and
    the rounds it took.  ``start``: a state, given how many rows there are before it
    and their sum; ``carried`` is what it hands to the next block."""
    rows = checkpointed(halo_blocks(rows, look_back, size=size))
    sums = rows.filter("_own").groupBy("symbol", "_block").agg(F.count("*").alias("n"), F.sum("x").alias("s"))
    earlier = Window.partitionBy("symbol").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    seeds = sums.select("symbol", "_block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("n", "s")])
    schema = f"symbol string, _block long, n long, s double, before binary, after binary, events array<struct<{EVENT.replace(' ', ':').replace(',:', ',')}>>"

    def run(pdf: pd.DataFrame, n: int, s: float, given: bytes | None = None) -> pd.DataFrame:
        state = start(n, s)
        if given is not None:
            state.resume(given)
        before = state.carried()
        pdf = pdf.sort_values("_i")
        events = [dict(zip(("ts", "idx", "direction", "score"), e, strict=True)) for e in state.feed(pdf)]
        return pd.DataFrame({
            "symbol": [pdf["symbol"].iloc[0]], "_block": [int(pdf["_block"].iloc[0])], "n": [n], "s": [s], "before": [before], "after": [state.carried()], "events": [events]
        })

    def guess(pdf: pd.DataFrame, seed: pd.DataFrame) -> pd.DataFrame:
        return run(pdf, int(seed["n"].iloc[0]), float(seed["s"].iloc[0]))

    def again(pdf: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        return run(pdf, int(given["n"].iloc[0]), float(given["s"].iloc[0]), bytes(given["given"].iloc[0]))

    keys = ["symbol", "_block"]
    done = checkpointed(rows.groupBy(*keys).cogroup(seeds.groupBy(*keys)).applyInPandas(guess, schema))
    rounds = 1
    while True:
        came = done.select("symbol", (F.col("_block") + 1).alias("_block"), F.col("after").alias("given"))
        changed = checkpointed(done.select(*keys, "n", "s", "before").join(came, keys).filter("before <> given").select(*keys, "n", "s", "given"))
        if changed.isEmpty():
            break
        rounds += 1
        redone = rows.join(changed.select(*keys), keys, "left_semi").groupBy(*keys).cogroup(changed.groupBy(*keys)).applyInPandas(again, schema)
        done = checkpointed(done.join(changed.select(*keys), keys, "left_anti").unionByName(redone))
    return done.select("symbol", F.explode("events").alias("e")).select("symbol", "e.*"), rounds


def detect_long(series: DataFrame, method: str = "cusum", q: float = 1.0, size: int = 1 << 17, **options) -> DataFrame:
    """``detect`` for a detector that forgets (cusum), in blocks of ``size`` rows."""
    if method != "cusum":
        raise ValueError("only cusum forgets where it came from; others keep running moments")
    rows = series.filter("value IS NOT NULL AND NOT isnan(value)").select("symbol", "ts", F.col("value").cast("double").alias("x"))
    return fold(rows, lambda n, s: DetectFold(method, q, options), size, look_back=1)[0]


def sample_long(dif: DataFrame, method: str, threshold: Column | float, b2b: int = 1, size: int = 1 << 17, **options) -> DataFrame:
    """symbol, ts, method as ``sample_events`` gives them, for samplers that forget (cum,
    page_hinkley), in blocks of ``size`` rows."""
    if method not in ("cum", "page_hinkley"):
        raise ValueError("cum and page_hinkley forget where they came from; others keep windows or moments")
    rows = sampling.aligned_threshold(dif, threshold)
    return fold(rows, lambda n, s: SampleFold(method, b2b, options, n, s), size)[0].select("symbol", "ts", F.lit(method).alias("method"))
