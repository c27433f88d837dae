"""A stream in pieces gives what the table gives, with a state that doesn't grow."""

import datetime as dt
import pickle

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import detect, kernels, sampling, structure
from tidemark.streaming import live
from tidemark.streaming.live import stream_detect, stream_market_state, stream_samples

T0 = dt.datetime(2020, 1, 1)
SERIES = "symbol string, ts timestamp, value double"


def run(spark, tmp_path, frame, schema, make, name, pieces=3):
    src = str(tmp_path / "src")
    for piece in np.array_split(np.arange(len(frame)), pieces):
        spark.createDataFrame(frame.iloc[piece], schema).coalesce(1).write.mode("append").parquet(src)
    q = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def walk(n, seed=0):
    x = np.cumsum(np.random.default_rng(seed).normal(0, 1, n))
    return pd.DataFrame({"symbol": (["a", "b", "a"] * n)[:n], "ts": [T0 + dt.timedelta(days=i) for i in range(n)], "value": x})


def test_detector_stream_equals_batch(spark, tmp_path):
    frame = walk(90)
    got = run(spark, tmp_path, frame, SERIES, lambda s: stream_detect(s, "cusum", 50.0), "live_events")
    want = detect.detect(spark.createDataFrame(frame, SERIES), "cusum", 50.0)
    rows = lambda d: sorted((r.symbol, r.ts, r.idx, r.direction) for r in d.collect())
    assert rows(got) == rows(want) != []


@pytest.mark.parametrize("machine", [{"q": 50.0}, {"q": 50.0, "lag": 2, "reset_on_change": True}])
def test_state_stream_equals_batch(spark, tmp_path, machine):
    c = 100 + np.cumsum(np.random.default_rng(1).normal(0, 1, 60))
    frame = pd.DataFrame({"symbol": "a", "ts": [T0 + dt.timedelta(days=i) for i in range(60)], "open": c, "high": c + 1, "low": c - 1, "close": c})
    schema = "symbol string, ts timestamp, open double, high double, low double, close double"
    got = run(spark, tmp_path, frame, schema, lambda s: stream_market_state(s, **machine), f"live_state_{len(machine)}")
    want = structure.market_state(spark.createDataFrame(frame, schema), **machine)
    rows = lambda d: sorted(tuple(str(x) for x in r) for r in d.select(want.columns).collect())
    assert rows(got) == rows(want)


def standing(rows):
    """What is emitted and not taken back."""
    out = set()
    for r in rows:
        item = (r.symbol, r.change_ts, r.direction)
        assert (item in out) == r.retracted
        out ^= {item}
    return out


def test_segmentation_stream_equals_batch_after_each_batch():
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(m, 1, 30) for m in (0, 5, 1, 1, 8)])
    stamps = pd.to_datetime([T0 + dt.timedelta(days=i) for i in range(len(values))]).to_numpy()
    feed, emitted = live.SegmentFeed("recursive_param_seg", 1.0, {}), []
    for at in range(0, len(values), 7):
        end = min(at + 7, len(values))
        emitted += list(feed.take("a", pd.DataFrame({"ts": stamps[at:end], "value": values[at:end]})).itertuples())
        want = {("a", pd.Timestamp(e[5]), e[2]) for e in detect.series_events(stamps[:end], values[:end], "recursive_param_seg", 1.0, {})}
        assert standing(emitted) == want
    assert any(r.retracted for r in emitted) and want


def test_segmentation_stream(spark, tmp_path):
    frame = walk(120, 5)
    got = run(spark, tmp_path, frame, SERIES, lambda s: stream_detect(s, "recursive_param_seg", 1.0), "live_segments", pieces=4)
    want = detect.detect(spark.createDataFrame(frame, SERIES), "recursive_param_seg", 1.0)
    order = sorted(got.collect(), key=lambda r: (r.symbol, r.ts, not r.retracted))
    assert standing(order) == {(r.symbol, r.change_ts, r.direction) for r in want.collect()} != set()


def test_sample_stream_equals_batch(spark, tmp_path):
    frame = walk(120, 2)
    frame["x"], frame["thr"] = np.random.default_rng(4).normal(0, 1, 120), 0.5
    frame = frame[["symbol", "ts", "x", "thr"]]
    schema = "symbol string, ts timestamp, x double, thr double"
    got = run(spark, tmp_path, frame, schema, lambda s: stream_samples(s, "cum", b2b=2), "live_samples")
    want = sampling.sample_events(spark.createDataFrame(frame, schema), "cum", F.col("thr"), b2b=2)
    rows = lambda d: sorted((r.symbol, r.ts, r.method) for r in d.collect())
    assert rows(got) == rows(want) != []


def test_expiry(spark, tmp_path):
    got = run(spark, tmp_path, walk(30), SERIES, lambda s: stream_detect(s, "cusum", 50.0, expire_ms=3_600_000), "live_expiry")
    want = detect.detect(spark.createDataFrame(walk(30), SERIES), "cusum", 50.0)
    assert sorted((r.symbol, r.ts) for r in got.collect()) == sorted((r.symbol, r.ts) for r in want.collect())


@pytest.mark.parametrize("reset", [False, True])
def test_state_is_bounded(reset):
    """A hundred thousand bars, drifting and trendless, of which few can still matter."""
    rng = np.random.default_rng(1)
    for drift in (0.0, 0.5):
        m, sizes = structure.Machine("cusum", 50.0, None, 0, reset), []
        for i, c in enumerate((100 + np.cumsum(rng.normal(drift, 1, 50_000))).tolist()):
            m.step(i, c, c + 1, c - 1, c)
            if i % 5_000 == 4_999:
                sizes.append(len(pickle.dumps(m)))
        assert max(sizes) < 4_000 and max(sizes[5:]) < 2 * max(sizes[:5])


class Whole:
    """The furthest bars by looking at all of them."""

    def __init__(self):
        self.out = {1: [], -1: []}

    def push(self, i, high, low):
        self.out[1].append(high)
        self.out[-1].append(-low)

    left, most = {1: [], -1: []}, 1

    def furthest(self, side, start):
        out = self.out[side]
        at = max(range(start, len(out)), key=lambda j: (out[j], -j), default=None)
        return None if at is None else (at, out[at])


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize(("method", "q", "lag", "reset"), [("cusum", 50.0, 0, False), ("cusum", 20.0, 3, True), ("sprt", 0.1, 0, True), ("shewhart", 0.05, 2, False)])
def test_forgotten_bars_are_not_missed(seed, method, q, lag, reset):
    rng = np.random.default_rng(seed)
    c = 100 + np.cumsum(rng.normal(0, 1, 300))
    c = np.round(c) if seed % 2 else c
    a, b = structure.Machine(method, q, None, lag, reset), structure.Machine(method, q, None, lag, reset)
    b.reach = Whole()
    for i, (x, up, down) in enumerate(zip(c.tolist(), rng.integers(0, 3, 300).tolist(), rng.integers(0, 3, 300).tolist(), strict=True)):
        a.reach.most = 0  # forget at every bar
        assert str(a.step(i, x, x + up, x - down, x)) == str(b.step(i, x, x + up, x - down, x))


def test_directions_of_the_beam():
    x = np.concatenate([np.random.default_rng(2).normal(m, 1, 25) for m in (0, 4, -3)])
    k = kernels.make("recursive_param_seg", 1.0)
    for i, v in enumerate(x.tolist()):
        k.step(v)
        for p in k.answer():
            assert k.direction(p) == kernels.direction_around(x[: i + 1], p, k.min_seg_len)
