import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate, sampling, structure, vector
from tidemark.plans import jobs

T0 = dt.datetime(2018, 1, 1)


def frame(n=420, symbols=("a", "b")):
    out = []
    for k, s in enumerate(symbols):
        g = np.random.default_rng(k)
        c = 100 * np.exp(np.cumsum(g.normal(0, 0.02, n)))
        out.append(pd.DataFrame({"symbol": s, "ts": [T0 + dt.timedelta(days=i) for i in range(n)], "open": c, "high": c * 1.01, "low": c * 0.99, "close": c}))
    return pd.concat(out)


def test_state_validation_and_swings(spark, tmp_path):
    prices, out = spark.createDataFrame(frame()), str(tmp_path)
    scored = jobs.state_job(spark, prices, out, start="2018-02-01", log_price=True, min_periods=50, q=1.0)
    assert scored.count() > 700 and scored.agg(F.min("ts")).first()[0] >= dt.datetime(2018, 2, 1)
    assert spark.read.parquet(f"{out}/correlations").count() == 100 and spark.read.parquet(f"{out}/summary").count() == 10
    jobs.validation_job(spark, scored, out, close_is_log=True, per_group=2, nrep=5, horizons=(5,), max_points=60)
    assert spark.read.parquet(f"{out}/explosive_by_state").count() > 5 and spark.read.parquet(f"{out}/lowess_index").count() == 16
    jobs.swings_job(spark, prices, out, 3, 10, 2, q=1.0)
    assert spark.read.parquet(f"{out}/eigenvalues").count() == 4


def test_sampling_job_and_command_line(spark, tmp_path):
    g = np.random.default_rng(0)
    ticks = pd.DataFrame({"time": [T0 + dt.timedelta(minutes=i) for i in range(400)], "p": np.cumsum(g.normal(size=400))})
    spark.createDataFrame(ticks).write.parquet(str(tmp_path / "t"))
    jobs.main(["sampling", "--data", str(tmp_path / "t"), "--out", str(tmp_path / "o"), "--target", "20", "--methods", "swt", "cum"])
    tuned = spark.read.parquet(str(tmp_path / "o/tuned")).collect()
    assert {r.method for r in tuned} == {"swt", "cum"} and all(abs(r.error) <= 3 for r in tuned)
    assert spark.read.parquet(str(tmp_path / "o/jaccard")).count() == 4


def test_plot_frames_and_level_matching(spark):
    bars = spark.createDataFrame(frame(200, ("a",)))
    state = structure.market_state(bars, q=50.0)
    e = evaluate.extremes_frame(state)
    assert e.count() == e.select("kind", "idx").distinct().count() > 3 and evaluate.state_bands(state).count() > 1
    spans = bars.groupBy("symbol").agg((F.min("ts") + F.expr("INTERVAL 60 DAYS")).alias("start"), F.max("ts").alias("end"))
    steps = evaluate.step_levels(e, spans).orderBy("kind", "ts").toPandas()
    for kind, g in steps.groupby("kind"):
        known = [(r.ts, r.price) for r in e.filter(F.col("kind") == kind).orderBy("ts").collect()]
        start, end = T0 + dt.timedelta(days=60), T0 + dt.timedelta(days=199)
        want = [(max(t, start), p) for i, (t, p) in enumerate(known) if t >= start or i + 1 == len(known) or known[i + 1][0] >= start]
        want += [(end, want[-1][1])] if want[-1][0] < end else []
        assert list(zip(g["ts"], g["price"], strict=True)) == want
    assert evaluate.step_levels(e.filter("false"), spans).count() == 0


def test_samplers_on_numbers_as_they_come(spark):
    g = np.random.default_rng(5)
    x = np.where(g.random(400) < 0.05, np.nan, g.normal(0, 1, 400))
    limit = np.where(g.random(400) < 0.1, np.nan, g.choice([1.5, 2.5, -1.0], 400, p=[0.6, 0.38, 0.02]))
    up = down = run = 0
    want = []
    for i, (v, top) in enumerate(zip(x.tolist(), limit.tolist(), strict=True)):
        up, down = (0.0, 0.0) if v != v else (max(0.0, up + v), max(0.0, down - v))
        run = run + 1 if max(up, down) > top else 0
        if run == 2:
            want.append(i)
            up = down = run = 0
    assert sampling.raw_positions("cum", x, limit, 2) == want != []
    clean = np.nan_to_num(x)
    assert sampling.raw_positions("swt", clean, np.full(400, 1.5), 2) == sampling.sample_positions("swt", clean, np.full(400, 1.5), 2) != []
    gap = clean.copy()
    gap[100] = np.nan
    assert max(sampling.raw_positions("swt", gap, np.full(400, 1.0))) < 100 and sampling.raw_positions("swt", clean[:10], np.zeros(10)) == []
    with pytest.raises(ValueError):
        sampling.raw_positions("glr", x, limit)
    rows = [("a", T0 + dt.timedelta(days=i), None if v != v else v) for i, v in enumerate(x.tolist())]
    got = sampling.raw_events(spark.createDataFrame(rows, "symbol string, ts timestamp, x double"), "cum", 2.5).orderBy("ts").collect()
    assert [(r.ts - T0).days for r in got] == sampling.raw_positions("cum", x, np.full(400, 2.5))


def test_points_matched_to_bars(spark):
    bars = frame(200, ("a",)).assign(n=range(200))
    flat = bars.copy()
    flat.loc[flat["n"].isin([50, 60]), ["open", "high", "low", "close"]] = [100.0, 123.0, 99.0, 101.0]  # one price at two bars
    df = spark.createDataFrame(flat.drop(columns="n"))
    t = lambda i: T0 + dt.timedelta(days=i)
    low = float(flat["low"].iloc[70])
    rows = [("a", t(150), 123.0, 123.0, low, 99.0), ("a", t(55), 123.0, 123.0, low, 101.0), ("a", t(199), 123.0, None, -5.0, 0.5), ("a", t(58), 123.0 * (1 + 9e-7), 123.0 * (1 + 2e-6), 100.0, 99.0)]
    asks = spark.createDataFrame(rows, "symbol string, ts timestamp, high1 double, high2 double, low1 double, low2 double")
    got = {(r.ts, r.label): r.idx for r in evaluate.match_points(asks, df, lookback=130).collect()}
    # a bar serves one level only: 99 is the low of both bars, which the highs have taken
    assert [got[t(150), c] for c in ("high1", "high2", "low1", "low2")] == [50, 60, 70, None]
    # bars after the time do not count; 101 is no low, but a close of a bar that is taken
    assert [got[t(55), c] for c in ("high1", "high2", "low1", "low2")] == [50, None, None, None]
    assert all(got[t(199), c] is None for c in ("high1", "high2", "low1", "low2"))  # out of the look-back
    assert [got[t(58), c] for c in ("high1", "high2", "low1", "low2")] == [50, None, None, None]
    assert len(got) == 16


def test_points_up_to_a_time_and_examples(spark):
    bars = spark.createDataFrame(frame(300))
    points = structure.shape_points(bars, q=5.0)
    rows = {(r.symbol, r.ts): r for r in points.collect()}
    asks = spark.createDataFrame([("a", T0), ("a", T0 + dt.timedelta(days=250, hours=5)), ("b", T0 + dt.timedelta(days=299))], "symbol string, ts timestamp")
    got = {(r.symbol, r.ts, r.label): (r.idx, r.level, r.kind) for r in evaluate.structure_points(points, asks).collect()}
    assert not any(k[1] == T0 for k in got)
    for symbol, ask, at in (("a", T0 + dt.timedelta(days=250, hours=5), 250), ("b", T0 + dt.timedelta(days=299), 299)):
        r = rows[symbol, T0 + dt.timedelta(days=at)]
        assert r.h1 is not None and got[symbol, ask, "high1"] == (r.h1_idx, r.h1, "high") and got[symbol, ask, "low2"] == (r.l2_idx, r.l2, "low")
    shape = structure.shape_state(bars, q=5.0)
    vectors = vector.state_vector(shape)
    some = evaluate.examples(vectors, shape, 7).collect()
    assert len(some) == 7 and all(None not in (r.high1, r.low2) for r in some)
    assert {(r.symbol, r.ts) for r in some} == {(r.symbol, r.ts) for r in evaluate.examples(vectors.drop("high1", "low1").repartition(7), shape, 7).collect()}


def test_commands_of_the_tests_and_diagnostics(spark, tmp_path):
    prices, out = frame(), str(tmp_path)
    spark.createDataFrame(prices.rename(columns={"ts": "date"})).write.parquet(f"{out}/prices.parquet")
    jobs.main(["state", "--input", f"{out}/prices.parquet", "--out", f"{out}/s", "--score-min-periods", "50", "--score-lower", "0.1", "--clip-upper", "0.9"])
    jobs.main(["state", "--state-path", f"{out}/s/shape_state", "--out", f"{out}/again", "--score-min-periods", "50", "--score-lower", "0.1", "--clip-upper", "0.9"])
    read = lambda p: spark.read.parquet(f"{out}/{p}")
    assert read("s/state_vector").exceptAll(read("again/state_vector")).count() == 0 < read("again/state_vector").count()
    jobs.main(["adf", "--vectors", f"{out}/s/state_vector", "--out", f"{out}/adf", "--state-columns", "range_pct,move_age", "--window", "50", "--min-obs", "40"])
    assert {r.state_variable for r in read("adf/adf_by_state").collect()} == {"range_pct", "move_age"}
    jobs.main(["explosive", "--vectors", f"{out}/s/state_vector", "--out", f"{out}/e", "--samples-per-group", "2", "--samples-per-state", "2", "--nrep", "3", "--state-columns", "range_pct"])
    assert {r.state_group for r in read("e/explosive_by_state").collect()} == {"low", "mid", "high"}
    jobs.main(["lowess", "--vectors", f"{out}/s/state_vector", "--out", f"{out}/l", "--return-horizons", "5", "--vol-horizons", "3", "--max-points", "40", "--state-columns", "range_pct,upper_break"])
    assert {(r.variable, r.target) for r in read("l/lowess_index").collect()} == {(v, t) for v in ("range_pct_score", "upper_break_score") for t in ("return_k5", "vol_k3")}
    jobs.main(["swings", "--input", f"{out}/prices.parquet", "--out", f"{out}/d", "--m", "3", "--n", "10", "--rank", "2"])
    assert {r.item for r in read("d/spectrum").select("item").distinct().collect()} == {"eigenvalue", "singular_value", "mode"}
    jobs.main(["diagnostics", "--run", f"{out}/d", "--out", f"{out}/g", "--m", "3", "--n", "10", "--rank", "2"])
    assert read("g/singular_value_diagnostics").exceptAll(read("d/singular_values")).count() == 0
    assert read("g/reconstruction_error").count() == 2 and read("g/eigenvalue_diagnostics").count() == 4
