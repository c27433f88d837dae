"""Exact order and quantiles against plain ones, with hot values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import numeric
from tidemark.operators import dmd, research, vector
from tidemark.plans import order


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(4)
    n = 3000
    hot = np.where(rng.random(n) < 0.5, 7.0, np.round(rng.normal(5, 3, n), 1))  # half of the rows have one value
    return pd.DataFrame({"symbol": rng.choice(["a", "b", "c"], n), "ts": np.arange(n), "x": hot, "y": rng.normal(0, 1, n), "w": rng.choice([1.0, 2.0], n)})


@pytest.fixture(scope="module")
def table(spark, frame):
    return spark.createDataFrame(frame).repartition(6)


def test_quantiles(table, frame):
    levels = (0.0, 0.01, 1 / 3, 0.5, 0.9, 1.0)
    (row,) = order.quantiles(table, [], "x", levels).collect()
    assert np.allclose(row.q, np.quantile(frame["x"], levels))
    for r in order.quantiles(table.withColumn("x", F.when(F.col("ts") % 5 > 0, F.col("x"))), ["symbol"], "x", levels).collect():
        mine = frame[(frame["symbol"] == r.symbol) & (frame["ts"] % 5 > 0)]["x"]
        assert np.allclose(r.q, np.quantile(mine, levels))


def test_quantiles_of_few_and_none(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 4.0), ("a", float("nan")), ("b", None), ("c", 2.0)], "k string, v double")
    assert sorted((r.k or "", r.q) for r in order.quantiles(df, ["k"], "v", (0.5, 1 / 3)).collect()) == [("", [2.5, 2.0]), ("c", [2.0, 2.0])]
    assert order.quantiles(df.filter("false"), ["k"], "v", (0.5,)).collect() == []
    (row,) = order.column_quantiles(df, ["v"], (0.0, 1.0)).collect()
    assert row["_q_v"] == [1.0, 4.0]
    (row,) = order.column_quantiles(df.filter("false"), ["v"], (0.5,)).collect()
    assert row["_q_v"] is None


@pytest.mark.parametrize("by", [[], ["symbol"], ["symbol", "w"]])
def test_positions(table, frame, by):
    got = order.with_position(table, ["x", "ts"], "i", "n", by).toPandas().sort_values("ts").reset_index(drop=True)
    want = frame.sort_values(["x", "ts"])
    groups = want.groupby(by) if by else [(0, want)]
    for _, g in groups:
        mine = got.loc[g.index]
        assert mine["i"].tolist() == list(range(len(g))) and (mine["n"] == len(g)).all()


def test_a_hot_value_is_spread_over_ranges(spark, table):
    """Half of the rows have one value: their ties keep them apart."""
    placed = order.with_position(table, ["x", "ts"], "i")
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan and "percentile" not in plan
    key = F.struct("x", "ts")
    cuts = [r.k for i, r in enumerate(table.select(key.alias("k")).orderBy("k").collect()) if i % 750 == 749][:3]
    bounds = [F.struct(F.lit(c["x"]).alias("x"), F.lit(c["ts"]).alias("ts")) for c in cuts]
    sizes = [r["count"] for r in table.groupBy(order.place_among(key, bounds)).count().collect()]
    assert max(sizes) <= 751


def test_subsamples_of_all_pairs_are_those_of_each(spark, table):
    long = table.withColumn("p", F.explode(F.array(F.lit("x"), F.lit("y")))).withColumn("v", F.when(F.col("p") == "x", F.col("x")).otherwise(F.col("y")))
    got = research.even_subsample(long, "v", 100, by=["p"])
    for p in ("x", "y"):
        one = research.even_subsample(table.withColumn("v", F.col(p)), "v", 100)
        rows = lambda d: sorted((r.v, r.symbol, r.ts) for r in d.collect())
        assert rows(got.filter(F.col("p") == p)) == rows(one) and one.count() == 100


def test_operators_on_quantiles(table, frame):
    d = {r.variable: r for r in vector.describe(table, ["x", "y"]).collect()}
    assert d["x"].p50 == pytest.approx(frame["x"].median()) and d["y"].p95 == pytest.approx(frame["y"].quantile(0.95)) and d["x"]["count"] == 3000
    low, high = frame["y"].quantile([0.01, 0.99])
    assert np.allclose(sorted(r.y for r in research.winsorise(table, ["y"]).collect()), np.sort(np.clip(frame["y"], low, high)))
    got = research.with_tertiles(table, ["y"]).groupBy("y_group").count().collect()
    assert sorted(r["count"] for r in got) == [1000, 1000, 1000]


@pytest.mark.parametrize("spread", [True, False])
def test_blocks_give_what_whole_series_give(spark, spread):
    rng = np.random.default_rng(8)
    n = 700
    pdf = pd.DataFrame({"symbol": ["a"] * n + ["b"] * 40, "ts": pd.date_range("2000-01-01", periods=n).tolist() + pd.date_range("2000-01-01", periods=40).tolist()})
    pdf["close"] = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, len(pdf))))
    pdf.loc[rng.random(len(pdf)) < 0.03, "close"] = np.nan
    pdf["v"], pdf["date"], pdf["bar_index"], pdf["event_id"], pdf["observable"] = rng.normal(0, 1, len(pdf)), pdf["ts"], range(len(pdf)), range(len(pdf)), np.cumsum(rng.normal(0, 1, len(pdf)))
    df = spark.createDataFrame(pdf).repartition(5)
    show = lambda d, *c: sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in d.select(*c).collect())
    adf = lambda b: show(research.rolling_adf(df, ["v"], block=b, spread=spread), "symbol", "ts", "adf_stat", "usedlag", "nobs", "v")
    assert adf(64) == adf(10**9) and len(adf(64)) > 400
    f = lambda b: show(dmd.rolling_forecasts(df, 5, 20, 3, block=b, spread=spread), "symbol", "start", "true", "pred")
    assert f(32) == f(10**9) and len(f(32)) == 700 - 26 + 40 - 26
    blocks = order.halo_blocks(df, 59, size=64, spread=spread).groupBy("symbol", "_block").count()
    assert blocks.filter("symbol = 'a'").count() == 11 and blocks.agg(F.max("count")).first()[0] <= 64 + 59
    # scores: plain quantiles of the rows before
    got = vector.rolling_scores(df, ["v"], window=50, min_periods=10, binary=[], spread=spread).toPandas().sort_values(["symbol", "ts"])
    for _, g in got.groupby("symbol"):
        low, high = (g["v"].shift(1).rolling(50, min_periods=10).quantile(q) for q in (0.05, 0.95))
        want = (2 * (g["v"] - low) / (high - low) - 1).clip(-1, 1)
        assert np.allclose(g["v_score"].astype(float), want, equal_nan=True)


@pytest.mark.parametrize(("m", "n", "rank"), [(5, 20, 3), (3, 3, 3), (4, 30, 1), (8, 4, 2)])
def test_forecasts_of_all_windows(m, n, rank):
    x = np.cumsum(np.random.default_rng(m).normal(0, 1, 200)) + np.sin(np.arange(200))
    want = [dmd.forecast(x[s : s + m + n + 1], m, n, rank) for s in range(200 - m - n)]
    assert np.allclose(dmd.forecasts(x, m, n, rank, at_once=1000), want, rtol=1e-8, atol=1e-8)
    with pytest.raises(ValueError):
        dmd.forecasts(np.ones(60), 5, 20, 3)


@pytest.mark.parametrize("lags", [0, 1, 2])
def test_statistics_of_all_windows(lags):
    rng = np.random.default_rng(lags)
    walks = np.cumsum(rng.normal(0, 1, (5, 40)), axis=1)
    walks[3], walks[4, 10:30] = np.exp(np.arange(40) / 20), 7.0
    got = numeric.window_statistics(walks, 13, lags)
    want = np.concatenate([numeric.unit_root_windows(np.lib.stride_tricks.sliding_window_view(walks, size, axis=1).reshape(-1, size), lags, "c").reshape(5, -1) for size in range(13, 41)], axis=1)
    assert np.allclose(got[:3], want[:3], rtol=1e-10, atol=1e-10)  # the rest is exact, or nearly, and one is constant for half of it
    best = numeric.explosive_statistics(walks, 13, lags, at_once=500)
    assert np.allclose(best[:3], np.nanmax(want[:3], axis=1)) and np.isnan(numeric.explosive_statistics(walks, 50)).all()
    assert numeric.explosive_statistic(walks[0], 13, lags) == pytest.approx(best[0])
