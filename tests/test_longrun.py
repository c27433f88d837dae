"""Blocks of one series against its single pass."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import detect, longrun, sampling


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    n = 6000
    pdf = pd.DataFrame({"symbol": ["one"] * n + ["b"] * 30, "ts": pd.date_range("2000-01-01", periods=n, freq="h").tolist() + pd.date_range("2000-01-01", periods=30).tolist()})
    pdf["x"] = rng.normal(0, 1, len(pdf))
    pdf["value"] = np.cumsum(pdf["x"])
    pdf.loc[rng.random(len(pdf)) < 0.02, ["x", "value"]] = None
    return spark.createDataFrame(pdf).repartition(6)


def show(df, *columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.select(*columns).collect())


def test_cusum(table):
    got = longrun.detect_long(table, q=300.0, size=400)
    want = detect.detect(table, "cusum", 300.0)
    columns = ["symbol", "ts", "idx", "direction", "score"]
    assert show(got, *columns) == show(want, *columns) and want.count() > 100


@pytest.mark.parametrize(("method", "limit", "b2b"), [("cum", 12.0, 1), ("cum", 5.0, 3), ("page_hinkley", 15.0, 1)])
def test_samplers(table, method, limit, b2b):
    got = longrun.sample_long(table, method, limit, b2b, size=400)
    want = sampling.sample_events(table, method, limit, b2b)
    assert show(got, "symbol", "ts") == show(want, "symbol", "ts") and want.count() > 20


def test_few_rounds_and_many_tasks(table):
    rows = sampling.aligned_threshold(table, F.lit(12.0))
    start = lambda n, s: longrun.SampleFold("cum", 1, {}, n, s)
    events, rounds = longrun.fold(rows, start, 400)
    assert rounds <= 4 and events.count() > 50  # fifteen blocks of one series
    whole, once = longrun.fold(rows, start, 10**9)
    assert once == 1 and show(whole, "symbol", "idx") == show(events, "symbol", "idx")


def test_nothing_and_what_never_forgets(table):
    assert longrun.detect_long(table.filter("false")).collect() == []
    with pytest.raises(ValueError):
        longrun.detect_long(table, "cusum_ls")
    with pytest.raises(ValueError):
        longrun.sample_long(table, "glr", 1.0)


def test_running_means_take_no_rounds(table):
    rows = sampling.aligned_threshold(table, F.lit(15.0))
    events, rounds = longrun.fold(rows, lambda n, s: longrun.SampleFold("page_hinkley", 1, {}, n, s), 200)
    assert rounds <= 6  # thirty blocks: means of sums differ in their last digit from those carried on
    assert show(events, "symbol", "ts") == show(sampling.sample_events(table, "page_hinkley", 15.0), "symbol", "ts")
