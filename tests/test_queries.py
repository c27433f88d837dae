"""Each query with SQL against DuckDB, on the smallest data."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.plans import checked  # noqa: F401
from tidemark.plans.queries import QUERIES, SQL

T0, DAY = dt.datetime(2024, 1, 1), dt.timedelta(days=1)
TABLES = "region nation customer supplier part orders lineitem events".split()


def norm(v):
    if isinstance(v, bool) or not isinstance(v, int | float):
        return v
    return float(v) + 0.0


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got, want = QUERIES[name](spark, small), con.sql(SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = lambda rows: sorted((tuple(norm(v) for v in r) for r in rows), key=str)
    at = [want.columns.index(c) for c in cols]
    assert order([r[c] for c in cols] for r in got.collect()) == order([r[i] for i in at] for r in want.fetchall())


@pytest.mark.parametrize("name", [n for n in ("market_state", "rolling_adf", "shape_state", "tuned_scales", "detector_comparison") if n in QUERIES])
def test_query_has_rows(spark, small, name):
    assert QUERIES[name](spark, small).limit(1).count() == 1


def test_every_bar_has_a_window_and_asks(spark, small):
    n = {r.symbol: r.n for r in QUERIES["daily_bars"](spark, small).groupBy("symbol").agg(F.count("*").alias("n")).collect()}
    assert QUERIES["trailing_windows_all"](spark, small).select("window_id").distinct().count() == sum(max(0, k - 59) for k in n.values()) > 0
    assert QUERIES["asof_join_all"](spark, small).count() == sum(n.values()) + 1


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["aff_samples", "gma_samples", "cum_events_raw", "sprt_samples", "page_hinkley_events", "cusum_ls_samples", "ssr_cusum_samples"])
def test_samplers_take_no_series_as_one_frame(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


#: In steps of 0.48: the last distances are 30 in decimals, and the order of summation decides.
AT_THE_THRESHOLD = {
    "a": [46, 95, 12, 21, 77, 94, 23, 66, 109, 79, 10, 34, 3, 60, 93, 2, 99, 16, 126, 141, 42, 43, 115, 95, 94, 51, 138, 32, 74, 133, 0, 62, 118, 134],
    "b": [31, 129, 137, 67, 78, 63, 20, 96, 132, 41, 77, 75, 80, 12, 130, 62, 126, 88, 128, 142, 29, 99, 35, 98, 119],
    "c": [77, 29, 41, 92, 75, 69, 110, 100, 25, 139, 125, 51, 19, 69, 118, 27, 56, 52, 68, 118, 125, 24, 58, 29, 10, 112, 21, 45, 70, 24, 14, 25, 47, 79, 17, 126, 2],
    "d": np.random.default_rng(4).integers(0, 145, 20_000).tolist(),
}


@pytest.mark.parametrize("name", ["swt_events", "swt_events_native"])
def test_swt_where_the_distance_is_the_threshold(spark, tmp_path, name):
    parts = [pd.DataFrame({"event_type": s, "ts": pd.date_range("2024-01-01", periods=len(k), freq="s").astype("datetime64[us]"), "value": np.round(np.array(k) * 0.48, 2)}) for s, k in AT_THE_THRESHOLD.items()]
    pd.concat(parts).sample(frac=1, random_state=1).to_parquet(tmp_path / "events.parquet", index=False)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(con.sql(SQL[name]).fetchall())
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == want != []


@pytest.mark.parametrize("window", [3, 20, 40])
def test_trailing_sums_have_one_order(spark, window):
    """The kernel's, the expression's and that of a window in SQL are the same number."""
    from tidemark.operators import sampling

    x = np.round(np.random.default_rng(2).integers(0, 145, 300) * 0.48, 2)
    table = pd.DataFrame({"i": np.arange(300), "x": x})  # noqa: F841
    want = duckdb.sql(f"SELECT avg(x) OVER (ORDER BY i ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING) FROM table ORDER BY i".replace("table", "\"table\"")).fetchall()
    assert [sampling.placed_sum(x[i - window : i].tolist(), i - window) / window for i in range(window, 300)] == [m for (m,) in want[window:]]
    rows = spark.createDataFrame([("a", T0 + DAY * i, v) for i, v in enumerate(x.tolist())], "symbol string, ts timestamp, x double")
    dist = [abs(v - m) for v, (m,) in zip(x.tolist()[window:], want[window:], strict=True)]
    for limit in dist[:40:8]:  # a distance itself is not above it
        got = {r.ts for r in sampling.sliding_window_events(rows, limit, window=window).collect()}
        assert got == {T0 + DAY * (i + window) for i, d in enumerate(dist) if d > limit}
        assert len(got) == len(sampling.sample_positions("swt", x, np.full(300, limit), window=window))
