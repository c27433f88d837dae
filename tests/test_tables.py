"""SQL text against the operators of the same name."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import tables
from tidemark.operators import detect, kernels, sampling, structure
from tidemark.plans import bars as B


@pytest.fixture(scope="module")
def views(spark, small):
    tables.register(spark)
    prices = B.order_bars(spark, small)
    B.log_close(prices).createOrReplaceTempView("udtf_series")
    structure.clean_bars(prices).createOrReplaceTempView("udtf_bars")
    dif = B.increments(B.event_ticks(spark, small))
    sampling.aligned_threshold(dif, F.lit(3.0) + F.abs("x") / 10).createOrReplaceTempView("udtf_dif")
    return spark


def rows(df, *columns):
    return sorted((tuple(str(x) for x in r) for r in df.select(*columns).collect()))


@pytest.mark.parametrize("method", list(kernels.KERNELS))
def test_every_detector(views, method):
    columns = ["symbol", "ts", "idx", "direction", "direction_source", "score", "change_ts"]
    q = 100.0 if method == "cusum" else 0.2
    got = views.sql(f"SELECT * FROM detect(TABLE(udtf_series) PARTITION BY symbol ORDER BY (ts), '{method}', {q})")
    assert rows(got, *columns) == rows(detect.detect(views.table("udtf_series"), method, q), *columns)


def test_options_and_wild_segmentation(views):
    got = views.sql("SELECT * FROM detect(TABLE(udtf_series) PARTITION BY symbol ORDER BY (ts), 'cusum', 10.0, h => 0.3)")
    assert rows(got, "symbol", "ts") == rows(detect.detect(views.table("udtf_series"), "cusum", 10.0, h=0.3), "symbol", "ts") != []
    text = "SELECT * FROM detect(TABLE(SELECT symbol, ts, value + IF(ts > '1995-01-01', 40, 0) AS value FROM udtf_series) PARTITION BY symbol ORDER BY (ts), 'wbs', 0.5, draws => 20, reps => 5)"
    assert {r.direction_source for r in views.sql(text).collect()} == {"wbs_lepage"}


@pytest.mark.parametrize("method", list(sampling.SAMPLERS))
def test_every_sampler(views, method):
    got = views.sql(f"SELECT * FROM sample_events(TABLE(udtf_dif) PARTITION BY symbol ORDER BY (ts), '{method}', b2b => 2)")
    assert rows(got, "symbol", "ts") == rows(sampling.sample_events(views.table("udtf_dif"), method, F.col("thr"), b2b=2), "symbol", "ts")


def test_market_state(views):
    got = views.sql("SELECT * FROM market_state(TABLE(udtf_bars) PARTITION BY symbol ORDER BY (ts), 'cusum', 30.0, reset_on_change => true)")
    want = structure.market_state(views.table("udtf_bars"), "cusum", 30.0, reset_on_change=True)
    assert got.columns == want.columns and rows(got, *want.columns) == rows(want, *want.columns)


@pytest.mark.parametrize("call", [
    "detect(TABLE(udtf_series) PARTITION BY symbol ORDER BY (ts), 'nothing')", "detect(TABLE(udtf_series) PARTITION BY symbol ORDER BY (ts), 'cusum', 1.0, zz => 1)",
    "detect(TABLE(udtf_bars) PARTITION BY symbol ORDER BY (ts), 'cusum')", "sample_events(TABLE(udtf_dif) PARTITION BY symbol ORDER BY (ts), 'nothing')",
    "detect(TABLE(udtf_series) PARTITION BY symbol ORDER BY (ts DESC), 'cusum')",
])
def test_errors(views, call):
    with pytest.raises(PySparkException):
        views.sql(f"SELECT * FROM {call}").collect()


def test_empty_and_missing_values(views):
    none = "SELECT * FROM detect(TABLE(SELECT * FROM udtf_series WHERE value IS NULL) PARTITION BY symbol ORDER BY (ts), '{}')"
    assert views.sql(none.format("cusum")).collect() == views.sql(none.format("recursive_param_seg")).collect() == []
    views.sql("SELECT symbol, ts, IF(day(ts) % 3 = 0, NULL, value) AS value FROM udtf_series").createOrReplaceTempView("udtf_gaps")
    got = views.sql("SELECT * FROM detect(TABLE(udtf_gaps) PARTITION BY symbol ORDER BY (ts), 'sprt', 0.1)")
    assert rows(got, "symbol", "ts", "idx") == rows(detect.detect(views.table("udtf_gaps"), "sprt", 0.1), "symbol", "ts", "idx") != []


def test_many_samplers_in_one_pass(views):
    text = "SELECT * FROM sample_many(TABLE(udtf_dif) PARTITION BY symbol ORDER BY (ts), 'swt 30 2, cum 60 2, e_detector 1.05')"
    one = "SELECT '{m}' AS method, symbol, ts FROM sample_events(TABLE(udtf_dif) PARTITION BY symbol ORDER BY (ts), '{m}', {q})"
    want = views.sql(" UNION ALL ".join(one.format(m=m, q=q) for m, q in {"swt": "30, b2b => 2", "cum": "60, b2b => 2", "e_detector": "1.05"}.items()))
    assert rows(views.sql(text), "method", "symbol", "ts") == rows(want, "method", "symbol", "ts") != []
    # symbols that meet in one partition, and more rows than come together at once
    views.sql("SELECT CAST(id DIV 5000 AS STRING) AS symbol, timestamp_seconds(id) AS ts, CAST(hash(id) % 100 AS DOUBLE) AS x FROM range(0, 15000, 1, 3)").createOrReplaceTempView("udtf_long")
    got = views.sql("SELECT * FROM sample_many(TABLE(udtf_long) WITH SINGLE PARTITION ORDER BY (symbol, ts), 'cum 300 2')")
    assert rows(got, "symbol", "ts") == rows(sampling.sample_events(views.table("udtf_long"), "cum", 300.0, b2b=2), "symbol", "ts") != []
    with pytest.raises(PySparkException):
        views.sql("SELECT * FROM sample_many(TABLE(udtf_dif) PARTITION BY symbol ORDER BY (ts), 'nothing 1')").collect()
