import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import numeric
from tidemark.operators import detect, dmd, evaluate, kernels, research, sampling, structure, vector
from tidemark.plans import order
from tidemark.plans.asof import asof_backward
from tidemark.sources import readers

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2020, 1, 1)


def bars_of(n=250, seed=0, symbol="a"):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
    open_ = np.concatenate([[100], close[:-1]])
    high, low = np.maximum(open_, close) * (1 + rng.random(n) * 0.01), np.minimum(open_, close) * (1 - rng.random(n) * 0.01)
    return pd.DataFrame({"symbol": symbol, "ts": [T0 + DAY * i for i in range(n)], "open": open_, "high": high, "low": low, "close": close})


# -- samplers


@pytest.mark.parametrize("b2b", [1, 2, 3])
def test_sliding_window_in_expressions_equals_the_kernel(spark, b2b):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"symbol": ["a"] * 200 + ["b"] * 30, "ts": [T0 + DAY * i for i in range(200)] + [T0 + DAY * i for i in range(30)], "x": rng.normal(0, 1, 230)})
    df = spark.createDataFrame(pdf)
    a, b = (sorted(map(tuple, f.select("symbol", "ts").collect())) for f in (sampling.sample_events(df, "swt", 0.8, b2b=b2b), sampling.sliding_window_events(df, 0.8, b2b=b2b)))
    assert a == b != []


def test_run_of_exceedances():
    x, limit = np.array([0.0] * 3 + [9.0] * 4), np.full(7, 5.0)
    at = lambda b: sampling.sample_positions("swt", x, limit, b, window=3)
    assert at(1)[:1] == [3] and at(2)[:1] == [4] and at(5) == []


@pytest.mark.parametrize("method", sampling.SAMPLERS)
def test_samplers_run_on_anything(method):
    rng = np.random.default_rng(1)
    for x in (np.zeros(0), np.ones(1), np.zeros(120), rng.normal(0, 1, 300)):
        got = sampling.sample_positions(method, x, np.full(len(x), np.inf))
        assert got == []
    assert sampling.sample_positions(method, rng.normal(0, 1, 300), np.full(300, -1.0))


def test_threshold_gaps_fill_forward_then_backward(spark):
    df = spark.createDataFrame([("a", T0 + DAY * i, float(i), v) for i, v in enumerate([None, 2.0, None, -5.0])], "symbol string, ts timestamp, x double, v double")
    assert [r.thr for r in sampling.aligned_threshold(df, F.col("v")).orderBy("ts").collect()] == [2.0, 2.0, 2.0, 0.0]


# -- the state machine


def states(pdf, **o):
    m = structure.Machine(**o)
    return structure.state_frame([m.step(*r) for r in pdf[["ts", "open", "high", "low", "close"]].itertuples(index=False, name=None)], "a")


@pytest.mark.parametrize("o", [{"q": 2.0}, {"q": 2.0, "lag": 3}, {"q": 2.0, "reset_on_change": True}, {"method": "shewhart", "q": 0.2}, {"method": "recursive_param_seg", "q": 2.0}])
def test_state_of_a_prefix_is_the_prefix_of_the_state(o):
    pdf = bars_of(160)
    full = states(pdf, **o)
    for n in (1, 40, 97):
        pd.testing.assert_frame_equal(states(pdf.head(n), **o), full.head(n))


def test_events_by_replay_of_every_prefix():
    """The single pass against running the detector anew on each prefix."""
    pdf = bars_of(120, 3)
    close = pdf["close"].to_numpy()
    seen, want = set(), []
    for i in range(len(close)):
        new = [e for e in detect.series_events(pdf["ts"].to_numpy()[: i + 1], close[: i + 1], "cusum", 80.0, {}) if e[1] not in seen and i - e[1] >= 2]
        seen |= {e[1] for e in new}
        want.append(bool(new))
    assert states(pdf, q=80.0, lag=2)["cpd_confirm_event"].tolist() == want and any(want)


def test_segmentation_with_a_lag_never_confirms():
    assert not states(bars_of(80), method="recursive_param_seg", lag=1)["cpd_confirm_event"].any()


def test_extremes_alternate_and_trends_follow_their_points():
    s = states(bars_of(400, 5), q=60.0)
    kinds = s[s.new_extremum_confirmed].drop_duplicates(["confirmed_extremum_kind", "confirmed_extremum_idx"])
    assert len(kinds) > 4
    up, down = s[s.current_trend == "uptrend"], s[s.current_trend == "downtrend"]
    assert len(up) and len(down) and (up.Low > up.point3).all() and (down.High < down.point3).all()
    assert set(s.current_phase) <= {"up_movement", "up_correction", "up_phase_unknown", "down_movement", "down_correction", "down_phase_unknown", "no_phase"}
    assert (s[s.direction == 0].status == 0).all()
    assert len(structure.FIELDS) == 57


def test_no_direction_yet():
    s = states(bars_of(10), q=1e9)
    assert (s.direction == 0).all() and s.last_max.isna().all() and s.time_since_last_cpd.tolist() == list(range(1, 11))


def test_duplicate_bars_keep_the_last(spark):
    rows = [("a", T0, 1.0, 2.0, 0.5, 1.5, 1), ("a", T0, 1.0, 3.0, 0.5, 2.5, 2), ("a", T0 + DAY, None, 3.0, 0.5, 2.5, 3), ("a", T0 + 2 * DAY, -1.0, 1.0, -2.0, 1.0, 4)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, input_order int")
    assert [r.close for r in structure.clean_bars(df).orderBy("ts").collect()] == [2.5, 1.0]
    assert structure.clean_bars(df, log_price=True).count() == 1


def test_shape_features_and_lags(spark):
    df = spark.createDataFrame(bars_of(300, 2))
    rows = structure.shape_state(df, n_lags=2, decay=0.5, q=60.0).orderBy("ts").toPandas()
    have = rows[rows.has_structural_window]
    assert len(have) and np.allclose(have.range_pct, have[["high1", "high2"]].max(axis=1) - have[["low1", "low2"]].min(axis=1))
    assert np.allclose(have.expansion, have.high_change - have.low_change)
    lagged = have[have.lag1_range_pct.notna()]
    assert len(lagged) and rows[~rows.has_structural_window].high1.isna().all()
    v = vector.state_vector(structure.shape_state(df, q=60.0)).filter("valid_state")
    assert v.count() > 0


# -- vector, evaluation


def test_scores_use_rows_before_only(spark):
    pdf = pd.DataFrame({"symbol": "a", "ts": [T0 + DAY * i for i in range(30)], "v": np.arange(30.0), "b": [None, 2.0, -1.0] * 10})
    out = vector.rolling_scores(spark.createDataFrame(pdf), ["v", "b"], window=10, min_periods=5, binary=["b"]).orderBy("ts").toPandas()
    assert out.v_score[:5].isna().all() and (out.v_score[5:] == 1).all()
    assert out.b_score[1] == 1 and out.b_score[2] == -1 and math.isnan(out.b_score[0])


def test_empty_buckets_stay(spark):
    df = spark.createDataFrame([("a", T0, 0.5, 1.0)], "symbol string, ts timestamp, position double, v double")
    got = {r["bucket"]: r["count"] for r in evaluate.position_returns(df, "v").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0}


# -- numerics


def test_unit_root_statistics_agree():
    rng = np.random.default_rng(0)
    y = np.cumsum(rng.normal(size=(5, 60)), axis=1)
    for reg in ("n", "c", "ct", "ctt"):
        many = numeric.unit_root_windows(y, 1, reg)
        assert np.allclose(many, [numeric.unit_root_t(w, 1, reg)[0] for w in y], rtol=1e-6)
    assert numeric.mackinnon_p(-2.86, "c") == pytest.approx(0.05, abs=2e-3)
    assert numeric.mackinnon_p(-3.43, "c") == pytest.approx(0.01, abs=2e-3)
    assert numeric.mackinnon_p(9, "c") == 1 and numeric.mackinnon_p(-30, "c") == 0


def test_explosive_series_is_told_from_a_walk():
    x = np.exp(0.15 * np.arange(60)) + np.random.default_rng(0).normal(0, 0.1, 60)
    assert numeric.explosive_statistic(x, 50, 1) > numeric.explosive_critical(60, 50, 40, 1)


def test_local_regression_reproduces_a_line():
    x = np.random.default_rng(3).random(80)
    fx, fy = numeric.local_regression(x, 2 * x + 1, 0.3, 1)
    assert np.allclose(fy, 2 * fx + 1, atol=1e-8)


def test_chi2_quantile():
    assert numeric.chi2_one_quantile(0.9999) == pytest.approx(15.1367, abs=1e-3)


# -- swing events


def test_delay_spectrum_of_a_sinusoid():
    d = dmd.decompose(np.cos(0.4 * np.arange(60)), 10, 40, 2)
    assert np.allclose(sorted(np.angle(d["eigenvalues"])), [-0.4, 0.4], atol=1e-6) and np.allclose(np.abs(d["eigenvalues"]), 1, atol=1e-6)
    assert dmd.forecast(np.cos(0.4 * np.arange(51)), 10, 40, 2) == pytest.approx(math.cos(0.4 * 51), abs=1e-6)


@pytest.mark.parametrize(("x", "m", "n", "rank", "error"), [(np.zeros(5), 3, 3, 1, ValueError), (np.ones(20), 3, 3, 2, ValueError), ([1.0, math.nan] * 9, 3, 3, 1, ValueError), (np.arange(9.0), 2.0, 3, 1, TypeError), (np.arange(9.0), 2, 3, 5, ValueError)])
def test_bad_decompositions(x, m, n, rank, error):
    with pytest.raises(error):
        dmd.decompose(x, m, n, rank)


def test_asof_matches_the_latest_not_after(spark):
    left = spark.createDataFrame([("a", T0 + 1.5 * DAY), ("a", T0 - DAY), ("b", T0), ("a", T0 + 2 * DAY)], "symbol string, ts timestamp")
    right = spark.createDataFrame([("a", T0, 0), ("a", T0 + DAY, 1), ("a", T0 + 2 * DAY, 2)], "symbol string, ts timestamp, i int")
    got = {(r.symbol, r.ts): r.i for r in asof_backward(left, right, ["i"]).collect()}
    assert got == {("a", T0 + 1.5 * DAY): 1, ("a", T0 - DAY): None, ("b", T0): None, ("a", T0 + 2 * DAY): 2}


def test_event_names_and_kinds(spark):
    df = spark.createDataFrame([(5, "Top", "2020-01-02", 3.0), (600000, "min", "2020-01-03", 2.0), (7, "what", "2020-01-03", 2.0)], "code int, kind string, date string, price double")
    assert sorted((r.symbol, r.kind) for r in dmd.normalise_events(df).collect()) == [("000005", "high"), ("600000", "low")]


def test_observable_skips_events_on_one_bar(spark):
    bars = bars_of(60)
    ev = pd.DataFrame({"symbol": "a", "date": [bars.ts[30], bars.ts[30], bars.ts[40], bars.ts[55]], "kind": "high", "price": [100.0, 101.0, 110.0, 90.0]})
    got = dmd.observable(spark.createDataFrame(ev), spark.createDataFrame(bars[["symbol", "ts", "close"]])).collect()
    assert len(got) == 2


# -- sources


def test_prices_from_csv_with_mark_and_mixed_case(spark, tmp_path):
    (tmp_path / "x.csv").write_text("﻿Date, OPEN,High,Low,Close,symbol\n2020-01-01,1,2,0.5,1.5,42\n2020-01-02,x,2,0.5,1.5,42\n2020-02-01,1,2,0.5,1.5,42\n", encoding="utf-8")
    rows = readers.read_prices(spark, str(tmp_path / "x.csv"), end="2020-01-31").orderBy("ts").collect()
    assert [(r.symbol, r.open) for r in rows] == [("000042", 1.0), ("000042", None)]
    with pytest.raises(ValueError):
        (tmp_path / "y.csv").write_text("a,b\n1,2\n")
        readers.read_prices(spark, str(tmp_path / "y.csv"))


def test_settings_file_wins(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"q": 2}')
    assert readers.read_settings(spark, str(tmp_path / "s.json"), q=1, lag=0) == {"q": 2, "lag": 0}


def test_series_reader(spark, tmp_path):
    spark.createDataFrame([(T0, 1.0)], "time timestamp, p double").write.parquet(str(tmp_path / "p"))
    assert readers.read_series(spark, str(tmp_path / "p")).first().value == 1.0


def test_sampling_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(str(i % 3), i) for i in range(90)], "symbol string, ts int")
    pick = lambda d: sorted(map(tuple, research.stratified_sample(d, ["symbol"], 5).collect()))
    assert pick(df) == pick(df.repartition(7)) and len(pick(df)) == 15


def test_counts_of_silent_configurations(spark):
    df = spark.createDataFrame([("a", T0 + DAY * i, float(i)) for i in range(30)], "symbol string, ts timestamp, value double")
    configs = [("cusum", 1.0), ("cusum", 1e9)]
    got = {r.q: r.n_events for r in detect.event_counts(detect.detect_many(df, configs), configs).collect()}
    assert got[1.0] > 0 and got[1e9] == 0
    with pytest.raises(ValueError):
        detect.detect(df, "none")


def test_native_cusum_equals_the_kernel(spark):
    x = bars_of(200, 9)
    df = spark.createDataFrame(x.assign(value=np.log(x.close))[["symbol", "ts", "value"]])
    a = {(r.idx, r.direction, round(r.score, 9)) for r in detect.cusum_fold(df, 2.0).collect()}
    assert a == {(r.idx, r.direction, round(r.score, 9)) for r in detect.detect(df, "cusum", 2.0).collect()} != set()
    assert kernels.make("CUSUM").q == 1.0


def test_explosive_windows_are_of_the_references_numbers(spark):
    from tidemark.plans import queries

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({v: rng.normal(0, 1, 4000) for v in vector.VARIABLES}).assign(symbol="a", ts=[T0 + DAY * i for i in range(4000)], valid_state=True)
    ends = queries.explosive_ends(spark.createDataFrame(pdf)).collect()
    of = [r.window_id.split("_a_")[0] for r in ends]
    want = {f"{v}_{g}": 120 for v in vector.VARIABLES for g in ("low", "mid", "high")} | {f"composite_{name}": 150 for name, _ in research.COMPOSITES}
    assert {k: of.count(k) for k in set(of)} == want and len({r.window_id for r in ends}) == len(ends)
    asked = {}
    monkeypatch.setattr(queries, "_bars", lambda s, d: None)
    monkeypatch.setattr(queries, "_shape", lambda s, d: None)
    monkeypatch.setattr(queries.V, "state_vector", lambda x: x)
    monkeypatch.setattr(queries, "explosive_ends", lambda x: x)
    monkeypatch.setattr(queries.R, "trailing_windows", lambda *a: a)
    monkeypatch.setattr(queries.R, "explosiveness", lambda windows, **o: asked.update(o))
    queries.explosiveness(spark, "")
    assert "nrep" not in asked  # the operator's own 499


def test_local_regression_collapses_few_values_over_all_rows(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"symbol": "a", "ts": [T0 + DAY * i for i in range(900)], "two": np.arange(900) % 2 * 1.0, "many": rng.normal(0, 1, 900), "y": rng.normal(0, 1, 900)})
    got = research.lowess(spark.createDataFrame(pdf), ["two", "many"], ["y"], max_points=50).toPandas()
    two = got[got.variable == "two"].sort_values("x")
    assert two.x.tolist() == [0.0, 1.0] and two.y.tolist() == pytest.approx(pdf.groupby("two").y.mean().tolist())
    assert (got.variable == "many").sum() == 50


def test_local_regression_query_takes_the_operators_points(spark):
    from tidemark.plans import queries

    asked = []
    monkeypatch.setattr(queries, "_vars", lambda s, d: spark.createDataFrame([("a", T0, 1.0)], "symbol string, ts timestamp, b double"))
    monkeypatch.setattr(queries.R, "lowess", lambda rows, *a, **o: asked.append(o))
    queries.local_regression(spark, "")
    assert asked == [{}]


def test_scales_tried_and_chosen(spark):
    """The search against its rule, with counts that rise and fall."""
    from tidemark.operators.sampling import search_scale

    tried = search_scale(lambda s: int(1000 * s), 300, 16)
    assert [t[0] for t in tried[:3]] == [1.0, 2.0, 4.0] or tried[0][0] == 1.0
    down = search_scale(lambda s: int(100 / s), 300, 16)
    # 100, 200, 400 events: half, then double again from there, then means
    assert [t[0] for t in down[:5]] == [1.0, 0.5, 0.25, 0.5, (0.25 * 0.5) ** 0.5] and [t[2] for t in down[:5]] == [False, False, True, True, True]
    best = min((abs(n - 300), s) for s, n, ok in down if ok)
    assert best[0] == 0
    up = search_scale(lambda s: int(5000 / s), 300, 2)
    assert [t[0] for t in up] == [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 32.0**0.5, (32.0**0.5 * 32.0) ** 0.5]


def test_counts_at_a_scale_and_silent_configurations(spark):
    rows = [("a", i, float((-1) ** i * (1 + i % 5))) for i in range(200)] + [("b", i, 1.0) for i in range(200)]
    dif = spark.createDataFrame([(s, T0 + dt.timedelta(days=i), x) for s, i, x in rows], "symbol string, ts timestamp, x double")
    got = {r.symbol: r.n_events for r in sampling.count_events(dif, "cum", 2.0).collect()}
    one = sampling.sample_events(sampling.base_threshold(dif), "cum", F.col("vol") * 2.0).groupBy("symbol").count().collect()
    assert {s: n for s, n in got.items() if n} == {r.symbol: r["count"] for r in one} and set(got) == {"a", "b"}
    scales = spark.createDataFrame([("a", "cum", 2.0), ("a", "swt", 1.0), ("b", "cum", 2.0)], "symbol string, method string, scale double")
    both = {(r.symbol, r.method): r["count"] for r in sampling.sample_scaled(sampling.base_threshold(dif), scales).groupBy("symbol", "method").count().collect()}
    assert both.get(("a", "cum"), 0) == got["a"]
    events = spark.createDataFrame([("a", T0, "m", 1.0)], "symbol string, ts timestamp, method string, q double")
    j = {(r.a_method, r.b_method): r.jaccard for r in detect.jaccard(events, configs=[("m", 1), ("n", 1), ("o", 2)]).collect()}
    assert j == {(a, b): 1.0 if a == b or {a, b} == {"n", "o"} else 0.0 for a in "mno" for b in "mno"}


def test_exchange_of_a_code(spark):
    from tidemark.sources.readers import exchange_prefix

    codes = ["000001", "300750", "600000", "430047", "830799", "500001", "900901", "123456", "200012", "700001"]
    got = [r[0] for r in spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, c string").orderBy("i").select(exchange_prefix("c")).collect()]
    assert got == ["sz000001", "sz300750", "sh600000", "bj430047", "bj830799", "500001", "900901", "123456", "200012", "700001"]


def test_extremes_without_a_bar_are_dated_by_their_confirmation(spark):
    rows = [("a", T0 + dt.timedelta(days=i), i == 3 or i == 4, "high" if i == 3 else "low", 1 if i == 3 else 99, float(i)) for i in range(6)]
    state = spark.createDataFrame(rows, "symbol string, timestamp timestamp, new_extremum_confirmed boolean, confirmed_extremum_kind string, confirmed_extremum_idx long, confirmed_extremum_value double")
    got = {r.extreme_type: r.extreme_date for r in dmd.extreme_events(state).collect()}
    assert got == {"high": T0 + dt.timedelta(days=1), "low": T0 + dt.timedelta(days=4)}


def test_series_longer_than_a_batch(spark):
    """Samplers carry their state over batches of rows, and a series' end isn't the next one's beginning."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"symbol": ["a"] * 700 + [None] * 300 + ["b"] * 3, "ts": pd.date_range("2020-01-01", periods=1003, freq="h")})
    pdf["x"] = rng.normal(0, 1, len(pdf))
    df = spark.createDataFrame(pdf, "symbol string, ts timestamp, x double").repartition(5)
    parts = {"a": pdf[:700], None: pdf[700:1000], "b": pdf[1000:]}
    want = lambda find: sorted(str((k, t.to_pydatetime())) for k, p in parts.items() for t in p["ts"].iloc[find(p["x"].to_numpy())])
    show = lambda out: sorted(str((r.symbol, r.ts)) for r in out.collect())
    limits = {"swt": 1.5, "cum": 3.0, "page_hinkley": 3.0, "cusum_ls": 3.0, "sprt": 2.0, "gma": 0.2, "glr": 5.0, "brandt_glr": 1.5, "e_detector": 1.05, "ssr_cusum": 3.0, "adaptive_cusum": 3.0, "aff": 0.2}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        for method, q in limits.items():
            assert show(sampling.sample_events(df, method, q, b2b=2)) == want(lambda x: sampling.sample_positions(method, x, np.full(len(x), q), 2)), method  # noqa: B023
        for method in ("cum", "swt"):
            assert show(sampling.raw_events(df, method, 1.5, b2b=2)) == want(lambda x: sampling.raw_positions(method, x, np.full(len(x), 1.5), 2)) != [], method  # noqa: B023
        tuned = sampling.tune_scales(df, ["cum"], 10).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert tuned and sorted(map(str, tuned)) == sorted(map(str, sampling.tune_scales(df, ["cum"], 10).collect()))


def test_a_sampler_sees_batches_not_series(spark):
    sizes = spark.sparkContext.accumulator(0)
    rows = spark.range(1000).selectExpr("'a' AS symbol", "timestamp_seconds(id) AS ts", "1D AS x")

    def begin():
        def feed(pdf):
            sizes.add(1)
            return pdf[["symbol"]].iloc[:1]

        return feed

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        assert order.passes(rows, ["symbol"], begin, "symbol string").count() == 10 == sizes.value
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
