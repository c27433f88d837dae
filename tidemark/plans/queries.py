"""Registered queries over the reference tables, and their DuckDB SQL.

Both sides round doubles alike, since sums come in another order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import detect as D
from tidemark.operators import dmd as K
from tidemark.operators import evaluate as E
from tidemark.operators import longrun as L
from tidemark.operators import research as R
from tidemark.operators import sampling as S
from tidemark.operators import structure as T
from tidemark.operators import vector as V
from tidemark.plans import bars as B
from tidemark.plans.asof import asof_backward

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = " ".join(sql.split())
        return f

    return register


def r(c: str | Column, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits)


# -- SQL building blocks -------------------------------------------------------

BARS = """bars AS (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
 min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS n FROM orders GROUP BY 1, 2)"""
SERIES = BARS + """, series AS (SELECT symbol, ts, ln(close) AS value, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM bars WHERE close > 0)"""
DIFFS = SERIES + """, diffs AS (SELECT symbol, ts, idx, value - lag(value) OVER (PARTITION BY symbol ORDER BY ts) AS x FROM series QUALIFY x IS NOT NULL),
 d AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM diffs)"""
TICKS = """ticks AS (SELECT event_type AS symbol, ts, value FROM events), dif AS (SELECT symbol, ts, value - lag(value) OVER (PARTITION BY symbol ORDER BY ts) AS x FROM ticks QUALIFY x IS NOT NULL),
 d AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM dif)"""
LABELLED = BARS + """, l0 AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS was FROM bars),
 l AS (SELECT *, CASE WHEN close > was * 1.2 THEN 'uptrend' WHEN close < was * 0.8 THEN 'downtrend' ELSE 'no_trend' END AS state FROM l0)"""


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return B.order_bars(spark, d)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Bars with a state that SQL can tell too."""
    was = F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))
    return _bars(spark, d).withColumn("was", was).withColumn(
        "state", F.when(F.col("close") > F.col("was") * 1.2, "uptrend").when(F.col("close") < F.col("was") * 0.8, "downtrend").otherwise("no_trend")
    )


@query(f"WITH {BARS} SELECT symbol, ts, open, high, low, close, n FROM bars")
def daily_bars(spark, d):
    return _bars(spark, d)


@query("""SELECT l_returnflag || l_linestatus AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, max(l_extendedprice) AS high, min(l_extendedprice) AS low, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def dense_bars(spark, d):
    return B.item_bars(spark, d).select("symbol", "ts", "high", "low", "n")


@query(f"""WITH {BARS}, daily AS (SELECT symbol, ts::DATE AS day, count(*) AS n FROM bars GROUP BY 1, 2), own AS (SELECT symbol, min(day) AS first_day, max(day) AS last_day, sum(n)::BIGINT AS n_rows, count(*) AS n_days FROM daily GROUP BY 1),
 cal AS (SELECT DISTINCT day FROM daily) SELECT own.*, (SELECT count(*) FROM cal WHERE cal.day BETWEEN own.first_day AND own.last_day) - n_days AS n_missing FROM own""")
def completeness(spark, d):
    return B.completeness(_bars(spark, d)).select("symbol", "first_day", "last_day", "n_rows", "n_days", "n_missing")


# -- detectors -----------------------------------------------------------------


CUSUM = f"""WITH RECURSIVE {DIFFS}, f AS (
   SELECT symbol, 0::BIGINT AS i, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, false AS fired, 0.0::DOUBLE AS score, 0 AS direction FROM (SELECT DISTINCT symbol FROM d)
   UNION ALL SELECT symbol, i, CASE WHEN fire THEN 0 ELSE a END, CASE WHEN fire THEN 0 ELSE b END, fire, greatest(a, b), CASE WHEN a >= b THEN 1 ELSE -1 END
   FROM (SELECT *, greatest(a, b) > 3.0 AS fire FROM (SELECT f.symbol, d.i, greatest(0, f.up + d.x - 0.00005) AS a, greatest(0, f.dn - d.x - 0.00005) AS b FROM f JOIN d ON d.symbol = f.symbol AND d.i = f.i + 1)))
 SELECT f.symbol, d.ts, d.idx, f.direction, round(f.score, 6) AS score FROM f JOIN d ON d.symbol = f.symbol AND d.i = f.i WHERE fired"""


def _running(a_expr: str, b_expr: str, limit: str, score: str, way: str, warm: int) -> str:
    """SQL of a detector with running mean and variance: sums a, b."""
    return f"""WITH RECURSIVE {DIFFS}, w AS (SELECT symbol, avg(x) AS mu, var_pop(x) AS var FROM d WHERE i <= {warm} GROUP BY symbol HAVING count(*) = {warm}), f AS (
   SELECT symbol, {warm}::BIGINT AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, mu, var, {warm}::BIGINT AS n, false AS fired, 0.0::DOUBLE AS score, 0 AS direction FROM w
   UNION ALL SELECT symbol, i, CASE WHEN fire THEN 0 ELSE na END, CASE WHEN fire THEN 0 ELSE nb END, CASE WHEN fire THEN x ELSE mu + (x - mu) / (n + 1) END,
     CASE WHEN fire THEN greatest(var, 1e-8) ELSE (n * var + (x - mu) * (x - (mu + (x - mu) / (n + 1)))) / (n + 1) END, CASE WHEN fire THEN 1 ELSE n + 1 END, fire, {score}, {way}
   FROM (SELECT *, {limit} AS fire FROM (SELECT *, {a_expr} AS na, {b_expr} AS nb FROM (SELECT f.symbol, d.i, f.a, f.b, f.mu, f.var, f.n, d.x, d.x - f.mu AS z, sqrt(greatest(f.var, 1e-8)) AS sigma FROM f JOIN d ON d.symbol = f.symbol AND d.i = f.i + 1))))
 SELECT f.symbol, d.ts, d.idx, f.direction, round(f.score, 6) AS score FROM f JOIN d ON d.symbol = f.symbol AND d.i = f.i WHERE fired"""


def _events(spark, d, method, q, **o) -> DataFrame:
    return D.detect(B.log_close(_bars(spark, d)), method, q, **o).select("symbol", "ts", "idx", "direction", r("score").alias("score"))


@query(CUSUM)
def cusum_events(spark, d):
    return _events(spark, d, "cusum", 100.0)


@query(CUSUM)
def cusum_events_native(spark, d):
    return D.cusum_fold(B.log_close(_bars(spark, d)), 100.0).select("symbol", "ts", "idx", "direction", r("score").alias("score"))


@query(CUSUM)
def cusum_events_blocks(spark, d):
    """One series over many tasks, in blocks of 500 bars."""
    return L.detect_long(B.log_close(_bars(spark, d)), q=100.0, size=500).select("symbol", "ts", "idx", "direction", r("score").alias("score"))


@query(_running(
    "greatest(0, a + z - 0.003)", "least(0, b + z + 0.003)", "greatest(na, -nb) > 5.0 * sigma", "greatest(na, -nb)",
    "CASE WHEN na >= -nb THEN 1 ELSE -1 END", 30
))
def cusum_ls_events(spark, d):
    return _events(spark, d, "cusum_ls", 1.0)


@query(_running("a + z", "0.0::DOUBLE", "abs(na) > 0.1 * 30.0 * sigma", "abs(na)", "CASE WHEN na > 0 THEN 1 ELSE -1 END", 20))
def sprt_events(spark, d):
    return _events(spark, d, "sprt", 0.1)


@query(_running("0.9 * a + (1 - 0.9) * z", "0.0::DOUBLE", "abs(na) > 0.2 * 2.0 * sigma", "abs(na)", "CASE WHEN na > 0 THEN 1 ELSE -1 END", 20))
def gma_events(spark, d):
    return _events(spark, d, "gma", 0.2)


def _rows_only(name: str, f) -> None:
    query(name=name)(f)


for _m, _q in (
    ("glr", 0.2), ("recursive_param_seg", 1.0), ("ssr_cusum", 0.2), ("adaptive_cusum", 0.2)
):
    _rows_only(f"{_m}_events", lambda spark, d, m=_m, q=_q: D.detect(B.log_close(_bars(spark, d)), m, q))
_rows_only("wbs_lepage_events", lambda spark, d: D.detect(B.log_close(_bars(spark, d)), "wbs_lepage", 0.5))

CONFIGS = [("cusum", 100.0), ("sprt", 0.1), ("cusum_ls", 1.0), ("gma", 0.3), ("shewhart", 0.05)]


# -- samplers ------------------------------------------------------------------


def _dif(spark, d) -> DataFrame:
    return B.increments(B.event_ticks(spark, d))


SWT = f"""WITH {TICKS}, m AS (SELECT *, abs(x - avg(x) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) > 30 AS over_ FROM d QUALIFY i > 20),
 g AS (SELECT *, sum(CASE WHEN over_ THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY i) AS island FROM m),
 p AS (SELECT *, row_number() OVER (PARTITION BY symbol, island, over_ ORDER BY i) AS place FROM g) SELECT symbol, ts FROM p WHERE over_ AND place % 2 = 0"""


@query(SWT)
def swt_events(spark, d):
    return S.sample_events(_dif(spark, d), "swt", 30.0, b2b=2).select("symbol", "ts")


@query(SWT)
def swt_events_native(spark, d):
    return S.sliding_window_events(_dif(spark, d), 30.0, b2b=2).select("symbol", "ts")


CUM = f"""WITH RECURSIVE {TICKS}, f AS (SELECT symbol, 0::BIGINT AS i, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, 0 AS run, false AS fired FROM (SELECT DISTINCT symbol FROM d)
  UNION ALL SELECT symbol, i, CASE WHEN fire THEN 0 ELSE a END, CASE WHEN fire THEN 0 ELSE b END, CASE WHEN fire THEN 0 WHEN hit THEN run + 1 ELSE 0 END, fire
  FROM (SELECT *, hit AND run + 1 >= 2 AS fire FROM (SELECT *, greatest(a, b) > 60 AS hit FROM (SELECT f.symbol, d.i, f.run, greatest(0, f.up + d.x) AS a, greatest(0, f.dn - d.x) AS b FROM f JOIN d ON d.symbol = f.symbol AND d.i = f.i + 1))))
  SELECT f.symbol, d.ts FROM f JOIN d ON d.symbol = f.symbol AND d.i = f.i WHERE fired"""


@query(CUM)
def cum_events(spark, d):
    return S.sample_events(_dif(spark, d), "cum", 60.0, b2b=2).select("symbol", "ts")


@query(CUM)
def cum_events_blocks(spark, d):
    return L.sample_long(_dif(spark, d), "cum", 60.0, b2b=2, size=500).select("symbol", "ts")


HINKLEY = f"""WITH RECURSIVE {TICKS}, e AS (SELECT *, avg(x) OVER (PARTITION BY symbol ORDER BY i) AS mean FROM d), f AS (SELECT symbol, 0::BIGINT AS i, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, false AS fired FROM (SELECT DISTINCT symbol FROM d)
  UNION ALL SELECT symbol, i, CASE WHEN fire THEN 0 ELSE a END, CASE WHEN fire THEN 0 ELSE b END, fire
  FROM (SELECT *, greatest(a, b) > 200 AND i >= 10 AS fire FROM (SELECT f.symbol, e.i, greatest(0, 0.9999 * f.up + (e.x - e.mean)) AS a, greatest(0, 0.9999 * f.dn + (e.mean - e.x)) AS b FROM f JOIN e ON e.symbol = f.symbol AND e.i = f.i + 1)))
  SELECT f.symbol, d.ts FROM f JOIN d ON d.symbol = f.symbol AND d.i = f.i WHERE fired"""


@query(HINKLEY)
def page_hinkley_events(spark, d):
    return S.sample_events(_dif(spark, d), "page_hinkley", 200.0).select("symbol", "ts")


@query(HINKLEY)
def page_hinkley_events_blocks(spark, d):
    return L.sample_long(_dif(spark, d), "page_hinkley", 200.0, size=500).select("symbol", "ts")


def _trailing(warm: int, a: str, b: str, stat: str, limit: float) -> str:
    return f"""WITH RECURSIVE {TICKS}, e AS (SELECT *, x - avg(x) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {warm} PRECEDING AND 1 PRECEDING) AS z FROM d), f AS (SELECT symbol, {warm}::BIGINT AS i, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, false AS fired FROM (SELECT DISTINCT symbol FROM d)
  UNION ALL SELECT symbol, i, CASE WHEN fire THEN 0 ELSE a END, CASE WHEN fire THEN 0 ELSE b END, fire
  FROM (SELECT *, {stat} > {limit} AS fire FROM (SELECT f.symbol, e.i, {a} AS a, {b} AS b FROM f JOIN e ON e.symbol = f.symbol AND e.i = f.i + 1)))
  SELECT f.symbol, d.ts FROM f JOIN d ON d.symbol = f.symbol AND d.i = f.i WHERE fired"""


@query(_trailing(30, "greatest(0, f.up + e.z)", "least(0, f.dn + e.z)", "greatest(a, -b)", 150))
def cusum_ls_samples(spark, d):
    return S.sample_events(_dif(spark, d), "cusum_ls", 150.0).select("symbol", "ts")


@query(_trailing(20, "f.up + e.z", "0.0::DOUBLE", "abs(a)", 150))
def sprt_samples(spark, d):
    return S.sample_events(_dif(spark, d), "sprt", 150.0).select("symbol", "ts")


@query(_trailing(20, "0.9 * f.up + (1.0 - 0.9) * e.z", "0.0::DOUBLE", "abs(a)", 9))
def gma_samples(spark, d):
    return S.sample_events(_dif(spark, d), "gma", 9.0).select("symbol", "ts")


for _m, _q in (("glr", 5.0), ("ssr_cusum", 3.0), ("adaptive_cusum", 3.0), ("aff", 5.0)):
    _rows_only(f"{_m}_samples", lambda spark, d, m=_m, q=_q: S.sample_events(_dif(spark, d), m, q))


@query(f"""WITH {TICKS}, a AS (SELECT *, CASE WHEN count(x) OVER w >= 32 THEN stddev_samp(x) OVER w END AS s1, CASE WHEN count(x) OVER u >= 8 THEN stddev_samp(x) OVER u END AS s2 FROM d
   WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 127 PRECEDING AND CURRENT ROW), u AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 b AS (SELECT *, coalesce(s1, s2) AS v FROM a), m AS (SELECT symbol, quantile_cont(abs(x), 0.5) AS mid FROM d GROUP BY 1),
 c AS (SELECT symbol, ts, x, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i), first_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM b)
 SELECT symbol, ts, round(greatest(v, mid * 0.001), 5) AS vol FROM c JOIN m USING (symbol)""")
def base_threshold(spark, d):
    return S.base_threshold(_dif(spark, d)).select("symbol", "ts", r("vol", 5).alias("vol"))


@query(f"""WITH {TICKS}, e AS (SELECT symbol, ts, CASE WHEN abs(x) > 20 THEN 'a' END AS a, CASE WHEN x > 10 THEN 'b' END AS b, CASE WHEN x < -10 THEN 'c' END AS c FROM d),
 s AS (SELECT symbol, ts, m FROM e UNPIVOT (m FOR k IN (a, b, c))), n AS (SELECT m, count(*) AS n FROM s GROUP BY 1), g AS (SELECT x.m AS a_method, y.m AS b_method, x.n AS nx, y.n AS ny FROM n x, n y),
 t AS (SELECT x.m AS a_method, y.m AS b_method, count(*) AS c FROM s x JOIN s y USING (symbol, ts) GROUP BY 1, 2) SELECT a_method, b_method, round(coalesce(c, 0) / (nx + ny - coalesce(c, 0)), 6) AS jaccard FROM g LEFT JOIN t USING (a_method, b_method)""")
def jaccard_matrix(spark, d):
    x = _dif(spark, d)
    sets = x.select(
        "symbol", "ts",
        F.explode(F.array_compact(F.array(F.when(F.abs("x") > 20, "a"), F.when(F.col("x") > 10, "b"), F.when(F.col("x") < -10, "c")))).alias("method")
    )
    return D.jaccard(sets, by=["method"]).select("a_method", "b_method", r("jaccard").alias("jaccard"))


@query()
def tuned_scales(spark, d):
    return S.tune_scales(_dif(spark, d), ["swt", "cum", "cusum_ls", "sprt", "gma"], target=200)


# -- market state and shape -----------------------------------------------------


def _state(spark, d) -> DataFrame:
    return T.market_state(_bars(spark, d), "cusum", 30.0)


def _shape(spark, d, **o) -> DataFrame:
    return T.shape_state(T.clean_bars(_bars(spark, d), log_price=True), method="cusum", q=30.0, **o)


_rows_only("market_state", _state)
_rows_only("core_state_vector", lambda s, d: T.core_vector(_state(s, d)))
_rows_only("shape_state", lambda s, d: _shape(s, d, n_lags=2, decay=0.5))
_rows_only("state_vector_scores", lambda s, d: V.rolling_scores(V.state_vector(_shape(s, d)), spread=False))
_rows_only(
    "state_vector_correlations", lambda s,
    d: V.correlations(V.standardise(V.state_vector(_shape(s, d)).filter("valid_state"), V.VARIABLES), V.VARIABLES)
)
for _k in (
    "trend_durations", "phase_duration_summary", "switch_counts", "transitions", "phase_transitions", "quality_summary", "terminal_quality",
    "point_intervals", "point_interval_summary", "position_returns_5", "trend_returns_5", "phase_returns_5"
):
    _rows_only(f"state_{_k}", lambda s, d, k=_k: E.evaluate(_state(s, d))[k])


@query(f"WITH {BARS} SELECT symbol, ts, round(lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts) / close - 1, 6) AS future_return_5 FROM bars")
def future_returns(spark, d):
    return E.future_return(_bars(spark, d), 5).select("symbol", "ts", r("future_return_5").alias("future_return_5"))


RUNS = LABELLED + """, c AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM l WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 g AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts)::BIGINT AS run FROM c), runs AS (SELECT symbol, run, first(state) AS state, min(ts) AS "start", max(ts) AS "end", count(*) AS bars FROM g GROUP BY 1, 2)"""


@query(f"WITH {RUNS} SELECT * FROM runs")
def durations(spark, d):
    return E.durations(_labelled(spark, d), "state")


@query(f"WITH {RUNS} SELECT state, count(*) AS count, round(avg(bars), 6) AS mean, quantile_cont(bars, 0.5)::DOUBLE AS median, min(bars) AS min, max(bars) AS max FROM runs GROUP BY 1")
def duration_summary(spark, d):
    return E.duration_summary(_labelled(spark, d), "state").select("state", "count", r("mean").alias("mean"), "median", "min", "max")


@query(f"WITH {RUNS} SELECT symbol, greatest(sum(new) - 1, 0)::BIGINT AS state_switch_count FROM g GROUP BY 1")
def switch_counts(spark, d):
    return E.switch_counts(_labelled(spark, d), ["state"])


@query(f"""WITH {LABELLED}, s AS (SELECT lag(state) OVER (PARTITION BY symbol ORDER BY ts) AS a, state AS b FROM l QUALIFY a IS NOT NULL), n AS (SELECT a, b, count(*) AS n FROM s GROUP BY 1, 2), t AS (SELECT a, sum(n) AS t FROM n GROUP BY 1)
 SELECT t.a AS "from", u.b AS "to", round(coalesce(n.n, 0) / t.t, 6) AS share FROM t CROSS JOIN (SELECT DISTINCT b FROM n) u LEFT JOIN n ON n.a = t.a AND n.b = u.b""")
def transition_matrix(spark, d):
    return E.transitions(_labelled(spark, d), "state").select("from", "to", r("share").alias("share"))


@query(f"""WITH {LABELLED}, p AS (SELECT *, (close - low) / nullif(high - low, 0) AS position, lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS v FROM l),
 b AS (SELECT CASE WHEN position <= 0 THEN 0 WHEN position <= .2 THEN 1 WHEN position <= .4 THEN 2 WHEN position <= .6 THEN 3 WHEN position <= .8 THEN 4 WHEN position <= 1 THEN 5 ELSE 6 END AS bucket, v FROM p WHERE position IS NOT NULL)
 SELECT k::INT AS bucket, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(quantile_cont(v, 0.5), 6) AS median, round(min(v), 6) AS min, round(max(v), 6) AS max FROM range(7) t(k) LEFT JOIN b ON b.bucket = t.k GROUP BY 1""")
def position_returns(spark, d):
    rows = E.future_return(_labelled(spark, d), 5, name="v").withColumn(
        "position", F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low"))
    )
    return E.position_returns(rows, "v").select("bucket", "count", *[r(c).alias(c) for c in ("mean", "std", "median", "min", "max")])


@query(f"""WITH {LABELLED}, p AS (SELECT state, lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS v FROM l)
 SELECT state, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(quantile_cont(v, 0.5), 6) AS median, round(min(v), 6) AS min, round(max(v), 6) AS max FROM p GROUP BY 1""")
def state_returns(spark, d):
    rows = E.future_return(_labelled(spark, d), 5, name="v")
    return E.summary(rows, ["state"], "v").select("state", "count", *[r(c).alias(c) for c in ("mean", "std", "median", "min", "max")])


# -- vector ---------------------------------------------------------------------

VARS = BARS + ", v AS (SELECT symbol, ts, close, ln(high) - ln(low) AS a, ln(close) AS b, CASE WHEN close > open THEN 1.0 ELSE 0.0 END AS c FROM bars)"


def _vars(spark, d) -> DataFrame:
    return _bars(spark, d).select(
        "symbol", "ts", "close", (F.ln("high") - F.ln("low")).alias("a"), F.ln("close").alias("b"),
        F.when(F.col("close") > F.col("open"), 1.0).otherwise(0.0).alias("c")
    )


@query(f"""WITH {VARS}, q AS (SELECT *, count(b) OVER w AS n, quantile_cont(b, 0.05) OVER w AS lo, quantile_cont(b, 0.95) OVER w AS hi FROM v WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING))
 SELECT symbol, ts, CASE WHEN n >= 100 AND abs(hi - lo) > 1e-12 THEN round(greatest(-1, least(1, 2 * (b - lo) / (hi - lo) - 1)), 6) END AS b_score, 2 * c - 1 AS c_score FROM q""")
def rolling_scores(spark, d):
    return V.rolling_scores(_vars(spark, d), ["b", "c"], window=200, binary=["c"]).select("symbol", "ts", r("b_score").alias("b_score"), "c_score")


@query(f"""WITH {VARS}, q AS (SELECT symbol, quantile_cont(b, 0.01) AS lo, quantile_cont(b, 0.99) AS hi FROM v GROUP BY 1), k AS (SELECT symbol, ts, greatest(least(b, hi), lo) AS b FROM v JOIN q USING (symbol)), m AS (SELECT symbol, avg(b) AS m, stddev_pop(b) AS s FROM k GROUP BY 1)
 SELECT symbol, ts, round((b - m) / s, 6) AS b FROM k JOIN m USING (symbol)""")
def standardised(spark, d):
    return V.standardise(_vars(spark, d), ["b"]).select("symbol", "ts", r("b").alias("b"))


@query(f"""WITH {VARS} SELECT 'a' AS a, 'b' AS b, round(corr(a, b), 6) AS corr FROM v UNION ALL SELECT 'b', 'a', round(corr(a, b), 6) FROM v UNION ALL SELECT 'a', 'a', 1.0 UNION ALL SELECT 'b', 'b', 1.0""")
def correlations(spark, d):
    return V.correlations(_vars(spark, d), ["a", "b"]).select("a", "b", r("corr").alias("corr"))


@query(f"""WITH {VARS} SELECT 'b' AS variable, count(b) AS count, round(avg(b), 6) AS mean, round(stddev_samp(b), 6) AS std, round(min(b), 6) AS min, round(quantile_cont(b, .01), 6) AS p01, round(quantile_cont(b, .05), 6) AS p05, round(quantile_cont(b, .5), 6) AS p50,
 round(quantile_cont(b, .95), 6) AS p95, round(quantile_cont(b, .99), 6) AS p99, round(max(b), 6) AS max FROM v""")
def description(spark, d):
    return V.describe(_vars(spark, d), ["b"]).select(
        "variable", "count", *[r(c).alias(c) for c in ("mean", "std", "min", "p01", "p05", "p50", "p95", "p99", "max")]
    )


# -- research ---------------------------------------------------------------------


@query(f"""WITH {VARS}, q AS (SELECT quantile_cont(a, 1/3) AS q1, quantile_cont(a, 2/3) AS q2, quantile_cont(b, 1/3) AS r1, quantile_cont(b, 2/3) AS r2 FROM v), g AS (SELECT CASE WHEN a <= q1 THEN 'low' WHEN a <= q2 THEN 'mid' ELSE 'high' END AS a_group, CASE WHEN b <= r1 THEN 'low' WHEN b <= r2 THEN 'mid' ELSE 'high' END AS b_group FROM v, q)
 SELECT a_group, b_group, CASE WHEN b_group = 'low' AND a_group = 'high' THEN 'second' WHEN a_group = 'high' THEN 'first' ELSE 'other' END AS label, count(*) AS n FROM g GROUP BY 1, 2, 3""")
def tertiles_and_labels(spark, d):
    rows = R.with_tertiles(_vars(spark, d), ["a", "b"])
    label = R.composite_state([("first", {"a": "high"}), ("second", {"a": "high", "b": "low"})])
    return rows.groupBy("a_group", "b_group", label.alias("label")).agg(F.count("*").alias("n"))


@query(f"""WITH {BARS} SELECT symbol, ts, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY md5('42|' || symbol || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S')), symbol, ts) <= 50""")
def stratified_sample(spark, d):
    return R.stratified_sample(_bars(spark, d), ["symbol"], 50).select("symbol", "ts", "close")


@query(f"""WITH {BARS}, p AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM bars), e AS (SELECT symbol || '_' || idx AS window_id, symbol, idx FROM p WHERE idx % 100 = 99)
 SELECT e.window_id, row_number() OVER (PARTITION BY e.window_id ORDER BY p.idx)::INT AS t, p.symbol, p.ts, round(ln(p.close), 6) AS log_close FROM e JOIN p ON p.symbol = e.symbol AND p.idx BETWEEN e.idx - 59 AND e.idx""")
def trailing_windows(spark, d):
    bars = _bars(spark, d)
    idx = bars.withColumn("idx", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1).filter("idx % 100 = 99")
    ends = idx.select(F.concat_ws("_", "symbol", F.col("idx").cast("string")).alias("window_id"), "symbol", "ts")
    return R.trailing_windows(bars, ends).select("window_id", "t", "symbol", "ts", r("log_close").alias("log_close"))


@query(f"""WITH {BARS}, p AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM bars)
 SELECT e.symbol || '_' || e.idx AS window_id, row_number() OVER (PARTITION BY e.symbol, e.idx ORDER BY p.idx)::INT AS t, p.symbol, p.ts, round(ln(p.close), 6) AS log_close FROM p e JOIN p ON p.symbol = e.symbol AND p.idx BETWEEN e.idx - 59 AND e.idx WHERE e.idx >= 59""")
def trailing_windows_all(spark, d):
    """A window for every bar that has enough before it."""
    bars = _bars(spark, d)
    idx = bars.withColumn("idx", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1)
    ends = idx.select(F.concat_ws("_", "symbol", F.col("idx").cast("string")).alias("window_id"), "symbol", "ts")
    return R.trailing_windows(bars, ends).select("window_id", "t", "symbol", "ts", r("log_close").alias("log_close"))


@query(f"""WITH {VARS}, s AS (SELECT symbol, ts, b, b - lag(b) OVER w AS ret, lead(b, 5) OVER w - b AS f FROM v WINDOW w AS (PARTITION BY symbol ORDER BY ts))
 SELECT symbol, ts, round(f, 6) AS return_k5, CASE WHEN count(ret) OVER k = 5 THEN round(stddev_pop(ret) OVER k, 6) END AS vol_k5 FROM s WINDOW k AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""")
def future_targets(spark, d):
    rows = R.future_targets(_bars(spark, d).withColumn("close", F.ln("close")), [5], [5])
    return rows.select("symbol", "ts", r("return_k5").alias("return_k5"), r("vol_k5").alias("vol_k5"))


@query(f"""WITH {VARS}, q AS (SELECT quantile_cont(b, 0.01) AS lo, quantile_cont(b, 0.99) AS hi FROM v) SELECT symbol, ts, round(greatest(least(b, hi), lo), 6) AS b FROM v, q""")
def winsorised(spark, d):
    return R.winsorise(_vars(spark, d), ["b"]).select("symbol", "ts", r("b").alias("b"))


@query(f"""WITH {BARS}, o AS (SELECT symbol, ts, close, row_number() OVER (ORDER BY close, symbol, ts) - 1 AS i, count(*) OVER () AS n FROM bars) SELECT symbol, ts, close FROM o WHERE n <= 500 OR i IN (SELECT floor(j * ((SELECT count(*) FROM bars) - 1) / 499.0)::BIGINT FROM range(500) t(j))""")
def even_subsample(spark, d):
    return R.even_subsample(_bars(spark, d), "close", 500).select("symbol", "ts", "close")


@query(f"WITH {VARS} SELECT c AS x, round(avg(b), 6) AS y FROM v GROUP BY 1")
def collapsed_means(spark, d):
    return R.collapse_few(_vars(spark, d), "c", "b").select(F.col("c").alias("x"), r("b").alias("y"))


_rows_only("rolling_adf", lambda s, d: R.rolling_adf(_vars(s, d), ["a", "b"]))
_rows_only("adf_by_state", lambda s, d: R.adf_by_state(R.rolling_adf(_vars(s, d), ["a", "b"]), ["a", "b"]))


def explosive_ends(vectors: DataFrame, per_group: int = 120, per_state: int = 150) -> DataFrame:
    """window_id, symbol, ts: sampled rows of each third of each state variable,
    and of each composite state."""
    rows = R.with_tertiles(vectors.filter("valid_state"), V.VARIABLES).withColumn("composite", R.composite_state())
    names = [F.struct(F.lit(v).alias("state_variable"), F.col(f"{v}_group").alias("state_group")) for v in V.VARIABLES]
    named = rows.select(
        "symbol", "ts",
        F.explode(F.array(*names, F.struct(F.lit("composite").alias("state_variable"), F.col("composite").alias("state_group")))).alias("z")
    ).select("symbol", "ts", "z.*").filter("state_group IS NOT NULL")
    stratum = ["state_variable", "state_group"]
    composite = F.col("state_variable") == "composite"
    ends = [
        R.stratified_sample(named.filter(c), stratum, n, key=(*stratum, "symbol", "ts")) for c,
        n in ((~composite, per_group), (composite & (F.col("state_group") != "other"), per_state))
    ]
    return ends[0].unionByName(ends[1]).select(F.concat_ws("_", *stratum, "symbol", F.col("ts").cast("string")).alias("window_id"), "symbol", "ts")


@query()
def explosiveness(spark, d):
    return R.explosiveness(R.trailing_windows(_bars(spark, d), explosive_ends(V.state_vector(_shape(spark, d)))))


@query()
def local_regression(spark, d):
    rows = R.future_targets(_vars(spark, d).withColumn("close", F.col("b")), [5], [])
    return R.lowess(rows, ["a", "c"], ["return_k5"])


# -- swing events -------------------------------------------------------------------

PRICES = BARS + """, p0 AS (SELECT symbol, ts, ln(close) AS lc, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_index FROM bars WHERE close > 0), p1 AS (SELECT *, lc - lag(lc) OVER (PARTITION BY symbol ORDER BY ts) AS lr FROM p0),
 prices AS (SELECT symbol, ts, bar_index, lc AS log_close, lr AS log_return, CASE WHEN count(lr) OVER w >= 10 THEN stddev_samp(lr) OVER w END AS hist_vol FROM p1 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {PRICES} SELECT symbol, ts, bar_index, round(log_close, 6) AS log_close, round(log_return, 6) AS log_return, round(hist_vol, 6) AS hist_vol FROM prices")
def price_table(spark, d):
    return K.price_table(_bars(spark, d)).select("symbol", "ts", "bar_index", *[r(c).alias(c) for c in ("log_close", "log_return", "hist_vol")])


@query(f"""WITH {PRICES}, q AS (SELECT symbol, ts + INTERVAL 12 HOUR AS ts FROM bars WHERE day(ts) = 15 UNION ALL SELECT '1-URGENT', TIMESTAMP '1990-01-01') SELECT q.symbol, q.ts, prices.bar_index FROM q ASOF LEFT JOIN prices ON q.symbol = prices.symbol AND q.ts >= prices.ts""")
def asof_join(spark, d):
    bars = _bars(spark, d)
    ask = bars.filter(F.dayofmonth("ts") == 15).select("symbol", (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("ts"))
    ask = ask.unionByName(spark.range(1).select(F.lit("1-URGENT").alias("symbol"), F.to_timestamp(F.lit("1990-01-01")).alias("ts")))
    return asof_backward(ask, K.price_table(bars), ["bar_index"])


@query(f"""WITH {PRICES}, q AS (SELECT symbol, ts + INTERVAL 12 HOUR AS ts FROM bars UNION ALL SELECT '1-URGENT', TIMESTAMP '1990-01-01') SELECT q.symbol, q.ts, prices.bar_index FROM q ASOF LEFT JOIN prices ON q.symbol = prices.symbol AND q.ts >= prices.ts""")
def asof_join_all(spark, d):
    """Every bar asks."""
    bars = _bars(spark, d)
    ask = bars.select("symbol", (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("ts"))
    ask = ask.unionByName(spark.range(1).select(F.lit("1-URGENT").alias("symbol"), F.to_timestamp(F.lit("1990-01-01")).alias("ts")))
    return asof_backward(ask, K.price_table(bars), ["bar_index"])


@query(f"""WITH {VARS}, m AS (SELECT symbol, quantile_cont(b, .5) AS m FROM v GROUP BY 1), x AS (SELECT symbol, quantile_cont(abs(b - m), .5) AS mad FROM v JOIN m USING (symbol) GROUP BY 1) SELECT symbol, ts, round((b - m) / mad, 6) AS z FROM v JOIN m USING (symbol) JOIN x USING (symbol)""")
def robust_scores(spark, d):
    return K.robust_standardise(_vars(spark, d), "b", "z").select("symbol", "ts", r("z").alias("z"))


def _observable(spark, d) -> DataFrame:
    return K.observable(K.extreme_events(_state(spark, d)), _bars(spark, d))


_rows_only("swing_events", lambda s, d: K.extreme_events(_state(s, d)))
_rows_only("swing_observable", _observable)
_rows_only("delay_spectrum", lambda s, d: K.eigen_table(K.spectrum(_observable(s, d), 5, 20, 3)))
_rows_only("delay_singular_values", lambda s, d: K.singular_table(K.spectrum(_observable(s, d), 5, 20, 3)))
_rows_only("delay_forecast_errors", lambda s, d: K.forecast_errors(K.rolling_forecasts(_observable(s, d), 5, 20, 3, spread=False)))
