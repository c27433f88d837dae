"""Queries whose inputs SQL can tell as well as Spark: operators on the state
machine's, the decomposition's and the tests' results run here on tables made of
the daily bars by plain rules, and are compared with DuckDB value by value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.tables import register
from tidemark.operators import detect as D
from tidemark.operators import dmd as K
from tidemark.operators import evaluate as E
from tidemark.operators import research as R
from tidemark.operators import sampling as S
from tidemark.operators import structure as T
from tidemark.operators import vector as V
from tidemark.plans import bars as B
from tidemark.plans.queries import BARS, CONFIGS, CUSUM, LABELLED, PRICES, SERIES, SQL, TICKS, VARS, _bars, _dif, _events, _labelled, _running, _shape, _vars, query, r

# -- detectors -------------------------------------------------------------------

LEVELS = SERIES + """, y AS (SELECT symbol, ts, idx, value, idx + 1 AS i, coalesce(sum(value) OVER b, 0) AS p0, coalesce(sum(value * value) OVER b, 0) AS q0,
   coalesce(sum(value) OVER t, 0) AS p10, coalesce(sum(value * value) OVER t, 0) AS q10, sum(value) OVER l AS inside, avg(value) OVER w AS m24, stddev_samp(value) OVER w AS s24 FROM series
   WINDOW b AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 10 PRECEDING),
   l AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""

# a window of ten against all that left it since the segment's first point: sums by difference of prefix sums
BRANDT = f"""WITH RECURSIVE {LEVELS}, f AS (SELECT symbol, 0::BIGINT AS i, 1::BIGINT AS start, 0.0::DOUBLE AS ps, 0.0::DOUBLE AS qs, false AS fired, 0 AS direction, 0.0::DOUBLE AS score FROM (SELECT DISTINCT symbol FROM y)
  UNION ALL SELECT symbol, i, CASE WHEN fire THEN i ELSE start END, CASE WHEN fire THEN p0 ELSE ps END, CASE WHEN fire THEN q0 ELSE qs END, fire, CASE WHEN gap >= 0 THEN 1 ELSE -1 END, stat
  FROM (SELECT *, coalesce(n >= 5 AND abs(var) > 0 AND stat > LIMIT_, false) AS fire FROM (SELECT *, 10 * gap * gap / nullif(var, 0) AS stat FROM (SELECT *, inside / 10 - mean AS gap, (s2 - s * mean) / greatest(n - 1, 1) AS var
   FROM (SELECT *, s / nullif(n, 0) AS mean FROM (SELECT f.symbol, y.i, f.start, f.ps, f.qs, y.p0, y.q0, y.inside, y.i - f.start + 1 - 10 AS n, y.p10 - f.ps AS s, y.q10 - f.qs AS s2 FROM f JOIN y ON y.symbol = f.symbol AND y.i = f.i + 1))))))
  SELECT f.symbol, y.ts, y.idx, f.direction, round(f.score, 4) AS score FROM f JOIN y ON y.symbol = f.symbol AND y.i = f.i WHERE fired""".replace("LIMIT_", "15.136705226623396 * 10 * 0.2")


@query(BRANDT)
def brandt_glr_events(spark, d):
    return D.detect(B.log_close(_bars(spark, d)), "brandt_glr", 0.2).select("symbol", "ts", "idx", "direction", r("score", 4).alias("score"))


SHEWHART = f"""WITH RECURSIVE {LEVELS}, f AS (SELECT symbol, 0::BIGINT AS i, 1::BIGINT AS start, 0 AS run, NULL::DOUBLE AS m, NULL::DOUBLE AS sd, false AS fired, 0 AS direction, 0.0::DOUBLE AS score FROM (SELECT DISTINCT symbol FROM y)
  UNION ALL SELECT symbol, i, CASE WHEN fire THEN i - 4 ELSE start END, CASE WHEN fire THEN 0 WHEN out_ THEN run + 1 ELSE 0 END, m, sd, fire, CASE WHEN value >= m THEN 1 ELSE -1 END, abs(value - m) / greatest(sd, 1e-8)
  FROM (SELECT *, out_ AND run + 1 >= 5 AS fire FROM (SELECT *, n > 24 AND coalesce(abs(value - m) > 0.05 * 10.0 * sd, false) AS out_ FROM (SELECT f.symbol, y.i, f.start, f.run, y.value, y.i - f.start + 1 AS n,
   CASE WHEN y.i - f.start + 1 = 24 THEN y.m24 ELSE f.m END AS m, CASE WHEN y.i - f.start + 1 = 24 THEN y.s24 ELSE f.sd END AS sd FROM f JOIN y ON y.symbol = f.symbol AND y.i = f.i + 1))))
  SELECT f.symbol, y.ts, y.idx, f.direction, round(f.score, 6) AS score FROM f JOIN y ON y.symbol = f.symbol AND y.i = f.i WHERE fired"""


@query(SHEWHART)
def shewhart_events(spark, d):
    return _events(spark, d, "shewhart", 0.05)


BETS = "list_value(-0.1::DOUBLE, -0.05, -0.02, -0.01, 0.01, 0.02, 0.05, 0.1)"


def _wagers(tables: str, epsilon: str, limit: str) -> str:
    return f"""{tables}, z AS (SELECT *, greatest(-5.0, least(5.0, x / (stddev_samp(x) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) + {epsilon}))) AS z FROM d), f AS (
   SELECT symbol, 50::BIGINT AS i, list_value(1.0::DOUBLE, 1, 1, 1, 1, 1, 1, 1) AS caps, false AS fired, 0.0::DOUBLE AS score, 0.0::DOUBLE AS best FROM (SELECT DISTINCT symbol FROM d)
   UNION ALL SELECT symbol, i, CASE WHEN mean > {limit} THEN list_value(1.0::DOUBLE, 1, 1, 1, 1, 1, 1, 1) ELSE caps END, mean > {limit}, mean, list_extract({BETS}, list_position(caps, list_max(caps)))
   FROM (SELECT *, list_sum(caps) / 8 AS mean FROM (SELECT f.symbol, z.i, list_transform(range(1, 9), lambda k: exp(list_extract({BETS}, k) * z.z - 0.5 * list_extract({BETS}, k) ** 2) * greatest(list_extract(f.caps, k), 1.0)) AS caps FROM f JOIN z ON z.symbol = f.symbol AND z.i = f.i + 1)))"""


@query(f"""WITH RECURSIVE {_wagers(SERIES + ''', diffs AS (SELECT symbol, ts, idx, value - lag(value) OVER (PARTITION BY symbol ORDER BY ts) AS x FROM series QUALIFY x IS NOT NULL), d AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM diffs)''', '1e-8', 'exp(0.05)')}
  SELECT f.symbol, d.ts, d.idx, CASE WHEN f.best > 0 THEN 1 ELSE -1 END AS direction, round(f.score, 6) AS score FROM f JOIN d ON d.symbol = f.symbol AND d.i = f.i WHERE fired""")
def e_detector_events(spark, d):
    return _events(spark, d, "e_detector", 0.05)


@query(f"WITH RECURSIVE {_wagers(TICKS, '1e-12', '1.05')} SELECT f.symbol, d.ts FROM f JOIN d ON d.symbol = f.symbol AND d.i = f.i WHERE fired")
def e_detector_samples(spark, d):
    return S.sample_events(_dif(spark, d), "e_detector", 1.05).select("symbol", "ts")


@query(f"""WITH RECURSIVE {TICKS}, y AS (SELECT symbol, ts, i, coalesce(sum(x) OVER b, 0) AS p0, coalesce(sum(x * x) OVER b, 0) AS q0, coalesce(sum(x) OVER t, 0) AS p20, coalesce(sum(x * x) OVER t, 0) AS q20, sum(x) OVER l AS inside FROM d
   WINDOW b AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 20 PRECEDING), l AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
  f AS (SELECT symbol, 0::BIGINT AS i, 1::BIGINT AS start, 0.0::DOUBLE AS ps, 0.0::DOUBLE AS qs, false AS fired FROM (SELECT DISTINCT symbol FROM y)
  UNION ALL SELECT symbol, i, CASE WHEN fire THEN i ELSE start END, CASE WHEN fire THEN p0 ELSE ps END, CASE WHEN fire THEN q0 ELSE qs END, fire
  FROM (SELECT *, coalesce(n >= 5 AND var > 1e-12 AND 20 * gap * gap / nullif(var, 0) > 1.5, false) AS fire FROM (SELECT *, inside / 20 - mean AS gap, (s2 - s * mean) / greatest(n - 1, 1) AS var FROM (SELECT *, s / nullif(n, 0) AS mean
   FROM (SELECT f.symbol, y.i, f.start, f.ps, f.qs, y.p0, y.q0, y.inside, y.i - f.start + 1 - 20 AS n, y.p20 - f.ps AS s, y.q20 - f.qs AS s2 FROM f JOIN y ON y.symbol = f.symbol AND y.i = f.i + 1)))))
  SELECT f.symbol, y.ts FROM f JOIN y ON y.symbol = f.symbol AND y.i = f.i WHERE fired""")
def brandt_glr_samples(spark, d):
    return S.sample_events(_dif(spark, d), "brandt_glr", 1.5).select("symbol", "ts")


_GMA = _running("0.9 * a + (1 - 0.9) * z", "0.0::DOUBLE", "abs(na) > 0.3 * 2.0 * sigma", "abs(na)", "CASE WHEN na > 0 THEN 1 ELSE -1 END", 20)
_SPRT = _running("a + z", "0.0::DOUBLE", "abs(na) > 0.1 * 30.0 * sigma", "abs(na)", "CASE WHEN na > 0 THEN 1 ELSE -1 END", 20)
_LS = _running(
    "greatest(0, a + z - 0.003)", "least(0, b + z + 0.003)", "greatest(na, -nb) > 5.0 * sigma", "greatest(na, -nb)",
    "CASE WHEN na >= -nb THEN 1 ELSE -1 END", 30
)
#: Events of the five configurations, and their table (the last one never fires).
SETS = "c(method, q) AS (VALUES ('cusum', 100.0::DOUBLE), ('sprt', 0.1), ('cusum_ls', 1.0), ('gma', 0.3), ('shewhart', 0.05), ('cusum', 1e9)), e AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS method, {q}::DOUBLE AS q, symbol, ts FROM ({sql})" for m, q, sql in (
        ("cusum", 100.0, CUSUM), ("sprt", 0.1, _SPRT), ("cusum_ls", 1.0, _LS), ("gma", 0.3, _GMA), ("shewhart", 0.05, SHEWHART)
    )
) + ")"
SILENT = [*CONFIGS, ("cusum", 1e9)]


#: Detectors by name: parameter, digits of the score that both sides show, SQL.
IN_SQL = {
    "cusum": (100.0, 6, CUSUM), "cusum_ls": (1.0, 6, _LS), "sprt": (0.1, 6, _SPRT), "gma": (0.3, 6, _GMA), "brandt_glr": (0.2, 4, BRANDT),
    "shewhart": (0.05, 6, SHEWHART), "e_detector": (0.05, 6, SQL["e_detector_events"]),
}


@query(" UNION ALL ".join(f"SELECT '{m}' AS method, symbol, ts, idx, direction, score FROM ({sql})" for m, (_, _, sql) in IN_SQL.items()))
def detect_udtf(spark, d):
    """Seven detectors by the table function, in SQL text."""
    register(spark, "detect")
    B.log_close(_bars(spark, d)).createOrReplaceTempView("detect_udtf_series")
    call = "detect(TABLE(detect_udtf_series) PARTITION BY symbol ORDER BY (ts), '{m}', {q:e})"
    return spark.sql(" UNION ALL ".join(
        f"SELECT '{m}' AS method, symbol, ts, idx, direction, round(score, {digits}) AS score FROM {call.format(m=m, q=q)}" for m, (q, digits, _) in IN_SQL.items()
    ))


@query(" UNION ALL ".join(f"SELECT '{m}' AS method, symbol, ts FROM ({SQL[f'{m}_{end}']})" for m, end in (("swt", "events"), ("cum", "events"), ("page_hinkley", "events"), ("cusum_ls", "samples"), ("sprt", "samples"), ("gma", "samples"), ("e_detector", "samples"), ("brandt_glr", "samples"))))
def sample_udtf(spark, d):
    """Eight samplers by the table function, in SQL text and one pass."""
    register(spark, "sample_many")
    _dif(spark, d).createOrReplaceTempView("sample_udtf_dif")
    methods = "swt 30 2, cum 60 2, page_hinkley 200, cusum_ls 150, sprt 150, gma 9, e_detector 1.05, brandt_glr 1.5"
    return spark.sql(f"SELECT method, symbol, ts FROM sample_many(TABLE(sample_udtf_dif) PARTITION BY symbol ORDER BY (ts), '{methods}')")


@query(f"WITH {SETS} SELECT c.method, c.q, count(e.ts) AS n_events FROM c LEFT JOIN e USING (method, q) WHERE c.q < 1e9 GROUP BY 1, 2")
def detector_counts(spark, d):
    return D.event_counts(D.detect_many(B.log_close(_bars(spark, d)), CONFIGS), CONFIGS)


@query(f"""WITH {SETS}, n AS (SELECT c.method, c.q, count(e.ts) AS n FROM c LEFT JOIN e USING (method, q) GROUP BY 1, 2), t AS (SELECT x.method AS m1, x.q AS q1, y.method AS m2, y.q AS q2, count(*) AS b FROM e x JOIN e y USING (symbol, ts) GROUP BY ALL)
 SELECT x.method AS a_method, x.q AS a_q, y.method AS b_method, y.q AS b_q, round(CASE WHEN x.n + y.n = 0 THEN 1.0 ELSE coalesce(b, 0) / (x.n + y.n - coalesce(b, 0)) END, 6) AS jaccard FROM n x CROSS JOIN n y LEFT JOIN t ON x.method = m1 AND x.q = q1 AND y.method = m2 AND y.q = q2""")
def detector_comparison(spark, d):
    """Jaccard similarity of the events of five detectors and a silent one."""
    out = D.jaccard(D.detect_many(B.log_close(_bars(spark, d)), SILENT), configs=SILENT)
    return out.select("a_method", "a_q", "b_method", "b_q", r("jaccard").alias("jaccard"))


# -- states that SQL can tell -------------------------------------------------------

TOLD = LABELLED + """, t0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM l), told AS (SELECT symbol, ts, idx, open, high, low, close, state AS current_trend, close / was - 1 AS trend_dynamic,
   (idx % 7)::DOUBLE AS trend_lifetime_movements, CASE WHEN idx % 3 > 0 THEN (idx % 11)::DOUBLE END AS trend_lifetime_bars_since_point3, idx - idx % 10 AS point2_idx, CASE WHEN idx % 10 >= 3 THEN idx - idx % 13 END AS point3_idx FROM t0)"""


def _indexed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1)


def _told(spark, d) -> DataFrame:
    rows, i = _indexed(_labelled(spark, d)), F.col("idx")
    return rows.withColumns({
        "current_trend": F.col("state"), "trend_dynamic": F.col("close") / F.col("was") - 1, "trend_lifetime_movements": (i % 7).cast("double"), "trend_lifetime_bars_since_point3": F.when(i % 3 > 0, (i % 11).cast("double")),
        "point2_idx": i - i % 10, "point3_idx": F.when(i % 10 >= 3, i - i % 13),
    })


@query(f"""WITH {TOLD}, u AS (SELECT current_trend, metric, value FROM (SELECT current_trend, trend_dynamic, trend_lifetime_movements, trend_lifetime_bars_since_point3 FROM told WHERE current_trend <> 'no_trend') UNPIVOT INCLUDE NULLS (value FOR metric IN (trend_dynamic, trend_lifetime_movements, trend_lifetime_bars_since_point3)))
 SELECT current_trend, metric, count(value) AS count, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max FROM u GROUP BY 1, 2""")
def told_quality_summary(spark, d):
    return E.quality_summary(_told(spark, d)).select("current_trend", "metric", "count", *[r(c).alias(c) for c in ("mean", "median", "min", "max")])


@query(f"""WITH {TOLD}, c AS (SELECT *, CASE WHEN current_trend IS DISTINCT FROM lag(current_trend) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM told WINDOW w AS (PARTITION BY symbol ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts)::BIGINT AS run FROM c)
 SELECT symbol, run, first(current_trend) AS current_trend, min(ts) AS "start", max(ts) AS "end", count(*) AS bars, round(arg_max(trend_dynamic, ts) FILTER (trend_dynamic IS NOT NULL), 6) AS terminal_dynamic, arg_max(trend_lifetime_movements, ts) AS terminal_lifetime_movements,
 arg_max(trend_lifetime_bars_since_point3, ts) FILTER (trend_lifetime_bars_since_point3 IS NOT NULL) AS terminal_lifetime_bars_since_point3 FROM g WHERE current_trend <> 'no_trend' GROUP BY 1, 2""")
def told_terminal_quality(spark, d):
    return E.terminal_quality(_told(spark, d)).withColumn("terminal_dynamic", r("terminal_dynamic"))


@query(f"""WITH {TOLD}, p AS (SELECT symbol, current_trend, point2_idx, point3_idx FROM told WHERE point3_idx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, point2_idx, point3_idx ORDER BY ts DESC) = 1)
 SELECT p.*, a.ts AS point2_ts, b.ts AS point3_ts, p.point3_idx - p.point2_idx AS bars FROM p JOIN told a ON a.symbol = p.symbol AND a.idx = p.point2_idx JOIN told b ON b.symbol = p.symbol AND b.idx = p.point3_idx WHERE p.point3_idx >= p.point2_idx""")
def told_point_intervals(spark, d):
    return E.point_intervals(_told(spark, d))


@query(f"""WITH {TOLD} SELECT symbol, ts AS timestamp, current_trend, CASE WHEN idx % 2 = 0 THEN 'even' ELSE 'odd' END AS current_phase, idx % 6 AS position, round((close - open) / nullif(close, 0), 6) AS dist_point2_pct, CASE WHEN idx % 4 > 0 THEN round((high - close) / nullif(close, 0), 6) END AS dist_point3_pct, idx % 5 AS time_since_last_cpd FROM told""")
def told_core_vector(spark, d):
    i = F.col("idx")
    rows = _told(spark, d).withColumns({
        "timestamp": F.col("ts"), "Close": F.col("close"), "current_phase": F.when(i % 2 == 0, "even").otherwise("odd"), "position": i % 6,
        "time_since_last_cpd": i % 5
    })
    rows = rows.withColumns({
        "distance_to_point2": F.col("close") - F.col("open"),
        "distance_to_point3": F.when(i % 4 > 0, F.col("high") - F.col("close")).otherwise(F.lit(float("nan")))
    })
    return T.core_vector(rows).withColumns({c: r(c) for c in ("dist_point2_pct", "dist_point3_pct")})


# -- shape features ------------------------------------------------------------------

POINTS = BARS + """, i0 AS (SELECT *, row_number() OVER w - 1 AS idx, lag(high, 8) OVER w AS h1, lag(high, 3) OVER w AS h2, lag(low, 6) OVER w AS l1, lag(low, 2) OVER w AS l2 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 p AS (SELECT symbol, ts, idx, open, high, low, close, h1, CASE WHEN h1 > 0 THEN h2 END AS h2, CASE WHEN h1 > 0 THEN l1 END AS l1, CASE WHEN h1 > 0 THEN l2 END AS l2, CASE WHEN idx % 9 > 0 THEN 2.0 ELSE 0.0 END AS gap FROM i0),
 f AS (SELECT symbol, ts, idx, close, h1 IS NOT NULL AS has_structural_window, CASE WHEN h1 > 0 THEN (idx % 2 = 0)::INT::DOUBLE END AS starts_high, h1 AS high1, h2 AS high2, l1 AS low1, l2 AS low2, h2 - h1 AS high_change, l2 - l1 AS low_change, h2 - h1 - (l2 - l1) AS expansion,
   CASE WHEN abs(greatest(h1, h2) - least(l1, l2)) >= 1e-12 AND h1 > 0 THEN (close - least(l1, l2)) / (greatest(h1, h2) - least(l1, l2)) END AS range_pos, CASE WHEN h1 > 0 THEN (close > h1 + (h2 - h1) / 5 * 8)::INT::DOUBLE END AS upper_break, CASE WHEN h1 > 0 THEN (close < l1 + (l2 - l1) / 4 * 6)::INT::DOUBLE END AS lower_break,
   h2 - h1 + l2 - l1 AS structure_dir, CASE WHEN h1 > 0 THEN greatest(h1, h2) - least(l1, l2) END AS range_pct, h2 - l2 AS last_width_pct, CASE WHEN gap > 0 AND h1 > 0 THEN 2 / gap END AS move_age, abs(h2 - h1) / 5 AS high_speed, abs(l2 - l1) / 4 AS low_speed, CASE WHEN h1 > 0 THEN 4.0 / 6 END AS extrema_freq FROM p)"""
FEATURES = [
    "starts_high", "high1", "high2", "low1", "low2", "high_change", "low_change", "expansion", "range_pos", "upper_break", "lower_break",
    "structure_dir", "range_pct", "last_width_pct", "move_age", "high_speed", "low_speed", "extrema_freq"
]


def _shaped(spark, d) -> DataFrame:
    rows, w, i = _indexed(_bars(spark, d)), Window.partitionBy("symbol").orderBy("ts"), F.col("idx")
    known = F.lag("high", 8).over(w).isNotNull()
    when = lambda c: F.when(known, c)
    at = {
        "h1": F.lag("high", 8).over(w), "h2": when(F.lag("high", 3).over(w)), "l1": when(F.lag("low", 6).over(w)),
        "l2": when(F.lag("low", 2).over(w)), "first_high": when(i % 2 == 0)
    }
    at |= {f"{c}_idx": when(i - n) for c, n in (("h1", 8), ("h2", 3), ("l1", 6), ("l2", 2), ("e0", 8), ("e3", 2))}
    return T.with_features(rows.withColumns(at).withColumn("median_gap", when(F.when(i % 9 > 0, 2.0).otherwise(0.0))))


@query(f"WITH {POINTS} SELECT symbol, ts, has_structural_window, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES)} FROM f")
def told_shape_features(spark, d):
    return _shaped(spark, d).select("symbol", "ts", "has_structural_window", *[r(c).alias(c) for c in FEATURES])


@query(f"""WITH {POINTS}, s AS (SELECT *, high_speed - low_speed AS speed_imbalance, high_speed + low_speed AS speed_level FROM f) SELECT symbol, ts, close, has_structural_window, starts_high, high1, high2, low1, low2, {', '.join(f'round({c}, 6) AS {c}' for c in V.VARIABLES)},
 {' AND '.join(f'{c} IS NOT NULL' for c in V.VARIABLES)} AS valid_state FROM s""")
def told_state_vector(spark, d):
    return V.state_vector(_shaped(spark, d)).withColumns({c: r(c) for c in V.VARIABLES})


_LAGS = ", ".join(f"round(CASE WHEN f2.n > {k} THEN s{k}.{c} * {0.5**k} END, 6) AS lag{k}_{c}" for k in (1, 2) for c in ("range_pct", "high_change", "starts_high"))


@query(f"""WITH {POINTS}, f1 AS (SELECT *, idx % 5 = 2 AND has_structural_window AS snap FROM f), f2 AS (SELECT *, sum(snap::INT) OVER (PARTITION BY symbol ORDER BY ts) AS n FROM f1), sn AS (SELECT * FROM f2 WHERE snap)
 SELECT f2.symbol, f2.ts, {_LAGS} FROM f2 LEFT JOIN sn s1 ON s1.symbol = f2.symbol AND s1.n = f2.n - 1 LEFT JOIN sn s2 ON s2.symbol = f2.symbol AND s2.n = f2.n - 2""")
def told_shape_lags(spark, d):
    out = T.with_lags(_shaped(spark, d).withColumn("confirmed", F.col("idx") % 5 == 2), 2, 0.5)
    return out.select("symbol", "ts", *[r(f"lag{k}_{c}").alias(f"lag{k}_{c}") for k in (1, 2) for c in ("range_pct", "high_change", "starts_high")])


@query(f"""WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM bars), u AS (SELECT symbol, ts, open, high, low, CASE WHEN idx % 11 > 0 THEN close END AS close, 0 AS o FROM n
   UNION ALL SELECT symbol, ts, open, high * 2, low, CASE WHEN idx % 7 > 0 THEN close ELSE -close END, 1 FROM n WHERE idx % 3 = 0)
 SELECT symbol, ts, round(ln(open), 6) AS open, round(ln(high), 6) AS high, round(ln(low), 6) AS low, round(ln(close), 6) AS close FROM (SELECT * FROM u WHERE close IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY o DESC) = 1) WHERE close > 0""")
def told_clean_bars(spark, d):
    """Of a time's rows the last complete one counts, in logarithms."""
    rows, i = _indexed(_bars(spark, d)), F.col("idx")
    price = ["open", "high", "low", "close"]
    first = rows.withColumn("close", F.when(i % 11 > 0, F.col("close"))).withColumn("input_order", F.lit(0))
    again = rows.filter(i % 3 == 0).withColumns({"high": F.col("high") * 2, "close": F.when(i % 7 > 0, F.col("close")).otherwise(-F.col("close")), "input_order": F.lit(1)})
    return T.clean_bars(first.unionByName(again).drop("idx"), log_price=True).select("symbol", "ts", *[r(c).alias(c) for c in price])


@query(f"""WITH {LABELLED}, v AS (SELECT symbol, ts, close, CASE WHEN close > 100000 THEN high END AS high1, high AS high2, low AS low1, low AS low2, state <> 'no_trend' AS valid_state FROM l)
 SELECT symbol, ts, close FROM v WHERE valid_state AND high1 IS NOT NULL ORDER BY md5('7|' || symbol || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S')), symbol, ts LIMIT 25""")
def told_examples(spark, d):
    """Twenty-five examples for plots."""
    rows = _labelled(spark, d)
    levels = rows.select("symbol", "ts", F.when(F.col("close") > 100000, F.col("high")).alias("high1"), F.col("high").alias("high2"), F.col("low").alias("low1"), F.col("low").alias("low2"))
    return E.examples(rows.select("symbol", "ts", "close", (F.col("state") != "no_trend").alias("valid_state")), levels, 25).select("symbol", "ts", "close")


@query(f"""WITH {TICKS}, a AS (SELECT *, CASE WHEN count(x) OVER w >= 32 THEN stddev_samp(x) OVER w END AS s1, CASE WHEN count(x) OVER u >= 8 THEN stddev_samp(x) OVER u END AS s2 FROM d
   WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 127 PRECEDING AND CURRENT ROW), u AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 b AS (SELECT *, coalesce(s1, s2) AS v FROM a), m AS (SELECT symbol, quantile_cont(abs(x), 0.5) AS mid FROM d GROUP BY 1),
 c AS (SELECT symbol, i, x, coalesce(v, first_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v, avg(x) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS mean FROM b)
 SELECT symbol, 'swt' AS method, 1.5::DOUBLE AS scale, count(*) FILTER (i > 20 AND abs(x - mean) > 1.5 * greatest(v, mid * 0.001)) AS n_events FROM c JOIN m USING (symbol) GROUP BY 1""")
def told_count_at_scale(spark, d):
    return S.count_events(_dif(spark, d), "swt", 1.5)


# -- research --------------------------------------------------------------------------

WINDOWS = VARS + """, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM v)"""


@query(f"""WITH {WINDOWS}, x AS (SELECT symbol, (idx % 97) / 97.0 AS p, state_variable, val FROM (SELECT symbol, idx, a, b FROM n) UNPIVOT (val FOR state_variable IN (a, b))), q AS (SELECT state_variable, quantile_cont(val, 1/3) AS q1, quantile_cont(val, 2/3) AS q2 FROM x GROUP BY 1),
 g AS (SELECT *, CASE WHEN val <= q1 THEN 'low' WHEN val <= q2 THEN 'mid' ELSE 'high' END AS state_group FROM x JOIN q USING (state_variable))
 SELECT state_variable, state_group, count(*) AS n_windows, count(DISTINCT symbol) AS n_symbols, round(avg((p < 0.05)::INT), 6) AS adf_reject_rate, round(avg(p), 6) AS adf_pvalue_mean, round(quantile_cont(p, 0.5), 6) AS adf_pvalue_median, round(quantile_cont(p, 0.25), 6) AS adf_pvalue_q25, round(quantile_cont(p, 0.75), 6) AS adf_pvalue_q75 FROM g GROUP BY 1, 2""")
def told_adf_by_state(spark, d):
    p = F.col("idx") % 97 / F.lit(97.0)
    rows = _indexed(_vars(spark, d)).withColumns({"adf_pvalue": p, "adf_reject": (p < 0.05).cast("double")})
    out = R.adf_by_state(rows, ["a", "b"])
    return out.withColumns({c: r(c) for c in out.columns if c.startswith("adf_")})


EXPLOSIVE = WINDOWS + """, e AS (SELECT symbol || '_' || idx AS window_id, symbol, 'v' || (idx % 2) AS state_variable, CASE idx % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END AS state_group, b - 11 AS stat, 1.0 AS cv FROM n),
 s AS (SELECT state_variable, state_group, count(DISTINCT window_id) AS n_windows, count(DISTINCT symbol) AS n_symbols, avg((stat > cv)::INT) AS explosive_rate, avg(stat) AS gsadf_mean, quantile_cont(stat, 0.5) AS gsadf_median, avg(stat - cv) AS mean_excess FROM e GROUP BY 1, 2)"""


def _explosive(spark, d) -> DataFrame:
    i = F.col("idx")
    rows = _indexed(_vars(spark, d)).withColumn("window_id", F.concat_ws("_", "symbol", i.cast("string")))
    meta = rows.select(
        "window_id", "symbol", F.concat(F.lit("v"), (i % 2).cast("string")).alias("state_variable"),
        F.when(i % 3 == 0, "low").when(i % 3 == 1, "mid").otherwise("high").alias("state_group")
    )
    got = rows.select("window_id", (F.col("b") - 11).alias("gsadf_stat"), F.lit(1.0).alias("gsadf_cv95"), (F.col("b") - 11 > 1).alias("gsadf_reject"))
    return R.explosive_summary(got, meta, ["state_variable", "state_group"])


@query(f"WITH {EXPLOSIVE} SELECT state_variable, state_group, n_windows, n_symbols, {', '.join(f'round({c}, 6) AS {c}' for c in ('explosive_rate', 'gsadf_mean', 'gsadf_median', 'mean_excess'))} FROM s")
def told_explosive_summary(spark, d):
    return _explosive(spark, d).withColumns({c: r(c) for c in ("explosive_rate", "gsadf_mean", "gsadf_median", "mean_excess")})


@query(f"WITH {EXPLOSIVE} SELECT state_variable, {', '.join(f'''round(max(explosive_rate) FILTER (state_group = '{g}'), 6) AS {g}''' for g in ('low', 'mid', 'high'))} FROM s GROUP BY 1")
def told_explosive_pivot(spark, d):
    return R.rate_pivot(_explosive(spark, d)).withColumns({c: r(c) for c in ("low", "mid", "high")})


@query(f"""WITH {WINDOWS}, t AS (SELECT *, CASE WHEN idx % 5 > 0 THEN b - 11 END AS t FROM n), u AS (SELECT variable, x, t FROM (SELECT a, b, t FROM t) UNPIVOT (x FOR variable IN (a, b))), f AS (SELECT 'a' AS variable, a AS x, b AS y FROM n WHERE idx % 10 = 0)
 SELECT u.variable, 't' AS target, count(*) AS n, any_value(fit_n) AS fit_n, round(any_value(x_min), 6) AS x_min, round(any_value(x_max), 6) AS x_max, round(any_value(y_min), 6) AS y_min, round(any_value(y_max), 6) AS y_max
 FROM u LEFT JOIN (SELECT variable, count(*) AS fit_n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM f GROUP BY 1) g ON g.variable = u.variable WHERE t IS NOT NULL GROUP BY 1""")
def told_lowess_index(spark, d):
    rows = _indexed(_vars(spark, d)).withColumn("t", F.when(F.col("idx") % 5 > 0, F.col("b") - 11))
    fits = rows.filter("idx % 10 = 0").select(F.lit("a").alias("variable"), F.lit("t").alias("target"), F.col("a").alias("x"), F.col("b").alias("y"))
    out = R.lowess_index(rows, fits, ["a", "b"], ["t"])
    return out.withColumns({c: r(c) for c in ("x_min", "x_max", "y_min", "y_max")})


# -- swing events -------------------------------------------------------------------------

# every fifth bar confirms a high or a low of the third bar of its twenty, so each is confirmed twice
EXTREMES = BARS + """, i0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM bars), i1 AS (SELECT *, idx // 20 AS g, CASE WHEN idx // 5 % 2 = 0 THEN 'high' ELSE 'low' END AS kind FROM i0),
 i2 AS (SELECT *, max(CASE WHEN idx % 20 = 2 THEN high END) OVER w AS top, max(CASE WHEN idx % 20 = 2 THEN low END) OVER w AS bottom, max(CASE WHEN idx % 20 = 2 THEN ts END) OVER w AS day FROM i1 WINDOW w AS (PARTITION BY symbol, g)),
 x0 AS (SELECT symbol, kind AS extreme_type, g * 20 + 2 AS extreme_idx, CASE WHEN kind = 'high' THEN top ELSE bottom END AS extreme_price, idx AS confirmed_idx, ts AS confirmed_date, day AS extreme_date FROM i2 WHERE idx % 5 = 4),
 x AS (SELECT * FROM x0 QUALIFY row_number() OVER (PARTITION BY symbol, extreme_type, extreme_idx, extreme_price ORDER BY confirmed_idx) = 1)"""


def _extremes(spark, d) -> DataFrame:
    rows, w = _indexed(_bars(spark, d)), Window.partitionBy("symbol", "_g")
    i = F.col("idx")
    rows = rows.withColumn("_g", F.floor(i / 20)).withColumn("kind", F.when(F.floor(i / 5) % 2 == 0, "high").otherwise("low"))
    held = lambda c: F.max(F.when(i % 20 == 2, F.col(c))).over(w)
    rows = rows.withColumn("value", F.when(F.col("kind") == "high", held("high")).otherwise(held("low")))
    return K.extreme_events(rows.select(
        "symbol", F.col("ts").alias("timestamp"), (i % 5 == 4).alias("new_extremum_confirmed"), F.col("kind").alias("confirmed_extremum_kind"),
        (F.col("_g") * 20 + 2).alias("confirmed_extremum_idx"), F.col("value").alias("confirmed_extremum_value")
    ))


@query(f"""WITH {EXTREMES} SELECT *, symbol || '_' || lpad((row_number() OVER (PARTITION BY symbol ORDER BY extreme_idx, confirmed_idx))::VARCHAR, 6, '0') AS event_id FROM x""")
def told_swing_events(spark, d):
    return _extremes(spark, d)


@query(f"""WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM bars) SELECT CASE WHEN idx % 2 = 0 THEN lpad((idx % 3000)::VARCHAR, 6, '0') ELSE symbol END AS symbol, ts AS event_date, ts AS confirm_date, CASE idx % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'high' END AS kind, close AS price
 FROM n WHERE idx % 4 < 3 AND idx % 6 < 5""")
def told_normal_events(spark, d):
    i = F.col("idx")
    rows = _indexed(_bars(spark, d)).select(
        F.when(i % 2 == 0, (i % 3000).cast("string")).otherwise(F.col("symbol")).alias("stock_id"), F.col("ts").alias("extrema_date"), F.when(i % 4 == 0, " H ").when(i % 4 == 1, "Bottom").when(i % 4 == 2, "TOP").otherwise("neither").alias("type"), F.when(i % 6 < 5, F.col("close")).alias("value")
    )
    return K.normalise_events(rows)


@query(f"WITH {BARS}, u AS (SELECT symbol, close, 'raw' AS kind FROM bars UNION ALL SELECT symbol, ln(close), 'log' FROM bars) SELECT symbol, kind, min(close) > 0 AND quantile_cont(close, 0.95) < 20 AS is_log FROM u GROUP BY 1, 2")
def told_price_mode(spark, d):
    rows = _bars(spark, d).select(
        "symbol",
        F.explode(F.array(
            F.struct(F.lit("raw").alias("kind"), F.col("close").alias("close")), F.struct(F.lit("log").alias("kind"), F.ln("close").alias("close"))
        )).alias("z")
    ).select("symbol", "z.*")
    return rows.groupBy("symbol", "kind").agg(K.price_is_log(rows).alias("is_log"))


@query(f"""WITH {EXTREMES}{PRICES.removeprefix(BARS)}, a AS (SELECT x.symbol, extreme_date, extreme_type, extreme_price, ln(extreme_price) AS level, bar_index, hist_vol FROM x JOIN prices ON prices.symbol = x.symbol AND prices.ts = extreme_date),
 l AS (SELECT *, lag(bar_index) OVER w AS b0, lag(level) OVER w AS l0, lag(hist_vol) OVER w AS v0 FROM a WINDOW w AS (PARTITION BY symbol, extreme_type ORDER BY extreme_date, extreme_price)), k AS (SELECT *, asinh((level - l0) / (v0 * sqrt(bar_index - b0))) AS raw, symbol || '_' || lpad((row_number() OVER (PARTITION BY symbol ORDER BY extreme_date, extreme_type))::VARCHAR, 6, '0') AS event_id FROM l WHERE bar_index > b0 AND v0 > 0),
 m AS (SELECT symbol, quantile_cont(raw, 0.5) AS mid FROM k GROUP BY 1), s AS (SELECT symbol, quantile_cont(abs(raw - mid), 0.5) AS dev FROM k JOIN m USING (symbol) GROUP BY 1)
 SELECT event_id, symbol, extreme_date AS date, bar_index, extreme_type, extreme_price, round((raw - mid) / dev, 6) AS observable FROM k JOIN m USING (symbol) JOIN s USING (symbol)""")
def told_observable(spark, d):
    return K.observable(_extremes(spark, d), _bars(spark, d), mode="raw").withColumn("observable", r("observable"))


SPEC = BARS + ", n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM bars), sp AS (SELECT symbol, idx AS i, ln(close) - 12 AS re, ln(high) - 11.5 AS im FROM n WHERE idx < 30)"


def _spec(spark, d, item: str) -> DataFrame:
    rows = _indexed(_bars(spark, d)).filter("idx < 30")
    return rows.select(
        "symbol", F.lit(item).alias("item"), F.col("idx").cast("int").alias("i"), F.lit(0).alias("j"), (F.ln("close") - 12).alias("re"),
        (F.ln("high") - 11.5).alias("im")
    )


@query(f"WITH {SPEC} SELECT symbol, i::INT AS mode, round(re, 6) AS re, round(im, 6) AS im, round(sqrt(re * re + im * im), 6) AS abs, round(atan2(im, re), 6) AS angle FROM sp")
def told_eigen_table(spark, d):
    return K.eigen_table(_spec(spark, d, "eigenvalue")).withColumns({c: r(c) for c in ("re", "im", "abs", "angle")})


@query(f"""WITH {SPEC}, e AS (SELECT symbol, i, re + 20 AS s, (re + 20) ** 2 / sum((re + 20) ** 2) OVER (PARTITION BY symbol) AS energy FROM sp) SELECT symbol, i::INT AS i, round(s, 6) AS sigma, round(s / max(s) OVER (PARTITION BY symbol), 6) AS ratio, round(energy, 6) AS energy, round(sum(energy) OVER (PARTITION BY symbol ORDER BY i), 6) AS cumulative FROM e""")
def told_singular_table(spark, d):
    return K.singular_table(_spec(spark, d, "singular_value").withColumn("re", F.col("re") + 20)).withColumns({c: r(c) for c in ("sigma", "ratio", "energy", "cumulative")})


@query(f"""WITH {WINDOWS}, p AS (SELECT symbol, idx AS start, b AS t, lag(b) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM n QUALIFY p IS NOT NULL), e AS (SELECT *, p - t AS e, abs(p - t) / (abs(p + t) / 2) AS rel FROM p)
 SELECT symbol, count(*) AS prediction_count, round(avg(e), 6) AS error_mean, round(stddev_pop(e), 6) AS error_std, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(quantile_cont(abs(e), 0.5), 6) AS median_abs_error, round(avg(rel), 6) AS relative_mean, round(quantile_cont(rel, 0.5), 6) AS relative_median, count(rel) AS relative_count,
 round(arg_max(t, start), 6) AS last_true, round(arg_max(p, start), 6) AS last_pred, round(arg_max(e, start), 6) AS last_error FROM e GROUP BY 1""")
def told_forecast_errors(spark, d):
    rows = _indexed(_vars(spark, d)).select(
        "symbol", F.col("idx").alias("start"), F.col("b").alias("true"), F.lag("b").over(Window.partitionBy("symbol").orderBy("ts")).alias("pred")
    ).filter("pred IS NOT NULL")
    out = K.forecast_errors(rows)
    return out.withColumns({c: r(c) for c in out.columns if c != "symbol" and not c.endswith("count")})


@query(f"""WITH {WINDOWS}, t AS (SELECT symbol, b AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 - count(*) OVER (PARTITION BY symbol) + 26 AS p FROM n), k AS (SELECT symbol, x, p FROM t WHERE p >= 0),
 c AS (SELECT item, i, j, i + j + add AS p FROM (VALUES ('X', 0), ('Y', 1)) v(item, add), range(5) a(i), range(21) b(j)) SELECT k.symbol, c.item, c.i::INT AS i, c.j::INT AS j, round(k.x, 6) AS re FROM c JOIN k USING (p)""")
def told_delay_matrices(spark, d):
    """Delay matrices of each symbol's last 26 points."""
    rows = _indexed(_vars(spark, d)).select("symbol", F.col("ts").alias("date"), F.col("idx").alias("bar_index"), F.col("idx").cast("string").alias("event_id"), F.col("b").alias("observable"))
    return K.spectrum(rows, 5, 20, 3).filter("item IN ('X', 'Y')").select("symbol", "item", "i", "j", r("re").alias("re"))


@query()
def structure_points_matched(spark, d):
    """Bars of the structure points of each month's last state."""
    shape = _shape(spark, d)
    last = shape.groupBy("symbol", F.trunc("ts", "month")).agg(F.max("ts").alias("ts")).select("symbol", "ts")
    asks = shape.join(last, ["symbol", "ts"]).select("symbol", "ts", "high1", "high2", "low1", "low2").dropna()
    return E.match_points(asks, _bars(spark, d), price_is_log=True)


@query(f"""WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx, min(ts) OVER (PARTITION BY symbol) + INTERVAL 100 DAY AS start, max(ts) OVER (PARTITION BY symbol) - INTERVAL 100 DAY AS stop FROM bars),
 e AS (SELECT symbol, CASE WHEN idx % 2 = 0 THEN 'high' ELSE 'low' END AS kind, ts, close AS price, start, stop FROM n WHERE idx % 7 = 3 AND ts <= stop),
 i AS (SELECT symbol, kind, CASE WHEN ts < start THEN start ELSE ts END AS ts, price, stop FROM e QUALIFY ts >= start OR row_number() OVER (PARTITION BY symbol, kind, ts < start ORDER BY ts DESC) = 1),
 z AS (SELECT symbol, kind, stop AS ts, arg_max(price, ts) AS price FROM i GROUP BY symbol, kind, stop HAVING max(ts) < stop) SELECT symbol, kind, ts, price FROM i UNION ALL SELECT * FROM z""")
def step_levels(spark, d):
    rows = _indexed(_bars(spark, d))
    spans = rows.groupBy("symbol").agg((F.min("ts") + F.expr("INTERVAL 100 DAYS")).alias("start"), (F.max("ts") - F.expr("INTERVAL 100 DAYS")).alias("end"))
    found = rows.filter("idx % 7 = 3").select("symbol", F.when(F.col("idx") % 2 == 0, "high").otherwise("low").alias("kind"), "ts", F.col("close").alias("price"))
    return E.step_levels(found, spans)


GAPS = TICKS + """, r AS (SELECT symbol, ts, i, CASE WHEN i % 97 = 0 THEN NULL ELSE x END AS x, CASE WHEN i % 31 = 0 THEN NULL ELSE 60.0 END AS thr FROM d)"""


@query(f"""WITH RECURSIVE {GAPS}, f AS (SELECT symbol, 0::BIGINT AS i, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, 0 AS run, false AS fired FROM (SELECT DISTINCT symbol FROM d)
  UNION ALL SELECT symbol, i, CASE WHEN fire THEN 0 ELSE a END, CASE WHEN fire THEN 0 ELSE b END, CASE WHEN fire THEN 0 WHEN hit THEN run + 1 ELSE 0 END, fire
  FROM (SELECT *, hit AND run + 1 >= 2 AS fire FROM (SELECT *, coalesce(greatest(a, b) > thr, false) AS hit FROM (SELECT f.symbol, r.i, f.run, r.thr, CASE WHEN r.x IS NULL THEN 0 ELSE greatest(0, f.up + r.x) END AS a, CASE WHEN r.x IS NULL THEN 0 ELSE greatest(0, f.dn - r.x) END AS b FROM f JOIN r ON r.symbol = f.symbol AND r.i = f.i + 1))))
  SELECT f.symbol, d.ts FROM f JOIN d ON d.symbol = f.symbol AND d.i = f.i WHERE fired""")
def cum_events_raw(spark, d):
    """Increments and thresholds with gaps, taken as they are."""
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))
    rows = _dif(spark, d).withColumn("i", place)
    rows = rows.withColumn("x", F.when(F.col("i") % 97 != 0, F.col("x")))
    return S.raw_events(rows, "cum", F.when(F.col("i") % 31 != 0, F.lit(60.0)), b2b=2).select("symbol", "ts")


@query()
def structure_points(spark, d):
    """The last four extremes known at each month's last bar."""
    bars = _bars(spark, d)
    asks = bars.groupBy("symbol", F.trunc("ts", "month")).agg(F.max("ts").alias("ts")).select("symbol", "ts")
    return E.structure_points(T.shape_points(bars, q=30.0), asks)


@query(f"""WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM bars), p AS (SELECT * FROM n WHERE idx % 5 = 0), a AS (SELECT symbol, ts FROM n WHERE idx % 11 = 0),
 j AS (SELECT a.symbol, a.ts, p.idx, p.high, p.close, p.low, p.open FROM a ASOF JOIN p ON p.symbol = a.symbol AND p.ts <= a.ts), k AS (SELECT * FROM j WHERE idx >= 50)
 SELECT symbol, ts, 'high1' AS label, 'high' AS kind, idx, high AS level FROM k UNION ALL SELECT symbol, ts, 'high2', 'high', idx + 1, close FROM k
 UNION ALL SELECT symbol, ts, 'low1', 'low', idx + 2, low FROM k UNION ALL SELECT symbol, ts, 'low2', 'low', idx + 3, open FROM k""")
def told_structure_points(spark, d):
    rows = _indexed(_bars(spark, d))
    known = lambda c: F.when(F.col("idx") >= 50, c)
    points = rows.filter("idx % 5 = 0").select("symbol", "ts", *[known(F.col(c)).alias(n) for n, c in (("h1", "high"), ("h2", "close"), ("l1", "low"), ("l2", "open"))], *[known(F.col("idx") + k).alias(f"{n}_idx") for k, n in enumerate(("h1", "h2", "l1", "l2"))])
    return E.structure_points(points, rows.filter("idx % 11 = 0").select("symbol", "ts"))
