"""What states are worth: durations, switches, transitions, future returns.
``state`` is a table of symbol, ts, a state column and a close."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = (float("-inf"), 0.0, 0.2, 0.4, 0.6, 0.8, 1.0, float("inf"))


def _time(by: str = "ts") -> Window:
    return Window.partitionBy("symbol").orderBy(by)


def future_return(rows: DataFrame, horizon: int, log: bool = False, close: str = "close", name: str | None = None) -> DataFrame:
    ahead = F.lead(close, horizon).over(_time())
    return rows.withColumn(name or f"future_return_{horizon}", ahead - F.col(close) if log else ahead / F.col(close) - 1.0)


def changed(column: str) -> Column:
    """Whether the state differs from the row before (a first row does)."""
    return ~F.col(column).eqNullSafe(F.lag(column).over(_time())) | (F.row_number().over(_time()) == 1)


def durations(rows: DataFrame, column: str) -> DataFrame:
    """symbol, run, state, start, end, bars of each unbroken run."""
    runs = rows.withColumn("_new", changed(column).cast("int")).withColumn("run", F.sum("_new").over(_time()))
    return runs.groupBy("symbol", "run").agg(
        F.min_by(column, "ts").alias(column), F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("bars")
    )


def summary(rows: DataFrame, by: Sequence[str], value: str, std: bool = True) -> DataFrame:
    out = [
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("min"),
        F.max(value).alias("max")
    ]
    return rows.groupBy(*by).agg(*out, *([F.stddev_samp(value).alias("std")] if std else []))


def duration_summary(rows: DataFrame, column: str) -> DataFrame:
    return summary(durations(rows, column), [column], "bars", std=False)


def switch_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per symbol how often each column changes, the first row aside."""
    marked = rows.select("symbol", *[changed(c).cast("long").alias(c) for c in columns])
    return marked.groupBy("symbol").agg(*[F.greatest(F.sum(c) - 1, F.lit(0)).alias(f"{c}_switch_count") for c in columns])


def transitions(rows: DataFrame, column: str) -> DataFrame:
    """from, to, share: rows of the matrix sum to one; pairs never seen are 0."""
    steps = rows.select(
        "symbol", F.lag(column).over(_time()).alias("from"), F.col(column).alias("to")
    ).filter("`from` IS NOT NULL AND `to` IS NOT NULL")
    seen = steps.groupBy("from", "to").agg(F.count("*").alias("n"))
    total = seen.groupBy("from").agg(F.sum("n").alias("total"))
    grid = total.join(seen.select("to").distinct())  # as many cells as states squared
    return grid.join(seen, ["from", "to"], "left").select("from", "to", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def bucket(column: str, bins: Sequence[float] = BINS) -> Column:
    """Number of the half-open bin (lower, upper] that holds the value."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(bins) - 1)):
        out = F.when((F.col(column) > bins[i]) & (F.col(column) <= bins[i + 1]) if i else F.col(column) <= bins[1], i).otherwise(out)
    return F.when(~F.isnan(column), out)


def position_returns(rows: DataFrame, value: str, column: str = "position", bins: Sequence[float] = BINS) -> DataFrame:
    """Summary of ``value`` per position bucket, empty buckets included."""
    spark = rows.sparkSession
    dim = spark.range(len(bins) - 1).select(F.col("id").cast("int").alias("bucket"))
    got = summary(rows.withColumn("bucket", bucket(column, bins)).filter("bucket IS NOT NULL"), ["bucket"], value)
    return dim.join(got, "bucket", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def quality_summary(
    state: DataFrame, column: str = "current_trend",
    metrics: Sequence[str] = ("trend_dynamic", "trend_lifetime_movements", "trend_lifetime_bars_since_point3")
) -> DataFrame:
    active = state.filter(F.col(column).isin("uptrend", "downtrend"))
    long = active.select(
        column, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("z")
    ).select(column, "z.*")
    return summary(long, [column, "metric"], "value", std=False)


def terminal_quality(
    state: DataFrame, column: str = "current_trend",
    metrics: Sequence[str] = ("trend_dynamic", "trend_lifetime_movements", "trend_lifetime_bars_since_point3")
) -> DataFrame:
    """Per run of a confirmed trend its last known metrics."""
    runs = state.withColumn("_new", changed(column).cast("int")).withColumn("run", F.sum("_new").over(_time()))
    active = runs.filter(F.col(column).isin("uptrend", "downtrend"))
    last = [F.max_by(m, F.when(F.col(m).isNotNull(), F.col("ts"))).alias(f"terminal_{m.removeprefix('trend_')}") for m in metrics]
    return active.groupBy("symbol", "run").agg(
        F.first(column).alias(column), F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("bars"), *last
    )


def point_intervals(state: DataFrame) -> DataFrame:
    """Distinct pairs of points 2 and 3 (latest row of each), their times and the
    bars between; ``state`` has idx, point2_idx, point3_idx, current_trend."""
    pairs = state.filter("point2_idx IS NOT NULL AND point3_idx IS NOT NULL")
    latest = Window.partitionBy("symbol", "point2_idx", "point3_idx").orderBy(F.desc("ts"))
    pairs = pairs.withColumn("_r", F.row_number().over(latest)).filter("_r = 1 AND point3_idx >= point2_idx").select(
        "symbol", "current_trend", "point2_idx", "point3_idx"
    )
    at = state.select("symbol", "idx", "ts")
    two, three = (at.select("symbol", F.col("idx").alias(f"point{n}_idx"), F.col("ts").alias(f"point{n}_ts")) for n in (2, 3))
    return pairs.join(two, ["symbol", "point2_idx"]).join(three, ["symbol", "point3_idx"]).withColumn("bars", F.col("point3_idx") - F.col("point2_idx"))


def extremes_frame(state: DataFrame, price_is_log: bool = False) -> DataFrame:
    """For plots: each confirmed extreme once (its first confirmation), with the
    time of its bar; prices as they were if the state has logs."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    rows = state.withColumn("idx", F.row_number().over(w) - 1)
    price = F.exp("confirmed_extremum_value") if price_is_log else F.col("confirmed_extremum_value")
    found = rows.filter("new_extremum_confirmed AND confirmed_extremum_idx IS NOT NULL").select(
        "symbol", F.col("confirmed_extremum_kind").alias("kind"), F.col("confirmed_extremum_idx").alias("idx"), price.alias("price"),
        F.col("timestamp").alias("confirmed_at")
    )
    once = Window.partitionBy("symbol", "kind", "idx").orderBy("confirmed_at")
    found = found.withColumn("_r", F.row_number().over(once)).filter("_r = 1").drop("_r")
    return found.join(rows.select("symbol", "idx", F.col("timestamp").alias("ts")), ["symbol", "idx"])


def state_bands(state: DataFrame, column: str = "current_trend") -> DataFrame:
    """For plots: the spans of each state."""
    return durations(state.withColumn("ts", F.col("timestamp")), column)


def step_levels(extremes: DataFrame, spans: DataFrame) -> DataFrame:
    """For plots: the level of the last extreme of each kind as steps within a span.
    ``extremes``: symbol, kind, ts, price; ``spans``: symbol, start, end.  The last extreme
    before the span holds from its start; the last level holds to its end.  Kinds
    without an extreme by the end have no rows."""
    rows = extremes.select("symbol", "kind", "ts", F.col("price").cast("double").alias("price")).join(spans, "symbol").filter("ts <= end")
    before = F.col("ts") < F.col("start")
    held = rows.filter(before).groupBy("symbol", "kind", "start", "end").agg(F.max_by("price", "ts").alias("price"))
    inside = rows.filter(~before).select("symbol", "kind", "ts", "price", "start", "end")
    steps = inside.unionByName(held.select("symbol", "kind", F.col("start").alias("ts"), "price", "start", "end"))
    last = steps.groupBy("symbol", "kind", "end").agg(F.max("ts").alias("ts"), F.max_by("price", "ts").alias("price")).filter("ts < end")
    return steps.select("symbol", "kind", "ts", "price").unionByName(last.select("symbol", "kind", F.col("end").alias("ts"), "price"))


LEVELS = (("high1", "high"), ("high2", "high"), ("low1", "low"), ("low2", "low"))


def structure_points(points: DataFrame, asks: DataFrame) -> DataFrame:
    """The last four alternating extremes known at each asked time: columns of
    ``asks`` (symbol, ts), label, kind, idx, level.  ``points`` is a table of
    ``structure.shape_points``; its latest row up to the time counts.  Times with
    fewer than two highs and two lows before them give no rows."""
    from tidemark.plans.asof import asof_backward

    named = ["h1", "h2", "l1", "l2"]
    at = asof_backward(asks, points.select("symbol", "ts", *named, *[f"{c}_idx" for c in named]), [*named, *[f"{c}_idx" for c in named]])
    four = F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(kind).alias("kind"), F.col(f"{c}_idx").alias("idx"), F.col(c).alias("level")) for (label, kind),
        c in zip(LEVELS, named, strict=True)
    ])
    return at.filter("h1_idx IS NOT NULL").select(*asks.columns, F.explode(four).alias("z")).select(*asks.columns, "z.*")


def match_points(asks: DataFrame, bars: DataFrame, lookback: int = 260, tolerance: float = 1e-6, price_is_log: bool = False) -> DataFrame:
    """The bars of the levels of each ask (symbol, ts, high1, high2, low1, low2):
    symbol, ts, label, kind, level, idx.  Of the bars from ``lookback`` before
    that of ts, the nearest in price whose high (or low) is the level, else the
    nearest of which any price is; a bar serves one level only, in the order of
    the labels.  Levels meet bars by symbol and rounded price, so only likely
    pairs form, and each ask is settled on its own."""
    step = lambda p: F.round(F.when(F.abs(p) >= 1, F.signum(p) * (F.ln(F.abs(p)) / tolerance / 2 + 1e7)).otherwise(p / tolerance / 2)).cast("long")
    w = Window.partitionBy("symbol").orderBy("ts")
    placed = bars.select(
        "symbol", "ts", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")]
    ).withColumn("idx", F.row_number().over(w) - 1)
    prices = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("price")) for c in ("open", "high", "low", "close")]))
    at = placed.select("symbol", "idx", prices.alias("z")).select("symbol", "idx", "z.*").filter("price IS NOT NULL")
    # one step to either side, and the other scale at its edge
    near = F.array_distinct(F.array(
        step(F.col("price")), step(F.col("price") * (1 + tolerance)), step(F.col("price") * (1 - tolerance)), step(F.col("price") + tolerance),
        step(F.col("price") - tolerance)
    ))
    at = at.withColumn("step", F.explode(near))
    four = F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(label).alias("label"), F.lit(kind).alias("kind"), F.col(label).cast("double").alias("level")) for i,
        (label, kind) in enumerate(LEVELS)
    ])
    long = asks.select("symbol", "ts", F.explode(four).alias("z")).select("symbol", "ts", "z.*").join(
        placed.select("symbol", "ts", F.col("idx").alias("end")), ["symbol", "ts"]
    )
    long = long.withColumn("sought", F.exp("level") if price_is_log else F.col("level"))
    met = long.withColumn("step", step(F.col("sought"))).join(at, ["symbol", "step"]).filter((F.col("idx") <= F.col("end")) & (F.col("idx") >= F.col("end") - lookback))
    off = F.abs(F.col("price") - F.col("sought")) / F.greatest(F.abs("sought"), F.lit(1.0))
    met = met.withColumn("off", off).filter(F.col("off") <= tolerance).select(
        "symbol", "ts", "place", "idx", "off", (F.col("side") == F.col("kind")).alias("own")
    ).distinct()

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        used: dict[int, int] = {}
        for place, own in ((p, o) for p in range(len(LEVELS)) for o in (True, False)):
            if place not in used:
                open_ = pdf[(pdf["place"] == place) & (pdf["own"] if own else True) & ~pdf["idx"].isin(list(used.values()))].sort_values(["off", "idx"])
                if len(open_):
                    used[place] = int(open_["idx"].iloc[0])
        return pd.DataFrame([(pdf["symbol"].iloc[0], pdf["ts"].iloc[0], p, i) for p, i in used.items()], columns=["symbol", "ts", "place", "idx"])

    found = met.groupBy("symbol", "ts").applyInPandas(settle, "symbol string, ts timestamp, place int, idx long")
    return long.join(found, ["symbol", "ts", "place"], "left").select("symbol", "ts", "label", "kind", "level", "idx")


def examples(vectors: DataFrame, shape: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """n rows of valid state with all four levels known, the same whatever the
    partitioning; levels that ``vectors`` lacks come from ``shape``."""
    more = [c for c in ("starts_high", "high1", "high2", "low1", "low2") if c in shape.columns and c not in vectors.columns]
    rows = vectors.join(shape.select("symbol", "ts", *more), ["symbol", "ts"], "left") if more else vectors
    if "valid_state" in rows.columns:
        rows = rows.filter("valid_state")
    rows = rows.dropna(subset=["high1", "high2", "low1", "low2"])
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "symbol", F.col("ts").cast("string")))
    return rows.orderBy(order, "symbol", "ts").limit(n)


def evaluate(state: DataFrame, horizons: Sequence[int] = (5,), log: bool = False) -> dict[str, DataFrame]:
    """All of the above for a market-state table."""
    rows = state.withColumn("ts", F.col("timestamp")).withColumn("close", F.col("Close")) if "timestamp" in state.columns else state
    for h in horizons:
        rows = future_return(rows, h, log)
    rows = rows.withColumn("idx", F.row_number().over(_time()) - 1)
    spans = point_intervals(rows)
    out = {
        "trend_durations": durations(rows, "current_trend"), "trend_duration_summary": duration_summary(rows, "current_trend"), "phase_durations": durations(rows, "current_phase"), "phase_duration_summary": duration_summary(rows, "current_phase"),
        "switch_counts": switch_counts(rows, ["current_trend", "current_phase", "status"]).join(
            rows.groupBy("symbol").agg(F.sum(F.col("new_extremum_confirmed").cast("long")).alias("confirmed_extrema_count")), "symbol"
        ),
        "transitions": transitions(rows, "current_trend"), "phase_transitions": transitions(rows, "current_phase"), "quality_summary": quality_summary(rows), "terminal_quality": terminal_quality(rows), "point_intervals": spans, "point_interval_summary": summary(spans, ["current_trend"], "bars"),
    }
    for h in horizons:
        v = f"future_return_{h}"
        out |= {
            f"position_returns_{h}": position_returns(rows, v), f"trend_returns_{h}": summary(rows, ["current_trend"], v),
            f"phase_returns_{h}": summary(rows, ["current_phase"], v)
        }
    return out
