"""Swing events and their delay-embedding spectrum.

Extremes become a series in event time (how far a high is from the last high,
in units of volatility), which is embedded in delays and decomposed by dynamic
modes.  Complex results are columns re and im.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.asof import asof_backward
from tidemark.plans import order
from tidemark.plans.order import halo_blocks

#: Names under which other tables carry the same columns.
ALIASES = {
    "symbol": ["symbol", "stock_id", "ticker", "code"], "event_date": [
        "event_date", "extreme_date", "extrema_date", "date"
    ], "confirm_date": ["confirm_date", "confirmed_at"],
    "kind": ["extreme_type", "extrema_type", "kind", "type"], "price": ["extreme_price", "extrema_price", "price", "value"],
}


def extreme_events(state: DataFrame) -> DataFrame:
    """Confirmed extremes of a market-state table, each once (its first
    confirmation), numbered by symbol: event_id, symbol, extreme_type,
    extreme_idx, extreme_date, extreme_price, confirmed_idx, confirmed_date.  An
    extreme whose bar is not in the table is dated by its confirmation."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    rows = state.withColumn("confirmed_idx", F.row_number().over(w) - 1)
    dates = rows.select("symbol", F.col("confirmed_idx").alias("extreme_idx"), F.col("timestamp").alias("extreme_date"))
    e = rows.filter("new_extremum_confirmed AND confirmed_extremum_kind IS NOT NULL AND confirmed_extremum_value IS NOT NULL").select(
        "symbol", F.col("confirmed_extremum_kind").alias("extreme_type"), F.col("confirmed_extremum_idx").alias("extreme_idx"), F.col("confirmed_extremum_value").alias("extreme_price"), "confirmed_idx", F.col("timestamp").alias("confirmed_date")
    ).join(dates, ["symbol", "extreme_idx"], "left").withColumn("extreme_date", F.coalesce("extreme_date", "confirmed_date"))
    once = Window.partitionBy("symbol", "extreme_type", "extreme_idx", "extreme_price").orderBy("confirmed_idx")
    e = e.withColumn("_r", F.row_number().over(once)).filter("_r = 1").drop("_r")
    number = F.row_number().over(Window.partitionBy("symbol").orderBy("extreme_idx", "confirmed_idx"))
    return e.withColumn("event_id", F.format_string("%s_%06d", "symbol", number))


def normalise_events(events: DataFrame) -> DataFrame:
    """symbol (six digits where it is a number), event_date, confirm_date, kind
    (high or low), price; incomplete rows go."""
    have = {k: next((c for c in names if c in events.columns), None) for k, names in ALIASES.items()}
    for need in ("symbol", "event_date", "kind", "price"):
        if have[need] is None:
            raise ValueError(f"no column for {need}; one of {ALIASES[need]} is needed")
    raw = F.col(have["symbol"]).cast("string")
    word = F.lower(F.trim(F.col(have["kind"])))
    kind = F.when(word.isin("h", "high", "max", "top"), "high").when(word.isin("l", "low", "min", "bottom"), "low")
    rows = events.select(
        F.when(raw.rlike("^[0-9]{1,5}$"), F.lpad(raw, 6, "0")).otherwise(raw).alias("symbol"), F.to_timestamp(have["event_date"]).alias("event_date"),
        F.to_timestamp(F.col(have["confirm_date"] or have["event_date"])).alias("confirm_date"), kind.alias("kind"), F.col(have["price"]).cast("double").alias("price"),
    )
    return rows.dropna()


def price_is_log(prices: DataFrame, close: str = "close") -> Column:
    """Whether closes read as raw prices: taken as logs if all are positive and
    the 95 % quantile is under 20.  An aggregate."""
    return F.coalesce((F.min(close) > 0) & (F.percentile(close, F.lit(0.95)) < 20), F.lit(False))


def price_table(prices: DataFrame, mode: str = "raw", window: int = 20, min_periods: int = 10) -> DataFrame:
    """symbol, ts, bar_index, log_close, log_return, hist_vol."""
    if window < 2 or min_periods < 2:
        raise ValueError("window and min_periods must be at least 2")
    level = F.col("close").cast("double") if mode == "log" else F.when(F.col("close") > 0, F.ln("close"))
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = prices.select("symbol", "ts", level.alias("log_close")).dropna().withColumn("bar_index", F.row_number().over(w) - 1)
    rows = rows.withColumn("log_return", F.col("log_close") - F.lag("log_close").over(w))
    back = w.rowsBetween(-(window - 1), 0)
    return rows.withColumn("hist_vol", F.when(F.count("log_return").over(back) >= min_periods, F.stddev_samp("log_return").over(back)))


def robust_standardise(rows: DataFrame, value: str, out: str, by: str = "symbol") -> DataFrame:
    """(x - median) / median absolute deviation; where that is zero, the z-score;
    where that fails too, null."""
    w, x, half = Window.partitionBy(by), F.col(value), F.lit(0.5)
    rows = rows.withColumns({"_m": F.percentile(value, half).over(w), "_a": F.avg(value).over(w), "_s": F.stddev_pop(value).over(w)})
    rows = rows.withColumn("_d", F.percentile(F.abs(x - F.col("_m")), half).over(w))
    return rows.withColumn(
        out, F.when(F.col("_d") > 0, (x - F.col("_m")) / F.col("_d")).when(F.col("_s") > 0, (x - F.col("_a")) / F.col("_s"))
    ).drop("_m", "_a", "_s", "_d")


def observable(events: DataFrame, prices: DataFrame, mode: str = "auto", window: int = 20, min_periods: int = 10) -> DataFrame:
    """event_id, symbol, date, bar_index, extreme_type, extreme_price, observable:
    the change since the last extreme of the same kind, in volatility units of
    that time and per square root of bars, through asinh, standardised."""
    e = normalise_events(events)
    if mode == "auto":
        mode = "log" if prices.agg(price_is_log(prices).alias("l")).first()["l"] else "raw"
    bars = price_table(prices, mode, window, min_periods)
    level = F.col("price") if mode == "log" else F.when(F.col("price") > 0, F.ln("price"))
    e = e.withColumn("level", level).filter("level IS NOT NULL").withColumn("ts", F.col("event_date"))
    e = asof_backward(e, bars.select("symbol", "ts", "bar_index", "hist_vol"), ["bar_index", "hist_vol"]).filter("bar_index IS NOT NULL")
    same = Window.partitionBy("symbol", "kind").orderBy("event_date", "confirm_date", "price")
    e = e.withColumns({f"_{c}": F.lag(c).over(same) for c in ("bar_index", "level", "hist_vol")})
    bars_between = F.col("bar_index") - F.col("_bar_index")
    e = e.filter((bars_between > 0) & (F.col("_hist_vol") > 0)).withColumn(
        "x_raw", F.asinh((F.col("level") - F.col("_level")) / (F.col("_hist_vol") * F.sqrt(bars_between.cast("double"))))
    )
    number = F.row_number().over(Window.partitionBy("symbol").orderBy("event_date", "confirm_date", "kind"))
    e = robust_standardise(
        e.withColumn("event_id", F.format_string("%s_%06d", "symbol", number)), "x_raw", "observable"
    ).filter("observable IS NOT NULL")
    return e.select(
        "event_id", "symbol", F.col("event_date").alias("date"), "bar_index", F.col("kind").alias("extreme_type"),
        F.col("price").alias("extreme_price"), "observable"
    )


# -- the decomposition -------------------------------------------------------


def _whole(name: str, v) -> int:
    if isinstance(v, bool) or not isinstance(v, int | np.integer):
        raise TypeError(f"{name} must be a whole number")
    if v < 1:
        raise ValueError(f"{name} must be positive")
    return int(v)


def delay_pair(x, m: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Delay matrices X and Y (one step on), each m by n + 1."""
    x = np.asarray(x, float)
    m, n = _whole("m", m), _whole("n", n)
    if x.ndim != 1 or not np.isfinite(x).all():
        raise ValueError("a one-dimensional series of finite numbers is needed")
    if m + n + 1 > len(x):
        raise ValueError(f"{m + n + 1} points are needed, there are {len(x)}")
    rows = np.lib.stride_tricks.sliding_window_view(x[: m + n + 1], n + 1)
    return rows[:m].copy(), rows[1 : m + 1].copy()


def decompose(x, m: int, n: int, rank: int) -> dict:
    """eigenvalues (largest first, then by angle), modes (phase of the largest
    entry zero), singular values, the reduced operator and its basis."""
    big, ahead = delay_pair(x, m, n)
    rank = _whole("rank", rank)
    u, s, vh = np.linalg.svd(big, full_matrices=False)
    if rank > len(s):
        raise ValueError(f"rank is at most {len(s)}")
    if s[rank - 1] <= np.finfo(float).eps * len(s) * s[0]:
        raise ValueError("the rank includes a singular value of zero")
    basis = u[:, :rank]
    step = basis.T @ ahead @ vh[:rank].T / s[:rank]
    values, vectors = np.linalg.eig(step)
    order = np.lexsort((np.round(np.angle(values), 10), -np.round(np.abs(values), 10)))
    modes = basis @ vectors[:, order]
    lead = modes[np.abs(modes).argmax(0), np.arange(modes.shape[1])]
    return {
        "eigenvalues": values[order], "modes": modes * (np.abs(lead) / lead), "singular_values": s, "rank": rank, "step": step, "basis": basis,
        "last": ahead[:, -1], "X": big, "Y": ahead
    }


def forecast(x, m: int, n: int, rank: int) -> float:
    """The point after a window of m + n + 1."""
    d = decompose(x, m, n, rank)
    return float(np.real(d["basis"] @ d["step"] @ d["basis"].T @ d["last"])[-1])


def forecasts(x: np.ndarray, m: int, n: int, rank: int, at_once: int = 1 << 22) -> np.ndarray:
    """``forecast`` for every window of m + n + 1 points.  With the delay matrices' products
    X X' and Y X', small matrices that change by a rank-one step from window to window,
    the singular basis and the operator of all windows come from one batch of symmetric
    eigenproblems.  A window whose singular values are too far apart for that (squared,
    they would lose half of their digits) is decomposed by itself."""
    x, size = np.asarray(x, float), m + n + 1
    count = len(x) - size + 1
    if count <= 0:
        return np.zeros(0)
    out = np.full(count, np.nan)
    doubtful = np.ones(count, bool)
    if rank <= m <= n + 1 and np.isfinite(x).all():
        step = max(1, at_once // (2 * m * (n + 1)))
        rows = np.lib.stride_tricks.sliding_window_view(np.lib.stride_tricks.sliding_window_view(x, n + 1), m + 1, axis=0)  # window, column, row
        for a in range(0, count, step):
            w = rows[a : a + step]
            big, ahead = w[:, :, :m].transpose(0, 2, 1), w[:, :, 1:].transpose(0, 2, 1)
            values, basis = np.linalg.eigh(big @ big.transpose(0, 2, 1))
            values, basis = values[:, ::-1][:, :rank], basis[:, :, ::-1][:, :, :rank]
            sure = values[:, -1] > 1e-7 * values[:, 0]
            turned = basis.transpose(0, 2, 1)
            with np.errstate(all="ignore"):
                inner = turned @ (ahead @ big.transpose(0, 2, 1)) @ basis / values[:, None, :]
                next_ = basis[:, -1:, :] @ inner @ turned @ ahead[:, :, -1:]
            out[a : a + step][sure] = next_[sure, 0, 0]
            doubtful[a : a + step] = ~sure
    for s in np.flatnonzero(doubtful):
        out[s] = forecast(x[s : s + size], m, n, rank)
    return out


def _tail(obs: DataFrame, size: int) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc("date"), F.desc("bar_index"), F.desc("event_id"))
    rows = obs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= size)
    full = rows.groupBy("symbol").agg(F.count("*").alias("_n")).filter(F.col("_n") == size)
    return rows.join(full.select("symbol"), "symbol")


def spectrum(obs: DataFrame, m: int, n: int, rank: int) -> DataFrame:
    """Of each symbol's last m + n + 1 events: rows of item (eigenvalue,
    singular_value, mode, X, Y, A_hat), i, j, re, im.  Shorter series have none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["date", "bar_index", "event_id"])
        d, symbol, rows = decompose(pdf["observable"].to_numpy(float), m, n, rank), pdf["symbol"].iloc[0], []
        for item, a in (
            ("eigenvalue", d["eigenvalues"][:, None]), ("singular_value", d["singular_values"][:, None]), ("mode", d["modes"]), ("X", d["X"]),
            ("Y", d["Y"]), ("A_hat", d["step"])
        ):
            rows += [(symbol, item, i, j, float(np.real(v)), float(np.imag(v))) for (i, j), v in np.ndenumerate(a)]
        return pd.DataFrame(rows, columns=["symbol", "item", "i", "j", "re", "im"])

    return _tail(obs, m + n + 1).groupBy("symbol").applyInPandas(run, "symbol string, item string, i int, j int, re double, im double")


def eigen_table(spec: DataFrame) -> DataFrame:
    return spec.filter("item = 'eigenvalue'").select(
        "symbol", F.col("i").alias("mode"), "re", "im", F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("abs"), F.atan2("im", "re").alias("angle")
    )


def singular_table(spec: DataFrame) -> DataFrame:
    """sigma, its ratio to the first, its share of energy and the running share."""
    s = spec.filter("item = 'singular_value'").select("symbol", "i", F.col("re").alias("sigma"))
    whole, upto = Window.partitionBy("symbol"), Window.partitionBy("symbol").orderBy("i")
    energy = F.col("sigma") ** 2 / F.sum(F.col("sigma") ** 2).over(whole)
    return s.withColumn(
        "ratio", F.col("sigma") / F.max("sigma").over(whole)
    ).withColumn("energy", energy).withColumn("cumulative", F.sum("energy").over(upto))


def rolling_forecasts(obs: DataFrame, m: int, n: int, rank: int, block: int = 512, spread: bool = True) -> DataFrame:
    """symbol, start, true, pred of the point after every window of m + n + 1, in
    blocks of ``block`` points (more, where windows are longer)."""
    size = m + n + 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        x, own, first = pdf["observable"].to_numpy(float), pdf["_own"].to_numpy(bool), int(pdf["_i"].iloc[0])
        at = np.flatnonzero(own[size:])
        if not len(at):
            return pdf.iloc[:0][["symbol"]].assign(start=0, true=0.0, pred=0.0)
        skip = at[0]  # own rows follow one another
        pred = forecasts(x[skip:-1], m, n, rank)
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]] * len(at), "start": first + at, "true": x[size + at], "pred": pred})

    points = obs.select("symbol", "date", "bar_index", "event_id", "observable")
    blocks = halo_blocks(points, size, ("date", "bar_index", "event_id"), size=block, spread=spread)
    return order.spread(blocks, "symbol", "_block").groupBy("symbol", "_block").applyInPandas(run, "symbol string, start int, true double, pred double")


def forecast_errors(rows: DataFrame) -> DataFrame:
    e = F.col("pred") - F.col("true")
    mid = F.abs(F.col("pred") + F.col("true")) / 2
    rel = F.when(mid > 2.220446049250313e-16, F.abs(e) / mid)
    half = lambda c: F.percentile(c, F.lit(0.5))
    return rows.groupBy("symbol").agg(
        F.count("*").alias("prediction_count"), F.avg(e).alias("error_mean"), F.stddev_pop(e).alias("error_std"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), half(F.abs(e)).alias("median_abs_error"),
        F.avg(rel).alias("relative_mean"), half(rel).alias("relative_median"), F.count(rel).alias("relative_count"), F.max_by("true", "start").alias("last_true"), F.max_by("pred", "start").alias("last_pred"), F.max_by(e, "start").alias("last_error"),
    )
