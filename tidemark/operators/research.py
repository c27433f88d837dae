"""Validation of state variables: unit roots by tertile, explosiveness of
sampled windows, local regression on later return and volatility."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import numeric
from tidemark.operators.vector import finite
from tidemark.plans import order
from tidemark.plans.order import column_quantiles, halo_blocks, quantiles, with_position


def rolling_adf(
    rows: DataFrame, columns: Sequence[str] = (), window: int = 60, min_obs: int = 50, maxlag: int = 1, regression: str = "c", alpha: float = 0.05,
    close_is_log: bool = False, block: int = 4096, spread: bool = True
) -> DataFrame:
    """A unit root test of each ``window`` of log closes: symbol, ts, adf_stat,
    adf_pvalue, adf_reject, usedlag, nobs and the state columns of its last row.
    Windows with too few finite or no varying values are left out.  A series is
    tested in blocks of ``block`` rows."""
    schema = "symbol string, ts timestamp, adf_stat double, adf_pvalue double, adf_reject double, usedlag int, nobs int" + "".join(f", `{c}` double" for c in columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i").reset_index(drop=True)
        y = pdf["close"].to_numpy(float)
        with np.errstate(all="ignore"):
            y = np.where(np.isfinite(y), y, np.nan) if close_is_log else np.log(np.where(y > 0, y, np.nan))
        names = ["symbol", "ts", "adf_stat", "adf_pvalue", "adf_reject", "usedlag", "nobs", *columns]
        if len(y) < window:
            none = pdf.iloc[:0][["symbol", "ts", *columns]]
            return none.assign(adf_stat=0.0, adf_pvalue=0.0, adf_reject=0.0, usedlag=0, nobs=0)[names]
        views = np.lib.stride_tricks.sliding_window_view(y, window)
        known = np.isfinite(views).sum(1)
        stats, used = np.full(len(views), np.nan), np.zeros(len(views), np.int64)
        full = np.flatnonzero((known == window) & (np.where(np.isfinite(views), views, 0).std(1) > 1e-12))
        if len(full) and window >= min_obs:
            stats[full], used[full] = numeric.unit_root_windows(views[full], maxlag, regression), window - 1 - maxlag
        for i in np.flatnonzero((known >= min_obs) & (known < window)):
            part = views[i][np.isfinite(views[i])]
            if part.std() > 1e-12:
                stats[i], used[i] = numeric.unit_root_t(part, maxlag, regression)
        at = np.flatnonzero(np.isfinite(stats) & pdf["_own"].to_numpy(bool)[window - 1 :])
        p = [numeric.mackinnon_p(s, regression) for s in stats[at]]
        out = pdf.iloc[at + window - 1][["symbol", "ts", *columns]].reset_index(drop=True)
        return out.assign(adf_stat=stats[at], adf_pvalue=p, adf_reject=(np.array(p) < alpha).astype(float), usedlag=maxlag, nobs=used[at])[names]

    rows = rows.select("symbol", "ts", "close", *[F.col(c).cast("double").alias(c) for c in columns])
    return order.spread(halo_blocks(rows, window - 1, size=block, spread=spread), "symbol", "_block").groupBy("symbol", "_block").applyInPandas(run, schema)


def tertile(column: str) -> Column:
    """low, mid or high by thirds, given the table's ``_q_<column>`` bounds."""
    v, q = finite(column), F.col(f"_q_{column}")
    return F.when(v <= q[0], "low").when(v <= q[1], "mid").when(v > q[1], "high")


def with_tertiles(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<column>_group`` by thirds of the whole table."""
    bounds = column_quantiles(rows, columns, (1 / 3, 2 / 3))
    return rows.join(F.broadcast(bounds)).withColumns({f"{c}_group": tertile(c) for c in columns}).drop(*[f"_q_{c}" for c in columns])  # one row of bounds


def adf_by_state(adf: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Reject rate and p-values per state variable and its thirds."""
    long = adf.filter(finite("adf_pvalue").isNotNull()).select(
        "symbol", "adf_pvalue", "adf_reject",
        F.explode(F.array(*[F.struct(F.lit(c).alias("state_variable"), finite(c).alias("v")) for c in columns])).alias("z")
    ).select("symbol", "adf_pvalue", "adf_reject", "z.*").filter("v IS NOT NULL")
    bounds = quantiles(long, ["state_variable"], "v", (1 / 3, 2 / 3), "_q_v")
    rows = long.join(F.broadcast(bounds), "state_variable").withColumn("state_group", tertile("v"))  # a row per variable
    by = ["state_variable", "state_group"]
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n_windows"), F.countDistinct("symbol").alias("n_symbols"), F.avg("adf_reject").alias("adf_reject_rate"), F.avg("adf_pvalue").alias("adf_pvalue_mean")
    )
    spread = quantiles(rows, by, "adf_pvalue", (0.5, 0.25, 0.75))
    names = ("adf_pvalue_median", "adf_pvalue_q25", "adf_pvalue_q75")
    return sums.join(spread, by).select(*sums.columns, *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


#: Composite states as (name, {variable: third}); later ones win.
COMPOSITES = [
    ("wide_expanding", {"range_pct": "high", "expansion": "high"}), ("narrow_expanding", {"range_pct": "low", "expansion": "high"}), (
        "upper_breakout", {"upper_break": "high", "range_pos": "high"}
    ), ("lower_breakdown", {"lower_break": "high", "range_pos": "low"}),
    ("fast_chop", {"extrema_freq": "high", "speed_level": "high"}), ("slow_extension", {"move_age": "high", "speed_level": "low"}), (
        "up_structure_high_pos", {"structure_dir": "high", "range_pos": "high"}
    ), ("down_structure_low_pos", {"structure_dir": "low", "range_pos": "low"}),
]


def composite_state(composites: Sequence[tuple[str, dict]] = COMPOSITES, default: str = "other") -> Column:
    out = F.lit(default)
    for name, need in composites:
        cond = F.lit(True)
        for c, third in need.items():
            cond = cond & F.coalesce(F.col(f"{c}_group") == third, F.lit(False))
        out = F.when(cond, name).otherwise(out)
    return out


def stratified_sample(rows: DataFrame, stratum: Sequence[str], n: int, seed: int = 42, key: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """At most n rows of each stratum, by the order of a seeded hash of the key:
    the same rows whatever the partitioning."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    w = Window.partitionBy(*stratum).orderBy(order, *key)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def trailing_windows(rows: DataFrame, ends: DataFrame, window: int = 60, min_obs: int = 50, close_is_log: bool = False) -> DataFrame:
    """window_id, t, symbol, ts, log_close of the ``window`` rows up to each row
    of ``ends`` (window_id, symbol, ts).  A window must lie within the series;
    of its rows those with a usable close count, ``min_obs`` at least."""
    o = Window.partitionBy("symbol").orderBy("ts")
    placed = rows.select("symbol", "ts", "close").withColumn("idx", F.row_number().over(o) - 1)
    at = ends.join(placed.select("symbol", "ts", "idx"), ["symbol", "ts"]).filter(F.col("idx") >= window - 1)
    want = at.select("window_id", "symbol", F.explode(F.sequence(F.col("idx") - window + 1, F.col("idx"))).alias("idx"))
    usable = finite("close").isNotNull() if close_is_log else finite("close") > 0
    got = want.join(placed.filter(usable), ["symbol", "idx"])
    w = Window.partitionBy("window_id")
    got = got.withColumn("t", F.row_number().over(w.orderBy("idx"))).withColumn("_n", F.count("*").over(w)).filter(F.col("_n") >= min_obs)
    return got.select("window_id", "t", "symbol", "ts", (F.col("close") if close_is_log else F.ln("close")).alias("log_close"))


def explosiveness(windows: DataFrame, minw: int = 50, lag: int = 1, nrep: int = 499, seed: int = 42) -> DataFrame:
    """The double recursive right-tailed test of each window, with its simulated
    95 % critical value (by length, on the executors)."""
    fields = "window_id string, n_obs int, minw int, lag int, nrep int, gsadf_stat double, gsadf_cv95 double, gsadf_reject boolean, error string"
    lengths = windows.groupBy("window_id").agg(F.count("*").cast("int").alias("n")).filter(F.col("n") > minw + lag + 5).select("n").distinct()
    sims = lengths.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(nrep - 1))))

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, reps in pdf.groupby("n")["rep"]:
                walks = [np.cumsum(np.random.default_rng([seed, int(n), minw, int(rep)]).standard_normal(int(n)) + 1.0 / n) for rep in reps]
                yield pd.DataFrame({"n": [n] * len(walks), "s": numeric.explosive_statistics(np.array(walks), minw, 0)}).astype({"n": "int32"})

    parts = 4 * windows.sparkSession.sparkContext.defaultParallelism
    critical = sims.repartition(parts, "n", "rep").mapInPandas(simulate, "n int, s double").groupBy("n").agg(F.percentile("s", F.lit(0.95)).alias("cv"))

    def scored(pdf: pd.DataFrame) -> pd.DataFrame:
        """Whole windows; those of one length are tested together."""
        names, series = zip(*[(k, g.to_numpy(float)) for k, g in pdf.groupby("window_id", sort=False)["log_close"]], strict=True)
        out = pd.DataFrame({"window_id": names, "n": [len(x) for x in series]})
        bad = np.array([len(x) <= minw + lag + 5 or x.std(ddof=1) <= 1e-12 for x in series])
        stats = np.full(len(series), np.nan)
        for n in out["n"][~bad].unique():
            at = np.flatnonzero((out["n"] == n) & ~bad)
            stats[at] = numeric.explosive_statistics(np.array([series[i] for i in at]), minw, lag)
        out["stat"] = pd.array([None if b else v for b, v in zip(bad, stats.tolist(), strict=True)], "Float64")
        return out.assign(error=np.where(bad, "too_short_or_constant", "")).astype({"n": "int32"})

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf])
            if len(pdf):
                last = pdf["window_id"] == pdf["window_id"].iloc[-1]  # may go on in the next batch
                if not last.all():
                    yield scored(pdf[~last])
                held = pdf[last]
        if held is not None:
            yield scored(held)

    ordered = windows.select("window_id", "t", "log_close").repartition("window_id").sortWithinPartitions("window_id", "t")
    tested = ordered.mapInPandas(test, "window_id string, n int, stat double, error string")
    out = tested.join(F.broadcast(critical), "n", "left")  # a row per window length
    cv = F.when(F.col("error") == "", F.col("cv"))
    return out.select(
        "window_id", F.col("n").alias("n_obs"), F.lit(minw).alias("minw"), F.lit(lag).alias("lag"), F.lit(nrep).alias("nrep"),
        F.col("stat").alias("gsadf_stat"), cv.alias("gsadf_cv95"), F.coalesce(F.col("stat") > cv, F.lit(False)).alias("gsadf_reject"), "error"
    )


def explosive_summary(results: DataFrame, meta: DataFrame, by: Sequence[str]) -> DataFrame:
    rows = meta.join(results, "window_id")
    return rows.groupBy(*by).agg(
        F.countDistinct("window_id").alias("n_windows"), F.countDistinct("symbol").alias("n_symbols"), F.avg(F.col("gsadf_reject").cast("double")).alias("explosive_rate"),
        F.avg("gsadf_stat").alias("gsadf_mean"), F.percentile("gsadf_stat", F.lit(0.5)).alias("gsadf_median"), F.avg(F.col("gsadf_stat") - F.col("gsadf_cv95")).alias("mean_excess"),
    )


def split_label(column: str = "sample_name") -> tuple[Column, Column]:
    """(variable, third) of labels such as range_pct_low."""
    return F.regexp_extract(column, "^(.+)_(low|mid|high)$", 1), F.regexp_extract(column, "^(.+)_(low|mid|high)$", 2)


def rate_pivot(summary: DataFrame) -> DataFrame:
    return summary.groupBy("state_variable").pivot("state_group", ["low", "mid", "high"]).agg(F.first("explosive_rate"))


def future_targets(rows: DataFrame, returns: Sequence[int] = (5, 10, 20), vols: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """``return_kN``: change of the log close N bars on; ``vol_kN``: population
    deviation of the next N one-bar changes, all known."""
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = rows.withColumn("_r", F.col("close") - F.lag("close").over(w))
    out = rows.withColumns({f"return_k{k}": F.lead("close", k).over(w) - F.col("close") for k in returns})
    for k in vols:
        ahead = w.rowsBetween(1, k)
        out = out.withColumn(f"vol_k{k}", F.when(F.count("_r").over(ahead) == k, F.stddev_pop("_r").over(ahead)))
    return out.drop("_r")


def winsorise(rows: DataFrame, columns: Sequence[str], lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Columns clipped at quantiles of the whole table."""
    q = column_quantiles(rows, columns, (lower, upper))
    clip = {c: F.when(finite(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"_q_{c}")[1]), F.col(f"_q_{c}")[0])) for c in columns}
    return rows.join(F.broadcast(q)).withColumns(clip).drop(*[f"_q_{c}" for c in columns])  # one row of bounds


def even_subsample(rows: DataFrame, x: str, most: int, tie: Sequence[str] = ("symbol", "ts"), by: Sequence[str] = ()) -> DataFrame:
    """At most ``most`` rows (of each value of ``by``), evenly spaced in the order of x."""
    placed = with_position(rows, [x, *tie], "_i", "_n", by)
    step = (F.col("_n") - 1) / F.lit(float(max(most - 1, 1)))
    # row i is taken if some whole j has floor(j * step) = i
    j = F.ceil(F.col("_i") / step)
    taken = (F.col("_n") <= most) | ((j < most) & (F.floor(j * step) == F.col("_i"))) | ((j - 1 >= 0) & (j - 1 < most) & (F.floor((j - 1) * step) == F.col("_i")))
    return placed.filter(taken).drop("_i", "_n")


def collapse_few(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Mean y of each x: for variables of few values."""
    return rows.filter(finite(x).isNotNull() & finite(y).isNotNull()).groupBy(x).agg(F.avg(y).alias(y))


def lowess(
    rows: DataFrame, variables: Sequence[str], targets: Sequence[str], frac: float = 0.25, robust: int = 1, max_points: int = 8000
) -> DataFrame:
    """variable, target, x, y of a local regression for each pair; the points
    given to one fit are bounded by ``max_points`` (evenly spaced in x).  A variable
    with at most eight values collapses to the means of all its rows."""
    pair = ["variable", "target"]
    items = F.array(*[
        F.struct(F.lit(v).alias("variable"), F.lit(t).alias("target"), finite(v).cast("double").alias("x"), finite(t).cast("double").alias("y")) for v in variables for t in targets
    ])
    # all pairs in one plan: their rows are numbered together, by (variable, target, x, tie)
    long = rows.select("symbol", "ts", F.explode(items).alias("z")).select("symbol", "ts", "z.*").filter("x IS NOT NULL AND y IS NOT NULL")
    means = long.groupBy(*pair, "x").agg(F.avg("y").alias("y"), F.count("*").alias("n"))
    few = F.broadcast(means.groupBy(*pair).agg((F.count("*") <= 8).alias("few")))  # a row per pair
    spaced = even_subsample(long, "x", max_points, by=pair).select(*pair, "x", "y", F.lit(1).cast("long").alias("n"))
    out = spaced.join(few, pair).filter("NOT few").unionByName(means.join(few, pair).filter("few")).drop("few")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        if pdf["n"].sum() < 3 or x.std() <= 1e-12:
            return pdf.iloc[:0][["variable", "target", "x", "y"]]
        if len(np.unique(x)) <= 8:
            g = pdf.groupby("x")["y"].mean()
            fx, fy = g.index.to_numpy(float), g.to_numpy(float)
        else:
            fx, fy = numeric.local_regression(x, y, frac, robust)
        return pd.DataFrame({"variable": pdf["variable"].iloc[0], "target": pdf["target"].iloc[0], "x": fx, "y": fy})

    return out.groupBy("variable", "target").applyInPandas(fit, "variable string, target string, x double, y double")


def lowess_index(rows: DataFrame, fits: DataFrame, variables: Sequence[str], targets: Sequence[str]) -> DataFrame:
    items = [F.struct(
        F.lit(v).alias("variable"), F.lit(t).alias("target"), finite(v).alias("x"), finite(t).alias("y")
    ) for v in variables for t in targets]
    n = rows.select(F.explode(F.array(*items)).alias("z")).select("z.*").filter("x IS NOT NULL AND y IS NOT NULL").groupBy("variable", "target").agg(F.count("*").alias("n"))
    shape = fits.groupBy("variable", "target").agg(
        F.count("*").alias("fit_n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max")
    )
    return n.join(shape, ["variable", "target"], "left")
