"""Whole jobs from files to files, and their command line:

    python -m tidemark.plans.jobs sampling --data ticks.parquet --out out --target 2000
    python -m tidemark.plans.jobs state --input prices/ --out out --log-price
    python -m tidemark.plans.jobs swings --input prices/ --out out --m 8 --n 60 --rank 4
    python -m tidemark.plans.jobs adf --vectors out/state_vector --out out/adf
    python -m tidemark.plans.jobs explosive --vectors out/state_vector --out out/explosive
    python -m tidemark.plans.jobs lowess --vectors out/state_vector --out out/lowess
    python -m tidemark.plans.jobs diagnostics --run out --out out/diagnostics
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import detect, dmd, research, sampling, structure, vector
from tidemark.plans.bars import increments
from tidemark.sources import readers

SAMPLED = [m for m in sampling.SAMPLERS if m != "page_hinkley"]


def _note(spark: SparkSession, path: str, what: dict) -> None:
    spark.createDataFrame([(json.dumps(what, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def sampling_job(
    spark: SparkSession, series: DataFrame, out: str, target: int = 2000, b2b: int = 1, vol_window: int = 128, max_iter: int = 16,
    methods: list[str] | None = None
) -> DataFrame:
    """Tune each method to about ``target`` events, sample, compare: writes
    base, history, tuned, events, jaccard and metadata; returns the tuned scales."""
    methods, dif = methods or SAMPLED, increments(series)
    sampling.base_threshold(dif, vol_window).write.mode("overwrite").parquet(f"{out}/base")
    base = spark.read.parquet(f"{out}/base")
    sampling.tuning_history(dif, methods, target, b2b, vol_window, max_iter).write.mode("overwrite").parquet(f"{out}/history")
    sampling.best_scales(spark.read.parquet(f"{out}/history"), target).write.mode("overwrite").parquet(f"{out}/tuned")
    tuned = spark.read.parquet(f"{out}/tuned")
    events = sampling.sample_scaled(base, tuned, b2b)
    events.write.mode("overwrite").parquet(f"{out}/events")
    similarity = detect.jaccard(spark.read.parquet(f"{out}/events").withColumn("q", F.lit(1.0)), by=["method"], configs=[(m, 1.0) for m in methods])
    similarity.write.mode("overwrite").parquet(f"{out}/jaccard")
    _note(spark, f"{out}/metadata", {"target": target, "b2b": b2b, "vol_window": vol_window, "max_iter": max_iter, "methods": methods})
    return tuned


def state_job(
    spark: SparkSession, prices: DataFrame | None, out: str, start: str | None = None, end: str | None = None, log_price: bool = False, n_lags: int = 0, decay: float | None = None, window: int = 1000, min_periods: int = 100,
    clip: tuple[float, float] = (0.01, 0.99), score: tuple[float, float] = (0.05, 0.95), max_symbols: int | None = None, state_path: str | None = None, **machine,
) -> DataFrame:
    """Prices to scored state vectors.  Dates are cut after the machine has run,
    which needs the history; ``max_symbols`` takes the first symbols by name.
    ``state_path``: a shape-state table to use again instead of running it."""
    if state_path:
        shape = spark.read.parquet(state_path)
    else:
        shape = structure.shape_state(structure.clean_bars(_first_symbols(prices, max_symbols), log_price), n_lags=n_lags, decay=decay, **machine)
        if start:
            shape = shape.filter(F.col("ts") >= F.to_timestamp(F.lit(start)))
        if end:
            shape = shape.filter(F.col("ts") <= F.to_timestamp(F.lit(end)))
        shape.write.mode("overwrite").parquet(f"{out}/shape_state")
        shape = spark.read.parquet(f"{out}/shape_state")
    scored = vector.rolling_scores(vector.state_vector(shape), window=window, min_periods=min_periods, lower=score[0], upper=score[1], spread=False)
    scored.write.mode("overwrite").parquet(f"{out}/state_vector")
    scored = spark.read.parquet(f"{out}/state_vector")
    valid = scored.filter("valid_state")
    vector.describe(valid, vector.VARIABLES).write.mode("overwrite").parquet(f"{out}/summary")
    vector.correlations(vector.standardise(valid, vector.VARIABLES, *clip), vector.VARIABLES).write.mode("overwrite").parquet(f"{out}/correlations")
    _note(
        spark, f"{out}/score_config",
        {"scores": vector.score_config(window=window, min_periods=min_periods, lower=score[0], upper=score[1]), **machine}
    )
    return scored


def _first_symbols(prices: DataFrame, most: int | None) -> DataFrame:
    return prices.join(F.broadcast(prices.select("symbol").distinct().orderBy("symbol").limit(most)), "symbol") if most else prices


def swings_job(
    spark: SparkSession, prices: DataFrame, out: str, m: int, n: int, rank: int, start: str | None = None, end: str | None = None,
    log_price: bool = False, save_matrices: bool = False, **machine
) -> DataFrame:
    """Prices to swing events, their observable, its spectrum and forecasts.
    Dates are cut before the machine runs.  The delay matrices and the reduced
    operator are kept with ``save_matrices`` only."""
    if start:
        prices = prices.filter(F.col("ts") >= F.to_timestamp(F.lit(start)))
    if end:
        prices = prices.filter(F.col("ts") <= F.to_timestamp(F.lit(end)))
    bars = structure.clean_bars(prices, log_price)
    dmd.extreme_events(structure.market_state(bars, **machine)).write.mode("overwrite").parquet(f"{out}/events")
    obs = dmd.observable(spark.read.parquet(f"{out}/events"), bars, mode="log" if log_price else "auto")
    obs.write.mode("overwrite").parquet(f"{out}/observable")
    obs = spark.read.parquet(f"{out}/observable")
    spec = dmd.spectrum(obs, m, n, rank)
    (spec if save_matrices else spec.filter("item NOT IN ('X', 'Y', 'A_hat')")).write.mode("overwrite").parquet(f"{out}/spectrum")
    spec = spark.read.parquet(f"{out}/spectrum")
    dmd.eigen_table(spec).write.mode("overwrite").parquet(f"{out}/eigenvalues")
    dmd.singular_table(spec).write.mode("overwrite").parquet(f"{out}/singular_values")
    dmd.forecast_errors(dmd.rolling_forecasts(obs, m, n, rank)).write.mode("overwrite").parquet(f"{out}/forecast_errors")
    return spec


def adf_job(spark: SparkSession, vectors: DataFrame, out: str, columns: list[str] | None = None, **test) -> DataFrame:
    """State vectors to unit-root tests of each window, and their rates by thirds
    of each variable.  ``test``: settings of ``research.rolling_adf``."""
    columns = columns or vector.VARIABLES
    research.rolling_adf(vectors, columns, **test).write.mode("overwrite").parquet(f"{out}/adf")
    by_state = research.adf_by_state(spark.read.parquet(f"{out}/adf"), columns)
    by_state.write.mode("overwrite").parquet(f"{out}/adf_by_state")
    _note(spark, f"{out}/adf_config", {"columns": columns, **test})
    return spark.read.parquet(f"{out}/adf_by_state")


def explosive_job(
    spark: SparkSession, vectors: DataFrame, out: str, columns: list[str] | None = None, window: int = 60, min_obs: int = 50, per_group: int = 120, per_state: int = 150, seed: int = 42, nrep: int = 499, close_is_log: bool = False
) -> DataFrame:
    """State vectors to explosiveness of sampled windows: so many of each third of
    each variable, and of each composite state."""
    columns = columns or vector.VARIABLES
    rows = research.with_tertiles(vectors.filter("valid_state"), columns)
    if set(vector.VARIABLES) <= set(columns):
        rows = rows.withColumn("composite", research.composite_state())
    else:
        rows = rows.withColumn("composite", F.lit("other"))
    names = [F.struct(F.lit(v).alias("state_variable"), F.col(f"{v}_group").alias("state_group")) for v in columns]
    named = rows.select(
        "symbol", "ts",
        F.explode(F.array(*names, F.struct(F.lit("composite").alias("state_variable"), F.col("composite").alias("state_group")))).alias("z")
    ).select("symbol", "ts", "z.*").filter("state_group IS NOT NULL")
    stratum, composite = ["state_variable", "state_group"], F.col("state_variable") == "composite"
    meta = [
        research.stratified_sample(named.filter(c), stratum, n, seed, (*stratum, "symbol", "ts")) for c,
        n in ((~composite, per_group), (composite & (F.col("state_group") != "other"), per_state))
    ]
    meta = meta[0].unionByName(meta[1]).withColumn("window_id", F.md5(F.concat_ws("|", *stratum, "symbol", F.col("ts").cast("string"))))
    meta.write.mode("overwrite").parquet(f"{out}/windows_meta")
    meta = spark.read.parquet(f"{out}/windows_meta")
    research.trailing_windows(
        vectors, meta.select("window_id", "symbol", "ts"), window, min_obs, close_is_log
    ).write.mode("overwrite").parquet(f"{out}/windows")
    research.explosiveness(spark.read.parquet(f"{out}/windows"), nrep=nrep, seed=seed).write.mode("overwrite").parquet(f"{out}/explosiveness")
    research.explosive_summary(spark.read.parquet(f"{out}/explosiveness"), meta, stratum).write.mode("overwrite").parquet(f"{out}/explosive_by_state")
    summary = spark.read.parquet(f"{out}/explosive_by_state")
    research.rate_pivot(summary).write.mode("overwrite").parquet(f"{out}/explosive_pivot")
    return summary


def lowess_job(
    spark: SparkSession, vectors: DataFrame, out: str, columns: list[str] | None = None, scores: bool = True, returns: tuple[int, ...] = (5, 10, 20), vols: tuple[int, ...] = (5, 10, 20), frac: float = 0.25, robust: int = 1, max_points: int = 8000,
    clip: tuple[float, float] = (0.01, 0.99), close_is_log: bool = False,
) -> DataFrame:
    """State vectors to local regressions of later return and volatility on each
    variable's score (or the variable itself)."""
    columns = columns or vector.VARIABLES
    variables = [f"{c}_score" if scores and f"{c}_score" in vectors.columns else c for c in columns]
    log = vectors if close_is_log else vectors.filter("close > 0").withColumn("close", F.ln("close"))
    targets = [f"return_k{h}" for h in returns] + [f"vol_k{h}" for h in vols]
    research.winsorise(
        research.future_targets(log, returns, vols), targets, *clip
    ).select("symbol", "ts", *dict.fromkeys([*variables, *targets])).write.mode("overwrite").parquet(f"{out}/targets")
    data = spark.read.parquet(f"{out}/targets")
    research.lowess(data, variables, targets, frac, robust, max_points).write.mode("overwrite").parquet(f"{out}/lowess")
    research.lowess_index(data, spark.read.parquet(f"{out}/lowess"), variables, targets).write.mode("overwrite").parquet(f"{out}/lowess_index")
    return spark.read.parquet(f"{out}/lowess_index")


def validation_job(
    spark: SparkSession, vectors: DataFrame, out: str, close_is_log: bool = False, per_group: int = 120, per_state: int = 150, seed: int = 42,
    nrep: int = 499, horizons: tuple[int, ...] = (5, 10, 20), max_points: int = 8000
) -> None:
    """All three tests of state vectors."""
    adf_job(spark, vectors, out, close_is_log=close_is_log)
    explosive_job(spark, vectors, out, per_group=per_group, per_state=per_state, seed=seed, nrep=nrep, close_is_log=close_is_log)
    lowess_job(
        spark, vectors, out, columns=[v for v in vector.VARIABLES if v not in vector.BINARY], scores=False, returns=horizons, vols=horizons,
        max_points=max_points, close_is_log=close_is_log
    )


def diagnostics_job(spark: SparkSession, run: str, out: str, m: int | None = None, n: int | None = None, rank: int | None = None) -> DataFrame:
    """Diagnostics of a stored decomposition: singular values with their shares,
    eigenvalues with size and angle and, given m, n and rank, errors of forecasts
    over the stored observable.  ``run``: what ``swings_job`` wrote; a folder
    ``eigenvalue_summary`` is preferred to ``eigenvalues``."""
    exists = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{run}/{name}").getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{run}/{name}"))
    name = "eigenvalue_summary" if exists("eigenvalue_summary") else "eigenvalues"
    for need in (name, "singular_values"):
        if not exists(need):
            raise FileNotFoundError(f"{run}/{need}")
    eigen, singular = spark.read.parquet(f"{run}/{name}"), spark.read.parquet(f"{run}/singular_values")
    spec = eigen.select(
        "symbol", F.lit("eigenvalue").alias("item"), F.col("mode").alias("i"), "re", "im"
    ).unionByName(singular.select("symbol", F.lit("singular_value").alias("item"), "i", F.col("sigma").alias("re"), F.lit(0.0).alias("im")))
    dmd.eigen_table(spec).write.mode("overwrite").parquet(f"{out}/eigenvalue_diagnostics")
    dmd.singular_table(spec).write.mode("overwrite").parquet(f"{out}/singular_value_diagnostics")
    if None not in (m, n, rank):
        errors = dmd.forecast_errors(dmd.rolling_forecasts(spark.read.parquet(f"{run}/observable"), m, n, rank))
        errors.withColumns({
            "m": F.lit(m), "n": F.lit(n), "rank": F.lit(rank), "train_observable_count": F.lit(m + n + 1)
        }).write.mode("overwrite").parquet(f"{out}/reconstruction_error")
    return spark.read.parquet(f"{out}/singular_value_diagnostics")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="job", required=True)
    a = sub.add_parser("sampling")
    a.add_argument("--data", required=True)
    a.add_argument("--column")
    a.add_argument("--target", type=int, default=2000)
    a.add_argument("--b2b", type=int, default=1)
    a.add_argument("--vol-window", type=int, default=128)
    a.add_argument("--max-iter", type=int, default=16)
    a.add_argument("--methods", nargs="*")
    for name in ("state", "swings"):
        b = sub.add_parser(name)
        b.add_argument("--input", required=name == "swings")
        b.add_argument("--config", help="JSON settings; what they name wins over flags")
        b.add_argument("--start")
        b.add_argument("--end")
        b.add_argument("--log-price", action="store_true")
        b.add_argument("--detector-method", default="cusum")
        b.add_argument("--detector-q", type=float, default=1.0)
        b.add_argument("--cpd-confirm-lag", type=int, default=0)
        b.add_argument("--reset-structure-on-cpd", action="store_true")
        if name == "state":
            b.add_argument("--state-path", help="a shape-state table to use again")
            b.add_argument("--n-lags", type=int, default=0)
            b.add_argument("--max-symbols", type=int)
            b.add_argument("--clip-lower", type=float, default=0.01)
            b.add_argument("--clip-upper", type=float, default=0.99)
            b.add_argument("--score-window", type=int, default=1000)
            b.add_argument("--score-min-periods", type=int, default=100)
            b.add_argument("--score-lower", type=float, default=0.05)
            b.add_argument("--score-upper", type=float, default=0.95)
        else:
            for flag in ("--m", "--n", "--rank"):
                b.add_argument(flag, type=int, required=True)
            b.add_argument("--save-matrices", action="store_true")
    words, numbers = (lambda x: x.split(",")), (lambda x: tuple(map(int, x.split(","))))
    for name in ("adf", "explosive", "lowess"):
        c = sub.add_parser(name)
        c.add_argument("--vectors", required=True, help="a table of scored state vectors")
        c.add_argument("--state-columns", type=words, dest="columns")
        c.add_argument("--close-is-log", action="store_true")
        if name != "lowess":
            c.add_argument("--window", type=int, default=60)
            c.add_argument("--min-obs", type=int, default=50)
    c = sub.choices["adf"]
    c.add_argument("--maxlag", type=int, default=1)
    c.add_argument("--regression", default="c", choices=["c", "ct", "ctt", "n"])
    c.add_argument("--alpha", type=float, default=0.05)
    c = sub.choices["explosive"]
    c.add_argument("--samples-per-group", type=int, default=120, dest="per_group")
    c.add_argument("--samples-per-state", type=int, default=150, dest="per_state")
    c.add_argument("--random-state", type=int, default=42, dest="seed")
    c.add_argument("--nrep", type=int, default=499)
    c = sub.choices["lowess"]
    c.add_argument("--raw-state", action="store_false", dest="scores")
    c.add_argument("--return-horizons", type=numbers, default=(5, 10, 20), dest="returns")
    c.add_argument("--vol-horizons", type=numbers, default=(5, 10, 20), dest="vols")
    c.add_argument("--frac", type=float, default=0.25)
    c.add_argument("--it", type=int, default=1, dest="robust")
    c.add_argument("--max-points", type=int, default=8000)
    c.add_argument("--target-clip-lower", type=float, default=0.01)
    c.add_argument("--target-clip-upper", type=float, default=0.99)
    c = sub.add_parser("diagnostics")
    c.add_argument("--run", required=True, help="what a swings job wrote")
    for flag in ("--m", "--n", "--rank"):
        c.add_argument(flag, type=int)
    for x in sub.choices.values():
        x.add_argument("--out", required=True)
    o = vars(p.parse_args(args))
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    job = o.pop("job")
    if job == "sampling":
        sampling_job(
            spark, readers.read_series(spark, o["data"], o["column"]), o["out"], o["target"], o["b2b"], o["vol_window"], o["max_iter"], o["methods"]
        )
    elif job == "diagnostics":
        diagnostics_job(spark, **o)
    elif job in ("adf", "explosive", "lowess"):
        if job == "lowess":
            o["clip"] = (o.pop("target_clip_lower"), o.pop("target_clip_upper"))
        {"adf": adf_job, "explosive": explosive_job, "lowess": lowess_job}[job](spark, spark.read.parquet(o.pop("vectors")), o.pop("out"), **o)
    else:
        o = readers.read_settings(spark, o.pop("config"), **o)
        machine = {"method": o["detector_method"], "q": o["detector_q"], "lag": o["cpd_confirm_lag"], "reset_on_change": o["reset_structure_on_cpd"]}
        prices = readers.read_prices(spark, o["input"]) if o["input"] else None
        if prices is None and not o.get("state_path"):
            p.error("--input or --state-path is needed")
        span = {"start": o["start"], "end": o["end"], "log_price": o["log_price"]}
        if job == "state":
            clip, score = (o["clip_lower"], o["clip_upper"]), (o["score_lower"], o["score_upper"])
            state_job(
                spark, prices, o["out"], n_lags=o["n_lags"], max_symbols=o["max_symbols"], window=o["score_window"],
                min_periods=o["score_min_periods"], clip=clip, score=score, state_path=o["state_path"], **span, **machine
            )
        else:
            swings_job(spark, prices, o["out"], o["m"], o["n"], o["rank"], save_matrices=o["save_matrices"], **span, **machine)


if __name__ == "__main__":
    main()
