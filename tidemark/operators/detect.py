"""Detectors over long tables ``symbol, ts, value``: one pass per series.

Events come back as rows: symbol, ts, idx (position in the series), direction,
direction_source, score, change_ts (where the method dates the change itself),
method, q.  ``ts`` is when the change is known.
"""

from __future__ import annotations

import inspect
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import kernels, wbs
from tidemark.plans import order

EVENTS = "symbol string, ts timestamp, idx long, direction int, direction_source string, score double, change_ts timestamp, method string, q double"
COLUMNS = [f.split()[0] for f in EVENTS.split(", ")]
METHODS = [*kernels.KERNELS, "wbs_lepage"]


def _clean(v: float) -> float | None:
    return float(v) if np.isfinite(v) else None


def series_events(ts: np.ndarray, values: np.ndarray, method: str, q: float, options: dict) -> Iterator[tuple]:
    """(ts, idx, direction, source, score, change_ts) for one ordered series."""
    name = "wbs_lepage" if method.lower() == "wbs" else method.lower()
    n = len(values)
    if name == "wbs_lepage":
        d = np.diff(values)
        at = np.flatnonzero(np.isfinite(d))
        for i in wbs.segment(d[at], q=q, **options) if n else []:
            yield ts[-1], n - 1, 0, "wbs_lepage", None, ts[at[i] + 1]
        return
    k = kernels.make(name, q, **options)
    if isinstance(k, kernels.SegmentBeam):
        for v in values:
            k.step(float(v))
        for place in k.answer():
            yield ts[-1], n - 1, kernels.direction_around(values, place, k.min_seg_len), k.source, None, ts[place]
        return
    feed = np.concatenate([[np.nan], np.diff(values)]) if k.on == "diff" else values
    for i, x in enumerate(feed.tolist()):
        if x == x and abs(x) != float("inf") and (event := k.step(x)):
            yield ts[i], i, event[0], k.source, _clean(event[1]), None


def detect_many(series: DataFrame, configs: Sequence[tuple] | Sequence[dict]) -> DataFrame:
    """``configs``: (method, q) or (method, q, options).  Repeated pairs of
    method and q count once, the last winning.  Each (series, config) is a task
    group of its own, so many configurations spread over the cluster."""
    known = {}
    for c in configs:
        method, q, *rest = c if not isinstance(c, dict) else (c["method"], c.get("q", 1.0), c.get("options", {}))
        name = "wbs_lepage" if method.lower() == "wbs" else method.lower()
        if name not in METHODS:
            raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
        known[name, float(q)] = dict(rest[0]) if rest else {}
    table = list(known.items())

    def run(pdf: pd.DataFrame, more: dict | None = None) -> pd.DataFrame:
        (method, q), options = table[int(pdf["config"].iloc[0])]
        options = options | (more or {})
        pdf = pdf.sort_values("ts", kind="stable")
        symbol = pdf["symbol"].iloc[0]
        ts = pdf["ts"].to_numpy()
        rows = [(symbol, *e, method, q) for e in series_events(ts, pdf["value"].to_numpy(float), method, q, options)]
        out = pd.DataFrame(rows, columns=COLUMNS)
        return out.astype({"ts": "datetime64[ns]", "change_ts": "datetime64[ns]", "score": float})

    rows = series.filter("value IS NOT NULL AND NOT isnan(value)").select("symbol", "ts", F.col("value").cast("double").alias("value"))

    def spread(configs: list[int]) -> DataFrame:
        return rows.withColumn("config", F.explode(F.array(*[F.lit(i) for i in configs])) if len(configs) > 1 else F.lit(configs[0]))

    wild = {i: options for i, ((method, _), options) in enumerate(table) if method == "wbs_lepage"}
    plain = [i for i in range(len(table)) if i not in wild]
    def run_plain(pdf: pd.DataFrame) -> pd.DataFrame:
        return run(pdf)

    out = order.spread(spread(plain), "symbol", "config").groupBy("symbol", "config").applyInPandas(run_plain, EVENTS) if plain or not wild else None
    if not wild:
        return out

    def run_wild(pdf: pd.DataFrame, limits: pd.DataFrame) -> pd.DataFrame:
        return run(pdf, {"limits": dict(zip(limits["length"].tolist(), limits["value"].tolist(), strict=True))})

    limits = wild_limits(rows, wild)
    found = spread(list(wild)).groupBy("symbol", "config").cogroup(limits.groupBy("symbol", "config")).applyInPandas(run_wild, EVENTS)
    return found if out is None else out.unionByName(found)


def wild_limits(rows: DataFrame, wild: dict[int, dict]) -> DataFrame:
    """symbol, config, length, value: thresholds of wild binary segmentation for
    the lengths that a series can need.  Each length is simulated once per config,
    its repetitions spread over the executors."""
    settings = {i: {
        k: v.default for k, v in inspect.signature(wbs.segment).parameters.items() if k in ("draws", "alpha", "least", "reps", "seed")
    } for i in wild}
    settings = {i: s | {k: v for k, v in wild[i].items() if k in s} for i, s in settings.items()}
    levels = sorted({1 - s["alpha"] for s in settings.values()})
    lengths = F.array(*[
        F.struct(
            F.lit(i).alias("config"), F.lit(n).alias("length"), F.lit(s["reps"]).alias("reps"), F.lit(levels.index(1 - s["alpha"])).alias("level")
        ) for i,
        s in settings.items() for n in wbs.grid(10000, s["least"])
    ])

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = [
                wbs.noise_maximum(n, rep, *(settings[i][k] for k in ("draws", "least", "seed"))) for i, n,
                rep in pdf[["config", "length", "rep"]].itertuples(index=False)
            ]
            yield pdf[["config", "length"]].assign(s=s)

    sizes = rows.groupBy("symbol").agg(F.count("*").alias("n"))
    needed = lambda t: t.select("*", F.explode(lengths).alias("z")).select("*", "z.*").filter(F.col("length") <= F.col("n")).drop("z", "n")
    sims = needed(sizes.agg(F.max("n").alias("n"))).select("config", "length", F.explode(F.sequence(F.lit(0), F.col("reps") - 1)).alias("rep"))
    parts = max(64, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    stats = sims.repartition(parts, "config", "length", "rep").mapInPandas(simulate, "config int, length int, s double")
    values = stats.groupBy("config", "length").agg(F.percentile("s", F.array(*[F.lit(p) for p in levels])).alias("at"))
    # no broadcast: that would bound the time of the simulation
    return needed(sizes).join(values.hint("merge"), ["config", "length"]).select(
        F.col("symbol").alias("symbol"), F.col("config").alias("config"), "length", F.get("at", F.col("level")).alias("value")
    )


def detect(series: DataFrame, method: str, q: float = 1.0, **options) -> DataFrame:
    return detect_many(series, [(method, q, options)])


def event_counts(events: DataFrame, configs: Sequence[tuple]) -> DataFrame:
    """Events per (method, q), with a row for configurations without any."""
    spark = events.sparkSession
    dim = spark.createDataFrame([(m.lower(), float(q)) for m, q, *_ in configs], "method string, q double").distinct()
    return dim.join(
        events.groupBy("method", "q").agg(F.count("*").alias("n")), ["method", "q"], "left"
    ).select("method", "q", F.coalesce("n", F.lit(0)).alias("n_events"))


def jaccard(
    events: DataFrame, by: Sequence[str] = ("method", "q"), on: Sequence[str] = ("symbol", "ts"), configs: Sequence[tuple] | None = None
) -> DataFrame:
    """Similarity of the event sets of each two groups: a_*, b_*, jaccard.  One
    pass over the events: what an event has in common is the list of its groups,
    of which there are as many as configurations, and so is the final table.
    With ``configs`` (method, q) those without events are there as well: 0
    against others, 1 against another empty one."""
    per = events.select(F.struct(*by).alias("g"), *on).groupBy(*on).agg(F.collect_set("g").alias("gs"))
    pairs = per.select("gs", F.explode("gs").alias("a")).select("a", F.explode("gs").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    rows = pairs.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    if configs is not None:
        known = events.sparkSession.createDataFrame(
            sorted({("wbs_lepage" if m.lower() == "wbs" else m.lower(), float(q)) for m, q, *_ in configs}), "method string, q double"
        )
        rows = known.select(F.struct(*by).alias("a")).join(rows, "a", "left")
    grid = rows.agg(F.collect_list(F.struct("a", "m")).alias("t")).select("t", F.explode("t").alias("x")).select("x", F.explode("t").alias("y"))
    size = lambda s: F.coalesce(F.try_element_at(F.col(f"{s}.m"), F.col(f"{s}.a")), F.lit(0))
    both = F.coalesce(F.try_element_at(F.col("x.m"), F.col("y.a")), F.lit(0))
    share = F.when(size("x") + size("y") == 0, 1.0).otherwise(both / F.nullif(size("x") + size("y") - both, F.lit(0)))
    return grid.select(*[F.col(f"{v}.a.{c}").alias(f"{s}_{c}") for s, v in (("a", "x"), ("b", "y")) for c in by], share.alias("jaccard"))


def cusum_fold(series: DataFrame, q: float = 1.0, h: float = 0.03, nu: float = 5e-5) -> DataFrame:
    """The cusum detector without Python: a fold over each series' array, for
    series that fit in one row.  Same events as ``detect(..., 'cusum')``."""
    step = F.transform(
        "a", lambda x, i: F.struct(x["ts"].alias("ts"), i.cast("long").alias("idx"), (x["value"] - F.get("a", i - 1)["value"]).alias("d"))
    )
    diffs = series.filter("value IS NOT NULL").groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("a")).select(
        "symbol", F.filter(step, lambda x: x["d"].isNotNull()).alias("a")
    )
    state = "named_struct('up', 0D, 'down', 0D, 'hit', cast(array() as array<struct<ts: timestamp, idx: bigint, direction: int, score: double>>))"
    merge = f"""aggregate(a, {state}, (s, x) -> CASE
        WHEN greatest(s.up + x.d - {nu!r}D, s.down - x.d - {nu!r}D) > {q * h!r}D THEN named_struct('up', 0D, 'down', 0D, 'hit',
            concat(s.hit, array(named_struct('ts', x.ts, 'idx', x.idx, 'direction', if(greatest(0D, s.up + x.d - {nu!r}D) >= greatest(0D, s.down - x.d - {nu!r}D), 1, -1), 'score', greatest(s.up + x.d - {nu!r}D, s.down - x.d - {nu!r}D)))))
        ELSE named_struct('up', greatest(0D, s.up + x.d - {nu!r}D), 'down', greatest(0D, s.down - x.d - {nu!r}D), 'hit', s.hit) END)"""
    return diffs.select("symbol", F.explode(F.expr(merge)["hit"]).alias("e")).select("symbol", "e.*")
