"""The ten-variable state vector, its rolling scores and its description."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans import order

#: Names of the vector's columns in its files.
VARIABLES = [
    "range_pct", "expansion", "structure_dir", "range_pos", "upper_break", "lower_break", "move_age", "extrema_freq", "speed_imbalance", "speed_level"
]
BINARY = {"upper_break", "lower_break"}
KEPT = ["symbol", "ts", "close", "has_structural_window", "num_confirmed_extrema", "starts_high", "high1", "high2", "low1", "low2"]


def finite(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def state_vector(shape: DataFrame) -> DataFrame:
    rows = shape.withColumns({"speed_imbalance": F.col("high_speed") - F.col("low_speed"), "speed_level": F.col("high_speed") + F.col("low_speed")})
    valid = finite(VARIABLES[0]).isNotNull()
    for v in VARIABLES[1:]:
        valid = valid & finite(v).isNotNull()
    return rows.select(*[c for c in KEPT if c in rows.columns], *VARIABLES, valid.alias("valid_state"))


def prior_bounds(values: np.ndarray, window: int, least: int, levels: tuple[float, float]) -> np.ndarray:
    """Of each value the quantiles at ``levels`` of the finite ones among the
    ``window`` before it; NaN where there are fewer than ``least``.  The window
    is kept sorted: one insertion and one deletion a step."""
    kept: list[float] = []
    out = np.full((len(values), 2), np.nan)
    known = np.isfinite(values)
    for i in range(1, len(values)):
        if known[i - 1]:
            insort(kept, values[i - 1])
        gone = i - 1 - window
        if gone >= 0 and known[gone]:
            del kept[bisect_left(kept, values[gone])]
        if len(kept) >= max(least, 1):
            for j, level in enumerate(levels):
                at = level * (len(kept) - 1)
                k = min(int(at), len(kept) - 1)
                out[i, j] = kept[k] + (kept[min(k + 1, len(kept) - 1)] - kept[k]) * (at - k)
    return out


def rolling_scores(
    rows: DataFrame, columns: Sequence[str] = tuple(VARIABLES), window: int = 1000, min_periods: int = 100, lower: float = 0.05, upper: float = 0.95,
    binary: Sequence[str] = tuple(BINARY), spread: bool = True
) -> DataFrame:
    """``<column>_score`` in -1..1: where a value lies between quantiles of the
    ``window`` rows before it, of which ``min_periods`` must be known.  One pass
    over a sorted window, in blocks of a symbol's rows; a window function would sort
    every frame anew.  Where the quantiles meet, or a value is not finite, there is none."""
    moving = [c for c in columns if c not in binary]
    out = rows
    if moving:
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"`_bounds_{c}` array<double>" for c in moving)])

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_i")
            own = pdf["_own"].to_numpy(bool)
            found = {f"_bounds_{c}": list(prior_bounds(pdf[c].to_numpy(float, na_value=np.nan), window, min_periods, (lower, upper))) for c in moving}
            return pdf.drop(columns=["_i", "_block", "_own"]).assign(**found)[own]

        out = order.spread(order.halo_blocks(rows, window, size=max(4096, 4 * window), spread=spread), "symbol", "_block").groupBy("symbol", "_block").applyInPandas(run, schema)
        for c in moving:
            lo, hi = F.col(f"_bounds_{c}")[0], F.col(f"_bounds_{c}")[1]
            score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (F.col(c) - lo) / (hi - lo) - 1))
            out = out.withColumn(f"{c}_score", F.when(finite(c).isNotNull() & finite(lo).isNotNull() & (F.abs(hi - lo) > 1e-12), score))
        out = out.drop(*[f"_bounds_{c}" for c in moving])
    return out.withColumns({f"{c}_score": F.when(
        finite(c).isNotNull(), 2 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) - 1
    ) for c in columns if c in binary})


def score_config(
    columns: Sequence[str] = tuple(VARIABLES), window: int = 1000, min_periods: int = 100, lower: float = 0.05, upper: float = 0.95
) -> list[dict]:
    return [
        {"variable": c, "score_column": f"{c}_score", "method": "binary_fixed" if c in BINARY else "rolling_prior_quantile"}
        | dict.fromkeys(("window", "min_periods", "lower_quantile", "upper_quantile")) | ({} if c in BINARY else {
            "window": window, "min_periods": min_periods, "lower_quantile": lower, "upper_quantile": upper
        })
        for c in columns
    ]


def standardise(rows: DataFrame, columns: Sequence[str], lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """symbol, ts and each column clipped at its symbol's quantiles and z-scored
    with the population deviation; constant columns become null."""
    w = Window.partitionBy("symbol")  # one shuffle, and what stands below runs once
    q = {f"_q_{c}": F.percentile(finite(c), F.array(F.lit(lower), F.lit(upper))).over(w) for c in columns}
    clipped = rows.select("symbol", "ts", *columns).withColumns(q).select(
        "symbol", "ts",
        *[F.when(finite(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"_q_{c}")[1]), F.col(f"_q_{c}")[0])).alias(c) for c in columns]
    )
    m = clipped.withColumns({f"_m_{c}": F.avg(c).over(w) for c in columns} | {f"_s_{c}": F.stddev_pop(c).over(w) for c in columns})
    return m.select("symbol", "ts", *[F.when(F.col(f"_s_{c}") != 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(c) for c in columns])


def correlations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, corr of each pair of columns, in one aggregation."""
    pairs = list(combinations_with_replacement(columns, 2))
    one = rows.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    items = [
        F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs) for x,
        y in dict.fromkeys([(a, b), (b, a)])
    ]
    return one.select(F.explode(F.array(*items)).alias("z")).select("z.*")


def describe(rows: DataFrame, columns: Sequence[str], quantiles: Sequence[float] = (0.01, 0.05, 0.5, 0.95, 0.99)) -> DataFrame:
    """variable, count, mean, std, min, quantiles (pXX), max."""
    names = [f"p{round(q * 100):02d}" for q in quantiles]
    items = F.array(*[F.struct(F.lit(c).alias("variable"), finite(c).cast("double").alias("v")) for c in columns])
    long = rows.select(F.explode(items).alias("z")).select("z.*")
    sums = long.groupBy("variable").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    levels = order.quantiles(long, ["variable"], "v", quantiles)
    return sums.join(F.broadcast(levels), "variable", "left").select(  # a row per column
        "variable", "count", "mean", "std", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(names)], "max"
    )
