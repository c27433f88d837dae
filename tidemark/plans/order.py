"""Global order and exact quantiles without a single-task sort: rows meet in ranges
of their order, and only one row per range goes through an undivided window.
Nothing here starts a job: bounds are one-row tables of the same plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled rows for each range, of which one is a bound.
SAMPLES = 64


def place_among(value: Column, cuts: list | Column) -> Column:
    """How many of the ascending ``cuts`` (a list, or a column of arrays) lie below a
    value (0 for null), by binary search."""
    if isinstance(cuts, list) and not cuts:
        return F.lit(0)
    bounds = F.array(*[F.lit(c) for c in cuts]) if isinstance(cuts, list) else cuts
    size = F.lit(len(cuts)) if isinstance(cuts, list) else F.size(cuts)
    steps = F.lit(len(cuts).bit_length()) if isinstance(cuts, list) else F.ceil(F.log2(size + 1)).cast("int") + 1
    half = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")

    def step(s: Column, _: Column) -> Column:
        below = F.get(bounds, half(s)) < value
        return F.when(s["lo"] >= s["hi"], s).when(
            below, F.struct((half(s) + 1).alias("lo"), s["hi"].alias("hi"))
        ).otherwise(F.struct(s["lo"].alias("lo"), half(s).alias("hi")))

    whole = F.struct(F.lit(0).alias("lo"), size.alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), steps), whole, step, lambda s: s["lo"])


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by key over a stated number of partitions: groups that a Python kernel
    works on are small in bytes and dear in time, and adaptive execution would put many
    of them in one task."""
    return rows.repartition(max(_ranges(rows), 4 * rows.sparkSession.sparkContext.defaultParallelism), *keys)


def passes(rows: DataFrame, keys: Sequence[str], begin: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """One pass over the rows of each of ``keys`` in order of ts.  Spark sorts them, and
    a task holds a batch of rows and what the pass carries on, however long a series is.
    ``begin`` gives a new pass: a function that takes the batches of one series in turn.
    What it gives back at the end, if it has a ``close``, comes last."""

    def closed(feed: Callable | None) -> list[pd.DataFrame]:
        return [feed.close()] if hasattr(feed, "close") else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, feed = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            codes = np.array([pd.factorize(pdf[k])[0] for k in keys])
            cuts = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1).tolist(), len(pdf)]
            out = []
            for lo, hi in zip(cuts, cuts[1:]):
                key = tuple(None if pd.isna(v) else v for v in pdf[list(keys)].iloc[lo])
                if feed is None or key != last:
                    out += closed(feed)
                    last, feed = key, begin()
                out.append(feed(pdf.iloc[lo:hi]))
            yield pd.concat(out) if len(out) > 1 else out[0]
        yield from closed(feed)

    return spread(rows, *keys).sortWithinPartitions(*keys, "ts").mapInPandas(run, schema)


def _ranges(rows: DataFrame) -> int:
    return max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_position(rows: DataFrame, order: Sequence[str], position: str, total: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Add the row's place (from 0) in ``order``, and the number of rows, each within
    ``by`` (few values or many).  Ranges are those of (by, order) as a whole, so a value
    of many rows is spread as far as the other columns of the order tell them apart."""
    key, n = F.struct(*by, *order), _ranges(rows)
    some = rows.select(key.alias("_key")).orderBy(F.xxhash64("_key"), "_key").limit(SAMPLES * n)
    sorted_ = some.agg(F.sort_array(F.collect_list("_key")).alias("_all"))
    bounds = sorted_.select(F.filter("_all", lambda x, i: i % SAMPLES == SAMPLES - 1).alias("_cuts"))  # one row of one bound for each range
    placed = rows.crossJoin(F.broadcast(bounds)).withColumn("_part", place_among(key, F.col("_cuts"))).drop("_cuts")
    local = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    sizes = placed.groupBy("_part", *by).agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("_c").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", *by, before.alias("_b"), F.sum("_c").over(whole).alias("_t"))
    same = F.lit(True)
    for c in ("_part", *by):
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}"))
    out = placed.withColumn("_l", local).alias("p").join(sizes.alias("s"), same).select("p.*", "_b", "_t")
    out = out.withColumn(position, F.col("_b") + F.col("_l") - 1)
    return (out.withColumn(total, F.col("_t")) if total else out).drop("_part", "_l", "_b", "_t")


def quantiles(rows: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float], out: str = "q") -> DataFrame:
    """``by`` and an array of exact quantiles, interpolated linearly, of the values
    that are numbers.  Equal values are counted before they meet; distinct values meet
    in ranges, so that no buffer holds a group's values.  Groups without a value are
    left out."""
    n = _ranges(rows)
    v = F.col(value).cast("double")
    known = rows.filter(v.isNotNull() & ~F.isnan(v)).select(*by, (v + F.lit(0.0)).alias("_v"))
    counts = known.groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    cuts = counts.groupBy(*by).agg(F.array_distinct(F.percentile_approx("_v", [i / n for i in range(1, n)] or [0.5], 1000)).alias("_cuts"))
    if by:
        placed = _meet(counts, F.broadcast(cuts) if len(by) == 1 else cuts, by)
    else:
        placed = counts.crossJoin(F.broadcast(cuts))  # one row of bounds
    placed = placed.withColumn("_part", place_among(F.col("_v"), F.col("_cuts"))).drop("_cuts")
    placed = placed.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by, "_part").orderBy("_v")))
    sizes = placed.groupBy(*by, "_part").agg(F.max("_upto").alias("_n"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*by, "_part", before.alias("_b"), F.sum("_n").over(whole).alias("_t"))
    ranked = _meet(placed, sizes, [*by, "_part"])
    last = F.col("_b") + F.col("_upto") - 1  # places of a value: from first to last
    first = last - F.col("_c") + 1
    picks = []
    for i, p in enumerate(probabilities):
        at = (F.col("_t") - 1) * F.lit(float(p))
        for name, place in ((f"_lo{i}", F.floor(at)), (f"_hi{i}", F.ceil(at))):
            picks.append(F.max(F.when((first <= place) & (place <= last), F.col("_v"))).alias(name))
    found = ranked.groupBy(*by).agg(F.first("_t").alias("_t"), *picks)
    levels = []
    for i, p in enumerate(probabilities):
        at, lo, hi = (F.col("_t") - 1) * F.lit(float(p)), F.col(f"_lo{i}"), F.col(f"_hi{i}")
        levels.append(F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi))
    return found.select(*by, F.array(*levels).alias(out))


def _meet(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join in which null keys are equal."""
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.alias("l").join(right.alias("r"), same).select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in on])


def column_quantiles(rows: DataFrame, columns: Sequence[str], probabilities: Sequence[float], prefix: str = "_q_") -> DataFrame:
    """One row: for each column ``<prefix><column>``, the array of its quantiles (null
    where no value is finite), all columns in one pass."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    items = F.array(*[F.struct(F.lit(i).alias("_i"), finite(c).cast("double").alias("_x")) for i, c in enumerate(columns)])
    long = rows.select(F.explode(items).alias("_z")).select("_z.*")
    found = quantiles(long, ["_i"], "_x", probabilities)
    return found.agg(*[F.max(F.when(F.col("_i") == i, F.col("q"))).alias(f"{prefix}{c}") for i, c in enumerate(columns)])


def halo_blocks(rows: DataFrame, look_back: int, order: Sequence[str] = ("ts",), by: str = "symbol", size: int | None = None, spread: bool = True) -> DataFrame:
    """Rows with ``_i`` (their place in their series), ``_block`` and ``_own``: a series in
    blocks of ``size`` rows, before which the ``look_back`` rows before it are repeated
    (``_own`` false).  What depends on a row and ``look_back`` rows before it can be
    computed block by block, and one series is the work of many tasks.

    ``spread``: number rows by ranges, so that no task sorts a series.  This reads the
    rows twice; where they come from a kernel that is one task per series anyway, a
    window numbers them in one reading."""
    size = max(size or 4 * look_back, look_back, 1)
    if spread:
        placed = with_position(rows, order, "_i", "_n", [by])
    else:
        own = Window.partitionBy(by)
        placed = rows.withColumns({"_i": F.row_number().over(own.orderBy(*order)) - 1, "_n": F.count("*").over(own)})
    own = F.floor(F.col("_i") / size)
    last = F.floor(F.least(F.col("_i") + look_back, F.col("_n") - 1) / size)  # the last block that looks back at this row
    blocks = F.transform(F.sequence(own, last), lambda b: F.struct(b.alias("_block"), (b == own).alias("_own")))
    return placed.withColumn("_z", F.explode(blocks)).select("*", "_z._block", "_z._own").drop("_z", "_n")
