"""Connected components of a distributed edge list, by alternating stars.

Each round hangs the neighbours of every node from their least member, first the
larger ones, then the smaller (Kiveris et al., "Connected Components in
MapReduce and Beyond").  Rounds are written to the shared folder; a hub's edges
are rows, never one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop, stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """``edges``: u, v (orderable, no nulls).  Returns ``node`` and ``label``,
    the least node of its component, for every node of an edge."""
    now = stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _state(now)
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stage(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = stage(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small-star")
        drop(now, large)
        now, state = after, _state(after)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    # stars now: every node hangs from its component's least
    return now.select(
        F.col("u").alias("node"), F.col("v").alias("label")
    ).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
