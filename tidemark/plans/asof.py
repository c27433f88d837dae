"""Backward as-of join: each left row with the latest right row not after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, take: Sequence[str], by: Sequence[str] = ("symbol",), on: str = "ts") -> DataFrame:
    """``left`` with the ``take`` columns of ``right`` (null if there is none).
    The tables are stacked and the last right row carried forward: one shuffle,
    and no row of one side meets all of the other."""
    names = [c for c in left.columns if c not in take]
    held = F.struct(*take)
    a = left.select(*names, F.lit(1).alias("_side"), F.lit(None).cast(right.select(held.alias("h")).schema["h"].dataType).alias("_held"))
    b = right.select(
        *[F.col(c) if c in (*by, on) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names], F.lit(0).alias("_side"),
        held.alias("_held")
    )
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_held", F.last("_held", True).over(w)).filter("_side = 1")
    return both.select(*names, *[F.col(f"_held.{c}").alias(c) for c in take])
