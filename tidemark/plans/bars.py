"""Bars from ticks, and the series that queries run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def bars_from_ticks(ticks: DataFrame, symbol: Column, ts: Column, price: Column, order: list[Column]) -> DataFrame:
    """symbol, ts, open, high, low, close, n: first and last price by ``order``.
    Partial aggregates before one shuffle."""
    o = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return ticks.groupBy(symbol.alias("symbol"), ts.alias("ts")).agg(
        F.min_by(price, o).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, o).alias("close"),
        F.count("*").alias("n")
    )


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return bars_from_ticks(
        o, F.col("o_orderpriority"), F.date_trunc("day", F.col("o_orderdate").cast("timestamp")), F.col("o_totalprice"), [F.col("o_orderkey")]
    )


def item_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    return bars_from_ticks(
        i, F.concat("l_returnflag", "l_linestatus"), F.date_trunc("day", F.col("l_shipdate").cast("timestamp")), F.col("l_extendedprice"), order
    )


def log_close(bars: DataFrame) -> DataFrame:
    return bars.filter("close > 0").select("symbol", "ts", F.ln("close").alias("value"))


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value")
    )


def increments(series: DataFrame) -> DataFrame:
    """symbol, ts, x: first differences that exist."""
    w = Window.partitionBy("symbol").orderBy("ts")
    return series.select("symbol", "ts", (F.col("value") - F.lag("value").over(w)).alias("x")).filter("x IS NOT NULL")


def completeness(bars: DataFrame) -> DataFrame:
    """Per symbol against the calendar of all symbols within its own span:
    first, last, n_rows, n_days, n_duplicates, n_missing, min and max rows a day."""
    daily = bars.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("ts").alias("d"))
    own = daily.groupBy("symbol").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("n").alias("n_rows"), F.count("*").alias("n_days"),
        F.sum(F.col("n") - F.col("d")).alias("n_duplicates"), F.min("n").alias("min_per_day"), F.max("n").alias("max_per_day")
    )
    # one row per day of all symbols, numbered: what lies between two days is a difference of numbers
    numbered = daily.select("day").distinct().withColumn("_i", F.row_number().over(Window.orderBy("day")))
    first, last = numbered.select(
        F.col("day").alias("first_day"), F.col("_i").alias("_first")
    ), numbered.select(F.col("day").alias("last_day"), F.col("_i").alias("_last"))
    out = own.join(first, "first_day").join(last, "last_day").withColumn(
        "n_missing", (F.col("_last") - F.col("_first") + 1 - F.col("n_days")).cast("long")
    )
    return out.select(*own.columns, "n_missing")
