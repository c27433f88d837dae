"""Sources and sinks: series, price tables in several layouts, run settings."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Column names of a daily price download, in order.
DAILY = {
    "日期": "date", "股票代码": "symbol", "开盘": "open", "收盘": "close", "最高": "high", "最低": "low", "成交量": "volume", "成交额": "amount", "振幅": "amplitude",
    "涨跌幅": "pct_change", "涨跌额": "change", "换手率": "turnover"
}
DAILY_ORDER = ["date", "symbol", "name", "open", "high", "low", "close", "volume", "amount", "amplitude", "pct_change", "change", "turnover"]
NUMBERS = ["open", "high", "low", "close", "volume", "amount", "amplitude", "pct_change", "change", "turnover"]


def number(c: str) -> Column:
    """A double, or null where the text is none or the number is not finite."""
    v = F.expr(f"try_cast(`{c}` AS DOUBLE)")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def plain_names(df: DataFrame) -> DataFrame:
    """Column names without byte order mark and surrounding space, in lower case."""
    return df.toDF(*[c.replace("﻿", "").strip().lower() for c in df.columns])


def symbol_code(c: str | Column) -> Column:
    c = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.when(c.rlike("^[0-9]{1,5}$"), F.lpad(c, 6, "0")).otherwise(c)


def read_prices(
    spark: SparkSession, path: str | Sequence[str], start: str | None = None, end: str | None = None, symbol: str | None = None
) -> DataFrame:
    """Price bars from CSV (a file, a folder or a pattern) or Parquet, with any
    letter case of column names: symbol, ts, open, high, low, close and what
    numbers there are.  Without a symbol column, ``symbol`` or the file name."""
    first = path if isinstance(path, str) else path[0]
    if first.endswith(".parquet"):
        raw = spark.read.parquet(*([path] if isinstance(path, str) else path))
    else:
        raw = spark.read.option("header", True).option("inferSchema", False).csv(path if isinstance(path, str) else list(path))
    raw = raw.withColumn("_file", F.input_file_name())
    rows = plain_names(raw)
    when = next((c for c in ("date", "ts", "time", "timestamp") if c in rows.columns), None)
    if when is None or not {"open", "high", "low", "close"} <= set(rows.columns):
        raise ValueError("a date column and open, high, low, close are needed")
    name = F.lit(symbol) if symbol else symbol_code("symbol") if "symbol" in rows.columns else F.regexp_extract("_file", r"([^/]+)\.[^./]*$", 1)
    rows = rows.select(
        name.alias("symbol"), F.to_timestamp(when).alias("ts"), *[number(c).alias(c) for c in NUMBERS if c in rows.columns]
    ).filter("ts IS NOT NULL")
    if start:
        rows = rows.filter(F.col("ts") >= F.to_timestamp(F.lit(start)))
    if end:
        rows = rows.filter(F.col("ts") <= F.to_timestamp(F.lit(end)))
    return rows


def read_symbol(
    spark: SparkSession, folder: str, symbol: str = "spx", interval: str = "1d", start: str | None = None, end: str | None = None
) -> DataFrame:
    """One symbol's bars from ``<folder>/<symbol>_<interval>.csv``, both ends of
    the span included; an error if there are none."""
    rows = read_prices(spark, f"{folder.rstrip('/')}/{symbol}_{interval}.csv", start, end, symbol)
    if not rows.limit(1).count():
        raise ValueError(f"no bars of {symbol} in this span")
    return rows


def read_series(spark: SparkSession, path: str, column: str | None = None, time: str | None = None, symbol: str = "series") -> DataFrame:
    """symbol, ts, value from Parquet: the named column, or the only one there is
    beside the time."""
    raw = spark.read.parquet(path)
    when = time or next((c for c in ("time", "ts", "date", "timestamp", "__index_level_0__") if c in raw.columns), None)
    if when is None:
        raise ValueError("no time column")
    rest = [c for c in raw.columns if c not in (when, "symbol")]
    value = column or (rest[0] if len(rest) == 1 else "p" if "p" in rest else None)
    if value is None or value not in raw.columns:
        raise ValueError(f"name one of {rest}")
    return raw.select(
        (F.col("symbol") if "symbol" in raw.columns else F.lit(symbol)).alias("symbol"), F.to_timestamp(when).alias("ts"),
        F.col(value).cast("double").alias("value")
    )


def normalise_daily(raw: DataFrame, symbol: str, name: str | None = None) -> DataFrame:
    """A downloaded daily table under plain names, in fixed order."""
    rows = raw.select(*[F.col(f"`{c}`").alias(DAILY.get(c, c)) for c in raw.columns])
    rows = rows.withColumns({"symbol": F.lit(symbol), "name": F.lit(name)} | {c: number(c) for c in NUMBERS if c in rows.columns})
    return rows.select(*[c for c in DAILY_ORDER if c in rows.columns])


def normalise_intraday(raw: DataFrame, symbol: str, order: str | None = None) -> DataFrame:
    """Intraday bars: numbers coerced, incomplete prices dropped, of one time the
    last row (by ``order``) kept."""
    rows = plain_names(raw)
    rows = rows.withColumns({c: number(c) for c in NUMBERS if c in rows.columns} | {
        "ts": F.to_timestamp("date"), "symbol": F.lit(symbol)
    }).dropna(subset=["ts", "open", "high", "low", "close"])
    w = Window.partitionBy("ts").orderBy(F.desc(order or "ts"))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", *([order] if order else []))


def exchange_prefix(code: str | Column) -> Column:
    """The exchange before a six-digit code by its first digit: sz for 0 and 3, sh
    for 6, bj for 4 and 8; other codes stay as they are."""
    c = symbol_code(code)
    return F.concat(
        F.when(c.rlike("^[03]"), F.lit("sz")).when(c.rlike("^6"), F.lit("sh")).when(c.rlike("^[48]"), F.lit("bj")).otherwise(F.lit("")), c
    )


def read_settings(spark: SparkSession, path: str | None, **flags) -> dict:
    """Run settings from a JSON file; what the file names wins over flags."""
    given = json.loads(spark.read.option("wholetext", True).text(path).first()[0]) if path else {}
    return flags | given


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
