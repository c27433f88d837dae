"""A data source for folders of price files named ``{symbol}_{interval}.csv``.

    register(spark)
    bars = spark.read.format("symbol_files").load(folder)
    bars.filter("symbol = 'spx' AND interval = '1d' AND ts >= '2020-01-01'")

Filters on symbol and interval (equality, lists, text beginnings) choose the files
before any is opened, and each file is a partition of its own, read in batches.
Filters on ts drop rows as batches are read.  Folders are local or any that Arrow's
file systems open (``hdfs://``, ``s3://``, ``gs://``); names of columns may be in any
letter case.  Options: ``interval``, where names have none; ``batch_mb``.

Rows without a time are left out.  Numbers that can't be read are null.  Other files
of the folder are passed over; an empty folder gives no rows.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith
)

PRICES = ("open", "high", "low", "close", "volume")
SCHEMA = "symbol string, interval string, ts timestamp, " + ", ".join(f"{c} double" for c in PRICES)
TIMES = ("date", "ts", "time", "timestamp", "datetime")
NAME = re.compile(r"([^/]+?)(?:_([^/_]+))?\.csv$")
_UTC = dt.timezone.utc


class OneFile(InputPartition):
    def __init__(self, path: str, symbol: str, interval: str | None):
        super().__init__((symbol, interval))
        self.path, self.symbol, self.interval = path, symbol, interval


def keeps(filters: list[Filter], column: str, value: str | None) -> bool:
    """Whether a value can satisfy all filters on its column."""
    for f in filters:
        if f.attribute == (column,):
            if isinstance(f, EqualTo) and value != f.value or isinstance(f, In) and value not in f.value:
                return False
            if isinstance(f, StringStartsWith) and not (value or "").startswith(f.value):
                return False
    return True


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.interval, self.batch = options["path"], options.get("interval"), int(float(options.get("batch_mb", 4)) * (1 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            named = f.attribute in (("symbol",), ("interval",)) and isinstance(f, EqualTo | In | StringStartsWith)
            timed = f.attribute == ("ts",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual)
            if named or timed:
                self.filters.append(f)
            else:
                yield f  # Spark does it

    def partitions(self) -> list[InputPartition]:
        system, root = pyarrow.fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (pyarrow.fs.LocalFileSystem(), self.folder.removeprefix("file:"))
        out = []
        for info in sorted(system.get_file_info(pyarrow.fs.FileSelector(root)), key=lambda i: i.path):
            name = NAME.fullmatch(info.base_name)
            if not name or not info.is_file:
                continue
            symbol, interval = (name[1], name[2]) if self.interval is None else (name[1] + (f"_{name[2]}" if name[2] and name[2] != self.interval else ""), self.interval)
            if keeps(self.filters, "symbol", symbol) and keeps(self.filters, "interval", interval):
                out.append(OneFile(info.path, symbol, interval))
        return out

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty folder, or no file that the filters leave
            return
        system = pyarrow.fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder else pyarrow.fs.LocalFileSystem()
        with system.open_input_stream(partition.path) as f:
            head = f.read(self.batch).split(b"\n", 1)[0].decode("utf-8-sig").strip("\r")
        with system.open_input_stream(partition.path) as f:
            # columns as text: what is a number is told value by value
            names = [n.strip().strip('"') for n in head.split(",")]
            options = pyarrow.csv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=True)
            rows = pyarrow.csv.open_csv(f, pyarrow.csv.ReadOptions(column_names=names, skip_rows=1, block_size=self.batch), convert_options=options)
            for b in rows:
                yield from self.rows(b, partition)

    def rows(self, b: pa.RecordBatch, of: OneFile) -> Iterator[pa.RecordBatch]:
        names = {n.lower(): i for i, n in enumerate(b.schema.names)}
        when = next((c for c in TIMES if c in names), None)
        if when is None:
            raise ValueError(f"{of.path}: no column of times")
        ts = pa.array([_moment(v) for v in b.column(names[when]).to_pylist()], pa.timestamp("us", "UTC"))
        columns = [pa.array([_number(v) for v in b.column(names[c]).to_pylist()] if c in names else [None] * len(b), pa.float64()) for c in PRICES]
        kept = pc.is_valid(ts)
        for f in self.filters:
            if f.attribute == ("ts",):
                bound = f.value if f.value.tzinfo else f.value.replace(tzinfo=_UTC)
                test = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}[type(f)]
                kept = pc.and_(kept, test(ts, pa.scalar(bound, pa.timestamp("us", "UTC"))))
        out = pa.RecordBatch.from_arrays([pa.array([of.symbol] * len(b)), pa.array([of.interval] * len(b), pa.string()), ts, *columns], ["symbol", "interval", "ts", *PRICES])
        if (out := out.filter(pc.fill_null(kept, False))).num_rows:
            yield out


def _moment(v) -> dt.datetime | None:
    if isinstance(v, dt.datetime):
        return v if v.tzinfo else v.replace(tzinfo=_UTC)
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day, tzinfo=_UTC)
    try:
        out = dt.datetime.fromisoformat(str(v).strip())
    except ValueError:
        return None
    return out if out.tzinfo else out.replace(tzinfo=_UTC)


def _number(v) -> float | None:
    try:
        return None if v is None else float(v)
    except (TypeError, ValueError):
        return None


class SymbolFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "symbol_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known, and let Spark hand filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SymbolFiles)


def load_data(spark: SparkSession, folder: str, symbols: list[str] | None = None, interval: str = "1d", start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of some symbols (all, if none are named) of one interval, both ends of the
    span included."""
    register(spark)
    rows = spark.read.format("symbol_files").load(folder).filter(f"interval = '{interval}'")
    if symbols is not None:
        rows = rows.filter(rows["symbol"].isin(symbols))
    for sign, value in ((">=", start), ("<=", end)):
        if value:
            rows = rows.filter(f"ts {sign} TIMESTAMP '{value}'")
    return rows
