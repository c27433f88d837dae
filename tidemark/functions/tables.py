"""Table functions: detectors, samplers and the state machine in SQL text.

    register(spark)
    SELECT * FROM detect(TABLE(series) PARTITION BY symbol ORDER BY (ts), 'cusum', 100.0)
    SELECT * FROM detect(TABLE(series) PARTITION BY symbol ORDER BY (ts), 'cusum', 100.0, h => 0.05)
    SELECT * FROM sample_events(TABLE(dif) PARTITION BY symbol ORDER BY (ts), 'swt', 30.0, b2b => 2)
    SELECT * FROM sample_many(TABLE(dif) PARTITION BY symbol ORDER BY (ts), 'swt 30 2, cum 60 2, gma 9')
    SELECT * FROM market_state(TABLE(bars) PARTITION BY symbol ORDER BY (ts), 'cusum', 30.0)

Spark partitions and sorts the table; a partition is one pass of the same kernel
as in ``operators``.  Methods and options are checked when the query is planned,
and the types of symbol and ts are those of the table.  Rows without a value are
passed over.  Rows must come in order of ts within a symbol (an error if not);
repeated ts are taken in the order they come in.
"""

from __future__ import annotations

import dataclasses
import inspect
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.types import BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tidemark.operators import detect, kernels, sampling, structure, wbs

SQL_TYPES: dict[str, DataType] = {"string": StringType(), "double": DoubleType(), "boolean": BooleanType(), "int": IntegerType(), "long": LongType()}


def _columns(rows: AnalyzeArgument, *needed: str) -> StructType:
    if not rows.isTable:
        raise ValueError("the first argument is a table: TABLE(name) PARTITION BY symbol ORDER BY (ts)")
    missing = [c for c in needed if c not in rows.dataType.names]
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    return rows.dataType


def _constant(argument: AnalyzeArgument | None, name: str, default=None):
    if argument is None:
        return default
    if not argument.isConstantExpression or argument.value is None:
        raise ValueError(f"{name} must be a constant")
    return argument.value


def _plain(value):
    """A constant as the kernels take it: decimals of SQL text are doubles."""
    return float(value) if hasattr(value, "as_tuple") else value


def _known_options(cls, options: dict) -> None:
    known = {f.name for f in dataclasses.fields(cls) if f.init} if dataclasses.is_dataclass(cls) else set(inspect.signature(cls).parameters)
    if unknown := set(options) - known:
        raise ValueError(f"unknown options {', '.join(sorted(unknown))}; known: {', '.join(sorted(known))}")


class _Ordered:
    """One symbol's rows in order.  Another symbol in the same partition (a table
    that isn't partitioned by symbol) begins anew."""

    def __init__(self):
        self.symbol, self.last_ts, self.begun = None, None, False

    def moved(self, symbol, ts) -> bool:
        """Whether this row begins a series."""
        new = not self.begun or symbol != self.symbol
        if not new and ts < self.last_ts:
            raise ValueError(f"rows of {symbol!r} are not in order of ts: use PARTITION BY symbol ORDER BY (ts)")
        self.symbol, self.last_ts, self.begun = symbol, ts, True
        return new


class Detect(_Ordered):
    """Events of one detector: symbol, ts, idx, direction, direction_source, score,
    change_ts."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, method: AnalyzeArgument, q: AnalyzeArgument | None = None, **options: AnalyzeArgument) -> AnalyzeResult:
        table = _columns(rows, "symbol", "ts", "value")
        name = str(_constant(method, "method")).lower()
        if name in ("wbs", "wbs_lepage"):
            known = set(inspect.signature(wbs.segment).parameters)
            if unknown := set(options) - known:
                raise ValueError(f"unknown options {', '.join(sorted(unknown))}")
        else:
            kernels.make(name)
            _known_options(kernels.KERNELS[name], options)
        _constant(q, "q")
        ts = table["ts"].dataType
        return AnalyzeResult(_schema(symbol=table["symbol"].dataType, ts=ts, idx=LongType(), direction=IntegerType(), direction_source=StringType(), score=DoubleType(), change_ts=ts))

    def eval(self, rows, method, q=1.0, **options) -> Iterator[tuple]:
        if rows["value"] is None or (value := float(rows["value"])) != value:
            return
        if self.moved(rows["symbol"], rows["ts"]):
            yield from self.close() if hasattr(self, "values") else ()
            self.of, self.i, self.before, self.values, self.stamps = rows["symbol"], -1, None, [], []
            self.method, self.q, self.options = method.lower(), float(q), {k: _plain(v) for k, v in options.items()}
            whole = self.method in ("wbs", "wbs_lepage") or kernels.KERNELS[self.method] is kernels.SegmentBeam
            self.kernel = None if whole else kernels.make(self.method, self.q, **self.options)
        self.i += 1
        if self.kernel is None:  # these look back from the end
            self.values.append(value)
            self.stamps.append(rows["ts"])
            return
        x = value if self.kernel.on == "level" else math.nan if self.before is None else value - self.before
        self.before = value
        if math.isfinite(x) and (event := self.kernel.step(x)):
            score = event[1] if math.isfinite(event[1]) else None
            yield self.of, rows["ts"], self.i, int(event[0]), self.kernel.source, None if score is None else float(score), None

    def close(self) -> Iterator[tuple]:
        stamps = np.empty(len(self.stamps), object)
        stamps[:] = self.stamps
        if len(self.values):
            for ts, i, way, source, score, change in detect.series_events(stamps, np.array(self.values), self.method, self.q, self.options):
                yield self.of, ts, int(i), int(way), source, score, change
        self.values, self.stamps = [], []

    def terminate(self) -> Iterator[tuple]:
        yield from self.close() if hasattr(self, "values") else ()


class SampleEvents(_Ordered):
    """symbol and ts of sampled events; the threshold is a number, or the column
    ``thr`` of the table where it is left out."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, method: AnalyzeArgument, threshold: AnalyzeArgument | None = None, b2b: AnalyzeArgument | None = None, **options: AnalyzeArgument) -> AnalyzeResult:
        table = _columns(rows, "symbol", "ts", "x", *([] if threshold is not None else ["thr"]))
        name = _constant(method, "method")
        if name not in sampling.SAMPLERS:
            raise ValueError(f"unknown method {name!r}; known: {', '.join(sampling.SAMPLERS)}")
        _known_options(sampling.SAMPLERS[name], options)
        return AnalyzeResult(_schema(symbol=table["symbol"].dataType, ts=table["ts"].dataType))

    def eval(self, rows, method, threshold=None, b2b=1, **options) -> Iterator[tuple]:
        if rows["x"] is None or not math.isfinite(rows["x"]):
            return
        if self.moved(rows["symbol"], rows["ts"]):
            self.run, self.sampler = 0, sampling.SAMPLERS[method](**{k: _plain(v) for k, v in options.items()})
        limit = float(threshold) if threshold is not None else math.inf if rows["thr"] is None or not math.isfinite(rows["thr"]) else float(rows["thr"])
        stat = self.sampler.stat(float(rows["x"]))
        if stat is None:
            return
        if not stat > max(0.0, limit):
            self.run = 0
            self.sampler.below()
            return
        self.run += 1
        if self.run >= b2b:
            self.run = 0
            self.sampler.fired(float(rows["x"]))
            yield rows["symbol"], rows["ts"]


class SampleMany(_Ordered):
    """method, symbol and ts of sampled events of several methods in one pass, since it is
    dear to hand a row over: of each its name, threshold and b2b (1 where it is left out)."""

    @staticmethod
    def table(text: str) -> list[tuple[str, float, int]]:
        out = []
        for method, threshold, *b2b in (part.split() for part in text.split(",")):
            if method not in sampling.SAMPLERS:
                raise ValueError(f"unknown method {method!r}; known: {', '.join(sampling.SAMPLERS)}")
            limit = float(threshold)
            out.append((method, max(0.0, limit) if math.isfinite(limit) else math.inf, int(b2b[0]) if b2b else 1))
        return out

    @staticmethod
    def analyze(rows: AnalyzeArgument, methods: AnalyzeArgument) -> AnalyzeResult:
        table = _columns(rows, "symbol", "ts", "x")
        SampleMany.table(_constant(methods, "methods"))
        return AnalyzeResult(_schema(method=StringType(), symbol=table["symbol"].dataType, ts=table["ts"].dataType))

    def __init__(self):
        super().__init__()
        self.x, self.stamps = [], []

    def eval(self, rows, methods) -> list[tuple] | None:
        _, ts, x = row = rows["symbol"], rows["ts"], rows["x"]
        if x is None or not math.isfinite(x):
            return None
        of, out = self.symbol, None
        if self.moved(*row[:2]):
            out = self.found(of)
            self.passes = [(m, limit, sampling.Pass(m, b2b)) for m, limit, b2b in self.table(methods)]
        self.x.append(float(x))
        self.stamps.append(ts)
        return out if out or len(self.x) < 4096 else self.found(self.symbol)

    def found(self, symbol) -> list[tuple]:
        """Events of the rows that have come together."""
        if not self.x:
            return []
        x, stamps, self.x, self.stamps = np.array(self.x), self.stamps, [], []
        return [(m, symbol, stamps[i]) for m, limit, one in self.passes for i in one.feed(x, np.full(len(x), limit))]

    def terminate(self) -> list[tuple]:
        return self.found(self.symbol)


class MarketState(_Ordered):
    """A state row per bar: symbol and the 57 fields.  Of bars with the same ts the
    first counts; prices must be complete."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, method: AnalyzeArgument | None = None, q: AnalyzeArgument | None = None, lag: AnalyzeArgument | None = None, reset_on_change: AnalyzeArgument | None = None, **options: AnalyzeArgument) -> AnalyzeResult:
        table = _columns(rows, "symbol", "ts", "open", "high", "low", "close")
        name = str(_constant(method, "method", "cusum")).lower()
        kernels.make(name)
        _known_options(kernels.KERNELS[name], options)
        kinds = SQL_TYPES | {"timestamp": table["ts"].dataType}
        return AnalyzeResult(_schema(symbol=table["symbol"].dataType, **{c: kinds[structure.TYPES[c]] for c in structure.FIELDS}))

    def eval(self, rows, method="cusum", q=1.0, lag=0, reset_on_change=False, **options) -> Iterator[tuple]:
        bar = [rows[c] for c in ("open", "high", "low", "close")]
        if any(v is None or not math.isfinite(v) for v in bar):
            return
        before = self.last_ts if self.begun and rows["symbol"] == self.symbol else None
        if self.moved(rows["symbol"], rows["ts"]):
            self.machine = structure.Machine(method.lower(), float(q), {k: _plain(v) for k, v in options.items()}, int(lag), bool(reset_on_change))
        elif before == rows["ts"]:
            return
        row = self.machine.step(rows["ts"], *map(float, bar))
        yield (rows["symbol"], *[_sql(row[c]) for c in structure.FIELDS])


def _sql(value):
    """NaN and infinities are nulls; numpy's numbers are Python's."""
    value = value.item() if isinstance(value, np.generic) else value
    return None if isinstance(value, float) and not math.isfinite(value) else value


def _schema(**columns: DataType) -> StructType:
    out = StructType()
    for name, kind in columns.items():
        out.add(name, kind)
    return out


FUNCTIONS = {"detect": Detect, "sample_events": SampleEvents, "sample_many": SampleMany, "market_state": MarketState}


def register(spark: SparkSession, *names: str) -> None:
    """Make the table functions (all, or those named) known to SQL text."""
    from pyspark.sql.functions import udtf

    for name in names or FUNCTIONS:
        spark.udtf.register(name, udtf(FUNCTIONS[name]))
