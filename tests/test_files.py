"""The source of price files: rows as the reader of single files gives them, and
only the files that filters leave are opened."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files, readers


@pytest.fixture
def folder(tmp_path):
    head = "Date,Open,High,Low,Close,Volume\n"
    rows = lambda k, n: "".join(f"2020-01-{i:02d},{k},{k + 2}.5,{k - 1},{k + 1},{'x' if i == 3 else i * 10}\n" for i in range(1, n + 1))
    (tmp_path / "spx_1d.csv").write_text("﻿" + head + rows(10, 20))
    (tmp_path / "ndx_1d.csv").write_text(head.lower() + rows(20, 9) + ",1,2,3,4,5\n")
    (tmp_path / "spx_1h.csv").write_text("time,open,high,low,close\n2020-01-01 10:00:00,1,2,0,1\n2020-01-01 11:00:00,1,,0,1\n")
    (tmp_path / "notes.txt").write_text("no prices")
    return str(tmp_path)


def test_rows_are_those_of_the_reader(spark, folder):
    for symbol, interval, start, end in (("spx", "1d", None, None), ("ndx", "1d", "2020-01-03", "2020-01-07"), ("spx", "1h", None, None)):
        got = files.load_data(spark, folder, [symbol], interval, start, end)
        want = readers.read_symbol(spark, folder, symbol, interval, start, end)
        columns = [c for c in ("symbol", "ts", "open", "high", "low", "close", "volume") if c in want.columns]
        show = lambda d: sorted(tuple(map(str, r)) for r in d.select(*columns).collect())
        assert show(got) == show(want) != []


def test_files_that_filters_exclude_are_not_opened(spark, folder):
    files.register(spark)
    for bad in ("ndx_1d.csv", "spx_1h.csv"):
        os.chmod(os.path.join(folder, bad), 0o000)
        with open(os.path.join(folder, "broken_" + bad), "wb") as f:
            f.write(b"nothing that can be read\n1\n")
    table = spark.read.format("symbol_files").load(folder)
    assert table.filter("symbol = 'spx' AND interval = '1d'").count() == 20
    assert table.filter(F.col("symbol").isin("spx") & (F.col("interval") == "1d") & (F.col("ts") > "2020-01-15")).count() == 5
    assert table.filter("symbol = 'none'").count() == 0
    with pytest.raises(Exception, match="broken_|no column of times|Permission"):
        table.filter("symbol LIKE 'broken%'").collect()


def test_partitions_and_pushed_filters(folder):
    reader = files.Reader({"path": folder})
    assert sorted((p.symbol, p.interval) for p in reader.partitions()) == [("ndx", "1d"), ("spx", "1d"), ("spx", "1h")]
    left = list(reader.pushFilters([files.EqualTo(("symbol",), "spx"), files.StringStartsWith(("interval",), "1d"), files.GreaterThan(("close",), 3.0)]))
    assert [f.attribute for f in left] == [("close",)] and [(p.symbol, p.interval) for p in reader.partitions()] == [("spx", "1d")]


def test_an_empty_folder(spark, tmp_path):
    assert files.load_data(spark, str(tmp_path)).collect() == []
