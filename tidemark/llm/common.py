"""What the operators share: staged tables in the cluster's shared folder, row
order over a whole table without a single-task sort, vocabulary files."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.
    Where it is unset the context's own checkpoint folder, or, in one JVM (as in
    tests), a new temporary one; elsewhere that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not own:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """How many rows Python workers get at a time in what runs meanwhile (texts are
    long, and the default of ten thousand takes much memory)."""
    option = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(option)
    if rows:
        spark.conf.set(option, str(rows))
    try:
        yield
    finally:
        spark.conf.set(option, before)


def stage(df: DataFrame, name: str, path: str | None = None, rows_at_once: int | None = None, group_mb: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage, survives lost executors and fixes row ids and partition numbers.
    ``rows_at_once``: how many rows Python workers get at a time meanwhile.
    ``group_mb``: for rows of a MB, of which a reader would hold thousands; it holds
    a row group at most, and these then end with the row that exceeds so much."""
    spark, path = df.sparkSession, path or new_path(df.sparkSession, name)
    out = df.write.mode("overwrite").option("compression", "zstd")
    if group_mb:  # and sizes are looked at after every row
        out = out.option("parquet.block.size", str(group_mb << 20)).option("parquet.page.size.row.check.min", "1").option("parquet.page.size.row.check.max", "1")
    with arrow_rows(spark, rows_at_once):
        out.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_staged_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def vocabulary(name_or_path: str) -> str:
    """A vocabulary file: a path as it is, or a bare name looked up among the
    installed public tokenizers (on whichever machine this runs)."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered(df: DataFrame, *order, name: str = "ordered", partitions: int | None = None) -> DataFrame:
    """Stage ``df`` range-partitioned and sorted by ``order``, with ``_part``
    (rising with the order) and ``_pos`` (place within the part, from 0).
    Only small rows should be passed: ids and counts, not texts."""
    n = partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranked = parts.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    # the low 33 bits of the generated id count the rows of a partition in its sorted order
    ranked = ranked.withColumn("_pos", F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_row")
    return stage(ranked, name)


def part_offsets(parts: DataFrame, value) -> DataFrame:
    """Per ``_part`` of an ``ordered`` table the sum of ``value`` over all
    earlier parts (``_before``).  One row per partition: the window is small
    however many rows the table has."""
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_sum"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", F.coalesce(F.sum("_sum").over(w), F.lit(0)).cast("long").alias("_before"))


def running_start(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one in
    ``order``, and ``_part``, which rises with it; staged.  Two small shuffles; no
    task sees the whole table."""
    o = ordered(df, *[F.col(c).asc_nulls_first() for c in order], name="prefix")
    w = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(value).over(w), F.lit(0))
    placed = o.withColumn("_local", local).join(part_offsets(o, F.col(value)), "_part")
    placed = stage(placed.withColumn(out, (F.col("_local") + F.col("_before")).cast("long")).drop("_local", "_before", "_pos"), "starts")
    drop(o)
    return placed


def broadcast_if_small(df: DataFrame, most_mb: int = 4) -> DataFrame:
    """A staged table, marked for broadcast if its files are under ``most_mb``
    (it is then held in some four times that memory); otherwise as it is, and
    the join shuffles."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return F.broadcast(df) if size <= most_mb << 20 else df


def join_skewed(left: DataFrame, right: DataFrame, on: str, rows_of: str, most: int, how: str = "left") -> DataFrame:
    """``left`` with the columns of ``right`` (one row per key; a left or an
    inner join), where ``rows_of`` tells how many rows of ``left`` a key has.  Keys of more than
    ``most`` rows are broadcast, and there are at most rows / ``most`` of them, so
    that no task takes a hot key's rows; the others shuffle.  Rows of null keys stay
    where they are."""
    hot, cold = right.filter(F.col(rows_of) > most).drop(rows_of), right.filter(F.col(rows_of) <= most).drop(rows_of)
    met = left.join(F.broadcast(hot), on)
    rest = left.filter(F.col(on).isNotNull()).join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on, how)
    if how == "inner":
        return met.unionByName(rest)
    none = left.filter(F.col(on).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in hot.schema if f.name != on])
    return met.unionByName(rest).unionByName(none)
