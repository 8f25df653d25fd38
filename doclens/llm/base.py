"""Registry of the queries of this subpackage, and small shared helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclens.files import opened
from doclens.session import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query builder, with its SQL twin where one exists."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def wide_rows(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Smaller Arrow batches for what is run inside: rows that carry whole sets are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner see which shuffles of finished steps nobody refers to any more, so that it deletes their files."""
    spark._jvm.System.gc()


def discard(done: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that no later step reads; what was made from it is written, too."""
    files = done.inputFiles()
    if files:
        jvm = done.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0].rsplit("/", 1)[0]))
        folder.getFileSystem(done.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def block_rows(folder: str, number: int, columns: list[str]) -> pa.Table | None:
    """Inside a task: the rows of one block of a table that was written by ``block``; None if it has none."""
    system, path = opened(folder)
    files = system.get_file_info(fs.FileSelector(f"{path}/block={number}", allow_not_found=True))
    names = sorted(f.path for f in files if f.base_name.endswith(".parquet"))
    parts = [pq.ParquetFile(system.open_input_file(n)).read(columns) for n in names]
    return pa.concat_tables(parts).combine_chunks() if parts else None


# --- membership bitmap -------------------------------------------------------
BITMAP_BITS = 27  # 2**27 bits: 16 MB, whatever the size of the table


class Bitmap:
    """A fixed-size membership filter over 64-bit keys: false positives, never a false negative."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def bitmap(keys: DataFrame, column: str, bits: int = BITMAP_BITS) -> Bitmap:
    """The bitmap of a long column whose values are well mixed; at most ``2**bits / 64`` rows reach the driver."""
    place = F.shiftrightunsigned(F.col(column), 64 - bits)
    found = (
        keys.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, int(shiftrightunsigned({column}, {64 - bits}) & 63))").alias("mask"))
        .groupBy("word")
        .agg(F.bit_or("mask").alias("mask"))
        .toArrow()
    )
    words = np.zeros(1 << (bits - 6), np.int64)
    words[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    return Bitmap(words.view(np.uint64), bits)


# --- prefix sums over an order -------------------------------------------------
def with_starts(df: DataFrame, order: list[str], weight: str, group: str | None, purpose: str) -> DataFrame:
    """Add ``start``: the sum of ``weight`` over all earlier rows in ``order`` (of the same ``group``).

    The rows are range-partitioned by ``order``. Each task sums its own rows; only one total
    per task and group is summed across tasks. Rows that tie in the whole order are alike
    and follow each other in any order. ``weight`` is a long and not null.
    """
    spark = df.sparkSession
    names = df.columns
    ranged = df.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order).withColumn("_task", F.spark_partition_id())

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            weights = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.zeros(len(weights), np.int64)
            keys = batch.column(group).to_numpy(zero_copy_only=False) if group else np.zeros(len(weights), np.int8)
            for key in np.unique(keys).tolist():
                own = np.flatnonzero(keys == key)
                upto = np.cumsum(weights[own])
                starts[own] = sums.get(key, 0) + upto - weights[own]
                sums[key] = sums.get(key, 0) + (int(upto[-1]) if len(own) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts)], [*batch.schema.names, "_start"])

    schema = T.StructType([*ranged.schema.fields, T.StructField("_start", T.LongType())])
    local = written(ranged.mapInArrow(running, schema), purpose)
    keys = [group] if group else []
    totals = local.groupBy("_task", *keys).agg(F.sum(weight).alias("_sum"))
    # one row per task and group: bounded by the cluster's own settings
    earlier = totals.select(
        "_task", *keys,
        F.expr(f"sum(_sum) OVER ({'PARTITION BY ' + group if group else ''} ORDER BY _task) - _sum").alias("_before"),
    )
    joined = local.join(F.broadcast(earlier), ["_task", *keys])
    return joined.select(*names, (F.col("_start") + F.col("_before")).alias("start"))
