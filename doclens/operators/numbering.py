"""Row numbers over a whole table without a window over one task."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclens.session import small_table, written


def number_rows(df: DataFrame, order: list[str], output: str = "code") -> DataFrame:
    """Add ``output``: 0, 1, 2 ... in the order of the columns ``order``, nulls first.

    A table that is proven small is numbered where it is. Others are range-partitioned and written, sorted within their
    tasks; each task's numbers begin after the counts of the tasks before it, and only those counts reach the driver. Rows that
    tie in the whole order follow each other in any order.
    """
    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.LongType())])
    table = small_table(df)
    if table is not None:
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in order], null_placement="at_start")) if table.num_rows else table
        return F.broadcast(spark.createDataFrame(table.append_column(output, pa.array(range(table.num_rows), pa.int64())), schema=schema))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed = written(sorted_rows.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    # the upper bits of the place are the task, the lower 33 the row in it
    task = F.shiftright("_place", 33)
    counts = dict(placed.groupBy(task.alias("t")).count().collect())
    starts, total = [], 0
    for t in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(t, 0)
    begin = F.get(F.array(*(F.lit(x).cast("long") for x in starts)), task.cast("int"))
    return placed.withColumn(output, begin + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_place")
