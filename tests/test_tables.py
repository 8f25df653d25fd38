import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from doclens.sources.tables import read_screening_table, spread


def _tasks(df):
    return df.select(F.spark_partition_id().alias("t")).groupBy("t").count().count()


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_spread_counts_tasks_that_have_rows(spark, tmp_path):
    rows = pa.table({"id": list(range(4000)), "text": [f"{i} " * 50 for i in range(4000)]})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # many byte ranges
        for name, size, files, dealt in (("one", 4000, 1, True), ("many", 100, 1, False), ("files", 4000, 8, False)):
            (tmp_path / name).mkdir()
            for f in range(files):
                pq.write_table(rows, tmp_path / name / f"{f}.parquet", row_group_size=size, compression="none")
            df = spark.read.parquet(str(tmp_path / name))
            out = spread(df)
            assert (_exchanges(out) > 0) == dealt, name
            assert _tasks(out) >= 4 and out.count() == 4000 * files
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_spread_of_an_empty_table(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "none"))
    assert spread(spark.read.parquet(str(tmp_path / "none"))).count() == 0


def test_screening_table_rows(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(50).repartition(3).write.parquet(path)
    read = lambda *a: [r["id"] for r in read_screening_table(spark, path, *a).collect()]
    assert sorted(read()) == sorted(read(0)) == sorted(read(-1)) == list(range(50))
    assert read(7, "id") == list(range(7)) and len(read(7)) == 7 and len(read(99)) == 50
