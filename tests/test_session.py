import glob
import time

from doclens.session import written
from pyspark.sql import functions as F


def _shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for folder in folders for f in glob.glob(f"{folder}/**/shuffle_*", recursive=True)}


def test_written_tables_leave_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    counts = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    joined = counts.join(spark.range(200).select(F.col("id").alias("k")).repartition(3, "k"), "k")
    flag = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(flag)
    done = written(joined, "counted")
    assert spark.conf.get(flag) == kept
    for _ in range(50):  # executors delete in the background
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    assert done.agg(F.sum("n"), F.count("k")).first() == (10_000, 100)
    assert joined.count() == 100  # can be computed again
