"""Screening of documents as they arrive: a per-job leaderboard kept by a stream.

A document that comes again replaces its earlier version, so it can fall, and another that was not listed can rise.
The state of a job is a pool of more documents than it lists, and a floor: nothing outside the pool ranks above it. Each
micro-batch is ranked by the batch operator and merged with the pool; documents sent again leave it first. What
ranks below the floor leaves the pool, too. While the pool still fills the list, the list is exact. When falling
documents have used it up, the job's pool is made anew from the last versions of all documents, which are kept as they
arrive; only such jobs pay for that.

Each micro-batch writes a version named after it. Replaying a batch rewrites its own version from the one before it, so a
restart cannot count a document twice. The last two versions are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from doclens.operators import rank
from doclens.session import written

_COLUMNS = [
    "job_id", "doc_id", "similarity_score", "skill_match_score", "combined_score", "matched_skills",
    "missing_skills", "resume_skills",
]


def _folder(spark: SparkSession, path: str):
    """``(file system, path)`` of a folder, whatever store it is in."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _written_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose writing ended, from their names; an unreadable folder is an error."""
    system, folder = _folder(spark, path)
    if not system.exists(folder):
        return []
    names = [f.getPath().getName() for f in system.listStatus(folder)]
    found = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
    return sorted(v for v in found if system.exists(_folder(spark, f"{path}/version={v}/_SUCCESS")[1]))


def pool_size(top_n: Column) -> Column:
    """Documents kept for a job that lists ``top_n``."""
    return 2 * top_n + 10


def last_versions(documents: DataFrame, text_column: str, id_column: str, order: list[str]) -> DataFrame:
    """One row ``(id, text)`` per document: the last in ``order``, of rows alike in it the one whose text has the larger digest."""
    latest = F.max(F.struct(*order, F.md5(F.coalesce(F.col(text_column), F.lit(""))).alias("_digest"), F.col(text_column).alias("_text")))
    return documents.groupBy(id_column).agg(latest.alias("_last")).select(id_column, F.col("_last._text").alias(text_column))


def _with_floors(ranked: DataFrame) -> DataFrame:
    """Mark rows of a ranking, and where it was cut off add a floor right behind its last row."""
    members = ranked.withColumn("is_floor", F.lit(False))
    cut = members.filter(F.col("rank") == F.col("pool")).withColumn("is_floor", F.lit(True))
    return members.unionByName(cut)


def merged_pools(rows: DataFrame) -> DataFrame:
    """Pools from members and floors: members above the highest floor, ``pool`` of them at most, and the new floor of each job.

    Unlisted documents rank behind the floor.
    """
    order = Window.partitionBy("job_id").orderBy(F.col("combined_score").desc(), F.col("doc_id"), "is_floor")
    placed = rows.withColumn("_floors", F.sum(F.col("is_floor").cast("int")).over(order)).withColumn("rank", F.row_number().over(order))
    # members above all floors, and what comes next: the highest floor, or the first member that has no place left
    above = placed.filter("rank <= pool + 1 AND (_floors = 0 OR (_floors = 1 AND is_floor))")
    return above.withColumn("is_floor", F.col("is_floor") | (F.col("rank") > F.col("pool"))).drop("_floors")


def merge_batch(
    jobs: DataFrame, path: str, text_column: str, id_column: str, version_column: str | None = None
) -> Callable[[DataFrame, int], None]:
    usable = rank.valid_jobs(jobs).withColumn("_listed", F.col("top_n")).withColumn("top_n", pool_size(F.col("top_n")))
    limits = usable.select("job_id", F.col("top_n").cast("int").alias("pool"), F.col("_listed").cast("int").alias("listed"))
    order = [version_column] if version_column else []

    def ranked(wanted: DataFrame, documents: DataFrame) -> DataFrame:
        found = rank.rank_with_skills(wanted.drop("_listed"), documents, text_column, id_column).select("rank", *_COLUMNS)
        return _with_floors(found.join(limits, "job_id"))

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = f"{path}/documents"
        arrived = batch.select(id_column, text_column, *order)
        arrived.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
        arrived = spark.read.schema(arrived.schema).parquet(f"{log}/batch={batch_id}")
        earlier = [v for v in _written_versions(spark, path) if v < batch_id]
        newest = last_versions(arrived, text_column, id_column, order)
        if version_column and earlier:  # an older version that comes late changes nothing
            newest = _still_newest(spark, log, arrived, newest, batch_id, id_column, version_column)
        rows = ranked(usable, newest)
        if earlier:
            pools = spark.read.schema(rows.schema).parquet(f"{path}/version={earlier[-1]}")
            again = newest.select(F.col(id_column).alias("doc_id")).distinct().withColumn("_again", F.lit(True))
            kept = pools.join(again, "doc_id", "left").filter(F.col("is_floor") | F.col("_again").isNull())
            rows = rows.unionByName(kept.select(*rows.columns))
        merged = written(merged_pools(rows), "pools")
        spent = (
            merged.groupBy("job_id", "listed").agg(F.count_if(~F.col("is_floor")).alias("n"), F.bool_or("is_floor").alias("cut"))
            .filter(F.col("cut") & (F.col("n") < F.col("listed"))).select("job_id")
        )
        spent = written(spent, "spent")
        if not spent.isEmpty():
            every = spark.read.schema(T.StructType([*arrived.schema.fields, T.StructField("batch", T.LongType())])).parquet(log)
            known = last_versions(every.filter(F.col("batch") <= batch_id), text_column, id_column, [*order, "batch"])
            anew = merged_pools(ranked(usable.join(F.broadcast(spent), "job_id", "left_semi"), known))
            merged = merged.join(F.broadcast(spent), "job_id", "left_anti").unionByName(anew)
        merged.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        for old in earlier[:-1]:
            system, folder = _folder(spark, f"{path}/version={old}")
            system.delete(folder, True)

    return merge


def _still_newest(
    spark: SparkSession, log: str, arrived: DataFrame, newest: DataFrame, batch_id: int, id_column: str, version_column: str
) -> DataFrame:
    """``newest`` without documents of which an earlier batch brought a later version."""
    every = spark.read.schema(T.StructType([*arrived.schema.fields, T.StructField("batch", T.LongType())])).parquet(log)
    before = every.filter(F.col("batch") < batch_id).groupBy(id_column).agg(F.max(version_column).alias("_before"))
    own = arrived.groupBy(id_column).agg(F.max(version_column).alias("_own"))
    late = own.join(before, id_column).filter(F.col("_before") > F.col("_own")).select(id_column)
    return newest.join(late, id_column, "left_anti")


def screen_stream(
    jobs: DataFrame,
    documents: DataFrame,
    path: str,
    checkpoint: str,
    text_column: str = "text",
    id_column: str = "doc_id",
    available_now: bool = False,
    version_column: str | None = None,
) -> StreamingQuery:
    """Start the stream. ``documents`` is a streaming DataFrame with id and text columns.

    Of a document that comes several times the last version counts: that with the largest ``version_column`` if one is named,
    else that of the last batch, and within a batch the one whose text has the larger digest.
    """
    writer = documents.writeStream.foreachBatch(merge_batch(jobs, path, text_column, id_column, version_column)).option(
        "checkpointLocation", checkpoint
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def leaderboard(jobs: DataFrame, path: str) -> DataFrame:
    """Latest leaderboard with decisions."""
    versions = _written_versions(jobs.sparkSession, path)
    if not versions:
        raise ValueError(f"no leaderboard in {path}")
    pools = jobs.sparkSession.read.parquet(f"{path}/version={versions[-1]}")
    board = pools.filter(~F.col("is_floor") & (F.col("rank") <= F.col("listed"))).select("rank", *_COLUMNS)
    return rank.apply_decisions(board, jobs)
