"""Table scans and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENTS_CSV_SCHEMA = T.StructType(
    [
        T.StructField("resume_text", T.StringType()),
        T.StructField("category", T.StringType()),
    ]
)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a few files over all cores before per-row text work.

    A row group is read by one task, however many byte ranges its file is cut into. Of many files nothing is
    shuffled; of few, the tasks that get rows are counted from the footers, and the rows are dealt when these
    tasks are less than half as many as the cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if 2 * len(df.inputFiles()) >= cores:
        return df
    filled = df.select(F.spark_partition_id().alias("task")).distinct().count()
    return df if 2 * filled >= cores else df.repartition(cores)


def read_documents_csv(
    spark: SparkSession, path: str | None, schema: T.StructType = DOCUMENTS_CSV_SCHEMA, multi_line: bool = True
) -> DataFrame:
    """CSV with quoted text; the schema is declared, never inferred.

    A multi-line CSV file cannot be split, so it is one task: turn ``multi_line``
    off for files whose texts have no line breaks.
    """
    if not path:
        raise ValueError("no data path given")
    return spark.read.schema(schema).csv(path, header=True, multiLine=multi_line, quote='"', escape='"')


def read_screening_table(
    spark: SparkSession, path: str, max_rows: int | None = None, id_column: str | None = None
) -> DataFrame:
    """Parquet scan; with ``max_rows`` > 0 the first rows (by id when one is named)."""
    df = spark.read.parquet(path)
    if max_rows is None or max_rows <= 0:
        return df
    return (df.orderBy(id_column) if id_column else df).limit(max_rows)


def write_documents(df: DataFrame, path: str, file_format: str = "parquet") -> str:
    """Write a document table; each task writes its own part. CSV has a header and quoted text."""
    writer = df.write.mode("overwrite")
    if file_format == "csv":
        writer.csv(path, header=True, quote='"', escape='"')
    else:
        writer.format(file_format).save(path)
    return path


def write_metrics(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


# -- reports -----------------------------------------------------------------------


def _present(df: DataFrame, column: str, default: Column) -> Column:
    return F.coalesce(F.col(column), default) if column in df.columns else default


def _joined(df: DataFrame, column: str) -> Column:
    return F.array_join(_present(df, column, F.array().cast("array<string>")), ", ")


def _rounded(df: DataFrame, column: str) -> Column:
    return F.round(_present(df, column, F.lit(0.0)), 4)


def shortlist_report(ranked: DataFrame, top_n: int = 10) -> DataFrame:
    """The first ``top_n`` rows of each job's ranking as a flat report."""
    unknown = F.lit("Unknown")
    return ranked.filter(F.col("rank") <= top_n).select(
        "job_id",
        "rank",
        _present(ranked, "filename", unknown).alias("candidate_name"),
        _rounded(ranked, "similarity_score").alias("similarity_score"),
        _rounded(ranked, "skill_match_score").alias("skill_match_score"),
        _rounded(ranked, "combined_score").alias("combined_score"),
        _present(ranked, "decision", unknown).alias("decision"),
        _joined(ranked, "matched_skills").alias("matched_skills"),
        _joined(ranked, "missing_skills").alias("missing_skills"),
        _joined(ranked, "resume_skills").alias("all_resume_skills"),
    )


def export_results(ranked: DataFrame) -> DataFrame:
    """Export table with display headers and the 1-based rank per job."""
    return ranked.select(
        F.col("job_id").alias("Job"),
        F.col("rank").alias("Rank"),
        F.col("filename").alias("Filename"),
        F.col("decision").alias("Decision"),
        _rounded(ranked, "combined_score").alias("Combined Score"),
        _rounded(ranked, "similarity_score").alias("Similarity Score"),
        _rounded(ranked, "skill_match_score").alias("Skill Match"),
        _present(ranked, "predicted_category", F.lit("")).alias("Predicted Category"),
        _rounded(ranked, "category_confidence").alias("Category Confidence"),
        _joined(ranked, "matched_skills").alias("Matched Skills"),
        _joined(ranked, "missing_skills").alias("Missing Skills"),
    )
