"""Job-by-document scoring, ranking, decisions and summaries."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens import lexicon as lx
from doclens.functions import scores as sc
from doclens.functions import text as tx
from doclens.operators import nearest
from doclens.operators.vectors import count_buckets
from doclens.session import broadcast_if_small

_SKILL_NAMES = list(lx.SKILLS)


def build_job_text() -> Column:
    """Job text from the fields of a job request; a default sentence when all are empty."""

    def part(column: str, before: str = "", after: str = "") -> Column:
        value = F.col(column)
        return F.when(value != "", F.concat(F.lit(before), value, F.lit(after)))

    years = F.col("experience_years")
    text = F.concat_ws(
        ". ",
        part("job_title", "Looking for a "),
        part("seniority", after=" level"),
        F.when(
            years != 0,
            F.concat(F.lit("with at least "), years.cast("string"), F.lit(" years of experience")),
        ),
        part("industry", "in the ", " industry"),
        part("location", "based in "),
        part("education_level", "with ", " education"),
        part("remote_preference"),
        part("required_skills", "Required skills: "),
        part("optional_skills", "Preferred skills: "),
    )
    return F.coalesce(F.nullif(tx.strip(text), F.lit("")), F.lit(lx.DEFAULT_JOB_TEXT))


def with_job_defaults(jobs: DataFrame) -> DataFrame:
    """Fill thresholds, weights and ``top_n`` that are absent or NULL; ``top_n`` is at least 1."""
    defaults = {
        "shortlist_threshold": F.lit(lx.SHORTLIST_THRESHOLD),
        "review_threshold": F.lit(lx.REVIEW_THRESHOLD),
        "top_n": F.lit(lx.TOP_N),
        "skill_weight": F.lit(lx.SKILL_WEIGHT),
        "similarity_weight": F.lit(lx.SIMILARITY_WEIGHT),
    }
    for name, value in defaults.items():
        jobs = jobs.withColumn(name, F.coalesce(F.col(name), value) if name in jobs.columns else value)
    return jobs.withColumn("top_n", F.greatest(F.col("top_n"), F.lit(1)).cast("int"))


def validate_jobs(jobs: DataFrame) -> DataFrame:
    """Add ``reject_reason``: NULL for a usable job. ``top_n`` below 1 becomes 1."""
    return with_job_defaults(jobs).withColumn(
        "reject_reason",
        F.when(
            F.col("shortlist_threshold") < F.col("review_threshold"),
            F.concat(
                F.lit("shortlist_threshold ("), F.col("shortlist_threshold").cast("string"),
                F.lit(") must be >= review_threshold ("), F.col("review_threshold").cast("string"), F.lit(")"),
            ),
        ),
    )


def valid_jobs(jobs: DataFrame) -> DataFrame:
    return validate_jobs(jobs).filter(F.col("reject_reason").isNull()).drop("reject_reason")


# -- vectors ---------------------------------------------------------------------------


def ranking_vectors(df: DataFrame, text: Column, skills: Column | None, dim: int = lx.EMBEDDING_DIM) -> DataFrame:
    """Add ``vector``: token counts of ``text``, then one flag per skill of ``skills``."""
    counted = count_buckets(df.withColumn("_text", text), "_text", "_counts", dim)
    if skills is None:
        return counted.withColumn("vector", vector_to_array("_counts", "float32")).drop("_text", "_counts")
    flagged = CountVectorizerModel.from_vocabulary(
        _SKILL_NAMES, inputCol="_skills", outputCol="_flags", binary=True
    ).transform(counted.withColumn("_skills", skills))
    return flagged.withColumn(
        "vector", F.concat(vector_to_array("_counts", "float32"), vector_to_array("_flags", "float32"))
    ).drop("_text", "_counts", "_skills", "_flags")


def score_similarity(df: DataFrame, job_column: str, text_column: str, output: str = "similarity_score") -> DataFrame:
    """Similarity of the job text and the document text of the same row; 0 for a blank job."""
    counted = count_buckets(
        count_buckets(
            df.withColumn("_job", tx.strip(tx.text_or_empty(job_column))).withColumn(
                "_doc", tx.strip(tx.text_or_empty(text_column))
            ),
            "_job",
            "_jv",
        ),
        "_doc",
        "_dv",
    )
    arrays = counted.withColumn("_ja", vector_to_array("_jv")).withColumn("_da", vector_to_array("_dv"))
    cosine = sc.finite_score(sc.cosine_similarity("_ja", "_da", normalised=False))
    return arrays.withColumn(output, F.when(F.col("_job") == "", F.lit(0.0)).otherwise(cosine)).select(
        *df.columns, output
    )


# -- ranking ---------------------------------------------------------------------------


def rank_by_similarity(
    jobs: DataFrame,
    documents: DataFrame,
    text_columns: tuple[str, ...] = ("cleaned_text", "text", "resume_text"),
    id_column: str = "doc_id",
    block_rows: int = nearest.BLOCK_ROWS,
) -> DataFrame:
    """``(job_id, doc_id, similarity_score, rank)``: best ``top_n`` documents of each job.

    The document text is the first of ``text_columns`` that exists and is not empty.
    """
    present = [c for c in text_columns if c in documents.columns]
    text = tx.coalesce_texts(*[F.nullif(F.col(c), F.lit("")) for c in present])
    docs = ranking_vectors(documents.select(F.col(id_column).alias("doc_id"), text.alias("_t")), F.col("_t"), None)
    wanted = with_job_defaults(jobs).withColumns(
        {"similarity_weight": F.lit(1.0), "skill_weight": F.lit(0.0)}
    )
    wanted = _job_vectors(wanted, with_skills=False)
    ranked = nearest.top_documents_per_job(wanted, docs, lx.EMBEDDING_DIM, 0, block_rows)
    return ranked.select("job_id", "rank", "doc_id", "similarity_score")


def _job_vectors(jobs: DataFrame, with_skills: bool) -> DataFrame:
    text = tx.strip(tx.text_or_empty("job_text"))
    skills = F.col("job_skills") if with_skills else None
    return ranking_vectors(jobs, text, skills).withColumn("is_blank", text == "")


def _document_text(documents: DataFrame, text_column: str | tuple[str, ...]) -> Column:
    """The text of a document: the column, or the first of several that exists and is not empty."""
    if isinstance(text_column, str):
        return tx.text_or_empty(text_column)
    return tx.coalesce_texts(*[F.nullif(F.col(c), F.lit("")) for c in text_column if c in documents.columns])


def document_features(documents: DataFrame, text_column: str | tuple[str, ...] = "text", id_column: str = "doc_id") -> DataFrame:
    """``(doc_id, vector)``: everything ranking needs, computed once per document."""
    base = documents.select(F.col(id_column).alias("doc_id"), _document_text(documents, text_column).alias("_raw"))
    return ranking_vectors(base, F.col("_raw"), tx.extract_skills("_raw")).select("doc_id", "vector")


def rank_with_skills(
    jobs: DataFrame,
    documents: DataFrame,
    text_column: str | tuple[str, ...] = "text",
    id_column: str = "doc_id",
    with_cleaned_text: bool = False,
    block_rows: int = nearest.BLOCK_ROWS,
) -> DataFrame:
    """Best ``top_n`` documents of each job by weighted similarity and skill match.

    ``text_column`` may name several columns: the first that exists and is not empty is the document's text.
    The survivors carry their skills out of the scoring pass. Only the cleaned
    text, on request, needs the document table again, and only for survivors.
    """
    wanted = _job_vectors(with_job_defaults(jobs).withColumn("job_skills", tx.extract_skills("job_text")), True)
    features = document_features(documents, text_column, id_column)
    ranked = nearest.top_documents_per_job(wanted, features, lx.EMBEDDING_DIM, len(_SKILL_NAMES), block_rows)
    names = F.split(F.lit("\n".join(_SKILL_NAMES)), "\n")
    survivors = ranked.join(broadcast_if_small(wanted.select("job_id", "job_skills")), "job_id").withColumn(
        "resume_skills", F.transform("skill_ids", lambda i: F.get(names, i))
    )
    columns = [
        "job_id", "rank", "doc_id", "similarity_score", "skill_match_score", "combined_score",
        sc.matched_skills("job_skills", "resume_skills").alias("matched_skills"),
        sc.missing_skills("job_skills", "resume_skills").alias("missing_skills"),
        F.array_sort("job_skills").alias("job_skills"),
        F.array_sort("resume_skills").alias("resume_skills"),
    ]
    result = survivors.select(*columns)
    if with_cleaned_text:
        raw = documents.select(F.col(id_column).alias("doc_id"), _document_text(documents, text_column).alias("_raw"))
        cleaned = tx.remove_stopwords(tx.clean_text(tx.section_weighted_text("_raw")), folded=True)
        result = (
            raw.join(broadcast_if_small(result), "doc_id")
            .withColumn("cleaned_text", cleaned)
            .select(*result.columns, "cleaned_text")
        )
    return result


def apply_decisions(ranked: DataFrame, jobs: DataFrame, score_column: str = "combined_score") -> DataFrame:
    """Add ``decision`` from the thresholds of each row's job."""
    limits = with_job_defaults(jobs).select("job_id", "shortlist_threshold", "review_threshold")
    return ranked.join(broadcast_if_small(limits), "job_id").withColumn(
        "decision", sc.decide(score_column, "shortlist_threshold", "review_threshold")
    )


def decision_summary(decided: DataFrame, total_documents: int | Column) -> DataFrame:
    """Per job: documents screened in all, and decisions among the ranked rows."""
    total = F.lit(total_documents) if isinstance(total_documents, int) else total_documents
    return decided.groupBy("job_id").agg(
        F.first(total.cast("long")).alias("total_documents"),
        F.count_if(F.col("decision") == "Shortlist").alias("shortlisted"),
        F.count_if(F.col("decision") == "Further Review").alias("further_review"),
        F.count_if(F.col("decision") == "Reject").alias("rejected"),
    )
