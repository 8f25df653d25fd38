"""Queries of ingestion, sinks and the streaming form of screening."""

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from doclens.batches import SLICE_BYTES, byte_sizes, slices
from doclens.catalog.base import derived, query, table, with_views
from doclens.catalog.ranking import _SCORES, SQL_RANKED, _flat
from doclens.catalog.text import sql_strip
from doclens.files import Whole, make_folder
from doclens.session import shared_folder
from doclens.sources import files, tables
from doclens.streaming import leaderboard as board

_NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx_bytes(text: str) -> bytes:
    """A minimal DOCX with one paragraph per line."""
    body = "".join(
        f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n")
    )
    document = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_NAMESPACE}"><w:body>{body}</w:body></w:document>'
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", document)
    return packed.getvalue()


def uploads_of(df, suffix: str = "'DOCX'"):
    """Pack every document text as an uploaded DOCX blob; ``suffix`` is a SQL expression."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, lambda b: byte_sizes(b.column("text")), SLICE_BYTES):
            packed = [docx_bytes(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("filename"), pa.array(packed, pa.binary())], ["filename", "content"])

    name = F.concat(F.lit("cv"), F.col("doc_id").cast("string"), F.lit("."), F.expr(suffix))
    return df.select(name.alias("filename"), "text").mapInArrow(pack, "filename string, content binary")


_KEPT = (
    "array_to_string(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\\S')), chr(10))"
)
_PACKED = f"(SELECT doc_id, lang, {sql_strip(_KEPT)} AS text FROM documents)"


@query(
    "ingest_uploads",
    f"SELECT 'cv' || doc_id || '.DOCX' AS filename, 'DOCX' AS file_type, text FROM {_PACKED} WHERE text <> ''",
)
def _(spark, d):
    uploads = uploads_of(table(spark, d, "documents"))
    return files.ingest_uploads(uploads).select("filename", "file_type", "text")


def _as_files(uploads, folder: str) -> int:
    """Executors write each upload as a file of its name; returns how many there are."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("filename").to_pylist(), batch.column("content").to_pylist()):
                file = Whole(folder, name)
                file.write(content)
                file.close()
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    make_folder(folder)
    return uploads.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


@query(
    "ingest_document_files",
    f"""SELECT 'cv' || doc_id || '.docx' AS filename, 'DOCX' AS file_type, text FROM {_PACKED}
    WHERE text <> '' AND lang = 'en'""",
)
def _(spark, d):
    folder = shared_folder(spark, "document-files")
    _as_files(uploads_of(table(spark, d, "documents"), _SUFFIX), folder)  # files of another format are left out
    return files.ingest_document_files(spark, folder).select("filename", "file_type", "text")


@query("read_screening_table_rows", "SELECT doc_id, text, lang FROM documents ORDER BY doc_id LIMIT 100")
def _(spark, d):
    return tables.read_screening_table(spark, f"{d.rstrip('/')}/documents.parquet", 100, "doc_id").select("doc_id", "text", "lang")


_SUFFIX = "CASE WHEN lang = 'en' THEN 'docx' ELSE 'odt' END"


@query(
    "ingest_upload_errors",
    f"""SELECT 'cv' || doc_id || '.' || {_SUFFIX} AS filename, CASE WHEN lang = 'en' THEN text END AS text,
    CASE WHEN lang <> 'en' THEN 'unsupported file format: .odt' END AS error FROM {_PACKED}""",
)
def _(spark, d):
    uploads = uploads_of(table(spark, d, "documents"), _SUFFIX)
    return files.ingest_uploads(uploads, keep_errors=True).select("filename", "text", "error")


_DOCS = "SELECT doc_id, text AS resume_text, lang AS category FROM documents"


@query("read_documents_csv", _DOCS)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("resume_text"), F.col("lang").alias("category"))
    path = tables.write_documents(docs, shared_folder(spark, "documents-csv"), "csv")
    return tables.read_documents_csv(spark, path, docs.schema)


@query("write_documents", _DOCS)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("resume_text"), F.col("lang").alias("category"))
    return spark.read.schema(docs.schema).parquet(
        tables.write_documents(docs, shared_folder(spark, "documents-parquet"))
    )


@query(
    "write_metrics",
    with_views(
        "SELECT round(avg(CASE WHEN label = prediction THEN 1 ELSE 0 END), 6) AS accuracy FROM predictions", "predictions"
    ),
)
def _(spark, d):
    from doclens.operators import evaluate

    row = evaluate.accuracy(derived(spark, d, "predictions")).select(F.round("accuracy", 6).alias("accuracy"))
    return spark.read.schema(row.schema).json(tables.write_metrics(row, shared_folder(spark, "metrics")))


# Documents in two batches: a third is sent again with the text of another document, some of them twice in a batch.
_RESENT = """resumes AS (
    SELECT d.doc_id AS resume_id, CASE WHEN d.doc_id % 3 = 0 THEN coalesce(o.text, d.text) ELSE d.text END AS resume_text
    FROM documents d LEFT JOIN documents o ON d.doc_id % 3 = 0 AND o.doc_id = d.doc_id + 1)"""
_STREAM_TWIN = with_views(
    f"""WITH {_RESENT}, {SQL_RANKED}
    SELECT job_id, rank, resume_id AS doc_id, {_SCORES}, decision FROM ranked""",
    "jobs",
)


@query("screen_stream", _STREAM_TWIN)
def _(spark, d):
    jobs = derived(spark, d, "jobs")
    docs = table(spark, d, "documents").select("doc_id", "text")
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    again = docs.filter("doc_id % 3 = 0").join(other, "doc_id", "left")
    changed = again.select("doc_id", F.coalesce("other", "text").alias("text"))
    root = shared_folder(spark, "leaderboard")
    older = again.filter("doc_id % 2 = 0").select("doc_id", "text")
    batches = [
        docs.filter("doc_id % 2 = 0").withColumn("version", F.lit(1)),
        # the last versions, older ones in the same batch, and first versions that come late
        changed.withColumn("version", F.lit(3)).unionByName(older.withColumn("version", F.lit(2))).unionByName(
            docs.filter("doc_id % 2 = 1").withColumn("version", F.lit(1))
        ),
    ]
    for batch in batches:  # one run of the stream for each, from the same checkpoint
        batch.write.mode("append").parquet(f"{root}/arriving")
        arriving = spark.readStream.schema(batch.schema).parquet(f"{root}/arriving")
        board.screen_stream(
            jobs, arriving, f"{root}/board", f"{root}/checkpoint", available_now=True, version_column="version"
        ).awaitTermination()
    return _flat(board.leaderboard(jobs, f"{root}/board")).select(
        "job_id", "rank", "doc_id", "similarity_score", "skill_match_score", "combined_score", "decision"
    )


# Uploads: English documents as DOCX, a third of them sent twice; the others in a format that nobody reads.
_SENT = f"(SELECT *, 'cv' || doc_id || '.' || {_SUFFIX} AS filename FROM {_PACKED}, (VALUES (1), (2)) AS c(copy) WHERE copy = 1 OR doc_id % 3 = 0)"
_READ = f"""resumes AS (SELECT sha256(length(filename) || ':' || filename || text) || '-' || copy AS resume_id, filename,
        text AS resume_text FROM {_SENT} WHERE text <> '' AND lang = 'en')"""


def _screened(spark, d):
    from doclens.plans import screen

    docs = table(spark, d, "documents")
    sent = docs.unionAll(docs.filter("doc_id % 3 = 0"))
    return screen.screen_uploads(derived(spark, d, "jobs"), uploads_of(sent, _SUFFIX))


@query(
    "screen_uploads",
    with_views(
        f"""WITH {_READ}, {SQL_RANKED} SELECT job_id, rank, resume_id AS doc_id, filename, {_SCORES}, decision, matched_skills,
        missing_skills, 'no classifier loaded' AS prediction_error FROM ranked JOIN resumes USING (resume_id)""",
        "jobs",
    ),
)
def _(spark, d):
    return _flat(_screened(spark, d).rows).select(
        "job_id", "rank", "doc_id", "filename", "similarity_score", "skill_match_score", "combined_score", "decision",
        "matched_skills", "missing_skills", "prediction_error",
    )


@query(
    "screen_summary",
    with_views(
        f"""WITH {_READ}, {SQL_RANKED}
        SELECT j.job_id, j.shortlist_threshold, j.review_threshold, j.top_n, CAST(NULL AS VARCHAR) AS reject_reason,
               (SELECT count(*) FROM {_SENT} WHERE text <> '' OR lang <> 'en') AS total_documents,
               (SELECT count(*) FROM {_SENT} WHERE lang <> 'en') AS failed_documents,
               count(r.rank) AS ranked, count(*) FILTER (decision = 'Shortlist') AS shortlisted,
               count(*) FILTER (decision = 'Further Review') AS further_review, count(*) FILTER (decision = 'Reject') AS rejected
        FROM jobs j LEFT JOIN ranked r ON r.job_id = j.job_id GROUP BY ALL""",
        "jobs",
    ),
)
def _(spark, d):
    return _screened(spark, d).summary


@query(
    "failed_uploads",
    f"SELECT filename, 'unsupported file format: .odt' AS error FROM {_SENT} WHERE lang <> 'en'",
)
def _(spark, d):
    return _screened(spark, d).failed
