"""Text extraction from document files and uploaded blobs, one Spark job each.

Reading a zip container cannot be written as a column expression, so a small
per-row helper runs under ``mapInArrow``; Spark distributes the files.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.batches import SLICE_BYTES, byte_sizes, slices
from doclens.functions import text as tx

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_EXTRACTED = "filename string, filepath string, text string, file_type string, error string"

_FILE_BYTES = 4096  # what a file counts besides its content

Reader = Callable[[bytes], str]


def read_docx(content: bytes) -> str:
    """Non-blank body paragraphs, one per line."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_WORD}body")
    paragraphs = []
    for paragraph in body.findall(f"{_WORD}p"):
        pieces = []
        for node in paragraph.iter():
            if node.tag == f"{_WORD}t":
                pieces.append(node.text or "")
            elif node.tag == f"{_WORD}tab":
                pieces.append("\t")
            elif node.tag in (f"{_WORD}br", f"{_WORD}cr"):
                pieces.append("\n")
        paragraphs.append("".join(pieces))
    return "\n".join(p for p in paragraphs if p.strip())


def _default_pdf_reader() -> Reader | None:
    """A PDF reader when the executor has one; pages are joined by newlines."""
    try:
        import fitz
    except ImportError:
        return None

    def read(content: bytes) -> str:
        with fitz.open(stream=content, filetype="pdf") as document:
            return "\n".join(page.get_text("text") for page in document)

    return read


def _extract(rows: DataFrame, pdf_reader: Reader | None) -> DataFrame:
    """``rows``: ``filename, filepath, suffix, file_type, content``. A failing row keeps its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = {".docx": read_docx, ".pdf": pdf_reader or _default_pdf_reader()}
        for batch in slices(batches, lambda b: byte_sizes(b.column("content")) + _FILE_BYTES, SLICE_BYTES):
            texts, errors = [], []
            for suffix, content in zip(batch.column("suffix").to_pylist(), batch.column("content")):
                text, error = None, None
                try:
                    reader = readers.get(suffix)
                    if reader is not None:
                        text = reader(content.as_py())
                    elif suffix in readers:
                        error = f"no reader for {suffix} on this executor"
                    else:
                        error = f"unsupported file format: {suffix}"
                except Exception as problem:  # one bad file must not fail the job
                    error = f"{type(problem).__name__}: {problem}"
                texts.append(text)
                errors.append(error)
            columns = [*(batch.column(c) for c in ("filename", "filepath")), pa.array(texts, pa.string()), batch.column("file_type"), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["filename", "filepath", "text", "file_type", "error"])

    return rows.select("filename", "filepath", "suffix", "file_type", "content").mapInArrow(run, _EXTRACTED)


def _finished(extracted: DataFrame, keep_errors: bool, split_sentences: bool) -> DataFrame:
    text = tx.sentence_lines("text") if split_sentences else tx.strip("text")
    result = extracted.withColumn("text", F.when(F.col("text").isNotNull(), text))
    if keep_errors:
        return result.filter(F.col("error").isNotNull() | (F.col("text") != ""))
    return result.filter(F.col("error").isNull() & (F.col("text") != "")).drop("error")


def ingest_document_files(
    spark: SparkSession,
    folder: str,
    extensions: tuple[str, ...] = (".pdf", ".docx"),
    pdf_reader: Reader | None = None,
    keep_errors: bool = False,
    split_sentences: bool = False,
) -> DataFrame:
    """Text of every matching file directly inside ``folder``; empty and failing files left out.

    ``keep_errors`` keeps failing files with their message instead.
    """
    names = ",".join(e.lstrip(".") for e in extensions)
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*.{{{names}}}")
        .option("recursiveFileLookup", "false")
        .load(folder)
    )
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.concat(F.lit("."), F.element_at(F.split("path", r"\."), -1)))
    rows = files.select(
        name.alias("filename"),
        F.col("path").alias("filepath"),
        suffix.alias("suffix"),
        F.upper(F.substr(suffix, F.lit(2))).alias("file_type"),
        "content",
    )
    return _finished(_extract(rows, pdf_reader), keep_errors, split_sentences)


def ingest_uploads(
    uploads: DataFrame,
    pdf_reader: Reader | None = None,
    keep_errors: bool = False,
    split_sentences: bool = False,
) -> DataFrame:
    """Text of uploaded ``(filename, content)`` blobs.

    A name without suffix is read as PDF and typed ``UNKNOWN``.
    """
    suffix = F.lower(F.regexp_extract("filename", r"(?<=[^/])(\.[^./]+)$", 1))
    rows = uploads.select(
        "filename",
        F.lit(None).cast("string").alias("filepath"),
        F.when(suffix == "", ".pdf").otherwise(suffix).alias("suffix"),
        F.when(suffix == "", "UNKNOWN").otherwise(F.upper(F.substr(suffix, F.lit(2)))).alias("file_type"),
        "content",
    )
    return _finished(_extract(rows, pdf_reader), keep_errors, split_sentences).drop("filepath")
