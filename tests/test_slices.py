"""Slices of Arrow batches."""

import io
import zipfile

import pyarrow as pa

from doclens.batches import SLICE_BYTES, byte_sizes, slices
from doclens.sources import files


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(["aaaa", None, "bb", "c" * 50, "d", ""])], ["t"])
    parts = [b.column("t").to_pylist() for b in slices(iter([batch]), lambda b: byte_sizes(b.column("t")), 6)]
    assert parts == [["aaaa", None, "bb"], ["c" * 50], ["d", ""]]
    assert [*slices(iter([batch.slice(0, 0)]), lambda b: byte_sizes(b.column("t")), 6)] == []


def test_uploads_are_read_in_slices(spark):
    """All files of a batch together would be many times the bytes of a slice."""
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>x</w:t></w:r></w:p></w:body></w:document>'
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        archive.writestr("word/document.xml", body)
    n = 3 * SLICE_BYTES // (4096 + len(packed.getvalue()))
    df = spark.range(0, n, 1, 1).selectExpr("concat('f', id, '.docx') AS filename").crossJoin(spark.createDataFrame([(bytearray(packed.getvalue()),)], "content binary"))
    read = files.ingest_uploads(df.coalesce(1), keep_errors=True)
    assert read.filter("text = 'x' AND error IS NULL").count() == n
