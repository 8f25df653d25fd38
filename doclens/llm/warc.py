"""WARC archives with a two-level capture index.

Every page becomes a record, compressed on its own. The index has one line per record, sorted by the
URL key with the host reversed (``com,example,www)/path``); runs of lines form compressed blocks, and a
sparse directory keeps the first key and the place of each block. A lookup searches the directory,
reads one block, and then reads the record's own range of the archive. Tables of keys are looked up by the tasks, sorted.

Tasks write archives and index parts straight into the shared folder. Each attempt of a task has files of its
own, and only the rows of the attempt that counts name them; what a lost attempt left is never read. The
directory is a table like any other.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.files import Whole, make_folder, opened, read_range
from doclens.llm.base import block_rows, query, table, tasks
from doclens.llm.words import chunks
from doclens.session import shared_folder, written

DEDUP_BYTES = 1000  # payloads of fewer bytes are stored each time
BLOCK_LINES = 1000  # index lines of a block
READ_RECORDS = 1000  # index lines whose records are read one after the other
_DATE = "2024-01-01T00:00:00Z"  # captures carry no time of their own


def url_key(url: Column) -> Column:
    """Host labels reversed and joined by commas, then ``)`` and path with query, in lower case; null or no host: ``)``."""
    plain = F.lower(F.coalesce(url, F.lit("")))
    rest = F.regexp_replace(F.regexp_replace(plain, "^[a-z][a-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.regexp_extract(rest, "^([^/?]*)", 1), "^.*@|:[0-9]*$", "")
    path = F.regexp_extract(rest, "^[^/?]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.when(path == "", F.lit("/")).otherwise(path))


def captures(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to)`` per row of ``pages``."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html")).select(
        "page_id", "url", "html",
        F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha1(F.encode(html, "UTF-8")).alias("payload_digest"),
    )
    # pages without an id can't be referred to; they and small payloads are responses
    large = rows.filter((F.col("payload_bytes") >= DEDUP_BYTES) & F.col("page_id").isNotNull())
    copied = (
        large.groupBy("payload_digest").agg(F.max("page_id").alias("owner"), F.min("page_id").alias("least"))
        .filter(F.col("owner") != F.col("least"))
        .select(F.col("payload_digest").alias("copied"), "owner")
    )
    owned = rows.join(copied, (F.col("payload_digest") == F.col("copied")) & (F.col("payload_bytes") >= DEDUP_BYTES), "left")
    revisit = F.coalesce(F.col("owner") != F.col("page_id"), F.lit(False))
    return owned.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("owner")).alias("refers_to"),
    )


def _record(row: dict) -> bytes:
    """One record: version line, headers, empty line, content, two empty lines."""
    payload = b"" if row["record_type"] == "revisit" else (row["html"] or "").encode()
    content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    name = json.dumps(row["page_id"])
    headers = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", json.dumps(row["url"])[1:-1] if row["url"] is not None else None),
        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
        ("X-Payload-Bytes", str(row["payload_bytes"])),
        ("WARC-Refers-To", f"<urn:page:{json.dumps(row['refers_to'])}>" if row["refers_to"] is not None else None),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if row["record_type"] == "revisit" else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(content))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None) + "\r\n"
    return head.encode() + content + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one uncompressed record; ``payload`` is what the record itself holds.

    A response whose payload has not the length and SHA-1 that its header names raises an error.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    content = rest[: int(fields["Content-Length"])]
    payload = content.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response":
        named = int(fields["X-Payload-Bytes"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if (len(payload), hashlib.sha1(payload).hexdigest()) != named:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not the one that was written")
    name = lambda x: json.loads(x.removeprefix("<urn:page:").removesuffix(">"))
    return {
        "page_id": name(fields["WARC-Record-ID"]),
        "url": json.loads(f'"{fields["WARC-Target-URI"]}"') if "WARC-Target-URI" in fields else None,
        "record_type": fields["WARC-Type"],
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": int(fields["X-Payload-Bytes"]),
        "refers_to": name(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "payload": payload,
    }


def write_archives(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Write one archive per task into ``folder``; returns the written index rows ``(key, page_id, file, start, length)``."""
    make_folder(folder)
    rows = captures(pages, **columns).withColumn("key", url_key(F.col("url"))).withColumn("file", F.spark_partition_id().cast("long"))
    if rows.schema["page_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        rows = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})  # records name ids of other types by their text

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = name = None
        for batch in chunks(batches, "html", 1 << 22):
            starts, lengths = [], []
            for row in batch.to_pylist():
                if archive is None:
                    name = f"pages-{row['file']:08d}-{uuid.uuid4().hex}.warc.gz"  # the index names this attempt's own file
                    archive = Whole(folder, name)
                data = gzip.compress(_record(row), compresslevel=4, mtime=0)
                starts.append(archive.size)
                lengths.append(len(data))
                archive.write(data)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("page_id"), pa.array([name] * n, pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())],
                ["key", "page_id", "file", "start", "length"],
            )
        if archive is not None:
            archive.close()

    kind = rows.schema["page_id"].dataType.simpleString()
    return written(rows.mapInArrow(write, f"key string, page_id {kind}, file string, start long, length long"), "captures")


def write_index(index: DataFrame, folder: str, lines: int = BLOCK_LINES) -> DataFrame:
    """Write sorted compressed blocks; returns the directory ``(first_key, last_key, file, start, length, lines)``."""
    make_folder(folder)
    order = ["key", "page_id", "file", "start"]
    ranged = index.repartitionByRange(tasks(index.sparkSession), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None
        held: list[tuple[str, str]] = []
        done: list[tuple] = []

        def flush() -> None:
            data = gzip.compress("".join(line for _, line in held).encode(), compresslevel=6, mtime=0)
            done.append((held[0][0], held[-1][0], name, out.size, len(data), len(held)))
            out.write(data)
            held.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"index-{row['part']:08d}-{uuid.uuid4().hex}.gz"
                    out = Whole(folder, name)
                held.append((row["key"], json.dumps([row["key"], row["page_id"], row["file"], row["start"], row["length"]]) + "\n"))
                if len(held) >= lines:
                    flush()
        if out is not None:
            if held:
                flush()
            out.close()
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = ["first_key", "last_key", "file", "start", "length", "lines"]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names)

    return written(ranged.mapInArrow(write, "first_key string, last_key string, file string, start long, length long, lines long"), "directory")


def _block_lines(folder: str, file: str, start: int, length: int) -> list[list]:
    system, path = opened(folder)
    return [json.loads(x) for x in gzip.decompress(read_range(system, f"{path}/{file}", start, length)).decode().splitlines()]


def _records(folder: str, places: list[list]) -> Iterator[tuple[list, dict]]:
    """``(index line, record)``: ranges are read by file, then in order of their place; each file is opened once."""
    system, path = opened(folder)
    name = file = None
    try:
        for line in sorted(places, key=lambda x: (x[2], x[3])):
            if line[2] != name:
                if file is not None:
                    file.close()
                name, file = line[2], system.open_input_file(f"{path}/{line[2]}")
            file.seek(line[3])
            yield line, parse_record(gzip.decompress(file.read(line[4])))
    finally:
        if file is not None:
            file.close()


def _search(directory: list[tuple[str, str, str, int, int]], firsts: list[str], key: str, lines) -> Iterator[list]:
    """The index lines of a key: binary search in the directory, then in each block that may hold it."""
    # the block before the first one that begins with the key may end with it
    at = max(0, bisect.bisect_left(firsts, key) - 1)
    while at < len(directory) and firsts[at] <= key:
        if directory[at][1] >= key:
            found, keys = lines(*directory[at][2:5])
            yield from found[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
        at += 1


def _keyed_block(folder: str, file: str, start: int, length: int) -> tuple[list[list], list[str]]:
    found = _block_lines(folder, file, start, length)
    return found, [x[0] for x in found]


def lookup(directory: list[tuple[str, str, str, int, int]], key: str, index_folder: str, archive_folder: str) -> list[dict]:
    """The records of one URL key: binary search in the directory, one read per block and per record.

    ``directory`` holds ``(first_key, last_key, file, start, length)`` in the order of ``first_key``.
    """
    found = list(_search(directory, [d[0] for d in directory], key, lambda *place: _keyed_block(index_folder, *place)))
    return [record for _, record in _records(archive_folder, found)]


def find_records(keys: DataFrame, directory: DataFrame, index_folder: str, archive_folder: str, id_type: str = "bigint") -> DataFrame:
    """Every record of the URL keys in ``keys`` (column ``key``), found by binary search; repeated keys count once, unknown ones give no row.

    Columns ``(key, page_id, url, payload_bytes, payload_digest, record_type, refers_to, stored_bytes)``. Index files hold ranges of keys, and
    the driver knows the first and last key of each file, of which there are as many as tasks that wrote them. A key goes to every file whose range
    it is in, so one that very many captures share is searched by as many tasks as wrote it. There, the sorted keys of a file search its part of the
    sparse directory, each block is read once, and records are read in the order of their place.
    """
    spark = keys.sparkSession
    part_of = F.substring("file", 7, 8).cast("int")  # files are named by the range of keys that they hold
    parts = directory.groupBy(part_of.alias("part")).agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).orderBy("part").toArrow()
    # ranges follow each other; neighbours share at most the key at their border
    numbers, lows, highs = (parts.column(c).to_pylist() for c in ("part", "low", "high"))
    folder = shared_folder(spark, "directory")
    directory.withColumn("block", part_of).repartition(tasks(spark), "block").sortWithinPartitions("block", "start").write.partitionBy("block").parquet(folder)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for key in batch.column("key").to_pylist():
                for part in range(bisect.bisect_left(highs, key), bisect.bisect_right(lows, key)):
                    out[0].append(numbers[part])
                    out[1].append(key)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.string())], ["part", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        part, entries, firsts, places = None, [], [], []
        block: dict[tuple, tuple] = {}

        def lines(*place):
            if place not in block:
                block.clear()  # keys come sorted: a block that is left isn't needed again
                block[place] = _keyed_block(index_folder, *place)
            return block[place]

        def rows() -> pa.RecordBatch:
            found = [{n: r[n] for n in names} | {"key": line[0], "stored_bytes": len(r["payload"])} for line, r in _records(archive_folder, places)]
            places.clear()
            return pa.RecordBatch.from_pylist(found, schema=arrow)

        for batch in batches:
            for number, key in zip(batch.column("part").to_pylist(), batch.column("key").to_pylist()):
                if number != part:
                    part = number
                    table_ = block_rows(folder, part, ["first_key", "last_key", "file", "start", "length"])
                    entries = sorted(zip(*(c.to_pylist() for c in table_.columns)), key=lambda d: d[3])
                    firsts = [d[0] for d in entries]
                for line in _search(entries, firsts, key, lines):
                    places.append(line)
                    if len(places) >= READ_RECORDS:
                        yield rows()
        if places:
            yield rows()

    whole = id_type in ("tinyint", "smallint", "int", "bigint")
    id_arrow, id_read = (pa.int64(), "bigint") if whole else (pa.string(), "string")
    kinds = {"key": pa.string(), "page_id": id_arrow, "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
             "record_type": pa.string(), "refers_to": id_arrow, "stored_bytes": pa.int64()}
    arrow = pa.schema(list(kinds.items()))
    schema = f"key string, page_id {id_read}, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to {id_read}, stored_bytes bigint"
    wanted = keys.select(F.col("key").cast("string").alias("key")).filter(F.col("key").isNotNull()).distinct()
    dealt = wanted.mapInArrow(assign, "part int, key string").repartition(tasks(spark), "part").sortWithinPartitions("part", "key")
    found = dealt.mapInArrow(search, schema)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archive(pages: DataFrame, lines: int = BLOCK_LINES, **columns: str) -> tuple[DataFrame, DataFrame, str, str]:
    """Write archives and index; ``(index rows, directory, archive folder, index folder)``.

    One record per row. Null pages have an empty payload, null URLs the key ``)/``, null ids a record of
    that name that nothing refers to. Of payloads of 1000 bytes or more that occur under several ids, the rows with the
    largest id are responses and the others revisits; repeated rows with that id are responses each.
    An empty table writes no archive. Other columns are not looked at. A record is held whole by one task, so a very long page is, too.
    Ids may be of any type that Spark writes as text and reads back.
    """
    spark = pages.sparkSession
    archives, blocks = shared_folder(spark, "archives"), shared_folder(spark, "index")
    index = write_archives(pages, archives, **columns)
    return index, write_index(index, blocks, lines), archives, blocks


@query("op6_warc")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    _, directory, archives, blocks = archive(pages)
    found = find_records(pages.select(url_key(F.col("url")).alias("key")), directory, blocks, archives)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
