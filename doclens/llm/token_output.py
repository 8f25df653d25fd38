"""Token-ID output in training order.

The tokens of all documents, each followed by an end token, form one stream in the order of the files and the rows in
them; it is cut into sequences of equal length. Tokens are made once and written to the shared folder, with the place
of every document in its stretch: the rows of one file that a task read one after the other. Prefix sums over the
stretches, made by Spark and looked up in the shared folder, give every stretch its start and the number of sequences, however
the scan was cut and however many files there are. A keyed Feistel permutation
of the sequence numbers, walked until it lands inside them, gives each sequence its slot: a fixed
random order that needs no random numbers and no sort of the corpus, and that a reader can invert. Slot ``s`` lies in shard
``s // per_shard``, at byte ``(s % per_shard) * stride``, so a reader resumes anywhere with one seek.

Texts are never shuffled; tokens are made once and shuffled once, each piece compressed.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclens.files import Whole, make_folder, opened
from doclens.llm.base import block_rows, query, table, tasks, with_starts
from doclens.llm.tokenizers import byte_model, vocabulary
from doclens.llm.words import chunks
from doclens.session import DEFAULT_SEED, shared_folder, written

_U = np.uint64
ROUNDS = 6
BLOCK_STRETCHES = 10_000  # stretches whose starts a task holds at once
# tokens are packed over pages so large that copies of texts meet in one
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20)}


def _round(values: np.ndarray, key: int, number: int) -> np.ndarray:
    v = values + _U((key * 0x9E3779B97F4A7C15 + (number + 1) * 0xD1B54A32D192ED03) % 2**64)
    v = (v ^ (v >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> _U(27))) * _U(0x94D049BB133111EB)
    return v ^ (v >> _U(31))


class Permutation:
    """A keyed bijection on ``0 .. size - 1``: a balanced Feistel network on the next even power of two, with cycle-walking."""

    def __init__(self, size: int, key: int):
        self.size, self.key = size, key
        self.half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
        self.mask = _U((1 << self.half) - 1)

    def _pass(self, values: np.ndarray, back: bool) -> np.ndarray:
        left, right = values >> _U(self.half), values & self.mask
        for number in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ (_round(left, self.key, number) & self.mask), left
            else:
                left, right = right, left ^ (_round(right, self.key, number) & self.mask)
        return left << _U(self.half) | right

    def _walk(self, values: np.ndarray, back: bool) -> np.ndarray:
        out = self._pass(np.asarray(values).astype(np.uint64), back)
        outside = np.flatnonzero(out >= _U(self.size))
        while len(outside):  # the domain is at most four times the size
            out[outside] = self._pass(out[outside], back)
            outside = outside[out[outside] >= _U(self.size)]
        return out.astype(np.int64)

    def slots(self, sequences: np.ndarray) -> np.ndarray:
        return self._walk(sequences, False)

    def sequences(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


def _scanned(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(file, row, id, text)`` of a table of files; other input is written first."""
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    try:
        place = docs.select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
            F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"),
        )
        place.schema  # noqa: B018  analysed here: only a scan of files has the metadata
        return place
    except AnalysisException:
        return _scanned(written(narrow, "documents"), "id", "text")


def _placed(rows: DataFrame, purpose: str) -> DataFrame:
    """Write ``(file, row, id, tokens)`` with ``stretch``, the first row of its stretch, and ``start``, the tokens before it there."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, stretch, last, start = None, -1, -1, 0
        for batch in batches:
            stretches, starts = [], []
            for own, row, n in zip(batch.column("file").to_pylist(), batch.column("row").to_pylist(), pc.binary_length(batch.column("tokens")).to_pylist()):
                if own != file or row < last:
                    file, stretch, start = own, row, 0
                stretches.append(stretch)
                starts.append(start)
                last, start = row, start + n // 2
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(stretches, pa.int64()), pa.array(starts, pa.int64())], [*batch.schema.names, "stretch", "start"]
            )

    schema = T.StructType([*rows.schema.fields, T.StructField("stretch", T.LongType()), T.StructField("start", T.LongType())])
    path = shared_folder(rows.sparkSession, purpose)
    rows.mapInArrow(place, schema).write.options(**PACKED).parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def _stretches(placed: DataFrame) -> DataFrame:
    """``(file, stretch, rows, last, heads, tokens)``, one row per stretch."""
    held = placed.groupBy("file", "stretch").agg(
        F.count(F.lit(1)).alias("rows"), F.max("row").alias("last"), F.sum(F.expr("int(start = 0)")).alias("heads"),
        F.sum(F.octet_length("tokens") / 2).cast("long").alias("tokens"),
    )
    return written(held, "stretches")


def _block_of(file: str, stretch: int, blocks: int) -> int:
    return zlib.crc32(f"{file}|{stretch}".encode()) % blocks


def _begins(stretches: DataFrame) -> tuple[str, int, int]:
    """Write the start of every stretch in the whole stream, in blocks; their folder and number, and the stream's tokens."""
    sums = stretches.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")).first()
    blocks = max(1, -(-sums["n"] // BLOCK_STRETCHES))
    begins = with_starts(stretches.select("file", "stretch", "tokens"), ["file", "stretch"], "tokens", None, "starts")
    folder = shared_folder(stretches.sparkSession, "begins")
    block = (F.crc32(F.concat_ws("|", "file", "stretch")) % blocks).cast("int").alias("block")
    begins.select("file", "stretch", F.col("start").alias("begin"), block).repartition("block").write.partitionBy("block").parquet(folder)
    return folder, blocks, sums["tokens"] or 0


@lru_cache(maxsize=4)
def _begins_of(folder: str, number: int) -> dict[tuple[str, int], int]:
    """One block of starts; a worker keeps the last few it read."""
    rows = block_rows(folder, number, ["file", "stretch", "begin"])
    return {} if rows is None else {(f, s): b for f, s, b in zip(*(rows.column(c).to_pylist() for c in rows.column_names))}


def write_training_order(
    docs: DataFrame,
    folder: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizer: str = "byte_bpe_50k.tiktoken",
    length: int = 1024,
    per_shard: int = 2048,
    end_token: int = 50256,
    key: int = DEFAULT_SEED,
    path: str | None = None,
) -> DataFrame:
    """Write the shards into ``folder``; returns their pieces: ``(id, slot, shard, file, first_slot, position, first_token, n_tokens)``.

    A piece is the part of one document in one sequence: ``n_tokens`` tokens of the document from ``first_token`` on,
    at ``position`` in the sequence of ``slot``; ``file`` is its shard's, which begins with ``first_slot``. Token ids are
    little-endian 16-bit numbers, a sequence is ``length`` of them; the last sequence of the stream is filled up with
    end tokens. Every document ends with one end token, which counts as its own. Sequence ``n`` of the stream has slot
    ``Permutation(number of sequences, key).slots(n)``. The order follows the files by name and the rows in them, however
    tasks share them out; input that isn't read from files is taken in the order of its partitions. Rows that were filtered,
    dealt out or doubled after the scan cost one more shuffle of their tokens.

    Null and empty texts are an end token alone; null ids and rows that repeat an id or a text are rows like any other.
    An empty table writes nothing. Other columns are not looked at. A text is held whole by one task.
    """
    spark = docs.sparkSession
    path = path or vocabulary(tokenizer)
    make_folder(folder)
    scan = _scanned(docs, id_column, text_column)
    kind = scan.schema["id"].dataType.simpleString()
    parts = tasks(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_model(path)
        for batch in chunks(batches, "text"):
            own = [array("H", [*(model.encode_ordinary(text) if text else ()), end_token]).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "row", "id")), pa.array(own, pa.binary())], ["file", "row", "id", "tokens"])

    placed = _placed(scan.mapInArrow(encode, f"file string, row long, id {kind}, tokens binary"), "tokens")
    stretches = _stretches(placed)
    # rows of a stretch that follow each other without a gap lie in no other stretch
    if not stretches.filter("heads > 1 OR rows != last - stretch + 1").isEmpty():
        # rows were dealt out, left out or doubled after the scan: the tokens are put in order
        dealt = placed.drop("stretch", "start").repartitionByRange(parts, "file", "row").sortWithinPartitions("file", "row", "id", "tokens")
        placed = _placed(dealt, "tokens")
        stretches = _stretches(placed)
    starts, blocks, total = _begins(stretches)
    order = Permutation(max(1, -(-total // length)), key)
    n_shards = -(-order.size // per_shard)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            owners, numbers, positions, firsts, counts, parts_ = [], [], [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("file", "stretch", "start", "tokens"))
            for i, (file, stretch, start, own) in enumerate(zip(*columns)):
                at = _begins_of(starts, _block_of(file, stretch, blocks))[file, stretch] + start
                stop = at + len(own) // 2
                edges = [at, *range((at // length + 1) * length, stop, length), stop]
                for a, b in zip(edges[:-1], edges[1:]):
                    owners.append(i)
                    numbers.append(a // length)
                    positions.append(a % length)
                    firsts.append(a - at)
                    counts.append(b - a)
                    parts_.append(codec.compress(own[2 * (a - at) : 2 * (b - at)], asbytes=True))
            slots = order.slots(np.array(numbers, np.int64))
            part = slots // per_shard * parts // n_shards  # whole shards, equally many for each task
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(owners, pa.int64())), pa.array(slots), pa.array(part.astype(np.int32)),
                 pa.array(positions, pa.int64()), pa.array(firsts, pa.int64()), pa.array(counts, pa.int64()), pa.array(parts_, pa.binary())],
                ["id", "slot", "part", "position", "first_token", "n_tokens", "tokens"],
            )

    stride = 2 * length

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, name, shard, last = None, "", -1, -1
        codec = pa.Codec("zstd")

        def fill(missing: int) -> None:
            file.write(struct.pack("<H", end_token) * (missing // 2))

        for batch in batches:
            names = []
            columns = (batch.column(c).to_pylist() for c in ("slot", "position", "n_tokens", "tokens"))
            for slot, position, n, tokens in zip(*columns):
                if slot != last:
                    last = slot
                    if file is not None:
                        fill(-file.size % stride)
                    if slot // per_shard != shard:
                        if file is not None:
                            file.close()
                        shard = slot // per_shard
                        name = f"shard-{shard:08d}-{uuid.uuid4().hex}.bin"  # the pieces name this attempt's own file
                        file = Whole(folder, name)
                if (slot % per_shard) * stride + 2 * position != file.size:
                    raise ValueError("a piece is missing or there twice")
                file.write(codec.decompress(tokens, 2 * n, asbytes=True))
                names.append(name)
            kept = batch.select(["id", "slot", "position", "first_token", "n_tokens"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(names, pa.string())], [*kept.schema.names, "file"])
        if file is not None:
            fill(-file.size % stride)
            file.close()

    cut = placed.mapInArrow(pieces, f"id {kind}, slot long, part int, position long, first_token long, n_tokens long, tokens binary")
    dealt = cut.repartitionById(parts, "part").sortWithinPartitions("slot", "position")
    local = written(dealt.mapInArrow(write, f"id {kind}, slot long, position long, first_token long, n_tokens long, file string"), "pieces")
    shard = F.floor(F.col("slot") / per_shard).cast("long")
    return local.select("id", "slot", shard.alias("shard"), "file", (shard * per_shard).alias("first_slot"), "position", "first_token", "n_tokens")


def read_pieces(pieces: DataFrame, folder: str, length: int) -> DataFrame:
    """``pieces`` with ``tokens_crc32``, the checksum of the bytes that the shard holds in the piece's place."""
    stride = 2 * length

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        name, file = None, None
        for batch in batches:
            sums = []
            columns = (batch.column(c).to_pylist() for c in ("file", "slot", "first_slot", "position", "n_tokens"))
            for own, slot, first, position, n in zip(*columns):
                if own != name:
                    if file is not None:
                        file.close()
                    name, file = own, system.open_input_file(f"{path}/{own}")
                file.seek((slot - first) * stride + 2 * position)
                sums.append(zlib.crc32(file.read(2 * n)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], [*batch.schema.names, "tokens_crc32"])
        if file is not None:
            file.close()

    return pieces.mapInArrow(read, T.StructType([*pieces.schema.fields, T.StructField("tokens_crc32", T.LongType())]))


def read_sequences(folder: str, shards: list[tuple[int, str]], first: int, count: int, length: int) -> Iterator[np.ndarray]:
    """The sequences of slots ``first`` to ``first + count - 1`` in training order; ``shards`` lists ``(first slot, file)`` in order."""
    system, path = opened(folder)
    stride, slot = 2 * length, first
    starts = [s for s, _ in shards]
    while slot < first + count:
        at = bisect.bisect_right(starts, slot) - 1
        stop = min(first + count, starts[at + 1] if at + 1 < len(starts) else first + count)
        with system.open_input_file(f"{path}/{shards[at][1]}") as file:
            file.seek((slot - starts[at]) * stride)
            for _ in range(stop - slot):
                yield np.frombuffer(file.read(stride), "<u2")
        slot = stop


def training_order(docs: DataFrame, length: int = 1024, **options) -> DataFrame:
    """Write the shards of ``docs`` into a new shared folder and read them back, piece by piece."""
    folder = shared_folder(docs.sparkSession, "shards")
    pieces = write_training_order(docs, folder, length=length, **options)
    name = options.get("id_column", "doc_id")
    return read_pieces(pieces, folder, length).drop("file", "first_slot").withColumnRenamed("id", name)


@query("op2_training_order")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(table(spark, sf_dir, "documents"))
