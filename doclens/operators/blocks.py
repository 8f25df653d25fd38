"""Feature rows of a fit in block files of the shared folder, for fits of more rows than a task takes at once.

Rows are sorted by their contents, so partitions don't matter. A task maps the files into memory and reads the rows that it
needs; what it holds itself are a few numbers a row.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.files import Whole, make_folder, opened
from doclens.session import shared_folder

BLOCK_ROWS = 1 << 15
_SALTS = 64  # rows that are alike may lie in so many tasks


def mapped(uri: str, kind: str, shape: tuple[int, ...]) -> np.ndarray:
    """A file as an array whose pages are read when they are used; a file of a remote store is copied first."""
    if 0 in shape:
        return np.zeros(shape, kind)
    system, path = opened(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, kind, "r", shape=shape)
    with tempfile.TemporaryFile() as copy, system.open_input_stream(path, compression=None) as file:
        while data := file.read(1 << 22):
            copy.write(data)
        copy.flush()
        return np.memmap(copy, kind, "r", shape=shape)


_maps: dict[str, dict[str, np.ndarray]] = {}  # of one set of files, so that deleted ones don't stay


@dataclass
class Blocks:
    """A matrix of rows in files, or the part of it that ``index`` (rising) names."""

    folder: str
    purpose: str
    names: list[str]
    starts: np.ndarray  # the first row of each file, and the number of all rows
    width: int
    kind: str
    index: np.ndarray | None = None

    def __len__(self) -> int:
        return int(self.starts[-1]) if self.index is None else len(self.index)

    @property
    def shape(self) -> tuple[int, int]:
        return len(self), self.width

    def part(self, rows: np.ndarray) -> Blocks:
        chosen = np.flatnonzero(rows) if rows.dtype == bool else rows
        return Blocks(self.folder, self.purpose, self.names, self.starts, self.width, self.kind, chosen if self.index is None else self.index[chosen])

    def block(self, at: int) -> np.ndarray:
        place, name = f"{self.folder}/{self.purpose}", self.names[at]
        if place not in _maps:
            _maps.clear()
        held = _maps.setdefault(place, {})
        if name not in held:
            held[name] = mapped(f"{place}-{name}", self.kind, (int(self.starts[at + 1] - self.starts[at]), self.width))
        return held[name]

    def pieces(self, begin: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
        """``(row, array)``: the stored rows from ``begin`` to ``end``, file by file, not copied."""
        for at in range(int(np.searchsorted(self.starts, begin, "right")) - 1, len(self.names)):
            first = int(self.starts[at])
            if first >= end:
                return
            yield max(begin, first), self.block(at)[max(begin - first, 0) : end - first]

    def take(self, rows: np.ndarray, columns: np.ndarray | None = None) -> np.ndarray:
        """Copies of the ``rows``, which rise: whole, or of each its own columns (one, or a line of them)."""
        rows = rows if self.index is None else self.index[rows]
        out = np.empty((len(rows), self.width) if columns is None else columns.shape, self.kind)
        ends = np.searchsorted(rows, self.starts)
        for at in np.flatnonzero(np.diff(ends)).tolist():
            some = slice(int(ends[at]), int(ends[at + 1]))
            own = rows[some] - self.starts[at]
            if columns is None:
                out[some] = self.block(at)[own]
            else:
                out[some] = self.block(at)[own if columns.ndim == 1 else own[:, None], columns[some]]
        return out

    def mapped_to(self, spark: SparkSession, purpose: str, kind: str, change) -> Blocks:
        """Files beside these with what ``change`` makes of each, a task a file."""

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in batch.column("id").to_pylist():
                    write(self.folder, f"{purpose}-{self.names[at]}", change(self.block(at)).astype(kind))
                yield pa.RecordBatch.from_arrays([batch.column("id")], ["id"])

        files = len(self.names)
        spark.range(0, files, 1, files).mapInArrow(make, "id long").count()
        return Blocks(self.folder, purpose, self.names, self.starts, self.width, kind)

    def delete(self) -> None:
        system, path = opened(self.folder)
        for name in self.names:
            system.delete_file(f"{path}/{self.purpose}-{name}")


def take(matrix: np.ndarray | Blocks, rows: np.ndarray, columns: np.ndarray | None = None) -> np.ndarray:
    if isinstance(matrix, Blocks):
        return matrix.take(rows, columns)
    if columns is None:
        return matrix[rows]
    return matrix[rows if columns.ndim == 1 else rows[:, None], columns]


def write(folder: str, name: str, values: np.ndarray) -> None:
    file = Whole(folder, name)
    file.write(memoryview(np.ascontiguousarray(values)).cast("B"))
    file.close()


def stored(df: DataFrame, by_label: bool = False) -> tuple[Blocks, np.ndarray]:
    """Values of ``features`` in block files, and the labels, ordered by a hash of the values, or by labels first."""
    spark = df.sparkSession
    folder = shared_folder(spark, "fit-rows")
    make_folder(folder)
    rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"))
    tasks = max(1, -(-df.count() // BLOCK_ROWS))
    order = ["y", "k"] if by_label else ["k", "y"]
    salted = rows.withColumns({"k": F.xxhash64("x"), "s": F.monotonically_increasing_id() % _SALTS})
    dealt = salted.repartitionByRange(tasks, *order, "s").sortWithinPartitions(*order).select("x", "y")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, labels = TaskContext.get().partitionId(), 0, [], []

        def finished() -> pa.RecordBatch:
            nonlocal made
            name, y = f"{task:06d}-{made:06d}", np.concatenate(labels).astype(np.int32)
            values = np.concatenate(held)
            write(folder, f"values-{name}", values)
            held.clear()
            labels.clear()
            made += 1
            return pa.RecordBatch.from_pylist([{"name": name, "width": values.shape[1], "labels": y.tobytes()}], schema=_FILE)

        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            if len(batch):
                held.append(x.reshape(len(batch), -1))
                labels.append(batch.column("y").to_numpy(zero_copy_only=False))
            if sum(map(len, held)) >= BLOCK_ROWS:
                yield finished()
        if held:
            yield finished()

    # a row a file; a label has two bytes
    files = dealt.mapInArrow(store, "name string, width int, labels binary").toArrow().sort_by("name")
    labels = [np.frombuffer(x, np.int32) for x in files.column("labels").to_pylist()]
    every = np.concatenate(labels) if labels else np.zeros(0, np.int32)
    starts = np.cumsum([0, *map(len, labels)])
    width = files.column("width")[0].as_py() if len(labels) else 0
    small = every.astype(np.int16) if not len(every) or every.max() < 1 << 15 else every
    return Blocks(folder, "values", files.column("name").to_pylist(), starts, width, "float64"), small


_FILE = pa.schema([("name", pa.string()), ("width", pa.int32()), ("labels", pa.binary())])
