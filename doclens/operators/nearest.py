"""Exact top-k between two vector tables, without pairing all rows in a join.

One side is taken in blocks of bounded size and the other side streams past them. Blocks of jobs are
broadcast; the items of a training set grow with the data, so executors write them into block files around pivots, and tasks read
those blocks that may hold a neighbour. A task multiplies a batch with the block as dense
matrices and keeps only the best ``k`` per query, so it emits at most ``k`` rows per query and the pairs
themselves never become rows. Rows of the streamed side are never shuffled or copied, however
many blocks there are; with more than one block of jobs, the documents' vectors are written once and scanned per block.

The final ``row_number`` per job runs over these partial results only; a task has all items of its queries. Ids may be of any simple type.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclens.batches import slices
from doclens.files import Whole, make_folder, opened
from doclens.session import shared_folder, written

BLOCK_ROWS = 10_000
_MATRIX_CELLS = 4_000_000  # scores held at once by one task
_DOCUMENTS = 1024  # documents whose vectors a task widens and scores at once,
_JOB_CELLS = 1 << 19  # or as many as have so many scores: there are several such matrices side by side


_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string(),
    "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "date": pa.date32(),
}


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    kind = dict(df.dtypes)[column]
    if kind not in _ARROW:
        raise ValueError(f"column {column} has type {kind}; known: {sorted(_ARROW)}")
    return _ARROW[kind]


def sortable(column: pa.Array) -> np.ndarray:
    """Ids as an array that sorts as Spark sorts them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.array(column.to_pylist(), dtype=str)
    return column.to_numpy(zero_copy_only=False)


def blocks_of(df: DataFrame, id_column: str, block_rows: int) -> Iterator[pa.Table]:
    """The rows in hash blocks of about ``block_rows``, one after the other on the driver; one empty block for no rows."""
    blocks = max(1, -(-df.count() // block_rows))
    dealt = written(df, "blocks") if blocks > 1 else df
    for block in range(blocks):
        yield dealt.filter(F.pmod(F.xxhash64(F.col(id_column)), F.lit(blocks)) == block).toArrow()


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Arrow list column -> float64 matrix without per-row work."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dim)


def best_per_column(scores: np.ndarray, ids: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the best ``limits[column]`` scores of every column, best first.

    Ties go to the lowest id, so everything equal to the last kept score stays a
    candidate until the ids have been compared.
    """
    rows = scores.shape[0]
    found = []
    for keep in np.unique(limits).tolist():  # a job that wants many rows doesn't widen the others
        wanted = np.flatnonzero(limits == keep)
        part = scores[:, wanted]
        if rows > keep:
            edge = np.partition(part, rows - keep, axis=0)[rows - keep]
            row, column = np.nonzero(part >= edge[None, :])
        else:
            row, column = (x.ravel() for x in np.indices(part.shape))
        found.append((row, wanted[column]))
    row, column = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
    order = np.lexsort((ids[row], -scores[row, column], column))
    row, column = row[order], column[order]
    kept = place_in_run(column) < limits[column]
    return row[kept], column[kept]


def place_in_run(keys: np.ndarray) -> np.ndarray:
    """0-based place of every element inside its run of equal keys."""
    if len(keys) == 0:
        return np.zeros(0, dtype=int)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return np.arange(len(keys)) - np.repeat(starts, np.diff(np.r_[starts, len(keys)]))


# -- jobs against documents -------------------------------------------------------------

_SCORES = {
    "top_n": pa.int32(), "similarity_score": pa.float64(), "skill_match_score": pa.float64(), "combined_score": pa.float64(),
    "skill_ids": pa.list_(pa.int32()),
}
_SCORES_SQL = "top_n int, similarity_score double, skill_match_score double, combined_score double, skill_ids array<int>"


class JobBlock:
    """A block of jobs as matrices: token counts, skill flags and weights."""

    def __init__(self, jobs: pa.Table, vector_dim: int, skill_dim: int, schema: pa.Schema):
        self.schema = schema
        self.job_id = sortable(jobs.column("job_id"))
        jobs = jobs.drop_columns("job_id").to_pandas()
        vectors = np.array(jobs["vector"].tolist(), dtype="float64").reshape(len(jobs), vector_dim + skill_dim)
        self.vector_dim = vector_dim
        self.top_n = jobs["top_n"].to_numpy("int64")
        self.counts = vectors[:, :vector_dim].T
        self.flags = vectors[:, vector_dim:].T
        self.norm2 = (vectors[:, :vector_dim] ** 2).sum(axis=1)
        self.n_skills = self.flags.sum(axis=0)
        self.blank = jobs["is_blank"].to_numpy(bool)
        self.w_sim = jobs["similarity_weight"].to_numpy("float64")
        self.w_skill = jobs["skill_weight"].to_numpy("float64")

    def score(self, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(similarity, skill match, combined) of documents x jobs.

        Counts are whole numbers, so every dot product is exact and the scores
        do not depend on how rows were split over tasks.
        """
        counts = documents[:, : self.vector_dim]
        norms = np.sqrt((counts**2).sum(axis=1)[:, None] * self.norm2[None, :])
        dots = counts @ self.counts
        similarity = np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
        similarity[:, self.blank] = 0.0
        shared = documents[:, self.vector_dim :] @ self.flags
        skill = np.divide(shared, self.n_skills, out=np.zeros_like(shared), where=self.n_skills > 0)
        return similarity, skill, self.w_sim * similarity + self.w_skill * skill

    def best(self, doc_ids: np.ndarray, documents: np.ndarray) -> pa.Table:
        """Best ``top_n`` documents of the batch for every job."""
        step = max(1, _JOB_CELLS // max(len(self.job_id), 1))
        parts = []
        for start in range(0, len(doc_ids), step):
            ids, rows = doc_ids[start : start + step], documents[start : start + step]
            similarity, skill, combined = self.score(rows)
            at, job = best_per_column(combined, ids, self.top_n)
            flags = rows[:, self.vector_dim :]
            columns = [
                self.job_id[job], ids[at], self.top_n[job], similarity[at, job], skill[at, job], combined[at, job],
                [np.flatnonzero(flags[i]).astype("int32") for i in at],
            ]
            parts.append(pa.table([pa.array(c).cast(f.type) if len(c) else pa.array([], f.type) for c, f in zip(columns, self.schema)], schema=self.schema))
        return trim(parts, self.schema)


def trim(parts: list[pa.Table], schema: pa.Schema) -> pa.Table:
    """Merge partial results and cut them back to ``top_n`` per job."""
    if not parts:
        return schema.empty_table()
    merged = pa.concat_tables(parts)
    job = sortable(merged.column("job_id"))
    order = np.lexsort((sortable(merged.column("doc_id")), -merged.column("combined_score").to_numpy(), job))
    kept = place_in_run(job[order]) < merged.column("top_n").to_numpy()[order]
    return merged.take(order[kept])


def best_documents(jobs: JobBlock, batches: Iterator[pa.RecordBatch], width: int) -> pa.Table:
    """Best ``top_n`` of a task's documents for every job, few documents at a time however large the batches are."""
    kept: list[pa.Table] = []
    for batch in slices(batches, lambda b: np.ones(b.num_rows, np.int64), _DOCUMENTS):
        kept.append(jobs.best(sortable(batch.column("doc_id")), matrix(batch.column("vector"), width)))
        if len(kept) >= 8:
            kept = [trim(kept, jobs.schema)]
    return trim(kept, jobs.schema)


def top_documents_per_job(
    jobs: DataFrame, documents: DataFrame, vector_dim: int, skill_dim: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Partial-then-final top-N of every job.

    ``jobs``: ``job_id, vector, top_n, is_blank, similarity_weight, skill_weight``;
    ``documents``: ``doc_id, vector``; ``vector`` holds counts then skill flags.
    """
    columns = ["job_id", "vector", "top_n", "is_blank", "similarity_weight", "skill_weight"]
    jobs, documents = jobs.select(*columns), documents.select("doc_id", "vector")
    width = vector_dim + skill_dim
    schema = pa.schema([("job_id", arrow_type(jobs, "job_id")), ("doc_id", arrow_type(documents, "doc_id")), *_SCORES.items()])
    kinds = dict(jobs.dtypes)["job_id"], dict(documents.dtypes)["doc_id"]
    partial = None
    for number, table in enumerate(blocks_of(jobs, "job_id", block_rows)):
        if number == 1:  # more than one block: the vectors are made once
            documents = written(documents, "vectors")
        block = documents.sparkSession.sparkContext.broadcast(JobBlock(table, vector_dim, skill_dim, schema))

        def stream(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            yield from best_documents(block.value, batches, width).to_batches()

        part = documents.mapInArrow(stream, f"job_id {kinds[0]}, doc_id {kinds[1]}, {_SCORES_SQL}")
        partial = part if partial is None else partial.unionAll(part)
    order = Window.partitionBy("job_id").orderBy(F.col("combined_score").desc(), F.col("doc_id"))
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= F.col("top_n"))
        .drop("top_n")
    )


# -- nearest neighbours -------------------------------------------------------------------


class ItemBlock:
    """A block of labelled vectors."""

    def __init__(self, ids: np.ndarray, labels: pa.Array, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.norm2 = (vectors**2).sum(axis=1)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, schema: pa.Schema) -> pa.Table:
        """``k`` nearest items of every query by Euclidean distance (ties by id).

        The matrix product only narrows the candidates, with a margin far above
        its rounding error; distances of the candidates are then computed directly.
        """
        step = max(1, _MATRIX_CELLS // max(len(self.ids), 1))
        parts = []
        for start in range(0, len(query_ids) if len(self.ids) else 0, step):
            part = queries[start : start + step]
            norm2 = (part**2).sum(axis=1)
            rough = norm2[:, None] + self.norm2[None, :] - 2.0 * (part @ self.vectors.T)
            if rough.shape[1] > k:
                margin = 1e-9 * (1.0 + norm2 + float(self.norm2.max()))
                query, item = np.nonzero(rough <= (np.partition(rough, k - 1, axis=1)[:, k - 1] + margin)[:, None])
            else:
                query, item = (x.ravel() for x in np.indices(rough.shape))
            gaps = np.sqrt(((self.vectors[item] - part[query]) ** 2).sum(axis=1))
            order = np.lexsort((self.ids[item], gaps, query))
            order = order[place_in_run(query[order]) < k]
            query, item = query[order], item[order]
            columns = [pa.array(query_ids[start + query]), pa.array(self.ids[item]), self.labels.take(pa.array(item)), pa.array(gaps[order])]
            parts.append(pa.table([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()


# -- an index of blocks around pivots ---------------------------------------------------------

MAX_PIVOTS = 1024
HELD_QUERIES = 50_000  # queries that a task holds while it goes through the blocks


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (vectors**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2.0 * (vectors @ pivots.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _save_table(folder: str, name: str, table: pa.Table) -> None:
    file = Whole(folder, name)
    with pa.ipc.new_stream(file.stream, table.schema) as out:
        out.write_table(table)
    file.close()


def _load_table(folder: str, name: str) -> pa.Table:
    system, path = opened(folder)
    with system.open_input_file(f"{path}/{name}") as file:
        return pa.ipc.open_stream(file).read_all().combine_chunks()


@lru_cache(maxsize=2)
def _directory(folder: str, name: str, dim: int) -> tuple:
    """Pivots, and file, cell, least and largest distance from the pivot of every block."""
    blocks = _load_table(folder, f"{name}-directory.arrow")
    pivots = matrix(_load_table(folder, f"{name}-pivots.arrow").column("vector"), dim)
    return pivots, blocks.column("file").to_pylist(), *(blocks.column(c).to_numpy() for c in ("cell", "low", "high"))


@lru_cache(maxsize=4)
def _block(folder: str, file: str, dim: int) -> ItemBlock:
    table = _load_table(folder, file)
    return ItemBlock(sortable(table.column("item_id")), table.column("label").combine_chunks(), matrix(table.column("vector"), dim))


@dataclass(frozen=True)
class MetricIndex:
    """Labelled vectors in block files: each block holds items of one pivot's cell within a range of distances from the pivot.

    A query reads the blocks that may hold a neighbour: by the triangle inequality an item is at least as far as
    the gap between the query's and the block's distances from the pivot.
    """

    folder: str
    name: str
    dim: int
    blocks: int
    item_kind: str
    label_kind: str

    def schema(self) -> pa.Schema:
        return pa.schema([("query", pa.int64()), ("item_id", _ARROW[self.item_kind]), ("label", _ARROW[self.label_kind]), ("distance", pa.float64())])

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return _distances(vectors, _directory(self.folder, self.name, self.dim)[0]).argmin(1)

    def near(self, vectors: np.ndarray, k: int) -> tuple[pa.Table, np.ndarray]:
        """The ``k`` nearest items of each vector as ``(query, item_id, label, distance)``, and the blocks compared per vector."""
        pivots, files, cell, low, high = _directory(self.folder, self.name, self.dim)
        schema, compared = self.schema(), np.zeros(len(vectors), np.int64)
        best, farthest = schema.empty_table(), np.full(len(vectors), np.inf)
        if not len(vectors) or not files:
            return best, compared
        away = _distances(vectors, pivots)
        slack = 1e-9 * (1.0 + float(away.max()))  # far above the rounding of the distances
        gap = lambda b: np.maximum(np.maximum(away[:, cell[b]] - high[b], low[b] - away[:, cell[b]]) - slack, 0.0)
        for b in np.argsort([gap(b).mean() for b in range(len(files))], kind="stable"):
            asking = np.flatnonzero(gap(b) <= farthest)
            if not len(asking):
                continue
            compared[asking] += 1
            best = _best(pa.concat_tables([best, _block(self.folder, files[b], self.dim).nearest(asking, vectors[asking], k, schema)]), k)
            query = best.column("query").to_numpy()
            last = np.flatnonzero(place_in_run(query) == k - 1)
            farthest[query[last]] = best.column("distance").to_numpy()[last]
        return best, compared

    def items(self, spark: SparkSession) -> DataFrame:
        """``(item_id, label, vector)`` as they were indexed."""
        folder, dim, name = self.folder, self.dim, self.name
        numbers = spark.range(0, self.blocks, 1, max(1, self.blocks))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number in batch.column("id").to_pylist():
                    yield from _load_table(folder, _directory(folder, name, dim)[1][number]).to_batches()

        return numbers.mapInArrow(read, f"item_id {self.item_kind}, label {self.label_kind}, vector array<double>")


def build_index(items: DataFrame, folder: str, dim: int, block_rows: int = BLOCK_ROWS) -> MetricIndex:
    """Index ``items`` (``item_id, label, vector``) in ``folder``.

    Pivots are at most 1,024 items, the first in hash order. Executors sort the items by cell and distance and write blocks of
    ``block_rows``; a cell with very many items has many blocks. Only pivots and counts reach the driver.
    """
    items = items.select("item_id", "label", F.col("vector").cast("array<double>").alias("vector"))
    spark, name = items.sparkSession, uuid.uuid4().hex
    kinds = dict(items.dtypes)
    for column in ("item_id", "label"):
        arrow_type(items, column)  # an error for other types
    make_folder(folder)
    rows = items.count()
    wanted = min(MAX_PIVOTS, max(1, -(-rows // block_rows)))
    chosen = items.select("vector", F.xxhash64("vector", "item_id").alias("h")).orderBy("h").limit(wanted).toArrow().combine_chunks()
    pivots = matrix(chosen.column("vector"), dim)
    _save_table(folder, f"{name}-pivots.arrow", pa.table({"vector": pa.array(list(pivots), pa.list_(pa.float64()))}))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = _distances(matrix(batch.column("vector"), dim), pivots) if batch.num_rows else np.zeros((0, 1))
            cell = away.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away[np.arange(len(cell)), cell])], [*batch.schema.names, "cell", "away"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            file, away = f"block-{uuid.uuid4().hex}.arrow", table.column("away").to_numpy()  # this attempt's own
            _save_table(folder, file, table.select(["item_id", "label", "vector"]))
            cell = held[0].column("cell")[0].as_py()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([cell], pa.int32()), pa.array([away.min()]), pa.array([away.max()])], ["file", "cell", "low", "high"])

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            start = 0
            while start < batch.num_rows:
                if held and held[0].column("cell")[0].as_py() != cells[start]:
                    yield close()
                    size = 0
                same = int(np.searchsorted(cells, cells[start], "right"))
                stop = min(same, start + block_rows - size)
                held.append(batch.slice(start, stop - start))
                size += stop - start
                start = stop
                if size >= block_rows:
                    yield close()
                    size = 0
        if held:
            yield close()

    def list_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = pa.schema([("file", pa.string()), ("cell", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]).empty_table()
        table = pa.concat_tables([empty, *(pa.Table.from_batches([b]) for b in batches)]).sort_by([("cell", "ascending"), ("low", "ascending"), ("file", "ascending")])
        _save_table(folder, f"{name}-directory.arrow", table)
        yield pa.RecordBatch.from_arrays([pa.array([table.num_rows], pa.int64())], ["blocks"])

    order = ["cell", "away", "item_id"]
    assigned = items.mapInArrow(assign, f"item_id {kinds['item_id']}, label {kinds['label']}, vector array<double>, cell int, away double")
    dealt = assigned.repartitionByRange(max(1, -(-rows // (4 * block_rows))), *order).sortWithinPartitions(*order)
    listed = written(dealt.mapInArrow(write, "file string, cell int, low double, high double"), "block-list")
    # a row per block: one task lists them
    blocks = listed.coalesce(1).mapInArrow(list_blocks, "blocks long").agg(F.sum("blocks")).first()[0] or 0
    if not blocks:
        list(list_blocks(iter([])))
    return MetricIndex(folder, name, dim, blocks, kinds["item_id"], kinds["label"])


def nearest_items(
    queries: DataFrame, items: DataFrame, k: int, dim: int, block_rows: int = BLOCK_ROWS, index: MetricIndex | None = None
) -> DataFrame:
    """``(query_id, item_id, label, distance)``: the ``k`` nearest items of each query.

    ``queries``: ``query_id, vector``; ``items``: ``item_id, label, vector``, or an ``index`` of them. With more than one block
    the queries are sorted by the cell that they lie in, so that those of a task ask for the same blocks; a task holds many
    queries at a time and reads a block once for all that need it. No vector but the pivots passes through the driver.
    """
    queries = queries.select("query_id", "vector")
    kinds = dict(queries.dtypes)["query_id"]
    query_type = arrow_type(queries, "query_id")
    if index is None:
        index = build_index(items, shared_folder(queries.sparkSession, "blocks"), dim, block_rows)
    if index.blocks > 1:

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = index.cells(matrix(batch.column("vector"), dim)) if batch.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], [*batch.schema.names, "cell"])

        placed = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(place, f"query_id {kinds}, vector array<double>, cell int")
        tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        queries = placed.repartitionByRange(tasks, "cell", "query_id").sortWithinPartitions("cell", "query_id").select("query_id", "vector")

    def search(ids: list[pa.Array], vectors: list[np.ndarray]) -> pa.RecordBatch:
        best, _ = index.near(np.concatenate(vectors), k)
        own = pa.concat_arrays(ids).take(best.column("query").combine_chunks())
        names = ["item_id", "label", "distance"]
        return pa.RecordBatch.from_arrays([own, *(best.column(c).combine_chunks() for c in names)], ["query_id", *names])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []
        for batch in batches:
            ids.append(batch.column("query_id").cast(query_type))
            vectors.append(matrix(batch.column("vector"), dim))
            if sum(map(len, ids)) >= HELD_QUERIES:
                yield search(ids, vectors)
                ids, vectors = [], []
        if ids:
            yield search(ids, vectors)

    return queries.mapInArrow(stream, f"query_id {kinds}, item_id {index.item_kind}, label {index.label_kind}, distance double")


def _best(found: pa.Table, k: int) -> pa.Table:
    """The ``k`` nearest of every query, ties by id."""
    query = found.column("query").to_numpy()
    order = np.lexsort((sortable(found.column("item_id")), found.column("distance").to_numpy(), query))
    return found.take(pa.array(order[place_in_run(query[order]) < k]))
