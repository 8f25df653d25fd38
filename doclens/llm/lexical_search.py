"""Ranked lexical search by sequential reads of impact-sorted lists (no random access).

The documents are dealt into index shards. A shard has a list for each term that an item asks for: the documents that
hold it with what the term adds to their score, the largest first. For an item, all lists of a shard are read from the
top, a stretch of each per round. A document's score lies between the sum of what was read for it and that sum plus, for
each list that has not shown it yet, the last value read there. Reading ends when every document whose upper
bound reaches the k-th best lower bound has a lower bound equal to its upper: membership, ties and scores are then final.
The k-th best score of a task's earlier shards holds for its later ones, too.

The weights come from counts over all documents. A task keeps the k best per item; groups of tasks and then all of
them are merged. Items are taken in blocks of a bounded number of terms, one pass over the documents each; only the block's
terms and their counts go through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from doclens.llm.base import query, table, wide_rows
from doclens.llm.words import PUNCTUATION, Words, chunks, text_bytes
from doclens.session import written

BLOCK_TERMS = 200_000  # item terms of one pass over the documents
SHARD_POSTINGS = 1 << 20  # list entries of a shard
FIRST_READ = 128  # entries of each list that the first round reads; every round doubles what was read
MERGED_TASKS = 256  # tasks whose results are merged before those of all


def _term_rows(items: DataFrame, item_column: str, text_column: str) -> DataFrame:
    """``(item, term)`` without repeats; terms are signed 64-bit fingerprints."""
    rows = items.select(F.col(item_column).alias("item"), F.col(text_column).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = Words(*text_bytes(batch.column("text")), lower=True, between=PUNCTUATION)
            own = batch.column("item").take(pa.array(words.text_of_word()))
            yield pa.RecordBatch.from_arrays([own, pa.array(words.hashes().view(np.int64))], ["item", "term"])

    schema = T.StructType([rows.schema["item"], T.StructField("term", T.LongType())])
    return written(rows.mapInArrow(scan, schema).distinct(), "item-terms")


def _forward(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """``(id, n, terms, counts)`` per document: its length, and places in ``wanted`` with how often they occur (int32 each)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = Words(*text_bytes(batch.column("text")), lower=True, between=PUNCTUATION)
            hashes = words.hashes()
            place = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
            hit = np.flatnonzero(wanted[place] == hashes)
            pairs, counts = np.unique(words.text_of_word()[hit] * len(wanted) + place[hit], return_counts=True)
            cuts = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * len(wanted))
            terms, counts = (pairs % len(wanted)).astype("<i4"), counts.astype("<i4")
            pack = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(words.counts.astype(np.int64)), pack(terms), pack(counts)], ["id", "n", "terms", "counts"]
            )

    schema = T.StructType(
        [docs.schema["id"], T.StructField("n", T.LongType()), T.StructField("terms", T.BinaryType()), T.StructField("counts", T.BinaryType())]
    )
    return written(docs.mapInArrow(scan, schema), "forward")


def _weights(forward: DataFrame, terms: int, documents: int) -> np.ndarray:
    """The weight of each wanted term from the number of documents that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(terms, np.int64)
        for batch in batches:
            held += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4"), minlength=terms)
        own = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(held[own])], ["term", "df"])

    counted = forward.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(terms, np.int64)
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


def _shard(ids: pa.Array, lengths: np.ndarray, terms: list[bytes], counts: list[bytes], weights: np.ndarray, documents: int, total: int) -> dict:
    """The lists of some documents, numbered in the order of their ids."""
    order = pc.array_sort_indices(ids, null_placement="at_start") if len(ids) else pa.array([], pa.uint64())
    number = np.empty(len(ids), np.int64)
    number[order.to_numpy()] = np.arange(len(ids))
    doc = np.repeat(np.arange(len(ids)), [len(x) // 4 for x in terms])
    term = np.frombuffer(b"".join(terms), "<i4")
    count = np.frombuffer(b"".join(counts), "<i4").astype(np.int64)
    length = 50 + 50 * lengths * documents // total
    impact = weights[term] * (1_000_000_000 * count // (1000 * count + 20 * length[doc]))
    doc = number[doc]
    kept = np.flatnonzero(impact > 0)
    kept = kept[np.lexsort((doc[kept], -impact[kept], term[kept]))]
    names, firsts = np.unique(term[kept], return_index=True)
    return {
        "ids": ids.take(order).to_pylist(),
        "terms": names.astype("<i4").tobytes(),
        "firsts": np.append(firsts, len(kept)).astype("<i8").tobytes(),
        "docs": doc[kept].astype("<i4").tobytes(),
        "impacts": impact[kept].astype("<i8").tobytes(),
    }


def _index(forward: DataFrame, weights: np.ndarray, documents: int, total: int, postings: int) -> DataFrame:
    """One row per shard: document ids, terms, and for each term its part of ``docs`` and ``impacts``, largest first."""
    schema = T.StructType(
        [T.StructField("ids", T.ArrayType(forward.schema["id"].dataType)), *(T.StructField(x, T.BinaryType()) for x in ("terms", "firsts", "docs", "impacts"))]
    )
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            columns = {x: whole.column(x) for x in ("terms", "counts")}
            row = _shard(
                pa.concat_arrays(whole.column("id").chunks), whole.column("n").to_numpy(),
                columns["terms"].to_pylist(), columns["counts"].to_pylist(), weights, documents, total,
            )
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            upto = np.cumsum([len(x) // 4 for x in batch.column("terms").to_pylist()])
            start = 0
            while start < batch.num_rows:
                before = int(upto[start - 1]) if start else 0
                stop = min(batch.num_rows, max(start + 1, int(np.searchsorted(upto, before + postings - size, "right"))))
                held.append(batch.slice(start, stop - start))
                size += int(upto[stop - 1]) - before
                if stop < batch.num_rows:
                    yield flush()
                    size = 0
                start = stop
        if held:
            yield flush()

    return written(forward.filter(F.length("terms") > 0).mapInArrow(build, schema), "lists")


def best_documents(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """``(documents, scores, entries read)``: the ``k`` best of documents 0 to ``size - 1`` with a score of ``floor`` or more.

    Each list holds documents and what it adds to them, the largest first; a document is in a list once.
    Equal scores go by the document's number.
    """
    lower = np.zeros(size, np.int64)
    seen = np.zeros((len(lists), size), bool)
    alive = np.arange(size)  # documents that may still be among the best
    done, upto = 0, FIRST_READ
    while True:
        ceilings = np.zeros(len(lists), np.int64)
        for at, (docs, impacts) in enumerate(lists):
            part = docs[done:upto]
            lower[part] += impacts[done:upto]
            seen[at, part] = True
            if upto < len(impacts):
                ceilings[at] = impacts[upto - 1]
        own = lower[alive]
        kth = int(np.partition(own, len(own) - k)[len(own) - k]) if len(own) >= k else 0
        least = max(floor, kth)
        if ceilings.any():
            upper = own + (ceilings.astype(np.float64) @ ~seen[:, alive]).astype(np.int64)  # sums below 2 ** 53 are exact
        else:
            upper = own
        possible = upper >= least
        alive, own, upper = alive[possible], own[possible], upper[possible]
        if (own == upper).all():
            break
        done, upto = upto, 2 * upto
    order = np.lexsort((alive, -own))[:k]
    return alive[order], own[order], sum(min(upto, len(d)) for d, _ in lists)


def _search_shards(index: DataFrame, items: pa.Array, queries: list[np.ndarray], k: int, id_field: T.StructField, item_field: T.StructField) -> DataFrame:
    """``(item, id, score, task)``: the best of each task."""
    schema = T.StructType([item_field, id_field, T.StructField("score", T.LongType()), T.StructField("task", T.IntegerType())])
    id_type = to_arrow_type(id_field.dataType)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pa.table({"id": pa.array([], id_type), "score": pa.array([], pa.int64())})] * len(queries)
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column("ids")[row].values
                read = lambda name, kind: np.frombuffer(batch.column(name)[row].as_buffer(), kind)  # noqa: B023, E731
                terms, firsts, docs, impacts = read("terms", "<i4"), read("firsts", "<i8"), read("docs", "<i4"), read("impacts", "<i8")
                for number, wanted in enumerate(queries):
                    own = np.flatnonzero(np.isin(terms, wanted, assume_unique=True))
                    if not len(own):
                        continue
                    before = held[number]
                    floor = before.column("score")[-1].as_py() if before.num_rows == k else 1
                    lists = [(docs[firsts[t] : firsts[t + 1]], impacts[firsts[t] : firsts[t + 1]]) for t in own]
                    found, scores, _ = best_documents(lists, len(ids), k, floor)
                    if len(found):
                        both = pa.concat_tables([before, pa.table({"id": ids.take(pa.array(found)), "score": pa.array(scores)})])
                        order = pc.sort_indices(both, [("score", "descending"), ("id", "ascending")], null_placement="at_start")
                        held[number] = both.take(order[:k]).combine_chunks()
        task = TaskContext.get().partitionId()
        for number, best in enumerate(held):
            if best.num_rows:
                n = best.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([items[number].as_py()] * n, items.type), best.column("id").combine_chunks().cast(id_type), best.column("score").combine_chunks(), pa.array([task] * n, pa.int32())],
                    ["item", "id", "score", "task"],
                )

    return index.mapInArrow(search, schema)


def _ranked(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    block_terms: int = BLOCK_TERMS,
    shard_postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """``(item, rank, id, score)``: the ``k`` documents with the highest scores above 0 for each item, ranked from 1.

    Terms are runs of ASCII letters, digits and characters outside ASCII, A-Z lower-cased. Equal scores go by id, null ids
    first. Null, empty and term-less texts have no terms: such documents are found by nothing and count in no
    statistic, such items find nothing. Rows of ``items`` with the same id are one item; repeated rows of ``docs`` are
    documents of their own. Empty tables give no rows, other columns are not looked at. A long text is read as a
    whole by one task, at some 60 bytes of memory per byte. Ids may be of any type that can be ordered.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    asked = _term_rows(items, item_column, item_text_column)
    blocks = max(1, -(-asked.count() // block_terms))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    results = [_block(spark, rows, asked.filter(F.col("block") == block).drop("block"), k, shard_postings) for block in range(blocks)]
    return reduce(DataFrame.unionByName, results).select(F.col("item").alias(item_column), "rank", F.col("id").alias(id_column), "score")


def _block(spark: SparkSession, rows: DataFrame, asked: DataFrame, k: int, postings: int) -> DataFrame:
    """The best documents of one block of items, written."""
    pairs = asked.orderBy("item", "term").toArrow().combine_chunks()
    terms = pairs.column("term").to_numpy().view(np.uint64)
    wanted, place = np.unique(terms, return_inverse=True)
    schema = T.StructType([asked.schema["item"], T.StructField("rank", T.IntegerType()), rows.schema["id"], T.StructField("score", T.LongType())])
    if not len(wanted):
        return spark.createDataFrame([], schema)
    names = pa.concat_arrays(pairs.column("item").chunks)
    firsts = np.flatnonzero(np.append(True, [a != b for a, b in zip(names[1:].to_pylist(), names[:-1].to_pylist())]))
    queries = [part.astype(np.int32) for part in np.split(place, firsts[1:])]
    forward = _forward(rows, wanted)
    counted = forward.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("total")).first()
    if not counted["total"]:
        return spark.createDataFrame([], schema)
    weights = _weights(forward, len(wanted), counted["documents"])
    index = _index(forward, weights, counted["documents"], counted["total"], postings)
    with wide_rows(spark, 1):  # a row is a shard
        found = written(
            _search_shards(index, names.take(pa.array(firsts)), queries, k, rows.schema["id"], asked.schema["item"]), "found"
        )
    some = _ranked(found.withColumn("part", F.floor(F.col("task") / MERGED_TASKS)), ["item", "part"], k).drop("rank", "part")
    return written(_ranked(some, ["item"], k).select("item", F.col("rank").cast("int"), "id", "score"), "ranked")


_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS d, doc_id, text FROM documents),
words AS (SELECT d, doc_id, unnest(regexp_extract_all(translate(text, {_LETTERS}), '{_TERM}')) AS term FROM texts),
held AS (SELECT d, doc_id, term, count(*) AS tf FROM words GROUP BY d, doc_id, term),
lengths AS (SELECT d, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY d),
whole AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS total FROM lengths),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {_LETTERS}), '{_TERM}')) AS term FROM benchmark),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM held, whole WHERE term IN (SELECT term FROM asked) GROUP BY term, documents),
impacts AS (
  SELECT h.d, h.doc_id, h.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * documents) // total))) AS impact
  FROM held h JOIN weights USING (term) JOIN lengths l ON h.d = l.d, whole),
scores AS (SELECT item_id, d, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, d, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@query("op12_lexical_search", _SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
