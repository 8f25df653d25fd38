"""Benchmark decontamination by SimHash windows of the items' size.

Every window of a text that is as long as a benchmark item gets a 64-bit SimHash of its word pairs. A fingerprint
within the radius of an item's must, in one of four 16-bit blocks, differ from it in at most a quarter of
the radius; each item is therefore filed in each block under all values so near to its own, and a window looks
up its four blocks. That finds all fingerprints within the radius. Around a hit, the exact weighted similarity of word
shingles decides over the windows of every length, so words may be put in or left out.

Item sizes are rounded down to a grid, so the number of window sizes grows with the logarithm of the longest
item only; an item longer than its grid size is looked for by its first and its last words. Windows of all
places of all texts are made from sums of the pair bits over 1, 2, 4, ... neighbours. The pass is narrow: documents are never
shuffled. Items never reach the driver: Spark counts over the whole benchmark how many items hold a shingle and files the
items in blocks of bounded size in the shared folder, which the tasks read one by one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.base import block_rows, query, table
from doclens.llm.words import Words, chunks, mix, text_bytes, windows
from doclens.session import shared_folder, written

SHINGLE = 5
RADIUS = 11
# Window sizes in words.
GRID = (5, 6, 8, 10, 12, 15, 19, 24, 30, 38, 48, 60)
BLOCK_ITEMS = 10_000  # benchmark items that a task holds at once
HELD_BYTES = 64 << 20  # texts that a task holds while it goes through several blocks of items
_SPAN = 16_384  # windows made at once
_U = np.uint64


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """Fingerprints of neighbouring words."""
    return mix(hashes[:-1] * _U(0xD6E8FEB86659FD93) + hashes[1:]) if len(hashes) > 1 else np.zeros(0, np.uint64)


def _sums(pairs: np.ndarray) -> list[np.ndarray]:
    """Sums of +1 and -1 per bit over 1, 2, 4, ... neighbouring pairs from each on; no grid size overflows 8 bits."""
    bits = np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.int8)
    out = [bits * np.int8(2) - np.int8(1)]
    while 1 << len(out) <= GRID[-1] and len(out[-1]) > 1 << (len(out) - 1):
        half = 1 << (len(out) - 1)
        out.append(out[-1][:-half] + out[-1][half:])
    return out


def _simhashes(sums: list[np.ndarray], size: int) -> np.ndarray:
    """The fingerprint of every window of ``size`` words; a tied bit is 0."""
    pairs = size - 1
    many, at, total = len(sums[0]) - pairs + 1, 0, None
    for k in range(pairs.bit_length()):
        if pairs >> k & 1:
            part = sums[k][at : at + many]
            total = part if total is None else total + part
            at += 1 << k
    return np.packbits(total > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def _block(marks: np.ndarray, number: int) -> np.ndarray:
    """One of the four 16-bit blocks of each fingerprint."""
    return ((marks >> _U(16 * number)) & _U(0xFFFF)).astype(np.uint16)


def _split(values: np.ndarray, held: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(held)[:-1]) if len(held) else []


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_counts=True)


def _looked_up(values: np.ndarray, keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The number of each value among sorted keys, else one."""
    if not len(keys):
        return np.ones(len(values))
    place = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[place] == values, numbers[place], 1).astype(float)


class Items:
    """Benchmark items and, per window size, the table of their fingerprints' blocks."""

    def __init__(self, ids: Sequence, texts: Sequence[str | None], radius: int = RADIUS, holders: list[tuple[np.ndarray, np.ndarray]] | None = None):
        """``holders`` lists per item the shingles that other items hold, too, and the number of items; else it is counted on these items."""
        self.ids, self.radius = ids, radius
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        words = Words(data, offsets, lower=True)
        hashes = words.hashes()
        self.lengths = words.counts
        self.own = [_counted(v) for v in _split(*windows(hashes, words.counts, SHINGLE))]  # shingles, their counts
        if holders is None:
            every, held = np.unique(np.concatenate([np.zeros(0, np.uint64), *(v for v, _ in self.own)]), return_counts=True)
            holders = [(every, held)] * len(self.own)
        # a shingle that many items share says little
        self.weights = [1.0 / _looked_up(v, *h) for (v, _), h in zip(self.own, holders)]
        self.totals = [float((n * w).sum()) for (_, n), w in zip(self.own, self.weights)]
        prints: dict[int, list[tuple[int, int, int]]] = {}
        for i, n in enumerate(words.counts.tolist()):
            if n < SHINGLE:
                continue
            size = max(g for g in GRID if g <= n)
            sums = _sums(_pairs(hashes[words.first[i] : words.first[i] + n]))
            marks = _simhashes(sums, size)
            for at in sorted({0, (n - size) // 2, n - size}):
                prints.setdefault(size, []).append((int(marks[at]), i, at))
        near = [m for k in range(radius // 4 + 1) for m in (sum(1 << b for b in c) for c in itertools.combinations(range(16), k))]
        self.tables = {}
        for size, found in sorted(prints.items()):
            marks = np.array([f[0] for f in found], np.uint64)
            blocks = []
            for block in range(4):
                cells = (_block(marks, block).astype(np.int64)[:, None] ^ np.array(near)[None, :]).ravel()
                order = np.argsort(cells, kind="stable")
                first = np.searchsorted(cells[order], np.arange((1 << 16) + 1)).astype(np.int32)
                blocks.append((first, np.diff(first) > 0, (order // len(near)).astype(np.int32)))
            self.tables[size] = (marks, np.array([f[1] for f in found]), np.array([f[2] for f in found]), blocks)

    def near(self, size: int, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ``(window, print)`` whose fingerprints differ in at most ``radius`` bits."""
        own, _, _, blocks = self.tables[size]
        windows_, prints = [], []
        for number, (first, used, filed) in enumerate(blocks):
            cell = _block(marks, number)
            hit = np.flatnonzero(used[cell])
            if not len(hit):
                continue
            cell = cell[hit].astype(np.int64)
            low = first[cell].astype(np.int64)
            many = first[cell + 1] - low
            window = np.repeat(hit, many)
            place = np.arange(int(many.sum())) + np.repeat(low - (np.cumsum(many) - many), many)
            one = filed[place]
            close = np.bitwise_count(marks[window] ^ own[one]) <= self.radius
            windows_.append(window[close])
            prints.append(one[close])
        if not windows_:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.concatenate(windows_) * len(own) + np.concatenate(prints))
        return both // len(own), both % len(own)

    def best_window(self, item: int, shingles: np.ndarray, threshold: float) -> tuple[float, int]:
        """Similarity and first shingle of the best stretch of ``shingles``, of any length; (0, 0) if none reaches the threshold.

        The similarity is weighted Jaccard of shingles with their counts; shingles that the item hasn't weigh one. A best
        stretch begins and ends with shingles of the item, since others only lower it.
        """
        (keys, counts), weights, total = self.own[item], self.weights[item], self.totals[item]
        place = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
        hits = np.flatnonzero(keys[place] == shingles)
        which = place[hits]
        least = threshold * total - 1e-9
        if (np.minimum(np.bincount(which, minlength=len(keys)), counts) * weights).sum() < least:
            return 0.0, 0
        load = np.ones(len(shingles))
        load[hits] = weights[which]
        upto = np.concatenate(([0.0], np.cumsum(load)))
        order = np.argsort(which, kind="stable")
        rank = np.empty(len(hits), np.int64)  # of each hit among those of the same shingle
        rank[order] = np.arange(len(hits)) - np.searchsorted(which[order], which[order])
        gone = np.zeros(len(keys), np.int64)
        left = np.cumsum(weights[which][::-1])[::-1]
        best, first = 0.0, 0
        for s, begin in enumerate(hits.tolist()):
            if left[s] < least or best >= 1.0 - 1e-12:
                break
            stop = int(np.searchsorted(upto[hits + 1], upto[begin] + total / threshold + 1e-9, "right"))
            own = which[s:stop]
            shared = np.cumsum(np.where(rank[s:stop] - gone[own] < counts[own], weights[own], 0.0))
            near = shared / (total + upto[hits[s:stop] + 1] - upto[begin] - shared)
            if len(near) and near.max() > best + 1e-12:
                best, first = float(near.max()), begin
            gone[which[s]] += 1
        return (best, first) if best >= threshold - 1e-9 else (0.0, 0)

    def search(self, column: pa.Array, threshold: float) -> dict[tuple[int, int], tuple[float, int]]:
        """``(text, item) -> (similarity, first word)`` of the best window, for all pairs that reach the threshold."""
        best: dict[tuple[int, int], tuple[float, int]] = {}
        if not self.tables:
            return best
        data, offsets = text_bytes(column)
        words = Words(data, offsets, lower=True)
        hashes = words.hashes()
        pairs = _pairs(hashes)
        owner = words.text_of_word()
        spots = []  # text, item, and the word of the text at which the item would begin
        longest = max(self.tables)
        for begin in range(0, len(hashes), _SPAN):
            end = min(len(hashes), begin + _SPAN + longest - 1)
            sums = _sums(pairs[begin : end - 1])
            for size, (_, item_of, at_of, _) in self.tables.items():
                starts = min(_SPAN, end - begin - size + 1)
                if starts <= 0:
                    continue
                inside = owner[begin : begin + starts] == owner[begin + size - 1 : begin + size - 1 + starts]
                window, found = self.near(size, _simhashes(sums, size)[:starts])
                window, found = window[inside[window]], found[inside[window]]
                text = owner[begin + window]
                spots.append(np.stack((text, item_of[found], begin + window - at_of[found] - words.first[text])))
        if not spots or not sum(s.shape[1] for s in spots):
            return best
        text, item, low = np.unique(np.concatenate(spots, axis=1), axis=1)
        # so many words may lie before or behind the place that the hit tells
        pad = np.ceil(self.lengths[item] * (1 / threshold - 1)).astype(np.int64) + 1
        reach = self.lengths[item] + 2 * pad
        apart = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (low[1:] - low[:-1] > reach[:-1])
        heads = np.flatnonzero(np.concatenate(([True], apart)))
        tails = np.concatenate((heads[1:], [len(low)])) - 1
        values, held = windows(hashes, words.counts, SHINGLE)
        base = np.cumsum(held) - held
        for a, b in zip(heads.tolist(), tails.tolist()):
            t, i = int(text[a]), int(item[a])
            first = max(0, int(low[a] - pad[a]))
            stop = min(int(held[t]), int(low[b] + self.lengths[i] + pad[b]) - SHINGLE + 1)
            near, at = self.best_window(i, values[base[t] + first : base[t] + stop], threshold)
            if near > best.get((t, i), (0.0, 0))[0] + 1e-12:
                best[t, i] = (near, first + at)
        return best


def _filed(benchmark: DataFrame, item_column: str, text_column: str) -> tuple[str, int, pa.DataType]:
    """Write the items in blocks, each with the shingles it shares with other items; the folder, the blocks, and the type of the ids."""
    named = benchmark.select(F.col(item_column).alias("item"), F.col(text_column).cast("string").alias("text"))
    items = written(named.filter(F.col("text").isNotNull()).withColumn("row", F.monotonically_increasing_id()), "items")
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = Words(*text_bytes(batch.column("text")), lower=True)
            own = [np.unique(v) for v in _split(*windows(words.hashes(), words.counts, SHINGLE))]
            rows = np.repeat(batch.column("row").to_numpy(), [len(v) for v in own])
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.concatenate(own).view(np.int64))], ["row", "shingle"])

    held = items.select("row", "text").mapInArrow(shingled, "row long, shingle long")
    shared = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    of_item = held.join(shared, "shingle").groupBy("row").agg(F.collect_list(F.struct("shingle", "holders")).alias("shared"))
    folder = shared_folder(benchmark.sparkSession, "blocks")
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")
    items.join(of_item, "row", "left").select("item", "text", "shared", block).repartition("block").write.partitionBy("block").parquet(folder)
    return folder, blocks, named.select("item").limit(0).toArrow().schema.field(0).type


@lru_cache(maxsize=1)
def _block_items(folder: str, number: int, kind: pa.DataType, radius: int) -> Items:
    """The items of one block; a worker keeps the last block it read."""
    rows = block_rows(folder, number, ["item", "text", "shared"])
    if rows is None:
        return Items(pa.array([], kind), [], radius, [])
    holders = []
    for shared in rows.column("shared").to_pylist():
        keys = np.array([s["shingle"] for s in shared or []], np.int64).view(np.uint64)
        order = np.argsort(keys)
        holders.append((keys[order], np.array([s["holders"] for s in shared or []], np.int64)[order]))
    ids = rows.column("item").cast(kind).combine_chunks()
    return Items(ids, rows.column("text").to_pylist(), radius, holders)


def _gathered(batches: Iterator[pa.RecordBatch], column: str, blocks: int) -> Iterator[list[pa.RecordBatch]]:
    """Chunks of texts; several at once if there are several blocks to go through."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in chunks(batches, column):
        held.append(batch)
        size += len(text_bytes(batch.column(column))[0])
        if blocks == 1 or size >= HELD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    threshold: float = 0.8,
    radius: int = RADIUS,
) -> DataFrame:
    """``(id, item, similarity, first_word)``: the best window of each text and item that reach the threshold.

    Words are ``[^\\x20\\x09-\\x0D]+`` in lower case (A-Z); shingles have five of them and count as often as they occur. A
    shingle of the item weighs one over the number of items of the benchmark that hold it, others weigh one. Windows of
    every length are compared. Null and empty texts and items, and items of fewer than five words, match nothing. Rows or items
    that repeat an id give one row with the best window; of equal windows the first. Null ids are ids, of any type. An
    empty table on either side gives no rows; other columns are not looked at. A very long text is held whole by one task.
    """
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind, item_kind = texts.schema["id"].dataType.simpleString(), benchmark.schema[item_column].dataType.simpleString()
    folder, blocks, item_type = _filed(benchmark, item_column, item_text_column)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches, "text", blocks):
            for number in range(blocks):
                items = _block_items(folder, number, item_type, radius)
                for batch in held:
                    rows = sorted(items.search(batch.column("text"), threshold).items())
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("id").take(pa.array([t for (t, _), _ in rows], pa.int64())),
                            items.ids.take(pa.array([i for (_, i), _ in rows], pa.int64())),
                            pa.array([s for _, (s, _) in rows], pa.float64()),
                            pa.array([w for _, (_, w) in rows], pa.int64()),
                        ],
                        ["id", "item", "similarity", "first_word"],
                    )

    found = texts.mapInArrow(look, f"id {kind}, item {item_kind}, similarity double, first_word long")
    best = found.groupBy("id", "item").agg(F.max(F.struct("similarity", (-F.col("first_word")).alias("back"))).alias("b"))
    return best.select(F.col("id").alias(id_column), F.col("item").alias(item_column), "b.similarity", (-F.col("b.back")).alias("first_word"))


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", threshold: float = 0.8, radius: int = RADIUS, **columns: str) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns; nothing is shuffled."""
    folder, blocks, item_type = _filed(benchmark, columns.get("item_column", "item_id"), columns.get("item_text_column", "text"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches, text_column, blocks):
            clean = [np.ones(batch.num_rows, bool) for batch in held]
            for number in range(blocks):
                items = _block_items(folder, number, item_type, radius)
                for batch, own in zip(held, clean):
                    own[[t for t, _ in items.search(batch.column(text_column), threshold)]] = False
            for batch, own in zip(held, clean):
                yield batch.filter(pa.array(own))

    return docs.mapInArrow(keep, docs.schema)


@query("op10_benchmark_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
