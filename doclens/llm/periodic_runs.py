"""Periodic runs by recursive frequency splitting.

A run is a stretch of consecutive words with smallest period ``q``, at least ``max(12, 2 * q)`` words long, that no
neighbouring word extends. Each of its words stands in it at least twice, ``q`` words apart, and ``q`` is at most half of
any segment around it. So a word without an equal one within half of its segment belongs to no run and splits the
segment; the parts are split again, by what is rare within them, until nothing changes. In ordinary prose nothing is left.

The segments that are left are scanned lag by lag. The places at which words ``q`` apart agree form a stretch of at least
``max(q, 12 - q)`` places in a run of period ``q``, so one of that many places is looked at: ``n * log(n)`` of them for
all lags. Where the words agree, the stretch is measured both ways on ranks of all blocks of 1, 2, 4 ... words. The
comparisons are exact but for 64-bit fingerprints that stand for the words.

Everything happens within a text: no shuffle, and a text that is one long run costs no more than ``n * log(n) ** 2``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclens.llm.base import query, table
from doclens.llm.words import Words, chunks, text_bytes

LEAST_LENGTH = 12  # words of a run
_SLAB = 1 << 20  # places looked at together


def segments(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, stops)`` of the stretches that hold all runs of the texts ``words[bounds[i]:bounds[i + 1]]``."""
    starts, stops = bounds[:-1], bounds[1:]
    kinds = int(words.max()) + 1 if len(words) else 1
    settled: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        long = stops - starts >= LEAST_LENGTH
        starts, stops = starts[long], stops[long]
        if not len(starts):
            break
        lengths = stops - starts
        number = np.repeat(np.arange(len(starts)), lengths)
        place = np.arange(len(number)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        key = number * kinds + words[place]
        order = np.argsort(key, kind="stable")
        far = np.iinfo(np.int64).max
        gaps = np.where(key[order[1:]] == key[order[:-1]], place[order[1:]] - place[order[:-1]], far)
        nearest = np.empty(len(order), np.int64)
        nearest[order] = np.minimum(np.append(gaps, far), np.insert(gaps, 0, far))
        kept = nearest <= (lengths // 2)[number]
        whole = np.logical_and.reduceat(kept, np.cumsum(lengths) - lengths)
        settled.append((starts[whole], stops[whole]))
        kept &= ~whole[number]
        # neighbours in a segment that both stay go on together
        joined = kept[1:] & kept[:-1] & (number[1:] == number[:-1])
        starts = place[kept & ~np.insert(joined, 0, False)]
        stops = place[kept & ~np.append(joined, False)] + 1
    if not settled:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, stops = (np.concatenate(x) for x in zip(*settled))
    order = np.argsort(starts)
    return starts[order], stops[order]


def _ranks(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """For 1, 2, 4 ... words: a number per place, equal where the blocks that begin there are equal."""
    levels, size = [words.astype(np.int32)], 1
    while 2 * size <= longest:
        last = levels[-1].astype(np.int64)
        if len(last) <= size:
            break
        pairs = last[:-size] * (int(last.max()) + 1) + last[size:]
        kinds, ranks = np.unique(pairs, return_inverse=True)
        if len(kinds) == len(pairs):
            break  # no block of this size occurs twice
        levels.append(ranks.astype(np.int32))
        size *= 2
    return levels


def _agreeing(levels: list[np.ndarray], one: np.ndarray, two: np.ndarray, back: bool) -> np.ndarray:
    """How many words from the places ``one`` and ``two`` (larger) on are equal; ``back``: how many before them."""
    agreed = np.zeros(len(one), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ranks, size = levels[level], 1 << level
        x, y = (one - agreed - size, two - agreed - size) if back else (one + agreed, two + agreed)
        inside = np.flatnonzero((x >= 0) & (y < len(ranks)))
        same = inside[ranks[x[inside]] == ranks[y[inside]]]
        agreed[same] += size
    return agreed


def runs_in(words: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Rows ``(start, length, period)`` of all runs in the given segments, by start and period."""
    lengths = stops - starts
    if not len(lengths):
        return np.zeros((0, 3), np.int64)
    # the segments one after the other, with a word of its own behind each
    first = np.cumsum(lengths + 1) - lengths - 1
    number = np.repeat(np.arange(len(lengths)), lengths + 1)
    within = np.arange(len(number)) - first[number]
    ends = within == lengths[number]
    joined = words[np.minimum(starts[number] + within, len(words) - 1)]
    joined[ends] = int(words.max()) + 1 + np.arange(len(lengths))
    joined = np.unique(joined, return_inverse=True)[1]
    levels = _ranks(joined, int(lengths.max()))
    # all lags of all segments, and the places to look at for each
    halves = lengths // 2
    segment = np.repeat(np.arange(len(lengths)), halves)
    lag = np.arange(len(segment)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    stride = np.maximum(lag, LEAST_LENGTH - lag)
    places = -(-(lengths[segment] - lag) // stride)
    upto = np.cumsum(places)
    found, begin = [], 0
    while begin < len(lag):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + _SLAB, "right")))
        own = np.repeat(np.arange(begin, end), places[begin:end])
        step = np.arange(len(own)) - np.repeat(np.cumsum(places[begin:end]) - places[begin:end], places[begin:end])
        one = first[segment[own]] + step * stride[own]
        same = joined[one] == joined[one + lag[own]]
        one, own = one[same], own[same]
        before = _agreeing(levels, one, one + lag[own], True)
        agreed = before + _agreeing(levels, one, one + lag[own], False)
        enough = agreed >= stride[own]
        at, own = (one - before)[enough], own[enough]
        found.append(np.unique(np.stack([at, agreed[enough] + lag[own], lag[own]], 1), axis=0))
        begin = end
    rows = np.unique(np.concatenate(found), axis=0)
    # a stretch that is found at several lags has the first as its smallest period, the others are multiples
    rows = rows[np.insert((rows[1:, :2] != rows[:-1, :2]).any(1), 0, True)] if len(rows) else rows
    rows[:, 0] += (starts - first)[number[rows[:, 0]]]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _collapsed(words: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of the texts' kept words, joined by one space each."""
    lengths = words.ends - words.starts
    inside = np.zeros(len(words.data) + 1, bool)
    places = np.repeat(words.starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    inside[places] = np.repeat(kept, lengths)
    text = words.text_of_word()
    own = np.flatnonzero(kept)
    followed = own[:-1][text[own[1:]] == text[own[:-1]]]  # the byte after such a word is a separator
    data = np.append(words.data, np.uint8(0x20))
    data[words.ends[followed]] = 0x20
    inside[words.ends[followed]] = True
    return data[inside], np.concatenate(([0], np.cumsum(inside)))[words.offsets]


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers).cast(pa.string())


def collapse_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_words, runs, collapsed)`` per row of ``docs``.

    ``runs`` holds ``(start, length, period)`` in words, by start and period; runs may overlap. ``collapsed`` joins by one
    space the words that no run contains after its first period. Null, empty and wordless texts have no words, no runs
    and an empty ``collapsed``; a text of fewer than 12 words has no runs. Repeated rows and null ids are rows like others,
    an empty table gives no rows, other columns are not looked at. A text is held whole by one task,
    at some 60 bytes of memory per byte, and four more per doubling for the words of segments that are left.
    """
    rows = docs.select(F.col(id_column).alias(id_column), F.col(text_column).cast("string").alias("_text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            words = Words(*text_bytes(batch.column("_text")))
            numbers = np.unique(words.hashes(), return_inverse=True)[1]
            bounds = words.first
            rows = runs_in(numbers, *segments(numbers, bounds))
            text = np.searchsorted(bounds, rows[:, 0], "right") - 1
            # a word is dropped between a run's first period and its end
            change = np.zeros(len(numbers) + 1, np.int64)
            np.add.at(change, rows[:, 0] + rows[:, 2], 1)
            np.add.at(change, rows[:, 0] + rows[:, 1], -1)
            kept = np.cumsum(change)[:-1] == 0
            found = pa.StructArray.from_arrays(
                [pa.array(rows[:, 0] - bounds[text]), pa.array(rows[:, 1]), pa.array(rows[:, 2])], ["start", "length", "period"]
            )
            offsets = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), found), _strings(*_collapsed(words, kept))],
                [id_column, "n_words", "runs", "collapsed"],
            )

    run = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
    schema = T.StructType(
        [rows.schema[0], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())]
    )
    return rows.mapInArrow(scan, schema)


# --- the query ---------------------------------------------------------------------
def with_planted_tails(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """The text; of ids whose checksum ends in 0, the words from some place on repeat those of one period."""
    check = F.crc32(F.col(id_column).cast("string").cast("binary"))
    g = F.floor(check / 10)
    words = F.filter(F.split(F.col(text_column), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    n = F.size(words)
    a = F.when(n > 0, g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    period = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return F.when((check % 10 == 0) & (n > 0), planted).otherwise(F.col(text_column))


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII string, in DuckDB."""
    bit = "lambda x, y: xor(x >> 1, (x & 1) * 3988292384)"
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)), "
        f"lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], {bit})), 4294967295)"
    )


_SQL = f"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS d, {_crc32("CAST(doc_id AS VARCHAR)")} AS h,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS own
  FROM documents),
tails AS (SELECT *, len(own) AS n, CASE WHEN h % 10 = 0 AND len(own) > 0 THEN (h // 10) % len(own) ELSE len(own) END AS a FROM split),
period AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM tails),
words AS (
  SELECT doc_id, d, n, unnest(range(n)) AS i, a, p, own FROM period),
placed AS (SELECT d, n, i, own[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS word FROM words),
agree AS (
  SELECT x.d, y.i - x.i AS q, x.i FROM placed x JOIN placed y ON x.d = y.d AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
islands AS (SELECT d, q, i, i - row_number() OVER (PARTITION BY d, q ORDER BY i) AS island FROM agree),
stretches AS (
  SELECT d, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY d, q, island HAVING count(*) >= greatest(q, 12 - q)),
runs AS (SELECT d, start, length, min(q) AS period FROM stretches GROUP BY d, start, length),
listed AS (
  SELECT d, count(*) AS n_runs, min(struct_pack(l := -length, s := start, p := period)) AS longest,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY d),
dropped AS (SELECT DISTINCT r.d, unnest(range(start + period, start + length)) AS i FROM runs r),
kept AS (
  SELECT p.d, string_agg(word, ' ' ORDER BY p.i) AS collapsed FROM placed p ANTI JOIN dropped x ON p.d = x.d AND p.i = x.i GROUP BY p.d)
SELECT s.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(longest.s AS BIGINT) AS start, CAST(-longest.l AS BIGINT) AS length,
       CAST(longest.p AS BIGINT) AS period, CAST(1000 * -longest.l // longest.p AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM split s LEFT JOIN listed l ON s.d = l.d LEFT JOIN kept k ON s.d = k.d
"""


@query("op11_periodic_runs", _SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_planted_tails().alias("text"))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return (
        collapse_runs(docs)
        .withColumn("longest", longest)
        .select(
            "doc_id", F.size("runs").cast("long").alias("n_runs"),
            F.col("longest.s").alias("start"), (-F.col("longest.l")).alias("length"), F.col("longest.p").alias("period"),
            F.floor(-1000 * F.col("longest.l") / F.col("longest.p")).alias("exponent_milli"),
            F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )
