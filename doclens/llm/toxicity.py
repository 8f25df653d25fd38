"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled texts train a linear classifier in numpy. Unlabelled texts stand for both
classes, so the risk of the negatives is what they have beyond the class prior's share of positives:
``prior * R(P, +) + max(0, R(U, -) - prior * R(P, -))``. Where the second part falls below zero,
its gradient is climbed instead of descended, which stops the classifier from learning the positives by heart.

Features are hashed words and their first letters. Spark counts in how many of all texts, and in how many of all toxic
ones, each occurs and keeps the most telling ones, so only their few places per text of the training sample reach the
driver. The cut between the classes is placed on a histogram of the scores of all reviewed texts. Scoring is one narrow
pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.base import bitmap, query, table
from doclens.llm.words import PUNCTUATION, Words, chunks, mix, text_bytes
from doclens.session import DEFAULT_SEED, written

FEATURE_BITS = 20
PREFIXES = (4, 5, 6)  # bytes
MAX_POSITIVE = 20_000  # rows of the sample that the gradient steps see; everything else covers all rows
MAX_UNLABELLED = 20_000
CUT_STEP = 0.01  # width of the bins of scores, in logits
MAX_FEATURES = 1000
LEAST_G = 20.0  # G statistic that a feature needs: chance alone gives one in a hundred thousand

_U = np.uint64


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, feature)`` of all words and prefixes of some texts, with repeats."""
    data, offsets = text_bytes(column)
    words = Words(data, offsets, lower=True, between=PUNCTUATION)
    owner = words.text_of_word()
    lengths = words.ends - words.starts
    owners, found = [owner], [words.hashes()]
    for k in PREFIXES:
        long = np.flatnonzero(lengths > k)
        value = np.zeros(len(long), np.uint64)
        for j in range(k):
            value = value * _U(0x9E3779B97F4A7C15) + mix(words.data[words.starts[long] + j].astype(np.uint64) + _U(1 + 256 * k))
        owners.append(owner[long])
        found.append(mix(value))
    place = np.concatenate(found) >> _U(64 - FEATURE_BITS)
    return np.concatenate(owners), place.astype(np.int64)


def _distinct(column: pa.Array, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``(text number, feature)``; with ``among``, features become their numbers there, -1 being left out."""
    owner, place = _features(column)
    if among is not None:
        place = among[place]
        owner, place = owner[place >= 0], place[place >= 0]
    pairs = np.unique(owner << FEATURE_BITS | place)
    return pairs >> FEATURE_BITS, pairs & ((1 << FEATURE_BITS) - 1)


@dataclass
class Model:
    """Numbers of the chosen features, their weights, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        among = np.full(1 << FEATURE_BITS, -1, np.int64)
        among[self.features] = np.arange(len(self.features))
        return among

    def logits(self, column: pa.Array, among: np.ndarray) -> np.ndarray:
        owner, place = _distinct(column, among)
        return np.bincount(owner, self.weights[place], len(column)) + self.bias if len(place) else np.full(len(column), self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Rows:
    """Sparse binary rows."""

    def __init__(self, rows: list[np.ndarray]):
        self.rows = rows

    def take(self, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = [self.rows[i] for i in picked]
        sizes = np.array([len(r) for r in rows], np.int64)
        return (np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)), sizes


def risk_slope(theta: np.ndarray, positive: tuple[np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray], prior: float) -> np.ndarray:
    """Gradient of the non-negative risk; where the part of the negatives is below zero, the way that raises it.

    Rows are ``(places, places per row)``; the last entry of ``theta`` is the bias.
    """
    (pc, pn), (uc, un) = positive, unlabelled
    p_own, u_own = np.repeat(np.arange(len(pn)), pn), np.repeat(np.arange(len(un)), un)
    p = _sigmoid(np.bincount(p_own, theta[pc], len(pn)) + theta[-1])
    u = _sigmoid(np.bincount(u_own, theta[uc], len(un)) + theta[-1])
    as_negative = -np.log(1 - u + 1e-9).mean() + prior * np.log(1 - p + 1e-9).mean()
    p_slope, u_slope = -prior * p / len(p), u / len(u)
    if as_negative >= 0:
        p_slope = p_slope + prior * (p - 1) / len(p)
    else:
        p_slope, u_slope = -p_slope, -u_slope
    slope = np.bincount(pc, p_slope[p_own], len(theta)) + np.bincount(uc, u_slope[u_own], len(theta))
    slope[-1] = p_slope.sum() + u_slope.sum()
    return slope


def fit_nnpu(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], n_features: int, prior: float,
    epochs: int = 60, rate: float = 0.05, decay: float = 1e-4, batches: int = 5, seed: int = DEFAULT_SEED,
) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk under the logistic loss, by Adam on mini-batches."""
    rng = np.random.default_rng(seed)
    theta = np.zeros(n_features + 1)
    theta[-1] = np.log(prior / (1 - prior))
    if not positive or not unlabelled:
        return theta[:-1], float(theta[-1])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    p_rows, u_rows, step = _Rows(positive), _Rows(unlabelled), 0
    batches = max(1, min(batches, len(positive), len(unlabelled)))
    for _ in range(epochs):
        p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for k in range(batches):
            slope = risk_slope(theta, p_rows.take(p_order[k::batches]), u_rows.take(u_order[k::batches]), prior)
            slope[:-1] += decay * theta[:-1]
            step += 1
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _threshold(z: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The cut with the fewest errors among scores ``z``, which rise and have so many rows each: the middle of the widest such stretch."""
    # cutting above the i lowest scores misses the toxic rows among them and takes the clean ones above them
    errors = clean.sum() + np.concatenate(([0], np.cumsum(toxic - clean)))
    edges = np.concatenate(([z[0] - 1.0], z, [z[-1] + 1.0]))
    width = np.where(errors == errors.min(), edges[1:] - edges[:-1], -1.0)
    at = int(np.argmax(width))
    return float((edges[at] + edges[at + 1]) / 2)


def fold(id_column: Column) -> Column:
    """The held-out fold is 0; a null id counts as the text of no characters."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % 5


def frequencies(texts: DataFrame) -> DataFrame:
    """``(place, n)``: in how many texts each feature occurs, added up in the tasks first; place -1 has the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(1 << FEATURE_BITS, np.int64), 0
        for batch in chunks(batches, "text"):
            rows += batch.num_rows
            held += np.bincount(_distinct(batch.column("text"))[1], minlength=len(held))
        places = np.flatnonzero(held)
        places, n = np.append(places, -1), np.append(held[places], rows)
        for at in range(0, len(places), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(places[at : at + 100_000]), pa.array(n[at : at + 100_000])], ["place", "n"])

    return texts.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))


def _among(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose id may be among ``ids``, and all of those that are: what a join needn't shuffle goes."""
    wanted = bitmap(ids.select(F.xxhash64("id").alias("key")), "key")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.has(batch.column("key").to_numpy()))).select(["id", "text"])

    return texts.withColumn("key", F.xxhash64("id")).mapInArrow(keep, texts.schema)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
    max_features: int = MAX_FEATURES,
    seed: int = DEFAULT_SEED,
) -> Model:
    """Train on at most ``max_positive`` toxic and ``max_unlabelled`` other texts outside the held-out fold, first in hash order.

    The class prior is the toxic share of the labelled rows outside that fold. Features are chosen by their counts over all texts
    and all toxic texts outside it. Reviewed texts, all of them, place the cut between the classes; those without toxicity teach the
    weights nothing. A text with several labels is toxic if one says so; null labels and labels without a text
    teach nothing. Without toxic rows every text gets the prior. A very long text is held whole by one task.
    """
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string")))
    kind = docs.schema[id_column].dataType.simpleString()
    known = (
        labels.select(F.col(id_column).cast(kind).alias("id"), F.col(label_column).cast("int").alias("y"))
        .filter(F.col("y").isNotNull() & F.col("id").isNotNull() & (fold(F.col("id")) != 0))
        .groupBy("id").agg(F.max("y").alias("y"))
    )
    counts = known.agg(F.count(F.when(F.col("y") == 1, 1)).alias("p"), F.count(F.lit(1)).alias("n")).first()
    prior = min(0.5, max(0.001, counts["p"] / counts["n"])) if counts["n"] else 0.001
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    texts = texts.filter(F.col("id").isNotNull() & (fold(F.col("id")) != 0))
    toxic = known.filter("y = 1").select("id")
    # at most max_positive + max_unlabelled ids
    first = lambda ids, n, k: ids.select("id", h.alias("h")).orderBy("h").limit(n).select("id", F.lit(k).alias("kind"))
    chosen = written(first(toxic, max_positive, 1).unionAll(first(texts, max_unlabelled, 0)), "sample")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            owner, place = _distinct(batch.column("text"))
            stops = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(place, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("kind"), lists], ["id", "kind", "places"])

    sample = written(
        texts.join(F.broadcast(chosen), "id").select("id", "kind", "text").mapInArrow(places, f"id {kind}, kind int, places array<int>"), "features"
    )
    of_toxic = frequencies(_among(texts, toxic).join(toxic, "id")).withColumnRenamed("n", "p")
    counted = written(frequencies(texts).withColumnRenamed("n", "u").join(of_toxic, "place"), "frequencies")
    sizes = counted.filter("place = -1").first()
    n_p, n_u = (sizes["p"], sizes["u"]) if sizes else (0, 0)
    if not n_p:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    least = max(1, min(5, n_p // 3))
    a, b = (F.col("p") + 0.5) / (n_p + 1), (F.col("u") + 0.5) / (n_u + 1)
    telling = a * F.log(a / b) + (1 - a) * F.log((1 - a) / (1 - b))
    best = (
        counted.filter((F.col("place") >= 0) & (F.col("p") >= least) & (telling * (2 * n_p) >= LEAST_G))
        .orderBy(telling.desc(), "place").limit(max_features).select("place").toArrow()
    )
    features = np.sort(best.column("place").to_numpy().astype(np.int64))
    if not len(features):
        return Model(features, np.zeros(0), float(np.log(prior / (1 - prior))))
    number = np.full(1 << FEATURE_BITS, -1, np.int32)
    number[features] = np.arange(len(features))

    def chosen_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for row in batch.column("places"):
                own = number[row.values.to_numpy(zero_copy_only=False)]
                kept.append(own[own >= 0])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("kind"), pa.array(kept, pa.list_(pa.int32()))], ["id", "kind", "places"])

    # bounded: sample rows times chosen features
    rows = sample.mapInArrow(chosen_places, f"id {kind}, kind int, places array<int>").orderBy("kind", h).toArrow()
    lists = [np.asarray(x, np.int64) for x in rows.column("places").to_pylist()]
    kinds = rows.column("kind").to_numpy()
    positive, unlabelled = [lists[i] for i in np.flatnonzero(kinds == 1)], [lists[i] for i in np.flatnonzero(kinds == 0)]
    weights, bias = fit_nnpu(positive, unlabelled, len(features), prior, seed=seed)
    model = Model(features, weights, 0.0)
    among = model.table()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.clip(model.logits(batch.column("text"), among), -30, 30))], ["id", "z"])

    judged = _among(texts, known).mapInArrow(judge, f"id {kind}, z double").join(known, "id")
    bins = judged.groupBy(F.floor(F.col("z") / CUT_STEP).alias("bin")).agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    cells = bins.orderBy("bin").toArrow()  # as many as the logits' range has bins
    z, toxic_rows, clean_rows = (cells.column(c).to_numpy() for c in ("bin", "toxic", "clean"))
    if not clean_rows.sum():
        return Model(features, weights, bias)
    return Model(features, weights, -_threshold((z + 0.5) * CUT_STEP, toxic_rows, clean_rows))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)`` per row: whole texts, nothing but the text enters the score.

    Null and empty texts have the score of a text without any telling word. Equal texts score equal; an empty
    table gives no rows; other columns are not looked at. A very long text is held whole by one task.
    """
    among = model.table()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_sigmoid(model.logits(batch.column("text"), among)))], ["id", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    scored = texts.mapInArrow(judge, f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_column), (fold(F.col("id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
