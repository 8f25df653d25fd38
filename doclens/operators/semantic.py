"""Document embeddings learned from the corpus: the leading right singular vectors of its TF-IDF matrix.

Randomized subspace iteration (Halko, Martinsson and Tropp 2011). The matrix stays a table of sparse rows. A round
is one pass: every task multiplies its rows with the present basis and with that product once more, block of rows
by block of rows, so it holds one matrix of terms by dimensions however many rows it has; those are summed by
blocks of terms across the tasks. Only the sum reaches the driver, where a basis of terms by dimensions, both
bounded by parameters, is made orthogonal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclens import lexicon as lx
from doclens.operators import vectors
from doclens.session import DEFAULT_SEED, written

ROWS = 256  # documents that a task multiplies at once
TERMS = 64  # terms of a block of the sums


def _sparse_rows(model: vectors.TfidfModel, df: DataFrame, text_column: str) -> DataFrame:
    return model.transform(df, text_column, "_tfidf").withColumn("_tfidf", F.unwrap_udt("_tfidf"))


def _blocks(lists: pa.StructArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from, to, terms, weights)``: a few rows as a dense matrix over the terms that they have."""
    indices, weights = lists.field("indices"), lists.field("values")
    sizes = indices.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    all_terms = indices.flatten().to_numpy(zero_copy_only=False)
    all_weights = weights.flatten().to_numpy(zero_copy_only=False)
    for at in range(0, len(sizes), ROWS):
        to = min(at + ROWS, len(sizes))
        own = slice(int(ends[at] - sizes[at]), int(ends[to - 1]))
        terms, place = np.unique(all_terms[own], return_inverse=True)
        dense = np.zeros((to - at, len(terms)))
        dense[np.repeat(np.arange(to - at), sizes[at:to]), place] = all_weights[own]
        yield at, to, terms, dense


def _gram_times(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """The transposed matrix times the matrix times the basis, in one job."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(basis)  # terms x dimensions, both bounded by parameters

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(shared.value)
        for batch in batches:
            for _, _, terms, dense in _blocks(batch.column("_tfidf")):
                total[terms] += dense.T @ (dense @ shared.value[terms])
        for at in range(0, len(total), TERMS):
            part = total[at : at + TERMS]
            if part.any():
                yield _part(at // TERMS, part)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sent in zip(batch.column("block").to_pylist(), batch.column("sums")):
                part = np.frombuffer(sent.as_buffer(), np.float64)
                sums[block] = sums[block] + part if block in sums else part.copy()
        for block, part in sums.items():
            yield _part(block, part)

    # one sum a task: as many tasks as run at once, each over many files
    parts = rows.select("_tfidf").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(multiply, "block int, sums binary")
    found = parts.repartition("block").mapInArrow(add, "block int, sums binary").toArrow()
    out = np.zeros_like(basis)
    for block, sent in zip(found.column("block").to_pylist(), found.column("sums")):
        part = np.frombuffer(sent.as_buffer(), np.float64).reshape(-1, basis.shape[1])
        out[block * TERMS : block * TERMS + len(part)] = part
    shared.unpersist()
    return out


def _part(block: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["block", "sums"])


@dataclass
class SemanticModel:
    """The TF-IDF model, the basis (terms x dimensions), its singular values, and the largest residual of the fit."""

    tfidf: vectors.TfidfModel
    basis: np.ndarray
    singular: np.ndarray
    residual: float = 0.0

    def transform(self, df: DataFrame, text_column: str = "resume_text", output: str = "embedding", cosine: str | None = None, to: dict[int, float] | None = None) -> DataFrame:
        """Add the unit-length ``array<float>`` embedding; zeros for a text that has no term. Narrow: one pass.

        ``cosine`` names one more column: the cosine of the text's TF-IDF vector with the unit vector ``to`` (weights by terms'
        positions): the part that lies inside the basis, from the dimensions of both, and the part outside.
        """
        names = [c for c in df.columns if c not in (output, cosine)]
        if not self.tfidf.terms:
            empty = [F.lit(0.0).alias(cosine)] if cosine else []
            return df.select(*names, F.array_repeat(F.lit(0.0).cast("float"), self.basis.shape[1]).alias(output), *empty)
        other = np.zeros(len(self.basis))
        for position, weight in (to or {}).items():
            other[position] = weight
        inside = other @ self.basis
        shared = df.sparkSession.sparkContext.broadcast((self.basis, inside, other - self.basis @ inside))

        def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            basis, inside, outside = shared.value
            for batch in batches:
                for at, to, terms, dense in _blocks(batch.column("_tfidf")):
                    found = dense @ basis[terms]
                    norms = np.linalg.norm(found, axis=1, keepdims=True)
                    unit = (found / np.where(norms == 0, 1.0, norms)).astype(np.float32)
                    offsets = pa.array(np.arange(to - at + 1, dtype=np.int32) * basis.shape[1])
                    part = batch.slice(at, to - at)
                    columns = [*(part.column(c) for c in names), pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))]
                    if cosine:
                        columns.append(pa.array(found @ inside + dense @ outside[terms]))
                    yield pa.RecordBatch.from_arrays(columns, [*names, output, *([cosine] if cosine else [])])

        kept = _sparse_rows(self.tfidf, df, text_column).select(*names, "_tfidf")
        added = [T.StructField(output, T.ArrayType(T.FloatType())), *([T.StructField(cosine, T.DoubleType())] if cosine else [])]
        return kept.mapInArrow(embed, T.StructType([*df.select(*names).schema.fields, *added]))

    def save(self, spark: SparkSession, path: str) -> str:
        words, dims = self.tfidf.stop_words, self.basis.shape[1]
        rows = [(i, t, w, v.tolist()) for i, (t, w, v) in enumerate(zip(self.tfidf.terms, self.tfidf.idf, self.basis))]
        schema = "position int, term string, idf double, vector array<double>"
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/terms")
        facts = [(self.singular.tolist(), self.residual, words, dims)]
        schema = "singular array<double>, residual double, stop_words array<string>, dims int"
        spark.createDataFrame(facts, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/fit")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> SemanticModel:
        rows = spark.read.parquet(f"{path}/terms").orderBy("position").collect()
        fit = spark.read.parquet(f"{path}/fit").first()
        model = vectors.TfidfModel([r["term"] for r in rows], [r["idf"] for r in rows], fit["stop_words"])
        basis = np.array([r["vector"] for r in rows], float).reshape(len(rows), fit["dims"])
        return SemanticModel(model, basis, np.array(fit["singular"], float), fit["residual"])


def fit_semantic(
    df: DataFrame,
    text_column: str = "resume_text",
    dims: int = lx.EMBEDDING_DIM,
    spare: int = 10,
    rounds: int = 4,
    tolerance: float = 1e-9,
    seed: int = DEFAULT_SEED,
    **tfidf,
) -> SemanticModel:
    """Learn ``dims`` dimensions from all rows of ``df``; ``tfidf`` are the arguments of :func:`vectors.fit_tfidf`.

    The basis starts at random with ``spare`` more columns. It is settled when, for every kept dimension, the part of its
    image outside itself is at most ``tolerance`` of the largest squared singular value; after ``rounds`` passes it is
    taken as it is, and ``residual`` tells how far it came. Fewer terms or rows than dimensions leave the rest zero;
    a table without terms gives zeros only. A direction's largest entry is positive, so reruns agree but for rounding.
    """
    model = vectors.fit_tfidf(df, text_column, **tfidf)
    terms = len(model.terms)
    basis, singular, residual = np.zeros((terms, dims)), np.zeros(dims), 0.0
    if not terms:
        return SemanticModel(model, basis, singular)
    rows = written(_sparse_rows(model, df.select(text_column), text_column).select("_tfidf"), "tfidf")
    kept = min(dims, terms)
    trial = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, min(terms, dims + spare))))[0]
    for _ in range(max(1, rounds)):
        image = _gram_times(rows, trial)
        values, turn = np.linalg.eigh(trial.T @ image)
        order = np.argsort(values)[::-1][:kept]
        ritz, lengths = (trial @ turn)[:, order], np.maximum(values[order], 0)
        apart = np.linalg.norm(image @ turn[:, order] - ritz * lengths, axis=0)
        residual = float(apart.max() / max(lengths[0], 1e-300)) if lengths[0] else 0.0
        if residual <= tolerance:
            break
        trial = np.linalg.qr(image)[0]
    real = lengths > 1e-12 * max(lengths[0], 1e-300)
    sign = np.sign(ritz[np.abs(ritz).argmax(axis=0), np.arange(kept)])
    basis[:, :kept] = ritz * np.where(real, np.where(sign == 0, 1.0, sign), 0.0)
    singular[:kept] = np.sqrt(lengths) * real
    return SemanticModel(model, basis, singular, residual)
