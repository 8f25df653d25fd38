"""Document vectors: the default hashed encoder, pluggable encoders, TF-IDF, scaling, assembly."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclens import lexicon as lx
from doclens.batches import slices
from doclens.functions import features as ft
from doclens.functions import text as tx
from doclens.operators.numbering import number_rows
from doclens.session import small_table, written

_FEW_TERMS = 1000  # a vocabulary of at most so many terms has its tokens counted before its bigrams

# -- default encoder -----------------------------------------------------------------


def token_buckets(text: Column | str, dim: int = lx.EMBEDDING_DIM) -> Column:
    """Bucket number (as a string) of every token: the first 28 bits of its MD5, modulo ``dim``."""
    return F.transform(
        tx.encoder_tokens(text),
        lambda t: F.pmod(F.conv(F.left(F.md5(t), F.lit(7)), 16, 10).cast("int"), F.lit(dim)).cast("string"),
    )


def count_buckets(df: DataFrame, text_column: str, output: str, dim: int = lx.EMBEDDING_DIM) -> DataFrame:
    """Add a sparse ML vector with the token count of every bucket. Narrow: one pass, no shuffle."""
    counter = CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(dim)], inputCol="_buckets", outputCol=output
    )
    return counter.transform(df.withColumn("_buckets", token_buckets(text_column, dim))).drop("_buckets")


_TOKENS_AT_ONCE = 1 << 17
_LEAST_TOKENS = 64  # what a row counts at least, so that few rows' vectors are held at once
_KNOWN_TOKENS = 200_000


class _Buckets:
    """``token_buckets`` inside a task; a token is hashed when it is met first."""

    def __init__(self, dim: int):
        self.dim, self.known = dim, {}

    def of(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > _KNOWN_TOKENS:
            self.known.clear()
        for t in tokens:
            if t not in self.known:
                self.known[t] = int(hashlib.md5(t.encode()).hexdigest()[:7], 16) % self.dim
        return np.array([self.known[t] for t in tokens], np.int64)

    def unit_vectors(self, lists: pa.Array) -> np.ndarray:
        encoded = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        place = row * self.dim + self.of(encoded.dictionary.to_pylist())[encoded.indices.to_numpy()]
        counts = np.bincount(place, minlength=len(lists) * self.dim).reshape(len(lists), self.dim)
        return (counts / np.sqrt((counts * counts).sum(axis=1))[:, None]).astype(np.float32)


def _with_hashed(df: DataFrame, text: Column, output: str, dim: int) -> DataFrame:
    """Add the unit-length counts of ``token_buckets``; the tokens are hashed and counted by whole batches."""
    names = [c for c in df.columns if c != output]

    def sizes(batch: pa.RecordBatch) -> np.ndarray:
        return np.maximum(pc.list_value_length(batch.column(len(names))).to_numpy(zero_copy_only=False), _LEAST_TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(dim)
        for part in slices(batches, sizes, _TOKENS_AT_ONCE):
            unit = buckets.unit_vectors(part.column(len(names)))
            offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * dim)
            vectors = pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], vectors], [*names, output])

    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(output, T.ArrayType(T.FloatType()))])
    return df.select(*names, tx.encoder_tokens(text).alias("_tokens")).mapInArrow(run, schema)


def embed_documents(
    df: DataFrame,
    text_column: str = "resume_text",
    output: str = "embedding",
    encoder: Callable[[], Callable[[pd.Series], list]] | None = None,
    max_chars: int | None = None,
    dim: int = lx.EMBEDDING_DIM,
) -> DataFrame:
    """Add a unit-length ``array<float>`` embedding of the text.

    ``encoder`` is a factory called once per Python worker; the function it
    returns maps a batch of texts to a batch of vectors. Without it the text's
    tokens are hashed. ``max_chars`` cuts the text first, for
    encoders with an input limit.
    """
    source = tx.text_or_empty(text_column) if max_chars is None else tx.truncate_text(text_column, max_chars)
    if encoder is None:
        return _with_hashed(df, source, output, dim)
    prepared = df.withColumn("_text", source)

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        run = encoder()
        for texts in batches:
            safe = texts.where(texts.str.strip() != "", "[empty]")
            vectors = np.asarray(run(safe), dtype="float64").reshape(len(safe), -1)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            unit = vectors / np.where(norms == 0, 1.0, norms)
            yield pd.Series(list(unit.astype("float32")))

    return prepared.withColumn(output, encode("_text")).drop("_text")


# -- TF-IDF --------------------------------------------------------------------------


@dataclass
class TfidfModel:
    """Vocabulary (at most ``max_terms`` terms) with its document frequencies."""

    terms: list[str]
    idf: list[float]
    stop_words: list[str] | None = None

    def transform(self, df: DataFrame, text_column: str, output: str = "tfidf") -> DataFrame:
        """Add the L2-normalised TF-IDF vector. Narrow: counts, weights and norm stay in the row."""
        terms = df.withColumn("_terms", tx.tfidf_terms(text_column, self.stop_words))
        counted = CountVectorizerModel.from_vocabulary(
            self.terms, inputCol="_terms", outputCol="_counts"
        ).transform(terms)
        weighted = ElementwiseProduct(
            scalingVec=Vectors.dense(self.idf), inputCol="_counts", outputCol="_weighted"
        ).transform(counted)
        return (
            Normalizer(p=2.0, inputCol="_weighted", outputCol=output)
            .transform(weighted)
            .drop("_terms", "_counts", "_weighted")
        )

    def long_form(self, df: DataFrame, text_column: str, id_column: str) -> DataFrame:
        """``(id, term, weight)``: one row per term of a document."""
        vocabulary = F.split(F.lit("\n".join(self.terms)), "\n")  # folded to one literal
        parts = self.transform(df, text_column, "_v").select(id_column, F.unwrap_udt("_v").alias("v"))
        pairs = parts.select(
            id_column, F.inline(F.arrays_zip(F.col("v.indices").alias("i"), F.col("v.values").alias("weight")))
        ).toDF(id_column, "i", "weight")
        return pairs.select(id_column, F.get(vocabulary, F.col("i")).alias("term"), "weight")


def _term_counts(df: DataFrame, terms: Column) -> DataFrame:
    """``(term, cf, df)``: occurrences, and rows that have the term. In a row equal terms lie side by side and the first is marked."""

    def marked(t: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), t)  # one longer
        return F.zip_with(t, F.slice(before, 1, F.size(t)), lambda a, b: F.struct(a.alias("term"), F.when(a == b, 0).otherwise(1).alias("first")))

    rows = df.select(F.inline(tx.bind(F.sort_array(terms), marked)))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("cf"), F.sum("first").alias("df"))


def fit_tfidf(
    df: DataFrame,
    text_column: str,
    min_df: int = 2,
    max_df: float = 0.95,
    max_terms: int = lx.TFIDF_MAX_TERMS,
    stop_words: list[str] | None = None,
) -> TfidfModel:
    """Count terms and documents per term in one aggregation keyed by term only.

    Every document contributes each occurrence of a term once, so there is no shuffle by
    ``(document, term)``, and a very common term combines map-side. Only the
    ``max_terms`` best terms reach the driver.

    For few terms the single tokens are counted first. No bigram is more frequent than its tokens, so those with a token
    that is rarer than the ``max_terms`` best tokens are not among the best terms and need no count.
    """
    rows = df.count()

    def usable(counts: DataFrame) -> DataFrame:
        return counts.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * rows)))

    counts = None
    if 0 < max_terms <= _FEW_TERMS:
        single = written(_term_counts(df, tx.tfidf_words(text_column, stop_words)), "tokens")
        best = usable(single).orderBy(F.col("cf").desc()).limit(max_terms).agg(F.min("cf").alias("least"), F.count("cf").alias("n")).first()
        frequent = single.filter(F.col("cf") >= (best["least"] if best["n"] == max_terms else 0))
        names = small_table(frequent.select("term"), 2 * _FEW_TERMS)
        if names is not None:
            pairs = tx.bind(tx.tfidf_words(text_column, stop_words), lambda t: tx.bigrams(t, names.column("term").to_pylist()))
            counts = frequent.unionByName(_term_counts(df, pairs))
    if counts is None:
        counts = _term_counts(df, tx.tfidf_terms(text_column, stop_words))
    best = (
        usable(counts)
        .orderBy(F.col("cf").desc(), "term")
        .limit(max_terms)
        .withColumn("idf", F.ln(F.lit(1.0 + rows) / (1 + F.col("df"))) + 1)
        .orderBy("term")
        .collect()
    )
    return TfidfModel([r["term"] for r in best], [r["idf"] for r in best], stop_words)


# -- numeric features ------------------------------------------------------------------


def structured_features(
    df: DataFrame,
    text_column: str = "resume_text",
    as_of_year: int | None = None,
    use_sections: bool = False,
) -> DataFrame:
    """Add the 14 numeric feature columns. Skills and keywords are extracted once."""
    prepared = df.withColumns({"_skills": tx.extract_skills(text_column), "_signals": ft.signal_words(text_column)})
    columns = ft.structured_features(text_column, as_of_year, use_sections, "_skills", "_signals")
    return prepared.select(*[F.col(c) for c in df.columns], *columns)


@dataclass
class ScalerModel:
    """Mean and population standard deviation per column (1 for a constant column)."""

    columns: list[str]
    mean: list[float]
    scale: list[float]

    def scaled(self) -> list[Column]:
        return [
            ((F.col(c) - F.lit(m)) / F.lit(s)).alias(c)
            for c, m, s in zip(self.columns, self.mean, self.scale)
        ]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(dict(zip(self.columns, self.scaled())))


def fit_scaler(df: DataFrame, columns: list[str] | None = None) -> ScalerModel:
    columns = columns or lx.FEATURE_COLUMNS
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    means = [row[f"m{i}"] or 0.0 for i in range(len(columns))]
    scales = [row[f"s{i}"] or 0.0 for i in range(len(columns))]
    constant = 10 * 2.220446049250313e-16  # spread below rounding error counts as constant
    return ScalerModel(
        list(columns), means, [s if s > constant * max(abs(m), 1.0) else 1.0 for m, s in zip(means, scales)]
    )


def scale_features(df: DataFrame, model: ScalerModel | None) -> DataFrame:
    if model is None:
        raise ValueError("the scaler is not fitted; call fit_scaler first")
    return model.transform(df)


def assemble_features(
    df: DataFrame,
    vector_column: str | None,
    numeric_columns: list[str] | None,
    output: str = "features",
) -> DataFrame:
    """One ML vector from a text vector (array or ML vector) and numeric columns."""
    from pyspark.ml.feature import VectorAssembler

    inputs = []
    work = df
    if vector_column is not None:
        inputs.append("_text_vector")
        is_array = dict(df.dtypes)[vector_column].startswith("array")
        source = array_to_vector(F.col(vector_column).cast("array<double>")) if is_array else F.col(vector_column)
        work = work.withColumn("_text_vector", source)
    inputs += numeric_columns or []
    return VectorAssembler(inputCols=inputs, outputCol=output).transform(work).drop("_text_vector")


# -- labels ------------------------------------------------------------------------------


def label_codes(df: DataFrame, label_column: str = "category") -> DataFrame:
    """``(label, code)``: codes 0.. over the sorted class names."""
    names = df.select(label_column).filter(F.col(label_column).isNotNull()).distinct()
    return number_rows(names, [label_column])


def encode_labels(df: DataFrame, label_column: str = "category", codes: DataFrame | None = None) -> DataFrame:
    """Add ``code``; rows with an unknown label are kept with a NULL code."""
    return df.join(codes if codes is not None else label_codes(df, label_column), label_column, "left")


def decode_labels(df: DataFrame, codes: DataFrame, label_column: str = "category") -> DataFrame:
    """Add the class name of ``code``."""
    return df.join(codes.select("code", label_column), "code", "left")
