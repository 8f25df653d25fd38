"""Token normalisation by dictionary, and the full preprocessing chain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclens.batches import slices
from doclens.functions import text as tx
from doclens.operators.cleaning import with_clean_text
from doclens.session import small_table

_WORDS_AT_ONCE = 1 << 17


def _with_forms(df: DataFrame, dictionary: DataFrame, words: Column, output: str, id_column: str) -> DataFrame:
    """Add ``output``: the words of each row, replaced by their dictionary forms and joined by blanks.

    A dictionary that is proven small goes to the tasks as two arrays, and whole batches are looked up
    at once: nothing is exploded or shuffled. A larger one is joined by token, where AQE splits the
    partitions of very common words.
    """
    pairs = small_table(dictionary.select("token", "norm").filter(F.col("token").isNotNull()))
    if pairs is None:
        return _with_joined_forms(df, dictionary, words, output, id_column)
    known, forms = (pairs.column(c).combine_chunks() for c in ("token", "norm"))
    kept = df.withColumn("_words", F.coalesce(words, F.array().cast("array<string>")))
    names = df.columns

    def word_counts(batch: pa.RecordBatch) -> np.ndarray:
        return pc.list_value_length(batch.column("_words")).to_numpy(zero_copy_only=False)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, word_counts, _WORDS_AT_ONCE):
            lists = batch.column("_words")
            tokens = lists.flatten()
            normal = pc.coalesce(forms.take(pc.index_in(tokens, value_set=known)), tokens)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            joined = pc.binary_join(pa.ListArray.from_arrays(offsets, normal), " ")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), joined], [*names, output])

    return kept.mapInArrow(replace, T.StructType([*df.schema.fields, T.StructField(output, T.StringType())]))


def _with_joined_forms(df: DataFrame, dictionary: DataFrame, words: Column, output: str, id_column: str) -> DataFrame:
    tokens = df.select(id_column, F.posexplode_outer(words).alias("pos", "token"))
    looked_up = tokens.join(dictionary.select("token", "norm"), "token", "left")
    word = F.when(F.col("token").isNotNull(), F.struct("pos", F.coalesce("norm", "token").alias("word")))
    forms = looked_up.groupBy(id_column).agg(F.array_sort(F.collect_list(word)).alias("_words"))
    joined = df.join(forms, id_column)
    return joined.select(*df.columns, F.array_join(F.col("_words.word"), " ").alias(output))


def normalize_tokens(
    df: DataFrame,
    dictionary: DataFrame,
    text_column: str = "text",
    id_column: str = "doc_id",
    output: str = "normalized",
    stop_words: list[str] | None = None,
) -> DataFrame:
    """Replace each word by its dictionary form (lemma or stem), keeping the order.

    ``dictionary`` is ``(token, norm)`` with one row per token; a token without form stays.
    ``stop_words`` are dropped before the lookup. Returns ``(id, output)``.
    """
    source = tx.text_or_empty(text_column)
    if stop_words:
        source = tx.remove_stopwords(source, stop_words)
    docs = df.select(F.col(id_column), source.alias("_text"))
    return _with_forms(docs, dictionary, tx.words("_text"), output, id_column).select(id_column, output)


def preprocess_documents(
    df: DataFrame,
    text_column: str = "resume_text",
    id_column: str = "doc_id",
    output: str = "cleaned_text",
    dictionary: DataFrame | None = None,
    stop_words: list[str] | None = None,
    section_aware: bool = True,
    return_tokens: bool = False,
) -> DataFrame:
    """Section weighting, cleaning, stop words, then the optional dictionary lookup: one narrow pass.

    ``return_tokens`` gives an array of words instead of text.
    """
    weighted = tx.section_weighted_text(text_column) if section_aware else tx.text_or_empty(text_column)
    cleaned = with_clean_text(df, weighted, output, stop_words=stop_words or tx.default_stop_words())
    if dictionary is not None:
        cleaned = (
            _with_forms(cleaned, dictionary, tx.words(output), "_normalized", id_column)
            .drop(output)
            .withColumnRenamed("_normalized", output)
            .select(*df.columns, output)
        )
    if return_tokens:
        cleaned = cleaned.withColumn(output, tx.words(output))
    return cleaned


def parse_sections_long(df: DataFrame, text_column: str = "resume_text", id_column: str = "doc_id") -> DataFrame:
    """``(id, ord, section, content)``: one row per section of a document."""
    sections = F.posexplode(tx.parse_sections(text_column)).alias("ord", "s")
    return df.select(id_column, sections).select(
        id_column, "ord", F.col("s.section").alias("section"), F.col("s.content").alias("content")
    )
