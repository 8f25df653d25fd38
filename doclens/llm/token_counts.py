"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are encoded in batches of about equal bytes; a long text is cut where the tokenizer
would start a new token anyway, and its parts are spread over the batches. No token id leaves
the worker. The pass is narrow: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.base import query, table
from doclens.llm.tokenizers import byte_model, byte_parts, piece_model, piece_parts, vocabulary
from doclens.llm.words import chunks

BATCH_BYTES = 1 << 18


def _json_model(path: str):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    model.no_truncation()
    model.no_padding()
    return model


def lengths(name: str, path: str):
    """``(cut, count)`` of a vocabulary file: how to cut a text, and the token counts of a list of parts."""
    if name.endswith(".model"):
        return piece_parts, lambda parts: [len(x) for x in piece_model(path).encode(parts, num_threads=1)]
    if name.endswith(".tiktoken"):
        return byte_parts, lambda parts: [len(byte_model(path).encode_ordinary(x)) for x in parts]
    if name.endswith(".json"):
        # its normalizer may look across any place: whole texts only
        model = _json_model(path)
        return lambda text: [text], lambda parts: [len(x) for x in model.encode_batch(parts, add_special_tokens=False)]
    raise ValueError(f"unknown kind of vocabulary: {name}")


def byte_batches(texts: list[str], parts_of) -> Iterator[tuple[list[str], list[int]]]:
    """``(parts, numbers of their texts)`` in batches of about ``BATCH_BYTES`` of UTF-8: a batch is full with the part that reaches them."""
    parts, owners, held = [], [], 0
    for i, text in enumerate(texts):
        for part in parts_of(text) if text else []:
            parts.append(part)
            owners.append(i)
            held += len(part) if part.isascii() else len(part.encode())
            if held >= BATCH_BYTES:
                yield parts, owners
                parts, owners, held = [], [], 0
    if parts:
        yield parts, owners


def token_counts(
    docs: DataFrame,
    tokenizer: str = "piece_bpe_32k.model",
    text_column: str = "text",
    limit: int = 4096,
    path: str | None = None,
) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) in place of the text.

    Counts are those of the library for the vocabulary file, without begin, end or other added tokens; strings of
    special tokens inside a text are text. Null texts count as empty: 0 bytes, 0 tokens. Equal rows are counted
    each. An empty table gives no rows. Columns of these three names are replaced. A very long text is held whole by one task.
    """
    path = path or vocabulary(tokenizer)
    others = [c for c in docs.columns if c not in (text_column, "n_bytes", "n_tokens", "over_limit")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_of, count_parts = lengths(tokenizer, path)
        for batch in chunks(batches, text_column, 1 << 22):
            texts = [t or "" for t in batch.column(text_column).to_pylist()]
            counts, sizes = np.zeros(len(texts), np.int64), np.array([len(t.encode()) for t in texts], np.int64)
            for parts, owners in byte_batches(texts, parts_of):
                np.add.at(counts, owners, count_parts(parts))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array(sizes), pa.array(counts), pa.array(counts > limit)],
                [*others, "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = docs.select(*others, F.col(text_column).cast("string").alias(text_column))
    schema = docs.select(*others).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return narrow.mapInArrow(count, schema)


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
