"""Cleaning of whole Arrow batches of texts.

Arrow's regular expressions run in linear time but know ASCII classes only. So the text comes with its other word
characters written as ``_`` (``_masked``): cleaning drops both, and a rule asks of them only whether they are word characters.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclens import lexicon as lx
from doclens.batches import byte_sizes, slices
from doclens.functions import text as tx

# white space of Unicode that RE2's \s lacks
_OTHER_BLANKS = "[\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_SLICE_BYTES = 1 << 21

_KEPT = b"abcdefghijklmnopqrstuvwxyz0123456789"
_FOLD = bytes(c if c in _KEPT else 0x20 for c in range(256))
_SHORT = 2  # characters of a literal that is in so many texts that looking for it first saves nothing


@lru_cache(maxsize=2)
def _rules(keep_terms: bool) -> list[tuple[list[str], str, str]]:
    """``(literals, pattern, replacement)`` in order; a text without any of the literals has no match."""
    rules = [([word], rf"\b{word}\b", target) for word, target in lx.ALIASES]
    if keep_terms:
        rules += [([term], rf"\b{lx.escaped(term)}\b", f" {token} ") for term, token in lx.PROTECTED_TERMS]
        rules += [
            ([product], rf"\b{pattern}\b", " " + replacement.replace("$", "\\") + " ")
            for pattern, replacement in lx.VERSION_RULES
            for product in lx.VERSIONED_PRODUCTS
            if pattern.startswith(product)
        ]
    return [*rules, (["http", "www"], lx.URL_PATTERN, " "), (["@"], lx.EMAIL_PATTERN, " "), ([], lx.PHONE_PATTERN, " ")]


def _bytes(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return (data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if data is not None else b""), offsets - offsets[0]


def _holders(data: bytes, offsets: np.ndarray, literal: str) -> list[int]:
    """Texts that may have the literal; a text without it is among them only if it begins inside one."""
    sought, ends, found = literal.encode(), offsets[1:].tolist(), []
    at = data.find(sought)
    while at >= 0:
        found.append(bisect_right(ends, at))
        at = data.find(sought, ends[found[-1]])
    return found


def _rewritten(texts: pa.Array, literals: list[str], pattern: str, replacement: str) -> pa.Array:
    if not literals or len(literals[0]) <= _SHORT:
        return pc.replace_substring_regex(texts, pattern, replacement)
    held = _bytes(texts)
    hits = sorted({row for literal in literals for row in _holders(*held, literal)})
    if not hits:
        return texts
    if 2 * len(hits) > len(texts):
        return pc.replace_substring_regex(texts, pattern, replacement)
    mask = np.zeros(len(texts), bool)
    mask[hits] = True
    changed = pc.replace_substring_regex(texts.take(pa.array(hits, pa.int32())), pattern, replacement)
    return pc.replace_with_mask(texts, pa.array(mask), changed)


def folded(texts: pa.Array, stop: frozenset[bytes]) -> pa.Array:
    """Words of ``a-z 0-9`` of each text but the stop words, with single blanks between."""
    data, offsets = _bytes(texts)
    data, at = data.translate(_FOLD), offsets.tolist()
    return pa.array([b" ".join([w for w in data[a:b].split() if w not in stop]) for a, b in zip(at, at[1:])], pa.binary()).cast(pa.string())


def clean(texts: pa.Array, keep_terms: bool = True, stop: frozenset[bytes] = frozenset()) -> pa.Array:
    """Aliases, protected terms, contacts, charset, in that order; the texts are lower-case, masked and not null."""
    texts = pc.replace_substring_regex(texts, _OTHER_BLANKS, " ")
    for rule in _rules(keep_terms):
        texts = _rewritten(texts, *rule)
    return folded(texts, stop)


def _masked(text: Column, keep_terms: bool) -> Column:
    """``struct<text, odd>``: the lower-case text in ASCII word characters; or cleaned, where digits beyond ASCII make it odd."""

    def prepared(t: Column) -> Column:
        beyond = F.octet_length(t) != F.length(t)
        odd = beyond & t.rlike(r"(?U)[\d&&[^\x00-\x7F]]")
        word = F.when(beyond, F.regexp_replace(t, r"(?U)[\w&&[^\x00-\x7F]]+", "_")).otherwise(t)
        return tx.bind(odd, lambda o: F.struct(F.when(o, tx.clean_text(t, keep_terms)).otherwise(word).alias("text"), o.alias("odd")))

    return tx.bind(F.lower(tx.text_or_empty(text)), prepared)


def with_clean_text(df: DataFrame, text: Column, output: str, keep_terms: bool = True, stop_words: list[str] | None = None) -> DataFrame:
    """Add ``output``: ``tx.clean_text`` of ``text``, without the stop words if there are any. Narrow; a task cleans about 2 MB of texts at a time."""
    stop = frozenset(w.encode() for w in stop_words or ())
    names = [c for c in df.columns if c != output]
    kept = df.withColumn("_masked", _masked(text, keep_terms)).select(*names, "_masked.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, lambda b: byte_sizes(b.column(len(names))), _SLICE_BYTES):
            texts, odd = (part.column(i) for i in (len(names), len(names) + 1))
            done = clean(texts.cast(pa.string()), keep_terms, stop)
            if pc.any(odd).as_py():
                done = pc.if_else(odd, folded(texts.cast(pa.string()), stop), done)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], done], [*names, output])

    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(output, T.StringType())])
    return kept.toDF(*names, "_text", "_odd").mapInArrow(run, schema)
