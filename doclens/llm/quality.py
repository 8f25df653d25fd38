"""Quality rules: tokeniser fertility beside word rules.

A public vocabulary reads every text, once. Three figures say how well it fits: characters per token,
the share of tokens that are byte fallbacks, and the entropy of the text's tokens. Histograms over all
documents give their median and spread per language, and per script where no language is known; text far from
its own language's figures is debris: keys, encoded data, tables of numbers, random characters, one phrase over
and over, or a script that the vocabulary can't spell. Wide fixed bands per script hold besides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclens.llm.base import query, table
from doclens.llm.tokenizers import piece_model, piece_parts, vocabulary
from doclens.llm.words import Words, chunks, text_bytes, windows
from doclens.session import shared_folder, written

REPEAT_WORDS = 5

# Fixed values: (least, most) characters per token, most byte-fallback share, least entropy in bits
# relative to the entropy of as many different tokens (texts of MIN_TOKENS tokens or more).
# "latin" and "other" are scripts; a language code overrides its script.
BANDS = {
    "latin": ((1.2, 8.0), 0.10, 0.40),
    "other": ((0.4, 6.0), 0.60, 0.30),
}
MIN_TOKENS = 32

# Derived bands: so many spreads (quartile range / 1.349) around the median, and the second figure at least.
SPREADS = 6
LEAST = {"chars": 0.2, "share": 0.09, "level": 0.15}  # chars: in natural logarithms
STEPS = {"chars": 0.01, "share": 0.002, "level": 0.004}  # widths of the histograms' bins
MIN_DOCS = 50  # languages, scripts and lengths with fewer documents have no figures of their own
EXTRA_TOKENS = 48  # a key or some numbers in a short text of prose may add so many tokens
REPEAT_TOKENS = 16  # tokens that a repeated phrase may take from the variety of a short text

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeated(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text, the words that lie in a window of REPEAT_WORDS words found twice or more."""
    values, held = windows(hashes, counts, REPEAT_WORDS)
    out = np.zeros(len(counts), np.int64)
    stops = np.cumsum(held)
    for i in np.flatnonzero(held > 1).tolist():
        own = values[stops[i] - held[i] : stops[i]]
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        if same.any():
            twice = np.zeros(len(own), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(counts[i] + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + REPEAT_WORDS, -1)
            out[i] = int((np.cumsum(edge[:-1]) > 0).sum())
    return out


def _base_columns(column: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = text_bytes(column)
    words = Words(data, offsets)

    def per_text(flags: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(flags)))
        return upto[offsets[1:]] - upto[offsets[:-1]]

    head = (data & 0xC0) != 0x80  # first bytes of characters
    duplicates = np.zeros(len(words.counts), np.int64)
    for i, text in enumerate(column.to_pylist()):
        if text and "\n" in text:
            lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
            duplicates[i] = len(lines) - len(set(lines))
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": per_text(head & words.inside),
        "n_symbols": per_text(_SYMBOL[data]),
        "n_dup_lines": duplicates,
        "n_repeat_words": _repeated(words.hashes(), words.counts),
        "_chars": per_text(head),
        "_latin": per_text((data < 0x80) | ((data >= 0xC3) & (data <= 0xC9))),
    }


def _fertility(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: tokens, byte-fallback tokens, entropy of its tokens in bits."""
    model = piece_model(path)
    fallback = np.array([model.is_byte(i) for i in range(model.vocab_size())])
    tokens, bytes_, entropy = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for i, text in enumerate(texts):
        if not text:
            continue
        ids = np.concatenate([np.array(x, np.int32) for x in model.encode(piece_parts(text), num_threads=1)])
        if not len(ids):
            continue
        ids.sort()
        edges = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True])))
        share = np.diff(edges) / len(ids)
        tokens[i], bytes_[i] = len(ids), int(fallback[ids].sum())
        entropy[i] = float(-(share * np.log2(share)).sum())
    return tokens, bytes_, entropy


_MEASURED = [
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
    ("base_failed", "boolean"), ("n_tokens", "long"), ("chars_per_token", "double"), ("byte_share", "double"), ("token_entropy", "double"),
]


def _prefix(columns: list[str]) -> str:
    """Of columns of figures beside columns of the caller: none of those begins with it."""
    own = "_quality_"
    while any(c.lower().startswith(own) for c in columns):
        own = "_" + own
    return own


def _with(schema: T.StructType, made: list[tuple[str, str]]) -> T.StructType:
    """A copy of ``schema`` with more columns."""
    out = T.StructType(list(schema.fields))
    for name, kind in made:
        out.add(name, kind)
    return out


def _measures(column: pa.Array, path: str) -> dict[str, np.ndarray]:
    base = _base_columns(column)
    tokens, fallback, entropy = _fertility(column.to_pylist(), path)
    some = np.maximum(tokens, 1)
    return base | {
        "base_failed": (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"]),
        "n_tokens": tokens, "chars_per_token": base["_chars"] / some, "byte_share": fallback / some,
        "token_entropy": entropy / np.maximum(np.log2(np.minimum(some, 4096)), 1), "latin": 2 * base["_latin"] >= base["_chars"],
    }


def _middle(values: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Median and spread of values that are there ``counts`` times."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(counts[order])
    low, mid, high = (values[order][np.searchsorted(upto, upto[-1] * q)] for q in (0.25, 0.5, 0.75))
    return float(mid), float(high - low) / 1.349


def derived_bands(measured: DataFrame, prefix: str = "") -> dict:
    """Median and spread of the three figures over all rows that pass the base rules and have MIN_TOKENS tokens.

    Keys are ``(group, figure)`` or ``(group, figure, octave of tokens)``; a group is ``("lang", code)`` or ``("script", name)``.
    Characters per token hardly depend on length and spread with one over the root of the tokens; entropy and byte share have
    figures per octave. ``("script", name)`` alone lists the groups that texts of rare and unknown languages may fit. Counted on histograms: what reaches the driver grows with the languages of MIN_DOCS documents, not with the rows.
    """
    col = lambda n: F.col(prefix + n)
    rows = measured.filter(~col("base_failed") & (col("n_tokens") >= MIN_TOKENS))
    known = rows.filter(col("lang").isNotNull()).groupBy(col("lang").alias("lang")).count().filter(F.col("count") >= MIN_DOCS)
    langs = [r["lang"] for r in known.orderBy(F.desc("count"), "lang").collect()]
    bins = F.array(*(
        F.struct(F.lit(name).alias("figure"), F.floor(value / STEPS[name]).alias("bin"))
        for name, value in (("chars", F.log(col("chars_per_token"))), ("share", col("byte_share")), ("level", col("token_entropy")))
    ))
    cells = (
        rows.select(F.when(col("lang").isin(langs), col("lang")).alias("lang"), col("latin").alias("latin"),
                    F.floor(F.log2(col("n_tokens"))).alias("octave"), F.explode(bins).alias("b"))
        .groupBy("lang", "latin", "octave", "b.figure", "b.bin").count().toArrow().to_pylist()
    )
    held: dict = {}
    total, latin_docs = Counter(), Counter()
    for c in cells:
        total[c["lang"]] += c["count"]
        latin_docs[c["lang"]] += c["count"] * c["latin"]
        entry = (c["octave"], (c["bin"] + 0.5) * STEPS[c["figure"]], c["count"])
        for group in [("script", "latin" if c["latin"] else "other"), *([("lang", c["lang"])] if c["lang"] is not None else [])]:
            keys = [(group, c["figure"])] if c["figure"] == "chars" else [(group, c["figure"], c["octave"])]
            for key in keys:
                held.setdefault(key, []).append(entry)
    found = {}
    for key, entries in held.items():
        octaves, values, counts = (np.array(x) for x in zip(*entries))
        if counts.sum() < MIN_DOCS:
            continue
        middle, spread = _middle(values, counts)
        if key[1] == "chars":  # of the deviation times the root of the tokens
            spread = _middle((values - middle) * np.sqrt(1.5 * 2.0**octaves), counts)[1]
        found[key] = (middle, spread)
    # what texts of a script without a language of their own are held to: its languages, or all of its texts
    for script in ("latin", "other"):
        own = [("lang", x) for x in langs if (("lang", x), "chars") in found and (2 * latin_docs[x] >= total[x]) == (script == "latin")]
        found["script", script] = own or [g for g in [("script", script)] if (g, "chars") in found]
    return found


def _near(found: dict, group: tuple, tokens: int, chars: float, others: dict) -> bool:
    """Whether a text's figures lie near those of a group."""
    middle, spread = found[group, "chars"]
    away = float(np.log(chars)) - middle
    extra = tokens - tokens * chars / np.exp(middle)  # tokens beyond what the group takes for these characters
    if abs(away) > max(LEAST["chars"], SPREADS * spread / tokens**0.5) and (away > 0 or extra > EXTRA_TOKENS):
        return False
    for figure, value in others.items():
        middle, spread = found.get((group, figure, tokens.bit_length() - 1), (value, 0.0))
        room = max(LEAST[figure], SPREADS * spread) + REPEAT_TOKENS / tokens
        if value > middle + room or (figure == "level" and value < middle - room):
            return False
    return True


def _inside(batch: pa.RecordBatch, prefix: str, limits: dict, fixed: dict, found: dict) -> np.ndarray:
    """Which rows pass the base rules and lie inside their bands."""
    column = lambda n: batch.column(prefix + n).to_numpy(zero_copy_only=False)
    langs, latin = batch.column(prefix + "lang").to_pylist(), column("latin")
    tokens, chars, share, level = (column(n) for n in ("n_tokens", "chars_per_token", "byte_share", "token_entropy"))
    band = [limits[x] if x in limits else limits["latin" if y else "other"] for x, y in zip(langs, latin)]
    low, high = np.array([b[0][0] for b in band]), np.array([b[0][1] for b in band])
    most, least = np.array([b[1] for b in band]), np.array([b[2] for b in band])
    fits = (chars >= low) & (chars <= high) & (share <= most) & ((level >= least) | (tokens < MIN_TOKENS))
    for i in np.flatnonzero(fits & ~column("base_failed") & (tokens >= MIN_TOKENS)).tolist():
        script = "latin" if latin[i] else "other"
        if langs[i] in fixed or script in fixed:
            continue
        own = ("lang", langs[i])
        groups = [own] if (own, "chars") in found else found.get(("script", script), [])
        fits[i] = not groups or any(_near(found, g, int(tokens[i]), float(chars[i]), {"share": share[i], "level": level[i]}) for g in groups)
    return fits & ~column("base_failed")


def quality_rules(
    docs: DataFrame,
    tokenizer: str = "piece_bpe_32k.model",
    text_column: str = "text",
    lang_column: str | None = "lang",
    bands: dict | None = None,
    path: str | None = None,
) -> DataFrame:
    """The rule columns of every row of ``docs`` beside its other columns (the text is left out).

    Words are ``[^\\x20\\x09-\\x0D]+``. ``word_chars``: characters in words; ``n_symbols``: characters of
    ``#*$%&|<>``; ``n_dup_lines``: lines with a word that equal an earlier line; ``n_repeat_words``: words in 5-word
    windows found twice or more. ``base_failed``: fewer than 10 words, or over 20% repeated words.
    ``chars_per_token``, ``byte_share`` and ``token_entropy`` (0 to 1: of the most that so many tokens can
    have) are held to the fixed band of the row's script and to :func:`derived_bands` of its language, or else of any one
    language of its script; ``kept`` is false outside. ``bands`` replaces both for the languages and scripts that it names.

    Null and empty texts have 0 everywhere and fail the base rules. A null, rare or unknown language has to fit
    one of its script's; a script of under MIN_DOCS documents has its fixed band only. Texts of under 32 tokens have no
    entropy rule and no derived band. Equal rows get equal verdicts. An empty table gives no rows. Columns with
    the names of the results are replaced. A very long text is held whole by one task. The figures are written to the shared folder, without the texts.
    """
    path = path or vocabulary(tokenizer)
    limits, fixed, mark = BANDS | (bands or {}), bands or {}, _prefix(docs.columns)
    names = [n for n, _ in _MEASURED]
    others = [c for c in docs.columns if c != text_column and c not in names and c != "kept"]
    carried = [(mark + n, "string" if n == "lang" else "boolean") for n in ("lang", "latin")]
    has_lang = lang_column is not None and lang_column in others

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_column):
            values = _measures(batch.column(text_column), path)
            own = [*(batch.column(c) for c in others), *(pa.array(values[n]) for n in names), batch.column(mark + "lang"), pa.array(values["latin"])]
            yield pa.RecordBatch.from_arrays(own, [*others, *names, *(n for n, _ in carried)])

    schema = _with(docs.select(*others).schema, _MEASURED + carried)
    lang = F.col(lang_column).cast("string") if has_lang else F.lit(None).cast("string")
    measured = written(
        docs.select(*others, F.col(text_column).cast("string").alias(text_column), lang.alias(mark + "lang")).mapInArrow(measure, schema), "quality"
    )
    found = derived_bands(measured.select(*(F.col(n).alias(mark + n) for n in names), *(n for n, _ in carried)), mark)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([batch.column(c) for c in [*names, *(n for n, _ in carried)]], [*(mark + n for n in names), *(n for n, _ in carried)])
            kept = pa.array(_inside(own, mark, limits, fixed, found))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*others, *names]), kept], [*others, *names, "kept"])

    return measured.mapInArrow(judge, _with(docs.select(*others).schema, [*_MEASURED, ("kept", "boolean")]))


def keep_good(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", text_column: str = "text", lang_column: str = "lang", bands: dict | None = None, path: str | None = None) -> DataFrame:
    """The rows of ``docs`` whose texts :func:`quality_rules` keeps, with all their columns; nothing is shuffled.

    The rows that pass the base rules are written to the shared folder once, so that no text is tokenised twice.
    """
    path = path or vocabulary(tokenizer)
    limits, fixed, mark = BANDS | (bands or {}), bands or {}, _prefix(docs.columns)
    names = ["base_failed", "n_tokens", "chars_per_token", "byte_share", "token_entropy", "latin"]
    kinds = dict(_MEASURED) | {"latin": "boolean"}
    docs_columns, schema = docs.columns, docs.schema
    lang = F.col(lang_column).cast("string") if lang_column in docs_columns else F.lit(None).cast("string")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_column):
            values = _measures(batch.column(text_column), path)
            whole = pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(values[n]) for n in names)], [*batch.schema.names, *(mark + n for n in names)])
            yield whole.filter(pa.array(~values["base_failed"]))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_inside(batch, mark, limits, fixed, found))).select(docs_columns)

    with_lang = docs.withColumn(mark + "lang", lang)
    figures = with_lang.mapInArrow(measure, _with(with_lang.schema, [(mark + n, kinds[n]) for n in names]))
    folder = shared_folder(docs.sparkSession, "quality")  # whole texts: packed more tightly than tables of numbers
    figures.write.option("compression", "zstd").parquet(folder)
    measured = docs.sparkSession.read.schema(figures.schema).parquet(folder)
    found = derived_bands(measured.select(*(mark + n for n in [*names, "lang"])), mark)
    return measured.mapInArrow(keep, schema)


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("lang")
