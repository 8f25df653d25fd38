"""Sentences of documents, with abbreviations that the corpus itself tells.

A full stop ends a sentence unless it belongs to an abbreviation. Whether a word is one is decided by counts over
all documents (Kiss and Strunk 2006, "Unsupervised multilingual sentence boundary detection"): an abbreviation is
nearly always followed by a full stop, is short, and often holds full stops of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.functions import text as tx
from doclens.session import small_table, written

THRESHOLD = 0.3  # of the score, as published
CLINGS = 0.99  # the share of an abbreviation's uses that a full stop follows, as published
MAX_LITERALS = 10_000  # abbreviations that are looked up in the row; more are joined

WORD = r"\p{L}+(?:\.\p{L}+)*"
OPENING = r"[\"'(\[]*"
CLOSING = r"[\"')\],;:!?]*"
PIECE = r"(?s:.*?[.!?]\s+|.+)"
LAST_WORD = rf"(?:^|\s){OPENING}({WORD})\.\s+$"


def word_counts(df: DataFrame, text_column: str = "text") -> DataFrame:
    """``(word, with_stop, without_stop)`` of the lower-cased words of all texts; combined before the one shuffle, by word."""
    tokens = F.regexp_extract_all(F.lower(tx.text_or_empty(text_column)), F.lit(rf"{tx.UNICODE}\S+"), F.lit(0))
    token = rf"{tx.UNICODE}^{OPENING}({WORD})(\.?){CLOSING}$"
    found = df.select(F.explode(tokens).alias("token")).select(
        F.regexp_extract("token", token, 1).alias("word"), (F.regexp_extract("token", token, 2) == ".").cast("long").alias("stop")
    )
    return (
        found.filter("word <> ''")
        .groupBy("word")
        .agg(F.sum("stop").alias("with_stop"), F.sum(1 - F.col("stop")).alias("without_stop"))
    )


def abbreviations(df: DataFrame, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(word, with_stop, without_stop, score)`` of the words that are abbreviations in these texts.

    The score is the log-likelihood ratio of "nearly always with a full stop" against "as often as any word",
    times ``exp(-letters)``, times the inner full stops and one, and divided by ``letters ** without_stop``.
    Null and blank texts count nothing; no text with a full stop gives no abbreviation.
    """
    counts = written(word_counts(df, text_column), "words")
    total = counts.agg(F.sum("with_stop").alias("stops"), F.sum(F.col("with_stop") + F.col("without_stop")).alias("words")).first()
    if not total["stops"]:
        return counts.withColumn("score", F.lit(0.0)).limit(0)
    share = total["stops"] / total["words"]
    letters = F.length(F.regexp_replace("word", r"\.", "")).cast("double")
    inner = F.length("word") - letters
    usual = F.col("with_stop") * F.ln(F.lit(share / CLINGS))
    if share < 1:
        usual += F.col("without_stop") * F.ln(F.lit((1 - share) / (1 - CLINGS)))
    score = -2 * usual * F.exp(-letters) * (inner + 1) * F.pow(letters, -F.col("without_stop").cast("double"))
    return counts.filter("with_stop > 0").withColumn("score", score).filter(F.col("score") >= threshold)


def _pieces(text: Column) -> Column:
    """The text in parts that end behind a sentence sign and its blanks; put together they are the text."""
    return F.regexp_extract_all(text, F.lit(tx.UNICODE + PIECE), F.lit(0))


def _last_word(piece: Column) -> Column:
    """The word whose full stop ends the piece; empty if another sign does."""
    return F.lower(F.regexp_extract(piece, tx.UNICODE + LAST_WORD, 1))


def _lines(joined: Column) -> Column:
    lines = F.filter(F.transform(F.split(joined, "\n"), tx.strip), lambda s: s != "")
    return F.array_join(lines, "\n")


def _ended(piece: Column, inside: Column) -> Column:
    return F.when(inside, piece).otherwise(F.concat(piece, F.lit("\n")))


def sentence_lines(
    df: DataFrame,
    known: DataFrame,
    text_column: str = "text",
    id_column: str = "doc_id",
    output: str = "lines",
    max_literals: int = MAX_LITERALS,
) -> DataFrame:
    """``(id, output)``: one sentence per line; the full stop of a ``word`` in ``known`` ends none.

    Line breaks of the text stay, blanks around a line and empty lines go, null gives an empty text. A list that is
    proven small is looked up in the row, in one narrow pass. A longer one is joined by word, where AQE splits
    very common words; then ids have to be unique.
    """
    words = small_table(known.select("word"), max_literals)
    docs = df.select(id_column, tx.text_or_empty(text_column).alias("_text"))
    if words is not None:
        listed = words.column("word").to_pylist()
        joined = F.array_join(
            F.transform(_pieces(F.col("_text")), lambda p: _ended(p, _last_word(p).isin(listed) if listed else F.lit(False))), ""
        )
        return docs.select(id_column, _lines(joined).alias(output))
    pieces = docs.select(id_column, F.posexplode_outer(_pieces(F.col("_text"))).alias("pos", "piece"))
    looked_up = pieces.withColumn("word", _last_word(F.col("piece"))).join(
        known.select("word").distinct().withColumn("_inside", F.lit(True)), "word", "left"
    )
    part = F.struct("pos", _ended(F.coalesce("piece", F.lit("")), F.coalesce("_inside", F.lit(False))).alias("part"))
    whole = looked_up.groupBy(id_column).agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    return whole.select(id_column, _lines(F.array_join(F.col("_parts.part"), "")).alias(output))
