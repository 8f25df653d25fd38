import math
import re
from collections import Counter

from doclens.operators import sentences

TEXTS = [
    (1, "Dr. Smith came. He met Mr. Brown and Dr. Jones, e.g. at noon. They spoke! Was it late? Yes it was."),
    (2, "We saw Dr. Who. Fruit, e.g. apples, is good.\nMr. Brown said so. It was late."),
    (3, "It was good. He spoke. They met at noon. Apples it was. Yes. Mr. Jones (e.g. he) was late."),
    (4, None),
    (5, "   "),
    (6, "no stop at all"),
    (6, "no stop at all"),
    (7, "He came with Dr.\nJones.   Then   he left..."),
] + [(10 + i, "The fruit was good and late and he was there and it spoke of the noon when they came") for i in range(8)]


def _plain(rows):
    """The published score by a plain loop over the words."""
    stops, others = Counter(), Counter()
    for _, text in rows:
        for token in (text or "").lower().split():
            found = re.match(r"^[\"'(\[]*([^\W\d_]+(?:\.[^\W\d_]+)*)(\.?)[\"')\],;:!?]*$", token)
            if found:
                (stops if found[2] else others)[found[1]] += 1
    share = sum(stops.values()) / (sum(stops.values()) + sum(others.values()))
    out = {}
    for word, n in stops.items():
        letters, m = len(word.replace(".", "")), others[word]
        ratio = -2 * (n * math.log(share / 0.99) + m * math.log((1 - share) / 0.01))
        score = ratio * math.exp(-letters) * (word.count(".") + 1) / letters**m
        if score >= 0.3:
            out[word] = (n, m, round(score, 9))
    return out


def _lines(text, known):
    out, start = "", 0
    for sign in re.finditer(r"[.!?]\s+", text or ""):
        piece = text[start : sign.end()]
        last = re.search(r"(?:^|\s)[\"'(\[]*([^\W\d_]+(?:\.[^\W\d_]+)*)\.\s+$", piece)
        out += piece + ("" if last and last[1].lower() in known else "\n")
        start = sign.end()
    out += (text or "")[start:]
    return "\n".join(s.strip() for s in out.split("\n") if s.strip())


def _table(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_abbreviations_equal_a_plain_loop(spark):
    found = {r["word"]: (r["with_stop"], r["without_stop"], round(r["score"], 9)) for r in sentences.abbreviations(_table(spark)).collect()}
    assert found == _plain(TEXTS)
    assert {"dr", "mr", "e.g"} <= set(found) and "late" not in found and "noon" not in found


def test_lines_equal_a_plain_loop_in_the_row_and_joined(spark):
    docs = _table(spark)
    known = sentences.abbreviations(docs)
    listed = set(_plain(TEXTS))
    want = sorted((i, _lines(t, listed)) for i, t in TEXTS)
    got = sorted(tuple(r) for r in sentences.sentence_lines(docs, known).collect())
    assert got == want
    lines = dict(got)
    assert lines[1].startswith("Dr. Smith came.\nHe met Mr. Brown and Dr. Jones, e.g. at noon.\n")
    assert lines[4] == lines[5] == "" and lines[7].startswith("He came with Dr.\nJones.")
    unique = _table(spark, list(dict.fromkeys(TEXTS)))
    joined = sorted(tuple(r) for r in sentences.sentence_lines(unique, known, max_literals=0).collect())
    assert joined == sorted(set(want))


def test_tables_without_a_stop(spark):
    for rows in ([], [(1, None)], [(1, "no stop here")]):
        docs = _table(spark, rows)
        known = sentences.abbreviations(docs)
        assert known.count() == 0
        assert [tuple(r) for r in sentences.sentence_lines(docs, known).collect()] == [(i, t or "") for i, t in rows]


def test_texts_of_stops_only_and_a_long_one(spark):
    docs = _table(spark, [(1, "a. b. c."), (2, "word. " * 50_000)])
    known = sentences.abbreviations(docs)
    assert known.count() >= 0  # every word has a stop: no other use to compare with
    assert sentences.sentence_lines(docs, known.limit(0)).filter("doc_id = 2").first()["lines"].count("\n") == 49_999
