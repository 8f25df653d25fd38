import hashlib
import random
import zlib

import numpy as np
from conftest_llm import WORD
from doclens.llm.base import QUERIES
from doclens.llm.periodic_runs import collapse_runs, runs_in, segments


def runs_by_hand(words):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed_by_hand(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rng):
    words = [rng.randrange(rng.choice([1, 2, 3, 5, 30])) for _ in range(rng.randint(0, 90))]
    for _ in range(rng.randint(0, 2)):
        if words:
            a, b = sorted(rng.randrange(len(words)) for _ in range(2))
            p = rng.randint(1, 12)
            words[a:b] = [words[a + (i - a) % p] if a + p <= b else words[i] for i in range(a, b)]
    return words


def test_runs_of_random_words():
    rng = random.Random(5)
    seen = 0
    for _ in range(400):
        texts = [random_words(rng) for _ in range(rng.randint(1, 4))]
        flat = np.array([w for t in texts for w in t], np.int64)
        bounds = np.cumsum([0, *map(len, texts)]).astype(np.int64)
        starts, stops = segments(flat, bounds)
        want = [(s + o, n, q) for t, o in zip(texts, bounds.tolist()) for s, n, q in runs_by_hand(t)]
        assert sorted(map(tuple, runs_in(flat, starts, stops).tolist())) == sorted(want)
        # every run lies within a segment
        assert all(((starts <= s) & (s + n <= stops)).any() for s, n, _ in want)
        seen += len(want)
    assert seen > 300


def test_splitting_leaves_nothing_of_unlike_words_and_all_of_a_run():
    words = np.concatenate((np.arange(500), 500 + np.arange(300) % 100, 600 + np.arange(500)))
    starts, stops = segments(words, np.array([0, len(words)]))
    assert (starts.tolist(), stops.tolist()) == ([500], [800])
    assert runs_in(words, starts, stops).tolist() == [[500, 300, 100]]
    # equal words further apart than half of their segment split it, which leaves nothing
    far = np.concatenate((np.arange(100), 100 + np.arange(60), np.arange(100)))
    assert len(segments(far, np.array([0, len(far)]))[0]) == 0


def test_long_runs_of_one_word_and_of_nested_periods():
    one = np.zeros(60_000, np.int64)
    assert runs_in(one, *segments(one, np.array([0, len(one)]))).tolist() == [[0, 60_000, 1]]
    nested = np.tile(np.concatenate((np.zeros(12, np.int64), np.arange(1, 9))), 50)
    assert sorted(runs_in(nested, *segments(nested, np.array([0, len(nested)]))).tolist()) == sorted(
        [[0, 1000, 20], *([20 * i, 12, 1] for i in range(50))]
    )


def test_edge_cases(spark, edge):
    rows = collapse_runs(edge).collect()
    assert len(rows) == edge.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], r)
    for r in edge.collect():
        words = WORD.findall(r["text"] or "")
        got, runs = by_id[r["doc_id"]], runs_by_hand(words) if len(words) < 1000 else None
        assert got["n_words"] == len(words)
        if runs is not None:
            assert [tuple(x) for x in got["runs"]] == runs
            assert got["collapsed"] == collapsed_by_hand(words, runs)
    assert collapse_runs(edge.limit(0)).count() == 0
    clash = spark.createDataFrame([("a", "x y " * 9, 1, "z")], "name string, body string, runs int, collapsed string")
    row = collapse_runs(clash, "name", "body").first()
    assert (row["name"], [tuple(x) for x in row["runs"]], row["collapsed"]) == ("a", [(0, 18, 2)], "x y")
    lines = spark.createDataFrame([(1, " one\ttwo\n\none two\x0bone two one two one two one two tail\r")], "doc_id long, text string")
    assert collapse_runs(lines).first()["collapsed"] == "one two tail"


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        words = WORD.findall(d["text"] or "")
        h = zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        if len(words) > 1500:
            continue
        runs, r = runs_by_hand(words), got[d["doc_id"]]
        planted += bool(runs)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        want = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == want
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed_by_hand(words, runs).encode()).hexdigest()
    assert planted > 10
