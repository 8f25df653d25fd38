import math
import random
import re
from collections import Counter

import numpy as np
from conftest_llm import lower
from doclens.llm.lexical_search import best_documents, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def search_by_hand(docs, items, k):
    """``docs`` and ``items``: (id, text) pairs."""
    counts = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall(lower(t)))
    rows = set()
    for item, terms in asked.items():
        scored = []
        for (i, c), n in zip(counts, sizes):
            score = 0
            for t in terms:
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // total)))
            if score > 0:
                scored.append((-score, i is not None, i if i is not None else 0, i))
        scored.sort(key=lambda x: x[:3])
        rows |= {(item, rank, s[3], -s[0]) for rank, s in enumerate(scored[:k], 1)}
    return rows


def test_reading_ends_early_and_is_exact():
    rng = np.random.default_rng(1)
    saved = 0
    for case in range(300):
        size, k = int(rng.integers(1, 3000)), int(rng.integers(1, 20))
        lists, exact = [], np.zeros(size, np.int64)
        for _ in range(int(rng.integers(1, 9))):
            docs = rng.permutation(size)[: int(rng.integers(0, size + 1))]
            impacts = np.sort((rng.pareto(1, len(docs)) * 100 + 1).astype(np.int64) if case % 2 else rng.integers(1, 4, len(docs)))[::-1]
            exact[docs] += impacts
            lists.append((docs, impacts))
        floor = int(rng.integers(1, 5))
        docs, scores, read = best_documents(lists, size, k, floor)
        want = [d for d in np.lexsort((np.arange(size), -exact)) if exact[d] >= floor][:k]
        assert docs.tolist() == want and scores.tolist() == exact[want].tolist()
        saved += sum(len(d) for d, _ in lists) - read
    assert saved > 0
    # two lists whose first entries decide need no further reading
    top = np.concatenate(([10**6], np.ones(99_999, np.int64)))
    assert best_documents([(np.arange(100_000), top)] * 2, 100_000, 1)[2] == 256


def test_blocks_and_shards_give_the_same(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "x", "Y"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([5, 63])]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 5, 50, 300]))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)]  # ties
    items = [(i, text(rng.choice([1, 3, 20]))) for i in range(25)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    want = search_by_hand(docs, items, 10)
    for options in ({}, {"block_terms": 30, "shard_postings": 100}, {"shard_postings": 1}):
        assert {tuple(r) for r in search(d, i, k=10, **options).collect()} == want


def test_edge_cases(spark, edge):
    docs = [(r["doc_id"], r["text"]) for r in edge.collect()]
    items = [(1, "Two words"), (1, "THE of"), (2, None), (3, "... ,"), (None, "日本語 á"), (4, "thon"), (5, "nowhere")]
    asked = spark.createDataFrame(items, "item_id int, text string")
    got = search(edge, asked, k=3).collect()
    assert {tuple(r) for r in got} == search_by_hand(docs, [x for x in items if x[1]], 3)
    assert {r["item_id"] for r in got} == {1, 4, None}
    assert search(edge.limit(0), asked).count() == 0 and search(edge, asked.limit(0)).count() == 0
    none = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert search(none, asked).count() == 0
    # names of the operator's own columns, and ids of another type
    odd = spark.createDataFrame([("b", "one two", 1, 2), ("a", "one TWO", 3, 4), (None, "three", 5, 6)], "score string, item string, id int, rank int")
    wanted = spark.createDataFrame([("q", "two!", 1)], "term string, task string, item_id int")
    rows = search(odd, wanted, 5, "score", "item", "term", "task").toDF("item", "rank", "doc", "points").collect()
    assert [(r["item"], r["rank"], r["doc"]) for r in rows] == [("q", 1, "a"), ("q", 2, "b")] and rows[0]["points"] == rows[1]["points"]


def test_query_table(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = search_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 50)
    assert {tuple(r) for r in search(docs, items).collect()} == want
