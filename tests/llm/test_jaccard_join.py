import random
import re

import numpy as np
import pytest
from conftest_llm import components_by_hand
from doclens.llm import jaccard_join
from doclens.llm.components import components
from doclens.llm.jaccard_join import Scheme, jaccard_components, keep_one


def _family(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.4:
            words[at] = f"w{rng.randrange(10**6)}"
        elif kind < 0.7 and len(words) > 6:
            del words[at]
        else:
            words.insert(at, f"v{rng.randrange(10**6)}")
    return " ".join(words)


def _texts(seed):
    rng = random.Random(seed)
    texts = []
    for size in (3, 6, 9, 14, 22, 40, 90, 200, 700):
        for _ in range(2):
            base = [f"b{rng.randrange(10**6)}" for _ in range(size)]
            passage = [f"p{i}" for i in range(12)]
            for _ in range(12):
                texts.append(_family(rng, base + passage * rng.randrange(2), rng.randrange(0, max(2, size // 25 + 2))))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("size", "threshold", "block"), [(4, (85, 100), 2048), (5, (4, 5), 4)])
def test_components_equal_brute_force(spark, monkeypatch, size, threshold, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = _texts(size)
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, size=size, threshold=threshold).collect()}
    assert got == components_by_hand({100 + i: t for i, t in enumerate(texts)}, size, threshold)
    assert len({c for _, c in got.values()}) < len(texts)


def test_edge_rows(spark, edge):
    rows = jaccard_components(edge, size=5).collect()
    assert len(rows) == 12
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got[1][1] == got[2][1] == got[3][1] == 1
    assert got[4] == (0, 4) and got[5] == (0, 5) and got[6] == (0, 6)
    assert got[7] == (1, 7) and got[8] == (1, 7)
    assert got[None][1] is None and got[9][1] == 9
    kept = keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 9, 10]


def test_empty_table(spark, edge):
    assert jaccard_components(edge.limit(0)).count() == 0


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for num, den, size in ((85, 100, 4), (4, 5, 5), (1, 2, 3)):
        scheme = Scheme(num, den, size)
        for n in [*range(1, 30), 60, 150, 400]:
            for _ in range(6):
                a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
                b = set(a.tolist())
                # as different as a link allows
                while True:
                    c = set(b)
                    if rng.random() < 0.5 and len(c) > 1:
                        c.remove(list(c)[int(rng.integers(len(c)))])
                    else:
                        c.add(int(rng.integers(0, 2**63)))
                    shared = len(c & set(a.tolist()))
                    if den * shared < num * len(c | set(a.tolist())):
                        break
                    b = c
                second = np.sort(np.array(sorted(b), np.uint64))
                sigs, owners = scheme.signatures([a, second])
                assert set(sigs[owners == 0].tolist()) & set(sigs[owners == 1].tolist()), (n, len(a), len(second))


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(4)
    scheme = Scheme(85, 100, 4)
    for n in (5, 50, 500):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate((a[n // 10 :], rng.integers(0, 2**63, n // 12, dtype=np.uint64)))
        x, y = scheme.sketch(a), scheme.sketch(b)
        width = min(len(x), len(y))
        apart = np.bitwise_count(jaccard_join._fold(x, width) ^ jaccard_join._fold(y, width)).sum()
        assert apart <= len(set(a.tolist()) ^ set(b.tolist()))


def test_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5000, 5000), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_words_are_split_at_ascii_space_only():
    import pyarrow as pa
    from doclens.llm.words import Words, shingles, text_bytes

    text = "A b c\x0bd  É　x"
    words = Words(*text_bytes(pa.array([text, None, "", "q"])), lower=True)
    assert words.counts.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", text)), 0, 0, 1]
    assert [len(s) for s in shingles(words.hashes(), words.counts, 5)] == [1, 0, 0, 1]
