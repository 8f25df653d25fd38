import random
from collections import Counter

import pytest
from doclens.functions import text as tx
from doclens.operators import vectors
from pyspark.sql import functions as F


def _texts():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(40)], k=rng.randrange(30))) for _ in range(60)]
    return [*texts, None, "", "the of and", "lone", "w0 w0 w0", "w0 w1 w0 w1 w0 w1", texts[0], texts[0]]


def _by_hand(texts, max_terms):
    cf, df = Counter(), Counter()
    for text in texts:
        tokens = [t for t in (text or "").split() if t not in tx.default_stop_words() and len(t) > 1]
        terms = tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]
        cf.update(terms)
        df.update(set(terms))
    kept = [t for t in cf if 2 <= df[t] <= 0.95 * len(texts)]
    return sorted(sorted(kept, key=lambda t: (-cf[t], t))[:max_terms])


@pytest.mark.parametrize("max_terms", [1, 5, 12, 41, 60, 1000, 8000])
def test_vocabulary_equals_plain_counts(spark, max_terms):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3)
    assert vectors.fit_tfidf(docs, "text", max_terms=max_terms).terms == _by_hand(texts, max_terms)


def test_few_terms_count_no_bigram_of_rare_tokens(spark, monkeypatch):
    counted = []
    count = vectors._term_counts
    monkeypatch.setattr(vectors, "_term_counts", lambda df, terms: counted.append(df.select(F.sum(F.size(terms))).first()[0]) or count(df, terms))
    docs = spark.createDataFrame([(" ".join(f"c{j % 4}" for j in range(20)) + f" x{i} y{i} z{i}",) for i in range(30)], "text string")
    model = vectors.fit_tfidf(docs, "text", max_df=1.0, max_terms=3)
    assert model.terms == ["c0", "c0 c1", "c1"]  # as frequent as each other, so by name
    assert counted == [30 * 23, 30 * 19]  # all tokens, then bigrams of common ones only
