"""The block index and the nearest-neighbour classifier against plain loops."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from doclens.operators import classify, nearest
from doclens.plans import train
from doclens.session import shared_folder


def _clusters(n, seed=0, dim=3, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).uniform(-10, 10, (12, dim))
    which = rng.integers(0, 12, n)
    return centres[which] + spread * rng.normal(size=(n, dim)), which % 3


def _items(spark, x, y):
    return spark.createDataFrame([(i, int(c), v.tolist()) for i, (v, c) in enumerate(zip(x, y))], "item_id long, label int, vector array<double>")


def _frame(spark, x, y):
    rows = [(i, float(c), v.tolist()) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "doc_id long, label double, v array<double>").select("doc_id", "label", array_to_vector("v").alias("features"))


@pytest.mark.parametrize("block_rows", [10_000, 40, 7])
def test_index_finds_the_nearest_and_reads_few_blocks(spark, block_rows):
    x, y = _clusters(600)
    x[300:360] = x[5]  # many at one place
    index = nearest.build_index(_items(spark, x, y).repartition(3), shared_folder(spark, "index"), 3, block_rows)
    queries = np.concatenate((_clusters(50, seed=1)[0], x[:10], np.random.default_rng(3).uniform(-12, 12, (20, 3))))
    found, compared = index.near(queries, 7)
    rows = found.to_pylist()
    for q, v in enumerate(queries):
        gaps = np.sqrt(((x - v) ** 2).sum(1))
        want = sorted(zip(gaps, range(600)))[:7]
        got = [(r["distance"], r["item_id"]) for r in rows if r["query"] == q]
        assert np.allclose([g for g, _ in got], [g for g, _ in want])
        assert [i for _, i in got] == [i for _, i in want]
    if block_rows == 10_000:
        assert index.blocks == 1
    else:
        assert index.blocks >= 600 // block_rows and compared[:60].mean() < 0.5 * index.blocks
    assert sorted((r["item_id"], r["label"], r["vector"]) for r in index.items(spark).collect()) == [(i, int(c), v.tolist()) for i, (v, c) in enumerate(zip(x, y))]


def test_empty_index(spark):
    index = nearest.build_index(_items(spark, np.zeros((0, 3)), []), shared_folder(spark, "index"), 3)
    assert index.blocks == 0 and index.near(np.zeros((2, 3)), 3)[0].num_rows == 0 and index.items(spark).count() == 0


def test_votes_equal_a_plain_loop(spark, tmp_path):
    x, y = _clusters(300, spread=1.5)
    x[7] = x[8]
    y[7], y[8] = 0, 1
    fitted = classify.fit_classifier(_frame(spark, x, y), "knn", block_rows=50)
    test, labels = _clusters(60, seed=2, spread=1.5)
    test[0] = x[7]
    df = _frame(spark, test, labels)
    got = [r["probabilities"] for r in fitted.transform(df).orderBy("doc_id").collect()]
    for v, p in zip(test, got):
        gaps = np.sqrt(((x - v) ** 2).sum(1))
        near = np.argsort(gaps, kind="stable")[:7]
        votes = (gaps[near] == 0).astype(float) if (gaps[near] == 0).any() else 1 / gaps[near]
        assert np.allclose(p, np.bincount(y[near], votes, 3) / votes.sum())
    assert got[0] == [0.5, 0.5, 0.0]
    whole = train.DocumentClassifier(train.FeaturePlan(use_structured=False), ["a", "b", "c"], fitted)
    loaded = train.load_classifier(spark, whole.save(spark, str(tmp_path / "model")))
    assert [r["probabilities"] for r in loaded.fitted.transform(df).orderBy("doc_id").collect()] == got


def test_calibrated(spark):
    x, y = _clusters(90)
    fitted = classify.calibrate(_frame(spark, x, y), "knn")
    rows = fitted.transform(_frame(spark, x, y)).collect()
    assert fitted.calibrated and np.mean([r["prediction"] == r["label"] for r in rows]) > 0.9
