"""Fits of more rows than a task takes at once: they take all rows, and give what fits in memory give."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window
from pyspark.sql import functions as F

from doclens.catalog import classification
from doclens.operators import blocks, classify, kernels, sampling, trees
from doclens.plans import train


def _rows(n=400, classes=3, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    return np.round(rng.normal(size=(n, 11)) + y[:, None] * np.linspace(0, 1, 11), 1), y


def _frame(spark, x, y, parts=3):
    rows = [(i, float(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "doc_id long, label double, v array<double>").repartition(parts)
    return df.select("doc_id", "label", array_to_vector("v").alias("features"))


def _probabilities(fitted, df):
    return np.array([r["probabilities"] for r in fitted.transform(df).orderBy("doc_id").collect()])


@pytest.fixture
def small(monkeypatch):
    """Rows of a fit lie in several files."""
    monkeypatch.setattr(classify, "LOCAL_ROWS", 50)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 64)


def test_stored_rows_are_the_rows(spark, small):
    x, y = _rows()
    values, labels = blocks.stored(_frame(spark, x, y))
    again = blocks.stored(_frame(spark, x, y, parts=7))
    assert len(values.names) > 2 and (labels == again[1]).all()
    every = np.arange(400)
    assert (values.take(every) == again[0].take(every)).all()
    assert sorted(map(tuple, np.c_[values.take(every), labels])) == sorted(map(tuple, np.c_[x, y]))
    some, columns = np.array([3, 64, 65, 399]), np.array([1, 0, 2, 10])
    assert (values.take(some, columns) == values.take(every)[some, columns]).all()
    part = values.part(np.arange(400) % 3 == 0)
    assert part.shape == (134, 11) and (part.take(np.array([1, 133])) == values.take(np.array([3, 399]))).all()
    by_label = blocks.stored(_frame(spark, x, y), by_label=True)[1]
    assert (np.diff(by_label) >= 0).all() and (np.bincount(by_label) == np.bincount(y)).all()


@pytest.mark.parametrize(
    "model_type, params",
    [
        ("xgboost", {"rounds": 3, "depth": 4, "row_share": 1.0, "column_share": 1.0}),
        ("gradient_boosting", {"rounds": 3, "depth": 4, "row_share": 1.0}),
        ("random_forest", {"trees": 2, "bootstrap": False, "column_share": 1.0}),
    ],
)
def test_trees_take_all_rows(spark, small, monkeypatch, tmp_path, model_type, params):
    x, y = _rows()
    df = _frame(spark, x, y)
    stored = classify.fit_classifier(df, model_type, **params)
    monkeypatch.setattr(classify, "LOCAL_ROWS", 400)
    want = _probabilities(classify.fit_classifier(df, model_type, **params), df)
    assert np.allclose(_probabilities(stored, df), want)
    # trees of many nodes are files
    monkeypatch.setattr(trees, "_KEPT_NODES", 0)
    stored.model.save(spark, f"{tmp_path}/model")
    loaded = trees.Ensemble.load(spark, f"{tmp_path}/model", 3, stored.model.start, stored.model.boosted)
    assert loaded.trees == [] and np.allclose(_probabilities(classify.FittedClassifier(model_type, loaded), df), want)
    loaded.save(spark, f"{tmp_path}/again")
    again = trees.Ensemble.load(spark, f"{tmp_path}/again", 3, stored.model.start, stored.model.boosted)
    assert np.allclose(again.raw(x), loaded.raw(x))


def test_drawn_rows_and_columns(spark, small):
    x, y = _rows()
    df = _frame(spark, x, y)
    for model_type, params in (("xgboost", {"rounds": 2}), ("random_forest", {"trees": 5})):
        one, two = (classify.fit_classifier(_frame(spark, x, y, parts), model_type, **params) for parts in (2, 5))
        scored = _probabilities(one, df)
        assert (scored == _probabilities(two, df)).all() and np.mean(scored.argmax(1) == y) > 0.8


def test_tuning_takes_all_rows(spark, small):
    x, y = _rows()
    df = _frame(spark, x, y)
    for model_type, grid in (("xgboost", [{"rounds": n, "depth": d} for n in (1, 3) for d in (2, 4)]), ("random_forest", [{"trees": t, "depth": d} for t in (3, 12) for d in (3, None)])):
        _, scores = classify.tune(df, model_type, grid)
        sample = trees.stored_sample(df)
        kept = trees.Sample(sample.bins.take(np.arange(400)), sample.labels, sample.edges, sample.classes)
        search = trees.tune_forest if model_type == "random_forest" else trees.tune_boosting
        assert np.allclose([s for _, s in scores], search(spark, kept, grid, classify.tree_params(model_type)))


def test_kernel_machine_takes_all_rows(spark, small, monkeypatch):
    x, y = _rows()
    df = _frame(spark, x, y)
    stored = classify.fit_classifier(df, "svm", tol=1e-6, max_iter=-1)
    assert stored.model.classes == 3 and len(stored.model.rows) > 50
    monkeypatch.setattr(classify, "LOCAL_ROWS", 400)
    plain = classify.fit_classifier(df, "svm", tol=1e-6, max_iter=-1)
    assert stored.model.gamma == pytest.approx(plain.model.gamma)
    assert np.allclose(stored.model.margins(x), plain.model.margins(x), atol=1e-3)
    assert np.abs(stored.model.probabilities(x) - plain.model.probabilities(x)).max() < 0.1  # the folds are others


def test_a_fold_is_a_problem_without_its_rows(spark, small):
    x, y = _rows(200, 2)
    values, labels = blocks.stored(_frame(spark, x, y), by_label=True)
    ends = np.cumsum([0, *np.bincount(labels)]).tolist()
    rows = kernels.PairRows(values, [(ends[0], ends[1]), (ends[1], ends[2])])
    own, side = values.take(rows.rows), np.where(labels == 0, 1.0, -1.0)
    assert np.allclose(rows.kernel_row(7, 0.1), kernels.kernel(own[7:8], own, 0.1)[0])
    kept = np.arange(200) % 5 != 0
    bounds = np.full(200, 10.0)
    w, b = kernels.solve(own[kept], side[kept], bounds[kept], 0.1, 1e-6, -1)
    weights, bias, margins = kernels.solved(rows, side, np.where(kept, bounds, 0.0), 0.1, 1e-6, -1)
    assert (weights[~kept] == 0).all() and bias == pytest.approx(b, abs=1e-4)
    assert np.allclose(margins, kernels.kernel(own, own[kept], 0.1) @ w + b, atol=1e-3)


def test_folds_equal_a_ranking_of_whole_classes(spark):
    rows = [(None if i % 50 == 3 else i % 300, None if i % 40 == 1 else float(i % 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, label double")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(sampling.hash_order("doc_id"), "doc_id"))
    count = lambda d: {tuple(r) for r in d.groupBy("doc_id", "label", "_fold").count().collect()}
    assert count(classify.with_folds(df, "doc_id")) == count(df.withColumn("_fold", ((rank - 1) % 3).cast("int")))


def test_no_fit_sees_a_sample(spark, monkeypatch):
    """Fits saw at most 20,000 rows."""
    n = 20_500
    rows = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("double").alias("label"), array_to_vector(F.array(F.col("id") % 3 * 1.0, F.rand(1))).alias("features"))
    seen = []
    fit = classify.fit_classifier
    monkeypatch.setattr(classify, "fit_classifier", lambda df, *a, **b: seen.append(df.count()) or fit(df, *a, **b))
    data = train.TrainingData(train.FeaturePlan(), ["a", "b", "c"], rows.withColumn("is_test", F.col("doc_id") >= n - 10), "doc_id", {"holdout_size": 0})
    train.fit_prepared(data, calibrate=False, tune=False, max_iter=2)
    monkeypatch.setattr(classification, "_embedded", lambda spark, d: data.rows.withColumnRenamed("doc_id", "vec_id"))
    classification._fit_and_score(spark, "", "logistic")
    monkeypatch.setattr(classify, "tune", lambda df, *a, **b: seen.append(df.count()) or ({}, [({}, 1.0)]))
    classification._tuned(spark, "", "xgboost")
    assert seen == [n - 10] * 3


def test_larger_fits_take_all_cores(spark):
    """50,000 rows were fitted and scored in 3 tasks, however many cores there are."""
    assert classify.fit_tasks(spark, 0) == classify.fit_tasks(spark, 20_000) == 1
    assert classify.fit_tasks(spark, 50_000) == spark.sparkContext.defaultParallelism
    assert classify.fit_tasks(spark, 2_000_000) == 100
