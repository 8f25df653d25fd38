"""Calibration curves and row numbers against plain loops."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from doclens.operators import classify, numbering, sampling, vectors


def _plain_isotonic(x, t, w):
    """Minimum over ends of the maximum over starts of the weighted means."""
    n = len(x)
    mean = lambda i, j: np.average(t[i : j + 1], weights=w[i : j + 1])
    return [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]


def test_pooled_blocks_are_the_isotonic_fit():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 25))
        x, w = np.sort(rng.random(n)), rng.integers(1, 5, n).astype(float)
        hits = np.array([rng.binomial(int(k), 0.5) for k in w], float)
        curve = classify.pooled(x, hits, w)
        assert np.allclose(curve.values(x), _plain_isotonic(x, hits / w, w))
        assert (np.diff(curve.y) >= -1e-12).all() and curve.values(np.array([-9.0, 9.0])).tolist() == [curve.y[0], curve.y[-1]]


def _frame(spark, n=150, classes=3):
    rng = np.random.default_rng(1)
    rows = [(i, float(i % classes), [float(i % classes) + 0.8 * rng.normal(), rng.normal()]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, label double, v array<double>").select("doc_id", "label", array_to_vector("v").alias("features"))


@pytest.mark.parametrize("classes", [2, 3])
def test_calibration_equals_a_plain_loop(spark, classes):
    df = _frame(spark, classes=classes)
    fitted = classify.calibrate(df, "logistic", max_iter=50)
    folds = classify.with_folds(df, "doc_id").select("doc_id", "_fold")
    want = 0
    for f, (base, curves) in enumerate(fitted.folds):
        own = base.transform(df).join(folds, "doc_id").orderBy("doc_id").collect()
        scores, held = np.array([r["scores"] for r in own]), np.array([r["_fold"] == f for r in own])
        labels = np.array([r["label"] for r in own])
        p = np.zeros_like(scores)
        for c, curve in curves:
            order = np.argsort(scores[held, c])
            x, t = scores[held, c][order], (labels[held] == c).astype(float)[order]
            assert np.allclose(curve.values(x), _plain_isotonic(x, t, np.ones(len(x))), atol=1e-9)
            p[:, c] = curve.values(scores[:, c])
        if classes == 2:
            assert [c for c, _ in curves] == [1]
            p[:, 0] = 1 - p[:, 1]
        total = p.sum(1, keepdims=True)
        want = want + np.where(total > 0, p / np.where(total > 0, total, 1), 1 / classes) / 3
    got = [r["probabilities"] for r in fitted.transform(df).orderBy("doc_id").collect()]
    assert np.allclose(got, want, atol=1e-9)


def test_curves_of_all_folds_take_one_shuffled_fit(spark, monkeypatch):
    calls = []
    inner = classify.fit_curves
    monkeypatch.setattr(classify, "fit_curves", lambda scored, classes: calls.append(scored.select("fold").distinct().count()) or inner(scored, classes))
    classify.calibrate(_frame(spark), "logistic", max_iter=5)
    assert calls == [3]


@pytest.mark.parametrize("rows", [50, 300_000])
def test_numbers(spark, rows):
    df = spark.range(rows).select(F.md5(F.col("id").cast("string")).alias("name"), (F.col("id") % 7).alias("k"))
    out = numbering.number_rows(df, ["k", "name"])
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.agg(F.count_distinct("code"), F.min("code"), F.max("code")).first()
    assert tuple(got) == (rows, 0, rows - 1)
    wrong = out.alias("a").join(out.alias("b"), F.col("a.code") + 1 == F.col("b.code")).filter("struct(a.k, a.name) >= struct(b.k, b.name)")
    assert wrong.count() == 0


def test_numbers_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "x string")
    assert {r["x"]: r["code"] for r in numbering.number_rows(df, ["x"]).collect()} == {None: 0, "a": 1, "b": 2}
    assert numbering.number_rows(df.limit(0), ["x"]).count() == 0


def test_a_million_classes_and_no_window(spark):
    df = spark.range(1_000_000).select("id", F.concat(F.lit("c"), "id").alias("category"))
    codes = vectors.label_codes(df)
    assert "Window" not in codes._jdf.queryExecution().executedPlan().toString()
    facts = codes.agg(F.count(F.lit(1)), F.count_distinct("code"), F.max("code")).first()
    assert tuple(facts) == (1_000_000, 1_000_000, 999_999)
    assert codes.filter("code = 0").first()["category"] == "c0"


def test_split_shares_the_remainder_in_order(spark):
    rows = [(i, "abc"[i % 3]) for i in range(31)]
    split = sampling.train_test_split(spark.createDataFrame(rows, "doc_id long, category string"), test_size=0.2)
    got = {r["category"]: r["n"] for r in split.filter("is_test").groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()}
    # 7 of 31: shares 11 * 7 / 31 = 2 + 15/31, 10 * 7 / 31 = 2 + 8/31 each
    assert got == {"a": 3, "b": 2, "c": 2}
