import math

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from doclens.operators import classify
from doclens.plans import train


@pytest.fixture(scope="module")
def clouds(spark):
    """Three separable groups of points."""
    rows = [
        (i, float(i % 3), [math.cos(2.1 * (i % 3)) + 0.1 * math.sin(i), math.sin(2.1 * (i % 3)) + 0.1 * math.cos(i)])
        for i in range(90)
    ]
    df = spark.createDataFrame(rows, "doc_id long, label double, v array<double>")
    return df.select("doc_id", "label", array_to_vector("v").alias("features")).coalesce(1).cache()


def _accuracy(fitted, df):
    return fitted.transform(df).agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0]


@pytest.mark.parametrize(
    "model_type, params",
    [
        ("logistic", {"max_iter": 30}),
        ("random_forest", {"trees": 5, "depth": 4}),
        ("xgboost", {"rounds": 2, "depth": 2}),
        ("svm", {"dims": 32, "max_iter": 10}),
    ],
)
def test_models_separate_the_groups(clouds, model_type, params):
    fitted = classify.fit_classifier(clouds, model_type, **params)
    assert _accuracy(fitted, clouds) > 0.95
    row = classify.predict_category(fitted, clouds, ["a", "b", "c"]).first()
    assert row["category"] in "abc" and 0 < row["confidence"] <= 1
    assert sum(row["probabilities"]) == pytest.approx(1.0)


def test_calibrated_model_round_trip(spark, clouds, tmp_path):
    fitted = classify.calibrate(clouds, "svm", dims=16, max_iter=5)
    assert fitted.calibrated and _accuracy(fitted, clouds) > 0.9
    whole = train.DocumentClassifier(train.FeaturePlan(use_structured=False), ["a", "b", "c"], fitted)
    loaded = train.load_classifier(spark, whole.save(spark, str(tmp_path / "model")))
    before = {r["doc_id"]: r["prediction"] for r in fitted.transform(clouds).collect()}
    after = {r["doc_id"]: r["prediction"] for r in loaded.fitted.transform(clouds).collect()}
    assert before == after


@pytest.mark.parametrize(
    "model_type, grid",
    [
        ("random_forest", [{"trees": 2, "depth": 1}, {"trees": 5, "depth": 4}]),
        ("xgboost", [{"rounds": 1, "depth": 1}, {"rounds": 2, "depth": 2}]),
    ],
)
def test_tuning_tries_every_set(clouds, model_type, grid):
    best, scores = classify.tune(clouds, model_type, grid, min_rows=10)
    assert best in grid and len(scores) == 2
    assert classify.tune(clouds, model_type, grid)[1] == []  # too few rows by default


def test_class_weights(spark):
    rows = spark.createDataFrame([("a",)] * 3 + [("b",)], "label string")
    got = {r["label"]: r["weight"] for r in classify.class_weights(rows).collect()}
    assert got == {"a": pytest.approx(4 / 6), "b": 2.0}
