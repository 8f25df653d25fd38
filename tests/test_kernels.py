"""Kernel machines against plain solvers."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from doclens.operators import classify, kernels
from doclens.plans import train


def _clouds(n, classes=3, seed=0, noise=0.9):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % classes
    x = np.stack([np.cos(2.1 * y), np.sin(2.1 * y), np.zeros(n)], 1) + noise * rng.normal(size=(n, 3))
    return x, y


def _frame(spark, x, y):
    rows = [(i, float(c), v.tolist()) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "doc_id long, label double, v array<double>").select("doc_id", "label", array_to_vector("v").alias("features"))


def _plain_dual(x, y, bounds, gamma, steps=400):
    """Coordinate pairs in a fixed order, over and over: slow, and simple."""
    k = np.array([[np.exp(-gamma * ((a - b) ** 2).sum()) for b in x] for a in x])
    alpha = np.zeros(len(y))
    f = np.zeros(len(y))  # sum of alpha * y * k
    for _ in range(steps):
        moved = 0.0
        for i in range(len(y)):
            steep = y - f
            j = int(np.argmin(np.where(((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < bounds)), steep, np.inf)))
            if i == j:
                continue
            t = (steep[i] - steep[j]) / max(2 - 2 * k[i, j], 1e-12)
            low = max(-alpha[i] if y[i] > 0 else alpha[i] - bounds[i], alpha[j] - bounds[j] if y[j] > 0 else -alpha[j])
            high = min(bounds[i] - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else bounds[j] - alpha[j])
            t = min(max(t, low), high)
            alpha[i] += y[i] * t
            alpha[j] -= y[j] * t
            f += t * (k[i] - k[j])
            moved = max(moved, abs(t))
        if moved < 1e-7:
            break
    return 0.5 * (alpha * y) @ k @ (alpha * y) - alpha.sum()


@pytest.mark.parametrize("noise, c", [(0.4, 10.0), (0.9, 1.0), (1.5, 10.0)])
def test_dual_objective(noise, c):
    x, y = _clouds(200, 2, noise=noise)
    sign = np.where(y == 0, 1.0, -1.0)
    bounds = c * np.where(y == 0, 1.3, 0.8)
    coefficients, bias = kernels.solve(x, sign, bounds, 0.5, 1e-6, -1)
    alpha = coefficients * sign
    assert (alpha >= 0).all() and (alpha <= bounds).all() and abs(coefficients.sum()) < 1e-9
    value, plain = kernels.objective(coefficients, x, sign, 0.5), _plain_dual(x, sign, bounds, 0.5)
    assert abs(value - plain) < 1e-4 * max(1.0, abs(plain))
    margins = sign * (kernels.kernel(x, x, 0.5) @ coefficients + bias)
    assert (margins[alpha == 0] > 1 - 1e-3).all() and (margins[alpha == bounds] < 1 + 1e-3).all()
    assert np.allclose(margins[(alpha > 0) & (alpha < bounds)], 1, atol=1e-3)


def test_sigmoid_is_the_minimum():
    rng = np.random.default_rng(2)
    m = rng.normal(size=300)
    y = np.where(rng.random(300) < 1 / (1 + np.exp(-2 * m + 0.5)), 1.0, -1.0)
    a, b = kernels.fit_sigmoid(m, y)
    n, k = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n + 1) / (n + 2), 1 / (k + 2))
    loss = lambda a, b: (t * np.logaddexp(0, a * m + b) + (1 - t) * np.logaddexp(0, -a * m - b)).sum()
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-9 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))
    assert a < 0


def test_coupling_of_consistent_pairs_gives_the_probabilities():
    p = np.array([[0.2, 0.5, 0.3], [0.7, 0.1, 0.2]])
    pairwise = p[:, :, None] / (p[:, :, None] + p[:, None, :])
    assert np.allclose(kernels.coupled(pairwise), p)
    r = np.random.default_rng(1).uniform(0.05, 0.95, (1, 4, 4))
    r = np.triu(r[0], 1) + np.tril(1 - r[0].T, -1)
    best = kernels.coupled(r[None])[0]
    cost = lambda q: sum((r[j, i] * q[i] - r[i, j] * q[j]) ** 2 for i in range(4) for j in range(4) if i != j)
    for i in range(4):
        for j in range(4):
            other = best.copy()
            other[i] += 1e-3
            other[j] -= 1e-3
            assert cost(best) <= cost(other) + 1e-12
    assert kernels.coupled(np.zeros((2, 1, 1))).tolist() == [[1.0], [1.0]]


def test_machine(spark, tmp_path):
    x, y = _clouds(240, 3, noise=0.5)
    df = _frame(spark, x, y)
    one, two = (classify.fit_classifier(df.repartition(n), "svm") for n in (1, 4))
    scored = [r["probabilities"] for r in one.transform(df).orderBy("doc_id").collect()]
    assert [r["probabilities"] for r in two.transform(df).orderBy("doc_id").collect()] == scored
    assert all(sum(p) == pytest.approx(1.0) and min(p) >= 0 for p in scored)
    test, labels = _clouds(300, 3, seed=5, noise=0.5)
    rows = one.transform(_frame(spark, test, labels)).collect()
    assert np.mean([r["prediction"] == r["label"] for r in rows]) > 0.85
    # the confident are more often right
    sure = [r for r in rows if max(r["probabilities"]) > 0.9]
    assert len(sure) > 100 and np.mean([r["prediction"] == r["label"] for r in sure]) > 0.93
    # gamma is that of the spread of all values
    assert one.model.gamma == pytest.approx(1 / (3 * x.var()))
    whole = train.DocumentClassifier(train.FeaturePlan(use_structured=False), ["a", "b", "c"], one)
    loaded = train.load_classifier(spark, whole.save(spark, str(tmp_path / "model")))
    assert [r["probabilities"] for r in loaded.fitted.transform(df).orderBy("doc_id").collect()] == scored


def test_classes_without_rows_and_alone(spark):
    x, y = _clouds(60, 2)
    got = classify.fit_classifier(_frame(spark, x, 2 * y), "svm").transform(_frame(spark, x, y)).collect()
    assert all(len(r["probabilities"]) == 3 and r["probabilities"][1] == 0 for r in got)
    alone = classify.fit_classifier(_frame(spark, x, np.ones(60, int)), "svm").transform(_frame(spark, x, y)).first()
    assert alone["probabilities"] == [0.0, 1.0] and alone["prediction"] == 1.0


def test_classes_are_told_by_pairs_won(spark):
    x, y = _clouds(150, 3, noise=0.7)
    machine = kernels.fit_machine(spark, x, y)
    margins = machine.margins(x)
    won = np.zeros((150, 3))
    for at, (one, other) in enumerate(machine.pairs):
        won[np.arange(150), np.where(margins[:, at] > 0, one, other)] += 1
    assert (np.floor(machine.decisions(x) + 0.5) == won).all()
    got = classify.FittedClassifier("svm", machine).transform(_frame(spark, x, y)).orderBy("doc_id").collect()
    assert [r["prediction"] for r in got] == machine.decisions(x).argmax(1).tolist()
    assert np.allclose([r["probabilities"] for r in got], machine.probabilities(x))
