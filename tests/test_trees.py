"""Tree ensembles against plain loops."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from doclens.operators import classify, trees
from doclens.plans import train


def _rows(n, width, kinds, seed=0, classes=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, kinds, (n, width)).astype(float)
    y = ((x[:, 0] > kinds / 2).astype(int) + (x[:, 1] + x[:, 2] > kinds)) % classes
    y = np.where(rng.random(n) < 0.2, rng.integers(0, classes, n), y)
    return x, y


def _frame(spark, x, y):
    rows = [(i, float(c), v.tolist()) for i, (v, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "doc_id long, label double, v array<double>")
    return df.select("doc_id", "label", array_to_vector("v").alias("features"))


def _plain_tree(x, stats, score, allowed, depth, min_split, min_leaf, at=0):
    """Nested (feature, threshold, left, right) or the leaf's sums, by trying every cut of every feature."""
    total = stats.sum(0)
    best = (1e-12, None)
    if at < depth and len(x) >= max(min_split, 2 * min_leaf):
        for f in range(x.shape[1]):
            kinds = np.unique(x[:, f])
            for a, b in zip(kinds[:-1], kinds[1:]):
                left = x[:, f] <= (a + b) / 2
                one, other = stats[left].sum(0), stats[~left].sum(0)
                if min(left.sum(), (~left).sum()) < min_leaf or not (allowed(one) and allowed(other)):
                    continue
                gain = score(one) + score(other) - score(total)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, (a + b) / 2, left))
    if best[1] is None:
        return total
    f, cut, left = best[1]
    rest = (score, allowed, depth, min_split, min_leaf, at + 1)
    return f, cut, _plain_tree(x[left], stats[left], *rest), _plain_tree(x[~left], stats[~left], *rest)


def _plain_leaf(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _sample(x, y):
    edges = [trees.cut_points(x[:, f], 32) for f in range(x.shape[1])]
    return trees.Sample(trees.binned(x, edges), y, edges, int(y.max()) + 1)


def test_boosted_tree_equals_a_plain_one():
    x, y = _rows(300, 5, 12)
    sample = _sample(x, y)
    scores = np.random.default_rng(1).normal(size=(300, 3))
    params = trees.Boosting(rounds=1, depth=4, row_share=1.0, rate=1.0)
    p = trees.softmax(scores)
    for label in range(3):
        tree, value = params.tree(sample, scores, 0, label)
        stats = np.stack([p[:, label] - (y == label), 2 * p[:, label] * (1 - p[:, label])], 1)
        plain = _plain_tree(x, stats, lambda s: s[0] ** 2 / (s[1] + 1), lambda s: s[1] >= 1, 4, 2, 1)
        own = np.array([_plain_leaf(plain, r) for r in x])
        assert np.allclose(tree.sums[tree.leaves(sample.bins)], own)  # sums of gradients and curvatures
        assert np.allclose(value[tree.leaves(sample.bins)], -own[:, 0] / (own[:, 1] + 1))


def test_forest_tree_without_bootstrap_equals_a_plain_one():
    x, y = _rows(250, 4, 10, seed=3)
    sample = _sample(x, y)
    tree = trees.Forest(depth=None, min_split=5, min_leaf=2, bootstrap=False, column_share=1.0).tree(sample, 0)
    weights = len(y) / (3 * np.bincount(y))
    stats = np.eye(3)[y] * weights[y][:, None]
    plain = _plain_tree(x, stats, lambda s: (s**2).sum() / s.sum(), lambda s: True, 99, 5, 2)
    own = np.array([_plain_leaf(plain, r) for r in x])
    assert np.allclose(tree.sums[tree.leaves(sample.bins)], own)
    assert tree.depth.max() > 5 and (tree.count[tree.feature >= 0] >= 5).all() and (tree.count[tree.feature < 0] >= 2).all()


def test_cut_trees_are_the_smaller_trees():
    x, y = _rows(300, 5, 12, seed=4)
    sample = _sample(x, y)
    whole = trees.Forest(depth=None, min_split=2, min_leaf=2, column_share=1.0).tree(sample, 7)
    small = trees.Forest(depth=3, min_split=20, min_leaf=2, column_share=1.0).tree(sample, 7)
    assert np.allclose(whole.sums[whole.leaves(sample.bins, 3, 20)], small.sums[small.leaves(sample.bins)])


def test_cut_points():
    assert trees.cut_points(np.array([1.0, 3.0, 3.0, 5.0]), 32).tolist() == [2.0, 4.0]
    assert len(trees.cut_points(np.ones(5), 32)) == 0
    edges = trees.cut_points(np.random.default_rng(0).normal(size=5000), 32)
    assert len(edges) == 31 and (np.diff(edges) > 0).all()
    parts = np.bincount(np.searchsorted(edges, np.random.default_rng(0).normal(size=5000)))
    assert parts.min() > 100


def _plain_boosting(x, y, rounds, newton):
    """Softmax boosting with plain trees of all rows and features."""
    classes = int(y.max()) + 1
    scores = np.zeros((len(y), classes)) if newton else np.tile(np.log(np.bincount(y) / len(y)), (len(y), 1))
    for _ in range(rounds):
        p = trees.softmax(scores)
        gained = np.zeros_like(scores)
        for k in range(classes):
            g = p[:, k] - (y == k)
            if newton:
                stats = np.stack([g, 2 * p[:, k] * (1 - p[:, k])], 1)
                plain = _plain_tree(x, stats, lambda s: s[0] ** 2 / (s[1] + 1), lambda s: s[1] >= 1, 2, 2, 1)
                leaf = lambda s: -s[0] / (s[1] + 1)
            else:
                stats = np.stack([g, np.ones(len(g)), np.abs(g) * (1 - np.abs(g))], 1)
                plain = _plain_tree(x, stats, lambda s: s[0] ** 2 / s[1], lambda s: True, 2, 2, 1)
                leaf = lambda s: -(classes - 1) / classes * s[0] / s[2]
            gained[:, k] = [0.1 * leaf(_plain_leaf(plain, r)) for r in x]
        scores = scores + gained
    return trees.softmax(scores)


@pytest.mark.parametrize("model_type, newton", [("xgboost", True), ("gradient_boosting", False)])
def test_boosting_equals_plain_boosting(spark, model_type, newton):
    x, y = _rows(120, 4, 9, seed=6)
    params = {"rounds": 3, "depth": 2, "row_share": 1.0, "column_share": 1.0, "min_split": 2, "min_leaf": 1}
    df = _frame(spark, x, y)
    got = classify.fit_classifier(df.repartition(3), model_type, **params).transform(df).orderBy("doc_id").collect()
    want = _plain_boosting(x, y, 3, newton)
    assert np.allclose([r["probabilities"] for r in got], want)
    assert [r["prediction"] for r in got] == want.argmax(1).tolist()


@pytest.mark.parametrize("model_type, params", [
    ("random_forest", {"trees": 7, "depth": None}), ("xgboost", {"rounds": 3, "depth": 3}), ("gradient_boosting", {"rounds": 3, "depth": 3}),
])
def test_fits_do_not_depend_on_partitions_and_survive_saving(spark, tmp_path, model_type, params):
    x, y = _rows(200, 5, 40, seed=8)
    df = _frame(spark, x, y)
    one, two = (classify.fit_classifier(df.repartition(n), model_type, **params) for n in (1, 4))
    scored = [r["probabilities"] for r in one.transform(df).orderBy("doc_id").collect()]
    assert [r["probabilities"] for r in two.transform(df).orderBy("doc_id").collect()] == scored
    whole = train.DocumentClassifier(train.FeaturePlan(use_structured=False), ["a", "b", "c"], one)
    loaded = train.load_classifier(spark, whole.save(spark, str(tmp_path / "model")))
    assert [r["probabilities"] for r in loaded.fitted.transform(df).orderBy("doc_id").collect()] == scored
    assert all(sum(p) == pytest.approx(1.0) for p in scored)


def test_tuning_scores_equal_separate_fits(spark):
    x, y = _rows(240, 5, 12, seed=9)
    sample = _sample(x, y)
    fold = trees._dealt(sample, 3, 42)
    assert all(abs(np.bincount(fold[y == k], minlength=3) - (y == k).sum() / 3).max() < 1 for k in range(3))
    grid = [{"rounds": n, "depth": d} for n in (2, 4) for d in (1, 3)]
    base = trees.Boosting(row_share=0.9, column_share=0.8)
    got = trees.tune_boosting(spark, sample, grid, base)
    for params, score in zip(grid, got):
        own = []
        for f in range(3):
            fit = trees.fit_boosting(spark, sample.part(fold != f), trees.Boosting(**{**vars(base), **params}))
            own.append(trees.macro_f1(y[fold == f], fit.probabilities(x[fold == f]).argmax(1)))
        assert score == pytest.approx(np.mean(own))
    grid = [{"trees": t, "depth": d, "min_split": s} for t in (5, 12) for d in (2, None) for s in (2, 30)]
    base = trees.Forest(min_leaf=2, column_share=1.0)
    got = trees.tune_forest(spark, sample, grid, base, chunk=4)
    for params, score in zip(grid, got):
        own = []
        for f in range(3):
            fit = trees.fit_forest(spark, sample.part(fold != f), trees.Forest(**{**vars(base), **params}))
            own.append(trees.macro_f1(y[fold == f], fit.probabilities(x[fold == f]).argmax(1)))
        assert score == pytest.approx(np.mean(own), abs=1e-6)


def test_bounds(spark):
    x, y = _rows(30, 3, 5)
    with pytest.raises(ValueError, match="at most 20 rows"):
        trees.sample_of(_frame(spark, x, y), 20)
    constant = classify.fit_classifier(_frame(spark, np.ones((30, 2)), y), "xgboost", rounds=2)
    assert constant.transform(_frame(spark, np.ones((3, 2)), y[:3])).select(F.size("probabilities")).first()[0] == 3


@pytest.mark.parametrize("boosted", [False, True])
def test_workers_get_leaf_values_once(spark, monkeypatch, boosted):
    """A worker held the trees and their joined arrays, with a value of every class for inner nodes, too."""
    x, y = _rows(200, 4, 6)
    sample = trees.sample_of(_frame(spark, x, y), 1000)
    fit, params = (trees.fit_boosting, trees.Boosting(rounds=3)) if boosted else (trees.fit_forest, trees.Forest(trees=5))
    model = fit(spark, sample, params)
    sent = []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or broadcast(self, value))
    got = _frame(spark, x, y).select("doc_id", model.column(spark).alias("p")).orderBy("doc_id").collect()
    leaves = sum(int((t.feature < 0).sum()) for t in model.trees)
    assert sent[0].trees == [] and len(sent[0]._joined[-1]) == leaves < sum(len(t.feature) for t in model.trees)

    def walk(tree, row):
        at = 0
        while tree.feature[at] >= 0:
            at = tree.left[at] + (row[tree.feature[at]] > tree.threshold[at])
        return tree.value[at]

    if boosted:
        raw = np.array([[model.start[c] + sum(walk(t, row)[0] for t in model.trees[c :: model.classes]) for c in range(model.classes)] for row in x])
        want = trees.softmax(raw)
    else:
        want = np.array([np.mean([walk(t, row) for t in model.trees], axis=0) for row in x])
    np.testing.assert_allclose([r["p"] for r in got], want, rtol=1e-12)
