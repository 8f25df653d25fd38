"""Sums of tree levels."""

import tracemalloc

import numpy as np

from doclens.operators import trees


def test_a_tree_of_many_features_takes_little_memory():
    rng = np.random.default_rng(2)
    sample = trees.Sample(rng.integers(0, 32, (5000, 300), np.uint8), rng.integers(0, 3, 5000), [np.arange(31.0)] * 300, 3)
    params, scores = trees.Boosting(rounds=1, depth=3, row_share=1.0), np.zeros((5000, 3))
    tracemalloc.start()
    params.tree(sample, scores, 0, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15e6  # rows x features keys of 8 bytes alone take 12 MB


def test_sums_of_shared_candidates_equal_those_of_single_nodes():
    rng = np.random.default_rng(5)
    bins, stats = rng.integers(0, 8, (400, 6), np.uint8), np.stack([rng.normal(size=400), np.ones(400)], 1)
    rows, node = np.arange(400), rng.integers(0, 3, 400)
    same = np.tile(np.array([1, 4]), (3, 1))
    other = np.vstack([same, [[0, 2]]])  # a node without rows, of other candidates
    one, two = (trees._histograms(bins, stats, rows, node, c, 8) for c in (same, other))
    assert (one[0] == two[0][:3]).all() and (one[1] == two[1][:3]).all()
