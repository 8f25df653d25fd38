"""Tree ensembles on binned features: boosting of all classes at once, and forests.

Features are cut into bins at quantiles once, one byte per value. Up to ``classify.LOCAL_ROWS`` rows reach the driver and
the tasks as a broadcast; more stay in block files of the shared folder, which tasks map into memory, and so do the
scores of boosted rows. A round of boosting is one job: every class's tree is
grown by a task, from the gradients and curvatures of the softmax loss that follow from the scores of the rounds before.
A forest is one job, each tree a row. Trees grow level by level; a level takes sums per node, feature and bin, and
the best cut of every node from them. Tuning runs one job for all parameter sets and folds. A task that grows a tree
holds its rows' numbers, some 100 bytes a row, whatever the features.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.files import make_folder, opened
from doclens.operators import blocks
from doclens.operators.blocks import Blocks, take
from doclens.session import DEFAULT_SEED, shared_folder, written

MAX_BINS = 32
_CHUNK = 1 << 16  # rows whose values are held at once
_COLUMNS = 8  # features that a task cuts into bins
_KEPT_NODES = 1 << 20  # nodes of an ensemble that a worker holds; more are read from files
_CELLS = 1 << 22  # sums held at once while the cuts of a level are sought
_NO_LIMIT = 1 << 30


# -- fit samples ------------------------------------------------------------------------


@dataclass
class Sample:
    """The binned rows of a fit in an order of their own contents, so that partitions don't matter."""

    bins: np.ndarray | Blocks  # rows x features
    labels: np.ndarray
    edges: list[np.ndarray]  # value <= edges[f][b] is bin <= b
    classes: int

    @property
    def width(self) -> int:
        return max((len(e) for e in self.edges), default=0) + 1

    def part(self, rows: np.ndarray) -> Sample:
        own = self.bins.part(rows) if isinstance(self.bins, Blocks) else self.bins[rows]
        return Sample(own, self.labels[rows], self.edges, self.classes)

    def delete(self) -> None:
        """What the sample has in files goes; its fits stay."""
        if isinstance(self.bins, Blocks):
            self.bins.delete()


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """Middles between neighbouring values, of all when they are few, else at quantiles of the rows."""
    kinds, counts = np.unique(values, return_counts=True)
    if len(kinds) > bins:
        upto = np.cumsum(counts)
        wanted = np.searchsorted(upto, np.arange(1, bins) * (len(values) / bins))
        places = np.unique(np.minimum(wanted, len(kinds) - 2))
    else:
        places = np.arange(len(kinds) - 1)
    return (kinds[places] + kinds[places + 1]) / 2


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(values.shape, np.uint8)
    for f, edge in enumerate(edges):
        out[:, f] = np.searchsorted(edge, values[:, f], "left")
    return out


def sample_of(df: DataFrame, max_rows: int, bins: int = MAX_BINS) -> Sample:
    """The rows of a fit on the driver; more than ``max_rows`` are an error, ``stored_sample`` takes any number."""
    rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y")).limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        raise ValueError(f"a fit on the driver takes at most {max_rows} rows: take stored_sample")
    labels = rows.column("y").to_numpy()
    values = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(labels), -1) if len(labels) else np.zeros((0, 0))
    order = np.lexsort((labels, [zlib.crc32(v.tobytes()) for v in values]))
    values, labels = values[order], labels[order].astype(np.int64)
    edges = [cut_points(values[:, f], bins) for f in range(values.shape[1])]
    return Sample(binned(values, edges), labels, edges, int(labels.max()) + 1 if len(labels) else 0)


def stored_sample(df: DataFrame, bins: int = MAX_BINS) -> Sample:
    """All rows of ``df``, their bins in block files; edges are exact, each from all values of its feature."""
    spark = df.sparkSession
    values, labels = blocks.stored(df)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column("id").to_pylist():
                first, last = at * _COLUMNS, min((at + 1) * _COLUMNS, values.width)
                columns = np.empty((last - first, len(values)))
                for row, block in values.pieces(0, len(values)):
                    columns[:, row : row + len(block)] = block[:, first:last].T
                found = [cut_points(column, bins).tolist() for column in columns]
                yield pa.RecordBatch.from_arrays([pa.array(range(first, last), pa.int64()), pa.array(found, pa.list_(pa.float64()))], ["feature", "edges"])

    units = -(-values.width // _COLUMNS)
    found = spark.range(0, units, 1, units).mapInArrow(cut, "feature long, edges array<double>").toArrow().sort_by("feature")
    edges = [np.array(e) for e in found.column("edges").to_pylist()]
    cells = values.mapped_to(spark, "bins", "uint8", lambda block: binned(block, edges))
    values.delete()
    return Sample(cells, labels, edges, int(labels.max()) + 1)


# -- one tree ---------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in the order of their making; a leaf has feature -1. ``sums`` and ``count`` are of the rows it was grown on."""

    feature: np.ndarray
    cut: np.ndarray  # bin: smaller ones and itself go left
    left: np.ndarray  # the right child is the next one
    sums: np.ndarray
    count: np.ndarray
    depth: np.ndarray

    def leaves(self, bins: np.ndarray | Blocks, max_depth: int = _NO_LIMIT, min_split: int = 0) -> np.ndarray:
        """The node at which each row ends; a limit below the tree's own cuts it."""
        node = np.zeros(len(bins), np.int64)
        inner = (self.feature >= 0) & (self.depth < max_depth) & (self.count >= min_split)
        while True:
            going = np.flatnonzero(inner[node])
            if not len(going):
                return node
            at = node[going]
            node[going] = self.left[at] + (take(bins, going, self.feature[at]) > self.cut[at])


Score = Callable[[np.ndarray], np.ndarray]


def grow(
    bins: np.ndarray | Blocks,
    stats: np.ndarray,
    inside: np.ndarray,
    width: int,
    score: Score,
    features: Callable[[int], np.ndarray],
    allowed: Callable[[np.ndarray], np.ndarray] | None = None,
    max_depth: int = _NO_LIMIT,
    min_split: int = 2,
    min_leaf: int = 1,
    scored: int | None = None,
) -> Tree:
    """A tree whose cuts gain most in ``score`` of the summed ``stats`` (rows x numbers) of both sides over that of the node.

    ``inside`` marks the rows that count; ``features(nodes)`` gives the candidate features of as many nodes;
    ``allowed`` tells which sums a child may have; both read the first ``scored`` numbers only. Equal gains go to the candidate that comes first.
    """
    rows = np.flatnonzero(inside)
    at = np.zeros(len(rows), np.int64)  # node of each row
    feature, cut, left = [-1], [0], [0]
    sums, count, depth = [stats[rows].sum(0)], [len(rows)], [0]
    active = np.array([0])
    level = 0
    while len(active) and level < max_depth:
        active = active[np.array([count[a] for a in active]) >= max(min_split, 2 * min_leaf)]
        if not len(active):
            break
        place = np.full(len(feature), -1)
        place[active] = np.arange(len(active))
        kept = place[at] >= 0
        rows, at = rows[kept], at[kept]
        own = place[at]
        candidates = features(len(active))
        best_gain, best = np.zeros(len(active)), np.zeros((len(active), 2), np.int64)
        group = max(1, _CELLS // (candidates.shape[1] * width * (stats.shape[1] + 1)))
        for start in range(0, len(active), group):
            some = candidates[start : start + group]
            mine = np.flatnonzero((own >= start) & (own < start + group))
            gains = _gains(bins, stats[:, :scored], rows[mine], own[mine] - start, some, width, score, allowed, min_leaf)
            flat = gains.reshape(len(some), -1)
            most = flat.max(1, keepdims=True)
            top = (flat >= most - 1e-9 * np.where(np.isfinite(most), np.abs(most), 0.0)).argmax(1)  # sums round: nearly equal is equal
            best_gain[start : start + group] = flat[np.arange(len(some)), top]
            best[start : start + group, 0] = some[np.arange(len(some)), top // (width - 1)] if width > 1 else 0
            best[start : start + group, 1] = top % max(width - 1, 1)
        split = np.flatnonzero(best_gain > 1e-12)
        if not len(split):
            break
        children = np.full(len(active), -1)
        for number, a in enumerate(split):
            children[a] = len(feature)
            node = int(active[a])
            feature[node], cut[node], left[node] = int(best[a, 0]), int(best[a, 1]), len(feature)
            feature += [-1, -1]
            cut += [0, 0]
            left += [0, 0]
            depth += [level + 1, level + 1]
        moving = children[own] >= 0
        rows, own = rows[moving], own[moving]
        at = children[own] + (take(bins, rows, best[own, 0]) > best[own, 1])
        new = len(feature) - len(sums)
        first = len(sums)
        sums += list(np.stack([np.bincount(at - first, stats[rows, c], new) for c in range(stats.shape[1])], 1))
        count += np.bincount(at - first, minlength=new).tolist()
        active = np.arange(first, len(feature))
        level += 1
    return Tree(np.array(feature), np.array(cut), np.array(left), np.array(sums), np.array(count), np.array(depth))


def _histograms(bins, stats, rows, node, candidates, width) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of rows of each (node, candidate, bin).

    Candidates that all nodes share are counted one by one, from arrays that stay in the processor's cache. Either way a
    cell's rows are added in their order, so the sums are the same to the last bit. Rows are taken in chunks.
    """
    nodes, m = candidates.shape
    counted = [bool((stats[rows, c] == 1.0).all()) for c in range(stats.shape[1])]  # a sum of ones is the number of rows
    shared = (candidates == candidates[0]).all()
    sums, counts = np.zeros((nodes, m, width, len(counted))), np.zeros((nodes, m, width), np.int64)
    for start in range(0, len(rows), _CHUNK):
        some, at = rows[start : start + _CHUNK], node[start : start + _CHUNK]
        own = [np.ascontiguousarray(stats[some, c]) for c in range(len(counted))]
        if shared:
            first, columns = at * width, np.ascontiguousarray(take(bins, some).T)
            for slot, feature in enumerate(candidates[0].tolist()):
                key = first + columns[feature]
                counts[:, slot] += (number := np.bincount(key, minlength=nodes * width).reshape(nodes, width))
                for c, values in enumerate(own):
                    sums[:, slot, :, c] += number if counted[c] else np.bincount(key, values, nodes * width).reshape(nodes, width)
        else:
            key = ((at[:, None] * m + np.arange(m)) * width + take(bins, some, candidates[at])).ravel()
            size, shape = nodes * m * width, (nodes, m, width)
            counts += np.bincount(key, minlength=size).reshape(shape)
            for c, values in enumerate(own):
                sums[..., c] += np.bincount(key, np.repeat(values, m), size).reshape(shape)
    return sums, counts


def _gains(bins, stats, rows, node, candidates, width, score, allowed, min_leaf) -> np.ndarray:
    """Gain of each (node, candidate, cut); minus infinity where a side may not be."""
    nodes, m = candidates.shape
    if width < 2:
        return np.full((nodes, 1, 1), -np.inf)
    sums, counts = _histograms(bins, stats, rows, node, candidates, width)
    upto, below = sums.cumsum(2), counts.cumsum(2)
    whole, n = upto[:, :, -1:], below[:, :, -1:]
    one, other = upto[:, :, :-1], whole - upto[:, :, :-1]
    fine = (below[:, :, :-1] >= min_leaf) & (n - below[:, :, :-1] >= min_leaf)
    if allowed is not None:
        fine &= allowed(one) & allowed(other)
    with np.errstate(invalid="ignore", divide="ignore"):
        gains = score(one) + score(other) - score(whole)
    return np.where(fine, gains, -np.inf)


# -- boosting ---------------------------------------------------------------------------


def softmax(scores: np.ndarray) -> np.ndarray:
    grown = np.exp(scores - scores.max(1, keepdims=True))
    return grown / grown.sum(1, keepdims=True)


def _shares(scores: np.ndarray | list[np.ndarray], label: int) -> np.ndarray:
    """The probability of ``label`` in each row of the scores, which are a matrix or a list of its columns."""
    rows = len(scores) if isinstance(scores, np.ndarray) else len(scores[0])
    out = np.empty(rows)
    for at in range(0, rows, _CHUNK):
        some = slice(at, at + _CHUNK)
        out[some] = softmax(scores[some] if isinstance(scores, np.ndarray) else np.stack([s[some] for s in scores], 1))[:, label]
    return out


@dataclass
class Boosting:
    """Parameters of softmax boosting.

    ``newton``: cuts and leaves from gradients and curvatures with an L2 penalty (``penalty``) and a least curvature of a
    child. Otherwise cuts minimise the squared error of the residuals, and leaves are refitted with one Newton step.
    """

    rounds: int = 200
    rate: float = 0.1
    depth: int = 7
    row_share: float = 0.8
    column_share: float = 1.0
    newton: bool = True
    penalty: float = 1.0
    least_curvature: float = 1.0
    min_split: int = 2
    min_leaf: int = 1
    seed: int = DEFAULT_SEED

    def start(self, sample: Sample) -> np.ndarray:
        """Scores before the first round: 0, or the logarithm of each class's share."""
        if self.newton:
            return np.zeros(sample.classes)
        counts = np.bincount(sample.labels, minlength=sample.classes)
        return np.log(np.maximum(counts, 1e-9) / max(len(sample.labels), 1))

    def tree(self, sample: Sample, scores: np.ndarray | list[np.ndarray], number: int, label: int) -> tuple[Tree, np.ndarray]:
        """The tree of a class in a round, and the value of each node, times the rate."""
        n, width = sample.bins.shape
        drawn = np.random.default_rng([self.seed, number])  # one draw of rows for all classes of a round
        inside = drawn.random(n) < self.row_share if self.row_share < 1 else np.ones(n, bool)
        own = np.random.default_rng([self.seed, number, label])
        m = max(1, round(self.column_share * width))
        columns = np.sort(own.permutation(width)[:m]) if m < width else np.arange(width)
        p = _shares(scores, label)
        gradient = p - (sample.labels == label)
        if self.newton:
            curvature = np.maximum(2.0 * p * (1.0 - p), 1e-16)
            stats = np.stack([gradient, curvature], 1)
            score = lambda s: s[..., 0] ** 2 / (s[..., 1] + self.penalty)
            allowed = lambda s: s[..., 1] >= self.least_curvature
        else:
            size = np.abs(gradient)
            stats = np.stack([gradient, np.ones(n), size * (1.0 - size)], 1)
            score = lambda s: s[..., 0] ** 2 / s[..., 1]
            allowed = None
        tree = grow(
            sample.bins, stats, inside, sample.width, score, lambda nodes: np.tile(columns, (nodes, 1)), allowed,
            self.depth, self.min_split, self.min_leaf, scored=2,
        )
        if self.newton:
            value = -tree.sums[:, 0] / (tree.sums[:, 1] + self.penalty)
        else:
            shrunk = (sample.classes - 1) / sample.classes if sample.classes > 1 else 1.0
            value = np.where(tree.sums[:, 2] > 1e-150, -shrunk * tree.sums[:, 0] / np.maximum(tree.sums[:, 2], 1e-150), 0.0)
        return tree, self.rate * value


def fit_boosting(spark: SparkSession, sample: Sample, params: Boosting) -> Ensemble:
    """One job per round; a task grows the tree of a class. Scores of the sample (rows x classes) go along."""
    if isinstance(sample.bins, Blocks):
        return _fit_boosting_stored(spark, sample, params)
    context = spark.sparkContext
    start = params.start(sample)
    scores = np.tile(start, (len(sample.labels), 1))
    shared = context.broadcast(sample)
    classes = spark.range(0, sample.classes, 1, max(1, min(sample.classes, context.defaultParallelism)))
    made: list[_Nodes] = []
    for number in range(params.rounds):
        state = context.broadcast(scores)

        def one_round(batches: Iterator[pa.RecordBatch], number=number, state=state) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                for label in batch.column("id").to_pylist():
                    tree, value = params.tree(known, state.value, number, label)
                    gained = value[tree.leaves(known.bins)]
                    yield pa.RecordBatch.from_pylist([{"label": label, **_row(_nodes(tree, value[:, None], known.edges)), "gained": gained.tobytes()}], schema=_ROUND)

        rows = classes.mapInArrow(one_round, f"label long, {_NODES_SQL}, gained binary").toArrow().sort_by("label")
        scores = scores.copy()
        for row in rows.to_pylist():
            scores[:, row["label"]] += np.frombuffer(row["gained"])
            made.append(_from_row(row))
        state.destroy()
    shared.destroy()
    return Ensemble(made, sample.classes, start.tolist(), boosted=True)


def _fit_boosting_stored(spark: SparkSession, sample: Sample, params: Boosting) -> Ensemble:
    """As ``fit_boosting``, but each class's scores are a file that its task reads and writes anew; only trees reach the driver."""
    context = spark.sparkContext
    start, folder, rows = params.start(sample), sample.bins.folder, len(sample.labels)
    shared = context.broadcast(sample)
    classes = spark.range(0, sample.classes, 1, max(1, sample.classes))
    made: list[_Nodes] = []
    for number in range(params.rounds):

        def one_round(batches: Iterator[pa.RecordBatch], number=number) -> Iterator[pa.RecordBatch]:
            known = shared.value
            if number:
                scores = [blocks.mapped(f"{folder}/scores-{number}-{c}", "float64", (rows,)) for c in range(known.classes)]
            else:
                scores = [np.broadcast_to(s, rows) for s in start]
            for batch in batches:
                for label in batch.column("id").to_pylist():
                    tree, value = params.tree(known, scores, number, label)
                    blocks.write(folder, f"scores-{number + 1}-{label}", scores[label] + value[tree.leaves(known.bins)])
                    yield pa.RecordBatch.from_pylist([{"label": label, **_row(_nodes(tree, value[:, None], known.edges))}], schema=_TREE)

        made += [_from_row(r) for r in classes.mapInArrow(one_round, f"label long, {_NODES_SQL}").toArrow().sort_by("label").to_pylist()]
        system, path = opened(folder)
        for c in range(sample.classes if number else 0):
            system.delete_file(f"{path}/scores-{number}-{c}")
    shared.destroy()
    return Ensemble(made, sample.classes, start.tolist(), boosted=True)


# -- forests ------------------------------------------------------------------------------


@dataclass
class Forest:
    """Parameters of a random forest; ``depth`` None grows until the split and leaf sizes end it."""

    trees: int = 200
    depth: int | None = 20
    min_split: int = 5
    min_leaf: int = 2
    bootstrap: bool = True
    column_share: float | None = None  # None: the square root of the number of features
    seed: int = DEFAULT_SEED

    def tree(self, sample: Sample, number: int) -> Tree:
        """Rows are drawn with replacement (Poisson counts); classes weigh alike within the draw; cuts lower the Gini impurity."""
        n, width = sample.bins.shape
        rng = np.random.default_rng([self.seed, number])
        times = rng.poisson(1.0, n) if self.bootstrap else np.ones(n, np.int64)
        held = np.bincount(sample.labels, times, sample.classes)
        weights = times * (times.sum() / (max((held > 0).sum(), 1) * np.maximum(held, 1)))[sample.labels]
        stats = np.zeros((n, sample.classes))
        stats[np.arange(n), sample.labels] = weights
        m = max(1, int(np.sqrt(width)) if self.column_share is None else round(self.column_share * width))

        def features(nodes: int) -> np.ndarray:
            if m >= width:
                return np.tile(np.arange(width), (nodes, 1))
            return np.argpartition(rng.random((nodes, width)), m - 1, axis=1)[:, :m]

        return grow(
            sample.bins, stats, times > 0, sample.width, lambda s: (s**2).sum(-1) / s.sum(-1), features,
            max_depth=_NO_LIMIT if self.depth is None else self.depth, min_split=self.min_split, min_leaf=self.min_leaf,
        )


def shares(tree: Tree) -> np.ndarray:
    """Class shares of every node."""
    return tree.sums / np.maximum(tree.sums.sum(1, keepdims=True), 1e-300)


def fit_forest(spark: SparkSession, sample: Sample, params: Forest) -> Ensemble:
    """One job; the trees are dealt over the tasks."""
    context = spark.sparkContext
    shared = context.broadcast(sample)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("id").to_pylist():
                tree = params.tree(shared.value, number)
                yield pa.RecordBatch.from_pylist([{"label": number, **_row(_nodes(tree, shares(tree), shared.value.edges))}], schema=_TREE)

    if isinstance(sample.bins, Blocks):
        numbers = spark.range(0, params.trees, 1, max(1, params.trees))
        grown = written(numbers.mapInArrow(some, f"label long, {_NODES_SQL}"), "trees")
        shared.destroy()
        return Ensemble.of(grown, sample.classes, [], boosted=False)
    numbers = spark.range(0, params.trees, 1, max(1, min(params.trees, 2 * context.defaultParallelism)))
    rows = numbers.mapInArrow(some, f"label long, {_NODES_SQL}").toArrow().sort_by("label")
    shared.destroy()
    return Ensemble([_from_row(r) for r in rows.to_pylist()], sample.classes, [], boosted=False)


# -- fitted ensembles -----------------------------------------------------------------------


@dataclass
class _Nodes:
    """A tree over plain feature values."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray  # nodes x 1 (boosted) or x classes


_NODE_FIELDS = [
    ("feature", pa.list_(pa.int32())), ("threshold", pa.list_(pa.float64())), ("left", pa.list_(pa.int32())), ("value", pa.list_(pa.float64())),
]
_NODES_SQL = "feature array<int>, threshold array<double>, left array<int>, value array<double>"
_TREE = pa.schema([("label", pa.int64()), *_NODE_FIELDS])
_ROUND = pa.schema([("label", pa.int64()), *_NODE_FIELDS, ("gained", pa.binary())])


def _nodes(tree: Tree, value: np.ndarray, edges: list[np.ndarray]) -> _Nodes:
    threshold = np.array([edges[f][c] if f >= 0 else 0.0 for f, c in zip(tree.feature.tolist(), tree.cut.tolist())])
    return _Nodes(tree.feature, threshold, tree.left, value)


def _row(nodes: _Nodes) -> dict:
    return {"feature": nodes.feature, "threshold": nodes.threshold, "left": nodes.left, "value": nodes.value.ravel()}


def _from_row(row: dict) -> _Nodes:
    n = len(row["feature"])
    return _Nodes(np.array(row["feature"], np.int32), np.array(row["threshold"]), np.array(row["left"], np.int32), np.array(row["value"]).reshape(n, -1))


@dataclass
class Ensemble:
    """A fitted ensemble. Boosted trees come round by round, a tree per class in each.

    Trees of very many nodes are files, which workers map into memory: ``files`` is their folder and the nodes and leaves of each.
    """

    trees: list[_Nodes]
    classes: int
    start: list[float]
    boosted: bool
    _joined: tuple | None = field(default=None, repr=False)
    files: tuple[str, list[tuple[int, int]]] | None = None

    @staticmethod
    def of(rows: DataFrame, classes: int, start: list[float], boosted: bool) -> Ensemble:
        """The ensemble whose trees are the rows of a written table."""
        if (rows.agg(F.sum(F.size("feature"))).first()[0] or 0) <= _KEPT_NODES:
            return Ensemble([_from_row(r) for r in rows.toArrow().sort_by("label").to_pylist()], classes, start, boosted)
        folder = shared_folder(rows.sparkSession, "ensemble")
        make_folder(folder)

        def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, label in enumerate(batch.column("label").to_pylist()):
                    feature, threshold, left, value = (batch.column(n)[at].values.to_numpy() for n in ("feature", "threshold", "left", "value"))
                    leaf = feature < 0
                    values = value.reshape(len(feature), -1)[leaf]
                    places = np.where(leaf, np.cumsum(leaf) - 1, left).astype(np.int32)
                    whole = b"".join(np.ascontiguousarray(x).tobytes() for x in (threshold, values, feature.astype(np.int32), places))
                    blocks.write(folder, f"tree-{label}", np.frombuffer(whole, np.uint8))
                    yield pa.RecordBatch.from_pylist([{"label": label, "nodes": len(feature), "leaves": len(values)}])

        made = rows.mapInArrow(lay_out, "label long, nodes long, leaves long").toArrow().sort_by("label")
        return Ensemble([], classes, start, boosted, files=(folder, list(zip(made.column("nodes").to_pylist(), made.column("leaves").to_pylist()))))

    def _tree(self, number: int) -> tuple[np.ndarray, ...]:
        """Feature, threshold, left child (of a leaf: its place among the values) and values of the leaves, from its file."""
        folder, sizes = self.files
        (nodes, leaves), width = sizes[number], 1 if self.boosted else self.classes
        data = blocks.mapped(f"{folder}/tree-{number}", "uint8", (16 * nodes + 8 * leaves * width,))
        threshold, values = data[: 8 * nodes].view(np.float64), data[8 * nodes : 8 * (nodes + leaves * width)].view(np.float64).reshape(leaves, width)
        feature, left = data[-8 * nodes :].view(np.int32).reshape(2, nodes)
        return feature, threshold, left, values

    def _arrays(self) -> tuple:
        """All trees end to end: roots, features, thresholds, left children (of a leaf: its place among the values), values of the leaves."""
        if self._joined is None:
            sizes = np.array([len(t.feature) for t in self.trees])
            roots = np.cumsum(sizes) - sizes
            feature = np.concatenate([t.feature for t in self.trees]).astype(np.int32)
            left = np.concatenate([t.left + r for t, r in zip(self.trees, roots)])
            leaf = feature < 0
            self._joined = (
                roots.astype(np.int32),
                feature,
                np.concatenate([t.threshold for t in self.trees]),
                np.where(leaf, np.cumsum(leaf) - 1, left).astype(np.int32),
                np.concatenate([t.value[t.feature < 0] for t in self.trees]),
            )
        return self._joined

    def raw(self, values: np.ndarray) -> np.ndarray:
        """Scores (boosted) or mean class shares of rows of feature values."""
        out = np.tile(np.array(self.start), (len(values), 1)) if self.boosted else np.zeros((len(values), self.classes))
        if self.files:
            for number in range(len(self.files[1])):
                feature, threshold, left, value = self._tree(number)
                node = np.zeros(len(values), np.int64)
                going = np.flatnonzero(feature[node] >= 0)
                while len(going):
                    at = node[going]
                    at = left[at] + (values[going, feature[at]] > threshold[at])
                    node[going] = at
                    going = going[feature[at] >= 0]
                if self.boosted:
                    out[:, number % self.classes] += value[left[node], 0]
                else:
                    out += value[left[node]]
            return out if self.boosted else out / len(self.files[1])
        if not self.trees and self._joined is None:
            return out
        roots, feature, threshold, left, value = self._arrays()
        step = max(1, 1_000_000 // len(roots))
        for begin in range(0, len(values), step):
            some = values[begin : begin + step]
            node = np.tile(roots, len(some))
            row = np.repeat(np.arange(len(some)), len(roots))
            going = np.flatnonzero(feature[node] >= 0)
            while len(going):
                at = node[going]
                at = left[at] + (some[row[going], feature[at]] > threshold[at])
                node[going] = at
                going = going[feature[at] >= 0]
            node = left[node].reshape(len(some), len(roots))
            if self.boosted:
                out[begin : begin + step] += value[node, 0].reshape(len(some), -1, self.classes).sum(1)
            else:
                for tree in range(len(roots)):
                    out[begin : begin + step] += value[node[:, tree]]
        return out if self.boosted else out / len(roots)

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        raw = self.raw(values)
        return softmax(raw) if self.boosted else raw

    def column(self, spark: SparkSession, features: str = "features") -> Column:
        """Class probabilities of the feature vector; executors get the trees once."""
        # a worker holds the joined arrays, not the trees as well
        joined = self._arrays() if self.trees else None
        model = spark.sparkContext.broadcast(Ensemble([], self.classes, self.start, self.boosted, joined, self.files))

        @F.arrow_udf("array<double>")
        def probabilities(column: pa.Array) -> pa.Array:
            values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
            found = model.value.probabilities(values)
            offsets = np.arange(len(column) + 1, dtype=np.int32) * found.shape[1]
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))

        return probabilities(vector_to_array(features))

    def save(self, spark: SparkSession, path: str) -> None:
        if self.files:
            trees = len(self.files[1])
            spark.range(0, trees, 1, trees).mapInArrow(self._read_back, f"label long, {_NODES_SQL}").write.mode("overwrite").parquet(path)
            return
        rows = pa.Table.from_pylist([{"label": i, **_row(t)} for i, t in enumerate(self.trees)], schema=_TREE)
        spark.createDataFrame(rows).write.mode("overwrite").parquet(path)

    def _read_back(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Trees from their files; inner nodes have zeros as values, which are not used."""
        for batch in batches:
            for number in batch.column("id").to_pylist():
                feature, threshold, left, leaves = self._tree(number)
                leaf = feature < 0
                value = np.zeros((len(feature), leaves.shape[1]))
                value[leaf] = leaves
                nodes = _Nodes(feature, threshold, np.where(leaf, 0, left), value)
                yield pa.RecordBatch.from_pylist([{"label": number, **_row(nodes)}], schema=_TREE)

    @staticmethod
    def load(spark: SparkSession, path: str, classes: int, start: list[float], boosted: bool) -> Ensemble:
        return Ensemble.of(spark.read.parquet(path), classes, start, boosted)


# -- tuning -----------------------------------------------------------------------------------


def macro_f1(labels: np.ndarray, predicted: np.ndarray) -> float:
    """Mean F1 over the classes that occur in either."""
    found = []
    for label in np.unique(np.concatenate((labels, predicted))):
        hit = np.sum((labels == label) & (predicted == label))
        found.append(2 * hit / (np.sum(labels == label) + np.sum(predicted == label)))
    return float(np.mean(found)) if found else 0.0


def _dealt(sample: Sample, folds: int, seed: int) -> np.ndarray:
    """The fold of each row: the rows of a class are dealt round in a seeded order."""
    order = np.lexsort((np.random.default_rng(seed).random(len(sample.labels)), sample.labels))
    fold = np.empty(len(order), np.int8)
    firsts = np.searchsorted(sample.labels[order], sample.labels[order])
    fold[order] = (np.arange(len(order)) - firsts) % folds
    return fold


def tune_boosting(spark: SparkSession, sample: Sample, grid: list[dict], base: Boosting, folds: int = 3) -> list[float]:
    """Mean macro F1 of each parameter set. Sets that differ in rounds only are prefixes of one fit; a task makes a fit."""
    fold = _dealt(sample, folds, base.seed)
    fits: dict[tuple, list[int]] = {}
    for number, params in enumerate(grid):
        fits.setdefault(tuple(sorted((k, v) for k, v in params.items() if k != "rounds")), []).append(number)
    plans = list(fits.items())
    shared = spark.sparkContext.broadcast((sample, fold))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, of = shared.value
        for batch in batches:
            for unit in batch.column("id").to_pylist():
                own, sets = plans[unit // folds]
                training, held = whole.part(of != unit % folds), whole.part(of == unit % folds)
                wanted = {n: grid[n].get("rounds", base.rounds) for n in sets}
                params = Boosting(**{**vars(base), **dict(own)})
                start = params.start(training)
                scores, tested = (np.tile(start, (len(x.labels), 1)) for x in (training, held))
                found = []
                for number in range(max(wanted.values())):
                    gained = np.empty_like(scores)
                    for label in range(training.classes):
                        tree, value = params.tree(training, scores, number, label)
                        gained[:, label] = value[tree.leaves(training.bins)]
                        tested[:, label] += value[tree.leaves(held.bins)]
                    scores += gained
                    found += [(n, macro_f1(held.labels, tested.argmax(1))) for n, r in wanted.items() if r == number + 1]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], ["set", "f1"])

    return _means(spark, len(plans) * folds, score, len(grid), shared)


def tune_forest(spark: SparkSession, sample: Sample, grid: list[dict], base: Forest, folds: int = 3, chunk: int = 10) -> list[float]:
    """Mean macro F1 of each parameter set. Numbers of trees are prefixes, depths and split sizes are cuts of the same trees."""
    fold = _dealt(sample, folds, base.seed)
    sets = [Forest(**{**vars(base), **params}) for params in grid]
    trees = max(s.trees for s in sets)
    cuts = sorted({(_NO_LIMIT if s.depth is None else s.depth, s.min_split) for s in sets})
    deepest, least = max(d for d, _ in cuts), min(s for _, s in cuts)
    grown = Forest(**{**vars(base), "depth": None if deepest == _NO_LIMIT else deepest, "min_split": least})
    chunks = -(-trees // chunk)
    stops = {s.trees for s in sets}
    uptos = sorted(stops | {min(trees, (part + 1) * chunk) for part in range(chunks)})
    shared = spark.sparkContext.broadcast((sample, fold))
    folder = shared_folder(spark, "votes")
    make_folder(folder)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, of = shared.value
        for batch in batches:
            for unit in batch.column("id").to_pylist():
                number, part = unit % folds, unit // folds
                training, held = whole.part(of != number), whole.part(of == number)
                votes = np.zeros((len(cuts), len(held.labels), whole.classes))
                for tree_number in range(part * chunk, min(trees, (part + 1) * chunk)):
                    tree = grown.tree(training, tree_number)
                    share = shares(tree)
                    for at, (depth, split) in enumerate(cuts):
                        votes[at] += share[tree.leaves(held.bins, depth, split)]
                    if tree_number + 1 in uptos:
                        blocks.write(folder, f"{number}-{tree_number + 1}", votes.astype(np.float32))
                        votes[:] = 0
            yield pa.RecordBatch.from_arrays([batch.column("id")], ["id"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, of = shared.value
        for batch in batches:
            for number in batch.column("id").to_pylist():
                labels = whole.labels[of == number]
                files = [blocks.mapped(f"{folder}/{number}-{upto}", "float32", (len(cuts), len(labels), whole.classes)) for upto in uptos]
                predicted = {upto: np.zeros((len(cuts), len(labels)), np.int32) for upto in stops}
                for begin in range(0, len(labels), _CHUNK):
                    some = slice(begin, begin + _CHUNK)
                    total = np.zeros((len(cuts), len(labels[some]), whole.classes))
                    for upto, votes in zip(uptos, files):
                        total += votes[:, some]
                        if upto in stops:
                            predicted[upto][:, some] = total.argmax(-1)
                for upto in predicted:
                    found = [macro_f1(labels, own) for own in predicted[upto]]
                    columns = [pa.array([upto] * len(cuts), pa.int64()), pa.array(range(len(cuts)), pa.int64()), pa.array(found, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, ["upto", "cut", "f1"])

    units = chunks * folds
    spark.range(0, units, 1, units).mapInArrow(vote, "id long").count()
    counted = spark.range(0, folds, 1, folds).mapInArrow(count, "upto long, cut long, f1 double").toArrow().to_pylist()
    shared.destroy()
    system, path = opened(folder)
    system.delete_dir(path)
    found: dict[tuple, list[float]] = {}
    for row in counted:
        found.setdefault((row["upto"], *cuts[row["cut"]]), []).append(row["f1"])
    return [float(np.mean(found[s.trees, _NO_LIMIT if s.depth is None else s.depth, s.min_split])) for s in sets]


def _means(spark: SparkSession, units: int, score, sets: int, shared) -> list[float]:
    rows = spark.range(0, units, 1, units).mapInArrow(score, "set long, f1 double").groupBy("set").agg(F.avg("f1").alias("f1")).collect()
    shared.destroy()
    by_set = {r["set"]: r["f1"] for r in rows}
    return [by_set[n] for n in range(sets)]
