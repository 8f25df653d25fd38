"""Support vector machines with the RBF kernel: one against one, with pairwise probabilities.

Every pair of classes is a problem of its own; a task solves
it with all kernel values it needs computed from the rows of the two classes. More rows than ``classify.LOCAL_ROWS`` stay in
block files, sorted by class; then a task solves one problem of a pair, that of all its rows or that of a fold, and holds
some numbers a row and the kernel rows used last, whatever the features. The dual is solved by pairs of
variables that violate optimality most (second-order choice of the partner), until the violation is below the
tolerance or the iterations are used up. Margins become probabilities by a sigmoid fitted with Newton steps on
margins of held-out folds; the probabilities of all pairs are coupled into those of the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.files import make_folder, opened
from doclens.operators import blocks
from doclens.operators.blocks import Blocks
from doclens.session import DEFAULT_SEED, shared_folder

_KEPT_ROWS = 2_000  # kernel rows that a problem keeps,
_KEPT_BYTES = 1 << 27  # or as many as have so many bytes


def kernel(one: np.ndarray, other: np.ndarray, gamma: float) -> np.ndarray:
    gaps = (one**2).sum(1)[:, None] + (other**2).sum(1)[None, :] - 2.0 * (one @ other.T)
    return np.exp(-gamma * np.maximum(gaps, 0.0))


class PairRows:
    """The rows of two classes, which are two stretches of rows sorted by class, in block files."""

    def __init__(self, values: Blocks, spans: list[tuple[int, int]]):
        self.values, self.spans = values, spans
        self.rows = np.concatenate([np.arange(a, b) for a, b in spans])
        self.squares = self._each(lambda block: np.einsum("ij,ij->i", block, block))

    def _each(self, of) -> np.ndarray:
        out, at = np.empty(len(self.rows)), 0
        for a, b in self.spans:
            for _, block in self.values.pieces(a, b):
                out[at : at + len(block)] = of(block)
                at += len(block)
        return out

    def kernel_row(self, i: int, gamma: float) -> np.ndarray:
        own = self.values.take(self.rows[i : i + 1])[0]
        gaps = self._each(lambda block: block @ own)
        gaps *= -2.0
        gaps += self.squares + self.squares[i]
        return np.exp(-gamma * np.maximum(gaps, 0.0))


def solve(x: np.ndarray | PairRows, y: np.ndarray, bounds: np.ndarray, gamma: float, tol: float, max_iter: int) -> tuple[np.ndarray, float]:
    """``(alpha * y, bias)`` of the soft-margin dual; ``y`` is 1 or -1, ``bounds`` the largest alpha of each row.

    ``max_iter`` below 0 means no limit.
    """
    return solved(x, y, bounds, gamma, tol, max_iter)[:2]


def solved(x: np.ndarray | PairRows, y: np.ndarray, bounds: np.ndarray, gamma: float, tol: float, max_iter: int) -> tuple[np.ndarray, float, np.ndarray]:
    """As ``solve``, and the margin of every row; rows of bound 0 have no part in the problem."""
    n = len(y)
    most = max(2, min(_KEPT_ROWS, _KEPT_BYTES // (8 * max(n, 1))))
    alpha, gradient = np.zeros(n), -np.ones(n)
    kept: dict[int, np.ndarray] = {}

    def row(i: int) -> np.ndarray:
        if i not in kept:
            if len(kept) >= most:
                kept.pop(next(iter(kept)))
            kept[i] = x.kernel_row(i, gamma) if isinstance(x, PairRows) else kernel(x[i : i + 1], x, gamma)[0]
        return kept[i]

    done = 0
    while max_iter < 0 or done < max_iter:
        up = np.where(y > 0, alpha < bounds, alpha > 0)
        down = np.where(y > 0, alpha > 0, alpha < bounds)
        steep = -y * gradient
        if not up.any() or not down.any():
            break
        i = int(np.where(up, steep, -np.inf).argmax())
        if steep[i] - np.where(down, steep, np.inf).min() < tol:
            break
        own = row(i)
        gap = steep[i] - steep
        curve = np.maximum(2.0 - 2.0 * own, 1e-12)  # the kernel of a row with itself is 1
        j = int(np.where(down & (gap > 0), gap**2 / curve, -np.inf).argmax())
        other = row(j)
        # along this direction the constraint sum(alpha * y) = 0 holds
        step = gap[j] / curve[j]
        step = min(step, bounds[i] - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else bounds[j] - alpha[j])
        for at, moved in ((i, y[i] * step), (j, -y[j] * step)):
            alpha[at] += moved
            if min(alpha[at], bounds[at] - alpha[at]) < 1e-12 * bounds[at]:  # rounding must not leave it beside its end
                alpha[at] = 0.0 if alpha[at] < bounds[at] / 2 else bounds[at]
        gradient += y * step * (own - other)
        done += 1
    free = (alpha > 0) & (alpha < bounds)
    steep = -y * gradient
    if free.any():
        bias = float(steep[free].mean())
    else:
        up, down = np.where(y > 0, alpha < bounds, alpha > 0), np.where(y > 0, alpha > 0, alpha < bounds)
        ends = [steep[up].max()] * bool(up.any()) + [steep[down].min()] * bool(down.any())
        bias = float(np.mean(ends)) if ends else 0.0
    return alpha * y, bias, (gradient + 1.0) * y + bias


def objective(coefficients: np.ndarray, x: np.ndarray, y: np.ndarray, gamma: float) -> float:
    """The dual's value: half the squared norm less the sum of alphas."""
    return float(0.5 * coefficients @ kernel(x, x, gamma) @ coefficients - (coefficients * y).sum())


def fit_sigmoid(margins: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """``(a, b)`` of the probability ``1 / (1 + exp(a * margin + b))`` of ``y = 1``, for targets drawn a little inwards."""
    positive, negative = int((y > 0).sum()), int((y <= 0).sum())
    targets = np.where(y > 0, (positive + 1.0) / (positive + 2.0), 1.0 / (negative + 2.0))
    a, b = 0.0, float(np.log((negative + 1.0) / (positive + 1.0)))

    def loss(a: float, b: float) -> float:
        z = a * margins + b
        return float((targets * z + np.logaddexp(0.0, -z)).sum())

    value = loss(a, b)
    for _ in range(steps):
        p = np.exp(-np.logaddexp(0.0, a * margins + b))
        error, weight = targets - p, p * (1.0 - p)
        slope = np.array([(margins * error).sum(), error.sum()])
        if np.abs(slope).max() < 1e-6:
            break
        cross = (margins * weight).sum()
        curve = np.array([[(margins**2 * weight).sum() + 1e-12, cross], [cross, weight.sum() + 1e-12]])
        move = -np.linalg.solve(curve, slope)
        size = 1.0
        while size >= 1e-10:
            tried = loss(a + size * move[0], b + size * move[1])
            if tried < value + 1e-4 * size * float(slope @ move):
                a, b, value = a + size * move[0], b + size * move[1], tried
                break
            size /= 2
        else:
            break
    return float(a), float(b)


def coupled(pairwise: np.ndarray) -> np.ndarray:
    """Class probabilities (rows x classes) that agree best with ``pairwise[row, i, j]``, the probability of ``i`` against ``j``.

    They minimise the sum of ``(r[j, i] * p[i] - r[i, j] * p[j]) ** 2`` under a sum of 1: a linear system per row.
    """
    rows, classes, _ = pairwise.shape
    if classes == 1:
        return np.ones((rows, 1))
    across = pairwise.transpose(0, 2, 1)
    system = np.zeros((rows, classes + 1, classes + 1))
    system[:, :classes, :classes] = -across * pairwise
    diagonal = np.arange(classes)
    squares = across**2
    squares[:, diagonal, diagonal] = 0.0
    system[:, diagonal, diagonal] = squares.sum(2)
    system[:, :classes, classes] = system[:, classes, :classes] = 1.0
    right = np.zeros((rows, classes + 1, 1))
    right[:, classes] = 1.0
    found = np.clip(np.linalg.solve(system, right)[:, :classes, 0], 0.0, None)
    return found / found.sum(1, keepdims=True)


# -- fits --------------------------------------------------------------------------------


@dataclass
class KernelMachine:
    """The fitted pairs of classes over their common support rows."""

    gamma: float
    classes: int
    rows: np.ndarray  # support rows x features
    pairs: np.ndarray  # pairs x 2 class codes, the first is the positive side
    weights: np.ndarray  # pairs x support rows
    biases: np.ndarray
    sigmoids: np.ndarray  # pairs x 2

    def margins(self, values: np.ndarray) -> np.ndarray:
        if not len(self.rows):
            return np.tile(self.biases, (len(values), 1))
        out = np.empty((len(values), len(self.pairs)))
        step = max(1, 4_000_000 // len(self.rows))
        for begin in range(0, len(values), step):
            out[begin : begin + step] = kernel(values[begin : begin + step], self.rows, self.gamma) @ self.weights.T + self.biases
        return out

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        """Coupled pairwise probabilities; classes without rows in the fit have 0."""
        step = max(1, 2_000_000 // self.classes**2)
        if len(values) > step:
            return np.concatenate([self.probabilities(values[i : i + step]) for i in range(0, len(values), step)])
        seen = np.unique(self.pairs) if len(self.pairs) else np.array([self.classes - 1])
        place = {int(c): i for i, c in enumerate(seen)}
        pairwise = np.zeros((len(values), len(seen), len(seen)))
        margins = self.margins(values)
        for at, (one, other) in enumerate(self.pairs.tolist()):
            a, b = self.sigmoids[at]
            p = np.clip(np.exp(-np.logaddexp(0.0, a * margins[:, at] + b)), 1e-7, 1 - 1e-7)
            pairwise[:, place[one], place[other]] = p
            pairwise[:, place[other], place[one]] = 1.0 - p
        out = np.zeros((len(values), self.classes))
        out[:, seen] = coupled(pairwise)
        return out

    def decisions(self, values: np.ndarray) -> np.ndarray:
        """Pairs won by each class, plus less than half for the sum of its margins; -1 for classes without rows in the fit."""
        margins = self.margins(values)
        won, summed = (np.zeros((len(values), self.classes)) for _ in range(2))
        for at, (one, other) in enumerate(self.pairs.tolist()):
            won[:, one] += margins[:, at] > 0
            won[:, other] += margins[:, at] <= 0
            summed[:, one] += margins[:, at]
            summed[:, other] -= margins[:, at]
        out = won + summed / (3.0 * (np.abs(summed) + 1.0))
        seen = np.unique(self.pairs) if len(self.pairs) else [self.classes - 1]
        out[:, np.setdiff1d(np.arange(self.classes), seen)] = -1.0
        return out

    def column(self, spark: SparkSession, features: str = "features") -> Column:
        """Class scores and then class probabilities of the feature vector; executors get the support rows once."""
        model = spark.sparkContext.broadcast(self)

        @F.arrow_udf("array<double>")
        def judged(column: pa.Array) -> pa.Array:
            known = model.value
            values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, known.rows.shape[1]))
            found = np.concatenate((known.decisions(values), known.probabilities(values)), 1)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * 2 * known.classes), pa.array(found.ravel()))

        return judged(vector_to_array(features))

    def save(self, spark: SparkSession, path: str) -> None:
        """Two tables: support rows, and pairs with their weights."""
        rows = pa.table({"row": np.arange(len(self.rows)), "x": pa.array(list(self.rows), pa.list_(pa.float64())), "w": pa.array(list(self.weights.T), pa.list_(pa.float64()))})
        spark.createDataFrame(rows).write.mode("overwrite").parquet(f"{path}/rows")
        pairs = pa.table({"pair": np.arange(len(self.pairs)), "one": self.pairs[:, 0], "other": self.pairs[:, 1], "bias": self.biases, "a": self.sigmoids[:, 0], "b": self.sigmoids[:, 1]})
        spark.createDataFrame(pairs).write.mode("overwrite").parquet(f"{path}/pairs")

    @staticmethod
    def load(spark: SparkSession, path: str, gamma: float, classes: int, features: int) -> KernelMachine:
        rows = spark.read.parquet(f"{path}/rows").toArrow().sort_by("row")
        pairs = spark.read.parquet(f"{path}/pairs").toArrow().sort_by("pair")
        matrix = lambda name, width: rows.column(name).combine_chunks().flatten().to_numpy().reshape(rows.num_rows, width)
        number = lambda name: pairs.column(name).to_numpy()
        return KernelMachine(
            gamma, classes, matrix("x", features), np.stack([number("one"), number("other")], 1).astype(np.int64).reshape(-1, 2),
            matrix("w", pairs.num_rows).T, number("bias"), np.stack([number("a"), number("b")], 1).reshape(-1, 2),
        )


def sample_of(df: DataFrame, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature values and labels of a fit on the driver, in an order of their contents; more than ``max_rows`` rows are an error."""
    rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y")).limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        raise ValueError(f"a fit on the driver takes at most {max_rows} rows: take fit_machine_stored")
    labels = rows.column("y").to_numpy().astype(np.int64)
    values = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(labels), -1) if len(labels) else np.zeros((0, 0))
    order = np.lexsort((*values.T, labels))
    return values[order], labels[order]


def fit_machine(
    spark: SparkSession, values: np.ndarray, labels: np.ndarray, c: float = 10.0, gamma: float | None = None, tol: float = 1e-3,
    max_iter: int = 2000, folds: int = 5, seed: int = DEFAULT_SEED,
) -> KernelMachine:
    """One job, a task per pair of classes.

    ``gamma`` defaults to 1 over the number of features times the variance of all values. A row's bound is ``c`` times
    its class's weight, rows / (classes * class rows). ``max_iter`` bounds the steps of each solver run.
    """
    counts = np.bincount(labels)
    seen = np.flatnonzero(counts)
    classes = len(counts)
    variance = float(values.var()) if values.size else 0.0
    gamma = gamma or (1.0 / (values.shape[1] * variance) if variance > 0 else 1.0)
    weight = len(labels) / (len(seen) * np.maximum(counts, 1))
    pairs = [(int(a), int(b)) for i, a in enumerate(seen) for b in seen[i + 1 :]]
    context = spark.sparkContext
    shared = context.broadcast((values, labels))

    def one_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x_all, labels_all = shared.value
        for batch in batches:
            for at in batch.column("id").to_pylist():
                one, other = pairs[at]
                own = np.flatnonzero((labels_all == one) | (labels_all == other))
                x, y = x_all[own], np.where(labels_all[own] == one, 1.0, -1.0)
                bounds = c * weight[labels_all[own]]
                coefficients, bias = solve(x, y, bounds, gamma, tol, max_iter)
                # the sigmoid sees margins of rows that their solver run did not
                dealt = np.random.default_rng([seed, at]).permutation(len(y)) % folds
                margins = np.zeros(len(y))
                for fold in range(folds):
                    rest, held = dealt != fold, dealt == fold
                    if not held.any():
                        continue
                    if len(np.unique(y[rest])) < 2:
                        margins[held] = y[rest][0] if rest.any() else 0.0
                        continue
                    w, b = solve(x[rest], y[rest], bounds[rest], gamma, tol, max_iter)
                    used = w != 0
                    margins[held] = kernel(x[held], x[rest][used], gamma) @ w[used] + b
                a, b = fit_sigmoid(margins, y)
                used = np.flatnonzero(coefficients)
                yield pa.RecordBatch.from_pylist([{"pair": at, "rows": own[used].tolist(), "w": coefficients[used].tolist(), "bias": bias, "a": a, "b": b}], schema=_PAIR)

    found = []
    if pairs:
        units = spark.range(0, len(pairs), 1, max(1, min(len(pairs), 2 * context.defaultParallelism)))
        found = units.mapInArrow(one_pair, "pair long, rows array<long>, w array<double>, bias double, a double, b double").toArrow().sort_by("pair").to_pylist()
    shared.destroy()
    support = np.unique(np.concatenate([np.array(f["rows"], np.int64) for f in found])) if found else np.zeros(0, np.int64)
    weights = np.zeros((len(pairs), len(support)))
    for at, f in enumerate(found):
        weights[at, np.searchsorted(support, f["rows"])] = f["w"]
    return KernelMachine(
        gamma, classes, values[support], np.array(pairs, np.int64).reshape(-1, 2), weights, np.array([f["bias"] for f in found]),
        np.array([[f["a"], f["b"]] for f in found]).reshape(-1, 2),
    )


def fit_machine_stored(
    spark: SparkSession, values: Blocks, labels: np.ndarray, c: float = 10.0, gamma: float | None = None, tol: float = 1e-3,
    max_iter: int = 2000, folds: int = 5, seed: int = DEFAULT_SEED,
) -> KernelMachine:
    """As ``fit_machine`` over rows in block files, sorted by class: a task for each pair of classes and fold, and for each pair.

    The support rows reach the driver: at most two for every step of a pair's solver.
    """
    counts = np.bincount(labels)
    seen = np.flatnonzero(counts)
    ends = np.cumsum(counts)
    gamma = gamma or _stored_gamma(spark, values)
    weight = len(labels) / (len(seen) * np.maximum(counts, 1))
    pairs = [(int(a), int(b)) for i, a in enumerate(seen) for b in seen[i + 1 :]]
    folder = shared_folder(spark, "margins")
    make_folder(folder)

    def sides(at: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]:
        """Stretches of rows, their sides and bounds, and the fold of each row."""
        one, other = pairs[at]
        y = np.repeat([1.0, -1.0], [counts[one], counts[other]])
        bounds = c * np.repeat([weight[one], weight[other]], [counts[one], counts[other]])
        dealt = (np.random.default_rng([seed, at]).permutation(len(y)) % folds).astype(np.int16)
        return [(int(ends[k] - counts[k]), int(ends[k])) for k in (one, other)], y, bounds, dealt

    def one_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.column("id").to_pylist():
                at, fold = divmod(unit, folds + 1)
                spans, y, bounds, dealt = sides(at)
                if fold == folds:  # all rows
                    x = PairRows(values, spans)
                    coefficients, bias = solve(x, y, bounds, gamma, tol, max_iter)
                    used = np.flatnonzero(coefficients)
                    yield pa.RecordBatch.from_pylist([{"pair": at, "rows": x.rows[used].tolist(), "w": coefficients[used].tolist(), "bias": bias, "a": 0.0, "b": 0.0}], schema=_PAIR)
                    continue
                # the sigmoid sees margins of rows that their solver run did not
                rest, held = dealt != fold, dealt == fold
                if not held.any():
                    continue
                if len(np.unique(y[rest])) < 2:
                    margins = np.full(len(y), y[rest][0] if rest.any() else 0.0)
                else:
                    margins = solved(PairRows(values, spans), y, np.where(rest, bounds, 0.0), gamma, tol, max_iter)[2]
                blocks.write(folder, f"{at}-{fold}", margins[held])

    def one_sigmoid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column("id").to_pylist():
                _, y, _, dealt = sides(at)
                margins = np.zeros(len(y))
                for fold in range(folds):
                    held = dealt == fold
                    if held.any():
                        margins[held] = blocks.mapped(f"{folder}/{at}-{fold}", "float64", (int(held.sum()),))
                a, b = fit_sigmoid(margins, y)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([a], pa.float64()), pa.array([b], pa.float64())], ["pair", "a", "b"])

    found, sigmoids = [], []
    if pairs:
        units = len(pairs) * (folds + 1)
        fields = "pair long, rows array<long>, w array<double>, bias double, a double, b double"
        found = spark.range(0, units, 1, units).mapInArrow(one_run, fields).toArrow().sort_by("pair").to_pylist()
        sigmoids = spark.range(0, len(pairs), 1, len(pairs)).mapInArrow(one_sigmoid, "pair long, a double, b double").toArrow().sort_by("pair").to_pylist()
    system, path = opened(folder)
    system.delete_dir(path)
    support = np.unique(np.concatenate([np.array(f["rows"], np.int64) for f in found])) if found else np.zeros(0, np.int64)
    weights = np.zeros((len(pairs), len(support)))
    for at, f in enumerate(found):
        weights[at, np.searchsorted(support, f["rows"])] = f["w"]
    return KernelMachine(
        gamma, len(counts), values.take(support), np.array(pairs, np.int64).reshape(-1, 2), weights, np.array([f["bias"] for f in found]),
        np.array([[s["a"], s["b"]] for s in sigmoids]).reshape(-1, 2),
    )


def _stored_gamma(spark: SparkSession, values: Blocks) -> float:
    """1 over the number of features times the variance of all values."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column("id").to_pylist():
                own = values.block(at)
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.float64()) for v in (own.size, own.mean(), own.var())], ["n", "mean", "var"])

    files = len(values.names)
    found = spark.range(0, files, 1, files).mapInArrow(moments, "n double, mean double, var double").toArrow()
    n, mean, var = (found.column(c).to_numpy() for c in ("n", "mean", "var"))
    variance = float((n * (var + (mean - (n * mean).sum() / n.sum()) ** 2)).sum() / n.sum())
    return 1.0 / (values.width * variance) if variance > 0 else 1.0


_PAIR = pa.schema(
    [("pair", pa.int64()), ("rows", pa.list_(pa.int64())), ("w", pa.list_(pa.float64())), ("bias", pa.float64()), ("a", pa.float64()), ("b", pa.float64())]
)
