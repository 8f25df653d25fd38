"""Multi-class training, tuning, calibration and prediction with Spark ML."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclens.functions import scores as sc
from doclens.operators import blocks, evaluate, kernels, nearest, trees
from doclens.operators.sampling import hash_order
from doclens.session import DEFAULT_SEED, broadcast_if_small, shared_folder, written

MODEL_TYPES = ["logistic", "random_forest", "gradient_boosting", "xgboost", "svm", "knn"]
TREE_MODELS = ["random_forest", "gradient_boosting", "xgboost"]
COMPARED_MODELS = ["gradient_boosting", "random_forest", "logistic", "svm", "xgboost"]
_MIN_ROWS_TO_TUNE = 200
_MIN_ROWS_TO_CALIBRATE = 30
_FOLDS = 3
LOCAL_ROWS = 20_000  # fits of trees and kernels hold so many rows in a task; more stay in block files
_TASK_ROWS = 4_096
_BIN_DIGITS = 3  # 4,096 bins of hashes per class
_SCORE_STEPS = 10_000


# -- class weights -------------------------------------------------------------------


def class_weights(df: DataFrame, label_column: str = "label") -> DataFrame:
    """``(label, n, weight)`` with weight ``rows / (classes * class rows)``."""
    counts = broadcast_if_small(df.groupBy(label_column).agg(F.count(F.lit(1)).alias("n")))
    facts = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).first()
    return counts.withColumn(
        "weight", F.lit(float(facts["rows"] or 0)) / (F.lit(float(facts["classes"])) * F.col("n"))
    )


def with_class_weight(df: DataFrame, label_column: str = "label", output: str = "class_weight") -> DataFrame:
    weights = broadcast_if_small(class_weights(df, label_column).select(label_column, F.col("weight").alias(output)))
    return df.join(weights, label_column)


# -- estimators ------------------------------------------------------------------------


def logistic(rows: int, c: float = 1.0, max_iter: int = 2000, tol: float = 1e-4) -> LogisticRegression:
    """Multinomial logistic regression with an L2 penalty of strength 1/C over the summed loss."""
    return LogisticRegression(
        family="multinomial", maxIter=max_iter, tol=tol, regParam=1.0 / (c * max(rows, 1)), standardization=False,
        weightCol="class_weight",
    )


def tree_params(model_type: str, **params) -> trees.Forest | trees.Boosting:
    """Parameters of a tree ensemble: the defaults of its type with ``params`` over them."""
    if model_type == "random_forest":
        return trees.Forest(**params)
    if model_type == "gradient_boosting":
        return trees.Boosting(**{"rounds": 150, "newton": False, "min_split": 5, "min_leaf": 2, **params})
    return trees.Boosting(**{"column_share": 0.8, **params})


def linear_svm(
    rows: int, c: float = 10.0, max_iter: int = 200, tol: float = 1e-3, parallelism: int = 4
) -> OneVsRest:
    svc = LinearSVC(maxIter=max_iter, tol=tol, regParam=1.0 / (c * max(rows, 1)), standardization=False)
    return OneVsRest(classifier=svc, parallelism=parallelism, weightCol="class_weight")


# -- random Fourier features for the RBF kernel ------------------------------------------


@dataclass
class FourierMap:
    """Random Fourier features (Rahimi and Recht 2007): dot products approximate the RBF kernel."""

    input_dim: int
    gamma: float
    dims: int = 512
    seed: int = DEFAULT_SEED

    def transform(self, df: DataFrame, features: str = "features", output: str = "features") -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        input_dim, gamma, dims, seed = self.input_dim, self.gamma, self.dims, self.seed

        @F.pandas_udf("array<double>")
        def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            # the projection follows from the seed, so nothing is shipped to the workers
            rng = np.random.default_rng(seed)
            weights = rng.normal(0.0, np.sqrt(2.0 * gamma), (input_dim, dims))
            shift = rng.uniform(0.0, 2.0 * np.pi, dims)
            for batch in batches:
                x = np.stack(batch.to_list()) if len(batch) else np.empty((0, input_dim))
                yield pd.Series(list(np.sqrt(2.0 / dims) * np.cos(x @ weights + shift)))

        return df.withColumn(output, array_to_vector(project(vector_to_array(features))))


def fit_fourier_map(df: DataFrame, features: str = "features", dims: int = 512) -> FourierMap:
    """``gamma = 1 / (features * variance of all feature values)``."""
    values = df.select(vector_to_array(features).alias("a")).select(
        F.size("a").alias("width"),
        F.aggregate("a", F.lit(0.0), lambda t, x: t + x).alias("s"),
        F.aggregate("a", F.lit(0.0), lambda t, x: t + x * x).alias("ss"),
    )
    row = values.agg(F.max("width").alias("w"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("width").alias("n")).first()
    variance = row["ss"] / row["n"] - (row["s"] / row["n"]) ** 2
    return FourierMap(row["w"], 1.0 / (row["w"] * variance) if variance > 0 else 1.0, dims)


# -- fitted models -------------------------------------------------------------------------


@dataclass
class FittedClassifier:
    """A fitted model that adds ``prediction``, class ``scores`` and ``probabilities``."""

    model_type: str
    model: Model | Transformer | trees.Ensemble | kernels.KernelMachine | NearestModel
    fourier: FourierMap | None = None
    params: dict = field(default_factory=dict)
    calibrated: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        if isinstance(self.model, (trees.Ensemble, kernels.KernelMachine, NearestModel)):
            kept = [c for c in df.columns if c not in ("prediction", "scores", "probabilities")]
            judged = df.select(*kept, self.model.column(df.sparkSession).alias("probabilities")).withColumn("scores", F.col("probabilities"))
            if isinstance(self.model, kernels.KernelMachine):  # classes are told by pairs won, not by probability
                n = self.model.classes
                judged = judged.withColumns({"scores": F.slice("scores", 1, n), "probabilities": F.slice("probabilities", n + 1, n)})
            best = (F.array_position("scores", F.array_max("scores")) - 1).cast("double")
            return judged.select(*kept, best.alias("prediction"), "scores", "probabilities")
        source = df
        if self.fourier:
            # the model reads the projected features; the caller gets its own back
            source = self.fourier.transform(df.withColumn("_features", F.col("features")))
        scored = self.model.transform(source)
        has_probability = "probability" in scored.columns
        raw = vector_to_array("rawPrediction") if "rawPrediction" in scored.columns else vector_to_array("probability")
        result = scored.withColumn("scores", vector_to_array("probability") if has_probability else raw)
        probabilities = F.col("scores") if has_probability else sc.softmax("scores")
        kept = [c for c in df.columns if c not in ("prediction", "scores", "probabilities")]
        restored = [F.col("_features").alias(c) if self.fourier and c == "features" else F.col(c) for c in kept]
        return result.withColumn("probabilities", probabilities).select(
            *restored, "prediction", "scores", "probabilities"
        )


def estimator(model_type: str, rows: int, **params):
    if model_type == "logistic":
        return logistic(rows, **params)
    if model_type == "svm":
        return linear_svm(rows, **params)
    raise ValueError(f"unknown model type {model_type!r}; known: {MODEL_TYPES}")


def fit_tasks(spark: SparkSession, rows: int) -> int:
    """An iterative fit runs a job per step: a small table must not pay for near-empty tasks, a larger one takes all cores."""
    return 1 if rows <= LOCAL_ROWS else max(-(-rows // LOCAL_ROWS), min(-(-rows // _TASK_ROWS), spark.sparkContext.defaultParallelism))


def fit_rows(df: DataFrame, label_column: str = "label") -> DataFrame:
    """All rows that have a label, in as many tasks as a fit should have."""
    labelled = df.filter(F.col(label_column).isNotNull())
    return labelled.coalesce(fit_tasks(df.sparkSession, labelled.count()))


def with_folds(df: DataFrame, id_column: str, label_column: str = "label", folds: int = _FOLDS, seed: int = DEFAULT_SEED) -> DataFrame:
    """Add ``_fold``: rows of each class dealt round by hash rank.

    Rows are ranked inside the bins of their class's leading hash digits; ranks go on after the rows of the bins before.
    """
    names = df.columns
    keyed = df.withColumn("_h", hash_order(id_column, seed)).withColumn("_bin", F.left("_h", F.lit(_BIN_DIGITS)))
    bins = keyed.groupBy(F.col(label_column).alias("_class"), F.col("_bin").alias("_in")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_class").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,097 rows
    offsets = broadcast_if_small(bins.select("_class", "_in", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    same_bin = F.col(label_column).eqNullSafe(F.col("_class")) & F.col("_bin").eqNullSafe(F.col("_in"))
    rank = F.col("_offset") + F.row_number().over(Window.partitionBy(label_column, "_bin").orderBy("_h", id_column))
    return keyed.join(offsets, same_bin).select(*names, ((rank - 1) % folds).cast("int").alias("_fold"))


def fit_classifier(df: DataFrame, model_type: str = "logistic", **params) -> FittedClassifier:
    """Fit on ``features`` (ML vector) and ``label`` (class code as double).

    Every fit takes all rows of ``df``, any number of them. A ``svm`` has the RBF kernel; with ``dims`` the kernel is
    approximated by so many random features.
    """
    if model_type in TREE_MODELS:
        sample, chosen = _tree_rows(df), tree_params(model_type, **params)
        fit = trees.fit_forest if model_type == "random_forest" else trees.fit_boosting
        fitted = FittedClassifier(model_type, fit(df.sparkSession, sample, chosen), params=params)
        sample.delete()
        return fitted
    if model_type == "knn":
        return FittedClassifier(model_type, fit_nearest(df, **params), params=params)
    if model_type == "svm" and "dims" not in params:
        if df.count() <= LOCAL_ROWS:
            return FittedClassifier(model_type, kernels.fit_machine(df.sparkSession, *kernels.sample_of(df, LOCAL_ROWS), **params), params=params)
        values, labels = blocks.stored(df, by_label=True)
        fitted = FittedClassifier(model_type, kernels.fit_machine_stored(df.sparkSession, values, labels, **params), params=params)
        values.delete()
        return fitted
    rows = df.count()
    weighted = with_class_weight(df)
    fourier = None
    if model_type == "svm":
        fourier = fit_fourier_map(weighted, dims=params.pop("dims"))
        weighted = fourier.transform(weighted)
    model = estimator(model_type, rows, **params).fit(weighted)
    return FittedClassifier(model_type, model, fourier, params)


def _tree_rows(df: DataFrame) -> trees.Sample:
    return trees.sample_of(df, LOCAL_ROWS) if df.count() <= LOCAL_ROWS else trees.stored_sample(df)


# -- tuning --------------------------------------------------------------------------------


class MacroF1(Evaluator):
    """Mean F1 over the classes seen; larger is better."""

    def _evaluate(self, dataset: DataFrame) -> float:
        return evaluate.f1_scores(dataset).first()["f1_macro"] or 0.0

    def isLargerBetter(self) -> bool:
        return True


def tuning_grid(model_type: str, rows: int) -> list[dict]:
    """Parameter sets searched per model type; one empty set for types that are not tuned."""
    if model_type == "logistic":
        return [{"c": c} for c in (0.1, 0.5, 1.0, 2.0, 5.0)]
    if model_type == "random_forest":
        return [{"trees": t, "depth": d, "min_split": s} for t in (100, 200) for d in (10, 20, None) for s in (2, 5)]
    if model_type == "xgboost":
        return [
            {"rounds": n, "depth": d, "rate": r, "row_share": s}
            for n in (100, 200) for d in (4, 6, 8) for r in (0.05, 0.1) for s in (0.7, 0.9)
        ]
    return [{}]


def tune(
    df: DataFrame, model_type: str = "logistic", grid: list[dict] | None = None, parallelism: int = 4,
    min_rows: int = _MIN_ROWS_TO_TUNE, id_column: str = "doc_id",
) -> tuple[dict, list[tuple[dict, float]]]:
    """Best parameters by 3-fold macro F1, and the score of every set tried.

    Folds are dealt by hash inside each class, so they don't depend on the partitioning.
    """
    rows = df.count()
    grid = tuning_grid(model_type, rows) if grid is None else grid
    if rows < min_rows or len(grid) < 2:
        return (grid[0] if len(grid) == 1 else {}), []
    if model_type in TREE_MODELS:
        sample = _tree_rows(df)
        search = trees.tune_forest if model_type == "random_forest" else trees.tune_boosting
        scores = search(df.sparkSession, sample, grid, tree_params(model_type), _FOLDS)
        sample.delete()
        return grid[max(range(len(grid)), key=lambda i: scores[i])], list(zip(grid, scores))
    weighted = written(with_folds(with_class_weight(df), id_column), "folds")
    # penalties scale with the rows that a fold's model is fitted on
    candidates = [estimator(model_type, rows * (_FOLDS - 1) // _FOLDS, **params) for params in grid]
    base = candidates[0]
    maps = [{base.getParam(p.name): v for p, v in c.extractParamMap().items() if c.isSet(p)} for c in candidates]
    search = CrossValidator(
        estimator=base, estimatorParamMaps=maps, evaluator=MacroF1(), numFolds=_FOLDS, parallelism=parallelism,
        foldCol="_fold",
    )
    scores = [float(m) for m in search.fit(weighted).avgMetrics]
    best = max(range(len(grid)), key=lambda i: scores[i])
    return grid[best], list(zip(grid, scores))


# -- calibration ------------------------------------------------------------------------------


@dataclass
class Curve:
    """A rising curve through the ends of its pooled blocks; straight between them, level outside."""

    x: list[float]
    y: list[float]

    def values(self, scores: np.ndarray) -> np.ndarray:
        return np.interp(scores, self.x, self.y)


def pooled(x: np.ndarray, hits: np.ndarray, weights: np.ndarray) -> Curve:
    """Isotonic fit of the share of hits: neighbouring points that fall are pooled until none does. ``x`` rises."""
    blocks: list[list[float]] = []  # first x, last x, hits, weight
    for point in zip(x.tolist(), x.tolist(), hits.tolist(), weights.tolist()):
        blocks.append(list(point))
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, last, more, weight = blocks.pop()
            blocks[-1][1], blocks[-1][2], blocks[-1][3] = last, blocks[-1][2] + more, blocks[-1][3] + weight
    ends = [(first, last, h / w) for first, last, h, w in blocks]
    points = [q for first, last, y in ends for q in ([(first, y)] if first == last else [(first, y), (last, y)])]
    return Curve([q[0] for q in points], [q[1] for q in points])


@dataclass
class CalibratedClassifier:
    """Average over folds of isotonic one-versus-rest calibrated probabilities."""

    folds: list[tuple[FittedClassifier, list[tuple[int, Curve]]]]
    classes: int
    calibrated: bool = True

    def transform(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c not in ("prediction", "scores", "probabilities")]
        work = df
        for i, (base, curves) in enumerate(self.folds):
            work = base.transform(work).withColumn(f"_p{i}", sc.normalise_sum(_calibrated("scores", curves, self.classes)))
            work = work.drop("prediction", "scores", "probabilities")
        summed = [
            sum((F.get(F.col(f"_p{i}"), F.lit(c)) for i in range(len(self.folds))), F.lit(0.0)) / len(self.folds)
            for c in range(self.classes)
        ]
        averaged = work.withColumn("probabilities", F.array(*summed))
        best = (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("double")
        return averaged.withColumn("prediction", best).select(
            *kept, "prediction", F.col("probabilities").alias("scores"), "probabilities"
        )


def _class_score(scores: str, c: int) -> Column:
    """Score of class ``c``; 0 when the fold's model never saw a class that high."""
    return F.coalesce(F.get(F.col(scores), F.lit(c)), F.lit(0.0))


def _calibrated(scores: str, curves: list[tuple[int, Curve]], classes: int) -> Column:
    """The calibrated score of every class, not yet normalised; of two classes the first has what the second leaves."""

    @F.arrow_udf("array<double>")
    def curved(column: pa.Array) -> pa.Array:
        given = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
        out = np.zeros((len(column), classes))
        for c, curve in curves:
            out[:, c] = curve.values(given[:, c] if c < given.shape[1] else np.zeros(len(given)))
        if classes == 2 and len(curves) == 1:
            out[:, 0] = 1.0 - out[:, 1]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * classes), pa.array(out.ravel()))

    return curved(F.col(scores))


def fit_curves(scored: DataFrame, classes: int) -> dict[int, list[tuple[int, Curve]]]:
    """The curves of every fold from ``(fold, label, scores)``, all of them in one job.

    Scores are binned to ten thousand steps per fold and class, so that what is pooled together stays bounded.
    """
    targets = [1] if classes == 2 else list(range(classes))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), _class_score("scores", c).alias("x")) for c in targets))).alias("s")
    long = scored.select("fold", "label", each).select("fold", "s.c", "s.x", (F.col("label") == F.col("s.c")).cast("double").alias("t"))
    spans = long.groupBy("fold", "c").agg(F.min("x").alias("low"), F.max("x").alias("high"))  # a row per fold and class
    step = F.when(F.col("high") > F.col("low"), F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * _SCORE_STEPS)).otherwise(0)
    binned = (
        long.join(F.broadcast(spans), ["fold", "c"]).groupBy("fold", "c", step.alias("step"))
        .agg(F.avg("x").alias("x"), F.sum("t").alias("hits"), F.count(F.lit(1)).cast("double").alias("weight"))
    )

    def pool(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("x")
        curve = pooled(*(rows[n].to_numpy() for n in ("x", "hits", "weight")))
        return pd.DataFrame({"fold": [key[0]], "c": [key[1]], "x": [curve.x], "y": [curve.y]})

    found: dict[int, list[tuple[int, Curve]]] = {}
    rows = binned.groupBy("fold", "c").applyInPandas(pool, "fold int, c int, x array<double>, y array<double>")
    for r in sorted(rows.collect(), key=lambda r: (r["fold"], r["c"])):  # a curve per fold and class
        found.setdefault(r["fold"], []).append((r["c"], Curve(list(r["x"]), list(r["y"]))))
    return found


def calibrate(
    df: DataFrame, model_type: str, id_column: str = "doc_id", classes: int | None = None,
    min_rows: int = _MIN_ROWS_TO_CALIBRATE, **params,
) -> FittedClassifier | CalibratedClassifier:
    """Isotonic calibration over 3 stratified hash folds; a plain fit when there are too few rows.

    Each fold's model is fitted on the other folds and scores its own; those scores are written once, and all
    curves of all folds come from them in one job.
    """
    if df.count() < min_rows:
        return fit_classifier(df, model_type, **params)
    classes = classes or int(df.agg(F.max("label")).first()[0]) + 1
    numbered = written(with_folds(df, id_column), "folds")
    bases = [fit_classifier(numbered.filter(F.col("_fold") != f).drop("_fold"), model_type, **dict(params)) for f in range(_FOLDS)]
    held = [
        base.transform(numbered.filter(F.col("_fold") == f)).select(F.lit(f).cast("int").alias("fold"), "label", "scores")
        for f, base in enumerate(bases)
    ]
    curves = fit_curves(written(reduce(DataFrame.unionByName, held), "fold-scores"), classes)
    return CalibratedClassifier([(base, curves.get(f, [])) for f, base in enumerate(bases)], classes)


# -- prediction ---------------------------------------------------------------------------------


def predict(fitted: FittedClassifier | CalibratedClassifier, df: DataFrame, classes: list[str]) -> DataFrame:
    """Add ``category`` (class name), ``confidence`` (largest probability) and the probability array."""
    names = F.array(*[F.lit(c) for c in classes])
    return fitted.transform(df).withColumns(
        {
            "category": F.get(names, F.col("prediction").cast("int")),
            "confidence": F.array_max("probabilities"),
        }
    )


def predict_category(
    fitted: FittedClassifier | CalibratedClassifier, df: DataFrame, classes: list[str], temperature: float = 0.85,
    unknown_below: float | None = None,
) -> DataFrame:
    """Class name and confidence per row.

    The temperature sharpens the confidence of uncalibrated models only; models
    without probabilities report the softmax (or sigmoid) of their margins.
    ``unknown_below`` names rows of low confidence ``Unknown``; off by default.
    """
    if temperature <= 0:
        raise ValueError(f"temperature must be > 0, got {temperature}")
    named = predict(fitted, df, classes)
    one_vs_rest = isinstance(getattr(fitted, "model", None), Transformer) and getattr(
        fitted, "model_type", ""
    ) == "svm"
    confidence: Column = F.col("confidence")
    if one_vs_rest:
        confidence = sc.margin_confidence("scores")
    elif not fitted.calibrated and temperature != 1.0:
        confidence = F.array_max(sc.temperature_scale("probabilities", temperature))
    result = named.withColumn("confidence", confidence)
    if unknown_below is not None:
        result = result.withColumn(
            "category", F.when(F.col("confidence") < unknown_below, "Unknown").otherwise(F.col("category"))
        )
    return result


# -- nearest neighbours ----------------------------------------------------------------------------


@dataclass
class NearestModel:
    """Distance-weighted votes of the ``k`` nearest rows of the fit, which lie in an index of block files."""

    index: nearest.MetricIndex
    k: int
    classes: int

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        """Vote shares; where a row of the fit is at distance 0, only such rows vote."""
        near, _ = self.index.near(values, self.k)
        query, label, distance = (near.column(c).to_numpy() for c in ("query", "label", "distance"))
        exact = np.bincount(query, distance == 0, len(values)) > 0
        with np.errstate(divide="ignore"):
            votes = np.where(exact[query], distance == 0, 1.0 / distance)
        out = np.bincount(query * self.classes + label, votes, len(values) * self.classes).reshape(-1, self.classes)
        return out / np.maximum(out.sum(1, keepdims=True), 1e-300)

    def column(self, spark: SparkSession, features: str = "features") -> Column:
        @F.arrow_udf("array<double>")
        def shares(column: pa.Array) -> pa.Array:
            values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), self.index.dim)
            offsets = np.arange(len(column) + 1, dtype=np.int32) * self.classes
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.probabilities(values).ravel()))

        return shares(vector_to_array(features))

    def save(self, spark: SparkSession, path: str) -> dict:
        """Index the rows in ``path``; returns what :meth:`load` takes."""
        index = nearest.build_index(self.index.items(spark), path, self.index.dim)
        return {"index": {k: v for k, v in vars(index).items() if k != "folder"}, "k": self.k, "classes": self.classes}

    @staticmethod
    def load(path: str, index: dict, k: int, classes: int) -> NearestModel:
        return NearestModel(nearest.MetricIndex(folder=path, **index), k, classes)


def fit_nearest(df: DataFrame, k: int = 7, block_rows: int = nearest.BLOCK_ROWS) -> NearestModel:
    """Index all rows of ``df``; a fit takes any number of them."""
    rows = df.select(F.col("label").cast("int").alias("label"), vector_to_array("features").alias("vector"))
    facts = rows.agg(F.max("label").alias("label"), F.max(F.size("vector")).alias("dim")).first()
    # equal distances go by a hash of the contents, whatever the partitions are; rows alike in both are alike in their votes
    numbered = rows.withColumn("item_id", F.xxhash64("vector", "label"))
    index = nearest.build_index(written(numbered, "nearest-rows"), shared_folder(df.sparkSession, "nearest"), facts["dim"] or 0, block_rows)
    return NearestModel(index, k, (facts["label"] if facts["label"] is not None else -1) + 1)


def predict_knn(
    train: DataFrame, rows: DataFrame, dim: int, k: int = 7, block_rows: int = nearest.BLOCK_ROWS
) -> DataFrame:
    """Distance-weighted vote of the ``k`` nearest training vectors.

    ``train``: ``item_id, label, vector``; ``rows``: ``query_id, vector``. With a
    training vector at distance 0 only such vectors vote. Returns ``query_id,
    prediction, confidence``.
    """
    near = nearest.nearest_items(rows, train, k, dim, block_rows)
    votes = near.groupBy("query_id", "label").agg(
        F.sum(F.when(F.col("distance") == 0, 1.0).otherwise(0.0)).alias("exact"),
        F.sum(F.when(F.col("distance") > 0, 1.0 / F.col("distance")).otherwise(0.0)).alias("weighted"),
    )
    totals = votes.groupBy("query_id").agg(
        F.sort_array(
            F.collect_list(F.struct("exact", "weighted", "label"))  # at most k entries
        ).alias("votes"),
        F.sum("exact").alias("exact"),
        F.sum("weighted").alias("weighted"),
    )
    vote = F.transform(
        "votes",
        lambda v: F.struct(
            F.when(F.col("exact") > 0, v["exact"] / F.col("exact")).otherwise(v["weighted"] / F.col("weighted")).alias("share"),
            v["label"].alias("label"),
        ),
    )
    best = F.array_max(F.transform(vote, lambda v: v["share"]))
    winner = F.array_min(F.transform(F.filter(vote, lambda v: v["share"] == best), lambda v: v["label"]))
    return totals.select("query_id", winner.alias("prediction"), best.alias("confidence"))
