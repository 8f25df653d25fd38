"""Training and scoring of the document classifier."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegressionModel, OneVsRestModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens import lexicon as lx
from doclens.functions import text as tx
from doclens.operators import classify, evaluate, kernels, sampling, tokens, trees, vectors
from doclens.operators.cleaning import with_clean_text
from doclens.session import DEFAULT_SEED, written

_MODEL_CLASSES = {"logistic": LogisticRegressionModel, "svm": OneVsRestModel}


@dataclass
class FeaturePlan:
    """How a document becomes its feature vector. Statistics come from the train split only."""

    backend: str = "hashed"  # or "tfidf"
    use_structured: bool = True
    as_of_year: int | None = None
    max_chars: int | None = None
    scaler: vectors.ScalerModel | None = None
    tfidf: vectors.TfidfModel | None = None

    def reads(self) -> tuple:
        """What decides the result of ``prepare``."""
        return self.backend, self.use_structured, self.as_of_year, self.max_chars

    def prepare(self, df: DataFrame, raw_column: str, clean_column: str) -> DataFrame:
        """All that is read from the texts and needs no statistics: numbers, and the hashed vector or the text to be weighted."""
        work = df.withColumns(
            {"_clean": tx.coalesce_texts(clean_column), "_raw": tx.coalesce_texts(raw_column, clean_column)}
        )
        if self.use_structured:
            work = vectors.structured_features(work, "_raw", self.as_of_year)
        work = work.drop("_raw")
        if self.backend == "tfidf":
            return work
        return vectors.embed_documents(work, "_clean", "_vector", max_chars=self.max_chars).drop("_clean")

    def fit(self, prepared: DataFrame) -> FeaturePlan:
        if self.use_structured:
            self.scaler = vectors.fit_scaler(prepared)
        if self.backend == "tfidf":
            self.tfidf = vectors.fit_tfidf(prepared, "_clean")
        return self

    def transform(self, prepared: DataFrame) -> DataFrame:
        if self.use_structured:
            prepared = vectors.scale_features(prepared, self.scaler)
        embedded = self.tfidf.transform(prepared, "_clean", "_vector") if self.backend == "tfidf" else prepared
        numbers = lx.FEATURE_COLUMNS if self.use_structured else None
        assembled = vectors.assemble_features(embedded, "_vector", numbers, "features")
        return assembled.drop("_vector", "_clean", *lx.FEATURE_COLUMNS)


@dataclass
class DocumentClassifier:
    """Feature plan, class names and fitted model: one object to score and save."""

    features: FeaturePlan
    classes: list[str]
    fitted: classify.FittedClassifier | classify.CalibratedClassifier

    def vectorise(self, df: DataFrame, raw_column: str = "resume_text", clean_column: str = "cleaned_text") -> DataFrame:
        return self.features.transform(self.features.prepare(df, raw_column, clean_column))

    def predict(self, df: DataFrame, raw_column: str = "resume_text", clean_column: str = "cleaned_text") -> DataFrame:
        return classify.predict(self.fitted, self.vectorise(df, raw_column, clean_column), self.classes)

    def read_documents(self, df: DataFrame, text_column: str = "text") -> DataFrame:
        """Raw documents with ``cleaned_text`` and what the feature plan reads from them, whatever the model."""
        cleaned = with_clean_text(df, tx.section_weighted_text(text_column), "cleaned_text", stop_words=tx.default_stop_words())
        return self.features.prepare(cleaned, text_column, "cleaned_text")

    def predict_category(
        self, df: DataFrame, text_column: str = "text", temperature: float = 0.85, unknown_below: float | None = None,
        is_read: bool = False,
    ) -> DataFrame:
        """Add ``cleaned_text``, ``category``, ``confidence`` and ``backend`` to raw documents.

        With ``is_read`` the documents come from ``read_documents`` of a classifier whose plan reads the same.
        """
        work = self.features.transform(df if is_read else self.read_documents(df, text_column))
        scored = classify.predict_category(self.fitted, work, self.classes, temperature, unknown_below)
        return scored.withColumn("backend", F.lit(self.features.backend)).drop(
            "features", "prediction", "scores", "probabilities"
        )

    # -- one directory holds everything; every part is written by Spark

    def save(self, spark: SparkSession, path: str) -> str:
        folds = (
            self.fitted.folds if isinstance(self.fitted, classify.CalibratedClassifier) else [(self.fitted, [])]
        )
        indexes = [
            base.model.save(spark, f"{path}/fold{i}/model") if isinstance(base.model, classify.NearestModel) else None
            for i, (base, _) in enumerate(folds)
        ]
        config = {
            "backend": self.features.backend,
            "use_structured": self.features.use_structured,
            "as_of_year": self.features.as_of_year,
            "max_chars": self.features.max_chars,
            "classes": self.classes,
            "calibrated": self.fitted.calibrated,
            "scaler": vars(self.features.scaler) if self.features.scaler else None,
            "folds": [
                {
                    "model_type": base.model_type,
                    "fourier": vars(base.fourier) if base.fourier else None,
                    "trees": {"classes": base.model.classes, "start": base.model.start, "boosted": base.model.boosted}
                    if isinstance(base.model, trees.Ensemble) else None,
                    "machine": {"gamma": base.model.gamma, "classes": base.model.classes, "features": base.model.rows.shape[1]}
                    if isinstance(base.model, kernels.KernelMachine) else None,
                    "nearest": index,
                    "curves": [[c, curve.x, curve.y] for c, curve in curves],
                }
                for (base, curves), index in zip(folds, indexes)
            ],
        }
        spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/config"
        )
        if self.features.tfidf is not None:
            model = self.features.tfidf
            spark.createDataFrame(
                list(zip(range(len(model.terms)), model.terms, model.idf)), "position int, term string, idf double"
            ).write.mode("overwrite").parquet(f"{path}/vocabulary")
        for i, (base, _) in enumerate(folds):
            if isinstance(base.model, (trees.Ensemble, kernels.KernelMachine)):
                base.model.save(spark, f"{path}/fold{i}/model")
            elif not isinstance(base.model, classify.NearestModel):
                base.model.write().overwrite().save(f"{path}/fold{i}/model")
        return path


def load_classifier(spark: SparkSession, path: str) -> DocumentClassifier:
    config = json.loads(spark.read.text(f"{path}/config").first()["value"])
    features = FeaturePlan(
        config["backend"], config["use_structured"], config["as_of_year"], config["max_chars"]
    )
    if config["scaler"]:
        features.scaler = vectors.ScalerModel(**config["scaler"])
    if config["backend"] == "tfidf":
        terms = spark.read.parquet(f"{path}/vocabulary").orderBy("position").collect()
        features.tfidf = vectors.TfidfModel([r["term"] for r in terms], [r["idf"] for r in terms])
    folds = []
    for i, part in enumerate(config["folds"]):
        place = f"{path}/fold{i}/model"
        if part["trees"]:
            model = trees.Ensemble.load(spark, place, **part["trees"])
        elif part["machine"]:
            model = kernels.KernelMachine.load(spark, place, **part["machine"])
        elif part["nearest"]:
            model = classify.NearestModel.load(place, **part["nearest"])
        else:
            model = _MODEL_CLASSES[part["model_type"]].load(place)
        fourier = classify.FourierMap(**part["fourier"]) if part["fourier"] else None
        curves = [(c, classify.Curve(x, y)) for c, x, y in part["curves"]]
        folds.append((classify.FittedClassifier(part["model_type"], model, fourier), curves))
    if config["calibrated"]:
        fitted = classify.CalibratedClassifier(folds, len(config["classes"]))
    else:
        fitted = folds[0][0]
    return DocumentClassifier(features, config["classes"], fitted)


@dataclass
class TrainingResult:
    classifier: DocumentClassifier
    test_predictions: DataFrame
    holdout_predictions: DataFrame | None
    sizes: dict
    tuned: dict

    def metrics(self) -> DataFrame:
        """One row: scores on the test split, sizes, and the scores on the holdout if there is one."""
        row = evaluate.metrics_row(self.test_predictions)
        for name, value in self.sizes.items():
            row = row.withColumn(name, F.lit(value))
        if self.holdout_predictions is None:
            return row.withColumns(
                {
                    "holdout_size": F.lit(None).cast("long"),
                    "holdout_accuracy": F.lit(None).cast("double"),
                    "holdout_f1_macro": F.lit(None).cast("double"),
                }
            )
        held = evaluate.metrics_row(self.holdout_predictions, None)
        return row.withColumns(
            {
                "holdout_size": F.lit(self.sizes["holdout_size"]),
                "holdout_accuracy": held.select("accuracy").scalar(),
                "holdout_f1_macro": held.select("f1_macro").scalar(),
            }
        )

    def report(self) -> DataFrame:
        spark = self.test_predictions.sparkSession
        names = spark.createDataFrame([(c,) for c in self.classifier.classes], "label string")
        return evaluate.classification_report(self.test_predictions, names)

    def confusion(self) -> DataFrame:
        return evaluate.confusion_matrix(self.test_predictions, self.classifier.classes)


@dataclass
class TrainingData:
    """Feature vectors of all rows, written once and shared by every fit."""

    plan: FeaturePlan
    classes: list[str]
    rows: DataFrame  # id, label, is_test (NULL for holdout), features
    id_column: str
    sizes: dict

    @property
    def train(self) -> DataFrame:
        return self.rows.filter("NOT is_test")


def prepare_training(
    df: DataFrame,
    id_column: str = "doc_id",
    raw_column: str = "resume_text",
    clean_column: str = "cleaned_text",
    label_column: str = "category",
    backend: str = "hashed",
    use_structured: bool = True,
    test_size: float = 0.2,
    as_of_year: int | None = None,
    seed: int = DEFAULT_SEED,
) -> TrainingData:
    """Encode labels over all rows, split, fit the features on the train split, vectorise."""
    if clean_column not in df.columns:
        df = tokens.preprocess_documents(df, raw_column, id_column, clean_column)
    codes = vectors.label_codes(df, label_column)
    classes = [r[label_column] for r in codes.orderBy("code").collect()]  # class names only
    labelled = vectors.encode_labels(df, label_column, codes).withColumn("label", F.col("code").cast("double"))
    has_tag = "data_source" in df.columns
    if not has_tag:
        labelled = labelled.withColumn("data_source", F.lit("train"))
    is_holdout = F.coalesce(F.col("data_source") == "holdout", F.lit(False))
    rows = sampling.train_test_split(labelled.filter(~is_holdout), id_column, label_column, test_size, seed)
    if has_tag:
        rows = rows.unionByName(labelled.filter(is_holdout).withColumn("is_test", F.lit(None).cast("boolean")))
    plan = FeaturePlan(backend, use_structured, as_of_year)
    base = rows.select(id_column, raw_column, clean_column, "label", "is_test")
    prepared = written(plan.prepare(base, raw_column, clean_column).drop(raw_column, clean_column), "prepared")
    plan.fit(prepared.filter("NOT is_test"))
    ready = written(plan.transform(prepared).select(id_column, "label", "is_test", "features"), "features")
    by_flag = {r["is_test"]: r["count"] for r in ready.groupBy("is_test").count().collect()}
    ready = ready.coalesce(classify.fit_tasks(df.sparkSession, sum(by_flag.values())))
    first = ready.select("features").first()
    sizes = {
        "train_size": by_flag.get(False, 0),
        "test_size": by_flag.get(True, 0),
        "holdout_size": by_flag.get(None, 0),
        "n_features": first["features"].size if first else 0,
        "n_classes": len(classes),
    }
    return TrainingData(plan, classes, ready, id_column, sizes)


def fit_prepared(
    data: TrainingData, model_type: str = "logistic", calibrate: bool = True, tune: bool = True, **params
) -> TrainingResult:
    """Tune, fit or calibrate one model type on the train split, then predict the test split and the holdout."""
    tuned: dict = {}
    rows = classify.fit_rows(data.train)
    if tune and not params:
        tuned, _ = classify.tune(rows, model_type, id_column=data.id_column)
    chosen = {**tuned, **params}
    if calibrate:
        fitted = classify.calibrate(rows, model_type, data.id_column, len(data.classes), **chosen)
    else:
        fitted = classify.fit_classifier(rows, model_type, **chosen)
    names = F.array(*[F.lit(c) for c in data.classes])

    def predicted(part: DataFrame) -> DataFrame:
        out = classify.predict(fitted, part, data.classes).select(
            data.id_column,
            F.get(names, F.col("label").cast("int")).alias("label"),
            F.col("category").alias("prediction"),
            "confidence",
        )
        return written(out, "predictions")

    holdout = predicted(data.rows.filter("is_test IS NULL")) if data.sizes["holdout_size"] else None
    return TrainingResult(
        DocumentClassifier(data.plan, data.classes, fitted),
        predicted(data.rows.filter("is_test")),
        holdout,
        data.sizes,
        tuned,
    )


def train_classifier(
    df: DataFrame, model_type: str = "logistic", calibrate: bool = True, tune: bool = True,
    params: dict | None = None, **preparation,
) -> TrainingResult:
    """Split, fit features on the train split, tune, calibrate, evaluate.

    ``params`` are the model's parameters; ``preparation`` goes to ``prepare_training``.
    """
    return fit_prepared(prepare_training(df, **preparation), model_type, calibrate, tune, **(params or {}))


def compare_models(
    df: DataFrame, models: dict[str, dict] | None = None, calibrate: bool = True, tune: bool = True, **preparation
) -> DataFrame:
    """One metrics row per model type on the same features, with ``is_best`` on the highest macro F1.

    ``models`` maps the model type to its parameters.
    """
    data = prepare_training(df, **preparation)
    rows = []
    for model_type, params in (models or {m: {} for m in classify.COMPARED_MODELS}).items():
        result = fit_prepared(data, model_type, calibrate, tune, **params)
        scores = evaluate.metrics_row(result.test_predictions).first()
        rows.append((model_type, *[scores[c] for c in ("accuracy", "f1_macro", "f1_weighted", "calibration_error")]))
    best = max(rows, key=lambda r: r[2] or 0.0)[0]
    return df.sparkSession.createDataFrame(
        [(*r, r[0] == best) for r in rows],
        "model string, accuracy double, f1_macro double, f1_weighted double, calibration_error double, is_best boolean",
    )
