"""Queries of model fits, tuning, calibration, training and prediction.

Fits run with the library defaults on all labelled rows of the train split. A fit has no SQL form; what is determined about its result has: row counts, classes, ranges,
and that the model fits the rows it was trained on.
"""

from functools import lru_cache

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from doclens.catalog.base import AS_OF_YEAR, derived, query, table, with_views
from doclens.catalog.evaluation import _KNN
from doclens.catalog.ranking import _SCORES, SQL_RANKED, _flat
from doclens.catalog.text import SQL_PREPROCESSED
from doclens.operators import classify, evaluate, sampling
from doclens.plans import prepare
from doclens.plans import screen as screening
from doclens.plans import train
from doclens.session import shared_folder, written

_LEAST_TRAIN_ACCURACY = 0.2  # the labels of the embeddings are ten and random


def _embedded(spark, d):
    """Embeddings as ML rows with a stratified test flag, written once."""
    split = sampling.train_test_split(table(spark, d, "embeddings"), "vec_id", "label")
    rows = split.select(
        "vec_id",
        F.col("label").cast("double").alias("label"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        "is_test",
    )
    return written(rows, "embedded")


def _facts(scored, test_rows):
    """What any fitted model must give: known classes, confidences in range, probabilities of sum 1."""
    return scored.agg(
        F.count_if(test_rows).alias("test_rows"),
        F.bool_and(F.col("prediction").isin([float(i) for i in range(10)])).alias("known_classes"),
        F.bool_and(F.array_max("probabilities").between(0, 1 + 1e-9)).alias("in_range"),
        F.bool_and(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-6).alias("sum_to_one"),
        (
            F.count_if(~test_rows & (F.col("prediction") == F.col("label"))) >= _LEAST_TRAIN_ACCURACY * F.count_if(~test_rows)
        ).alias("fits_train"),
    )


_FACTS = """SELECT CAST(ceil(0.2 * count(*)) AS BIGINT) AS test_rows, true AS known_classes, true AS in_range,
       true AS sum_to_one, true AS fits_train FROM embeddings"""


def _fit_and_score(spark, d, model_type):
    rows = _embedded(spark, d)
    fitted = classify.fit_classifier(classify.fit_rows(rows.filter("NOT is_test")), model_type)
    return _facts(fitted.transform(rows), F.col("is_test"))


@query("fit_logistic", _FACTS)
def _(spark, d):
    return _fit_and_score(spark, d, "logistic")


@query("fit_random_forest", _FACTS)
def _(spark, d):
    return _fit_and_score(spark, d, "random_forest")


@query("fit_gradient_boosting", _FACTS)
def _(spark, d):
    return _fit_and_score(spark, d, "gradient_boosting")


@query("fit_boosted_softprob", _FACTS)
def _(spark, d):
    return _fit_and_score(spark, d, "xgboost")


@query("fit_svm", _FACTS)
def _(spark, d):
    return _fit_and_score(spark, d, "svm")


@query(
    "fit_knn",
    f"WITH {_KNN} SELECT query_id, CAST(prediction AS DOUBLE) AS prediction, round(confidence, 6) AS confidence, true AS sum_to_one FROM knn",
)
def _(spark, d):
    """Trained on all rows of the split, saved, loaded, and asked for the others."""
    rows = _embedded(spark, d)
    fitted = classify.fit_classifier(rows.filter("NOT is_test"), "knn")
    whole = train.DocumentClassifier(train.FeaturePlan(use_structured=False), [str(i) for i in range(10)], fitted)
    loaded = train.load_classifier(spark, whole.save(spark, shared_folder(spark, "model"))).fitted
    scored = loaded.transform(rows.filter("is_test"))
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x)
    return scored.select(
        F.col("vec_id").alias("query_id"), "prediction", F.round(F.array_max("probabilities"), 6).alias("confidence"), (F.abs(total - 1) < 1e-9).alias("sum_to_one")
    )


def _tuned(spark, d, model_type):
    rows = _embedded(spark, d)
    best, scores = classify.tune(classify.fit_rows(rows.filter("NOT is_test")), model_type, parallelism=8, id_column="vec_id")
    top = max(s for _, s in scores)
    return [(p, 0 <= s <= 1, next(t for q, t in scores if q == best) == top) for p, s in scores]


@query(
    "tune",
    "SELECT CAST(c AS DOUBLE) AS c, true AS in_range, true AS best_is_best FROM (VALUES (0.1), (0.5), (1.0), (2.0), (5.0)) AS g(c)",
)
def _(spark, d):
    rows = [(p["c"], *facts) for p, *facts in _tuned(spark, d, "logistic")]
    return spark.createDataFrame(rows, "c double, in_range boolean, best_is_best boolean")


@query(
    "tune_random_forest",
    """SELECT CAST(t AS INTEGER) AS trees, CAST(d AS INTEGER) AS depth, CAST(s AS INTEGER) AS min_split, true AS in_range, true AS best_is_best
    FROM (VALUES (100), (200)) AS a(t), (VALUES (10), (20), (NULL)) AS b(d), (VALUES (2), (5)) AS c(s)""",
)
def _(spark, d):
    rows = [(p["trees"], p["depth"], p["min_split"], *facts) for p, *facts in _tuned(spark, d, "random_forest")]
    return spark.createDataFrame(rows, "trees int, depth int, min_split int, in_range boolean, best_is_best boolean")


@query(
    "tune_boosted_softprob",
    """SELECT CAST(n AS INTEGER) AS rounds, CAST(d AS INTEGER) AS depth, CAST(r AS DOUBLE) AS rate, CAST(s AS DOUBLE) AS row_share,
           true AS in_range, true AS best_is_best
    FROM (VALUES (100), (200)) AS a(n), (VALUES (4), (6), (8)) AS b(d), (VALUES (0.05), (0.1)) AS c(r), (VALUES (0.7), (0.9)) AS e(s)""",
)
def _(spark, d):
    rows = [(p["rounds"], p["depth"], p["rate"], p["row_share"], *facts) for p, *facts in _tuned(spark, d, "xgboost")]
    return spark.createDataFrame(rows, "rounds int, depth int, rate double, row_share double, in_range boolean, best_is_best boolean")


@query("calibrate", _FACTS.replace("true AS fits_train", "true AS three_folds"))
def _(spark, d):
    rows = _embedded(spark, d)
    fitted = classify.calibrate(classify.fit_rows(rows.filter("NOT is_test")), "logistic", "vec_id")
    return _facts(fitted.transform(rows), F.col("is_test")).drop("fits_train").withColumn("three_folds", F.lit(len(fitted.folds) == 3))


@query(
    "prepare_training_table",
    with_views(
        f"""WITH {SQL_PREPROCESSED},
        usable AS (SELECT resume_id, category FROM resumes WHERE regexp_matches(resume_text, '\\S') AND regexp_matches(category, '\\S')
                   QUALIFY row_number() OVER (PARTITION BY resume_text ORDER BY resume_id) = 1),
        tagged AS (SELECT resume_id, category, cleaned_text, CASE WHEN row_number() OVER (ORDER BY md5('42|' || resume_id))
                     <= greatest(1, floor(count(*) OVER () * CAST(0.2 AS DOUBLE))) THEN 'holdout' ELSE 'train' END AS data_source
                   FROM usable JOIN preprocessed USING (resume_id)),
        sizes AS (SELECT category, data_source, count(*) AS ids, min(md5(cleaned_text)) AS first_text, max(md5(cleaned_text)) AS last_text
                  FROM tagged GROUP BY category, data_source)
        SELECT category, data_source, CASE WHEN data_source = 'train' THEN (SELECT max(ids) FROM sizes WHERE data_source = 'train') ELSE ids END AS rows,
               ids, first_text, last_text FROM sizes""",
        "resumes",
    ),
)
def _(spark, d):
    raw = derived(spark, d, "resumes").select("resume_id", "category", "resume_text")
    done = prepare.prepare_training_table(raw, "resume_id")
    text = F.md5("cleaned_text")
    return done.groupBy("category", "data_source").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("resume_id").alias("ids"), F.min(text).alias("first_text"), F.max(text).alias("last_text")
    )


def _training_table(spark, d):
    resumes = derived(spark, d, "resumes").select("resume_id", "category", "data_source", "resume_text")
    return resumes.filter("resume_text IS NOT NULL")


@lru_cache(maxsize=2)
def _trained(spark, d, **options):
    """One trained model for all queries of a session that use it: tuned and calibrated, library defaults."""
    return train.train_classifier(_training_table(spark, d), id_column="resume_id", as_of_year=AS_OF_YEAR, **options)


_SIZES = """
WITH t AS (SELECT * FROM resumes WHERE resume_text IS NOT NULL), h AS (SELECT count(*) AS n FROM t WHERE data_source = 'holdout'),
r AS (SELECT count(*) AS n FROM t WHERE data_source <> 'holdout')
SELECT CAST(r.n - ceil(0.2 * r.n) AS BIGINT) AS train_size, CAST(ceil(0.2 * r.n) AS BIGINT) AS test_size, h.n AS holdout_size,
       (SELECT count(DISTINCT category) FROM t) AS n_classes, true AS in_range FROM r, h
"""


@query("train_classifier", with_views(_SIZES, "resumes"))
def _(spark, d):
    row = _trained(spark, d).metrics()
    scores = [F.col(c).between(0, 1) for c in ("accuracy", "f1_macro", "f1_weighted", "holdout_accuracy", "holdout_f1_macro")]
    every = scores[0] & scores[1] & scores[2] & scores[3] & scores[4]
    return row.select(*(F.col(c).cast("long").alias(c) for c in ("train_size", "test_size", "holdout_size", "n_classes")), every.alias("in_range"))


def _known(result):
    return F.col("category").isin(result.classifier.classes), F.col("confidence").between(0, 1 + 1e-9)


@query(
    "predict",
    with_views("SELECT resume_id, true AS known_class, true AS in_range FROM resumes WHERE resume_text IS NOT NULL", "resumes"),
)
def _(spark, d):
    result = _trained(spark, d)
    docs = _training_table(spark, d).withColumn("cleaned_text", F.lower("resume_text"))
    known, ranged = _known(result)
    return result.classifier.predict(docs).select("resume_id", known.alias("known_class"), ranged.alias("in_range"))


@query("predict_category", "SELECT doc_id, true AS known_class, true AS in_range, 'hashed' AS backend FROM documents")
def _(spark, d):
    result = _trained(spark, d)
    known, ranged = _known(result)
    docs = table(spark, d, "documents").select("doc_id", "text")
    return result.classifier.predict_category(docs).select("doc_id", known.alias("known_class"), ranged.alias("in_range"), "backend")


@query("save_and_load_model", "SELECT doc_id, true AS same FROM documents")
def _(spark, d):
    classifier = _trained(spark, d).classifier
    loaded = train.load_classifier(spark, classifier.save(spark, shared_folder(spark, "model")))
    docs = table(spark, d, "documents").select("doc_id", "text")
    read = written(classifier.read_documents(docs).drop("text", "cleaned_text"), "read")  # once for both models
    before = classifier.predict_category(read, is_read=True).select("doc_id", "category", "confidence")
    same_reading = loaded.features.reads() == classifier.features.reads()
    again = loaded.predict_category(read if same_reading else docs, is_read=same_reading)
    after = again.select("doc_id", F.col("category").alias("c"), F.col("confidence").alias("p"))
    return before.join(after, "doc_id").select("doc_id", ((F.col("category") == F.col("c")) & (F.abs(F.col("confidence") - F.col("p")) < 1e-9)).alias("same"))


@query(
    "compare_models",
    """SELECT model_type, true AS in_range, true AS best_is_best
    FROM (VALUES ('random_forest'), ('logistic'), ('svm'), ('gradient_boosting'), ('xgboost')) AS m(model_type)""",
)
def _(spark, d):
    # tuning and calibration multiply the fits (README); they have queries of their own
    compared = train.compare_models(_training_table(spark, d), id_column="resume_id", as_of_year=AS_OF_YEAR, tune=False, calibrate=False)
    scores = [F.col(c).between(0, 1) for c in ("accuracy", "f1_macro", "f1_weighted", "calibration_error")]
    top = compared.agg(F.max("f1_macro")).first()[0]
    return compared.select(
        F.col("model").alias("model_type"), (scores[0] & scores[1] & scores[2] & scores[3]).alias("in_range"),
        (~F.col("is_best") | (F.col("f1_macro") == top)).alias("best_is_best"),
    )


@query(
    "screen",
    with_views(
        f"""WITH resumes AS (SELECT doc_id AS resume_id, text AS resume_text FROM documents), {SQL_RANKED}
        SELECT job_id, rank, resume_id AS doc_id, {_SCORES}, decision, matched_skills, missing_skills, true AS known_class,
               CAST(NULL AS VARCHAR) AS prediction_error FROM ranked""",
        "jobs",
    ),
)
def _(spark, d):
    result = _trained(spark, d)
    documents = table(spark, d, "documents").select("doc_id", "text")
    rows = screening.screen(derived(spark, d, "jobs"), documents, result.classifier)
    known = F.col("predicted_category").isin(result.classifier.classes)
    return _flat(rows).select(
        "job_id", "rank", "doc_id", "similarity_score", "skill_match_score", "combined_score", "decision", "matched_skills",
        "missing_skills", known.alias("known_class"), "prediction_error",
    )
