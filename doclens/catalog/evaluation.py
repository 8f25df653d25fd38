"""Queries of the metrics, on language guesses for every document and on nearest neighbours."""

from pyspark.sql import functions as F

from doclens.catalog.base import derived, query, table, with_views
from doclens.catalog.sampling import SQL_SPLIT
from doclens.operators import classify, evaluate, sampling


def _predictions(spark, d):
    return derived(spark, d, "predictions")


SQL_CLASSES = """
seen AS (SELECT label AS class FROM {source} UNION SELECT prediction FROM {source}),
scores AS (SELECT class, support, predicted, hits,
    CASE WHEN predicted > 0 THEN CAST(hits AS DOUBLE) / predicted ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN CAST(hits AS DOUBLE) / support ELSE 0 END AS recall,
    CASE WHEN support + predicted > 0 THEN 2.0 * CAST(hits AS DOUBLE) / (support + predicted) ELSE 0 END AS f1
  FROM (SELECT class, (SELECT count(*) FROM {source} WHERE label = class) AS support,
               (SELECT count(*) FROM {source} WHERE prediction = class) AS predicted,
               (SELECT count(*) FROM {source} WHERE prediction = class AND label = class) AS hits FROM seen))
"""
_P = SQL_CLASSES.format(source="predictions")


@query("accuracy", with_views("SELECT round(avg(CASE WHEN label = prediction THEN 1 ELSE 0 END), 6) AS accuracy FROM predictions", "predictions"))
def _(spark, d):
    return evaluate.accuracy(_predictions(spark, d)).select(F.round("accuracy", 6).alias("accuracy"))


@query(
    "f1_scores",
    with_views(
        f"""WITH {_P} SELECT round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted
        FROM scores""",
        "predictions",
    ),
)
def _(spark, d):
    return evaluate.f1_scores(_predictions(spark, d)).select(
        F.round("f1_macro", 6).alias("f1_macro"), F.round("f1_weighted", 6).alias("f1_weighted")
    )


@query(
    "classification_report",
    with_views(
        f"""WITH {_P}, rows AS (
        SELECT class AS name, precision, recall, f1, CAST(support AS BIGINT) AS support FROM scores
        UNION ALL SELECT 'accuracy', NULL, NULL, CAST(sum(hits) AS DOUBLE) / sum(support), sum(support) FROM scores
        UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM scores
        UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                         sum(f1 * support) / sum(support), sum(support) FROM scores)
        SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
               CAST(support AS BIGINT) AS support FROM rows""",
        "predictions",
    ),
)
def _(spark, d):
    report = evaluate.classification_report(_predictions(spark, d))
    return report.select("name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "confusion_matrix",
    with_views(
        """WITH classes AS (SELECT label AS c FROM predictions UNION SELECT prediction FROM predictions)
        SELECT a.c AS label, b.c AS prediction,
               (SELECT count(*) FROM predictions p WHERE p.label = a.c AND p.prediction = b.c) AS n
        FROM classes a, classes b""",
        "predictions",
    ),
)
def _(spark, d):
    return evaluate.confusion_matrix(_predictions(spark, d))


@query(
    "calibration_error",
    with_views(
        """WITH bins AS (SELECT greatest(ceil(confidence * 10) - 1, 0) AS bin,
                    avg(CASE WHEN label = prediction THEN 1.0 ELSE 0 END) AS a, avg(confidence) AS c
             FROM predictions GROUP BY 1)
        SELECT round(avg(abs(a - c)), 6) AS calibration_error FROM bins""",
        "predictions",
    ),
)
def _(spark, d):
    return evaluate.calibration_error(_predictions(spark, d)).select(
        F.round("calibration_error", 6).alias("calibration_error")
    )


@query(
    "holdout_metrics",
    with_views(
        " UNION ALL ".join(
            f"""SELECT '{part}' AS data_source, CAST(sum(support) AS BIGINT) AS size,
            round(CAST(sum(hits) AS DOUBLE) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS f1_macro
            FROM (WITH part AS (SELECT * FROM predictions WHERE data_source = '{part}'),
                  {SQL_CLASSES.format(source='part')} SELECT * FROM scores)"""
            for part in ("train", "holdout")
        ),
        "predictions",
    ),
)
def _(spark, d):
    return evaluate.holdout_metrics(_predictions(spark, d)).select(
        "data_source", "size", F.round("accuracy", 6).alias("accuracy"), F.round("f1_macro", 6).alias("f1_macro")
    )


_PROBABILITIES = "p_de, p_en, p_es, p_fr"


@query(
    "temperature_scale",
    with_views(
        f"""WITH scaled AS (SELECT id, list_transform([{_PROBABILITIES}], lambda p: ln(greatest(p, 1e-12)) / CAST(0.85 AS DOUBLE)) AS z
              FROM predictions),
        shifted AS (SELECT id, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM scaled)
        SELECT id, round(e[1] / list_sum(e), 6) AS p_de, round(e[2] / list_sum(e), 6) AS p_en,
               round(e[3] / list_sum(e), 6) AS p_es, round(e[4] / list_sum(e), 6) AS p_fr FROM shifted""",
        "predictions",
    ),
)
def _(spark, d):
    from doclens.functions import scores as sc

    scaled = _predictions(spark, d).select(
        "id", sc.temperature_scale(F.array("p_de", "p_en", "p_es", "p_fr")).alias("p")
    )
    return scaled.select(
        "id", *[F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate(("p_de", "p_en", "p_es", "p_fr"))]
    )


@query(
    "margin_confidence",
    with_views(
        """SELECT id, round(1 / (1 + exp(-(p_en - p_fr))), 6) AS one_margin,
        round(1 / (exp(p_de - m) + exp(p_en - m) + exp(p_es - m) + exp(p_fr - m)), 6) AS many_margins
        FROM (SELECT *, greatest(p_de, p_en, p_es, p_fr) AS m FROM predictions)""",
        "predictions",
    ),
)
def _(spark, d):
    from doclens.functions import scores as sc

    one = sc.margin_confidence(F.array(F.col("p_en") - F.col("p_fr")))
    many = sc.margin_confidence(F.array("p_de", "p_en", "p_es", "p_fr"))
    return _predictions(spark, d).select(
        "id", F.round(one, 6).alias("one_margin"), F.round(many, 6).alias("many_margins")
    )


# -- nearest neighbours on the embeddings --------------------------------------------------

_KNN = f"""
{SQL_SPLIT.format(label='label', source='embeddings', hash="md5('42|' || vec_id)")},
pairs AS (SELECT q.vec_id AS query_id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY d, t.vec_id) AS place, d
          FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM split WHERE is_test) q
          CROSS JOIN (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM split WHERE NOT is_test) t,
          LATERAL (SELECT list_distance(q.v, t.v) AS d)),
near AS (SELECT * FROM pairs WHERE place <= 7),
votes AS (SELECT query_id, label, sum(CASE WHEN d = 0 THEN 1.0 ELSE 0 END) AS exact,
                 sum(CASE WHEN d > 0 THEN 1 / d ELSE 0 END) AS weighted FROM near GROUP BY ALL),
shares AS (SELECT query_id, label, CASE WHEN sum(exact) OVER (PARTITION BY query_id) > 0
             THEN exact / sum(exact) OVER (PARTITION BY query_id)
             ELSE weighted / sum(weighted) OVER (PARTITION BY query_id) END AS share FROM votes),
knn AS (SELECT query_id, label AS prediction, share AS confidence FROM shares
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY share DESC, label) = 1)
"""


def split_embeddings(spark, d):
    return sampling.train_test_split(table(spark, d, "embeddings"), "vec_id", "label")


def knn_predictions(spark, d):
    split = split_embeddings(spark, d)
    train = split.filter("NOT is_test").select(F.col("vec_id").alias("item_id"), "label", F.col("embedding").alias("vector"))
    test = split.filter("is_test").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return classify.predict_knn(train, test, dim=64)


@query(
    "predict_knn",
    f"WITH {_KNN} SELECT query_id, CAST(prediction AS BIGINT) AS prediction, round(confidence, 6) AS confidence FROM knn",
)
def _(spark, d):
    return knn_predictions(spark, d).select(
        "query_id", F.col("prediction").cast("long").alias("prediction"), F.round("confidence", 6).alias("confidence")
    )


@query(
    "knn_metrics",
    f"""WITH {_KNN}, judged AS (SELECT CAST(s.label AS BIGINT) AS label, CAST(k.prediction AS BIGINT) AS prediction, confidence
          FROM split s JOIN knn k ON s.vec_id = k.query_id), {SQL_CLASSES.format(source='judged')},
    bins AS (SELECT greatest(ceil(confidence * 10) - 1, 0) AS bin, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0 END) AS a,
                    avg(confidence) AS c FROM judged GROUP BY 1)
    SELECT round(CAST(sum(hits) AS DOUBLE) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS f1_macro,
           round(sum(f1 * support) / sum(support), 6) AS f1_weighted,
           (SELECT round(avg(abs(a - c)), 6) FROM bins) AS calibration_error FROM scores""",
)
def _(spark, d):
    truth = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    judged = knn_predictions(spark, d).join(truth, "query_id")
    row = evaluate.metrics_row(judged)
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


@query(
    "split_sizes",
    f"""WITH {SQL_SPLIT.format(label='label', source='embeddings', hash="md5('42|' || vec_id)")}
    SELECT count(*) FILTER (WHERE NOT is_test) AS train_size, count(*) FILTER (WHERE is_test) AS test_size,
           CAST(max(len(embedding)) AS BIGINT) AS n_features,
           (SELECT string_agg(c, '|' ORDER BY c) FROM (SELECT DISTINCT CAST(label AS VARCHAR) AS c FROM embeddings)) AS classes
    FROM split""",
)
def _(spark, d):
    return evaluate.split_sizes(split_embeddings(spark, d), features="embedding")
