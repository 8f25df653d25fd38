"""Classification metrics as aggregates over a prediction table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction", *by: str) -> DataFrame:
    """Counts per (label, prediction): the one pass over the rows every metric starts from.

    Combines map-side; the result has at most classes x classes rows per group.
    """
    return df.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("int")).alias("accuracy"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def class_scores(
    df: DataFrame, label: str = "label", prediction: str = "prediction", *by: str, classes: DataFrame | None = None
) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined.

    Classes are those seen in labels or predictions, plus every row of
    ``classes`` (``label``) when given.
    """
    counts = confusion_counts(df, label, prediction, *by)
    same = F.col("label") == F.col("prediction")

    def side(name: str, support: Column, predicted: Column, hits: Column) -> Column:
        return F.struct(
            F.col(name).alias("class"),
            support.cast("long").alias("support"),
            predicted.cast("long").alias("predicted"),
            hits.cast("long").alias("hits"),
        )

    n, none = F.col("n"), F.lit(0)
    sides = counts.select(
        *by,
        F.inline(
            F.array(side("label", n, none, F.when(same, n).otherwise(none)), side("prediction", none, n, none))
        ),
    )
    if classes is not None:
        zero = F.lit(0).cast("long")
        sides = sides.unionByName(
            classes.select(
                F.col("label").alias("class"), zero.alias("support"), zero.alias("predicted"), zero.alias("hits")
            )
        )
    summed = sides.groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )
    scored = summed.withColumn("precision", _ratio(F.col("hits"), F.col("predicted"))).withColumn(
        "recall", _ratio(F.col("hits"), F.col("support"))
    )
    return scored.withColumn(
        "f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    ).select(*by, "class", "precision", "recall", "f1", "support", "predicted", "hits")


def f1_scores(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``f1_macro`` over the classes seen, ``f1_weighted`` by support."""
    return class_scores(df, label, prediction).agg(
        F.avg("f1").alias("f1_macro"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
    )


def classification_report(
    df: DataFrame, classes: DataFrame | None = None, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Rows per class, then ``accuracy``, ``macro avg`` and ``weighted avg``."""
    scores = class_scores(df, label, prediction, classes=classes)
    total = F.sum("support")
    nothing = F.lit(None).cast("double")
    hit_share = _ratio(F.sum("hits"), total)
    rows = [
        scores.select(F.col("class").cast("string").alias("name"), "precision", "recall", "f1", "support"),
        scores.agg(
            nothing.alias("precision"), nothing.alias("recall"), hit_share.alias("f1"), total.alias("support")
        ).select(F.lit("accuracy").alias("name"), "*"),
        scores.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], total.alias("support")).select(
            F.lit("macro avg").alias("name"), "*"
        ),
        scores.agg(
            *[_ratio(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in ("precision", "recall", "f1")],
            total.alias("support"),
        ).select(F.lit("weighted avg").alias("name"), "*"),
    ]
    return reduce(DataFrame.unionByName, rows)


def confusion_matrix(
    df: DataFrame, classes: list | None = None, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Dense ``(label, prediction, n)``; absent pairs are 0.

    ``classes`` is the class list; by default it is read from the counts. The
    grid is an explode over that list, at most classes x classes rows.
    """
    counts = confusion_counts(df, label, prediction)
    if classes is None:
        seen = counts.select(F.explode(F.array("label", "prediction")).alias("c")).distinct()
        classes = sorted(r["c"] for r in seen.collect())
    class_type = dict(counts.dtypes)["label"]
    names = F.array(*[F.lit(c).cast(class_type) for c in classes])
    grid = (
        df.sparkSession.range(1)
        .select(F.explode(names).alias("label"))
        .select("label", F.explode(names).alias("prediction"))
    )
    return grid.join(counts, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def calibration_bins(
    df: DataFrame, confidence: str = "confidence", label: str = "label", prediction: str = "prediction", bins: int = 10
) -> DataFrame:
    """Accuracy and mean confidence per equal-width confidence bin (lo, hi]; empty bins are absent."""
    bin_no = F.greatest(F.ceil(F.col(confidence) * bins) - 1, F.lit(0)).cast("int")
    return df.groupBy(bin_no.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(label) == F.col(prediction)).cast("int")).alias("accuracy"),
        F.avg(confidence).alias("mean_confidence"),
    )


def calibration_error(
    df: DataFrame,
    confidence: str = "confidence",
    label: str = "label",
    prediction: str = "prediction",
    bins: int = 10,
) -> DataFrame:
    """Unweighted mean gap between accuracy and confidence over the non-empty bins."""
    table = calibration_bins(df, confidence, label, prediction, bins)
    return table.agg(F.avg(F.abs(F.col("accuracy") - F.col("mean_confidence"))).alias("calibration_error"))


def holdout_metrics(
    df: DataFrame, source: str = "data_source", label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Size, accuracy and macro F1 per ``data_source``; no row for an empty one."""
    return (
        class_scores(df, label, prediction, source)
        .groupBy(source)
        .agg(
            F.sum("support").alias("size"),
            _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
            F.avg("f1").alias("f1_macro"),
        )
    )


def split_sizes(df: DataFrame, flag: str = "is_test", label: str = "label", features: str | None = None) -> DataFrame:
    """Train and test row counts, number of features and the sorted class list."""
    classes = F.array_join(F.sort_array(F.collect_set(F.col(label).cast("string"))), "|")
    width = F.lit(None).cast("long") if features is None else F.max(F.size(features)).cast("long")
    return df.agg(
        F.count_if(~F.col(flag)).alias("train_size"),
        F.count_if(F.col(flag)).alias("test_size"),
        width.alias("n_features"),
        classes.alias("classes"),
    )


def metrics_row(df: DataFrame, confidence: str | None = "confidence") -> DataFrame:
    """One row: accuracy, macro and weighted F1 and, given a confidence, the calibration error."""
    scores = class_scores(df)
    row = scores.agg(
        _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
    )
    if confidence is None:
        return row.withColumn("calibration_error", F.lit(None).cast("double"))
    error = calibration_error(df, confidence)
    return row.withColumn("calibration_error", error.scalar())
