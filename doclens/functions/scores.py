"""Score, decision and probability expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclens import lexicon as lx
from doclens.functions.text import ColumnLike, as_column, bind


def dot_product(a: ColumnLike, b: ColumnLike) -> Column:
    products = F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def cosine_similarity(a: ColumnLike, b: ColumnLike, normalised: bool = True) -> Column:
    """Cosine of two vectors; a plain dot product when both have unit length."""
    if normalised:
        return dot_product(a, b)
    return dot_product(a, b) / F.sqrt(dot_product(a, a) * dot_product(b, b))


def finite_score(score: ColumnLike) -> Column:
    """NaN and -Inf become 0, +Inf becomes 1."""
    s = as_column(score)
    return (
        F.when(F.isnan(s) | (s == float("-inf")), F.lit(0.0))
        .when(s == float("inf"), F.lit(1.0))
        .otherwise(s)
    )


def matched_skills(job_skills: ColumnLike, document_skills: ColumnLike) -> Column:
    return F.array_sort(F.array_intersect(as_column(job_skills), as_column(document_skills)))


def missing_skills(job_skills: ColumnLike, document_skills: ColumnLike) -> Column:
    return F.array_sort(F.array_except(as_column(job_skills), as_column(document_skills)))


def skill_overlap(job_skills: ColumnLike, document_skills: ColumnLike) -> Column:
    """Share of the job's skills found in the document; 0 when the job names none."""
    job = as_column(job_skills)
    shared = F.size(F.array_intersect(job, as_column(document_skills)))
    return F.when(F.size(job) > 0, shared / F.size(job)).otherwise(F.lit(0.0))


def combined_score(
    similarity: ColumnLike, skill_match: ColumnLike, similarity_weight: ColumnLike, skill_weight: ColumnLike
) -> Column:
    return as_column(similarity_weight) * as_column(similarity) + as_column(skill_weight) * as_column(
        skill_match
    )


def decide(
    score: ColumnLike,
    shortlist_threshold: ColumnLike | float = lx.SHORTLIST_THRESHOLD,
    review_threshold: ColumnLike | float = lx.REVIEW_THRESHOLD,
) -> Column:
    """Shortlist, Further Review or Reject; a missing score counts as 0."""
    value = F.coalesce(as_column(score), F.lit(0.0))

    def limit(threshold: ColumnLike | float) -> Column:
        return F.lit(threshold) if isinstance(threshold, (int, float)) else as_column(threshold)

    return (
        F.when(value >= limit(shortlist_threshold), F.lit("Shortlist"))
        .when(value >= limit(review_threshold), F.lit("Further Review"))
        .otherwise(F.lit("Reject"))
    )


def score_band(score: ColumnLike) -> Column:
    """Display band; its limits do not follow the job's thresholds."""
    value = as_column(score)
    return (
        F.when(value >= lx.SHORTLIST_THRESHOLD, F.lit("high"))
        .when(value >= lx.REVIEW_THRESHOLD, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def softmax(scores: ColumnLike) -> Column:
    """Probabilities from raw scores, shifted by the maximum first."""
    shifted = bind(
        as_column(scores),
        lambda s: bind(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top))),
    )
    return normalise_sum(shifted)


def normalise_sum(values: Column) -> Column:
    """Divide by the sum; a zero sum gives the uniform distribution."""
    return bind(
        values,
        lambda v: bind(
            F.aggregate(v, F.lit(0.0), lambda total, x: total + x),
            lambda total: F.transform(
                v, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0) / F.size(v))
            ),
        ),
    )


def temperature_scale(probabilities: ColumnLike, temperature: float = 0.85) -> Column:
    """Sharpen (T < 1) or flatten (T > 1) a probability array."""
    if temperature <= 0:
        raise ValueError(f"temperature must be > 0, got {temperature}")
    logits = F.transform(
        as_column(probabilities), lambda p: F.ln(F.greatest(p, F.lit(1e-12))) / F.lit(float(temperature))
    )
    return softmax(logits)


def margin_confidence(margins: ColumnLike) -> Column:
    """Sigmoid of a single margin, or the largest softmax value of many."""
    return bind(
        as_column(margins),
        lambda m: F.when(
            F.size(m) == 1, F.lit(1.0) / (F.lit(1.0) + F.exp(-F.get(m, F.lit(0))))
        ).otherwise(F.array_max(softmax(m))),
    )
