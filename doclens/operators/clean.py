"""Cleaning, normalising and filtering of document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens import lexicon as lx
from doclens.functions import text as tx
from doclens.session import broadcast_if_small


def pick_column(df: DataFrame, candidates: list[str], what: str) -> str:
    """First candidate name present in the table."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"no {what} column among {df.columns}; looked for {candidates}")


def dedup_exact(df: DataFrame, text_column: str = "resume_text", id_column: str = "doc_id") -> DataFrame:
    """Keep the row with the lowest id of each distinct text; ``id_column`` is a key.

    Only digests and ids are grouped, combined map-side, so a text that makes up a
    third of the table reaches its reducer as one row per input task. Texts move
    once, to meet the ids that stay. NULL texts are one group, as in a data-frame
    ``drop_duplicates``.
    """
    digest = F.coalesce(F.unhex(F.sha2(F.col(text_column), 256)), F.lit("null").cast("binary"))
    ids = df.select(digest.alias("_digest"), F.col(id_column).alias("_id"))
    kept = ids.groupBy(F.col("_digest").alias("_kept_digest")).agg(F.min("_id").alias("_kept_id"))
    same = F.col("_digest").eqNullSafe(F.col("_kept_digest")) & F.col(id_column).eqNullSafe(F.col("_kept_id"))
    return df.withColumn("_digest", digest).join(kept, same, "left_semi").drop("_digest")


def clean_documents(
    df: DataFrame,
    category_column: str | None = None,
    text_column: str | None = None,
    id_column: str = "doc_id",
) -> DataFrame:
    """Find and rename the two columns, cast to string, drop NULL and blank rows, deduplicate."""
    text_column = text_column or pick_column(df, lx.TEXT_COLUMNS, "text")
    category_column = category_column or pick_column(df, lx.CATEGORY_COLUMNS, "category")
    renamed = {text_column: "resume_text", category_column: "category"}
    columns = [
        F.col(c).cast("string").alias(renamed[c]) if c in renamed else F.col(c) for c in df.columns
    ]
    usable = df.select(*columns).filter(~tx.is_blank("resume_text") & ~tx.is_blank("category"))
    return dedup_exact(usable, "resume_text", id_column)


def normalize_columns(df: DataFrame) -> DataFrame:
    """Map header variants (case, blanks) of the known columns to their own names."""

    def target(name: str) -> str:
        return lx.COLUMN_ALIASES.get(name.strip().lower().replace(" ", "_"), name)

    return df.select(*[F.col(f"`{c}`").alias(target(c)) for c in df.columns])


def filter_min_length(
    df: DataFrame, text_column: str = "resume_text", category_column: str = "category", min_chars: int = 50
) -> DataFrame:
    return df.filter((F.length(text_column) >= min_chars) & (F.length(category_column) > 0))


def filter_rare_categories(
    df: DataFrame, category_column: str = "category", min_category_count: int = 5
) -> DataFrame:
    """Keep rows of categories with at least ``min_category_count`` rows.

    Counts combine map-side and the kept names are a class list: the row table
    itself is not shuffled while that list is proven small.
    """
    frequent = (
        df.groupBy(category_column)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_category_count)
        .select(category_column)
    )
    return df.join(broadcast_if_small(frequent), category_column, "left_semi")


def category_counts(df: DataFrame, category_column: str = "category") -> DataFrame:
    return df.groupBy(category_column).agg(F.count(F.lit(1)).alias("n"))


# -- structured profiles -----------------------------------------------------------


def _present(column: str) -> Column:
    return F.coalesce(F.length(F.col(column)) > 0, F.lit(False))


def profile_to_text(df: DataFrame) -> Column:
    """Sentences about one structured profile; parts without a value are left out."""
    missing = [c for c in lx.PROFILE_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"profile columns missing: {missing}")

    def said(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    c = F.col
    return F.concat_ws(
        " ",
        said("Professional with ", c("experience_years"), " years of experience."),
        said("Skilled in ", c("programming_languages"), "."),
        said("Completed ", c("projects"), " major projects and ", c("internships"), " internships."),
        F.when(_present("certifications"), said("Holds certifications in ", c("certifications"), ".")),
        F.when(c("research_papers") > 0, said("Author of ", c("research_papers"), " research papers.")),
        said(
            "Education: ", F.coalesce(c("education_level"), F.lit("Graduate")),
            " from ", F.coalesce(c("university_tier"), F.lit("Tier-1")),
            " university with CGPA ", c("cgpa"), ".",
        ),
    )


def infer_category() -> Column:
    """Role of a structured profile: ordered word rules, then a role chosen by id."""
    languages = F.lower(F.coalesce(F.col("programming_languages"), F.lit("")))
    projects = F.coalesce(F.col("projects").cast("string"), F.lit(""))

    def named(*words: str) -> Column:
        return languages.rlike("|".join(words))

    fallback = F.array(*[F.lit(r) for r in lx.FALLBACK_ROLES])
    return (
        F.when(languages.contains("python") & projects.rlike("machine|data"), "Data Scientist")
        .when(named("java", "spring"), "Backend Developer")
        .when(named("javascript", "react", "angular"), "Frontend Developer")
        .when(named("devops", "aws", "docker"), "DevOps Engineer")
        .when(languages.contains("sql") & F.lower(projects).contains("analysis"), "Data Analyst")
        .otherwise(
            F.element_at(fallback, (F.pmod(F.col("candidate_id"), F.lit(len(lx.FALLBACK_ROLES))) + 1).cast("int"))
        )
    )
