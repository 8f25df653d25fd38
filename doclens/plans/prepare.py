"""Dataset preparation as chains of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens import lexicon as lx
from doclens.functions import text as tx
from doclens.operators import clean, sampling, tokens
from doclens.session import DEFAULT_SEED, written


def adapt_screening_table(
    df: DataFrame,
    id_column: str = "resume_id",
    holdout_fraction: float = 0.2,
    min_category_count: int = 5,
    seed: int = DEFAULT_SEED,
    materialise: bool = True,
) -> DataFrame:
    """Screening rows -> training table with a stratified holdout tag.

    Cleaning and dedup are computed once and written to the shared folder: the
    class counts, the hash histogram and the result all start from that table.
    """
    named = clean.normalize_columns(df)
    missing = {"resume_text", "category"} - set(named.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}; found {named.columns}")
    changed = {
        "resume_text": tx.strip_preamble("resume_text"),
        "category": tx.normalize_role(F.coalesce(F.col("category").cast("string"), F.lit(""))),
    }
    if "screening_decision" in named.columns:
        changed["screening_decision"] = tx.normalize_decision("screening_decision")
    cleaned = clean.filter_min_length(named.withColumns(changed))
    unique = clean.dedup_exact(cleaned, "resume_text", id_column)
    if materialise:
        unique = written(unique, "adapted")
    frequent = clean.filter_rare_categories(unique, "category", min_category_count)
    tagged = sampling.assign_stratified_holdout(frequent, id_column, "category", holdout_fraction, seed)
    kept = [c for c in lx.SCREENING_COLUMNS if c in tagged.columns]
    return tagged.select(id_column, *kept)


def adapt_profiles(df: DataFrame, id_column: str = "candidate_id") -> DataFrame:
    """Structured profiles -> ``(id, resume_text, category)``."""
    adapted = df.select(
        F.col(id_column), clean.profile_to_text(df).alias("resume_text"), clean.infer_category().alias("category")
    )
    return adapted.filter(~tx.is_blank("resume_text") & F.col("category").isNotNull())


def prepare_training_table(
    df: DataFrame,
    id_column: str = "doc_id",
    strategy: str | None = "oversample",
    dictionary: DataFrame | None = None,
    holdout_fraction: float = 0.2,
    seed: int = DEFAULT_SEED,
    output_path: str | None = None,
) -> DataFrame:
    """Clean, tag a holdout, preprocess the text, balance the train rows, optionally write.

    The text is preprocessed before balancing: copies of a row share the work.
    """
    cleaned = clean.clean_documents(df, id_column=id_column)
    processed = written(
        tokens.preprocess_documents(cleaned, "resume_text", id_column, dictionary=dictionary), "prepared"
    )
    tagged = sampling.assign_holdout(processed, id_column, holdout_fraction, seed)
    if strategy is not None:
        tagged = sampling.balance_classes(tagged, id_column, "category", strategy, seed=seed)
    if output_path is not None:
        tagged.write.mode("overwrite").parquet(output_path)
        return df.sparkSession.read.schema(tagged.schema).parquet(output_path)
    return tagged
