"""Dataset profiling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens import lexicon as lx
from doclens.functions import text as tx


def profile_dataset(df: DataFrame, category_column: str = "category") -> DataFrame:
    """Long ``(section, name, value)`` profile.

    Sections: ``shape``, ``missing`` per column, ``duplicates``,
    ``class_distribution`` and ``imbalance_ratio`` (only with two classes or more).
    """
    columns = df.columns
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(columns)],
    )

    def entry(section: str, name: str, value: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"), F.lit(name).alias("name"), value.cast("double").alias("value")
        )

    shape = [entry("shape", "rows", F.col("rows")), entry("shape", "columns", F.lit(len(columns)))]
    nulls = [entry("missing", c, F.col(f"null_{i}")) for i, c in enumerate(columns)]
    base = counted.select(F.inline(F.array(*shape, *nulls)))
    # whole rows compare through a digest of their JSON form: short keys, map-side combine
    duplicates = (
        df.select(F.sha2(F.to_json(F.struct(*columns)), 256).alias("row"))
        .groupBy("row")
        .agg((F.count(F.lit(1)) - 1).alias("extra"))
        .agg(F.coalesce(F.sum("extra"), F.lit(0)).cast("double").alias("value"))
        .select(F.lit("duplicates").alias("section"), F.lit("rows").alias("name"), "value")
    )
    parts = [base, duplicates]
    if category_column in columns:
        classes = (
            df.filter(F.col(category_column).isNotNull())
            .groupBy(F.col(category_column).cast("string").alias("name"))
            .agg(F.count(F.lit(1)).cast("double").alias("value"))
        )
        parts.append(classes.select(F.lit("class_distribution").alias("section"), "name", "value"))
        parts.append(
            classes.agg(
                (F.max("value") / F.min("value")).alias("value"), F.count(F.lit(1)).alias("classes")
            )
            .filter(F.col("classes") > 1)
            .select(F.lit("imbalance_ratio").alias("section"), F.lit("max/min").alias("name"), "value")
        )
    return reduce(DataFrame.unionByName, parts)


def sample_rows(df: DataFrame, id_column: str, rows: int = 3) -> DataFrame:
    """The first rows by id (a top-k, not a sort)."""
    return df.orderBy(id_column).limit(rows)


def profile_columns(df: DataFrame, id_column: str, max_listed: int = 20, listed: int = 10) -> DataFrame:
    """One row per column: type, NULL count and share; details for text and category columns.

    Category columns get the number of distinct values and, below ``max_listed``
    of them, up to ``listed`` values; text columns the first sample, cut to 100
    characters. Every row repeats the row and column counts of the table.
    """
    columns = df.columns
    types = dict(df.dtypes)
    texts = [c for c in lx.INSPECTED_TEXT_COLUMNS if c in columns]
    categories = [c for c in lx.INSPECTED_CATEGORY_COLUMNS if c in columns]
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(columns)],
    )
    base = counted.select(
        "rows",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.lit(types[c]).alias("type"),
                        F.col(f"null_{i}").alias("nulls"),
                    )
                    for i, c in enumerate(columns)
                ]
            )
        ),
    )
    details = []
    for c in categories:
        # distinct values once; only their count and the first few leave the aggregate
        values = df.filter(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("v")).distinct()
        details.append(_detail(values.agg(F.count(F.lit(1)).alias("unique_values")), c))
        first = values.orderBy("v").limit(max_listed)
        details.append(_detail(first.agg(F.sort_array(F.collect_list("v")).alias("head")), c))
    for c in texts:
        sample = (
            df.filter(F.col(c).isNotNull())
            .select(id_column, F.left(F.col(c), F.lit(100)).alias("sample"))
            .orderBy(id_column)
            .limit(1)
        )
        details.append(_detail(sample.select("sample"), c))
    result = base.select(
        "column",
        "type",
        "nulls",
        F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows") * 100).otherwise(F.lit(0.0)).alias("null_percent"),
        "rows",
        F.lit(len(columns)).cast("long").alias("columns"),
    )
    if not details:
        details.append(_detail(df.sparkSession.createDataFrame([], "sample string"), columns[0]))
    merged = (
        reduce(DataFrame.unionByName, details)
        .groupBy("column")
        .agg(*[F.max(c).alias(c) for c in ("unique_values", "head", "sample")])
    )
    return result.join(merged, "column", "left").select(
        *result.columns,
        "unique_values",
        F.when(
            F.col("unique_values") < max_listed, F.array_join(F.slice("head", 1, listed), "|")
        ).alias("listed_values"),
        "sample",
    )


def _detail(df: DataFrame, column: str) -> DataFrame:
    """Bring one column's finding into the common detail schema."""
    types = {"unique_values": "long", "head": "array<string>", "sample": "string"}
    return df.select(
        F.lit(column).alias("column"),
        *[
            (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c)
            for c, t in types.items()
        ],
    )


def list_categories(df: DataFrame, category_column: str = "category") -> DataFrame:
    """Sorted distinct non-blank categories."""
    name = tx.strip(F.col(category_column)).alias("category")
    return df.select(name).filter(F.col("category") != "").distinct().orderBy("category")
