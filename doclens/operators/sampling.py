"""Splits and class balancing by hash order.

A row's place in the "random" order is ``md5(seed|id)``: repeatable, and the
same for every partitioning. To take the first ``k`` rows of a class in that
order no class is ever sorted as a whole. A histogram over the leading hash
digits (map-side combined) finds the one bin in which the k-th hash lies; only
the rows of that bin are ranked to get the exact cut-off; the selection itself
is then a comparison with the cut-off in a narrow pass over the table. A class
that holds a third of all rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.operators.numbering import number_rows
from doclens.session import DEFAULT_SEED, broadcast_if_small

_BIN_DIGITS = 4  # 65,536 bins per class
_COPIES_PER_TASK = 10_000


def hash_order(id_column: str | Column, seed: int = DEFAULT_SEED) -> Column:
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.md5(F.concat(F.lit(f"{seed}|"), column.cast("string")))


def class_sizes(df: DataFrame, class_column: str) -> DataFrame:
    """``(class, n)``: one row per class, broadcast once proven small. NULL is no class: its rows count nowhere."""
    sizes = df.filter(F.col(class_column).isNotNull()).groupBy(class_column).agg(F.count(F.lit(1)).alias("n"))
    return broadcast_if_small(sizes)


def hash_cutoffs(
    df: DataFrame, id_column: str, class_column: str, quotas: DataFrame, seed: int = DEFAULT_SEED
) -> DataFrame:
    """``(class, cutoff)``: rows with ``hash_order <= cutoff`` are the first ``quota`` rows.

    ``quotas`` holds ``(class, quota)``; a class without a cutoff selects nothing.
    """
    keyed = df.select(F.col(class_column), hash_order(id_column, seed).alias("h")).withColumn(
        "bin", F.left("h", F.lit(_BIN_DIGITS))
    )
    histogram = keyed.groupBy(class_column, "bin").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy(class_column).orderBy("bin")
    cut_bins = (
        histogram.withColumn("upto", F.sum("n").over(running))
        .join(quotas.select(class_column, "quota"), class_column)
        .filter((F.col("upto") - F.col("n") < F.col("quota")) & (F.col("upto") >= F.col("quota")))
        .select(class_column, "bin", (F.col("quota") - F.col("upto") + F.col("n")).alias("need"))
    )
    in_bin = Window.partitionBy(class_column).orderBy("h")
    cutoffs = (
        keyed.join(broadcast_if_small(cut_bins), [class_column, "bin"])
        .withColumn("place", F.row_number().over(in_bin))
        .filter(F.col("place") == F.col("need"))
        .select(class_column, F.col("h").alias("cutoff"))
    )
    return broadcast_if_small(cutoffs)


def mark_selected(
    df: DataFrame,
    id_column: str,
    class_column: str,
    quotas: DataFrame,
    flag: str,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Add boolean ``flag``: true for the first ``quota`` rows of each class in hash order."""
    cutoffs = hash_cutoffs(df, id_column, class_column, quotas, seed)
    chosen = F.coalesce(hash_order(id_column, seed) <= F.col("cutoff"), F.lit(False))
    return df.join(cutoffs, class_column, "left").withColumn(flag, chosen).drop("cutoff").select(*df.columns, flag)


def _global_cutoff(df: DataFrame, id_column: str, quota: int, seed: int) -> str:
    """Hash of the ``quota``-th row of the whole table, found with the same histogram."""
    if quota <= 0:
        return ""
    everything = df.select(F.col(id_column), F.lit(0).alias("one"))
    quotas = df.sparkSession.createDataFrame([(0, quota)], "one int, quota long")
    row = hash_cutoffs(everything, id_column, "one", quotas, seed).select("cutoff").first()
    return "g" if row is None else row["cutoff"]  # no row: quota exceeds the table, take all


def _holdout_size(rows: int, fraction: float) -> int:
    return max(1, int(rows * fraction))


def assign_holdout(
    df: DataFrame, id_column: str = "doc_id", fraction: float = 0.2, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Tag ``max(1, int(n * fraction))`` rows as holdout; no-op when the tag exists."""
    if "data_source" in df.columns:
        return df
    cutoff = _global_cutoff(df, id_column, _holdout_size(df.count(), fraction), seed)
    return df.withColumn(
        "data_source", F.when(hash_order(id_column, seed) <= cutoff, "holdout").otherwise("train")
    )


def assign_stratified_holdout(
    df: DataFrame,
    id_column: str = "doc_id",
    category_column: str = "category",
    fraction: float = 0.2,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Holdout rows per category, topped up from the rest to the overall share."""
    sizes = class_sizes(df, category_column)
    quotas = broadcast_if_small(
        sizes.withColumn(
            "quota", F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(float(fraction)))).cast("long")
        )
    )
    flagged = mark_selected(df, id_column, category_column, quotas, "held", seed)
    totals = quotas.agg(F.sum("n").alias("n"), F.sum(F.least("quota", "n")).alias("held")).first()
    shortage = _holdout_size(totals["n"] or 0, fraction) - (totals["held"] or 0)
    held = F.col("held")
    if shortage > 0:
        cutoff = _global_cutoff(flagged.filter(~held), id_column, shortage, seed)
        held = held | (hash_order(id_column, seed) <= cutoff)
    return flagged.withColumn("data_source", F.when(held, "holdout").otherwise("train")).drop("held")


def train_test_split(
    df: DataFrame,
    id_column: str = "doc_id",
    label_column: str = "category",
    test_size: float = 0.2,
    seed: int = DEFAULT_SEED,
    flag: str = "is_test",
) -> DataFrame:
    """Add ``is_test``: a stratified share of rows, or a plain one when a class is too small.

    ``ceil(test_size * n)`` test rows are shared over the labels in proportion,
    the remainder going to the largest fractional parts (ties by label). Rows without a
    label are train rows and count for no share.
    """
    sizes = class_sizes(df, label_column)
    facts = sizes.agg(
        F.sum("n").alias("n"), F.min("n").alias("smallest"), F.count(F.lit(1)).alias("classes")
    ).first()
    rows, classes = facts["n"] or 0, facts["classes"]
    n_test = -int(-(rows * test_size) // 1)
    stratify = (facts["smallest"] or 0) >= 2 and n_test >= classes and rows - n_test >= classes
    if not stratify:
        cutoff = _global_cutoff(df, id_column, n_test, seed)
        return df.withColumn(flag, hash_order(id_column, seed) <= cutoff)
    share = F.col("n") * F.lit(n_test)
    shared = sizes.withColumn("base", F.floor(share / F.lit(rows)).cast("long")).withColumn(
        "rest", share - F.col("base") * F.lit(rows)
    )
    left_over = n_test - (shared.agg(F.sum("base")).first()[0] or 0)
    ranked = number_rows(shared.withColumn("_less", -F.col("rest")).select(label_column, "base", "_less"), ["_less", label_column], "_place")
    quotas = ranked.select(label_column, (F.col("base") + (F.col("_place") < left_over).cast("long")).alias("quota"))
    return mark_selected(df, id_column, label_column, broadcast_if_small(quotas), flag, seed)


def oversample(
    df: DataFrame, id_column: str = "doc_id", class_column: str = "category", seed: int = DEFAULT_SEED
) -> DataFrame:
    """Raise every class to the size of the largest one; adds ``copy`` (0 = the original).

    Each row appears ``floor(N / n)`` times and the first ``N mod n`` rows of the
    class in hash order once more, so every original is kept. Rows without a class leave.
    """
    sizes = class_sizes(df, class_column)
    largest = sizes.agg(F.max("n").alias("n")).first()["n"]
    if largest is None:
        return df.withColumn("copy", F.lit(0))
    plan = broadcast_if_small(
        sizes.select(
            class_column,
            F.floor(F.lit(largest) / F.col("n")).cast("int").alias("times"),
            F.pmod(F.lit(largest), F.col("n")).cast("long").alias("quota"),
        )
    )
    marked = mark_selected(df, id_column, class_column, plan, "extra", seed)
    counted = marked.join(plan.drop("quota"), class_column).withColumn(
        "times", F.col("times") + F.col("extra").cast("int")
    )
    columns = [*df.columns, "copy"]
    single = counted.filter(F.col("times") <= _COPIES_PER_TASK).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.col("times") - 1))
    )
    biggest = plan.agg(F.max("times").alias("t")).first()["t"]
    if biggest < _COPIES_PER_TASK:
        return single.select(*columns)
    # a tiny class: spread the copies of each row over many tasks before making them
    chunked = (
        counted.filter(F.col("times") > _COPIES_PER_TASK)
        .withColumn(
            "chunk", F.explode(F.sequence(F.lit(0), ((F.col("times") - 1) / _COPIES_PER_TASK).cast("int")))
        )
        .repartition(F.col(id_column), F.col("chunk"))
        .withColumn(
            "copy",
            F.explode(
                F.sequence(
                    F.col("chunk") * _COPIES_PER_TASK,
                    F.least((F.col("chunk") + 1) * _COPIES_PER_TASK, F.col("times")) - 1,
                )
            ),
        )
    )
    return single.select(*columns).unionByName(chunked.select(*columns))


def undersample(
    df: DataFrame, id_column: str = "doc_id", class_column: str = "category", seed: int = DEFAULT_SEED
) -> DataFrame:
    """Cut every class to the size of the smallest one. Rows without a class leave."""
    sizes = class_sizes(df, class_column)
    smallest = sizes.agg(F.min("n").alias("n")).first()["n"] or 0
    quotas = broadcast_if_small(sizes.withColumn("quota", F.lit(smallest).cast("long")))
    return mark_selected(df, id_column, class_column, quotas, "kept", seed).filter("kept").drop("kept")


def balance_classes(
    df: DataFrame,
    id_column: str = "doc_id",
    class_column: str = "category",
    strategy: str = "oversample",
    only_train: bool = True,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Balance the ``train`` rows and keep the ``holdout`` rows; other tags are left out."""

    def balanced(part: DataFrame) -> DataFrame:
        if strategy == "undersample":
            return undersample(part, id_column, class_column, seed).withColumn("copy", F.lit(0))
        return oversample(part, id_column, class_column, seed)

    if only_train and "data_source" in df.columns:
        train = balanced(df.filter(F.col("data_source") == "train"))
        holdout = df.filter(F.col("data_source") == "holdout").withColumn("copy", F.lit(0))
        return train.unionByName(holdout)
    return balanced(df)


def shuffle_rows(
    df: DataFrame, id_column: str = "doc_id", seed: int = DEFAULT_SEED, index_column: str | None = None
) -> DataFrame:
    """Global order by hash (a range partitioning). ``index_column`` adds the new 0-based index.

    The index is the row's place inside its hash bin plus the number of rows in
    earlier bins, so no single task ranks the table.
    """
    if index_column is None:
        return df.orderBy(hash_order(id_column, seed))
    keyed = df.withColumn("_h", hash_order(id_column, seed)).withColumn("_bin", F.left("_h", F.lit(_BIN_DIGITS)))
    bins = keyed.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most 65,536 rows
    offsets = broadcast_if_small(
        bins.select("_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    place = F.row_number().over(Window.partitionBy("_bin").orderBy("_h"))
    return (
        keyed.join(offsets, "_bin")
        .withColumn(index_column, F.col("_offset") + place - 1)
        .orderBy(index_column)
        .drop("_h", "_bin", "_offset")
    )
