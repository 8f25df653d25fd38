"""Mixing sources to target weights by capped water-filling.

Each source's share of the budget follows its weight; a source stops at ``max_epochs`` times its
size and its excess goes to the others by weight, until none is above. A target is met by whole
repetitions of the source plus a seeded part of its documents: those that come first in hash order
until the rest of the target is reached. The place of the cut is found on a histogram of hashes, so no source
is sorted as a whole, and a source with most of the rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.base import query, table, with_starts
from doclens.session import DEFAULT_SEED, broadcast_if_small, written

_BIN_DIGITS = 4  # 65,536 bins of the hash per source


def word_count(text: str) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null has 0."""
    plain = F.trim(F.translate(F.col(text), "\t\n\x0b\x0c\r", "     "))
    squeezed = F.regexp_replace(plain, " +", " ")
    spaces = F.length(squeezed) - F.length(F.translate(squeezed, " ", ""))
    return F.when(plain.isNull() | (plain == ""), F.lit(0)).otherwise(spaces + 1).cast("long")


def cyclic_weights(sources: DataFrame, source: str, cycle: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """``sources`` with ``weight``: the cycle over the sources in code-point order, null last."""
    ordered = sources.withColumn("_null", F.col(source).isNull().cast("int")).withColumn("_one", F.lit(1).cast("long"))
    ranked = with_starts(ordered, ["_null", source], "_one", None, "sources").withColumnRenamed("start", "_rank")
    values = F.array(*(F.lit(float(c)) for c in cycle))
    return ranked.withColumn("weight", F.element_at(values, (F.col("_rank") % len(cycle) + 1).cast("int"))).drop("_null", "_one", "_rank")


def water_fill(sources: DataFrame, max_epochs: float, share: float) -> DataFrame:
    """``sources`` (``source_size``, ``weight``) with ``target``; two sums per round reach the driver, not the sources."""
    whole = sources.agg(F.sum("source_size").alias("size"), F.count(F.lit(1)).alias("n")).first()
    budget = share * float(whole["size"] or 0)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, full = 0.0, -1
    for _ in range(whole["n"] + 2):  # a round clamps one more source at least, or is the last
        above = cap <= F.col("weight") * F.lit(level) if level else F.lit(False)
        state = sources.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)).alias("capped"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count(F.when(above, 1)).alias("full"),
        ).first()
        if state["full"] == full or state["open"] == 0:
            break
        full = state["full"]
        level = max(0.0, budget - state["capped"]) / state["open"]
    else:
        raise RuntimeError("the targets don't settle")
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def _hash(id_column: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))


def source_plan(
    docs: DataFrame,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
    cycle: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_epochs: float = 3.0,
    share: float = 1.0,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """``(p, source_size, target, whole, end)`` per source ``p``: every row ``whole`` times, those up to hash ``end`` once more."""
    return _plan(_sizes(docs, id_column, source_column, text_column, seed), cycle, max_epochs, share)


def _sizes(docs: DataFrame, id_column: str, source_column: str, text_column: str, seed: int) -> DataFrame:
    """``(id, own, source, size, h)`` per row: its id, source as it is and as text, words and hash, from one pass over the texts."""
    return written(
        docs.select(
            F.col(id_column).alias("id"), F.col(source_column).alias("own"), F.col(source_column).cast("string").alias("source"),
            word_count(text_column).alias("size"), _hash(id_column, seed).alias("h"),
        ),
        "sizes",
    )


def _plan(rows: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: float = 3.0, share: float = 1.0) -> DataFrame:
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = water_fill(written(cyclic_weights(sources, "source", cycle), "sources"), max_epochs, share)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # a hair's breadth below a whole number of repetitions is that number
    whole = F.floor(ratio + F.lit(1e-12)).cast("long")
    plan = written(
        targets.withColumn("whole", whole).withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))),
        "targets",
    )
    # the bin of the hash in which a source's part ends, then the hash
    keyed = rows.withColumn("bin", F.left("h", F.lit(_BIN_DIGITS)))
    upto = keyed.groupBy("source", "bin").agg(F.sum("size").alias("n")).withColumn("upto", F.expr("sum(n) OVER (PARTITION BY source ORDER BY bin)"))
    needs = broadcast_if_small(plan.select(F.col("source").alias("s"), "need"))
    cut_bins = written(
        upto.join(needs, F.col("source").eqNullSafe(F.col("s")))
        .filter((F.col("need") > 0) & (F.col("upto") - F.col("n") < F.col("need")) & (F.col("upto") >= F.col("need")))
        .select("s", F.col("bin").alias("b"), (F.col("need") - F.col("upto") + F.col("n")).alias("rest")),
        "cuts",
    )
    inside = (
        keyed.join(broadcast_if_small(cut_bins), F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
        .groupBy("source", "b", "rest", "h")
        .agg(F.sum("size").alias("n"))
        .withColumn("upto", F.expr("sum(n) OVER (PARTITION BY source ORDER BY h)"))
    )
    # the first hash that reaches the rest, or the one before it if that is nearer
    cut = inside.groupBy("source", "b", "rest").agg(
        F.min(F.when(F.col("upto") >= F.col("rest"), F.struct("h", "upto", "n"))).alias("over"),
        F.max(F.when(F.col("upto") < F.col("rest"), F.col("h"))).alias("under"),
    )
    near = F.col("over.upto") - F.col("rest") <= F.col("rest") - F.col("over.upto") + F.col("over.n")
    # before the first hash of its bin, a part ends with the bins below: their hashes sort before the bare digits
    ends = cut.select(F.col("source").alias("c"), F.when(near, F.col("over.h")).otherwise(F.coalesce("under", "b")).alias("end"))
    return written(
        plan.join(ends, F.col("source").eqNullSafe(F.col("c")), "left").select(F.col("source").alias("p"), "source_size", "target", "whole", "end"),
        "plans",
    )


def _with_copies(rows: DataFrame, plan: DataFrame, source: Column, h: Column) -> DataFrame:
    copies = F.col("whole") + F.coalesce((h <= F.col("end")).cast("long"), F.lit(0).cast("long"))
    return rows.join(broadcast_if_small(plan), source.cast("string").eqNullSafe(F.col("p"))).withColumn("_copies", copies)


def mix(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", seed: int = DEFAULT_SEED, **options) -> DataFrame:
    """``(id, source, size, source_size, target, taken)`` per row of ``docs``; sizes are words.

    ``taken`` is ``size`` times the repetitions of the row. A source's taken words miss its target by less than the
    rows that share the id of the cut. Rows with equal ids in a source are taken alike, reruns agree.
    Null or wordless texts have size 0, and are taken neither more nor less for it. A null source is a source,
    after all others; a null id hashes like an empty one. An empty table gives no rows; other columns are not looked at.
    """
    rows = _sizes(docs, id_column, source_column, text_column, seed)
    taken = _with_copies(rows, _plan(rows, **options), F.col("source"), F.col("h"))
    return taken.select(
        F.col("id").alias(id_column), F.col("own").alias("source"), "size", "source_size", "target", (F.col("size") * F.col("_copies")).alias("taken")
    )


def mixed_rows(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", seed: int = DEFAULT_SEED, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (see :func:`mix`); the texts are not shuffled."""
    names = docs.columns
    plan = source_plan(docs, id_column, source_column, text_column, seed=seed, **options)
    packed = docs.select(F.struct(*(docs[c] for c in names)).alias("_row"), docs[id_column].alias("_id"), docs[source_column].alias("_source"))
    taken = _with_copies(packed, plan, F.col("_source"), _hash("_id", seed)).filter("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")).select("_row.*")


@query("op4_mixing_sources")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")
