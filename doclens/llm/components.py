"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm.base import tasks
from doclens.session import written

_MAX_ROUNDS = 60


def compact(df: DataFrame) -> DataFrame:
    """Fewer and larger files for tables of links, which are small next to what they come from."""
    return df.coalesce(max(1, tasks(df.sparkSession) // 4))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node that has a link; ``component`` is its smallest reachable node.

    Each round joins every node to its smallest neighbour, alternating between the neighbours
    above a node and those below it, so that chains halve and stars collapse at once. Links stay
    one row per node and neighbour, rounds grow with the logarithm of the longest chain. Every
    round is written to the shared folder. Loops and nulls are left out.
    """
    edges = written(compact(
        links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()),
        "links",
    )
    for _ in range(_MAX_ROUNDS):
        # large star: the neighbours above a node move to its smallest neighbour
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
            .join(least, "u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .distinct()
        )
        large = written(compact(large), "links")
        # small star: the neighbours below a node move to the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = written(compact(
            joined.filter(F.col("lo") != F.col("m"))
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionAll(least.select("hi", F.col("m").alias("lo")))
            .distinct()),
            "links",
        )
        # done when every node has one neighbour below it and no node is both
        state = small.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("hi").alias("h")).first()
        chained = small.join(small.select(F.col("hi").alias("lo")).distinct(), "lo", "left_semi").limit(1).count()
        edges = small
        if state["n"] == state["h"] and not chained:
            roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots)
    raise RuntimeError(f"components not settled after {_MAX_ROUNDS} rounds")
