"""Sharding by a hierarchical weighted hash tree.

A row descends from the root through regions and racks to a shard. At each level it draws one
number per child, from its key and the child's name, and goes where the draw, scaled by the
child's weight, is least (an exponential variable of that rate: children get rows in proportion to
their weights). A weight that changes moves rows only between the changed subtree and its siblings,
level by level; all other draws stay as they were. A new shard that comes in a region of its own
takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.base import query, table, with_starts

Tree = dict  # name -> weight, or name -> subtree


def weight(node) -> float:
    """The weight of a shard, or the sum of a subtree."""
    return sum(map(weight, node.values())) if isinstance(node, dict) else float(node)


def balanced_tree(shards: int, base: int = 8) -> Tree:
    """Shards 0 to ``base - 1`` in racks of two and regions of two racks; later ones in regions of their own."""
    tree: Tree = {}
    for shard in range(shards):
        if shard < base:
            tree.setdefault(f"region{shard // 4}", {}).setdefault(f"rack{shard // 2}", {})[shard] = 1.0
        else:
            tree[f"grown{shard}"] = {f"rack{shard}": {shard: 1.0}}
    return tree


def _draw(key: Column, name: str, share: float) -> Column:
    """An exponential variable of rate ``share``: minus the logarithm of a uniform draw in (0, 1), over the share."""
    uniform = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{name}|"), key)), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(uniform) / F.lit(share)


def place(key: Column, tree: Tree, path: str = "root") -> Column:
    """The shard of a key as a column; weights must not be negative, and one must be positive at each level."""
    children = [(n, c, weight(c)) for n, c in tree.items() if weight(c) > 0]
    if not children:
        raise ValueError(f"no child with a weight in {path}")
    inner = [place(key, c, f"{path}/{n}") if isinstance(c, dict) else F.lit(n).cast("int") for n, c, _ in children]
    if len(children) == 1:
        return inner[0]
    draws = F.array(*(_draw(key, f"{path}/{n}", w) for n, _, w in children))
    at = F.array_position(draws, F.array_min(draws)).cast("int")
    chosen = F.when(at == 1, inner[0])
    for number, column in enumerate(inner[1:], 2):
        chosen = chosen.when(at == number, column)
    return chosen


def shard_rows(
    docs: DataFrame,
    tree: Tree,
    grown: Tree | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard)`` per row of ``docs``; the law is ``key``.

    ``size`` is the text's UTF-8 bytes plus 1, ``slot`` a gapless number from 0 within the shard in the order of the
    id's hash. Rows with equal ids go to the same shard, into slots of their own. A null id is a key like any other.
    Null texts have size 1 and the checksum of no bytes, 0. An empty table gives no rows; other columns are not looked at.
    """
    key = F.concat(F.lit("k"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("id").isNull().cast("string"))
    bytes_ = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = (
        docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
        .select(
            "id",
            (F.length(bytes_).cast("long") + 1).alias("size"),
            F.crc32(bytes_).alias("text_crc32"),
            place(key, tree).alias("shard"),
            (place(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
            F.md5(key).alias("h"),
            F.lit(1).cast("long").alias("one"),
        )
    )
    slotted = with_starts(rows, ["h", "text_crc32", "size"], "one", "shard", "slots")
    return slotted.select(
        F.col("id").alias(id_column), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.col("start").alias("slot"), "grown_shard",
    )


@query("op7_sharding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), balanced_tree(8), balanced_tree(9))
