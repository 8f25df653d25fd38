"""Queries of the splits and balancing operators."""

from pyspark.sql import functions as F

from doclens.catalog.base import derived, query, table, with_views
from doclens.catalog.cleaning import SQL_HASH, SQL_STRATIFIED
from doclens.operators import sampling

_H = SQL_HASH.format("c_custkey")
_CUSTOMERS = "SELECT c_custkey, c_mktsegment AS category FROM customer"


def _customers(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("category"))


def _resumes(spark, d):
    return derived(spark, d, "resumes").select("resume_id", "category", "data_source")


@query(
    "assign_holdout",
    f"""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('42|' || o_orderkey))
          <= greatest(1, floor(count(*) OVER () * CAST(0.2 AS DOUBLE))) THEN 'holdout' ELSE 'train' END AS data_source
        FROM orders""",
)
def _(spark, d):
    return sampling.assign_holdout(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "assign_stratified_holdout",
    with_views(
        "WITH bare AS (SELECT resume_id, category FROM resumes), "
        + SQL_STRATIFIED.format(hash=SQL_HASH.format("resume_id"), source="bare")
        + " SELECT resume_id, category, data_source FROM tagged",
        "resumes",
    ),
)
def _(spark, d):
    return sampling.assign_stratified_holdout(_resumes(spark, d).drop("data_source"), "resume_id")


SQL_SPLIT = """
sizes AS (SELECT {label} AS class, count(*) AS n_c FROM {source} GROUP BY 1),
portions AS (SELECT class, n_c, (SELECT ceil(sum(n_c) * CAST(0.2 AS DOUBLE)) FROM sizes)::BIGINT AS n_test,
                    (SELECT sum(n_c) FROM sizes)::BIGINT AS n FROM sizes),
floors AS (SELECT *, (n_c * n_test) // n AS base, (n_c * n_test) % n AS rest FROM portions),
quotas AS (SELECT class, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, class)
                  <= n_test - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM floors),
split AS (SELECT s.*, row_number() OVER (PARTITION BY q.class ORDER BY {hash}) <= q.quota AS is_test
          FROM {source} s JOIN quotas q ON s.{label} = q.class)
"""


@query(
    "train_test_split",
    f"WITH source AS ({_CUSTOMERS}), {SQL_SPLIT.format(label='category', source='source', hash=_H)} "
    "SELECT c_custkey, category, is_test FROM split",
)
def _(spark, d):
    return sampling.train_test_split(_customers(spark, d), "c_custkey")


# one supplier per nation key is not enough for a stratified split of a key column: plain split
@query(
    "train_test_split_plain",
    """SELECT s_suppkey, s_suppkey AS category, row_number() OVER (ORDER BY md5('42|' || s_suppkey))
         <= ceil(count(*) OVER () * CAST(0.2 AS DOUBLE)) AS is_test FROM supplier""",
)
def _(spark, d):
    suppliers = table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").alias("category"))
    return sampling.train_test_split(suppliers, "s_suppkey")


def _oversampled(source: str, key: str) -> str:
    return f"""SELECT {key}, category, CAST(unnest(range(times)) AS BIGINT) AS copy FROM (
      SELECT {key}, category, top // n + CASE WHEN place <= top % n THEN 1 ELSE 0 END AS times FROM (
        SELECT *, max(n) OVER () AS top FROM (
          SELECT {key}, category, count(*) OVER (PARTITION BY category) AS n,
                 row_number() OVER (PARTITION BY category ORDER BY md5('42|' || {key})) AS place FROM {source})))"""


@query("oversample", with_views(_oversampled("resumes", "resume_id"), "resumes"))
def _(spark, d):
    out = sampling.oversample(_resumes(spark, d).drop("data_source"), "resume_id")
    return out.withColumn("copy", F.col("copy").cast("long"))


_SQL_UNDER = """SELECT c_custkey, category FROM (
  SELECT *, min(n) OVER () AS bottom FROM (
    SELECT c_custkey, c_mktsegment AS category, count(*) OVER (PARTITION BY c_mktsegment) AS n,
           row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42|' || c_custkey)) AS place FROM customer))
WHERE place <= bottom"""


@query("undersample", _SQL_UNDER)
def _(spark, d):
    return sampling.undersample(_customers(spark, d), "c_custkey")


@query(
    "balance_train_only",
    with_views(
        f"""WITH train AS (SELECT resume_id, category FROM resumes WHERE data_source = 'train')
        SELECT resume_id, category, copy, 'train' AS data_source FROM ({_oversampled('train', 'resume_id')})
        UNION ALL SELECT resume_id, category, CAST(0 AS BIGINT), 'holdout' FROM resumes WHERE data_source = 'holdout'""",
        "resumes",
    ),
)
def _(spark, d):
    out = sampling.balance_classes(_resumes(spark, d), "resume_id")
    return out.withColumn("copy", F.col("copy").cast("long"))


@query(
    "shuffle_rows",
    "SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|' || o_orderkey)) - 1 AS new_index FROM orders",
)
def _(spark, d):
    out = sampling.shuffle_rows(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", index_column="new_index")
    return out.withColumn("new_index", F.col("new_index").cast("long"))
