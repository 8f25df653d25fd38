"""Queries of the profiling operators."""

from pyspark.sql import functions as F

from doclens.catalog.base import derived, query, table, with_views
from doclens.operators import profile
from doclens.sources import tables


def _profile_twin(source: str, columns: list[str], category: str | None) -> str:
    parts = [
        f"SELECT 'shape' AS section, 'rows' AS name, CAST(count(*) AS DOUBLE) AS value FROM {source}",
        f"SELECT 'shape', 'columns', CAST({len(columns)} AS DOUBLE)",
        *[
            f"SELECT 'missing', '{c}', CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) FROM {source}"
            for c in columns
        ],
        f"SELECT 'duplicates', 'rows', CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS DOUBLE) FROM {source}",
    ]
    if category:
        counts = f"(SELECT count(*) AS n FROM {source} GROUP BY {category})"
        parts.append(
            f"SELECT 'class_distribution', {category}, CAST(count(*) AS DOUBLE) FROM {source} GROUP BY {category}"
        )
        parts.append(
            f"SELECT 'imbalance_ratio', 'max/min', CAST(max(n) AS DOUBLE) / min(n) FROM {counts} HAVING count(*) > 1"
        )
    return " UNION ALL ".join(parts)


_TEXTS = "(SELECT doc_id, text AS resume_text, lang AS category, source, n_chars FROM documents)"


@query("profile_dataset", _profile_twin(_TEXTS, ["doc_id", "resume_text", "category", "source", "n_chars"], "category"))
def _(spark, d):
    return profile.profile_dataset(table(spark, d, "documents").withColumnsRenamed({"text": "resume_text", "lang": "category"}))


_LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


@query("profile_dataset_lineitem", _profile_twin("lineitem", _LINEITEM, "l_returnflag"))
def _(spark, d):
    return profile.profile_dataset(table(spark, d, "lineitem"), "l_returnflag")


@query(
    "profile_sample",
    with_views("SELECT resume_id, category, resume_text FROM resumes ORDER BY resume_id LIMIT 3", "resumes"),
)
def _(spark, d):
    return profile.sample_rows(
        derived(spark, d, "resumes").select("resume_id", "category", "resume_text"), "resume_id"
    )


_COLUMNS = [("resume_id", "bigint"), ("category", "string"), ("data_source", "string"), ("years", "int"), ("resume_text", "string")]
_COLUMN_ROWS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS type, count(*) FILTER (WHERE {c} IS NULL) AS nulls,
    round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS null_percent, count(*) AS rows,
    CAST({len(_COLUMNS)} AS BIGINT) AS columns,
    {"count(DISTINCT category)" if c == "category" else "CAST(NULL AS BIGINT)"} AS unique_values,
    {"(SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT category AS v FROM resumes ORDER BY v LIMIT 10))"
     if c == "category" else "CAST(NULL AS VARCHAR)"} AS listed_values,
    {"(SELECT left(resume_text, 100) FROM resumes WHERE resume_text IS NOT NULL ORDER BY resume_id LIMIT 1)"
     if c == "resume_text" else "CAST(NULL AS VARCHAR)"} AS sample
    FROM resumes"""
    for c, t in _COLUMNS
)


@query("profile_columns", with_views(_COLUMN_ROWS, "resumes"))
def _(spark, d):
    profiled = profile.profile_columns(derived(spark, d, "resumes"), "resume_id")
    return profiled.withColumn("null_percent", F.round("null_percent", 6))


@query(
    "list_categories",
    with_views("SELECT DISTINCT trim(category) AS category FROM resumes WHERE trim(category) <> '' ORDER BY 1", "resumes"),
)
def _(spark, d):
    return profile.list_categories(derived(spark, d, "resumes"))


@query("read_screening_table", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, d):
    return tables.read_screening_table(spark, f"{d}/documents.parquet")
