"""Line dedup by site-relative frequency: lines that many pages of the same host share are boilerplate.

DataFrame functions only. A page's lines travel as 16-byte digests of host and line; the counts are
combined before the shuffle, and texts are moved once, to meet the digests that their page drops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.base import query, table
from doclens.session import written

# Markup that stands inside a line or is not shown, and markup that ends a line.
_HIDDEN = (
    "(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|"
    "</?(?:a|abbr|b|code|em|font|i|mark|small|span|strong|sub|sup|u)(?:\\s[^>]*)?>"
)
# The same with the first character outside, so that every other place is passed at once.
_HIDDEN_AHEAD = "(?is)<(?:" + _HIDDEN.removeprefix("(?is)<").replace("|<", "|") + ")"
_BREAK = "(?:<[^>]*>|[\\r\\n])+"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL without user and port; null without one."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), "^.*@|:[0-9]*$", "")
    return F.when(host != "", host)


def lines_of(html: Column) -> Column:
    """The shown lines of a page, trimmed, without empty ones; null has none."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN_AHEAD, "")
    return F.filter(F.transform(F.split(bare, _BREAK), lambda x: F.trim(x)), lambda x: x != "")


def drop_boilerplate(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    percent: int = 20,
    least_pages: int = 3,
) -> DataFrame:
    """``(id, host, n_lines, n_dropped, text)`` per row of ``pages``; ``text`` joins the kept lines.

    A line goes where at least ``least_pages`` pages of its host and over ``percent`` in a hundred of them have it;
    a page counts once for a line it repeats, and loses every occurrence. Repeated rows are pages of their own.
    Null pages have no lines. Pages without a host lose nothing. An empty table gives no rows; other columns are not
    looked at.
    """
    rows = pages.select(
        F.col(id_column).alias("id"), host_of(F.col(url_column).cast("string")).alias("host"), F.col(html_column).cast("string").alias("html")
    ).withColumn("page", F.md5(F.to_json(F.struct("id", "host", "html"), {"ignoreNullFields": "false"})))
    digest = lambda x: F.unhex(F.md5(F.concat(F.col("host"), F.lit("\n"), x)))
    digests = written(
        rows.filter(F.col("host").isNotNull())
        .select("page", "host", F.array_distinct(F.transform(lines_of(F.col("html")), digest)).alias("keys")),
        "lines",
    )
    totals = digests.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    single = digests.select("page", "host", F.explode("keys").alias("key"))
    boilerplate = (
        single.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_pages)
        .join(totals, "host").filter(F.col("n") * 100 > F.col("pages") * percent).select("key")
    )
    dropped = single.join(boilerplate, "key").select("page", "key").groupBy("page").agg(F.collect_set("key").alias("gone"))
    every = lines_of(F.col("html"))
    none = F.array().cast("array<binary>")
    kept = rows.join(dropped, "page", "left").select(
        "id", "host", every.alias("lines"), F.coalesce("gone", none).alias("gone")
    )
    left = F.filter("lines", lambda x: F.when(F.size("gone") == 0, F.lit(True)).otherwise(~F.array_contains("gone", digest(x))))
    return kept.select("id", "host", F.size("lines").cast("long").alias("n_lines"), left.alias("left")).select(
        F.col("id").alias(id_column), "host", "n_lines", (F.col("n_lines") - F.size("left")).alias("n_dropped"), F.array_join("left", "\n").alias("text")
    )


_SQL = f"""
WITH rows AS (
  SELECT page_id, row_number() OVER () AS page,
         nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^.*@|:[0-9]*$', '', 'g'), '') AS host,
         list_filter(list_transform(string_split_regex(regexp_replace(coalesce(html, ''), '{_HIDDEN}', '', 'g'), '{_BREAK}'),
                                    lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM pages),
lines AS (SELECT page, host, unnest(lines) AS line FROM rows),
totals AS (SELECT host, count(*) AS pages FROM rows WHERE host IS NOT NULL GROUP BY host),
gone AS (SELECT l.host, l.line FROM lines l JOIN totals t ON l.host = t.host
         GROUP BY l.host, l.line, t.pages HAVING count(DISTINCT page) >= 3 AND count(DISTINCT page) * 100 > t.pages * 20),
listed AS (SELECT host, list(line) AS gone FROM gone GROUP BY host),
kept AS (SELECT r.page_id, r.host, r.lines, list_filter(r.lines, lambda x: NOT coalesce(list_contains(l.gone, x), false)) AS held
         FROM rows r LEFT JOIN listed l ON r.host = l.host)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(held) AS BIGINT) AS n_dropped,
       md5(coalesce(array_to_string(held, chr(10)), '')) AS text_md5
FROM kept
"""


@query("op3_line_dedup", _SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_boilerplate(table(spark, sf_dir, "pages"))
    return cleaned.select("page_id", "host", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))
