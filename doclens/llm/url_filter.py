"""URL filters: a blocked Bloom filter in front of an exact hash join.

Listed are rules (a host with its subdomains, and the beginning of a path) and whole canonical URLs. Each becomes a key. A
URL asks for few keys: its canonical form, and for each *shape* of a rule (number of host labels, length of the path)
the one prefix of itself that has this shape. The filter is made of blocks of 512 bits; a key has one block, and one bit
in each of the block's eight words. Keys that it passes are joined exactly, which removes the false positives.

The filter is sized by the number of keys and cut into parts of at most 64 MB, which executors write as files. With one
part the scan itself asks it and nothing is shuffled; with more, hashes go to the tasks of their part. URLs
that the filter turns away take no part in the join.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.files import Whole, make_folder, opened
from doclens.llm.base import query, table, tasks
from doclens.session import broadcast_if_small, shared_folder, written

KEY_BITS = 16  # bits of the filter per key: some 2 of 1000 keys that are not listed pass
WORDS = 8  # 64-bit words of a block
PART_BLOCKS = 1 << 20  # blocks of a part of the filter: 64 MB

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TRACKING = "^(utm_[^=]*|ref|gclid|fbclid)(=|$)"  # parameters that do not change the page
_ARTICLE = "(?s)<article>(.*?)</article>"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, user, default port, ``www.``, last slash and fragment, then the sorted parameters.

    Parameters that only track are left out. Null without ``://``.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^.*@|:(80|443)$", ""), "^www\\.|\\.$", "")
    asked = F.split(F.regexp_extract(_rest(url), "^[^?#]*\\?([^#]*)", 1), "&")
    told = F.array_join(F.array_sort(F.filter(asked, lambda x: (x != "") & ~x.rlike(_TRACKING))), "&")
    whole = F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(told == "", F.lit("")).otherwise(F.concat(F.lit("?"), told)))
    return F.when(_rest(url).isNotNull(), whole)


# --- the filter ------------------------------------------------------------------
def _bits(key: Column) -> list[Column]:
    """Two hashes of a key: one for its block, one for its bits."""
    return [F.xxhash64(key), F.xxhash64(key, F.lit(1))]


def block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes.view(np.uint64) >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


class Filter:
    """A blocked Bloom filter in files; it has every key that it was built from, and few others."""

    def __init__(self, folder: str, files: list[str], blocks: int, part_blocks: int):
        self.folder, self.files, self.blocks, self.part_blocks = folder, files, blocks, part_blocks

    def has(self, places: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """For the two hashes of some keys of a few parts: whether the filter holds them."""
        block = block_of(places, self.blocks)
        found, part_of = np.zeros(len(block), bool), block // self.part_blocks
        for part in np.unique(part_of).tolist():
            own = np.flatnonzero(part_of == part)
            words = _part(self.folder, self.files[part])
            at = (block[own] - part * self.part_blocks) * WORDS
            hit = np.ones(len(own), bool)
            for word in range(WORDS):
                bit = bits[own].view(np.uint64) >> np.uint64(6 * word) & np.uint64(63)
                hit &= words[at + word] >> bit & np.uint64(1) == 1
            found[own] = hit
        return found


@functools.lru_cache(maxsize=1)
def _part(folder: str, file: str) -> np.ndarray:
    system, path = opened(folder)
    with system.open_input_file(f"{path}/{file}") as stream:
        return np.frombuffer(stream.read(), "<u8")


def build_filter(keys: DataFrame, column: str, part_blocks: int = PART_BLOCKS) -> Filter:
    """The filter of all values of a string column. Bits are combined in the tasks and by block; a task writes a part."""
    spark = keys.sparkSession
    blocks = max(1, -(-keys.count() * KEY_BITS // (64 * WORDS)))
    parts = -(-blocks // part_blocks)
    place, bits = _bits(F.col(column))
    # the high half of the hash, scaled to the number of blocks: below 2 ** 63 for up to 2 ** 31 blocks
    block = F.shiftright(F.shiftrightunsigned(place, 32) * F.lit(blocks), 32)
    masks = [
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * w).bitwiseAND(F.lit(63)).cast("int")) for w in range(WORDS)
    ]
    combined = (
        keys.select(block.alias("block"), *(m.alias(f"w{w}") for w, m in enumerate(masks)))
        .groupBy("block").agg(*(F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)))
        .withColumn("part", F.floor(F.col("block") / part_blocks))
    )
    folder = shared_folder(spark, "url-filter")
    make_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, current, words = [], None, None

        def flush() -> None:
            file = Whole(folder, f"part-{current:06d}-{uuid.uuid4().hex}")
            file.write(words.astype("<u8").tobytes())
            file.close()
            done.append((current, file.path.rpartition("/")[2]))

        for batch in batches:
            part_of, block_at = batch.column("part").to_numpy(), batch.column("block").to_numpy()
            for part in np.unique(part_of).tolist():
                if part != current:
                    if current is not None:
                        flush()
                    current, words = part, np.zeros(min(part_blocks, blocks - part * part_blocks) * WORDS, np.uint64)
                own = np.flatnonzero(part_of == part)
                for w in range(WORDS):
                    words[(block_at[own] - part * part_blocks) * WORDS + w] = batch.column(f"w{w}").to_numpy()[own].view(np.uint64)
        if current is not None:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.int64()), pa.array([f for _, f in done], pa.string())], ["part", "file"])

    dealt = combined.repartition(parts, "part").sortWithinPartitions("part")
    files = {r["part"]: r["file"] for r in dealt.mapInArrow(write, "part long, file string").collect()}  # one row per 64 MB
    for part in range(parts):  # no key has a bit there
        if part not in files:
            empty = Whole(folder, f"part-{part:06d}-{uuid.uuid4().hex}")
            empty.write(bytes(8 * WORDS * min(part_blocks, blocks - part * part_blocks)))
            empty.close()
            files[part] = empty.path.rpartition("/")[2]
    return Filter(folder, [files[part] for part in range(parts)], blocks, part_blocks)


def possible(rows: DataFrame, held: Filter) -> DataFrame:
    """``rows`` (``row``, ``keys``, ...) with ``keys`` cut down to those that the filter passes."""
    if len(held.files) == 1:

        @F.arrow_udf("array<boolean>")
        def asked(places: pa.Array, bits: pa.Array) -> pa.Array:
            flat = held.has(places.flatten().to_numpy(zero_copy_only=False), bits.flatten().to_numpy(zero_copy_only=False))
            sizes = places.value_lengths().to_numpy(zero_copy_only=False)
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat))

        flagged = rows.withColumn("flags", asked(F.transform("keys", lambda k: _bits(k)[0]), F.transform("keys", lambda k: _bits(k)[1])))
        return flagged.withColumn("keys", F.filter("keys", lambda k, i: F.get("flags", i))).drop("flags")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = held.has(batch.column("place").to_numpy(), batch.column("bits").to_numpy())
            own = batch.filter(pa.array(hit))
            yield pa.RecordBatch.from_arrays([own.column("row"), own.column("at")], ["row", "at"])

    single = rows.select("row", F.posexplode("keys").alias("at", "key"))
    hashed = single.select("row", "at", *(h.alias(n) for n, h in zip(("place", "bits"), _bits(F.col("key")))))
    # a task's rows have neighbouring blocks, so it reads few parts, one after the other
    dealt = hashed.repartitionByRange(max(tasks(rows.sparkSession), 2 * len(held.files)), F.shiftrightunsigned("place", 32), "row")
    passed = dealt.sortWithinPartitions(F.shiftrightunsigned("place", 32)).mapInArrow(ask, "row long, at int")
    kept = passed.groupBy("row").agg(F.array_sort(F.collect_list("at")).alias("places"))  # no more than there are shapes
    joined = rows.join(kept, "row", "left")
    return joined.withColumn("keys", F.transform(F.coalesce("places", F.array().cast("array<int>")), lambda i: F.get("keys", i))).drop("places")


# --- verdicts ----------------------------------------------------------------------
def judge(
    pages: DataFrame,
    rules: DataFrame,
    listed: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    part_blocks: int = PART_BLOCKS,
) -> DataFrame:
    """``(id, host, path, rule, verdict, listed)`` per row of ``pages``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (``allow`` or ``block``): a rule fits its host and all subdomains of it,
    where the path begins with the rule's. The longest fitting rule decides, of equally long ones that of the longer host, and
    ``block`` where a rule is listed with both verdicts. Without a rule, URLs whose canonical form is in ``listed`` (``url``,
    canonical) are blocked and others allowed. Rules without a host fit nothing; null parts of rules and null listed URLs
    are passed over. A null URL or one without ``://`` has an empty host and path and is allowed. Repeated rows and
    null ids are rows like others, empty tables are fine, other columns are not looked at. A long URL is held by one row.
    """
    spark = pages.sparkSession
    kept_rules = rules.filter((F.col("host") != "") & F.col("path").isNotNull() & F.col("verdict").isNotNull()).select(
        F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict"
    )
    rule_keys = kept_rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        F.concat(F.lit("rule "), "host", F.lit(" "), "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict",
        F.size(F.split("host", "\\.")).alias("labels"), F.length("path").alias("begins"), F.length("host").alias("host_length"),
    )
    url_keys = listed.filter(F.col("url").isNotNull()).select(F.concat(F.lit("url "), "url").alias("key")).distinct()
    keys = written(rule_keys.unionByName(url_keys, allowMissingColumns=True), "listed")
    # as many as there are numbers of labels times lengths of paths
    shapes = [(r["labels"], r["begins"]) for r in keys.filter("rule IS NOT NULL").select("labels", "begins").distinct().collect()]

    url = F.col("_url")
    rows = pages.select(F.col(id_column).alias("_id"), F.col(url_column).cast("string").alias("_url")).select(
        "_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical_url(url).alias("_canonical")
    )
    labels = F.size(F.split("host", "\\."))
    prefix = lambda n, begins: F.when(
        (F.col("host") != "") & (labels >= n) & (F.length("path") >= begins),
        F.concat(F.lit("rule "), F.substring_index("host", ".", -n), F.lit(" "), F.substring("path", 1, begins)),
    )
    asked = F.array_compact(F.array(F.concat(F.lit("url "), F.col("_canonical")), *(prefix(n, b) for n, b in sorted(shapes))))
    numbered = rows.withColumn("keys", asked).drop("_canonical").withColumn("row", F.monotonically_increasing_id())
    held = build_filter(keys, "key", part_blocks)
    probed = written(possible(numbered if len(held.files) == 1 else written(numbered, "urls"), held), "possible")
    # the exact join: a few rules may fit most of the URLs, so a large list is left to the join that splits skewed keys
    hits = probed.filter(F.size("keys") > 0).select("row", "_id", "host", "path", F.explode("keys").alias("asked"))
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("l"), "host_length", "rule", "verdict")))
    judged = (
        hits.join(broadcast_if_small(keys), F.col("asked") == F.col("key"), "left")
        .groupBy("row", "_id", "host", "path")
        .agg(best.alias("best"), F.coalesce(F.bool_or(F.col("key").isNotNull() & F.col("rule").isNull()), F.lit(False)).alias("listed"))
        .select("_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled"), "listed")
    )
    nothing = probed.filter(F.size("keys") == 0).select(
        "_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("ruled"), F.lit(False).alias("listed")
    )
    verdict = F.coalesce("ruled", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.unionByName(nothing).select(F.col("_id").alias(id_column), "host", "path", "rule", verdict.alias("verdict"), "listed")


def mirrored_urls(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``(url)``: canonical URLs whose article was seen under another URL with a smaller id.

    The article of a page without the element is the whole page. Pages without text, id or canonical URL list nothing.
    """
    html = F.col(html_column).cast("string")
    article = F.regexp_extract(html, _ARTICLE, 1)
    rows = pages.filter((html != "") & F.col(id_column).isNotNull()).select(
        F.md5(F.when(article == "", html).otherwise(article)).alias("digest"), canonical_url(F.col(url_column).cast("string")).alias("url"), F.col(id_column).alias("id")
    )
    held = written(rows.filter(F.col("url").isNotNull()).groupBy("digest", "url").agg(F.min("id").alias("id")), "payloads")
    first = held.groupBy("digest").agg(F.min(F.struct("id", "url")).alias("first"), F.count(F.lit(1)).alias("urls")).filter("urls > 1")
    return held.join(first.select(F.col("digest").alias("_digest"), "first"), F.col("digest") == F.col("_digest")).filter(
        F.col("url") != F.col("first.url")
    ).select("url").distinct()


RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]

_SQL_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_SQL = f"""
WITH rests AS (SELECT row_number() OVER () AS n, page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT n, page_id, html, rest, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'),
                                               lambda x: x <> '' AND NOT regexp_matches(x, '{_TRACKING}'))), '&') AS told
  FROM rests),
urls AS (
  SELECT *, CASE WHEN rest IS NOT NULL THEN
         regexp_replace(regexp_replace(host, '^.*@|:(80|443)$', '', 'g'), '^www\\.|\\.$', '', 'g') || regexp_replace(path, '/+$', '') ||
         CASE WHEN coalesce(told, '') = '' THEN '' ELSE '?' || told END END AS url
  FROM parts),
payloads AS (SELECT md5(coalesce(nullif(regexp_extract(html, '{_ARTICLE}', 1), ''), html)) AS digest, url, min(page_id) AS id FROM urls WHERE html <> '' AND page_id IS NOT NULL AND url IS NOT NULL GROUP BY ALL),
firsts AS (SELECT digest, min(struct_pack(id := id, url := url)).url AS first FROM payloads GROUP BY digest),
mirrored AS (SELECT DISTINCT url FROM payloads JOIN firsts USING (digest) WHERE url <> first),
rules(rule_host, rule_path, rule_verdict) AS (VALUES {_SQL_RULES}),
fitting AS (
  SELECT n, rule_host || rule_path AS rule, rule_verdict, row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS rank
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.rule_verdict, CASE WHEN m.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, m.url IS NOT NULL AS listed
FROM urls u LEFT JOIN fitting f ON u.n = f.n AND f.rank = 1 LEFT JOIN mirrored m ON u.url = m.url
"""


@query("op13_url_filter", _SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(pages, rules, mirrored_urls(pages))
