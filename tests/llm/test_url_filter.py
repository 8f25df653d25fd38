import re

import numpy as np
import pytest
from doclens.llm.url_filter import RULES, build_filter, canonical_url, judge, mirrored_urls, possible
from pyspark.sql import functions as F

URLS = [
    "http://A.Example.COM/en/x?utm_source=a&b=2&a=1#top", "https://www.example.com/en/", "https://x.www.example.com/en/a", "http://example.com",
    "http://example.com?q", "http://example.com/", "http://notexample.com/en/", "http://deexample.com.net/fr/1", "ftp://net/fr/", "http://u@b.net:80/es/#x",
    "http://xnet/fr/", "x://", "://com/", "com/", "", None, "http://[::1]/a", "a://b://com/x", "http://É.com/É?é#é", "http://com./", "http:///en/",
    "http://example.com/en", "http://example.com/EN/", "http://" + "a." * 3000 + "com/" + "x" * 3000, "http://h.org/p\nq/r", "http://h.org/page/?b&a&&ref=1",
]
CANONICAL = {
    URLS[0]: "a.example.com/en/x?a=1&b=2", URLS[1]: "example.com/en", URLS[3]: "example.com", URLS[4]: "example.com?q", URLS[9]: "b.net/es", "com/": None,
    URLS[25]: "h.org/page?a&b",
}


def parts_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


def verdict_by_hand(url, rules, listed, canonical):
    host, path = parts_by_hand(url)
    fitting = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fitting)[2:] if fitting else (None, "block" if canonical in listed else "allow")
    return host, path, rule, verdict


@pytest.mark.parametrize("part_blocks", [1 << 20, 2])
def test_verdicts(spark, part_blocks):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0])], "page_id long, url string").withColumn("keys", F.lit(1)).withColumn("host", F.lit("x"))
    canonical = {r["url"]: r["c"] for r in pages.select("url", canonical_url(F.col("url")).alias("c")).collect()}
    assert {u: canonical[u] for u in CANONICAL} == CANONICAL
    more = [(f"h{i}.org", f"/{'p' * (i % 7)}", "block") for i in range(300)]
    rules = spark.createDataFrame(RULES + more + [("", "/", "block"), (None, "/", "block"), ("h.org", None, "block")], "host string, path string, verdict string")
    listed = {"h.org/page?a&b", "example.com", "xnet/fr", *(f"other{i}.org/" for i in range(500))}
    urls = spark.createDataFrame([(u,) for u in sorted(listed)] + [(None,), ("example.com",)], "url string")
    got = judge(pages, rules, urls, part_blocks=part_blocks)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "listed"]
    rows = got.collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        url = URLS[r["page_id"]]
        assert tuple(r)[1:5] == verdict_by_hand(url, RULES + more, listed, canonical[url])
        assert r["listed"] == (canonical[url] in listed)


def test_longest_rule_and_both_verdicts(spark):
    pages = spark.createDataFrame([("a", "http://x.b.de/cd"), (None, "http://b.de/c"), ("z", "http://b.de")], "page_id string, url string")
    rules = spark.createDataFrame([("x.b.de", "/c", "allow"), ("b.de", "/cd", "block"), ("de", "", "block"), ("de", "", "allow"), ("b.de", "/c", "allow")], "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judge(pages, rules, spark.createDataFrame([], "url string")).collect()}
    assert got == {"a": ("x.b.de/c", "allow"), None: ("b.de/c", "allow"), "z": ("de", "block")}


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    rules, none = spark.createDataFrame(RULES, "host string, path string, verdict string"), spark.createDataFrame([], "url string")
    assert judge(pages.limit(0), rules, none).count() == 0
    assert tuple(judge(pages, rules.limit(0), none).first()) == (1, "a.com", "/x", None, "allow", False)


@pytest.mark.parametrize("part_blocks", [1 << 20, 16])
def test_filter_has_every_key_and_few_others(spark, part_blocks):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    held = build_filter(keys, "key", part_blocks)
    assert held.blocks == 125 and len(held.files) == -(-125 // part_blocks)
    rows = spark.range(20_000).select(F.col("id").alias("row"), F.array(F.concat(F.lit("k"), "id"), F.concat(F.lit("no"), "id")).alias("keys"))
    passed = {r["row"]: r["keys"] for r in possible(rows, held).collect()}
    assert len(passed) == 20_000 and all(passed[i][0] == f"k{i}" for i in range(4000))
    wrong = sum(len(k) for i, k in passed.items()) - 4000
    assert 0 < wrong < 36_000 * 0.01
    assert np.mean([len(passed[i]) for i in range(4000, 20_000)]) < 0.02


def test_mirrored_urls(spark):
    page = "<title>{}</title><article>{}</article>"
    rows = [
        (5, "http://a.com/1", page.format(5, "same")), (3, "http://b.com/1", page.format(3, "same")), (4, "https://www.b.com/1/", page.format(4, "same")),
        (6, "http://c.com/", "no element"), (7, "http://d.com/", "no element"), (8, "nowhere", "no element"), (None, "http://e.com/", "no element"),
        (9, "http://f.com/", ""), (10, "http://g.com/", None), (11, "http://h.com/", page.format(1, "other")),
    ]
    got = mirrored_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["url"] for r in got} == {"a.com/1", "d.com"}
