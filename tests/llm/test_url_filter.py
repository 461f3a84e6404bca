"""Blocked Bloom filter in front of the exact join; rules."""

import pytest
from pyspark.sql import functions as F

from ledgerlark.llm.queries import URL_RULES
from ledgerlark.llm.url_filter import canonical_url, judge_urls, listed_hits

PAGES = "page_id long, url string, rule int"


@pytest.mark.parametrize("limit", [0, 500_000])
@pytest.mark.parametrize("bits", [1, 16])
def test_listed_is_exact_at_any_filter_size(spark, bits, limit):
    pages = spark.createDataFrame([(i, f"u{i}") for i in range(4000)] + [(9999, None)], "id long, u string")
    listed = spark.createDataFrame([(f"u{i}",) for i in range(0, 8000, 7)] * 2 + [(None,)], "u string")
    got = {r.id: r.listed for r in listed_hits(pages, listed, "u", bits, limit).collect()}
    assert got == {i: i % 7 == 0 for i in range(4000)} | {9999: False}


def test_rules_and_odd_urls(spark):
    urls = {
        "http://Example.COM/en/1": ("example.com", "/en/1", "example.com/en/", "block"),
        "http://www.example.com/en/1?q": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://xexample.com/en/1": ("xexample.com", "/en/1", "com/", "allow"),
        "http://example.com": ("example.com", "", None, "allow"),
        "https://b.example.net/fr/2#t": ("b.example.net", "/fr/2", "net/fr/", "block"),
        "ftp://listed.org/a.html#x": ("listed.org", "/a.html", None, "block"),
        "https://listed.org/b": ("listed.org", "/b", None, "allow"),
        "no url": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "x://y://z/p": ("y:", "//z/p", None, "allow"),
    }
    rows = [(i, u, 1) for i, u in enumerate(urls)] + [(0, "http://Example.COM/en/1", 1)]
    pages = spark.createDataFrame(rows, PAGES)
    listed = spark.createDataFrame([("http://LISTED.org/a/?utm_source=feed",), (None,), ("junk",)], "url string")
    got = judge_urls(pages, listed, URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == urls[r.url]
    assert judge_urls(pages.limit(0), listed, URL_RULES).collect() == []
    assert {r.verdict for r in judge_urls(pages, listed.limit(0), []).collect()} == {"allow"}


def test_canonical_forms(spark):
    same = ["http://A.b/c/1", "https://a.b/c/1/", "http://a.b/c/1.html#top", "http://a.b/c/1?utm_source=x&ref=y"]
    got = spark.createDataFrame([(u,) for u in same], "u string").select(canonical_url(F.col("u")).alias("c")).distinct().collect()
    assert [r.c for r in got] == ["a.b/c/1"]
