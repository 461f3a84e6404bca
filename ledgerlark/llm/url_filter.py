"""URL filters: a blocked Bloom filter in front of an exact join with the listed URLs, and path rules.

The filter is a table: one row per block with eight 64-bit words. Every listed URL sets one bit in each
word of its block, so one lookup answers a URL. What passes is joined with the list itself, which removes
false positives; the other rows never meet a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import small, stash, without

LANES = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to /, ?, # or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host, path and query without scheme, fragment, tracking arguments, ``.html`` and closing slashes.

    Null for a url without host.
    """
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    told = F.filter(F.split(query, "&"), lambda x: ~x.rlike("^(utm_[a-z]*|ref)=|^$"))
    path = F.regexp_replace(url_path(url), r"(\.html|/)+$", "")
    tail = F.when(F.size(told) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(told), "&"))).otherwise(F.lit(""))
    host = url_host(url)
    return F.when(host != "", F.concat(host, path, tail))


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("long")


def _bits(url: Column) -> list[Column]:
    """One bit for each lane: six bits of a second hash choose its place in the word."""
    h = F.xxhash64(url, F.lit(1))
    return [F.expr(f"shiftleft(1L, int(shiftrightunsigned(__h, {6 * i}) & 63))") for i in range(LANES)], h


def build_filter(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """(block, word0..word7) over distinct non-null urls; each block's words are bitwise sums."""
    bits, h = _bits(F.col(url))
    rows = listed.select(_block(F.col(url), blocks).alias("__block"), h.alias("__h"))
    return rows.groupBy("__block").agg(*[F.bit_or(b).alias(f"__word{i}") for i, b in enumerate(bits)])


def listed_hits(
    pages: DataFrame, listed: DataFrame, url: str, bits_per_url: int = 16, broadcast_blocks: int = 500_000
) -> DataFrame:
    """The pages with a boolean ``listed``: whether the value of ``url`` is in the one-column list.

    A null url is not listed, a repeated listing counts once, and an empty list hits nothing. The filter has
    ``bits_per_url`` bits per listed URL; it is broadcast up to ``broadcast_blocks`` blocks of 72 bytes (by
    the counted size of the list), beyond that the pages meet it in a shuffle by block.
    """
    pages = without(pages, "listed")
    known = stash(listed.select(F.col(url).alias("__url")).filter(F.col("__url").isNotNull()).distinct(), "listed-urls")
    blocks = max(1, -(-known.count() * bits_per_url // (64 * LANES)))
    table = build_filter(known, "__url", blocks)
    bits, h = _bits(F.col(url))
    met = (
        pages.withColumns({"__h": h, "__b": _block(F.col(url), blocks)})
        .join(small(table, blocks, broadcast_blocks), F.col("__b") == F.col("__block"), "left")
    )
    inside = F.lit(True)
    for i, bit in enumerate(bits):
        inside = inside & (F.col(f"__word{i}").bitwiseAND(bit) != 0)
    marked = met.withColumn("__maybe", F.coalesce(inside, F.lit(False)))
    extra = ["__h", "__b", "__block", "__maybe", *[f"__word{i}" for i in range(LANES)]]
    passed = marked.filter("__maybe").drop(*extra)
    exact = known.withColumn("listed", F.lit(True))
    hits = passed.join(exact, F.col(url) == F.col("__url"), "left").withColumn(
        "listed", F.coalesce("listed", F.lit(False))
    ).drop("__url")
    others = marked.filter("not __maybe").drop(*extra).withColumn("listed", F.lit(False))
    return others.unionByName(hits)


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str]],
    url: str = "url",
    **options,
) -> DataFrame:
    """The pages with ``host``, ``path``, ``rule`` and ``verdict`` (allow or block).

    ``listed`` has one column named like ``url``; its URLs are blocked in all spellings of one canonical
    form. ``rules`` are (verdict, host/path) pairs: a rule fits its host and all subdomains if the path
    starts with the rule's, the longest wins and overrides the list. A null url, or one without host, has
    empty host and path, fits no rule and is allowed.
    """
    pages = without(pages, "host", "path", "rule", "verdict")
    keyed = pages.withColumn("__canonical", canonical_url(F.col(url)))
    known = listed.select(canonical_url(F.col(url)).alias("__canonical"))
    found = listed_hits(keyed, known, "__canonical", **options).drop("__canonical")
    found = found.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("listed"), "block").otherwise("allow")
    for what, pattern in sorted(rules, key=lambda r: len(r[1])):
        host, _, path = pattern.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule, verdict = F.when(fits, pattern).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return found.withColumns({"rule": rule, "verdict": verdict})
