"""Near duplicates by SimHash fingerprints and multi-index hashing.

Fingerprints at a small Hamming distance are found by tables keyed on segments of the fingerprint: by
the pigeonhole principle two linked fingerprints are close in at least one segment, so each
fingerprint asks every table for all keys in a small ball around its own segment, and the whole
distance of what comes back is verified. Table keys with many entries are not joined; fingerprints
that ask for them are linked through the midpoints between them, whose groups are bounded by the size of
a ball. Both ways are exact.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import discard, small, stash

BITS = 64
_CHUNK = 200_000  # shingles hashed at once, so that very long texts need no more memory
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint of the word shingles of a text, repeats included; 0 without words."""
    found = (text or b"").translate(_LOWER).split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    n = max(1, len(found) - width + 1)
    starts = np.r_[0, ends[: n - 1] + 1].tolist()
    stops = ends[len(found) - n :].tolist()
    digest = xxhash.xxh64_digest
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        hashes = b"".join([
            digest(line[a:b], seed) for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK])
        ])
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprint(text: Column, width: int = 3) -> Column:
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array((simhash(t.as_py(), width) for t in texts.cast(pa.binary())), pa.int64())

    return of(text)


def ball(bits: int, radius: int) -> list[int]:
    """XOR masks of at most ``radius`` set bits."""
    return [sum(1 << b for b in at) for r in range(radius + 1) for at in combinations(range(bits), r)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def hamming_links(prints: DataFrame, radius: int = 2, segments: int = 2, hot: int = 32) -> DataFrame:
    """Edges (a, b) among distinct fingerprints ``fp`` that leave two of them connected exactly if a
    chain of distances of at most ``radius`` (even) joins them.

    Segment i is asked within radius r_i, where the r_i + 1 add up to radius + 1. A table key with over
    ``hot`` entries goes the midpoint way.
    """
    if radius % 2 or BITS % segments:
        raise ValueError("the radius must be even and the segments must divide 64 bits")
    width = BITS // segments
    reach = [(radius + 1) // segments + (i < (radius + 1) % segments) - 1 for i in range(segments)]
    part = lambda i: F.shiftrightunsigned("fp", width * i).bitwiseAND(_signed((1 << width) - 1))

    def asked(i: int) -> Column:
        """Keys of the ball whose added bits are 0 here: of two keys at distance 1, one asks the other."""
        masks = F.array(*[F.lit(_signed(m)) for m in ball(width, reach[i])])
        near = F.filter(masks, lambda m: part(i).bitwiseAND(m) == 0) if reach[i] == 1 else masks
        return F.transform(near, lambda m: F.struct(F.lit(i).alias("segment"), part(i).bitwiseXOR(m).alias("key")))

    used = [i for i in range(segments) if reach[i] >= 0]
    own = F.array(*[F.struct(F.lit(i).alias("segment"), part(i).alias("key")) for i in used])
    entries = prints.select(F.col("fp").alias("other"), F.inline(own))
    queries = prints.select("fp", F.inline(F.concat(*[asked(i) for i in used])))
    hot_keys = stash(
        entries.groupBy("segment", "key").count().filter(F.col("count") > hot).select("segment", "key"),
        "hot-segments",
    )
    met = entries.join(hot_keys, ["segment", "key"], "left_anti").join(queries, ["segment", "key"])
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    links = met.filter((F.col("fp") != F.col("other")) & (distance <= radius)).select(
        F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")
    )
    crowded = queries.join(hot_keys, ["segment", "key"], "left_semi").select("fp").distinct()
    masks = F.array(*[F.lit(_signed(m)) for m in ball(BITS, radius // 2)])
    stars = (
        crowded.select("fp", F.explode(masks).alias("mask"))
        .groupBy(F.col("fp").bitwiseXOR(F.col("mask")).alias("middle"))
        .agg(F.min("fp").alias("a"), F.collect_list("fp").alias("near"))  # at most one ball
        .filter(F.size("near") > 1)
        .select("a", F.explode("near").alias("b"))
        .filter(F.col("a") != F.col("b"))
    )
    return links.union(stars).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge list (a, b); the root is the component's smallest node.

    Alternates two rewirings until the edges stay as they are: every node's larger neighbours move to
    its smallest neighbour, then its smaller ones do. Edges never become more than they were.
    """
    now, state = stash(edges, "links"), None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        down = large.select(F.col("b").alias("a"), F.col("a").alias("b"))  # a is the larger end
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("m").alias("a"), F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("b"))
        old, now = now, stash(small.filter("a <> b").distinct(), "links")
        discard(old)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = 2, segments: int = 2, hot: int = 32
) -> DataFrame:
    """One narrow row per document: key, ``text_digest``, ``fingerprint`` (hex) and ``component_id``.

    The component is the smallest non-null key among the documents reachable over links. Null, empty
    and blank texts have fingerprint 0 and link like any other. Rows may repeat; each returns its row.
    A component all of whose keys are null has a null id. An empty table returns no rows.
    """
    prints = stash(
        docs.select(F.col(key), F.md5(F.col(text)).alias("text_digest"), fingerprint(F.col(text)).alias("fp")),
        "fingerprints",
    )
    classes = stash(prints.groupBy("fp").agg(F.min(key).alias("first")), "classes")
    roots = connected(hamming_links(classes.select("fp"), radius, segments, hot))
    placed = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = placed.join(ids, "root").select("fp", "root", "component_id")
    return prints.join(of_print, "fp").select(
        key, "text_digest", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root"
    )


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The documents, one of each near-duplicate component: that with the smallest key (null last)."""
    return first_of_each(docs, near_duplicates(docs, text, key, **options), text, key)


def first_of_each(docs: DataFrame, found: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents, one of each ``root`` of (key, ``text_digest``, ``root``): that with the smallest key (null last)."""
    rows = found.groupBy("root", key, "text_digest").agg(F.count(F.lit(1)).alias("m"))
    first = F.min(F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("text_digest").alias("d"), "m"))
    keepers = stash(rows.groupBy("root").agg(first.alias("f")).select(
        F.col("f.k").alias("__k"), F.col("f.d").alias("__d"), F.col("f.m").alias("__m")
    ), "keepers")
    same = F.col(key).eqNullSafe(F.col("__k")) & F.col("__digest").eqNullSafe(F.col("__d"))
    digests = docs.withColumn("__digest", F.md5(F.col(text)))
    out = digests.join(keepers.filter("__m = 1"), same, "left_semi")
    # Only documents whose rows repeat take another shuffle, which leaves one of them.
    again = keepers.filter("__m > 1")
    if repeated := again.count():
        one = digests.join(small(again, repeated), same, "left_semi").dropDuplicates([key, "__digest"])
        out = out.unionByName(one)
    return out.drop("__digest")
