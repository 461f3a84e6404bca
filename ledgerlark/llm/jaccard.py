"""Near duplicates by the exact Jaccard similarity of word shingles.

First links come from ``simhash``: fingerprints of the shingle sets at a small Hamming distance, found by multi-index
hashing. They connect most copies but not all that are similar, so the rest comes from a prefix filter:
two sets with similarity t or more share a shingle among the |s| - ceil(t |s|) + 1 first ones of each, in any
order that holds for all sets, so candidates miss no pair. Frequent shingles come last in the order, the most frequent
ones at the very end: those of a sample, then all that over a few sets were found to have among their first ones. This
bears on the speed only. The place of a shared shingle bounds what two sets can share if it is the first one they share,
so pairs that meet too late for the similarity are no candidates. Keys are not capped: in each round some
members of a key are compared with all its members outside their component, four times as many as in the round
before, until a key holds one component or all its pairs were compared. A group of near copies collapses in the
first rounds, so no pair list of it is made. Every link is verified on the texts; bit maps of the sets reject most
other pairs before, by a bound that rejects no similar pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import arrow_rows, discard, in_map, key_map, small, stash
from ledgerlark.llm.simhash import _LOWER, connected, hamming_links

#: Documents on which shingle frequencies are estimated, and how many of them make a shingle frequent.
SAMPLE, FREQUENT = 20_000, 4
_MOST_FREQUENT = 500_000
#: All pairs of a key with so few sets are compared at once; shingles with more sets are put last, in so many passes.
_FEW, PASSES = 8, 2
#: Whole texts that a Python worker gets at once.
TEXTS = 1_000
#: Members of a key that one task compares with the key's leaders.
_DEAL = 2_000


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, a blank one has none."""
    found = (text or b"").translate(_LOWER).split()
    if not found:
        return np.empty(0, dtype=np.int64)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    n = max(1, len(found) - width + 1)
    starts, stops = np.r_[0, ends[: n - 1] + 1].tolist(), ends[len(found) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b]) for a, b in zip(starts, stops)), dtype=np.uint64, count=n).view(np.int64))


def shingle_sets(text: Column, width: int) -> Column:
    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_py(), width) for t in texts.cast(pa.binary())], pa.list_(pa.int64()))

    return of(text)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def held_in(s: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mask of the members of ``s`` in the sorted table."""
    if not len(table):
        return np.zeros(len(s), dtype=bool)
    return table[np.minimum(np.searchsorted(table, s), len(table) - 1)] == s


class Late:
    """Shingles that come last in the order, by their number of sets; adding some leaves the others as they were."""

    def __init__(self, hashes: np.ndarray, sets: np.ndarray) -> None:
        by_hash = np.argsort(hashes, kind="stable")
        self.hashes, self.sets = hashes[by_hash], sets[by_hash]

    def plus(self, hashes: np.ndarray, sets: np.ndarray) -> Late:
        fresh = ~held_in(hashes, self.hashes)
        return Late(np.r_[self.hashes, hashes[fresh]], np.r_[self.sets, sets[fresh]])

    def head(self, s: np.ndarray, percent: int) -> np.ndarray:
        """First shingles of a sorted set: the order of the hashes, then that of (sets, hash) for the late ones."""
        last = held_in(s, self.hashes)
        late = s[last]
        at = np.searchsorted(self.hashes, late)
        return np.r_[s[~last], late[np.argsort(self.sets[at], kind="stable")]][: prefix_length(len(s), percent)]


def majority(s: np.ndarray) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if set in over half of the hashes; 0 without any."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(s), 100_000):
        ones += np.unpackbits(s[at : at + 100_000].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(s)).tobytes(), "big", signed=True)


def bit_map(s: np.ndarray) -> bytes:
    """The set as bits at the hashes' low bits; the number of bits is a power of two, four times the set or more."""
    size = max(512, 1 << (4 * len(s) - 1).bit_length()) if len(s) else 512
    bits = np.zeros(size, dtype=np.uint8)
    bits[(s & (size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def may_be_similar(a: bytes, b: bytes, na: int, nb: int, percent: int) -> bool:
    """False only if two sets of these bit maps and sizes can't reach the similarity."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    while len(x) > len(y):  # bit k of a map of half the size is bit k or k + half of the map
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    common = min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))
    return 100 * common >= percent * (na + nb - common)


def sketches(text: Column, width: int, percent: int, late) -> Column:
    """(sid, n, fp, head, bits): 64-bit id of the shingle set, its size, fingerprint, first shingles and bit map; those in the
    broadcast ``late`` come last."""

    @F.arrow_udf("struct<sid:bigint,n:bigint,fp:bigint,head:array<bigint>,bits:binary>")
    def of(texts: pa.Array) -> pa.Array:
        sids, sizes, prints, heads, maps = [], [], [], [], []
        for t in texts.cast(pa.binary()):
            s = shingle_set(t.as_py(), width)
            sids.append(int.from_bytes(xxhash.xxh64_digest(s.tobytes(), 1), "big", signed=True))
            sizes.append(len(s))
            prints.append(majority(s))
            heads.append(late.value.head(s, percent))
            maps.append(bit_map(s))
        columns = [pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(heads, pa.list_(pa.int64())), pa.array(maps, pa.binary())]
        return pa.StructArray.from_arrays(columns, names=["sid", "n", "fp", "head", "bits"])

    return of(text)


def heads(text: Column, width: int, percent: int, late) -> Column:
    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([late.value.head(shingle_set(t.as_py(), width), percent) for t in texts.cast(pa.binary())], pa.list_(pa.int64()))

    return of(text)


def frequent_shingles(docs: DataFrame, text: str, width: int) -> Late:
    """Shingles that are frequent in a sample of the distinct texts, the most frequent ones if there are too many."""
    n = docs.count()
    every = max(1, n // SAMPLE)
    sample = docs.select(F.col(text).alias("__t")).filter(F.pmod(F.xxhash64("__t"), F.lit(every)) == 0).distinct()
    counts = sample.select(F.explode(shingle_sets(F.col("__t"), width)).alias("h")).groupBy("h").count()
    top = counts.filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "h").limit(_MOST_FREQUENT)
    found = top.toArrow()
    return Late(found["h"].to_numpy().astype(np.int64), found["count"].to_numpy().astype(np.int64) * every)


class Verifier:
    """Keeps those pairs of sets (a, b) whose similarity is at least ``percent``: sizes, then bit maps, then whole texts."""

    def __init__(self, docs: DataFrame, text: str, classes: DataFrame, width: int, percent: int) -> None:
        self.texts = docs.select(F.col(text).alias("t")).withColumn("d", F.coalesce(F.md5("t"), F.lit("")))
        self.classes, self.width, self.percent = classes, width, percent

    def similar(self, pairs: DataFrame) -> DataFrame:
        percent, width = self.percent, self.width

        @F.arrow_udf("boolean")
        def possible(a: pa.Array, b: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
            rows = zip(a.to_pylist(), b.to_pylist(), na.to_pylist(), nb.to_pylist())
            return pa.array([may_be_similar(*r, percent) for r in rows], pa.bool_())

        @F.arrow_udf("boolean")
        def alike(a: pa.Array, b: pa.Array) -> pa.Array:
            out, last, left = [], None, None
            for x, y in zip(a.cast(pa.binary()), b.cast(pa.binary())):
                if left is None or x != last:
                    last, left = x, shingle_set(x.as_py(), width)
                right = shingle_set(y.as_py(), width)
                common = int(held_in(left, right).sum())
                out.append(100 * common >= percent * (len(left) + len(right) - common))
            return pa.array(out, pa.bool_())

        side = lambda c: self.classes.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"), F.col("d").alias(f"d{c}"))
        # The narrow pairs go to the maps, not all maps to the pairs of a round.
        asked = small(pairs, pairs.count())
        met = asked.join(side("a"), "a").join(asked.join(side("b"), "b"), ["a", "b"])
        sized = met.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        open_ = stash(sized.filter(possible("bitsa", "bitsb", "na", "nb")).select("a", "b", "da", "db"), "possible-pairs")
        wanted = stash(open_.select(F.explode(F.array("da", "db")).alias("d")).distinct(), "wanted-texts")
        texts = stash(self.texts.join(small(wanted, wanted.count()), "d").dropDuplicates(["d"]), "texts")
        both = open_.join(texts.withColumnsRenamed({"d": "da", "t": "ta"}), "da").join(texts.withColumnsRenamed({"d": "db", "t": "tb"}), "db")
        found = stash(both.filter(alike("ta", "tb")).select("a", "b"), "similar")
        discard(open_, wanted, texts)
        return found


def first_links(classes: DataFrame, verifier: Verifier, radius: int = 2) -> DataFrame:
    """Verified links among sets whose fingerprints lie within ``radius`` bits, by multi-index hashing."""
    prints = stash(classes.groupBy("fp").agg(F.min("sid").alias("first")), "set-prints")
    near = hamming_links(prints.select("fp"), radius)
    ends = near.join(prints.select(F.col("fp").alias("a"), F.col("first").alias("fa")), "a").join(prints.select(F.col("fp").alias("b"), F.col("first").alias("fb")), "b")
    same = classes.select("fp", "sid").join(prints, "fp").filter("sid <> first").select("first", "sid")
    pairs = stash(ends.select("fa", "fb").union(same).toDF("a", "b"), "print-pairs")
    found = verifier.similar(pairs)
    discard(prints, pairs)
    return found


def similar_links(entries: DataFrame, links: DataFrame, verifier: Verifier) -> DataFrame:
    """Edges (root, sid) that leave two sets connected exactly if a chain of similar pairs joins them.

    ``entries``: (h, sid, n, at), the keys of every set that shares one and their places; ``links``: what is known already.
    If h is the first shingle that two sets share, they share no more than what each of them has from it on. Similar sets
    meet at that key, so those that can't be similar by this bound are not compared there.
    """
    percent, leaders, stars = verifier.percent, 1, None
    while True:
        if not links.isEmpty():
            known = links if stars is None else links.union(stars)
            old, stars = stars, stash(connected(known).select(F.col("root").alias("a"), F.col("node").alias("b")), "stars")
            discard(old)
        discard(links)
        rooted = entries if stars is None else entries.join(stars.select(F.col("b").alias("sid"), F.col("a").alias("root")), "sid", "left")
        root = F.col("sid") if stars is None else F.coalesce("root", "sid")
        live = stash(rooted.select("h", "sid", "n", "at", root.alias("root")), "rooted-keys")
        keys = live.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("sid").alias("first"))
        led = stash(live.join(keys.filter("lo <> hi"), "h").drop("lo", "hi"), "live-keys")
        discard(entries, live)
        if led.isEmpty():
            discard(led)
            return stars if stars is not None else entries.sparkSession.createDataFrame([], "a long, b long")
        # All members of a small key lead; else the first one and about 4^round more, much the same ones in all keys.
        draw = F.pmod(F.xxhash64("sid"), F.lit(1 << 30)) / 2.0**30 * F.col("m") < float(leaders - 1)
        led = led.withColumn("leads", (F.col("sid") == F.col("first")) | (F.col("m") <= _FEW) | draw)
        # The members of a large key are dealt over several places, each of which gets all its leaders.
        places = F.ceil(F.col("m") / _DEAL)
        lead = led.filter("leads").select("h", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("at").alias("ata"), F.col("root").alias("ra"), F.explode(F.sequence(F.lit(0).cast("long"), places - 1)).alias("place"))
        dealt = led.withColumn("place", F.pmod(F.xxhash64("sid"), places))
        shared = F.least(F.col("n") - F.col("at"), F.col("na") - F.col("ata"))
        near = ((100 + percent) * shared >= percent * (F.col("n") + F.col("na"))) & (F.col("root") != F.col("ra"))
        met = lead.join(dealt, ["h", "place"]).filter(near & (~F.col("leads") | (F.col("a") < F.col("sid"))))
        pairs = stash(met.select(F.least("a", "sid").alias("a"), F.greatest("a", "sid").alias("b")).distinct(), "pairs")
        links = verifier.similar(pairs)
        entries = stash(led.filter(~F.col("leads")).select("h", "sid", "n", "at"), "left-keys")
        discard(pairs)
        leaders *= 4


def holds_any(head: Column, table) -> Column:
    """Whether the array has a member in the sorted broadcast ``table``."""

    @F.arrow_udf("boolean")
    def of(found: pa.Array) -> pa.Array:
        return pa.array([bool(held_in(h.values.to_numpy(zero_copy_only=False), table.value).any()) for h in found], pa.bool_())

    return of(head)


def key_sizes(classes: DataFrame) -> DataFrame:
    """(h, m): the number of sets that have h in ``head``."""
    return classes.select(F.explode("head").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("m"))


def rarest_first(classes: DataFrame, docs: DataFrame, text: str, late: Late, width: int, percent: int) -> DataFrame:
    """The sets with shingles that over ``_FEW`` of them have in ``head`` put last; other heads are the same in the new order."""
    context = classes.sparkSession.sparkContext
    texts = docs.select(F.col(text).alias("t"), F.coalesce(F.md5(text), F.lit("")).alias("d"))
    for _ in range(PASSES):
        common = key_sizes(classes).filter(F.col("m") > _FEW).orderBy(F.desc("m"), "h").limit(_MOST_FREQUENT + len(late.hashes)).toArrow()
        more = late.plus(common["h"].to_numpy().astype(np.int64), common["m"].to_numpy().astype(np.int64))
        if len(more.hashes) == len(late.hashes):
            break
        fresh = context.broadcast(more.hashes[~held_in(more.hashes, late.hashes)])
        late = more
        marked = stash(classes.withColumn("moved", holds_any(F.col("head"), fresh)), "marked-classes")
        discard(classes)
        wanted = stash(marked.filter("moved").select("sid", "d"), "moved-classes")
        again = texts.join(small(wanted, wanted.count()), "d").select("sid", heads(F.col("t"), width, percent, context.broadcast(late)).alias("head"))
        again = stash(again.groupBy("sid").agg(F.first("head").alias("head")), "moved-heads")  # the same for every text of a set
        kept = marked.filter("not moved").drop("moved")
        classes = stash(kept.unionByName(marked.filter("moved").drop("moved", "head").join(again, "sid")), "classes")
        discard(marked, wanted, again)
    return classes


def shared_keys(classes: DataFrame) -> DataFrame:
    """(h, sid, n, at) of the keys in ``head`` that two sets or more have, and few others (a bit map decides)."""
    shared = stash(key_sizes(classes).filter("m > 1").select("h"), "shared-keys")
    used = classes.sparkSession.sparkContext.broadcast(key_map(shared, "h"))
    discard(shared)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column(2), len(batch)
            keys = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), sizes)
            place = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            mask = in_map(used.value, keys)
            at = pa.array(row[mask])
            columns = [pa.array(keys[mask], pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(place[mask], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "sid", "n", "at"])

    return stash(classes.select("sid", "n", "head").mapInArrow(keep, "h bigint, sid bigint, n bigint, at bigint"), "keys")


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """(key, ``text_digest``, ``root``): the component of every document over links of similarity percent / 100 or more.

    Words as in ``simhash``. Documents without words (null, empty, blank) are copies of one another. Shingles and
    whole sets are compared by 64-bit hashes. Repeated rows each return their row, in one component; keys may
    be null; other columns don't matter; an empty table returns no rows. Very long texts are read whole.
    """
    with arrow_rows(docs.sparkSession, TEXTS):
        docs = docs.select(F.col(key), F.col(text))
        order = frequent_shingles(docs, text, width)
        late = docs.sparkSession.sparkContext.broadcast(order)
        found = docs.select(F.col(key), F.md5(F.col(text)).alias("text_digest"), sketches(F.col(text), width, percent, late).alias("p"))
        whole = stash(found.select(key, "text_digest", "p.*"), "sketches")
        digest = F.min(F.coalesce("text_digest", F.lit(""))).alias("d")
        firsts = [F.first(c).alias(c) for c in ("n", "fp", "head", "bits")]  # the same for every row of a set
        classes = stash(whole.groupBy("sid").agg(*firsts, digest), "classes")
        prints = stash(whole.select(key, "text_digest", "sid"), "prints")
        discard(whole)
        classes = rarest_first(classes, docs, text, order, width, percent)
        entries = shared_keys(classes)
        narrow = stash(classes.drop("head"), "set-maps")
        discard(classes)
        verifier = Verifier(docs, text, narrow, width, percent)
        stars = similar_links(entries, first_links(narrow, verifier), verifier)
        roots = stars.select(F.col("b").alias("sid"), F.col("a").alias("r"))
        return prints.join(roots, "sid", "left").select(key, "text_digest", F.coalesce("r", "sid").alias("root"))
