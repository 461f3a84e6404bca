"""SimHash and multi-index hashing against plain loops."""

import random
import re

import pytest
import xxhash

from ledgerlark.llm.queries import op2_simhash_multi_index
from ledgerlark.llm.simhash import connected, hamming_links, keep_one, near_duplicates, simhash

SCHEMA = "doc_id long, text string, fp string"


def plain_simhash(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not found:
        return 0
    grams = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=2):
    """{item: root} by union over all pairs."""
    items = sorted(prints)
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(items):
        for b in items[:x]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in items}


def test_query_against_all_pairs(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: plain_simhash(t) for i, t in texts.items()}
    want = {i: (f"{prints[i]:016x}", c) for i, c in plain_components(prints).items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op2_simhash_multi_index(spark, sf).collect()} == want


@pytest.mark.parametrize("text", [None, "", " \n\t", "one", "One TWO", "a b c d a b c", "É\x85x\u2003y z", "w " * 300_000])
def test_fingerprint_of_odd_texts(text):
    signed = simhash(None if text is None else text.encode())
    assert signed % (1 << 64) == plain_simhash(text)


@pytest.mark.parametrize("hot", [0, 2, 32])
def test_links_hot_and_cold_tables_agree(spark, hot):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    prints = {centre, 0, 1, 3, 7, 15}
    for _ in range(150):  # a dense ball, chains, and noise
        p = centre
        for _ in range(rng.randint(0, 4)):
            p ^= 1 << rng.randrange(64)
        prints |= {p, rng.getrandbits(64)}
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    edges = hamming_links(df, hot=hot)
    assert all((signed[r.a] ^ signed[r.b]).bit_count() <= 2 for r in edges.collect())
    got = {r.node: r.root for r in connected(edges).collect()}
    want = plain_components(signed)
    assert {s: got.get(s, s) for s in signed} == want


def test_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(1, 200)] + [(1000, i) for i in range(1001, 1300)]
    random.Random(1).shuffle(chain)
    got = {r.node: r.root for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(2, 201)) and all(got[i] == 1000 for i in range(1001, 1300))


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(None, "lonely words in here", "x"), (5, None, "x"), (4, "", "x"), (4, "", "x"), (9, "same text here", "x"), (8, "SAME text here", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id) for r in near_duplicates(df).collect())
    assert got == [(-1, None), (4, 4), (4, 4), (5, 4), (8, 8), (9, 8)]
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "lonely words in here"), (4, ""), (8, "SAME text here")]
    assert near_duplicates(df.limit(0)).collect() == [] and keep_one(df.limit(0)).collect() == []
