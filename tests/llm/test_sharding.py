"""Histogram sort: even bytes, gapless slots, groups of copies cut by id, odd inputs."""

import random
import zlib

from pyspark.sql import functions as F

from ledgerlark.llm.queries import op1_histogram_sort
from ledgerlark.llm.sharding import find_splitters, shard_by_bytes

SCHEMA = "doc_id long, text string, shard string"


def sizes_of(rows):
    out = {}
    for r in rows:
        out[r["shard"]] = out.get(r["shard"], 0) + r["size"]
    return out


def test_query_over_all_documents(spark, sf):
    rows = op1_histogram_sort(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_hot_group_is_cut_and_shares_are_even(spark):
    rng = random.Random(3)
    rows = [(i, "copy " * 30 if i % 3 == 0 else " ".join(rng.choices("abcdef", k=rng.randint(1, 60))), "x") for i in range(6000)]
    out = shard_by_bytes(spark.createDataFrame(rows, SCHEMA), 8, tolerance=0.002)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "size", "shard", "slot"]
    total = sum(r["size"] for r in got)
    assert len(got) == 6000 and all(abs(s - total / 8) <= 2 * 0.002 * total / 8 + 200 for s in sizes_of(got).values())
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in shard_by_bytes(spark.createDataFrame(rows, SCHEMA), 8, tolerance=0.002).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in got}


def test_splitters_match_a_full_sort(spark):
    rng = random.Random(5)
    rows = [(rng.choice([7, rng.getrandbits(60)]), i, rng.randint(16, 900)) for i in range(3000)]
    narrow = spark.createDataFrame(rows, "__key long, __tie long, __size long")
    cuts = find_splitters(narrow, 10, 0.0, 16)
    keys = sorted(((k + (1 << 63)) << 64 | (t + (1 << 63)), s) for k, t, s in rows)
    total = sum(s for _, s in keys)
    for k, cut in enumerate(cuts, 1):
        below = sum(s for key, s in keys if key < cut)
        best = min(abs(sum(s for _, s in keys[:i]) - total * k / 10) for i in range(len(keys) + 1))
        assert abs(below - total * k / 10) == best


def test_nulls_repeats_empty_and_extra_columns(spark):
    rows = [(None, None, "s"), (1, "", "s"), (1, "", "s"), (2, None, "s"), (3, "é" * 5000, "s")]
    got = shard_by_bytes(spark.createDataFrame(rows, SCHEMA).withColumn("Size", F.lit("old")), 3).collect()
    assert sorted(r["size"] for r in got) == [16, 16, 16, 16, 10016]
    assert len({(r["shard"], r["slot"]) for r in got}) == 5
    assert shard_by_bytes(spark.createDataFrame([], SCHEMA), 3).collect() == []
