"""Mixing against a plain sort and prefix sum."""

import random

from pyspark.sql import functions as F

from ledgerlark.llm.mixing import mix

SCHEMA = "doc_id long, text string, source string, w double, target string"
OUT = ["size", "source_size", "target", "copies", "taken"]


def targets_of(sizes, total_share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), total_share * sum(sizes.values())
    while open_:  # share by weight, stop at the cap, share the excess again
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check(got):
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken == r.copies * r.size <= 2 * r.size
    target = targets_of(sizes)
    longest = max(r.size for r in got)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-4
    for s in sizes:
        assert abs(taken[s] - target[s]) <= longest / 2 + 1


def test_targets_epochs_and_hot_source(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "c", None] + ["hot"] * 4), rng.choice([0.5, 1.0, 2.0, None, 0.0]), "old") for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mix(df, weight=F.col("w"), rows_per_task=500).collect()
    check(got)
    again = mix(df.repartition(7), weight=F.col("w"), rows_per_task=10**6).collect()
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in again}


def test_heavier_documents_come_first(spark):
    rows = [(i, "one two three", "z" if i % 2 else "y", 8.0 if i % 4 < 2 else 1.0, "") for i in range(4000)]
    got = [r for r in mix(spark.createDataFrame(rows, SCHEMA), shares=(1, 3), total_share=1.0, weight=F.col("w")).collect() if r.source == "y"]
    assert 0 < got[0].target < got[0].source_size
    heavy = sum(r.copies for r in got if r.w == 8.0)
    assert heavy > 2 * sum(r.copies for r in got if r.w == 1.0)


def test_odd_inputs(spark):
    df = spark.createDataFrame([(None, None, None, None, "t"), (1, "", "s", 1.0, "t"), (1, "a b", "s", 1.0, "t"), (1, "a b", "s", 1.0, "t")], SCHEMA)
    got = mix(df).collect()
    assert len(got) == 4 and [r.taken for r in got if r.source is None] == [0]
    check(got)
    assert mix(df.limit(0)).collect() == []
    assert mix(df).columns[-5:] == OUT
