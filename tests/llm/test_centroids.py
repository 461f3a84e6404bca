"""Centroid clustering against plain Lloyd rounds on Python integers, and odd inputs."""

import hashlib
import math
import random

import pytest

from ledgerlark.llm import centroids
from ledgerlark.llm.common import table
from ledgerlark.llm.queries import op12_heap_centroids


def plain_clusters(rows, k=16, rounds=3, scale=64, size=64, seed=1):
    kept = [
        (key, [math.floor(scale * float(x)) for x in v]) for key, v in rows
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and math.isfinite(scale * x) for x in v)
    ]
    name = lambda key: hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        own = assigned()
        for i in range(len(centres)):
            members = [v for (_, v), (_, j) in zip(kept, own) if i == j]
            if members:
                centres[i] = [sum(x) // len(members) for x in zip(*members)]
    own = assigned()
    total = lambda ds: s if (s := sum(ds)) < 1 << 63 and max(ds) < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [
        (key, i, d if d < 1 << 63 else None, total([e for e, j in own if i == j]), total([e for e, _ in own]), digest[i])
        for (key, _), (d, i) in zip(kept, own)
    ]


def rows_of(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_over_all_embeddings(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    got = rows_of(op12_heap_centroids(spark, sf_dir))
    assert got == sorted(plain_clusters(rows), key=repr) and len({r[1] for r in got}) > 1


@pytest.mark.parametrize("spread", [1.0, 1e4, 1e20, 1e36])
def test_ties_repeats_and_odd_vectors(spark, spread):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, -0.25, 0.0, 0.5, 1.0]) * spread for _ in range(3)]) for i in range(300)]
    rows += rows[:20] + [(None, [0.0, 0.0, 0.0])] * 3 + [(1000 + i, [0.25 * spread, 0.0, 0.0]) for i in range(100)]
    rows += [(-1, None), (-2, []), (-3, [1.0, 2.0]), (-4, [1.0, None, 1.0]), (-5, [1.0, math.nan, 1.0]), (-6, [math.inf, 1.0, 1.0])]
    df = spark.createDataFrame([(a, b, "c") for a, b in rows], "vec_id long, embedding array<float>, cluster string")
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    for k, rounds in [(5, 6), (1, 2), (40, 3)]:
        got = rows_of(centroids.cluster_report(df, k=k, rounds=rounds, size=3))
        assert got == sorted(plain_clusters(exact, k, rounds, size=3), key=repr)


def test_few_vectors_and_empty_table(spark):
    kind = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(7, [1.0, 2.0]), (8, [1.0, 2.0])], kind)
    assert rows_of(centroids.cluster_report(df, size=2)) == sorted(plain_clusters([(7, [1.0, 2.0]), (8, [1.0, 2.0])], size=2), key=repr)
    assert centroids.cluster_report(spark.createDataFrame([], kind)).collect() == []


def test_heaps_pop_only_what_the_drift_reached():
    import numpy as np

    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.integers(-60, 60, (400, 64)) + 1000 * i for i in range(4)])
    old = [[1000 * i] * 64 for i in range(4)]
    new = [[1000 * i + 1] * 64 for i in range(4)]
    clusters, expiry = centroids.nearest(rows, old)
    drift = centroids.add_drift([0.0] * 4, old, new)
    out = centroids.expired(clusters, expiry, drift)
    assert len(out) == 0  # far clusters: nothing is rescanned
    far = centroids.add_drift(drift, new, [[1000 * i + 700] * 64 for i in range(4)])
    out = set(centroids.expired(clusters, expiry, far).tolist())
    moved = np.flatnonzero(centroids.nearest(rows, [[1000 * i + 700] * 64 for i in range(4)])[0] != clusters)
    assert set(moved.tolist()) <= out
