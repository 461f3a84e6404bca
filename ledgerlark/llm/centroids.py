"""Exact centroid clustering of integer vectors with heap-ordered bounds.

A vector remembers its gap: the distance to the second nearest centroid less that to its own. A round that moves the
own centroid by d and the others by at most e shrinks the gap by at most d + e; these drifts add up per
cluster. The gap plus the cluster's drift at that time is the vector's expiry. A block of vectors keeps one
heap of expiries per cluster; only what the drift has reached is popped and compared with all centroids again.
Sums of clusters change by the vectors that moved, so nothing else is added up. All decisions are made on
exact integers; bounds are floats with a margin.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import stash

#: Within this magnitude squared distances of up to 64 components fit 64-bit integers; beyond, Python's integers take over.
FITS = 1 << 27
#: Relative allowance for rounding in bounds.
MARGIN = 1e-9
_LIMB = 40  # sums cross the shuffle in limbs of so many bits, whose sums fit a decimal
_SUM = pa.struct([("cluster", pa.int32()), ("component", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])


def usable(vector: Column, scale: int, size: int) -> Column:
    """Whether a vector has ``size`` components, none null or non-finite (also after scaling)."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double") * float(scale)) < float("inf")))
    return F.coalesce((F.size(vector) == size) & fine, F.lit(False))


def whole(rows: np.ndarray) -> np.ndarray:
    """Integral floats as exact integers: 64-bit within FITS, else Python's."""
    if np.abs(rows).max(initial=0) <= FITS:
        return rows.astype(np.int64)
    return np.array([[int(x) for x in row] for row in rows.tolist()], dtype=object).reshape(rows.shape)


def squared(rows: np.ndarray, centre: list[int]) -> np.ndarray:
    """Exact squared distances of the rows to one centroid."""
    if rows.dtype == object or max(map(abs, centre), default=0) > FITS or rows.shape[1] > 64:
        d = rows.astype(object) - np.array(centre, dtype=object)
        return (d * d).sum(axis=1) if len(rows) else np.empty(0, dtype=object)
    d = rows - np.array(centre, dtype=np.int64)
    return np.einsum("ij,ij->i", d, d)


def nearest(rows: np.ndarray, centres: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smallest), and the gap to the second nearest, rounded down."""
    best, low = np.zeros(len(rows), dtype=np.int64), squared(rows, centres[0])
    second = np.full(len(rows), np.inf)
    for number, centre in enumerate(centres[1:], 1):
        d = squared(rows, centre)
        nearer = d < low
        second = np.minimum(second, np.where(nearer, low, d).astype(np.float64))
        best, low = np.where(nearer, number, best), np.where(nearer, d, low)
    a, b = np.sqrt(low.astype(np.float64)), np.sqrt(second)
    return best, np.where(np.isinf(b), np.inf, b - a - MARGIN * (a + np.where(np.isinf(b), 0, b) + 1))


def expired(clusters: np.ndarray, expiry: np.ndarray, drift: list[float]) -> np.ndarray:
    """Rows of a block whose gap is used up: every cluster's heap is popped as far as its drift reaches."""
    heaps: dict[int, list[tuple[float, int]]] = defaultdict(list)
    for at, (c, e) in enumerate(zip(clusters.tolist(), expiry.tolist())):
        heaps[c].append((e, at))
    out: list[int] = []
    for c, heap in heaps.items():
        heapq.heapify(heap)
        while heap and heap[0][0] <= drift[c]:
            out.append(heapq.heappop(heap)[1])
    return np.array(sorted(out), dtype=np.int64)


def add_drift(drift: list[float], old: list[list[int]], new: list[list[int]]) -> list[float]:
    """Drift of every cluster after its centroids moved: its own way plus the longest way of another one."""
    ways = [math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))) for x, y in zip(old, new)]
    other = [max((w for j, w in enumerate(ways) if j != i), default=0.0) for i in range(len(ways))]
    return [(d + w + o) * (1 + MARGIN) for d, w, o in zip(drift, ways, other)]


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    sign, total, at = (-1 if total < 0 else 1), abs(total), 0
    while total:
        if part := total & ((1 << _LIMB) - 1):
            yield at, sign * part
        total, at = total >> _LIMB, at + 1


def _floats(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


class _Moves:
    """Counts and sums that clusters gain and lose in one task."""

    def __init__(self, size: int) -> None:
        self.size, self.sums = size, defaultdict(int)

    def add(self, rows: np.ndarray, clusters: np.ndarray, sign: int) -> None:
        for c in np.unique(clusters).tolist():
            own = rows[clusters == c]
            self.sums[c, -1] += sign * len(own)  # component -1 counts
            for i, v in enumerate(own.sum(axis=0).tolist()):
                self.sums[c, i] += sign * v

    def rows(self) -> list[dict]:
        return [
            {"cluster": c, "component": i, "limb": at, "value": v}
            for (c, i), total in self.sums.items() for at, v in _limbs(total)
        ]


def _first_pass(kept: DataFrame, centres: list[list[int]], scale: int, size: int, key: str) -> DataFrame:
    """State of all vectors: key, integers, cluster, expiry; one row a task with what clusters gain (``moves``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves, kind = _Moves(size), None
        for batch in batches:
            kind = batch.schema.field(0).type
            floats = np.floor(_floats(batch.column(1), size) * float(scale))
            rows = whole(floats)
            best, gap = nearest(rows, centres)
            moves.add(rows, best, 1)
            yield _state(batch.column(0), floats, best, gap)
        if kind is not None:
            yield _tail(kind, moves)

    return kept.mapInArrow(run, _schema(kept, key))


def _next_pass(state: DataFrame, centres: list[list[int]], drift: list[float], size: int, key: str) -> DataFrame:
    """The state after popping and rescanning what expired, with what clusters gain and lose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves, kind = _Moves(size), None
        for batch in batches:
            kind = batch.schema.field(0).type
            floats = _floats(batch.column(1), size)
            clusters = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            expiry = batch.column(3).to_numpy(zero_copy_only=False).copy()
            at = expired(clusters, expiry, drift)
            if len(at):
                rows = whole(floats[at])
                best, gap = nearest(rows, centres)
                moved = best != clusters[at]
                moves.add(rows[moved], clusters[at][moved], -1)
                moves.add(rows[moved], best[moved], 1)
                clusters = clusters.copy()
                clusters[at] = best
                expiry[at] = gap + np.array(drift)[best]
            yield _state(batch.column(0), floats, clusters, expiry)
        if kind is not None:
            yield _tail(kind, moves)

    return state.filter("moves is null").select(key, "whole", "cluster", "expiry").mapInArrow(run, _schema(state, key))


def _schema(df: DataFrame, key: str) -> str:
    kind = df.schema[key].dataType.simpleString()
    return f"`{key}` {kind}, whole array<double>, cluster int, expiry double, moves array<struct<cluster:int,component:int,limb:int,value:bigint>>"


def _state(keys: pa.Array, floats: np.ndarray, clusters: np.ndarray, expiry: np.ndarray) -> pa.RecordBatch:
    n, size = floats.shape
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(floats.ravel()))
    columns = [keys, vectors, pa.array(clusters, pa.int32()), pa.array(expiry, pa.float64()), pa.nulls(n, pa.list_(_SUM))]
    return pa.RecordBatch.from_arrays(columns, names=["k", "whole", "cluster", "expiry", "moves"])


def _tail(kind: pa.DataType, moves: _Moves) -> pa.RecordBatch:
    columns = [
        pa.nulls(1, kind), pa.nulls(1, pa.list_(pa.float64())), pa.nulls(1, pa.int32()), pa.nulls(1, pa.float64()),
        pa.array([moves.rows()], pa.list_(_SUM)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["k", "whole", "cluster", "expiry", "moves"])


def _totals(state: DataFrame) -> dict[tuple[int, int], int]:
    """What the clusters gained, summed over the tasks: at most clusters x (components + 1) numbers."""
    parts = state.filter("moves is not null").select(F.inline("moves"))
    out: dict[tuple[int, int], int] = defaultdict(int)
    for r in parts.groupBy("cluster", "component", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("v")).collect():
        out[r.cluster, r.component] += int(r.v) << (_LIMB * r.limb)
    return out


def first_centres(kept: DataFrame, vector: str, key: str, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of ``seed:key`` (null key: ``null``; ties by the components), in that order."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    rows = kept.select(F.sha2(name, 256).alias("h"), F.col(vector).alias("v")).orderBy("h", "v").limit(k).collect()
    return [[int(math.floor(float(x) * scale)) for x in r.v] for r in rows]


def cluster(
    df: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = 16, rounds: int = 3, scale: int = 64, size: int = 64, seed: int = 1
) -> tuple[DataFrame, list[list[int]]]:
    """(key, ``cluster``, ``distance``) of every usable vector after the rounds, and the final centroids.

    Vectors that are null, have another size, or a null or non-finite component (before or after scaling) are left
    out. Repeated rows each count. Fewer vectors than k give as many centroids as there are vectors; an empty table none
    and no rows. ``distance`` is squared and exact, null beyond 64 bits. Every round writes one state table; it holds
    each vector once. Other columns are not returned.
    """
    kept = df.filter(usable(F.col(vector), scale, size)).select(key, vector)
    centres = first_centres(kept, vector, key, k, seed, scale)
    if not centres:
        return df.limit(0).select(key, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    state = stash(_first_pass(kept, centres, scale, size, key), "centroid-state")
    sums, drift = _totals(state), [0.0] * len(centres)
    for _ in range(rounds):
        new = [
            [sums[c, i] // n for i in range(size)] if (n := sums[c, -1]) else old for c, old in enumerate(centres)
        ]
        drift, centres = add_drift(drift, centres, new), new
        state = stash(_next_pass(state, centres, drift, size, key), "centroid-state")
        for at, v in _totals(state).items():
            sums[at] += v

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = whole(_floats(batch.column(1), size))
            own = batch.column(2).to_numpy(zero_copy_only=False)
            distance = np.empty(len(rows), dtype=object)
            for c in np.unique(own).tolist():
                distance[own == c] = squared(rows[own == c], centres[c])
            values = pa.array([int(d) if d < 1 << 63 else None for d in distance.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), values], names=["k", "cluster", "distance"])

    found = state.filter("moves is null").select(key, "whole", "cluster")
    kind = df.schema[key].dataType.simpleString()
    return found.mapInArrow(measure, f"`{key}` {kind}, cluster int, distance bigint"), centres


def centroid_digest(centre: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()


def cluster_report(df: DataFrame, vector: str = "embedding", key: str = "vec_id", **options) -> DataFrame:
    """``cluster`` with ``cluster_inertia`` and ``inertia`` (summed distances of the cluster and of all; null beyond 64 bits
    or if a distance is) and the ``centroid_sha256`` of the decimal components joined by commas."""
    found, centres = cluster(df, vector, key, **options)
    found = stash(found, "clusters")
    total = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    own = found.groupBy("cluster").agg(total.alias("own")).collect()  # a row per centroid
    fits = lambda v: int(v) if v is not None and v < 1 << 63 else None
    parts = {r.cluster: r.own for r in own}
    everything = None if any(v is None for v in parts.values()) else sum(parts.values())
    rows = [(c, fits(parts.get(c)), fits(everything), centroid_digest(x)) for c, x in enumerate(centres)]
    facts = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
