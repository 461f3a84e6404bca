"""Sharding by histogram sort: shards of near-equal bytes in one global key order.

Splitters between shards are found without sorting or sampling: each round counts the exact bytes
below candidate boundaries in every partition, adds the counts up, and puts new candidates only into
the cells that still hold a wanted splitter. When every splitter is within tolerance, the rows are
exchanged once.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import stash, without

_KEY, _TIE, _SIZE = "__key", "__tie", "__size"
_CENSUS = "cell int, bytes long, low string, high string"
#: A signed long as an unsigned one of the same order.
_FLIP = 1 << 63


def text_bytes(text: Column) -> Column:
    """Bytes a document occupies: its UTF-8 text and 16 bytes of framing."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 40,
    text: str = "text",
    tie: str = "doc_id",
    tolerance: float = 0.001,
    probes: int = 64,
) -> DataFrame:
    """Put every row into one of ``shards`` shards of near-equal bytes; adds ``size``, ``shard`` and
    ``slot`` (gapless from 0 in each shard).

    The order is (hash of the text, tie), so equal texts lie side by side, and a group of copies that is
    larger than a shard is cut by its tie column. A boundary is accepted within ``tolerance`` of a
    shard's even share, or, where single rows are larger than that, at the nearest row. Rows equal in
    text and tie are one key: they stay in one shard, in any order. A null text has size 16 and a null
    tie sorts first. An empty table returns no rows. Driver memory: shards x probes counters per round.
    """
    docs = without(docs, "size", "shard", "slot")
    kind = dict(docs.dtypes)[tie]
    rank = F.col(tie).cast("long") if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(tie)
    keyed = docs.withColumns({
        _KEY: F.xxhash64(text),
        _TIE: F.coalesce(rank, F.lit(-(1 << 63))),
        _SIZE: text_bytes(F.col(text)),
    })
    narrow = stash(keyed.select(_KEY, _TIE, _SIZE), "shard-keys")
    cuts = find_splitters(narrow, shards, tolerance, probes)
    return (
        keyed.withColumn("shard", _shard_of(cuts))
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions(_KEY, _TIE)
        # Partition and shard are the same thing here, so the position in the partition is the slot.
        .withColumn("slot", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        .withColumnRenamed(_SIZE, "size")
        .drop(_KEY, _TIE)
    )


def find_splitters(narrow: DataFrame, shards: int, tolerance: float, probes: int) -> list[int]:
    """Keys (128-bit integers) at which shards 1, 2, ... begin."""
    cells = _census(narrow, [])
    if not cells:
        return []
    total, low, high = cells[0]
    share = total / shards
    below: dict[int, int] = {low: 0, high + 1: total}
    bounds = [low, high + 1]
    span = {low: (low, high)}  # smallest and largest key seen in the cell that begins here
    while True:
        wanted: dict[int, int] = {}
        for k in range(1, shards):
            left, right = _bracket(below, bounds, k * share)
            near = min(abs(below[left] - k * share), abs(below[right] - k * share))
            first, last = span[left]
            if near > tolerance * share and first < last:
                wanted[left] = wanted.get(left, 0) + 1
        if not wanted:
            break
        asked = set()
        for left, count in wanted.items():
            first, last = span[left]
            steps = min(count * probes, last - first)
            asked.update(first + -(-(last - first) * j // steps) for j in range(1, steps + 1))
        asked = sorted(asked | set(bounds))
        running = 0
        census = _census(narrow, asked)
        for i, probe in enumerate(asked):  # cell i lies below probe i, cell i + 1 from it on
            running += census.get(i, (0,))[0]
            if probe not in below:
                below[probe] = running
                insort(bounds, probe)
            if i + 1 in census:
                span[probe] = census[i + 1][1:]
            else:
                span[probe] = (probe, probe)
    cuts = []
    for k in range(1, shards):
        left, right = _bracket(below, bounds, k * share)
        cuts.append(left if k * share - below[left] <= below[right] - k * share else right)
    return cuts


def _bracket(below: dict[int, int], bounds: list[int], target: float) -> tuple[int, int]:
    at = bisect_right(bounds, target, key=below.__getitem__)
    return bounds[max(at - 1, 0)], bounds[min(at, len(bounds) - 1)]


def _census(narrow: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int]]:
    """Bytes, smallest and largest key of every non-empty cell between neighbouring probes."""
    edges = np.array([p.to_bytes(16, "big") for p in probes if p < 1 << 128], dtype="S16")

    def count(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            both = np.empty((batch.num_rows, 2), dtype=">u8")
            for i in (0, 1):
                both[:, i] = batch.column(i).to_numpy().view(np.uint64) ^ np.uint64(_FLIP)
            keys = both.view("S16").ravel()
            order = np.argsort(keys)
            keys, sizes = keys[order], batch.column(2).to_numpy()[order]
            cell = np.searchsorted(edges, keys, side="right")
            start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            stop = np.r_[start[1:], len(cell)] - 1
            name = [[k.ljust(16, b"\0").hex() for k in keys[at].tolist()] for at in (start, stop)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell[start].astype(np.int32)), pa.array(np.add.reduceat(sizes, start)), *map(pa.array, name)],
                names=["cell", "bytes", "low", "high"],
            )

    found = (
        narrow.select(_KEY, _TIE, _SIZE)
        .mapInArrow(count, _CENSUS)
        .groupBy("cell")
        .agg(F.sum("bytes"), F.min("low"), F.max("high"))
    )
    return {r[0]: (r[1], int(r[2], 16), int(r[3], 16)) for r in found.collect()}


def _shard_of(cuts: list[int]) -> Column:
    """Number of splitters at or below the row's key, as a balanced tree of comparisons."""

    def at_least(cut: int) -> Column:
        key, tie = (cut >> 64) - _FLIP, (cut & ((1 << 64) - 1)) - _FLIP
        return (F.col(_KEY) > key) | ((F.col(_KEY) == key) & (F.col(_TIE) >= tie))

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        if cuts[middle] >= 1 << 128:  # beyond every key
            return search(low, middle)
        return F.when(at_least(cuts[middle]), search(middle + 1, high)).otherwise(search(low, middle))

    return search(0, len(cuts)).cast("int")
