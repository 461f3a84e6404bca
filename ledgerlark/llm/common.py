"""Small helpers of the corpus operators.

Conventions of every operator in this package: an input column with the name of one of the operator's
own output columns is replaced by it (names compare without case); helper columns start with ``__``
and are dropped; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.session import discard, scratch_dir  # noqa: F401  (operators take both from here)

#: White space between words: the blank and the six ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a narrow table (a few dozen bytes each) that may be broadcast after they were counted.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write the frame once to the shared scratch folder and read it from there.

    Lost executors cost only a reread; the plan behind the frame runs once.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.stashed = path
    return written


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most so many rows an Arrow batch for jobs inside: whole texts in Python workers need bounded memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: A map of used keys has a fixed size of 2^26 bits, however many keys there are.
MAP_BITS = 26


def key_map(keys: DataFrame, key: str) -> np.ndarray:
    """Bit map over the top bits of 64-bit keys, as words of 64 bits: a filter that never misses a key."""
    top = keys.select(F.shiftrightunsigned(key, 64 - MAP_BITS).alias("top"))
    bits = top.selectExpr("int(shiftright(top, 6)) as at", "shiftleft(1L, int(top & 63)) as bit")
    out = np.zeros(1 << (MAP_BITS - 6), dtype=np.uint64)
    rows = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def in_map(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Mask of the 64-bit keys that the map may hold."""
    top = keys.view(np.uint64) >> np.uint64(64 - MAP_BITS)
    return (words[top >> np.uint64(6)] >> (top & np.uint64(63))) & np.uint64(1) == 1


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint where the counted rows are within the limit; else Spark plans a shuffle join."""
    return F.broadcast(df) if rows <= limit else df


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns that the operator is about to produce."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
