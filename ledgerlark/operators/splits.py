"""Chronological splits, cutoffs, prefixes and bounded samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.plans.prefix import bucketed_prefix, global_rank, measure_cuts, with_scalars

FOUR_PARTS = ["train", "model_validation", "policy_validation", "test"]


def chronological_order(events: DataFrame) -> DataFrame:
    """Stable order (time, arrival), range-partitioned; the result keeps the partitioning."""
    return events.orderBy("event_us", "seq")


def times_at(df: DataFrame, shares: Sequence[float], time: str = "event_us") -> tuple[int, list[int]]:
    """Number of distinct times and the distinct times at positions floor(n * share)."""
    distinct = df.select(time).distinct()
    total = distinct.agg(F.count(F.lit(1)).alias("__n"))
    ranked = global_rank(distinct, [time], "__rank", measure_cuts(df, time))
    wanted = F.array(*[F.floor(F.col("__n") * F.lit(float(s))) for s in shares])
    found = (
        with_scalars(ranked, total)
        .filter(F.array_contains(wanted, F.col("__rank")))
        .collect()  # at most one row per share
    )
    if not found:
        return 0, []
    n = found[0]["__n"]
    by_rank = {r["__rank"]: r[time] for r in found}
    return n, [by_rank.get(math.floor(n * s)) for s in shares]


def chronological_split(
    df: DataFrame, train: float = 0.6, validation: float = 0.2, time: str = "event_us"
) -> DataFrame:
    """Add ``partition``: train, validation or test by shares of the distinct timestamps."""
    if not (0 < train < 1 and 0 < validation < 1 and train + validation < 1):
        raise ValueError("train and validation shares must be positive and leave a test partition")
    n, cuts = times_at(df, [train, train + validation], time)
    first, second = math.floor(n * train), math.floor(n * (train + validation))
    if first < 1 or second <= first or second >= n:
        raise ValueError("not enough distinct timestamps for three nonempty partitions")
    return df.withColumn(
        "partition",
        F.when(F.col(time) < cuts[0], "train").when(F.col(time) < cuts[1], "validation").otherwise("test"),
    )


def four_way_split(
    df: DataFrame,
    fractions: Sequence[float] = (0.6, 0.15, 0.1),
    boundaries: Sequence[int] | None = None,
    time: str = "event_us",
) -> DataFrame:
    """Add ``partition`` out of four; a time equal to a boundary opens the next partition."""
    if boundaries is None:
        if len(fractions) != 3 or min(fractions) <= 0 or sum(fractions) >= 1:
            raise ValueError("three positive shares must leave a test period")
        running, total = [], 0.0
        for fraction in fractions:
            total += fraction
            running.append(total)
        n, cuts = times_at(df, running, time)
        places = [math.floor(n * s) for s in running]
        if not n or places[0] < 1 or places[-1] >= n or len(set(places)) != 3:
            raise ValueError("not enough distinct timestamps for four nonempty partitions")
        boundaries = cuts
    elif len(boundaries) != 3 or list(boundaries) != sorted(set(boundaries)):
        raise ValueError("boundaries must be three increasing times")
    part = F.lit(FOUR_PARTS[3])
    for name, bound in reversed(list(zip(FOUR_PARTS, boundaries))):
        part = F.when(F.col(time) < bound, name).otherwise(part)
    return df.withColumn("partition", part)


def label_cutoffs(
    parts: DataFrame, order: Sequence[str] = FOUR_PARTS, configured: dict | None = None, time: str = "event_us"
) -> DataFrame:
    """Per partition the largest time before the next partition starts, or a configured earlier one."""
    spark = parts.sparkSession
    configured = configured or {}
    follow = spark.createDataFrame(
        [(a, b, configured.get(a)) for a, b in zip(order, order[1:])],
        "partition string, following string, chosen bigint",
    )
    starts = parts.groupBy(F.col("partition").alias("following")).agg(
        (F.min(time) - 1).alias("limit_us")
    )
    limits = follow.join(starts, "following")
    wrong = limits.filter(F.col("chosen") > F.col("limit_us"))
    if configured and wrong.limit(1).collect():
        raise ValueError("a label cutoff must precede the next partition")
    return limits.select("partition", F.coalesce("chosen", "limit_us").alias("cutoff_us"))


def calibration_prefix(df: DataFrame, rows: int, time: str = "event_us") -> DataFrame:
    """The first complete timestamp groups that together hold at least ``rows`` rows."""
    if rows < 1:
        raise ValueError("rows must be positive")
    groups = df.groupBy(time).agg(F.count(F.lit(1)).alias("__n"))
    before = bucketed_prefix(groups, [time], {"__before": F.col("__n")}, cuts=measure_cuts(df, time))
    last = before.filter(F.col("__before") < rows).agg(F.max(time).alias("__last"))
    return with_scalars(df, last).filter(F.col(time) <= F.col("__last")).drop("__last")


def preview_rows(df: DataFrame, rows: int = 20) -> DataFrame:
    """The first rows in chronological order; at most 100 may be asked for."""
    if not 1 <= rows <= 100:
        raise ValueError("between 1 and 100 rows can be previewed")
    return df.orderBy("event_us", "seq").limit(rows)


def stratified_context(
    df: DataFrame, limit: int, seed: int = 42, id_column: str = "event_id", label: str = "label"
) -> DataFrame:
    """Class-proportional sample without replacement, at least one row per class.

    The draw is the hash order of the ids, so it does not depend on partitioning.
    """
    known = df.filter(F.col(label).isin(0, 1))
    counts = known.agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")
    ).first()
    positives, negatives = counts["p"], counts["n"]
    if positives + negatives <= limit:
        return known
    share = math.floor(limit * positives / (positives + negatives) + 0.5)
    wanted = max(1, limit - negatives, min(share, positives, limit - 1))
    drawn = F.xxhash64(F.lit(seed), F.col(id_column))
    fraud = known.filter(F.col(label) == 1).orderBy(drawn, id_column).limit(wanted)
    rest = known.filter(F.col(label) == 0).orderBy(drawn, id_column).limit(limit - wanted)
    return fraud.unionByName(rest)


def inner_pretrain_split(parts: DataFrame, share: float = 0.8, time: str = "event_us") -> DataFrame:
    """Training rows divided at ``share`` of their distinct timestamps: ``inner`` is fit or check."""
    rows = parts.filter(F.col("partition") == "train")
    n, cuts = times_at(rows, [share], time)
    if not 0 < math.floor(n * share) < n:
        raise ValueError("at least two training timestamps are required")
    return rows.withColumn("inner", F.when(F.col(time) < cuts[0], "fit").otherwise("check"))


def nearest_rank_quantile(df: DataFrame, column: str, q: float, name: str = "quantile") -> DataFrame:
    """sorted[ceil(q * n) - 1], found from value counts and their prefix."""
    groups = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    before = bucketed_prefix(groups, [column], {"__before": F.col("__n")}, cuts=measure_cuts(df, column))
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    place = F.least(
        F.col("__total") - 1, F.greatest(F.lit(0), F.ceil(F.lit(float(q)) * F.col("__total")) - 1)
    )
    hit = (F.col("__before") <= place) & (place < F.col("__before") + F.col("__n"))
    return with_scalars(before, total).filter(hit).select(F.col(column).alias(name))


def episode_split(df: DataFrame, episodes: int, column: str = "episode", share: float = 0.8) -> DataFrame:
    """The first share of the episodes trains, the rest is held out (at least one trains)."""
    first = max(1, math.floor(episodes * share))
    return df.withColumn(
        "partition", F.when(F.col(column) < first, "train").otherwise("held_out")
    )


def replay_partition(split_us: int, time: Column | str = "event_us") -> Column:
    column = F.col(time) if isinstance(time, str) else time
    return F.when(column < split_us, "prefix").otherwise("evaluation")
