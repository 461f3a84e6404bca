"""Global orders built on the bucketed prefix: dense ids by first appearance, running maxima."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.plans.prefix import BUCKET, Cuts, bucketed_prefix, measure_cuts


def first_seen_index(
    events: DataFrame, keys: Sequence[Column], order: Sequence[str], name: str = "index"
) -> DataFrame:
    """Dense ids of keys by first appearance; within a row the keys count in the given order.

    The first order column is numeric and should be close to unique (an arrival sequence).
    """
    seen = events.select(
        *order, F.posexplode(F.array(*keys)).alias("__pos", "key")
    ).filter(F.col("key").isNotNull())
    first = seen.groupBy("key").agg(
        F.min(F.struct(*order, "__pos")).alias("__first")
    )
    flat = first.select("key", *[F.col("__first")[c].alias(c) for c in [*order, "__pos"]])
    ranked = bucketed_prefix(
        flat, [*order, "__pos"], {name: F.lit(1).cast("bigint")}, cuts=measure_cuts(events, order[0])
    )
    return ranked.select("key", name)


def running_max(
    df: DataFrame, order: Sequence[str], value: str, name: str, cuts: Cuts | None = None
) -> DataFrame:
    """Largest value among the rows before each row in a global order."""
    cuts = cuts or measure_cuts(df, order[0])
    rows = cuts.add(df, order[0])
    totals = rows.groupBy(BUCKET).agg(F.max(value).alias("__m"))
    earlier = Window.partitionBy(F.lit(0)).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(BUCKET, F.max("__m").over(earlier).alias("__carry"))
    inside = (
        Window.partitionBy(BUCKET)
        .orderBy(*[F.col(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # At most MAX_COARSE * MAX_FINE carry rows.
    return (
        rows.join(F.broadcast(carry), BUCKET, "left")
        .withColumn(name, F.greatest(F.max(value).over(inside), F.col("__carry")))
        .drop(BUCKET, "__carry")
    )


def previous_value(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    cuts: Cuts | None = None,
) -> DataFrame:
    """Value of the row just before each row, per ``by`` group in a total order.

    Groups are cut into buckets of the first order column, so a group may hold most of the rows.
    """
    cuts = cuts or measure_cuts(df, order[0])
    rows = cuts.add(df, order[0])
    position = F.struct(*[F.col(c) for c in order])
    boxed = F.struct(F.col(value).alias("v"))
    last = rows.groupBy(*by, BUCKET).agg(F.max_by(boxed, position).alias("__last"))
    slots = Window.partitionBy(*(by or [F.lit(0)])).orderBy(BUCKET)
    carry = last.select(*by, BUCKET, F.lag("__last").over(slots).alias("__carry"))
    inside = Window.partitionBy(*by, BUCKET).orderBy(*[F.col(c) for c in order])
    return (
        rows.withColumn("__here", F.lag(boxed).over(inside))
        .join(carry, [*by, BUCKET], "left")
        .withColumn(name, F.coalesce(F.col("__here"), F.col("__carry"))["v"])
        .drop(BUCKET, "__here", "__carry")
    )
