"""Ordered prefixes that stay parallel when one key (or no key at all) holds much of the data.

Every history feature of the library is one of four plans:

* ``strict_prefix``    sums and maxima over the rows of the same key that are strictly earlier;
* ``bucketed_prefix``  running totals over a *global* order, without a one-task window;
* ``asof_last_k``      the last k history items strictly before a probe;
* ``decayed_prefix``   exponentially decayed sums strictly before a probe.

A key whose history is larger than ``spark.ledgerlark.rowsPerTask`` is cut into time buckets. The
buckets are scanned independently and the totals of the earlier buckets are joined back, so the
result is exact and no task scans more than about one bucket. Rows of equal order value always
fall into the same bucket, because the bucket is a function of the order value alone.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.session import rows_per_task

MAX_COARSE = 64
MAX_FINE = 256
HASH_SLICES = 16_384
# Rows that one task sorts for a window, where the number of rows is known.
WINDOW_ROWS = 500_000
BUCKET = "__bucket"
_COARSE = "__coarse"


@dataclass(frozen=True)
class Cuts:
    """Monotone bucketing of a numeric column: quantile cuts, each divided into equal widths."""

    bounds: tuple[float, ...]
    fine: int = 1

    @property
    def buckets(self) -> int:
        return (len(self.bounds) - 1) * self.fine

    def add(self, df: DataFrame, column: str, name: str = BUCKET) -> DataFrame:
        inner = self.bounds[1:-1]

        def search(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(F.col(column) < F.lit(inner[middle]), search(low, middle)).otherwise(
                search(middle + 1, high)
            )

        coarse = search(0, len(inner))
        if self.fine == 1:
            return df.withColumn(name, coarse)
        lows = F.array(*[F.lit(float(b)) for b in self.bounds[:-1]])
        widths = F.array(*[F.lit(float(b - a)) for a, b in zip(self.bounds, self.bounds[1:])])
        low = F.element_at(lows, F.col(_COARSE) + 1)
        width = F.element_at(widths, F.col(_COARSE) + 1)
        step = F.when(
            width > 0, F.floor((F.col(column).cast("double") - low) / width * self.fine)
        ).otherwise(F.lit(0))
        inside = F.greatest(F.lit(0), F.least(F.lit(self.fine - 1), step))
        return (
            df.withColumn(_COARSE, coarse)
            .withColumn(name, (F.col(_COARSE) * self.fine + inside).cast("int"))
            .drop(_COARSE)
        )


def measure_cuts(df: DataFrame, column: str, per_task: int | None = None) -> Cuts:
    """One aggregate job: row count and approximate quantiles, kept as literals of the plan."""
    per_task = per_task or rows_per_task(df.sparkSession)
    shares = [i / MAX_COARSE for i in range(MAX_COARSE + 1)]
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx(column, shares, 2000).alias("q"),
    ).first()
    if not row["q"]:
        return Cuts((0.0, 1.0))
    wanted = max(8, -(-row["n"] // per_task))
    coarse = min(MAX_COARSE, wanted)
    fine = min(MAX_FINE, -(-wanted // coarse))
    picked = [row["q"][round(i * MAX_COARSE / coarse)] for i in range(coarse + 1)]
    bounds = sorted(set(picked))
    if len(bounds) == 1:
        bounds = [bounds[0], bounds[0] + 1]
    return Cuts(tuple(bounds), fine)


@dataclass(frozen=True)
class Layout:
    """Which keys are split by time, and where."""

    hot: DataFrame
    cuts: Cuts

    def add(self, df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
        """Bucket of a split key, -1 for every other key (one bucket per light key)."""
        marked = df.join(F.broadcast(self.hot), list(keys), "left")
        marked = self.cuts.add(marked, order)
        return marked.withColumn(
            BUCKET, F.when(F.col("__hot"), F.col(BUCKET)).otherwise(F.lit(-1))
        ).drop("__hot")


def plan_layout(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    per_task: int | None = None,
    at_most: int | None = None,
) -> Layout | None:
    """Find keys with more than ``per_task`` rows. At most n/per_task keys can qualify.

    One pass counts rows per slice of the hash range, which map-side sums keep small. Only a slice with more than
    ``per_task`` rows can hold such a key, so mostly that is all; else the keys of such slices are counted one by one.
    No pass is made when the caller knows that there are ``at_most`` so many rows.
    """
    per_task = per_task or rows_per_task(rows.sparkSession)
    if at_most is not None and at_most <= per_task:
        return None
    keyed = rows.select(*keys, order)
    slice_ = F.pmod(F.xxhash64(*keys), F.lit(HASH_SLICES))
    slices = keyed.groupBy(slice_.alias("__slice")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > per_task)
    full = slices.collect()  # at most HASH_SLICES
    if not full:
        return None
    total = sum(r["__n"] for r in full)
    hot = (
        keyed.filter(slice_.isin([r["__slice"] for r in full]))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") > per_task)
        .select(*keys, F.lit(True).alias("__hot"))
    )
    found = hot.limit(total // per_task + 1).collect()
    if not found:
        return None
    small = rows.sparkSession.createDataFrame(found, hot.schema)
    return Layout(small, measure_cuts(keyed, order, per_task))


def spread(rows: DataFrame, keys: Sequence[str], size: int | None) -> DataFrame:
    """Deal ``size`` rows by key over as many tasks as they need, so that the memory of a task doesn't grow with the table.

    Tables that the session's number of shuffle partitions holds anyway, and those of unknown size, are left alone.
    """
    wanted = -(-(size or 0) // WINDOW_ROWS)
    if wanted <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return rows
    return rows.repartition(wanted, *keys)


def dealt(rows: DataFrame, keys: Sequence[str], size: int | None) -> DataFrame:
    """The rows dealt by key, over as many tasks as ``size`` rows need: every window over these or more keys reads them as is."""
    many = spread(rows, keys, size)
    return rows.repartition(*keys) if many is rows else many


def strict_prefix(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    layout: Layout | None = None,
    sequence: Sequence[Column] | None = None,
    size: int | None = None,
) -> DataFrame:
    """Add per row the sums and maxima over rows of the same key that come strictly before it.

    ``order`` is an integer column. By default "before" means a smaller order value, so rows of
    one timestamp never see one another; probe rows carry NULL or zero values. With
    ``sequence`` the rows are taken one by one in the order ``(order, *sequence)``. ``size`` is the number of rows, or
    somewhat more, where the caller knows it.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    names = [*sums, *maxima]

    def totals() -> list[Column]:
        return [F.sum(c).alias(n) for n, c in sums.items()] + [
            F.max(c).alias(n) for n, c in maxima.items()
        ]

    partition = list(keys)
    carry = None
    if layout is not None:
        rows = layout.add(rows, keys, order)
        partition.append(BUCKET)
        per_bucket = rows.filter(F.col(BUCKET) >= 0).groupBy(*partition).agg(*totals())
        before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(
            Window.unboundedPreceding, -1
        )
        carry = per_bucket.select(
            *partition,
            *[F.sum(n).over(before).alias("__c_" + n) for n in sums],
            *[F.max(n).over(before).alias("__c_" + n) for n in maxima],
        )
        rows = spread(rows, partition, size).join(carry, partition, "left")
    else:
        rows = spread(rows, partition, size)

    window = Window.partitionBy(*partition)
    if sequence is None:
        window = window.orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    else:
        window = window.orderBy(F.col(order), *sequence).rowsBetween(
            Window.unboundedPreceding, -1
        )
    result = rows.withColumns(
        {n: F.sum(c).over(window) for n, c in sums.items()}
        | {n: F.max(c).over(window) for n, c in maxima.items()}
    )
    if carry is None:
        return result.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in sums})
    return result.withColumns(
        {
            n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col("__c_" + n), F.lit(0))
            for n in sums
        }
        | {n: F.greatest(F.col(n), F.col("__c_" + n)) for n in maxima}
    ).drop(BUCKET, *["__c_" + n for n in names])


def bucketed_prefix(
    df: DataFrame,
    order: Sequence[str],
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    descending: bool = False,
    cuts: Cuts | None = None,
) -> DataFrame:
    """Add running totals over the rows that come before each row in a global order.

    The first order column is numeric and is cut into buckets; the others break ties inside a
    bucket. Bucket totals number at most ``MAX_COARSE * MAX_FINE`` per ``by`` value.
    """
    order = list(order)
    by = list(by)
    cuts = cuts or measure_cuts(df, order[0])
    rows = cuts.add(df, order[0])
    if descending:
        rows = rows.withColumn(BUCKET, -F.col(BUCKET))
    totals = rows.groupBy(*by, BUCKET).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(BUCKET)
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*by, BUCKET, *[F.sum(n).over(earlier).alias("__c_" + n) for n in sums])
    if not by:
        carry = F.broadcast(carry)  # at most MAX_COARSE * MAX_FINE rows
    inside = (
        Window.partitionBy(*by, BUCKET)
        .orderBy(
            F.col(order[0]).desc() if descending else F.col(order[0]).asc(),
            *[F.col(c).asc() for c in order[1:]],
        )
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = rows.join(carry, [*by, BUCKET], "left")
    return (
        joined.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
        .withColumns(
            {
                n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col("__c_" + n), F.lit(0))
                for n in sums
            }
        )
        .drop(BUCKET, *["__c_" + n for n in sums])
    )


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row, as an uncorrelated scalar subquery."""
    packed = one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("s")).scalar()
    return df.withColumn("__scalars", packed).select("*", "__scalars.*").drop("__scalars")


def global_rank(
    df: DataFrame, order: Sequence[str], name: str = "rank", cuts: Cuts | None = None
) -> DataFrame:
    """Zero-based position of every row in a total order, without a one-task window."""
    return bucketed_prefix(df, order, {name: F.lit(1).cast("bigint")}, cuts=cuts)


def last_items(array: Column, k: int) -> Column:
    """The last k elements of an array column (all of them when it is shorter)."""
    return F.slice(array, F.greatest(F.size(array) - k + 1, F.lit(1)), F.lit(k))


def asof_last_k(
    history: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str,
    item: Column,
    k: int,
    name: str = "items",
    layout: Layout | None = None,
    size: int | None = None,
) -> DataFrame:
    """Add to every probe the last k history items strictly before it, oldest first.

    ``tie`` orders history rows of one timestamp. Each history row first receives the at most k
    items ending with it; a probe then takes the array of the latest earlier row. History and probes are dealt by key
    once, before there are arrays. ``size`` is the number of history rows and probes, where the caller knows it.
    """
    keys = list(keys)
    partition = [*keys, BUCKET] if layout is not None else keys
    past = history.select(*keys, order, tie, item.alias("__item"))
    asked = probes
    if layout is not None:
        past = layout.add(past, keys, order)
        asked = layout.add(asked, keys, order)
    box, unbox = boxed(probes, [*keys, order])
    marked = past.withColumns(
        {"__probe": F.lit(None).cast(row_type(probes.select(box.alias("b")).select("b.*"))), "__asks": F.lit(False)}
    )
    asked = asked.select(
        *partition,
        F.col(order),
        F.lit(None).cast(past.schema[tie].dataType).alias(tie),
        F.lit(None).cast(past.schema["__item"].dataType).alias("__item"),
        box.alias("__probe"),
        F.lit(True).alias("__asks"),
    )
    both = dealt(marked.unionByName(asked), partition, size)
    ending = Window.partitionBy(*partition, "__asks").orderBy(order, tie).rowsBetween(-(k - 1), 0)
    both = both.withColumn("__last", F.when(~F.col("__asks"), F.collect_list("__item").over(ending))).drop("__item")
    position = F.struct(F.col(order), F.col(tie))
    carried = None
    if layout is not None:
        per_bucket = (
            both.filter(~F.col("__asks") & (F.col(BUCKET) >= 0))
            .groupBy(*partition)
            .agg(F.max_by("__last", position).alias("__last"))
        )
        slots = Window.partitionBy(*keys).orderBy(BUCKET)
        upto = per_bucket.select(
            *partition,
            last_items(
                F.flatten(F.collect_list("__last").over(slots.rowsBetween(-(k - 1), 0))), k
            ).alias("__upto"),
        )
        # A probe may fall into a bucket without history of its own.
        asked_slots = asked.filter(F.col(BUCKET) >= 0).select(*partition).distinct()
        carried = (
            upto.join(asked_slots, partition, "full")
            .withColumn(
                "__carry",
                F.last("__upto", ignorenulls=True).over(
                    slots.rowsBetween(Window.unboundedPreceding, -1)
                ),
            )
            .drop("__upto")
        )
    strictly = Window.partitionBy(*partition).orderBy(order).rangeBetween(
        Window.unboundedPreceding, -1
    )
    found = both.withColumn(
        "__found",
        F.max_by("__last", F.when(~F.col("__asks"), position)).over(strictly),
    ).filter("__asks")
    empty = F.array().cast(both.schema["__last"].dataType)
    local = F.coalesce(F.col("__found"), empty)
    if carried is not None:
        found = found.join(carried, partition, "left")
        local = last_items(F.concat(F.coalesce(F.col("__carry"), empty), local), k)
    return found.select(*unbox, local.alias(name))


def boxed(probes: DataFrame, outside: Sequence[str]) -> tuple[Column, list[Column]]:
    """A probe as one struct without the columns that rows carry anyway, and the probe's columns taken from both again."""
    inner = [c for c in probes.columns if c not in outside]
    box = F.struct(*[F.col(c) for c in inner]) if inner else F.struct(F.lit(True).alias("__here"))
    types = {f.name: f.dataType for f in probes.schema.fields}
    # A union may have widened a key.
    unbox = [F.col("__probe")[c].alias(c) if c in inner else F.col(c).cast(types[c]).alias(c) for c in probes.columns]
    return box, unbox


def row_type(df: DataFrame):
    """Struct type of a frame's own columns, for typed NULLs."""
    return T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name != BUCKET]
    )


def decayed_prefix(
    history: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    time: str,
    weight: Column | Mapping[str, Column],
    decay: float,
    name: str = "decayed",
    width: float = 2.0,
    per_task: int | None = None,
) -> DataFrame:
    """Add to every probe the sum of ``weight * exp(-(t - when) / decay)`` over strictly earlier rows.

    ``time`` is an integer column in the unit of ``decay``. Rows are cut into time slots of ``width`` decays;
    inside a slot the sum is a plain prefix of ``exp((when - start) / decay)`` and the slots before it enter
    with their totals, back to where the factor is zero as a double. A slot of one key with more than
    ``per_task`` rows is cut by time like any other hot key. Several weights by name give as many sums in one pass.
    """
    weights = dict(weight) if isinstance(weight, Mapping) else {name: weight}
    keys, slot = list(keys), "__slot"
    span = float(decay) * width
    reach = math.ceil(746 / width)  # exp(-746) is 0.0
    number = F.floor(F.col(time) / F.lit(span)).cast("bigint")
    grown = F.exp((F.col(time) - F.col(slot) * F.lit(span)) / F.lit(float(decay)))
    past = history.withColumn(slot, number).select(
        *keys, slot, time, *[(w * grown).alias("__w_" + n) for n, w in weights.items()]
    )
    asked = probes.withColumn(slot, number)
    totals = past.groupBy(*keys, slot).agg(*[F.sum("__w_" + n).alias("__t_" + n) for n in weights])
    # Every slot that holds history or probes gets the decayed total of the slots before it.
    slots = totals.unionByName(asked.select(*keys, slot).distinct().withColumns({"__t_" + n: F.lit(0.0) for n in weights}))
    slots = slots.groupBy(*keys, slot).agg(*[F.sum("__t_" + n).alias("__t_" + n) for n in weights])
    near = Window.partitionBy(*keys).orderBy(slot).rangeBetween(-reach, -1)

    def faded(total: str):
        return lambda acc, x: acc + x[total] * F.exp((x["b"] - F.col(slot)) * F.lit(float(width)))

    slots = slots.withColumn(
        "__near", F.collect_list(F.struct(F.col(slot).alias("b"), *["__t_" + n for n in weights])).over(near)
    ).select(
        *keys,
        slot,
        *[F.aggregate("__near", F.lit(0.0), faded("__t_" + n)).alias("__carry_" + n) for n in weights],
    )
    box, unbox = boxed(probes, [*keys, time])
    kind = row_type(probes.select(box.alias("b")).select("b.*"))
    both = past.withColumn("__probe", F.lit(None).cast(kind)).unionByName(
        asked.select(
            *keys,
            slot,
            time,
            *[F.lit(None).cast("double").alias("__w_" + n) for n in weights],
            box.alias("__probe"),
        )
    )
    layout = plan_layout(both, [*keys, slot], time, per_task)
    summed = strict_prefix(both, [*keys, slot], time, {"__sum_" + n: F.col("__w_" + n) for n in weights}, layout=layout)
    found = summed.filter(F.col("__probe").isNotNull()).join(slots, [*keys, slot], "left")
    shrink = F.exp(-(F.col(time) - F.col(slot) * F.lit(span)) / F.lit(float(decay)))
    sums = [((F.col("__sum_" + n) + F.coalesce(F.col("__carry_" + n), F.lit(0.0))) * shrink).alias(n) for n in weights]
    return found.select(*unbox, *sums)
