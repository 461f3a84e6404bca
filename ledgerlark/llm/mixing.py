"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key with its quality weight as rate; a source's documents in key order
are a weighted sample without replacement. Word budgets are met by complete epochs of the source first; the
rest goes to the documents at the front of the order, found by prefix sums. A source is cut into
key ranges, so one that holds most rows is not one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import small, stash, without, words

OUTPUTS = ("size", "source_size", "target", "copies", "taken")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts: 52 bits, the same in every run and partitioning."""
    digits = F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 52)


def source_targets(
    sizes: DataFrame, source: str, shares: Sequence[float], total_share: float, most_epochs: float
) -> DataFrame:
    """(source, source_size, target): shares repeat over the sources by code point, null last.

    Targets share ``total_share`` of all sizes by weight, none above ``most_epochs`` times its source; what
    is cut there goes to the others by weight. In order of size to weight a source is capped while the level of
    those after it still exceeds its own. One row per source; the window over them is the only one
    without partitions.
    """
    order = Window.orderBy(F.col(source).isNull(), F.col(source))
    weights = F.array(*[F.lit(float(s)) for s in shares])
    weighed = sizes.withColumn("__rank", F.row_number().over(order) - 1).withColumn(
        "__w", F.get(weights, F.pmod("__rank", F.lit(len(shares))).cast("int"))
    )
    ratio = F.col("source_size") / F.col("__w")
    ranked = weighed.withColumn("__by", F.row_number().over(Window.orderBy(ratio, "__rank")))
    before = Window.orderBy("__by").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("__by").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy("__by").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most_epochs
    levels = ranked.withColumn(
        "__level", (F.sum("source_size").over(whole) * total_share - capped) / F.sum("__w").over(rest)
    )
    # The common level of the sources that are not capped; null where all are.
    open_ = F.when(F.col("__level") < ratio * most_epochs, F.struct("__by", "__level"))
    levels = levels.withColumn("__final", F.min(open_).over(whole)["__level"])
    limit = F.col("source_size") * float(most_epochs)
    target = F.when(F.col("__final").isNull(), limit).otherwise(F.least(limit, F.col("__final") * F.col("__w")))
    return levels.select(source, "source_size", F.round(target, 6).alias("target"))


def plan_mix(
    docs: DataFrame,
    shares: Sequence[float] = (3, 1, 2),
    total_share: float = 1.5,
    most_epochs: float = 2,
    source: str = "source",
    text: str = "text",
    key: str = "doc_id",
    weight: Column | None = None,
    weights: DataFrame | None = None,
    seed: int = 7,
    rows_per_task: int = 1_000_000,
) -> DataFrame:
    """One narrow row per document: key, source, ``tie`` (text hash), ``size`` (words), ``source_size``,
    ``target``, ``copies`` and ``taken`` (words taken, copies x size).

    copies = the complete epochs that fit the target, plus 1 for the documents at the front of the key order
    whose middle word lies below the rest of the target. So a source misses its target by half a document
    at most, and no document exceeds ``most_epochs`` times its size. The weight is a column of the documents or
    comes from ``weights`` (key, weight; one row per key); without one it is 1, values below 1e-9 are 1e-9. Null
    and empty texts have size 0. A null source is a source. Ties of draws go by key, then text hash; rows equal
    in both are interchangeable. An empty table returns no rows. Texts are read once and not shuffled.
    """
    rate = weight if weight is not None else F.lit(1.0)
    narrow = docs.select(
        F.col(key), F.col(source), F.size(words(F.col(text))).cast("long").alias("size"),
        F.xxhash64(text).alias("tie"), rate.cast("double").alias("__rate"),
    )
    if weights is not None:
        known = weights.select(F.col(key).alias("__k"), F.col("weight").cast("double").alias("__given"))
        narrow = narrow.join(known, F.col(key) == F.col("__k"), "left").withColumn(
            "__rate", F.coalesce("__given", "__rate")
        ).drop("__k", "__given")
    rate = F.greatest(F.coalesce("__rate", F.lit(1.0)), F.lit(1e-9))
    draw = -F.log(uniform(F.lit(seed), F.col(key))) / rate
    sized = stash(narrow.withColumn("__draw", draw).drop("__rate"), "mix-rows")
    # Positive doubles sort like their exponents and mantissas; the leading bits name a range of draws. How many
    # bits depends on the rows, so that a range of even the largest source has a fraction of rows_per_task.
    cells = max(32, 1 << max(0, math.ceil(math.log2(max(1, 8 * sized.count() / rows_per_task)))))
    octave = F.floor(F.log2("__draw"))
    cell = octave * cells + F.floor((F.col("__draw") / F.pow(F.lit(2.0), octave) - 1) * cells)
    sized = sized.withColumn("__cell", cell.cast("long"))
    totals = stash(sized.groupBy(source, "__cell").agg(F.sum("size").alias("cell_size")), "mix-cells")
    sizes = totals.groupBy(source).agg(F.sum("cell_size").alias("source_size"))
    targets = source_targets(sizes, source, shares, total_share, most_epochs)
    earlier = Window.partitionBy(source).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("__start", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)))
    t = targets.withColumnRenamed(source, "__tsource")
    starts = starts.join(t, F.col(source).eqNullSafe(F.col("__tsource"))).select(
        F.col(source).alias("__source"), F.col("__cell").alias("__at"), "__start", "source_size", "target"
    )
    starts = stash(starts, "mix-starts")
    inside = (
        Window.partitionBy(source, "__cell").orderBy("__draw", key, "tie").rowsBetween(Window.unboundedPreceding, -1)
    )
    same = F.col(source).eqNullSafe(F.col("__source")) & (F.col("__cell") == F.col("__at"))
    placed = sized.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        small(starts, starts.count()), same
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    left = F.col("target") - epochs * F.col("source_size")
    front = F.col("__start") + F.col("__inside") + F.col("size") / 2.0 < left
    return placed.withColumn("copies", (epochs + front.cast("int")).cast("long")).select(
        key, source, "tie", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The documents with the columns OUTPUTS of ``plan_mix``; see there.

    The plan is joined back on key and text hash, which moves each text once. Repeated rows are numbered on both
    sides, so each gets the plan of one of them.
    """
    docs = without(docs, *OUTPUTS)
    plan = stash(plan_mix(docs, text=text, key=key, **options), "mix-plan")
    number = F.row_number().over(Window.partitionBy("__key", "__tie").orderBy(F.desc("copies")))
    plan = plan.select(F.col(key).alias("__key"), F.col("tie").alias("__tie"), *OUTPUTS).withColumn("__n", number)
    mine = F.row_number().over(Window.partitionBy(key, "__hash").orderBy(F.lit(0)))
    rows = docs.withColumn("__hash", F.xxhash64(text)).withColumn("__m", mine)
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__hash") == F.col("__tie")) & (F.col("__m") == F.col("__n"))
    return rows.join(plan, same).drop("__key", "__tie", "__n", "__hash", "__m")


def label_weights(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, weight): 2 for labelled quality, 0.5 for labelled junk; repeated labels count as the worst of them."""
    worst = labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(key).agg(F.min("quality").alias("q"))
    return worst.select(key, F.when(F.col("q") >= 1, 2.0).otherwise(0.5).alias("weight"))
