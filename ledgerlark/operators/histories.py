"""Vectors and surprise scores from the last few items and decayed histograms of an account."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.scalars import AMOUNT_EDGES, GAP_EDGES, amount_bin, bin_of, gap_bin
from ledgerlark.operators.joins import last_neighbors
from ledgerlark.plans.ordering import previous_value
from ledgerlark.plans.prefix import (
    asof_last_k,
    decayed_prefix,
    global_rank,
    last_items,
    plan_layout,
    strict_prefix,
    with_scalars,
)
from ledgerlark.session import written

# Decay times in minutes, list lengths, histogram smoothing.
HISTORY_DECAY = 720.0
PAIR_DECAY = 1440.0
HISTORY_LIMIT = 8
PAIR_LIMIT = 6
NEIGHBOR_LIMIT = 4
SMOOTHING = 0.5
MINUTE_US = 60e6


def _age(now: Column, item: Column) -> Column:
    return F.greatest(F.lit(0.0), (now - item["event_us"]) / MINUTE_US)


def _wave(age: Column) -> list[Column]:
    return [F.sin(age / 60.0), F.cos(age / 60.0)]


def account_basis(age: Column, item: Column) -> list[Column]:
    return [
        F.lit(1.0),
        item["role"].cast("double"),
        F.log1p(item["amount"]) / 8.0,
        F.least(age / 720.0, F.lit(4.0)),
        *_wave(age),
        F.sin(age / 1440.0),
        F.cos(age / 1440.0),
    ]


def pair_basis(age: Column, item: Column) -> list[Column]:
    return [F.lit(1.0), F.log1p(item["amount"]) / 8.0, F.least(age / 720.0, F.lit(4.0)), *_wave(age)]


def add_decayed_vector(
    df: DataFrame, items: str, decay: float, basis, weights: Sequence[Sequence[float]], name: str
) -> DataFrame:
    """tanh of the decay-weighted mean of projected basis terms; zeros without items.

    The projection is linear, so the basis is averaged first and projected once. The sums are a
    column of their own, so that they are computed once per row.
    """
    terms = len(weights[0])
    now = F.col("event_us")
    start = F.array(*[F.lit(0.0)] * (terms + 1))

    def add(total: Column, item: Column) -> Column:
        age = _age(now, item)
        weight = F.exp(-age / F.lit(float(decay)))
        values = F.array(*[weight * b for b in basis(age, item)], weight)
        return F.zip_with(total, values, lambda x, y: x + y)

    summed = df.withColumn("__sums", F.aggregate(items, start, add))
    total = F.element_at("__sums", terms + 1)
    rows = [
        sum((F.element_at("__sums", j + 1) * F.lit(float(w)) for j, w in enumerate(row)), F.lit(0.0))
        for row in weights
    ]
    vector = F.array(*[F.when(total > 0, F.tanh(r / total)).otherwise(0.0) for r in rows])
    return summed.withColumn(name, vector).drop("__sums")


def account_history_vector(
    payments: DataFrame, probes: DataFrame, weights: Sequence[Sequence[float]], name: str = "vector"
) -> DataFrame:
    """Vector of the last 8 incidents of each probe ``(account, event_us, ...)``."""
    found = last_neighbors(payments, probes, HISTORY_LIMIT, "__items", ["event_us", "amount", "role"])
    return add_decayed_vector(found, "__items", HISTORY_DECAY, account_basis, weights, name).drop("__items")


def last_pair_payments(payments: DataFrame, probes: DataFrame, k: int = PAIR_LIMIT, name: str = "items") -> DataFrame:
    """Last k payments of each directed pair strictly before a probe ``(source, destination, event_us)``."""
    rows = payments.filter(
        (F.col("kind") == "payment") & F.col("source").isNotNull() & F.col("destination").isNotNull()
    )
    keys = ["source", "destination"]
    item = F.struct("event_us", "amount")
    layout = plan_layout(rows, keys, "event_us")
    return asof_last_k(rows, probes, keys, "event_us", "seq", item, k, name, layout)


def pair_history_vector(
    payments: DataFrame, probes: DataFrame, weights: Sequence[Sequence[float]], name: str = "vector"
) -> DataFrame:
    found = last_pair_payments(payments, probes, PAIR_LIMIT, "__items")
    return add_decayed_vector(found, "__items", PAIR_DECAY, pair_basis, weights, name).drop("__items")


def _newest_distinct(items: Column) -> Column:
    """Items newest first, one per counterparty."""
    newest = F.reverse(items)
    return F.filter(
        newest,
        lambda x, i: F.array_position(F.transform(newest, lambda y: y["other"]), x["other"]) == i + 1,
    )


def recent_distinct_neighbors(payments: DataFrame, probes: DataFrame, name: str = "neighbors") -> DataFrame:
    """Distinct counterparties among the last 4 incidents, newest first."""
    found = last_neighbors(payments, probes, NEIGHBOR_LIMIT, "__items", ["other"])
    return found.withColumn(name, F.transform(_newest_distinct(F.col("__items")), lambda x: x["other"])).drop(
        "__items"
    )


def neighborhood_vector(
    payments: DataFrame,
    probes: DataFrame,
    weights: Sequence[Sequence[float]],
    mix: Sequence[Sequence[float]],
    depth: int = 2,
    name: str = "vector",
) -> DataFrame:
    """Own history vector mixed with those of recent neighbours, ``depth`` hops out, all at the probe time.

    Every level is one as-of lookup over the distinct (account, time) probes that it needs: the last items of a vector
    hold those of the neighbours.
    """
    dim = len(weights)
    # Every level is read again on the way back, so each is written once.
    needed = written(probes.select("account", "event_us").distinct())
    levels = []
    for hop in range(depth + 1):
        leaf = hop == depth
        fields = ["event_us", "amount", "role"] if leaf else ["other", "event_us", "amount", "role"]
        found = last_neighbors(payments, needed, HISTORY_LIMIT, "__items", fields)
        near = [] if leaf else [_newest_distinct(last_items(F.col("__items"), NEIGHBOR_LIMIT)).alias("__near")]
        based = add_decayed_vector(found, "__items", HISTORY_DECAY, account_basis, weights, "__v")
        level = written(based.select("account", "event_us", "__v", *near))
        levels.append(level)
        if not leaf:
            asked = level.select(F.explode("__near.other").alias("account"), "event_us")
            needed = written(asked.distinct())
    vectors = levels.pop()
    for level in reversed(levels):
        base = level.select("account", "event_us", F.col("__v").alias("__base"))
        hop = level.select("account", "event_us", F.explode("__near").alias("n"))
        children = hop.withColumn("__child", F.col("n.other")).join(
            vectors.withColumnRenamed("account", "__child").hint("merge"), ["__child", "event_us"]
        )
        age = _age(F.col("event_us"), F.col("n"))
        edge = F.array(
            F.col("n.role").cast("double"),
            F.log1p(F.col("n.amount")) / 8.0,
            F.least(age / 720.0, F.lit(4.0)),
            F.lit(1.0),
        )
        children = children.withColumn("__full", F.concat(F.col("__v"), edge))
        weight = F.exp(-age / F.lit(HISTORY_DECAY))
        projected = [
            F.tanh(sum((F.element_at("__full", j + 1) * F.lit(float(w)) for j, w in enumerate(row)), F.lit(0.0)))
            for row in mix
        ]
        mixed = children.groupBy("account", "event_us").agg(
            F.sum(weight).alias("__total"),
            *[F.sum(weight * p).alias(f"__m{i}") for i, p in enumerate(projected)],
        )
        joined = base.join(mixed.hint("merge"), ["account", "event_us"], "left")
        out = [
            F.when(
                F.col("__total") > 0,
                F.tanh(F.element_at("__base", i + 1) + F.col(f"__m{i}") / F.col("__total")),
            ).otherwise(F.element_at("__base", i + 1))
            for i in range(dim)
        ]
        vectors = written(joined.select("account", "event_us", F.array(*out).alias("__v")))
    return probes.join(vectors.withColumnRenamed("__v", name).hint("merge"), ["account", "event_us"])


# --- Surprise of an amount or a gap -------------------------------------------------------------


def _bits(total: Column, own: Column, bins: int) -> Column:
    """-log2 of the smoothed share of the own bin."""
    return -F.log2((own + SMOOTHING) / (total + SMOOTHING * bins))


@dataclass(frozen=True)
class Bins:
    """One kind of bins: their number, a payment's own bin, the bin that it adds to its sender's history where ``adds``
    holds, and the bins (event_us, bin) of earlier payments of the pair."""

    number: int
    own: Column
    past: Column
    adds: Column
    of_pair: Callable[[Column], Column]


def _surprise(payments: DataFrame, paid: DataFrame, kinds: Mapping[str, Bins], pair_weight: float) -> DataFrame:
    """Decayed histogram of the sender plus the weighted one of the pair, at each payment: (event_id, <kind>_bits).

    All kinds share a decayed prefix of the sender's totals and a lookup of the pair's last payments; a prefix of the sender's
    own bin serves each. Payments with their bins are written once, narrow, as every prefix reads them several times.
    """
    binned = [
        column.alias(f"{part}_{kind}")
        for kind, bins in kinds.items()
        for part, column in (("own", bins.own), ("past", bins.past), ("adds", bins.adds))
    ]
    rows = written(paid.select("event_id", "event_us", "seq", "kind", "source", "destination", "amount", *binned))
    origin = written(payments.agg(F.min("event_us").alias("origin")))  # one row

    def minutes(df: DataFrame) -> DataFrame:
        return with_scalars(df, origin).withColumn("event_us", F.col("event_us") - F.col("origin")).drop("origin")

    decay = HISTORY_DECAY * MINUTE_US
    past = minutes(rows.select("source", "event_us", *[f"adds_{kind}" for kind in kinds]))
    weights = {f"all_{kind}": F.when(F.col(f"adds_{kind}"), 1.0).otherwise(0.0) for kind in kinds}
    folded = decayed_prefix(
        past, minutes(rows.select("event_id", "source", "event_us")), ["source"], "event_us", weights, decay
    ).select("event_id", *weights)
    for kind in kinds:
        added = minutes(rows.filter(f"adds_{kind}").select("source", F.col(f"past_{kind}").alias("bin"), "event_us"))
        asked = minutes(rows.select("event_id", "source", F.col(f"own_{kind}").alias("bin"), "event_us"))
        own = decayed_prefix(added, asked, ["source", "bin"], "event_us", F.lit(1.0), decay, f"mine_{kind}")
        folded = folded.join(own.select("event_id", f"mine_{kind}"), "event_id")
    asked = rows.select("event_id", "source", "destination", "event_us", *[f"own_{kind}" for kind in kinds])
    pairs = last_pair_payments(rows, asked, PAIR_LIMIT, "items")

    def weigh(entries: Column, condition) -> Column:
        return F.aggregate(
            entries,
            F.lit(0.0),
            lambda acc, x: acc
            + F.when(
                condition(x),
                F.lit(pair_weight)
                * F.exp(-F.greatest(F.lit(0.0), (F.col("event_us") - x["event_us"]) / MINUTE_US) / PAIR_DECAY),
            ).otherwise(0.0),
        )

    def own_bin(kind: str):
        return lambda x: x["bin"] == F.col(f"own_{kind}")

    weighed = pairs.select(
        "event_id",
        *[
            weigh(bins.of_pair(F.col("items")), condition).alias(f"pair_{part}_{kind}")
            for kind, bins in kinds.items()
            for part, condition in (("all", lambda x: F.lit(True)), ("mine", own_bin(kind)))
        ],
    )
    return weighed.join(folded, "event_id").select(
        "event_id",
        *[
            _bits(
                F.col(f"all_{kind}") + F.col(f"pair_all_{kind}"), F.col(f"mine_{kind}") + F.col(f"pair_mine_{kind}"), bins.number
            ).alias(f"{kind}_bits")
            for kind, bins in kinds.items()
        ],
    )


def _paid() -> Column:
    return (F.col("kind") == "payment") & F.col("source").isNotNull() & F.col("destination").isNotNull()


def _amount_bins() -> Bins:
    own = amount_bin(F.col("amount"))

    def of_pair(items: Column) -> Column:
        return F.transform(
            items, lambda x: F.struct(x["event_us"].alias("event_us"), amount_bin(x["amount"]).alias("bin"))
        )

    return Bins(len(AMOUNT_EDGES) + 1, own, own, F.lit(True), of_pair)


def _gap_bins() -> Bins:
    """Bins over the columns of ``_with_gaps``."""

    def of_pair(items: Column) -> Column:
        # Gaps between consecutive items of the pair, dated by the later one.
        later = F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))
        return F.transform(
            later,
            lambda x, i: F.struct(
                x["event_us"].alias("event_us"),
                bin_of(
                    (x["event_us"] - F.element_at(items, i + 1)["event_us"]) / MINUTE_US, GAP_EDGES
                ).alias("bin"),
            ),
        )

    idle = F.greatest(F.lit(0.0), (F.col("event_us") - F.col("last_us")) / MINUTE_US)
    own = gap_bin(F.when(F.col("seen") > 0, idle).otherwise(0.0), F.col("seen"))
    past = bin_of((F.col("event_us") - F.col("previous")) / MINUTE_US, GAP_EDGES)
    return Bins(len(GAP_EDGES) + 2, own, past, F.col("previous").isNotNull(), of_pair)


def _with_gaps(payments: DataFrame) -> DataFrame:
    """Payments between accounts with the time of the sender's ``previous`` payment (input order within ties) and, over
    payments and deposits of any role strictly before, how often it was ``seen`` and at ``last_us`` last."""
    columns = ["event_id", "event_us", "seq", "kind", "source", "destination", "amount"]
    sent = previous_value(payments.filter(_paid()).select(columns), ["source"], ["event_us", "seq"], "event_us", "previous")
    carried = ["event_id", "seq", "kind", "destination", "amount", "previous"]
    self_paid = F.coalesce(F.col("source") == F.col("destination"), F.lit(False))
    touches = F.col("kind").isin("payment", "deposit")

    def ends(rows: DataFrame, payload: Column) -> DataFrame:
        sender = F.struct(F.col("source").alias("account"), payload.alias("paid"), F.lit(1).alias("touch"))
        received = F.when(self_paid, 0).otherwise(1)
        recipient = F.struct(F.col("destination").alias("account"), F.lit(None).alias("paid"), received.alias("touch"))
        return rows.select("event_us", F.explode(F.array(sender, recipient)).alias("x")).select("event_us", "x.*").filter(
            "account is not null"
        )

    others = payments.filter(touches & ~F.coalesce(_paid(), F.lit(False))).select(columns)
    size = 2 * payments.count()
    layout = plan_layout(ends(payments.filter(touches), F.lit(None)), ["account"], "event_us", None, size)
    rows = ends(sent, F.struct(*carried))
    kind = rows.schema["paid"].dataType
    rows = rows.unionByName(ends(others, F.lit(None).cast(kind)))
    touched = {"seen": F.col("touch")}
    last = {"last_us": F.when(F.col("touch") == 1, F.col("event_us"))}
    found = strict_prefix(rows, ["account"], "event_us", touched, last, layout, size=size).filter("paid is not null")
    return found.select("event_us", F.col("account").alias("source"), "paid.*", "seen", "last_us")


def amount_surprise_bits(payments: DataFrame, pair_weight: float = 1.0) -> DataFrame:
    """Bits of surprise of each amount bin under the sender's decayed history."""
    found = _surprise(payments, payments.filter(_paid()), {"amount": _amount_bins()}, pair_weight)
    return found.select("event_id", F.col("amount_bits").alias("bits"))


def gap_surprise_bits(payments: DataFrame, pair_weight: float = 1.0) -> DataFrame:
    """Bits of surprise of the time since the sender's last activity under its earlier gaps.

    History gaps are those between consecutive payments of the sender (input order within ties).
    """
    found = _surprise(payments, _with_gaps(payments), {"gap": _gap_bins()}, pair_weight)
    return found.select("event_id", F.col("gap_bits").alias("bits"))


def surprise_bits(payments: DataFrame) -> DataFrame:
    """Amount and gap surprise per payment, and their sum, over one set of prefixes."""
    found = _surprise(payments, _with_gaps(payments), {"amount": _amount_bins(), "gap": _gap_bins()}, 1.0)
    return found.withColumn("bits", F.col("amount_bits") + F.col("gap_bits"))


def retained_history(events: DataFrame, limit: int, split_us: int | None = None, growing: bool = True) -> DataFrame:
    """Which earlier events each event sees when only the last ``limit`` are retained.

    Positions are global (time, arrival); an event sees positions in [first, stop), the events of
    strictly smaller time. The interval describes the history without materialising it.
    """
    ranked = global_rank(events, ["event_us", "seq"], "position")
    starts = ranked.groupBy("event_us").agg(F.min("position").alias("stop"))
    joined = ranked.join(starts, "event_us")
    if not growing:
        frozen = ranked.agg(F.count_if(F.col("event_us") < F.lit(split_us)).alias("__frozen"))
        joined = with_scalars(joined, frozen)
        joined = joined.withColumn("stop", F.least("stop", "__frozen")).drop("__frozen")
    return joined.withColumn("first", F.greatest(F.lit(0), F.col("stop") - limit))


def projection(rows: int, columns: int, seed: int = 512) -> list[list[float]]:
    """Deterministic projection weights with unit-scale rows."""
    return [
        [math.sin(seed + 12.9898 * (i * columns + j)) / math.sqrt(columns) for j in range(columns)]
        for i in range(rows)
    ]
