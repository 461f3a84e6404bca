"""History features over a bounded number of retained events.

Only the last N events of the whole stream (of any kind and any account) are remembered. A payment therefore sees the
global positions [first, stop): stop counts the events of strictly smaller time, first is stop - N or 0.
Every count and sum is the difference of two prefixes of the account, probed at the positions stop and first; the
hour before is a third probe at the first position within the hour. No window is materialised, so a task's
work doesn't depend on N, and hot accounts are split by position as all prefixes are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators.features import MONEY, PAYMENT_FEATURES, REGISTRY, SIDES, WINDOW_US
from ledgerlark.plans.prefix import bucketed_prefix, global_rank, measure_cuts, plan_layout, strict_prefix, with_scalars
from ledgerlark.session import written

_SUMS = ("out_count", "in_count", "out_value", "in_value", "seen")


def retained_positions(events: DataFrame, limit: int, freeze_us: int | None = None) -> DataFrame:
    """The events with their global ``position`` and the probes ``stop``, ``first`` and ``hour``.

    The positions [first, stop) are remembered, [hour, stop) of them lie within the last hour. With ``freeze_us``
    no later event is remembered, and the hour ends there at the latest. Events of equal time take positions by ``seq``.
    """
    if limit < 1:
        raise ValueError("the number of retained events must be positive")
    ranked = global_rank(events, ["event_us", "seq"], "position")
    asked = F.col("event_us") if freeze_us is None else F.least("event_us", F.lit(freeze_us))
    times = ranked.groupBy("event_us").agg(F.min("position").alias("stop"), F.count(F.lit(1)).alias("n")).withColumn("asked", asked)
    # A time asks how many events lie before its hour; at equal times the question comes first.
    ask = F.struct((F.col("asked") - WINDOW_US).alias("at"), F.lit(0).alias("adds"), F.lit(0).cast("bigint").alias("n"), F.col("event_us").alias("of"))
    add = F.struct(F.col("event_us").alias("at"), F.lit(1).alias("adds"), F.col("n"), F.lit(None).cast("bigint").alias("of"))
    line = times.select(F.inline(F.array(ask, add)))
    hours = bucketed_prefix(line, ["at", "adds"], {"hour": F.col("n")}, cuts=measure_cuts(line, "at")).filter("adds = 0")
    clock = times.join(hours.select(F.col("of").alias("event_us"), "hour"), "event_us").drop("n", "asked")
    if freeze_us is not None:
        frozen = events.agg(F.count_if(F.col("event_us") < F.lit(freeze_us)).alias("__frozen"))
        clock = with_scalars(clock, frozen).withColumn("stop", F.least("stop", "__frozen")).drop("__frozen")
    first = F.greatest(F.lit(0).cast("bigint"), F.col("stop") - limit)
    clock = clock.withColumn("first", first).withColumn("hour", F.greatest("first", F.least("hour", "stop")))
    return ranked.join(clock, "event_us")


def _pairs(rows: DataFrame, per_task: int | None, size: int) -> DataFrame:
    """(event_id, raw_pair_out_count, raw_pair_total_count) of the payments between two accounts."""
    paid = rows.filter((F.col("kind") == "payment") & F.col("source").isNotNull() & F.col("destination").isNotNull())
    forward = F.col("source") <= F.col("destination")
    keyed = paid.select(
        "event_id", "seq", forward.alias("fwd"), (F.col("source") == F.col("destination")).alias("self"),
        F.least("source", "destination").alias("lo"), F.greatest("source", "destination").alias("hi"),
        F.explode(F.array(*[
            F.struct(F.lit(role).alias("role"), F.col(at).alias("at")) for role, at in ((-1, "position"), (0, "stop"), (1, "first"))
        ])).alias("r"),
    ).select("*", "r.*").drop("r")
    adds = F.col("role") == -1
    sums = {"same": F.when(adds & F.col("fwd"), 1).otherwise(0), "back": F.when(adds & ~F.col("fwd"), 1).otherwise(0)}
    layout = plan_layout(keyed, ["lo", "hi"], "at", per_task, 3 * size)
    scanned = strict_prefix(keyed, ["lo", "hi"], "at", sums, layout=layout, size=3 * size).filter("role >= 0")
    sign = F.when(F.col("role") == 0, 1).otherwise(-1)
    own = F.when(F.col("fwd"), F.col("same")).otherwise(F.col("back"))
    total = F.when(F.col("self"), 2 * F.col("same")).otherwise(F.col("same") + F.col("back"))
    return scanned.groupBy("event_id", "seq").agg(
        F.sum(sign * own).alias("raw_pair_out_count"), F.sum(sign * total).alias("raw_pair_total_count")
    )


def _accounts(rows: DataFrame, per_task: int | None, size: int) -> DataFrame:
    """(event_id, raw_sender_*, raw_recipient_*) of all payments."""
    paid = (F.col("kind") == "payment") & F.col("source").isNotNull() & F.col("destination").isNotNull()
    touches = F.col("kind").isin("payment", "deposit")
    self_paid = F.coalesce(F.col("source") == F.col("destination"), F.lit(False))

    def row(role: int, account: str, at: str) -> Column:
        """Role -1 adds; 3 i + j asks for side i at probe j."""
        sender = account == "source"
        flag = lambda c: F.when(c, 1).otherwise(0) if role < 0 else F.lit(0)
        return F.struct(
            F.lit(role).alias("role"), F.col(account).alias("account"), F.col(at).alias("at"),
            flag(paid & F.lit(sender)).alias("out"), flag(paid & F.lit(not sender)).alias("inn"),
            flag(touches & (F.lit(True) if sender else ~self_paid)).alias("touch"),
        )

    sides = ("source", "destination")
    parts = [row(-1, a, "position") for a in sides]
    parts += [row(3 * i + j, a, at) for i, a in enumerate(sides) for j, at in enumerate(("stop", "first", "hour"))]
    exploded = rows.select(
        "event_id", "seq", "event_us", F.col("kind").alias("__kind"), F.col("amount").cast(MONEY).alias("value"), F.explode(F.array(*parts)).alias("r")
    ).select("*", "r.*").drop("r").filter(F.col("account").isNotNull() & ((F.col("role") < 0) | (F.col("__kind") == "payment")))
    value = F.col("value")
    sums = {
        "out_count": F.col("out"), "in_count": F.col("inn"), "out_value": F.when(F.col("out") == 1, value),
        "in_value": F.when(F.col("inn") == 1, value), "seen": F.col("touch"),
    }
    latest = {"last_us": F.when(F.col("touch") == 1, F.col("event_us"))}
    layout = plan_layout(exploded, ["account"], "at", per_task, 8 * size)
    scanned = strict_prefix(exploded, ["account"], "at", sums, latest, layout, size=8 * size).filter("role >= 0")

    def pick(role: int, name: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col(name)))

    aggregates = []
    for i, side in enumerate(SIDES):
        for name in _SUMS:
            aggregates.append((pick(3 * i, name) - pick(3 * i + 1, name)).alias(f"raw_{side}_{name}"))
            if name != "seen":
                aggregates.append((pick(3 * i, name) - pick(3 * i + 2, name)).alias(f"raw_{side}_recent_{name}"))
        # The last touch before stop is remembered exactly if any touch is.
        aggregates.append(pick(3 * i, "last_us").alias(f"raw_{side}_last_us"))
    return scanned.groupBy("event_id", "seq").agg(*aggregates)


def retained_features(
    payments: DataFrame,
    limit: int,
    names: Sequence[str] | None = None,
    freeze_us: int | None = None,
    keep: Sequence[str] = (),
    per_task: int | None = None,
) -> DataFrame:
    """Chosen features (all 27 by default) of every payment from the last ``limit`` events before its time.

    A limit of at least the stream's length gives the same values as ``payment_features``. Payments without one of the
    two accounts have zero history on that side. ``freeze_us``: later events are never remembered.
    """
    names = list(names or PAYMENT_FEATURES)
    recipes = [REGISTRY[n] for n in names]
    needs = {need for r in recipes for need in r.needs}
    columns = ["event_id", "event_us", "seq", "kind", "source", "destination", "amount"]
    # Ranks, clocks, cuts and the three uses of the placed rows would each repeat the plan behind them.
    payments = written(payments.select(*columns, *keep))
    rows, size = written(retained_positions(payments, limit, freeze_us)), payments.count()
    base = rows.filter(F.col("kind") == "payment").drop("position", "stop", "first", "hour")
    zeros: dict[str, Column] = {}
    if "pair" in needs:
        base = base.join(_pairs(rows, per_task, size), ["event_id", "seq"], "left")
        zeros |= {c: F.coalesce(F.col(c), F.lit(0)) for c in ("raw_pair_out_count", "raw_pair_total_count")}
    if needs & {"account", "recent"}:
        base = base.join(_accounts(rows, per_task, size), ["event_id", "seq"], "left")
        for side in SIDES:
            counts = [*_SUMS, *[f"recent_{n}" for n in _SUMS if n != "seen"]]
            zeros |= {c: F.coalesce(F.col(c), F.lit(0)) for c in (f"raw_{side}_{n}" for n in counts)}
            gap = F.greatest(F.lit(0.0), (F.col("event_us") - F.col(f"raw_{side}_last_us")) / 60e6)
            zeros[f"raw_{side}_gap"] = F.when(F.col(f"raw_{side}_seen") > 0, gap).otherwise(0.0)
    return base.withColumns(zeros).select("event_id", "event_us", "seq", *keep, *[r.build().alias(r.id) for r in recipes])
