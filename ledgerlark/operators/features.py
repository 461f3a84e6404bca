"""The 27 payment-history features and their registry.

One plan serves every recipe: a window over the unordered pair, then the payments exploded into
account rows and one window over the account, then one aggregation back to the payment. The
60-minute figures are differences of two prefixes, at t and at t minus one hour, because a
sliding frame would rescan the hour of a busy account for each of its payments.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.scalars import AMOUNT_EDGES, amount_bin, scaled_log1p
from ledgerlark.plans.prefix import Layout, plan_layout, strict_prefix

RECIPE_VERSION = "1"
WINDOW_US = 3_600_000_000
MONEY = "decimal(28,6)"

# Raw columns that a recipe may read besides the payment's own columns.
ACCOUNT_RAW = ["out_count", "in_count", "out_value", "in_value", "seen", "gap"]
RECENT_RAW = ["recent_in_count", "recent_out_count", "recent_in_value", "recent_out_value"]
SIDES = ["sender", "recipient"]
PAIR_RAW = ["pair_out_count", "pair_total_count"]


@dataclass(frozen=True)
class Recipe:
    """A feature: its id, what the source must offer, and a Column over the raw columns."""

    id: str
    requires: tuple[str, ...]
    build: Callable[[], Column]
    version: str = RECIPE_VERSION
    needs: tuple[str, ...] = ()


REGISTRY: dict[str, Recipe] = {}


def register_recipe(recipe: Recipe) -> Recipe:
    """Add a feature. Ids are unique; ``build`` sees only observable columns and raw history."""
    if recipe.id in REGISTRY:
        raise ValueError(f"feature id already registered: {recipe.id}")
    REGISTRY[recipe.id] = recipe
    return recipe


def _scaled(name: str, scale: float, needs: tuple[str, ...], requires: tuple[str, ...]) -> None:
    register_recipe(
        Recipe(name, requires, lambda: scaled_log1p(F.col("raw_" + name), scale), needs=needs)
    )


def _register_payment_recipes() -> None:
    identity = ("identities",)
    timed = ("identities", "timestamps")
    money = ("amount", "identities")
    register_recipe(Recipe("log_amount", ("amount",), lambda: scaled_log1p(F.col("amount"), 8)))
    register_recipe(
        Recipe(
            "amount_bin",
            ("amount",),
            lambda: amount_bin(F.col("amount")) / F.lit(float(len(AMOUNT_EDGES))),
        )
    )
    for side in SIDES:
        for what in ("out_count", "in_count"):
            _scaled(f"{side}_{what}", 6, ("account",), identity)
    for side in SIDES:
        for what in ("out_value", "in_value"):
            _scaled(f"{side}_{what}", 10, ("account",), money)
    for side in SIDES:
        _scaled(f"{side}_seen", 6, ("account",), identity)
    for side in SIDES:
        _scaled(f"{side}_gap", 6, ("account",), timed)
    _scaled("pair_out_count", 3, ("pair",), identity)
    _scaled("pair_total_count", 3, ("pair",), identity)
    register_recipe(
        Recipe(
            "prior_contact",
            identity,
            lambda: (F.col("raw_pair_total_count") > 0).cast("double"),
            needs=("pair",),
        )
    )
    for side in SIDES:
        for what in ("recent_in_count", "recent_out_count"):
            _scaled(f"{side}_{what}", 4, ("account", "recent"), timed)
    for side in SIDES:
        for what in ("recent_in_value", "recent_out_value"):
            _scaled(f"{side}_{what}", 10, ("account", "recent"), (*money, "timestamps"))

    def against_mean(value: str, count: str) -> Column:
        mean = F.col(value).cast("double") / F.greatest(F.lit(1), F.col(count))
        return scaled_log1p(F.col("amount") / F.greatest(F.lit(1.0), mean), 8)

    register_recipe(
        Recipe(
            "amount_vs_sender_out_mean",
            (*money, "timestamps"),
            lambda: against_mean("raw_sender_out_value", "raw_sender_out_count"),
            needs=("account",),
        )
    )
    register_recipe(
        Recipe(
            "amount_vs_recipient_in_mean",
            (*money, "timestamps"),
            lambda: against_mean("raw_recipient_in_value", "raw_recipient_in_count"),
            needs=("account",),
        )
    )


_register_payment_recipes()
PAYMENT_FEATURES = list(REGISTRY)


def available_recipes(capabilities: Sequence[str]) -> dict[str, list[str]]:
    """Requirements that are missing, per recipe; an empty list means the recipe can be built."""
    have = set(capabilities)
    return {name: sorted(set(r.requires) - have) for name, r in REGISTRY.items()}


def pair_history(
    payments: DataFrame,
    settled: bool = False,
    freeze_us: int | None = None,
    per_task: int | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """Earlier payments between the same two accounts, in this and in both directions.

    Rows are keyed by the unordered pair. Rows that are no payment between two accounts have no
    pair; they get a key of their own, so that they do not meet in one task.
    """
    paired = (
        (F.col("kind") == "payment") & F.col("source").isNotNull() & F.col("destination").isNotNull()
    )
    forward = F.col("source") <= F.col("destination")
    adds = paired & F.coalesce(F.col("settled"), F.lit(True)) if settled else paired
    rows = payments.withColumns(
        {
            "__lo": F.when(~paired, F.concat(F.lit("#"), F.col("event_id")))
            .when(forward, F.col("source"))
            .otherwise(F.col("destination")),
            "__hi": F.when(~paired, "").when(forward, F.col("destination")).otherwise(F.col("source")),
            "__fwd": F.coalesce(forward, F.lit(True)),
            "__adds": F.when(adds, 1).otherwise(0),
            "__at": F.col("event_us"),
            "__asks": F.lit(freeze_us is None),
        }
    )
    if freeze_us is not None:
        probes = rows.withColumns(
            {
                "__adds": F.lit(0),
                "__at": F.least(F.col("event_us"), F.lit(freeze_us)),
                "__asks": F.lit(True),
            }
        )
        rows = rows.unionByName(probes)
    keys = ["__lo", "__hi"]
    rows = strict_prefix(
        rows,
        keys,
        "__at",
        {
            "__same": F.when(F.col("__fwd"), F.col("__adds")).otherwise(0),
            "__back": F.when(F.col("__fwd"), 0).otherwise(F.col("__adds")),
        },
        layout=plan_layout(rows, keys, "__at", per_task, at_most),
        sequence=[F.col("seq")] if settled else None,
        size=at_most,
    ).filter("__asks")
    directed = F.when(F.col("__fwd"), F.col("__same")).otherwise(F.col("__back"))
    both = F.when(F.col("source") == F.col("destination"), F.col("__same") * 2).otherwise(
        F.col("__same") + F.col("__back")
    )
    return rows.withColumns(
        {"raw_pair_out_count": directed, "raw_pair_total_count": both}
    ).drop("__lo", "__hi", "__fwd", "__adds", "__at", "__asks", "__same", "__back")


def _account_rows(
    payments: DataFrame, carried: list[str], recent: bool, settled: bool, freeze_us: int | None
) -> DataFrame:
    """Per payment: a row for the sender and one for the recipient, plus rows one hour earlier.

    ``role`` 0 sender, 1 recipient, 2 sender an hour before, 3 recipient an hour before; -1 adds
    to the history only. ``out``, ``inn`` and ``touch`` say what the row adds.
    """
    paid = (F.col("kind") == "payment") & F.col("source").isNotNull() & F.col("destination").isNotNull()
    counts = paid & F.coalesce(F.col("settled"), F.lit(True)) if settled else paid
    touches = F.col("kind").isin("payment", "deposit")
    self_paid = F.coalesce(F.col("source") == F.col("destination"), F.lit(False))
    zero = F.lit(0)

    def row(role: int, account: str, adds: bool, phase: int, shift: int, order: Column) -> Column:
        sender = account == "source"
        if not adds:
            out = inn = touch = zero
        elif settled:
            # A self-payment adds everything in its sender row, which comes second.
            out = F.when(counts, 1).otherwise(0) if sender else zero
            inn = (
                F.when(counts & self_paid, 1).otherwise(0)
                if sender
                else F.when(counts & ~self_paid, 1).otherwise(0)
            )
            touch = F.when(touches & (F.lit(True) if sender else ~self_paid), 1).otherwise(0)
        else:
            out = F.when(counts, 1).otherwise(0) if sender else zero
            inn = zero if sender else F.when(counts, 1).otherwise(0)
            touch = F.when(touches & (F.lit(True) if sender else ~self_paid), 1).otherwise(0)
        lead = role in (-1, 0)
        return F.struct(
            F.lit(role).alias("role"),
            F.col(account).alias("account"),
            (order - F.lit(shift)).alias("at"),
            F.lit(phase).alias("phase"),
            F.lit(0 if not sender else 1).alias("side"),
            out.alias("out"),
            inn.alias("inn"),
            touch.alias("touch"),
            *[
                (F.col(c) if lead else F.lit(None).cast(payments.schema[c].dataType)).alias("c_" + c)
                for c in carried
            ],
        )

    now = F.col("event_us")
    if freeze_us is None:
        rows = [row(0, "source", True, 1, 0, now), row(1, "destination", True, 1, 0, now)]
        probe = now
    else:
        probe = F.least(now, F.lit(freeze_us))
        rows = [
            row(-1, "source", True, 1, 0, now),
            row(-1, "destination", True, 1, 0, now),
            row(0, "source", False, 1, 0, probe),
            row(1, "destination", False, 1, 0, probe),
        ]
    if recent:
        rows += [
            row(2, "source", False, 0, WINDOW_US, probe),
            row(3, "destination", False, 0, WINDOW_US, probe),
        ]
    exploded = payments.select(
        "event_id",
        F.col("seq").alias("seq"),
        F.col("amount").cast(MONEY).alias("value"),
        F.explode(F.array(*rows)).alias("r"),
    ).select("event_id", "seq", "value", "r.*")
    return exploded.filter(F.col("account").isNotNull())


def raw_history(
    payments: DataFrame,
    needs: Sequence[str] = ("account", "recent", "pair"),
    settled: bool = False,
    freeze_us: int | None = None,
    keep: Sequence[str] = (),
    per_task: int | None = None,
) -> DataFrame:
    """Payments with their raw history columns ``raw_sender_*``, ``raw_recipient_*``, ``raw_pair_*``.

    ``settled``    only settled payments count, and simultaneous rows are taken in arrival order.
    ``freeze_us``  history stops growing at this time.
    """
    columns = ["event_id", "event_us", "seq", "kind", "source", "destination", "amount"]
    base = payments.select(*columns, *(["settled"] if settled else []), *keep)
    if not needs:
        return base.filter(F.col("kind") == "payment")
    size = payments.count()
    plain = base
    if "pair" in needs:
        base = pair_history(base, settled, freeze_us, per_task, 2 * size)
    if "account" not in needs:
        return base.filter(F.col("kind") == "payment")
    carried = [c for c in base.columns if c not in ("event_id", "seq", "settled", "role")]
    recent = "recent" in needs
    rows = _account_rows(base, carried, recent, settled, freeze_us)
    # Hot accounts are sought without the history of pairs, whose window would run for it once more.
    layout = plan_layout(_account_rows(plain, [], recent, settled, freeze_us), ["account"], "at", per_task, 6 * size)
    value = F.col("value")
    sums = {
        "out_count": F.col("out"),
        "in_count": F.col("inn"),
        "out_value": F.when(F.col("out") == 1, value),
        "in_value": F.when(F.col("inn") == 1, value),
        "seen": F.col("touch"),
    }
    scanned = strict_prefix(
        rows,
        ["account"],
        "at",
        sums,
        {"last_us": F.when(F.col("touch") == 1, F.col("at"))},
        layout,
        [F.col("phase"), F.col("seq"), F.col("side")] if settled else None,
        6 * size,
    ).filter((F.col("role") >= 0) & (F.col("role") < 4))

    def pick(role: int, name: str, alias: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col(name))).alias(alias)

    aggregates = [F.max("c_" + c).alias(c) for c in carried]
    if freeze_us is not None:
        aggregates = [F.max(F.when(F.col("role") == 0, F.col("c_" + c))).alias(c) for c in carried]
    for role, side in enumerate(SIDES):
        for name in ("out_count", "in_count", "out_value", "in_value", "seen", "last_us"):
            aggregates.append(pick(role, name, f"raw_{side}_{name}"))
        if recent:
            for name in ("out_count", "in_count", "out_value", "in_value"):
                aggregates.append(pick(role + 2, name, f"old_{side}_{name}"))
    folded = scanned.groupBy("event_id", "seq").agg(*aggregates).filter(F.col("kind") == "payment")
    extra = {}
    for side in SIDES:
        gap = F.greatest(F.lit(0.0), (F.col("event_us") - F.col(f"raw_{side}_last_us")) / 60e6)
        extra[f"raw_{side}_gap"] = F.when(F.col(f"raw_{side}_seen") > 0, gap).otherwise(0.0)
        if recent:
            for name in ("out_count", "in_count", "out_value", "in_value"):
                extra[f"raw_{side}_recent_{name}"] = F.col(f"raw_{side}_{name}") - F.col(
                    f"old_{side}_{name}"
                )
    return folded.withColumns(extra).drop(*[c for c in folded.columns if c.startswith("old_")])


def payment_features(
    payments: DataFrame,
    names: Sequence[str] | None = None,
    settled: bool = False,
    freeze_us: int | None = None,
    keep: Sequence[str] = (),
    per_task: int | None = None,
) -> DataFrame:
    """Chosen features (all 27 by default) of every payment, from strictly earlier history."""
    names = list(names or PAYMENT_FEATURES)
    recipes = [REGISTRY[n] for n in names]
    needs = {need for r in recipes for need in r.needs}
    raw = raw_history(payments, sorted(needs), settled, freeze_us, keep, per_task)
    return raw.select(
        "event_id", "event_us", "seq", *keep, *[r.build().alias(r.id) for r in recipes]
    )


def numeric_payments(payments: DataFrame) -> DataFrame:
    """log1p amount and the earlier payment counts of sender (as sender) and recipient."""
    raw = raw_history(payments.filter(F.col("kind") == "payment"), ["account"])
    return raw.select(
        "event_id",
        "event_us",
        F.log1p("amount").alias("log1p_amount"),
        F.col("raw_sender_out_count").cast("double").alias("prior_source_count"),
        F.col("raw_recipient_in_count").cast("double").alias("prior_destination_count"),
    )


# Weights of the label-free rarity score.
RARITY_WEIGHTS = {
    "log_amount": 0.35,
    "amount_bin": 0.4,
    "sender_gap": 0.7,
    "recipient_gap": 0.7,
    "sender_recent_in_count": 0.6,
    "sender_recent_out_count": 0.8,
    "recipient_recent_in_count": 0.6,
    "recipient_recent_out_count": 0.8,
    "amount_vs_sender_out_mean": 0.8,
    "amount_vs_recipient_in_mean": 0.8,
}
NEW_CONTACT_WEIGHT = 1.2


def rarity_score() -> Column:
    """Weighted sum of ten features plus a term for a first contact, floored at zero."""
    total = F.lit(NEW_CONTACT_WEIGHT) * (F.lit(1.0) - F.col("prior_contact"))
    for name, weight in RARITY_WEIGHTS.items():
        total = total + F.lit(weight) * F.col(name)
    return F.greatest(F.lit(0.0), total)


def context_statistics(payments: DataFrame) -> DataFrame:
    """Five scaled context figures of sender, recipient and pair, plus three pair features."""
    raw = raw_history(payments, ["account", "pair"])

    def mean(value: str, count: str) -> Column:
        return F.col(value).cast("double") / F.greatest(F.lit(1), F.col(count))

    return raw.select(
        "event_id",
        "event_us",
        scaled_log1p(mean("raw_sender_out_value", "raw_sender_out_count"), 8).alias("sender_mean_out"),
        scaled_log1p(mean("raw_recipient_in_value", "raw_recipient_in_count"), 8).alias(
            "recipient_mean_in"
        ),
        scaled_log1p(F.col("raw_sender_seen"), 6).alias("sender_activity"),
        scaled_log1p(F.col("raw_recipient_seen"), 6).alias("recipient_activity"),
        scaled_log1p(F.col("raw_pair_out_count"), 3).alias("pair_activity"),
        scaled_log1p(F.col("raw_recipient_in_count"), 6).alias("recipient_popularity"),
        (F.col("raw_pair_total_count") > 0).cast("double").alias("known_pair"),
    )
