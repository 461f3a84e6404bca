"""Row-level expressions: parsing, labels, clocks, keys, bins and signatures."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Edges of the amount bins (currency units) and of the gap bins (minutes).
AMOUNT_EDGES = [15, 35, 75, 150, 300, 650, 1500, 4000, 10000]
GAP_EDGES = [1, 5, 20, 60, 180, 720, 2880]
# Spellings of an unknown label, and seconds per clock unit.
UNKNOWN_LABELS = ["", "-1", "unknown", "null"]
UNIT_SECONDS = {"seconds": 1, "minutes": 60, "hours": 3600}

MICROS = 1_000_000


def finite_number(value: Column, nonnegative: bool = False) -> Column:
    """The value as a finite double, or NULL where it is no such number."""
    number = value.try_cast("double")
    bad = F.isnan(number) | (F.abs(number) == float("inf"))
    if nonnegative:
        bad = bad | (number < 0)
    return F.when(~bad, number)


def tri_label(value: Column, mapping: Mapping[str, int] | None = None) -> Column:
    """1 fraud, 0 legitimate, -1 unknown; NULL for a spelling that is none of these."""
    text = F.trim(value.cast("string"))
    unknown = value.isNull() | F.lower(text).isin(UNKNOWN_LABELS)
    if mapping is not None:
        pairs = [F.lit(x) for item in mapping.items() for x in item]
        known = F.try_element_at(F.create_map(*pairs), value.cast("string"))
    else:
        lowered = F.lower(text)
        known = F.when(lowered.isin("1", "true"), 1).when(lowered.isin("0", "false"), 0)
    return F.when(unknown, -1).otherwise(known).cast("int")


def to_seconds(value: Column, unit: str) -> Column:
    """Seconds as a double; ISO-8601 text must carry an offset. NULL where it cannot be read."""
    if unit == "iso8601":
        text = value.cast("string")
        zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
        return F.when(zoned, F.unix_micros(F.try_to_timestamp(text)) / F.lit(float(MICROS)))
    if unit not in UNIT_SECONDS:
        raise ValueError("time unit must be seconds, minutes, hours or iso8601")
    return finite_number(value) * F.lit(float(UNIT_SECONDS[unit]))


def to_micros(seconds: Column) -> Column:
    """Integer order key of a clock in seconds."""
    return F.round(seconds * F.lit(float(MICROS))).cast("bigint")


def entity_key(*parts: Column | str) -> Column:
    """Collision-free text key: a JSON array of the parts, e.g. (kind, id)."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.to_json(F.array(*[c.cast("string") for c in cols]))


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """Number of edges that are less than or equal to the value."""
    result = F.when(value < edges[0], 0)
    for index in range(1, len(edges)):
        result = result.when(value < edges[index], index)
    return result.otherwise(len(edges)).cast("int")


def amount_bin(amount: Column) -> Column:
    return bin_of(amount, AMOUNT_EDGES)


def gap_bin(gap_minutes: Column, seen: Column) -> Column:
    """Bin of the minutes since the last activity; one extra bin for a first activity."""
    return F.when(seen > 0, bin_of(F.greatest(F.lit(0.0), gap_minutes), GAP_EDGES)).otherwise(
        len(GAP_EDGES) + 1
    ).cast("int")


def scaled_log1p(value: Column, scale: float = 1.0) -> Column:
    return F.log1p(F.greatest(F.lit(0.0), value.cast("double"))) / F.lit(float(scale))


def convert_currency(amount: Column, currency: str | None, factor: float | None = None) -> Column:
    """Amount in EUR. A source in another (or no) currency needs an explicit positive factor."""
    if factor is None:
        if currency != "EUR":
            raise ValueError("a positive conversion factor to EUR is required")
        factor = 1.0
    if not (math.isfinite(factor) and factor > 0):
        raise ValueError("the conversion factor must be finite and positive")
    return amount * F.lit(float(factor))


def mask_label(label: Column, available_at: Column, cutoff: Column | float) -> Column:
    """-1 where the label became known only after the cutoff; NULL availability is kept."""
    limit = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    return F.when(available_at > limit, -1).otherwise(label).cast("int")


def time_encoding(delta: Column, dimensions: int) -> Column:
    """cos(w * log1p(|delta|)) for ``dimensions`` frequencies from 1 down to 1e-9."""
    steps = [9.0 * i / max(1, dimensions - 1) for i in range(dimensions)]
    return F.array(*[F.cos(F.log1p(F.abs(delta)) * F.lit(10.0 ** -s)) for s in steps])


def payment_signature(source: Column, destination: Column, time: Column, amount: Column) -> Column:
    """Hash of what was observed, independent of ids and labels."""
    return F.sha2(
        F.to_json(F.array(source, destination, time.cast("string"), amount.cast("string"))), 256
    )


def numeric_signature(time: Column, features: Mapping[str, Column]) -> Column:
    names = F.array(*[F.lit(n) for n in features])
    values = F.array(*[c.cast("double").cast("string") for c in features.values()])
    return F.sha2(
        F.concat_ws("|", time.cast("string"), F.to_json(names), F.to_json(values)), 256
    )


def sigmoid(x: Column, clip: float | None = None) -> Column:
    """Logistic function, evaluated without overflow on either side."""
    value = x if clip is None else F.least(F.lit(clip), F.greatest(F.lit(-clip), x))
    small = F.exp(-F.abs(value))
    return F.when(value >= 0, F.lit(1.0) / (F.lit(1.0) + small)).otherwise(
        small / (F.lit(1.0) + small)
    )


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def classify_outcome(decision: Column, label: Column) -> Column:
    """warmup, unknown, tp, fn, fp or tn."""
    blocked = decision == "BLOCK"
    return (
        F.when(decision == "LEARNING", "warmup")
        .when(label.isNull() | (label < 0), "unknown")
        .when(label == 1, F.when(blocked, "tp").otherwise("fn"))
        .otherwise(F.when(blocked, "fp").otherwise("tn"))
    )
