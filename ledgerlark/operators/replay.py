"""Replay of a history: prefix and evaluation, released labels, joined rows and the manifest."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators.features import PAYMENT_FEATURES, payment_features
from ledgerlark.operators.retained import retained_features
from ledgerlark.plans.prefix import bucketed_prefix, measure_cuts, plan_layout, strict_prefix, with_scalars


def timestamp_groups(events: DataFrame) -> DataFrame:
    """Atomic groups of simultaneous events: time, size, first and last arrival."""
    return events.groupBy("event_us").agg(
        F.count(F.lit(1)).alias("events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


def release_times(events: DataFrame, outcomes: DataFrame, label_delay_us: int | None = None) -> DataFrame:
    """Known labels with the time from which they may be used for scoring.

    A label helps events that are later than its own event and not earlier than its availability;
    with a fixed delay the recorded availability is ignored. Retrospective labels have no time.
    """
    joined = events.select("event_id", "event_us").join(outcomes, "event_id").filter("label >= 0")
    available = (
        F.col("available_us") if label_delay_us is None else F.col("event_us") + F.lit(label_delay_us)
    )
    return joined.withColumn("available_us", available).withColumn(
        "usable_us",
        F.when(F.col("available_us").isNotNull(), F.greatest(F.col("available_us"), F.col("event_us") + 1)),
    )


def released_feedback(
    events: DataFrame, outcomes: DataFrame, label_delay_us: int | None = None, key: str | None = None
) -> DataFrame:
    """Per event the labels (and frauds) visible when it is scored, overall or per entity ``key``."""
    carried = ["event_id", "event_us", *([key] if key else [])]
    labels = release_times(events, outcomes, label_delay_us).filter(F.col("usable_us").isNotNull())
    if key:
        labels = labels.join(events.select("event_id", key), "event_id")
        rows = labels.select(
            key,
            (F.col("usable_us") - 1).alias("at"),
            F.lit(1).alias("one"),
            F.col("label").alias("fraud"),
            F.lit(None).cast("string").alias("event_id"),
            F.lit(None).cast("bigint").alias("event_us"),
        ).unionByName(
            events.select(*carried, F.col("event_us").alias("at"), F.lit(0).alias("one"), F.lit(0).alias("fraud"))
        )
        layout = plan_layout(rows, [key], "at")
        counted = strict_prefix(
            rows, [key], "at", {"visible": F.col("one"), "visible_fraud": F.col("fraud")}, layout=layout
        )
        return counted.filter(F.col("event_id").isNotNull()).select(*carried, "visible", "visible_fraud")
    freed = labels.groupBy((F.col("usable_us") - 1).alias("at")).agg(
        F.count(F.lit(1)).alias("one"), F.sum("label").alias("fraud")
    )
    times = events.select(F.col("event_us").alias("at")).distinct()
    clock = times.join(freed, "at", "full").na.fill(0, ["one", "fraud"])
    counted = bucketed_prefix(
        clock, ["at"], {"visible": F.col("one"), "visible_fraud": F.col("fraud")}, cuts=measure_cuts(events, "event_us")
    ).select(F.col("at").alias("event_us"), "visible", "visible_fraud")
    return events.select(*carried).join(counted, "event_us").select(*carried, "visible", "visible_fraud")


def replay_split(events: DataFrame, split_us: int) -> tuple[DataFrame, DataFrame]:
    """Prefix (observed, unscored) and evaluation suffix; an empty suffix is an error."""
    prefix = events.filter(F.col("event_us") < split_us)
    suffix = events.filter(F.col("event_us") >= split_us)
    if suffix.isEmpty():
        raise ValueError("the split leaves no evaluation events; choose an earlier split")
    return prefix, suffix


def replay_rows(
    payments: DataFrame,
    outcomes: DataFrame,
    split_us: int,
    scorer: Callable[[DataFrame], DataFrame],
    names: Sequence[str] = tuple(PAYMENT_FEATURES),
    history: str = "growing",
    max_events: int | None = None,
) -> DataFrame:
    """Scored evaluation rows with their final outcomes.

    ``scorer`` gets the feature rows and adds ``score``. ``fixed`` history stops at the split; with ``max_events``
    features see only so many of the latest events. Outcomes are joined only afterwards.
    """
    if history not in ("fixed", "growing"):
        raise ValueError("history must be fixed or growing")
    freeze_us = split_us if history == "fixed" else None
    if max_events is None:
        features = payment_features(payments, names, freeze_us=freeze_us)
    else:
        features = retained_features(payments, max_events, names, freeze_us)
    # The filter follows the features: earlier rows are their history.
    scored = scorer(features.filter(F.col("event_us") >= split_us))
    return scored.join(outcomes.select("event_id", "label", "available_us"), "event_id", "left").withColumn(
        "label", F.coalesce("label", F.lit(-1))
    )


def replay_manifest(
    events: DataFrame,
    outcomes: DataFrame,
    split_us: int,
    label_delay_us: int | None = None,
    history: str = "growing",
    max_events: int | None = None,
) -> DataFrame:
    """One row of counts: population, feedback and maturity of the evaluation labels."""
    joined = events.select("event_id", "event_us").join(
        outcomes.select("event_id", "label", "available_us"), "event_id", "left"
    )
    horizon = events.agg(F.max("event_us").alias("horizon_us"))
    label = F.coalesce("label", F.lit(-1))
    available = F.col("available_us") if label_delay_us is None else F.col("event_us") + F.lit(label_delay_us)
    rows = with_scalars(joined, horizon).select(
        (F.col("event_us") < split_us).alias("prefix"),
        "horizon_us",
        F.when(label < 0, "unknown")
        .when(available.isNull(), "retrospective")
        .when(available <= F.col("horizon_us"), "mature")
        .otherwise("pending")
        .alias("state"),
    )

    def count(state: str, evaluation: bool) -> Column:
        hit = F.col("state") == state
        return F.count_if(hit & ~F.col("prefix")) if evaluation else F.count_if(hit)

    counted = rows.agg(
        F.count_if("prefix").alias("prefix_count"),
        F.count_if(~F.col("prefix")).alias("evaluation_count"),
        count("mature", False).alias("released"),
        count("pending", False).alias("pending"),
        count("retrospective", False).alias("retrospective_unavailable"),
        count("unknown", False).alias("unknown"),
        *[
            count(s, True).alias(f"evaluation_{s}")
            for s in ("unknown", "retrospective", "mature", "pending")
        ],
        F.max("horizon_us").alias("horizon_us"),
    )
    seen = F.col("prefix_count") if history == "fixed" else F.col("prefix_count") + F.col("evaluation_count")
    kept = seen if max_events is None else F.least(seen, F.lit(max_events))
    return counted.withColumn("retained_event_count", kept)


def replay(
    payments: DataFrame,
    outcomes: DataFrame,
    split_us: int,
    scorer: Callable[[DataFrame], DataFrame],
    names: Sequence[str] = tuple(PAYMENT_FEATURES),
    history: str = "growing",
    label_delay_us: int | None = None,
    max_events: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Evaluation rows and manifest of one replay."""
    replay_split(payments, split_us)
    rows = replay_rows(payments, outcomes, split_us, scorer, names, history, max_events)
    return rows, replay_manifest(payments, outcomes, split_us, label_delay_us, history, max_events)
