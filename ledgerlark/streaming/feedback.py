"""Streaming labels, budgets and late rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def stream_released_feedback(
    events: DataFrame, outcomes: DataFrame, horizon: str | None = None, delay: str = "1 hour"
) -> DataFrame:
    """Labels joined to their events as they become available, however late either of them is.

    ``events(event_id, event_ts)`` and ``outcomes(event_id, label, available_ts)`` are streams. Without a
    ``horizon`` no known label is lost and the state holds both sides. With one, labels that become available
    later than that after their event are given up (``expired_feedback`` tells which), and watermarks of
    ``delay`` let both sides forget what can no longer match.
    """
    left = events.alias("e")
    right = outcomes.filter(F.col("label") >= 0).withColumnRenamed("event_id", "o_id").alias("o")
    matched = "e.event_id = o.o_id and o.available_ts >= e.event_ts"
    if horizon is not None:
        left = events.withWatermark("event_ts", delay).alias("e")
        right = right.withWatermark("available_ts", delay).alias("o")
        matched += f" and o.available_ts <= e.event_ts + interval {horizon}"
    return left.join(right, F.expr(matched)).select("event_id", "event_ts", "label", "available_ts")


def expired_feedback(events: DataFrame, outcomes: DataFrame, horizon: str) -> DataFrame:
    """Known labels (event_id, label, available_ts) of stored tables that a stream with this ``horizon`` gives up."""
    known = outcomes.filter(F.col("label") >= 0)
    late = F.col("available_ts") > F.expr(f"event_ts + interval {horizon}")
    return events.select("event_id", "event_ts").join(known, "event_id").filter(late).select("event_id", "label", "available_ts")


def stream_settled_feedback(events: DataFrame, outcomes: DataFrame, horizon: str, delay: str = "1 hour") -> DataFrame:
    """Every known label of the stream exactly once: (event_id, label, available_ts, event_ts, state).

    ``state`` is RELEASED for a label that becomes available from its event's time on and at most ``horizon`` later,
    as soon as both have arrived. Any other label is EXPIRED, without ``event_ts``: it came too long after its event,
    before it, or its event is not there. It comes out when the watermark of both streams, ``delay`` behind their latest
    rows, shows that no event can match any more, and then leaves the state. So the state holds what lies
    within horizon and delay, however long the stream runs. Rows more than ``delay`` late, and all before 1970, are
    the matter of ``late_event_audit``. ``closing_feedback`` makes the rows that complete a stored stream.
    """
    known = outcomes.filter(F.col("label") >= 0).withColumnRenamed("event_id", "o_id")
    left = known.withWatermark("available_ts", delay).alias("o")
    right = events.select("event_id", "event_ts").withWatermark("event_ts", delay).alias("e")
    matched = f"e.event_id = o.o_id and e.event_ts <= o.available_ts and o.available_ts <= e.event_ts + interval {horizon}"
    state = F.when(F.col("event_id").isNull(), "EXPIRED").otherwise("RELEASED").alias("state")
    joined = left.join(right, F.expr(matched), "left_outer")
    return joined.select(F.col("o_id").alias("event_id"), "label", "available_ts", "event_ts", state)


def closing_feedback(last_us: int, beyond_us: int) -> list[tuple[str, int, str, int]]:
    """An event and an outcome (event_id, at_us, kind, label) beyond all others; behind them every other label is settled.

    The ids are not null, as a join drops null keys before the watermark sees them. They are for the end of a
    stream: the outcome itself stays in the state.
    """
    at = last_us + beyond_us
    return [("closing:event", at, "event", -1), ("closing:outcome", at, "outcome", 0)]


class AdaptiveCutoff(StatefulProcessor):
    """Warm-up, then a drifting cutoff per stream key, in request order.

    A request that arrives after a later one of its key was decided changes nothing and comes out as LATE, so the
    decisions do not depend on how the stream is cut into batches as long as it arrives in order. Of a micro-batch
    a key holds (order, position, score) as numbers; the rows go out in pieces. ``in_request_order`` bounds
    a micro-batch.
    """

    piece = 10_000

    def __init__(self, alpha: float, eta: float, warmup: int) -> None:
        self.alpha, self.eta, self.warmup = alpha, eta, warmup

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cutoff = handle.getValueState("cutoff", "tau double, decided bigint, blocked bigint")
        self.learned = handle.getListState("learned", "score double")
        self.last = handle.getValueState("last", "seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        order = np.concatenate([p["seq"].to_numpy() for p in parts])
        ranked = np.argsort(order, kind="stable")
        starts = np.cumsum([0, *map(len, parts)])
        tau0, decided, blocked = self.cutoff.get() if self.cutoff.exists() else (None, 0, 0)
        learned = [r[0] for r in self.learned.get()] if tau0 is None and self.learned.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        columns = ["event_id", "segment", "seq", "score", "decision", "tau_before", "tau_after"]
        for at in range(0, len(ranked), self.piece):
            out = []
            taken = ranked[at : at + self.piece]
            held = np.searchsorted(starts, taken, "right") - 1
            chunk = pd.concat([parts[p].iloc[taken[held == p] - starts[p]] for p in np.unique(held)])
            chunk = chunk.sort_values("seq", kind="stable")
            for event_id, segment, seq, score in zip(*(chunk[c].tolist() for c in columns[:4])):
                if last is not None and seq <= last:
                    out.append((event_id, segment, seq, score, "LATE", None, None))
                    continue
                last = int(seq)
                if tau0 is None:
                    learned.append(float(score))
                    if len(learned) >= self.warmup:
                        tau0 = sorted(learned)[max(0, math.ceil((1 - self.alpha) * len(learned)) - 1)]
                    out.append((event_id, segment, seq, score, "LEARNING", None, tau0))
                    continue
                before = tau0 + self.eta * (blocked - self.alpha * decided)
                block = score > before
                decided, blocked = decided + 1, blocked + int(block)
                after = tau0 + self.eta * (blocked - self.alpha * decided)
                out.append((event_id, segment, seq, score, "BLOCK" if block else "ALLOW", before, after))
            yield pd.DataFrame(out, columns=columns)
        if last is not None:
            self.last.update((last,))
        if tau0 is None:
            if learned:
                self.learned.put([(s,) for s in learned])
        else:
            self.learned.clear()
            self.cutoff.update((tau0, decided, blocked))

    def close(self) -> None:
        pass


def in_request_order(rows: DataFrame, path: str, step: Callable[[], None], order: str = "seq", most: int = 250_000, least: int = 4) -> None:
    """Hand a stored table to a file stream in the order of ``order``, at most about ``most`` rows at a time.

    The rows are cut into ranges of equal size (``least`` or more of them). One range after another is appended
    to the folder ``path`` by many tasks, and ``step`` is called, which runs the stream over what is new. No
    micro-batch is larger than a range, whatever share of the rows a key has.
    """
    n = rows.count()
    parts = max(least, -(-n // most))
    cuts = sorted(set(rows.stat.approxQuantile(order, [i / parts for i in range(1, parts)], 0.25 / parts))) if n and parts > 1 else []
    for low, high in zip([None, *cuts], [*cuts, None]):
        inside = F.lit(True) if low is None else F.col(order) > low
        rows.filter(inside & (F.lit(True) if high is None else F.col(order) <= high)).write.mode("append").parquet(path)
        step()


def stream_adaptive_budget(
    scores: DataFrame, alpha: float = 0.02, eta: float = 0.025, warmup: int = 128
) -> DataFrame:
    """Decisions over a stream ``(event_id, segment, seq, score)`` that arrives in request order.

    One segment is one key: its requests are decided one after another by nature of an online cutoff.
    """
    return scores.groupBy("segment").transformWithStateInPandas(
        statefulProcessor=AdaptiveCutoff(alpha, eta, warmup),
        outputStructType="event_id string, segment string, seq bigint, score double, decision string, "
        "tau_before double, tau_after double",
        outputMode="append",
        timeMode="none",
    )


def late_event_audit(events: DataFrame, path: str, checkpoint: str):
    """Separate rows that are older than what is already committed; they never join the past.

    Below ``path`` the batches append to ``accepted`` and ``late``; ``marks`` keeps the largest
    committed time of every batch, one row each.
    """

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        committed = None
        if number > 0:
            marks = spark.read.parquet(f"{path}/marks").filter(F.col("batch") < number)
            committed = marks.agg(F.max("event_us")).first()[0]
        low = F.lit(committed).cast("bigint")
        late = F.coalesce(F.col("event_us") < low, F.lit(False))
        # The batch number is a partition, so a repeated batch replaces what it wrote.
        for name, rows in (("late", batch.filter(late)), ("accepted", batch.filter(~late))):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.agg(F.max("event_us").alias("event_us")).write.mode("overwrite").parquet(
            f"{path}/marks/batch={number}"
        )

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(commit)
