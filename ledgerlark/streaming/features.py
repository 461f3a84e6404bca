"""Continuous payment features with keyed account state.

A timestamp is scored only after the watermark has passed it, so simultaneous payments never see
one another and the stream gives what the batch gives. Per account the state holds lifetime
counters, counters per counterparty and the payments of the last hour; rows wait in the state
until their timestamp is complete. Every call to the state store is a round trip out of Python, so rows of a batch wait
as one text, and counterparties share slots of a bounded number.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerlark.operators.features import REGISTRY, WINDOW_US

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_FIELDS = ["us", "seq", "event_id", "role", "other", "amount", "counts", "touches"]
_OUT = (
    "event_id string, event_us bigint, seq bigint, role int, amount double, out_count bigint, in_count bigint, "
    "out_value double, in_value double, seen bigint, gap double, recent_out_count bigint, "
    "recent_in_count bigint, recent_out_value double, recent_in_value double, pair_out bigint, pair_in bigint"
)


#: Kind of the row that ends a stream: it belongs to no account and is later than every other row.
CLOSING = "closing"


def closing_row(payments: DataFrame) -> DataFrame:
    """One row after the last of the stored ``payments``. Sent behind them it completes their last timestamp, which
    otherwise waits for a later payment."""
    last = payments.agg(F.max("event_us").alias("m"))
    late = F.col("m") + 1_000_000
    own = {"kind": F.lit(CLOSING), "event_us": late, "event_ts": F.timestamp_micros(late)}
    kinds = payments.schema
    return last.filter("m is not null").select(
        *[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds.fields]
    )


def account_stream(payments: DataFrame) -> DataFrame:
    """Account rows of a payment stream that carries ``event_ts`` and a watermark on it."""
    paid = (F.col("kind") == "payment") & F.col("source").isNotNull() & F.col("destination").isNotNull()
    touches = F.col("kind").isin("payment", "deposit")
    closing = F.col("kind") == CLOSING
    self_paid = F.coalesce(F.col("source") == F.col("destination"), F.lit(False))

    def side(account: str, other: str, role: int):
        return F.struct(
            F.col(account).alias("account"),
            F.col(other).alias("other"),
            F.lit(role).alias("role"),
            paid.alias("counts"),
            (touches if role == 0 else touches & ~self_paid).alias("touches"),
        )

    return (
        payments.filter(touches | closing)  # a closing row has no account and only moves the watermark
        .select(
            "event_ts", F.col("event_us").alias("us"), "seq", "event_id", "amount",
            F.explode(F.array(side("source", "destination", 0), side("destination", "source", 1))).alias("x"),
        )
        .select("event_ts", "us", "seq", "event_id", "amount", "x.*")
        .filter(F.col("account").isNotNull())
    )


# Waiting rows of a text.
_TEXT_ROWS = 10_000
#: Counterparties that share a slot of the state on average, at most.
SLOT_PAIRS = 256


class Recent:
    """Counts and sums by role over a sliding hour, each row added and dropped once.

    Two stacks: the older one carries sums up to its end, the newer one plain totals, so nothing is ever subtracted.
    """

    def __init__(self, rows: list) -> None:
        self.older: list[tuple] = []  # newest first: (us, role, amount, counts, sums up to the end)
        self.newer: list[tuple] = []
        self.counts, self.sums = [0, 0], [0.0, 0.0]
        for us, role, amount in rows:
            self.add(us, role, amount)

    def add(self, us: int, role: int, amount: float) -> None:
        self.newer.append((us, role, amount))
        self.counts[role] += 1
        self.sums[role] += amount

    def drop(self, before: int) -> None:
        """Rows earlier than ``before`` go; rows were added in the order of time."""
        while True:
            if not self.older:
                if not self.newer or self.newer[0][0] >= before:
                    return
                counts, sums = [0, 0], [0.0, 0.0]
                for us, role, amount in reversed(self.newer):
                    counts[role] += 1
                    sums[role] += amount
                    self.older.append((us, role, amount, tuple(counts), tuple(sums)))
                self.newer, self.counts, self.sums = [], [0, 0], [0.0, 0.0]
            if self.older[-1][0] >= before:
                return
            self.older.pop()

    def totals(self) -> tuple[int, int, float, float]:
        """Rows sent, rows received, amount sent, amount received."""
        counts, sums = self.older[-1][3:] if self.older else ((0, 0), (0.0, 0.0))
        return counts[0] + self.counts[0], counts[1] + self.counts[1], sums[0] + self.sums[0], sums[1] + self.sums[1]

    def rows(self) -> list:
        return [row[:3] for row in reversed(self.older)] + self.newer


class Pairs:
    """Payments sent and received by counterparty, in slots of the state that are read and written whole.

    A slot is one text, and there are as many slots as keep ``SLOT_PAIRS`` counterparties in each; they double as an
    account meets more of them.
    """

    def __init__(self, state, slots: int, size: int, per_slot: int = SLOT_PAIRS) -> None:
        self.state, self.slots, self.size, self.per_slot = state, slots, size, per_slot
        self.held: dict[int, dict[str, list[int]]] = {}
        self.fresh = size == 0  # nothing is stored yet

    def _slot(self, number: int) -> dict[str, list[int]]:
        if number not in self.held:
            found = None if self.fresh else self.state.getValue((number,))
            self.held[number] = json.loads(found[0]) if found else {}
        return self.held[number]

    def of(self, other: str) -> list[int]:
        slot = self._slot(zlib.crc32(other.encode("utf-8", "surrogatepass")) % self.slots)
        if other not in slot:
            slot[other] = [0, 0]
            self.size += 1
        return slot[other]

    def store(self) -> None:
        """Write the slots that were used, after splitting them if they hold too many."""
        while self.size > self.per_slot * self.slots:
            whole = [self._slot(number) for number in range(self.slots)]
            self.slots *= 2
            self.held = {number: {} for number in range(self.slots)}
            for slot in whole:
                for other, counts in slot.items():
                    self.held[zlib.crc32(other.encode("utf-8", "surrogatepass")) % self.slots][other] = counts
        for number, slot in self.held.items():
            self.state.updateValue((number,), (json.dumps(slot),))


class AccountHistory(StatefulProcessor):
    """Scores complete timestamps of one account against its state, then adds them to it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState(
            "totals", "oc bigint, ic bigint, ov double, iv double, seen bigint, last bigint, slots bigint, size bigint"
        )
        self.waiting = handle.getListState("waiting", "rows string")
        self.recent = handle.getValueState("recent", "rows string")
        self.pairs = handle.getMapState("pairs", "slot int", "counts string")
        self.timer = handle.getValueState("timer", "at bigint")

    def _await(self, first_us: int) -> None:
        at = first_us // 1000 + 1
        current = self.timer.get()
        if current is not None:
            if current[0] <= at:
                return
            self.handle.deleteTimer(current[0])
        self.timer.update((at,))
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            if len(batch):
                values = list(zip(*(batch[f].tolist() for f in _FIELDS)))
                self.waiting.appendValue((json.dumps(values),))
                low = min(v[0] for v in values)
                first = low if first is None else min(first, low)
        if first is not None:
            self._await(first)
        return iter(())  # not even an empty frame, which would cost every account a batch

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        complete = timerValues.getCurrentWatermarkInMs() * 1000
        texts = [text for (text,) in self.waiting.get()]
        rows = sorted((r for text in texts for r in json.loads(text)), key=lambda r: (r[0], r[1], r[3]))
        ready = [r for r in rows if r[0] < complete]
        later = [r for r in rows if r[0] >= complete]
        if later:
            self.waiting.put([(json.dumps(later[i : i + _TEXT_ROWS]),) for i in range(0, len(later), _TEXT_ROWS)])
        else:
            self.waiting.clear()
        state = self.totals.get()
        held = None if state is None else self.recent.get()
        state = [0, 0, 0.0, 0.0, 0, 0, 1, 0] if state is None else list(state)
        recent = Recent(json.loads(held[0]) if held else [])
        pairs = Pairs(self.pairs, state[6], state[7])
        out, place = [], 0
        while place < len(ready):
            us = ready[place][0]
            end = place
            while end < len(ready) and ready[end][0] == us:
                end += 1
            group = ready[place:end]
            recent.drop(us - WINDOW_US)
            hour = recent.totals()
            gap = max(0.0, (us - state[5]) / 60e6) if state[4] else 0.0
            for _, seq, event_id, role, other, amount, counts, _ in group:
                if counts:
                    known = pairs.of(other) if role == 0 else (0, 0)
                    out.append(
                        (event_id, us, seq, role, amount, state[0], state[1], state[2], state[3], state[4],
                         gap, *hour, known[0], known[1])
                    )
            for _, _, _, role, other, amount, counts, touches in group:
                if touches:
                    state[4] += 1
                    state[5] = us
                if counts:
                    state[role] += 1
                    state[2 + role] += amount
                    recent.add(us, role, amount)
                    pairs.of(other)[role] += 1
            place = end
        pairs.store()
        state[6:] = [pairs.slots, pairs.size]
        self.totals.update(tuple(state))
        kept = recent.rows()
        if kept:
            self.recent.update((json.dumps(kept),))
        elif held:
            self.recent.clear()
        if later:
            self._await(min(r[0] for r in later))
        names = [c.strip().split(" ")[0] for c in _OUT.split(",")]
        yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def history_parts(payments: DataFrame) -> DataFrame:
    """Two rows per scored payment (role 0 sender, 1 recipient) with the raw counters before it.

    ``payments`` is a stream with a watermark on ``event_ts``. Both rows of a payment come out in
    the same micro-batch, because the watermark is shared.
    """
    return (
        account_stream(payments)
        .groupBy("account")
        .transformWithStateInPandas(
            statefulProcessor=AccountHistory(), outputStructType=_OUT, outputMode="append", timeMode="eventTime"
        )
    )


def fold_parts(parts: DataFrame, names: list[str]) -> DataFrame:
    """Features from the parts of one micro-batch (or of a stored table of parts)."""

    def of(role: int, column: str):
        return F.max(F.when(F.col("role") == role, F.col(column)))

    sides = (("sender", 0), ("recipient", 1))
    columns = (
        "out_count", "in_count", "out_value", "in_value", "seen", "gap",
        "recent_out_count", "recent_in_count", "recent_out_value", "recent_in_value",
    )
    raw = parts.groupBy("event_id", "event_us", "seq").agg(
        F.max("amount").alias("amount"),
        *[of(role, c).alias(f"raw_{side}_{c}") for side, role in sides for c in columns],
        of(0, "pair_out").alias("raw_pair_out_count"),
        F.max(F.when(F.col("role") == 0, F.col("pair_out") + F.col("pair_in"))).alias("raw_pair_total_count"),
    )
    return raw.select("event_id", "event_us", "seq", *[REGISTRY[n].build().alias(n) for n in names])


def stream_payment_features(
    payments: DataFrame, names: list[str], write: Callable[[DataFrame, int], None], checkpoint: str
):
    """Start the stream; ``write(features, batch_id)`` receives each micro-batch of features."""
    payments.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return (
        history_parts(payments)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda parts, batch: write(fold_parts(parts, names), batch))
    )
