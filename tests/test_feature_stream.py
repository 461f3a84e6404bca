"""The payment stream: its state calls, its sliding hour, its slots of counterparties, and several micro-batches."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators.features import WINDOW_US, payment_features
from ledgerlark.session import scratch_dir
from ledgerlark.streaming import features as sft

NAMES = ["sender_seen", "sender_gap", "pair_out_count", "pair_total_count", "sender_recent_out_value", "recipient_recent_in_count"]


class Store:
    """A value, list or map of the state; ``calls`` counts the round trips."""

    def __init__(self):
        self.value, self.rows, self.map, self.calls = None, [], {}, 0

    def __getattribute__(self, name):
        plain = object.__getattribute__
        if callable(getattr(type(self), name, None)) and not name.startswith("_"):
            self.calls = plain(self, "calls") + 1
        return plain(self, name)

    def exists(self):
        return bool(object.__getattribute__(self, "value") or object.__getattribute__(self, "rows"))

    def get(self):
        return iter(self.rows) if self.rows else self.value

    def update(self, value):
        self.value = value

    def appendList(self, rows):
        self.rows.extend(rows)

    def appendValue(self, row):
        self.rows.append(row)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.value, self.rows = None, []

    def containsKey(self, key):
        return key in self.map

    def getValue(self, key):
        return self.map.get(key)

    def updateValue(self, key, value):
        self.map[key] = value


class Handle:
    def __init__(self):
        self.states = {}

    def _state(self, name, *schema):
        return self.states.setdefault(name, Store())

    getValueState = getListState = getMapState = _state

    def registerTimer(self, at):
        pass

    deleteTimer = registerTimer


class Now:
    def getCurrentWatermarkInMs(self):
        return 10_000


def test_state_calls_do_not_grow_with_rows_or_counterparties():
    account, handle = sft.AccountHistory(), Handle()
    account.init(handle)
    rows = [(i * 1000, i, str(i), 0, f"k{i % 200}", 1.5, True, True) for i in range(1000)]
    batch = pd.DataFrame(rows, columns=["us", "seq", "event_id", "role", "other", "amount", "counts", "touches"])
    list(account.handleInputRows(("a",), iter([batch]), Now()))
    (out,) = account.handleExpiredTimer(("a",), Now(), None)
    assert out["pair_out"].tolist() == [i // 200 for i in range(1000)]
    assert out["recent_out_value"].tolist() == [1.5 * i for i in range(1000)]
    assert sum(store.calls for store in handle.states.values()) < 20


def test_sliding_hour_matches_a_scan():
    rng = random.Random(5)
    hour, rows, us = sft.Recent([]), [], 0
    for _ in range(600):
        us += rng.choice([0, 1, WINDOW_US // 9, WINDOW_US // 2])
        hour.drop(us - WINDOW_US)
        rows = [r for r in rows if r[0] >= us - WINDOW_US]
        sent, received = ([r[2] for r in rows if r[1] == role] for role in (0, 1))
        assert hour.totals() == (len(sent), len(received), pytest.approx(sum(sent)), pytest.approx(sum(received)))
        assert hour.rows() == rows
        if rng.random() < 0.1:
            hour = sft.Recent(hour.rows())
        row = (us, rng.randrange(2), rng.random())
        rows.append(row)
        hour.add(*row)


def test_slots_of_counterparties_split_and_keep_their_counts():
    rng, want, state, slots, size = random.Random(6), {}, Store(), 1, 0
    for _ in range(30):
        pairs = sft.Pairs(state, slots, size, per_slot=3)
        for _ in range(7):
            other, role = f"k{rng.randrange(60)}", rng.randrange(2)
            assert pairs.of(other) == want.setdefault(other, [0, 0])
            pairs.of(other)[role] += 1
            want[other][role] += 1
        pairs.store()
        slots, size = pairs.slots, pairs.size
    assert size == len(want) <= 3 * slots


def test_micro_batches_give_what_the_batch_gives(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for i in range(120):
        a, b = rng.choice("pqrs"), rng.choice("pqrs")
        kind = rng.choice(["payment"] * 4 + ["deposit"])
        rows.append((str(i), (1 + i // 3) * 900_000_000, i, kind, a if kind == "payment" else None, b, round(rng.uniform(1, 90), 2)))
    names = "event_id string, event_us bigint, seq bigint, kind string, source string, destination string, amount double"
    payments = spark.createDataFrame(rows, names).withColumn("event_ts", F.timestamp_micros("event_us"))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(4):
        payments.filter(f"seq >= {part * 30} and seq < {part * 30 + 30}").coalesce(1).write.mode("append").parquet(source)
    sft.closing_row(payments).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(payments.schema).option("maxFilesPerTrigger", 1).parquet(source).withWatermark("event_ts", "0 seconds")
    run = sft.stream_payment_features(
        stream, NAMES, lambda df, batch: df.write.mode("append").parquet(out), scratch_dir(spark, "stream-state")
    ).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r["event_id"]: r.asDict() for r in spark.read.parquet(out).collect()}
    want = {r["event_id"]: r.asDict() for r in payment_features(payments, NAMES).collect()}
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert {n: got[key][n] for n in NAMES} == pytest.approx({n: row[n] for n in NAMES})
