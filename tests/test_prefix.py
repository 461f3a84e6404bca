import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators.features import payment_features
from ledgerlark.operators.histories import amount_surprise_bits
from ledgerlark.plans import prefix as px
from ledgerlark.plans.ordering import first_seen_index, previous_value, running_max

ROWS = [("hub" if random.Random(i).random() < 0.5 else f"k{i % 7}", i // 3, i, float(i % 11)) for i in range(400)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "key string, at bigint, seq bigint, v double").cache()


def past(key, at):
    return [r for r in ROWS if r[0] == key and r[1] < at]


@pytest.mark.parametrize("per_task", [None, 20])
def test_strict_prefix_splits_hot_keys(rows, per_task):
    layout = px.plan_layout(rows, ["key"], "at", per_task)
    assert (layout is None) == (per_task is None)
    got = px.strict_prefix(rows, ["key"], "at", {"n": F.lit(1), "s": F.col("v")}, {"m": F.col("at")}, layout)
    for r in got.collect():
        seen = past(r["key"], r["at"])
        assert (r["n"], r["s"]) == (len(seen), sum(x[3] for x in seen))
        assert r["m"] == (max(x[1] for x in seen) if seen else None)


def counted(df):
    """The frame, and a counter of how often its rows were made."""
    made = df.sparkSession.sparkContext.accumulator(0)

    def see(_):
        made.add(1)
        return True

    return df.filter(F.udf(see, "boolean")("seq")), made


def test_light_keys_are_found_in_one_pass(rows):
    light, made = counted(rows.withColumn("key", F.concat("key", F.col("seq").cast("string"))))
    assert px.plan_layout(light, ["key"], "at", 20) is None
    assert made.value == len(ROWS)


@pytest.mark.parametrize("slices", [1, 3])
def test_hot_keys_are_exact_whatever_shares_their_slice(rows, monkeypatch, slices):
    monkeypatch.setattr(px, "HASH_SLICES", slices)
    sizes = {k: sum(r[0] == k for r in ROWS) for k in {r[0] for r in ROWS}}
    for per_task in (20, max(sizes.values()) - 1):
        layout = px.plan_layout(rows, ["key"], "at", per_task)
        assert {r["key"] for r in layout.hot.collect()} == {k for k, n in sizes.items() if n > per_task}
    assert px.plan_layout(rows, ["key"], "at", max(sizes.values())) is None


def test_surprise_reads_its_payments_three_times_at_most(spark):
    paid = [(f"e{i}", i * 60_000_000, i, "payment", f"a{i % 3}", f"b{i % 2}", float(i % 9)) for i in range(30)]
    names = "event_id string, event_us bigint, seq bigint, kind string, source string, destination string, amount double"
    payments, made = counted(spark.createDataFrame(paid, names))
    assert amount_surprise_bits(payments).count() == 30
    assert made.value <= 3 * 30  # origin, payments with bins, history


@pytest.mark.parametrize("per_task", [None, 20])
def test_asof_last_k(rows, per_task):
    layout = px.plan_layout(rows, ["key"], "at", per_task)
    found = px.asof_last_k(rows, rows.select("key", "at", "seq"), ["key"], "at", "seq", F.col("seq"), 4, "xs", layout)
    for r in found.collect():
        want = [x[2] for x in sorted(past(r["key"], r["at"]), key=lambda x: (x[1], x[2]))][-4:]
        assert r["xs"] == want


def test_bucketed_prefix_both_directions(rows):
    for cuts in (px.measure_cuts(rows, "seq"), px.measure_cuts(rows, "seq", per_task=1)):
        for descending in (False, True):
            got = px.bucketed_prefix(rows, ["seq"], {"s": F.col("v")}, descending=descending, cuts=cuts)
            for r in got.collect():
                before = [x[3] for x in ROWS if (x[2] > r["seq"] if descending else x[2] < r["seq"])]
                assert r["s"] == pytest.approx(sum(before))


@pytest.mark.parametrize("per_task", [None, 5])
def test_decayed_prefix(rows, per_task):
    probes = rows.select("key", "at", "seq")
    got = px.decayed_prefix(rows, probes, ["key"], "at", F.col("v"), 5.0, "d", per_task=per_task)
    for r in got.collect():
        want = sum(x[3] * math.exp(-(r["at"] - x[1]) / 5.0) for x in past(r["key"], r["at"]))
        assert r["d"] == pytest.approx(want, abs=1e-9)


def test_orders(rows):
    for r in running_max(rows, ["seq"], "v", "m").collect():
        before = [x[3] for x in ROWS if x[2] < r["seq"]]
        assert r["m"] == (max(before) if before else None)
    for r in previous_value(rows, ["key"], ["seq"], "v", "p").collect():
        before = [x for x in ROWS if x[0] == r["key"] and x[2] < r["seq"]]
        assert r["p"] == (before[-1][3] if before else None)
    index = {r["key"]: r["index"] for r in first_seen_index(rows, [F.col("key")], ["seq"]).collect()}
    seen = list(dict.fromkeys(x[0] for x in ROWS))
    assert [index[k] for k in seen] == list(range(len(seen)))


def document(spark, rows):
    return spark.createDataFrame(
        rows,
        "event_id string, event_us bigint, seq bigint, kind string, source string, destination string, amount double",
    )


def minute(m):
    return int(m * 60_000_000)


TIES = [
    ("a", minute(0), 0, "payment", "x", "y", 100.0),
    ("b", minute(0), 1, "payment", "x", "y", 200.0),
    ("c", minute(60), 2, "payment", "x", "z", 100.0),
    ("d", minute(60.001), 3, "payment", "x", "y", 100.0),
]


def test_ties_and_window_boundary(spark):
    names = ["sender_out_count", "sender_recent_out_count", "sender_recent_out_value"]
    got = {r["event_id"]: r for r in payment_features(document(spark, TIES), names).collect()}

    def raw(name, scale):
        return [round(math.expm1(got[i][name] * scale), 6) for i in "abcd"]

    assert raw("sender_out_count", 6) == [0, 0, 2, 3]
    assert raw("sender_recent_out_count", 4) == [0, 0, 2, 1]
    assert raw("sender_recent_out_value", 10) == [0, 0, 300, 100]


def test_future_rows_and_tie_order_change_nothing(spark):
    base = {r["event_id"]: r.asDict() for r in payment_features(document(spark, TIES)).collect()}
    more = [*TIES, ("e", minute(90), 4, "payment", "y", "x", 5.0), ("f", minute(61), 5, "deposit", None, "x", 1.0)]
    swapped = [(*r[:2], 1 - r[2], *r[3:]) if r[2] < 2 else r for r in more]
    for rows in (more, swapped):
        got = {r["event_id"]: r.asDict() for r in payment_features(document(spark, rows)).collect()}
        for key, row in base.items():
            assert {k: v for k, v in got[key].items() if k != "seq"} == {k: v for k, v in row.items() if k != "seq"}


def test_hot_accounts_give_the_same_features(spark, sf):
    from ledgerlark.catalog.base import pay_events

    payments = pay_events(spark, sf).withColumn(
        "source", F.when(F.col("source").isNotNull() & (F.col("seq") % 3 == 0), "account:hub").otherwise(F.col("source"))
    )
    plain = {r["event_id"]: r.asDict() for r in payment_features(payments).collect()}
    split = {r["event_id"]: r.asDict() for r in payment_features(payments, per_task=40).collect()}
    assert plain.keys() == split.keys()
    for key, row in plain.items():
        assert split[key] == pytest.approx(row)


def test_window_tasks_hold_a_bounded_number_of_rows(spark, monkeypatch):
    rows = [(f"k{i % 50}", i // 3, i, i % 7) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k string, at bigint, i bigint, v bigint")
    asked = frame.select("k", "at", F.col("i").alias("probe"))

    def both():
        summed = px.strict_prefix(frame, ["k"], "at", {"s": F.col("v")}, size=3000)
        last = px.asof_last_k(frame, asked, ["k"], "at", "i", F.col("v"), 3, size=6000)
        return summed, last

    plain = [sorted(map(repr, df.collect())) for df in both()]
    monkeypatch.setattr(px, "WINDOW_ROWS", 100)
    dealt = both()
    # Four tasks, the session's number, before.
    assert [df.rdd.getNumPartitions() for df in dealt] == [30, 60]
    assert [sorted(map(repr, df.collect())) for df in dealt] == plain
