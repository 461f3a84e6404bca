"""Settled labels: each known label once, late ones and orphans as expired, whatever the cut into batches."""

import pytest
from pyspark.sql import functions as F

from ledgerlark.session import scratch_dir
from ledgerlark.streaming.feedback import closing_feedback, in_request_order, stream_settled_feedback

HOUR = 3_600_000_000
START = 473_000 * HOUR  # a watermark begins at 1970, what lies before it is late
# (event_id, hours from the start, kind, label)
FACTS = [
    ("a", 0, "event", -1), ("a", 0, "outcome", 1),  # at once
    ("b", 1, "event", -1), ("b", 25, "outcome", 0),  # exactly at the horizon
    ("c", 2, "event", -1), ("c", 27, "outcome", 1),  # an hour beyond it
    ("d", 5, "outcome", 1),  # no event
    ("e", 30, "event", -1), ("e", 29, "outcome", 0),  # before its event
    ("f", 31, "event", -1), ("f", 32, "outcome", -1),  # unknown
    (None, 33, "event", -1), (None, 34, "outcome", 1),  # no id
    ("g", 40, "event", -1), ("g", 41, "outcome", 0), ("g", 41, "outcome", 0),  # repeated
]
WANT = [
    (None, 1, "EXPIRED"), ("a", 1, "RELEASED"), ("b", 0, "RELEASED"), ("c", 1, "EXPIRED"), ("d", 1, "EXPIRED"),
    ("e", 0, "EXPIRED"), ("g", 0, "RELEASED"), ("g", 0, "RELEASED"),
]


def settle(spark, facts, least):
    schema = "event_id string, at_us bigint, kind string, label int"
    rows = spark.createDataFrame([(i, START + h * HOUR, k, v) for i, h, k, v in facts], schema)
    source, out, checkpoint = (scratch_dir(spark, n) for n in ("in", "out", "state"))

    def step():
        at = F.timestamp_micros("at_us")
        stream = spark.readStream.schema(schema).parquet(source)
        settled = stream_settled_feedback(
            stream.filter("kind = 'event'").select("event_id", at.alias("event_ts")),
            stream.filter("kind = 'outcome'").select("event_id", "label", at.alias("available_ts")), "24 hours",
        )
        run = settled.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        run.trigger(availableNow=True).start().awaitTermination()

    in_request_order(rows, source, step, "at_us", least=least)
    spark.createDataFrame(closing_feedback(START + 100 * HOUR, 100 * HOUR), schema).write.mode("append").parquet(source)
    step()
    got = spark.read.schema("event_id string, label int, event_ts timestamp, state string").parquet(out).collect()
    assert all((r.event_ts is None) == (r.state == "EXPIRED") for r in got)
    return sorted(((r.event_id, r.label, r.state) for r in got), key=lambda r: (r[0] or "", *r[1:]))


@pytest.mark.parametrize("least", [1, 4])
def test_every_known_label_once(spark, least):
    assert settle(spark, FACTS, least) == WANT


def test_empty_stream(spark):
    assert settle(spark, [], 1) == []


def test_query_takes_large_ranges(spark, sf, monkeypatch):
    from ledgerlark.catalog import models

    taken = []

    def ranges(rows, path, step, order="seq", most=250_000, least=4):
        taken.append(most)
        in_request_order(rows, path, step, order, most, least)

    monkeypatch.setattr(models.sfb, "in_request_order", ranges)
    assert models.stream_settled_feedback(spark, sf).count() > 0
    # 60 times sf0.1 has 10.6 million rows: six steps, each of which starts the stream anew (43 before).
    assert -(-10_600_000 // taken[0]) <= 6
