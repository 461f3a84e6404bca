"""The online budget over a stream that arrives in many bounded ranges."""

import math
import random

from ledgerlark.session import scratch_dir
from ledgerlark.streaming import features as sft
from ledgerlark.streaming import feedback as sfb
from oracles import adaptive


def test_decisions_over_many_ranges(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(f"e{i}", rng.choice(["a", "a", "a", "b"]), 10 * i, float(rng.randrange(1000))) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id string, segment string, seq bigint, score double").repartition(7)
    monkeypatch.setattr(sfb.AdaptiveCutoff, "piece", 13)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sft.STATE_STORE)
    source, out, state = (scratch_dir(spark, f"budget-{n}") for n in ("source", "out", "state"))
    steps = []

    def step():
        stream = sfb.stream_adaptive_budget(spark.readStream.schema(df.schema).parquet(source), 0.05, 0.5, 20)
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        run.trigger(availableNow=True).start().awaitTermination()
        steps.append(1)

    sfb.in_request_order(df, source, step, most=250)
    assert len(steps) == 4
    got = {r.event_id: (r.decision, r.tau_before, r.tau_after) for r in spark.read.parquet(out).collect()}
    for segment in ("a", "b"):
        own = [r for r in rows if r[1] == segment]
        for r, (decision, before, after) in zip(own, adaptive([r[3] for r in own], 0.05, 0.5, 20)):
            near = lambda x, y: x is y or math.isclose(x, y, abs_tol=1e-9)
            assert got[r[0]][0] == decision and near(got[r[0]][1], before) and near(got[r[0]][2], after)


def test_query_takes_large_ranges(spark, sf, monkeypatch):
    from ledgerlark.catalog import models

    taken, kept = [], models.sfb.in_request_order

    def ranges(rows, path, step, order="seq", most=250_000, least=4):
        taken.append(most)
        kept(rows, path, step, order, most, least)

    monkeypatch.setattr(models.sfb, "in_request_order", ranges)
    assert models.stream_adaptive_budget(spark, sf).count() > 0
    # 3.6 million requests at 60 times sf0.1 start the stream four times (15 before).
    assert -(-3_600_000 // taken[0]) <= 4
