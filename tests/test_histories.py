import math
import random

import numpy as np
import pytest

from ledgerlark.operators import experiments as ex
from ledgerlark.operators import histories as hs
from ledgerlark.operators import joins as jn
from ledgerlark.session import scratch_dir
from ledgerlark.streaming.feedback import late_event_audit

WEIGHTS, MIX = hs.projection(3, 8), hs.projection(3, 7, seed=5)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    made = []
    for i in range(60):
        a, b = rng.sample("pqrst", 2)
        made.append((str(i), (i // 2) * 7 * 60_000_000, i, "payment", a, b, float(rng.randrange(1, 400))))
    return made


@pytest.fixture(scope="module")
def payments(spark, rows):
    return spark.createDataFrame(
        rows, "event_id string, event_us bigint, seq bigint, kind string, source string, destination string, amount double"
    )


def incidents(rows, node, us):
    found = []
    for _, at, seq, _, a, b, amount in rows:
        if at < us:
            if a == node:
                found.append((at, 2 * seq, b, -1, amount))
            if b == node:
                found.append((at, 2 * seq + 1, a, 1, amount))
    return sorted(found)


def vector(rows, node, us):
    total, out = 0.0, np.zeros(3)
    for at, _, _, role, amount in incidents(rows, node, us)[-8:]:
        age = (us - at) / 60e6
        w = math.exp(-age / 720)
        basis = [1, role, math.log1p(amount) / 8, min(age / 720, 4), math.sin(age / 60), math.cos(age / 60),
                 math.sin(age / 1440), math.cos(age / 1440)]
        out += w * (np.array(WEIGHTS) @ basis)
        total += w
    return np.tanh(out / total) if total else out


def mixed(rows, node, us, depth):
    base = vector(rows, node, us)
    if not depth:
        return base
    total, extra, seen = 0.0, np.zeros(3), set()
    for at, _, other, role, amount in incidents(rows, node, us)[-4:][::-1]:
        if other in seen:
            continue
        seen.add(other)
        age = (us - at) / 60e6
        w = math.exp(-age / 720)
        edge = [role, math.log1p(amount) / 8, min(age / 720, 4), 1.0]
        extra += w * np.tanh(np.array(MIX) @ np.concatenate([mixed(rows, other, us, depth - 1), edge]))
        total += w
    return np.tanh(base + extra / total) if total else base


def test_neighborhood_vector(payments, rows):
    probes = payments.selectExpr("event_id", "source as account", "event_us")
    got = hs.neighborhood_vector(payments, probes, WEIGHTS, MIX).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["vector"] == pytest.approx(list(mixed(rows, r["account"], r["event_us"], 2)), abs=1e-9)


def test_negative_destinations(payments, rows):
    from ledgerlark.operators.graph import negative_destinations

    got = {r["event_id"]: r["negative"] for r in negative_destinations(payments).collect()}
    for key, us, _, _, source, _, _ in rows:
        seen = {r[5] for r in rows if r[1] <= us}
        allowed = seen - {source} - {r[5] for r in rows if r[1] == us and r[4] == source}
        assert got[key] in allowed if allowed else got[key] is None


def test_used_rows_are_refused(spark):
    rows = [(str(i), i // 2, i % 2, float(i % 7), float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id string, event_us bigint, label int, a double, b double")
    path = scratch_dir(spark, "artifact")
    ex.train_experiment(spark, df, ["a", "b"], path)
    _, _, facts = ex.evaluate_artifact(spark, path, df)
    assert facts["same_dataset"] and facts["overlapping_rows"] == 0
    renamed = df.selectExpr("concat('copy', event_id) as event_id", "event_us", "label", "a", "b")
    with pytest.raises(ValueError, match="used to fit"):
        ex.compare_runs(spark, {"m": path}, renamed, partition="all")
    with pytest.raises(ValueError, match="choose its test partition"):
        ex.compare_runs(spark, {"m": path}, df, partition="all")


def test_population_check(spark):
    events = spark.createDataFrame([("a", 1), ("b", 2)], "event_id string, event_us bigint")
    outcomes = spark.createDataFrame([("a", 1, None)], "event_id string, label int, available_at double")
    good = spark.createDataFrame([("a", 0.5), ("b", 0.1)], "event_id string, score double")
    labels = {r["event_id"]: r["label"] for r in jn.join_predictions(events, outcomes, good).collect()}
    assert labels == {"a": 1, "b": -1}
    with pytest.raises(ValueError, match="do not match"):
        jn.join_predictions(events, outcomes, good.limit(1))


def test_late_rows_go_aside(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for number, times in enumerate([[1, 5], [3, 9], [9, 8]]):
        frame = spark.createDataFrame([(t,) for t in times], "event_us bigint").coalesce(1)
        frame.write.mode("append").parquet(source)
        run = late_event_audit(
            spark.readStream.schema("event_us bigint").parquet(source), out, str(tmp_path / "state")
        ).trigger(availableNow=True).start()
        run.awaitTermination()
    late = sorted(r["event_us"] for r in spark.read.parquet(f"{out}/late").collect())
    kept = sorted(r["event_us"] for r in spark.read.parquet(f"{out}/accepted").collect())
    assert (late, kept) == ([3, 8], [1, 5, 9, 9])


def test_levels_and_kinds_share_their_lookups(payments, rows, monkeypatch):
    asked = []
    for name in ("last_neighbors", "last_pair_payments"):
        def watched(*args, plain=getattr(hs, name), name=name, **kwargs):
            asked.append(name)
            return plain(*args, **kwargs)

        monkeypatch.setattr(hs, name, watched)
    probes = payments.selectExpr("event_id", "source as account", "event_us")
    assert hs.neighborhood_vector(payments, probes, WEIGHTS, MIX).count() == len(rows)
    both = {r["event_id"]: r for r in hs.surprise_bits(payments).collect()}
    assert asked == ["last_neighbors"] * 3 + ["last_pair_payments"]
    for part in ("amount", "gap"):
        for r in getattr(hs, f"{part}_surprise_bits")(payments).collect():
            assert both[r["event_id"]][f"{part}_bits"] == pytest.approx(r["bits"])
