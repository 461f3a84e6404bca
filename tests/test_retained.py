"""Features over a bounded number of retained events against a plain deque."""

import math
import random
from collections import deque

import pytest

from ledgerlark.operators.features import PAYMENT_FEATURES, payment_features
from ledgerlark.operators.retained import retained_features

HOUR = 3_600_000_000
KIND = "event_id string, event_us bigint, seq bigint, kind string, source string, destination string, amount double"


def made(n=240):
    rng = random.Random(8)
    rows, at = [], 5
    for i in range(n):
        at += rng.choice([0, 0, 1, 600_000_000, HOUR // 2, HOUR, 2 * HOUR])
        kind = rng.choice(["payment"] * 5 + ["deposit", "login"])
        a = rng.choice(["hot", "hot", "b", "c"])
        b = rng.choice(["hot", "b", "c", "d"])
        source = None if kind != "payment" or rng.random() < 0.05 else a
        destination = None if kind == "payment" and source and rng.random() < 0.05 else b
        rows.append((f"e{i}", at, i, kind, source, destination, float(rng.randrange(1, 90_000)) / 4))
    return rows


def plain(rows, limit, freeze=None):
    """(event_id: figures) by walking over the stream with a bounded memory."""
    memory, out = deque(maxlen=limit), {}
    for at in sorted({r[1] for r in rows}):
        group = [r for r in rows if r[1] == at]
        asked = at if freeze is None else min(at, freeze)
        for event, _, _, kind, source, destination, amount in group:
            if kind != "payment":
                continue
            paid = [m for m in memory if m[3] == "payment" and m[4] is not None and m[5] is not None]
            touched = lambda x: [m for m in memory if m[3] in ("payment", "deposit") and x is not None and x in (m[4], m[5])]
            figures = {}
            for side, x in (("sender", source), ("recipient", destination)):
                for name, column in (("out", 4), ("in", 5)):
                    own = [m for m in paid if x is not None and m[column] == x]
                    late = [m for m in own if m[1] >= asked - HOUR]
                    figures |= {f"{side}_{name}_count": len(own) , f"{side}_{name}_value": sum(m[6] for m in own)}
                    figures |= {f"{side}_recent_{name}_count": len(late), f"{side}_recent_{name}_value": sum(m[6] for m in late)}
                seen = touched(x)
                figures[f"{side}_seen"] = len(seen)
                figures[f"{side}_gap"] = (at - max(m[1] for m in seen)) / 60e6 if seen else 0
            known = source is not None and destination is not None
            figures["pair_out_count"] = sum((m[4], m[5]) == (source, destination) for m in paid) if known else 0
            figures["pair_total_count"] = figures["pair_out_count"] + (sum((m[5], m[4]) == (source, destination) for m in paid) if known else 0)
            out[event] = figures
        if freeze is None or at < freeze:
            memory.extend(sorted(group, key=lambda r: r[2]))
    return out


SCALES = {"count": 6, "value": 10, "seen": 6, "gap": 6}


@pytest.mark.parametrize("limit,per_task,frozen", [(1, None, False), (7, 20, False), (40, 20, True), (40, None, False)])
def test_features_see_the_last_events_only(spark, limit, per_task, frozen):
    rows = made()
    freeze = rows[150][1] if frozen else None
    df = spark.createDataFrame(rows, KIND).repartition(5)
    got = {r.event_id: r for r in retained_features(df, limit, freeze_us=freeze, per_task=per_task).collect()}
    want = plain(rows, limit, freeze)
    assert set(got) == set(want)
    for event, figures in want.items():
        for name, value in figures.items():
            scale = 3 if name.startswith("pair") else 4 if name.endswith("count") and "recent" in name else SCALES[name.rsplit("_", 1)[1]]
            assert math.isclose(got[event][name], math.log1p(value) / scale, abs_tol=1e-9), (event, name)
        assert got[event].prior_contact == float(figures["pair_total_count"] > 0)


def test_a_long_memory_equals_the_whole_history(spark):
    rows = [r for r in made(120) if r[4] != r[5]]
    df = spark.createDataFrame(rows, KIND)
    whole = {r.event_id: r for r in payment_features(df).collect()}
    for r in retained_features(df, 10_000).collect():
        assert all(math.isclose(r[n], whole[r.event_id][n], abs_tol=1e-9) for n in PAYMENT_FEATURES)


def test_limits_and_empty_streams(spark):
    empty = spark.createDataFrame([], KIND)
    assert retained_features(empty, 5).collect() == []
    with pytest.raises(ValueError):
        retained_features(empty, 0)


def test_the_stream_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.createDataFrame(made(), KIND).mapInPandas(counted, KIND)
    assert retained_features(df, 40).count() > 0
    assert seen.value == 240  # several times that before
