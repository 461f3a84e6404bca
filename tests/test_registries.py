"""Scorers and heads of one's own, and the certificate of a logistic fit."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import scoring as so


def test_scorer_is_frozen_and_checked(spark):
    train = spark.createDataFrame([(1.0, 1), (3.0, 1), (0.0, 0)], "x double, label int")
    fit = lambda rows, names: {"top": rows.agg(F.max(names[0])).first()[0]}
    scorer = so.arrow_scorer("test-share", fit, lambda state, x: x["x"] / state["top"])
    state = scorer.fit(train, ["x"])
    assert json.loads(state) == {"scorer": "test-share", "features": ["x"], "state": {"top": 3.0}}
    asked = spark.createDataFrame([("a", 1.5, 7), ("b", None, 8)], "event_id string, x double, extra int")
    got = {r.event_id: r.probability for r in scorer.predict(asked, state).collect()}
    assert got["a"] == 0.5 and (got["b"] is None or got["b"] != got["b"])
    assert scorer.predict(asked.limit(0), state).collect() == []
    with pytest.raises(ValueError):
        so.arrow_scorer("test-share", fit, lambda state, x: x["x"])
    with pytest.raises(ValueError):
        scorer.predict(asked, json.dumps({"scorer": "other"}))
    with pytest.raises(Exception, match="between zero and one"):
        scorer.predict(asked.withColumn("x", F.lit(9.0)), state).collect()


def test_head(spark):
    head = so.arrow_head("test-above", lambda ref: {"m": ref.agg(F.avg("logit")).first()[0]}, lambda s, x: x - s["m"])
    rows = spark.createDataFrame([(1.0,), (3.0,)], "logit double")
    assert sorted(r.score for r in head.score(rows, rows).collect()) == [-1.0, 1.0]
    with pytest.raises(ValueError):
        head.score(rows, None)


@pytest.mark.parametrize("balanced", [False, True])
def test_gradient_vanishes_at_the_optimum_alone(spark, balanced):
    rows = [(float(i % 7), float(i % 5) * 10, 1 if (i * 7919) % 11 + i % 7 > 9 else 0 if i % 9 else -1) for i in range(300)]
    train = spark.createDataFrame(rows, "x double, y double, label int")
    model = so.fit_logistic(train, ["x", "y"], balanced=balanced)
    at = so.logistic_gradient(train, model, balanced=balanced).collect()
    assert [r.feature for r in at] == ["x", "y", "intercept"]
    assert all(abs(r.gradient) < 1e-6 for r in at)
    moved = so.LogisticModel(model.features, model.mean, model.scale, (model.weights[0] + 0.01, model.weights[1]), model.bias)
    assert max(abs(r.gradient) for r in so.logistic_gradient(train, moved, balanced=balanced).collect()) > 1e-4
