"""Probes of as-of lookups and decayed sums carry their keys once, and come back with the columns they had."""

import math

from pyspark.sql import functions as F

from ledgerlark.plans import prefix


def history(spark):
    rows = [("a", 1, 0, 10), ("a", 5, 1, 11), ("b", 2, 2, 12)]
    return spark.createDataFrame(rows, "acc string, us long, seq long, v long")


def test_decayed_probes_carry_keys_once(spark, monkeypatch):
    seen, strict = [], prefix.strict_prefix

    def watched(rows, *args, **kwargs):
        seen.append(rows.schema["__probe"].dataType.names)
        return strict(rows, *args, **kwargs)

    monkeypatch.setattr(prefix, "strict_prefix", watched)
    probes = spark.createDataFrame([("x", "a", 6, 1.5), ("y", "c", 6, None)], "id string, acc string, us long, w double")
    found = prefix.decayed_prefix(history(spark), probes, ["acc"], "us", F.lit(1.0), 10.0)
    assert seen == [["id", "w"]]
    assert found.columns == ["id", "acc", "us", "w", "decayed"]
    got = {r.id: r for r in found.collect()}
    assert got["x"][1:4] == ("a", 6, 1.5) and math.isclose(got["x"].decayed, math.exp(-0.5) + math.exp(-0.1))
    assert got["y"][1:] == ("c", 6, None, 0.0)


def test_probes_of_keys_alone_and_of_another_type(spark):
    probes = spark.createDataFrame([(6, "a"), (6, None), (1, "a")], "us int, acc string")
    found = prefix.asof_last_k(history(spark), probes, ["acc"], "us", "seq", F.col("v"), 2)
    assert found.dtypes[:2] == [("us", "int"), ("acc", "string")]
    assert sorted((r.us, r.acc or "", r["items"]) for r in found.collect()) == [(1, "a", []), (6, "", []), (6, "a", [10, 11])]
    found = prefix.decayed_prefix(history(spark), probes, ["acc"], "us", F.lit(1.0), 10.0)
    assert found.dtypes[:2] == [("us", "int"), ("acc", "string")] and found.count() == 3


def test_lookup_deals_rows_once_and_before_there_are_lists(spark):
    probes = spark.createDataFrame([("x", "a", 6), ("y", "c", 6)], "id string, acc string, us long")
    found = prefix.asof_last_k(history(spark), probes, ["acc"], "us", "seq", F.col("v"), 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert {r.id: r["items"] for r in found.collect()} == {"x": [10, 11], "y": []}
