"""A prepared stream is refused when any stored row is not what was written."""

import pytest
from pyspark.sql import functions as F

from ledgerlark.catalog.inputs import _stream_of
from ledgerlark.session import scratch_dir
from ledgerlark.sources import store


@pytest.fixture()
def path(spark, sf):
    path = scratch_dir(spark, "prepared-test")
    store.write_prepared(_stream_of(spark, sf), path)
    return path


def replace(spark, path, part, change):
    rows = spark.read.parquet(f"{path}/{part}")
    changed = spark.createDataFrame(change(rows).collect(), rows.schema)
    changed.write.mode("overwrite").parquet(f"{path}/{part}")


def test_untouched_and_rewritten_files_open(spark, path):
    assert store.open_prepared(spark, path).events.count() == 1500
    replace(spark, path, "events", lambda df: df.orderBy(F.desc("arrival_seq")))
    assert store.open_prepared(spark, path).events.count() == 1500


@pytest.mark.parametrize("change,says", [
    (lambda df, one: df.withColumn("features", F.when(F.col("event_id") == one, F.create_map(F.lit("amount"), F.lit(1.5).cast("decimal(15,2)"))).otherwise(F.col("features"))), "content changed"),
    (lambda df, one: df.filter(F.col("event_id") != one), "are there"),
    (lambda df, one: df.union(df.filter(F.col("event_id") == one)), "are there"),
])
def test_changed_lost_and_added_events_are_refused(spark, path, change, says):
    first = spark.read.parquet(f"{path}/events").orderBy("event_us", "arrival_seq").first()
    kind = spark.read.parquet(f"{path}/events").schema["features"].dataType.valueType
    replace(spark, path, "events", lambda df: change(df, first.event_id).withColumn("features", F.col("features").cast(f"map<string,{kind.simpleString()}>")))
    with pytest.raises(ValueError, match=f"events, range 0 from {first.event_us} .*{says}"):
        store.open_prepared(spark, path)
    assert store.open_prepared(spark, path, check=False).events.count() > 0


def test_a_swapped_label_is_refused(spark, path):
    replace(spark, path, "outcomes", lambda df: df.withColumn("label", F.when(F.col("event_id") == "1", 1 - F.abs("label")).otherwise(F.col("label"))))
    with pytest.raises(ValueError, match="outcomes, range"):
        store.open_prepared(spark, path)
