"""Durable tables: prepared streams, feature tables and variants, as-of training tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.scalars import mask_label
from ledgerlark.operators.metrics import dataset_fingerprint, label_availability_kind
from ledgerlark.operators.splits import chronological_split, label_cutoffs
from ledgerlark.plans.prefix import BUCKET, Cuts, measure_cuts, with_scalars
from ledgerlark.schema import Descriptor, Stream
from ledgerlark.sources.csv_layouts import validate_events

STREAM_TAG = "transaction-stream/v1"
FEATURE_TAG = "feature-table/v1"


def _write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(
        1
    ).write.mode("errorifexists").text(path)


def _read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


#: Ranges of outcomes, which have no time of their own, are shares of the hashed ids.
OUTCOME_RANGES = 64


def range_digests(stream: Stream, cuts: Cuts) -> DataFrame:
    """(part, range, rows, total, mix, low, high): a digest of all columns of the rows of every range.

    Events are cut by time, outcomes by hashed id. Digests are sums and exclusive ors of row hashes: they don't depend on
    files or order, and those of neighbouring ranges add up. ``low`` and ``high`` are the times in the range.
    """

    def of(part: str, df: DataFrame, at: Column) -> DataFrame:
        row = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns) if c != BUCKET]))
        return df.groupBy(F.lit(part).alias("part"), F.col(BUCKET).cast("int").alias("range")).agg(
            F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("total"),
            F.bit_xor(F.xxhash64(row, F.lit("mix"))).alias("mix"), F.min(at).alias("low"), F.max(at).alias("high"),
        )

    outcomes = stream.outcomes.withColumn(BUCKET, F.pmod(F.xxhash64("event_id"), F.lit(OUTCOME_RANGES)))
    none = F.lit(None).cast("bigint")
    return of("events", cuts.add(stream.events, "event_us"), F.col("event_us")).union(of("outcomes", outcomes, none))


def changed_ranges(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Ranges whose rows are not those of the manifest, with the stored and the found number of rows and times."""
    keys = ["part", "range"]
    now = found.select(*keys, *[F.col(c).alias("now_" + c) for c in found.columns if c not in keys])
    same = F.col("rows").eqNullSafe(F.col("now_rows")) & F.col("total").eqNullSafe(F.col("now_total")) & F.col("mix").eqNullSafe(F.col("now_mix"))
    return stored.join(now, keys, "full").filter(~same).orderBy(*keys)


def write_prepared(stream: Stream, path: str) -> None:
    """Events in chronological files, outcomes apart, digests per time range, and a one-row manifest. Never overwrites."""
    spark = stream.events.sparkSession
    (
        stream.events.repartitionByRange("event_us", "arrival_seq")
        .sortWithinPartitions("event_us", "arrival_seq")
        .write.mode("errorifexists")
        .parquet(f"{path}/events")
    )
    stream.outcomes.write.mode("errorifexists").parquet(f"{path}/outcomes")
    kept = Stream(stream.descriptor, spark.read.parquet(f"{path}/events"), spark.read.parquet(f"{path}/outcomes"))
    cuts = measure_cuts(kept.events, "event_us")
    range_digests(kept, cuts).coalesce(1).write.mode("errorifexists").parquet(f"{path}/digests")  # a row per range
    written = kept.events.count()
    if not written:
        raise ValueError("the source contains no transactions")
    kind = label_availability_kind(stream.outcomes).first()["availability"]
    manifest = {
        "tag": STREAM_TAG,
        "rows": written,
        "cuts": {"bounds": list(cuts.bounds), "fine": cuts.fine},
        "descriptor": asdict(stream.descriptor),
        "label_availability": kind,
    }
    _write_manifest(spark, f"{path}/manifest", manifest)


def open_prepared(spark: SparkSession, path: str, check: bool = True) -> Stream:
    """Open a prepared stream; ``check`` re-reads it against the digests of its ranges and its rules.

    A changed, lost or added row is refused, and the error names its range.
    """
    manifest = _read_manifest(spark, f"{path}/manifest")
    if manifest.get("tag") != STREAM_TAG:
        raise ValueError("not a prepared transaction stream")
    fields = dict(manifest["descriptor"])
    for name in ("entity_types", "feature_names"):
        fields[name] = tuple(fields[name])
    stream = Stream(
        Descriptor(**fields),
        spark.read.parquet(f"{path}/events"),
        spark.read.parquet(f"{path}/outcomes"),
    )
    if check:
        cuts = Cuts(tuple(manifest["cuts"]["bounds"]), manifest["cuts"]["fine"])
        stored = spark.read.parquet(f"{path}/digests")
        if changed := changed_ranges(stored, range_digests(stream, cuts)).limit(1).collect():
            r = changed[0]
            times = [t for t in (r["low"], r["now_low"], r["high"], r["now_high"]) if t is not None]
            span = f" from {min(times)} to {max(times)} microseconds" if times else ""
            raise ValueError(f"{r['part']}, range {r['range']}{span}: {r['rows'] or 0} rows were written, {r['now_rows'] or 0} are there, or their content changed")
        bad = validate_events(stream).limit(1).collect()
        if bad:
            raise ValueError(f"event {bad[0]['event_id']}: {bad[0]['rule']}")
    return stream


def scan_interval(events: DataFrame, start: float | None = None, stop: float | None = None) -> DataFrame:
    """Events with start <= time < stop. The filter reaches the Parquet row groups."""
    for bound in (start, stop):
        if bound is not None and bound != bound:
            raise ValueError("bounds must be finite seconds")
    if start is not None and stop is not None and start >= stop:
        raise ValueError("the interval start must precede its stop")
    if start is not None:
        events = events.filter(F.col("event_time") >= start)
    if stop is not None:
        events = events.filter(F.col("event_time") < stop)
    return events


def chronological_batches(events: DataFrame, batches: int) -> DataFrame:
    """Events range-partitioned by time and sorted inside each partition, ready for mapInArrow."""
    return events.repartitionByRange(batches, "event_us", "arrival_seq").sortWithinPartitions(
        "event_us", "arrival_seq"
    )


def truth_for(outcomes: DataFrame, ids: DataFrame) -> DataFrame:
    """Outcomes of the given ids; ids without an outcome are simply absent."""
    return outcomes.join(ids.select("event_id"), "event_id", "left_semi")


def write_features(
    features: DataFrame, names: Sequence[str], path: str, recipes: dict | None = None, parent: str | None = None
) -> dict:
    """Immutable feature table keyed by ``event_id`` with ordered names and a content fingerprint."""
    spark = features.sparkSession
    kept = [c for c in features.columns if c not in names]
    features.select(*kept, *names).write.mode("errorifexists").parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    manifest = {
        "tag": FEATURE_TAG,
        "names": list(names),
        "recipes": recipes or {},
        "parent": parent,
        "fingerprint": dataset_fingerprint(stored).first()["fingerprint"],
    }
    _write_manifest(spark, f"{path}/manifest", manifest)
    return manifest


def read_features(spark: SparkSession, path: str, check: bool = True) -> tuple[DataFrame, dict]:
    """Stored features and manifest; content, ids and values are verified on reading."""
    manifest = _read_manifest(spark, f"{path}/manifest")
    if manifest.get("tag") != FEATURE_TAG:
        raise ValueError("not a feature table")
    rows, names = spark.read.parquet(f"{path}/rows"), manifest["names"]
    if [c for c in rows.columns if c in names] != names:
        raise ValueError("stored columns differ from the manifest")
    if check:
        if dataset_fingerprint(rows).first()["fingerprint"] != manifest["fingerprint"]:
            raise ValueError("stored features changed after they were written")
        bad = F.lit(False)
        for name in names:
            value = F.col(name)
            bad = bad | value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
        if rows.filter(bad).limit(1).collect():
            raise ValueError("stored features must be finite")
        if rows.groupBy("event_id").count().filter("count > 1").limit(1).collect():
            raise ValueError("stored feature ids must be unique")
    return rows, manifest


def save_feature_variant(
    spark: SparkSession, source: str, names: Sequence[str], target: str
) -> dict:
    """A new table with a chosen, ordered subset of a stored table's features."""
    rows, manifest = read_features(spark, source)
    unknown = sorted(set(names) - set(manifest["names"]))
    if unknown or len(set(names)) != len(names) or not names:
        raise ValueError(f"choose distinct stored features; unknown: {unknown}")
    kept = [c for c in rows.columns if c not in manifest["names"]]
    recipes = {n: v for n, v in manifest["recipes"].items() if n in names}
    return write_features(rows.select(*kept, *names), names, target, recipes, source)


def stage_asof_table(
    numeric: DataFrame, train: float = 0.6, validation: float = 0.2
) -> tuple[DataFrame, DataFrame]:
    """Training table whose labels are masked by what was known before the next partition.

    ``numeric`` has id columns, ``event_us``, ``label`` and ``available_us``. The second result
    counts the masked labels per partition.
    """
    parts = chronological_split(numeric, train, validation)
    limits = label_cutoffs(parts, ["train", "validation", "test"])
    staged = parts.join(F.broadcast(limits), "partition", "left").withColumn(  # one row per partition
        "__masked", mask_label(F.col("label"), F.col("available_us"), F.col("cutoff_us"))
    )
    counts = staged.groupBy("partition").agg(
        F.count_if((F.col("label") >= 0) & (F.col("__masked") < 0)).alias("masked"),
        F.count(F.lit(1)).alias("rows"),
    )
    return staged.withColumn("label", F.col("__masked")).drop("__masked", "cutoff_us"), counts


VIEWS = {"numeric": False, "stream": False, "graph": True, "labeled_graph": True, "payments": True}


def inspect_dataset(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: rows, outcome counts, recorded availability and time range."""
    return events.join(outcomes, "event_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("label") >= 0).alias("known"),
        F.count_if(F.col("label") == 1).alias("fraud"),
        F.count_if(F.col("label") == 0).alias("legitimate"),
        F.count_if(F.col("label") < 0).alias("unknown"),
        F.count_if((F.col("label") >= 0) & F.col("available_at").isNotNull()).alias(
            "recorded_availability"
        ),
        F.min("event_time").alias("first_seconds"),
        F.max("event_time").alias("last_seconds"),
    )


def supported_views(descriptor: Descriptor) -> list[str]:
    """Views a source can serve: those over relations need entity identities."""
    return [view for view, relational in VIEWS.items() if descriptor.graph or not relational]


def interval_guard(
    events: DataFrame, max_events: int = 20_000, max_entities: int = 256
) -> DataFrame:
    """Counts of an interval and whether it is within the limits; nothing is truncated."""
    entities = events.select(F.explode("entities").alias("e")).agg(
        F.count_distinct("e.kind", "e.id").alias("entities")
    )
    counted = with_scalars(events.agg(F.count(F.lit(1)).alias("events")), entities)
    return counted.withColumn(
        "within_limits", (F.col("events") <= max_events) & (F.col("entities") <= max_entities)
    )


def guard_interval(events: DataFrame, max_events: int = 20_000, max_entities: int = 256) -> DataFrame:
    """The events as they are, or an error if the interval is larger than the limits; nothing is truncated."""
    row = interval_guard(events, max_events, max_entities).first()
    if not row["within_limits"]:
        raise ValueError(
            f"the interval holds {row['events']} events of {row['entities']} entities; "
            f"at most {max_events} of {max_entities} are allowed: choose a shorter one"
        )
    return events
