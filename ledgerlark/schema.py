"""Tables of the library.

``events``    event_id STRING, event_time DOUBLE (seconds), event_us BIGINT (order key),
              event_type STRING, entities ARRAY<STRUCT<kind, id, role>>,
              features MAP<STRING, DOUBLE>, arrival_seq BIGINT
``outcomes``  event_id STRING, label INT (-1 unknown, 0, 1), available_at DOUBLE (NULL =
              retrospective), diagnostics MAP<STRING, STRING>; always a separate table
``payments``  event_id, event_us, seq, kind (payment, deposit, report), source, destination,
              amount, and optionally settled; source and destination are typed text keys

The rules every operator keeps: an event's history is what has a strictly smaller ``event_us``;
the 60-minute window contains its lower boundary; outcomes and settlement never reach features;
later rows never change earlier ones; an unknown label is context, not a class.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("role", T.StringType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_time", T.DoubleType()),
        T.StructField("event_us", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("entities", T.ArrayType(ENTITY)),
        T.StructField("features", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("arrival_seq", T.LongType()),
    ]
)

OUTCOMES = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("available_at", T.DoubleType()),
        T.StructField("diagnostics", T.MapType(T.StringType(), T.StringType())),
    ]
)


@dataclass(frozen=True)
class Descriptor:
    """What a source declares about its event stream."""

    dataset_id: str
    version: str = "1"
    entity_types: tuple[str, ...] = ()
    feature_names: tuple[str, ...] = ("amount",)
    graph: bool = False
    currency: str | None = None
    source_unit: str = "seconds"
    extra: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Stream:
    """An ordered event table with its outcomes kept apart."""

    descriptor: Descriptor
    events: DataFrame
    outcomes: DataFrame


def role_id(role: str):
    """Id of the first entity with the given role, NULL when there is none."""
    return F.try_element_at(F.filter("entities", lambda e: e["role"] == role), F.lit(1))


def payments_of(stream: Stream, namespace: tuple[str, ...] = ()) -> DataFrame:
    """Flat payments of an event stream; every source transaction counts as a payment attempt.

    Endpoints are typed keys: JSON arrays of the namespace, the entity kind and the entity id.
    """
    if not stream.descriptor.graph:
        raise ValueError("the stream has no relational identities")
    source, destination = role_id("source"), role_id("destination")

    def key(entity):
        return F.to_json(F.array(*[F.lit(n) for n in namespace], entity["kind"], entity["id"]))

    return stream.events.select(
        "event_id",
        "event_us",
        F.col("arrival_seq").alias("seq"),
        F.lit("payment").alias("kind"),
        key(source).alias("source"),
        key(destination).alias("destination"),
        F.try_element_at("features", F.lit("amount")).alias("amount"),
    )
