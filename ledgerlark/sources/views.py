"""Views over an event stream: feature projections, numeric tables, temporal graphs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.scalars import finite_number, to_micros, to_seconds
from ledgerlark.operators.metrics import label_availability_kind
from ledgerlark.plans.ordering import first_seen_index
from ledgerlark.plans.prefix import global_rank, with_scalars
from ledgerlark.schema import Stream, payments_of
from ledgerlark.sources.csv_layouts import SEQ, scan_csv_files


def feature_columns(
    available: Sequence[str], names: Sequence[str], factor: float = 1.0
) -> list[Column]:
    """Columns for a distinct, ordered choice of observable features and ``log1p_amount``."""
    permitted = set(available) | ({"log1p_amount"} if "amount" in available else set())
    if not names or len(set(names)) != len(names) or set(names) - permitted:
        raise ValueError(f"choose distinct observable features out of {sorted(permitted)}")

    def value(name: str) -> Column:
        if name in ("amount", "log1p_amount"):
            amount = F.try_element_at("features", F.lit("amount")) * F.lit(float(factor))
            return F.log1p(amount) if name == "log1p_amount" else amount
        return F.try_element_at("features", F.lit(name))

    return [value(n).alias(n) for n in names]


def project_features(stream: Stream, names: Sequence[str], factor: float = 1.0) -> DataFrame:
    columns = feature_columns(stream.descriptor.feature_names, names, factor)
    return stream.events.select("event_id", "event_time", "event_us", "arrival_seq", *columns)


def numeric_view(stream: Stream, names: Sequence[str] | None = None) -> DataFrame:
    """Events with chosen features and their final label."""
    chosen = list(names or stream.descriptor.feature_names)
    return project_features(stream, chosen).join(
        stream.outcomes.select("event_id", "label"), "event_id"
    )


@dataclass(frozen=True)
class TemporalGraph:
    """``edges(event_id, time, event_us, src, dst, features...)`` with dense node ids and
    ``nodes(node, key)``; the clock starts at the first event of ``origin`` seconds."""

    edges: DataFrame
    nodes: DataFrame
    origin: DataFrame


def rebase_clock(df: DataFrame, time: str = "event_time", name: str = "time") -> tuple[DataFrame, DataFrame]:
    """Clock relative to the first event, and the one-row frame that holds the origin."""
    origin = df.agg(F.min(time).alias("origin_seconds"))
    shifted = with_scalars(df, origin).withColumn(name, F.col(time) - F.col("origin_seconds"))
    return shifted.drop("origin_seconds"), origin


def _graph(rows: DataFrame, order: Sequence[str], features: Sequence[str]) -> TemporalGraph:
    index = first_seen_index(rows, [F.col("source"), F.col("destination")], order, "node")
    senders = index.select(F.col("key").alias("source"), F.col("node").alias("src"))
    recipients = index.select(F.col("key").alias("destination"), F.col("node").alias("dst"))
    timed, origin = rebase_clock(rows)
    edges = timed.join(senders, "source").join(recipients, "destination").select(
        "event_id", "time", "event_us", *order[-1:], "src", "dst", *features
    )
    return TemporalGraph(edges, index.select("node", "key"), origin)


def graph_view(stream: Stream, names: Sequence[str] = ("log1p_amount",)) -> TemporalGraph:
    """Event stream as a temporal graph; endpoint keys carry dataset, version, kind and id."""
    keyed = payments_of(stream, (stream.descriptor.dataset_id, stream.descriptor.version))
    values = project_features(stream, names).drop("event_us")
    rows = keyed.select("event_id", "event_us", "seq", "source", "destination").join(
        values.drop("arrival_seq"), "event_id"
    )
    return _graph(rows, ["event_us", "seq"], list(names))


def labeled_graph_view(
    graph: TemporalGraph, outcomes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Edges with label and availability on the graph clock, and the kind of availability."""
    timed = with_scalars(outcomes, graph.origin).select(
        "event_id", "label", (F.col("available_at") - F.col("origin_seconds")).alias("available_at")
    )
    edges = graph.edges.join(timed, "event_id", "left").withColumn(
        "label", F.coalesce("label", F.lit(-1))
    )
    return edges, label_availability_kind(edges)


def read_temporal_links(
    spark: SparkSession,
    paths,
    columns: dict[str, str] | None = None,
    features: Sequence[str] = (),
    time_unit: str = "seconds",
    node_features: DataFrame | None = None,
    edge_features: DataFrame | None = None,
    edge_index: str | None = None,
) -> TemporalGraph:
    """Mapped link CSV; feature tables are Parquet frames keyed by an integer ``index``."""
    columns = columns or {"id": "idx", "source": "u", "destination": "i", "time": "ts"}
    if set(features) & set(columns.values()) or len(set(features)) != len(features):
        raise ValueError("feature columns must be distinct from the mapped columns")
    if features and edge_features is not None:
        raise ValueError("choose CSV features or an edge feature table, not both")
    raw = scan_csv_files(spark, paths, [*columns.values(), *features])
    time = to_seconds(F.col(columns["time"]), time_unit)
    rows = raw.select(
        F.trim(columns["id"]).alias("event_id"),
        time.alias("event_time"),
        to_micros(time).alias("event_us"),
        F.col(SEQ).alias("seq"),
        F.trim(columns["source"]).alias("source"),
        F.trim(columns["destination"]).alias("destination"),
        *[finite_number(F.col(f)).alias(f) for f in features],
        F.trim(edge_index or columns["id"]).try_cast("bigint").alias("__edge"),
    )
    names = list(features)
    if edge_features is not None:
        names = [c for c in edge_features.columns if c != "index"]
        rows = lookup_indexed_features(rows, "__edge", edge_features)
    graph = _graph(rows, ["seq"], names)
    if node_features is not None:
        nodes = lookup_indexed_features(
            graph.nodes.withColumn("__native", F.col("key").try_cast("bigint")), "__native", node_features
        ).drop("__native")
        graph = TemporalGraph(graph.edges, nodes, graph.origin)
    return graph


def lookup_indexed_features(rows: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """Attach the feature row with the given integer index; every index must be covered."""
    uncovered = rows.join(table.select(F.col("index").alias(column)), column, "left_anti")
    if uncovered.limit(1).collect():
        raise ValueError(f"the feature table does not cover every {column}")
    return rows.join(table.withColumnRenamed("index", column), column)


def align_features_to_graph(edges: DataFrame, features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Replace edge features by stored ones. Ids must match one to one and times within 1e-7 s.

    Both frames have ``event_id``, ``time`` and ``label``.
    """
    left = edges.select("event_id", *[c for c in edges.columns if c not in (*names, "event_id")])
    right = features.select(
        F.col("event_id").alias("__id"), F.col("time").alias("__time"), F.col("label").alias("__label"), *names
    )
    joined = left.join(right, F.col("event_id") == F.col("__id"), "full")
    wrong = joined.filter(
        F.col("event_id").isNull()
        | F.col("__id").isNull()
        | (F.abs(F.col("time") - F.col("__time")) > 1e-7)
        | (F.col("label") != F.col("__label"))
    )
    if wrong.limit(1).collect():
        raise ValueError("stored feature rows do not match the graph")
    return joined.drop("__id", "__time", "__label")


def chronological_edges(graph: TemporalGraph) -> DataFrame:
    """Edges with their dense position in (time, input) order."""
    order = [c for c in ("event_us", "seq") if c in graph.edges.columns]
    return global_rank(graph.edges, order, "position")
