"""Entity graph: contacts, degrees, explorer tables, paging, components, sampled links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators.joins import last_neighbors, neighbor_edges
from ledgerlark.plans.prefix import (
    bucketed_prefix,
    global_rank,
    measure_cuts,
    plan_layout,
    strict_prefix,
    with_scalars,
)
from ledgerlark.session import written

# Page limits of the explorer.
MAX_NODES = 500
MAX_EDGES = 2000
MAX_SEARCH = 50


def _linking(payments: DataFrame) -> DataFrame:
    """Payments that add topology: two different accounts, no deposits, no reports."""
    return payments.filter(
        (F.col("kind") == "payment")
        & F.col("source").isNotNull()
        & F.col("destination").isNotNull()
        & (F.col("source") != F.col("destination"))
    )


def first_contacts(payments: DataFrame, directed: bool = False) -> DataFrame:
    """Unique edges with the time of their first payment: (src, dst, us), or undirected (lo, hi, us)."""
    rows = _linking(payments)
    if directed:
        return rows.groupBy(F.col("source").alias("src"), F.col("destination").alias("dst")).agg(
            F.min("event_us").alias("us")
        )
    return rows.groupBy(
        F.least("source", "destination").alias("lo"), F.greatest("source", "destination").alias("hi")
    ).agg(F.min("event_us").alias("us"))


def contact_ends(contacts: DataFrame) -> DataFrame:
    """Both ends of every contact: (node, other, us)."""
    return contacts.select(
        F.explode(
            F.array(
                F.struct(F.col("lo").alias("node"), F.col("hi").alias("other")),
                F.struct(F.col("hi").alias("node"), F.col("lo").alias("other")),
            )
        ).alias("e"),
        "us",
    ).select("e.*", "us")


def degree_before(contacts: DataFrame, probes: DataFrame, ends: bool = False) -> DataFrame:
    """Distinct contacts of each probe ``(node, us, ...)`` strictly before its time.

    With ``ends`` the contacts are given as rows (node, us) of both ends.
    """
    ends = (contacts if ends else contact_ends(contacts)).select("node", "us", F.lit(1).alias("__adds"))
    columns = [c for c in probes.columns if c not in ("node", "us")]
    rows = ends.unionByName(
        probes.select("node", "us", F.struct(*columns).alias("__probe"), F.lit(0).alias("__adds")),
        allowMissingColumns=True,
    )
    layout = plan_layout(rows, ["node"], "us")
    counted = strict_prefix(rows, ["node"], "us", {"degree": F.col("__adds")}, layout=layout)
    return counted.filter(F.col("__probe").isNotNull()).select("node", "us", "__probe.*", "degree")


def payment_ends(payments: DataFrame) -> DataFrame:
    """Probes for both ends of every payment: (node, us, event_id, side)."""
    rows = payments.filter(F.col("kind") == "payment")
    return rows.select(
        "event_id",
        F.col("event_us").alias("us"),
        F.explode(
            F.array(
                F.struct(F.lit("sender").alias("side"), F.col("source").alias("node")),
                F.struct(F.lit("recipient").alias("side"), F.col("destination").alias("node")),
            )
        ).alias("x"),
    ).select("x.node", "us", "event_id", "x.side")


def degree_features(payments: DataFrame) -> DataFrame:
    """log1p of the distinct contacts of sender and recipient before each payment."""
    counted = degree_before(first_contacts(payments), payment_ends(payments))
    return counted.groupBy("event_id").agg(
        F.log1p(F.max(F.when(F.col("side") == "sender", F.col("degree")))).alias("graph_sender_degree"),
        F.log1p(F.max(F.when(F.col("side") == "recipient", F.col("degree")))).alias(
            "graph_recipient_degree"
        ),
    )


def graph_summary(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts per node and edge type, and one row of totals with the time range."""
    types = (
        nodes.groupBy("type")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("element", F.lit("node"))
        .unionByName(
            edges.groupBy("type").agg(F.count(F.lit(1)).alias("count")).withColumn("element", F.lit("edge"))
        )
    )
    size = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    totals = with_scalars(
        edges.agg(F.count(F.lit(1)).alias("edges"), F.min("us").alias("first_us"), F.max("us").alias("last_us")),
        size,
    )
    return types, totals


def build_explorer(
    payments: DataFrame, accounts: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Explorer tables: nodes with search keys and degrees, edges with a dense sequence from 1.

    Keys are 'kind:id'. ``accounts(key, name)`` adds declared accounts, connected or not.
    """
    rows = payments.filter(
        (F.col("kind") == "payment") & F.col("source").isNotNull() & F.col("destination").isNotNull()
    )
    ranked = global_rank(
        rows.withColumnRenamed("seq", "arrival"), ["event_us", "arrival"], "position"
    )
    label = F.col("label") if "label" in payments.columns else F.lit(-1)
    edges = ranked.select(
        (F.col("position") + 1).alias("seq"),
        F.col("event_id").alias("id"),
        F.col("source").alias("src"),
        F.col("destination").alias("dst"),
        F.col("kind").alias("type"),
        F.col("event_us").alias("us"),
        label.alias("label"),
        "amount",
    )
    ends = rows.select(
        F.explode(
            F.array(
                F.struct(F.col("source").alias("key"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("destination").alias("key"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ).alias("e")
    ).select("e.*", F.lit(None).cast("string").alias("name"))
    if accounts is not None:
        ends = ends.unionByName(
            accounts.select("key", F.lit(0).alias("o"), F.lit(0).alias("i"), "name")
        )
    external = F.element_at(F.split("key", ":", 2), 2)
    nodes = (
        ends.groupBy("key")
        .agg(
            F.max("name").alias("name"),
            F.sum("o").cast("bigint").alias("out_degree"),
            F.sum("i").cast("bigint").alias("in_degree"),
        )
        .select(
            F.col("key").alias("node"),
            F.coalesce("name", external).alias("label"),
            F.element_at(F.split("key", ":", 2), 1).alias("type"),
            external.alias("external_id"),
            F.lower(F.coalesce("name", external)).alias("search_label"),
            F.lower(external).alias("search_external"),
            "out_degree",
            "in_degree",
        )
    )
    return nodes, edges


def _page(
    edges: DataFrame, nodes: DataFrame, offset: int, node_limit: int, edge_limit: int, existing: Sequence[str],
    filtered: bool,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, nodes, page info) of one page. A page is at most ``edge_limit`` + 1 rows by contract."""
    if not (1 <= node_limit <= MAX_NODES and 1 <= edge_limit <= MAX_EDGES):
        raise ValueError("page limits are out of range")
    spark = edges.sparkSession
    known = list(dict.fromkeys(existing))
    if len(known) > node_limit:
        raise ValueError("the selected and existing nodes exceed the node limit")
    if known:
        found = nodes.filter(F.col("node").isin(known)).count()
        if found != len(known):
            raise ValueError("unknown graph node")
    candidates = edges.filter(F.col("seq") > offset).orderBy("seq").limit(edge_limit + 1)
    rows = candidates.select("seq", "src", "dst").collect()
    selected = dict.fromkeys(known)
    cursor, reason, taken = offset, None, 0
    for row in rows:
        fresh = {row["src"], row["dst"]} - selected.keys()
        if len(selected) + len(fresh) > node_limit:
            reason = "node_limit"
            break
        if taken == edge_limit:
            reason = "edge_limit"
            break
        selected.setdefault(row["src"])
        selected.setdefault(row["dst"])
        cursor, taken = row["seq"], taken + 1
    page = edges.filter((F.col("seq") > offset) & (F.col("seq") <= cursor))
    if selected or rows or offset or filtered:
        chosen = nodes.filter(F.col("node").isin(list(selected)))
    else:
        chosen = nodes.orderBy("node").limit(node_limit)
    more = reason is not None
    info = spark.createDataFrame(
        [(offset, cursor if more and cursor > offset else None, more, reason)],
        "offset bigint, next_offset bigint, has_more boolean, limit_reason string",
    )
    return page, chosen, info


def _narrow(edges: DataFrame, start_us, stop_us, label, edge_type) -> tuple[DataFrame, bool]:
    used = False
    if start_us is not None and stop_us is not None and start_us > stop_us:
        raise ValueError("start must not exceed stop")
    for condition in (
        None if start_us is None else F.col("us") >= start_us,
        None if stop_us is None else F.col("us") < stop_us,
        None if label is None else F.col("label") == label,
        None if edge_type is None else F.col("type") == edge_type,
    ):
        if condition is not None:
            edges, used = edges.filter(condition), True
    return edges, used


def sample_edges(
    edges: DataFrame, nodes: DataFrame, offset: int = 0, node_limit: int = 100, edge_limit: int = 300,
    start_us: int | None = None, stop_us: int | None = None, label: int | None = None,
    edge_type: str | None = None, existing: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges after a cursor in sequence order, limited by edges and by distinct nodes."""
    narrowed, used = _narrow(edges, start_us, stop_us, label, edge_type)
    return _page(narrowed, nodes, offset, node_limit, edge_limit, existing, used)


def expand_neighbors(
    edges: DataFrame, nodes: DataFrame, node: str, direction: str = "both", offset: int = 0,
    node_limit: int = 100, edge_limit: int = 300, existing: Sequence[str] = (), **narrow,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same paging over the edges at one node."""
    narrowed, _ = _narrow(
        neighbor_edges(edges, node, direction),
        narrow.get("start_us"), narrow.get("stop_us"), narrow.get("label"), narrow.get("edge_type"),
    )
    return _page(narrowed, nodes, offset, node_limit, edge_limit, [*existing, node], True)


def search_nodes(nodes: DataFrame, text: str = "", limit: int = 20) -> DataFrame:
    """Prefix search on label or external id, or an exact node id; ``has_more`` on every row."""
    if len(text) > 200 or not 1 <= limit <= MAX_SEARCH:
        raise ValueError("search text or limit out of range")
    prefix = text.strip().lower()
    hits = nodes.filter(
        F.startswith(F.col("search_label"), F.lit(prefix))
        | F.startswith(F.col("search_external"), F.lit(prefix))
        | (F.col("node") == text)
    )
    top = hits.orderBy("search_label", "node").limit(limit + 1)
    numbered = top.withColumns(
        {
            "position": F.row_number().over(  # at most limit + 1 rows
                Window.partitionBy(F.lit(0)).orderBy("search_label", "node")
            ),
            "has_more": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) > limit,
        }
    )
    return numbered.filter(F.col("position") <= limit).select("node", "label", "type", "has_more")


# --- Connected components ---------------------------------------------------------------------


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(
        "ctx",
        F.explode(
            F.array(
                F.struct(F.col("a").alias("x"), F.col("b").alias("y")),
                F.struct(F.col("b").alias("x"), F.col("a").alias("y")),
            )
        ).alias("e"),
    ).select("ctx", "e.*")


def _jump(hooks: DataFrame) -> DataFrame:
    """Every pointer moves on to where its target points; ``moved`` says whether that was further."""
    ahead = hooks.select("ctx", F.col("node").alias("root"), F.col("root").alias("further"))
    return hooks.join(ahead, ["ctx", "root"]).select(
        "ctx", "node", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")
    )


def follow_hooks(hooks: DataFrame) -> DataFrame:
    """(ctx, node, root) after every chain of pointers was followed to its end; ends point to themselves."""
    while True:
        jumped = written(_jump(_jump(_jump(hooks))))
        hooks = jumped.select("ctx", "node", "root")
        if jumped.filter("moved").isEmpty():
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node per (ctx, node) over edges (ctx, a, b); nodes without edges are absent.

    All contexts go through the same rounds: every node hooks to its smallest neighbour, pointer chains are
    shortened to their ends, and the edges are contracted, until none is left. Hooks point to smaller nodes,
    so chains end; at least half of the nodes that still have edges disappear, so the rounds are
    logarithmic. Hubs only meet map-side combined minima and equi-joins.
    """
    rest = written(edges.filter("a <> b").distinct())
    labels = rest.select("ctx", F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    while not rest.isEmpty():
        hooks = (
            _both_ways(rest)
            .groupBy("ctx", "x")
            .agg(F.min("y").alias("m"))
            .select("ctx", F.col("x").alias("node"), F.least("x", "m").alias("root"))
        )
        hooks = follow_hooks(written(hooks))
        fresh = hooks.join(labels.select("ctx", "node"), ["ctx", "node"], "left_anti")
        labels = written(_follow(labels, hooks).unionByName(fresh))
        at_a = hooks.select("ctx", F.col("node").alias("a"), F.col("root").alias("__a"))
        at_b = hooks.select("ctx", F.col("node").alias("b"), F.col("root").alias("__b"))
        rest = written(
            rest.join(at_a, ["ctx", "a"])
            .join(at_b, ["ctx", "b"])
            .select("ctx", F.col("__a").alias("a"), F.col("__b").alias("b"))
            .filter("a <> b")
            .distinct()
        )
    return labels


def _follow(labels: DataFrame, step: DataFrame) -> DataFrame:
    """Labels whose roots have moved on to the roots of a further step."""
    nxt = step.select("ctx", F.col("node").alias("root"), F.col("root").alias("next"))
    return labels.join(nxt, ["ctx", "root"], "left").select(
        "ctx", "node", F.coalesce("next", "root").alias("root")
    )


def graph_structure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: number of components, isolated nodes and self-loops."""
    linked = edges.filter("src <> dst").select(
        F.lit(0).alias("ctx"), F.col("src").alias("a"), F.col("dst").alias("b")
    )
    labels = components(linked)
    touched = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    isolated = nodes.join(touched, "node", "left_anti").agg(F.count(F.lit(1)).alias("isolated"))
    loops = edges.agg(F.count_if(F.col("src") == F.col("dst")).alias("self_loops"))
    joined = nodes.select("node").join(labels.select("node", "root"), "node", "left")
    counted = joined.agg(F.count_distinct(F.coalesce("root", "node")).alias("components"))
    return with_scalars(with_scalars(counted, isolated), loops)


# --- Sampled links and neighbour sequences ------------------------------------------------------


def negative_destinations(payments: DataFrame, seed: int = 7) -> DataFrame:
    """One destination per payment that was not its link: seen by its time, not the sender itself,
    and no destination of the same sender at the same time. NULL when there is none.

    Destinations are ranked by first appearance, the draw is a hash of seed and id, and excluded
    ranks are skipped by counting those before the drawn position, so nothing is redrawn.
    """
    rows = _linking_any(payments)
    first = rows.groupBy("destination").agg(F.min("event_us").alias("__first"))
    ranked = global_rank(first, ["__first", "destination"], "__rank", measure_cuts(rows, "event_us"))
    fresh = first.groupBy(F.col("__first").alias("event_us")).agg(F.count(F.lit(1)).alias("__new"))
    times = rows.select("event_us").distinct().join(fresh, "event_us", "left").na.fill(0, ["__new"])
    sized = bucketed_prefix(
        times, ["event_us"], {"__before": F.col("__new")}, cuts=measure_cuts(rows, "event_us")
    ).select("event_us", (F.col("__before") + F.col("__new")).alias("__n"))
    banned = (
        rows.select("source", "event_us", F.explode(F.array("destination", "source")).alias("destination"))
        .distinct()
        .join(ranked.select("destination", "__rank"), "destination")
        .join(sized, "event_us")
        .filter(F.col("__rank") < F.col("__n"))
    )
    group = Window.partitionBy("source", "event_us")
    banned = banned.select(
        "source",
        "event_us",
        (F.col("__rank") - F.row_number().over(group.orderBy("__rank")) + 1).alias("__at"),
    )
    excluded = banned.groupBy("source", "event_us").agg(F.count(F.lit(1)).alias("__f"))
    valid = F.col("__n") - F.coalesce("__f", F.lit(0))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), "event_id")), 1, 15)
    draws = (
        rows.join(sized, "event_us")
        .join(excluded, ["source", "event_us"], "left")
        .withColumn(
            "__draw", F.when(valid > 0, F.pmod(F.conv(digits, 16, 10).cast("bigint"), valid))
        )
    )
    probes = draws.filter(F.col("__draw").isNotNull()).select(
        "event_id", "source", "event_us", "__draw", (F.col("__draw") + 1).alias("__at"), F.lit(0).alias("__adds")
    )
    both = probes.unionByName(banned.withColumn("__adds", F.lit(1)), allowMissingColumns=True)
    skipped = strict_prefix(both, ["source", "event_us"], "__at", {"__skip": F.col("__adds")})
    placed = skipped.filter(F.col("event_id").isNotNull()).select(
        "event_id", (F.col("__draw") + F.col("__skip")).alias("__rank")
    )
    chosen = placed.join(ranked.select("__rank", F.col("destination").alias("negative")), "__rank")
    return rows.select("event_id", "event_us", "source", "destination").join(
        chosen.select("event_id", "negative"), "event_id", "left"
    )


def _linking_any(payments: DataFrame) -> DataFrame:
    return payments.filter(
        (F.col("kind") == "payment") & F.col("source").isNotNull() & F.col("destination").isNotNull()
    )


def neighbor_cooccurrence(payments: DataFrame, k: int = 8) -> DataFrame:
    """Per payment and side: the last k neighbours and how often each occurs in the own and in the
    other side's sequence."""
    probes = payment_ends(payments).select(
        F.col("node").alias("account"), F.col("us").alias("event_us"), "event_id", "side"
    )
    found = last_neighbors(payments, probes, k)
    ids = F.transform("neighbors", lambda x: x["other"])
    both = found.groupBy("event_id").agg(
        F.max(F.when(F.col("side") == "sender", ids)).alias("sender_neighbors"),
        F.max(F.when(F.col("side") == "recipient", ids)).alias("recipient_neighbors"),
    )

    def occurs(own: str, other: str):
        return F.transform(own, lambda x: F.size(F.filter(other, lambda y: y == x)))

    return both.select(
        "event_id",
        "sender_neighbors",
        "recipient_neighbors",
        occurs("sender_neighbors", "sender_neighbors").alias("sender_in_sender"),
        occurs("sender_neighbors", "recipient_neighbors").alias("sender_in_recipient"),
        occurs("recipient_neighbors", "recipient_neighbors").alias("recipient_in_recipient"),
        occurs("recipient_neighbors", "sender_neighbors").alias("recipient_in_sender"),
    )
