"""Graph features as of each payment: PageRank snapshots, local personalized PageRank, components.

Only topology before the payment's timestamp counts: unique directed edges for PageRank, unique
undirected contacts for the rest; self-payments, deposits and reports add nothing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators.graph import (
    contact_ends,
    degree_before,
    degree_features,
    first_contacts,
    follow_hooks,
    payment_ends,
)
from ledgerlark.plans.prefix import bucketed_prefix, measure_cuts, plan_layout, strict_prefix
from ledgerlark.session import cut_lineage, discard, scratch_dir, written

# Fixed values of the PageRank snapshots and of the local walks.
DAMPING = 0.85
PAGERANK_TOLERANCE = 1e-8
REFRESH_FRACTION = 0.1
PPR_EDGE_BUDGET = 512
PPR_TOLERANCE = 1e-4
# A cold start needs more rounds than a warm one for the same certificate.
PAGERANK_ROUNDS = 60
HUB_EDGES = 1_000_000
# Rows of a narrow table that Spark may broadcast; the files of a larger one say too little about its size in memory.
BROADCAST_ROWS = 200_000


def _beside(table: DataFrame, rows: int) -> DataFrame:
    """The table as one side of a join: one with many rows is merged, not broadcast."""
    return table if rows <= BROADCAST_ROWS else table.hint("merge")


# --- PageRank ---------------------------------------------------------------------------------


def edge_counts(payments: DataFrame, edges: DataFrame) -> DataFrame:
    """(us, before): unique directed edges strictly before every event timestamp."""
    times = payments.select(F.col("event_us").alias("us")).distinct()
    fresh = edges.groupBy("us").agg(F.count(F.lit(1)).alias("__new"))
    rows = times.join(fresh, "us", "left").na.fill(0, ["__new"])
    return bucketed_prefix(
        rows, ["us"], {"before": F.col("__new")}, cuts=measure_cuts(payments, "event_us")
    ).select("us", F.col("before").cast("bigint").alias("before"))


def snapshot_schedule(counts: DataFrame, fetch: int = 5000) -> list[tuple[int, int]]:
    """(time, edges) of the snapshots: one is taken at the first timestamp whose earlier edges have
    grown by max(1, ceil(10 %)). Their number is logarithmic in the edges; each fetch is bounded."""
    schedule: list[tuple[int, int]] = []
    have, wanted = 0, 1
    while True:
        rows = counts.filter(F.col("before") >= wanted).orderBy("us").limit(fetch).collect()
        for row in rows:
            if row["before"] >= wanted:
                have = row["before"]
                schedule.append((row["us"], have))
                wanted = have + max(1, math.ceil(REFRESH_FRACTION * have))
        if len(rows) < fetch:
            return schedule


def _snapshot_of(times: Sequence[int], column: Column) -> Column:
    """Index of the snapshot in force (0-based), -1 before the first."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low - 1)
        middle = (low + high) // 2
        return F.when(column < F.lit(times[middle]), search(low, middle)).otherwise(
            search(middle + 1, high)
        )

    return search(0, len(times))


def pagerank_snapshots(
    edges: DataFrame,
    schedule: Sequence[tuple[int, int]],
    damping: float = DAMPING,
    rounds: int = PAGERANK_ROUNDS,
    tolerance: float = PAGERANK_TOLERANCE,
    hub_edges: int = HUB_EDGES,
    check_every: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """All snapshots at once: (snap, node, rank) and their certificates (snap, error); see ``_solve_snapshots``."""
    found, quiet, bases, certificates = _solve_snapshots(edges, schedule, damping, rounds, tolerance, hub_edges, check_every)
    last = len(schedule) - 1
    alike = quiet.filter(F.col("first") <= last).select("node", F.explode(F.sequence(F.col("first"), F.lit(last))).alias("snap"))
    ranks = found.unionByName(alike.join(F.broadcast(bases), "snap").select("snap", "node", F.col("base").alias("rank")))
    return ranks, certificates


def _solve_snapshots(
    edges: DataFrame, schedule: Sequence[tuple[int, int]], damping: float, rounds: int, tolerance: float, hub_edges: int,
    check_every: int,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Ranks (snap, node, rank) of accounts that receive, all others (node, first) with the snapshot that first holds them,
    their rank (snap, base) in every snapshot, and the certificates (snap, error).

    Snapshot sizes grow geometrically, so together they hold about eleven times the edges. A
    snapshot stops when its L1 bound d/(1-d) * change meets the tolerance. Accounts that never receive all have the
    same rank in a snapshot, and what they send is that rank times a sum of 1 / out-degree that never changes. So the
    loop only carries accounts that receive and the edges among them; the others are one number of each snapshot.
    The out-edges of a hub are spread over salts.
    """
    spark = edges.sparkSession
    times = [t for t, _ in schedule]
    if not times:
        empty = edges.limit(0)
        return (
            empty.select(F.lit(0).alias("snap"), F.col("src").alias("node"), F.lit(0.0).alias("rank")),
            empty.select(F.col("src").alias("node"), F.lit(0).alias("first")),
            empty.select(F.lit(0).alias("snap"), F.lit(0.0).alias("base")),
            empty.select(F.lit(0).alias("snap"), F.lit(0.0).alias("error")),
        )
    # First snapshot that contains an edge: the first snapshot time after the edge.
    since = _snapshot_of(times, F.col("us")) + 1
    member = edges.withColumn("__k", since).filter(F.col("__k") < len(times)).select("src", "dst", "__k")
    last = len(times) - 1
    ends = member.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("node"), F.lit(0).alias("in"), "__k"),
                F.struct(F.col("dst").alias("node"), F.lit(1).alias("in"), "__k"),
            )
        ).alias("e")
    )
    nodes = written(
        ends.groupBy(F.col("e.node").alias("node")).agg(F.min("e.__k").alias("first"), (F.max("e.in") == 1).alias("receives"))
    )
    in_snaps = nodes.withColumn("snap", F.explode(F.sequence(F.col("first"), F.lit(last))))
    sizes = in_snaps.groupBy("snap").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("receives")).alias("quiet"))
    known = _beside(nodes.select(F.col("node").alias("src"), "receives"), nodes.count())
    marked = written(member.join(known, "src"))

    def with_degrees(part: DataFrame) -> tuple[DataFrame, DataFrame]:
        snap_edges = part.select("src", "dst", F.explode(F.sequence(F.col("__k"), F.lit(last))).alias("snap"))
        degrees = snap_edges.groupBy("snap", "src").agg(F.count(F.lit(1)).alias("deg"))
        # Spark sizes the edges of all snapshots like the edges, so it is left no choice.
        return snap_edges.join(degrees.hint("merge"), ["snap", "src"]), degrees

    sent, degrees = with_degrees(marked.filter("receives"))
    salts = F.floor(F.col("deg") / hub_edges).cast("int")
    links = written(
        sent.select("snap", "src", "dst", F.pmod(F.xxhash64("dst"), salts + 1).cast("int").alias("salt"))
    )
    # What the accounts that never receive send to a node, as a multiple of their rank.
    quiet_sent, _ = with_degrees(marked.filter(~F.col("receives")))
    pushed = quiet_sent.groupBy("snap", F.col("dst").alias("node")).agg(F.sum(F.lit(1.0) / F.col("deg")).alias("push"))
    state = written(
        in_snaps.filter("receives").select("snap", "node")
        .join(F.broadcast(sizes), "snap")  # one row per snapshot, logarithmic in the edges
        .join(degrees.withColumnRenamed("src", "node").hint("merge"), ["snap", "node"], "left")
        .join(pushed.hint("merge"), ["snap", "node"], "left")
        .select(
            "snap", "node", "n", "quiet", F.coalesce("deg", F.lit(0)).alias("deg"), F.coalesce("push", F.lit(0.0)).alias("push"),
            (F.lit(1.0) / F.col("n")).alias("rank"), (F.lit(1.0) / F.col("n")).alias("base"),
        )
    )
    held = state.count()  # no later round has more rows
    factor = damping / (1 - damping)
    fixed = ["snap", "node", "n", "quiet", "deg", "push"]
    errors: dict[int, float] = {k: 2.0 for k in range(len(times))}
    settled: list[DataFrame] = []
    for step in range(1, rounds + 1):
        # A node's rank goes out once per salt of its edges.
        out = state.filter("deg > 0").select(
            "snap",
            F.col("node").alias("src"),
            (F.col("rank") / F.col("deg")).alias("share"),
            F.explode(F.sequence(F.lit(0), F.floor(F.col("deg") / hub_edges).cast("int"))).alias("salt"),
        )
        inbound = (
            links.join(_beside(out, held), ["snap", "src", "salt"])
            .groupBy("snap", F.col("dst").alias("node"))
            .agg(F.sum("share").alias("inbound"))
        )
        # Every account without out-edges receives.
        dangling = state.groupBy("snap").agg(
            F.sum(F.when(F.col("deg") == 0, F.col("rank")).otherwise(0.0)).alias("loose")
        )
        arrived = F.coalesce("inbound", F.lit(0.0)) + F.col("push") * F.col("base")
        updated = (
            state.join(_beside(inbound, held), ["snap", "node"], "left")
            .join(F.broadcast(dangling), "snap")  # one row per snapshot
            .withColumn("new_base", (F.lit(1 - damping) + F.lit(damping) * F.col("loose")) / F.col("n"))
            .withColumn("new", F.lit(damping) * arrived + F.col("new_base"))
        )
        updated = written(updated.select(*fixed, "rank", "base", "new", "new_base"))
        state = updated.select(*fixed, F.col("new").alias("rank"), F.col("new_base").alias("base"))
        if step % check_every == 0 or step == rounds:
            moved = F.sum(F.abs(F.col("new") - F.col("rank")))
            moved_base = F.max(F.col("quiet") * F.abs(F.col("new_base") - F.col("base")))
            changes = updated.groupBy("snap").agg((moved + moved_base).alias("change"))
            for row in changes.collect():  # one row per snapshot
                errors[row["snap"]] = min(2.0, factor * row["change"] + 1e-14)
            # Settled snapshots leave the loop.
            active = [k for k, e in errors.items() if e > tolerance]
            settled.append(state.filter(~F.col("snap").isin(active)).select("snap", "node", "rank", "base"))
            state = state.filter(F.col("snap").isin(active))
            if not active:
                break
    found = state.select("snap", "node", "rank", "base")
    for part in settled:
        found = found.unionByName(part)
    bases = found.groupBy("snap").agg(F.max("base").alias("base"))  # every snapshot has an account that receives
    certificates = spark.createDataFrame(list(errors.items()), "snap int, error double")
    return found.select("snap", "node", "rank"), nodes.filter(~F.col("receives")).select("node", "first"), bases, certificates


def pagerank_features(payments: DataFrame, rounds: int = PAGERANK_ROUNDS) -> DataFrame:
    """Sender and recipient score of the snapshot in force, its certificate and the edge lag."""
    edges = cut_lineage(first_contacts(payments, directed=True))
    counts = cut_lineage(edge_counts(payments, edges))
    schedule = snapshot_schedule(counts)
    found, quiet, bases, errors = _solve_snapshots(edges, schedule, DAMPING, rounds, PAGERANK_TOLERANCE, HUB_EDGES, 4)
    spark = payments.sparkSession
    placed = payment_ends(payments).withColumn("snap", _snapshot_of([t for t, _ in schedule], F.col("us")))
    # Accounts that never receive are looked up once each, not once for every snapshot that holds them.
    ranked = (
        placed.join(found.hint("merge"), ["snap", "node"], "left")
        .join(quiet.hint("merge"), "node", "left")
        .join(F.broadcast(bases), "snap", "left")  # one row per snapshot
    )
    rank = F.coalesce("rank", F.when(F.col("first") <= F.col("snap"), F.col("base")))
    scored = ranked.groupBy("event_id", "us", "snap").agg(
        *[
            F.coalesce(F.max(F.when(F.col("side") == side, rank)), F.lit(0.0)).alias(
                f"graph_{side}_pagerank"
            )
            for side in ("sender", "recipient")
        ]
    )
    taken = spark.createDataFrame(
        [(i, e) for i, (_, e) in enumerate(schedule)], "snap int, taken bigint"
    ).join(errors, "snap", "left")
    return (
        scored.join(F.broadcast(taken), "snap", "left")  # one row per snapshot
        .join(counts.hint("merge"), "us")
        .select(
            "event_id",
            "graph_sender_pagerank",
            "graph_recipient_pagerank",
            F.coalesce("error", F.lit(0.0)).alias("graph_pagerank_error_bound"),
            (F.col("before") - F.coalesce("taken", F.lit(0))).cast("double").alias("graph_pagerank_edge_lag"),
        )
    )


# --- Components as of a time --------------------------------------------------------------------


def contraction_tree(contacts: DataFrame) -> DataFrame:
    """(node, level, top, until): the tree that rounds of contraction build over the contacts.

    In a round every group takes its earliest contact to another group, groups joined by such contacts
    become one, and contacts inside a group go. The latest contact on the way from a node up to ``top`` is
    ``until``. Two nodes are connected before a time exactly if both reach a common top over earlier contacts: the
    latest contact between them on a minimum spanning forest is also the latest one in this tree. Groups
    at least halve, so there are logarithmic many rounds and rows per node; hubs only meet map-side combined
    minima and equi-joins.
    """
    edges = written(
        contacts.select(F.col("lo").alias("a"), F.col("hi").alias("b"), F.struct("us", "lo", "hi").alias("w"))
    )
    tops = contact_ends(contacts).select("node", F.col("node").alias("top")).distinct()
    tops = written(tops.withColumn("until", F.lit(None).cast("bigint")))
    held = tops.count()  # no table of groups has more rows
    levels, level = [], 0
    while not edges.isEmpty():
        level += 1
        both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "w").union(edges.select("b", "a", "w"))
        best = both.groupBy("x").agg(F.min(F.struct("w", "y")).alias("m"))
        best = written(best.select("x", F.col("m.y").alias("y"), F.col("m.w.us").alias("at")))
        # Two groups that take each other's contact end the chains; the smaller of them is the root.
        back = best.select(F.col("x").alias("y"), F.col("y").alias("__back"))
        own = (F.col("__back") == F.col("x")) & (F.col("x") < F.col("y"))
        hooks = best.join(_beside(back, held), "y").select(
            F.lit(0).alias("ctx"), F.col("x").alias("node"), F.when(own, F.col("x")).otherwise(F.col("y")).alias("root")
        )
        hooks = follow_hooks(hooks).select(F.col("node").alias("x"), F.col("root").alias("__root"))
        steps = best.select("x", "at").join(hooks, "x")
        tops = tops.join(_beside(steps, held), F.col("top") == F.col("x")).select(
            "node", F.col("__root").alias("top"), F.greatest("until", "at").alias("until")
        )
        levels.append(tops.withColumn("level", F.lit(level)))
        at_a = hooks.select(F.col("x").alias("a"), F.col("__root").alias("__a"))
        at_b = hooks.select(F.col("x").alias("b"), F.col("__root").alias("__b"))
        moved = edges.join(_beside(at_a, held), "a").join(_beside(at_b, held), "b").filter("__a <> __b")
        edges = written(
            moved.groupBy(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b")).agg(F.min("w").alias("w"))
        )
    tree = tops.withColumn("level", F.lit(0)).filter("level > 0") if not levels else levels[0]
    for more in levels[1:]:
        tree = tree.unionByName(more)
    return tree.select("node", "level", "top", "until")


def temporal_components(contacts: DataFrame, probes: DataFrame) -> DataFrame:
    """Component and size of each probe ``(node, us)`` strictly before ``us``.

    ``root`` names the component among those of the same time. It is the highest top of the contraction tree
    that the node reaches over contacts before ``us``; the members are the nodes that reach the same top, and
    their number is a running count over the times at which nodes reach it. Probes of nodes not seen yet come
    back with size 0 and no root.
    """
    tree = written(contraction_tree(contacts))
    asked = probes.select("node", "us").distinct()
    reached = (
        asked.join(tree.hint("merge"), "node")
        .filter(F.col("until") < F.col("us"))
        .groupBy("node", "us")
        .agg(F.max(F.struct("level", "top")).alias("t"))
        .select("node", "us", F.concat_ws("/", "t.level", "t.top").alias("root"))
    )
    rows = tree.select(
        F.concat_ws("/", "level", "top").alias("root"), F.col("until").alias("us"), F.lit(1).alias("__one"),
        F.lit(None).cast("string").alias("node"),
    ).unionByName(reached.select("root", "us", F.lit(0).alias("__one"), "node"))
    layout = plan_layout(rows, ["root"], "us")
    counted = strict_prefix(rows, ["root"], "us", {"size": F.col("__one")}, layout=layout).filter("node is not null")
    return probes.join(counted.select("node", "us", "root", "size").hint("merge"), ["node", "us"], "left").withColumn(
        "size", F.coalesce("size", F.lit(0))
    )


def component_features(payments: DataFrame, contacts: DataFrame | None = None) -> DataFrame:
    """Whether both ends were connected before the payment, and log1p of their component sizes."""
    contacts = first_contacts(payments) if contacts is None else contacts
    found = temporal_components(cut_lineage(contacts), payment_ends(payments))
    folded = found.groupBy("event_id").agg(
        *[
            F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side}_{c}")
            for side in ("sender", "recipient")
            for c in ("root", "size")
        ]
    )
    same = F.coalesce(F.col("sender_root") == F.col("recipient_root"), F.lit(False))
    return folded.select(
        "event_id",
        same.cast("double").alias("graph_same_component"),
        F.log1p("sender_size").alias("graph_sender_component_size"),
        F.log1p("recipient_size").alias("graph_recipient_component_size"),
    )


# --- Local personalized PageRank ----------------------------------------------------------------


# Nodes that an open walk asks for at first; while these do not use up its budget, it asks for more and more.
_ASK = 4


def ranked_contacts(contacts: DataFrame) -> DataFrame:
    """Both ends of every contact with its 0-based place among the contacts of ``node``: (node, other, us, place)."""
    ends = contact_ends(contacts)
    layout = plan_layout(ends, ["node"], "us")
    return strict_prefix(ends, ["node"], "us", {"place": F.lit(1)}, layout=layout, sequence=[F.col("other")])


def _spread(known: dict, start: str, target: str, damping: float, budget: int, tolerance: float):
    """Run one walk as far as the known contacts go.

    ``known[node] = (degree, contacts or None)``. Mass is moved level by level: a level takes the pending nodes
    within a factor of two of the heaviest one, as they stand when it begins, in order of mass and name. In the level
    that uses up the budget only the target's place among a node's contacts counts, so no contacts are needed there.
    Returns (value, error, ends, nodes to ask for). ``ends`` are the nodes (node, degree, take, credit) of that level:
    the target gains the credit where it is among the first ``take`` contacts, and moves it from error to value
    where it is a later one. What is asked for is (node, degree or None, room): the degree, and the contacts if
    they are fewer than ``room``; the heaviest nodes first, their contacts in a round about the rest of the budget.
    With nodes to ask for, the rest is not final.
    """

    def ask(wanted: list) -> tuple:
        missing = sorted((-m, n) for n, m in pending.items() if n not in known)
        missing = missing[: min(left, max(_ASK, 2 * len(known)))]
        room = left // max(1, len(missing)) + 1
        return 0.0, 1.0, [], wanted + [(n, None, min(left, room)) for _, n in missing]

    pending, ended, reached, left, ends = {start: 1.0}, 0.0, 0.0, budget, []
    moved = 0.0
    while pending and left and 1.0 - ended > tolerance:
        floor = max(pending.values()) / 2
        level = sorted((-m, n) for n, m in pending.items() if m >= floor)
        room, takes = left, []
        for weight, node in level:
            if not room:
                break
            if node not in known:
                return ask([])
            take = min(known[node][0], room)
            takes.append((-weight, node, take))
            room -= take
        if room:
            wanted = [(n, known[n][0], left) for _, n, take in takes if take and known[n][1] is None]
            if wanted:
                return ask(wanted)
        for mass, node, take in takes:
            if not take:
                continue
            degree, others = known[node]
            pending[node] -= mass  # what arrived during this level stays
            if pending[node] <= 0:
                del pending[node]
            ended += (1 - damping) * mass
            if node == target:
                reached += (1 - damping) * mass
            share = damping * mass / degree
            if room:
                for other in others:
                    pending[other] = pending.get(other, 0.0) + share
            else:
                moved += take * share
                ends.append((node, degree, take, (1 - damping) * share))
        if room == left:
            break
        left = room
    total = math.fsum([ended, (1 - damping) * moved, *((1 - damping) * m for m in pending.values())])
    error = min(1.0, max(0.0, 1.0 - total) + 1e-14)
    return reached + (1 - damping) * pending.get(target, 0.0), error, ends, []


def bounded_ppr(
    contacts: DataFrame,
    walks: DataFrame,
    damping: float = DAMPING,
    budget: int = PPR_EDGE_BUDGET,
    tolerance: float = PPR_TOLERANCE,
) -> DataFrame:
    """Lower bound of the walk score from ``start`` to ``target`` over contacts before ``us``.

    ``walks(walk, start, target, us)``. Every walk may traverse ``budget`` contacts, heaviest levels first;
    the node that exceeds the budget is expanded partly, and of its other contacts the target is credited with what
    stops there. Adds ``value`` and ``error``: value <= exact <= value + error.

    One plan for any size: open walks ask for degrees, which are running counts, and for the contacts of nodes
    with less than the rest of the budget. A walk holds at most ``budget`` contacts, and none of those of its last
    level, where the target's place is looked up by a join; so hubs cost no more than other nodes, and
    no table of nodes or walks is broadcast. The rounds end when no walk asks, which is after the depth of the walks usually.
    """
    import pyarrow as pa

    ranked = written(ranked_contacts(contacts))
    heads = written(
        ranked.filter(F.col("place") < budget).groupBy("node").agg(
            F.array_sort(F.collect_list(F.struct("place", "other"))).alias("c")  # at most `budget`
        ).select("node", F.col("c.other").alias("head"))
    )
    walk_kind = "walk bigint, start string, target string, us bigint"
    ends_kind = "array<struct<node: string, degree: bigint, take: bigint, credit: double>>"
    asks_kind = "array<struct<node: string, degree: bigint, room: bigint>>"
    kind = f"{walk_kind}, value double, error double, ends {ends_kind}, known string, asks {asks_kind}"
    ends_type = pa.list_(
        pa.struct([("node", pa.string()), ("degree", pa.int64()), ("take", pa.int64()), ("credit", pa.float64())])
    )
    asks_type = pa.list_(pa.struct([("node", pa.string()), ("degree", pa.int64()), ("room", pa.int64())]))
    schema = pa.schema(
        [
            ("walk", pa.int64()), ("start", pa.string()), ("target", pa.string()), ("us", pa.int64()),
            ("value", pa.float64()), ("error", pa.float64()), ("ends", ends_type), ("known", pa.string()), ("asks", asks_type),
        ]
    )

    def run(batches):
        walk, near, out = None, {}, []

        def close() -> None:
            value, error, ends, asks = _spread(near, walk[1], walk[2], damping, budget, tolerance)
            out.append((*walk, value, error, ends, json.dumps(near) if asks else None, asks))

        def flush():
            columns = [pa.array(c, t) for c, t in zip(zip(*out), schema.types)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for *row, known, node, degree, others in zip(*(c.to_pylist() for c in batch.columns)):
                if node is None:  # the walk comes before the answers to it
                    if walk is not None:
                        close()
                    walk, near = row, json.loads(known)
                else:
                    near[node] = (degree, others and json.loads(others))
            if len(out) >= 1000:
                yield flush()
        if walk is not None:
            close()
        if out:
            yield flush()

    asking = written(
        walks.select(
            "walk", "start", "target", "us", F.lit("{}").alias("known"),
            F.array(F.struct(F.col("start").alias("node"), F.lit(None).cast("bigint").alias("degree"), F.lit(budget).cast("bigint").alias("room"))).alias("asks"),
        )
    )
    settled = None
    while True:
        asked = asking.select("walk", "us", F.explode("asks").alias("a")).select("walk", "us", "a.*")
        counted = degree_before(ranked.select("node", "us", "place"), asked.filter("degree is null").drop("degree"), ends=True)
        columns = ["walk", "node", "degree", "room"]
        answers = written(
            counted.select(*columns).unionByName(asked.filter("degree is not null").select(*columns))
        )
        few = (F.col("degree") < F.col("room")) & (F.col("degree") > 0)
        lists = answers.filter(few).join(heads.hint("merge"), "node").select(
            "walk", "node", "degree", F.to_json(F.slice("head", F.lit(1), F.col("degree").cast("int"))).alias("others")
        )
        found = lists.unionByName(
            answers.filter(~few).select("walk", "node", "degree", F.lit(None).cast("string").alias("others"))
        )
        rows = asking.select("walk", "start", "target", "us", "known").unionByName(found, allowMissingColumns=True)
        result = rows.repartition("walk").sortWithinPartitions("walk", F.col("node").isNotNull()).mapInArrow(run, kind)
        result = result.withColumn("open", (F.size("asks") > 0).cast("int"))
        path = scratch_dir(contacts.sparkSession, "walks")
        result.write.partitionBy("open").parquet(path)
        result = contacts.sparkSession.read.schema(result.schema).parquet(path)
        # The known contacts of open walks go once the next round is written; what is settled stays.
        discard(asking, answers)
        done = result.filter("open = 0").select("walk", "start", "target", "us", "value", "error", "ends")
        settled = done if settled is None else settled.unionByName(done)
        asking = result.filter("open = 1").select("walk", "start", "target", "us", "known", "asks")
        if asking.isEmpty():
            discard(heads)
            break
        asking.stashed = f"{path}/open=1"
    places = ranked.select("node", F.col("other").alias("target"), "place")
    gains = (
        settled.select("walk", "target", F.explode("ends").alias("e")).select("walk", "target", "e.*")
        .join(places.hint("merge"), ["node", "target"])
        .filter(F.col("place") < F.col("degree"))
        .groupBy("walk")
        .agg(
            F.sum("credit").alias("__gain"),
            # A contact of the partly expanded node that was not reached.
            F.sum(F.when(F.col("place") >= F.col("take"), F.col("credit")).otherwise(0.0)).alias("__extra"),
        )
    )
    return settled.join(gains.hint("merge"), "walk", "left").select(
        "walk", "start", "target", "us",
        (F.col("value") + F.coalesce("__gain", F.lit(0.0))).alias("value"),
        F.greatest(F.lit(0.0), F.col("error") - F.coalesce("__extra", F.lit(0.0))).alias("error"),
    )


def ppr_features(
    payments: DataFrame, connected: DataFrame, contacts: DataFrame | None = None, **options
) -> DataFrame:
    """Walk scores of both directions for payments whose ends were connected, else zero.

    ``connected(event_id, graph_same_component)`` comes from ``component_features``.
    """
    contacts = cut_lineage(first_contacts(payments) if contacts is None else contacts)
    paid = payments.filter("kind = 'payment'").select("event_id", "event_us", "source", "destination")
    linked = paid.join(connected.filter("graph_same_component = 1").hint("merge"), "event_id", "left_semi")
    walks = linked.select(
        "event_id",
        F.col("event_us").alias("us"),
        F.explode(
            F.array(
                F.struct(F.lit("f").alias("way"), F.col("source").alias("start"), F.col("destination").alias("target")),
                F.struct(F.lit("r").alias("way"), F.col("destination").alias("start"), F.col("source").alias("target")),
            )
        ).alias("w"),
    ).select("event_id", "us", "w.*")
    # Equal starts, targets and times are walked once.
    keys = ["start", "target", "us"]
    unique = cut_lineage(
        walks.select(*keys).distinct().withColumn("walk", F.monotonically_increasing_id())
    )
    solved = bounded_ppr(contacts, unique, **options)
    back = walks.join(solved.select(*keys, "value", "error").hint("merge"), keys)
    folded = back.groupBy("event_id").agg(
        F.max(F.when(F.col("way") == "f", F.col("value"))).alias("fv"),
        F.max(F.when(F.col("way") == "r", F.col("value"))).alias("rv"),
        F.max(F.when(F.col("way") == "f", F.col("error"))).alias("fe"),
        F.max(F.when(F.col("way") == "r", F.col("error"))).alias("re"),
    )
    return paid.select("event_id").join(folded.hint("merge"), "event_id", "left").select(
        "event_id",
        F.coalesce("fv", F.lit(0.0)).alias("graph_ppr_sender_to_recipient"),
        F.coalesce("rv", F.lit(0.0)).alias("graph_ppr_recipient_to_sender"),
        F.coalesce("fe", F.lit(0.0)).alias("graph_ppr_forward_error_bound"),
        F.coalesce("re", F.lit(0.0)).alias("graph_ppr_reverse_error_bound"),
    )


def graph_features(payments: DataFrame) -> DataFrame:
    """All thirteen graph features of every payment."""
    contacts = cut_lineage(first_contacts(payments))
    linked = cut_lineage(component_features(payments, contacts))
    return (
        pagerank_features(payments)
        .join(ppr_features(payments, linked, contacts).hint("merge"), "event_id")
        .join(linked.hint("merge"), "event_id")
        .join(degree_features(payments).hint("merge"), "event_id")
    )
