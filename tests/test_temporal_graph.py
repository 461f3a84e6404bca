import math

import oracles
import pytest

from ledgerlark.catalog.base import pay_events
from ledgerlark.operators import graph as gr
from ledgerlark.operators import temporal_graph as tg


@pytest.fixture(scope="module")
def payments(spark, sf):
    rows = pay_events(spark, sf).filter("event_us < 1704067200000000 + 12 * 86400000000")
    return rows.cache()


@pytest.fixture(scope="module")
def local(payments):
    return [r.asDict() for r in payments.collect()]


def test_components_match_search(payments, local):
    got = {r["event_id"]: r for r in tg.component_features(payments).collect()}
    paid = [p for p in local if p["kind"] == "payment"]
    assert len(got) == len(paid)
    for p in paid:
        _, contacts = oracles.topology_before(local, p["event_us"])
        a = oracles.component_of(contacts, p["source"])
        b = oracles.component_of(contacts, p["destination"])
        row = got[p["event_id"]]
        assert row["graph_same_component"] == float(bool(a) and a == b)
        assert row["graph_sender_component_size"] == pytest.approx(math.log1p(len(a)))
        assert row["graph_recipient_component_size"] == pytest.approx(math.log1p(len(b)))


def test_pagerank_within_certificate(payments, local):
    got = {r["event_id"]: r for r in tg.pagerank_features(payments).collect()}
    schedule = oracles.snapshot_times(local)
    exact = {t: oracles.exact_pagerank(oracles.topology_before(local, t)[0]) for t, _ in schedule}
    for p in local:
        if p["kind"] != "payment":
            continue
        row = got[p["event_id"]]
        taken = [(t, n) for t, n in schedule if t <= p["event_us"]]
        edges, _ = oracles.topology_before(local, p["event_us"])
        if not taken:
            assert row["graph_sender_pagerank"] == 0 and row["graph_pagerank_edge_lag"] == 0
            continue
        t, n = taken[-1]
        assert row["graph_pagerank_edge_lag"] == len(edges) - n
        bound = row["graph_pagerank_error_bound"]
        assert bound <= 1e-8
        for side, node in (("sender", p["source"]), ("recipient", p["destination"])):
            assert abs(row[f"graph_{side}_pagerank"] - exact[t].get(node, 0.0)) <= bound + 1e-12


def test_no_table_of_accounts_is_broadcast_for_the_ranks(payments):
    df = tg.pagerank_features(payments)
    assert df.count() > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "BroadcastExchange" in line]
    assert keys and not any("string" in line for line in keys)


@pytest.fixture(scope="module")
def connected(payments):
    return tg.component_features(payments).cache()


@pytest.mark.parametrize("budget", [1, 3, 16, 64, 512])
def test_walk_scores_are_certified_lower_bounds(payments, local, connected, budget):
    rows = tg.ppr_features(payments, connected, budget=budget).collect()
    by_id = {p["event_id"]: p for p in local}
    links = {r["event_id"]: r["graph_same_component"] for r in connected.collect()}
    for row in rows:
        p = by_id[row["event_id"]]
        forward, reverse = row["graph_ppr_sender_to_recipient"], row["graph_ppr_recipient_to_sender"]
        if not links[row["event_id"]]:
            assert (forward, reverse) == (0.0, 0.0)
            continue
        _, contacts = oracles.topology_before(local, p["event_us"])
        for value, error, a, b in (
            (forward, row["graph_ppr_forward_error_bound"], p["source"], p["destination"]),
            (reverse, row["graph_ppr_reverse_error_bound"], p["destination"], p["source"]),
        ):
            exact = oracles.exact_ppr(contacts, a)[b]
            assert -1e-12 <= exact - value <= error + 1e-12


def test_structure(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdefg"], "node string")
    edges = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("d", "e"), ("f", "f")], "src string, dst string"
    )
    row = gr.graph_structure(nodes, edges).first()
    assert (row["components"], row["isolated"], row["self_loops"]) == (4, 1, 1)


def test_components_long_path(spark):
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(200)], "ctx int, a int, b int")
    rows = gr.components(edges).collect()
    assert len(rows) == 201 and {r["root"] for r in rows} == {0}


def test_walks_next_to_hubs_carry_no_contact_lists(spark, monkeypatch):
    from pyspark.sql import functions as F

    kept, sizes = tg.written, []

    def measured(df):
        table = kept(df)
        sizes.append(table.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0)
        return table

    monkeypatch.setattr(tg, "written", measured)
    pairs = [(f"hub{h:02d}", f"user{u:03d}") for h in range(20) for u in range(600)]
    contacts = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "lo string, hi string, us bigint")
    walks = spark.createDataFrame(
        [(u, f"user{u:03d}", f"hub{u % 20:02d}", 20_000) for u in range(100)], "walk bigint, start string, target string, us bigint"
    )
    rows = tg.bounded_ppr(contacts, walks).collect()
    for row in rows[::20]:
        exact = oracles.exact_ppr(set(pairs), row["start"])[row["target"]]
        assert -1e-12 <= exact - row["value"] <= row["error"] + 1e-12
    # Each walk uses up its budget in the first hub; the lists of the other hubs were 7 MB before.
    assert len(rows) == 100 and sum(sizes) < 3_000_000


def test_pagerank_loop_carries_only_accounts_that_receive(spark, monkeypatch):
    sizes = []
    for name in ("written", "cut_lineage"):
        def measured(df, kept=getattr(tg, name)):
            table = kept(df)
            sizes.append(table.count())
            return table

        monkeypatch.setattr(tg, name, measured)
    # Sixty payers to four shops; one shop pays on, the others pay nobody.
    pairs = [(f"p{i:02d}", f"s{(i * j) % 4}") for i in range(60) for j in (1, 3)] + [("s1", "s2")]
    edges = spark.createDataFrame([(*e, 0) for e in sorted(set(pairs))], "src string, dst string, us bigint")
    ranks, errors = tg.pagerank_snapshots(edges, [(1, len(set(pairs)))])
    exact = oracles.exact_pagerank(set(pairs))
    got = {r["node"]: r["rank"] for r in ranks.collect()}
    bound = errors.first()["error"]
    assert got.keys() == exact.keys() and bound <= 1e-8
    assert all(abs(got[n] - exact[n]) <= bound + 1e-12 for n in exact)
    # Nodes and edges once, then four rows a round (64 before).
    assert max(sizes[4:]) <= 4


def test_walks_leave_no_tables_of_rounds(spark):
    import glob

    import pyarrow.parquet as pq

    ring = [(f"n{i}", f"n{(i + 1) % 40}", i) for i in range(40)] + [("n0", f"m{i}", 50 + i) for i in range(30)]
    contacts = spark.createDataFrame([(min(a, b), max(a, b), us) for a, b, us in ring], "lo string, hi string, us bigint")
    walks = spark.createDataFrame([(1, "n3", "n9", 100), (2, "n0", "m4", 100), (3, "m1", "n20", 60)], "walk bigint, start string, target string, us bigint")
    held = lambda: {f for f in glob.glob(spark.conf.get("spark.checkpoint.dir") + "/**/*.parquet", recursive=True) if (p := pq.ParquetFile(f)).metadata.num_rows and {"known", "head"} & set(p.schema_arrow.names)}  # noqa: E501,E731
    tg.written(contacts)  # names the folder
    before = held()
    found = tg.bounded_ppr(contacts, walks, budget=64)
    left = [f for f in held() - before if "open=0" not in f]
    assert not left and found.count() == 3


def test_no_table_of_walks_is_broadcast_for_their_scores(payments, connected):
    df = tg.ppr_features(payments, connected)
    assert df.count() > 0
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
