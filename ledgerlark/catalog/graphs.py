"""Queries over contacts, the explorer, as-of neighbours and temporal graph features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.catalog.base import PAY_EVENTS, PAY_ORDERS, pay_events, pay_orders, query, r6, with_cte
from ledgerlark.operators import graph as gr
from ledgerlark.operators import histories as hs
from ledgerlark.operators import joins as jn
from ledgerlark.operators import temporal_graph as tg
from ledgerlark.session import cut_lineage

CONTACTS = """,
links as (select * from pay where kind = 'payment' and source <> destination),
edges as (select source as src, destination as dst, min(event_us) as us from links group by all),
contacts as (select least(source, destination) as lo, greatest(source, destination) as hi,
  min(event_us) as us from links group by all),
ends as (select lo as node, hi as other, us from contacts union all select hi, lo, us from contacts)"""


def _events(body: str) -> str:
    return with_cte(PAY_EVENTS, CONTACTS + body)


def _orders(body: str) -> str:
    return with_cte(PAY_ORDERS, CONTACTS + body)


@query("first_contacts", _events(" select lo, hi, us from contacts"))
def first_contacts(spark, sf):
    return gr.first_contacts(pay_events(spark, sf))


@query("first_contacts_directed", _events(" select src, dst, us from edges"))
def first_contacts_directed(spark, sf):
    return gr.first_contacts(pay_events(spark, sf), directed=True)


DEGREES = """, dg as (select p.event_id, count(distinct a.other) filter (a.us < p.event_us) as s,
    (select count(*) from ends b where b.node = p.destination and b.us < p.event_us) as d
  from pay p left join ends a on a.node = p.source where p.kind = 'payment'
  group by p.event_id, p.destination, p.event_us)
  select event_id, round(ln(1 + s), 6) as graph_sender_degree, round(ln(1 + d), 6) as graph_recipient_degree from dg"""


@query("graph_degree", _events(DEGREES))
def graph_degree(spark, sf):
    df = gr.degree_features(pay_events(spark, sf))
    return df.select("event_id", r6(F.col("graph_sender_degree")).alias("graph_sender_degree"),
                     r6(F.col("graph_recipient_degree")).alias("graph_recipient_degree"))


def _pagerank(spark, sf):
    return tg.pagerank_features(pay_events(spark, sf))


def _components(spark, sf):
    return tg.component_features(pay_events(spark, sf))


def _ppr(spark, sf):
    payments = pay_events(spark, sf)
    contacts = cut_lineage(gr.first_contacts(payments))
    return tg.ppr_features(payments, cut_lineage(tg.component_features(payments, contacts)), contacts)


# Latest contact of the best connection of every two accounts: a min-max table, squared until paths of 512
# contacts are covered.
_SQUARES = 9
BOTTLENECKS = """, b0 as (select node as x, other as y, us as t from ends
   union all select node, node, min(us) from ends group by node)""" + "".join(
    f""", b{i + 1} as (select p.x, q.y, min(greatest(p.t, q.t)) as t from b{i} p join b{i} q on p.y = q.x group by all)"""
    for i in range(_SQUARES)
) + f""", sz as (select p.event_id, count(*) filter (b.x = p.source) as s, count(*) filter (b.x = p.destination) as d,
     max(case when b.x = p.source and b.y = p.destination then 1 else 0 end) as same
   from pay p left join b{_SQUARES} b on b.x in (p.source, p.destination) and b.t < p.event_us
   where p.kind = 'payment' group by 1),
 comp as (select event_id, same::double as graph_same_component, round(ln(1 + s), 6) as graph_sender_component_size,
   round(ln(1 + d), 6) as graph_recipient_component_size from sz)"""


def _rounded(df):
    return df.select("event_id", *[r6(F.col(c)).alias(c) for c in df.columns if c != "event_id"])


@query("temporal_components", _events(BOTTLENECKS + " select * from comp"))
def temporal_components(spark, sf):
    return _rounded(_components(spark, sf))


@query("pagerank_snapshots")
def pagerank_snapshots(spark, sf):
    return _rounded(_pagerank(spark, sf))


@query("bounded_ppr")
def bounded_ppr(spark, sf):
    return _rounded(_ppr(spark, sf))


@query("graph_features")
def graph_features(spark, sf):
    """All thirteen."""
    return _rounded(tg.graph_features(pay_events(spark, sf)))


EXPLORER = """, paid as (select * from pay where kind = 'payment'),
 sides as (select source as node, 1 as o, 0 as i from paid union all select destination, 0, 1 from paid),
 gn as (select node, split_part(node, ':', 2) as label, split_part(node, ':', 1) as type,
   split_part(node, ':', 2) as external_id, cast(sum(o) as bigint) as out_degree, cast(sum(i) as bigint) as in_degree
   from sides group by all),
 ge as (select row_number() over (order by event_us, seq) as seq, event_id as id, source as src,
   destination as dst, kind as type, event_us as us, label, amount from paid)"""


@query("explorer_nodes", with_cte(PAY_ORDERS, EXPLORER + " select node, label, type, external_id, out_degree, in_degree from gn"))
def explorer_nodes(spark, sf):
    nodes, _ = gr.build_explorer(pay_orders(spark, sf))
    return nodes.select("node", "label", "type", "external_id", "out_degree", "in_degree")


@query("explorer_edges", with_cte(PAY_ORDERS, EXPLORER + " select seq, id, src, dst, us, label from ge"))
def explorer_edges(spark, sf):
    _, edges = gr.build_explorer(pay_orders(spark, sf))
    return edges.select("seq", "id", "src", "dst", "us", "label")


@query("graph_summary", with_cte(PAY_ORDERS, EXPLORER + """
 select 'node' as element, type, count(*) as count from gn group by all
 union all select 'edge', type, count(*) from ge group by all"""))
def graph_summary(spark, sf):
    nodes, edges = gr.build_explorer(pay_orders(spark, sf))
    return gr.graph_summary(nodes, edges)[0]


@query("graph_totals", with_cte(PAY_ORDERS, EXPLORER + """
 select count(*) as edges, min(us) as first_us, max(us) as last_us, (select count(*) from gn) as nodes from ge"""))
def graph_totals(spark, sf):
    nodes, edges = gr.build_explorer(pay_orders(spark, sf))
    return gr.graph_summary(nodes, edges)[1]


@query("sample_edges", with_cte(PAY_ORDERS, EXPLORER + """,
 c as (select * from ge where seq > 100 and label = 1 order by seq limit 301),
 f as (select node, min(seq) as first_at from (select src as node, seq from c union all select dst, seq from c) group by 1),
 r as (select seq, (select count(*) from f where first_at <= c.seq) as nodes, row_number() over (order by seq) as k from c)
 select seq, id, src, dst from ge join (select seq from r
   where k <= 300 and seq < coalesce((select min(seq) from r where nodes > 100), 9223372036854775807)) using (seq)"""))
def sample_edges(spark, sf):
    nodes, edges = gr.build_explorer(pay_orders(spark, sf))
    page, _, _ = gr.sample_edges(edges, nodes, offset=100, node_limit=100, edge_limit=300, label=1)
    return page.select("seq", "id", "src", "dst")


@query("expand_neighbors", with_cte(PAY_ORDERS, EXPLORER + """
 select seq, id, src, dst from ge where src = 'supplier:1' or dst = 'supplier:1' order by seq limit 40"""))
def expand_neighbors(spark, sf):
    nodes, edges = gr.build_explorer(pay_orders(spark, sf))
    page, _, _ = gr.expand_neighbors(edges, nodes, "supplier:1", edge_limit=40)
    return page.select("seq", "id", "src", "dst")


@query("neighbor_edges", with_cte(PAY_ORDERS, EXPLORER + """
 select case when src = 'supplier:1' then src else dst end as node, seq, src, dst from ge where src = 'supplier:1' or dst = 'supplier:1'
 union all select 'customer:7', seq, src, dst from ge where src = 'customer:7' or dst = 'customer:7'"""))
def neighbor_edges(spark, sf):
    nodes, edges = gr.build_explorer(pay_orders(spark, sf))
    asked = nodes.filter(F.col("node").isin("supplier:1", "customer:7")).select("node")
    return jn.neighbor_edges_of(edges, asked).select("node", "seq", "src", "dst")


@query("search_nodes", with_cte(PAY_ORDERS, EXPLORER + """, h as (select node, label, type from gn
   where starts_with(lower(label), '12') or node = '12' order by label, node limit 21)
 select node, label, type, (select count(*) from h) > 20 as has_more from h order by label, node limit 20"""))
def search_nodes(spark, sf):
    nodes, _ = gr.build_explorer(pay_orders(spark, sf))
    return gr.search_nodes(nodes, "12", 20)


STRUCTURE = with_cte(PAY_EVENTS, """,
 acct as (select distinct 'account:' || user_id as node from events
          union select distinct 'account:' || json_extract_string(props, '$.k') from events),
 rare as (select source as src, destination as dst from pay where kind = 'payment' and source is not null),
 und as (select src as a, dst as b from rare union select dst, src from rare),
 reach as (with recursive r(node, seen) as (
   select node, node from acct union select r.node, u.b from r join und u on u.a = r.seen) select * from r),
 lead as (select node, min(seen) as root from reach group by 1)
 select (select count(distinct root) from lead) as components,
   (select count(*) from acct where node not in (select a from und)) as isolated,
   (select count(*) from rare where src = dst) as self_loops""")


@query("graph_structure", STRUCTURE)
def graph_structure(spark, sf):
    payments = pay_events(spark, sf)
    events = payments.sparkSession.read.parquet(f"{sf}/events.parquet")
    accounts = events.select(
        F.explode(F.array(
            F.concat(F.lit("account:"), F.col("user_id")),
            F.concat(F.lit("account:"), F.get_json_object("props", "$.k")),
        )).alias("node")
    ).distinct()
    paid = payments.filter("kind = 'payment'").select(F.col("source").alias("src"), F.col("destination").alias("dst"))
    return gr.graph_structure(accounts, paid)


@query("negative_destinations", with_cte(PAY_ORDERS, """,
 f as (select destination, min(event_us) as first_at from pay group by 1),
 g as (select source, event_us, list(destination) as own from pay group by all),
 v as (select g.source, g.event_us, list(f.destination order by first_at, f.destination) as ds
   from g join f on first_at <= g.event_us and f.destination <> g.source and not list_contains(own, f.destination) group by all)
 select event_id, ds[1 + ('0x' || substr(md5('7:' || event_id), 1, 15))::bigint % len(ds)] as negative
 from pay left join v using (source, event_us)"""))
def negative_destinations(spark, sf):
    return gr.negative_destinations(pay_orders(spark, sf)).select("event_id", "negative")


@query("negative_destinations_counts", with_cte(PAY_ORDERS, """,
 f as (select destination, min(event_us) as first_at from pay group by 1),
 t as (select distinct event_us from pay),
 n as (select event_us, (select count(*) from f where first_at <= t.event_us) as n from t),
 g as (select source, event_us, count(distinct destination) as banned from pay group by all)
 select count(*) as payments, count(*) filter (n.n - g.banned > 0) as paired,
   cast(0 as bigint) as forbidden from pay join n using (event_us) join g using (source, event_us)"""))
def negative_destinations_counts(spark, sf):
    payments = pay_orders(spark, sf)
    drawn = gr.negative_destinations(payments)
    links = payments.select("source", "event_us", F.col("destination").alias("negative"), F.lit(1).alias("hit")).distinct()
    first = payments.groupBy(F.col("destination").alias("negative")).agg(F.min("event_us").alias("at"))
    checked = drawn.join(links, ["source", "event_us", "negative"], "left").join(first, "negative", "left")
    wrong = F.col("hit").isNotNull() | (F.col("negative") == F.col("source")) | (F.col("at") > F.col("event_us"))
    return checked.agg(
        F.count(F.lit(1)).alias("payments"), F.count("negative").alias("paired"),
        F.count_if(wrong).alias("forbidden"),
    )


def _probes(payments, side="source"):
    return payments.filter("kind = 'payment'").select("event_id", F.col(side).alias("account"), "event_us")


INCIDENTS = """, inc as (
  select source as account, destination as other, -1 as role, event_id, event_us, seq * 2 as place, amount from pay
  where kind = 'payment'
  union all select destination, source, 1, event_id, event_us, seq * 2 + 1, amount from pay where kind = 'payment'),
 nb as (select p.event_id, i.other, i.event_id as item, i.event_us as item_us, i.place, i.amount, i.role,
   row_number() over (partition by p.event_id order by i.event_us desc, i.place desc) as k
  from pay p join inc i on i.account = p.source and i.event_us < p.event_us where p.kind = 'payment')"""


@query("asof_last_k_neighbors", with_cte(PAY_EVENTS, INCIDENTS + """
 select p.event_id, coalesce(string_agg(other || '@' || item, ',' order by k desc) filter (k <= 8), '') as neighbors
 from pay p left join nb using (event_id) where kind = 'payment' group by p.event_id"""))
def asof_last_k_neighbors(spark, sf):
    payments = pay_events(spark, sf)
    found = jn.last_neighbors(payments, _probes(payments), 8)
    text = F.array_join(F.transform("neighbors", lambda x: F.concat(x["other"], F.lit("@"), x["event_id"])), ",")
    return found.select("event_id", text.alias("neighbors"))


@query("asof_last_k_neighbors_ties", with_cte(PAY_ORDERS, INCIDENTS + """
 select p.event_id, coalesce(string_agg(other || '@' || item, ',' order by k desc) filter (k <= 8), '') as neighbors
 from pay p left join nb using (event_id) where kind = 'payment' group by p.event_id"""))
def asof_last_k_neighbors_ties(spark, sf):
    payments = pay_orders(spark, sf)
    found = jn.last_neighbors(payments, _probes(payments), 8)
    text = F.array_join(F.transform("neighbors", lambda x: F.concat(x["other"], F.lit("@"), x["event_id"])), ",")
    return found.select("event_id", text.alias("neighbors"))


@query("asof_pair_state", with_cte(PAY_ORDERS, """, u as (select source, destination, event_us, avg(amount) as v from pay group by all)
 select p.event_id, round(arg_max(u.v, u.event_us), 6) as state from pay p
 left join u on u.source = p.source and u.destination = p.destination and u.event_us < p.event_us group by p.event_id"""))
def asof_pair_state(spark, sf):
    payments = pay_orders(spark, sf)
    probes = payments.select("event_id", "source", "destination", "event_us")
    return jn.pair_state(payments, probes, "amount").select("event_id", r6(F.col("state")).alias("state"))


@query("recent_distinct_neighbors", with_cte(PAY_EVENTS, INCIDENTS + """,
 d as (select event_id, other, min(k) as k from nb where k <= 4 group by all)
 select p.event_id, coalesce(string_agg(other, ',' order by k), '') as neighbors
 from pay p left join d using (event_id) where kind = 'payment' group by p.event_id"""))
def recent_distinct_neighbors(spark, sf):
    payments = pay_events(spark, sf)
    found = hs.recent_distinct_neighbors(payments, _probes(payments))
    return found.select("event_id", F.array_join("neighbors", ",").alias("neighbors"))


@query("neighbor_cooccurrence", with_cte(PAY_EVENTS, INCIDENTS + """,
 rb as (select p.event_id, i.other,
   row_number() over (partition by p.event_id order by i.event_us desc, i.place desc) as k
  from pay p join inc i on i.account = p.destination and i.event_us < p.event_us where p.kind = 'payment'),
 s as (select event_id, list(other order by k desc) as xs from nb where k <= 8 group by 1),
 d as (select event_id, list(other order by k desc) as ys from rb where k <= 8 group by 1),
 b as (select event_id, coalesce(xs, []) as xs, coalesce(ys, []) as ys
   from pay p left join s using (event_id) left join d using (event_id) where kind = 'payment')
 select event_id,
   array_to_string([len([y for y in xs if y = x]) for x in xs], ',') as sender_in_sender,
   array_to_string([len([y for y in ys if y = x]) for x in xs], ',') as sender_in_recipient,
   array_to_string([len([y for y in ys if y = x]) for x in ys], ',') as recipient_in_recipient,
   array_to_string([len([y for y in xs if y = x]) for x in ys], ',') as recipient_in_sender from b"""))
def neighbor_cooccurrence(spark, sf):
    df = gr.neighbor_cooccurrence(pay_events(spark, sf))
    names = ["sender_in_sender", "sender_in_recipient", "recipient_in_recipient", "recipient_in_sender"]
    return df.select("event_id", *[F.array_join(F.col(n).cast("array<string>"), ",").alias(n) for n in names])


def _vector(df, name="vector"):
    rounded = F.transform(name, lambda x: F.round(x, 6))
    return df.select("event_id", *[F.element_at(rounded, i + 1).alias(f"v{i}") for i in range(4)])


ACCOUNT_W = hs.projection(4, 8)
PAIR_W = hs.projection(4, 5)
MIX_W = hs.projection(4, 8, seed=77)


def _vector_sql(weights, basis, source, limit, decay, probe="event_id"):
    parts = []
    for i, row in enumerate(weights):
        total = " + ".join(f"({w!r}) * sum(w * ({b}))" for w, b in zip(row, basis))
        parts.append(f"round(coalesce(tanh(({total}) / sum(w)), 0), 6) as v{i}")
    return f""", ag as (select n.*, (p.event_us - n.item_us) / 60e6 as age from {source} n join pay p using (event_id) where k <= {limit}),
  wg as (select *, exp(-age / {decay}) as w from ag),
  vv as (select event_id, {', '.join(parts)} from wg group by event_id)
  select p.event_id, {', '.join(f'coalesce(v{i}, 0) as v{i}' for i in range(len(weights)))}
  from pay p left join vv using (event_id) where kind = 'payment'"""


ACCOUNT_BASIS = ["1.0", "role", "ln(1 + amount) / 8", "least(age / 720, 4.0)", "sin(age / 60)", "cos(age / 60)",
                 "sin(age / 1440)", "cos(age / 1440)"]
PAIR_BASIS = ["1.0", "ln(1 + amount) / 8", "least(age / 720, 4.0)", "sin(age / 60)", "cos(age / 60)"]


@query("account_history_vector", with_cte(PAY_EVENTS, INCIDENTS + _vector_sql(ACCOUNT_W, ACCOUNT_BASIS, "nb", 8, 720.0)))
def account_history_vector(spark, sf):
    payments = pay_events(spark, sf)
    return _vector(hs.account_history_vector(payments, _probes(payments), ACCOUNT_W))


@query("pair_history_vector", with_cte(PAY_EVENTS, """, pn as (
  select p.event_id, i.event_us as item_us, i.amount,
    row_number() over (partition by p.event_id order by i.event_us desc, i.seq desc) as k
  from pay p join pay i on i.source = p.source and i.destination = p.destination and i.event_us < p.event_us
  where p.kind = 'payment' and i.kind = 'payment')""" + _vector_sql(PAIR_W, PAIR_BASIS, "pn", 6, 1440.0)))
def pair_history_vector(spark, sf):
    payments = pay_events(spark, sf)
    probes = payments.filter("kind = 'payment'").select("event_id", "source", "destination", "event_us")
    return _vector(hs.pair_history_vector(payments, probes, PAIR_W))


@query("neighborhood_vector")
def neighborhood_vector(spark, sf):
    payments = pay_events(spark, sf)
    return _vector(hs.neighborhood_vector(payments, _probes(payments), ACCOUNT_W, MIX_W))


BIN = """case when {a} < 15 then 0 when {a} < 35 then 1 when {a} < 75 then 2 when {a} < 150 then 3
 when {a} < 300 then 4 when {a} < 650 then 5 when {a} < 1500 then 6 when {a} < 4000 then 7 when {a} < 10000 then 8 else 9 end"""
GAP = """case when {a} < 1 then 0 when {a} < 5 then 1 when {a} < 20 then 2 when {a} < 60 then 3
 when {a} < 180 then 4 when {a} < 720 then 5 when {a} < 2880 then 6 else 7 end"""

SURPRISE_TAIL = """,
 hw as (select o.event_id, sum(exp(-(o.event_us - h.event_us) / 60e6 / 720)) as a,
   coalesce(sum(exp(-(o.event_us - h.event_us) / 60e6 / 720)) filter (h.bin = o.bin), 0) as b
   from own o join hist h on h.source = o.source and h.event_us < o.event_us group by 1),
 pw as (select o.event_id, sum(exp(-(o.event_us - h.event_us) / 60e6 / 1440)) as a,
   coalesce(sum(exp(-(o.event_us - h.event_us) / 60e6 / 1440)) filter (h.bin = o.bin), 0) as b
   from own o join phist h on h.event_id = o.event_id group by 1)
 select o.event_id, round(-log2((coalesce(hw.b, 0) + coalesce(pw.b, 0) + 0.5) /
   (coalesce(hw.a, 0) + coalesce(pw.a, 0) + 0.5 * {bins})), 6) as bits
 from own o left join hw using (event_id) left join pw using (event_id)"""
PAIR_ITEMS = """, paid as (select * from pay where kind = 'payment'),
 pn as (select p.event_id, i.event_us, i.seq, i.amount,
    row_number() over (partition by p.event_id order by i.event_us desc, i.seq desc) as k
  from paid p join paid i on i.source = p.source and i.destination = p.destination and i.event_us < p.event_us)"""


@query("amount_surprise_bits", with_cte(PAY_EVENTS, PAIR_ITEMS + f""",
 own as (select event_id, source, event_us, {BIN.format(a='amount')} as bin from paid),
 hist as (select source, event_us, {BIN.format(a='amount')} as bin from paid),
 phist as (select event_id, event_us, {BIN.format(a='amount')} as bin from pn where k <= 6)""" + SURPRISE_TAIL.format(bins=10)))
def amount_surprise_bits(spark, sf):
    df = hs.amount_surprise_bits(pay_events(spark, sf))
    return df.select("event_id", r6(F.col("bits")).alias("bits"))


@query("gap_surprise_bits", with_cte(PAY_EVENTS, PAIR_ITEMS + f""",
 act as (select source as acct, event_us from paid union all select destination, event_us from paid
         union all select destination, event_us from pay where kind = 'deposit'),
 lst as (select p.event_id, max(a.event_us) as last_us from paid p left join act a on a.acct = p.source and a.event_us < p.event_us group by 1),
 own as (select p.event_id, p.source, p.event_us, case when last_us is null then 8
    else {GAP.format(a='((p.event_us - last_us) / 60e6)')} end as bin from paid p join lst using (event_id)),
 lg as (select source, event_us, (event_us - lag(event_us) over (partition by source order by event_us, seq)) / 60e6 as g from paid),
 hist as (select source, event_us, {GAP.format(a='g')} as bin from lg where g is not null),
 pg as (select event_id, event_us, (event_us - lag(event_us) over (partition by event_id order by event_us, seq)) / 60e6 as g from pn where k <= 6),
 phist as (select event_id, event_us, {GAP.format(a='g')} as bin from pg where g is not null)""" + SURPRISE_TAIL.format(bins=9)))
def gap_surprise_bits(spark, sf):
    df = hs.gap_surprise_bits(pay_events(spark, sf))
    return df.select("event_id", r6(F.col("bits")).alias("bits"))


@query("retained_history", with_cte(PAY_ORDERS, """, r as (select event_id, event_us, row_number() over (order by event_us, seq) - 1 as position from pay),
 s as (select event_us, min(position) as stop from r group by 1)
 select event_id, position, stop, greatest(0, stop - 500) as first from r join s using (event_us)"""))
def retained_history(spark, sf):
    return hs.retained_history(pay_orders(spark, sf), 500).select("event_id", "position", "stop", "first")


def _register_graph_feature(name: str, build, sql: str | None = None) -> None:
    @query(name, sql)
    def run(spark, sf):
        return build(spark, sf).select("event_id", r6(F.col(name)).alias(name))


for _name in (
    "graph_sender_pagerank", "graph_recipient_pagerank", "graph_pagerank_error_bound", "graph_pagerank_edge_lag",
):
    _register_graph_feature(_name, _pagerank)
for _name in ("graph_same_component", "graph_sender_component_size", "graph_recipient_component_size"):
    _register_graph_feature(_name, _components, _events(BOTTLENECKS + f" select event_id, {_name} from comp"))
for _name in (
    "graph_ppr_sender_to_recipient", "graph_ppr_recipient_to_sender",
    "graph_ppr_forward_error_bound", "graph_ppr_reverse_error_bound",
):
    _register_graph_feature(_name, _ppr)
for _name in ("graph_sender_degree", "graph_recipient_degree"):
    _register_graph_feature(
        _name,
        lambda spark, sf: gr.degree_features(pay_events(spark, sf)),
        f"select event_id, {_name} from ({_events(DEGREES)})",
    )
