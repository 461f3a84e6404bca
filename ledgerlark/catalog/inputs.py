"""Queries over sources, views, stores and row-level expressions.

File layouts are written by Spark from the given tables into the scratch folder and read back.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.catalog.base import (
    PAY_EVENTS,
    PAY_ORDERS,
    SCORES,
    pay_events,
    pay_orders,
    query,
    r6,
    scores,
    table,
    with_cte,
)
from ledgerlark.functions import scalars as sc
from ledgerlark.operators import features as ft
from ledgerlark.operators import metrics as mt
from ledgerlark.plans.ordering import first_seen_index
from ledgerlark.sources import csv_layouts as cl
from ledgerlark.sources import documents as dc
from ledgerlark.sources import exports as xp
from ledgerlark.sources import store as st
from ledgerlark.sources import views as vw
from ledgerlark.schema import Descriptor, Stream
from ledgerlark.session import cut_lineage, scratch_dir


def _csv(df, name: str) -> str:
    path = scratch_dir(df.sparkSession, name)
    df.write.option("header", True).option("quoteAll", True).csv(path)
    return path


HANDBOOK_SQL = """select cast(o_orderkey as varchar) as event_id, epoch_us(o_orderdate) / 1e6 as event_time,
 'customer' as source_kind, cast(o_custkey as varchar) as source_id, 'terminal' as destination_kind,
 cast(o_custkey % 97 as varchar) as destination_id, o_totalprice as amount,
 cast(case o_orderstatus when 'F' then 1 when 'O' then 0 else -1 end as integer) as label,
 o_orderpriority as scenario from orders"""


def _handbook_path(spark, sf):
    orders = table(spark, sf, "orders")
    return _csv(
        orders.select(
            F.col("o_orderkey").alias("TRANSACTION_ID"),
            (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("TX_TIME_SECONDS"),
            F.col("o_custkey").alias("CUSTOMER_ID"),
            (F.col("o_custkey") % 97).alias("TERMINAL_ID"),
            F.col("o_totalprice").alias("TX_AMOUNT"),
            F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "0").otherwise("").alias("TX_FRAUD"),
            F.col("o_orderpriority").alias("TX_FRAUD_SCENARIO"),
        ),
        "handbook",
    )


def _handbook(spark, sf, check=True):
    return cl.read_handbook(spark, _handbook_path(spark, sf), check=check)


@query("read_handbook", HANDBOOK_SQL)
def read_handbook(spark, sf):
    stream = _handbook(spark, sf)
    return stream.events.join(stream.outcomes, "event_id").select(
        "event_id", "event_time",
        F.col("entities")[0]["kind"].alias("source_kind"), F.col("entities")[0]["id"].alias("source_id"),
        F.col("entities")[1]["kind"].alias("destination_kind"), F.col("entities")[1]["id"].alias("destination_id"),
        F.col("features")["amount"].alias("amount"), "label",
        F.col("diagnostics")["TX_FRAUD_SCENARIO"].alias("scenario"),
    )


@query("read_ulb", """select epoch_us(ts) / 1e6 as event_time, value as amount, round(value * 7 + user_id, 6) as v7,
 cast(case when event_type = 'error' then 1 else 0 end as integer) as label, 0 as entities from events""")
def read_ulb(spark, sf):
    events = table(spark, sf, "events")
    path = _csv(
        events.select(
            (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("Time"),
            *[F.round(F.col("value") * i + F.col("user_id"), 6).alias(f"V{i}") for i in range(1, 29)],
            F.col("value").alias("Amount"),
            F.when(F.col("event_type") == "error", 1).otherwise(0).alias("Class"),
        ),
        "ulb",
    )
    stream = cl.read_ulb(spark, path)
    return stream.events.join(stream.outcomes, "event_id").select(
        "event_time", F.col("features")["amount"].alias("amount"), F.col("features")["V7"].alias("v7"), "label",
        F.size("entities").alias("entities"),
    )


@query("read_paysim", """select (event_id % 700) * 3600.0::double as event_time,
 case event_type when 'view' then 'CASH_IN' when 'click' then 'CASH_OUT' when 'error' then 'DEBIT'
   when 'signup' then 'PAYMENT' else 'TRANSFER' end as event_type, 'C' || user_id as source_id, value as amount,
 cast(case when event_type = 'error' then 1 else 0 end as integer) as label from events""")
def read_paysim(spark, sf):
    kind = (
        F.when(F.col("event_type") == "view", "cash-in").when(F.col("event_type") == "click", "CASH_OUT")
        .when(F.col("event_type") == "error", "debit").when(F.col("event_type") == "signup", "PAYMENT").otherwise("transfer")
    )
    path = _csv(
        table(spark, sf, "events").select(
            (F.col("event_id") % 700).alias("step"), kind.alias("type"), F.col("value").alias("amount"),
            F.concat(F.lit("C"), "user_id").alias("nameOrig"), F.lit(10.0).alias("oldbalanceOrg"),
            F.lit(3.5).alias("newbalanceOrig"), F.concat(F.lit("M"), F.col("event_id") % 50).alias("nameDest"),
            F.lit(0.0).alias("oldbalanceDest"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("isFraud"),
        ),
        "paysim",
    )
    stream = cl.read_paysim(spark, path)
    return stream.events.join(stream.outcomes, "event_id").select(
        "event_time", "event_type", F.col("entities")[0]["id"].alias("source_id"),
        F.col("features")["amount"].alias("amount"), "label",
    )


@query("scan_csv_files", """select count(*) as rows, count(*) as distinct_positions, count(*) - 1 as last_position,
 cast(0 as bigint) as disordered from orders""")
def scan_csv_files(spark, sf):
    ordered = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority").repartitionByRange(4, "o_orderkey")
    path = _csv(ordered.sortWithinPartitions("o_orderkey"), "scan")
    rows = cl.scan_csv_files(spark, path, ["o_orderkey"])
    expected = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("k"))
    from ledgerlark.plans.prefix import global_rank

    ranked = global_rank(expected.withColumn("n", F.col("k").cast("bigint")), ["n"], "place")
    joined = rows.join(ranked, F.col("o_orderkey") == F.col("k"))
    return joined.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(cl.SEQ).alias("distinct_positions"),
        F.max(cl.SEQ).alias("last_position"), F.count_if(F.col(cl.SEQ) != F.col("place")).alias("disordered"),
    )


@query("validate_events", """select cast(o_orderkey as varchar) as event_id, 'label-value' as rule from orders where o_orderkey % 29 = 0 and o_orderkey % 31 <> 0
 union all select cast(o_orderkey as varchar), 'range TX_AMOUNT' from orders where o_orderkey % 31 = 0
 union all select 'twice', 'event-id-repeated'""")
def validate_events(spark, sf):
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    twice = F.when((key % 29 != 0) & (key % 31 != 0) & (key < 100), F.lit("twice")).otherwise(key.cast("string"))
    path = _csv(
        orders.select(
            twice.alias("TRANSACTION_ID"),
            (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("TX_TIME_SECONDS"),
            F.col("o_custkey").alias("CUSTOMER_ID"), (F.col("o_custkey") % 97).alias("TERMINAL_ID"),
            F.when(key % 31 == 0, "NaN").otherwise(F.col("o_totalprice").cast("string")).alias("TX_AMOUNT"),
            F.when(key % 29 == 0, "maybe").otherwise("0").alias("TX_FRAUD"),
        ),
        "bad",
    )
    parsed, descriptor = cl.read_parsed(spark, "handbook", path)
    return cl.parse_violations(parsed, descriptor).filter("rule <> 'outcome-absent'").select("event_id", "rule").distinct()


def _stream_of(spark, sf, graph=True):
    """Order payments as an event stream with outcomes kept apart."""
    base = pay_orders(spark, sf)

    def entity(column, role):
        parts = F.split(column, ":", 2)
        return F.struct(F.element_at(parts, 1).alias("kind"), F.element_at(parts, 2).alias("id"), F.lit(role).alias("role"))

    events = base.select(
        "event_id", (F.col("event_us") / 1e6).alias("event_time"), "event_us", F.lit("payment").alias("event_type"),
        F.array(entity("source", "source"), entity("destination", "destination")).alias("entities"),
        F.create_map(F.lit("amount"), F.col("amount")).alias("features"), F.col("seq").alias("arrival_seq"),
    )
    outcomes = base.select(
        "event_id", "label",
        F.when(F.col("label") >= 0, F.col("available_us") / 1e6).alias("available_at"),
        F.create_map().cast("map<string,string>").alias("diagnostics"),
    )
    descriptor = Descriptor("orders", entity_types=("customer", "supplier"), graph=True, currency="EUR")
    return Stream(descriptor, events, outcomes)


@query("open_prepared", with_cte(PAY_ORDERS, """
 select event_id, event_us, seq as arrival_seq, split_part(source, ':', 2) as source, split_part(destination, ':', 2) as destination,
   cast(amount as double) as amount, label, case when label >= 0 then available_us end as available_us from pay"""))
def open_prepared(spark, sf):
    """Every stored event and outcome after the digests of all ranges were checked."""
    path = scratch_dir(spark, "prepared")
    st.write_prepared(_stream_of(spark, sf), path)
    stream = st.open_prepared(spark, path)
    name = lambda i: F.element_at("entities", i)["id"]
    events = stream.events.select(
        "event_id", "event_us", "arrival_seq", name(1).alias("source"), name(2).alias("destination"),
        F.col("features")["amount"].cast("double").alias("amount"),
    )
    available = F.round(F.col("available_at") * 1e6).cast("bigint").alias("available_us")
    return events.join(stream.outcomes.select("event_id", "label", available), "event_id")


@query("prepared_range_digests", with_cte(PAY_ORDERS, """
 select 'events' as part, count(*) as rows, min(event_us) as low, max(event_us) as high from pay
 union all select 'outcomes', count(*), null, null from pay"""))
def prepared_range_digests(spark, sf):
    """The digests of all ranges as the manifest has them, added up."""
    path = scratch_dir(spark, "prepared")
    stream = _stream_of(spark, sf)
    st.write_prepared(stream, path)
    stored = spark.read.parquet(f"{path}/digests")
    return stored.groupBy("part").agg(F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))


@query("scan_interval", with_cte(PAY_ORDERS, " select event_id from pay where event_us >= 852076800000000 and event_us < 883612800000000"))
def scan_interval(spark, sf):
    stream = _stream_of(spark, sf)
    return st.scan_interval(stream.events, 852076800.0, 883612800.0).select("event_id")


@query("truth_for", with_cte(PAY_ORDERS, " select event_id, label from pay where seq % 10 = 0"))
def truth_for(spark, sf):
    stream = _stream_of(spark, sf)
    ids = stream.events.filter("arrival_seq % 10 = 0").select("event_id").union(
        stream.events.filter("arrival_seq % 10 = 0").select(F.concat(F.lit("none"), "event_id"))
    )
    return st.truth_for(stream.outcomes, ids).select("event_id", "label")


@query("read_numeric_csv", with_cte(SCORES, """ select event_id as id, event_us / 1e6 as time, label, amount, cast(score as double) as score from scored"""))
def read_numeric_csv(spark, sf):
    path = _csv(
        scores(spark, sf).select(
            F.col("event_id").alias("transaction_id"), (F.col("event_us") / 1e6).alias("timestamp"),
            F.when(F.col("label") < 0, "unknown").otherwise(F.col("label").cast("string")).alias("is_fraud"), "amount", "score",
        ),
        "numeric",
    )
    rows = cl.read_numeric_csv(spark, path, "transaction_id", "timestamp", "is_fraud", ["amount", "score"])
    return rows.select("id", "time", "label", "amount", "score")


PAYMENT_COLUMNS = {
    "id": "transaction_id", "time": "timestamp", "sender": "sender_account", "recipient": "recipient_account",
    "amount": "amount_eur", "label": "is_fraud", "label_available_at": "outcome_confirmed_at", "kind": "kind",
}


def _payment_csv(spark, sf):
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    base = pay_orders(spark, sf)
    rows = base.repartitionByRange(4, "seq").sortWithinPartitions("seq").select(
        F.col("event_id").alias("transaction_id"),
        F.date_format(F.timestamp_micros("event_us"), iso).alias("timestamp"),
        F.col("source").alias("sender_account"), F.col("destination").alias("recipient_account"),
        F.col("amount").alias("amount_eur"), "kind",
        F.when(F.col("label") >= 0, F.col("label").cast("string")).otherwise("").alias("is_fraud"),
        F.coalesce(F.date_format(F.timestamp_micros("available_us"), iso), F.lit("")).alias("outcome_confirmed_at"),
    )
    return dc.read_payment_csv(spark, _csv(rows, "payments"), PAYMENT_COLUMNS, "iso8601")


FIRST_SEEN_SQL = """, fs as (select key, min(k) as k from (
   select source as key, seq * 2 as k from pay union all select destination, seq * 2 + 1 from pay) group by 1),
 ids as (select key, row_number() over (order by k) - 1 as idx from fs)"""


@query("read_payment_csv", with_cte(PAY_ORDERS, FIRST_SEEN_SQL + """, z as (select min(event_us) as z from pay)
 select p.event_id as id, round((p.event_us - z) / 60e6, 6) as t, a.idx as u, b.idx as v, amount,
   case when label >= 0 then label end as label,
   round(case when label >= 0 then (available_us - z) / 60e6 end, 6) as available_at
 from pay p join ids a on a.key = source join ids b on b.key = destination, z"""))
def read_payment_csv(spark, sf):
    document = _payment_csv(spark, sf)
    return document.events.join(document.outcomes, "id", "left").select(
        "id", r6(F.col("t")).alias("t"), "u", "v", "amount", "label", r6(F.col("available_at")).alias("available_at")
    )


@query("first_seen_index", with_cte(PAY_ORDERS, FIRST_SEEN_SQL + " select key, idx as index from ids"))
def first_seen(spark, sf):
    return first_seen_index(pay_orders(spark, sf), [F.col("source"), F.col("destination")], ["seq"])


@query("payments_view", with_cte(PAY_ORDERS, """, fs as (select key, min((event_us, k)) as k from (
   select source as key, event_us, seq * 2 as k from pay union all select destination, event_us, seq * 2 + 1 from pay) group by 1),
 ids as (select key, row_number() over (order by k) - 1 as idx from fs)
 select p.event_id as id, round(event_us / 60e6, 6) as t, a.idx as u, b.idx as v, round(amount * 1.25, 6) as amount,
   '["orders","1","' || replace(source, ':', '","') || '"]' as sender
 from pay p join ids a on a.key = source join ids b on b.key = destination"""))
def payments_view(spark, sf):
    stream = _stream_of(spark, sf)
    document = dc.payments_view(replace(stream, descriptor=replace(stream.descriptor, currency="USD")), 1.25)
    names = document.accounts.select(F.col("id").alias("u"), F.col("external_id").alias("sender"))
    return document.events.join(names, "u").select(
        "id", r6(F.col("t")).alias("t"), "u", "v", r6(F.col("amount")).alias("amount"), "sender"
    )


def _document(spark, sf):
    """Events table as a payment document with deposits and reports."""
    base = pay_events(spark, sf)
    rows = base.filter("source is null or source <> destination")
    ids = first_seen_index(rows, [F.col("source"), F.col("destination")], ["seq"], "id")
    accounts = ids.select("id", F.col("key").alias("external_id"), F.col("key").alias("name"))
    u = ids.select(F.col("key").alias("source"), F.col("id").alias("u"))
    v = ids.select(F.col("key").alias("destination"), F.col("id").alias("v"))
    events = rows.join(u, "source", "left").join(v, "destination").select(
        F.col("event_id").alias("id"), "kind", (F.col("event_us") / 60e6).alias("t"),
        F.coalesce("u", F.lit(-1)).cast("bigint").alias("u"), "v", "amount", "settled",
        F.when(F.col("kind") == "report", (F.col("seq") - F.col("seq") % 10).cast("string")).alias("reference"), "seq",
    )
    outcomes = events.filter("kind = 'payment'").select(
        "id", F.when(F.col("amount") > 40, 1).otherwise(0).alias("label"),
        F.when(F.col("seq") % 2 == 0, F.col("t") + 30).alias("available_at"),
    )
    return dc.PaymentDocument(accounts, events, outcomes)


DOCUMENT_SQL = """, d as (select * from pay where source is null or source <> destination)"""


@query("document_violations", with_cte(PAY_EVENTS, DOCUMENT_SQL + """
 select event_id, 'time-or-amount' as rule from d where seq % 101 = 0
 union all select event_id, 'outcome-unpaid' from d where kind = 'deposit' and seq % 50 = 0"""))
def document_violations(spark, sf):
    document = _document(spark, sf)
    broken = document.events.withColumn("amount", F.when(F.col("seq") % 101 == 0, -1.0).otherwise(F.col("amount")))
    odd = document.events.filter("kind = 'deposit' and seq % 50 = 0").select("id", F.lit(1).alias("label"), F.lit(None).cast("double").alias("available_at"))
    found = dc.document_violations(dc.PaymentDocument(document.accounts, broken, document.outcomes.union(odd)))
    return found.select("event_id", "rule")


@query("export_payment_document", with_cte(PAY_EVENTS, DOCUMENT_SQL + """
 select event_id as id, kind, round(event_us / 60e6, 6) as t, amount, settled from d"""))
def export_payment_document(spark, sf):
    path = scratch_dir(spark, "document")
    dc.export_payment_document(_document(spark, sf), path)
    back = dc.import_payment_document(spark, path)
    return back.events.select("id", "kind", r6(F.col("t")).alias("t"), "amount", "settled")


def _documents(spark, sf, most=1000):
    """The events table as many documents of at most ``most`` rows, each with accounts of its own."""
    rows = pay_events(spark, sf).filter("source is null or source <> destination").withColumn(
        "document", F.format_string("part-%012d", F.floor(F.col("seq") / most))
    )
    ends = rows.select("document", F.explode(F.array("source", "destination")).alias("external_id"))
    within = Window.partitionBy("document").orderBy("external_id")  # the accounts of one document
    accounts = cut_lineage(
        ends.filter("external_id is not null").distinct().withColumn("id", (F.row_number().over(within) - 1).cast("bigint"))
    ).withColumn("name", F.col("external_id"))
    u = accounts.select("document", F.col("external_id").alias("source"), F.col("id").alias("u"))
    v = accounts.select("document", F.col("external_id").alias("destination"), F.col("id").alias("v"))
    events = rows.join(u, ["document", "source"], "left").join(v, ["document", "destination"]).select(
        "document", F.col("event_id").alias("id"), "kind", (F.col("event_us") / 60e6).alias("t"),
        F.coalesce("u", F.lit(-1)).cast("bigint").alias("u"), "v", "amount", "settled", F.lit(None).cast("string").alias("reference"), "seq",
    )
    outcomes = events.filter("kind = 'payment'").select(
        "document", "id", F.when(F.col("amount") > 40, 1).otherwise(0).alias("label"),
        F.when(F.col("seq") % 2 == 0, F.col("t") + 30).alias("available_at"),
    )
    return dc.PaymentDocuments(accounts.select("document").distinct(), accounts, events, outcomes)


@query("read_payment_json", with_cte(PAY_EVENTS, DOCUMENT_SQL + """
 select 'part-' || lpad(cast(seq // 1000 as varchar), 12, '0') as document, event_id as id, kind, round(event_us / 60e6, 6) as t,
   source as sender, destination as recipient, amount, settled,
   cast(case when kind = 'payment' then case when amount > 40 then 1 else 0 end end as integer) as label,
   case when kind = 'payment' and seq % 2 = 0 then round(event_us / 60e6 + 30, 6) end as available_at from d"""))
def read_payment_json(spark, sf):
    path = scratch_dir(spark, "json")
    dc.write_payment_documents(_documents(spark, sf), path, per_file=4)
    read = dc.read_payment_documents(spark, path)
    names = lambda i, name: read.accounts.select("document", F.col("id").alias(i), F.col("external_id").alias(name))
    rows = read.events.join(read.outcomes, ["document", "id"], "left").join(names("u", "sender"), ["document", "u"], "left")
    return rows.join(names("v", "recipient"), ["document", "v"], "left").select(
        "document", "id", "kind", r6(F.col("t")).alias("t"), "sender", "recipient", "amount", "settled", "label",
        r6(F.col("available_at")).alias("available_at"),
    )


@query("compose_episodes", with_cte(PAY_EVENTS, DOCUMENT_SQL + """,
 h as (select case when event_us < 1705276800000000 then 1 else 2 end as ep, * from d),
 b as (select ep, min(event_us) / 60e6 as lo, max(event_us) / 60e6 as hi from h group by 1),
 o as (select ep, case when ep = 1 then 0 else (select hi - lo + 60 from b where ep = 1) end - lo as shift from b)
 select 'episode-' || ep || ':' || event_id as id, round(event_us / 60e6 + shift, 4) as t, amount from h join o using (ep)"""))
def compose_episodes(spark, sf):
    document = _document(spark, sf)
    cut = 1705276800.0
    first = dc.select_payment_interval(document, stop=cut)
    second = dc.select_payment_interval(document, start=cut)
    whole, _ = dc.compose_episodes([first, second])
    return whole.events.select("id", F.round("t", 4).alias("t"), "amount")


@query("select_payment_interval", with_cte(PAY_EVENTS, DOCUMENT_SQL + """,
 h as (select * from d where event_us >= 1704672000000000 and event_us < 1705276800000000),
 a as (select distinct x from (select source as x from h where kind = 'payment' union all select destination from h))
 select (select count(*) from h) as events, (select count(*) from a) as accounts,
   (select count(*) from a) - 1 as largest_id, (select count(*) from h where kind = 'payment') as outcomes"""))
def select_payment_interval(spark, sf):
    part = dc.select_payment_interval(_document(spark, sf), 1704672000.0, 1705276800.0)
    from ledgerlark.plans.prefix import with_scalars

    sizes = with_scalars(
        part.events.agg(F.count(F.lit(1)).alias("events")),
        part.accounts.agg(F.count(F.lit(1)).alias("accounts"), F.max("id").alias("largest_id")),
    )
    return with_scalars(sizes, part.outcomes.agg(F.count(F.lit(1)).alias("outcomes")))


@query("report_availability", with_cte(PAY_EVENTS, DOCUMENT_SQL + """
 select r.ref as id, round(min(r.event_us / 60e6), 6) as available_at from
 (select cast(seq - seq % 10 as varchar) as ref, event_us from d where kind = 'report') r
 join d p on p.event_id = r.ref and p.kind = 'payment' group by 1"""))
def report_availability(spark, sf):
    found = dc.report_availability(_document(spark, sf))
    return found.select("id", r6(F.col("available_at")).alias("available_at"))


@query("read_temporal_links", with_cte(PAY_ORDERS, FIRST_SEEN_SQL + """
 select p.event_id, (event_us - (select min(event_us) from pay)) / 1e6 as time, a.idx as src, b.idx as dst, amount * 2 as weight
 from pay p join ids a on a.key = source join ids b on b.key = destination"""))
def read_temporal_links(spark, sf):
    base = pay_orders(spark, sf)
    rows = base.repartitionByRange(4, "seq").sortWithinPartitions("seq").select(
        F.col("seq").alias("idx"), F.col("source").alias("u"), F.col("destination").alias("i"), (F.col("event_us") / 1e6).alias("ts")
    )
    edge_table = base.select(F.col("seq").alias("index"), (F.col("amount") * 2).alias("weight"))
    graph = vw.read_temporal_links(spark, _csv(rows, "links"), edge_features=edge_table)
    return graph.edges.select("event_id", "time", "src", "dst", "weight")


@query("lookup_indexed_features", with_cte(PAY_ORDERS, " select event_id, round(amount / 3, 6) as f0 from pay"))
def lookup_indexed_features(spark, sf):
    base = pay_orders(spark, sf)
    features = base.select(F.col("seq").alias("index"), r6(F.col("amount") / 3).alias("f0"))
    return vw.lookup_indexed_features(base.select("event_id", "seq"), "seq", features).select("event_id", "f0")


@query("graph_view", with_cte(PAY_ORDERS, """, fs as (select key, min((event_us, k)) as k from (
   select source as key, event_us, seq * 2 as k from pay union all select destination, event_us, seq * 2 + 1 from pay) group by 1),
 ids as (select key, row_number() over (order by k) - 1 as idx from fs)
 select p.event_id, (event_us - (select min(event_us) from pay)) / 1e6 as time, a.idx as src, b.idx as dst, round(ln(1 + amount), 6) as log1p_amount
 from pay p join ids a on a.key = source join ids b on b.key = destination"""))
def graph_view(spark, sf):
    graph = vw.graph_view(_stream_of(spark, sf))
    return graph.edges.select("event_id", "time", "src", "dst", r6(F.col("log1p_amount")).alias("log1p_amount"))


@query("labeled_graph_view", with_cte(PAY_ORDERS, """
 select event_id, label, case when label >= 0 then (available_us - (select min(event_us) from pay)) / 1e6 end as available_at from pay"""))
def labeled_graph_view(spark, sf):
    stream = _stream_of(spark, sf)
    edges, _ = vw.labeled_graph_view(vw.graph_view(stream), stream.outcomes)
    return edges.select("event_id", "label", "available_at")


@query("align_features_to_graph", with_cte(PAY_ORDERS, " select event_id, round(sqrt(amount), 6) as root from pay"))
def align_features_to_graph(spark, sf):
    stream = _stream_of(spark, sf)
    edges, _ = vw.labeled_graph_view(vw.graph_view(stream), stream.outcomes)
    stored = edges.select("event_id", "time", "label").join(
        pay_orders(spark, sf).select("event_id", F.sqrt("amount").alias("root")), "event_id"
    )
    return vw.align_features_to_graph(edges, stored, ["root"]).select("event_id", r6(F.col("root")).alias("root"))


@query("rebase_clock", with_cte(PAY_ORDERS, " select event_id, event_us / 1e6 - (select min(event_us) / 1e6 from pay) as time from pay"))
def rebase_clock(spark, sf):
    return vw.rebase_clock(_stream_of(spark, sf).events)[0].select("event_id", "time")


@query("numeric_view", with_cte(PAY_ORDERS, " select event_id, amount, round(ln(1 + amount), 6) as log1p_amount, label from pay"))
def numeric_view(spark, sf):
    df = vw.numeric_view(_stream_of(spark, sf), ["amount", "log1p_amount"])
    return df.select("event_id", "amount", r6(F.col("log1p_amount")).alias("log1p_amount"), "label")


@query("project_features", with_cte(PAY_ORDERS, " select event_id, round(ln(1 + amount * 0.5), 6) as log1p_amount from pay"))
def project_features(spark, sf):
    df = vw.project_features(_stream_of(spark, sf), ["log1p_amount"], 0.5)
    return df.select("event_id", r6(F.col("log1p_amount")).alias("log1p_amount"))


FEATURE_CHOICE = ["log_amount", "sender_out_count", "pair_out_count"]


@query("read_features", with_cte(PAY_ORDERS, " select event_id, round(ln(1 + amount) / 8, 6) as log_amount from pay"))
def read_features(spark, sf):
    path = scratch_dir(spark, "features")
    st.write_features(ft.payment_features(pay_orders(spark, sf), FEATURE_CHOICE), FEATURE_CHOICE, path)
    return st.read_features(spark, path)[0].select("event_id", r6(F.col("log_amount")).alias("log_amount"))


@query("save_feature_variant", with_cte(PAY_ORDERS, " select event_id, round(ln(1 + amount) / 8, 6) as log_amount from pay"))
def save_feature_variant(spark, sf):
    path, target = scratch_dir(spark, "features"), scratch_dir(spark, "variant")
    versions = {n: ft.REGISTRY[n].version for n in FEATURE_CHOICE}
    st.write_features(ft.payment_features(pay_orders(spark, sf), FEATURE_CHOICE), FEATURE_CHOICE, path, versions)
    st.save_feature_variant(spark, path, ["log_amount"], target)
    rows, _ = st.read_features(spark, target)
    return rows.select("event_id", r6(F.col("log_amount")).alias("log_amount"))


STAGE_SQL = """, u as (select event_us, row_number() over (order by event_us) - 1 as r,
  count(*) over () as n from (select distinct event_us from scored)),
 parts as (select scored.*, case when r < cast(floor(n * 0.6) as bigint) then 'train'
  when r < cast(floor(n * (0.6::double + 0.2::double)) as bigint) then 'validation' else 'test' end as partition
  from scored join u using (event_us)),
 lim as (select 'train' as partition, min(event_us) - 1 as cut from parts where partition = 'validation'
   union all select 'validation', min(event_us) - 1 from parts where partition = 'test'),
 staged as (select parts.*, case when available_us > cut then -1 else label end as masked from parts left join lim using (partition))"""


@query("stage_asof_training_table", with_cte(SCORES, STAGE_SQL + " select event_id, partition, masked as label from staged"))
def stage_asof_training_table(spark, sf):
    return st.stage_asof_table(scores(spark, sf))[0].select("event_id", "partition", "label")


@query("stage_masked_counts", with_cte(SCORES, STAGE_SQL + """
 select partition, count(*) filter (label >= 0 and masked < 0) as masked, count(*) as rows from staged group by 1"""))
def stage_masked_counts(spark, sf):
    return st.stage_asof_table(scores(spark, sf))[1]


@query("inspect_dataset", with_cte(PAY_ORDERS, """ select count(*) as rows, count(*) filter (label >= 0) as known,
 count(*) filter (label = 1) as fraud, count(*) filter (label = 0) as legitimate, count(*) filter (label < 0) as unknown,
 count(*) filter (label >= 0 and available_us is not null) as recorded_availability,
 min(event_us) / 1e6 as first_seconds, max(event_us) / 1e6 as last_seconds from pay"""))
def inspect_dataset(spark, sf):
    stream = _stream_of(spark, sf)
    return st.inspect_dataset(stream.events, stream.outcomes)


@query("interval_guard", with_cte(PAY_ORDERS, """ select count(*) as events,
 count(distinct source) + count(distinct destination) as entities,
 count(*) <= 20000 and count(distinct source) + count(distinct destination) <= 256 as within_limits from pay"""))
def interval_guard(spark, sf):
    return st.interval_guard(_stream_of(spark, sf).events)


def _records(spark, sf):
    base = scores(spark, sf)
    risky = F.when(F.col("seq") % 50 == 0, F.concat(F.lit("=cmd|"), "source")).otherwise(F.col("source"))
    return base.select(
        "event_id", (F.col("event_us") / 60e6).alias("time_minutes"), risky.alias("sender"),
        F.col("destination").alias("recipient"), F.col("amount").alias("amount_eur"), (F.col("score") / 20).alias("probability"),
        F.col("score").alias("score_bits"), F.lit(12.0).alias("threshold_bits"),
        F.when(F.col("score") > 12, "BLOCK").otherwise("ALLOW").alias("decision"), F.lit(True).alias("settled"),
        F.col("label").alias("outcome"), F.col("score").alias("raw_margin"), F.lit(0.5).alias("baseline"),
        F.array("amount", "score").alias("values"), F.array("amount", "score").alias("inputs"),
        F.array(F.col("score") / 2, F.col("score") / 4).alias("contributions"),
    )


@query("export_predictions_csv", with_cte(SCORES, """
 select event_id, case when seq % 50 = 0 then '''=cmd|' || source else source end as sender,
   case when score > 12 then 'BLOCK' else 'ALLOW' end as decision, round(score / 4, 6) as score_shap from scored"""))
def export_predictions_csv(spark, sf):
    path = scratch_dir(spark, "export")
    xp.export_predictions_csv(_records(spark, sf), ["amount", "score"], path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("event_id", "sender", "decision", r6(F.col("score_shap")).alias("score_shap"))


@query("export_predictions_json", with_cte(SCORES, " select event_id, round(score / 20, 6) as probability from scored"))
def export_predictions_json(spark, sf):
    path = scratch_dir(spark, "export")
    xp.export_predictions_json(_records(spark, sf), path)
    return spark.read.json(path).select("event_id", r6(F.col("probability")).alias("probability"))


# --- Row-level expressions ----------------------------------------------------------------------


@query("finite_number", """select event_id, case when event_id % 5 = 0 or event_id % 7 = 0 then null else value end as number from events""")
def finite_number(spark, sf):
    df = table(spark, sf, "events")
    text = F.when(F.col("event_id") % 5 == 0, "n/a").when(F.col("event_id") % 7 == 0, "Infinity").otherwise(F.col("value").cast("string"))
    return df.select("event_id", sc.finite_number(text, True).alias("number"))


@query("tri_label", """select event_id, cast(case event_id % 5 when 0 then -1 when 1 then 1 when 2 then 0 when 3 then -1 end as integer) as label from events""")
def tri_label(spark, sf):
    df = table(spark, sf, "events")
    text = F.element_at(F.array(*[F.lit(x) for x in ("", "1", " 0", "Unknown", "maybe")]), (F.col("event_id") % 5 + 1).cast("int"))
    return df.select("event_id", sc.tri_label(text).alias("label"))


@query("to_seconds", """select event_id, case when event_id % 3 = 0 then null else (epoch_us(ts) - 7200000000) / 1e6 end as seconds,
 value * 3600 as hours_in_seconds from events""")
def to_seconds(spark, sf):
    df = table(spark, sf, "events")
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    zoned = F.when(F.col("event_id") % 3 == 0, text).otherwise(F.concat(text, F.lit("+02:00")))
    return df.select(
        "event_id", sc.to_seconds(zoned, "iso8601").alias("seconds"), sc.to_seconds(F.col("value"), "hours").alias("hours_in_seconds")
    )


@query("entity_key", """select event_id, '["events","1","account","' || user_id || '"]' as key from events""")
def entity_key(spark, sf):
    return table(spark, sf, "events").select("event_id", sc.entity_key("events", "1", "account", F.col("user_id")).alias("key"))


@query("convert_currency", with_cte(PAY_ORDERS, " select event_id, round(amount * 0.92, 6) as amount from pay"))
def convert_currency(spark, sf):
    return pay_orders(spark, sf).select("event_id", r6(sc.convert_currency(F.col("amount"), "USD", 0.92)).alias("amount"))


@query("amount_bin", """select event_id, cast(case when value < 15 then 0 when value < 35 then 1 when value < 75 then 2 when value < 150 then 3
 when value < 300 then 4 when value < 650 then 5 when value < 1500 then 6 when value < 4000 then 7 when value < 10000 then 8 else 9 end as integer) as bin from events""")
def amount_bin(spark, sf):
    return table(spark, sf, "events").select("event_id", sc.amount_bin(F.col("value")).alias("bin"))


@query("scaled_log1p", "select event_id, round(ln(1 + greatest(0, value - 10)) / 6, 6) as x from events")
def scaled_log1p(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(sc.scaled_log1p(F.col("value") - 10, 6)).alias("x"))


@query("mask_labels", with_cte(PAY_ORDERS, " select event_id, cast(case when available_us > 883612800000000 then -1 else label end as integer) as label from pay"))
def mask_labels(spark, sf):
    df = pay_orders(spark, sf)
    return df.select("event_id", sc.mask_label(F.col("label"), F.col("available_us"), F.lit(883612800000000)).alias("label"))


@query("observation_signature", with_cte(PAY_ORDERS, " select count(*) as rows, count(distinct (source, destination, event_us, amount)) as signatures from pay"))
def observation_signature(spark, sf):
    df = pay_orders(spark, sf)
    signature = sc.payment_signature(F.col("source"), F.col("destination"), F.col("event_us"), F.col("amount"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(signature).alias("signatures"))


@query("classify_outcome", with_cte(SCORES, """ select event_id, case when seq % 9 = 0 then 'warmup' when label < 0 then 'unknown'
 when label = 1 then case when score > 12 then 'tp' else 'fn' end else case when score > 12 then 'fp' else 'tn' end end as outcome from scored"""))
def classify_outcome(spark, sf):
    decision = F.when(F.col("seq") % 9 == 0, "LEARNING").when(F.col("score") > 12, "BLOCK").otherwise("ALLOW")
    return scores(spark, sf).select("event_id", sc.classify_outcome(decision, F.col("label")).alias("outcome"))


@query("gap_bin", """select event_id, cast(case when user_id = 0 then 8 when value < 1 then 0 when value < 5 then 1 when value < 20 then 2 when value < 60 then 3
 when value < 180 then 4 when value < 720 then 5 when value < 2880 then 6 else 7 end as integer) as bin from events""")
def gap_bin(spark, sf):
    return table(spark, sf, "events").select("event_id", sc.gap_bin(F.col("value"), F.col("user_id")).alias("bin"))


@query("time_encoding", """select event_id, round(cos(ln(1 + abs(value))), 6) as e0, round(cos(ln(1 + abs(value)) * 1e-3), 6) as e1,
 round(cos(ln(1 + abs(value)) * 1e-6), 6) as e2, round(cos(ln(1 + abs(value)) * 1e-9), 6) as e3 from events""")
def time_encoding(spark, sf):
    df = table(spark, sf, "events").withColumn("e", sc.time_encoding(F.col("value"), 4))
    return df.select("event_id", *[r6(F.col("e")[i]).alias(f"e{i}") for i in range(4)])


# --- Extension points -----------------------------------------------------------------------------


@query("register_recipe", with_cte(PAY_ORDERS, """,
 c as (select p.event_id, count(x.event_id) as n from pay p left join pay x on x.source = p.source and x.event_us < p.event_us group by 1)
 select event_id, round(1.0 / (1 + n), 6)::double as sender_novelty from c"""))
def register_recipe(spark, sf):
    if "sender_novelty" not in ft.REGISTRY:
        ft.register_recipe(
            ft.Recipe(
                "sender_novelty", ("identities",),
                lambda: F.lit(1.0) / (1 + F.col("raw_sender_out_count")), needs=("account",),
            )
        )
    df = ft.payment_features(pay_orders(spark, sf), ["sender_novelty"])
    return df.select("event_id", r6(F.col("sender_novelty")).alias("sender_novelty"))


@query("register_adapter", "select cast(o_orderkey as varchar) as event_id, o_totalprice as amount from orders")
def register_adapter(spark, sf):
    if "cents" not in cl.ADAPTERS:

        def parse(raw, descriptor):
            whole = raw.withColumn("TX_AMOUNT", F.col("TX_AMOUNT").cast("double") / 100)
            return cl.ADAPTERS["handbook"].parse(whole, descriptor)

        base = cl.ADAPTERS["handbook"]
        cl.register_adapter(cl.Adapter("cents", parse, base.required, replace(base.descriptor, dataset_id="cents")))
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("TRANSACTION_ID"),
        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("TX_TIME_SECONDS"),
        F.col("o_custkey").alias("CUSTOMER_ID"), (F.col("o_custkey") % 97).alias("TERMINAL_ID"),
        F.round(F.col("o_totalprice") * 100, 0).cast("bigint").alias("TX_AMOUNT"),
    )
    stream = cl.read_transactions(spark, "cents", _csv(orders, "cents"))
    return stream.events.select("event_id", F.col("features")["amount"].alias("amount"))
