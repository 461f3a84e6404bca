"""Registration of the queries, and the payment views over the given tables.

Every query reads the given parquet tables (or what Spark derives from them) and, where SQL can
say the same, carries a DuckDB text for the result check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column: Column) -> Column:
    """Doubles are compared after rounding to six decimals."""
    return F.round(column.cast("double"), 6)


def pay_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payment per order, customer to its first supplier (0 for an order without lines); dates tie often."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.min("l_suppkey").alias("supp"), F.max("l_shipdate").alias("shipped"))
    )
    return (
        table(spark, sf_dir, "orders")
        .join(lines, "o_orderkey", "left")
        .select(
            F.col("o_orderkey").cast("string").alias("event_id"),
            F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("event_us"),
            F.col("o_orderkey").alias("seq"),
            F.lit("payment").alias("kind"),
            F.concat(F.lit("customer:"), F.col("o_custkey")).alias("source"),
            F.concat(F.lit("supplier:"), F.coalesce("supp", F.lit(0))).alias("destination"),
            F.col("o_totalprice").alias("amount"),
            F.when(F.col("o_orderstatus") == "F", 1)
            .when(F.col("o_orderstatus") == "O", 0)
            .otherwise(-1)
            .alias("label"),
            F.when(
                F.col("shipped") >= F.col("o_orderdate"),
                F.unix_micros(F.col("shipped").cast("timestamp")),
            ).alias("available_us"),
        )
    )


PAY_ORDERS = """
lines as (
  select l_orderkey, min(l_suppkey) as supp, max(l_shipdate) as shipped from lineitem group by 1
),
pay as (
  select cast(o_orderkey as varchar) as event_id, epoch_us(o_orderdate) as event_us,
         o_orderkey as seq, 'payment' as kind, 'customer:' || o_custkey as source,
         'supplier:' || coalesce(supp, 0) as destination, o_totalprice as amount,
         case o_orderstatus when 'F' then 1 when 'O' then 0 else -1 end as label,
         case when shipped >= o_orderdate then epoch_us(shipped) end as available_us,
         true as settled
  from orders left join lines on l_orderkey = o_orderkey
)"""


def pay_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Microsecond clock, one kind of account on both ends, with deposits and reports."""
    events = table(spark, sf_dir, "events")
    kind = (
        F.when(F.col("event_type") == "signup", "deposit")
        .when(F.col("event_type") == "error", "report")
        .otherwise("payment")
    )
    user = F.concat(F.lit("account:"), F.col("user_id"))
    other = F.concat(F.lit("account:"), F.get_json_object("props", "$.k"))
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("event_us"),
        F.col("event_id").alias("seq"),
        kind.alias("kind"),
        F.when(kind == "payment", user).alias("source"),
        F.when(kind == "deposit", user).otherwise(other).alias("destination"),
        F.col("value").alias("amount"),
        (F.col("event_type") != "view").alias("settled"),
    )


PAY_EVENTS = """
pay as (
  select cast(event_id as varchar) as event_id, epoch_us(ts) as event_us, event_id as seq,
         case event_type when 'signup' then 'deposit' when 'error' then 'report' else 'payment' end as kind,
         case when event_type in ('signup', 'error') then null else 'account:' || user_id end as source,
         case event_type when 'signup' then 'account:' || user_id
              else 'account:' || json_extract_string(props, '$.k') end as destination,
         value as amount, event_type <> 'view' as settled
  from events
)"""


def with_cte(cte: str, body: str) -> str:
    return "with " + cte.strip() + body


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic model scores with many ties, for the evaluation operators."""
    return pay_orders(spark, sf_dir).select(
        "event_id", "event_us", "seq", "label", "available_us", "source", "destination", "amount",
        F.round(F.log(1 + F.col("amount")), 1).alias("score"),
    )


SCORES = PAY_ORDERS + """,
scored as (select *, round(ln(1 + amount), 1) as score from pay)"""
