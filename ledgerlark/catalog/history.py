"""Queries over the payment-history features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.catalog.base import (
    PAY_EVENTS,
    PAY_ORDERS,
    pay_events,
    pay_orders,
    query,
    r6,
)
from ledgerlark.operators import features as ft

HISTORY_SQL = """,
inc as (
  select source as acct, event_us, 1 as o, 0 as i, 1 as touch, cast(amount as decimal(18,6)) as v
  from pay where kind = 'payment'
  union all
  select destination, event_us, 0, 1, case when source = destination then 0 else 1 end,
         cast(amount as decimal(18,6))
  from pay where kind = 'payment'
  union all
  select destination, event_us, 0, 0, 1, 0 from pay where kind = 'deposit'
),
st as (
  select distinct acct, event_us,
    coalesce(sum(o) over past, 0) as oc, coalesce(sum(i) over past, 0) as ic,
    coalesce(sum(o * v) over past, 0) as ov, coalesce(sum(i * v) over past, 0) as iv,
    coalesce(sum(touch) over past, 0) as seen,
    max(case when touch = 1 then event_us end) over past as last_us,
    coalesce(sum(o) over hour, 0) as roc, coalesce(sum(i) over hour, 0) as ric,
    coalesce(sum(o * v) over hour, 0) as rov, coalesce(sum(i * v) over hour, 0) as riv
  from inc
  window past as (partition by acct order by event_us range between unbounded preceding and 1 preceding),
         hour as (partition by acct order by event_us range between 3600000000 preceding and 1 preceding)
),
dir as (
  select source, destination, event_us, count(*) as n from pay where kind = 'payment' group by all
),
pr as (
  select p.event_id,
    coalesce(sum(case when d.source = p.source then d.n end), 0) as same,
    coalesce(sum(case when d.source = p.destination then d.n end), 0) as back
  from pay p left join dir d on d.event_us < p.event_us and
    ((d.source = p.source and d.destination = p.destination) or
     (d.source = p.destination and d.destination = p.source))
  where p.kind = 'payment' group by p.event_id
),
raw as (
  select p.event_id, p.event_us, p.amount,
    s.oc as s_oc, s.ic as s_ic, s.ov as s_ov, s.iv as s_iv, s.seen as s_seen,
    case when s.seen > 0 then (p.event_us - s.last_us) / 60e6 else 0 end as s_gap,
    s.roc as s_roc, s.ric as s_ric, s.rov as s_rov, s.riv as s_riv,
    d.oc as d_oc, d.ic as d_ic, d.ov as d_ov, d.iv as d_iv, d.seen as d_seen,
    case when d.seen > 0 then (p.event_us - d.last_us) / 60e6 else 0 end as d_gap,
    d.roc as d_roc, d.ric as d_ric, d.rov as d_rov, d.riv as d_riv,
    pr.same, pr.same + pr.back as total
  from pay p join st s on s.acct = p.source and s.event_us = p.event_us
    join st d on d.acct = p.destination and d.event_us = p.event_us
    join pr on pr.event_id = p.event_id
  where p.kind = 'payment'
)"""


def _log(expression: str, scale: int) -> str:
    return f"ln(1 + greatest(0, cast({expression} as double))) / {scale}"


FEATURE_SQL = {
    "log_amount": _log("amount", 8),
    "amount_bin": "(case when amount < 15 then 0 when amount < 35 then 1 when amount < 75 then 2 "
    "when amount < 150 then 3 when amount < 300 then 4 when amount < 650 then 5 "
    "when amount < 1500 then 6 when amount < 4000 then 7 when amount < 10000 then 8 else 9 end) / 9.0",
    "pair_out_count": _log("same", 3),
    "pair_total_count": _log("total", 3),
    "prior_contact": "case when total > 0 then 1.0 else 0.0 end",
    "amount_vs_sender_out_mean": _log(
        "amount / greatest(1.0, cast(s_ov as double) / greatest(1, s_oc))", 8
    ),
    "amount_vs_recipient_in_mean": _log(
        "amount / greatest(1.0, cast(d_iv as double) / greatest(1, d_ic))", 8
    ),
}
for _side, _letter in (("sender", "s"), ("recipient", "d")):
    for _name, _column, _scale in (
        ("out_count", "oc", 6),
        ("in_count", "ic", 6),
        ("out_value", "ov", 10),
        ("in_value", "iv", 10),
        ("seen", "seen", 6),
        ("gap", "gap", 6),
        ("recent_in_count", "ric", 4),
        ("recent_out_count", "roc", 4),
        ("recent_in_value", "riv", 10),
        ("recent_out_value", "rov", 10),
    ):
        FEATURE_SQL[f"{_side}_{_name}"] = _log(f"{_letter}_{_column}", _scale)


def feature_sql(cte: str, names: list[str], tail: str = "") -> str:
    chosen = ", ".join(f"round(cast({FEATURE_SQL[n]} as double), 6) as {n}" for n in names)
    return f"with {cte.strip()}{HISTORY_SQL} select event_id, {chosen}{tail} from raw"


def _rounded(df, names):
    return df.select("event_id", *[r6(F.col(n)).alias(n) for n in names])


@query("payment_features", feature_sql(PAY_ORDERS, ft.PAYMENT_FEATURES))
def payment_features(spark, sf_dir):
    return _rounded(ft.payment_features(pay_orders(spark, sf_dir)), ft.PAYMENT_FEATURES)


@query("payment_features_mixed_kinds", feature_sql(PAY_EVENTS, ft.PAYMENT_FEATURES))
def payment_features_mixed_kinds(spark, sf_dir):
    return _rounded(ft.payment_features(pay_events(spark, sf_dir)), ft.PAYMENT_FEATURES)


def _register_single(name: str) -> None:
    @query("feature_" + name, feature_sql(PAY_EVENTS, [name]))
    def run(spark, sf_dir):
        return _rounded(ft.payment_features(pay_events(spark, sf_dir), [name]), [name])


for _feature in ft.PAYMENT_FEATURES:
    _register_single(_feature)
