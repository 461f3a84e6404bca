"""Queries over joins, scoring, models, replay and streams."""

from __future__ import annotations

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
    with_cte,
)
from ledgerlark.catalog.evaluation import TWO_MODELS, _two_models, adaptive_sql
from ledgerlark.catalog.history import FEATURE_SQL, HISTORY_SQL, feature_sql
from ledgerlark.functions import scalars as sc
from ledgerlark.operators import experiments as ex
from ledgerlark.operators import features as ft
from ledgerlark.operators import joins as jn
from ledgerlark.operators import metrics as mt
from ledgerlark.operators import policy as pol
from ledgerlark.operators import replay as rp
from ledgerlark.operators import scoring as so
from ledgerlark.operators import splits as sp
from ledgerlark.operators import trees as tr
from ledgerlark.session import cut_lineage, scratch_dir
from ledgerlark.streaming import feedback as sfb
from ledgerlark.streaming import features as sft

SPLIT_US = 883612800000000  # 1998-01-01


def _events_outcomes(spark, sf):
    base = pay_orders(spark, sf).withColumn("event_time", F.col("event_us") / 1e6)
    outcomes = base.filter("seq % 11 <> 0").select(
        "event_id",
        F.when(F.col("seq") % 13 == 0, 7).otherwise(F.col("label")).alias("label"),
        ((F.col("available_us") - F.when(F.col("seq") % 5 == 0, 10**16).otherwise(0)) / 1e6).alias("available_at"),
    )
    return base.select("event_id", "event_time", "event_us", "seq"), outcomes


@query("check_event_outcome_integrity", with_cte(PAY_ORDERS, """,
 o as (select event_id, event_us / 1e6 as t, case when seq % 13 = 0 then 7 else label end as l, seq % 11 = 0 as lost,
   (available_us - case when seq % 5 = 0 then 10000000000000000 else 0 end) / 1e6 as a from pay),
 p as (select event_id, case when lost then 'missing outcome' when l = 7 then 'bad label'
   when l = -1 and a is not null then 'unknown with availability' when a < t then 'available before event' end as problem from o)
 select * from p where problem is not null"""))
def check_event_outcome_integrity(spark, sf):
    events, outcomes = _events_outcomes(spark, sf)
    return jn.check_event_outcome_integrity(events, outcomes)


@query("join_predictions", with_cte(SCORES, """
 select event_id, round(score / 20, 6) as score, label from scored where event_us >= 883612800000000"""))
def join_predictions(spark, sf):
    base = scores(spark, sf)
    events = base.select("event_id", "event_us", "seq")
    outcomes = base.select("event_id", "label", F.col("available_us").alias("available_at"))
    subset = base.filter(F.col("event_us") >= SPLIT_US)
    predictions = subset.select("event_id", (F.col("score") / 20).alias("score"))
    joined = jn.join_predictions(events, outcomes, predictions, subset=subset.select("event_id"))
    return joined.select("event_id", r6(F.col("score")).alias("score"), "label")


@query("prediction_violations", with_cte(SCORES, """,
 x as (select event_id, case when seq % 17 = 0 then 1.5 when seq % 19 = 0 then null else score / 20 end as s from scored
   union all select event_id, score / 20 from scored where seq % 23 = 0)
 select event_id, 'score must be finite' as rule from x where s is null
 union all select event_id, 'probabilities lie in [0, 1]' from x where s > 1
 union all select event_id, 'duplicate id' from x group by event_id having count(*) > 1"""))
def prediction_violations(spark, sf):
    base = scores(spark, sf)
    first = base.select("event_id", F.when(F.col("seq") % 17 == 0, 1.5).when(F.col("seq") % 19 == 0, None).otherwise(
        F.col("score") / 20).alias("score"))
    return jn.prediction_violations(first.union(base.filter("seq % 23 = 0").select("event_id", F.col("score") / 20)))


@query("except_ids", with_cte(SCORES, """
 select event_id, 'missing' as side from scored where seq % 3 = 0 and seq % 2 <> 0
 union all select event_id, 'extra' from scored where seq % 2 = 0 and seq % 3 <> 0"""))
def except_ids(spark, sf):
    base = scores(spark, sf)
    return jn.missing_and_extra_ids(base.filter("seq % 2 = 0"), base.filter("seq % 3 = 0"))


@query("intersect_test_ids", with_cte(SCORES, " select event_id from scored where seq % 2 = 0 and seq % 3 = 0 and seq % 5 <> 0"))
def intersect_test_ids(spark, sf):
    base = scores(spark, sf)
    return jn.intersect_ids(base.filter("seq % 2 = 0"), base.filter("seq % 3 = 0"), base.filter("seq % 5 <> 0"))


def _signed(df):
    return df.withColumn(
        "signature",
        sc.payment_signature(F.col("source"), F.col("destination"), F.col("event_us"), F.col("amount")),
    )


@query("overlap_check", with_cte(SCORES, """
 select 'copy:' || event_id as event_id from scored where event_us < 883612800000000 and seq % 4 = 0"""))
def overlap_check(spark, sf):
    base = _signed(scores(spark, sf))
    used = base.filter(F.col("event_us") < SPLIT_US)
    copies = base.filter("seq % 4 = 0").withColumn("event_id", F.concat(F.lit("copy:"), "event_id"))
    return jn.overlap_check(copies, used).select("event_id")


def _parts(spark, sf):
    return sp.chronological_split(_signed(scores(spark, sf)))


SPLIT_SQL = """, u as (select event_us, row_number() over (order by event_us) - 1 as r,
  count(*) over () as n from (select distinct event_us from scored)),
 parts as (select scored.*, case when r < cast(floor(n * 0.6) as bigint) then 'train'
  when r < cast(floor(n * (0.6::double + 0.2::double)) as bigint) then 'validation' else 'test' end as partition
  from scored join u using (event_us))"""


@query("comparison_population", with_cte(SCORES, SPLIT_SQL + " select event_id from parts where partition = 'test'"))
def comparison_population(spark, sf):
    parts = cut_lineage(_parts(spark, sf))
    run = {
        "same": True, "used": parts.filter("partition <> 'test'"), "test": parts.filter("partition = 'test'"),
    }
    older = {"same": False, "used": parts.filter("partition = 'train'").select("event_id", "signature")}
    return jn.comparison_population(parts.select("event_id", "signature"), [run, older]).select("event_id")


@query("reserved_ids", with_cte(SCORES, SPLIT_SQL + """,
 t as (select event_id, event_us from parts where partition = 'test'),
 g as (select event_us, coalesce(sum(count(*)) over (order by event_us rows between unbounded preceding and 1 preceding), 0) as before
   from t group by 1)
 select event_id from t where event_us > (select max(event_us) from g where before < 100)"""))
def reserved_ids(spark, sf):
    parts = _parts(spark, sf)
    calibration = sp.calibration_prefix(parts.filter("partition = 'test'"), 100)
    return jn.reserved_and_evaluation(parts, calibration)[1].select("event_id")


@query("attach_partition", with_cte(SCORES, SPLIT_SQL + " select partition, count(*) as rows from parts group by 1"))
def attach_partition(spark, sf):
    parts = _parts(spark, sf)
    joined = jn.attach_partition(scores(spark, sf), parts.select("event_id", "partition"))
    return joined.groupBy("partition").agg(F.count(F.lit(1)).alias("rows"))


@query("combine_model_scores", with_cte(TWO_MODELS, """
 select event_id, event_us, label, max(score) filter (model = 'amount') as score_amount,
   max(score) filter (model = 'supplier') as score_supplier,
   case when max(score) filter (model = 'amount') > 12 then 'BLOCK' else 'ALLOW' end as decision_amount,
   case when max(score) filter (model = 'supplier') > 3 then 'BLOCK' else 'ALLOW' end as decision_supplier
 from two group by all"""))
def combine_model_scores(spark, sf):
    cutoff = F.when(F.col("model") == "amount", 12.0).otherwise(3.0)
    reports = pol.decide_fixed(_two_models(spark, sf), cutoff)
    return jn.combine_model_scores(reports, ["amount", "supplier"])


@query("common_evaluated", with_cte(TWO_MODELS, """,
 k as (select *, row_number() over (partition by model order by case when model = 'amount' then seq else -seq end) as k from two)
 select event_id from k group by 1 having min(k) > 200"""))
def common_evaluated(spark, sf):
    from ledgerlark.plans.prefix import bucketed_prefix

    base = _two_models(spark, sf).withColumn(
        "place", F.when(F.col("model") == "amount", F.col("seq")).otherwise(-F.col("seq"))
    )
    ranked = bucketed_prefix(base, ["place"], {"k": F.lit(1).cast("bigint")}, by=["model"])
    decided = ranked.withColumn("decision", F.when(F.col("k") < 200, "LEARNING").otherwise("ALLOW"))
    return jn.common_evaluated(decided, 2)


@query("history_edges", with_cte(PAY_EVENTS, """
 select event_id, split_part(source, ':', 1) as source_kind, split_part(source, ':', 2) as source_id,
   split_part(destination, ':', 1) as destination_kind, split_part(destination, ':', 2) as destination_id
 from pay where kind = 'payment'"""))
def history_edges(spark, sf):
    return jn.history_edges(_entity_events(pay_events(spark, sf))).select(
        "event_id", "source_kind", "source_id", "destination_kind", "destination_id"
    )


def _entity_events(payments):
    def entity(column, role):
        parts = F.split(column, ":", 2)
        return F.when(
            F.col(column).isNotNull(),
            F.struct(F.element_at(parts, 1).alias("kind"), F.element_at(parts, 2).alias("id"), F.lit(role).alias("role")),
        )

    both = F.array(entity("source", "source"), entity("destination", "destination"))
    return payments.select(
        "event_id", (F.col("event_us") / 1e6).alias("event_time"), "event_us", F.col("kind").alias("event_type"),
        F.filter(both, lambda e: e.isNotNull()).alias("entities"),
    )


@query("history_neighbors", with_cte(PAY_EVENTS, """
 select 'account' as kind, split_part(destination, ':', 2) as id from pay where kind = 'payment' and source = 'account:7'
 union select 'account', split_part(source, ':', 2) from pay where kind = 'payment' and destination = 'account:7'"""))
def history_neighbors(spark, sf):
    return jn.history_neighbors(_entity_events(pay_events(spark, sf)), "account", "7")


@query("validate_decisions", with_cte(SCORES, """
 select 'a' as model, event_id, 'decision differs from score and cutoff' as rule from scored where seq % 31 = 0
 union all select 'a', event_id, 'settlement differs from the mode' from scored where seq % 37 = 0"""))
def validate_decisions(spark, sf):
    base = scores(spark, sf).withColumns({
        "model": F.lit("a"), "eligible": F.col("seq") % 7 != 0, "tau_before": F.lit(12.0), "tau_after": F.lit(12.0),
    })
    right = F.when(~F.col("eligible"), "CONTEXT").when(F.col("score") > 12, "BLOCK").otherwise("ALLOW")
    wrong = F.when(right == "BLOCK", "ALLOW").otherwise("BLOCK")
    rows = base.withColumn("decision", F.when(F.col("seq") % 31 == 0, wrong).otherwise(right))
    rows = rows.withColumn("settled", F.col("seq") % 37 != 0)
    return jn.decision_violations(rows, ["model"])


@query("filter_records", with_cte(SCORES, """
 select event_id, case when label < 0 then 'unknown' when label = 1 then 'tp' else 'fp' end as outcome from scored
 where score > 12 and label = 0 and contains(lower(concat_ws(' ', source, destination)), 'customer:1')"""))
def filter_records(spark, sf):
    rows = pol.decide_fixed(scores(spark, sf).withColumn("tau_before", F.lit(12.0)), 12.0)
    found = jn.filter_records(rows, decision="BLOCK", outcome="fp", text="Customer:1", sort="amount", descending=True)
    return found.select("event_id", "outcome")


# --- Features that need a mode -----------------------------------------------------------------

RARITY = " + ".join(f"{w} * {FEATURE_SQL[n]}" for n, w in ft.RARITY_WEIGHTS.items())


@query("rarity_score", "with " + PAY_EVENTS.strip() + HISTORY_SQL + f"""
 select event_id, round(greatest(0, 1.2 * (1 - {FEATURE_SQL['prior_contact']}) + {RARITY}), 6) as rarity from raw""")
def rarity_score(spark, sf):
    names = [*ft.RARITY_WEIGHTS, "prior_contact"]
    df = ft.payment_features(pay_events(spark, sf), names)
    return df.select("event_id", r6(ft.rarity_score()).alias("rarity"))


@query("numeric_payments", "with " + PAY_EVENTS.strip() + HISTORY_SQL + """
 select event_id, round(ln(1 + amount), 6) as log1p_amount, cast(s_oc as double) as prior_source_count,
   cast(d_ic as double) as prior_destination_count from raw""")
def numeric_payments(spark, sf):
    df = ft.numeric_payments(pay_events(spark, sf))
    return df.select("event_id", r6(F.col("log1p_amount")).alias("log1p_amount"), "prior_source_count", "prior_destination_count")


@query("context_statistics", "with " + PAY_EVENTS.strip() + HISTORY_SQL + """
 select event_id, round(ln(1 + cast(s_ov as double) / greatest(1, s_oc)) / 8, 6) as sender_mean_out,
   round(ln(1 + cast(d_iv as double) / greatest(1, d_ic)) / 8, 6) as recipient_mean_in,
   round(ln(1 + s_seen) / 6, 6) as sender_activity, round(ln(1 + d_seen) / 6, 6) as recipient_activity,
   round(ln(1 + same) / 3, 6) as pair_activity, round(ln(1 + d_ic) / 6, 6) as recipient_popularity,
   case when total > 0 then 1.0::double else 0.0 end as known_pair from raw""")
def context_statistics(spark, sf):
    df = ft.context_statistics(pay_events(spark, sf))
    return df.select("event_id", *[r6(F.col(c)).alias(c) for c in df.columns if c not in ("event_id", "event_us")])


SETTLED_NAMES = ["sender_out_count", "recipient_in_value", "sender_seen", "recipient_seen", "pair_total_count",
                 "sender_recent_out_count", "recipient_recent_in_value", "sender_gap"]


@query("settled_history_features", with_cte(PAY_EVENTS, """,
 inc as (select source as acct, event_us, seq, event_id, 1 as o, 0 as i, cast(amount as decimal(18,6)) as v, settled from pay where kind = 'payment'
   union all select destination, event_us, seq, event_id, 0, 1, cast(amount as decimal(18,6)), settled from pay where kind = 'payment'
   union all select destination, event_us, seq, event_id, 0, 0, 0, true from pay where kind = 'deposit'),
 a as (select p.event_id, max(p.event_us) as t, count(*) filter (x.o = 1 and x.settled) as oc,
   count(distinct x.event_id) as seen, max(x.event_us) as last_us,
   count(*) filter (x.o = 1 and x.settled and x.event_us >= p.event_us - 3600000000) as roc
   from pay p left join inc x on x.acct = p.source and (x.event_us, x.seq) < (p.event_us, p.seq) where p.kind = 'payment' group by 1),
 b as (select p.event_id, coalesce(sum(x.v) filter (x.i = 1 and x.settled), 0) as iv, count(distinct x.event_id) as seen,
   coalesce(sum(x.v) filter (x.i = 1 and x.settled and x.event_us >= p.event_us - 3600000000), 0) as riv
   from pay p left join inc x on x.acct = p.destination and (x.event_us, x.seq) < (p.event_us, p.seq) where p.kind = 'payment' group by 1),
 c as (select p.event_id, count(x.event_id) as total from pay p left join pay x on x.kind = 'payment' and x.settled
   and (x.event_us, x.seq) < (p.event_us, p.seq)
   and ((x.source = p.source and x.destination = p.destination) or (x.source = p.destination and x.destination = p.source))
   where p.kind = 'payment' group by 1),
 q as (select p.event_id, case when p.source = p.destination then 2 else 1 end as twice from pay p where kind = 'payment')
 select event_id, round(ln(1 + oc) / 6, 6) as sender_out_count, round(ln(1 + cast(iv as double)) / 10, 6) as recipient_in_value,
   round(ln(1 + a.seen) / 6, 6) as sender_seen, round(ln(1 + b.seen) / 6, 6) as recipient_seen,
   round(ln(1 + total * twice) / 3, 6) as pair_total_count, round(ln(1 + roc) / 4, 6) as sender_recent_out_count,
   round(ln(1 + cast(riv as double)) / 10, 6) as recipient_recent_in_value,
   round(ln(1 + case when a.seen > 0 then (t - last_us) / 60e6 else 0 end) / 6, 6) as sender_gap
 from a join b using (event_id) join c using (event_id) join q using (event_id)"""))
def settled_history_features(spark, sf):
    df = ft.payment_features(pay_events(spark, sf), SETTLED_NAMES, settled=True)
    return df.select("event_id", *[r6(F.col(n)).alias(n) for n in SETTLED_NAMES])


# --- Scores and models --------------------------------------------------------------------------


@query("empirical_tail_score", with_cte(SCORES, """,
 r as (select score as logit from scored where event_us < 883612800000000)
 select event_id, round((1 + (select count(*) from r where logit <= s.score)) / (1 + (select count(*) from r)), 6) as tail_probability,
   round(-log2((1 + (select count(*) from r where logit <= s.score)) / (1 + (select count(*) from r))), 6) as score
 from scored s where event_us >= 883612800000000"""))
def empirical_tail_score(spark, sf):
    base = scores(spark, sf).withColumnRenamed("score", "logit")
    df = so.empirical_tail_score(base.filter(F.col("event_us") < SPLIT_US), base.filter(F.col("event_us") >= SPLIT_US))
    return df.select("event_id", r6(F.col("tail_probability")).alias("tail_probability"), r6(F.col("score")).alias("score"))


@query("fixed_likelihood_score", with_cte(SCORES, """
 select event_id, round(1 / (1 + exp(-(score - 11))), 6) as tail_probability, round(log2(1 + exp(-(score - 11))), 6) as bits from scored"""))
def fixed_likelihood_score(spark, sf):
    tail, bits = so.fixed_likelihood_score(F.col("score") - 11)
    return scores(spark, sf).select("event_id", r6(tail).alias("tail_probability"), r6(bits).alias("bits"))


@query("fraud_bits", with_cte(SCORES, """
 select event_id, round(1 / (1 + exp(-(score - 11))), 6) as probability, round(log2(1 + exp(score - 11)), 6) as bits from scored"""))
def fraud_bits(spark, sf):
    probability, bits = so.fraud_bits(F.col("score") - 11)
    return scores(spark, sf).select("event_id", r6(probability).alias("probability"), r6(bits).alias("bits"))


@query("probability_bits", with_cte(SCORES, " select event_id, round(-log2(greatest(1e-12, 1 - score / 14)), 6) as bits from scored"))
def probability_bits(spark, sf):
    return scores(spark, sf).select("event_id", r6(so.probability_bits(F.col("score") / 14)).alias("bits"))


@query("tail_cutoff", with_cte(SCORES, """
 select event_id, score > -log2(0.0003) as above, round(1 - power(2, -score), 6) as probability from scored"""))
def tail_cutoff(spark, sf):
    base = scores(spark, sf)
    bits = F.col("score")
    return base.select(
        "event_id", (bits > so.tail_cutoff(0.0003)).alias("above"),
        r6(-F.expm1(-F.greatest(F.lit(0.0), bits) * F.log(F.lit(2.0)))).alias("probability"),
    )


NUMERIC = ["log_amount", "sender_out_count", "recipient_in_count", "sender_gap", "prior_contact"]


def _numeric(spark, sf):
    return ft.payment_features(pay_orders(spark, sf), NUMERIC, keep=["label", "available_us"])


def _numeric_sql(where: str) -> str:
    """Mean and deviation of the features over some rows, and the gradient that an optimum has."""
    rows = " union all ".join(
        f"select '{n}' as feature, {FEATURE_SQL[n]}::double as x from raw join chosen using (event_id)" for n in NUMERIC
    )
    return f""", chosen as (select event_id as event_id from {where})
 select feature, round(avg(x), 6) as mean, round(greatest(1e-6, stddev_pop(x)), 6) as scale, 0.0::double as gradient from ({rows}) group by 1
 union all select 'intercept', 0.0, 1.0, 0.0"""


def _certificate(df):
    # Rounded to five decimals of the mean loss; adding zero takes the sign off a zero.
    return df.select("feature", r6(F.col("mean")).alias("mean"), r6(F.col("scale")).alias("scale"), (F.round("gradient", 5) + 0.0).alias("gradient"))


@query("fit_logistic", "with " + PAY_ORDERS.strip() + HISTORY_SQL + SPLIT_SQL.replace("scored", "pay")
       + _numeric_sql("parts where partition = 'train' and label >= 0"))
def fit_logistic(spark, sf):
    """The weights' certificate: standardisation, and a gradient that vanishes at the optimum alone."""
    train = cut_lineage(sp.chronological_split(_numeric(spark, sf)).filter("partition = 'train'"))
    return _certificate(so.logistic_gradient(train, so.fit_logistic(train, NUMERIC)))


@query("score_logistic")
def score_logistic(spark, sf):
    rows = cut_lineage(sp.chronological_split(_numeric(spark, sf)))
    model = so.fit_logistic(rows.filter("partition = 'train'"), NUMERIC)
    scored = so.score_logistic(rows.filter("partition = 'test'"), model)
    return scored.select("event_id", F.round("margin", 4).alias("margin"), F.round("probability", 4).alias("probability"))


# A fixed small ensemble over the table's columns, for the scoring operators.
SMALL_ENSEMBLE = tr.TreeEnsemble(
    ("amount", "score"), -1.0, 0.5,
    (
        {"feature": 0, "threshold": 150000.0,
         "left": {"feature": 1, "threshold": 11.0, "left": {"leaf": -0.5}, "right": {"leaf": 0.25}},
         "right": {"feature": 0, "threshold": 300000.0, "left": {"leaf": 1.0}, "right": {"leaf": 2.0}}},
        {"feature": 1, "threshold": 12.0, "left": {"leaf": -0.25}, "right": {"leaf": 0.75}},
    ),
)
SMALL_MARGIN = """(-1.0 + 0.5 * (case when amount <= 150000 then case when score <= 11.0 then -0.5 else 0.25 end
 else case when amount <= 300000 then 1.0 else 2.0 end end + case when score <= 12.0 then -0.25 else 0.75 end))"""


@query("score_tree_ensemble", with_cte(SCORES, f"""
 select event_id, round({SMALL_MARGIN}, 6)::double as margin, round(1 / (1 + exp(-{SMALL_MARGIN})), 6) as probability from scored"""))
def score_tree_ensemble(spark, sf):
    df = tr.score_tree_ensemble(scores(spark, sf), SMALL_ENSEMBLE)
    return df.select("event_id", r6(F.col("margin")).alias("margin"), r6(F.col("probability")).alias("probability"))


@query("tree_cover_counts", with_cte(SCORES, """
 select tree::int as tree, node::int as node, n as count from (
 select 0 as tree, 0 as node, count(*) as n from scored union all select 0, 1, count(*) from scored where amount <= 150000
 union all select 0, 2, count(*) from scored where amount <= 150000 and score <= 11.0
 union all select 0, 3, count(*) from scored where amount <= 150000 and score > 11.0
 union all select 0, 4, count(*) from scored where amount > 150000
 union all select 0, 5, count(*) from scored where amount > 150000 and amount <= 300000
 union all select 0, 6, count(*) from scored where amount > 300000
 union all select 1, 0, count(*) from scored union all select 1, 1, count(*) from scored where score <= 12.0
 union all select 1, 2, count(*) from scored where score > 12.0)"""))
def tree_cover_counts(spark, sf):
    return tr.tree_cover_counts(scores(spark, sf), SMALL_ENSEMBLE)


@query("tree_path", with_cte(SCORES, """
 select event_id, case when amount <= 150000 then case when score <= 11.0 then 'LL' else 'LR' end
   else case when amount <= 300000 then 'RL' else 'RR' end end as leaf_path,
   case when amount <= 150000 then 'amount,score' else 'amount,amount' end as features from scored"""))
def tree_path(spark, sf):
    path = tr.tree_path(SMALL_ENSEMBLE, 0)
    return scores(spark, sf).withColumn("p", path).select(
        "event_id", F.col("p.leaf_path").alias("leaf_path"),
        F.array_join(F.transform("p.steps", lambda s: s["feature"]), ",").alias("features"),
    )


# Values of the ensemble's games: f of nothing, of amount, of score and of both, by the covers.
SHAPLEY_SQL = f""", n as (
 select count(*)::double as n, count(*) filter (amount <= 150000)::double as l,
   count(*) filter (amount <= 150000 and score <= 11.0)::double as ll, count(*) filter (amount > 150000)::double as r,
   count(*) filter (amount > 150000 and amount <= 300000)::double as rl, count(*) filter (score <= 12.0)::double as s
 from scored),
 m as (select *, coalesce((-0.5 * ll + 0.25 * (l - ll)) / nullif(l, 0), 0) as low,
   coalesce((rl + 2.0 * (r - rl)) / nullif(r, 0), 0) as high, coalesce((-0.25 * s + 0.75 * (n - s)) / n, 0) as plain from n),
 g as (select event_id, amount, score, {SMALL_MARGIN} as margin, (l * low + r * high) / n + plain as none,
   case when amount <= 150000 then low when amount <= 300000 then 1.0 else 2.0 end + plain as of_amount,
   (l * case when score <= 11.0 then -0.5 else 0.25 end + r * high) / n
     + case when score <= 12.0 then -0.25 else 0.75 end as of_score,
   (margin + 1.0) / 0.5 as whole from scored, m),
 e as (select event_id, amount, score, margin, -1.0 + 0.5 * none as baseline,
   0.25 * (of_amount - none + whole - of_score) as c_amount, 0.25 * (of_score - none + whole - of_amount) as c_score from g)"""


@query("explain_tree_ensemble", with_cte(SCORES, SHAPLEY_SQL + """
 select event_id, round(margin, 6)::double as margin, round(baseline, 6)::double as baseline,
   round(c_amount, 6)::double as c_amount, round(c_score, 6)::double as c_score from e"""))
def explain_tree_ensemble(spark, sf):
    base = scores(spark, sf)
    covers = tr.tree_cover_counts(base, SMALL_ENSEMBLE)
    scored = tr.score_tree_ensemble(base, SMALL_ENSEMBLE)
    explained = tr.explain_tree_ensemble(scored.select("event_id", "margin", "amount", "score"), SMALL_ENSEMBLE, covers, ["event_id", "margin"])
    parts = {"margin": F.col("margin"), "baseline": F.col("baseline"), "c_amount": F.col("contributions")[0], "c_score": F.col("contributions")[1]}
    return explained.select("event_id", *[r6(c).alias(n) for n, c in parts.items()])


def _summary_sql(feature: str) -> str:
    c = f"c_{feature}"
    return f"""select '{feature}' as feature, round(avg(abs({c})), 6)::double as mean_abs, round(avg({c}), 6)::double as mean,
      round(min({c}), 6)::double as min, round(max({c}), 6)::double as max, round(avg({feature}), 6)::double as mean_value,
      round(min({feature}), 6)::double as min_value, round(max({feature}), 6)::double as max_value from e"""


@query("contribution_summary", with_cte(SCORES, SHAPLEY_SQL + " " + " union all ".join(map(_summary_sql, ("amount", "score")))))
def contribution_summary(spark, sf):
    base = scores(spark, sf)
    covers = tr.tree_cover_counts(base, SMALL_ENSEMBLE)
    explained = tr.explain_tree_ensemble(base, SMALL_ENSEMBLE, covers, ["event_id", "amount", "score"])
    records = explained.withColumn("values", F.array("amount", "score"))
    df = mt.contribution_summary(records, ["amount", "score"])
    return df.select("feature", *[r6(F.col(c)).alias(c) for c in ("mean_abs", "mean", "min", "max", "mean_value", "min_value", "max_value")])


@query("fit_boosted_trees")
def fit_boosted_trees(spark, sf):
    rows = cut_lineage(sp.chronological_split(_numeric(spark, sf)))
    model = tr.fit_boosted_trees(rows.filter("partition = 'train'"), NUMERIC, trees=8)
    scored = tr.score_tree_ensemble(rows.filter("partition = 'test'"), model)
    return scored.select("event_id", F.round("margin", 4).alias("margin"))


@query("fit_history_head", "with " + PAY_ORDERS.strip() + HISTORY_SQL + _numeric_sql("pay where label >= 0")
       + " union all select 'bits', null, null, 0.0")
def fit_history_head(spark, sf):
    """Certificate of the class-weighted head; the surprise in it has a query of its own, only its gradient is shown."""
    base = pay_orders(spark, sf)
    rows = so.history_rows(base, base.select("event_id", "label"), NUMERIC)
    model = so.fit_logistic(rows, [*NUMERIC, "bits"], balanced=True)
    found = _certificate(so.logistic_gradient(rows, model, balanced=True))
    return found.withColumns({c: F.when(F.col("feature") != "bits", F.col(c)) for c in ("mean", "scale")})


@query("score_history_head")
def score_history_head(spark, sf):
    base = pay_orders(spark, sf)
    _, scored = so.fit_history_head(base, base.select("event_id", "label"), NUMERIC)
    return scored.select("event_id", F.round("probability", 4).alias("probability"))


@query("train_experiment")
def train_experiment(spark, sf):
    path = scratch_dir(spark, "artifact")
    ex.train_experiment(spark, cut_lineage(_numeric(spark, sf)), NUMERIC, path)
    rows = spark.read.parquet(f"{path}/report")
    return rows.select("event_id", "label", "decision", F.round("score", 4).alias("score"))


@query("evaluate_artifact", with_cte(SCORES, SPLIT_SQL + """
 select event_id, case when label >= 0 then label end as label from parts where partition = 'test'"""))
def evaluate_artifact(spark, sf):
    path, rows = scratch_dir(spark, "artifact"), cut_lineage(_numeric(spark, sf))
    ex.train_experiment(spark, rows, NUMERIC, path)
    return ex.evaluate_artifact(spark, path, rows)[0].select("event_id", "label")


@query("compare_runs", with_cte(SCORES, SPLIT_SQL + """,
 m(model) as (values ('few'), ('many'))
 select model, count(*) as rows, count(*) filter (label >= 0) as known, count(*) filter (label < 0) as unknown
 from parts, m where partition = 'test' group by 1"""))
def compare_runs(spark, sf):
    rows = cut_lineage(_numeric(spark, sf))
    paths = {"many": scratch_dir(spark, "artifact"), "few": scratch_dir(spark, "artifact")}
    ex.train_experiment(spark, rows, NUMERIC, paths["many"])
    ex.train_experiment(spark, rows, NUMERIC[:2], paths["few"], threshold=0.5)
    return ex.compare_runs(spark, paths, rows)[1].select("model", "rows", "known", "unknown")


@query("evaluation_report", with_cte(SCORES, """
 select event_id, score / 20 as score, case when label >= 0 then label end as label,
   case when score / 20 > 0.6 then 'BLOCK' else 'ALLOW' end as decision from scored"""))
def evaluation_report(spark, sf):
    scored = scores(spark, sf).withColumn("probability", F.col("score") / 20)
    return ex.evaluation_rows(scored, 0.6).select("event_id", "score", "label", "decision")


@query("export_scored_history", with_cte(SCORES, SPLIT_SQL + """,
 t as (select * from parts where partition = 'test'),
 g as (select event_us, coalesce(sum(count(*)) over (order by event_us rows between unbounded preceding and 1 preceding), 0) as before from t group by 1),
 c as (select * from t where event_us <= (select max(event_us) from g where before < 100)),
 e as (select t.*, -log2((1 + (select count(*) from c where score <= t.score)) / (1 + (select count(*) from c))) as tail,
    log2(1 + exp(-(score - 11.0))) as fixed from t where event_us > (select max(event_us) from g where before < 100)),
 h as (select 'empirical_tail' as head, label, tail > -log2(0.2) as flag from e
       union all select 'fixed_likelihood', label, fixed > -log2(0.2) from e)
 select head, count(*) as rows, count(*) filter (label = 1 and flag) as tp, count(*) filter (label = 0 and flag) as fp,
   count(*) filter (label = 1 and not flag) as fn, count(*) filter (label = 0 and not flag) as tn from h group by 1"""))
def export_scored_history(spark, sf):
    logits = sp.chronological_split(scores(spark, sf)).withColumn("logit", F.col("score") - 11)
    _, metrics = ex.export_scored_history(logits.drop("score"), 100, 0.2)
    return metrics.select("head", "rows", "tp", "fp", "fn", "tn")


# --- Replay and streams ---------------------------------------------------------------------------


def _replay_input(spark, sf):
    base = pay_orders(spark, sf)
    return base, base.select("event_id", "label", "available_us")


def _fit_means(train, features):
    known = train.filter("label >= 0")
    means = known.groupBy("label").agg(*[F.avg(f).alias(f) for f in features]).collect()  # two rows
    return {str(r["label"]): [r[f] for f in features] for r in means}


def _score_means(state, features):
    near = [((features - state[c]) ** 2).sum(axis=1) for c in ("0", "1")]
    return near[0] / (near[0] + near[1]).where(lambda d: d > 0)


@query("register_scorer", with_cte(SCORES, SPLIT_SQL + """,
 m as (select avg(score) filter (label = 0) as s0, avg(score) filter (label = 1) as s1,
   avg(ln(1 + amount)) filter (label = 0) as a0, avg(ln(1 + amount)) filter (label = 1) as a1 from parts where partition = 'train'),
 d as (select event_id, power(score - s0, 2) + power(ln(1 + amount) - a0, 2) as d0,
   power(score - s1, 2) + power(ln(1 + amount) - a1, 2) as d1 from parts, m where partition <> 'train')
 select event_id, round(d0 / (d0 + d1), 6) as probability from d"""))
def register_scorer(spark, sf):
    """A scorer of one's own: nearness to the mean of each class, frozen and run on Arrow batches."""
    rows = scores(spark, sf).withColumn("log_amount", F.log(1 + F.col("amount").cast("double")))
    parts = cut_lineage(sp.chronological_split(rows))
    model = so.SCORERS.get("class-means") or so.arrow_scorer("class-means", _fit_means, _score_means)
    state = model.fit(parts.filter("partition = 'train'"), ["score", "log_amount"])
    return model.predict(parts.filter("partition <> 'train'"), state).select("event_id", r6(F.col("probability")).alias("probability"))


def _fit_spread(reference):
    row = reference.agg(F.avg("logit").alias("mean"), F.stddev_pop("logit").alias("scale")).first()
    return {"mean": row["mean"], "scale": row["scale"]}


@query("register_head", with_cte(SCORES, """,
 r as (select avg(score) as m, stddev_pop(score) as s from scored where event_us < 883612800000000)
 select event_id, round((score - m) / s, 6) as score, (score - m) / s > -log2(0.3) as above from scored, r where event_us >= 883612800000000"""))
def register_head(spark, sf):
    """A head of one's own: distance from the mean of the reference in deviations, run on Arrow batches."""
    rows = scores(spark, sf).withColumnRenamed("score", "logit")
    past, queries = rows.filter(F.col("event_us") < SPLIT_US), rows.filter(F.col("event_us") >= SPLIT_US)
    head = so.HEADS.get("deviations") or so.arrow_head("deviations", _fit_spread, lambda s, x: (x - s["mean"]) / s["scale"])
    scored = head.score(queries, past)
    return scored.select("event_id", r6(F.col("score")).alias("score"), (F.col("score") > head.cutoff(0.3)).alias("above"))


@query("timestamp_groups", with_cte(PAY_ORDERS, """
 select event_us, count(*) as events, min(seq) as first_seq, max(seq) as last_seq from pay group by 1"""))
def timestamp_groups(spark, sf):
    return rp.timestamp_groups(pay_orders(spark, sf))


@query("released_feedback", with_cte(PAY_ORDERS, """,
 l as (select label, greatest(available_us, event_us + 1) as usable from pay where label >= 0 and available_us is not null),
 t as (select event_us, (select count(*) from l where usable <= x.event_us) as visible,
        (select coalesce(sum(label), 0) from l where usable <= x.event_us) as fraud from (select distinct event_us from pay) x)
 select event_id, visible, cast(fraud as bigint) as visible_fraud from pay join t using (event_us)"""))
def released_feedback(spark, sf):
    events, outcomes = _replay_input(spark, sf)
    return rp.released_feedback(events, outcomes).select("event_id", "visible", "visible_fraud")


@query("released_feedback_by_entity", with_cte(PAY_ORDERS, """,
 l as (select destination, label, event_us + 86400000000 as usable from pay where label >= 0)
 select p.event_id, count(l.label) as visible, cast(coalesce(sum(l.label), 0) as bigint) as visible_fraud
 from pay p left join l on l.destination = p.destination and l.usable <= p.event_us group by 1"""))
def released_feedback_by_entity(spark, sf):
    events, outcomes = _replay_input(spark, sf)
    df = rp.released_feedback(events, outcomes, label_delay_us=86_400_000_000, key="destination")
    return df.select("event_id", "visible", "visible_fraud")


@query("replay_manifest", with_cte(PAY_ORDERS, """,
 h as (select max(event_us) as hz from pay),
 s as (select event_us < 883612800000000 as prefix, case when label < 0 then 'u' when available_us is null then 'r'
   when available_us <= hz then 'm' else 'p' end as st from pay, h)
 select count(*) filter (prefix) as prefix_count, count(*) filter (not prefix) as evaluation_count,
   count(*) filter (st = 'm') as released, count(*) filter (st = 'p') as pending,
   count(*) filter (st = 'r') as retrospective_unavailable, count(*) filter (st = 'u') as unknown,
   count(*) filter (st = 'u' and not prefix) as evaluation_unknown,
   count(*) filter (st = 'r' and not prefix) as evaluation_retrospective,
   count(*) filter (st = 'm' and not prefix) as evaluation_mature,
   count(*) filter (st = 'p' and not prefix) as evaluation_pending, (select hz from h) as horizon_us,
   least(count(*), 500) as retained_event_count from s"""))
def replay_manifest(spark, sf):
    events, outcomes = _replay_input(spark, sf)
    return rp.replay_manifest(events, outcomes, SPLIT_US, max_events=500)


REPLAY_NAMES = ["log_amount", "sender_out_count", "recipient_in_value", "pair_out_count"]


def _scorer(df):
    return df.withColumn("score", F.round(F.col("log_amount") + F.col("sender_out_count") / 10, 6))


@query("replay", "with " + PAY_ORDERS.strip() + HISTORY_SQL + f"""
 select raw.event_id, label, round({FEATURE_SQL['sender_out_count']}, 6) as sender_out_count
 from raw join pay using (event_id) where raw.event_us >= 883612800000000""")
def replay(spark, sf):
    events, outcomes = _replay_input(spark, sf)
    rows, _ = rp.replay(events, outcomes, SPLIT_US, _scorer, REPLAY_NAMES)
    return rows.select("event_id", "label", r6(F.col("sender_out_count")).alias("sender_out_count"))


@query("replay_fixed_history", with_cte(PAY_ORDERS, """
 select p.event_id, round(ln(1 + (select count(*) from pay x where x.source = p.source and x.event_us < 883612800000000)) / 6, 6) as sender_out_count,
   round(ln(1 + (select count(*) from pay x where x.source = p.source and x.destination = p.destination and x.event_us < 883612800000000)) / 3, 6) as pair_out_count
 from pay p where event_us >= 883612800000000"""))
def replay_fixed_history(spark, sf):
    events, outcomes = _replay_input(spark, sf)
    rows = rp.replay_rows(events, outcomes, SPLIT_US, _scorer, REPLAY_NAMES, "fixed")
    return rows.select("event_id", *[r6(F.col(n)).alias(n) for n in ("sender_out_count", "pair_out_count")])


def _retained_sql(limit: int, frozen: int | None = None) -> str:
    """All features from the last events before each time, by a self-join on positions."""
    ask = "event_us" if frozen is None else f"least(event_us, {frozen})"
    head, rest = HISTORY_SQL.split("st as (", 1)
    tail = rest[rest.index("raw as (") :]
    moves = head.replace("event_us, 1 as o", "event_us, pos, 1 as o").replace("event_us, 0, 1, case", "event_us, pos, 0, 1, case")
    moves = moves.replace("event_us, 0, 0, 1, 0", "event_us, pos, 0, 0, 1, 0").replace("from pay", "from placed").strip().strip(",")
    return f"""with {PAY_ORDERS.strip()},
placed as (select *, row_number() over (order by event_us, seq) - 1 as pos from pay),
frozen as (select count(*) as n from pay where {'true' if frozen is None else f'event_us < {frozen}'}),
clock as (
  select event_us, {ask} as asked, least(min(pos), (select n from frozen)) as stop,
    greatest(0, least(min(pos), (select n from frozen)) - {limit}) as first
  from placed group by 1, 2
),
{moves},
st as (
  select a.acct, a.event_us, coalesce(sum(o), 0) as oc, coalesce(sum(i), 0) as ic, coalesce(sum(o * v), 0) as ov,
    coalesce(sum(i * v), 0) as iv, coalesce(sum(touch), 0) as seen, max(case when touch = 1 then m.event_us end) as last_us,
    coalesce(sum(o) filter (m.event_us >= asked - 3600000000), 0) as roc, coalesce(sum(i) filter (m.event_us >= asked - 3600000000), 0) as ric,
    coalesce(sum(o * v) filter (m.event_us >= asked - 3600000000), 0) as rov, coalesce(sum(i * v) filter (m.event_us >= asked - 3600000000), 0) as riv
  from (select distinct acct, event_us, asked, stop, first from inc join clock using (event_us)) a
    left join inc m on m.acct = a.acct and m.pos >= a.first and m.pos < a.stop
  group by 1, 2
),
pr as (
  select p.event_id, count(d.event_id) filter (d.source = p.source) as same,
    count(d.event_id) filter (d.source = p.destination) as back
  from pay p join clock c using (event_us) left join placed d on d.kind = 'payment' and d.pos >= c.first and d.pos < c.stop and
    ((d.source = p.source and d.destination = p.destination) or (d.source = p.destination and d.destination = p.source))
  where p.kind = 'payment' group by 1
),
{tail}
select event_id, label, {", ".join(f"round(cast({FEATURE_SQL[n]} as double), 6) as {n}" for n in ft.PAYMENT_FEATURES)}
from raw join (select event_id, label from pay) using (event_id) where event_us >= 883612800000000"""


def _retained(spark, sf, history):
    events, outcomes = _replay_input(spark, sf)
    rows, _ = rp.replay(events, outcomes, SPLIT_US, _scorer, ft.PAYMENT_FEATURES, history, max_events=500)
    return rows.select("event_id", "label", *[r6(F.col(n)).alias(n) for n in ft.PAYMENT_FEATURES])


@query("replay_retained", _retained_sql(500))
def replay_retained(spark, sf):
    return _retained(spark, sf, "growing")


@query("replay_retained_fixed", _retained_sql(500, 883612800000000))
def replay_retained_fixed(spark, sf):
    return _retained(spark, sf, "fixed")


@query("replay_split", with_cte(PAY_ORDERS, """
 select case when event_us < 883612800000000 then 'prefix' else 'evaluation' end as part, count(*) as rows from pay group by 1"""))
def replay_split(spark, sf):
    prefix, suffix = rp.replay_split(pay_orders(spark, sf), SPLIT_US)
    both = prefix.select(F.lit("prefix").alias("part")).union(suffix.select(F.lit("evaluation")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))


def _stream(spark, sf):
    """The events table as a stream, mapped like ``pay_events``."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    kind = (
        F.when(F.col("event_type") == "signup", "deposit").when(F.col("event_type") == "error", "report").otherwise("payment")
    )
    user = F.concat(F.lit("account:"), F.col("user_id"))
    other = F.concat(F.lit("account:"), F.get_json_object("props", "$.k"))
    return raw.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").cast("timestamp").alias("event_ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("event_us"),
        F.col("event_id").alias("seq"),
        kind.alias("kind"),
        F.when(kind == "payment", user).alias("source"),
        F.when(kind == "deposit", user).otherwise(other).alias("destination"),
        F.col("value").alias("amount"),
    )


def _stored_payments(spark, sf):
    return pay_events(spark, sf).withColumn("event_ts", F.timestamp_micros("event_us"))


STREAM_NAMES = list(ft.PAYMENT_FEATURES)


@query("stream_payment_features", feature_sql(PAY_EVENTS, STREAM_NAMES, ""))
def stream_payment_features(spark, sf):
    stored, out, checkpoint = (scratch_dir(spark, f"stream-{n}") for n in ("in", "out", "state"))
    payments = _stored_payments(spark, sf)
    payments.write.parquet(stored)
    sft.closing_row(payments).write.mode("append").parquet(stored)

    def write(features, batch):
        features.write.mode("append").parquet(out)

    stream = spark.readStream.schema(payments.schema).parquet(stored).withWatermark("event_ts", "0 seconds")
    run = sft.stream_payment_features(stream, STREAM_NAMES, write, checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    done = spark.read.parquet(out)
    return done.select("event_id", *[r6(F.col(n)).alias(n) for n in STREAM_NAMES])


@query("stream_released_feedback", """
 select cast(event_id as varchar) as event_id, cast(case when event_type = 'error' then 1 else 0 end as integer) as label
 from events where event_type <> 'view'""")
def stream_released_feedback(spark, sf):
    out, checkpoint = scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-state")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    events = raw.select(F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("event_ts"))
    label = F.when(F.col("event_type") == "view", -1).when(F.col("event_type") == "error", 1).otherwise(0)
    outcomes = raw.select(
        F.col("event_id").cast("string").alias("event_id"), label.cast("int").alias("label"),
        (F.col("ts").cast("timestamp") + F.expr("interval 2 days")).alias("available_ts"),
    )
    released = sfb.stream_released_feedback(events, outcomes)
    run = (
        released.select("event_id", "label").writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema("event_id string, label int").parquet(out)


@query("stream_settled_feedback", with_cte(PAY_EVENTS, """,
 o as (select *, event_us + (seq % 5) * 86400000000 as available_us from pay where seq % 7 <> 0)
 select event_id, case when amount > 40 then 1 else 0 end::integer as label,
   case when seq % 5 <= 2 and seq % 11 <> 0 then 'RELEASED' else 'EXPIRED' end as state,
   case when seq % 5 <= 2 and seq % 11 <> 0 then event_us end as event_us, available_us from o"""))
def stream_settled_feedback(spark, sf):
    """Labels come after 0 to 4 days with a horizon of 2; every eleventh event never arrives. Ordered ranges of bounded size."""
    source, out, checkpoint = (scratch_dir(spark, f"settled-{n}") for n in ("in", "out", "state"))
    pay = pay_events(spark, sf)
    available = F.col("event_us") + (F.col("seq") % 5) * 86_400_000_000
    events = pay.filter("seq % 11 <> 0").select("event_id", F.col("event_us").alias("at_us"), F.lit("event").alias("kind"), F.lit(-1).alias("label"))
    outcomes = pay.filter("seq % 7 <> 0").select(
        "event_id", available.alias("at_us"), F.lit("outcome").alias("kind"), F.when(F.col("amount") > 40, 1).otherwise(0).alias("label")
    )
    rows = cut_lineage(events.union(outcomes))

    def step():
        at = F.timestamp_micros("at_us")
        stream = spark.readStream.schema(rows.schema).parquet(source)
        settled = sfb.stream_settled_feedback(
            stream.filter("kind = 'event'").select("event_id", at.alias("event_ts")),
            stream.filter("kind = 'outcome'").select("event_id", "label", at.alias("available_ts")), "2 days",
        )
        run = settled.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        run.trigger(availableNow=True).start().awaitTermination()

    # A key of the join has two rows, so a range is dealt over all tasks and may be large.
    sfb.in_request_order(rows, source, step, "at_us", most=2_000_000)
    last = rows.agg(F.max("at_us")).first()[0]
    if last is not None:
        spark.createDataFrame(sfb.closing_feedback(last, 10 * 86_400_000_000), rows.schema).write.mode("append").parquet(source)
        step()
    done = spark.read.schema("event_id string, label int, available_ts timestamp, event_ts timestamp, state string").parquet(out)
    return done.select(
        "event_id", "label", "state", F.unix_micros("event_ts").alias("event_us"), F.unix_micros("available_ts").alias("available_us")
    )


@query("stream_adaptive_budget", with_cte(PAY_EVENTS, adaptive_sql(""",
   s as (select event_id, seq, ln(1 + amount) as score, case when seq % 2 = 0 then 'even' else 'odd' end as segment
         from pay where kind = 'payment')""") + " select event_id, decision, tau_after from decided"))
def stream_adaptive_budget(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sft.STATE_STORE)
    source, out, checkpoint = (scratch_dir(spark, f"stream-{n}") for n in ("source", "out", "state"))
    rows = pay_events(spark, sf).filter("kind = 'payment'").select(
        "event_id", F.when(F.col("seq") % 2 == 0, "even").otherwise("odd").alias("segment"), F.col("seq").cast("bigint").alias("seq"),
        F.log(1 + F.col("amount").cast("double")).alias("score"),
    )

    def step():
        stream = sfb.stream_adaptive_budget(spark.readStream.schema(rows.schema).parquet(source), 0.05)
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        run.trigger(availableNow=True).start().awaitTermination()

    sfb.in_request_order(rows, source, step, most=1_000_000)
    stored = spark.read.schema("event_id string, decision string, tau_after double").parquet(out)
    return stored.select("event_id", "decision", r6(F.col("tau_after")).alias("tau_after"))


LATE_PARTS = """, marked as (
   select event_id, event_us, seq,
     case when event_us < lo + (hi - lo) // 2 and seq % 7 <> 0 then 1 when event_us < lo + (hi - lo) * 3 // 4 then 2 else 3 end as part
   from pay, (select min(event_us) as lo, max(event_us) as hi from pay)),
 tops as (select part, max(event_us) as top from marked group by 1)"""


@query("late_event_audit", with_cte(PAY_EVENTS, LATE_PARTS + """
 select event_id, case when event_us < (select max(top) from tops t where t.part < m.part) then 'late' else 'accepted' end as part
 from marked m"""))
def late_event_audit(spark, sf):
    """Three batches; the second brings every seventh event of the first half too late."""
    source, out, checkpoint = (scratch_dir(spark, f"audit-{n}") for n in ("in", "out", "state"))
    events = pay_events(spark, sf).select("event_id", "event_us", "seq")
    low, high = events.agg(F.min("event_us"), F.max("event_us")).first()
    early = (F.col("event_us") < low + (high - low) // 2) & (F.col("seq") % 7 != 0)
    part = F.when(early, 1).when(F.col("event_us") < low + (high - low) * 3 // 4, 2).otherwise(3)
    for number in (1, 2, 3):
        events.filter(part == number).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        sfb.late_event_audit(stream, out, checkpoint).trigger(availableNow=True).start().awaitTermination()
    late = spark.read.parquet(f"{out}/late").select("event_id", F.lit("late").alias("part"))
    return spark.read.parquet(f"{out}/accepted").select("event_id", F.lit("accepted").alias("part")).union(late)
