"""Queries over splits, metrics, cutoffs and decision policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.catalog.base import PAY_ORDERS, SCORES, pay_orders, query, r6, scores, with_cte
from ledgerlark.operators import metrics as mt
from ledgerlark.operators import policy as pol
from ledgerlark.operators import splits as sp


def _rounded(df, columns):
    return df.withColumns({c: r6(F.col(c)) for c in columns})


def _sql(body: str) -> str:
    return with_cte(SCORES, body)


@query(
    "class_counts",
    _sql(""" select count(*) as rows, count(*) filter (label = 1) as fraud,
      count(*) filter (label = 0) as legitimate, count(*) filter (label < 0) as unknown from scored"""),
)
def class_counts(spark, sf):
    return mt.class_counts(scores(spark, sf))


CONFUSION_SQL = """, c as (
  select count(*) as rows, count(*) filter (label >= 0) as known, count(*) filter (label < 0) as unknown,
    count(*) filter (label = 1 and score > 12.0) as tp, count(*) filter (label = 0 and score > 12.0) as fp,
    count(*) filter (label = 1 and score <= 12.0) as fn, count(*) filter (label = 0 and score <= 12.0) as tn,
    round(avg(case when score > 12.0 then 1.0 else 0.0 end), 6) as block_rate from scored
)"""


@query(
    "confusion_metrics",
    _sql(CONFUSION_SQL + """ select *, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall,
      round(2 * tp / (2 * tp + fp + fn), 6) as f1 from c"""),
)
def confusion_metrics(spark, sf):
    df = mt.confusion_metrics(scores(spark, sf), 12.0)
    return _rounded(df, ["block_rate", "precision", "recall", "f1"])


@query(
    "objective_metrics",
    _sql(CONFUSION_SQL + """ select tp, fp, fn, tn, round(tp / (tp + fp), 6) as precision,
      round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1,
      round(5 * tp / (5 * tp + fp + 4 * fn), 6) as f2,
      round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) as balanced_accuracy,
      round(fp / (fp + tn), 6) as false_block_rate from c"""),
)
def objective_metrics(spark, sf):
    counts = mt.confusion_counts(scores(spark, sf), F.col("score") > 12.0).select("tp", "fp", "fn", "tn")
    names = ["precision", "recall", "f1", "f2", "balanced_accuracy", "false_block_rate"]
    return _rounded(mt.objective_metrics(counts), names)


@query(
    "recall_at_budget",
    _sql(""", l as (select * from scored where label >= 0),
    b as (select count(*) as labeled, count(*) filter (label = 1) as positives,
          cast(floor(0.05 * count(*)) as bigint) as budget from l),
    r as (select label, row_number() over (order by score desc, seq) as k from l),
    c as (select count(*) as caught from r, b where label = 1 and k <= budget)
    select labeled, positives, budget, caught as caught_at_budget,
      round(caught / positives, 6) as recall_at_budget from b, c"""),
)
def recall_at_budget(spark, sf):
    return _rounded(mt.recall_at_budget(scores(spark, sf), 0.05), ["recall_at_budget"])


RANKING_SQL = """
  g as (select {by} score, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg
        from {source} where label >= 0 group by all),
  w as (select *, sum(pos) over up as tp, sum(pos + neg) over up as n,
          coalesce(sum(neg) over below, 0) as neg_below, sum(pos) over whole as p, sum(neg) over whole as q
        from g window up as ({part} order by score desc),
          below as ({part} order by score rows between unbounded preceding and 1 preceding),
          whole as ({part0}))
"""


@query(
    "ranking_metrics",
    _sql("," + RANKING_SQL.format(by="", source="scored", part="", part0="") +
         """ select round(sum(pos * tp / n) / max(p), 6) as average_precision,
      round(sum(pos * (neg_below + neg / 2)) / (max(p) * max(q)), 6) as roc_auc from w"""),
)
def ranking_metrics(spark, sf):
    return _rounded(mt.ranking_metrics(scores(spark, sf)), ["average_precision", "roc_auc"])


@query(
    "log_loss",
    _sql(""" select round(avg(case when label = 1 then -ln(least(1 - 1e-15, greatest(1e-15, score / 20)))
      else -ln(1 - least(1 - 1e-15, greatest(1e-15, score / 20))) end), 6) as log_loss
      from scored where label >= 0"""),
)
def log_loss(spark, sf):
    df = scores(spark, sf).withColumn("p", F.col("score") / 20)
    return _rounded(mt.log_loss(df, "p"), ["log_loss"])


@query(
    "log_loss_from_logits",
    _sql(""" select round(avg(ln(1 + exp(score - 11)) - label * (score - 11)), 6) as log_loss
      from scored where label >= 0"""),
)
def log_loss_from_logits(spark, sf):
    df = scores(spark, sf).withColumn("logit", F.col("score") - 11)
    return _rounded(mt.log_loss_from_logits(df, "logit"), ["log_loss"])


@query(
    "link_metrics",
    _sql(""", pr as (select score - 11.0 as positive, case when label >= 0 then round(11.3 - score / 7, 1) - 10 end as negative from scored),
    st as (select 1 as label, positive as score from pr where negative is not null
           union all select 0, negative from pr where negative is not null),"""
         + RANKING_SQL.format(by="", source="st", part="", part0="")
         + """, rk as (select round(sum(pos * tp / n) / max(p), 6) as average_precision,
      round(sum(pos * (neg_below + neg / 2)) / (max(p) * max(q)), 6) as roc_auc from w),
    ct as (select count(*) as observed_links, count(negative) as paired_links,
             count(*) - count(negative) as unpaired_links from pr),
    rest as (select round(avg(case when (1 / (1 + exp(-score)) > 0.5) = (label = 1) then 1.0 else 0.0 end), 6) as accuracy,
             round(avg(greatest(score, 0) + ln(1 + exp(-abs(score))) - label * score), 6) as log_loss from st)
    select * from ct, rk, rest"""),
)
def link_metrics(spark, sf):
    pairs = scores(spark, sf).select(
        (F.col("score") - 11.0).alias("positive"),
        F.when(F.col("label") >= 0, F.round(11.3 - F.col("score") / 7, 1) - 10).alias("negative"),
    )
    return _rounded(mt.link_metrics(pairs), ["average_precision", "roc_auc", "accuracy", "log_loss"])


FRONTIER_SQL = """
  fg as (select {by} score, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg, count(*) as n
         from {source} group by all),
  fb as (select {by} score as tau, coalesce(sum(n) over up, 0) as blocks, coalesce(sum(neg) over up, 0) as fp,
           sum(pos) over whole - coalesce(sum(pos) over up, 0) as fn from fg
         window up as ({part} order by score desc rows between unbounded preceding and 1 preceding), whole as ({part})
         union all
         select {by} -2.220446049250313e-16, sum(n), sum(neg), 0 from fg {group}),
  ft as (select {by} sum(n) as requests, sum(pos) as positives, sum(neg) as negatives from fg {group}),
  fo as (select {by} max(tau) as tau, fp, fn, min(blocks) as blocks from fb group by {by} fp, fn),
  frontier as (
    select {o_by} cast(o.tau as double) as tau, cast(o.fp as bigint) as fp, cast(o.fn as bigint) as fn,
      cast(o.blocks as bigint) as blocks, cast(requests as bigint) as requests,
      cast(positives as bigint) as positives, cast(negatives as bigint) as negatives,
      cast(requests - positives - negatives as bigint) as unknown
    from fo o join ft on {join}
    where not exists (select 1 from fo x where {x_join} x.fp <= o.fp and x.fn <= o.fn and (x.fp < o.fp or x.fn < o.fn)))
"""
SINGLE_FRONTIER = FRONTIER_SQL.format(
    by="", source="scored", part="", group="", o_by="", join="true", x_join=""
)
OBJECTIVES_SQL = """, fx as (select *, positives - fn as tp, negatives - fp as tn from frontier),
  fv as (select tau, fp, fn, blocks, requests, positives, negatives, unknown,
    round(case when tp + fp > 0 then tp / (tp + fp) end, 6) as precision, round(tp / positives, 6) as recall,
    round(2 * tp / (2 * tp + fp + fn), 6) as f1, round(5 * tp / (5 * tp + fp + 4 * fn), 6) as f2,
    round((tp / positives + tn / negatives) / 2, 6) as balanced_accuracy,
    round(blocks / requests, 6) as implied_alpha, 2 * tp / (2 * tp + fp + fn) as raw_f1,
    (tp / positives + tn / negatives) / 2 as raw_balanced from fx)"""
RATES = ["precision", "recall", "f1", "f2", "balanced_accuracy", "implied_alpha"]


@query("policy_frontier", _sql("," + SINGLE_FRONTIER + " select * from frontier"))
def policy_frontier(spark, sf):
    return pol.policy_frontier(scores(spark, sf))


@query(
    "select_cost_cutoff",
    _sql("," + SINGLE_FRONTIER + OBJECTIVES_SQL + """ select * exclude (raw_f1, raw_balanced),
      cast(1.5 * fp + 2.0 * fn as double) as loss from fv order by 1.5 * fp + 2.0 * fn, blocks limit 1"""),
)
def select_cost_cutoff(spark, sf):
    return _rounded(pol.select_cost_cutoff(pol.policy_frontier(scores(spark, sf)), 1.5, 2.0), RATES)


@query(
    "cost_grid",
    _sql("," + SINGLE_FRONTIER + OBJECTIVES_SQL + """,
      costs(false_block, missed_fraud) as (values (1.0::double, 1.0::double), (1.0, 2.0), (5.0, 1.0), (1.0, 20.0)),
      cg as (select c.*, fv.* exclude (raw_f1, raw_balanced), false_block * fp + missed_fraud * fn as loss,
        row_number() over (partition by false_block, missed_fraud
                           order by false_block * fp + missed_fraud * fn, blocks) as k from fv, costs c)
      select * exclude (k) from cg where k = 1"""),
)
def cost_grid(spark, sf):
    grid = [(1.0, 1.0), (1.0, 2.0), (5.0, 1.0), (1.0, 20.0)]
    return _rounded(pol.cost_grid(pol.policy_frontier(scores(spark, sf)), grid), RATES)


@query(
    "select_objective_cutoff",
    _sql("," + SINGLE_FRONTIER + OBJECTIVES_SQL + """ select * exclude (raw_f1, raw_balanced),
      (select count(*) from frontier) as candidates_tested from fv order by raw_balanced desc, blocks limit 1"""),
)
def select_objective_cutoff(spark, sf):
    chosen = pol.select_objective_cutoff(pol.policy_frontier(scores(spark, sf)), "balanced_accuracy")
    return _rounded(chosen, RATES)


@query(
    "choose_f1_cutoff",
    _sql("""," g as (select score, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg
        from scored where label >= 0 group by 1),
      b as (select score as tau, coalesce(sum(pos) over up, 0) as tp, coalesce(sum(neg) over up, 0) as fp,
              (select sum(pos) from g) as p from g
            window up as (order by score desc rows between unbounded preceding and 1 preceding)
            union all select -2.220446049250313e-16, sum(pos), sum(neg), sum(pos) from g),
      v as (select tau, 2 * tp / (tp + fp + p) as f1, tp + fp as blocks from b)
      select tau, round(f1, 6) as f1, cast(blocks as bigint) as blocks from v order by v.f1 desc, blocks limit 1"""
         .replace('," g', ", g")),
)
def choose_f1_cutoff(spark, sf):
    return _rounded(pol.choose_f1_cutoff(scores(spark, sf)), ["f1"])


def _two_models(spark, sf):
    base = scores(spark, sf)
    pair = F.explode(
        F.array(
            F.struct(F.lit("amount").alias("model"), F.col("score").alias("s")),
            F.struct(F.lit("supplier").alias("model"), F.round(F.log(2 + F.length("destination") + F.col("amount") / 5000), 1).alias("s")),
        )
    )
    mode = F.when(F.col("seq") % 2 == 0, "shadow").otherwise("enforce")
    return base.withColumn("m", pair).select(
        "event_id", "event_us", "seq", "label", "amount", mode.alias("mode"), "m.model", F.col("m.s").alias("score")
    )


TWO_MODELS = SCORES + """, two as (
  select event_id, event_us, seq, label, amount, case when seq % 2 = 0 then 'shadow' else 'enforce' end as mode,
    'amount' as model, score from scored
  union all
  select event_id, event_us, seq, label, amount, case when seq % 2 = 0 then 'shadow' else 'enforce' end,
    'supplier', round(ln(2 + length(destination) + amount / 5000), 1) from scored
)"""


@query(
    "frontier_by_model",
    with_cte(TWO_MODELS, "," + FRONTIER_SQL.format(
        by="model, mode,", source="two", part="partition by model, mode", group="group by model, mode",
        o_by="o.model, o.mode,", join="o.model = ft.model and o.mode = ft.mode",
        x_join="x.model = o.model and x.mode = o.mode and") + " select * from frontier"),
)
def frontier_by_model(spark, sf):
    return pol.frontier_by_model(_two_models(spark, sf))


@query(
    "ranking_metrics_by_model",
    with_cte(TWO_MODELS, "," + RANKING_SQL.format(
        by="model,", source="two", part="partition by model", part0="partition by model") +
        """ select model, round(sum(pos * tp / n) / max(p), 6) as average_precision,
      round(sum(pos * (neg_below + neg / 2)) / (max(p) * max(q)), 6) as roc_auc from w group by model"""),
)
def ranking_metrics_by_model(spark, sf):
    df = mt.ranking_metrics(_two_models(spark, sf), by=["model"])
    return _rounded(df, ["average_precision", "roc_auc"])


@query(
    "decide_fixed",
    _sql(""" select event_id, case when seq % 7 = 0 then 'CONTEXT' when score > 12 then 'BLOCK' else 'ALLOW' end as decision
      from scored"""),
)
def decide_fixed(spark, sf):
    df = pol.decide_fixed(scores(spark, sf), 12.0, eligible=F.col("seq") % 7 != 0)
    return df.select("event_id", "decision")


TUNED_CUT_US = 883612800000000  # 1998-01-01
VALID_FRONTIER = FRONTIER_SQL.format(
    by="", source="valid", part="", group="", o_by="", join="true", x_join=""
)


@query(
    "decide_tuned",
    _sql(f""", valid as (select * from scored where event_us < {TUNED_CUT_US}),""" + VALID_FRONTIER + f""",
      best as (select tau from frontier order by 1.0 * fp + 1.5 * fn, blocks limit 1)
      select event_id, tau, case when score > tau then 'BLOCK' else 'ALLOW' end as decision
      from scored, best where event_us >= {TUNED_CUT_US}"""),
)
def decide_tuned(spark, sf):
    base = scores(spark, sf)
    cut = F.col("event_us") < TUNED_CUT_US
    df = pol.decide_tuned(base.filter(~cut), base.filter(cut), false_block=1.0, missed_fraud=1.5)
    return df.select("event_id", "tau", "decision")


ADAPTIVE = {"alpha": 0.05, "eta": 0.025, "warmup": 128}


def _adaptive(spark, sf):
    base = pay_orders(spark, sf).withColumn("score", F.log(1 + F.col("amount")))
    segmented = base.withColumn("segment", F.when(F.col("seq") % 3 == 0, "small").otherwise("large"))
    return pol.decide_adaptive_budget(segmented, ["segment"], stretch_rows=2000, **ADAPTIVE)


def adaptive_sql(scored: str, alpha: float = 0.05) -> str:
    """Decisions of the online cutoff by a fold over the requests; ``scored`` defines s(event_id, segment, seq, score)."""
    step = f"(case when x.s > tau0 + 0.025 * (a.k - {alpha} * a.i) then 1 else 0 end)"
    return scored + f""",
      o as (select *, row_number() over (partition by segment order by seq) as k from s),
      t as (select segment, list_sort(list(score)) as w from o where k <= 128 group by segment),
      q as (select segment, w[cast(ceil({1 - alpha} * len(w)) as int)] as tau0 from t),
      f as (select o.segment, tau0, list(struct_pack(s := score) order by seq) as xs
            from o join q using (segment) where k > 128 group by all),
      r as (select segment, list_reduce(xs, lambda a, x: struct_pack(
              i := a.i + 1, k := a.k + {step}, d := list_append(a.d, a.k + {step}), s := 0.0),
            struct_pack(i := 0, k := 0, d := []::int[], s := 0.0)).d as d from f),
      decided as (
        select event_id, segment, 'LEARNING' as decision, null::double as tau_before,
          case when k = 128 then round(tau0, 6) end as tau_after from o join q using (segment) where k <= 128
        union all
        select event_id, segment, case when d[k - 128] > coalesce(d[k - 129], 0) then 'BLOCK' else 'ALLOW' end,
          round(tau0 + 0.025 * (coalesce(d[k - 129], 0) - {alpha} * (k - 129)), 6),
          round(tau0 + 0.025 * (d[k - 128] - {alpha} * (k - 128)), 6)
        from o join q using (segment) join r using (segment) where k > 128)"""


@query("decide_adaptive_budget", with_cte(PAY_ORDERS, adaptive_sql(""",
      s as (select event_id, seq, ln(1 + amount) as score, case when seq % 3 = 0 then 'small' else 'large' end as segment from pay)""")
      + " select * from decided"))
def decide_adaptive_budget(spark, sf):
    return _adaptive(spark, sf).select(
        "event_id", "segment", "decision", r6(F.col("tau_before")).alias("tau_before"),
        r6(F.col("tau_after")).alias("tau_after"),
    )


@query(
    "metrics_by_scenario",
    with_cte(PAY_ORDERS, """,
      s as (select *, ln(1 + amount) as score, case when seq % 3 = 0 then 'small' else 'large' end as segment from pay),
      o as (select *, row_number() over (partition by segment order by seq) as k from s),
      t as (select segment, list_sort(list(score)) as w from o where k <= 128 group by segment),
      q as (select segment, w[cast(ceil(0.95 * len(w)) as int)] as tau0 from t),
      f as (select o.segment, tau0, count(*) + 128 as requests,
              list(struct_pack(s := score, l := label) order by seq) as xs
            from o join q using (segment) where k > 128 group by all),
      r as (select segment, requests, tau0, list_reduce(xs, lambda a, x: struct_pack(
              i := a.i + 1, k := a.k + (case when x.s > tau0 + 0.025 * (a.k - 0.05 * a.i) then 1 else 0 end),
              tp := a.tp + (case when x.l = 1 and x.s > tau0 + 0.025 * (a.k - 0.05 * a.i) then 1 else 0 end),
              fp := a.fp + (case when x.l = 0 and x.s > tau0 + 0.025 * (a.k - 0.05 * a.i) then 1 else 0 end),
              p := a.p + (case when x.l = 1 then 1 else 0 end), n := a.n + (case when x.l = 0 then 1 else 0 end),
              s := 0.0, l := 0), struct_pack(i := 0, k := 0, tp := 0, fp := 0, p := 0, n := 0, s := 0.0, l := 0)) as z from f)
      select segment, requests, cast(128 as bigint) as calibration, cast(z.tp as bigint) as tp,
        cast(z.p - z.tp as bigint) as fn, cast(z.fp as bigint) as fp, cast(z.n - z.fp as bigint) as tn,
        round(tau0 + 0.025 * (z.k - 0.05 * z.i), 6) as tau from r"""),
)
def metrics_by_scenario(spark, sf):
    return _rounded(mt.metrics_by_scenario(_adaptive(spark, sf), ["segment"]), ["tau"])


@query(
    "policy_cost",
    _sql(""" select count(*) as eligible, count(*) filter (score > 12) as blocks,
      count(*) filter (label = 1 and score <= 12) as fn, count(*) filter (label = 0 and score > 12) as fp,
      round(avg(score), 6) as mean_score,
      cast(1.0 * count(*) filter (label = 0 and score > 12) + 20.0 * count(*) filter (label = 1 and score <= 12) as double) as error_cost,
      round(count(*) filter (score > 12) / count(*), 6) as block_rate from scored"""),
)
def policy_cost(spark, sf):
    df = pol.policy_cost(pol.decide_fixed(scores(spark, sf), 12.0))
    return _rounded(df, ["mean_score", "block_rate"])


@query(
    "policy_sweep",
    _sql(""", c(config, tau) as (values ('a', 9.0::double), ('b', 11.0), ('c', 12.0), ('d', 13.0))
      select config, tau, count(*) as requests, count(*) filter (score > tau) as blocks,
        count(*) filter (score > tau and label = 1) as tp, count(*) filter (score > tau and label = 0) as fp,
        count(*) filter (score <= tau and label = 1) as fn, count(*) filter (score <= tau and label = 0) as tn
      from scored, c group by all"""),
)
def policy_sweep(spark, sf):
    return pol.policy_sweep(scores(spark, sf), [("a", 9.0), ("b", 11.0), ("c", 12.0), ("d", 13.0)])


SWEEP_SEGMENTS = """,
      s as (select event_id, seq, label, score, case when seq % 3 = 0 then 'small' else 'large' end as segment from scored
            where event_us >= {cut})""".replace("{cut}", str(TUNED_CUT_US))


def _sweep_sql() -> str:
    counts = """count(*) as requests, count(*) filter (block) as blocks, count(*) filter (block and label = 1) as tp,
      count(*) filter (block and label = 0) as fp, count(*) filter (not block and label = 1) as fn,
      count(*) filter (not block and label = 0) as tn"""
    online = " union all ".join(
        "(" + with_cte(SCORES, adaptive_sql(SWEEP_SEGMENTS, alpha)) + f""" select '{name}' as config, null::double as tau, {counts}
          from (select d.decision = 'BLOCK' as block, s.label from decided d join s using (event_id) where d.decision <> 'LEARNING'))"""
        for name, alpha in (("low", 0.05), ("high", 0.125))
    )
    plain = "(" + _sql(f" select 'fixed' as config, 12.0::double as tau, {counts} from (select score > 12.0 as block, label from scored where event_us >= {TUNED_CUT_US})") + ")"
    return plain + " union all " + online


@query("policy_sweep_online", _sweep_sql())
def policy_sweep_online(spark, sf):
    """Fixed and adaptive configurations side by side."""
    df = scores(spark, sf).filter(F.col("event_us") >= TUNED_CUT_US)
    df = df.withColumn("segment", F.when(F.col("seq") % 3 == 0, "small").otherwise("large"))
    online = [{"config": n, "alpha": a, "eta": 0.025, "warmup": 128} for n, a in (("low", 0.05), ("high", 0.125))]
    return pol.sweep_policies(df, fixed=[("fixed", 12.0)], adaptive=online, by=["segment"])


DISTINCT_TIMES = """, u as (select event_us, row_number() over (order by event_us) - 1 as r,
  count(*) over () as n from (select distinct event_us from scored))"""


@query(
    "chronological_split",
    _sql(DISTINCT_TIMES + """ select event_id, case when r < cast(floor(n * 0.6) as bigint) then 'train'
      when r < cast(floor(n * (0.6::double + 0.2::double)) as bigint) then 'validation' else 'test' end as partition
      from scored join u using (event_us)"""),
)
def chronological_split(spark, sf):
    return sp.chronological_split(scores(spark, sf)).select("event_id", "partition")


FOUR_SQL = DISTINCT_TIMES + """, f as (select event_id, scored.event_us, case when r < cast(floor(n * 0.6) as bigint) then 'train'
  when r < cast(floor(n * (0.6::double + 0.15::double)) as bigint) then 'model_validation'
  when r < cast(floor(n * (0.6::double + 0.15::double + 0.1::double)) as bigint) then 'policy_validation'
  else 'test' end as partition from scored join u using (event_us))"""


@query("four_way_split", _sql(FOUR_SQL + " select event_id, partition from f"))
def four_way_split(spark, sf):
    return sp.four_way_split(scores(spark, sf)).select("event_id", "partition")


@query(
    "label_cutoffs",
    _sql(FOUR_SQL + """ select case partition when 'model_validation' then 'train'
      when 'policy_validation' then 'model_validation' else 'policy_validation' end as partition,
      min(event_us) - 1 as cutoff_us from f where partition <> 'train' group by f.partition"""),
)
def label_cutoffs(spark, sf):
    return sp.label_cutoffs(sp.four_way_split(scores(spark, sf)))


@query(
    "calibration_prefix",
    _sql(""", g as (select event_us, coalesce(sum(count(*)) over (order by event_us rows between unbounded preceding and 1 preceding), 0) as before
        from scored group by 1)
      select event_id from scored where event_us <= (select max(event_us) from g where before < 500)"""),
)
def calibration_prefix(spark, sf):
    return sp.calibration_prefix(scores(spark, sf), 500).select("event_id")


@query(
    "preview_rows",
    _sql(" select event_id, event_us, amount, label from scored order by event_us, seq limit 100"),
)
def preview_rows(spark, sf):
    return sp.preview_rows(scores(spark, sf), 100).select("event_id", "event_us", "amount", "label")


@query(
    "chronological_order",
    _sql(" select event_id, event_us, seq from scored order by event_us, seq"),
)
def chronological_order(spark, sf):
    return sp.chronological_order(scores(spark, sf)).select("event_id", "event_us", "seq")


@query(
    "stratified_context",
    _sql(""", k as (select count(*) filter (label = 1) as p, count(*) filter (label = 0) as n from scored),
      w as (select greatest(1, 400 - n, least(cast(floor(400 * p / (p + n) + 0.5) as bigint), p, 399)) as fraud from k)
      select 1 as label, fraud as rows from w union all select 0, 400 - fraud from w"""),
)
def stratified_context(spark, sf):
    sample = sp.stratified_context(scores(spark, sf), 400)
    return sample.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "inner_pretrain_split",
    _sql(DISTINCT_TIMES + """, t as (select s.event_id, s.event_us from scored s join u using (event_us)
        where r < cast(floor(n * 0.6) as bigint)),
      v as (select event_us, row_number() over (order by event_us) - 1 as r, count(*) over () as n
            from (select distinct event_us from t))
      select event_id, case when r < cast(floor(n * 0.8) as bigint) then 'fit' else 'check' end as "inner"
      from t join v using (event_us)"""),
)
def inner_pretrain_split(spark, sf):
    parts = sp.chronological_split(scores(spark, sf))
    return sp.inner_pretrain_split(parts).select("event_id", "inner")


@query(
    "nearest_rank_quantile",
    _sql(" select quantile_disc(amount, 0.98) as quantile from scored"),
)
def nearest_rank_quantile(spark, sf):
    return sp.nearest_rank_quantile(scores(spark, sf), "amount", 0.98)


@query(
    "episode_split",
    _sql(" select event_id, case when seq % 6 < 4 then 'train' else 'held_out' end as partition from scored"),
)
def episode_split(spark, sf):
    df = scores(spark, sf).withColumn("episode", F.col("seq") % 6)
    return sp.episode_split(df, 6).select("event_id", "partition")


def _stats_sql(feature: str) -> str:
    return f"""select '{feature}' as feature, count({feature}) as count, count(*) - count({feature}) as missing,
      count(distinct {feature}) as "unique", round(min({feature}), 6) as min, round(max({feature}), 6) as max,
      round(avg({feature}), 6) as mean, round(stddev_pop({feature}), 6) as std,
      round(quantile_cont({feature}, 0.25), 6) as p25, round(quantile_cont({feature}, 0.5), 6) as p50,
      round(quantile_cont({feature}, 0.75), 6) as p75 from x"""


STATS_INPUT = """, x as (select cast(amount as double) as amount, cast(score as double) as score,
  case when label >= 0 then cast(label as double) end as target from scored)"""


def _stats(spark, sf):
    df = scores(spark, sf).select(
        "amount", "score", F.when(F.col("label") >= 0, F.col("label").cast("double")).alias("target")
    )
    return mt.column_statistics(df, ["amount", "score", "target"])


@query(
    "column_statistics",
    _sql(STATS_INPUT + " " + " union all ".join(_stats_sql(f) for f in ("amount", "score", "target"))),
)
def column_statistics(spark, sf):
    return _rounded(_stats(spark, sf)[0], ["min", "max", "mean", "std", "p25", "p50", "p75"])


def _hist_sql(feature: str) -> str:
    return f"""select '{feature}' as feature, bin, round(lo + bin / k * (hi - lo), 6) as bin_min,
      round(lo + (bin + 1) / k * (hi - lo), 6) as bin_max, count(*) as count from (
        select cast(least(floor(({feature} - lo) / (hi - lo) * k), k - 1) as int) as bin, lo, hi, k
        from x, (select min({feature}) as lo, max({feature}) as hi, least(10, count(distinct {feature})) as k from x)
        where {feature} is not null) group by all"""


@query(
    "column_histogram",
    _sql(STATS_INPUT + " " + " union all ".join(_hist_sql(f) for f in ("amount", "score", "target"))),
)
def column_histogram(spark, sf):
    return _rounded(_stats(spark, sf)[1], ["bin_min", "bin_max"])


@query("dataset_fingerprint", _sql(""", h as (select sha256('{"amount":' || amount || ',"event_id":"' || event_id
    || '","event_us":' || event_us || ',"label":' || label || '}') as h from scored),
   n as (select ('0x' || substr(h, 61, 4))::bigint % 256 as b, count(*) as n,
     sum(('0x' || substr(h, 1, 15))::hugeint) as q0, sum(('0x' || substr(h, 16, 15))::hugeint) as q1,
     sum(('0x' || substr(h, 31, 15))::hugeint) as q2, sum(('0x' || substr(h, 46, 15))::hugeint) as q3 from h group by 1)
   select sum(n)::bigint as rows, sha256('amount,event_id,event_us,label|' || array_to_string(
     list_sort(list(concat_ws(':', b, n, q0, q1, q2, q3))), '|')) as fingerprint from n"""))
def dataset_fingerprint(spark, sf):
    return mt.dataset_fingerprint(scores(spark, sf).select("event_id", "event_us", "amount", "label"))


@query(
    "fit_standardizer",
    _sql(""" select 'amount' as feature, round(avg(amount), 6) as mean, round(stddev_pop(amount), 6) as scale from scored
      union all select 'score', round(avg(score), 6), round(stddev_pop(score), 6) from scored"""),
)
def fit_standardizer(spark, sf):
    return _rounded(mt.fit_standardizer(scores(spark, sf), ["amount", "score"]), ["mean", "scale"])


@query(
    "class_weight",
    _sql(""" select count(*) filter (label = 1) as fraud, count(*) filter (label = 0) as legitimate,
      round(least(10.0, count(*) filter (label = 0) / count(*) filter (label = 1)), 6) as weight from scored"""),
)
def class_weight(spark, sf):
    return _rounded(mt.class_weight(scores(spark, sf), 10.0), ["weight"])


@query(
    "label_availability_kind",
    _sql(""", k as (select count(*) filter (label >= 0) as known,
        count(*) filter (label >= 0 and available_us is not null) as recorded from scored)
      select known, recorded, case when known > 0 and known = recorded then 'as-of'
        when recorded > 0 then 'mixed' else 'retrospective' end as availability from k"""),
)
def label_availability_kind(spark, sf):
    return mt.label_availability_kind(scores(spark, sf).withColumnRenamed("available_us", "available_at"))
