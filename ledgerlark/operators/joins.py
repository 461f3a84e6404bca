"""Joins of events, outcomes, predictions and runs, with their population checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.scalars import classify_outcome
from ledgerlark.plans.ordering import previous_value
from ledgerlark.plans.prefix import asof_last_k, plan_layout


def check_event_outcome_integrity(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Events without an outcome, with a bad label, or with a label known before the event."""
    joined = events.select("event_id", "event_time").join(
        outcomes.select(F.col("event_id").alias("o_id"), "label", "available_at"),
        F.col("event_id") == F.col("o_id"),
        "left",
    )
    problem = (
        F.when(F.col("o_id").isNull(), "missing outcome")
        .when(~F.coalesce(F.col("label").isin(-1, 0, 1), F.lit(False)), "bad label")
        .when((F.col("label") == -1) & F.col("available_at").isNotNull(), "unknown with availability")
        .when(F.col("available_at") < F.col("event_time"), "available before event")
    )
    return joined.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select(
        "event_id", "problem"
    )


# What a prediction score may mean. Only probabilities are bounded.
SCORE_KINDS = ("probability", "risk", "logit")


def prediction_violations(predictions: DataFrame, score_kind: str = "probability") -> DataFrame:
    """Rows of a prediction table that cannot be joined: bad id, bad score, duplicates."""
    if score_kind not in SCORE_KINDS:
        raise ValueError(f"score kind must be one of {SCORE_KINDS}")
    score = F.col("score")
    checks = [
        F.when(F.coalesce(F.col("event_id"), F.lit("")) == "", "id must be a nonempty string"),
        F.when(
            score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), "score must be finite"
        ),
    ]
    if "id" in predictions.columns:
        checks.append(F.when(F.col("id") != F.col("event_id"), "id and event_id disagree"))
    if score_kind == "probability":
        checks.append(F.when((score < 0) | (score > 1), "probabilities lie in [0, 1]"))
    rows = predictions.select(
        "event_id", F.explode(F.filter(F.array(*checks), lambda r: r.isNotNull())).alias("rule")
    )
    twice = (
        predictions.groupBy("event_id")
        .count()
        .filter("count > 1")
        .select("event_id", F.lit("duplicate id").alias("rule"))
    )
    return rows.unionByName(twice)


def missing_and_extra_ids(have: DataFrame, want: DataFrame, id_column: str = "event_id") -> DataFrame:
    """Ids on one side only, as (id, side) with side missing or extra."""
    a = have.select(id_column).distinct()
    b = want.select(id_column).distinct()
    missing = b.join(a, id_column, "left_anti").withColumn("side", F.lit("missing"))
    extra = a.join(b, id_column, "left_anti").withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


def join_predictions(
    events: DataFrame,
    outcomes: DataFrame,
    predictions: DataFrame,
    score_kind: str = "probability",
    subset: DataFrame | None = None,
    check: bool = True,
) -> DataFrame:
    """Predictions with final outcomes, for exactly the events (or the chosen subset of them)."""
    wanted = events if subset is None else events.join(subset.select("event_id"), "event_id", "left_semi")
    if check:
        bad = prediction_violations(predictions, score_kind).limit(1).collect()
        if bad:
            raise ValueError(f"prediction {bad[0]['event_id']!r}: {bad[0]['rule']}")
        off = missing_and_extra_ids(predictions, wanted).orderBy("event_id").limit(5).collect()
        if off:
            raise ValueError(f"prediction ids do not match: {[tuple(r) for r in off]}")
    return (
        wanted.join(predictions, "event_id")
        .join(outcomes.select("event_id", "label", "available_at"), "event_id", "left")
        .withColumn("label", F.coalesce("label", F.lit(-1)))
    )


def overlap_check(target: DataFrame, used: DataFrame, signature: str = "signature") -> DataFrame:
    """Target rows whose observation was already used, by signature."""
    return target.join(used.select(signature), signature, "left_semi")


def comparison_population(
    observations: DataFrame, runs: Sequence[dict], partition: str = "test"
) -> DataFrame:
    """Common held-out ids of several runs, refused when any of them saw the rows.

    ``observations(event_id, signature)``. Each run has ``used(event_id, signature)`` (train and
    validation rows), ``same`` (trained on this dataset), ``test(event_id)`` when it is the same,
    and ``same_namespace`` when ids are comparable although the dataset differs.
    """
    same = [r for r in runs if r["same"]]
    if partition == "all" and same:
        raise ValueError("this dataset trained a selected model; choose its test partition")
    if partition == "test" and not same:
        raise ValueError("no saved test partition belongs to this dataset")
    common = observations
    for run in same:
        common = common.join(run["test"].select("event_id"), "event_id", "left_semi")
    for run in runs:
        leaked = None
        if run["same"] or run.get("same_namespace"):
            leaked = common.join(run["used"].select("event_id"), "event_id", "left_semi")
        if not run["same"]:
            copied = overlap_check(common, run["used"])
            leaked = copied if leaked is None else leaked.unionByName(copied)
        found = leaked.limit(1).collect()
        if found:
            raise ValueError(f"row {found[0]['event_id']} was used to fit a selected model")
    if not common.limit(1).collect():
        raise ValueError("the selected models have no common held-out rows")
    return common


def intersect_ids(first: DataFrame, *others: DataFrame) -> DataFrame:
    result = first.select("event_id")
    for other in others:
        result = result.intersect(other.select("event_id"))
    return result


def reserved_and_evaluation(parts: DataFrame, calibration: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids used for train, validation or calibration, and the test rows that remain."""
    used = parts.filter(F.col("partition").isin("train", "validation")).select("event_id")
    reserved = used.union(calibration.select("event_id")).distinct()
    evaluation = parts.filter("partition = 'test'").join(reserved, "event_id", "left_anti")
    return reserved, evaluation


def combine_model_scores(reports: DataFrame, models: Sequence[str], check: bool = True) -> DataFrame:
    """One row per id: label, decision and score of every model. Labels must agree.

    ``reports(event_id, event_us, model, label, score, decision)``.
    """
    folded = reports.groupBy("event_id").agg(
        F.min("event_us").alias("event_us"),
        F.min("label").alias("label"),
        F.max("label").alias("__other"),
        *[F.max(F.when(F.col("model") == m, F.col("score"))).alias(f"score_{m}") for m in models],
        *[F.max(F.when(F.col("model") == m, F.col("decision"))).alias(f"decision_{m}") for m in models],
    )
    if check:
        off = folded.filter(F.col("label") != F.col("__other")).limit(1).collect()
        if off:
            raise ValueError(f"models disagree on the label of {off[0]['event_id']}")
    return folded.drop("__other")


def common_evaluated(decisions: DataFrame, models: int | None = None) -> DataFrame:
    """Ids that every model has decided (none of them still learning)."""
    folded = decisions.groupBy("event_id").agg(
        F.bool_and(F.col("decision") != "LEARNING").alias("all_decided"),
        F.count_distinct("model").alias("models"),
    )
    kept = folded.filter("all_decided")
    if models is not None:
        kept = kept.filter(F.col("models") == models)
    return kept.select("event_id")


def attach_partition(df: DataFrame, membership: DataFrame, check: bool = True) -> DataFrame:
    """Saved split membership by id; it must name every row."""
    if check:
        lost = df.join(membership, "event_id", "left_anti").limit(1).collect()
        if lost:
            raise ValueError(f"row {lost[0]['event_id']} has no saved partition")
    return df.join(membership.select("event_id", "partition"), "event_id")


def incidences(payments: DataFrame) -> DataFrame:
    """Two rows per payment between accounts: (account, other, role -1 sent / +1 received, ...)."""
    rows = payments.filter(
        (F.col("kind") == "payment") & F.col("source").isNotNull() & F.col("destination").isNotNull()
    )

    def side(account: str, other: str, role: int) -> Column:
        return F.struct(
            F.col(account).alias("account"), F.col(other).alias("other"), F.lit(role).alias("role")
        )

    return rows.select(
        "event_id", "event_us", "seq", "amount",
        F.explode(F.array(side("source", "destination", -1), side("destination", "source", 1))).alias("s"),
    ).select(
        "event_id", "event_us", "amount", "s.*",
        # Position inside the timestamp: input order, the sender's row first.
        (F.col("seq") * 2 + F.when(F.col("s.role") < 0, 0).otherwise(1)).alias("place"),
    )


def last_neighbors(
    payments: DataFrame, probes: DataFrame, k: int, name: str = "neighbors",
    fields: Sequence[str] = ("other", "event_id", "event_us", "amount", "role"),
) -> DataFrame:
    """Last k counterparties strictly before each probe ``(account, event_us, ...)``, oldest first.

    Items are structs of ``fields``.
    """
    history = incidences(payments)
    item = F.struct(*fields)
    layout = plan_layout(history, ["account"], "event_us")
    size = 2 * payments.count() + probes.count()
    return asof_last_k(history, probes, ["account"], "event_us", "place", item, k, name, layout, size)


def pair_state(updates: DataFrame, probes: DataFrame, value: str, name: str = "state") -> DataFrame:
    """Latest value of each directed pair strictly before a probe; simultaneous updates averaged."""
    keys = ["source", "destination"]
    folded = (
        updates.groupBy(*keys, "event_us")
        .agg(F.avg(value).alias("__v"))
        .withColumn("__tie", F.lit(0).cast("bigint"))
    )
    layout = plan_layout(folded, keys, "event_us")
    found = asof_last_k(folded, probes, keys, "event_us", "__tie", F.col("__v"), 1, "__items", layout)
    return found.withColumn(name, F.try_element_at("__items", F.lit(1))).drop("__items")


def neighbor_edges(edges: DataFrame, node: str, direction: str = "both") -> DataFrame:
    """Edges at one node; a self-loop appears once."""
    out, inc = F.col("src") == node, F.col("dst") == node
    if direction not in ("both", "incoming", "outgoing"):
        raise ValueError("direction must be both, incoming or outgoing")
    return edges.filter({"both": out | inc, "outgoing": out, "incoming": inc}[direction])


def neighbor_edges_of(edges: DataFrame, nodes: DataFrame, direction: str = "both") -> DataFrame:
    """Edges at a set of nodes, as (node, edge columns); two equi-joins, self-loops once."""
    out = edges.join(nodes.select(F.col("node").alias("src")), "src").withColumn("node", F.col("src"))
    inc = edges.join(nodes.select(F.col("node").alias("dst")), "dst").withColumn("node", F.col("dst"))
    if direction == "outgoing":
        return out
    if direction == "incoming":
        return inc
    return out.unionByName(inc.filter("src <> dst"))


def history_edges(events: DataFrame) -> DataFrame:
    """Directed edges of an event: every source-role entity to every destination-role entity.

    The number of entities of one event is part of its row, so the pairs stay within the row.
    """
    sources = events.withColumn("s", F.explode(F.filter("entities", lambda e: e["role"] == "source")))
    both = sources.withColumn("d", F.explode(F.filter("entities", lambda e: e["role"] == "destination")))
    return both.select(
        "event_id", "event_time", "event_us", "event_type",
        F.col("s.kind").alias("source_kind"), F.col("s.id").alias("source_id"),
        F.col("d.kind").alias("destination_kind"), F.col("d.id").alias("destination_id"),
    )


def history_neighbors(events: DataFrame, kind: str, id: str, direction: str = "both") -> DataFrame:
    """Distinct neighbours of an entity in a history; identity is (kind, id), not the role."""
    edges = history_edges(events)
    out = edges.filter((F.col("source_kind") == kind) & (F.col("source_id") == id)).select(
        F.col("destination_kind").alias("kind"), F.col("destination_id").alias("id")
    )
    inc = edges.filter((F.col("destination_kind") == kind) & (F.col("destination_id") == id)).select(
        F.col("source_kind").alias("kind"), F.col("source_id").alias("id")
    )
    chosen = {"both": out.union(inc), "outgoing": out, "incoming": inc}
    return chosen[direction].distinct()


def decision_violations(decisions: DataFrame, by: Sequence[str], mode: str = "shadow") -> DataFrame:
    """Decisions that contradict their score, cutoff, eligibility, settlement or predecessor."""
    chained = previous_value(decisions, by, ["seq"], "tau_after", "__previous")
    decision = F.col("decision")
    context, learning = ~F.col("eligible"), F.col("tau_before").isNull()
    above = F.coalesce(F.col("score") > F.col("tau_before"), F.lit(False))
    expected = (
        F.when(context, "CONTEXT").when(learning, "LEARNING").when(above, "BLOCK").otherwise("ALLOW")
    )
    settled = F.lit(True) if mode == "shadow" else decision != "BLOCK"
    checks = [
        F.when(decision != expected, "decision differs from score and cutoff"),
        F.when(
            F.col("__previous").isNotNull() & ~F.col("tau_before").eqNullSafe(F.col("__previous")),
            "cutoff differs from the one left by the previous request",
        ),
        F.when(F.col("settled") != settled, "settlement differs from the mode"),
        F.when(F.isnan("score") | (F.col("score") < 0), "score must be finite and nonnegative"),
    ]
    return chained.select(
        *by, "event_id", F.explode(F.filter(F.array(*checks), lambda r: r.isNotNull())).alias("rule")
    )


def filter_records(
    records: DataFrame,
    decision: str = "all",
    outcome: str = "all",
    text: str = "",
    sort: str = "time",
    descending: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Scored rows by decision, outcome class and substring; nulls last, then time and id."""
    rows = records.withColumn("outcome", classify_outcome(F.col("decision"), F.col("label")))
    if decision != "all":
        rows = rows.filter(F.col("decision") == decision)
    if outcome == "known":
        rows = rows.filter(F.col("label") >= 0)
    elif outcome == "unknown":
        rows = rows.filter(F.col("label").isNull() | (F.col("label") < 0))
    elif outcome != "all":
        rows = rows.filter(F.col("outcome") == outcome)
    if text.strip():
        joined = F.lower(
            F.concat_ws(" ", "event_id", F.col("amount").cast("string"), "source", "destination")
        )
        rows = rows.filter(F.contains(joined, F.lit(text.strip().lower())))
    key = F.col({"time": "event_us", "amount": "amount", "score": "score", "tau": "tau_before", "id": "event_id"}[sort])
    key = key.desc_nulls_last() if descending else key.asc_nulls_last()
    ordered = rows.orderBy(key, "event_us", "event_id")
    return ordered if limit is None else ordered.limit(limit)
