"""Cutoff selection and decision policies. A payment is blocked when score > cutoff, strictly."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators.metrics import score_groups
from ledgerlark.plans.prefix import Cuts, bucketed_prefix, measure_cuts, with_scalars

# Fixed value: the cutoff below all scores (minus the double precision epsilon).
BELOW_ALL = -2.220446049250313e-16
OBJECTIVES = ("f1", "f2", "balanced_accuracy")


def _boundaries(
    df: DataFrame, score: str, by: Sequence[str], label: str, cuts: Cuts | None
) -> DataFrame:
    """All cutoffs: (tau, blocks, fp, tp) for 'block what is above this score', plus block-all.

    P, N and n are the totals of the group.
    """
    groups = score_groups(df, score, by, label)
    above = bucketed_prefix(
        groups,
        [score],
        {"blocks": F.col("n"), "fp": F.col("neg"), "tp": F.col("pos")},
        by=by,
        descending=True,
        cuts=cuts or measure_cuts(df, score),
    )
    totals = groups.groupBy(*by).agg(
        F.sum("n").alias("requests"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")
    )
    rows = above.select(*by, F.col(score).alias("tau"), "blocks", "fp", "tp")
    everything = totals.select(
        *by,
        F.lit(BELOW_ALL).alias("tau"),
        F.col("requests").alias("blocks"),
        F.col("negatives").alias("fp"),
        F.col("positives").alias("tp"),
    )
    both = rows.unionByName(everything)
    return both.join(totals, list(by)) if by else with_scalars(both, totals)


def policy_frontier(
    df: DataFrame, score: str = "score", by: Sequence[str] = (), label: str = "label", cuts: Cuts | None = None
) -> DataFrame:
    """Nondominated cutoffs (tau, fp, fn, blocks); empty unless both classes are known.

    Among cutoffs that catch the same frauds the highest is kept, then among those with the same
    false blocks the one that misses least. Unknown rows count as blocks only.
    """
    by = list(by)
    rows = _boundaries(df, score, by, label, cuts).filter("positives > 0 and negatives > 0")
    carried = ["requests", "positives", "negatives"]
    first = rows.groupBy(*by, "tp").agg(
        F.max_by(F.struct("tau", "fp", "blocks"), F.col("tau")).alias("x"),
        *[F.max(c).alias(c) for c in carried],
    )
    best = (
        first.select(*by, "tp", "x.*", *carried)
        .groupBy(*by, "fp")
        .agg(
            F.max_by(F.struct("tau", "tp", "blocks"), F.col("tp")).alias("x"),
            *[F.max(c).alias(c) for c in carried],
        )
    )
    return best.select(
        *by,
        F.col("x.tau").alias("tau"),
        "fp",
        (F.col("positives") - F.col("x.tp")).alias("fn"),
        F.col("x.blocks").alias("blocks"),
        *carried,
        (F.col("requests") - F.col("positives") - F.col("negatives")).alias("unknown"),
    )


def frontier_by_model(df: DataFrame, by: Sequence[str] = ("model", "mode"), score: str = "score") -> DataFrame:
    return policy_frontier(df, score, by)


def _with_objectives(frontier: DataFrame) -> DataFrame:
    tp = F.col("positives") - F.col("fn")
    tn = F.col("negatives") - F.col("fp")
    fp, fn = F.col("fp"), F.col("fn")
    return frontier.withColumns(
        {
            "precision": F.when(tp + fp > 0, tp / (tp + fp)),
            "recall": F.when(tp + fn > 0, tp / (tp + fn)),
            "f1": F.coalesce(F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)), F.lit(0.0)),
            "f2": F.coalesce(F.when(5 * tp + fp + 4 * fn > 0, 5 * tp / (5 * tp + fp + 4 * fn)), F.lit(0.0)),
            "balanced_accuracy": F.when(
                (tp + fn > 0) & (tn + fp > 0), (tp / (tp + fn) + tn / (tn + fp)) / 2
            ),
            "implied_alpha": F.col("blocks") / F.col("requests"),
        }
    )


_CHOSEN = [
    "tau", "fp", "fn", "blocks", "requests", "positives", "negatives", "unknown", "precision",
    "recall", "f1", "f2", "balanced_accuracy", "implied_alpha",
]


def select_cost_cutoff(
    frontier: DataFrame, false_block: float = 1.0, missed_fraud: float = 20.0, by: Sequence[str] = ()
) -> DataFrame:
    """The cutoff of least cost, ties with fewer blocks; one row per group."""
    for cost in (false_block, missed_fraud):
        if not (math.isfinite(cost) and cost > 0):
            raise ValueError("error costs must be finite and positive")
    loss = F.lit(float(false_block)) * F.col("fp") + F.lit(float(missed_fraud)) * F.col("fn")
    rows = _with_objectives(frontier).withColumn("loss", loss)
    return rows.groupBy(*by).agg(
        F.min_by(F.struct(*_CHOSEN, "loss"), F.struct("loss", "blocks")).alias("x")
    ).select(*by, "x.*")


def cost_grid(frontier: DataFrame, costs: Sequence[tuple[float, float]], by: Sequence[str] = ()) -> DataFrame:
    """``select_cost_cutoff`` for several (false block, missed fraud) pairs in one pass."""
    grid = F.array(
        *[F.struct(F.lit(float(a)).alias("false_block"), F.lit(float(b)).alias("missed_fraud")) for a, b in costs]
    )
    rows = _with_objectives(frontier).withColumn("c", F.explode(grid)).select("*", "c.*").drop("c")
    rows = rows.withColumn(
        "loss", F.col("false_block") * F.col("fp") + F.col("missed_fraud") * F.col("fn")
    )
    keys = [*by, "false_block", "missed_fraud"]
    return rows.groupBy(*keys).agg(
        F.min_by(F.struct(*_CHOSEN, "loss"), F.struct("loss", "blocks")).alias("x")
    ).select(*keys, "x.*")


def select_objective_cutoff(frontier: DataFrame, objective: str = "f1", by: Sequence[str] = ()) -> DataFrame:
    """The cutoff of largest F1, F2 or balanced accuracy, ties with fewer blocks."""
    if objective not in OBJECTIVES:
        raise ValueError(f"the objective must be one of {OBJECTIVES}")
    rows = _with_objectives(frontier)
    return rows.groupBy(*by).agg(
        F.max_by(F.struct(*_CHOSEN), F.struct(F.col(objective), -F.col("blocks"))).alias("x"),
        F.count(F.lit(1)).alias("candidates_tested"),
    ).select(*by, "x.*", "candidates_tested")


def choose_f1_cutoff(
    df: DataFrame, score: str = "score", by: Sequence[str] = (), label: str = "label", cuts: Cuts | None = None
) -> DataFrame:
    """Largest F1 over the known rows, ties with fewest blocked rows; starts from blocking nothing."""
    rows = _boundaries(df.filter(F.col(label) >= 0), score, by, label, cuts).filter(
        "positives > 0 and negatives > 0"
    )
    fn = F.col("positives") - F.col("tp")
    f1 = F.coalesce(
        F.when(2 * F.col("tp") + F.col("fp") + fn > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + fn)),
        F.lit(0.0),
    )
    return rows.withColumn("f1", f1).groupBy(*by).agg(
        F.max_by(F.struct("tau", "f1", "blocks"), F.struct(F.col("f1"), -F.col("blocks"))).alias("x")
    ).select(*by, "x.*")


def decide_fixed(
    df: DataFrame, tau: float | Column, score: str = "score", eligible: Column | None = None
) -> DataFrame:
    """BLOCK above the cutoff, else ALLOW; ineligible rows are CONTEXT."""
    limit = tau if isinstance(tau, Column) else F.lit(float(tau))
    decision = F.when(F.col(score) > limit, "BLOCK").otherwise("ALLOW")
    if eligible is not None:
        decision = F.when(~eligible, "CONTEXT").otherwise(decision)
    return df.withColumn("decision", decision)


def decide_tuned(
    df: DataFrame, validation: DataFrame, by: Sequence[str] = (), objective: str | None = None,
    false_block: float = 1.0, missed_fraud: float = 20.0, score: str = "score",
) -> DataFrame:
    """Decide with the cutoff that validation rows select by cost or by objective, frozen."""
    frontier = policy_frontier(validation, score, by)
    if objective is None:
        chosen = select_cost_cutoff(frontier, false_block, missed_fraud, by)
    else:
        chosen = select_objective_cutoff(frontier, objective, by)
    cutoffs = chosen.select(*by, "tau")
    joined = df.join(cutoffs, list(by)) if by else with_scalars(df, cutoffs)
    return decide_fixed(joined, F.col("tau"), score)


# --- Adaptive budget -------------------------------------------------------------------------
#
# After the warm-up the cutoff follows tau += eta * (blocked - alpha), so it always equals
# tau0 + eta * (K - alpha * i) with the number K of blocks among the first i decisions. A stretch
# of rows therefore maps a starting K to a final K, and since a larger K can never block where a
# smaller one does not, trajectories keep their order and merge. Stretches are mapped
# independently for the few K the score range permits, the maps are chained, and a second pass
# decides every row. One budget over all rows is thus not a serial job.


def _tau(tau0: float, eta: float, alpha: float, blocks: float, position: float) -> float:
    return tau0 + eta * (blocks - alpha * position)


def map_stretch(
    scores: np.ndarray, start: int, tau0: float, eta: float, alpha: float, low: int, high: int
) -> list[tuple[int, int]]:
    """Final block counts for the starting counts low..high, as (how many starts, final count)."""
    sizes = [1] * (high - low + 1)
    for offset, score in enumerate(scores):
        position = start + offset
        count = math.ceil((score - tau0) / eta + alpha * position)
        while score > _tau(tau0, eta, alpha, count, position):
            count += 1
        while not score > _tau(tau0, eta, alpha, count - 1, position):
            count -= 1
        blocked = min(max(count - low, 0), len(sizes))  # states low .. count-1 block
        if blocked:
            if blocked < len(sizes):
                sizes[blocked] += sizes[blocked - 1]
                del sizes[blocked - 1]
            low += 1
    return [(size, low + i) for i, size in enumerate(sizes)]


def reachable_blocks(
    position: int, tau0: float, eta: float, alpha: float, least: float, most: float
) -> tuple[int, int]:
    """Smallest and largest block count whose cutoff the scores can have produced."""
    low = math.floor((least - tau0) / eta - alpha + alpha * position) - 1
    high = math.ceil((most - tau0) / eta + 1 + alpha * position) + 1
    return max(0, low), max(0, min(position, high))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Slices of equal (stream, stretch) in sorted Arrow batches; True marks a new stretch."""
    previous = None
    for batch in batches:
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        stream = columns["stream"].to_numpy(zero_copy_only=False)
        stretch = columns["stretch"].to_numpy(zero_copy_only=False)
        if not len(stretch):
            continue
        changed = np.flatnonzero((stream[1:] != stream[:-1]) | (stretch[1:] != stretch[:-1])) + 1
        edges = [0, *changed.tolist(), len(stretch)]
        for a, b in zip(edges, edges[1:]):
            key = (stream[a], stretch[a])
            yield key != previous, {n: c.slice(a, b - a) for n, c in columns.items()}
            previous = key


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per stretch: its map from starting to final block count, run-length encoded."""
    state = None

    def emit(s):
        sizes, finals = zip(*s["map"])
        return pa.RecordBatch.from_pydict(
            {
                "stream": pa.array([s["stream"]]),
                "stretch": pa.array([s["stretch"]], pa.int64()),
                "low": pa.array([s["low"]], pa.int64()),
                "sizes": pa.array([list(sizes)], pa.list_(pa.int64())),
                "finals": pa.array([list(finals)], pa.list_(pa.int64())),
            }
        )

    for fresh, part in _runs(batches):
        scores = part["score"].to_numpy(zero_copy_only=False)
        first = {n: part[n][0].as_py() for n in ("stream", "stretch", "place", "tau0", "eta", "alpha", "least", "most")}
        if fresh:
            if state is not None:
                yield emit(state)
            low, high = reachable_blocks(
                first["place"], first["tau0"], first["eta"], first["alpha"], first["least"], first["most"]
            )
            state = {
                "stream": first["stream"], "stretch": first["stretch"], "low": low,
                "map": [(1, k) for k in range(low, high + 1)],
            }
        finals = [k for _, k in state["map"]]
        moved = map_stretch(
            scores, first["place"], first["tau0"], first["eta"], first["alpha"], finals[0], finals[-1]
        )
        state["map"] = _chain(state["map"], moved)
    if state is not None:
        yield emit(state)


def _chain(before: list[tuple[int, int]], after: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Compose two stretch maps; the second starts at the contiguous finals of the first."""
    result, index = [], 0
    for size, final in after:
        result.append((sum(s for s, _ in before[index : index + size]), final))
        index += size
    return result


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decide every row of a stretch from its known starting block count."""
    blocks = 0
    for fresh, part in _runs(batches):
        scores = part["score"].to_numpy(zero_copy_only=False)
        places = part["place"].to_numpy(zero_copy_only=False)
        tau0, eta, alpha = (part[n][0].as_py() for n in ("tau0", "eta", "alpha"))
        if fresh:
            blocks = part["start"][0].as_py()
        decisions, before, after = [], [], []
        for score, place in zip(scores.tolist(), places.tolist()):
            tau = _tau(tau0, eta, alpha, blocks, place)
            block = score > tau
            blocks += block
            decisions.append("BLOCK" if block else "ALLOW")
            before.append(tau)
            after.append(_tau(tau0, eta, alpha, blocks, place + 1))
        yield pa.RecordBatch.from_pydict(
            {
                "stream": part["stream"],
                "place": part["place"],
                "decision": pa.array(decisions, pa.string()),
                "tau_before": pa.array(before, pa.float64()),
                "tau_after": pa.array(after, pa.float64()),
            }
        )


def _start_counts(key, rows):
    """Chain the stretch maps of one stream; the rows are one short map per stretch."""
    import pandas as pd

    rows = rows.sort_values("stretch")
    current, starts = 0, []
    for low, sizes, finals in zip(rows["low"], rows["sizes"], rows["finals"]):
        starts.append(current)
        current = int(finals[int(np.searchsorted(np.cumsum(sizes), current - low, side="right"))])
    return pd.DataFrame({"stream": rows["stream"], "stretch": rows["stretch"], "start": starts})


def decide_adaptive_budget(
    df: DataFrame,
    by: Sequence[str] = (),
    order: str = "seq",
    score: str = "score",
    id_column: str = "event_id",
    alpha: float = 0.02,
    eta: float = 0.025,
    warmup: int = 128,
    eligible: Column | None = None,
    stretch_rows: int = 1_000_000,
    configs: Sequence[dict] | None = None,
) -> DataFrame:
    """Warm-up rows are LEARNING; then the cutoff drifts so that about a share alpha is blocked.

    One stream per ``by`` group (and per entry of ``configs``, dictionaries with ``config``,
    ``alpha``, ``eta`` and ``warmup``). Rows that are not eligible are CONTEXT and leave the cutoff
    alone; they show the cutoff in force. Without a cutoff yet the column is NULL.
    """
    by = list(by)
    settings = list(configs or [{"config": "default", "alpha": alpha, "eta": eta, "warmup": warmup}])
    grid = F.array(
        *[
            F.struct(
                F.lit(str(c["config"])).alias("config"),
                F.lit(float(c["alpha"])).alias("alpha"),
                F.lit(float(c["eta"])).alias("eta"),
                F.lit(max(1, int(c["warmup"]))).alias("warmup"),
            )
            for c in settings
        ]
    )
    kept = [*by, id_column, order, *[c for c in df.columns if c not in (*by, id_column, order, score)]]
    joins = F.lit(True) if eligible is None else eligible
    base = df.select(*kept, F.col(score).cast("double").alias("score"), joins.alias("__joins"))
    # Position among the eligible rows of the group; the same for every configuration.
    placed = bucketed_prefix(
        base, [order, id_column, "score"], {"__place": F.when(F.col("__joins"), 1).otherwise(0).cast("bigint")}, by=by
    )
    rows = placed.withColumn("__c", F.explode(grid)).select("*", "__c.*").drop("__c")
    stream = F.to_json(F.array(*[F.col(c).cast("string") for c in by], F.col("config")))
    rows = rows.withColumn("stream", stream)
    learning = F.col("__place") < F.col("warmup")
    # The warm-up of a stream is bounded by its setting, so its quantile fits one group.
    ready = (
        rows.filter(F.col("__joins") & learning)
        .groupBy("stream")
        .agg(
            F.max("alpha").alias("__alpha"),
            F.max("warmup").alias("__warmup"),
            F.array_sort(F.collect_list("score")).alias("__scores"),
        )
        .filter(F.size("__scores") >= F.col("__warmup"))
        .select(
            "stream",
            F.element_at(
                "__scores",
                F.least(
                    F.size("__scores"),
                    F.greatest(F.lit(1), F.ceil((1 - F.col("__alpha")) * F.size("__scores")).cast("int")),
                ),
            ).alias("tau0"),
        )
    )
    ranges = rows.filter("__joins").groupBy("stream").agg(
        F.min("score").alias("least"), F.max("score").alias("most")
    )
    active = rows.filter(F.col("__joins") & ~learning).select(
        "stream",
        "score",
        "alpha",
        "eta",
        (F.col("__place") - F.col("warmup")).alias("place"),
        F.floor((F.col("__place") - F.col("warmup")) / F.lit(stretch_rows)).cast("bigint").alias("stretch"),
    )
    active = active.join(ready, "stream").join(ranges, "stream")
    # The window holds a stretch together and in order. A repartition by these keys would be dropped above the join by the
    # same keys, and adaptive execution may then read that join's shuffle in pieces.
    inside = F.row_number().over(Window.partitionBy("stream", "stretch").orderBy("place")).alias("nth")
    maps = active.select(
        "stream", "stretch", "place", "score", "tau0", "eta", "alpha", "least", "most", inside
    ).mapInArrow(
        _summarise, "stream string, stretch bigint, low bigint, sizes array<bigint>, finals array<bigint>"
    )
    starts = maps.groupBy("stream").applyInPandas(
        _start_counts, "stream string, stretch bigint, start bigint"
    )
    decided = (
        active.join(starts, ["stream", "stretch"])
        .select("stream", "stretch", "place", "score", "tau0", "eta", "alpha", "start", inside)
        .mapInArrow(
            _decide, "stream string, place bigint, decision string, tau_before double, tau_after double"
        )
    )
    # Ids may repeat; the place of an eligible row doesn't.
    decided = decided.withColumn("__joins", F.lit(True)).withColumnRenamed("place", "__at")
    rows = rows.withColumn("__at", (F.col("__place") - F.col("warmup")).cast("bigint"))
    result = rows.join(decided, ["stream", "__at", "__joins"], "left").join(ready, "stream", "left")
    undecided = F.when(~F.col("__joins"), "CONTEXT").otherwise("LEARNING")
    last_warm = F.col("__joins") & (F.col("__place") == F.col("warmup") - 1)
    result = result.withColumns(
        {
            "decision": F.coalesce("decision", undecided),
            "tau_after": F.coalesce("tau_after", F.when(last_warm, F.col("tau0"))),
        }
    )
    if eligible is not None:
        # A context row shows the cutoff left by the eligible row before it.
        left = result.filter("__joins").select(
            "stream", (F.col("__place") + 1).alias("__place"), F.col("tau_after").alias("__held")
        )
        held = result.join(left, ["stream", "__place"], "left")
        waits = ~F.col("__joins")
        result = held.withColumns(
            {
                "tau_before": F.when(waits, F.col("__held")).otherwise(F.col("tau_before")),
                "tau_after": F.when(waits, F.col("__held")).otherwise(F.col("tau_after")),
            }
        )
    return result.select(*kept, "score", "config", "decision", "tau_before", "tau_after")


def policy_cost(
    decisions: DataFrame, false_block: float = 1.0, missed_fraud: float = 20.0, by: Sequence[str] = ()
) -> DataFrame:
    """Error cost, block rate and mean score of the judged rows."""
    judged = decisions.filter(F.col("decision").isin("BLOCK", "ALLOW"))
    blocked = F.col("decision") == "BLOCK"
    counts = judged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("eligible"),
        F.count_if(blocked).alias("blocks"),
        F.count_if((F.col("label") == 1) & ~blocked).alias("fn"),
        F.count_if((F.col("label") == 0) & blocked).alias("fp"),
        F.avg("score").alias("mean_score"),
    )
    return counts.withColumns(
        {
            "error_cost": F.lit(float(false_block)) * F.col("fp") + F.lit(float(missed_fraud)) * F.col("fn"),
            "block_rate": F.col("blocks") / F.col("eligible"),
        }
    )


def policy_sweep(
    df: DataFrame, cutoffs: Sequence[tuple[str, float]], score: str = "score"
) -> DataFrame:
    """Counts of cached scores under many fixed cutoffs, from one fold to distinct scores."""
    groups = score_groups(df, score)
    grid = F.array(
        *[F.struct(F.lit(name).alias("config"), F.lit(float(t)).alias("tau")) for name, t in cutoffs]
    )
    rows = groups.withColumn("c", F.explode(grid)).select(score, "pos", "neg", "n", "c.*")
    blocked = F.col(score) > F.col("tau")
    return rows.groupBy("config", "tau").agg(
        F.sum("n").alias("requests"),
        F.coalesce(F.sum(F.when(blocked, F.col("n"))), F.lit(0)).alias("blocks"),
        F.coalesce(F.sum(F.when(blocked, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(blocked, F.col("neg"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~blocked, F.col("pos"))), F.lit(0)).alias("fn"),
        F.coalesce(F.sum(F.when(~blocked, F.col("neg"))), F.lit(0)).alias("tn"),
    )


def sweep_policies(
    df: DataFrame,
    fixed: Sequence[tuple[str, float]] = (),
    tuned: Sequence[tuple[str, float, float]] = (),
    calibration: DataFrame | None = None,
    adaptive: Sequence[dict] = (),
    by: Sequence[str] = (),
    score: str = "score",
) -> DataFrame:
    """Counts of cached scores under fixed, tuned and adaptive configurations, one row each.

    ``tuned`` are (config, cost of a false block, cost of a missed fraud), each with the cutoff that is cheapest on
    ``calibration``; ``adaptive`` are configurations of ``decide_adaptive_budget``, whose warm-up rows do
    not count and whose drifting cutoff shows as NULL.
    """
    parts = [policy_sweep(df, fixed, score)] if fixed else []

    def counted(decisions: DataFrame) -> DataFrame:
        blocked = F.col("decision") == "BLOCK"
        return decisions.filter(F.col("decision").isin("BLOCK", "ALLOW")).groupBy("config", "tau").agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(blocked).alias("blocks"),
            F.count_if(blocked & (F.col("label") == 1)).alias("tp"),
            F.count_if(blocked & (F.col("label") == 0)).alias("fp"),
            F.count_if(~blocked & (F.col("label") == 1)).alias("fn"),
            F.count_if(~blocked & (F.col("label") == 0)).alias("tn"),
        )

    for config, false_block, missed_fraud in tuned:
        decided = decide_tuned(df, calibration, false_block=false_block, missed_fraud=missed_fraud)
        parts.append(counted(decided.withColumn("config", F.lit(config))))
    if adaptive:
        decided = decide_adaptive_budget(df, by, configs=adaptive, score=score)
        parts.append(counted(decided.withColumn("tau", F.lit(None).cast("double"))))
    if not parts:
        raise ValueError("no configuration to sweep")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
