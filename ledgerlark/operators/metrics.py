"""Counts, confusion figures, ranking metrics, column statistics and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.scalars import sigmoid, softplus
from ledgerlark.plans.prefix import BUCKET, Cuts, bucketed_prefix, measure_cuts, with_scalars


def class_counts(df: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    value = F.col(label)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(value == 1).alias("fraud"),
        F.count_if(value == 0).alias("legitimate"),
        F.count_if(value < 0).alias("unknown"),
    )


def confusion_counts(df: DataFrame, blocked: Column, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    actual = F.col(label)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(actual >= 0).alias("known"),
        F.count_if(actual < 0).alias("unknown"),
        F.count_if((actual == 1) & blocked).alias("tp"),
        F.count_if((actual == 0) & blocked).alias("fp"),
        F.count_if((actual == 1) & ~blocked).alias("fn"),
        F.count_if((actual == 0) & ~blocked).alias("tn"),
        F.avg(blocked.cast("double")).alias("block_rate"),
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def with_rates(counts: DataFrame, known: str | None = "known") -> DataFrame:
    """Precision, recall and F1; F1 is 0 when rows are known but nothing is positive."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    empty = F.lit(0.0) if known is None else F.when(F.col(known) > 0, F.lit(0.0))
    return counts.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": F.coalesce(_ratio(2 * tp, 2 * tp + fp + fn), empty),
        }
    )


def confusion_metrics(
    df: DataFrame, cutoff: float | Column, score: str = "score", by: Sequence[str] = (), label: str = "label"
) -> DataFrame:
    """A row is blocked when its score is strictly above the cutoff; block rate is over all rows."""
    limit = cutoff if isinstance(cutoff, Column) else F.lit(float(cutoff))
    return with_rates(confusion_counts(df, F.col(score) > limit, by, label))


def objective_metrics(counts: DataFrame) -> DataFrame:
    """Further figures from tp, fp, fn, tn: F2, balanced accuracy and false-block rate."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return with_rates(counts, None).withColumns(
        {
            "f2": F.coalesce(_ratio(5 * tp, 5 * tp + fp + 4 * fn), F.lit(0.0)),
            "balanced_accuracy": (_ratio(tp, tp + fn) + _ratio(tn, tn + fp)) / 2,
            "false_block_rate": _ratio(fp, fp + tn),
        }
    )


def score_groups(
    df: DataFrame, score: str, by: Sequence[str] = (), label: str = "label"
) -> DataFrame:
    """Per distinct score: rows of either class and of unknown label."""
    return df.groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) == 0).alias("neg"),
        F.count(F.lit(1)).alias("n"),
    )


def ranking_metrics(
    df: DataFrame, score: str = "score", by: Sequence[str] = (), label: str = "label", cuts: Cuts | None = None
) -> DataFrame:
    """Exact average precision and ROC AUC over the known rows; NULL unless both classes occur.

    Rows are first folded to distinct scores, so ties are exact and heavy ties cost nothing.
    """
    known = df.filter(F.col(label) >= 0)
    groups = score_groups(known, score, by, label)
    below = bucketed_prefix(
        groups,
        [score],
        {"pos_below": F.col("pos"), "neg_below": F.col("neg")},
        by=by,
        cuts=cuts or measure_cuts(df, score),
    )
    totals = groups.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    joined = below.join(totals, list(by)) if by else with_scalars(below, totals)
    above_pos = F.col("all_pos") - F.col("pos_below")
    above = above_pos + F.col("all_neg") - F.col("neg_below")
    sums = joined.groupBy(*by).agg(
        F.max("all_pos").alias("all_pos"),
        F.max("all_neg").alias("all_neg"),
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("wins"),
        F.sum(F.col("pos") * above_pos / above).alias("precision_sum"),
    )
    both = (F.col("all_pos") > 0) & (F.col("all_neg") > 0)
    return sums.select(
        *by,
        F.when(both, F.col("precision_sum") / F.col("all_pos")).alias("average_precision"),
        F.when(both, F.col("wins") / (F.col("all_pos") * F.col("all_neg"))).alias("roc_auc"),
    )


def log_loss(df: DataFrame, probability: str, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Mean log loss of the known rows, probabilities clipped at 1e-15."""
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(probability)))
    loss = F.when(F.col(label) == 1, -F.log(p)).otherwise(-F.log1p(-p))
    return df.filter(F.col(label) >= 0).groupBy(*by).agg(F.avg(loss).alias("log_loss"))


def log_loss_from_logits(df: DataFrame, logit: str, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    loss = softplus(F.col(logit)) - F.col(label) * F.col(logit)
    return df.filter(F.col(label) >= 0).groupBy(*by).agg(F.avg(loss).alias("log_loss"))


def link_metrics(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Observed links (``positive``) against sampled ones (``negative``, NULL when unpaired)."""
    paired = pairs.filter(F.col("negative").isNotNull())
    stacked = paired.select(
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("label"), F.col("positive").alias("logit")),
                F.struct(F.lit(0).alias("label"), F.col("negative").alias("logit")),
            )
        ).alias("x")
    ).select("x.*")
    ranked = ranking_metrics(stacked, "logit")
    right = ((sigmoid(F.col("logit")) > threshold).cast("int") == F.col("label")).cast("double")
    rest = stacked.agg(
        F.avg(right).alias("accuracy"),
        F.avg(softplus(F.col("logit")) - F.col("label") * F.col("logit")).alias("log_loss"),
    )
    counts = pairs.agg(
        F.count(F.lit(1)).alias("observed_links"),
        F.count("negative").alias("paired_links"),
        F.count_if(F.col("negative").isNull()).alias("unpaired_links"),
    )
    # Three frames of one row each.
    return with_scalars(with_scalars(counts, ranked), rest)


def recall_at_budget(
    df: DataFrame, alpha: float, score: str = "score", order: str = "seq", label: str = "label"
) -> DataFrame:
    """Frauds among the top floor(alpha * n) labelled rows, ties in request order.

    Whole score groups are counted by a prefix; only the group that the budget cuts is ranked by
    request order, itself in buckets, so a score shared by most rows stays parallel.
    """
    labeled = df.filter(F.col(label) >= 0)
    groups = score_groups(labeled, score, (), label)
    above = bucketed_prefix(
        groups,
        [score],
        {"n_above": F.col("n"), "pos_above": F.col("pos")},
        descending=True,
        cuts=measure_cuts(df, score),
    )
    totals = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("labeled"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"),
    ).withColumn("budget", F.floor(F.lit(float(alpha)) * F.col("labeled")))
    whole = with_scalars(above, totals).agg(
        F.coalesce(
            F.sum(F.when(F.col("n_above") + F.col("n") <= F.col("budget"), F.col("pos"))), F.lit(0)
        ).alias("whole_pos"),
        F.max(
            F.when(
                (F.col("n_above") < F.col("budget"))
                & (F.col("n_above") + F.col("n") > F.col("budget")),
                F.struct(F.col(score).alias("s"), (F.col("budget") - F.col("n_above")).alias("left")),
            )
        ).alias("cut"),
    )
    members = with_scalars(labeled, whole.select("cut")).filter(F.col(score) == F.col("cut.s"))
    ranked = bucketed_prefix(
        members, [order], {"__rank": F.lit(1).cast("bigint")}, cuts=measure_cuts(df, order)
    )
    part = ranked.agg(
        F.count_if((F.col("__rank") < F.col("cut.left")) & (F.col(label) == 1)).alias("part_pos")
    )
    caught = F.col("whole_pos") + F.col("part_pos")
    return with_scalars(with_scalars(totals, whole), part).select(
        "labeled",
        "positives",
        "budget",
        caught.alias("caught_at_budget"),
        _ratio(caught, F.col("positives")).alias("recall_at_budget"),
    )


def column_statistics(
    df: DataFrame, features: Sequence[str], bins: int = 10, cuts: int = 256
) -> tuple[DataFrame, DataFrame]:
    """Per feature: counts, moments and interpolated quartiles; and an equal-width histogram.

    All features go through the same two grouped passes, however many there are: one over the rows
    (sizes, moments and ``cuts`` approximate quantiles), one over the counts of distinct values, which are ranked
    within the quantile buckets of their feature.
    """

    def finite(feature: str) -> Column:
        value = F.col(feature).cast("double")
        return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), value)

    cells = [F.struct(F.lit(i).alias("f"), finite(name).alias("v")) for i, name in enumerate(features)]
    long = df.select(F.inline(F.array(*cells)))
    names = df.sparkSession.createDataFrame(list(enumerate(features)), "f int, feature string")
    shares = [i / cuts for i in range(1, cuts)]
    sizes = names.join(
        long.groupBy("f").agg(
            F.count("v").alias("count"),
            F.count_if(F.col("v").isNull()).alias("missing"),
            F.avg("v").alias("mean"),
            F.stddev_pop("v").alias("std"),
            F.min("v").alias("min"),
            F.max("v").alias("max"),
            F.percentile_approx("v", shares, 10 * cuts).alias("bounds"),
        ),
        "f",
        "left",
    ).na.fill(0, ["count", "missing"])
    counted = long.filter("v is not null").groupBy("f", "v").agg(F.count(F.lit(1)).alias("c"))
    sized = counted.join(F.broadcast(sizes), "f")  # one row per feature
    bucketed = sized.withColumn(BUCKET, F.size(F.filter("bounds", lambda b: b <= F.col("v"))))
    totals = bucketed.groupBy("f", BUCKET).agg(F.sum("c").alias("__t"))
    earlier = Window.partitionBy("f").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("f", BUCKET, F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__carry"))
    inside = Window.partitionBy("f", BUCKET).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = bucketed.withColumn("__in", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(carry, ["f", BUCKET])
    before = F.col("__carry") + F.col("__in")

    def at(position: Column) -> Column:
        return F.max(F.when((before <= position) & (position < before + F.col("c")), F.col("v")))

    place = {s: (F.col("count") - 1) * F.lit(s / 100) for s in (25, 50, 75)}
    picks = [
        pick for s, p in place.items() for pick in (at(F.floor(p)).alias(f"lo{s}"), at(F.ceil(p)).alias(f"hi{s}"))
    ]
    ranked = placed.groupBy("f").agg(F.count(F.lit(1)).alias("unique"), *picks)
    quantiles = [
        (F.col(f"lo{s}") + (F.col(f"hi{s}") - F.col(f"lo{s}")) * (p - F.floor(p))).alias(f"p{s}")
        for s, p in place.items()
    ]
    whole = sizes.join(ranked, "f", "left").na.fill(0, ["unique"])
    stats = whole.select("feature", "count", "missing", "unique", "min", "max", "mean", "std", *quantiles)
    k = F.when(F.col("min") == F.col("max"), 1).otherwise(F.least(F.lit(bins), F.col("unique")))
    limits = whole.select("f", F.col("min").alias("lo"), F.col("max").alias("hi"), k.alias("k"), "feature")
    share = F.when(F.col("hi") == F.col("lo"), 0.0).otherwise((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    histogram = (
        counted.join(F.broadcast(limits), "f")
        .withColumn("bin", F.least(F.floor(share * F.col("k")), F.col("k") - 1).cast("int"))
        .groupBy("feature", "bin", "lo", "hi", "k")
        .agg(F.sum("c").alias("count"))
        .select(
            "feature", "bin",
            (F.col("lo") + F.col("bin") / F.col("k") * (F.col("hi") - F.col("lo"))).alias("bin_min"),
            (F.col("lo") + (F.col("bin") + 1) / F.col("k") * (F.col("hi") - F.col("lo"))).alias("bin_max"),
            "count",
        )
    )
    return stats, histogram


def dataset_fingerprint(df: DataFrame, columns: Sequence[str] | None = None, buckets: int = 256) -> DataFrame:
    """Content hash that depends neither on row order nor on partitioning.

    Row hashes are summed per bucket (count and four wrapped sums), and the bucket lines hashed.
    """
    names = sorted(columns or df.columns)
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in names]), {"ignoreNullFields": "false"}), 256)
    hashed = df.select(row.alias("h"))

    def quarter(i: int) -> Column:
        # 15 hex digits fit a BIGINT; sums of decimals cannot overflow.
        return F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)"))

    per_bucket = hashed.groupBy(
        (F.conv(F.substring("h", 61, 4), 16, 10).cast("int") % buckets).alias("b")
    ).agg(
        F.count(F.lit(1)).alias("n"), *[quarter(i).alias(f"q{i}") for i in range(4)]
    )
    line = F.concat_ws(":", "b", "n", *[f"q{i}" for i in range(4)])
    header = ",".join(names)
    return per_bucket.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.sha2(
            F.concat_ws("|", F.lit(header), F.array_join(F.array_sort(F.collect_list(line)), "|")), 256
        ).alias("fingerprint"),  # at most `buckets` lines
    )


def fit_standardizer(train: DataFrame, features: Sequence[str], floor: float = 1e-6) -> DataFrame:
    """Mean and population deviation (at least ``floor``) per feature, long format."""
    row = train.agg(
        *[F.avg(f).alias("m_" + f) for f in features],
        *[F.stddev_pop(f).alias("s_" + f) for f in features],
    )
    entries = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col("m_" + f).alias("mean"),
            F.greatest(F.lit(floor), F.col("s_" + f)).alias("scale"),
        )
        for f in features
    ]
    return row.select(F.inline(F.array(*entries)))


def standardize(df: DataFrame, fitted: DataFrame, features: Sequence[str]) -> DataFrame:
    """Apply a fitted standardizer; its one row per feature is brought to the driver as literals."""
    values = {r["feature"]: (r["mean"], r["scale"]) for r in fitted.collect()}
    return df.withColumns(
        {f: (F.col(f) - F.lit(values[f][0])) / F.lit(values[f][1]) for f in features}
    )


def class_weight(df: DataFrame, cap: float | None = None, label: str = "label") -> DataFrame:
    """Weight of the fraud class: legitimate over fraud, optionally capped."""
    counts = df.agg(
        F.count_if(F.col(label) == 1).alias("fraud"), F.count_if(F.col(label) == 0).alias("legitimate")
    )
    ratio = F.greatest(F.lit(1.0), F.col("legitimate")) / F.greatest(F.lit(1.0), F.col("fraud"))
    return counts.select(
        "fraud", "legitimate", (ratio if cap is None else F.least(F.lit(cap), ratio)).alias("weight")
    )


def label_availability_kind(outcomes: DataFrame) -> DataFrame:
    """as-of when every known label has a time, retrospective when none has, else mixed."""
    counted = outcomes.agg(
        F.count_if(F.col("label") >= 0).alias("known"),
        F.count_if((F.col("label") >= 0) & F.col("available_at").isNotNull()).alias("recorded"),
    )
    kind = (
        F.when((F.col("known") > 0) & (F.col("known") == F.col("recorded")), "as-of")
        .when(F.col("recorded") > 0, "mixed")
        .otherwise("retrospective")
    )
    return counted.withColumn("availability", kind)


def contribution_summary(records: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature: mean absolute, mean, min and max contribution; mean, min and max value."""
    names = F.array(*[F.lit(f) for f in features])
    long = records.select(
        F.posexplode(F.arrays_zip("contributions", "values")).alias("position", "x")
    ).select(
        "position",
        F.element_at(names, F.col("position") + 1).alias("feature"),
        F.col("x.contributions").alias("c"),
        F.col("x.values").alias("v"),
    )
    return long.groupBy("position", "feature").agg(
        F.avg(F.abs("c")).alias("mean_abs"),
        F.avg("c").alias("mean"),
        F.min("c").alias("min"),
        F.max("c").alias("max"),
        F.avg("v").alias("mean_value"),
        F.min("v").alias("min_value"),
        F.max("v").alias("max_value"),
    )


def metrics_by_scenario(decisions: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """Per scenario: requests, warm-up rows, outcome counts and the cutoff after the last request."""
    blocked = F.col("decision") == "BLOCK"
    judged = F.col("decision").isin("BLOCK", "ALLOW")
    actual = F.col("label")
    return decisions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("decision") == "LEARNING").alias("calibration"),
        F.count_if(judged & (actual == 1) & blocked).alias("tp"),
        F.count_if(judged & (actual == 1) & ~blocked).alias("fn"),
        F.count_if(judged & (actual == 0) & blocked).alias("fp"),
        F.count_if(judged & (actual == 0) & ~blocked).alias("tn"),
        F.max_by("tau_after", order).alias("tau"),
    )
