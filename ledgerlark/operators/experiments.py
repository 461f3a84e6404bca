"""Training, re-evaluation and comparison of models over chronological partitions."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.scalars import numeric_signature
from ledgerlark.operators.joins import (
    attach_partition,
    combine_model_scores,
    comparison_population,
    reserved_and_evaluation,
)
from ledgerlark.operators.metrics import (
    class_counts,
    confusion_counts,
    confusion_metrics,
    dataset_fingerprint,
    log_loss,
    objective_metrics,
    ranking_metrics,
)
from ledgerlark.operators.policy import choose_f1_cutoff
from ledgerlark.operators.scoring import (
    HEADS,
    SCORERS,
    LogisticModel,
    Scorer,
    fit_logistic,
    register_scorer,
    score_logistic,
    tail_cutoff,
)
from ledgerlark.operators.splits import calibration_prefix, chronological_split
from ledgerlark.operators.trees import TreeEnsemble, fit_boosted_trees, score_tree_ensemble
from ledgerlark.plans.prefix import with_scalars

register_scorer(
    Scorer(
        "logistic_regression",
        lambda train, features: fit_logistic(train, features).to_json(),
        lambda df, state: score_logistic(df, LogisticModel.from_json(state)),
    )
)
register_scorer(
    Scorer(
        "boosted_trees",
        lambda train, features: fit_boosted_trees(train, features).to_json(),
        lambda df, state: score_tree_ensemble(df, TreeEnsemble.from_json(state)),
    )
)


def evaluation_rows(scored: DataFrame, threshold: float, score: str = "probability") -> DataFrame:
    """Report rows: unknown labels are NULL, decisions are BLOCK or ALLOW."""
    extra = [c for c in ("margin", "baseline", "contributions") if c in scored.columns]
    return scored.select(
        "event_id",
        "event_us",
        F.col(score).alias("score"),
        F.when(F.col("label") >= 0, F.col("label")).alias("label"),
        F.when(F.col(score) > F.lit(float(threshold)), "BLOCK").otherwise("ALLOW").alias("decision"),
        *extra,
    )


def evaluation_metrics(scored: DataFrame, threshold: float, score: str = "probability") -> DataFrame:
    """One row: confusion, ranking and log-loss figures of a scored table."""
    base = confusion_metrics(scored, threshold, score)
    ranked = ranking_metrics(scored, score)
    loss = log_loss(scored, score)
    return with_scalars(with_scalars(base, ranked), loss)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"].rstrip("\n")


def _signature(features: Sequence[str]) -> Column:
    return numeric_signature(F.col("event_us"), {f: F.col(f) for f in features})


def train_experiment(
    spark: SparkSession,
    numeric: DataFrame,
    features: Sequence[str],
    path: str,
    scorer: str = "logistic_regression",
    train: float = 0.6,
    validation: float = 0.2,
    threshold: float | None = None,
) -> dict:
    """Split, fit on known training rows, choose the cutoff on validation, report on test, publish.

    ``numeric(event_id, event_us, label, features...)``. The artifact is a new folder with the
    model state, the split membership (with observation signatures) and a manifest.
    """
    model = SCORERS[scorer]
    parts = chronological_split(numeric, train, validation)
    state = model.fit(parts.filter("partition = 'train'"), list(features))
    scored = model.predict(parts, state)
    source = "configured"
    if threshold is None:
        found = choose_f1_cutoff(scored.filter("partition = 'validation'"), "probability").first()
        if found is None:
            raise ValueError("validation needs both known classes, or a fixed threshold")
        threshold, source = found["tau"], "validation-f1"
    test = scored.filter("partition = 'test'")
    metrics = evaluation_metrics(test, threshold).first().asDict()
    membership = parts.select("event_id", "partition", _signature(features).alias("signature"))
    membership.write.mode("errorifexists").parquet(f"{path}/membership")
    evaluation_rows(test, threshold).write.mode("errorifexists").parquet(f"{path}/report")
    _write_text(spark, f"{path}/state", state)
    manifest = {
        "schema": "model-artifact/v1",
        "scorer": scorer,
        "features": list(features),
        "threshold": threshold,
        "threshold_source": source,
        "fingerprint": dataset_fingerprint(numeric, ["event_id", "event_us", *features]).first()["fingerprint"],
        "metrics": metrics,
    }
    _write_text(spark, f"{path}/manifest", json.dumps(manifest))
    return manifest


def load_artifact(spark: SparkSession, path: str) -> dict:
    manifest = json.loads(_read_text(spark, f"{path}/manifest"))
    if manifest.get("schema") != "model-artifact/v1":
        raise ValueError("not a model artifact")
    manifest["state"] = _read_text(spark, f"{path}/state")
    manifest["membership"] = spark.read.parquet(f"{path}/membership")
    return manifest


def evaluate_artifact(
    spark: SparkSession, path: str, numeric: DataFrame, partition: str = "test"
) -> tuple[DataFrame, DataFrame, dict]:
    """Score again with a saved artifact: rows, metrics, and how the data relates to its training."""
    artifact = load_artifact(spark, path)
    features = artifact["features"]
    missing = sorted(set(features) - set(numeric.columns))
    if missing:
        raise ValueError(f"the data lacks features of the model: {missing}")
    content = dataset_fingerprint(numeric, ["event_id", "event_us", *features]).first()["fingerprint"]
    same = content == artifact["fingerprint"]
    rows, membership = numeric, artifact["membership"]
    if partition != "all":
        if not same:
            raise ValueError("a saved partition belongs to the dataset it was made from")
        rows = attach_partition(numeric, membership).filter(F.col("partition") == partition)
    used = membership.filter("partition <> 'test'").select("signature")
    signed = rows.withColumn("signature", _signature(features))
    overlap = signed.join(used, "signature", "left_semi").count()
    scored = SCORERS[artifact["scorer"]].predict(rows, artifact["state"])
    facts = {"same_dataset": same, "overlapping_rows": overlap, "threshold": artifact["threshold"]}
    return (
        evaluation_rows(scored, artifact["threshold"]),
        evaluation_metrics(scored, artifact["threshold"]),
        facts,
    )


def compare_runs(
    spark: SparkSession, runs: dict[str, str], numeric: DataFrame, partition: str = "test"
) -> tuple[DataFrame, DataFrame]:
    """Joined rows and metrics per run on the rows that all runs held out."""
    artifacts = {name: load_artifact(spark, path) for name, path in runs.items()}
    described = []
    for artifact in artifacts.values():
        columns = ["event_id", "event_us", *artifact["features"]]
        same = dataset_fingerprint(numeric, columns).first()["fingerprint"] == artifact["fingerprint"]
        members = artifact["membership"]
        described.append(
            {
                "same": same,
                "used": members.filter("partition <> 'test'").select("event_id", "signature"),
                "test": members.filter("partition = 'test'").select("event_id"),
            }
        )
    first = next(iter(artifacts.values()))
    observed = numeric.select("event_id", _signature(first["features"]).alias("signature"))
    common = comparison_population(observed, described, partition).select("event_id")
    rows = numeric.join(common, "event_id", "left_semi")
    reports = None
    for name, artifact in artifacts.items():
        scored = SCORERS[artifact["scorer"]].predict(rows, artifact["state"])
        report = evaluation_rows(scored, artifact["threshold"]).select(
            F.lit(name).alias("model"), "event_id", "event_us", "score", "label", "decision"
        )
        reports = report if reports is None else reports.unionByName(report)
    known = reports.withColumn("label", F.coalesce("label", F.lit(-1)))
    counts = confusion_counts(known, F.col("decision") == "BLOCK", ["model"])
    metrics = (
        objective_metrics(counts)
        .join(ranking_metrics(known, "score", ["model"]), "model")
        .join(log_loss(known, "score", ["model"]), "model")
    )
    return combine_model_scores(reports, list(artifacts)), metrics


def export_scored_history(
    logits: DataFrame, calibration_rows: int, alpha: float = 0.02, heads: Sequence[str] = ("empirical_tail", "fixed_likelihood")
) -> tuple[DataFrame, DataFrame]:
    """Scores of every row under several heads, and their metrics on the rows left for evaluation.

    ``logits(event_id, event_us, label, partition, logit)``. Heads see the first complete
    timestamp groups of the test partition; those rows, train and validation are not evaluated.
    """
    calibration = calibration_prefix(logits.filter("partition = 'test'"), calibration_rows)
    _, evaluation = reserved_and_evaluation(logits, calibration)
    ids = evaluation.select("event_id")
    scored = metrics = None
    for name in heads:
        head = HEADS[name]
        part = head.score(logits, calibration).select(
            F.lit(name).alias("head"), "event_id", "event_us", "label", "logit", "score"
        )
        flagged = part.withColumn("flagged", F.col("score") > F.lit(head.cutoff(alpha)))
        judged = flagged.join(ids, "event_id", "left_semi")
        counts = confusion_counts(judged, F.col("flagged"), ["head"])
        scored = flagged if scored is None else scored.unionByName(flagged)
        metrics = counts if metrics is None else metrics.unionByName(counts)
    return scored, objective_metrics(metrics)


def partition_counts(parts: DataFrame) -> DataFrame:
    return class_counts(parts, ["partition"])


__all__ = [
    "compare_runs", "evaluate_artifact", "evaluation_metrics", "evaluation_rows",
    "export_scored_history", "load_artifact", "partition_counts", "tail_cutoff", "train_experiment",
]
