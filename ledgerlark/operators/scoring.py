"""Score transforms (heads), logistic models and their columns."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.scalars import sigmoid, softplus
from ledgerlark.operators.metrics import class_weight, fit_standardizer
from ledgerlark.plans.prefix import bucketed_prefix, measure_cuts, with_scalars
from ledgerlark.session import cut_lineage, written

# Fixed value: the smallest positive double.
SMALLEST = 5e-324


@dataclass(frozen=True)
class LogisticModel:
    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float

    def margin(self) -> Column:
        total = F.lit(self.bias)
        for name, mean, scale, weight in zip(self.features, self.mean, self.scale, self.weights):
            total = total + (F.col(name) - F.lit(mean)) / F.lit(scale) * F.lit(weight)
        return total

    def to_json(self) -> str:
        return json.dumps({"version": 1, **asdict(self)})

    @staticmethod
    def from_json(text: str, features: Sequence[str] | None = None) -> "LogisticModel":
        raw = json.loads(text)
        if raw.pop("version", None) != 1 or (features is not None and list(features) != raw["features"]):
            raise ValueError("incompatible model state")
        numbers = [*raw["mean"], *raw["scale"], *raw["weights"], raw["bias"]]
        if not all(math.isfinite(v) for v in numbers) or min(raw["scale"]) <= 0:
            raise ValueError("invalid model parameters")
        return LogisticModel(
            tuple(raw["features"]), tuple(raw["mean"]), tuple(raw["scale"]), tuple(raw["weights"]), raw["bias"]
        )


def fit_logistic(
    train: DataFrame,
    features: Sequence[str],
    label: str = "label",
    c: float = 1.0,
    balanced: bool = False,
    max_iter: int = 500,
) -> LogisticModel:
    """Standardise on the known training rows, then L2 logistic regression with a free intercept."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from ledgerlark.operators.metrics import standardize

    known = train.filter(F.col(label) >= 0)
    fitted = fit_standardizer(known, features).collect()  # one row per feature
    frame = train.sparkSession.createDataFrame(fitted)
    rows = standardize(known, frame, features).withColumn(label, F.col(label).cast("double"))
    weight = class_weight(known, None, label).first()["weight"] if balanced else 1.0
    rows = rows.withColumn("__w", F.when(F.col(label) == 1, float(weight)).otherwise(1.0))
    total = rows.agg(F.sum("__w").alias("w")).first()["w"]
    vectors = VectorAssembler(inputCols=list(features), outputCol="__x").transform(rows)
    model = LogisticRegression(
        featuresCol="__x", labelCol=label, weightCol="__w", regParam=1.0 / (c * total), elasticNetParam=0.0,
        standardization=False, maxIter=max_iter, tol=1e-10,
    ).fit(vectors)
    by_name = {r["feature"]: r for r in fitted}
    return LogisticModel(
        tuple(features),
        tuple(by_name[f]["mean"] for f in features),
        tuple(by_name[f]["scale"] for f in features),
        tuple(float(v) for v in model.coefficients),
        float(model.intercept),
    )


def logistic_gradient(
    train: DataFrame, model: LogisticModel, label: str = "label", c: float = 1.0, balanced: bool = False
) -> DataFrame:
    """Certificate of a fit: (feature, mean, scale, gradient), one row per feature and one for the intercept.

    ``gradient`` is that of the mean weighted loss plus penalty at the model's weights. The objective is strictly
    convex, so it vanishes at the fitted optimum and nowhere else. One grouped pass over the known rows.
    """
    known = train.filter(F.col(label) >= 0)
    size = class_weight(known, None, label).select(F.col("weight").alias("__fraud"))
    weight = F.when(F.col(label) == 1, F.col("__fraud") if balanced else F.lit(1.0)).otherwise(1.0)
    error = F.col("__w") * (sigmoid(model.margin(), 700.0) - F.col(label))
    rows = with_scalars(known, size).withColumn("__w", weight).withColumn("__e", error)
    parts = [*zip(model.features, model.mean, model.scale, model.weights), ("intercept", 0.0, 1.0, 0.0)]
    sums = rows.agg(
        F.sum("__w").alias("__n"),
        *[
            F.sum(F.col("__e") * (F.lit(1.0) if f == "intercept" else (F.col(f) - F.lit(m)) / F.lit(s))).alias(f"g_{f}")
            for f, m, s, _ in parts
        ],
    )
    entries = [
        F.struct(
            F.lit(f).alias("feature"), F.lit(m).alias("mean"), F.lit(s).alias("scale"),
            ((F.col(f"g_{f}") + F.lit(w / c)) / F.col("__n")).alias("gradient"),
        )
        for f, m, s, w in parts
    ]
    return sums.select(F.inline(F.array(*entries)))


def score_logistic(df: DataFrame, model: LogisticModel) -> DataFrame:
    """Add ``margin`` and ``probability``."""
    return df.withColumn("margin", model.margin()).withColumn(
        "probability", sigmoid(F.col("margin"), 50.0)
    )


def empirical_tail_score(reference: DataFrame, queries: DataFrame, logit: str = "logit") -> DataFrame:
    """p = (1 + number of reference logits <= the query) / (1 + n), score = -log2 p."""
    ref = reference.groupBy(logit).agg(F.count(F.lit(1)).alias("__r"))
    asked = queries.select(logit).distinct().withColumn("__r", F.lit(0).cast("bigint"))
    values = ref.unionByName(asked).groupBy(logit).agg(F.sum("__r").alias("__r"))
    placed = bucketed_prefix(values, [logit], {"__below": F.col("__r")}, cuts=measure_cuts(queries, logit))
    ranks = placed.select(logit, (F.col("__below") + F.col("__r")).alias("__rank"))
    size = reference.agg(F.count(F.lit(1)).alias("__n"))
    tail = (F.col("__rank") + 1) / (F.col("__n") + 1)
    joined = with_scalars(queries.join(ranks, logit), size).withColumn("tail_probability", tail)
    return joined.withColumn("score", -F.log2("tail_probability")).drop("__rank", "__n")


def fixed_likelihood_score(logit: Column) -> tuple[Column, Column]:
    """(tail probability, bits): the logistic function, floored at the smallest positive double."""
    tail = F.greatest(sigmoid(logit), F.lit(SMALLEST))
    return tail, -F.log2(tail)


def fraud_bits(logit: Column) -> tuple[Column, Column]:
    """(fraud probability, bits of surprise)."""
    return sigmoid(logit), softplus(logit) / F.lit(math.log(2))


def tail_cutoff(alpha: float) -> float:
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie strictly between zero and one")
    return -math.log2(alpha)


def probability_cutoff(bits: float) -> float:
    """Fraud probability that corresponds to a cutoff in bits."""
    return -math.expm1(-max(0.0, bits) * math.log(2))


def probability_bits(probability: Column) -> Column:
    return -F.log2(F.greatest(F.lit(1e-12), F.lit(1.0) - probability))


@dataclass(frozen=True)
class Head:
    """Turns logits into a score. ``fit`` may look at reference logits, ``score`` adds ``score``."""

    id: str
    score: Callable[[DataFrame, DataFrame | None], DataFrame]
    cutoff: Callable[[float], float] = tail_cutoff


HEADS: dict[str, Head] = {}


def register_head(head: Head) -> Head:
    if head.id in HEADS:
        raise ValueError(f"head already registered: {head.id}")
    HEADS[head.id] = head
    return head


def _fixed(queries: DataFrame, reference: DataFrame | None) -> DataFrame:
    tail, bits = fixed_likelihood_score(F.col("logit"))
    return queries.withColumns({"tail_probability": tail, "score": bits})


def _fraud(queries: DataFrame, reference: DataFrame | None) -> DataFrame:
    probability, bits = fraud_bits(F.col("logit"))
    return queries.withColumns({"fraud_probability": probability, "score": bits})


register_head(Head("empirical_tail", lambda q, ref: empirical_tail_score(ref, q)))
register_head(Head("fixed_likelihood", _fixed))
register_head(Head("fraud_linear", _fraud))


@dataclass(frozen=True)
class Scorer:
    """A model by name: ``fit(train, features) -> state`` and ``predict(df, state) -> df`` with
    ``probability`` (and optionally ``margin``)."""

    id: str
    fit: Callable
    predict: Callable


SCORERS: dict[str, Scorer] = {}


def register_scorer(scorer: Scorer) -> Scorer:
    if scorer.id in SCORERS:
        raise ValueError(f"scorer already registered: {scorer.id}")
    SCORERS[scorer.id] = scorer
    return scorer


def arrow_scorer(
    id: str, fit: Callable[[DataFrame, Sequence[str]], dict], score: Callable[[dict, pd.DataFrame], pd.Series]
) -> Scorer:
    """A scorer whose ``score(state, features)`` runs on Arrow batches in the executors.

    ``fit`` returns the numbers that the model consists of. They are frozen as text together with the names of the features,
    so an artifact can store them, and are read once per Python worker; probabilities outside 0 to 1 are refused.
    """

    def freeze(train: DataFrame, features: Sequence[str]) -> str:
        return json.dumps({"scorer": id, "features": list(features), "state": fit(train, features)}, sort_keys=True)

    def predict(df: DataFrame, text: str) -> DataFrame:
        frozen = json.loads(text)
        if frozen.get("scorer") != id:
            raise ValueError(f"state of another scorer: {frozen.get('scorer')}")
        names, state = frozen["features"], frozen["state"]

        def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for part in parts:
                part.columns = names
                found = pd.Series(score(state, part), dtype="float64")
                if not found.dropna().between(0.0, 1.0).all():
                    raise ValueError(f"{id}: probabilities must lie between zero and one")
                yield found

        taken = F.struct(*[F.col(f).cast("double").alias(f) for f in names])
        return df.withColumn("probability", F.pandas_udf(batches, "double")(taken))

    return register_scorer(Scorer(id, freeze, predict))


def arrow_head(
    id: str, fit: Callable[[DataFrame], dict], score: Callable[[dict, pd.Series], pd.Series], cutoff: Callable[[float], float] = tail_cutoff
) -> Head:
    """A head whose ``score(state, logits)`` runs on Arrow batches; ``fit`` sees the reference logits and returns numbers."""

    def apply(queries: DataFrame, reference: DataFrame | None) -> DataFrame:
        if reference is None:
            raise ValueError(f"{id} needs reference logits")
        state = json.loads(json.dumps(fit(reference)))

        def batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series(score(state, part), dtype="float64")

        return queries.withColumn("score", F.pandas_udf(batches, "double")(F.col("logit").cast("double")))

    return register_head(Head(id, apply, cutoff))


def history_rows(payments: DataFrame, outcomes: DataFrame, names: Sequence[str]) -> DataFrame:
    """What the history head sees: features, ``bits`` and label per payment, written once as fitting reads them several times.

    The payments are written as well: features and surprise read them in some ten places, each of which would repeat the
    joins behind them.
    """
    from ledgerlark.operators.features import payment_features
    from ledgerlark.operators.histories import surprise_bits

    payments, outcomes = written(payments), written(outcomes.select("event_id", "label"))
    return cut_lineage(
        payment_features(payments, names)
        .join(surprise_bits(payments).select("event_id", "bits"), "event_id")
        .join(outcomes.select("event_id", "label"), "event_id")
    )


def fit_history_head(payments: DataFrame, outcomes: DataFrame, names: Sequence[str]) -> tuple[LogisticModel, DataFrame]:
    """Class-weighted logistic head over history features and the surprise of amount and gap."""
    rows = history_rows(payments, outcomes, names)
    model = fit_logistic(rows, [*names, "bits"], balanced=True)
    return model, score_logistic(rows, model)
