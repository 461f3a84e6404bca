"""Export of scored rows with explanations as CSV or JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Leading columns of the prediction export.
EXPORT_HEADER = [
    "event_id", "time_minutes", "sender", "recipient", "amount_eur", "probability", "score_bits",
    "threshold_bits", "decision", "settled", "outcome", "raw_margin", "baseline",
]


def formula_guard(text: Column) -> Column:
    """A text that a spreadsheet would run as a formula gets a leading apostrophe."""
    return F.when(text.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def prediction_export(records: DataFrame, features: Sequence[str]) -> DataFrame:
    """Header columns, then one value, one input and one contribution column per feature.

    ``values``, ``inputs`` and ``contributions`` are arrays in feature order.
    """
    texts = {f.name for f in records.schema.fields if f.dataType.simpleString() == "string"}
    head = [
        (formula_guard(F.col(c)) if c in texts else F.col(c)).alias(c) for c in EXPORT_HEADER
    ]
    spread = [
        F.element_at(array, i + 1).alias(f"{name}_{suffix}")
        for array, suffix in (("values", "value"), ("inputs", "input"), ("contributions", "shap"))
        for i, name in enumerate(features)
    ]
    return records.select(*head, *spread)


def export_predictions_csv(records: DataFrame, features: Sequence[str], path: str) -> None:
    (
        prediction_export(records, features)
        .write.mode("errorifexists")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def export_predictions_json(records: DataFrame, path: str) -> None:
    records.write.mode("errorifexists").json(path)
