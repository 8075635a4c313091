"""Labelled headlines to metrics and a template comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings import fixed_values as fixed
from tidings.operators.ablation import ablate
from tidings.operators.corpus import prepare_eval
from tidings.operators.labelling import Scorer, classify
from tidings.operators.metrics import class_report, confusion, report_averages
from tidings.session import pin
from tidings.sources.labels import Label
from tidings.sources.tables import resolve_columns

HEADLINE_TEMPLATE = dict(fixed.TEMPLATES)["P2_baseline_headline"]


def eval_pairs(table: DataFrame, labels: list[Label]) -> DataFrame:
    """Text and true label of a table with any accepted column names."""
    found = resolve_columns(table, fixed.EVAL_COLUMNS, ("text", "label"), case_sensitive=True)
    return prepare_eval(found, labels)


def predict(
    pairs: DataFrame,
    labels: list[Label],
    template: str = HEADLINE_TEMPLATE,
    scorer: Scorer | None = None,
) -> DataFrame:
    """Add ``yhat`` and ``confidence``; the text alone is scored."""
    scored = classify(pairs, labels, template, scorer, premise=F.col("x"))
    return scored.select(*pairs.columns, F.col("raw_category").alias("yhat"), "confidence")


def evaluate(
    pairs: DataFrame, labels: list[Label], scorer: Scorer | None = None
) -> dict[str, DataFrame]:
    """Class report, averages, confusion matrix and ablation of a corpus.

    Predictions are written once, without the texts, and shared by the metrics.
    """
    scored = predict(pairs, labels, scorer=scorer)
    preds = pin(scored.select("y", "yhat", "confidence"), "predictions")
    return {
        "class_report": class_report(preds),
        "averages": report_averages(preds),
        "confusion": confusion(preds, labels),
        "ablation": ablate(pairs, labels, scorer=scorer),
    }
