"""Classification metrics over predictions (``y``, ``yhat``, ``confidence``).

All of them start from one count per (y, yhat), which Spark combines before its only shuffle, so a
class holding most rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings import fixed_values as fixed
from tidings.operators.corpus import label_is_known
from tidings.sources.labels import Label, label_table

NORMAL_95 = 1.96


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def pair_counts(preds: DataFrame) -> DataFrame:
    return preds.groupBy("y", "yhat").agg(F.count(F.lit(1)).alias("n"))


def confusion(preds: DataFrame, labels: list[Label]) -> DataFrame:
    """Count for every pair of labels, zeros included; rows with another label are left out."""
    names = label_table(preds.sparkSession, labels).select("label")
    axis = F.array(*(F.lit(label.label) for label in labels))
    cells = names.select(F.col("label").alias("y"), F.explode(axis).alias("yhat"))
    return cells.join(pair_counts(preds), ["y", "yhat"], "left").select(
        "y", "yhat", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def confusion_wide(preds: DataFrame, labels: list[Label]) -> DataFrame:
    """The same as a matrix, one row per true label and one column per predicted label."""
    names = [label.label for label in labels]
    return confusion(preds, labels).groupBy("y").pivot("yhat", names).agg(F.sum("n"))


def confusion_check(preds: DataFrame, labels: list[Label]) -> DataFrame:
    """Rows inside the matrix, all rows, and the difference."""
    inside = F.count_if(label_is_known("y", labels) & label_is_known("yhat", labels))
    total = F.count(F.lit(1))
    return preds.agg(
        inside.alias("matrix_total"), total.alias("n_rows"), (total - inside).alias("diff")
    )


def class_counts(preds: DataFrame) -> DataFrame:
    """Hits, predictions and support of every class that is true or predicted somewhere."""
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("y").alias("label"),
            F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(zero).alias("hits"),
            zero.alias("predicted"),
            F.col("n").alias("support"),
        ),
        F.struct(
            F.col("yhat").alias("label"),
            zero.alias("hits"),
            F.col("n").alias("predicted"),
            zero.alias("support"),
        ),
    )
    return (
        pair_counts(preds)
        .select(F.inline(sides))
        .groupBy("label")
        .agg(*(F.sum(name).alias(name) for name in ("hits", "predicted", "support")))
    )


def _scores(counts: DataFrame) -> DataFrame:
    precision = _ratio(F.col("hits"), F.col("predicted"))
    recall = _ratio(F.col("hits"), F.col("support"))
    f1 = _ratio(2 * F.col("hits"), F.col("predicted") + F.col("support"))
    return counts.select(
        "label",
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        "support",
        "hits",
    )


def class_report(preds: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where a ratio has no denominator."""
    return _scores(class_counts(preds)).select(
        "label",
        *(F.round(name, 4).alias(name) for name in ("precision", "recall", "f1")),
        "support",
    )


def report_averages(preds: DataFrame) -> DataFrame:
    """Accuracy, macro average and average weighted by support."""
    total = F.sum("support")
    measures = ("precision", "recall", "f1")

    def row(name: str, values: list[Column]) -> Column:
        named = [F.round(v, 4).alias(m) for v, m in zip(values, measures)]
        return F.struct(F.lit(name).alias("average"), *named, F.col("support"))

    summed = _scores(class_counts(preds)).agg(
        *(F.avg(m).alias(f"macro_{m}") for m in measures),
        *(_ratio(F.sum(F.col(m) * F.col("support")), total).alias(f"weighted_{m}") for m in measures),
        _ratio(F.sum("hits"), total).alias("accuracy"),
        F.coalesce(total, F.lit(0)).alias("support"),
    )
    rows = F.array(
        row("accuracy", [F.col("accuracy")] * 3),
        row("macro", [F.coalesce(f"macro_{m}", F.lit(0.0)) for m in measures]),
        row("weighted", [F.col(f"weighted_{m}") for m in measures]),
    )
    return summed.select(F.inline(rows))


def top_confusions(preds: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent mistakes, ties by label."""
    wrong = pair_counts(preds.where("y <> yhat"))
    return wrong.orderBy(F.desc("n"), "y", "yhat").limit(n)


def accuracy_interval(preds: DataFrame) -> DataFrame:
    """Accuracy with the half-width of its 95% interval."""
    hits, total = F.count_if(F.col("y") == F.col("yhat")), F.count(F.lit(1))
    counted = preds.agg(hits.alias("hits"), total.alias("n"))
    p = F.try_divide("hits", "n")
    half = NORMAL_95 * F.sqrt(F.try_divide(p * (1 - p), F.col("n")))
    return counted.select("n", F.round(p, 4).alias("accuracy"), F.round(half, 6).alias("half_width"))


def triage(preds: DataFrame, threshold: float = fixed.LOW_CONFIDENCE) -> DataFrame:
    """Error rate below and from the confidence threshold up."""
    low = F.col("confidence") < threshold
    errors = F.count_if(F.col("y") != F.col("yhat"))
    return preds.groupBy(low.alias("low_confidence")).agg(
        F.count(F.lit(1)).alias("n"),
        errors.alias("errors"),
        F.round(errors / F.count(F.lit(1)), 4).alias("error_rate"),
    )


def summary_compliance(summaries: DataFrame) -> DataFrame:
    """Share of summaries with exactly three lines of at most 22 words."""
    lines = F.split("summary", "\n")
    short = F.forall(
        lines,
        lambda line: F.size(F.filter(F.split(line, f"{fixed.SPACE}+"), lambda word: word != ""))
        <= fixed.SUMMARY_WORDS,
    )
    fits = (F.size(lines) == fixed.SUMMARY_LINES) & short
    fitting, total = F.count_if(fits), F.count(F.lit(1))
    return summaries.agg(
        fitting.alias("compliant"),
        total.alias("n"),
        F.round(F.try_divide(fitting, total), 4).alias("rate"),
    )
