"""Comparing hypothesis templates in one scan of the evaluation table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings import fixed_values as fixed
from tidings.functions.once import with_once
from tidings.functions.text import bind
from tidings.operators.labelling import (
    OverlapScorer,
    Scorer,
    fill,
    literal_strings,
    overlap_scorer,
)
from tidings.sources.labels import Label


def phrases_for(
    prompt_id: str, labels: list[Label], phrases: dict[str, str] | None = None
) -> list[str]:
    """What stands in for each label: its phrase for expanded templates, else the label itself."""
    known = fixed.EXPANDED_PHRASES if phrases is None else phrases
    if not prompt_id.endswith(fixed.EXPANDED_SUFFIX):
        return [label.label for label in labels]
    return [known.get(label.label, label.label) for label in labels]


def with_phrase(df: DataFrame, phrases: dict[str, str], label: str = "label") -> DataFrame:
    """Add ``phrase``, the label itself where it has none."""
    return df.withColumn("phrase", _lookup(F.col(label), list(phrases), list(phrases.values())))


def with_label(df: DataFrame, phrases: dict[str, str], phrase: str = "phrase") -> DataFrame:
    """Add ``label`` for a phrase, the phrase itself where no label has it."""
    return df.withColumn("label", _lookup(F.col(phrase), list(phrases.values()), list(phrases)))


def _lookup(value: Column, keys: list[str], values: list[str]) -> Column:
    if not keys:
        return value
    place = F.array_position(literal_strings(keys), value).cast("int")
    return F.coalesce(F.get(literal_strings(values), place - 1), value)


def best_label(logits: Column, labels: list[str]) -> Column:
    """Label with the highest logit, ties to the earlier one. Softmax keeps the order of logits, so
    it is skipped."""
    keyed = F.transform(logits, lambda x, i: F.struct(x.alias("x"), (-i).alias("i")))
    return F.get(literal_strings(labels), -F.array_max(keyed)["i"])


def predictions_by_template(
    df: DataFrame,
    labels: list[Label],
    templates: list[tuple[str, str]] | None = None,
    phrases: dict[str, str] | None = None,
    scorer: Scorer | None = None,
    premise: Column | None = None,
) -> DataFrame:
    """Add ``yhats``: the winning label under each template, in template order.

    A scorer that finds winners by itself is asked for them. To any other one all hypotheses of all
    templates go together, so it sees each text once; phrases are mapped back by their place in the
    vocabulary.
    """
    catalog = fixed.TEMPLATES if templates is None else templates
    names = [label.label for label in labels]
    groups = [fill(template, phrases_for(prompt_id, labels, phrases)) for prompt_id, template in catalog]
    text = F.col("x") if premise is None else premise
    scorer = scorer or overlap_scorer()
    if isinstance(scorer, OverlapScorer):
        places = scorer.winners(text, groups)
        return with_once(df, yhats=F.transform(places, lambda place: F.get(literal_strings(names), place)))
    logits = scorer(text, [text for group in groups for text in group])
    width = len(names)
    starts = F.array(*(F.lit(place * width + 1) for place in range(len(catalog))))
    best = bind(
        logits,
        lambda xs: F.transform(
            starts, lambda start: best_label(F.slice(xs, start, F.lit(width)), names)
        ),
    )
    return with_once(df, yhats=best)


def ablate(
    pairs: DataFrame,
    labels: list[Label],
    templates: list[tuple[str, str]] | None = None,
    phrases: dict[str, str] | None = None,
    scorer: Scorer | None = None,
) -> DataFrame:
    """Accuracy of every template, best first.

    Each row adds one hit or miss per template to one aggregate, so rows are neither multiplied nor
    shuffled.
    """
    catalog = fixed.TEMPLATES if templates is None else templates
    judged = predictions_by_template(pairs, labels, catalog, phrases, scorer)
    counted = judged.agg(
        *(
            F.count_if(F.get("yhats", F.lit(place)) == F.col("y")).alias(f"hits{place}")
            for place in range(len(catalog))
        ),
        F.count(F.lit(1)).alias("total"),
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(prompt_id).alias("prompt_id"),
                F.lit(template).alias("template"),
                F.round(F.try_divide(f"hits{place}", "total"), 4).alias("accuracy"),
            )
            for place, (prompt_id, template) in enumerate(catalog)
        )
    )
    return counted.select(F.inline(rows)).orderBy(F.desc("accuracy"), "prompt_id")


def best_template(ablation: DataFrame) -> DataFrame:
    """The template with the highest accuracy, ties to the lower id."""
    return ablation.orderBy(F.desc("accuracy"), "prompt_id").limit(1)


def ablation_deltas(ablation: DataFrame, baseline_id: str) -> DataFrame:
    """Gain of each template over a baseline, absolute and relative, and the best-worst spread."""
    # One row per template, so a window over all of them is small.
    every = Window.partitionBy(F.lit(0))
    base = F.max(F.when(F.col("prompt_id") == baseline_id, F.col("accuracy"))).over(every)
    gain = F.col("accuracy") - base
    return ablation.select(
        "prompt_id",
        "accuracy",
        F.round(gain, 4).alias("gain"),
        F.round(F.try_divide(gain, base), 4).alias("relative_gain"),
        F.round(F.max("accuracy").over(every) - F.min("accuracy").over(every), 4).alias("spread"),
    )
