"""Scoring articles against a label vocabulary.

Labels and templates are values in the plan, all of them one literal however many there are: rows
stay one per article, and softmax and arg-max need no shuffle.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidings import fixed_values as fixed
from tidings.functions import text as T
from tidings.functions.once import with_once
from tidings.functions.text import bind
from tidings.operators.articles import recency
from tidings.operators.positions import with_position
from tidings.sources.labels import Label, label_table

# A scorer takes the premise and the hypotheses and gives one logit per hypothesis.
Scorer = Callable[[Column, list[str]], Column]


def literal_json(values: list, kind: str) -> Column:
    """Values as one literal, which the optimizer folds to a single value."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def literal_strings(values: list[str]) -> Column:
    return literal_json(values, "array<string>")


def literal_table(rows: list[tuple], fields: str) -> Column:
    """Rows as one literal array of structs."""
    names = [field.split()[0] for field in fields.split(", ")]
    kinds = ", ".join(field.replace(" ", ": ") for field in fields.split(", "))
    return literal_json([dict(zip(names, row, strict=True)) for row in rows], f"array<struct<{kinds}>>")


@lru_cache(maxsize=64)
def distinct_words(texts: tuple[str, ...]) -> str:
    """The distinct words of each text, as JSON. Spark splits them, as it does with premises."""
    words = F.transform(literal_strings(list(texts)), lambda text: F.array_distinct(T.tokens(text)))
    return SparkSession.active().range(1).select(F.to_json(words)).first()[0]


def overlap_shares(premise: Column, hypotheses: list[str]) -> Column:
    """Share of each hypothesis's distinct words found in the premise.

    The premise is reduced to words that occur in some hypothesis first, so a long text is searched
    once and not once per hypothesis. Words that all hypotheses share are looked for once as well.
    """
    words = json.loads(distinct_words(tuple(hypotheses)))
    frame = set(words[0]).intersection(*words) if words else set()
    entries = [{"size": len(one), "words": [word for word in one if word not in frame]} for one in words]
    known = sorted({word for one in words for word in one})
    own = literal_json(entries, "array<struct<size: int, words: array<string>>>")

    def shares(found: Column, shared: Column) -> Column:
        return F.transform(
            own, lambda one: (shared + F.size(F.array_intersect(one["words"], found))) / one["size"]
        )

    found = F.array_intersect(T.word_pieces(premise), literal_strings(known))
    return bind(
        found,
        lambda have: bind(
            F.size(F.array_intersect(literal_strings(sorted(frame)), have)), lambda shared: shares(have, shared)
        ),
    )


class OverlapScorer:
    """Deterministic scorer that needs no model: ``scale`` times the share of words found."""

    def __init__(self, scale: float = 10.0):
        self.scale = scale

    def __call__(self, premise: Column, hypotheses: list[str]) -> Column:
        return F.transform(overlap_shares(premise, hypotheses), lambda share: share * self.scale)

    def winners(self, premise: Column, groups: list[list[str]]) -> Column:
        """The place of the best hypothesis in each group, ties to the earlier one, without a score for
        every hypothesis.

        The words that all hypotheses of a group share are its frame; what is left of each is its own.
        Groups that differ in their frames alone, as templates over one vocabulary do, share an index
        of own words. In it, of all hypotheses with the same number of own words only the one with
        most of them found can win, whatever the frame. So a text meets each entry of an index once,
        and each group compares one candidate for every number of own words.
        """
        every = [text for group in groups for text in group]
        said = iter(json.loads(distinct_words(tuple(every))))
        frames, indexes, place_of = [], [], {}
        for group in groups:
            words = [next(said) for _ in group]
            frame = set(words[0]).intersection(*words)
            own = tuple(tuple(word for word in one if word not in frame) for one in words)
            if own not in place_of:
                place_of[own] = len(indexes)
                indexes.append(own)
            frames.append({"index": place_of[own], "size": len(frame), "words": sorted(frame)})
        own_words = sorted({word for own in indexes for words in own for word in words})
        numbers = {word: number for number, word in enumerate(own_words)}
        indexed = literal_json(
            [_by_size(own, numbers) for own in indexes],
            "array<array<struct<size: int, entries: array<struct<turn: int, words: array<int>>>>>>",
        )
        framed = literal_json(frames, "array<struct<index: int, size: int, words: array<string>>>")
        known = sorted({*own_words, *(word for one in frames for word in one["words"])})
        found = F.array_intersect(T.word_pieces(premise), literal_strings(known))

        def places(have: Column) -> Column:
            held = F.transform(literal_strings(own_words), lambda word: F.array_contains(have, word).cast("int"))
            return bind(
                bind(held, lambda hits: _candidates(indexed, hits)), lambda best: _best_of(framed, best, have)
            )

        return bind(found, places)


def _by_size(own: tuple[tuple[str, ...], ...], numbers: dict[str, int]) -> list[dict]:
    """The entries of an index by their number of words, words by number; ``turn`` falls along the group."""
    by_size: dict[int, list[dict]] = {}
    for place, words in enumerate(own):
        entry = {"turn": -place, "words": [numbers[word] for word in words]}
        by_size.setdefault(len(words), []).append(entry)
    return [{"size": size, "entries": entries} for size, entries in sorted(by_size.items())]


def _candidates(indexes: Column, held: Column) -> Column:
    """For every index and number of own words the entry with most of them; ``held`` has 1 for each word
    that the text holds."""

    def hits(words: Column) -> Column:
        return F.aggregate(words, F.lit(0), lambda total, word: total + F.get(held, word))

    def best(one: Column) -> Column:
        scored = F.transform(
            one["entries"], lambda entry: F.struct(hits(entry["words"]).alias("hits"), entry["turn"].alias("turn"))
        )
        return bind(
            F.array_max(scored),
            lambda top: F.struct(one["size"].alias("size"), top["hits"].alias("hits"), top["turn"].alias("turn")),
        )

    return F.transform(indexes, lambda index: F.transform(index, best))


def _best_of(frames: Column, candidates: Column, found: Column) -> Column:
    """The place of each group's winner."""

    def place(frame: Column, hits: Column) -> Column:
        shares = F.transform(
            F.get(candidates, frame["index"]),
            lambda one: F.struct(
                F.try_divide(hits + one["hits"], frame["size"] + one["size"]).alias("share"), one["turn"].alias("turn")
            ),
        )
        return -F.array_max(shares)["turn"]

    return F.transform(
        frames, lambda frame: bind(F.size(F.array_intersect(frame["words"], found)), lambda hits: place(frame, hits))
    )


def overlap_scorer(scale: float = 10.0) -> OverlapScorer:
    return OverlapScorer(scale)


# Models of this worker process, by a digest of the function that loads them.
MODELS: dict[str, Callable] = {}


def loaded(key: str, load: Callable[[], Callable]) -> Callable:
    """The model that ``load`` gives, loaded once per worker process."""
    if key not in MODELS:
        MODELS[key] = load()
    return MODELS[key]


# Characters that a model is given at once, each text counted as long as the longest one with it, and
# how much longer than the shortest one that may be.
MODEL_CHARS, MOST_LONGER = 1 << 16, 1.15


def by_length(texts: list[str], most: int) -> Iterator[list[int]]:
    """Places of the texts in batches of similar length: their number times the longest of them is
    ``most`` at most; a longer text is a batch by itself."""
    batch: list[int] = []
    for place in sorted(range(len(texts)), key=lambda place: len(texts[place] or "")):
        size = len(texts[place] or "")
        if batch and ((len(batch) + 1) * size > most or size > MOST_LONGER * len(texts[batch[0]] or "") + 1):
            yield batch
            batch = []
        batch.append(place)
    if batch:
        yield batch


def pandas_scorer(
    load: Callable[[], Callable[[list[str], list[str]], np.ndarray]], most: int = MODEL_CHARS
) -> Scorer:
    """Scorer around a model. ``load`` runs once per worker process and returns a function from
    premises and hypotheses to a matrix of logits, one row per premise.

    Models pad the texts of a batch to the longest one, so texts of similar length go together, no
    more than ``most`` characters at once.
    """
    key = hashlib.sha256(cloudpickle.dumps(load)).hexdigest()

    def score(premise: Column, hypotheses: list[str]) -> Column:
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = loaded(key, load)
            for batch in batches:
                texts, logits = batch.tolist(), [None] * len(batch)
                for places in by_length(texts, most):
                    found = model([texts[place] for place in places], hypotheses)
                    for place, row in zip(places, found, strict=True):
                        logits[place] = row
                yield pd.Series(logits, index=batch.index)

        # Type hints of a nested function are text here, so they are given as objects.
        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, ArrayType(DoubleType()))(premise)

    return score


def softmax(logits: Column) -> Column:
    shifted = bind(
        logits,
        lambda xs: bind(F.array_max(xs), lambda top: F.transform(xs, lambda x: F.exp(x - top))),
    )
    return bind(
        shifted,
        lambda es: bind(
            F.aggregate(es, F.lit(0.0), lambda a, e: a + e),
            lambda total: F.transform(es, lambda e: e / total),
        ),
    )


def ranked_labels(probabilities: Column, labels: list[str]) -> Column:
    """Labels with their scores, best first, ties in vocabulary order."""
    scored = F.transform(
        probabilities,
        lambda p, i: F.struct(
            (-p).alias("key"), i.alias("rank"), F.get(literal_strings(labels), i).alias("label")
        ),
    )
    return F.transform(
        F.array_sort(scored),
        lambda s: F.struct(s["label"].alias("label"), (-s["key"]).alias("score")),
    )


def fill(template: str, labels: list[str]) -> list[str]:
    return [template.replace("{}", label) for label in labels]


def article_premise() -> Column:
    return T.premise(F.col("title"), F.col("description"))


def score_labels(
    df: DataFrame,
    labels: list[Label],
    template: str = fixed.ARTICLE_TEMPLATE,
    scorer: Scorer | None = None,
    premise: Column | None = None,
) -> DataFrame:
    """Add ``scores``: every label with its probability, best first."""
    names = [label.label for label in labels]
    text = article_premise() if premise is None else premise
    logits = (scorer or overlap_scorer())(text, fill(template, names))
    return with_once(df, scores=ranked_labels(softmax(logits), names))


def map_display(df: DataFrame, labels: list[Label]) -> DataFrame:
    """Add ``category``, the display name of ``raw_category``; "Unknown" outside the vocabulary."""
    names = literal_strings([label.label for label in labels])
    shown = literal_strings([label.display for label in labels])
    # Of equal labels the last display name counts.
    place = F.size(names) - F.array_position(F.reverse(names), F.col("raw_category"))
    known = F.array_contains(names, F.col("raw_category"))
    return df.withColumn(
        "category",
        F.coalesce(F.when(known, F.get(shown, place.cast("int"))), F.lit(fixed.UNKNOWN)),
    )


def classify(
    df: DataFrame,
    labels: list[Label],
    template: str = fixed.ARTICLE_TEMPLATE,
    scorer: Scorer | None = None,
    premise: Column | None = None,
) -> DataFrame:
    """Add ``scores``, ``raw_category``, ``confidence`` and ``category``. Some label always wins."""
    best = F.get("scores", F.lit(0))
    scored = score_labels(df, labels, template, scorer, premise)
    return map_display(
        scored.withColumn("raw_category", best["label"]).withColumn("confidence", best["score"]),
        labels,
    )


def hypotheses(
    df: DataFrame, labels: list[Label], templates: list[tuple[str, str]]
) -> DataFrame:
    """One row per article, template and label, with premise and hypothesis.

    All pairs are one literal, however many there are, so the plan stays small.
    """
    pairs = literal_table(
        [
            (prompt_id, rank, label.label, template.replace("{}", label.label))
            for prompt_id, template in templates
            for rank, label in enumerate(labels)
        ],
        "prompt_id string, label_rank int, label string, hypothesis string",
    )
    # Two steps: the premise is built per article, not per hypothesis.
    texts = df.select("article_id", article_premise().alias("premise"))
    return texts.select("*", F.inline(pairs))


def attach_predictions(articles: DataFrame, predictions: DataFrame) -> DataFrame:
    """Add predictions to their articles; both sides hold one row per ``article_id``."""
    return articles.join(predictions, "article_id")


def category_counts(tagged: DataFrame, labels: list[Label]) -> DataFrame:
    """Articles per category. Every label shows up, if only with 0; other categories follow."""
    known = (
        label_table(tagged.sparkSession, labels)
        .groupBy(F.col("display").alias("category"))
        .agg(F.min("label_rank").alias("label_rank"))
    )
    counted = tagged.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return known.join(counted, "category", "full").select(
        "category",
        F.col("label_rank").isNotNull().alias("in_tabs"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def category_buckets(tagged: DataFrame) -> DataFrame:
    """Position of each article inside its category, newest first."""
    narrow = tagged.select("article_id", "category", "published_ts", "feed_rank", "entry_index")
    return with_position(narrow, ["category"], recency()).select(
        "category", "position", "article_id"
    )
