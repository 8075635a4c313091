import math
import os
import random
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidings.operators import labelling as L
from tidings.operators.ablation import ablate, predictions_by_template
from tidings.sources.labels import Label, read_labels

LABELS = [Label("sport", "Sport"), Label("market", "Money"), Label("film", "Film")]
TEMPLATE = "This is about {}."


@pytest.fixture(scope="module")
def articles(spark):
    rows = [
        ("a", "Market day", "a market is open", 0, 0, 1),
        ("b", "Nothing", "", 0, 1, 2),
        ("c", "Film about sport", None, 0, 2, None),
    ]
    fields = "article_id string, title string, description string, feed_rank int, "
    fields += "entry_index bigint, day int"
    frame = spark.createDataFrame(rows, fields)
    return frame.withColumn("published_ts", F.make_timestamp(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0)))


def test_scores_are_probabilities_with_stable_ties(articles):
    rows = {r["article_id"]: r for r in L.classify(articles, LABELS, TEMPLATE).collect()}
    for row in rows.values():
        assert math.isclose(sum(s["score"] for s in row["scores"]), 1.0)
        assert row["confidence"] == max(s["score"] for s in row["scores"])
    assert rows["a"]["raw_category"] == "market" and rows["a"]["category"] == "Money"
    assert [s["label"] for s in rows["b"]["scores"]] == ["sport", "market", "film"]
    assert rows["c"]["raw_category"] == "sport"


def test_softmax_survives_large_logits(spark):
    row = spark.range(1).select(L.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("p")).first()
    assert list(row["p"]) == [0.5, 0.5]


def test_wide_form_equals_long_form(articles):
    """Scoring each pair on its own row gives the same winner."""
    pairs = L.hypotheses(articles, LABELS, [("t", TEMPLATE)])
    assert pairs.count() == 9
    words = lambda c: F.array_distinct(F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), ""))
    share = F.size(F.array_intersect(words(F.col("hypothesis")), words(F.col("premise")))) / F.size(
        words(F.col("hypothesis"))
    )
    best = pairs.withColumn("share", share).groupBy("article_id").agg(
        F.min_by("label", F.struct(-F.col("share"), "label_rank")).alias("label")
    )
    wide = L.classify(articles, LABELS, TEMPLATE).select("article_id", "raw_category")
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, wide.collect()))


def test_scoring_needs_no_shuffle_and_runs_once(articles):
    found = L.classify(articles, LABELS, TEMPLATE).where("category = 'Film' AND confidence > 0.2")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("EXP(") == 1


def test_model_scorer_is_loaded_once_per_worker(articles, tmp_path):
    def load():
        (tmp_path / f"{os.getpid()}-{uuid.uuid4()}").touch()

        def run(premises, hypotheses):
            return np.array([[float(h.split()[-1].strip(".") in p.lower()) for h in hypotheses] for p in premises])

        return run

    tagged = L.classify(articles, LABELS, TEMPLATE, L.pandas_scorer(load))
    assert {r["article_id"]: r["raw_category"] for r in tagged.collect()} == {
        "a": "market", "b": "sport", "c": "sport",
    }
    L.classify(articles.repartition(16), LABELS, TEMPLATE, L.pandas_scorer(load)).collect()
    workers = [path.name.split("-")[0] for path in tmp_path.iterdir()]
    assert len(workers) == len(set(workers)) > 0


def test_models_get_texts_of_similar_length(spark):
    """A model that tells how much it pads: under a tenth of what it reads."""
    rng = random.Random(6)
    lengths = [int(rng.lognormvariate(6, 1.5)) for _ in range(4000)] + [0, 200_000]
    texts = spark.createDataFrame([(place, "x" * size) for place, size in enumerate(lengths)], "id int, x string").repartition(4)

    def load():
        def run(premises, hypotheses):
            longest = max(map(len, premises))
            assert len(premises) == 1 or longest * len(premises) <= L.MODEL_CHARS
            return np.array([[longest - len(one), len(one)] for one in premises], float)

        return run

    scored = texts.select("id", L.pandas_scorer(load)(F.col("x"), ["padded", "read"]).alias("found")).collect()
    assert {row.id: row.found[1] for row in scored} == dict(enumerate(map(float, lengths)))
    assert sum(row.found[0] for row in scored) < 0.1 * sum(lengths)


def test_large_vocabularies_and_many_templates(spark, tmp_path):
    path = tmp_path / "labels.txt"
    path.write_text("\n".join(f"topic {place} kind{place}" for place in range(2500)))
    labels = read_labels(spark, str(path))
    assert len(labels) == 2500
    texts = spark.createDataFrame([("all of kind77 here", "topic 77 kind77"), ("kind2499", "x")], "x string, y string")
    wide = L.classify(texts, labels, "{}", premise=F.col("x"))
    assert [r.raw_category for r in wide.collect()] == ["topic 77 kind77", "topic 2499 kind2499"]
    few = labels[:300]
    templates = [(f"t{place:03}", f"number {place} {{}}") for place in range(120)]
    start = time.monotonic()
    found = ablate(texts, few, templates).collect()
    assert time.monotonic() - start < 30
    assert [(r.prompt_id, r.accuracy) for r in found] == [(name, 0.5) for name, _ in templates]


def test_winners_equal_all_scores(spark):
    """The index of own words finds what scoring every hypothesis finds, ties included."""
    rng = random.Random(5)
    words = [f"w{place}" for place in range(14)]
    some = lambda most: " ".join(rng.choice(words) for _ in range(rng.randint(1, most)))
    texts = spark.createDataFrame([(some(12),) for _ in range(200)] + [("",), (None,)], "x string")
    for _ in range(6):
        labels = [Label(f"{some(4)} l{place}", "") for place in range(9)]
        # Templates share words with labels, use phrases, hold nothing but the label, or hold it twice.
        templates = [("a", f"{some(3)} {{}}"), ("b_expanded", "{} w1 w2"), ("c", "{}"), ("d", "w3 {} {} w4"), ("e", "w5")]
        phrases = {labels[0].label: "w1 w2 w9", labels[3].label: "w7"}
        fast = predictions_by_template(texts, labels, templates, phrases).collect()
        plain = lambda premise, hypotheses: F.transform(L.overlap_shares(premise, hypotheses), lambda x: x * 10.0)
        slow = predictions_by_template(texts, labels, templates, phrases, scorer=plain).collect()
        assert fast == slow


def test_many_hypotheses_cost_little(spark):
    """120 templates of 300 labels next to 4 of 100 of the same kind."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.col("text").alias("x"), F.lit("").alias("y"))

    def seconds(n_labels, n_templates):
        labels = [Label(f"kind{place} of the {place % 7}", "") for place in range(n_labels)]
        templates = [(f"t{place:03}", f"number {place} in {{}}") for place in range(n_templates)]
        start = time.monotonic()
        ablate(docs, labels, templates).collect()
        return time.monotonic() - start

    seconds(100, 4)
    assert seconds(300, 120) < 2 * seconds(100, 4) + 3


def test_display_names(spark):
    frame = spark.createDataFrame([("sport",), ("other",), (None,)], "raw_category string")
    shown = [r["category"] for r in L.map_display(frame, LABELS).collect()]
    assert shown == ["Sport", "Unknown", "Unknown"]


def test_category_counts_keep_empty_and_unknown(spark):
    tagged = spark.createDataFrame([("Sport",), ("Sport",), ("Odd",)], "category string")
    got = {tuple(row) for row in L.category_counts(tagged, LABELS).collect()}
    assert got == {("Sport", True, 2), ("Money", True, 0), ("Film", True, 0), ("Odd", False, 1)}


def test_buckets_keep_recency(articles):
    tagged = articles.withColumn("category", F.lit("x"))
    got = [r["article_id"] for r in L.category_buckets(tagged).orderBy("position").collect()]
    assert got == ["b", "a", "c"]


def test_attach_predictions(articles):
    preds = articles.select("article_id", F.lit("x").alias("raw_category"))
    assert L.attach_predictions(articles, preds).count() == 3
