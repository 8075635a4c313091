import pytest
from pyspark.sql import functions as F

from tidings import fixed_values as fixed
from tidings.operators import ablation as A
from tidings.operators import corpus as C
from tidings.operators import metrics as M
from tidings.plans.evaluation import evaluate
from tidings.plans.preparation import balanced_corpus
from tidings.sources.labels import Label

# Published confusion counts, rows true and columns predicted.
CLASSES = ["Business", "Crime", "Entertainment", "Politics", "Sports", "Technology"]
CONFUSION = [
    [696, 55, 37, 58, 15, 139],
    [48, 781, 21, 93, 25, 32],
    [42, 123, 737, 29, 43, 26],
    [28, 61, 85, 252, 25, 20],
    [93, 64, 67, 46, 703, 27],
    [237, 26, 30, 12, 10, 685],
]
# Published scores per class and on average.
REPORT = {
    "Business": (0.6084, 0.6960, 0.6493, 1000),
    "Crime": (0.7036, 0.7810, 0.7403, 1000),
    "Entertainment": (0.7544, 0.7370, 0.7456, 1000),
    "Politics": (0.5143, 0.5350, 0.5245, 471),
    "Sports": (0.8563, 0.7030, 0.7721, 1000),
    "Technology": (0.7374, 0.6850, 0.7102, 1000),
}
AVERAGES = {
    "accuracy": (0.7044, 0.7044, 0.7044, 5471),
    "macro": (0.6957, 0.6895, 0.6903, 5471),
    "weighted": (0.7133, 0.7044, 0.7064, 5471),
}
# Published accuracy per template.
ABLATION = [
    ("P0", 0.7187), ("P1", 0.7233), ("P2", 0.7044), ("P3", 0.7428), ("P4", 0.7222),
    ("P5", 0.7094), ("P6", 0.6975), ("P7", 0.7333), ("P8", 0.6624), ("P9", 0.6626),
]
LABELS = [Label(name, name) for name in CLASSES]


@pytest.fixture(scope="module")
def preds(spark):
    cells = [
        (y, yhat, n) for y, row in zip(CLASSES, CONFUSION) for yhat, n in zip(CLASSES, row)
    ]
    counted = spark.createDataFrame(cells, "y string, yhat string, n int")
    return counted.select("y", "yhat", F.explode(F.sequence(F.lit(1), "n")).alias("i")).drop("i")


def test_class_report(preds):
    got = {r[0]: tuple(r)[1:] for r in M.class_report(preds).collect()}
    assert got == REPORT


def test_averages(preds):
    assert {r[0]: tuple(r)[1:] for r in M.report_averages(preds).collect()} == AVERAGES


def test_confusion(preds):
    wide = M.confusion_wide(preds, LABELS)
    assert wide.columns == ["y", *CLASSES]
    assert {r["y"]: [r[c] for c in CLASSES] for r in wide.collect()} == dict(zip(CLASSES, CONFUSION))
    assert tuple(M.confusion_check(preds, LABELS).first()) == (5471, 5471, 0)
    assert tuple(M.confusion_check(preds, LABELS[1:]).first())[2] == 5471 - sum(
        sum(row[1:]) for row in CONFUSION[1:]
    )


def test_confusion_has_rows_for_absent_labels(spark):
    preds = spark.createDataFrame([("a", "b"), ("a", "z")], "y string, yhat string")
    labels = [Label("a", "A"), Label("b", "B")]
    got = {tuple(r) for r in M.confusion(preds, labels).collect()}
    assert got == {("a", "a", 0), ("a", "b", 1), ("b", "a", 0), ("b", "b", 0)}


def test_report_covers_true_and_predicted_classes(spark):
    preds = spark.createDataFrame([("a", "b"), ("a", "a"), ("c", "a")], "y string, yhat string")
    got = {r[0]: tuple(r)[1:] for r in M.class_report(preds).collect()}
    assert got == {"a": (0.5, 0.5, 0.5, 2), "b": (0.0, 0.0, 0.0, 0), "c": (0.0, 0.0, 0.0, 1)}
    none = preds.where("y = 'none'")
    assert M.class_report(none).count() == 0
    assert [tuple(r)[1:] for r in M.report_averages(none).collect()] == [(0.0, 0.0, 0.0, 0)] * 3


def test_top_confusions(preds):
    got = [tuple(r) for r in M.top_confusions(preds, 5).collect()]
    assert got == [
        ("Technology", "Business", 237),
        ("Business", "Technology", 139),
        ("Entertainment", "Crime", 123),
        ("Crime", "Politics", 93),
        ("Sports", "Business", 93),
    ]


def test_interval(preds):
    row = M.accuracy_interval(preds).first()
    assert (row["n"], row["accuracy"]) == (5471, 0.7044)
    assert round(row["half_width"], 3) == 0.012


def test_triage(spark):
    rows = [("a", "a", 0.9), ("a", "b", 0.45), ("a", "b", 0.44), ("a", "a", 0.1)]
    preds = spark.createDataFrame(rows, "y string, yhat string, confidence double")
    got = {tuple(r) for r in M.triage(preds).collect()}
    assert got == {(True, 2, 1, 0.5), (False, 2, 1, 0.5)}


def test_compliance(spark):
    long = " ".join(["w"] * 23)
    texts = ["a\nb\nc", "a\nb", f"a\nb\n{long}", "a\nb\n" + " ".join(["w"] * 22)]
    frame = spark.createDataFrame([(t,) for t in texts], "summary string")
    assert tuple(M.summary_compliance(frame).first()) == (2, 4, 0.5)


def test_published_ablation(spark):
    table = spark.createDataFrame(ABLATION, "prompt_id string, accuracy double")
    table = table.withColumn("template", F.col("prompt_id"))
    assert A.best_template(table).first()["prompt_id"] == "P3"
    rows = {r["prompt_id"]: r for r in A.ablation_deltas(table, "P2").collect()}
    assert (rows["P3"]["gain"], rows["P3"]["relative_gain"]) == (0.0384, 0.0545)
    assert (rows["P8"]["gain"], rows["P9"]["gain"]) == (-0.042, -0.0418)
    assert {r["spread"] for r in rows.values()} == {0.0804}


def test_one_scan_equals_separate_runs(spark):
    rows = [
        ("politics and law", "Crime"), ("a game of sports", "Sports"), ("science", "Technology"),
        ("this headline is about crime", "Crime"), ("economy", "Business"), ("banking", "Business"),
    ]
    pairs = spark.createDataFrame(rows, "x string, y string")
    together = A.ablate(pairs, LABELS).collect()
    assert len(together) == len(fixed.TEMPLATES)
    assert [r["accuracy"] for r in together] == sorted((r["accuracy"] for r in together), reverse=True)
    for row in together:
        alone = A.ablate(pairs, LABELS, [(row["prompt_id"], row["template"])]).first()
        assert tuple(alone) == tuple(row)


def test_phrases_round_trip(spark):
    frame = spark.createDataFrame([("Crime",), ("Other",)], "given string")
    phrased = A.with_phrase(frame, fixed.EXPANDED_PHRASES, "given")
    got = [tuple(r) for r in A.with_label(phrased, fixed.EXPANDED_PHRASES).collect()]
    assert got == [("Crime", "crime and law", "Crime"), ("Other", "Other", "Other")]


def test_evaluate(spark):
    rows = [("sports", "Sports"), ("crime", "Crime"), ("crime", "Sports")]
    found = evaluate(spark.createDataFrame(rows, "x string, y string"), LABELS)
    assert found["confusion"].agg(F.sum("n")).first()[0] == 3
    assert {r["average"] for r in found["averages"].collect()} == {"accuracy", "macro", "weighted"}


def test_eval_rows_and_vocabulary(spark):
    rows = [(" x ", " Crime "), ("", "Crime"), (None, "Crime"), ("y", "Odd"), ("z", None)]
    frame = spark.createDataFrame(rows, "text string, label string")
    assert [tuple(r) for r in C.prepare_eval(frame, LABELS).collect()] == [("x", "Crime")]
    outside = C.out_of_vocab(frame, LABELS, "label")
    assert {r["text"] for r in outside.collect()} == {" x ", "y", "z"}


def test_counts_and_shares(spark):
    frame = spark.createDataFrame([("a",), ("a",), ("b",)], "c string")
    assert [tuple(r) for r in C.value_counts(frame, "c").collect()] == [("a", 2), ("b", 1)]
    assert {tuple(r) for r in C.class_share(frame, "c").collect()} == {
        ("a", 2, 0.6667), ("b", 1, 0.3333),
    }
    assert tuple(C.keep_rate(frame, F.col("c") == "a").first()) == (2, 3, 0.6667)


def test_balanced_corpus(spark):
    rows = [(i, " Crime ") for i in range(30)] + [(i, "Sports") for i in range(30, 35)] + [(99, "Odd")]
    frame = spark.createDataFrame(rows, "id int, headline_category string")
    sample, report = balanced_corpus(frame, n=10, id_column="id")
    assert {tuple(r) for r in report.collect()} == {("Crime", 30, 10), ("Sports", 5, 5)}
    assert sorted(r["shuffle_pos"] for r in sample.collect()) == list(range(1, 16))
