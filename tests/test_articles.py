from datetime import datetime

from pyspark.sql import functions as F

from tidings.operators import articles as N
from tidings.sources.schemas import ARTICLES


def article(n, title="", link="", rank=0, ts=None, description="", published=""):
    when = datetime(2024, 1, ts) if ts else None
    return (f"a{n}", f"s{rank}", rank, n, title, link, description, published, when)


def frame(spark, rows):
    return spark.createDataFrame(rows, ARTICLES)


def ids(df):
    return [row["article_id"] for row in df.collect()]


def test_dedup_first_seen(spark):
    rows = [
        article(1, "x", "L", rank=1),
        article(2, "y", "L", rank=0),
        article(3, "same"),
        article(4, "same", rank=2),
        article(5, "z", link="same", rank=3),
        article(6),
        article(7, "y"),
    ]
    unique = N.dedup_first_seen(frame(spark, rows))
    assert sorted(ids(unique)) == ["a2", "a3", "a7"]
    assert sorted(ids(N.dedup_first_seen(unique))) == ["a2", "a3", "a7"]


def test_latest_is_stable_and_undated_last(spark):
    rows = [
        article(1, "a", rank=1, ts=5),
        article(2, "b", rank=0, ts=5),
        article(3, "c"),
        article(4, "d", ts=9),
    ]
    assert ids(N.latest(frame(spark, rows), 3)) == ["a4", "a2", "a1"]
    assert ids(N.latest(frame(spark, rows), 10))[-1] == "a3"


def test_newest_keeps_exactly_n_rows(spark):
    """Rows without ordinals stay in the running, and equal ordinals add none."""
    rows = [article(k, f"t{k}", ts=1 + k % 3) for k in range(6)]
    bare = [(*row[:2], None if k % 2 else 0, None, *row[4:]) for k, row in enumerate(rows)]
    same = [(*row[:2], 0, 7, *row[4:]) for row in rows]
    for table in (bare, same, bare + bare, [bare[0]] * 5):
        for n in (1, 2, 4):
            assert N.latest(frame(spark, table), n).count() == min(n, len(table))
            assert N.newest_unique(frame(spark, table), n).count() == min(n, len(set(table)))
    mixed = N.union_articles(frame(spark, rows[:1]), frame(spark, bare[1:2]).drop("entry_index"))
    assert N.latest(mixed, 30).count() == 2


def test_newest_unique_dedups_before_ordering(spark):
    rows = [
        article(1, "a", ts=1, rank=0, description="old"),
        article(2, "a", ts=9, rank=1, description="new"),
        article(3, "b", ts=5),
    ]
    newest = N.newest_unique(frame(spark, rows), 2)
    assert ids(newest) == ["a3", "a1"]
    assert sorted(newest.columns) == sorted(frame(spark, rows).columns)


def test_first_copy_is_chosen_before_the_shuffle(spark):
    plan = N.dedup_first_seen(frame(spark, [article(1, "a")]))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_cards(spark):
    tagged = frame(spark, [article(1, "T", "http://l", description="One. Two.", published="p")])
    card = N.cards(tagged.withColumn("confidence", F.lit(0.456))).first()
    assert card["heading"] == "### [T](http://l)"
    assert card["caption"] == "Source: s0 | Published: p | Zero-shot confidence: 0.46"
    assert card["summary"].startswith("One.\nTwo.\n")


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([("1", "x")], "article_id string, title string")
    b = spark.createDataFrame([("2", "y")], "article_id string, link string")
    got = {tuple(row) for row in N.union_articles(a, b).collect()}
    assert got == {("1", "x", None), ("2", None, "y")}


def test_head_in_file_order(spark, tmp_path):
    """Rows come in file order across files and splits, whatever the number asked for."""
    from tidings.sources.tables import read_csv

    for name, start in (("a", 0), ("b", 100), ("c", 200)):
        lines = "".join(f"{i}\n" for i in range(start, start + 100))
        (tmp_path / f"{name}.csv").write_text("n\n" + lines)
    table = read_csv(spark, str(tmp_path), multi_line=False).withColumn("n", F.col("n").cast("int"))
    odd = table.where("n % 2 = 1")
    for n in (1, 60, 110, 500):
        got = sorted(row["n"] for row in N.head_in_order(odd, n).collect())
        assert got == list(range(1, 300, 2))[:n]
