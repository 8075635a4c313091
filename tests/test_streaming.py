import glob
import os
import time

from tidings.operators.articles import dedup_first_seen, latest
from tidings.sources.feeds import dedup_key, read_feeds
from tidings.sources.labels import Label
from tidings.streaming.refresh import (
    batch_folder,
    feed_stream,
    ingest,
    newest_folder,
    rolling_latest,
)

FEEDS = [("one", "u"), ("two", "v")]


def item(link, title, day):
    return (
        f"<item><title>{title}</title><link>{link}</link>"
        f"<pubDate>{day:02d} Jan 2024 00:00:00 GMT</pubDate></item>"
    )


def land(spark, folder, fetch, *feeds):
    rows = [
        (f"<rss><channel>{''.join(items)}</channel></rss>", rank, fetch)
        for rank, items in enumerate(feeds)
    ]
    frame = spark.createDataFrame(rows, "value string, feed_rank int, fetch bigint")
    frame.write.mode("append").partitionBy("feed_rank", "fetch").text(folder)


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_stream_equals_batch(spark, tmp_path):
    folder, table, newest = (str(tmp_path / name) for name in ("in", "articles", "newest"))

    def refresh():
        run(ingest(feed_stream(spark, folder, FEEDS), table, str(tmp_path / "c1")))
        stream = feed_stream(spark, folder, FEEDS)
        return run(rolling_latest(stream, newest, str(tmp_path / "c2"), 3, [Label("x", "X")]))

    land(spark, folder, 0, [item("l1", "a", 1), item("l2", "b", 2)], [item("l1", "copy", 1)])
    refresh()
    land(spark, folder, 1, [item("l2", "b again", 9), item("l3", "c", 3)], [item("l4", "d", 4)])
    last = refresh()

    batch = dedup_first_seen(read_feeds(spark, folder, FEEDS))
    key = lambda df: sorted(r["k"] for r in df.select(dedup_key().alias("k")).collect())
    kept = spark.read.parquet(table)
    assert key(kept) == key(batch) == ["l1", "l2", "l3", "l4"]
    batch_id = last.lastProgress["batchId"]
    rolled = spark.read.parquet(batch_folder(newest_folder(newest), batch_id))
    assert key(rolled) == key(latest(batch, 3)) == ["l2", "l3", "l4"]
    counted = spark.read.parquet(batch_folder(f"{newest}/counts", batch_id))
    assert [tuple(row) for row in counted.select("category", "n").collect()] == [("X", 3)]

    # An article that fell out of the newest three is listed again, now as the newest.
    land(spark, folder, 2, [item("l1", "late copy", 20)], [item("l5", "e", 2), item("l5", "e", 9)])
    batch_id = refresh().lastProgress["batchId"]
    rolled = spark.read.parquet(batch_folder(newest_folder(newest), batch_id))
    assert key(rolled) == ["l2", "l3", "l4"]
    assert key(spark.read.parquet(table)) == ["l1", "l2", "l3", "l4", "l5"]


def test_repeated_batch_changes_nothing(spark, tmp_path):
    """Running again without new files leaves the result alone."""
    folder, table = str(tmp_path / "in"), str(tmp_path / "articles")
    land(spark, folder, 0, [item("l1", "a", 1)], [item("l1", "a", 1)])
    for _ in range(2):
        run(ingest(feed_stream(spark, folder, FEEDS), table, str(tmp_path / "c")))
    assert spark.read.parquet(table).count() == 1


def refreshed(spark, tmp_path, **options):
    """Ingest and newest two after the files that have landed so far."""
    stream = feed_stream(spark, str(tmp_path / "in"), FEEDS)
    run(ingest(stream, str(tmp_path / "articles"), str(tmp_path / "c1"), **options))
    stream = feed_stream(spark, str(tmp_path / "in"), FEEDS)
    return run(rolling_latest(stream, str(tmp_path / "newest"), str(tmp_path / "c2"), 2))


def titles(spark, path):
    return sorted(row.title for row in spark.read.parquet(path).collect())


def test_batches_read_no_earlier_ones(spark, tmp_path):
    """Folders of earlier batches may be gone or spoilt: what was seen is state."""
    for fetch in range(4):
        land(spark, str(tmp_path / "in"), fetch, [item("same", f"copy {fetch}", 1), item(f"l{fetch}", f"t{fetch}", fetch + 2)])
        last = refreshed(spark, tmp_path)
        own = batch_folder(str(tmp_path / "articles"), fetch)
        assert titles(spark, own) == (["copy 0", "t0"] if not fetch else [f"t{fetch}"])
        state = last.lastProgress["stateOperators"][0]
        assert state["numRowsTotal"] == fetch + 2 and state["numRowsUpdated"] == (1 if fetch else 2)
        for old in (own, batch_folder(newest_folder(str(tmp_path / "newest")), fetch - 1)):
            for file in glob.glob(f"{old}/*.parquet"):
                open(file, "wb").write(b"spoilt")
                crc = f"{os.path.dirname(file)}/.{os.path.basename(file)}.crc"
                if os.path.exists(crc):
                    os.remove(crc)
    assert titles(spark, batch_folder(newest_folder(str(tmp_path / "newest")), 3)) == ["t2", "t3"]


def test_batch_that_ran_before_its_commit_was_noted(spark, tmp_path):
    """After a failure between writing and committing, the batch runs again with the state before it."""
    for fetch in range(3):
        land(spark, str(tmp_path / "in"), fetch, [item("l1", "again", 1), item(f"m{fetch}", f"t{fetch}", 3)])
        refreshed(spark, tmp_path)
    before = titles(spark, str(tmp_path / "articles")), titles(spark, batch_folder(newest_folder(str(tmp_path / "newest")), 2))
    for name in ("c1", "c2"):
        for file in glob.glob(str(tmp_path / name / "commits" / "*2*")) + glob.glob(str(tmp_path / name / "commits" / ".2*")):
            os.remove(file)
    refreshed(spark, tmp_path)
    after = titles(spark, str(tmp_path / "articles")), titles(spark, batch_folder(newest_folder(str(tmp_path / "newest")), 2))
    assert before == after
    assert before[0] == ["again", "t0", "t1", "t2"]


def test_first_copy_of_a_batch(spark, tmp_path):
    copies = [item("l1", f"copy {place}", 1) for place in range(50)]
    land(spark, str(tmp_path / "in"), 0, [item("l0", "x", 1)], copies)
    land(spark, str(tmp_path / "in"), 1, copies[::-1])
    refreshed(spark, tmp_path)
    assert titles(spark, str(tmp_path / "articles")) == ["copy 49", "x"]


def test_keys_may_be_forgotten(spark, tmp_path):
    """Once the time to keep a key is over, its article counts as new."""
    for keep, expected in (("1 day", ["a", "b", "c"]), ("1 second", ["a", "a", "b", "c"])):
        own = tmp_path / keep.replace(" ", "-")
        own.mkdir()
        for fetch, items in enumerate([["a"], ["b"], ["c", "a"]]):
            land(spark, str(own / "in"), fetch, [item(name, name, 1) for name in items])
            refreshed(spark, own, keep=keep)
            time.sleep(2.5)
        assert titles(spark, str(own / "articles")) == expected
