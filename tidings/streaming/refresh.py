"""Feed refresh as streams: first-seen ingest, and the newest articles after each batch.

Which articles were seen is the keyed state of the stream, kept by RocksDB on the executors' disks with
its changes in the checkpoint. A batch touches the state of its own keys only, however many batches
came before it, and a batch that is run again finds the state as it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidings import fixed_values as fixed
from tidings.operators.articles import ROW, drop_unkeyed, top_rows
from tidings.operators.labelling import Scorer, category_counts, classify
from tidings.session import list_by_few_tasks
from tidings.sources.feeds import dedup_key, parse_feeds
from tidings.sources.labels import Label
from tidings.sources.schemas import RAW_FEEDS

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Without it every batch would write a snapshot of the whole state.
CHANGES = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


def feed_stream(
    spark: SparkSession, folder: str, feeds: list[tuple[str, str]] | None = None
) -> DataFrame:
    """Articles of feed files as they land. Event time is arrival time, so an old article seen for
    the first time is not late."""
    list_by_few_tasks(spark)
    raw = spark.readStream.schema(RAW_FEEDS).text(folder, wholetext=True)
    stamped = raw.select(
        "value", "feed_rank", "fetch", F.col("_metadata.file_modification_time").alias("ingest_ts")
    )
    return parse_feeds(stamped, feeds)


def _first_copies(articles: DataFrame, key: str) -> DataFrame:
    """Per task and batch of the stream the first copy of each key, in feed and entry order."""
    order = [(name, "ascending") for name in (key, *ROW)]

    def best(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        keys = table[key].combine_chunks()
        new = [True, *pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_pylist()]
        return table.filter(pa.array(new[: len(keys)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, waiting = None, []
        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) > (len(kept) if kept else 0):
                kept = best(pa.concat_tables([*([kept] if kept else []), pa.Table.from_batches(waiting)]))
                waiting = []
        if waiting:
            kept = best(pa.concat_tables([*([kept] if kept else []), pa.Table.from_batches(waiting)]))
        if kept:
            yield from kept.to_batches()

    return articles.mapInArrow(run, articles.schema)


def first_seen(articles: DataFrame, keep: str | None = None) -> DataFrame:
    """The first copy of each article to arrive; of the copies in one batch the first in feed and entry
    order.

    Keys are known for ever, or for the time ``keep`` after they were first seen, so that the state
    stays bounded; an article listed again later than that counts as new. Copies are dropped per
    task first, so a key listed by many files reaches the task that holds its state once per task.
    """
    keyed = drop_unkeyed(articles).withColumn("dedup_key", dedup_key())
    once = _first_copies(keyed, "dedup_key").repartition("dedup_key")
    once = _first_copies(once, "dedup_key")
    if keep:
        new = once.withWatermark("ingest_ts", keep).dropDuplicatesWithinWatermark(["dedup_key"])
    else:
        new = once.dropDuplicates(["dedup_key"])
    return new.drop("dedup_key")


def _with_key_state(stream: DataFrame) -> DataStreamWriter:
    """A writer whose state lies in RocksDB, unless the session names another store."""
    conf = stream.sparkSession.conf
    if "RocksDB" not in conf.get(STATE_STORE):
        conf.set(STATE_STORE, ROCKSDB)
    conf.set(CHANGES, "true")
    return stream.writeStream


def ingest(
    articles: DataFrame, table: str, checkpoint: str, keep: str | None = None
) -> DataStreamWriter:
    """Merge first-seen articles into a parquet table with one folder per batch.

    What the table holds already is not read again; the state of the stream knows it (see
    ``first_seen``). A repeated batch finds the state before it and writes its own folder again.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(table, batch_id))

    writer = _with_key_state(first_seen(articles, keep)).foreachBatch(merge)
    return writer.option("checkpointLocation", checkpoint)


def rolling_latest(
    articles: DataFrame,
    folder: str,
    checkpoint: str,
    n: int = fixed.NEWEST,
    labels: list[Label] | None = None,
    scorer: Scorer | None = None,
    keep: str | None = None,
) -> DataStreamWriter:
    """Keep the newest ``n`` unique articles seen so far, one folder per batch.

    The first copy of an article counts, in feed and entry order within a batch; its key stays known
    (see ``first_seen``), so an article that fell out of the newest ones does not come back by being
    listed again. Each batch merges with the folder of the batch before it. With ``labels`` the
    newest articles are scored too, and their number per category is written below ``counts``. A
    repeated batch reads the same folders and writes its own again, so a restart changes nothing.
    """
    newest, counts = newest_folder(folder), f"{folder}/counts"

    def merge(seen: DataFrame, batch_id: int) -> None:
        read = seen.sparkSession.read
        schema = seen.schema
        if batch_id > 0:
            before = read.schema(schema).parquet(batch_folder(newest, batch_id - 1))
            seen = before.unionByName(seen)
        here = batch_folder(newest, batch_id)
        top_rows(seen, n).write.mode("overwrite").parquet(here)
        if labels:
            tagged = classify(read.schema(schema).parquet(here), labels, scorer=scorer)
            found = category_counts(tagged, labels)
            found.write.mode("overwrite").parquet(batch_folder(counts, batch_id))

    writer = _with_key_state(first_seen(articles, keep)).foreachBatch(merge)
    return writer.option("checkpointLocation", checkpoint)


def newest_folder(folder: str) -> str:
    return f"{folder}/newest"


def batch_folder(folder: str, batch_id: int) -> str:
    return f"{folder}/batch={batch_id}"
