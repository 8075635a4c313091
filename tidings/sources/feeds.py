"""RSS and Atom feeds, landed as one file per fetch."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidings import fixed_values as fixed
from tidings.functions.once import with_once
from tidings.functions.text import clean_text, or_else, strip
from tidings.functions.times import published_time
from tidings.session import list_by_few_tasks
from tidings.sources.entry_scanner import Entry, scan
from tidings.sources.schemas import FEED_ENTRY, RAW_FEEDS

# Entries of one fetch are numbered inside a block of this size.
FETCH_BITS = 32
FETCH_STRIDE = 1 << FETCH_BITS
# Entries sent back at once, and their characters; a longer entry is sent by itself.
ENTRIES = 1000
CHARS = 1 << 22


def landed_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """Feed documents under ``folder/feed_rank=<k>/fetch=<n>/``, one row per file."""
    list_by_few_tasks(spark)
    return spark.read.schema(RAW_FEEDS).text(folder, wholetext=True)


def source_name(feed_rank: Column, feeds: list[tuple[str, str]]) -> Column:
    """Name of the feed at a rank; the catalog is a short literal list."""
    return F.get(F.array(*(F.lit(name) for name, _ in feeds)), feed_rank)


def scanned_entries(raw: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per item or entry of every document, in its order: ``position`` and the fields as
    published; one that is cut off has no fields, and ``cut_off`` says by what. Of these columns
    those in ``names`` are sent back, all if there are none.

    Documents are read in one pass each, which forgives bad markup, so one bad entry costs no other.
    RSS, RDF and Atom with or without prefixes are treated alike; see ``entry_scanner``. A task holds
    one document as text at a time, and sends entries back once their texts are long enough together.
    """
    kept = [name for name in raw.columns if name != "value"]
    every = StructType.fromDDL(FEED_ENTRY)
    names = names or every.names
    own = StructType([every[name] for name in names])
    places = [every.names.index(name) for name in names]
    schema = StructType([*raw.select(*kept).schema, *own])
    arrow, kinds = to_arrow_schema(schema), to_arrow_schema(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, document in enumerate(batch.column(len(kept))):
                same = [batch.column(place).slice(row, 1) for place in range(len(kept))]
                read = map(_fields, itertools.count(), scan(document.as_py() or ""))
                for entries in _some(tuple(entry[place] for place in places) for entry in read):
                    before = [pa.concat_arrays([one] * len(entries)) for one in same]
                    found = [pa.array(one, kind.type) for one, kind in zip(zip(*entries, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(before + found, schema=arrow)

    return raw.select(*kept, "value").mapInArrow(run, schema)


def _some(entries: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Entries in lists of up to ``ENTRIES``, and of about ``CHARS`` characters; one has one at least."""
    held, chars = [], 0
    for entry in entries:
        held.append(entry)
        chars += sum(len(field) for field in entry if isinstance(field, str))
        if len(held) == ENTRIES or chars >= CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _fields(position: int, entry: Entry | str) -> tuple:
    if isinstance(entry, str):
        return (position, entry, None, None, None, None, None, None)
    said = entry.fields.get
    # An empty one counts as said, an absent one does not.
    first = lambda *names: next((said(name) for name in names if said(name) is not None), None)
    return (
        position,
        None,
        said("title"),
        entry.link(),
        said("summary"),
        first("description", "content_encoded", "content"),
        first("pubdate", "published", "dc_date"),
        said("updated"),
    )


def feed_rejects(raw: DataFrame) -> DataFrame:
    """Per document how many items or entries it begins, and how many of them cannot be read."""
    found = scanned_entries(raw, ["cut_off"]).groupBy("feed_rank", "fetch")
    return found.agg(
        F.count(F.lit(1)).alias("n_entries"), F.count("cut_off").alias("n_rejected")
    )


def reject_reasons(raw: DataFrame) -> DataFrame:
    """Per document and reason how many items or entries are cut off, and the place of the first."""
    found = scanned_entries(raw, ["position", "cut_off"]).where("cut_off IS NOT NULL").groupBy("feed_rank", "fetch", "cut_off")
    return found.agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first_position"))


def feed_entries(raw: DataFrame) -> DataFrame:
    """One row per readable RSS item or Atom entry, fields as published."""
    return scanned_entries(raw).where("cut_off IS NULL").drop("cut_off")


def normalize_entries(entries: DataFrame, feeds: list[tuple[str, str]]) -> DataFrame:
    """Feed entries to articles. Only an absent title becomes "Untitled", an empty one stays."""
    published = or_else(F.col("published"), F.coalesce("updated", F.lit("")))
    extra = [name for name in entries.columns if name == "ingest_ts"]
    text = with_once(
        entries,
        clean_title=clean_text(F.coalesce("title", F.lit(fixed.UNTITLED))),
        clean_description=clean_text(or_else(F.col("summary"), F.coalesce("description", F.lit("")))),
    )
    cleaned = text.select(
        source_name(F.col("feed_rank"), feeds).alias("source"),
        "feed_rank",
        (F.col("fetch") * FETCH_STRIDE + F.col("position")).alias("entry_index"),
        F.col("clean_title").alias("title"),
        strip(F.coalesce("link", F.lit(""))).alias("link"),
        F.col("clean_description").alias("description"),
        published.alias("published"),
        published_time(F.col("published"), F.col("updated")).alias("published_ts"),
        *extra,
    )
    return cleaned.select(F.md5(dedup_key()).alias("article_id"), *cleaned.columns)


def fetch_of(entry_index: Column) -> Column:
    """The fetch that an entry came with."""
    return F.shiftright(entry_index, FETCH_BITS)


def dedup_key() -> Column:
    """What makes two articles the same: their link, or the title where there is no link."""
    return or_else(F.col("link"), F.col("title"))


def parse_feeds(raw: DataFrame, feeds: list[tuple[str, str]] | None = None) -> DataFrame:
    """Articles of all feeds, in feed order and entry order, copies included."""
    return normalize_entries(feed_entries(raw), feeds or fixed.FEEDS)


def read_feeds(
    spark: SparkSession, folder: str, feeds: list[tuple[str, str]] | None = None
) -> DataFrame:
    return parse_feeds(landed_feeds(spark, folder), feeds)
