"""Benchmark decontamination by spaced-seed hashing.

A mask says which words of a short window are hashed; the others may differ. Hashes of all windows
of the benchmark and of the training texts are joined, and around every hit the two texts are laid
over each other: the longest stretch in which enough words agree tells whether the passage leaked.
Two bitmaps of fixed size with bits of the benchmark's hashes keep most training windows from the
join; they only ever let through too many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import (
    STEP, WIDE, Words, bitmap, byte_slices, fresh_name, in_bitmap, lists, mixed, powers,
    released,
)
from tidings.llm.near import SIMILARITY
from tidings.session import pin

# 1: the word is hashed, 0: it may be any.
MASKS = ("110111", "1101011", "10110101", "111001001")
# A stretch of so many words (or the whole of a shorter item) must agree in this share of words.
LEAST_WORDS = 13
LEAST_SHARE = SIMILARITY
# Words kept on either side of hits; hits nearer to each other than this make one segment.
REACH = 64
# Each bitmap has 2**BITMAP bits, whatever the benchmark's size.
BITMAP = 24


def seeds(words: Words, short: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hash) of every window of every mask, and of every run of a length in ``short``,
    that lies in one text; by word."""
    size = len(words.hash)
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, WIDE)]
    patterns = [*MASKS, *("1" * length for length in short)]
    for number, mask in enumerate(patterns):
        count = size - len(mask) + 1
        if count <= 0:
            continue
        # Runs of a short length have tags of their own, so both sides must know the length.
        tag = number if number < len(MASKS) else 1000 + len(mask)
        total = np.full(count, tag, WIDE)
        for place, factor in enumerate(powers(STEP, len(mask))):
            if mask[place] == "1":
                total += words.hash[place : place + count] * factor
        whole = words.doc[:count] == words.doc[len(mask) - 1 :]
        places.append(np.flatnonzero(whole))
        hashes.append(mixed(total[whole]))
    place, hash_ = np.concatenate(places), np.concatenate(hashes)
    order = np.argsort(place, kind="stable")
    return place[order], hash_[order]


def longest_span(equal: np.ndarray, share: float) -> tuple[int, int]:
    """(start, end) of the longest stretch of which ``share`` or more is true."""
    sums = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - share, -share))])
    lows = np.minimum.accumulate(sums)
    first = np.searchsorted(-lows, -sums - 1e-9)
    best = int((np.arange(len(sums)) - first).argmax())
    return int(first[best]), best


def _benchmark_words(items: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(item, copies, words) of every distinct text of the benchmark that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in byte_slices(batch.column(2)):
                words = Words(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, stop - start),
                        batch.column(1).slice(start, stop - start),
                        lists(words.hash.view(np.int64), np.diff(words.first), pa.int64()),
                    ],
                    ["item", "copies", "words"],
                )

    kind = items.schema[id_col].dataType.simpleString()
    texts = (
        items.groupBy(F.lower(text_col).alias("text"))
        .agg(F.min(id_col).alias("item"), F.count(F.lit(1)).alias("copies"))
        .select("item", "copies", "text")
    )
    found = texts.mapInArrow(released(run), f"item {kind}, copies long, words array<long>")
    return found.where(F.size("words") > 0).withColumn("key", F.monotonically_increasing_id())


def _item_seeds(items: DataFrame, shortest: int) -> DataFrame:
    """(key, place, seed) of every benchmark window."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, own in zip(frame["key"], frame["words"], strict=True):
                words = Words(np.zeros(0, np.uint8), np.zeros(2, np.int64))
                words.hash = np.asarray(own, np.int64).view(WIDE)
                words.doc = np.zeros(len(own), np.int64)
                short = (len(own),) if len(own) < shortest else ()
                place, hashes = seeds(words, short)
                yield pd.DataFrame({"key": key, "place": place, "seed": hashes.view(np.int64)})

    return items.select("key", "words").mapInPandas(run, "key long, place long, seed long")


def _segments(
    docs: DataFrame, text_col: str, id_col: str, marked, bits: int, short: tuple[int, ...], reach: int
) -> DataFrame:
    """Stretches of training texts around hits in the bitmap, with the seeds hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in byte_slices(batch.column(1)):
                words = Words(data, offsets)
                place, hashes = seeds(words, short)
                once, twice = marked.value
                hit = np.flatnonzero(in_bitmap(once, hashes, bits))
                hit = hit[in_bitmap(twice, hashes[hit] << WIDE(bits), bits)]
                if not len(hit):
                    continue
                place, hashes = place[hit], hashes[hit]
                doc = words.doc[place]
                new = np.flatnonzero((np.diff(place) > reach) | (np.diff(doc) != 0)) + 1
                first = np.concatenate([[0], new])
                last = np.concatenate([new, [len(place)]]) - 1
                own = doc[first]
                low = np.maximum(place[first] - reach, words.first[own])
                high = np.minimum(place[last] + reach, words.first[own + 1])
                counts = high - low
                at = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                hits = np.diff(np.append(first, len(place)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, stop - start).take(pa.array(own)),
                        pa.array(low - words.first[own]),
                        lists(words.hash[at].view(np.int64), counts, pa.int64()),
                        lists(hashes.view(np.int64), hits, pa.int64()),
                        lists(place - np.repeat(low, hits), hits, pa.int64()),
                    ],
                    ["doc", "first", "words", "seeds", "places"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc"), F.lower(text_col).alias("text"))
    schema = f"doc {kind}, first long, words array<long>, seeds array<long>, places array<long>"
    return texts.mapInArrow(released(run), schema).withColumn("segment", F.monotonically_increasing_id())


def _overlay(least: int, share: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, first, item, copies, mine, theirs, shifts in frame.itertuples(index=False):
                best = (0, 0, 0)
                for shift in shifts:
                    low, high = max(0, -shift), min(len(theirs), len(mine) - shift)
                    equal = mine[low + shift : high + shift] == theirs[low:high]
                    start, end = longest_span(equal, share)
                    found = (end - start, int(equal[start:end].sum()), first + low + shift + start)
                    best = max(best, found)
                if best[0] >= min(least, len(theirs)):
                    rows.append((doc, item, copies, *best, len(theirs)))
            yield pd.DataFrame(rows, columns=NAMES).astype({"doc_id": frame["doc"].dtype})

    return run


NAMES = ["doc_id", "item_id", "item_copies", "words", "matched", "start", "item_words"]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    item_text_col: str = "text",
    item_id_col: str = "item_id",
    least_words: int = LEAST_WORDS,
    least_share: float = LEAST_SHARE,
    reach: int = REACH,
    bits: int = BITMAP,
) -> DataFrame:
    """One row for each document and benchmark item of which the document holds a passage: doc_id,
    item_id, item_copies (items of the same text; item_id is the least), the longest overlap
    (words, matched), its first word in the document, and item_words.

    A passage is a stretch of ``least_words`` words, or a whole shorter item, in which
    ``least_share`` of the words agree. Null and wordless texts and items leak nothing. Rows that
    share a doc_id count as one document; copies of an item as one item.
    """
    spark = docs.sparkSession
    items = pin(_benchmark_words(items, item_text_col, item_id_col), "items")
    # An item shorter than the longest mask may lack windows, so it is also sought as a whole.
    shortest = max(map(len, MASKS))
    lengths = items.where(F.size("words") < shortest).select(F.size("words").alias("n")).distinct()
    short = tuple(sorted(row.n for row in lengths.collect()))
    known = pin(_item_seeds(items, shortest), "item-seeds")
    # The highest bits of a seed are looked up in one bitmap, the next ones in another.
    nexts = known.select(F.shiftleft("seed", bits).alias("seed"))
    maps = tuple(bitmap(part, "seed", bits) for part in (known, nexts))
    marked = spark.sparkContext.broadcast(maps)
    segments = pin(_segments(docs, text_col, id_col, marked, bits, short, reach), "segments")
    hits = segments.select("segment", F.explode(F.arrays_zip("seeds", "places")).alias("hit"))
    hits = hits.select("segment", F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("at"))
    shifts = (
        hits.join(known, "seed")
        .groupBy("segment", "key")
        .agg(F.collect_set(F.col("at") - F.col("place")).alias("shifts"))
    )
    pairs = (
        shifts.join(segments.select("segment", "doc", "first", F.col("words").alias("mine")), "segment")
        .join(items.select("key", "item", "copies", F.col("words").alias("theirs")), "key")
        .select("doc", "first", "item", "copies", "mine", "theirs", "shifts")
    )
    kinds = {name: "long" for name in NAMES}
    kinds["doc_id"] = docs.schema[id_col].dataType.simpleString()
    kinds["item_id"] = items.schema["item"].dataType.simpleString()
    found = pairs.mapInPandas(
        _overlay(least_words, least_share), ", ".join(f"{name} {kind}" for name, kind in kinds.items())
    )
    best = F.max(F.struct("words", "matched", "start")).alias("best")
    return (
        found.groupBy("doc_id", "item_id", "item_copies", "item_words")
        .agg(best)
        .select("doc_id", "item_id", "item_copies", "best.*", "item_words")
    )


def drop_leaks(
    docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options
) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage. Rows are told apart by numbers of
    their own, so other rows of the same doc_id stay, and a leaked row goes without a doc_id too."""
    names = docs.columns
    leaked = fresh_name(names, "leaked")
    # Written, so that a row has the same number whenever it is read.
    docs = pin(docs.withColumn(leaked, F.monotonically_increasing_id()), "numbered")
    found = find_leaks(docs.select(leaked, text_col), items, text_col, leaked, **options)
    gone = found.select(F.col("doc_id").alias(leaked)).distinct()
    return docs.join(gone, leaked, "left_anti").select(*names)
