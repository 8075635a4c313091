"""Similarity join on word n-grams by MinHash banding.

Texts with equal n-grams are one class from the start. Every class has a MinHash signature cut
into bands; classes that agree on a band are tied to the least of that band's bucket, so a bucket
of any size gives as many ties as it has members. All pairs of a tied component are then verified
on their full n-gram sets. Large components are dealt into tiles, and each pair of tiles is a task
of bounded size that returns sums and one root per class, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import (
    STEP, WIDE, Words, byte_slices, fresh_name, lists, mixed, powers, released,
)
from tidings.llm.graph import components
from tidings.session import pin

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
ROWS = 5
# Classes in a tile of a component, and n-grams in it where texts are long; a task verifies the pairs
# of two tiles.
TILE = 256
TILE_NGRAMS = 1 << 22
# Columns of the 0/1 matrix that are multiplied at once.
COLUMNS = 1 << 13


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` values so that a pair of that similarity shares one with ``recall``."""
    return ceil(log(1 - recall) / log(1 - similarity**rows))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``width`` words, by row; a text of fewer words is one run."""
    words = Words(data, offsets)
    count = np.diff(words.first)
    runs = np.zeros(max(0, len(words.hash) - width + 1), WIDE)
    for place, factor in enumerate(powers(STEP, width)):
        runs += words.hash[place : place + len(runs)] * factor
    whole = words.doc[: len(runs)] == words.doc[len(words.hash) - len(runs) :] if len(runs) else []
    docs, hashes = [words.doc[: len(runs)][whole]], [mixed(runs[whole])]
    for size in range(1, width):
        few = np.flatnonzero(count == size)
        total = np.full(len(few), size, WIDE)
        for place, factor in enumerate(powers(STEP, size)):
            total += words.hash[words.first[few] + place] * factor
        docs.append(few)
        hashes.append(mixed(total))
    doc, hash_ = np.concatenate(docs), np.concatenate(hashes)
    order = np.argsort(doc, kind="stable")
    return doc[order], hash_[order]


def signatures(doc: np.ndarray, hashes: np.ndarray, rows: int, bands: int):
    """For each row that has n-grams: its number, two 64-bit sums that tell its n-grams (with their
    counts), and its band hashes."""
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    if not len(starts):
        return doc, np.zeros((2, 0), WIDE), np.zeros((0, bands), WIDE)
    keys = [np.add.reduceat(mixed(hashes + WIDE(seed)), starts) for seed in (1, 2)]
    factors = mixed(np.arange(1, rows * bands + 1, dtype=WIDE)) | WIDE(1)
    shifts = mixed(np.arange(10_001, rows * bands + 10_001, dtype=WIDE))
    out = np.zeros((len(starts), bands), WIDE)
    for band in range(bands):
        total = np.full(len(starts), band, WIDE)
        for row, step in enumerate(powers(STEP, rows + 1)[1:]):
            place = band * rows + row
            least = np.minimum.reduceat((hashes * factors[place] + shifts[place]) >> WIDE(16), starts)
            total += least * step
        out[:, band] = mixed(total)
    return doc[starts], np.stack(keys), out


def sketch(docs: DataFrame, text_col: str, id_col: str, words: int, rows: int, bands: int) -> DataFrame:
    """doc, hi, lo (null for a text without words), its number of n-grams and the band hashes of
    every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            keys, found, marks = np.zeros((2, size), WIDE), np.zeros(size, bool), []
            counts = np.zeros(size, np.int64)
            for start, stop, data, offsets in byte_slices(batch.column(1)):
                owner, hashes = shingles(data, offsets, words)
                row, key, band = signatures(owner, hashes, rows, bands)
                keys[:, start + row], found[start + row] = key, True
                counts[start:stop] = np.bincount(owner, minlength=stop - start)
                marks.append(band)
            flat = np.concatenate(marks).ravel() if marks else np.zeros(0, WIDE)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(key.view(np.int64), mask=~found) for key in keys),
                    pa.array(counts),
                    lists(flat.view(np.int64), found * bands, pa.int64()),
                ],
                ["doc", "hi", "lo", "size", "bands"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc"), F.lower(text_col).alias("text"))
    return texts.mapInArrow(released(run), f"doc {kind}, hi long, lo long, size long, bands array<long>")


def _ngram_sets(docs: DataFrame, classes: DataFrame, text_col: str, id_col: str, words: int) -> DataFrame:
    """The n-grams of one text of each of ``classes`` (rep, first_doc, hi, lo)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in byte_slices(batch.column(1)):
                doc, hashes = shingles(data, offsets, words)
                row, key, _ = signatures(doc, hashes, 1, 1)
                counts = np.bincount(doc, minlength=stop - start)
                keys = np.zeros((2, stop - start), WIDE)
                keys[:, row] = key
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, stop - start),
                        *(pa.array(one.view(np.int64)) for one in keys),
                        lists(hashes.view(np.int64), counts, pa.int64()),
                    ],
                    ["doc", "hi", "lo", "ngrams"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc"), F.lower(text_col).alias("text"))
    wanted = classes.select(F.col("first_doc").alias("wanted")).distinct()
    chosen = texts.join(wanted, F.col("doc").eqNullSafe(F.col("wanted")), "left_semi")
    made = chosen.mapInArrow(released(run), f"doc {kind}, hi long, lo long, ngrams array<long>")
    of = classes.withColumnsRenamed({"hi": "_hi", "lo": "_lo"})
    same = (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo"))
    return made.join(of, same & F.col("doc").eqNullSafe(F.col("first_doc"))).select(
        *classes.columns[:1], *[c for c in of.columns if c not in ("rep", "_hi", "_lo", "first_doc")],
        "ngrams",
    )


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a partition that is sorted by ``keys``, each as one frame."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        values = frame[keys].to_numpy()
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        edges = [0, *cuts.tolist()]
        for start, stop in zip(edges, edges[1:], strict=False):
            yield frame.iloc[start:stop]
        rest = frame.iloc[edges[-1] :].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of hashes."""
    sizes = [len(one) for one in sets]
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    common = np.bincount(column, minlength=len(values)) > 1
    number = np.cumsum(common) - 1
    kept = common[column]
    owner, column = owner[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.diag(np.array(sizes, np.float32))
    total = np.zeros_like(out)
    for start in range(0, int(common.sum()), COLUMNS):
        low, high = np.searchsorted(column, [start, start + COLUMNS])
        matrix = np.zeros((len(sets), min(COLUMNS, int(common.sum()) - start)), np.float32)
        matrix[owner[low:high], column[low:high] - start] = 1
        total += matrix @ matrix.T
    np.fill_diagonal(total, sizes)
    return total


def _verify(similarity: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(frames, ["component", "low", "high"]):
            group = group.drop_duplicates("rep")
            if len(group) < 2:
                continue
            sets = [np.unique(np.asarray(one, np.int64)) for one in group["ngrams"]]
            shared = overlaps(sets)
            sizes = np.diag(shared)
            union = sizes[:, None] + sizes[None, :] - shared
            linked = shared >= similarity * union - 1e-6
            tile = group["tile"].to_numpy()
            if group["low"].iat[0] != group["high"].iat[0]:
                linked &= tile[:, None] != tile[None, :]
            np.fill_diagonal(linked, False)
            rep, copies = group["rep"].to_numpy(), group["copies"].to_numpy()
            root = rep.copy()
            while True:
                least = np.where(linked, root[None, :], root[:, None]).min(axis=1)
                least = np.minimum(least, root)
                if (least == root).all():
                    break
                root = least
            some = linked.any(axis=1)
            yield pd.DataFrame(
                {
                    "rep": rep[some],
                    "root": root[some],
                    "texts": linked.sum(axis=1)[some].astype(np.int64),
                    "docs": (linked @ copies)[some].astype(np.int64),
                }
            )

    return run


def near_duplicates(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    rows: int = ROWS,
    tile: int = TILE,
    tile_ngrams: int = TILE_NGRAMS,
) -> DataFrame:
    """For every row: doc_id, ``class_id`` (the least doc_id of its class of linked documents),
    ``n_links`` (other rows whose n-gram Jaccard similarity is ``similarity`` or more, or whose
    n-grams are the same) and ``n_texts`` (those with other n-grams, each text once).

    Words are compared in lower case; a text of fewer than ``words`` words is one n-gram. A text
    without words (null, empty, marks only) is linked with nothing and is its own class. Rows that
    share a doc_id count as documents of their own. Classes are connected components of links.
    """
    bands = bands_for(similarity, recall, rows)
    marks = pin(sketch(docs, text_col, id_col, words, rows, bands), "sketches")
    reps = (
        marks.where("hi IS NOT NULL")
        .groupBy("hi", "lo")
        .agg(
            F.first("bands").alias("bands"),
            F.first("size").alias("size"),
            F.count(F.lit(1)).alias("copies"),
            F.min("doc").alias("first_doc"),
        )
        .withColumn("rep", F.monotonically_increasing_id())
    )
    reps = pin(reps, "classes")
    buckets = reps.select("rep", F.posexplode("bands").alias("band", "mark"))
    least = buckets.groupBy("band", "mark").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n"))
    ties = buckets.join(least.where("n > 1"), ["band", "mark"]).where("rep <> a")
    tied = components(ties.select("a", F.col("rep").alias("b")))
    roots = tied.select("root").distinct().select(F.col("root").alias("rep"), F.col("root").alias("component"))
    members = tied.select(F.col("node").alias("rep"), F.col("root").alias("component")).unionAll(roots)
    known = reps.select("rep", "hi", "lo", "copies", "first_doc", "size")
    members = members.join(known, "rep").persist()
    tiles = F.greatest(F.count(F.lit(1)) / tile, F.sum("size") / tile_ngrams)
    sizes = members.groupBy("component").agg(F.ceil(tiles).cast("int").alias("tiles"))
    chosen = (
        members.join(sizes, "component")
        .withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
        .select("rep", "component", "tiles", "tile", "copies", "hi", "lo", "first_doc")
    )
    candidates = pin(chosen, "candidates")
    members.unpersist()
    sets = _ngram_sets(docs, candidates, text_col, id_col, words)
    keys = ["component", "low", "high"]
    pairs = (
        sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            "rep", "component", "tile", "copies", "ngrams",
            F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"),
        )
        .repartition(*keys)
        .sortWithinPartitions(*keys, "rep")
    )
    linked = pin(pairs.mapInPandas(_verify(similarity), "rep long, root long, texts long, docs long"), "links")
    links = linked.groupBy("rep").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    classes = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = (
        reps.select("rep", "hi", "lo", "copies", "first_doc")
        .join(links, "rep", "left")
        .join(classes.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("root", F.coalesce("root", "rep"))
    )
    named = known.groupBy("root").agg(F.min("first_doc").alias("class_id"))
    known = known.join(named, "root").select(
        "hi",
        "lo",
        "class_id",
        (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_texts"),
    )
    return marks.select(F.col("doc").alias("doc_id"), "hi", "lo").join(known, ["hi", "lo"], "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
    )


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id. Of several rows under that
    doc_id in one class any one stays, and rows without a doc_id all stay. Rows are told apart by
    numbers of their own, so a doc_id may stand for several texts."""
    names = docs.columns
    row = fresh_name(names, "row")
    # Written, so that a row has the same number whenever it is read.
    docs = pin(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(docs.select(row, text_col), text_col, row, **options)
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(row).alias("doc_id"), F.col(id_col).alias("given"))
    leaders = (
        found.join(ids, "doc_id")
        .groupBy("class_id")
        .agg(F.min(F.struct("given", "doc_id")).alias("first"))
        .select(F.col("first.doc_id").alias(row))
    )
    kept = docs.join(leaders, row, "left_semi").select(*names)
    return kept.unionAll(docs.where(F.col(id_col).isNull()).select(*names))
