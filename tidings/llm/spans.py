"""Substring deduplication by sliding sentence spans.

Every run of several consecutive sentences is hashed. The document with the least identifier that
holds a run keeps it, in its first place; sentences that any other copy of a run covers are cut
out, wherever the runs around them begin or end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import (
    STEP, STEP_BACK, WIDE, Words, byte_slices, folded, mixed, powers,
)


# A run has so many sentences at least, and as many more as it takes to have so many words.
SENTENCES = 3
WORDS = 15
# A sentence of more words ends at its commas, semicolons and colons too, and after the word of the
# least hash (the first of them) of every WINDOW words in a row. Windows that lie inside a passage
# pick the same words wherever it stands, and others pick none of its inner words, so a passage of
# 2 * WINDOW words at its ends and a run of SENTENCES + 1 windows between them holds a run.
LONG_SENTENCE = 15
WINDOW = 8
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
STOPS = np.zeros(256, bool)
STOPS[[33, 46, 63]] = True
PAUSES = np.zeros(256, bool)
PAUSES[[44, 58, 59]] = True


class Sentences:
    """Sentences of many texts: ``doc``, ``start`` and ``end`` (bytes; the sentences of a text cover
    it without gaps), ``first_word`` and, one longer, the words before each sentence."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, long_sentence: int):
        words = Words(folded(data) if len(data) else data, offsets)
        self.words = words
        if not len(words.hash):
            self.doc = self.start = self.end = self.first_word = np.zeros(0, np.int64)
            self.of_doc = np.zeros(len(offsets), np.int64)
            return
        followed = np.ones(len(data), bool)
        followed[:-1] = SPACES[data[1:]]
        stops = np.flatnonzero((STOPS[data] & followed) | (data == 10))
        heads = self._heads(words, stops)
        # Words of long sentences that follow a pause or an anchor begin one as well.
        length = np.diff(np.append(heads, len(words.hash)))
        long = np.repeat(length > long_sentence, length)
        pauses = np.flatnonzero(PAUSES[data] & followed)
        parts = self._heads(words, pauses)
        parts = np.union1d(parts, self._anchors(words) + 1)
        parts = parts[parts < len(words.hash)]
        heads = np.union1d(heads, parts[long[parts]])
        self.first_word = heads
        self.doc = words.doc[heads]
        self.of_doc = np.searchsorted(self.doc, np.arange(len(offsets)))
        # A sentence reaches to the next one's first word; the first one begins with its text.
        self.start = words.start[heads].copy()
        new = np.diff(self.doc, prepend=-1) > 0
        self.start[new] = offsets[self.doc[new]]
        self.end = np.append(self.start[1:], 0)
        last = np.append(new[1:], True)
        self.end[last] = offsets[self.doc[last] + 1]

    @staticmethod
    def _anchors(words: Words) -> np.ndarray:
        """The first word of the least hash in every window of a text."""
        if len(words.hash) < WINDOW:
            return np.zeros(0, np.int64)
        count = len(words.hash) - WINDOW + 1
        least, place = words.hash[:count].copy(), np.arange(count)
        for step in range(1, WINDOW):
            lower = np.flatnonzero(words.hash[step : step + count] < least)
            least[lower] = words.hash[lower + step]
            place[lower] = lower + step
        return np.unique(place[words.doc[:count] == words.doc[WINDOW - 1 :]])

    @staticmethod
    def _heads(words: Words, marks: np.ndarray) -> np.ndarray:
        """Words that are the first of their text or the first after a mark."""
        before = np.searchsorted(marks, words.start)
        new = np.ones(len(before), bool)
        new[1:] = (np.diff(before) > 0) | (np.diff(words.doc) > 0)
        return np.flatnonzero(new)

    def runs(self, sentences: int, least_words: int):
        """(sentence, sentence after the run's last, hash) of every run."""
        count = len(self.doc)
        if not count:
            return self.doc, self.doc, np.zeros(0, WIDE)
        words_before = np.append(self.first_word, len(self.words.hash))
        first = np.arange(count)
        after = np.searchsorted(words_before, words_before[:-1] + least_words)
        after = np.maximum(after, first + sentences)
        inside = after <= self.of_doc[self.doc + 1]
        first, after = first[inside], after[inside]
        size = len(self.words.hash)
        sums = np.zeros(size + 1, WIDE)
        np.cumsum(self.words.hash * powers(STEP, size), out=sums[1:])
        low, high = words_before[first], words_before[after]
        hashes = (sums[high] - sums[low]) * powers(STEP_BACK, size)[low]
        return first, after, mixed(hashes + (after - first).astype(WIDE))


def _first_runs(docs: DataFrame, kind: str, sentences: int, words: int, long_sentence: int) -> DataFrame:
    """(doc, mark, run, place): every run of every text, once per text, with its first sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in byte_slices(batch.column(1)):
                found = Sentences(data, offsets, long_sentence)
                first, _, hashes = found.runs(sentences, words)
                doc = found.doc[first]
                order = np.lexsort((first, hashes, doc))
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(doc[order]) > 0) | (hashes[order][1:] != hashes[order][:-1])
                kept = np.sort(order[new])
                place = first[kept] - found.of_doc[doc[kept]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, stop - start).take(pa.array(doc[kept])),
                        batch.column(2).slice(start, stop - start).take(pa.array(doc[kept])),
                        pa.array(hashes[kept].view(np.int64)),
                        pa.array(place.astype(np.int32)),
                    ],
                    ["doc", "mark", "run", "place"],
                )

    return docs.mapInArrow(run, f"doc {kind}, mark long, run long, place int")


def _cut(docs: DataFrame, kind: str, sentences: int, words: int, long_sentence: int) -> DataFrame:
    """Apply the covers (places and runs) of each text, and those of runs repeated in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covers = batch.column(2)
            for start, stop, data, offsets in byte_slices(batch.column(1)):
                found = Sentences(data, offsets, long_sentence)
                first, after, hashes = found.runs(sentences, words)
                doc = found.doc[first]
                order = np.lexsort((first, hashes, doc))
                gone = np.zeros(len(order), bool)
                gone[order[1:]] = (np.diff(doc[order]) == 0) & (hashes[order][1:] == hashes[order][:-1])
                own = covers.slice(start, stop - start)
                owner = np.repeat(
                    np.arange(stop - start),
                    np.fromiter((len(one) if one.is_valid else 0 for one in own), np.int64, stop - start),
                )
                flat = own.flatten()
                place = flat.field("place").to_numpy(zero_copy_only=False).astype(np.int64)
                named = flat.field("run").to_numpy(zero_copy_only=False).astype(np.int64).view(WIDE)
                # Texts of one hash share their covers; each takes those that are runs of its own.
                at = np.searchsorted(first, found.of_doc[owner] + place)
                good = at < len(first)
                at, named, owner, place = at[good], named[good], owner[good], place[good]
                good = (first[at] == found.of_doc[owner] + place) & (hashes[at] == named) & (doc[at] == owner)
                gone[at[good]] = True
                marks = np.zeros(len(found.doc) + 1, np.int64)
                np.add.at(marks, first[gone], 1)
                np.add.at(marks, after[gone], -1)
                removed = np.cumsum(marks)[:-1] > 0
                yield _texts(batch.slice(start, stop - start), data, offsets, found, removed)

    schema = f"doc_id {kind}, n_sentences long, n_removed long, text string, spans array<struct<start:long,end:long>>"
    return docs.mapInArrow(run, schema)


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _texts(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, found: Sentences, removed: np.ndarray):
    count = np.diff(found.of_doc)
    lost = np.bincount(found.doc, removed, minlength=len(count)).astype(np.int64)
    texts, spans = batch.column(1).to_pylist(), [[]] * len(count)
    for row in np.flatnonzero(lost).tolist():
        low, high = found.of_doc[row], found.of_doc[row + 1]
        out = removed[low:high]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
        whole = data[offsets[row] : offsets[row + 1]].tobytes()
        pieces, own, at, seen = [], [], 0, 0
        for first, after in zip(edges[::2] + low, edges[1::2] + low, strict=True):
            begin, end = int(found.start[first] - offsets[row]), int(found.end[after - 1] - offsets[row])
            left = whole[at:begin].decode()
            gone = whole[begin:end].decode()
            own.append({"start": seen + len(left), "end": seen + len(left) + len(gone)})
            seen += len(left) + len(gone)
            pieces.append(left)
            at = end
        pieces.append(whole[at:].decode())
        texts[row], spans[row] = "".join(pieces), own
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0), pa.array(count), pa.array(lost), pa.array(texts, pa.string()),
            pa.array(spans, pa.list_(SPAN)),
        ],
        ["doc_id", "n_sentences", "n_removed", "text", "spans"],
    )


def cut_repeats(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    sentences: int = SENTENCES,
    words: int = WORDS,
    long_sentence: int = LONG_SENTENCE,
) -> DataFrame:
    """For every row: doc_id, n_sentences, n_removed, ``text`` without the sentences that a repeated
    run covers, and ``spans`` of what was cut (code points of the given text).

    A sentence ends at ".", "!" or "?" before white space and at a line feed; one longer than
    ``long_sentence`` words also at commas, semicolons and colons and after the word of the least hash of
    every ``WINDOW`` words. A run has ``sentences`` sentences, and more until it has ``words`` words; case and
    marks do not count. Of all copies of a run, the first in the text with the least doc_id stays
    (null counts as greatest). Rows that share a doc_id keep the same runs. Null stays null; a text
    with fewer sentences has no runs.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(
        F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark")
    )
    runs = _first_runs(given, kind, sentences, words, long_sentence)
    owners = runs.groupBy("run").agg(F.min("doc").alias("owner"), F.count(F.lit(1)).alias("n"))
    owners = owners.where("n > 1").drop("n")
    covers = (
        runs.join(owners, "run")
        .where(~F.col("doc").eqNullSafe(F.col("owner")))
        # Rows of one doc_id (or of none) share covers only where their texts are equal, each but once.
        .groupBy(F.col("doc").alias("of"), F.col("mark").alias("marked"))
        .agg(F.collect_set(F.struct("place", "run")).alias("covers"))
    )
    own = F.col("doc").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("marked"))
    joined = given.join(covers, own, "left")
    return _cut(joined.select("doc", "text", "covers"), kind, sentences, words, long_sentence)
