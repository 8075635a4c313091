"""Packing of tokenized documents into sequences by first-fit decreasing.

Documents are dealt at random into groups of about the same number and size. In a group every document gives
full sequences of its own; what is left over is packed in decreasing order into the first sequence
that has room, which a tournament tree over the free room finds in logarithmic time. What lies in
sequences that stay too empty is cut anew into full ones and a few of power-of-two lengths, which
need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import byte_slices, released
from tidings.llm.encode import encoder, with_end

CAPACITY = 4096
GROUP = 1000
# Bytes of text in a group, and in a partition, on average; a longer text is held by itself.
GROUP_BYTES = 16 << 20
PART_BYTES = 64 << 20
# Sequences with more free room than this are cut.
SLACK = 8
GROUP_BITS = 32


class Tournament:
    """Free room of ``size`` bins; every inner node holds the most room below it."""

    def __init__(self, size: int, room: int):
        self.width = 1 << max(0, size - 1).bit_length()
        self.room = [0] * self.width + [room] * size + [0] * (self.width - size)
        for node in range(self.width - 1, 0, -1):
            self.room[node] = max(self.room[2 * node], self.room[2 * node + 1])

    def place(self, need: int) -> tuple[int, int]:
        """Put ``need`` into the first bin with room for it: the bin, and the room it had."""
        room, node = self.room, 1
        while node < self.width:
            node *= 2
            if room[node] < need:
                node += 1
        before = room[node]
        room[node] -= need
        found = node - self.width
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
        return found, before


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in it) of every item, by first fit in decreasing order (equal sizes as given)."""
    tree = Tournament(max(1, len(sizes)), capacity)
    out = [(0, 0)] * len(sizes)
    for item in sorted(range(len(sizes)), key=lambda item: -sizes[item]):
        found, room = tree.place(sizes[item])
        out[item] = (found, capacity - room)
    return out


def plan_pieces(sizes: list[int], capacity: int = CAPACITY, slack: int = SLACK) -> list[tuple[int, ...]]:
    """(item, start, length, sequence, offset) of every piece of items of these sizes."""
    pieces, number = [], 0
    rest = []
    for item, size in enumerate(sizes):
        for start in range(0, size - capacity + 1, capacity):
            pieces.append((item, start, capacity, number, 0))
            number += 1
        if size % capacity:
            rest.append((item, size - size % capacity, size % capacity))
    fits = first_fit_decreasing([size for _, _, size in rest], capacity)
    bins: dict[int, list[tuple[int, int, int, int]]] = {}
    for (item, start, size), (found, offset) in zip(rest, fits, strict=True):
        bins.setdefault(found, []).append((offset, item, start, size))
    loose: list[tuple[int, int, int]] = []
    for found in sorted(bins):
        held = sorted(bins[found])
        filled = held[-1][0] + held[-1][3]
        if capacity - filled <= slack:
            pieces += [(item, start, size, number, offset) for offset, item, start, size in held]
            number += 1
        else:
            loose += [(item, start, size) for _, item, start, size in held]
    # What lies in emptier sequences is cut anew: as many full ones as it fills, and of the rest
    # one for each of its binary digits, the greatest first.
    total = sum(size for _, _, size in loose)
    bits = range(capacity.bit_length(), -1, -1)
    lengths = [capacity] * (total // capacity)
    lengths += [1 << bit for bit in bits if total % capacity & (1 << bit)]
    room = offset = 0
    for item, start, size in loose:
        while size:
            if not room:
                room, offset = lengths.pop(0), 0
                number += 1
            taken = min(size, room)
            pieces.append((item, start, taken, number - 1, offset))
            start, size, room, offset = start + taken, size - taken, room - taken, offset + taken
    return pieces


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    text_col: str = "text",
    id_col: str = "doc_id",
    capacity: int = CAPACITY,
    group: int = GROUP,
    slack: int = SLACK,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """One row per piece of a document: doc_id, ``start`` and ``length`` in the document's ids,
    ``ids_crc32`` of the piece's ids as little-endian 32-bit numbers, ``doc_tokens``,
    ``sequence_id``, ``offset`` in the sequence, and ``sequence_tokens``, its ids without padding.

    ``tokenizer`` is a tokenizers file at the same path on every executor; ``end_id`` follows each
    text. Null and empty texts are the end id alone. Every row is a document, also where doc_ids
    repeat or are null. A sequence is full but for ``slack`` ids at most, or its length is a power
    of two.
    """
    counted = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    groups = max(1, -(-counted[0] // group), -(-counted[1] // group_bytes))
    # Rows are dealt by their place in the scan, so that equal rows do not meet in one group.
    dealt = docs.select(
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("group"),
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counted[1] // PART_BYTES))
    parts = min(groups, parts)
    # The order inside a group is fixed too: a task that runs again gives the same sequences.
    dealt = dealt.repartition(parts, "group").sortWithinPartitions("group", "row").drop("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        for number, rows in _by_group(batches):
            ids, counts = [], []
            # Batch by batch, as the texts of a group may be more than one array can hold.
            for texts in rows.column(2).chunks:
                for _, _, data, offsets in byte_slices(texts):
                    some, sizes = with_end(*tokens.encode(data, offsets), end_id)
                    ids.append(some.astype("<u4"))
                    counts.append(sizes)
            ids, sizes = np.concatenate(ids), np.concatenate(counts)
            firsts = np.cumsum(sizes) - sizes
            pieces = np.array(plan_pieces(sizes.tolist(), capacity, slack), np.int64)
            item, start, length, sequence, offset = pieces.T
            low = firsts[item] + start
            data = memoryview(ids).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(low.tolist(), (low + length).tolist(), strict=True)]
            filled = np.bincount(sequence, length).astype(np.int64)
            docs_of = rows.column(1).combine_chunks().take(pa.array(item))
            yield pa.RecordBatch.from_arrays(
                [
                    docs_of,
                    *map(pa.array, (start, length, np.array(sums, np.int64), sizes[item])),
                    pa.array((number << GROUP_BITS) + sequence),
                    pa.array(offset),
                    pa.array(filled[sequence]),
                ],
                ["doc_id", *NAMES],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return dealt.mapInArrow(released(run), f"doc_id {kind}, " + ", ".join(f"{name} long" for name in NAMES))


NAMES = [
    "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens",
]


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each group of a partition that is sorted by its first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
        for low, high in zip(edges, edges[1:], strict=False):
            part = batch.slice(low, high - low)
            if held and held[0].column(0)[0].as_py() != int(groups[low]):
                yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
