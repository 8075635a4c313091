"""Shared helpers: the training fold, slices of Arrow batches, letters and word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

FOLDS = 5
# Arrays made at once cover about so many bytes or characters; one longer text is a slice by itself.
SLICE = 1 << 20
WIDE = np.uint64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def held_out(id_col: str) -> Column:
    """True for the fold that is never learnt from; a row without an identifier belongs to it."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == 0, F.lit(True))


def slices(lengths: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths add up to about ``limit``; a range has one row at least."""
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop
        start = stop


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, row after the last, texts) of each slice; null is read as empty."""
    texts = [text or "" for text in column.to_pylist()]
    for start, stop in slices(np.fromiter(map(len, texts), np.int64, len(texts))):
        yield start, stop, texts[start:stop]


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over Arrow batches, giving the memory it has freed back to the system at its end.

    A worker process runs task after task and would otherwise keep what its largest one took.
    """

    def run_and_release(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            # Only the C library of GNU has it.
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run_and_release


def with_text_columns(
    docs: DataFrame,
    text_col: str,
    keep: list[str] | None,
    made: dict[str, str],
    compute: Callable[[list[str]], list],
) -> DataFrame:
    """The columns ``keep`` (all but the text if none are named) and those of ``made`` (name, type),
    which ``compute`` gives for a list of whole texts as one array or list for each. Kept columns
    pass through untouched; those named as in ``made``, whatever the case, are replaced."""
    taken = {name.lower() for name in made}
    keep = [
        name for name in (keep or docs.columns) if name != text_col and name.lower() not in taken
    ]
    kinds = [docs.sparkSession.createDataFrame([], f"c {kind}").schema[0].dataType for kind in made.values()]
    schema = docs.select(*keep).schema
    for name, kind in zip(made, kinds, strict=True):
        schema = schema.add(name, kind)
    arrow = [to_arrow_type(kind) for kind in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, texts in text_slices(batch.column(len(keep))):
                kept = [batch.column(place).slice(start, stop - start) for place in range(len(keep))]
                new = [pa.array(one, kind) for one, kind in zip(compute(texts), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, *new], [*keep, *made])

    return docs.select(*keep, text_col).mapInArrow(released(run), schema)


@cache
def letter_table() -> np.ndarray:
    """For each code point below 2**16: 0 if it is no letter, else the code of its lower case."""
    out = np.zeros(1 << 16, np.uint16)
    for point in range(1 << 16):
        if (char := chr(point)).isalpha():
            low = char.lower()
            out[point] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else point
    return out


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-case letters of all texts one after the other, 0 for what is no letter and between
    texts, and where each text starts. Letters beyond 2**16 all become one rare letter."""
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), np.uint32)
    wide = points >= 1 << 16
    folded = letter_table()[np.where(wide, 0, points)]
    if wide.any():
        alphabetic = [chr(point).isalpha() for point in points[wide]]
        folded[wide] = np.where(alphabetic, np.uint16(0xFFFF), np.uint16(0))
    starts = np.cumsum([0] + [len(text) + 1 for text in texts])
    return folded, starts


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a bijection)."""
    values = values ^ (values >> WIDE(30))
    values = values * WIDE(0xBF58476D1CE4E5B9)
    values = values ^ (values >> WIDE(27))
    values = values * WIDE(0x94D049BB133111EB)
    return values ^ (values >> WIDE(31))


STEP = 0x9E3779B97F4A7C15 | 1
STEP_BACK = pow(STEP, -1, 1 << 64)
BYTE_HASH = mixed(np.arange(1, 257, dtype=WIDE) * WIDE(0xD6E8FEB86659FD93))


def powers(base: int, count: int) -> np.ndarray:
    out = np.full(max(1, count), base, WIDE)
    out[0] = 1
    return np.cumprod(out, dtype=WIDE)


@cache
def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(STEP, size), powers(STEP_BACK, size)


class Words:
    """Words of many texts as arrays: ``hash``, ``doc`` (row), ``start`` and ``end`` (bytes), and
    ``first``: for each row the number of the words before it, and at the end that of all.

    A word is a longest run of ASCII letters and digits, "_", and characters outside ASCII but for
    U+0080-U+00BF, U+2000-U+2FFF and U+3000-U+303F.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        size = len(data)
        if size == 0:
            self.hash = np.zeros(0, WIDE)
            self.doc = self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(len(offsets), np.int64)
            return
        inside = word_bytes(data)
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[1:] > offsets[:-1]]
        starts[edges] = inside[edges]
        self.start = np.flatnonzero(starts)
        lasts = inside.copy()
        lasts[:-1] &= ~inside[1:]
        edges = edges[edges > 0] - 1
        lasts[edges] = inside[edges]
        self.end = np.flatnonzero(lasts) + 1
        ups, downs = _power_tables(1 << max(20, int(size).bit_length()))
        sums = np.zeros(size + 1, WIDE)
        np.cumsum(BYTE_HASH[data] * ups[:size], out=sums[1:])
        self.hash = mixed((sums[self.end] - sums[self.start]) * downs[self.start])
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))


def word_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to words."""
    kinds = np.zeros(256, bool)
    kinds[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
    inside = kinds[data]
    if len(data) and data.max() >= 0x80:
        for place in np.flatnonzero((data == 0xC2) | (data == 0xE2) | (data == 0xE3)):
            following = data[place + 1] if place + 1 < len(data) else 0
            if data[place] == 0xC2:
                inside[place : place + 2] = False
            elif (data[place] == 0xE2 and following < 0xC0) or following == 0x80:
                inside[place : place + 3] = False
    return inside


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capitals of ASCII and of U+00C0-U+00DE made small, byte for byte."""
    out = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    out[at] = data[at] + np.uint8(32)
    return out


def bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits with the bit of every hash's highest bits set, as 64-bit words; no
    more than 2**bits / 64 numbers reach the driver, whatever the number of hashes."""
    top = F.shiftrightunsigned(column, 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), top.bitwiseAND(63).cast("int"))
    words = hashes.groupBy(F.shiftrightunsigned(top, 6).alias("at")).agg(F.bit_or(one).alias("set"))
    out = np.zeros(1 << (bits - 6), np.int64)
    rows = words.toPandas()
    out[rows["at"].to_numpy(np.int64)] = rows["set"].to_numpy(np.int64)
    return out.view(WIDE)


def in_bitmap(words: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes have their bit set."""
    top = hashes >> WIDE(64 - bits)
    return ((words[top >> WIDE(6)] >> (top & WIDE(63))) & WIDE(1)).astype(bool)


def byte_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, UTF-8 bytes, offsets) of each slice of a text column."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    if len(column) == 0:
        return
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for start, stop in slices(np.diff(offsets)):
        own = offsets[start : stop + 1]
        yield start, stop, data[own[0] : own[-1]], own - own[0]


def runs_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` words in a row, by the first of them."""
    count = max(0, len(hashes) - width + 1)
    out = np.zeros(count, WIDE)
    for place, factor in enumerate(powers(STEP, width)):
        out += hashes[place : place + count] * factor
    return mixed(out)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Consecutive values as one list per row."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def fresh_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores added until no column has that name, whatever the case."""
    taken = {name.lower() for name in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
