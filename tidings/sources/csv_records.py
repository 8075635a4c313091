"""Records of CSV files with line breaks inside fields, read by many tasks.

Where a record ends depends on all quotes before it, yet a line only asks one thing of them: whether
it begins inside a quoted field. So each file split first tells in which state it ends for either
state it may begin in; a running composition over the splits of a file gives the state each of them
does begin in, and with that every split cuts its own records. Only records that reach beyond a split
are put together from their pieces.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The rest of a quoted field, up to its closing quote or the end of the line.
QUOTED = re.compile(r'[^"]*+(?:""[^"]*+)*+')
SPLIT = ["file_path", "file_offset"]
# Lines or records sent on at once.
ROWS = 10_000


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside a quoted field or not ends inside one.

    A field is quoted if its first character is a quote; two quotes in it stand for one, and what
    follows the closing quote up to the next comma belongs to the field, quotes included.
    """
    place = 0
    while True:
        if not inside:
            if not line.startswith('"', place):
                place = line.find(',"', place) + 1
                if not place:
                    return False
            place += 1
        place = QUOTED.match(line, place).end()
        if place == len(line):
            return True
        inside = False
        place = line.find(",", place) + 1
        if not place:
            return False


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files, in order within each split."""
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("file_offset"),
        "value",
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _split_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, now, states, found = [*SPLIT, "from_outside", "from_inside"], None, (False, True), []
    for file, offset, line in _rows(batches):
        if (file, offset) != now:
            if now:
                found.append((*now, *states))
            now, states = (file, offset), (False, True)
        states = tuple(ends_inside(line, state) for state in states)
    if now:
        found.append((*now, *states))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(one) for one in zip(*found, strict=True)], names)


def inside_from(lines: DataFrame) -> DataFrame:
    """The stretches of each file in which splits begin inside a quoted field: ``after`` the split at
    one offset, up to the one at ``until`` (null: to the end of the file).

    Lines without quotes change nothing and are not looked at. A split keeps the state, swaps it, or
    sets it; the state after it is what the last one that sets it says, swapped as often as splits
    since then do.
    """
    ends = lines.where(F.contains("value", F.lit('"'))).mapInArrow(
        _split_ends, "file_path string, file_offset long, from_outside boolean, from_inside boolean"
    )
    order = Window.partitionBy("file_path").orderBy("file_offset")
    counted = ends.select(
        *SPLIT,
        F.expr("from_outside = from_inside").alias("sets"),
        F.col("from_outside").cast("int").alias("state"),
        F.sum(F.expr("CAST(from_outside AND NOT from_inside AS INT)")).over(order).alias("swaps"),
    )
    base = F.last(F.when(F.col("sets"), F.struct("state", "swaps")), ignorenulls=True).over(order)
    state = F.coalesce("base.state", F.lit(0)) + F.col("swaps") - F.coalesce("base.swaps", F.lit(0))
    after = counted.withColumn("base", base).select(*SPLIT, (state % 2 == 1).alias("inside"))
    stretches = after.withColumn("until", F.lead("file_offset").over(order)).where("inside")
    return stretches.select("file_path", F.col("file_offset").alias("after"), "until")


def _cut(batches: Iterator[pa.RecordBatch], begins: dict[str, list[tuple]]) -> Iterator[pa.RecordBatch]:
    """The records of each split: number, text, whether it ``goes_on`` in the next split, and whether
    it ``continues`` one of the split before. ``begins`` has the stretches of each file."""
    names = [*SPLIT, "row_in_split", "record", "goes_on", "continues"]
    now, inside, lines, number, head, made = None, False, [], 0, False, []

    def whole(goes_on: bool) -> int:
        text = "\n".join(lines)
        # An empty line is no record.
        if goes_on or head or text.rstrip("\r"):
            made.append((*now, number, text, goes_on, head))
            return number + 1
        return number

    def sent() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.large_string(), pa.bool_(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(one, kind) for one, kind in zip(zip(*made), kinds, strict=True)], names)

    for file, offset, line in _rows(batches):
        if (file, offset) != now:
            if lines:
                whole(True)
            stretches = begins.get(file, [])
            place = bisect_left(stretches, (offset,)) - 1
            inside = place >= 0 and (stretches[place][1] is None or offset <= stretches[place][1])
            now, lines, number, head = (file, offset), [], 0, inside
        lines.append(line)
        if inside or '"' in line:
            inside = ends_inside(line, inside)
        if not inside:
            number = whole(False)
            lines, head = [], False
            if len(made) >= ROWS:
                yield sent()
                made.clear()
    if lines:
        whole(True)
    if made:
        yield sent()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the files: ``record`` (its text), ``file_path``, ``file_offset`` and
    ``row_in_split``, which sorted give file order. Empty lines are no records. A quote that is never
    closed takes the rest of the file, but for its last line break.

    Only the stretches reach the driver, one narrow row for each split at most. The lines are read
    twice, and once more where records reach beyond a split; only the pieces of those are shuffled.
    """
    lines = csv_lines(spark, path)
    begins: dict[str, list[tuple]] = {}
    for file, after, until in inside_from(lines).orderBy("file_path", "after").collect():
        begins.setdefault(file, []).append((after, until))
    found = lines.mapInArrow(
        lambda batches: _cut(batches, begins),
        "file_path string, file_offset long, row_in_split long, record string, goes_on boolean, continues boolean",
    )
    names = [*SPLIT, "row_in_split", "record"]
    if not begins:
        return found.select(*names)
    whole = found.where("NOT goes_on AND NOT continues").select(*names)
    upto = Window.partitionBy("file_path").orderBy("file_offset", "row_in_split")
    starts = F.sum((~F.col("continues")).cast("int")).over(upto)
    pieces = found.where("goes_on OR continues").withColumn("start", starts)
    order = F.struct("file_offset", "row_in_split", "record")
    joined = pieces.groupBy("file_path", "start").agg(F.array_sort(F.collect_list(order)).alias("pieces"))
    first = F.get("pieces", F.lit(0))
    joined = joined.select(
        "file_path",
        *(first[name].alias(name) for name in ("file_offset", "row_in_split")),
        F.array_join("pieces.record", "\n").alias("record"),
    )
    return whole.unionByName(joined)
