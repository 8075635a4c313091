"""Row numbers and running maxima over groups too large for one task.

A plain window puts a whole group into one task. Here the rows are range-partitioned on group and
order, so a large group spreads over many partitions; each partition is scanned on its own and
shifted by what the partitions before it hold. Frames are written, range-shuffled and written
again, so callers pass keys and order columns only and join the result back by ``rejoin``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.session import pin

PLACE = "_place"
SEGMENT = "_segment"
# A row identifier holds the partition above this bit and the row in the partition below it.
ROW_BITS = 33


def _lay_out(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``df`` sorted over its range partitions, with the place of each row; written once."""
    keys = [F.col(name).asc_nulls_first() for name in by] + order
    # Range partitioning reads its input twice, once to sample it, so that is written first.
    sorted_rows = pin(df, "unplaced").repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = pin(sorted_rows.withColumn("_id", F.monotonically_increasing_id()), "positions")
    return placed.select(
        *df.columns,
        F.shiftright("_id", ROW_BITS).alias(SEGMENT),
        F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias(PLACE),
    )


def _per_segment(rows: DataFrame, by: list[str], *aggregates: Column) -> DataFrame:
    """One row per (partition, group): ``_shift`` turns a place into a position in the group."""
    found = rows.groupBy(SEGMENT, *by).agg(
        F.min(PLACE).alias("_first"), F.count(F.lit(1)).alias("_n"), *aggregates
    )
    before = F.coalesce(F.sum("_n").over(_earlier(by)), F.lit(0))
    return found.withColumn("_shift", before - F.col("_first") + 1).drop("_first", "_n")


def _earlier(by: list[str]):
    """Earlier partitions of a group: one row per partition at most, so the window is small."""
    return (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy(SEGMENT)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def _join_segments(rows: DataFrame, segments: DataFrame, by: list[str]) -> DataFrame:
    """Bring per-segment values to the rows. Spark broadcasts the segments while they are small;
    beyond that no (partition, group) pair is larger than one range partition."""
    keys = [SEGMENT, *by]
    names = {key: f"_of{place}" for place, key in enumerate(keys)}
    segments = segments.withColumnsRenamed(names)
    on = [F.col(key).eqNullSafe(F.col(names[key])) for key in keys]
    return rows.join(segments, on).drop(*names.values())


def rejoin(df: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    """Bring the columns added to a narrow frame back to ``df``; ``key`` is unique on both sides."""
    added = [name for name in placed.columns if name not in df.columns]
    if set(df.columns) <= set(placed.columns):
        return placed.select(*df.columns, *added)
    return df.join(placed.select(key, *added), key).select(*df.columns, *added)


def with_position(
    df: DataFrame, by: list[str], order: list[Column], name: str = "position"
) -> DataFrame:
    """Add the 1-based position of each row in its group, in the given total order."""
    rows = _lay_out(df, by, order)
    numbered = _join_segments(rows, _per_segment(rows, by), by)
    return numbered.select(*df.columns, (F.col(PLACE) + F.col("_shift")).alias(name))


# Parts of a group of which ``first_of_group`` takes the first rows before it orders what is left.
PARTS = 1024


def first_of_group(
    df: DataFrame, by: list[str], order: list[Column], n: int, name: str | None = None
) -> DataFrame:
    """The first ``n`` rows of each group in the given total order, with their places if ``name`` is
    given.

    A group is dealt to parts by hash and each keeps ``n`` rows; where ``n`` is small every task drops
    most of its rows before they travel. What is left is numbered over range partitions, so no task
    holds a whole group, whatever ``n`` is. Rows travel with all their columns; pass narrow frames.
    """
    part = fresh_column(df, "part")
    dealt = df.withColumn(part, F.pmod(F.xxhash64(*df.columns), F.lit(PARTS)))
    place = F.row_number().over(Window.partitionBy(*by, part).orderBy(*order))
    left = dealt.withColumn(PLACE, place).where(F.col(PLACE) <= n).select(*df.columns)
    place = name or fresh_column(df, "position")
    found = with_position(left, by, order, place).where(F.col(place) <= n)
    return found if name else found.drop(place)


# Characters by which ``least_keys`` looks further into the keys in each round.
STEP = 3
ABOVE_ALL = "~"


def least_keys(df: DataFrame, by: list[str], key: str, n: int) -> DataFrame:
    """The rows with the ``n`` least values of ``key`` in each group; ``key`` is a text of hexadecimal
    digits, all of one length and unique in its group.

    The ``n``-th least key is found by counting: rows are counted by the first digits of their keys,
    the counts tell with which digits the ``n``-th one begins, and the next round counts the keys
    that begin so by their further digits. Counts are added up in every task before they travel,
    4,096 a group at most, and one filter then takes the rows; so no row is ever shuffled.
    """
    if n <= 0:
        return df.limit(0)
    names = {name: f"_{name}" for name in by}
    same = [F.col(name).eqNullSafe(F.col(other)) for name, other in names.items()]
    rows = df.select(*by, F.col(key).alias("_key")).withColumns({"_begin": F.lit(""), "_left": F.lit(n).cast("long")})
    length, bounds = 0, []
    while True:
        length += STEP
        digits = F.substring("_key", 1, length).alias("digits")
        counted = rows.groupBy(*by, "_left", digits).agg(F.count(F.lit(1)).alias("n"))
        buckets = F.array_sort(F.collect_list(F.struct("digits", "n")))
        found = counted.groupBy(*by, "_left").agg(_nth_bucket(buckets, F.col("_left")).alias("at"))
        found = pin(found.select(*by, "at.*"), "bounds")
        bounds.append(found.where("done").select(*by, F.concat("begin", F.lit(ABOVE_ALL)).alias("_upto")))
        further = found.where("NOT done").withColumnsRenamed(names)
        if further.isEmpty():
            break
        rows = df.select(*by, F.col(key).alias("_key")).join(further.select(*names.values(), "begin", "left"), same)
        rows = rows.where(F.startswith("_key", "begin")).select(*by, "_key", F.col("left").alias("_left"))
    upto = reduce(DataFrame.unionAll, bounds).withColumnsRenamed(names)
    return df.join(upto, [*same, F.col(key) <= F.col("_upto")], "left_semi")


def _nth_bucket(buckets: Column, n: Column) -> Column:
    """Where the ``n``-th row lies: the digits its bucket begins with, how many rows of the bucket are
    among the first ``n``, and whether those are all, or the buckets end before."""
    start = F.struct(F.lit("").alias("begin"), n.alias("left"), F.lit(0).cast("long").alias("size"))

    def step(state: Column, bucket: Column) -> Column:
        after = state["left"] - state["size"]
        there = F.struct(bucket["digits"].alias("begin"), after.alias("left"), bucket["n"].alias("size"))
        return F.when(after > 0, there).otherwise(state)

    def told(state: Column) -> Column:
        begin = F.when(state["left"] > state["size"], "").otherwise(state["begin"])
        return F.struct(begin.alias("begin"), state["left"].alias("left"), (state["left"] >= state["size"]).alias("done"))

    return F.aggregate(buckets, start, step, told)


def fresh_column(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = f"_{name}"
    return name


def paced_starts(
    df: DataFrame, by: list[str], order: list[Column], arrival: str, gap: int
) -> DataFrame:
    """Add ``start``: the first time at or after ``arrival`` that lies ``gap`` or more after the
    start of the row before it in the group; both are whole numbers of the same unit.

    With i the position in the group, start(i) = i*gap + max over j <= i of arrival(j) - j*gap, so
    a running maximum answers it.
    """
    rows = _lay_out(df, by, order).withColumn("_slack", F.col(arrival) - F.col(PLACE) * gap)
    highest = F.max("_slack").over(Window.partitionBy(SEGMENT, *by).orderBy(PLACE))
    top = F.max("_slack").alias("_top")
    segments = _per_segment(rows, by, top).withColumn("_top", F.col("_top") - F.col("_shift") * gap)
    segments = segments.withColumn("_floor", F.max("_top").over(_earlier(by))).drop("_top")
    paced = _join_segments(rows.withColumn("_highest", highest), segments, by)
    start = (F.col(PLACE) + F.col("_shift")) * gap + F.greatest(
        F.col("_highest") - F.col("_shift") * gap, F.col("_floor")
    )
    return paced.select(*df.columns, start.alias("start"))
