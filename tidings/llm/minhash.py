"""Near-duplicate documents by MinHash, verified, and joined into components.

Texts with equal shingle sets are one class from the start. Each class has many universal hash
minima, cut into bands; classes that share a band are candidates. Every bucket sets one pivot against
its members, and a pair is checked by its signatures and then on its full sets; a crowd of copies is
done with that. In buckets that still hold several components the rest is settled exactly, without
all pairs: two sets that have a rare shingle in common meet by the rarest one they share, and two
that have none can only be linked if most of each is common, which few pairs outside one component
are. Those meet in rounds of ever more pivots.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.llm.common import (
    BYTE_HASH, STEP, STEP_BACK, WIDE, bitmap, byte_slices, in_bitmap, lists, mixed, powers,
    released,
)
from tidings.llm.graph import components
from tidings.session import pin

WORDS = 3
# Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
RECALL = 0.999999
ROWS = 5
# A shingle of so many sets at most is rare.
RARE = 8
# How many times as many pivots a bucket has in each round as in the one before.
GROWTH = 32
# Where members would meet so many others on average, in buckets of so many at most, all of them meet.
FEW_MET, FEW_MEMBERS = 64, 4096
# So many pairs at most tell by broadcast (2 MB of numbers for either side) which sets are needed; of
# more pairs all sets are sent to their joins.
FEW_PAIRS = 1 << 18
# A linked pair's signatures disagree more than the least agreement allows once in 10**9 pairs.
DEVIATIONS = 6.0
# Bits of the map of the documents that candidates are read from (2 MB).
WANTED_BITS = 24


def bands_for(percent: int = PERCENT, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` minima with which a pair at the threshold shares one with ``recall``."""
    return ceil(log(1 - recall) / log(1 - (percent / 100) ** rows))


def least_agreement(percent: int, minima: int) -> int:
    """Equal minima that the signatures of a linked pair have at least."""
    chance = percent / 100
    return max(0, int(minima * chance - DEVIATIONS * (minima * chance * (1 - chance)) ** 0.5))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of every text, by row; words are what blanks (space and
    U+0009 to U+000D) leave, with A-Z in lower case, and a text of fewer than ``width`` words is one
    shingle."""
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    size, rows = len(data), len(offsets) - 1
    inside = (data != 32) & ((data < 9) | (data > 13))
    # A word ends with its text; the place of a blank after every text makes that so.
    place = np.arange(size) + np.repeat(np.arange(rows), np.diff(offsets))
    spread = np.zeros(size + rows + 1, bool)
    spread[place[inside] + 1] = True
    starts = np.flatnonzero(spread[1:] & ~spread[:-1])
    ends = np.flatnonzero(spread[:-1] & ~spread[1:])
    if len(ends) < len(starts):
        ends = np.append(ends, len(spread) - 1)
    edges = offsets + np.arange(rows + 1)
    row = np.searchsorted(edges, starts, "right") - 1
    bytes_ = powers(STEP, size + 1)
    sums = np.zeros(size + 1, WIDE)
    np.cumsum(BYTE_HASH[data] * bytes_[:size], out=sums[1:])
    first, last = starts - row, ends - row
    words = mixed((sums[last] - sums[first]) * powers(STEP_BACK, size + 1)[first])
    runs = np.zeros(max(0, len(words) - width + 1), WIDE)
    for step, factor in enumerate(powers(STEP, width)):
        runs += words[step : step + len(runs)] * factor
    whole = row[: len(runs)] == row[len(words) - len(runs) :]
    found_rows, found = [row[: len(runs)][whole]], [mixed(runs[whole])]
    begins = np.searchsorted(row, np.arange(rows + 1))
    for few in range(1, width):
        short = np.flatnonzero(np.diff(begins) == few)
        total = np.full(len(short), few, WIDE)
        for step, factor in enumerate(powers(STEP, few)):
            total += words[begins[short] + step] * factor
        found_rows.append(short)
        found.append(mixed(total))
    owner, hashes = np.concatenate(found_rows), np.concatenate(found)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new]


def set_keys(hashes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums by which equal sets are known."""
    return [np.add.reduceat(mixed(hashes + WIDE(seed)), starts) for seed in (1, 2)]


def minima(hashes: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """The least value of each of ``count`` universal hashes (odd factor, shift, high bits) per set."""
    factors = mixed(np.arange(1, count + 1, dtype=WIDE)) | WIDE(1)
    shifts = mixed(np.arange(10_001, count + 10_001, dtype=WIDE))
    out = np.empty((len(starts), count), WIDE)
    for place in range(count):
        out[:, place] = np.minimum.reduceat((hashes * factors[place] + shifts[place]) >> WIDE(24), starts)
    return out


def band_marks(values: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A hash of each band and its minima."""
    steps = powers(STEP, rows + 1)[1:]
    cut = values.reshape(len(values), bands, rows)
    return mixed((cut * steps).sum(axis=2, dtype=WIDE) + mixed(np.arange(1, bands + 1, dtype=WIDE)))


def sketches(texts: DataFrame, words: int, rows: int, bands: int) -> DataFrame:
    """``texts`` (doc, text) as doc, hi, lo (null for an empty set), size and the marks of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in byte_slices(batch.column(1)):
                owner, hashes = shingle_sets(data, offsets, words)
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                sizes = np.bincount(owner, minlength=stop - start)
                some = sizes > 0
                keys, marks = np.zeros((2, stop - start), WIDE), np.zeros((0, bands), WIDE)
                if len(starts):
                    keys[:, some] = set_keys(hashes, starts)
                    marks = band_marks(minima(hashes, starts, rows * bands), rows, bands)
                arrays = [
                    batch.column(0).slice(start, stop - start),
                    *(pa.array(one.view(np.int64), mask=~some) for one in keys),
                    pa.array(sizes.astype(np.int64)),
                    lists(marks.ravel().view(np.int64), some * bands, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc", "hi", "lo", "size", "marks"])

    kind = texts.schema["doc"].dataType.simpleString()
    return texts.mapInArrow(released(run), f"doc {kind}, hi long, lo long, size long, marks array<long>")


def full_sets(texts: DataFrame, classes: DataFrame, words: int, count: int) -> DataFrame:
    """rep, the full shingle set and the signature (a byte of each minimum) of each of ``classes`` (rep,
    first_doc, hi, lo), from the text of its first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in byte_slices(batch.column(1)):
                owner, hashes = shingle_sets(data, offsets, words)
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                if not len(starts):
                    continue
                least = minima(hashes, starts, count).astype(np.uint8).view(np.int8)
                arrays = [
                    batch.column(0).slice(start, stop - start).take(pa.array(owner[starts])),
                    *(pa.array(one.view(np.int64)) for one in set_keys(hashes, starts)),
                    lists(hashes.view(np.int64), np.diff([*starts, len(owner)]), pa.int64()),
                    lists(least.ravel(), np.full(len(starts), count), pa.int8()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc", "hi", "lo", "shingles", "signature"])

    kind = texts.schema["doc"].dataType.simpleString()
    wanted = classes.select(F.col("first_doc").alias("wanted")).distinct()
    # Few documents are wanted, so most texts are passed over before they would travel to the join.
    listed = bitmap(wanted.select(F.xxhash64("wanted").alias("hash")), "hash", WANTED_BITS)

    @F.pandas_udf("boolean")
    def may_be_wanted(hashes: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(listed, hashes.to_numpy(np.int64).view(WIDE), WANTED_BITS))

    chosen = texts.where(may_be_wanted(F.xxhash64("doc")))
    chosen = chosen.join(wanted, F.col("doc").eqNullSafe(F.col("wanted")), "left_semi")
    made = chosen.mapInArrow(released(run), f"doc {kind}, hi long, lo long, shingles array<long>, signature array<tinyint>")
    known = classes.select("rep", F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), "first_doc")
    same = (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo"))
    known = F.broadcast(known) if classes.count() <= FEW_PAIRS else known
    found = made.join(known, same & F.col("doc").eqNullSafe(F.col("first_doc")))
    return found.select("rep", "shingles", "signature")


def _needed(sets: DataFrame, reps: DataFrame, few: bool) -> DataFrame:
    """The sets of ``reps``, or all where there are many."""
    return sets.join(F.broadcast(reps), "rep", "left_semi") if few else sets


def find_links(pairs: DataFrame, sets: DataFrame, percent: int, agreement: int) -> DataFrame:
    """The pairs (rep, p_rep) whose signatures agree enough and whose full sets are similar enough, as
    (a, b)."""
    pairs = pin(pairs, "pairs")
    few = pairs.count() <= FEW_PAIRS
    own = _needed(sets, pairs.select("rep"), few)
    others = _needed(sets, pairs.select(F.col("p_rep").alias("rep")), few)
    others = others.withColumnsRenamed({name: f"p_{name}" for name in others.columns})
    equal = F.zip_with("signature", "p_signature", lambda one, other: (one == other).cast("int"))
    agreeing = F.aggregate(equal, F.lit(0), lambda total, one: total + one)
    shared = F.size(F.array_intersect("shingles", "p_shingles")).cast("long")
    similar = 100 * shared >= percent * (F.size("shingles") + F.size("p_shingles") - shared)
    linked = F.when(agreeing >= agreement, similar).otherwise(False)
    found = pairs.join(own, "rep").join(others, "p_rep").where(linked)
    return pin(found.select(F.col("rep").alias("a"), F.col("p_rep").alias("b")), "links")


def _possible(percent: int, one: tuple[str, str], other: tuple[str, str]) -> Column:
    """Whether two sets can be linked that share no more than the lesser of their parts named: columns
    of the size and of the part of each."""
    shared = F.least(one[1], other[1])
    return 100 * shared >= percent * (F.col(one[0]) + F.col(other[0]) - shared)


def _as_pairs(met: DataFrame) -> DataFrame:
    return met.select("rep", "p_rep").distinct()


def _pivots(active: DataFrame, parts: int) -> DataFrame:
    """The set of the highest rank in each of the random parts of a bucket."""
    columns = [name for name in active.columns if name not in ("mark", "rank", "n")]
    part = F.pmod(F.xxhash64("rep"), F.lit(parts))
    order = F.struct("rank", *columns)
    found = active.groupBy("mark", part.alias("part")).agg(F.max(order).alias("pivot"))
    return found.select("mark", *(F.col(f"pivot.{name}").alias(f"p_{name}") for name in columns))


def _unsettled(active: DataFrame) -> DataFrame:
    """The members (with ``root``) of buckets that hold several components, and their number ``n``."""
    buckets = active.groupBy("mark").agg(
        F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("n")
    )
    return pin(active.join(buckets.where("least < most").select("mark", "n"), "mark"), "unsettled")


def _with_roots(active: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return active
    new = roots.withColumnRenamed("root", "new")
    return active.join(new, "rep", "left").withColumn("root", F.coalesce("new", "root")).drop("new")


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The roots after more links."""
    if links.isEmpty():
        return roots
    if roots is not None:
        links = links.unionAll(roots.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    return pin(components(links).withColumnRenamed("node", "rep"), "roots")


def find_roots(
    members: DataFrame, bands: DataFrame, sets: DataFrame, percent: int, agreement: int
) -> DataFrame | None:
    """(rep, root) of every class of ``members`` (mark, rep, size) that is linked with others and not
    the root of its component; None if nothing is linked. ``bands`` has all marks of each class.

    In the first round a bucket's pivot is the member that shares most bands with any others, which in
    a crowd is one near its middle.
    """
    rank = F.count(F.lit(1)).over(Window.partitionBy("rep"))
    active = pin(members.select("*", rank.alias("rank"), F.col("rep").alias("root")), "active")
    met = active.join(_pivots(active, 1), "mark").where("rep <> p_rep")
    sizes = ("size", "size"), ("p_size", "p_size")
    roots = _merged(None, find_links(_as_pairs(met.where(_possible(percent, *sizes))), sets, percent, agreement))
    rest = _unsettled(_with_roots(met.select("mark", "rep", "size", "root"), roots))
    if rest.isEmpty():
        return roots
    known = pin(rest.select("rep", "size", "root").distinct(), "known")
    rare = pin(_rare_shingles(sets, known), "rare")
    few = rare.groupBy("rep").agg(F.count(F.lit(1)).alias("rare"), F.count_if(F.col("n_sets") == 1).alias("single"))
    known = known.join(few, "rep", "left").na.fill(0, ["rare", "single"])
    known = pin(known.withColumn("frequent", F.col("size") - F.col("rare")), "known")
    pairs = _pairs_by_rare_shingles(rare.where("n_sets > 1"), known, percent)
    likely = known.where(100 * F.col("frequent") >= percent * F.col("size")).join(bands, "rep")
    likely = likely.select("rep", "frequent", "marks", (F.col("frequent") / F.col("size")).alias("rank"))
    active = rest.drop("n").join(likely, "rep")
    parts, together = GROWTH, False
    while not together:
        active = _unsettled(active)
        average, largest = active.agg(F.avg("n"), F.max("n")).first()
        if largest is None:
            return roots if pairs is None else _merged(roots, find_links(pairs, sets, percent, agreement))
        together = average <= FEW_MET and largest <= FEW_MEMBERS
        columns = ["rep", "size", "root", "frequent", "marks"]
        pivots = active.select("mark", *(F.col(name).alias(f"p_{name}") for name in columns)) if together else pin(_pivots(active, parts), "pivots")
        possible = _possible(percent, ("size", "frequent"), ("p_size", "p_frequent"))
        # Two sets may share many bands; they meet by the first of them.
        first = F.get(F.array_intersect("marks", "p_marks"), F.lit(0)) == F.col("mark")
        met = active.join(pivots, "mark").where((F.col("root") != F.col("p_root")) & possible & first)
        if together:
            met = met.where("rep < p_rep")
        more = _as_pairs(met)
        pairs = more if pairs is None else pairs.unionAll(more).distinct()
        roots = _merged(roots, find_links(pairs, sets, percent, agreement))
        done = pivots.select("mark", F.col("p_rep").alias("rep"))
        active = _with_roots(active.drop("n").join(done, ["mark", "rep"], "left_anti"), roots)
        parts, pairs = parts * GROWTH, None
    return roots


def _rare_shingles(sets: DataFrame, known: DataFrame) -> DataFrame:
    """rep, shingle and its number of sets, for the rare shingles of the sets ``known``.

    31 bits of a shingle's hash will do: shingles that share them are taken for one, which is as rare as
    they are together, and no shared shingle is overlooked.
    """
    wanted = known.select("rep")
    wanted = F.broadcast(wanted) if known.count() <= FEW_PAIRS else wanted
    short = F.col("long").bitwiseAND((1 << 31) - 1).cast("int").alias("shingle")
    each = sets.join(wanted, "rep", "left_semi").select("rep", F.explode("shingles").alias("long")).select("rep", short)
    counted = each.groupBy("shingle").agg(F.count(F.lit(1)).cast("int").alias("n_sets")).where(F.col("n_sets") <= RARE)
    return each.join(counted, "shingle")


def _pairs_by_rare_shingles(rare: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of different components that may be linked and have a rare shingle in common.

    Linked sets share so much that the rarest shingle they share is among the rarest of either: no
    more shingles come before it than the set may have for itself, those of its own (``single``) first.
    So only those are looked up, and a shingle has ``RARE`` sets at most.
    """
    place = F.row_number().over(Window.partitionBy("rep").orderBy("n_sets", "shingle"))
    spare = F.floor(F.col("size") * (100 - percent) / 100)
    first = rare.join(known, "rep").withColumn("place", place).where(F.col("place") + F.col("single") <= spare + 1)
    first = first.select("shingle", "rep", "size", "root")
    other = first.select("shingle", *(F.col(name).alias(f"p_{name}") for name in ("rep", "size", "root")))
    sizes = ("size", "size"), ("p_size", "p_size")
    met = first.join(other, "shingle").where((F.col("rep") < F.col("p_rep")) & (F.col("root") != F.col("p_root")))
    return _as_pairs(met.where(_possible(percent, *sizes)))


def deduplicate(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    words: int = WORDS,
    percent: int = PERCENT,
    recall: float = RECALL,
    rows: int = ROWS,
) -> DataFrame:
    """For every row: doc_id, ``n_shingles`` (the size of its set), ``component_id`` (the least doc_id
    of the documents it is linked with, directly or through others, its own included) and ``kept``
    (whether that is its own).

    A-Z are compared in lower case. A text without words (null, empty, blanks) has the empty set and
    is linked with nothing. Rows that share a doc_id are documents of their own. A null doc_id counts
    as greater than any other; a component of such rows only has none and all its rows are kept.
    """
    bands = bands_for(percent, recall, rows)
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    marks = pin(sketches(texts, words, rows, bands), "sketches")
    classes = (
        marks.where("hi IS NOT NULL")
        .groupBy("hi", "lo")
        .agg(F.first("marks").alias("marks"), F.first("size").alias("size"), F.min("doc").alias("first_doc"))
        .withColumn("rep", F.monotonically_increasing_id())
    )
    classes = pin(classes, "classes")
    buckets = classes.select("rep", "size", F.explode("marks").alias("mark"))
    full = buckets.groupBy("mark").agg(F.min("rep").alias("least"), F.max("rep").alias("most"))
    members = pin(buckets.join(full.where("least < most").select("mark"), "mark", "left_semi"), "members")
    candidates = classes.drop("marks", "size").join(members.select("rep").distinct(), "rep", "left_semi")
    sets = pin(full_sets(texts, pin(candidates, "candidates"), words, rows * bands), "sets")
    all_marks = classes.select("rep", "marks")
    roots = find_roots(members, all_marks, sets, percent, least_agreement(percent, rows * bands))
    named = classes.select("rep", "hi", "lo", "first_doc")
    if roots is None:
        named = named.withColumn("component_id", F.col("first_doc"))
    else:
        named = named.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        least = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
        named = named.join(least, "root")
    found = marks.select(F.col("doc").alias("doc_id"), "size", "hi", "lo")
    found = found.join(named.select("hi", "lo", F.col("component_id").alias("least")), ["hi", "lo"], "left")
    component = F.when(F.col("hi").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    found = found.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
