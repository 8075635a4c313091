"""How filters overlap, whatever the order they run in.

Each row gets one bit per filter it fails. What any order of the filters keeps and removes follows
from the number of rows per combination of bits, so texts are read for their bits alone and all
orders come from a few counts per part.

Whether a text repeats is the only costly bit. A counting Bloom sketch clears texts that certainly
occur once; only the rest are compared in full.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import WIDE, bitmap, in_bitmap
from tidings.session import pin

FILTERS = "ABCDE"
REPEAT = 1 << FILTERS.index("E")
FEWEST_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5
MARKS = r"[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Slots of the sketch per row, and the most of them (2**28 bits are 32 MB to look up in).
SLOTS_PER_ROW = 16
FEWEST_BITS, MOST_BITS = 16, 28


def own_filters(text: Column) -> Column:
    """Bits of the filters that a text fails by itself: A to D."""
    words = F.filter(F.split(text, BLANKS), lambda word: word != "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    n_chars = F.char_length(text)
    n_capitals = n_chars - F.char_length(F.translate(text, CAPITALS, ""))
    failed = [
        n_words < FEWEST_WORDS,
        100 * n_distinct < DISTINCT_PERCENT * n_words,
        100 * n_capitals > CAPITAL_PERCENT * n_chars,
        text.rlike(MARKS),
    ]
    return sum((F.when(one, 1 << place).otherwise(0) for place, one in enumerate(failed)), F.lit(0))


def sketch_bits(rows: int) -> int:
    """Bits of a slot number: ``SLOTS_PER_ROW`` slots a row as far as the bound allows."""
    return min(MOST_BITS, max(FEWEST_BITS, (SLOTS_PER_ROW * rows).bit_length()))


def slots(hash_: Column, bits: int) -> list[Column]:
    """The two slots of a hash as its highest bits, and as those of the hash hashed again."""
    rest = F.lit(-1 << (64 - bits))
    return [hash_.bitwiseAND(rest), F.xxhash64(hash_).bitwiseAND(rest)]


def crowded_slots(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of the slots in which two rows or more count.

    Every row counts in two slots. Each task adds up a sketch of its own and the sketches are added
    slot by slot; of the sum one bit a slot reaches the driver, 2**bits / 8 bytes at most.
    """
    counters = hashes.select(F.explode(F.array(*slots(F.col(column), bits))).alias("slot"))
    counters = counters.groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    return bitmap(counters.where("n > 1"), "slot", bits)


def may_repeat(crowded: np.ndarray, hash_: Column, bits: int) -> Column:
    """False where a text certainly occurs once: one of its slots has no other row."""

    @F.pandas_udf("boolean")
    def known(first: pd.Series, second: pd.Series) -> pd.Series:
        one, other = (column.to_numpy(np.int64).view(WIDE) for column in (first, second))
        return pd.Series(in_bitmap(crowded, one, bits) & in_bitmap(crowded, other, bits))

    return known(*slots(hash_, bits))


def later_copies(texts: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of ``texts`` (id, part, hash, text) whose text has a row of a smaller id, with their mask.

    ``marked`` has the hashes of all rows. Rows that the sketch clears are never shuffled. Of the
    others each task sends every text once, with its least id; the rows that are no least ones are
    then told by id and digest, so copies of one text are spread over all tasks.
    """
    bits = sketch_bits(marked.count())
    crowded = crowded_slots(marked, "hash", bits)
    kept = texts.where(may_repeat(crowded, F.col("hash"), bits) & F.col("id").isNotNull())
    # The filters of the rows that the sketch clears are not evaluated again.
    kept = pin(kept.select("id", "part", own_filters(F.col("text")).alias("mask"), "text"), "repeats")
    first = kept.groupBy("text").agg(F.min("id").alias("id"))
    first = first.select("id", F.sha2("text", 256).alias("digest"))
    found = kept.select("id", "part", "mask", F.sha2("text", 256).alias("digest"))
    return found.join(first, ["id", "digest"], "left_anti").select("id", "part", "mask")


def mask_counts(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    part_col: str = "source",
) -> DataFrame:
    """``part``, ``mask`` (a bit for each filter failed), ``good``, ``toxic`` and the number of rows.

    A null text is empty, a null part the empty string. Rows that share an id and a text are copies
    with no smaller id among them; a row without an id has no smaller or greater one, so it neither
    fails the repeat filter nor makes others fail it, and has no labels. An id is good or toxic if
    any of its label rows says so.
    """
    texts = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    own = texts.select("id", "part", own_filters(F.col("text")).alias("mask"), F.xxhash64("text").alias("hash"))
    marked = pin(own, "masks")
    copies = later_copies(texts.withColumn("hash", F.xxhash64("text")), marked)
    # A later copy leaves the count without the repeat bit and enters the one with it.
    changes = [
        marked.select("id", "part", "mask", F.lit(1).alias("n")),
        copies.select("id", "part", "mask", F.lit(-1).alias("n")),
        copies.select("id", "part", F.col("mask").bitwiseOR(REPEAT).alias("mask"), F.lit(1).alias("n")),
    ]
    all_changes = changes[0].unionAll(changes[1]).unionAll(changes[2])
    per_id = all_changes.groupBy("id", "part", "mask").agg(F.sum("n").alias("n")).where("n > 0")
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    told = per_id.join(known, "id", "left")
    flags = [F.coalesce(name, F.lit(False)).alias(name) for name in ("good", "toxic")]
    return told.select("part", "mask", *flags, "n").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def order_effects(counts: DataFrame) -> DataFrame:
    """For every part, order of the filters and step: what the step keeps and removes.

    Rows that pass a set of filters are added up once per set; a step removes the difference of two
    such sums. ``counts`` is as ``mask_counts`` gives it.
    """
    sets = range(1 << len(FILTERS))
    n, mask = F.col("n"), F.col("mask")

    def passing(of: Column) -> Column:
        """By set of filters, the rows that fail none of them."""
        return F.array(*(F.coalesce(F.sum(F.when((mask.bitwiseAND(one) == 0) & of, n)), F.lit(0)) for one in sets))

    bits = [1 << place for place in range(len(FILTERS))]
    alone = [F.sum(F.when(mask == bit, n).otherwise(0)) for bit in bits]
    # Of the orders a row's filters stand in, each of those it fails comes first equally often.
    share = factorial(len(FILTERS)) / F.bit_count(mask)
    fair = [F.sum(F.when(mask.bitwiseAND(bit) > 0, n * share).otherwise(0)) for bit in bits]
    sums = counts.groupBy("part").agg(
        passing(F.lit(True)).alias("rows"),
        passing(F.col("good")).alias("good"),
        passing(F.col("toxic")).alias("toxic"),
        F.array(*alone).alias("alone"),
        F.array(*(F.round(one).cast("long") for one in fair)).alias("fair"),
    )
    each = sums.select("*", F.inline(F.from_json(F.lit(json.dumps(all_steps())), STEP)))

    def lost(kind: str) -> Column:
        return F.get(kind, F.col("before")) - F.get(kind, F.col("after"))

    place = F.col("place")
    failing = F.get("rows", F.lit(0)) - F.get("rows", F.call_function("shiftleft", F.lit(1), place))
    return each.select(
        "part", "filter_order", "step",
        F.get("rows", F.col("after")).alias("kept"),
        lost("rows").alias("removed"),
        (failing - lost("rows")).alias("redundant"),
        F.get("alone", place).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("fair", place).alias("shapley"),
    )


STEP = "array<struct<filter_order: string, step: int, place: int, before: int, after: int>>"


def all_steps() -> list[dict]:
    """For every order and step: its number from 1 on, its filter's place, and the sets of filters up
    to the one before it and up to it."""
    return [
        {
            "filter_order": "".join(order),
            "step": step + 1,
            "place": FILTERS.index(name),
            "before": sum(1 << FILTERS.index(one) for one in order[:step]),
            "after": sum(1 << FILTERS.index(one) for one in order[: step + 1]),
        }
        for order in permutations(FILTERS)
        for step, name in enumerate(order)
    ]


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """All 120 orders of the five filters over every part of ``docs``; see ``mask_counts`` for nulls
    and repeated rows. An empty table has no part and gives no rows."""
    return order_effects(mask_counts(docs, labels, **columns))
