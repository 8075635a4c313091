"""The audit of filter orders, order by order on single rows."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidings.llm import filter_audit
from tidings.llm.common import in_bitmap, table
from tidings.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def failed(rows, place):
    """The filters a row fails."""
    doc_id, text, _ = rows[place]
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = set()
    if len(words) < 50:
        out.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
        out.add("C")
    if re.search(r"[#$%&*|]", text):
        out.add("D")
    if doc_id is not None and any(
        other is not None and other < doc_id and (same or "") == text for other, same, _ in rows
    ):
        out.add("E")
    return out


def brute_force(rows, labels):
    fails = [failed(rows, place) for place in range(len(rows))]
    good = {doc_id for doc_id, quality, _ in labels if quality == 1 and doc_id is not None}
    toxic = {doc_id for doc_id, _, bad in labels if bad == 1 and doc_id is not None}
    out = {}
    for part in {row[2] or "" for row in rows}:
        own = [place for place, row in enumerate(rows) if (row[2] or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = set(own)
            for step, name in enumerate(order):
                here = {place for place in left if name in fails[place]}
                gone = {place for place in own if place not in left and name in fails[place]}
                left -= here
                shapley[name] += len(here)
                out[part, "".join(order), step + 1] = [
                    len(left), len(here), len(gone), sum(fails[place] == {name} for place in own),
                    sum(rows[place][0] in good for place in here), sum(rows[place][0] in toxic for place in here),
                ]
        for key, counts in out.items():
            if key[0] == part:
                counts.append(shapley[key[1][key[2] - 1]])
    return {key: tuple(counts) for key, counts in out.items()}


def as_dict(frame):
    out = {}
    for row in frame.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    ).collect():
        assert tuple(row[:3]) not in out
        out[tuple(row[:3])] = tuple(row[3:])
    return out


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    found = as_dict(QUERIES["op12_filter_audit"](spark, folder))
    with duckdb.connect() as db:
        for name in ("documents", "labels"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
        rows = db.execute(ORACLES["op12_filter_audit"]).fetchall()
    assert found == {row[:3]: row[3:] for row in rows}


def test_brute_force(spark):
    words = " ".join(f"word{place}" for place in range(60))
    rows = [
        (1, words, "a"), (2, words, "a"), (3, words, None), (3, words, ""), (1, words, "b"), (None, words, "a"),
        (4, None, "a"), (5, "", "b"), (None, None, "b"), (6, "A" * 10, "a"), (7, "a|b " * 60, "a"),
        (8, "again and again " * 30, "b"), (9, "again and again " * 30, "b"), (10, "\x0b\x0c \t", "b"),
        (11, "x" * 2_000_000, "a"), (12, "Éé  " * 70, None), (13, words.upper(), "a"), (14, words + "#", "a"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, 1, 1), (None, 1, 1), (9, None, 1), (13, 1, 0), (99, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5).withColumn("mask", F.lit("other")).withColumn("ID", F.lit(0))
    found = as_dict(filter_audit.audit(docs, spark.createDataFrame(labels, LABELS)))
    assert found == brute_force(rows, labels)


def test_crowd_of_copies(spark):
    """One text in most rows, of several parts, next to texts that occur once."""
    rows = [(place, "the same words again" if place % 3 else f"text {place}", f"s{place % 2}") for place in range(600)]
    found = as_dict(filter_audit.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS)))
    assert found["s1", "EABCD", 1][:2] == (101, 199)
    assert found["s0", "EABCD", 1][:2] == (100, 200)


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert filter_audit.audit(empty, spark.createDataFrame([], LABELS)).collect() == []


@pytest.mark.parametrize("bits", [10, 16])
def test_sketch_clears_no_repeat(spark, bits):
    """Whatever its size, every repeated text passes; a sketch of fair size clears most others."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    crowded = filter_audit.crowded_slots(docs, "hash", bits)
    assert len(crowded) == 1 << (bits - 6)
    hashes = [row.hash for row in docs.collect()]
    counts = Counter(hashes)
    passed = defaultdict(bool)
    for row in docs.select("hash", filter_audit.may_repeat(crowded, F.col("hash"), bits).alias("may")).collect():
        passed[row.hash] |= row.may
    assert all(passed[value] for value, n in counts.items() if n > 1)
    alone = [value for value, n in counts.items() if n == 1]
    if bits == 16:
        assert sum(passed[value] for value in alone) < 0.05 * len(alone)


def test_sketch_is_bounded():
    assert filter_audit.sketch_bits(0) == filter_audit.FEWEST_BITS
    assert filter_audit.sketch_bits(1 << 50) == filter_audit.MOST_BITS
    assert in_bitmap(np.zeros(1 << 10, np.uint64), np.zeros(1, np.uint64), 16).tolist() == [False]


def test_filters_of_rows_the_sketch_clears_are_not_evaluated_again(spark):
    rows = [(1, "s", "a a"), (2, "s", "once"), (3, "s", "a a"), (None, "s", "a a")]
    texts = spark.createDataFrame(rows, "id long, part string, text string").withColumn("hash", F.xxhash64("text"))
    # The rows come without their mask, which only those that may repeat are given.
    found = filter_audit.later_copies(texts, texts.select("hash")).collect()
    assert [tuple(row) for row in found] == [(3, "s", 3)]
