"""CSV records cut by many tasks against the reader that takes each file in one task."""

import csv
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidings.sources.csv_records import ends_inside
from tidings.sources.tables import CSV_OPTIONS, read_csv, with_ordinals

FIELDS = ['plain', '"quoted"', '"a, b"', '"two\nlines"', '"""said"""', '""', '', '"x""\n""y"', '5" disk', 'é', '"\n\n\n"', '"end"" \n"']


def in_one_task(spark, path):
    table = spark.read.options(**CSV_OPTIONS).csv(path, inferSchema=False, multiLine=True).coalesce(1)
    return [tuple(row) for row in table.collect()]


def in_many(spark, path, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        found = with_ordinals(read_csv(spark, path, multi_line=True))
        rows = found.orderBy("row_in_file").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [row.row_in_file for row in rows] == list(range(len(rows)))
    return [tuple(row[: len(found.columns) - 4]) for row in rows], len({row.file_offset for row in rows})


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", range(3))
def test_any_split(spark, tmp_path, seed, ending):
    rng = random.Random(seed)
    lines = [",".join(rng.choice(FIELDS) for _ in range(3)) + ending for _ in range(600)]
    lines.insert(300, '"' + "a long field of many lines\n" * 300 + '",1,2' + ending)
    lines.insert(100, ending + ending)
    path = tmp_path / "a.csv"
    path.write_bytes(("a,b,c" + ending + "".join(lines)).encode())
    expected = in_one_task(spark, str(path))
    for size in ("128m", "3k", "700"):
        found, splits = in_many(spark, str(path), size)
        assert found == expected
        assert size == "128m" or splits > 4


def test_several_files_and_odd_ends(spark, tmp_path):
    texts = ['t,u\n"a\nb",1\n', 't,u\nx,"never closed\nand on', "t,u\n", 't,u\r\n"r\r\nn",\r\n,2', "﻿t,u\n1,2\n3\n4,5,6\n"]
    for place, text in enumerate(texts):
        (tmp_path / f"{place}.csv").write_bytes(text.encode())
        expected = in_one_task(spark, str(tmp_path / f"{place}.csv"))
        for size in ("1m", "9"):
            assert in_many(spark, str(tmp_path / f"{place}.csv"), size)[0] == expected, text
    both = read_csv(spark, str(tmp_path), multi_line=True)
    assert both.columns[:2] == ["t", "u"]
    assert both.count() == 1 + 1 + 0 + 2 + 3


def test_written_and_read_again(spark, tmp_path):
    """What a writer quotes comes back field by field."""
    rng = random.Random(9)
    rows = [["".join(rng.choice('ab,"\n é') for _ in range(rng.randint(1, 30))) for _ in range(4)] for _ in range(2000)]
    path = tmp_path / "a.csv"
    with path.open("w", newline="") as file:
        csv.writer(file, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows([["a", "b", "c", "d"], *rows])
    found, splits = in_many(spark, str(path), "5k")
    assert splits > 10
    assert found == [tuple(row) for row in rows]


def test_fields_are_parsed_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"x\ny",2\n')
    plan = read_csv(spark, str(tmp_path), multi_line=True).where("a <> ''")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_csv") <= 2


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(['"', ",", "a", " "]), max_size=14), st.booleans())
def test_state_of_a_line(chars, inside):
    """A character at a time: at the start of a field, in an unquoted or quoted one, or after a quote."""
    state = "quoted" if inside else "start"
    for char in chars:
        if state == "quoted":
            state = "after" if char == '"' else "quoted"
        elif state == "after" and char == '"':
            state = "quoted"
        elif char == ",":
            state = "start"
        else:
            state = "quoted" if state == "start" and char == '"' else "unquoted"
    assert ends_inside("".join(chars), inside) == (state == "quoted")
