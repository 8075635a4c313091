import random

import pytest
from pyspark.sql import functions as F

from tidings.operators import corpus as C
from tidings.operators import requests as Q
from tidings.operators.positions import first_of_group, least_keys, with_position
from tidings.session import job_folder, pin, scratch_path


@pytest.fixture(scope="module", autouse=True)
def many_partitions(spark):
    """Small test partitions would otherwise be merged into one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, some keys one row, one key is NULL."""
    rng = random.Random(7)
    keys = ["hot"] * 900 + [f"k{i}" for i in range(60)] + [None] * 40
    rows = [(i, key, rng.randrange(50)) for i, key in enumerate(keys)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id int, k string, v int").repartition(13)


def test_positions_match_brute_force(spark, skewed):
    placed = with_position(skewed, ["k"], [F.col("v").desc(), F.col("id").asc()])
    got = {row["id"]: row["position"] for row in placed.collect()}
    groups = {}
    for row in skewed.collect():
        groups.setdefault(row["k"], []).append((-row["v"], row["id"]))
    want = {
        id_: place
        for rows in groups.values()
        for place, (_, id_) in enumerate(sorted(rows), start=1)
    }
    assert got == want


@pytest.mark.parametrize("partitions", ["1", "2", "5"])
def test_positions_without_groups(spark, skewed, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        placed = with_position(skewed.select("id"), [], [F.col("id").asc()]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {row["id"]: row["position"] for row in placed} == {i: i + 1 for i in range(1000)}


def test_a_hot_group_spreads_over_partitions(spark, skewed):
    from tidings.operators.positions import SEGMENT, _lay_out

    rows = _lay_out(skewed, ["k"], [F.col("id").asc()])
    assert rows.where("k = 'hot'").select(SEGMENT).distinct().count() > 1


def make_requests(spark, rows):
    frame = spark.createDataFrame(rows, "request_id int, api_key_id string, us bigint")
    return frame.withColumn("arrival_ts", F.timestamp_micros("us"))


def test_pace_equals_the_sequential_loop(spark):
    rng = random.Random(3)
    rows = [
        (i, rng.choice(["hot", "hot", "hot", "cold"]), rng.randrange(4_000) * 1_000_000)
        for i in range(800)
    ]
    paced = Q.pace(make_requests(spark, rows).repartition(9), 10)
    got = {r["request_id"]: r["s"] for r in paced.select("request_id", F.unix_micros("start_ts").alias("s")).collect()}
    want, last = {}, {}
    for id_, key, us in sorted(rows, key=lambda r: (r[2], r[0])):
        start = max(us, last.get(key, us - 10**12) + 6_000_000)
        want[id_], last[key] = start, start
    assert got == want
    assert "us" in paced.columns
    with pytest.raises(ValueError):
        Q.pace(make_requests(spark, rows), 0)


def test_quota(spark):
    day = 86_400_000_000
    rows = [(i, "a", i * 1000) for i in range(5)] + [(9, "a", day), (7, "b", 5)]
    requests = make_requests(spark, rows)
    got = {r["request_id"] for r in Q.quota(requests, 3).where("admitted").collect()}
    assert got == {0, 1, 2, 9, 7}
    assert Q.quota(requests, 0).where("admitted").count() == 7


def test_sample_is_exact_and_repeatable(spark):
    rows = [(i, "big") for i in range(500)] + [(i, "small") for i in range(500, 505)]
    frame = spark.createDataFrame(rows, "id int, c string")
    picks = [
        {r["id"] for r in C.stratified_sample(frame.repartition(n), "c", 20, id_column="id").collect()}
        for n in (1, 3, 11)
    ]
    assert picks[0] == picks[1] == picks[2]
    assert len(picks[0]) == 25 and {500, 501, 502, 503, 504} <= picks[0]


def test_shuffle_is_a_permutation(spark):
    frame = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "id int, t string")
    rows = C.shuffle_rows(frame, id_column="id").orderBy("shuffle_pos").collect()
    assert [r["shuffle_pos"] for r in rows] == list(range(1, 201))
    assert sorted(r["id"] for r in rows) == list(range(200))
    assert [r["id"] for r in rows] != list(range(200))
    assert all(r["t"] == f"t{r['id']}" for r in rows)


def test_job_folder_is_removed(spark):
    with job_folder(spark):
        kept = pin(spark.range(5), "five")
        path = scratch_path(spark, "more")
        assert kept.count() == 5 and "/job-" in path
        spark.range(1).write.parquet(path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    assert "/job-" not in scratch_path(spark, "more")


@pytest.mark.parametrize("n", [1, 999, 1001, 5000])
def test_first_of_group_never_meets_in_one_task(spark, n):
    """Rows are taken from parts of a group and then numbered over range partitions."""
    rows = spark.range(6000).select(F.lit("a").alias("g"), F.col("id"))
    found = first_of_group(rows, ["g"], [F.col("id").desc()], n)
    assert sorted(r.id for r in found.collect()) == list(range(6000 - n, 6000))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


@pytest.mark.parametrize("n", [0, 1, 7, 400, 899, 900, 901, 10_000_000])
def test_least_keys(spark, skewed, n):
    keyed = skewed.withColumn("key", F.md5(F.col("id").cast("string")))
    found = least_keys(keyed, ["k"], "key", n)
    groups = {}
    for row in keyed.collect():
        groups.setdefault(row.k, []).append((row.key, row.id))
    expected = {id_ for rows in groups.values() for _, id_ in sorted(rows)[:n]}
    rows = [row.id for row in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected
    assert found.columns == keyed.columns


def test_least_keys_with_long_common_beginnings(spark):
    """Rounds go on until the digits tell the keys apart."""
    rows = [("a", f"{'0' * 20}{place:012x}") for place in range(5000)] + [("b", "f" * 32)]
    frame = spark.createDataFrame(rows, "g string, key string").repartition(9)
    found = least_keys(frame, ["g"], "key", 1234)
    assert sorted(row.key for row in found.collect()) == sorted([key for _, key in rows[:1234]] + ["f" * 32])


def test_least_keys_shuffles_no_rows(spark):
    rows = spark.range(20_000).select((F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("key"))
    plan = least_keys(rows, ["g"], "key", 5000)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastHashJoin" in plan
