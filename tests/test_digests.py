import json
from datetime import datetime

from pyspark.sql import functions as F

from tidings import fixed_values as fixed
from tidings.operators import digests as D
from tidings.operators import requests as Q
from tidings.sources.schemas import ARTICLES

BODY = """Subject: Your News Digest (05 Jan 2024)

Hi Ann,

Here are your top updates today:

1. New (Tech, s1)
   One.
   Two.
   Additional details are awaited.

2. Old (News, s0)
   given one
   given two


Regards,
News Digest"""


def tagged(spark, n=2):
    rows = [
        ("a", "s0", 0, 0, "Old", "", "x", "", datetime(2024, 1, 1), "News", "given one\ngiven two\n"),
        ("b", "s1", 1, 0, "New", "", "One. Two.", "", datetime(2024, 1, 2), "Tech", None),
        ("c", "s1", 1, 1, "Off", "", "", "", datetime(2024, 1, 3), "Film", None),
    ]
    return spark.createDataFrame(rows, ARTICLES + ", category string, summary string")


def recipients(spark, rows):
    return spark.createDataFrame(
        rows, "recipient string, categories array<string>, max_articles int"
    )


def test_digest_body(spark):
    people = recipients(spark, [
        ("Ann", ["Tech", "News", "Tech"], 9), ("Bob", ["News", "Tech"], 1), ("Cy", ["Odd"], 5),
    ])
    as_of = F.lit("2024-01-05").cast("date")
    rows = {r["recipient"]: r for r in D.digests(tagged(spark), people, as_of).collect()}
    assert rows["Ann"]["body"] == BODY
    assert rows["Ann"]["subject"] == "Subject: Your News Digest (05 Jan 2024)"
    assert (rows["Ann"]["n_articles"], rows["Bob"]["n_articles"]) == (2, 1)
    assert "1. New" in rows["Bob"]["body"] and "Old" not in rows["Bob"]["body"]
    assert rows["Cy"]["body"].endswith("today:\n\n\nRegards,\nNews Digest")


def test_matches_are_numbered_without_gaps(spark):
    people = recipients(spark, [("Ann", ["Tech", "News", "Film"], 2), ("Bob", ["Film"], 4)])
    got = sorted(map(tuple, D.match_recipients(tagged(spark), people).collect()))
    assert got == [("Ann", 1, "c"), ("Ann", 2, "b"), ("Bob", 1, "c")]


def test_one_large_choice_costs_others_nothing(spark):
    """One recipient asks for 100,000 articles, the others for five: rows joined follow each one's own size."""
    rows = spark.range(60_000).select(
        F.concat(F.lit("a"), "id").alias("article_id"), (F.col("id") % 3).cast("string").alias("category"),
        F.timestamp_seconds(F.col("id") % 1000).alias("published_ts"), F.lit(0).alias("feed_rank"), F.col("id").alias("entry_index"),
    )
    people = [(f"p{place}", [str(place % 3), "1"], 5) for place in range(30)] + [("all", ["0", "2"], 100_000)]
    matched = D.match_recipients(rows, recipients(spark, people))
    counts = {r.recipient: r.n for r in matched.groupBy("recipient").agg(F.count("*").alias("n")).collect()}
    assert counts == {name: min(size, 40_000) for name, _, size in people}
    newest = matched.where("recipient = 'p0'").orderBy("number").collect()
    expected = sorted(((place % 1000, -place) for place in range(60_000) if place % 3 < 2), reverse=True)[:5]
    assert [r.article_id for r in newest] == [f"a{-place}" for _, place in expected]


def articles(spark, n):
    rows = [
        (f"a{i}", "s", 0, i, f"Títle {i}", "", f"Text {i}." if i % 2 else "", "", None)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, ARTICLES)


def test_packed_requests(spark):
    packed = Q.pack_requests(articles(spark, 5), 2).orderBy("batch").collect()
    assert [len(r["members"]) for r in packed] == [2, 2, 1]
    payload = packed[0]["payload"]
    assert payload.isascii() and payload.startswith(fixed.BATCH_PROMPT)
    assert json.loads(payload.removeprefix(fixed.BATCH_PROMPT)) == [
        {"id": 1, "title": "Títle 0", "details": "Títle 0"},
        {"id": 2, "title": "Títle 1", "details": "Text 1."},
    ]
    assert "T\\u00EDtle" in payload or "T\\u00edtle" in payload


def test_single_prompt(spark):
    text = Q.single_prompts(articles(spark, 1)).first()["payload"]
    assert text == fixed.SINGLE_PROMPT + "Title: Títle 0\nDetails: Títle 0"


def test_malformed_replies(spark):
    cases = {
        "fenced": ('```json\n[{"id": 1, "summary": "a"}]\n```', {1: "a"}),
        "object": ('{"id": 1, "summary": "a"}', {}),
        "inner list": ('{"items": [{"id": 2, "summary": "b"}]}', {2: "b"}),
        "text id": ('[{"id": "1", "summary": "a"}, {"id": 2, "summary": "b"}]', {2: "b"}),
        "flag id": ('[{"id": true, "summary": "a"}]', {1: "a"}),
        "float id": ('[{"id": 1.5, "summary": "a"}, {"id": 2.0, "summary": "b"}]', {}),
        "twice": ('[{"id": 1, "summary": "a"}, {"id": 1, "summary": "b"}]', {1: "b"}),
        "stray": ('[3, "x", null, {"id": 1, "summary": "a"}]', {1: "a"}),
        "raw newline": ('[{"id": 1, "summary": "a\n  b"},]', {1: "a\nb"}),
        "comma in text": ('[{"id": 1, "summary": "a,]"}]', {1: "a]"}),
        "no summary": ('[{"id": 1}, {"id": 2, "summary": 5}]', {1: "", 2: ""}),
        "prose": ("sorry, no", {}),
        "broken": ('[{"id": 1, "summary": "a"', {}),
        "empty": ("", {}),
        "none": (None, {}),
    }
    rows = [(name, text) for name, (text, _) in cases.items()]
    frame = spark.createDataFrame(rows, "request_id string, content string")
    got = {name: {} for name in cases}
    for row in Q.parse_replies(frame).collect():
        got[row["request_id"]][row["id"]] = row["summary"]
    assert got == {name: want for name, (_, want) in cases.items()}


def test_summaries_from_two_providers(spark):
    def answer(status, text):
        body = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit(text).alias("content")).alias("message"))).alias("choices")))
        return lambda sent: sent.select(
            "request_id", F.lit(status).alias("status"), F.lit("quota").alias("error"), body.alias("body")
        )

    reply = '[{"id": 1, "summary": "made"}, {"id": 2, "summary": "  "}]'
    found = Q.summarize(articles(spark, 2), 5, answer(429, "x"), answer(200, reply))
    rows = {r["article_id"]: (r["summary"].split("\n")[0], r["summary_source"]) for r in found.collect()}
    assert rows == {"a0": ("made", "reply"), "a1": ("Text 1.", "fallback")}


def test_first_success_of_several_attempts(spark):
    good = '{"choices":[{"message":{"content":"%s"}}]}'
    replies = spark.createDataFrame(
        [(1, 1, 429, None), (1, 2, 200, good % "two"), (1, 3, 200, good % "three"), (2, 1, 500, None)],
        "request_id int, attempt int, status int, body string",
    )
    requests = spark.createDataFrame([(1,), (2,)], "request_id int")
    none = replies.where("false")
    rows = {r["request_id"]: r for r in Q.coalesce_responses(requests, none, replies).collect()}
    assert (rows[1]["content"], rows[1]["provider"], rows[1]["error"]) == ("two", "second", None)
    assert (rows[2]["content"], rows[2]["provider"]) == (None, None) and rows[2]["error"]


def test_error_classes(spark):
    good = '{"choices":[{"message":{"content":"x"}}]}'
    frame = spark.createDataFrame(
        [(200, None, good), (429, "API error 429", None), (400, "Quota spent", None), (500, "no", None), (200, None, "{}")],
        "status int, error string, body string",
    )
    assert {tuple(r) for r in Q.error_classes(frame).collect()} == {
        ("ok", 1), ("rate_limited", 2), ("failed", 2),
    }


def test_texts_do_not_travel_to_meet_replies(spark):
    rows = [("a1", "s", 0, 0, "T1", "", "One. Two.", "", None), ("a2", "s", 0, 1, "T2", "", None, "", None)]
    articles = spark.createDataFrame(rows, ARTICLES)
    members = spark.createDataFrame([("q", 1, "a1"), ("q", 2, "a2")], "request_id string, id int, article_id string")
    parsed = spark.createDataFrame([("q", 2, " said ")], "request_id string, id bigint, summary string")
    found = Q.attach_summaries(articles, members, parsed).select("article_id", "summary", "summary_source")
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "description" not in above and "split" not in above
    assert sorted(tuple(row) for row in found.collect()) == [
        ("a1", "One.\nTwo.\nAdditional details are awaited.", "fallback"), ("a2", "said", "reply"),
    ]
