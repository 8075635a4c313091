"""One query for each operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidings.llm import (
    conversations, filter_audit, imatch, language, leaks, minhash, near, packing, pages, secrets, spans,
    token_files, toxicity,
)
from tidings.llm.common import held_out, table
from tidings.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(make: Callable[[SparkSession, str], DataFrame]):
    QUERIES[make.__name__] = make
    return make


@query
def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    samples = language.labelled_windows(docs)
    found = language.identify(docs, samples, keep=["doc_id"])
    return found.withColumn("held_out", held_out("doc_id"))


@query
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, folder, "labels"))
    found = toxicity.score(docs, model, keep=["doc_id"])
    return found.withColumn("held_out", held_out("doc_id"))


@query
def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return secrets.find_secrets(docs, keep=["doc_id"])


@query
def op6_main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "pages").select("page_id", "url", "html")
    return pages.extract(found, pages.train(spark), keep=["page_id", "url"])


@query
def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return leaks.find_leaks(docs, table(spark, folder, "benchmark"))


@query
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query
def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.token_spans(spark, path)


@query
def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return imatch.compare_edited(docs, imatch.learn_lexicon(docs))


@query
def op4_repeated_spans(spark: SparkSession, folder: str) -> DataFrame:
    return spans.cut_repeats(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op11_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.deduplicate(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(docs, table(spark, folder, "labels"))


ORACLES["op12_filter_audit"] = """
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents
),
failed AS (
    SELECT doc_id, part,
        len(words) < 50 AS a,
        100 * len(list_distinct(words)) < 65 * len(words) AS b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c,
        regexp_matches(text, '[#$%&*|]') AS d,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
    FROM texts
),
known AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
),
counts AS (
    SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask,
        count(*) AS n,
        count(*) FILTER (coalesce(good, false)) AS n_good,
        count(*) FILTER (coalesce(toxic, false)) AS n_toxic
    FROM failed LEFT JOIN known USING (doc_id) GROUP BY ALL
),
letters AS (SELECT unnest([0, 1, 2, 3, 4]) AS i),
orders AS (
    SELECT [v.i, w.i, x.i, y.i, z.i] AS places
    FROM letters v, letters w, letters x, letters y, letters z
    WHERE len(list_distinct([v.i, w.i, x.i, y.i, z.i])) = 5
),
steps AS (
    SELECT array_to_string([substr('ABCDE', p + 1, 1) FOR p IN places], '') AS filter_order,
        s + 1 AS step, 1 << places[s + 1] AS bit,
        coalesce(list_sum([1 << p FOR p IN places[1:s]]), 0)::INT AS before
    FROM orders, (SELECT unnest([0, 1, 2, 3, 4]) AS s)
),
effects AS (
    SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n_good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n_toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM counts, steps GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM effects
"""


@query
def op13_conversations(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.audit(conversations.damage(rows))
