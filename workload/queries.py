"""One query per operator, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings import fixed_values as fixed
from tidings.functions import replies as R
from tidings.functions import text as T
from tidings.functions.times import published_time, table_time
from tidings.operators import ablation as A
from tidings.operators import articles as N
from tidings.operators import corpus as C
from tidings.operators import digests as D
from tidings.operators import labelling as L
from tidings.operators import metrics as M
from tidings.operators import requests as Q
from tidings.plans.briefing import newest_with_summaries
from tidings.plans.evaluation import eval_pairs
from tidings.plans.preparation import balanced_corpus
from tidings.session import scratch_path
from tidings.sources.feeds import dedup_key, feed_rejects, parse_feeds, read_feeds, reject_reasons
from tidings.sources.labels import label_lines
from tidings.sources.schemas import RAW_FEEDS
from tidings.sources.tables import (
    FILE_ORDER,
    drop_blank_titles,
    preview,
    profile,
    read_articles_csv,
    read_corpus,
    read_csv,
    resolve_columns,
    write_corpus,
    write_digests,
)
from tidings.streaming.refresh import (
    batch_folder,
    feed_stream,
    ingest,
    newest_folder,
    rolling_latest,
)
from workload import sql as S
from workload import views as V

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


def big(name: str) -> F.Column:
    return F.col(name).cast("bigint").alias(name)


def stamp(name: str) -> F.Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"

# ---------------------------------------------------------------- headline


@query(
    f"""WITH {S.ARTICLES}, {S.UNIQUE}
    SELECT article_id, title, link, {STAMP.format('published_ts')},
           {S.fallback(S.DETAILS)} AS summary
    FROM uniq ORDER BY {S.RECENCY} LIMIT 30"""
)
def newest_summaries(spark, sf):
    newest = newest_with_summaries(V.articles(spark, sf))
    return newest.select("article_id", "title", "link", stamp("published_ts"), "summary")


# ---------------------------------------------------------------- sources and sinks

FEED_SQL = f"""WITH {S.ARTICLES},
    found AS (
      SELECT a.*, p.html, a.entry_index // {V.DOCS_PER_FETCH} AS fetch_no,
             row_number() OVER (
               PARTITION BY feed_rank, a.entry_index // {V.DOCS_PER_FETCH} ORDER BY entry_index
             ) - 1 AS position
      FROM arts a LEFT JOIN pages p ON p.page_id = a.entry_index
    )
    SELECT source, CAST(feed_rank AS BIGINT) AS feed_rank,
           fetch_no * 4294967296 + position AS entry_index, {S.clean('title')} AS title, link,
           {S.clean('coalesce(html, description)')} AS description,
           strftime(CAST(nullif(published, '') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS published_ts,
           md5(coalesce(nullif(link, ''), {S.clean('title')})) AS article_id
    FROM found"""


def _feed_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "source", big("feed_rank"), "entry_index", "title", "link", "description",
        stamp("published_ts"), "article_id",
    )


@query(FEED_SQL)
def feed_entries(spark, sf):
    return _feed_columns(parse_feeds(V.feed_files(spark, sf), V.feed_catalog()))


def broken_feeds(spark: SparkSession, sf: str) -> DataFrame:
    """The feed documents with bare ampersands and entities of HTML, each cut in its last entry."""
    loose = F.replace(F.replace(F.col("value"), F.lit("&amp;"), F.lit("&")), F.lit("</title>"), F.lit(" &nbsp;& </title>"))
    ended = F.regexp_replace(loose, "</(?:item|entry)></(?:channel></rss|feed)>$", "")
    return V.feed_files(spark, sf).withColumn("value", ended)


BROKEN_SQL = f"""WITH {S.ARTICLES},
    numbered AS (
      SELECT *, entry_index // {V.DOCS_PER_FETCH} AS fetch_no,
             row_number() OVER (PARTITION BY feed_rank, entry_index // {V.DOCS_PER_FETCH}
                                ORDER BY entry_index) AS place,
             count(*) OVER (PARTITION BY feed_rank, entry_index // {V.DOCS_PER_FETCH}) AS n
      FROM arts
    )"""


@query(
    f"""{BROKEN_SQL}
    SELECT CAST(feed_rank AS BIGINT) AS feed_rank, fetch_no * 4294967296 + place - 1 AS entry_index,
           {S.clean("title || ' ' || chr(160) || '&'")} AS title, link
    FROM numbered WHERE place < n"""
)
def broken_feed_entries(spark, sf):
    found = parse_feeds(broken_feeds(spark, sf), V.feed_catalog())
    return found.select(big("feed_rank"), "entry_index", "title", "link")


@query(
    f"""{BROKEN_SQL}
    SELECT CAST(feed_rank AS BIGINT) AS feed_rank, fetch_no AS "fetch", count(*) AS n_entries,
           1::BIGINT AS n_rejected
    FROM numbered GROUP BY 1, 2"""
)
def feed_reject_counts(spark, sf):
    return feed_rejects(broken_feeds(spark, sf)).withColumn("feed_rank", big("feed_rank"))


@query(
    f"""{BROKEN_SQL}
    SELECT CAST(feed_rank AS BIGINT) AS feed_rank, fetch_no AS "fetch", 'document ends' AS cut_off,
           1::BIGINT AS n, count(*) - 1 AS first_position
    FROM numbered GROUP BY 1, 2"""
)
def feed_reject_reasons(spark, sf):
    found = reject_reasons(broken_feeds(spark, sf))
    return found.select(big("feed_rank"), "fetch", "cut_off", "n", big("first_position"))


def wild_feeds(spark: SparkSession, sf: str) -> DataFrame:
    """The feed documents with entries in comments, starts of entries in CDATA, bare "<", end tags
    without a start and elements that are never closed."""
    value = F.col("value")
    for old, new in {
        "</item>": "<category>open</item>",
        "<item>": "<!-- <item><title>no</title></item> --><item>",
        "<entry>": "<!-- an <entry> --><entry>",
        "<description>": "<description><![CDATA[<item id=1>first</item> ]]>",
        "<summary>": "<summary><![CDATA[<entry>first</entry> ]]>",
        "</title>": " 5 < 6</title></b>",
    }.items():
        value = F.replace(value, F.lit(old), F.lit(new))
    return V.feed_files(spark, sf).withColumn("value", value)


@query(
    f"""{FEED_SQL.split("    SELECT source")[0]}
    SELECT CAST(feed_rank AS BIGINT) AS feed_rank, fetch_no * 4294967296 + position AS entry_index,
           {S.clean("title || ' 5 < 6'")} AS title, link,
           {S.clean("'<item id=1>first</item> ' || coalesce(html, description)")} AS description
    FROM found"""
)
def wild_feed_entries(spark, sf):
    found = parse_feeds(wild_feeds(spark, sf), V.feed_catalog())
    return found.select(big("feed_rank"), "entry_index", "title", "link", "description")


def landed(spark: SparkSession, sf: str) -> str:
    folder = scratch_path(spark, "feeds")
    V.feed_files(spark, sf).write.partitionBy("feed_rank", "fetch").text(folder)
    return folder


@query(FEED_SQL)
def feed_file_scan(spark, sf):
    return _feed_columns(read_feeds(spark, landed(spark, sf), V.feed_catalog()))


@query(
    f"""WITH {S.ARTICLES}
    SELECT {S.clean(S.strip('title'))} AS title, {S.strip('link')} AS link,
           {S.clean(S.strip('description'))} AS description, {S.strip('published')} AS published,
           strftime(CAST(nullif(published, '') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS published_ts,
           source
    FROM arts WHERE {S.strip('title')} <> ''"""
)
def article_csv_scan(spark, sf):
    path = scratch_path(spark, "articles-csv")
    foreign = V.articles(spark, sf).select(
        F.col("title").alias("Headline"), F.col("description").alias("text"),
        F.col("link").alias("URL"), F.col("published").alias("Date"),
        F.col("source").alias("outlet"), "lang",
    )
    write_corpus(foreign, path)
    return read_articles_csv(spark, path).select(
        "title", "link", "description", "published", stamp("published_ts"), "source"
    )


@query(
    "SELECT text AS title, source, lang AS description FROM documents"
)
def article_columns(spark, sf):
    foreign = V.table(spark, sf, "documents").select(
        F.col("lang").alias("Content"), F.col("text").alias("HEADLINE"),
        F.col("source").alias("Outlet"), "n_chars",
    )
    return resolve_columns(foreign, fixed.ARTICLE_COLUMNS)


@query("SELECT text, lang AS label FROM documents")
def eval_columns(spark, sf):
    return resolve_columns(
        V.corpus(spark, sf), fixed.EVAL_COLUMNS, ("text", "label"), case_sensitive=True
    )


@query("SELECT doc_id, text AS headline_text, lang AS category FROM documents")
def corpus_csv_round_trip(spark, sf):
    path = scratch_path(spark, "corpus-csv")
    write_corpus(V.corpus(spark, sf), path)
    schema = "doc_id bigint, headline_text string, category string"
    return read_corpus(spark, path, schema, multi_line=True)


@query(
    """SELECT n_nationkey::BIGINT AS line, n_name AS label,
           upper(n_name[1:1]) || lower(replace(n_name[2:], '_', ' ')) AS display
    FROM nation"""
)
def label_file(spark, sf):
    path = scratch_path(spark, "labels")
    names = V.table(spark, sf, "nation").orderBy("n_nationkey").select(
        F.concat(F.lit("  "), "n_name", F.lit("\r")).alias("value")
    )
    names.coalesce(1).write.text(path)
    return label_lines(spark, path)


@query("SELECT count(*) AS n_rows, 5::BIGINT AS n_columns FROM documents")
def table_profile(spark, sf):
    return profile(V.table(spark, sf, "documents"))


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 5")
def table_preview(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return preview(docs, 5, ["doc_id"])


# ---------------------------------------------------------------- projections and filters


@query(f"WITH {S.ARTICLES} SELECT article_id FROM arts WHERE link <> '' OR title <> ''")
def keyed_articles(spark, sf):
    return N.drop_unkeyed(V.articles(spark, sf)).select("article_id")


@query(
    f"WITH {S.ARTICLES} SELECT article_id, title FROM arts WHERE {S.strip('title')} <> ''"
)
def titled_articles(spark, sf):
    return drop_blank_titles(V.articles(spark, sf)).select("article_id", "title")


@query(f"WITH {S.PAIRS} SELECT x, y FROM pairs WHERE y IN ('en', 'fr', 'es')")
def eval_rows(spark, sf):
    return eval_pairs(V.corpus(spark, sf), V.SOME_LABELS)


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr', 'es')")
def vocabulary_rows(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "lang")
    return C.filter_by_vocab(docs, V.SOME_LABELS, "lang")


@query(
    """SELECT count(*) AS diff FROM documents
    WHERE lang IS NULL OR lang NOT IN ('en', 'fr', 'es')"""
)
def out_of_vocabulary(spark, sf):
    rows = C.out_of_vocab(V.table(spark, sf, "documents"), V.SOME_LABELS, "lang")
    return rows.agg(F.count(F.lit(1)).alias("diff"))


@query(
    """SELECT doc_id, text FROM documents
    WHERE regexp_matches(text, '(?i)ing th|lich|ciudad')"""
)
def keyword_rows(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "text")
    return C.keyword_filter(docs, "text", V.KEYWORDS)


@query(
    f"""SELECT count(*) FILTER (WHERE regexp_matches(lower(text), '{'|'.join(fixed.CRIME_KEYWORDS)}'))
             AS kept, count(*) AS total,
           round(count(*) FILTER (WHERE regexp_matches(lower(text),
             '{'|'.join(fixed.CRIME_KEYWORDS)}')) / count(*), 4) AS rate
    FROM documents"""
)
def crime_keyword_rate(spark, sf):
    docs = V.table(spark, sf, "documents")
    return C.keep_rate(docs, T.contains_any(F.col("text"), fixed.CRIME_KEYWORDS))


@query(f"WITH {S.TAGGED} SELECT article_id, category FROM tagged WHERE category IN ('EN', 'DE')")
def chosen_categories(spark, sf):
    chosen = N.filter_categories(V.tagged(spark, sf), ["EN", "DE"])
    return chosen.select("article_id", "category")


@query(f"WITH {S.ARTICLES} SELECT article_id, {S.DETAILS} AS details FROM arts")
def details_text(spark, sf):
    return N.with_details(V.articles(spark, sf)).select("article_id", "details")


@query(f"WITH {S.ARTICLES} SELECT article_id, {S.PREMISE} AS premise FROM arts")
def premise_text(spark, sf):
    return V.articles(spark, sf).select("article_id", L.article_premise().alias("premise"))


@query(
    f"""WITH {S.TAGGED}
    SELECT article_id, '### [' || title || '](' || link || ')' AS heading,
           'Source: ' || source || ' | Published: ' || published || ' | Zero-shot confidence: '
             || printf('%.2f', confidence) AS caption,
           {S.fallback(S.DETAILS)} AS summary
    FROM tagged"""
)
def article_cards(spark, sf):
    return N.cards(V.tagged(spark, sf))


@query(
    f"""WITH {S.PREDS}
    SELECT confidence < 0.45 AS low_confidence, count(*) AS n,
           count(*) FILTER (WHERE y <> yhat) AS errors,
           round(count(*) FILTER (WHERE y <> yhat) / count(*), 4) AS error_rate
    FROM preds GROUP BY 1"""
)
def confidence_triage(spark, sf):
    return M.triage(V.predictions(spark, sf))


# ---------------------------------------------------------------- joins


@query(
    """SELECT doc_id, lang AS raw_category,
           CASE lang WHEN 'en' THEN 'EN' WHEN 'fr' THEN 'FR' WHEN 'es' THEN 'ES'
             ELSE 'Unknown' END AS category
    FROM documents"""
)
def display_categories(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("raw_category"))
    return L.map_display(docs, V.SOME_LABELS)


@query(
    f"""WITH {S.TAGGED}
    SELECT article_id, title, raw_category, round(confidence, 6) AS confidence FROM tagged"""
)
def attached_predictions(spark, sf):
    found = V.articles(spark, sf).select("article_id", "title")
    preds = V.tagged(spark, sf).select("article_id", "raw_category", "confidence")
    return L.attach_predictions(found, preds).select(
        "article_id", "title", "raw_category", F.round("confidence", 6).alias("confidence")
    )


@query(
    f"""SELECT doc_id, coalesce(p.phrase, lang) AS phrase, lang AS label
    FROM documents LEFT JOIN ({S.values(list(V.PHRASES.items()))}) p(label, phrase)
      ON p.label = lang"""
)
def expanded_labels(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("given"))
    phrased = A.with_phrase(docs, V.PHRASES, "given")
    return A.with_label(phrased, V.PHRASES).select("doc_id", "phrase", "label")


HYPOTHESES_SQL = f"""WITH {S.ARTICLES}
    SELECT article_id, t.prompt_id, l.label_rank::BIGINT AS label_rank, l.label,
           {S.PREMISE} AS premise, replace(t.template, '{{}}', l.label) AS hypothesis
    FROM arts, {S.label_values()} l, ({{}}) t(prompt_id, template)"""


def _hypotheses(spark, sf, templates):
    found = L.hypotheses(V.articles(spark, sf), V.LABELS, templates)
    return found.withColumn("label_rank", F.col("label_rank").cast("bigint"))


@query(HYPOTHESES_SQL.replace("({})", f"({S.values(fixed.TEMPLATES[:1])})"))
def label_hypotheses(spark, sf):
    return _hypotheses(spark, sf, fixed.TEMPLATES[:1])


@query(HYPOTHESES_SQL.replace("({})", f"({S.values(fixed.TEMPLATES)})").replace(f"{S.PREMISE} AS premise, ", ""))
def template_hypotheses(spark, sf):
    return _hypotheses(spark, sf, fixed.TEMPLATES).drop("premise")


@query(f"WITH {S.MATCHED} SELECT recipient, number, article_id FROM matched")
def recipient_matches(spark, sf):
    matched = D.match_recipients(V.tagged(spark, sf), V.recipients(spark, sf))
    return matched.select("recipient", big("number"), "article_id")


@query(
    f"""WITH {S.TAGGED},
    tabs AS (SELECT * FROM ({S.values([('EN',), ('FR',), ('IT',)])}) t(category)),
    counted AS (SELECT category, count(*) AS n FROM tagged GROUP BY 1)
    SELECT coalesce(t.category, c.category) AS category, t.category IS NOT NULL AS in_tabs,
           coalesce(n, 0) AS n
    FROM tabs t FULL JOIN counted c ON c.category = t.category"""
)
def category_totals(spark, sf):
    tabs = [L.Label("en", "EN"), L.Label("fr", "FR"), L.Label("it", "IT")]
    return L.category_counts(V.tagged(spark, sf), tabs)


@query(
    f"""WITH {S.ARTICLES}, {S.PLACED}
    SELECT DISTINCT batch, batch % 10 <> 0 OR batch % 5 <> 0 AS answered,
           CASE WHEN batch % 5 <> 0 THEN 'first' WHEN batch % 10 <> 0 THEN 'second' END AS provider,
           CASE WHEN batch % 10 = 0 THEN 'Both providers failed.' END AS error
    FROM placed"""
)
def provider_fallback(spark, sf):
    packed = V.sent_requests(spark, sf)
    first, second = V.batch_replies(spark, sf, packed)
    outgoing = packed.select("request_id", "batch")
    return Q.coalesce_responses(outgoing, first, second).select(
        "batch", F.col("content").isNotNull().alias("answered"), "provider", "error"
    )


ANSWERED = f"""{S.ARTICLES}, {S.PLACED},
    turns AS (
      SELECT 'd' || conv_id AS article_id, {S.clean_summary('text')} AS reply
      FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations
            WHERE role = 'assistant' GROUP BY 1)
    ),
    answered AS (
      SELECT p.*, CASE WHEN batch % 10 <> 0 THEN nullif(t.reply, '') END AS reply
      FROM placed p LEFT JOIN turns t ON t.article_id = p.article_id
    )"""


@query(
    f"""WITH {ANSWERED}
    SELECT article_id, coalesce(reply, {S.fallback(S.DETAILS)}) AS summary,
           CASE WHEN reply IS NULL THEN 'fallback' ELSE 'reply' END AS summary_source
    FROM answered"""
)
def attached_summaries(spark, sf):
    packed = V.sent_requests(spark, sf)
    first, second = V.batch_replies(spark, sf, packed)
    answered = Q.coalesce_responses(packed.select("request_id"), first, second)
    filled = Q.attach_summaries(
        V.articles(spark, sf), Q.request_members(packed), Q.parse_replies(answered)
    )
    return filled.select("article_id", "summary", "summary_source")


@query(
    f"""WITH {ANSWERED}
    SELECT CAST(batch AS BIGINT) AS batch, CAST(id AS BIGINT) AS id, reply AS summary
    FROM answered WHERE reply IS NOT NULL"""
)
def reply_summaries(spark, sf):
    packed = V.sent_requests(spark, sf)
    first, second = V.batch_replies(spark, sf, packed)
    outgoing = packed.select("request_id", "batch")
    answered = Q.coalesce_responses(outgoing, first, second)
    parsed = Q.parse_replies(answered)
    return parsed.join(outgoing, "request_id").select("batch", "id", "summary")


def refuse(requests: DataFrame) -> DataFrame:
    """A provider that refuses every request."""
    return requests.select(
        "request_id", F.lit(429).alias("status"), F.lit(None).cast("string").alias("body")
    )


def echo_odd(requests: DataFrame) -> DataFrame:
    """A provider that answers every other article with its title."""
    payload = F.replace(F.col("payload"), F.lit(fixed.BATCH_PROMPT), F.lit(""))
    items = F.from_json(payload, "array<struct<id:int,title:string>>")
    odd = F.filter(items, lambda item: item["id"] % 2 == 1)
    answers = F.transform(odd, lambda item: F.struct(item["id"], item["title"].alias("summary")))
    message = F.struct(F.struct(F.to_json(answers).alias("content")).alias("message"))
    body = F.to_json(F.struct(F.array(message).alias("choices")))
    return requests.select("request_id", F.lit(200).alias("status"), body.alias("body"))


@query(
    f"""WITH {S.ARTICLES}, {S.PLACED}
    SELECT article_id,
           CASE WHEN id % 2 = 1 AND {S.clean_summary('title')} <> ''
             THEN {S.clean_summary('title')} ELSE {S.fallback(S.DETAILS)} END AS summary
    FROM placed"""
)
def summarized_articles(spark, sf):
    filled = Q.summarize(V.articles(spark, sf), V.BATCH, refuse, echo_odd)
    return filled.select("article_id", "summary")


# ---------------------------------------------------------------- aggregations


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def class_counts(spark, sf):
    return C.value_counts(V.table(spark, sf, "documents"), "lang")


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def source_counts(spark, sf):
    return C.value_counts(V.table(spark, sf, "documents"), "source")


SAMPLE_SIZE = 120


@query(
    f"""SELECT lang, count(*) AS n_before, least(count(*), {SAMPLE_SIZE}) AS n_after
    FROM documents WHERE lang IN ('en', 'fr', 'es') GROUP BY 1"""
)
def balance(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "lang")
    _, report = balanced_corpus(
        docs, "lang", ["en", "fr", "es", "it"], SAMPLE_SIZE, id_column="doc_id"
    )
    return report


@query(
    """SELECT count(*) FILTER (WHERE regexp_matches(text, '(?i)ing th|lich|ciudad')) AS kept,
           count(*) AS total,
           round(count(*) FILTER (WHERE regexp_matches(text, '(?i)ing th|lich|ciudad'))
             / count(*), 4) AS rate
    FROM documents"""
)
def keyword_keep_rate(spark, sf):
    docs = V.table(spark, sf, "documents")
    return C.keep_rate(docs, T.contains_any(F.col("text"), V.KEYWORDS))


CELLS = f"""cells AS (
      SELECT a.label AS y, b.label AS yhat
      FROM {S.label_values(V.SOME_LABELS)} a, {S.label_values(V.SOME_LABELS)} b
    ),
    matrix AS (
      SELECT c.y, c.yhat, count(p.article_id) AS n
      FROM cells c LEFT JOIN preds p ON p.y = c.y AND p.yhat = c.yhat GROUP BY 1, 2
    )"""


@query(f"WITH {S.PREDS}, {CELLS} SELECT y, yhat, n FROM matrix")
def confusion_cells(spark, sf):
    return M.confusion(V.predictions(spark, sf), V.SOME_LABELS)


@query(
    f"""WITH {S.PREDS}, {CELLS}
    SELECT y, CAST(sum(n) FILTER (WHERE yhat = 'en') AS BIGINT) AS en,
           CAST(sum(n) FILTER (WHERE yhat = 'fr') AS BIGINT) AS fr,
           CAST(sum(n) FILTER (WHERE yhat = 'es') AS BIGINT) AS es
    FROM matrix GROUP BY y"""
)
def confusion_matrix(spark, sf):
    return M.confusion_wide(V.predictions(spark, sf), V.SOME_LABELS)


@query(
    f"""WITH {S.PREDS},
    flagged AS (SELECT y IN ('en','fr','es') AND yhat IN ('en','fr','es') AS inside FROM preds)
    SELECT count(*) FILTER (WHERE inside) AS matrix_total, count(*) AS n_rows,
           count(*) FILTER (WHERE NOT inside) AS diff
    FROM flagged"""
)
def confusion_totals(spark, sf):
    return M.confusion_check(V.predictions(spark, sf), V.SOME_LABELS)


@query(
    f"""WITH {S.CLASS_COUNTS}
    SELECT label, round(precision, 4) AS precision, round(recall, 4) AS recall,
           round(f1, 4) AS f1, support FROM report"""
)
def class_metrics(spark, sf):
    return M.class_report(V.predictions(spark, sf))


@query(
    f"""WITH {S.CLASS_COUNTS}
    SELECT 'accuracy' AS average, round(sum(hits) / sum(support), 4) AS precision,
           round(sum(hits) / sum(support), 4) AS recall,
           round(sum(hits) / sum(support), 4) AS f1, CAST(sum(support) AS BIGINT) AS support
    FROM report
    UNION ALL
    SELECT 'macro', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4),
           CAST(sum(support) AS BIGINT) FROM report
    UNION ALL
    SELECT 'weighted', round(sum(precision * support) / sum(support), 4),
           round(sum(recall * support) / sum(support), 4),
           round(sum(f1 * support) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM report"""
)
def average_metrics(spark, sf):
    return M.report_averages(V.predictions(spark, sf))


ABLATION_LABELS = [
    (pid, rank, label.label, phrase)
    for pid, _ in fixed.TEMPLATES
    for rank, (label, phrase) in enumerate(
        zip(V.LABELS, A.phrases_for(pid, V.LABELS, V.PHRASES))
    )
]
ABLATION_SQL = f"""{S.PAIRS},
    {S.scored('pairs', ABLATION_LABELS, fixed.TEMPLATES)},
    ablation AS (
      SELECT s.prompt_id, t.template, round(avg((s.label = p.y)::INT), 4) AS accuracy
      FROM scored s JOIN pairs p ON p.article_id = s.article_id
      JOIN ({S.values(fixed.TEMPLATES)}) t(prompt_id, template) ON t.prompt_id = s.prompt_id
      WHERE s.rn = 1 GROUP BY 1, 2
    )"""


def _ablation(spark, sf):
    return A.ablate(V.pairs(spark, sf), V.LABELS, phrases=V.PHRASES)


@query(f"WITH {ABLATION_SQL} SELECT prompt_id, template, accuracy FROM ablation")
def template_ablation(spark, sf):
    return _ablation(spark, sf)


@query(
    f"""WITH {ABLATION_SQL}
    SELECT prompt_id, template, accuracy FROM ablation ORDER BY accuracy DESC, prompt_id LIMIT 1"""
)
def best_template(spark, sf):
    return A.best_template(_ablation(spark, sf))


BASELINE = "P2_baseline_headline"


@query(
    f"""WITH {ABLATION_SQL},
    base AS (SELECT accuracy AS b FROM ablation WHERE prompt_id = '{BASELINE}')
    SELECT prompt_id, accuracy, round(accuracy - b, 4) AS gain,
           round((accuracy - b) / b, 4) AS relative_gain,
           round((SELECT max(accuracy) - min(accuracy) FROM ablation), 4) AS spread
    FROM ablation, base"""
)
def ablation_gains(spark, sf):
    return A.ablation_deltas(_ablation(spark, sf), BASELINE)


@query(
    f"""WITH {S.TAGGED}
    SELECT category, row_number() OVER (PARTITION BY category ORDER BY {S.RECENCY}) AS position,
           article_id FROM tagged"""
)
def category_buckets(spark, sf):
    return L.category_buckets(V.tagged(spark, sf))


DIGEST_SQL = f"""WITH {S.MATCHED},
    blocks AS (
      SELECT m.recipient, m.number,
             number || '. ' || title || ' (' || category || ', ' || source || ')' || chr(10)
               || array_to_string(list_transform(
                    string_split({S.fallback(S.DETAILS)}, chr(10)), lambda s: '   ' || s), chr(10))
               || chr(10) AS block
      FROM matched m JOIN tagged t ON t.article_id = m.article_id
    ),
    bodies AS (
      SELECT recipient, string_agg(block, chr(10) ORDER BY number) AS middle, count(*) AS n
      FROM blocks GROUP BY 1
    )
    SELECT r.recipient, 'Subject: Your News Digest (31 Jan 2024)' AS subject,
           'Subject: Your News Digest (31 Jan 2024)' || chr(10) || chr(10) || 'Hi '
             || r.recipient || ',' || chr(10) || chr(10) || 'Here are your top updates today:'
             || chr(10) || chr(10) || coalesce(b.middle || chr(10), '') || chr(10) || 'Regards,'
             || chr(10) || 'News Digest' AS body,
           coalesce(b.n, 0) AS n_articles
    FROM recipients r LEFT JOIN bodies b ON b.recipient = r.recipient"""


def _digests(spark, sf):
    as_of = F.lit("2024-01-31").cast("date")
    return D.digests(V.tagged(spark, sf), V.recipients(spark, sf), as_of)


@query(DIGEST_SQL)
def recipient_digests(spark, sf):
    return _digests(spark, sf)


@query(DIGEST_SQL)
def digest_files(spark, sf):
    path = scratch_path(spark, "digests")
    digests = _digests(spark, sf)
    write_digests(digests, path)
    return spark.read.schema(digests.schema).json(path)


@query(
    f"""WITH {S.ARTICLES}, {S.PLACED}
    SELECT CAST(batch AS BIGINT) AS batch, CAST(id AS BIGINT) AS id, article_id, title,
           {S.DETAILS} AS details, true AS is_ascii
    FROM placed"""
)
def packed_requests(spark, sf):
    packed = V.batch_requests(spark, sf)
    payload = F.replace(F.col("payload"), F.lit(fixed.BATCH_PROMPT), F.lit(""))
    sent = packed.select(
        "batch",
        F.col("payload").rlike(r"^\p{ASCII}*\z").alias("is_ascii"),
        F.inline(
            F.arrays_zip(
                "members",
                F.from_json(payload, "array<struct<id:int,title:string,details:string>>").alias(
                    "sent"
                ),
            )
        ).alias("member", "sent"),
    )
    return sent.select(
        "batch", F.col("sent.id").cast("bigint").alias("id"), "member.article_id", "sent.title",
        "sent.details", "is_ascii",
    )


@query(
    f"""WITH {S.ARTICLES}
    SELECT article_id, {S.quoted(fixed.SINGLE_PROMPT)} || 'Title: ' || title || chr(10)
             || 'Details: ' || {S.DETAILS} AS payload
    FROM arts"""
)
def single_prompts(spark, sf):
    return Q.single_prompts(V.articles(spark, sf))


@query(
    f"""WITH {S.PREDS}
    SELECT y, yhat, count(*) AS n FROM preds WHERE y <> yhat GROUP BY 1, 2
    ORDER BY n DESC, y, yhat LIMIT 4"""
)
def top_confusions(spark, sf):
    return M.top_confusions(V.predictions(spark, sf), 4)


@query(
    f"""WITH {S.PREDS},
    one AS (SELECT count(*) AS n, avg((y = yhat)::INT) AS p FROM preds)
    SELECT n, round(p, 4) AS accuracy, round(1.96 * sqrt(p * (1 - p) / n), 6) AS half_width
    FROM one"""
)
def accuracy_interval(spark, sf):
    return M.accuracy_interval(V.predictions(spark, sf))


@query(
    f"""WITH cleaned AS (
      SELECT string_split({S.clean_summary('text')}, chr(10)) AS lines FROM conversations
    ),
    flagged AS (
      SELECT len(lines) = 3 AND len(list_filter(lines, lambda l: len(list_filter(
        regexp_split_to_array(l, '{S.SPACE}+'), lambda w: w <> '')) > 22)) = 0 AS fits
      FROM cleaned
    )
    SELECT count(*) FILTER (WHERE fits) AS compliant, count(*) AS n,
           round(count(*) FILTER (WHERE fits) / count(*), 4) AS rate
    FROM flagged"""
)
def compliant_summaries(spark, sf):
    turns = V.table(spark, sf, "conversations")
    return M.summary_compliance(
        turns.select(T.clean_summary_text(F.col("text")).alias("summary"))
    )


@query(
    """SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 4) AS share
    FROM documents GROUP BY 1"""
)
def class_shares(spark, sf):
    return C.class_share(V.table(spark, sf, "documents"), "lang")


# ---------------------------------------------------------------- windows, order, sets


@query(f"WITH {S.ARTICLES}, {S.UNIQUE} SELECT article_id, title, link, source FROM uniq")
def first_seen_articles(spark, sf):
    unique = N.dedup_first_seen(V.articles(spark, sf))
    return unique.select("article_id", "title", "link", "source")


@query(
    f"""WITH {S.TAGGED}
    SELECT article_id, label, round(p, 6) AS score, rn AS rank FROM scored"""
)
def label_scores(spark, sf):
    return V.tagged(spark, sf).select(
        "article_id", F.posexplode("scores").alias("place", "s")
    ).select(
        "article_id", F.col("s.label").alias("label"), F.round("s.score", 6).alias("score"),
        (F.col("place") + 1).cast("bigint").alias("rank"),
    )


def word_overlap_model():
    """A model in plain Python that must agree with the built-in scorer."""
    import re

    import numpy as np

    def words(text):
        return set(re.findall(r"[^\W_]+", text.lower()))

    def run(premises, hypotheses):
        wanted = [words(h) for h in hypotheses]
        return np.array(
            [[len(w & found) / len(w) * 10.0 for w in wanted] for found in map(words, premises)]
        )

    return run


@query(
    f"""WITH {S.TAGGED}
    SELECT article_id, category, round(confidence, 6) AS confidence FROM tagged"""
)
def model_labels(spark, sf):
    tagged = L.classify(
        V.articles(spark, sf), V.PHRASED, V.TEMPLATE, L.pandas_scorer(word_overlap_model)
    )
    return tagged.select("article_id", "category", F.round("confidence", 6).alias("confidence"))


SAMPLE_SQL = f"""sample AS (
      SELECT doc_id, lang, md5('42:' || doc_id) AS k FROM documents
      WHERE lang IN ('en', 'fr', 'es')
      QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id)
        <= {SAMPLE_SIZE}
    )"""


@query(f"WITH {SAMPLE_SQL} SELECT doc_id, lang FROM sample")
def class_sample(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "lang")
    known = C.filter_by_vocab(docs, V.SOME_LABELS, "lang")
    return C.stratified_sample(known, "lang", SAMPLE_SIZE, id_column="doc_id")


@query(
    f"""WITH {SAMPLE_SQL}
    SELECT doc_id, lang, row_number() OVER (ORDER BY k, doc_id) AS shuffle_pos FROM sample"""
)
def balanced_shuffle(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "lang")
    return balanced_corpus(docs, "lang", ["en", "fr", "es"], SAMPLE_SIZE, id_column="doc_id")[0]


@query(
    """SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS shuffle_pos
    FROM documents"""
)
def shuffled_rows(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "lang")
    return C.shuffle_rows(docs, id_column="doc_id")


PER_DAY = 50
QUOTA_SQL = f"""reqs AS (
      SELECT event_id AS request_id, event_type AS api_key_id, ts,
             row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id)
               <= {PER_DAY} AS admitted
      FROM events
    )"""


@query(f"WITH {QUOTA_SQL} SELECT request_id, api_key_id, admitted FROM reqs")
def admitted_requests(spark, sf):
    marked = Q.quota(V.requests(spark, sf), PER_DAY)
    return marked.select("request_id", "api_key_id", "admitted")


# One request per 20 minutes and key makes most requests wait.
PER_MINUTE = 0.05


@query(
    f"""WITH {QUOTA_SQL},
    placed AS (
      SELECT *, epoch_us(ts) AS arrival,
             row_number() OVER (PARTITION BY api_key_id ORDER BY ts, request_id) AS i
      FROM reqs WHERE admitted
    )
    SELECT request_id, api_key_id, i * 1200000000 + max(arrival - i * 1200000000) OVER (
             PARTITION BY api_key_id ORDER BY i) AS start_us
    FROM placed"""
)
def paced_requests(spark, sf):
    admitted = Q.quota(V.requests(spark, sf), PER_DAY).where("admitted")
    paced = Q.pace(admitted, PER_MINUTE)
    return paced.select("request_id", "api_key_id", F.unix_micros("start_ts").alias("start_us"))


@query(
    f"""WITH {S.ARTICLES}
    SELECT article_id, title, {STAMP.format('published_ts')}
    FROM arts ORDER BY {S.RECENCY} LIMIT 30"""
)
def latest_articles(spark, sf):
    return N.latest(V.articles(spark, sf)).select("article_id", "title", stamp("published_ts"))


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def first_rows(spark, sf):
    path = scratch_path(spark, "ordered-csv")
    docs = V.table(spark, sf, "documents").select("doc_id", "lang", "text")
    write_corpus(docs.orderBy("doc_id"), path)
    head = N.head_in_order(read_csv(spark, path), 50, FILE_ORDER)
    return head.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang")


@query(
    f"""WITH {S.ARTICLES}
    SELECT article_id, title, source FROM arts
    UNION ALL SELECT 'b' || item_id, text, NULL FROM benchmark
    UNION ALL SELECT 'p' || page_id, html, NULL FROM pages"""
)
def all_articles(spark, sf):
    found = V.articles(spark, sf).select("article_id", "title", "source")
    short = V.table(spark, sf, "benchmark").select(
        F.concat(F.lit("b"), "item_id").alias("article_id"), F.col("text").alias("title")
    )
    pages = V.table(spark, sf, "pages").select(
        F.concat(F.lit("p"), "page_id").alias("article_id"), F.col("html").alias("title")
    )
    return N.union_articles(found, short, pages)


# ---------------------------------------------------------------- text, times, replies


@query(f"SELECT page_id, {S.clean('html')} AS cleaned FROM pages")
def cleaned_pages(spark, sf):
    pages = V.table(spark, sf, "pages")
    return pages.select("page_id", T.clean_text(F.col("html")).alias("cleaned"))


@query(f"SELECT doc_id, {S.clean('text')} AS cleaned FROM documents")
def cleaned_documents(spark, sf):
    docs = V.table(spark, sf, "documents")
    return docs.select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query(
    f"""SELECT 'p' || page_id AS id, {S.clean_summary('html')} AS cleaned FROM pages
    UNION ALL SELECT 'd' || doc_id, {S.clean_summary('text')} FROM documents"""
)
def cleaned_summaries(spark, sf):
    pages = V.table(spark, sf, "pages").select(
        F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text")
    )
    docs = V.table(spark, sf, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("id"), "text"
    )
    return pages.union(docs).select("id", T.clean_summary_text(F.col("text")).alias("cleaned"))


@query(
    """SELECT event_id, strftime(CASE event_type
             WHEN 'click' THEN date_trunc('second', ts) - INTERVAL 330 MINUTE
             WHEN 'view' THEN date_trunc('second', ts)
             WHEN 'signup' THEN date_trunc('second', ts)
             WHEN 'purchase' THEN date_trunc('day', ts) END, '%Y-%m-%d %H:%M:%S') AS published_ts
    FROM events"""
)
def feed_times(spark, sf):
    kind, ts = F.col("event_type"), F.col("ts")
    mail = F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss")
    published = (
        F.when(kind == "click", F.concat(mail, F.lit(" +0530")))
        .when(kind == "view", F.concat(mail, F.lit(" GMT")))
        .when(kind == "signup", F.lit("soon"))
    )
    updated = F.when(kind == "purchase", F.date_format(ts, "yyyy-MM-dd")).when(
        kind == "signup", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    )
    return V.table(spark, sf, "events").select(
        "event_id",
        F.date_format(published_time(published, updated), "yyyy-MM-dd HH:mm:ss").alias(
            "published_ts"
        ),
    )


# How mail dates are written, by event, and what has to be added to reach UTC, in minutes.
MAIL_FORMS = [
    ("d MMM yy HH:mm:ss 'EST'", 300), ("EEEE, d MMMM yyyy HH:mm:ss 'GMT'", 0), ("EEE MMM d HH:mm:ss yyyy", 0),
    ("EEE d MMM yyyy HH:mm:ss 'PDT'", 420), ("MMMM d, yyyy HH:mm:ss '-0330'", 210), ("dd-MMM-yy HH:mm:ss 'CET'", 0),
]


@query(
    f"""SELECT event_id, strftime(date_trunc('second', ts) + to_minutes(CAST(CASE event_id % {len(MAIL_FORMS)}
             {" ".join(f"WHEN {place} THEN {minutes}" for place, (_, minutes) in enumerate(MAIL_FORMS))} END AS INTEGER)),
             '%Y-%m-%d %H:%M:%S') AS published_ts
    FROM events"""
)
def mail_times(spark, sf):
    forms = [F.date_format("ts", form) for form, _ in MAIL_FORMS]
    told = F.get(F.array(*forms), (F.col("event_id") % len(MAIL_FORMS)).cast("int"))
    found = V.table(spark, sf, "events").select("event_id", published_time(told).alias("published_ts"))
    return found.select("event_id", stamp("published_ts"))


@query(
    """SELECT event_id, strftime(CASE event_type
             WHEN 'click' THEN date_trunc('second', ts) - INTERVAL 330 MINUTE
             WHEN 'view' THEN date_trunc('day', ts)
             WHEN 'signup' THEN date_trunc('second', ts)
             WHEN 'purchase' THEN date_trunc('day', ts) END, '%Y-%m-%d %H:%M:%S') AS published_ts
    FROM events"""
)
def table_times(spark, sf):
    kind, ts = F.col("event_type"), F.col("ts")
    text = (
        F.when(kind == "click", F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")))
        .when(kind == "view", F.date_format(ts, "yyyyMMdd"))
        .when(kind == "signup", F.date_format(ts, "yyyyMMddHHmmss"))
        .when(kind == "purchase", F.date_format(ts, "M/d/yyyy"))
        .otherwise(F.lit("no date"))
    )
    return V.table(spark, sf, "events").select(
        "event_id", F.date_format(table_time(text), "yyyy-MM-dd HH:mm:ss").alias("published_ts")
    )


@query(
    f"""WITH split AS (SELECT doc_id, {S.split_sentences('text')} AS s FROM documents)
    SELECT doc_id, generate_subscripts(s, 1)::BIGINT AS place, unnest(s) AS sentence FROM split"""
)
def document_sentences(spark, sf):
    found = V.table(spark, sf, "documents").select(
        "doc_id", F.posexplode(T.sentences(F.col("text"))).alias("place", "sentence")
    )
    return found.select("doc_id", (F.col("place") + 1).cast("bigint").alias("place"), "sentence")


@query(f"WITH {S.ARTICLES} SELECT article_id, {S.fallback(S.DETAILS)} AS summary FROM arts")
def extractive_summaries(spark, sf):
    return N.with_summary(V.articles(spark, sf)).select("article_id", "summary")


@query(
    """SELECT doc_id, 'Src' || source[4:] || ' ' || upper(lang[1:1]) || lang[2:] AS display
    FROM documents"""
)
def label_names(spark, sf):
    raw = F.concat(F.lit(" "), "source", F.lit("_-"), "lang", F.lit("-"))
    return V.table(spark, sf, "documents").select("doc_id", T.label_name(raw).alias("display"))


@query(f"SELECT doc_id, lower({S.strip('text')}) AS trimmed FROM documents")
def trimmed_text(spark, sf):
    docs = V.table(spark, sf, "documents")
    return docs.select("doc_id", F.lower(T.strip(F.col("text"))).alias("trimmed"))


@query(
    """SELECT conv_id, turn, CASE role
             WHEN 'user' THEN '[{"id": 1, "summary": "' || text || '"}]'
             WHEN 'assistant' THEN '{"summary": "' || text || '"}'
             ELSE trim(text, ' ' || chr(10)) END AS payload
    FROM conversations"""
)
def reply_payloads(spark, sf):
    role = F.col("role")
    listed = F.concat(F.lit('[{"id": 1, "summary": "'), "text", F.lit('"},\n]'))
    single = F.concat(F.lit('{"summary": "'), "text", F.lit('",}'))
    reply = (
        F.when(role == "user", F.concat(F.lit("```json\n"), listed, F.lit("\n```")))
        .when(role == "assistant", F.concat(F.lit("Here you are: "), single, F.lit(" Enjoy")))
        .otherwise(F.col("text"))
    )
    return V.table(spark, sf, "conversations").select(
        "conv_id", "turn", R.repaired_payload(reply).alias("payload")
    )


@query(
    """SELECT CASE event_type WHEN 'click' THEN 'ok' WHEN 'view' THEN 'ok'
             WHEN 'signup' THEN 'rate_limited' ELSE 'failed' END AS outcome, count(*) AS n
    FROM events GROUP BY 1"""
)
def reply_outcomes(spark, sf):
    return Q.error_classes(V.responses(spark, sf))


@query(
    """SELECT event_id AS request_id,
           CASE WHEN event_type IN ('click', 'view') THEN props END AS content
    FROM events"""
)
def reply_contents(spark, sf):
    content = R.reply_content(F.col("status"), F.col("body"))
    return V.responses(spark, sf).select("request_id", content.alias("content"))


@query(
    """SELECT event_id, 'Subject: News (' || strftime(ts, '%d %b %Y') || ')' AS subject
    FROM events"""
)
def subject_lines(spark, sf):
    return V.table(spark, sf, "events").select(
        "event_id", T.subject_line("News", F.col("ts")).alias("subject")
    )


@query(
    f"""WITH {S.TAGGED}
    SELECT article_id, title || ' (' || category || ', ' || source || ')' || chr(10)
             || array_to_string(list_transform(string_split({S.fallback(S.DETAILS)}, chr(10)),
                  lambda s: '   ' || s), chr(10)) AS block
    FROM tagged"""
)
def digest_blocks(spark, sf):
    filled = N.with_summary(V.tagged(spark, sf))
    block = T.digest_block(F.col("title"), F.col("category"), F.col("source"), F.col("summary"))
    return filled.select("article_id", block.alias("block"))


# ---------------------------------------------------------------- streams

STREAM_CLEAN = f"""WITH {S.ARTICLES},
    cleaned AS (SELECT DISTINCT coalesce(nullif(link, ''), {S.clean('title')}) AS dedup_key
                FROM arts)"""


@query(f"{STREAM_CLEAN} SELECT dedup_key FROM cleaned WHERE dedup_key <> ''")
def stream_ingest(spark, sf):
    run = scratch_path(spark, "ingest")
    articles = feed_stream(spark, landed(spark, sf), V.feed_catalog())
    writer = ingest(articles, f"{run}/articles", f"{run}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.schema(articles.schema).parquet(f"{run}/articles")
    return kept.select(dedup_key().alias("dedup_key"))


def _rolled(spark, sf, labels=None) -> tuple[str, int, DataFrame]:
    """Three overlapping fetches of all feeds, the last two after a restart: folder, last batch."""
    run, folder = scratch_path(spark, "latest"), landed(spark, sf)
    first = spark.read.schema(RAW_FEEDS).text(folder, wholetext=True)
    for again in ((), (1000, 2000)):
        for later in again:
            once_more = first.withColumn("fetch", F.col("fetch") + later)
            once_more.write.mode("append").partitionBy("feed_rank", "fetch").text(folder)
        articles = feed_stream(spark, folder, V.feed_catalog())
        writer = rolling_latest(articles, run, f"{run}/checkpoint", labels=labels)
        running = writer.trigger(availableNow=True).start()
        running.awaitTermination()
    return run, running.lastProgress["batchId"], articles


ROLLED_SQL = f"""base AS ({FEED_SQL}),
    fresh AS (
      SELECT * FROM base WHERE article_id <> md5('')
      QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY feed_rank, entry_index) = 1
    ),
    rolled AS (
      SELECT * FROM fresh ORDER BY published_ts DESC NULLS LAST, feed_rank, entry_index LIMIT 30
    )"""


@query(f"WITH {ROLLED_SQL} SELECT * FROM rolled")
def newest_landed_articles(spark, sf):
    return _feed_columns(N.newest_landed(spark, landed(spark, sf), feeds=V.feed_catalog()))


@query(f"WITH {ROLLED_SQL} SELECT * FROM rolled")
def stream_latest(spark, sf):
    run, batch_id, articles = _rolled(spark, sf)
    newest = spark.read.schema(articles.schema).parquet(batch_folder(newest_folder(run), batch_id))
    return _feed_columns(newest)


@query(
    f"""WITH {ROLLED_SQL},
    texts AS (SELECT article_id, {S.PREMISE} AS x FROM rolled),
    {S.scored('texts', *S.one_template(V.PHRASED, fixed.ARTICLE_TEMPLATE))},
    won AS (SELECT label, count(*) AS n FROM scored WHERE rn = 1 GROUP BY 1)
    SELECT l.display AS category, true AS in_tabs, coalesce(w.n, 0) AS n
    FROM {S.label_values(V.PHRASED)} l LEFT JOIN won w ON w.label = l.label"""
)
def stream_category_counts(spark, sf):
    run, batch_id, _ = _rolled(spark, sf, V.PHRASED)
    counts = spark.read.schema("category string, in_tabs boolean, n bigint")
    return counts.parquet(batch_folder(f"{run}/counts", batch_id))
