"""The given tables seen as articles, corpora, recipients, requests and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.operators.labelling import classify
from tidings.operators.requests import pack_requests, request_members
from tidings.plans.evaluation import eval_pairs, predict
from tidings.session import pin
from tidings.sources.labels import Label

LABELS = [Label("en", "EN"), Label("fr", "FR"), Label("es", "ES"), Label("de", "DE")]
SOME_LABELS = LABELS[:3]
PHRASES = {
    "en": "the and of that",
    "fr": "le et les une",
    "es": "el los del por",
    "de": "der und den das",
}
PHRASED = [Label(PHRASES[label.label], label.display) for label in LABELS]
TEMPLATE = "This text is in {}."
KEYWORDS = ["ing th", "lich", "ciudad"]
SEGMENT_CATEGORIES = {
    "AUTOMOBILE": ["FR", "DE"],
    "BUILDING": ["EN"],
    "FURNITURE": ["ES", "DE", "EN"],
    "HOUSEHOLD": ["EN", "FR", "ES", "DE"],
    "MACHINERY": ["FR", "EN"],
}
BATCH = 20
DOCS_PER_FETCH = 2000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # Times in the tables carry no zone; they are read as UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as articles: the first line is the title, the rest the description; the page with
    the same number gives the link, the event with the same number the time unless it is an error.
    """
    docs = table(spark, sf, "documents")
    pages = table(spark, sf, "pages").select("page_id", "url")
    dated = F.when(F.col("event_type") != "error", F.col("ts"))
    events = table(spark, sf, "events").select("event_id", dated.alias("ts"))
    title = F.substring_index("text", "\n", 1)
    return (
        docs.join(pages, F.col("page_id") == F.col("doc_id"), "left")
        .join(events, F.col("event_id") == F.col("doc_id"), "left")
        .select(
            F.concat(F.lit("d"), "doc_id").alias("article_id"),
            "source",
            F.substr("source", F.lit(4)).cast("int").alias("feed_rank"),
            F.col("doc_id").alias("entry_index"),
            title.alias("title"),
            F.coalesce("url", F.lit("")).alias("link"),
            F.substr("text", F.length(title) + 2).alias("description"),
            F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("published"),
            F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("published_ts"),
            "lang",
        )
    )


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    return classify(articles(spark, sf), PHRASED, TEMPLATE)


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a labelled corpus with foreign column names."""
    return table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("headline_text"), F.col("lang").alias("category")
    )


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return eval_pairs(corpus(spark, sf), LABELS)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return predict(pairs(spark, sf), LABELS, TEMPLATE)


def recipients(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as recipients: the market segment sets the categories, the nation the size."""
    chosen: Column = F.lit(None).cast("array<string>")
    for segment, names in SEGMENT_CATEGORIES.items():
        wanted = F.array(*(F.lit(name) for name in names))
        chosen = F.when(F.col("c_mktsegment") == segment, wanted).otherwise(chosen)
    return table(spark, sf, "customer").select(
        F.col("c_name").alias("recipient"),
        chosen.alias("categories"),
        (F.col("c_nationkey") + 5).alias("max_articles"),
    )


def _escaped(text: Column) -> Column:
    amps = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(amps, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def feed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Articles as feed documents: RSS for even feeds, Atom for odd ones. Pages give the description
    where there is one. A document holds the entries of a fixed range of numbers."""
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("entry_index"), "html")
    found = articles(spark, sf).join(pages, "entry_index", "left")
    body = _escaped(F.coalesce("html", "description"))
    when = F.to_timestamp(F.nullif("published", F.lit("")))
    rss = F.concat(
        F.lit("<item><title>"), _escaped(F.col("title")), F.lit("</title><link>"),
        _escaped(F.col("link")), F.lit("</link><description>"), body,
        F.lit("</description><pubDate>"),
        F.coalesce(F.date_format(when, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.lit("")),
        F.lit("</pubDate></item>"),
    )
    atom = F.concat(
        F.lit('<entry><title type="text">'), _escaped(F.col("title")),
        F.lit('</title><link rel="self" href="x"/><link rel="alternate" href="'),
        _escaped(F.col("link")), F.lit('"/><summary>'), body, F.lit("</summary><updated>"),
        F.col("published"), F.lit("</updated></entry>"),
    )
    is_rss = F.col("feed_rank") % 2 == 0
    entry = F.struct("entry_index", F.when(is_rss, rss).otherwise(atom).alias("xml"))
    joined = F.array_join(F.col("entries.xml"), "")
    document = F.when(
        is_rss, F.concat(F.lit("<rss><channel>"), joined, F.lit("</channel></rss>"))
    ).otherwise(F.concat(F.lit("<feed>"), joined, F.lit("</feed>")))
    return (
        found.select(
            "feed_rank", F.floor(F.col("entry_index") / DOCS_PER_FETCH).alias("fetch"),
            entry.alias("entry"),
        )
        .groupBy("feed_rank", "fetch")
        .agg(F.array_sort(F.collect_list("entry")).alias("entries"))
        .select(document.alias("value"), "feed_rank", "fetch")
    )


def feed_catalog() -> list[tuple[str, str]]:
    return [(f"src{rank}", f"https://example.org/{rank}") for rank in range(20)]


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Events as summary requests, one key per kind of event."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("event_type").alias("api_key_id"),
        F.col("ts").cast("timestamp").alias("arrival_ts"),
    )


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Events as provider replies: errors failed, sign-ups were refused, purchases lack content."""
    kind = F.col("event_type")
    content = F.struct(F.struct(F.col("props").alias("content")).alias("message"))
    good = F.to_json(F.struct(F.array(content).alias("choices")))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        F.when(kind == "error", 500).when(kind == "signup", 429).otherwise(200).alias("status"),
        F.when(kind == "error", F.concat(F.lit("Server broke on "), "props"))
        .when(kind == "signup", F.lit("Slow down"))
        .alias("error"),
        F.when(kind == "purchase", F.lit('{"choices": []}'))
        .when(kind.isin("click", "view"), good)
        .alias("body"),
    )


def batch_requests(spark: SparkSession, sf: str) -> DataFrame:
    return pack_requests(articles(spark, sf), BATCH)


def sent_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Members of the packed requests, written once since requests and replies both use them."""
    return pin(batch_requests(spark, sf).select("request_id", "batch", "members"), "sent")


def batch_replies(
    spark: SparkSession, sf: str, packed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Replies of two providers to packed requests, as (first, second).

    Summaries are the assistant turns of a conversation, so articles beyond the conversations get none. Some replies are
    fenced, some end in a stray comma; every fifth first reply and every tenth second one fails.
    """
    said = F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text"))))
    turns = (
        table(spark, sf, "conversations").groupBy("conv_id")
        .agg(F.when(F.size(said) > 0, F.array_join(said["text"], " ")).alias("text"))
        .select(F.concat(F.lit("d"), "conv_id").alias("article_id"), "text")
    )
    item = F.concat(
        F.lit('{"id": '), F.col("id").cast("string"), F.lit(', "summary": "'), "text", F.lit('"}')
    )
    per_batch = (
        request_members(packed).join(packed.select("request_id", "batch"), "request_id")
        .join(turns, "article_id", "left")
        .groupBy("request_id", "batch")
        .agg(F.array_join(F.array_sort(F.collect_list(item)), ", ").alias("items"))
    )
    batch = F.col("batch")
    listed = F.concat(
        F.lit("["), "items",
        F.when((batch % 11 == 0) & (F.col("items") != ""), ",\n").otherwise(""), F.lit("]"),
    )
    fenced = F.when(batch % 7 == 0, F.concat(F.lit("```json\n"), listed, F.lit("\n```")))
    content = F.coalesce(fenced, listed)
    message = F.struct(F.struct(content.alias("content")).alias("message"))
    good = F.to_json(F.struct(F.array(message).alias("choices")))

    def provider(fails: Column) -> DataFrame:
        return per_batch.select(
            "request_id",
            F.when(fails, 429).otherwise(200).alias("status"),
            F.when(fails, "quota reached").alias("error"),
            F.when(~fails, good).alias("body"),
        )

    return provider(batch % 5 == 0), provider(batch % 10 == 0)
