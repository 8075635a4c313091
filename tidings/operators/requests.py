"""Batches of summary requests and the replies to them, as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings import fixed_values as fixed
from tidings.functions import replies as R
from tidings.functions import text as T
from tidings.operators.articles import recency
from tidings.operators.positions import paced_starts, rejoin, with_position
from tidings.session import pin

# A responder turns requests into responses, for example by calling a service from each task.
Responder = Callable[[DataFrame], DataFrame]


def pack_requests(articles: DataFrame, k: int, key: list[str] | None = None) -> DataFrame:
    """Requests of up to ``k`` articles, each a JSON list with ids 1..k and the prompt around it.

    Only keys and times are numbered; titles and texts join afterwards.
    """
    keys = key or []
    narrow = articles.select("article_id", *keys, "published_ts", "feed_rank", "entry_index")
    placed = with_position(narrow, keys, recency()).select(
        "article_id",
        F.floor((F.col("position") - 1) / k).cast("bigint").alias("batch"),
        ((F.col("position") - 1) % k + 1).cast("int").alias("id"),
    )
    texts = articles.select(
        "article_id", *keys, "title", T.details(F.col("title"), F.col("description")).alias("details")
    )
    item = F.struct("id", F.coalesce("title", F.lit("")).alias("title"), "details")
    packed = (
        texts.join(placed, "article_id")
        .groupBy(*keys, "batch")
        .agg(
            F.array_sort(F.collect_list(item)).alias("items"),
            F.array_sort(F.collect_list(F.struct("id", "article_id"))).alias("members"),
        )
    )
    payload = F.to_json("items", {"writeNonAsciiCharacterAsCodePoint": "true"})
    return packed.select(
        F.md5(F.concat_ws(":", *(F.col(name).cast("string") for name in keys), "batch")).alias(
            "request_id"
        ),
        *keys,
        "batch",
        "members",
        F.concat(F.lit(fixed.BATCH_PROMPT), payload).alias("payload"),
    )


def request_members(requests: DataFrame) -> DataFrame:
    """Which article has which id in which request."""
    return requests.select("request_id", F.inline("members").alias("id", "article_id"))


def single_prompts(articles: DataFrame) -> DataFrame:
    """One request per article, with its title and details in the prompt."""
    context = F.concat(
        F.lit(fixed.SINGLE_PROMPT + fixed.TITLE_FIELD),
        F.coalesce("title", F.lit("")),
        F.lit(fixed.DETAILS_FIELD),
        T.details(F.col("title"), F.col("description")),
    )
    return articles.select("article_id", context.alias("payload"))


def successes(responses: DataFrame) -> DataFrame:
    """Content of the first successful reply to each request."""
    content = R.reply_content(F.col("status"), F.col("body"))
    attempt = F.col("attempt") if "attempt" in responses.columns else F.lit(1)
    return (
        responses.select("request_id", attempt.alias("attempt"), content.alias("content"))
        .where("content IS NOT NULL")
        .groupBy("request_id")
        .agg(F.min_by("content", "attempt").alias("content"))
    )


def coalesce_responses(requests: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """The first provider's content, else the second's, else an error."""
    a = successes(first).withColumnRenamed("content", "_first")
    b = successes(second).withColumnRenamed("content", "_second")
    joined = requests.join(a, "request_id", "left").join(b, "request_id", "left")
    content = F.coalesce("_first", "_second")
    provider = F.when(F.col("_first").isNotNull(), "first").when(
        F.col("_second").isNotNull(), "second"
    )
    error = F.when(content.isNull(), "Both providers failed.")
    return joined.select(
        *requests.columns,
        content.alias("content"),
        provider.alias("provider"),
        error.alias("error"),
    )


def parse_replies(replies: DataFrame) -> DataFrame:
    """Summary per request and id from ``content``. The last entry with an id counts; entries that
    are no object or whose id is no whole number are skipped."""
    items = replies.select(
        "request_id", F.posexplode(R.parsed_items(F.col("content"))).alias("place", "item")
    )
    id_type = F.schema_of_variant(F.try_variant_get("item", "$.id", "variant"))
    as_number = F.try_variant_get("item", "$.id", "bigint")
    as_flag = F.try_variant_get("item", "$.id", "boolean").cast("bigint")
    is_text = F.schema_of_variant(F.try_variant_get("item", "$.summary", "variant")) == "STRING"
    text = F.when(is_text, F.try_variant_get("item", "$.summary", "string"))
    typed = items.select(
        "request_id",
        "place",
        F.when(id_type == "BIGINT", as_number).when(id_type == "BOOLEAN", as_flag).alias("id"),
        F.coalesce(text, F.lit("")).alias("summary"),
    ).where("id IS NOT NULL")
    last = typed.groupBy("request_id", "id").agg(F.max_by("summary", "place").alias("summary"))
    return last.select("request_id", "id", T.clean_summary_text(F.col("summary")).alias("summary"))


def attach_summaries(
    articles: DataFrame, members: DataFrame, parsed: DataFrame
) -> DataFrame:
    """Articles with their reply summary, or their first sentences where there is none."""
    replied = members.join(parsed, ["request_id", "id"]).select(
        "article_id", F.col("summary").alias("_reply")
    )
    given = T.strip(F.col("_reply"))
    # Made before the join, so that a few lines travel where a caller does not keep the texts.
    fallback = T.fallback_summary(T.details(F.col("title"), F.col("description")))
    origin = F.when(T.or_else(given, F.lit(None)).isNotNull(), "reply").otherwise("fallback")
    return (
        articles.withColumn("_fallback", fallback)
        .join(replied, "article_id", "left")
        .withColumn("summary", T.or_else(given, F.col("_fallback")))
        .withColumn("summary_source", origin)
        .drop("_reply", "_fallback")
    )


def summarize(
    articles: DataFrame, k: int, first: Responder, second: Responder
) -> DataFrame:
    """Articles with summaries from two responders, the second standing in for the first."""
    requests = pin(pack_requests(articles, k), "requests")
    outgoing = requests.select("request_id", "payload")
    # Replies are costly to get, so they are written before they are used.
    answered = pin(
        coalesce_responses(outgoing.select("request_id"), first(outgoing), second(outgoing)),
        "replies",
    )
    return attach_summaries(articles, request_members(requests), parse_replies(answered))


def error_classes(responses: DataFrame) -> DataFrame:
    """Replies by outcome: fine, refused for rate or quota, or failed otherwise."""
    ok = R.reply_content(F.col("status"), F.col("body")).isNotNull()
    outcome = (
        F.when(ok, "ok")
        .when(R.is_rate_limited(F.col("error"), F.col("status")), "rate_limited")
        .otherwise("failed")
    )
    return responses.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


ARRIVAL = ["api_key_id", "arrival_ts", "request_id"]


def quota(requests: DataFrame, per_day: int = fixed.REQUESTS_PER_DAY) -> DataFrame:
    """Mark the first ``per_day`` requests of each key and UTC day as admitted; 0 is no limit."""
    if per_day <= 0:
        return requests.withColumn("admitted", F.lit(True))
    dated = requests.select(*ARRIVAL, F.to_date("arrival_ts").alias("_day"))
    order = [F.col("arrival_ts").asc(), F.col("request_id").asc()]
    placed = with_position(dated, ["api_key_id", "_day"], order, "_nth")
    admitted = (F.col("_nth") <= per_day).alias("admitted")
    return rejoin(requests, placed.select(*ARRIVAL, admitted), "request_id")


def pace(requests: DataFrame, per_minute: float = fixed.REQUESTS_PER_MINUTE) -> DataFrame:
    """Start time of each request when those of a key are at least 60/``per_minute`` s apart."""
    if per_minute <= 0:
        raise ValueError("per_minute must be positive")
    gap = round(60_000_000 / per_minute)
    timed = requests.select(*ARRIVAL, F.unix_micros("arrival_ts").alias("_arrival"))
    order = [F.col("_arrival").asc(), F.col("request_id").asc()]
    paced = paced_starts(timed, ["api_key_id"], order, "_arrival", gap)
    started = paced.select(*ARRIVAL, F.timestamp_micros("start").alias("start_ts"))
    return rejoin(requests, started, "request_id")
