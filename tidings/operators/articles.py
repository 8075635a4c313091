"""Article tables: deduplication, order, selection and presentation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidings import fixed_values as fixed
from tidings.functions import text as T
from tidings.functions.once import with_once
from tidings.session import pin
from tidings.sources.feeds import dedup_key, fetch_of, landed_feeds, parse_feeds
from tidings.sources.tables import FILE_ORDER

FIRST_SEEN = ["feed_rank", "entry_index"]
# Together these tell rows apart, also where a source numbers nothing.
ROW = [*FIRST_SEEN, "article_id"]


def recency() -> list[Column]:
    """Newest first, undated last, ties in feed and entry order; unnumbered rows after the others."""
    order = [F.col(name).asc_nulls_last() for name in FIRST_SEEN]
    return [F.col("published_ts").desc_nulls_last(), *order]


def union_articles(*tables: DataFrame) -> DataFrame:
    """All articles of several sources, copies included; columns a source lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def drop_unkeyed(df: DataFrame) -> DataFrame:
    """Articles with a link or a title."""
    return df.where(dedup_key() != "")


def dedup_first_seen(df: DataFrame) -> DataFrame:
    """The first copy of each article in feed and entry order, which need not be the newest.

    Rank 1 is taken inside each input partition before the shuffle, so a key shared by many rows
    sends one row per partition. Rows without a key would all meet in one group; they go first.
    """
    first = Window.partitionBy("_key").orderBy(*(F.col(name).asc_nulls_last() for name in ROW))
    return (
        with_once(df, _key=dedup_key())
        .where("_key <> ''")
        .withColumn("_seen", F.row_number().over(first))
        .where("_seen = 1")
        .drop("_key", "_seen")
    )


def top_rows(df: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` rows of a narrow or small frame."""
    return df.orderBy(*recency(), "article_id").limit(n)


def _fetch(df: DataFrame, chosen: DataFrame, n: int, unique: bool = False) -> DataFrame:
    """The ``n`` articles chosen, in order. Rows are told apart by ``ROW``, NULL equal to NULL;
    of rows that are alike in it any may stay, so the number is right in any case."""
    names = {name: f"_{name}" for name in ROW}
    keys = chosen.select(*ROW).distinct().withColumnsRenamed(names)
    same = [F.col(name).eqNullSafe(F.col(other)) for name, other in names.items()]
    found = df.join(keys, same, "left_semi")
    return top_rows(found.dropDuplicates(ROW) if unique else found, n)


def latest(df: DataFrame, n: int = fixed.NEWEST) -> DataFrame:
    """The newest ``n`` articles, in order.

    Every input partition sends ``n`` rows to the task that merges them, so only times and positions
    travel; texts are fetched for the rows that stay.
    """
    return _fetch(df, top_rows(df.select("published_ts", *ROW), n), n)


def newest_unique(df: DataFrame, n: int = fixed.NEWEST) -> DataFrame:
    """The newest ``n`` articles after deduplication, decided on keys and times alone."""
    narrow = df.select("link", "title", "published_ts", *ROW)
    return _fetch(df, top_rows(dedup_first_seen(narrow), n), n, unique=True)


def newest_landed(
    spark: SparkSession,
    folder: str,
    n: int = fixed.NEWEST,
    feeds: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """The newest ``n`` unique articles of a feed folder.

    All documents are read once for keys and times; an article's place tells the document it came
    from, and only the ``n`` documents named at most are read again, for the texts.
    """
    documents = landed_feeds(spark, folder)
    narrow = parse_feeds(documents, feeds).select("link", "title", "published_ts", *ROW)
    chosen = pin(top_rows(dedup_first_seen(narrow), n).select(*ROW), "newest")
    named = chosen.select("feed_rank", fetch_of(F.col("entry_index")).alias("fetch")).distinct().collect()
    # Both columns are partitions of the folder, so other documents are not even opened.
    of = F.concat_ws("/", "feed_rank", "fetch").isin([f"{row.feed_rank}/{row.fetch}" for row in named])
    return _fetch(parse_feeds(documents.where(of), feeds), chosen, n, unique=True)


def head_in_order(df: DataFrame, n: int, order: list[str] = FILE_ORDER) -> DataFrame:
    """The first ``n`` rows in file order.

    The rows of each file split are counted first, then only splits that hold one of the first ``n``
    rows are sorted. As every counted split has a row, ``n`` of them are enough.
    """
    split = order[:-1]
    if not split:
        return df.orderBy(*order).limit(n)
    sizes = df.groupBy(*split).agg(F.count(F.lit(1)).alias("_n")).orderBy(*split).limit(n)
    earlier = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    needed = (
        sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .where(F.col("_before") < n)
        .select(*split)
    )
    kept = df.join(needed, split, "left_semi").select(*df.columns)
    return kept.orderBy(*order).limit(n)


def newest_rows(df: DataFrame, n: int = fixed.NEWEST) -> DataFrame:
    """The first ``n`` rows of a file, newest first where it has dates."""
    return df.orderBy(F.col("published_ts").desc_nulls_last(), *FILE_ORDER).limit(n)


def filter_categories(df: DataFrame, categories: list[str]) -> DataFrame:
    return df.where(F.col("category").isin(*categories))


def with_details(df: DataFrame) -> DataFrame:
    return df.withColumn("details", T.details(F.col("title"), F.col("description")))


def with_summary(df: DataFrame) -> DataFrame:
    """Fill a missing or blank ``summary`` with the first sentences of the article."""
    given = F.col("summary") if "summary" in df.columns else F.lit(None).cast("string")
    return df.withColumn(
        "summary", T.summary_or_fallback(given, F.col("title"), F.col("description"))
    )


def cards(df: DataFrame) -> DataFrame:
    """Heading, caption and summary of each article."""
    return with_summary(df).select(
        "article_id",
        T.card_heading(F.col("title"), F.col("link")).alias("heading"),
        T.card_caption(F.col("source"), F.col("published"), F.col("confidence")).alias("caption"),
        "summary",
    )
