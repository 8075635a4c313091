"""Feeds or a CSV table to tagged, bucketed articles and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings import fixed_values as fixed
from tidings.functions.times import table_time
from tidings.operators.articles import cards, newest_landed, newest_rows, newest_unique, with_summary
from tidings.operators.labelling import Scorer, category_counts, classify
from tidings.sources.labels import Label, read_labels
from tidings.sources.tables import FILE_ORDER, drop_blank_titles, normalize_rows, resolved_rows


def newest_with_summaries(articles: DataFrame, n: int = fixed.NEWEST) -> DataFrame:
    """The newest unique articles, each with a three-line summary."""
    return with_summary(newest_unique(articles, n))


def feed_briefing(
    spark: SparkSession,
    folder: str,
    labels: list[Label] | None = None,
    n: int = fixed.NEWEST,
    scorer: Scorer | None = None,
) -> DataFrame:
    """Newest unique feed articles with category and confidence."""
    return classify(newest_landed(spark, folder, n), labels or read_labels(spark), scorer=scorer)


def csv_briefing(
    spark: SparkSession,
    path: str,
    labels: list[Label] | None = None,
    n: int = fixed.NEWEST,
    scorer: Scorer | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """First or newest rows of a CSV table with category and confidence; copies stay."""
    # Rows are put in order first, and only those that stay are cleaned.
    rows = drop_blank_titles(resolved_rows(spark, path, multi_line))
    when = table_time(F.col("published")) if "published" in rows.columns else F.lit(None)
    chosen = newest_rows(rows.withColumn("published_ts", when.cast("timestamp")), n)
    articles = normalize_rows(chosen.drop("published_ts"))
    ordered = articles.orderBy(F.col("published_ts").desc_nulls_last(), *FILE_ORDER)
    return classify(ordered, labels or read_labels(spark), scorer=scorer)


def tabs(tagged: DataFrame, labels: list[Label]) -> tuple[DataFrame, DataFrame]:
    """Articles per category, and the cards to show."""
    return category_counts(tagged, labels), cards(tagged)
