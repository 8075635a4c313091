"""Matching recipients with articles and writing their digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings import fixed_values as fixed
from tidings.functions import text as T
from tidings.operators.articles import recency, with_summary
from tidings.operators.positions import first_of_group
from tidings.session import pin

CHOICE = ["categories", "max_articles"]


def with_choice(recipients: DataFrame) -> DataFrame:
    """Recipients with their categories in one canonical order."""
    return recipients.withColumn("categories", F.array_sort(F.array_distinct("categories")))


def leading_articles(tagged: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` articles of each category, with the columns of ``ENTRY`` and their ``place``.

    No digest of up to ``most`` articles can use more from one category, so this loses nothing.
    """
    order = [*recency(), F.col("article_id")]
    return first_of_group(tagged.select(*ENTRY), ["category"], order, most, "place")


def most_articles(recipients: DataFrame) -> int:
    """The largest digest asked for: a single number brought to the driver."""
    return recipients.agg(F.coalesce(F.max("max_articles"), F.lit(0))).first()[0]


ENTRY = ["article_id", "category", "published_ts", "feed_rank", "entry_index"]
# Places of a category's list that are matched together.
BLOCK = 32


def match_choices(leading: DataFrame, recipients: DataFrame) -> DataFrame:
    """Articles of every distinct choice of categories and size, with ``number`` 1, 2, ...

    The articles depend on the choice alone, so recipients with the same choice share the work. The
    lists of the categories are sorted and cut into blocks; a choice asks each of its lists for the
    blocks up to its own size and merges what they hold, so a large choice costs other ones nothing.
    """
    choices = with_choice(recipients).select(*CHOICE).distinct().where("max_articles > 0")
    last = F.floor((F.col("max_articles") - 1) / BLOCK)
    wanted = choices.select(*CHOICE, F.explode("categories").alias("category"), last.alias("last"))
    wanted = wanted.select(*CHOICE, "category", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block"))
    listed = leading.withColumn("block", F.floor((F.col("place") - 1) / BLOCK))
    number = F.row_number().over(Window.partitionBy(*CHOICE).orderBy(*recency()))
    return (
        wanted.join(listed, ["category", "block"])
        .where("place <= max_articles")
        .withColumn("number", number)
        .where(F.col("number") <= F.col("max_articles"))
        .select(*CHOICE, "number", "article_id")
    )


def _given(tagged: DataFrame) -> list[str]:
    return [name for name in tagged.columns if name == "summary"]


def _per_choice(matched: DataFrame, value: str) -> DataFrame:
    """One row per choice with its ``entries`` in order, at most ``max_articles`` of them.

    Written out, so that Spark knows its size when it joins the recipients: it is broadcast while
    small, and beyond that a choice shared by very many recipients is split as a skewed join.
    """
    entries = F.array_sort(F.collect_list(F.struct("number", value)))
    return pin(matched.groupBy(*CHOICE).agg(entries.alias("entries")), "choices")


def match_recipients(tagged: DataFrame, recipients: DataFrame) -> DataFrame:
    """Recipient, ``number`` and article of every digest entry."""
    leading = leading_articles(tagged, most_articles(recipients))
    per_choice = _per_choice(match_choices(leading, recipients), "article_id")
    return (
        with_choice(recipients)
        .join(per_choice, CHOICE)
        .select("recipient", F.inline("entries").alias("number", "article_id"))
    )


def numbered_blocks(blocks: Column) -> Column:
    """Blocks in order, each with its number and a closing blank line."""
    return F.transform(
        blocks,
        lambda entry: F.concat(
            entry["number"].cast("string"), F.lit(". "), entry["block"], F.lit("\n")
        ),
    )


def digests(
    tagged: DataFrame,
    recipients: DataFrame,
    as_of: Column,
    subject: str = "Your News Digest",
    sign_off: str = "News Digest",
) -> DataFrame:
    """One text per recipient: greeting, numbered articles with three-line summaries, sign-off.

    Recipients without a matching article get greeting and sign-off only.
    """
    block = T.digest_block(F.col("title"), F.col("category"), F.col("source"), F.col("summary"))
    # The newest few of each category are found without their texts; blocks are made for those
    # alone, and written since a tagged table is costly to make.
    rows = pin(tagged.select(*{*ENTRY, "title", "source", "description", *_given(tagged)}), "tagged")
    leading = pin(leading_articles(rows, most_articles(recipients)), "leading")
    matched = match_choices(leading, recipients)
    used = rows.join(leading.select("article_id"), "article_id", "left_semi")
    blocks = with_summary(used).select("article_id", block.alias("block"))
    listed = _per_choice(matched.join(blocks, "article_id"), "block")
    line = T.subject_line(subject, as_of)
    greeting = F.replace(F.lit(fixed.GREETING), F.lit("{}"), F.col("recipient"))
    blank = F.lit("")
    top = F.array(line, blank, greeting, blank, F.lit(fixed.OPENING), blank)
    bottom = F.array(blank, F.lit(fixed.CLOSING), F.lit(sign_off))
    middle = F.coalesce(numbered_blocks(F.col("entries")), F.array().cast("array<string>"))
    return (
        with_choice(recipients)
        .join(listed, CHOICE, "left")
        .select(
            "recipient",
            line.alias("subject"),
            F.array_join(F.concat(top, middle, bottom), "\n").alias("body"),
            F.coalesce(F.size("entries"), F.lit(0)).cast("bigint").alias("n_articles"),
        )
    )
