"""Corpus preparation: filters, exact samples, shuffles and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings import fixed_values as fixed
from tidings.functions.text import contains_any, strip
from tidings.operators.articles import head_in_order
from tidings.operators.positions import fresh_column, least_keys, rejoin, with_position
from tidings.session import pin
from tidings.sources.labels import Label
from tidings.sources.tables import FILE_ORDER


def label_is_known(column: str, labels: list[Label] | list[str]) -> Column:
    names = [label.label if isinstance(label, Label) else label for label in labels]
    return F.coalesce(F.col(column).isin(*names), F.lit(False))


def filter_by_vocab(df: DataFrame, labels: list[Label], column: str = "label") -> DataFrame:
    """Rows whose label is in the vocabulary; a list this short is a filter, not a join."""
    return df.where(label_is_known(column, labels))


def out_of_vocab(df: DataFrame, labels: list[Label], column: str = "label") -> DataFrame:
    """Rows whose label is outside the vocabulary, missing labels included."""
    return df.where(~label_is_known(column, labels))


def prepare_eval(df: DataFrame, labels: list[Label], keep: tuple[str, ...] = ()) -> DataFrame:
    """Evaluation pairs ``x``, ``y`` from columns ``text`` and ``label``."""
    pairs = df.na.drop(subset=["text", "label"]).select(
        *keep, strip(F.col("text")).alias("x"), strip(F.col("label")).alias("y")
    )
    return filter_by_vocab(pairs.where("x <> ''"), labels, "y")


def keyword_filter(
    df: DataFrame, column: str, keywords: list[str] | None = None, whole_words: bool = False
) -> DataFrame:
    """Rows whose text contains a keyword, also inside a longer word."""
    words = fixed.CRIME_KEYWORDS if keywords is None else keywords
    return df.where(contains_any(F.col(column), words, whole_words))


def keyword_subset(
    df: DataFrame,
    column: str,
    keywords: list[str] | None = None,
    n: int = fixed.KEYWORD_LIMIT,
    order: list[str] = FILE_ORDER,
) -> DataFrame:
    """The first ``n`` keyword matches in file order; ``order`` tells rows apart.

    Texts are matched once: the places of all matches are written, and the first ``n`` of them fetch
    their rows.
    """
    places = pin(keyword_filter(df, column, keywords).select(*order), "matches")
    chosen = head_in_order(places, n, order)
    return df.join(chosen, order, "left_semi").select(*df.columns).orderBy(*order)


def seeded_key(seed: int, id_column: str) -> Column:
    """A repeatable random sort key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))


def stratified_sample(
    df: DataFrame,
    by: str,
    n: int = fixed.SAMPLE_PER_CLASS,
    seed: int = fixed.SAMPLE_SEED,
    id_column: str = "article_id",
) -> DataFrame:
    """Exactly min(n, class size) rows of each class, without replacement.

    The least sort keys of each class are found by counting, so no class meets in one task; the rows
    chosen do not depend on the partitioning. ``id_column`` is unique.
    """
    key = fresh_column(df, "sample_key")
    return least_keys(df.withColumn(key, seeded_key(seed, id_column)), [by], key, n).drop(key)


def shuffle_rows(
    df: DataFrame, seed: int = fixed.SAMPLE_SEED, id_column: str = "article_id"
) -> DataFrame:
    """All rows in a repeatable random order, numbered from 1 in ``shuffle_pos``."""
    narrow = df.select(id_column, seeded_key(seed, id_column).alias("_key"))
    order = [F.col("_key").asc(), F.col(id_column).asc()]
    placed = with_position(narrow, [], order, "shuffle_pos").drop("_key")
    return rejoin(df, placed, id_column)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), column)


def balance_report(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Rows per class before and after sampling."""
    was = before.groupBy(column).agg(F.count(F.lit(1)).alias("n_before"))
    now = after.groupBy(column).agg(F.count(F.lit(1)).alias("n_after"))
    return was.join(now, column, "full").na.fill(0, ["n_before", "n_after"])


def class_share(df: DataFrame, column: str) -> DataFrame:
    """Rows and share of each class."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counted.select(column, "n", F.round(F.col("n") / total, 4).alias("share"))


def keep_rate(df: DataFrame, keep: Column) -> DataFrame:
    """How many rows a filter keeps, in one pass."""
    kept, total = F.count_if(keep), F.count(F.lit(1))
    return df.agg(
        kept.alias("kept"),
        total.alias("total"),
        F.round(F.try_divide(kept, total), 4).alias("rate"),
    )
