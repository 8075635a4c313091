"""Corpus files: a keyword subset and a class-balanced sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings import fixed_values as fixed
from tidings.functions.text import strip
from tidings.operators.corpus import (
    balance_report,
    keyword_subset,
    label_is_known,
    shuffle_rows,
    stratified_sample,
)
from tidings.session import pin
from tidings.sources.tables import FILE_ORDER, read_csv, write_corpus


def keyword_corpus(
    spark: SparkSession, path: str, column: str = "headline_text", multi_line: bool = False
) -> DataFrame:
    """The first keyword matches of a headline file."""
    return keyword_subset(read_csv(spark, path, multi_line), column)


def balanced_corpus(
    df: DataFrame,
    column: str = "headline_category",
    classes: list[str] | None = None,
    n: int = fixed.SAMPLE_PER_CLASS,
    seed: int = fixed.SAMPLE_SEED,
    id_column: str = "article_id",
) -> tuple[DataFrame, DataFrame]:
    """Shuffled sample of up to ``n`` rows per class, and the counts before and after."""
    wanted = fixed.BALANCED_CLASSES if classes is None else classes
    kept = df.withColumn(column, strip(F.col(column).cast("string"))).where(
        label_is_known(column, wanted)
    )
    # The shuffle and the report both read the sample.
    sample = pin(stratified_sample(kept, column, n, seed, id_column), "sample")
    return shuffle_rows(sample, seed, id_column), balance_report(kept, sample, column)


def write_keyword_corpus(spark: SparkSession, source: str, target: str) -> None:
    write_corpus(keyword_corpus(spark, source).orderBy(*FILE_ORDER).drop(*FILE_ORDER), target)
