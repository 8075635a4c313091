"""Label vocabularies: ordered lists that a user writes, kept as plain values next to the plan."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings import fixed_values as fixed
from tidings.functions.text import label_name, strip


class Label(NamedTuple):
    label: str
    display: str


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a label file, trimmed, blanks dropped, in file order."""
    lines = F.posexplode(F.split("value", fixed.LINE_BREAK)).alias("line", "text")
    trimmed = (
        spark.read.text(path, wholetext=True)
        .select(lines)
        .select("line", strip(F.col("text")).alias("label"))
        .where("label <> ''")
    )
    return trimmed.select(
        F.col("line").cast("bigint").alias("line"), "label", label_name("label").alias("display")
    )


def read_labels(spark: SparkSession, path: str | None = None) -> list[Label]:
    """Vocabulary of a label file; the default one where there is no file or no label."""
    rows = []
    if path:
        try:
            rows = label_lines(spark, path).orderBy("line").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    if not rows:
        return [Label(*pair) for pair in fixed.DEFAULT_LABELS]
    return [Label(row["label"], row["display"]) for row in rows]


def label_table(spark: SparkSession, labels: list[Label]) -> DataFrame:
    """The vocabulary as a table, with its order in ``label_rank``."""
    rows = [(rank, *label) for rank, label in enumerate(labels)]
    return spark.createDataFrame(rows, "label_rank int, label string, display string")
