"""Costly columns evaluated once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps reuse without evaluating them again.

    The optimizer copies a plain column into every later filter, and into the condition it derives
    for an ``explode``. A generator of one element stops that: filters on its output stay above it,
    and it keeps exactly one row per row.
    """
    fields = F.struct(*(column.alias(name) for name, column in columns.items()))
    return df.select("*", F.inline_outer(F.array(fields)))
