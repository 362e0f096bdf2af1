"""Columns that are worked out exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns, like ``withColumns``, but behind a barrier for filters.

    Spark moves a filter below a projection by repeating the projected expressions
    inside the filter, and it infers such filters from joins and explodes. In a chain of
    derived arrays the repeats multiply. No filter on a generated column moves below its
    generator, so the columns come out of one.
    """
    fields = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(fields)))
