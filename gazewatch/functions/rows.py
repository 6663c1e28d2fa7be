"""Filters on values that are costly to compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_present(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column and keep the rows where it is not null.

    An ordinary filter would be pushed below the projection together with a second
    copy of the expression. Exploding an array of at most one value computes it once.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array_compact(F.array(value))).alias(name))
