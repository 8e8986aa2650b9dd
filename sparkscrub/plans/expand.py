"""One row per element of an array that is expensive to compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expand(df: DataFrame, rest: list[str], generator: Column, filled: str) -> DataFrame:
    """Rows of an *outer* ``generator`` next to the columns ``rest``; rows without an element,
    known by an empty column ``filled``, are dropped after it.

    For an inner generator the optimizer tests the size of the array beforehand, and so
    computes it twice.
    """
    return df.select(*rest, generator).where(F.col(filled).isNotNull())
