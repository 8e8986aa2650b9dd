"""Detection as a table operation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscrub.functions.spans import SPANS_TYPE, spans_sql
from sparkscrub.functions.sqltext import column, let
from sparkscrub.plans.expand import expand
from sparkscrub.plans.handlers import analysed_sql


def detect(
    df: DataFrame,
    text: str = "text",
    entities: Iterable[str] | None = None,
    terms: dict | None = None,
    kind: str | None = None,
    output: str = "spans",
) -> DataFrame:
    """Add ``output``: all spans of the chosen types (start, end, entity_type, value)."""
    text, kind = column(df, text), kind and column(df, kind)
    return df.withColumn(output, F.expr(spans_sql(let(text, lambda t: analysed_sql(t, kind), "t"), entities, terms)))


def explode_spans(df: DataFrame, spans: str = "spans") -> DataFrame:
    """One row per span; rows without a span drop out."""
    if spans not in df.columns:
        raise ValueError(f"no column {spans} of type {SPANS_TYPE}")
    return expand(df, [c for c in df.columns if c != spans], F.inline_outer(spans), "start")


def select_spans(spans: DataFrame, entities: Iterable[str] | None = None) -> DataFrame:
    """Keep the rows of the chosen types; an empty choice keeps all."""
    chosen = list(entities or ())
    return spans.where(F.col("entity_type").isin(chosen)) if chosen else spans
