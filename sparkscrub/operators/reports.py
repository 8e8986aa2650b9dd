"""Audits and reports on masking."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscrub.catalog import entity_catalog, select_entities
from sparkscrub.functions.spans import ranked_values_sql
from sparkscrub.operators.automaton import automaton_values
from sparkscrub.operators.detect import detect, explode_spans
from sparkscrub.operators.matching import find_values
from sparkscrub.plans.sizing import materialize


def leaks(
    masked: DataFrame,
    known: DataFrame,
    text: str = "masked",
    key: list[str] | None = None,
    automaton: bool = False,
) -> DataFrame:
    """Rows ``key, value``: a known string is still present in a masked text.

    ``known`` has a column ``value`` and may be of any size. With ``automaton`` all strings
    are looked for in one reading of each text, in Python workers; else pieces are joined.
    """
    key = key or ["part_id"]
    values = known.select("value").distinct()
    return (automaton_values if automaton else find_values)(masked, values, [], key, text)


def leak_check(
    masked: DataFrame,
    known: DataFrame,
    text: str = "masked",
    key: list[str] | None = None,
    automaton: bool = False,
) -> DataFrame:
    """For each known string: in how many masked texts it is still present, zero included."""
    values = materialize(known.select("value").distinct(), "known")
    found = leaks(masked, values, text, key, automaton).groupBy("value").agg(F.count("*").alias("n_texts"))
    return values.join(found, "value", "left").select(
        "value", F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.col("n_texts").isNotNull().alias("leaked")
    )


def residual_pii(
    masked: DataFrame,
    text: str = "masked",
    entities: Iterable[str] | None = None,
    terms: dict | None = None,
    kind: str | None = None,
) -> DataFrame:
    """Detect on the masked text again; every span that comes back, one per row, is a leak."""
    return explode_spans(detect(masked, text, entities, terms, kind))


def unmasked_rows(
    df: DataFrame,
    before: str = "text",
    after: str = "masked",
    entities: Iterable[str] | None = None,
    terms: dict | None = None,
) -> DataFrame:
    """Rows whose text did not change though it holds a hit. Where the two texts are in
    different tables, join them on their key first (``before_and_after``)."""
    # The cheap test comes first: detection runs on unchanged texts only.
    same = df.where(F.col(before) == F.col(after))
    return same.where(f"size({ranked_values_sql(before, entities, terms)}) > 0")


def before_and_after(
    before: DataFrame, after: DataFrame, key: list[str], text: str = "text", masked: str = "masked"
) -> DataFrame:
    """The original and the masked text of each row, joined on the key."""
    return before.select(*key, text).join(after.select(*key, masked), key)


def rows_without_hits(df: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """Rows of which no span is known."""
    return df.join(spans.select(*key).distinct(), key, "left_anti")


def size_report(
    df: DataFrame, before: str = "text", after: str = "masked", by: list[str] | None = None
) -> DataFrame:
    """Original and masked size in bytes, in all or per group."""
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("n_texts"),
        F.sum(F.octet_length(before)).alias("original_bytes"),
        F.sum(F.octet_length(after)).alias("masked_bytes"),
    )


def entity_report(spans: DataFrame, entities: Iterable[str] | None = None) -> DataFrame:
    """Hits and distinct values per chosen entity type, types without hits included.

    Values are counted per type and value first, so a type with most of the hits does
    not end up in one task.
    """
    chosen = select_entities(entities)
    per_value = spans.groupBy("entity_type", "value").agg(F.count("*").alias("n"))
    per_type = per_value.groupBy("entity_type").agg(
        F.sum("n").alias("hits"), F.count("*").alias("distinct_values")
    )
    catalog = entity_catalog(spans.sparkSession).where(F.col("entity_type").isin(list(chosen)))
    return catalog.join(F.broadcast(per_type), "entity_type", "left").select(
        "entity_type",
        "description",
        F.coalesce("hits", F.lit(0)).alias("hits"),
        F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"),
    )


def attachment_report(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Attachments (parts with a file name) per content type."""
    content_type: Column = F.concat_ws("/", "maintype", "subtype").alias("content_type")
    return (
        parts.where(F.col("filename").isNotNull())
        .groupBy(*(by or []), content_type)
        .agg(F.count("*").alias("attachments"))
    )


def scope_report(df: DataFrame, scope: list[str], spans: str = "spans") -> DataFrame:
    """Parts, hits and distinct values per scope, from a table with a span column.

    One shuffle on scope and value, then one on scope: a hot scope is reduced first.
    """
    hits = df.select(*scope, F.posexplode_outer(spans).alias("_no", "_span"))
    per_value = hits.groupBy(*scope, F.col("_span.value").alias("_value")).agg(
        F.count_if(F.coalesce("_no", F.lit(0)) == 0).alias("_parts"), F.count("_no").alias("_hits")
    )
    return per_value.groupBy(*scope).agg(
        F.sum("_parts").alias("parts"),
        F.sum("_hits").alias("hits"),
        F.count("_value").alias("distinct_values"),
    )
