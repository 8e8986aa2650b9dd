"""The scalar functions for SQL users, as temporary SQL functions (no Python runs)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from sparkscrub.functions.html import html_text_sql, mask_html_sql
from sparkscrub.functions.mask import mask_spans_sql, mask_text_sql
from sparkscrub.functions.spans import keys_sql, map_sql, resolve_overlaps_sql, spans_sql
from sparkscrub.functions.sqltext import let


def register_functions(
    spark: SparkSession,
    entities: Iterable[str] | None = None,
    terms: dict | None = None,
    prefix: str = "pii_",
) -> list[str]:
    """Create the functions in the session and return their names.

    ``pii_spans(t)``, ``pii_map(t)``, ``pii_mask(t)``, ``pii_mask_positions(t)`` and
    ``pii_mask_html(h)``, each for the chosen entity types.
    """
    chosen = list(entities or ())
    functions = {
        "spans": spans_sql("t", chosen, terms),
        "map": let(keys_sql("t", chosen, terms), map_sql),
        "mask": mask_text_sql("t", chosen, terms),
        "mask_positions": mask_spans_sql("t", resolve_overlaps_sql(spans_sql("t", chosen, terms))),
        "mask_html": let(keys_sql(html_text_sql("t"), chosen, terms), lambda k: mask_html_sql("t", k)),
    }
    for name, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(t STRING) RETURN {body}")
    return [prefix + name for name in functions]
