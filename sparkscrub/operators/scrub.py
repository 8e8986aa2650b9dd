"""The masking job: detect, map and mask a table of texts."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscrub.catalog import DICTIONARY_TYPES, RANKED_TYPES, placeholder
from sparkscrub.functions.html import mask_html_sql
from sparkscrub.functions.mask import mask_spans_sql, replace_across_sql, replace_sql
from sparkscrub.functions.spans import keys_sql, resolve_overlaps_sql, spans_sql
from sparkscrub.functions.sqltext import column, let, literal
from sparkscrub.operators.scopes import (
    MAX_FOLDED_KEYS,
    scope_keys,
    scrub_with_keys,
)
from sparkscrub.plans.expand import expand
from sparkscrub.plans.handlers import Handler, analysed_sql, masked_sql
from sparkscrub.plans.sizing import materialize


def require_terms(entities: Iterable[str] | None, terms: dict | DataFrame | None) -> None:
    """Types that are found by terms only find nothing without terms: an error if they are named."""
    if terms is not None:
        return
    named = [t for t in entities or () if t in DICTIONARY_TYPES]
    if named:
        raise ValueError(f"{', '.join(named)}: found by terms only; pass terms= or leave them out")
    if entities is None:
        warnings.warn(f"without terms= no {', '.join(DICTIONARY_TYPES)} is looked for", stacklevel=3)


def scrub(
    df: DataFrame,
    text: str = "text",
    scope: list[str] | None = None,
    key: list[str] | None = None,
    entities: Iterable[str] | None = None,
    terms: dict | DataFrame | None = None,
    kind: str | None = None,
    output: str = "masked",
    max_folded_keys: int = MAX_FOLDED_KEYS,
    handlers: Mapping[str, Handler] | None = None,
) -> DataFrame:
    """Add ``output``: the text with the values of the chosen types masked.

    Without ``scope`` each row stands alone: one projection, no shuffle, also for
    streams. With ``scope`` a value found in any row of the scope is masked in all of
    them; ``key`` then names the columns that identify a row. ``terms`` are names,
    places and groups to look for: a dict of short lists, or a table ``term,
    entity_type`` of any size. ``kind`` names a column that says ``html`` for pages;
    ``handlers`` adds other kinds. With ``scope`` or a table of terms several jobs run
    when this is called (see ``plans.sizing.scratch`` for what they store).
    """
    require_terms(entities, terms)
    text, kind = column(df, text), kind and column(df, kind)
    if scope is None and not isinstance(terms, DataFrame):
        row = let(
            text,
            lambda t: let(
                keys_sql(analysed_sql(t, kind, handlers), entities, terms),
                lambda k: masked_sql(t, k, kind, handlers),
                "k",
            ),
            "t",
        )
        return df.withColumn(output, F.expr(row))
    if not key:
        raise ValueError("name the columns that identify a row in key=[...]")
    # A row is its own scope when only the table of terms makes a join necessary.
    scope = scope or key
    keys = materialize(scope_keys(df, scope, text, key, entities, terms, kind, handlers), "scope-keys")
    return scrub_with_keys(df, keys, scope, key, text, kind, output, max_folded_keys, handlers)


def scrub_by_position(
    df: DataFrame,
    text: str = "text",
    entities: Iterable[str] | None = None,
    terms: dict | None = None,
    threshold: float = 0.5,
    output: str = "masked",
) -> DataFrame:
    """Mask by position after overlap resolution: placed placeholders are never touched again,
    and a value is masked only where it was detected."""
    require_terms(entities, terms)
    text = column(df, text)
    row = let(
        text,
        lambda t: mask_spans_sql(t, resolve_overlaps_sql(spans_sql(t, entities, terms), threshold)),
        "t",
    )
    return df.withColumn(output, F.expr(row))


def mask_fragments(
    df: DataFrame,
    text: str = "text",
    separator: str = "\n",
    entities: Iterable[str] | None = None,
    terms: dict | None = None,
    output: str = "masked",
    across: bool = False,
) -> DataFrame:
    """One row per fragment of each text: detected on the whole text, masked one by one.

    A value that runs over two fragments is not masked, unless ``across`` is set: then the
    text is read as if the separators were not there, and a value that runs over several
    fragments is masked in the first of them and cut out of the others. Put together, the
    fragments are the masked text. For fragments that are rows already, use ``scrub`` with
    the document as scope.
    """
    require_terms(entities, terms)
    if across and (not separator or any(separator in placeholder(t) for t in RANKED_TYPES)):
        raise ValueError("a separator that stands in placeholders, or an empty one, cannot be looked across")
    name, text = text, column(df, text)
    pieces = f"split({{t}}, {_pattern_of(separator)}, -1)"

    def body(t: str) -> str:
        if across:
            whole = f"replace({t}, {literal(separator)}, '')"
            masked = let(keys_sql(whole, entities, terms), lambda k: replace_across_sql(t, k, separator), "k")
            return (
                f"zip_with({pieces.replace('{t}', t)}, {pieces.replace('{t}', masked)}, "
                f"(_f, _m) -> struct(_f AS fragment, _m AS {output}))"
            )
        return let(
            keys_sql(t, entities, terms),
            lambda k: f"transform({pieces.replace('{t}', t)}, _f -> "
            f"struct(_f AS fragment, {replace_sql('_f', k)} AS {output}))",
            "k",
        )

    rest = [c for c in df.columns if c != name]
    pieces_of = F.posexplode_outer(F.expr(let(text, body, "t"))).alias("fragment_no", "_fragment")
    found = expand(df, rest, pieces_of, "fragment_no")
    return found.select(*rest, "fragment_no", "_fragment.*")


def _pattern_of(separator: str) -> str:
    codes = "".join(f"\\x{{{ord(ch):x}}}" for ch in separator)
    return f"r'{codes}'"


def scrub_html(
    df: DataFrame,
    html: str = "html",
    entities: Iterable[str] | None = None,
    terms: dict | None = None,
    output: str = "masked",
) -> DataFrame:
    """Mask a table of pages, each on its own."""
    require_terms(entities, terms)
    html = column(df, html)
    page = let(
        html,
        lambda h: let(
            keys_sql(analysed_sql(h, "'html'"), entities, terms), lambda k: mask_html_sql(h, k), "k"
        ),
        "h",
    )
    return df.withColumn(output, F.expr(page))
