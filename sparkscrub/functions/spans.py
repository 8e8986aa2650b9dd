"""Spans and replacement keys of one text: find, rank, order, resolve overlaps.

Functions ending in ``_sql`` take and return SQL text; the others take a column
name (or any SQL expression) and return a ``Column``.

* spans: ``ARRAY<STRUCT<start INT, end INT, entity_type STRING, value STRING>>``,
  code points, end exclusive, ordered by position.
* keys: ``ARRAY<STRUCT<value STRING, placeholder STRING>>``, one entry per value,
  longest first, ready for the masking fold.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkscrub.catalog import RANKED_TYPES, placeholder, select_entities
from sparkscrub.functions.detectors import families_for, family_spans, family_values, markable_sql
from sparkscrub.functions.sqltext import let, literal, name, raw

SPANS_TYPE = "array<struct<start:int,end:int,entity_type:string,value:string>>"
KEYS_TYPE = "array<struct<value:string,placeholder:string>>"
NOT_BLANK = r"(?U)\S"
NO_KEYS = f"cast(array() AS {KEYS_TYPE})"
NO_SPANS = f"cast(array() AS {SPANS_TYPE})"

_TYPES = "array(" + ", ".join(literal(t) for t in RANKED_TYPES) + ")"
_PLACEHOLDERS = "array(" + ", ".join(literal(placeholder(t)) for t in RANKED_TYPES) + ")"


def type_sql(rank: str) -> str:
    return f"element_at({_TYPES}, {rank})"


def placeholder_sql(rank: str) -> str:
    return f"element_at({_PLACEHOLDERS}, {rank})"


def rank_sql(entity_type: str) -> str:
    return f"array_position({_TYPES}, {entity_type})"


def _when_not_blank(text: str, found: str, empty: str) -> str:
    """Null, empty and blank texts hold nothing and are not scanned."""
    return f"CASE WHEN {text} RLIKE {raw(NOT_BLANK)} THEN {found} ELSE {empty} END"


def spans_sql(text: str, entities: Iterable[str] | None = None, terms: dict | None = None) -> str:
    """All hits of the chosen types in a text, by position."""
    families = families_for(select_entities(entities), terms)
    if not families:
        return NO_SPANS

    def body(t: str) -> str:
        s = name("s")
        plain = let(
            markable_sql(t),
            lambda m: f"concat({', '.join(family_spans(f, m if f.marked else t) for f in families)})",
            "m",
        )
        ordered = f"sort_array({plain})"
        typed = (
            f"transform({ordered}, {s} -> struct({s}.start AS start, {s}.end AS end, "
            f"{type_sql(s + '.rank')} AS entity_type, {s}.value AS value))"
        )
        return _when_not_blank(t, typed, NO_SPANS)

    return let(text, body, "t")


def ranked_values_sql(text: str, entities: Iterable[str] | None = None, terms: dict | None = None) -> str:
    """``ARRAY<STRUCT<value, rank>>`` of the distinct hits in a text, without positions."""
    families = families_for(select_entities(entities), terms)
    if not families:
        return "cast(array() AS array<struct<value:string,rank:int>>)"

    def body(t: str) -> str:
        found = ", ".join(family_values(f, t) for f in families)
        return _when_not_blank(
            t, f"sort_array(array_distinct(concat({found})))", "array()"
        )

    return let(text, body, "t")


def may_hold_sql(text: str, entities: Iterable[str] | None = None) -> str:
    """A cheap test that every text with a hit of the chosen types passes."""
    tests = [f.may_match(text) for f in families_for(select_entities(entities))]
    return "(" + " OR ".join(tests) + ")" if tests else "false"


def order_keys_sql(keys: str) -> str:
    """Longest value first, equal lengths by value; empty values and no-ops are left out."""
    k = name("k")
    longest_first = (
        f"sort_array(transform(filter({keys}, {k} -> {k}.value <> '' AND {k}.value <> {k}.placeholder), "
        f"{k} -> struct(-length({k}.value) AS n, {k}.value AS value, {k}.placeholder AS placeholder)))"
    )
    return f"transform({longest_first}, {k} -> struct({k}.value AS value, {k}.placeholder AS placeholder))"


def keys_from_ranked_sql(ranked: str) -> str:
    """Sorted ``(value, rank)`` pairs to ordered keys; of several types for a value the first rank wins."""
    k, i = name("k"), name("i")
    return let(
        ranked,
        lambda a: order_keys_sql(
            f"transform(filter({a}, ({k}, {i}) -> {i} = 0 OR {a}[{i} - 1].value <> {k}.value), "
            f"{k} -> struct({k}.value AS value, {placeholder_sql(k + '.rank')} AS placeholder))"
        ),
        "a",
    )


def keys_sql(text: str, entities: Iterable[str] | None = None, terms: dict | None = None) -> str:
    """The replacement keys of a text."""
    return keys_from_ranked_sql(ranked_values_sql(text, entities, terms))


def keys_from_spans_sql(spans: str) -> str:
    """The replacement keys of an array of spans."""
    s = name("s")
    ranked = (
        f"sort_array(array_distinct(transform({spans}, {s} -> struct({s}.value AS value, "
        f"cast({rank_sql(s + '.entity_type')} AS int) AS rank))))"
    )
    return keys_from_ranked_sql(ranked)


def keys_from_map_sql(replacements: str) -> str:
    """The replacement keys of a ``MAP<STRING, STRING>`` from any other provider."""
    e = name("e")
    return order_keys_sql(
        f"transform(map_entries({replacements}), {e} -> struct({e}.key AS value, {e}.value AS placeholder))"
    )


def map_sql(keys: str) -> str:
    """Keys as ``MAP<STRING, STRING>``, the form users see."""
    k = name("k")
    return f"map_from_entries(transform({keys}, {k} -> struct({k}.value, {k}.placeholder)))"


def resolve_overlaps_sql(spans: str, threshold: float = 0.5) -> str:
    """Accept spans longest first; drop one that shares more than ``threshold`` of the
    smaller length with an accepted one. Empty spans overlap nothing. Order: longest
    first, then by position, then by rank of the type."""
    acc, s, a, x = name("acc"), name("s"), name("a"), name("x")
    ordered = (
        f"sort_array(transform({spans}, {x} -> struct({x}.start - {x}.end AS n, {x}.start AS start, "
        f"{x}.end AS end, {rank_sql(x + '.entity_type')} AS rank, "
        f"{x}.entity_type AS entity_type, {x}.value AS value)))"
    )
    shared = f"(least({s}.end, {a}.end) - greatest({s}.start, {a}.start))"
    smaller = f"least({s}.end - {s}.start, {a}.end - {a}.start)"
    clash = f"exists({acc}, {a} -> {shared} > {threshold}D * {smaller} AND {shared} > 0)"
    span = f"struct({s}.start AS start, {s}.end AS end, {s}.entity_type AS entity_type, {s}.value AS value)"
    return (
        f"aggregate({ordered}, {NO_SPANS}, ({acc}, {s}) -> "
        f"CASE WHEN {clash} THEN {acc} ELSE concat({acc}, array({span})) END)"
    )


def detect_spans(
    text: str, entities: Iterable[str] | None = None, terms: dict | None = None
) -> Column:
    """Column of all spans of the chosen types."""
    return F.expr(spans_sql(text, entities, terms))


def replacement_keys(
    text: str, entities: Iterable[str] | None = None, terms: dict | None = None
) -> Column:
    """Column of the ordered replacement keys of a text."""
    return F.expr(keys_sql(text, entities, terms))


def replacement_map(
    text: str, entities: Iterable[str] | None = None, terms: dict | None = None
) -> Column:
    """Column ``MAP<STRING, STRING>``: value -> placeholder.

    Departure: where a value fits several types, the rank of the type decides,
    not the order in which the hits were found.
    """
    return F.expr(let(keys_sql(text, entities, terms), map_sql))


def resolve_overlaps(spans: str, threshold: float = 0.5) -> Column:
    """Column of the spans that survive overlap resolution, longest first."""
    return F.expr(resolve_overlaps_sql(spans, threshold))


def may_hold(text: str, entities: Iterable[str] | None = None) -> Column:
    """Column: can the text hold a hit? False is certain, true is not."""
    return F.expr(may_hold_sql(text, entities))


def entity_placeholder(entity_type: str) -> Column:
    """Column ``<ENTITY_TYPE>`` for a column of entity types."""
    return F.expr(f"concat('<', {entity_type}, '>')")
