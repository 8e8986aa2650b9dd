"""Masking with one replacement map per scope: a value found in any part of a scope
(a message, a conversation, a source) is masked in every part of it.

Three passes. The first detects; its result, the distinct values per scope, is
written to the shared folder. Scopes with few values then carry them to their parts
as one array. A scope with many values is never folded as a whole: ``find_values``
tells which of them occur in which part, and each part gets only those.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscrub.catalog import DICTIONARY_TYPES, RANKED_TYPES, placeholder, select_entities
from sparkscrub.functions.spans import NO_KEYS, order_keys_sql, placeholder_sql, ranked_values_sql
from sparkscrub.functions.sqltext import column, let, literal
from sparkscrub.operators.gazetteer import gazetteer_values
from sparkscrub.operators.matching import find_values
from sparkscrub.plans.expand import expand
from sparkscrub.plans.handlers import Handler, analysed_sql, masked_sql
from sparkscrub.plans.sizing import fits_broadcast, hot_keys, materialize, salted_join

# A scope with more values than this is handled by lookup, not by folding its map.
MAX_FOLDED_KEYS = 200

_KEYS = "collect_list(struct(value, placeholder))"


def scope_sql(df: DataFrame, scope: list[str]) -> str:
    """One text per scope, different for different values; a missing scope is a scope of its
    own, so its rows are masked too."""
    parts = []
    for c in scope:
        kind, quoted = df.schema[c].dataType, column(df, c)
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            text = f"to_json({quoted}, map('ignoreNullFields', 'false', 'timestampFormat', 'yyyy-MM-dd HH:mm:ss.SSSSSS'))"
        elif isinstance(kind, T.BinaryType):
            text = f"hex({quoted})"
        else:
            text = f"cast({quoted} AS string)"
        parts.append(f"coalesce(concat(length({text}), ':', {text}), '-')")
    return f"concat({', '.join(parts)})"


def meeting_sql(value: str) -> str:
    """SQL test for keys that may first match once a placeholder stands in the text: pieces of a
    placeholder, or strings that hold its brackets next to its letters. The detectors find
    none of these; a table of terms may list some."""
    placed = ", ".join(literal(placeholder(t)) for t in RANKED_TYPES)
    return f"exists(array({placed}), _p -> contains(_p, {value})) OR {value} RLIKE '<$|<[A-Z<]|^>|[A-Z>]>'"


def scope_keys(
    df: DataFrame,
    scope: list[str],
    text: str = "text",
    key: list[str] | None = None,
    entities: Iterable[str] | None = None,
    terms: dict | DataFrame | None = None,
    kind: str | None = None,
    handlers: Mapping[str, Handler] | None = None,
) -> DataFrame:
    """Rows ``scope..., value, placeholder``: the replacement map of each scope.

    Nothing runs before the result is used, unless ``terms`` is a table: its lookup counts
    and stores the terms first. One stored result can serve several tables
    (``scrub_with_keys``). Of several types for a value the first rank wins. Counted and reduced before the
    shuffle, so a scope that holds a third of the data is no hot spot.
    """
    chosen = select_entities(entities)
    text, kind = column(df, text), kind and column(df, kind)
    analysed = let(text, lambda t: analysed_sql(t, kind, handlers), "t")
    inline = terms if isinstance(terms, dict) else None
    hits = expand(df, scope, F.expr(f"inline_outer({ranked_values_sql(analysed, chosen, inline)})"), "value")
    if isinstance(terms, DataFrame):
        listed = terms.where(F.col("entity_type").isin([t for t in DICTIONARY_TYPES if t in chosen]))
        key = [c for c in (key or ["part_id"]) if c not in scope]
        found = gazetteer_values(df, listed, analysed, [*scope, *key])
        hits = hits.unionByName(found.select(*scope, "value", "rank"))
    best = hits.groupBy(*scope, "value").agg(F.min("rank").alias("rank"))
    return best.select(*scope, "value", F.expr(placeholder_sql("rank")).alias("placeholder"))


def scrub_with_keys(
    df: DataFrame,
    keys: DataFrame,
    scope: list[str],
    key: list[str],
    text: str = "text",
    kind: str | None = None,
    output: str = "masked",
    max_folded_keys: int = MAX_FOLDED_KEYS,
    handlers: Mapping[str, Handler] | None = None,
) -> DataFrame:
    """Mask each row of ``df`` with the replacement map of its scope.

    Runs several jobs when called: it counts keys and rows and stores what they need.
    ``keys`` has distinct ``scope..., value, placeholder`` and is read several times;
    pass a stored table. ``key`` identifies a row within its scope. In scopes with
    more than ``max_folded_keys`` values a value is applied where the text holds it,
    or where it can meet a placed placeholder; the result is the same.
    """
    out = [*df.columns, output]
    text, kind = column(df, text), kind and column(df, kind)
    parts = df.select("*", F.expr(scope_sql(df, scope)).alias("_scope"))
    keys = keys.select(F.expr(scope_sql(keys, scope)).alias("_scope"), "value", "placeholder")
    sizes = keys.groupBy("_scope").agg(F.count("*").alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    has_large = most > max_folded_keys
    # Counted only where rows have to be moved, and then once.
    hot_parts = cache(lambda: hot_keys(parts.select("_scope"), ["_scope"]))

    folded_keys, folded_parts = keys, parts
    if has_large:
        large = materialize(sizes.where(F.col("_n") > max_folded_keys).select("_scope"), "large-scopes")
        if fits_broadcast(large):
            large, hot_scopes, hot_rows = F.broadcast(large), None, None
        else:
            hot_scopes, hot_rows = hot_keys(keys, ["_scope"]), hot_parts()
        folded_keys = salted_join(keys, large, ["_scope"], hot_scopes, ["value"], "left_anti")
        large_keys = salted_join(keys, large, ["_scope"], hot_scopes, ["value"], "left_semi")
        folded_parts = salted_join(parts, large, ["_scope"], hot_rows, key, "left_anti")
        large_parts = salted_join(parts, large, ["_scope"], hot_rows, key, "left_semi")

    masked = _mask_with_maps(folded_parts, folded_keys, hot_parts, key, text, kind, handlers, output).select(*out)
    if has_large:
        more = _mask_by_lookup(large_parts, large_keys, hot_parts, key, text, kind, handlers, output)
        masked = masked.unionByName(more.select(*out))
    return masked


def _mask_with_maps(parts, keys, hot_parts, key, text, kind, handlers, output) -> DataFrame:
    """Carry each scope's ordered keys to its parts. Scopes without hits stay as they are."""
    maps = keys.groupBy("_scope").agg(F.expr(_KEYS).alias("_keys"))
    maps = maps.withColumn("_keys", F.expr(order_keys_sql("_keys")))
    # The maps are no larger than the keys that they are made of.
    if fits_broadcast(keys):
        joined = parts.join(F.broadcast(maps), "_scope", "left")
    else:
        joined = salted_join(parts, maps, ["_scope"], hot_parts(), key, "left")
    keys = f"coalesce(_keys, {NO_KEYS})"
    return joined.withColumn(output, F.expr(let(keys, lambda k: masked_sql(text, k, kind, handlers), "k")))


def _mask_by_lookup(parts, keys, hot_parts, key, text, kind, handlers, output) -> DataFrame:
    """Give each part the keys that occur in it."""
    keys = materialize(keys, "large-scope-keys")
    parts = parts.withColumn("_part", F.expr(scope_sql(parts, key)))
    key = ["_part"]
    analysed = parts.select("_scope", *key, F.expr(analysed_sql(text, kind, handlers)).alias("_analysed"))
    found = find_values(analysed, keys, ["_scope"], key, "_analysed", keep=["placeholder"])
    per_part = found.groupBy("_scope", *key).agg(F.expr(_KEYS).alias("_found"))

    meeting = keys.where(meeting_sql("value")).groupBy("_scope").agg(F.expr(_KEYS).alias("_meeting"))
    meeting = materialize(meeting, "meeting-keys")
    joined = parts.join(per_part, ["_scope", *key], "left")
    if meeting.isEmpty():
        joined = joined.withColumn("_meeting", F.expr(NO_KEYS))
    elif fits_broadcast(meeting):
        joined = joined.join(F.broadcast(meeting), "_scope", "left")
    else:
        joined = salted_join(joined, meeting, ["_scope"], hot_parts(), key, "left")
    both = f"array_distinct(concat(coalesce(_found, {NO_KEYS}), coalesce(_meeting, {NO_KEYS})))"
    return joined.withColumn(
        output, F.expr(let(order_keys_sql(both), lambda k: masked_sql(text, k, kind, handlers), "k"))
    )
