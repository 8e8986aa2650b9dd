"""Masking of one text, of header lists and of fragments."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkscrub.functions.spans import (
    NO_SPANS,
    keys_from_map_sql,
    keys_sql,
    rank_sql,
)
from sparkscrub.functions.sqltext import let, literal, name, raw


def replace_sql(text: str, keys: str) -> str:
    """Replace every occurrence of every key, in the order of the keys.

    Literal, case-sensitive and not bounded by words; each key is looked for in the
    text as the keys before it left it, so a short key can hit a placed placeholder.
    """
    acc, k = name("acc"), name("k")
    return f"aggregate({keys}, {text}, ({acc}, {k}) -> replace({acc}, {k}.value, {k}.placeholder))"


def replace_across_sql(text: str, keys: str, separator: str) -> str:
    """As ``replace_sql`` on the text without its separators; these stay, also those within a value,
    which then follow its placeholder."""
    acc, k, c, i = (name(v) for v in "akci")
    gap = "(?:" + "".join(f"\\\\x{{{ord(ch):x}}}" for ch in separator) + ")*"
    letters = f"regexp_extract_all({k}.value, r'(?s).', 0)"
    quoted = f"transform({letters}, {c} -> regexp_replace({c}, r'([^\\p{{L}}\\p{{N}}])', r'\\\\$1'))"
    pattern = f"array_join({quoted}, '({gap})')"
    # Each gap is a group; all of them are put back.
    gaps = f"array_join(transform(filter(sequence(0, length({k}.value) - 1), {i} -> {i} > 0), {i} -> concat('$', {i})), '')"
    put = f"concat(regexp_replace({k}.placeholder, r'([\\\\$])', r'\\\\$1'), {gaps})"
    step = f"IF(contains({acc}, {literal(separator)}), regexp_replace({acc}, {pattern}, {put}), replace({acc}, {k}.value, {k}.placeholder))"
    return f"aggregate({keys}, {text}, ({acc}, {k}) -> {step})"


def mask_text_sql(text: str, entities: Iterable[str] | None = None, terms: dict | None = None) -> str:
    """Detect, map and mask within one text."""
    return let(text, lambda t: replace_sql(t, keys_sql(t, entities, terms)), "t")


def mask_spans_sql(text: str, spans: str) -> str:
    """Replace by position; text placed before is never touched again.

    Of two spans that share characters the longer (then the earlier) keeps its
    range, the other is cut to what is left of it.
    """
    acc, s, a, x, b, p = (name(c) for c in "asaxbp")
    ordered = (
        f"sort_array(transform({spans}, {x} -> struct({x}.start - {x}.end AS n, {x}.start AS start, "
        f"{x}.end AS end, {rank_sql(x + '.entity_type')} AS rank, {x}.entity_type AS entity_type)))"
    )
    # Shrink the range by what each accepted span already holds.
    left = (
        f"aggregate({acc}, struct({s}.start AS start, {s}.end AS end), ({x}, {a}) -> struct("
        f"CASE WHEN {a}.start <= {x}.start AND {a}.end > {x}.start THEN {a}.end ELSE {x}.start END AS start, "
        f"CASE WHEN {a}.start < {x}.end AND {a}.end >= {x}.end THEN {a}.start ELSE {x}.end END AS end))"
    )
    kept = let(
        left,
        lambda r: f"CASE WHEN {r}.start < {r}.end THEN concat({acc}, array(struct({r}.start AS start, "
        f"{r}.end AS end, {s}.entity_type AS entity_type, '' AS value))) ELSE {acc} END",
        "r",
    )
    disjoint = f"sort_array(aggregate({ordered}, {NO_SPANS}, ({acc}, {s}) -> {kept}))"
    step = (
        f"struct({b}.end AS pos, concat({p}.out, substring({{t}}, {p}.pos + 1, {b}.start - {p}.pos), "
        f"'<', {b}.entity_type, '>') AS out)"
    )

    def body(t: str) -> str:
        done = f"aggregate({disjoint}, struct(0 AS pos, '' AS out), ({p}, {b}) -> {step.replace('{t}', t)})"
        return let(done, lambda d: f"concat({d}.out, substring({t}, {d}.pos + 1))", "d")

    return let(text, body, "t")


def mask_headers_sql(headers: str, keys: str) -> str:
    """Mask header values, never names; ``Content-Type`` is left out, empty values stay."""
    h = name("h")
    return (
        f"transform(filter({headers}, {h} -> lower({h}.name) <> 'content-type'), {h} -> "
        f"struct({h}.ord AS ord, {h}.name AS name, {replace_sql(h + '.value', keys)} AS value))"
    )


def filename_sql(filename: str, kind: str | None = None, salt: str | None = None, part_id: str = "''") -> str:
    """Twelve hex characters and the original suffix.

    ``kind``: ``text`` gives ``.txt`` to a name without suffix, ``pdf`` and ``docx``
    force their suffix; a missing name becomes ``.bin`` (``.txt`` for text). With a
    salt the name is a repeatable hash of salt, part and name, else it is random.
    """
    # A suffix starts at the last dot, unless that dot starts or ends the name.
    suffix = f"regexp_extract({filename}, {raw('[^/](' + chr(92) + '.[^./]+)$')}, 1)"
    stem = (
        "substring(replace(uuid(), '-', ''), 1, 12)"
        if salt is None
        else f"substring(sha2(concat_ws('|', {literal(salt)}, {part_id}, {filename}), 256), 1, 12)"
    )
    if kind in ("pdf", "docx"):
        return f"concat({stem}, '.{kind}')"
    if kind == "text":
        return f"concat({stem}, coalesce(nullif({suffix}, ''), '.txt'))"
    if kind is None:
        return f"concat({stem}, CASE WHEN {filename} IS NULL THEN '.bin' ELSE {suffix} END)"
    raise ValueError(f"unknown kind: {kind}")


def mask_replace(text: str, keys: str) -> Column:
    """Mask a text with a column of ordered keys."""
    return F.expr(replace_sql(text, keys))


def mask_with_map(text: str, replacements: str) -> Column:
    """Mask a text with a ``MAP<STRING, STRING>`` column, longest key first."""
    return F.expr(f"coalesce({replace_sql(text, keys_from_map_sql(replacements))}, {text})")


def mask_spans(text: str, spans: str) -> Column:
    """Mask a text by the positions of (resolved) spans."""
    return F.expr(mask_spans_sql(text, spans))


def mask_text(text: str, entities: Iterable[str] | None = None, terms: dict | None = None) -> Column:
    """The text with every value of the chosen types masked, each row on its own."""
    return F.expr(mask_text_sql(text, entities, terms))


def mask_headers(headers: str, keys: str) -> Column:
    """Mask an array of ``(ord, name, value)`` headers."""
    return F.expr(mask_headers_sql(headers, keys))


def pseudonymize_filename(
    filename: str, kind: str | None = None, salt: str | None = None, part_id: str = "''"
) -> Column:
    """Column of a file name that tells nothing but the kind of the file."""
    return F.expr(filename_sql(filename, kind, salt, part_id))
