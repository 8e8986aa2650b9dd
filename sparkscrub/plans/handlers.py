"""How each kind of part is analysed and masked; new kinds plug in here.

A handler turns SQL text into SQL text, so all handlers of a query become one CASE
expression within the projection.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from sparkscrub.functions.html import html_text_sql, mask_html_sql
from sparkscrub.functions.mask import replace_sql
from sparkscrub.functions.sqltext import literal


def _same(text: str) -> str:
    return text


@dataclass(frozen=True)
class Handler:
    """``mask(text, keys)`` masks a part; ``analyse(text)`` is what detection looks at."""

    mask: Callable[[str, str], str] = replace_sql
    analyse: Callable[[str], str] = _same


PLAIN = Handler()
HTML = Handler(mask_html_sql, html_text_sql)

HANDLERS: Mapping[str, Handler] = {"html": HTML, "named_html": HTML}


def analysed_sql(text: str, kind: str | None, handlers: Mapping[str, Handler] | None = None) -> str:
    """What detection looks at, by kind of part. ``text`` is mentioned more than once."""
    return _by_kind(kind, handlers, lambda h: h.analyse(text))


def masked_sql(
    text: str, keys: str, kind: str | None, handlers: Mapping[str, Handler] | None = None
) -> str:
    """The masked part, by kind. ``text`` and ``keys`` are mentioned more than once."""
    return _by_kind(kind, handlers, lambda h: h.mask(text, keys))


def _by_kind(kind: str | None, handlers, write: Callable[[Handler], str]) -> str:
    if kind is None:
        return write(PLAIN)
    groups: dict[Handler, list[str]] = {}
    for name, handler in {**HANDLERS, **(handlers or {})}.items():
        groups.setdefault(handler, []).append(literal(name))
    whens = " ".join(f"WHEN {kind} IN ({', '.join(names)}) THEN {write(h)}" for h, names in groups.items())
    return f"CASE {whens} ELSE {write(PLAIN)} END"
