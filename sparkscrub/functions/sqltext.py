"""Small helpers to write Spark SQL expressions as text.

The scalar functions of this package are kept as SQL text, so that one
definition serves the DataFrame API (``F.expr``), SQL functions and streams.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

_names = itertools.count(1)


def name(stem: str) -> str:
    """A lambda variable name that no column and no other lambda uses."""
    return f"_{stem}{next(_names)}"


def let(value: str, body: Callable[[str], str], stem: str = "x") -> str:
    """Evaluate ``value`` once and use it many times in ``body``.

    Two plain mentions of an expensive expression would be computed twice.
    """
    var = name(stem)
    return f"transform(array({value}), {var} -> {body(var)})[0]"


def raw(pattern: str) -> str:
    """A regular expression as a raw SQL literal."""
    if "'" in pattern:
        raise ValueError(r"write a quote in a pattern as \x27")
    return f"r'{pattern}'"


def column(df, text: str) -> str:
    """A column's name as SQL, quoted; anything that is no column of ``df`` is SQL already."""
    return "`" + text.replace("`", "``") + "`" if text in df.columns else text


def literal(value: str) -> str:
    """Any text as a SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches_any(text: str, patterns: list[str]) -> str:
    """SQL test: does one of the patterns occur in the text?"""
    return f"({text} RLIKE {raw('|'.join(dict.fromkeys(patterns)))})"
