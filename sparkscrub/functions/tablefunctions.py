"""A provider as a SQL table function: the rows of a scope in, the same rows masked out.

    SELECT * FROM scrub_scope(TABLE(turns) PARTITION BY (conv_id), 'text')

A scope is what ``PARTITION BY`` deals out. Its rows and values are held until its last row
is read, since a value may be found in any of them; for scopes that do not fit a worker use
``plans.providers.scrub_with_provider``, which gives the same result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

import sparkscrub
from sparkscrub.catalog import RANKED_TYPES, placeholder
from sparkscrub.plans.shipping import ship_package

_OPEN, _CLOSE = "\ue000", "\ue001"
_PLACEHOLDERS = frozenset(placeholder(t) for t in RANKED_TYPES)


def mask_with_replacements(text: str, replacements: list[tuple[str, str]]) -> str:
    """Replace the values one after the other, as ordered.

    A value can match inside a placed placeholder of the catalogue, but inside no other
    replacement: these stand as marks of characters that no text has until the end.
    """
    marks = []
    for value, replacement in replacements:
        if value in text:
            mark = replacement
            if replacement not in _PLACEHOLDERS:
                digits = "".join(chr(0xE010 + int(d)) for d in str(len(marks)))
                marks.append((mark := f"{_OPEN}{digits}{_CLOSE}", replacement))
            text = text.replace(value, mark)
    for mark, replacement in marks:
        text = text.replace(mark, replacement)
    return text


def ordered_replacements(maps: list[dict[str, str]]) -> list[tuple[str, str]]:
    """The values of all maps, longest first; of two replacements the first in order of the alphabet."""
    best: dict[str, str] = {}
    for own in maps:
        for value, replacement in own.items():
            if value and value != replacement:
                best[value] = min(replacement, best.get(value, replacement))
    return sorted(best.items(), key=lambda item: (-len(item[0]), item[0]))


def register_scope_function(
    spark: SparkSession, load: Callable[[], Callable[[str], dict[str, str]]], name: str = "scrub_scope"
) -> None:
    """Register a table function around a provider's model, for the running session.

    Its arguments are a table and the name of its text column. It returns the columns of
    the table and ``masked``. ``load`` runs once per Python worker; what it returns maps a text
    that is not blank to ``value -> replacement``. Null texts stay null.
    """
    ship_package(spark, sparkscrub)
    mark = uuid.uuid4().hex

    # A class of its own for each function travels as it is: its output is found by a Python
    # process of the driver, which does not have the modules that the executors are sent.
    class ScrubScope:
        @staticmethod
        def analyze(rows: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the first argument must be TABLE(...)")
            names = [f.name for f in rows.dataType.fields]
            if text.value not in names or "masked" in names:
                raise ValueError(f"name a text column of {names}; none of them may be called masked")
            return AnalyzeResult(T.StructType([*rows.dataType.fields, T.StructField("masked", T.StringType())]))

        def __init__(self):
            self.rows, self.maps = [], []

        def eval(self, rows, text):
            from sparkscrub.plans.providers import loaded

            own = rows[text]
            if own and own.strip():
                self.maps.append(loaded(mark, load)(own))
            self.rows.append((rows, own))

        def terminate(self):
            from sparkscrub.functions.tablefunctions import mask_with_replacements, ordered_replacements

            replacements = ordered_replacements(self.maps)
            for rows, own in self.rows:
                yield (*rows, None if own is None else mask_with_replacements(own, replacements))

    spark.udtf.register(name, udtf(ScrubScope))
