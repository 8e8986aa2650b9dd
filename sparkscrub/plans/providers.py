"""Plug-in providers: anything that maps a text to ``original -> replacement``.

A provider is a function from a text column to a ``MAP<STRING, STRING>`` column, such
as a pandas UDF around a language model, or an expression.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import sparkscrub
from sparkscrub.catalog import RANKED_TYPES, placeholder
from sparkscrub.functions.mask import mask_with_map
from sparkscrub.functions.spans import replacement_map
from sparkscrub.functions.sqltext import column
from sparkscrub.operators.scopes import MAX_FOLDED_KEYS, scrub_with_keys
from sparkscrub.plans.shipping import ship_package
from sparkscrub.plans.sizing import materialize

Provider = Callable[[Column], Column]
MAP_TYPE = T.MapType(T.StringType(), T.StringType())


# Models of this worker process; workers serve many tasks.
_models: dict[str, Callable[[str], dict[str, str]]] = {}


def loaded(mark: str, load: Callable[[], Callable[[str], dict[str, str]]]) -> Callable[[str], dict[str, str]]:
    if mark not in _models:
        _models[mark] = load()
    return _models[mark]


def model_provider(load: Callable[[], Callable[[str], dict[str, str]]]) -> Provider:
    """A provider around a Python model. ``load`` runs once per Python worker; what it
    returns is called with each text that is not blank. The workers need this package
    (``scrub_with_provider`` sends it)."""
    mark = uuid.uuid4().hex

    @F.pandas_udf(MAP_TYPE)
    def provide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(mark, load)
        for texts in batches:
            yield pd.Series([model(t) if t and t.strip() else {} for t in texts], dtype=object)

    return provide


@dataclass(frozen=True)
class PatternProvider:
    """The built-in detectors in the form of a provider (of a column name)."""

    entities: tuple[str, ...] | None
    terms: dict | None

    def __call__(self, text: str) -> Column:
        return replacement_map(text, self.entities, self.terms)


def pattern_provider(entities: Iterable[str] | None = None, terms: dict | None = None) -> PatternProvider:
    return PatternProvider(None if entities is None else tuple(entities), terms)


# A replacement that is none of the placeholders is put in as a mark of characters that no
# text has, and written out at the end: so no key can match inside it.
_OPEN, _CLOSE = "\ue000", "\ue001"
_HEX, _MARKS = "0123456789ABCDEF", "".join(chr(0xE010 + i) for i in range(16))
_PLACEHOLDERS = [placeholder(t) for t in RANKED_TYPES]


def _marked(value: Column) -> Column:
    mark = F.concat(F.lit(_OPEN), F.translate(F.hex(value), _HEX, _MARKS), F.lit(_CLOSE))
    return F.when(value.isin(_PLACEHOLDERS), value).otherwise(mark)


def _written_out(text: str) -> Column:
    inner = f"[{_MARKS[0]}-{_MARKS[-1]}]*"
    found = F.transform(
        F.regexp_extract_all(text, F.lit(f"{_OPEN}({inner}){_CLOSE}"), 1),
        lambda m: F.decode(F.unhex(F.translate(m, _MARKS, _HEX)), "UTF-8"),
    )
    gaps = F.split(text, f"{_OPEN}{inner}{_CLOSE}", -1)
    joined = F.array_join(F.zip_with(gaps, F.concat(found, F.array(F.lit(""))), lambda g, m: F.concat(g, m)), "")
    return F.when(F.contains(F.col(text), F.lit(_OPEN)), joined).otherwise(F.col(text))


def scrub_with_provider(
    df: DataFrame,
    provider: Provider,
    text: str = "text",
    scope: list[str] | None = None,
    key: list[str] | None = None,
    output: str = "masked",
    max_folded_keys: int = MAX_FOLDED_KEYS,
) -> DataFrame:
    """Mask with the provider's maps instead of the built-in detectors.

    In a scope the maps of all rows are put together; where they give a value two
    replacements, the first in order of the alphabet is used. Keys can match inside placed
    placeholders ``<TYPE>`` of the catalogue, as ever, but not inside other replacements;
    so the result does not depend on how many keys a scope has.
    """
    ship_package(df.sparkSession, sparkscrub)
    quoted = column(df, text)
    made = provider(quoted) if isinstance(provider, PatternProvider) else provider(F.col(quoted))
    changed = F.map_filter(made, lambda k, v: k != v)
    mapped = df.withColumn("_map", F.transform_values(changed, lambda k, v: _marked(v)))
    if scope is None:
        masked = mapped.withColumn("_masked", mask_with_map(quoted, "_map"))
        return masked.withColumn(output, _written_out("_masked")).drop("_map", "_masked")
    if not key:
        raise ValueError("name the columns that identify a row in key=[...]")
    hits = mapped.select(*scope, F.explode("_map").alias("value", "placeholder"))
    keys = hits.groupBy(*scope, "value").agg(F.min("placeholder").alias("placeholder"))
    keys = materialize(keys, "provider-keys")
    masked = scrub_with_keys(df, keys, scope, key, text, None, "_masked", max_folded_keys)
    return masked.withColumn(output, _written_out("_masked")).drop("_masked")
