"""Very many strings in one reading of each text: tries with failure links (Aho-Corasick).

The strings are dealt to shards of bounded size; an automaton is built of each, once per
worker process, and runs over Arrow batches of texts. Strings may be of any length, no
phrases or pieces of texts are made, and no text moves. A table of strings that is too
large to be sent to the workers is looked up by joins instead (``operators.gazetteer``,
``operators.matching``), with the same result.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

import sparkscrub
from sparkscrub.catalog import DICTIONARY_TYPES
from sparkscrub.functions.spans import SPANS_TYPE, resolve_overlaps_sql
from sparkscrub.operators.gazetteer import gazetteer_spans
from sparkscrub.operators.matching import find_values
from sparkscrub.plans.shipping import ship_package
from sparkscrub.plans.sizing import fits_broadcast, materialize

# Characters of the strings of one shard; its automaton takes some 30 to 100 bytes for each.
SHARD_CHARS = 2_000_000
# Automata that a worker process keeps.
KEPT = 2

_automata: OrderedDict[str, tuple] = OrderedDict()


def _automaton(mark: str, shard: list) -> tuple:
    """The automaton and the strings of a shard, built once per worker process."""
    if mark not in _automata:
        import ahocorasick

        made, strings = ahocorasick.Automaton(), [s[0] for s in shard]
        for n, s in enumerate(strings):
            made.add_word(s, n)
        made.make_automaton()
        while len(_automata) >= KEPT:
            _automata.popitem(last=False)
        _automata[mark] = made, strings
    _automata.move_to_end(mark)
    return _automata[mark]


def _shards(strings: list) -> Iterator[list]:
    """Runs of (string, ...) with a bounded number of characters."""
    held, size = [], 0
    for s in strings:
        if held and size + len(s[0]) > SHARD_CHARS:
            yield held
            held, size = [], 0
        held.append(s)
        size += len(s[0])
    if held:
        yield held


def _is_word(character: str) -> bool:
    return character.isalpha() or "0" <= character <= "9"


def term_places(text: str, automaton, strings: list[str]) -> Iterator[tuple[int, int, int]]:
    """``start, end, number`` of each place of a string that no letter or digit touches, where
    the string itself begins or ends with one; places of one string do not overlap."""
    taken: dict[int, int] = {}
    for last, n in automaton.iter(text):
        term = strings[n]
        start, end = last + 1 - len(term), last + 1
        if start < taken.get(n, 0):
            continue
        if start and _is_word(term[0]) and _is_word(text[start - 1]):
            continue
        if end < len(text) and _is_word(term[-1]) and _is_word(text[end]):
            continue
        taken[n] = end
        yield start, end, n


def _passes(
    texts: DataFrame,
    strings: list,
    find: Callable[[str, tuple, list], list],
    field: T.StructField,
) -> list[DataFrame]:
    """One pass over ``texts`` (its last column is the text) per shard: the other columns and what
    ``find(text, automaton, shard)`` gives; texts without hits are left out."""
    spark = texts.sparkSession
    ship_package(spark, sparkscrub)
    schema = T.StructType([*texts.schema.fields[:-1], field])
    arrow = to_arrow_schema(schema)

    def over(shard):
        sent, mark = spark.sparkContext.broadcast(shard), uuid.uuid4().hex

        def step(batches):
            own = sent.value
            automaton = _automaton(mark, own)
            for batch in batches:
                rows, found = [], []
                for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    hits = find(text, automaton, own) if text else None
                    if hits:
                        rows.append(i)
                        found.append(hits)
                taken = pa.array(rows, pa.int64())
                kept = [batch.column(i).take(taken).cast(arrow.field(i).type) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found, arrow.field(len(kept)).type)], schema=arrow)

        return texts.mapInArrow(step, schema)

    return [over(shard) for shard in _shards(strings)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _spans_of(text: str, built: tuple, shard: list) -> list[dict]:
    automaton, strings = built
    return [
        {"start": start, "end": end, "entity_type": kind, "value": strings[n]}
        for start, end, n in term_places(text, automaton, strings)
        for kind in shard[n][1]
    ]


def automaton_spans(df: DataFrame, terms: DataFrame, text: str = "text", key: list[str] | None = None) -> DataFrame:
    """Rows ``key, start, end, entity_type, value``: each place where a term stands.

    The result of ``gazetteer_spans``: ``terms`` has ``term, entity_type``; of terms that
    overlap the longest wins. Counts the terms when called and brings them to the driver
    if they can be broadcast; more of them are looked up by joins. Null and empty texts
    hold nothing; rows of one key are one text each. ``key`` must be unique where terms
    fill several shards.
    """
    key = key or ["part_id"]
    listed = terms.select("term", "entity_type").where("term <> ''").distinct()
    listed = materialize(listed.groupBy("term").agg(F.sort_array(F.collect_set("entity_type")).alias("kinds")), "terms")
    if not fits_broadcast(listed):
        return gazetteer_spans(df, terms, text, key)
    strings = [(r["term"], r["kinds"]) for r in listed.orderBy("term").collect()]
    unknown = {k for _, kinds in strings for k in kinds} - set(DICTIONARY_TYPES)
    if unknown:
        raise ValueError(f"terms are for {DICTIONARY_TYPES}, not {sorted(unknown)}")
    texts = df.select(*key, F.expr(text).alias("_text"))
    field = T.StructField("spans", T._parse_datatype_string(SPANS_TYPE))
    parts = _passes(texts, strings, _spans_of, field)
    if not parts:
        return texts.select(*key, F.expr(f"inline(cast(array() AS {SPANS_TYPE}))"))
    rows = parts[0]
    if len(parts) > 1:
        # Only hits meet, not texts.
        rows = _union(parts).groupBy(*key).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return rows.select(*key, F.expr(f"inline({resolve_overlaps_sql('spans')})"))


def _values_in(text: str, built: tuple, shard: list) -> list[str]:
    automaton, strings = built
    return [strings[n] for n in dict.fromkeys(n for _, n in automaton.iter(text))]


def automaton_values(
    texts: DataFrame, values: DataFrame, scope: list[str], key: list[str], text: str = "text"
) -> DataFrame:
    """Rows ``scope, key, value``: the value of the scope occurs in the text.

    The result of ``find_values``: ``values`` has distinct ``scope..., value``; empty
    values occur nowhere. Each text is read once per shard, and no text moves.
    """
    values = materialize(values.select(*scope, "value").where("value <> ''"), "values")
    if not fits_broadcast(values):
        return find_values(texts, values, scope, key, text)
    strings = [(r["value"],) for r in values.select("value").distinct().orderBy("value").collect()]
    rows = texts.select(*scope, *key, F.col(text).alias("_text"))
    parts = _passes(rows, strings, _values_in, T.StructField("value", T.ArrayType(T.StringType())))
    if not parts:
        return texts.select(*scope, *key, F.lit("").alias("value")).where("false")
    found = _union(parts).select(*scope, *key, F.explode("value").alias("value"))
    return found.join(F.broadcast(values), [*scope, "value"]).select(*scope, *key, "value") if scope else found
