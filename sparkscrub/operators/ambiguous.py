"""Terms that may be of several types: one type for each place, by its context.

A name may be a person and a place. What stands around the places of terms of one type
teaches: the words before and after them, and which type follows which. Counted over all
texts, these give scores; the places of a text are then a chain, of which the types with the
highest sum of scores are chosen (Viterbi).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

import sparkscrub
from sparkscrub.catalog import DICTIONARY_TYPES, RANK
from sparkscrub.operators import automaton
from sparkscrub.operators.gazetteer import gazetteer_spans
from sparkscrub.operators.overlaps import accepted
from sparkscrub.plans.shipping import ship_package
from sparkscrub.plans.sizing import fits_broadcast, hot_keys, materialize, salted_join

KINDS = sorted(DICTIONARY_TYPES, key=RANK.get)
SIDES = ("before", "after")
_PLACES = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("value", T.StringType()),
            T.StructField("kinds", T.ArrayType(T.StringType())),
            *(T.StructField(s, T.StringType()) for s in SIDES),
        ]
    )
)


def word_before(text: str, start: int) -> str:
    end = start
    while end and not automaton._is_word(text[end - 1]):
        end -= 1
    begin = end
    while begin and automaton._is_word(text[begin - 1]):
        begin -= 1
    return text[begin:end].lower()


def word_after(text: str, end: int) -> str:
    begin = end
    while begin < len(text) and not automaton._is_word(text[begin]):
        begin += 1
    stop = begin
    while stop < len(text) and automaton._is_word(text[stop]):
        stop += 1
    return text[begin:stop].lower()


def _in_context(text: str, spans: list[dict], kinds: dict[str, list[str]]) -> list[dict]:
    out = []
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        words = {"before": word_before(text, s["start"]), "after": word_after(text, s["end"])}
        out.append({"start": s["start"], "end": s["end"], "value": s["value"], "kinds": kinds[s["value"]], **words})
    return out


def _places_of(text: str, built: tuple, shard: list) -> list[dict]:
    found, strings = built
    places = list(automaton.term_places(text, found, strings))
    spans = [{"start": a, "end": b, "entity_type": shard[n][1][0], "value": strings[n]} for a, b, n in places]
    numbers = {n for _, _, n in places}
    return _in_context(text, accepted(spans), {strings[n]: shard[n][1] for n in numbers}) if spans else []


def term_places(df: DataFrame, terms: DataFrame, text: str = "text", key: list[str] | None = None) -> DataFrame:
    """Rows ``key, places``: of each text with terms the places, by position, with the types that each may be of
    and the words before and after it. Of terms that overlap the longest wins."""
    key = key or ["part_id"]
    listed = terms.select("term", "entity_type").where("term <> ''").distinct()
    kinds = F.sort_array(F.collect_set("entity_type"))
    listed = materialize(listed.groupBy("term").agg(kinds.alias("kinds")), "terms")
    texts = df.select(*key, F.expr(text).alias("_text"))
    size = listed.agg(F.sum(F.length("term"))).first()[0] or 0
    field = T.StructField("places", _PLACES)
    if fits_broadcast(listed) and size <= automaton.SHARD_CHARS:
        strings = [(r["term"], r["kinds"]) for r in listed.orderBy("term").collect()]
        parts = automaton._passes(texts, strings, _places_of, field)
        return parts[0] if parts else texts.select(*key, F.lit(None).cast(_PLACES).alias("places")).where("false")
    # Too many terms for one automaton: places by joins, and the texts that have any follow.
    one = listed.select("term", F.col("kinds")[0].alias("entity_type"))
    spans = gazetteer_spans(df, one, text, key).join(listed.withColumnRenamed("term", "value"), "value")
    spans = spans.groupBy(*key).agg(F.collect_list(F.struct("start", "end", "value", "kinds")).alias("spans"))
    found = spans.join(texts, key).select(*key, "spans", "_text")
    schema = T.StructType([*(found.schema[c] for c in key), field])
    arrow = to_arrow_schema(schema)
    ship_package(df.sparkSession, sparkscrub)

    def step(batches):
        for batch in batches:
            rows = []
            for spans, text in zip(batch.column(len(key)).to_pylist(), batch.column(len(key) + 1).to_pylist()):
                rows.append(_in_context(text, spans, {s["value"]: s["kinds"] for s in spans}))
            kept = [batch.column(i).cast(arrow.field(i).type) for i in range(len(key))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, arrow.field(len(key)).type)], schema=arrow)

    return found.mapInArrow(step, schema)


def score(count: int, total: int, kinds: int) -> int:
    """A smoothed log-probability in thousandths, so that sums do not depend on their order."""
    return round(1000 * math.log((count + 1) / (total + kinds)))


def decode(options: list[dict[str, int]], follows: dict[tuple[str | None, str], int]) -> list[str]:
    """The types of highest score along a chain; of equal chains the one of earlier ranks at its end."""
    best: dict[str | None, int] = {None: 0}
    steps: list[dict[str, str | None]] = []
    for own in options:
        now, came = {}, {}
        for kind in sorted(own, key=RANK.get):
            sums = {b: s + follows.get((b, kind), 0) for b, s in best.items()}
            came[kind] = max(sums, key=lambda b: (sums[b], -RANK.get(b, 0)))
            now[kind] = sums[came[kind]] + own[kind]
        best = now
        steps.append(came)
    kind = max(best, key=lambda b: (best[b], -RANK.get(b, 0)))
    out = []
    for came in reversed(steps):
        out.append(kind)
        kind = came[kind]
    return out[::-1]


def typed_spans(df: DataFrame, terms: DataFrame, text: str = "text", key: list[str] | None = None) -> DataFrame:
    """Rows ``key, start, end, entity_type, value``: each place where a term stands, with one type.

    ``terms`` has ``term, entity_type``, a term with several types in several rows. A place
    of a term with one type has that type. Without any context that teaches, the first
    rank wins. ``key`` must be unique. Runs jobs when called: places and counted words are
    stored; what reaches the driver are the counts per type, and per pair of types.
    """
    key = key or ["part_id"]
    spark = df.sparkSession
    texts = materialize(term_places(df, terms, text, key), "term-places")
    places = texts.select(*key, F.posexplode("places").alias("n", "p")).select(*key, "n", "p.*")
    sure = places.where(F.size("kinds") == 1).withColumn("kind", F.col("kinds")[0])
    totals = {r["kind"]: r["count"] for r in sure.groupBy("kind").count().collect()}
    before = "IF(i = 1, NULL, places[i - 2].kinds)"
    both = f"transform(sequence(1, size(places)), i -> struct({before} AS a, places[i - 1].kinds AS b))"
    pairs = texts.select(F.explode(F.expr(both)).alias("x"))
    pairs = pairs.where("size(x.b) = 1 AND (x.a IS NULL OR size(x.a) = 1)")
    pairs = pairs.groupBy(F.col("x.a")[0].alias("a"), F.col("x.b")[0].alias("b")).count().collect()
    from_kind: dict[str | None, int] = {}
    for r in pairs:
        from_kind[r["a"]] = from_kind.get(r["a"], 0) + r["count"]
    counted = {(r["a"], r["b"]): r["count"] for r in pairs}
    follows = {(a, b): score(counted.get((a, b), 0), from_kind.get(a, 0), len(KINDS)) for a in (None, *KINDS) for b in KINDS}

    # Each word next to a place votes for the types whose places it stands beside.
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("word")) for s in SIDES))).alias("w")
    words = sure.select("kind", sides).select("kind", "w.*").groupBy("side", "word").pivot("kind", KINDS).count()
    words = materialize(words.fillna(0), "term-words")
    unsure = places.where(F.size("kinds") > 1).select(*key, "n", "kinds", sides).select(*key, "n", "kinds", "w.*")
    if fits_broadcast(words):
        votes = unsure.join(F.broadcast(words), ["side", "word"], "left")
    else:
        votes = salted_join(unsure, words, ["side", "word"], hot_keys(unsure, ["side", "word"]), key, "left")
    votes = votes.select(*key, "n", "kinds", "side", *(F.coalesce(k, F.lit(0)).alias(k) for k in KINDS))
    per_place = votes.groupBy(*key, "n").agg(F.collect_list(F.struct("side", *KINDS)).alias("votes"))
    per_text = per_place.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("n", "votes"))).alias("votes"))
    chains = texts.join(per_text, key, "left")
    chains = chains.select(*key, "places.kinds", F.map_entries("votes").alias("votes"), "places")

    types = T.StructField("types", T.ArrayType(T.StringType()))
    schema = T.StructType([*(chains.schema[c] for c in key), types, T.StructField("places", _PLACES)])
    arrow = to_arrow_schema(schema)

    def step(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = []
            for kinds, votes in zip(batch.column(len(key)).to_pylist(), batch.column(len(key) + 1).to_pylist()):
                seen = {v["key"]: v["value"] for v in votes or ()}
                chain = [
                    {
                        k: sum(score(v[k], totals.get(k, 0), len(totals) + 1) for v in seen.get(n, ())) if len(own) > 1 else 0
                        for k in own
                    }
                    for n, own in enumerate(kinds)
                ]
                types.append(decode(chain, follows))
            kept = [batch.column(i).cast(arrow.field(i).type) for i in range(len(key))]
            last = batch.column(len(key) + 2).cast(arrow.field(len(key) + 1).type)
            yield pa.RecordBatch.from_arrays([*kept, pa.array(types, arrow.field(len(key)).type), last], schema=arrow)

    ship_package(spark, sparkscrub)
    typed = chains.mapInArrow(step, schema)
    rows = typed.select(*key, F.explode(F.arrays_zip("types", "places")).alias("x"))
    return rows.select(*key, "x.places.start", "x.places.end", F.col("x.types").alias("entity_type"), "x.places.value")
