"""Dictionary lookup of names, places and groups from a table of terms.

Stands in for a language model: only listed terms are found, as written, and only
where no letter or digit touches them. Where a model is at hand, plug it in as a
provider (``plans.providers``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscrub.catalog import DICTIONARY_TYPES, RANK
from sparkscrub.functions.spans import resolve_overlaps_sql
from sparkscrub.functions.sqltext import let, name
from sparkscrub.operators.matching import quote_sql
from sparkscrub.plans.expand import expand
from sparkscrub.plans.sizing import fits_broadcast, join_vocabulary, materialize

WORD = r"[\p{L}0-9]"


def _phrases_sql(text: str, words: list[int]) -> str:
    """All distinct runs of so many words, as they stand in the text."""
    runs = ", ".join(
        f"regexp_extract_all({text}, r'(?={WORD})(?<!{WORD})"
        f"(?=({WORD}++(?:[^\\p{{L}}0-9]++{WORD}++){{{n - 1}}}))', 1)"
        for n in words
    )
    return f"array_distinct(concat({runs}))"


def _positions_sql(text: str, term: str) -> str:
    """Start of every occurrence of a term that no letter or digit touches."""
    m, g, acc = name("m"), name("g"), name("acc")
    pattern = (
        f"concat(CASE WHEN {term} RLIKE r'^{WORD}' THEN r'(?<!{WORD})' ELSE '' END, {quote_sql(term)}, "
        f"CASE WHEN {term} RLIKE r'{WORD}$' THEN r'(?!{WORD})' ELSE '' END)"
    )

    def body(p: str) -> str:
        gaps = f"transform(split({text}, {p}, -1), {g} -> length({g}))"
        start = "named_struct('pos', 0, 'out', cast(array() AS array<int>))"
        step = (
            f"named_struct('pos', {acc}.pos + {m} + length({term}), "
            f"'out', concat({acc}.out, array(cast({acc}.pos + {m} AS int))))"
        )
        return let(
            gaps,
            lambda a: f"aggregate(slice({a}, 1, size({a}) - 1), {start}, ({acc}, {m}) -> {step}).out",
            "a",
        )

    return let(pattern, body, "p")


def _prepare_terms(terms: DataFrame) -> tuple[DataFrame, list[int]]:
    """Distinct terms with the words they are looked up by, and the numbers of words in use."""
    terms = terms.select("term", "entity_type").where("term <> ''").distinct()
    core = f"regexp_extract(term, r'{WORD}++(?:[^\\p{{L}}0-9]++{WORD}++)*', 0)"
    terms = terms.withColumn("phrase", F.expr(core)).withColumn(
        "_words", F.expr(f"size(regexp_extract_all(phrase, r'{WORD}+', 0))")
    )
    counts = terms.groupBy("_words", "entity_type").count().collect()
    unknown = {r["entity_type"] for r in counts} - set(DICTIONARY_TYPES)
    if unknown:
        raise ValueError(f"terms are for {DICTIONARY_TYPES}, not {sorted(unknown)}")
    if any(r["_words"] == 0 for r in counts):
        raise ValueError("a term without a letter or digit cannot be looked up")
    return terms.drop("_words"), sorted({r["_words"] for r in counts})


def _matches(
    df: DataFrame, terms: DataFrame, text: str, key: list[str], max_broadcast_rows: int | None
) -> DataFrame:
    """Rows ``key, term, entity_type, positions``: terms whose words stand in a text, and where
    the term itself does (nowhere, if only its punctuation differs)."""
    terms, words = _prepare_terms(terms)
    texts = df.select(*key, F.expr(text).alias("_text"))
    if not words:
        return texts.select(
            *key,
            F.lit("").alias("term"),
            F.lit("").alias("entity_type"),
            F.array().cast("array<int>").alias("positions"),
        ).where("false")
    terms = materialize(terms, "terms")
    in_place = fits_broadcast(terms, max_broadcast_rows)
    carried = ["_text"] if in_place else []
    runs = F.explode_outer(F.expr(_phrases_sql("_text", words))).alias("phrase")
    phrases = expand(texts, [*key, *carried], runs, "phrase")
    found = join_vocabulary(phrases, terms, ["phrase"], key, max_broadcast_rows)
    if not in_place:
        found = found.join(texts, key)
    positions = F.expr(_positions_sql("_text", "term")).alias("positions")
    return found.select(*key, "term", "entity_type", positions)


def gazetteer_values(
    df: DataFrame,
    terms: DataFrame,
    text: str = "text",
    key: list[str] | None = None,
    max_broadcast_rows: int | None = None,
) -> DataFrame:
    """Rows ``key, value, rank``: the distinct terms found in each text.

    The same as with a dict of terms: for each type, matches from left to right without
    overlap, at one place the longest term.
    """
    key = key or ["part_id"]
    found = _matches(df, terms, text, key, max_broadcast_rows)
    rank = F.expr("CASE entity_type " + " ".join(f"WHEN '{t}' THEN {RANK[t]}" for t in DICTIONARY_TYPES) + " END")
    rows = expand(found, [*key, "term", "entity_type"], F.explode_outer("positions").alias("start"), "start")
    hit = F.struct("start", (-F.length("term")).alias("n"), "term")
    per_type = rows.groupBy(*key, "entity_type").agg(F.sort_array(F.collect_set(hit)).alias("hits"))
    step = (
        "IF(h.start < a.last, a, named_struct('last', h.start - h.n, "
        "'kept', IF(array_contains(a.kept, h.term), a.kept, array_append(a.kept, h.term))))"
    )
    kept = f"aggregate(hits, named_struct('last', 0, 'kept', cast(array() AS array<string>)), (a, h) -> {step}).kept"
    return per_type.select(*key, F.explode(F.expr(kept)).alias("value"), rank.alias("rank"))


def gazetteer_spans(
    df: DataFrame,
    terms: DataFrame,
    text: str = "text",
    key: list[str] | None = None,
    max_broadcast_rows: int | None = None,
) -> DataFrame:
    """Rows ``key, start, end, entity_type, value``: each place where a term stands.

    ``terms`` has ``term, entity_type``. Of terms that overlap the longest wins.
    """
    key = key or ["part_id"]
    found = _matches(df, terms, text, key, max_broadcast_rows)
    rows = expand(found, [*key, "term", "entity_type"], F.explode_outer("positions").alias("start"), "start")
    spans = rows.select(
        *key,
        F.struct(
            "start",
            (F.col("start") + F.length("term")).alias("end"),
            "entity_type",
            F.col("term").alias("value"),
        ).alias("span"),
    )
    # A text's own hits; they are no more than the text holds.
    per_text = spans.groupBy(*key).agg(F.collect_list("span").alias("spans"))
    return per_text.select(*key, F.expr(f"inline({resolve_overlaps_sql('spans')})"))
