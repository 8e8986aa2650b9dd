"""Automata find what the joins find."""

import random

import pytest

from sparkscrub.operators import automaton
from sparkscrub.operators.automaton import automaton_spans, automaton_values
from sparkscrub.operators.gazetteer import gazetteer_spans
from sparkscrub.operators.matching import find_values
from sparkscrub.plans import sizing

TERMS = "term string, entity_type string"


def made(seed):
    pick = random.Random(seed)
    words = ["ann", "Ann Lee", "lee", "a b a", "b", "São", "é😀", "x-y", "(c)", "7", "North 7", "new york", "york new"]
    texts = [(i, pick.choice(["", " ", "."]).join(pick.choice([*words, "new", "zz", " ", "a"]) for _ in range(pick.randint(0, 12)))) for i in range(150)]
    return texts + [(200, None), (201, ""), (202, "a b a b a b a"), (203, "Annlee Ann Lee7 (c)c ((c))")], words


@pytest.mark.parametrize("chars", [2_000_000, 12])
def test_spans_are_those_of_the_joins(spark, monkeypatch, chars):
    monkeypatch.setattr(automaton, "SHARD_CHARS", chars)
    texts, words = made(1)
    df = spark.createDataFrame(texts, "id int, text string").selectExpr("*", "'x' AS spans")
    kinds = ["PERSON", "LOCATION", "NRP"]
    terms = spark.createDataFrame([(w, kinds[i % 3]) for i, w in enumerate(words)] + [("ann", "NRP"), ("", "NRP")], TERMS)
    want = sorted(map(tuple, gazetteer_spans(df, terms, "text", ["id"]).collect()))
    got = automaton_spans(df, terms, "text", ["id"])
    assert got.columns == ["id", "start", "end", "entity_type", "value"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_terms_that_do_not_fit_are_joined(spark, monkeypatch):
    texts, words = made(2)
    df = spark.createDataFrame(texts, "id int, text string")
    terms = spark.createDataFrame([(w, "PERSON") for w in words], TERMS)
    own = sorted(map(tuple, automaton_spans(df, terms, "text", ["id"]).collect()))
    monkeypatch.setattr(sizing, "MAX_BROADCAST_ROWS", 3)
    monkeypatch.setattr(automaton, "_passes", None)
    assert sorted(map(tuple, automaton_spans(df, terms, "text", ["id"]).collect())) == own


def test_types_are_checked(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    with pytest.raises(ValueError):
        automaton_spans(df, spark.createDataFrame([("a", "URL")], TERMS), "text", ["id"])
    assert automaton_spans(df, spark.createDataFrame([], TERMS), "text", ["id"]).collect() == []


@pytest.mark.parametrize("chars", [2_000_000, 30])
def test_values_are_those_of_the_lookup(spark, monkeypatch, chars):
    monkeypatch.setattr(automaton, "SHARD_CHARS", chars)
    pick = random.Random(5)
    texts = [(i, i % 3, "".join(pick.choices("ab.é😀\n\\E$", k=pick.randrange(40)))) for i in range(60)] + [(99, 0, ""), (98, None, None)]
    values = {(pick.randrange(3), "".join(pick.choices("ab.é😀\n\\E$", k=pick.randrange(0, 9)))) for _ in range(120)}
    values |= {(s, t[2:30]) for _, s, t in texts[:9]}
    df = spark.createDataFrame(texts, "id int, s int, text string")
    known = spark.createDataFrame(sorted(values), "s int, value string")
    got = sorted(map(tuple, automaton_values(df, known, ["s"], ["id"]).collect()))
    assert got == sorted((s, i, v) for i, s, t in texts for w, v in values if t and v and w == s and v in t)
    plain = known.select("value").distinct()
    assert sorted(automaton_values(df, plain, [], ["id"]).collect()) == sorted(find_values(df, plain, [], ["id"]).collect())
    assert automaton_values(df, plain.limit(0), [], ["id"]).collect() == []
