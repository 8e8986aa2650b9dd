"""Types of ambiguous terms by their context, next to all chains and to hidden types."""

import itertools
import random

import pytest

from sparkscrub.operators import automaton
from sparkscrub.operators.ambiguous import KINDS, decode, typed_spans, word_after, word_before
from sparkscrub.operators.automaton import automaton_spans

TERMS = "term string, entity_type string"


def test_decoding_finds_the_best_chain():
    pick = random.Random(3)
    for _ in range(200):
        follows = {(a, b): -pick.randrange(3000) for a in (None, *KINDS) for b in KINDS}
        options = [{k: -pick.randrange(3000) for k in pick.sample(KINDS, pick.randint(1, 3))} for _ in range(pick.randint(1, 5))]

        def total(chain):
            return sum(o[k] for o, k in zip(options, chain)) + sum(follows[a, b] for a, b in zip((None, *chain), chain))

        assert total(decode(options, follows)) == max(map(total, itertools.product(*options)))


def test_words_around_a_place():
    text = "Vor Ann-Lee, (née SSa) 7."
    assert word_before(text, 4) == "vor" and word_after(text, 11) == "née"
    assert word_before(text, 0) == "" and word_after(text, len(text)) == ""


def made(seed, n=300):
    """Names and places whose words around them tell them apart; a fifth of the terms is both."""
    pick = random.Random(seed)
    names, places = [f"Name{i}" for i in range(40)], [f"Town{i}" for i in range(40)]
    rows, right = [], {}
    for i in range(n):
        text = ""
        for _ in range(pick.randint(1, 4)):
            person = pick.random() < 0.5
            term = pick.choice(names if person else places)
            lead = pick.choice(["dear", "Mr", "asked"] if person else ["in", "near", "from"])
            text += f"{lead} "
            right[i, len(text)] = "PERSON" if person else "LOCATION"
            text += f"{term} {pick.choice(['said', 'and', 'then'])}, "
        rows.append((i, text))
    terms = [(t, "PERSON") for t in names] + [(t, "LOCATION") for t in places]
    unsure = pick.sample(names, 8) + pick.sample(places, 8)
    return rows, terms + [(t, k) for t in unsure for k in ("PERSON", "LOCATION")], right, set(unsure)


@pytest.mark.parametrize("chars", [2_000_000, 10])
def test_hidden_types_come_back(spark, monkeypatch, chars):
    monkeypatch.setattr(automaton, "SHARD_CHARS", chars)
    rows, terms, right, unsure = made(4)
    df = spark.createDataFrame(rows, "id int, text string")
    got = typed_spans(df, spark.createDataFrame(terms, TERMS), "text", ["id"]).collect()
    assert {(r.id, r.start) for r in got} == set(right)
    hidden = [r for r in got if r.value in unsure]
    # Both precision and recall: every place gets one type.
    assert len(hidden) > 100 and all(right[r.id, r.start] == r.entity_type for r in hidden)


def test_without_context_the_first_rank_wins(spark):
    df = spark.createDataFrame([(1, "Paris"), (2, None), (3, ""), (4, "none")], "id int, text string")
    terms = spark.createDataFrame([("Paris", "LOCATION"), ("Paris", "PERSON")], TERMS)
    got = typed_spans(df, terms, "text", ["id"]).collect()
    assert [tuple(r) for r in got] == [(1, 0, 5, "PERSON", "Paris")]
    assert typed_spans(df, terms.limit(0), "text", ["id"]).collect() == []


def test_sure_terms_are_as_ever(spark):
    rows, terms, _, unsure = made(5, 60)
    sure = spark.createDataFrame([t for t in terms if t[0] not in unsure], TERMS)
    df = spark.createDataFrame(rows, "id int, text string")
    got = sorted(map(tuple, typed_spans(df, sure, "text", ["id"]).collect()))
    assert got == sorted(map(tuple, automaton_spans(df, sure, "text", ["id"]).collect()))


def test_a_text_does_not_read_the_whole_list_of_terms():
    from sparkscrub.operators import ambiguous, automaton

    class Long(list):
        def __iter__(self):
            raise AssertionError("read as a whole")

    terms = [("Ann", ["PERSON"]), ("Paris", ["LOCATION", "PERSON"])]
    built = automaton._automaton("terms", terms)
    got = ambiguous._places_of("Ann in Paris", built, Long(terms))
    assert [(p["value"], p["kinds"]) for p in got] == terms
