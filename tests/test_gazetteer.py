import random
import re

import pytest

from sparkscrub.catalog import RANK
from sparkscrub.operators.detect import detect, explode_spans
from sparkscrub.operators.gazetteer import gazetteer_spans, gazetteer_values
from sparkscrub.operators.scrub import scrub
from tests import models

WORD = r"[^\W_]"


def brute(text, terms):
    found = []
    for term, t in terms:
        left = f"(?<!{WORD})" if re.match(WORD, term) else ""
        right = f"(?!{WORD})" if re.match(WORD, term[-1]) else ""
        found += [(m.start(), m.end(), t, term) for m in re.finditer(left + re.escape(term) + right, text)]
    return sorted(models.resolve(found, RANK))


@pytest.mark.parametrize("large", [False, True])
def test_against_brute_force(spark, request, large):
    if large:
        request.getfixturevalue("tight")
    rnd = random.Random(3)
    words = ["Ann", "Lee", "New", "York", "City", "é", "St.", "-", "O'Neil", "x1", "😀"]
    texts = [(i, rnd.choice([" ", " ", ", "]).join(rnd.choices(words, k=rnd.randrange(12)))) for i in range(60)]
    terms = list({
        (" ".join(rnd.choices(words, k=rnd.randrange(1, 4))), rnd.choice(["PERSON", "LOCATION", "NRP"])) for _ in range(40)
    })
    terms = list({t: (t, e) for t, e in terms if re.search(WORD, t)}.values())
    df = spark.createDataFrame(texts, "id int, text string")
    table = spark.createDataFrame(terms, "term string, entity_type string")
    spans = gazetteer_spans(df, table, key=["id"]).collect()
    for i, text in texts:
        got = sorted((r["start"], r["end"], r["entity_type"], r["value"]) for r in spans if r["id"] == i)
        assert got == brute(text, terms), text
    # As values, the table finds what the same terms find as a dict.
    listed = {e: [t for t, own in terms if own == e] for _, e in terms}
    found = explode_spans(detect(df, entities=list(listed), terms=listed)).select("id", "value").distinct()
    values = {(r["id"], r["value"]) for r in gazetteer_values(df, table, key=["id"]).collect()}
    assert values == {(r["id"], r["value"]) for r in found.collect()}


def test_bad_terms(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    with pytest.raises(ValueError):
        gazetteer_spans(df, spark.createDataFrame([("--", "PERSON")], "term string, entity_type string"), key=["id"])
    with pytest.raises(ValueError):
        gazetteer_spans(df, spark.createDataFrame([("a", "URL")], "term string, entity_type string"), key=["id"])
    none = spark.createDataFrame([], "term string, entity_type string")
    assert gazetteer_spans(df, none, key=["id"]).count() == 0


def test_scrub_with_a_table_of_terms(spark):
    df = spark.createDataFrame([(1, "Ann Lee wrote to a@b.org"), (2, "Annual Ann Leeds"), (3, "Ann Lee")], "id int, text string")
    terms = spark.createDataFrame([("Ann Lee", "PERSON"), ("Leeds", "LOCATION")], "term string, entity_type string")
    got = [r["masked"] for r in scrub(df, key=["id"], terms=terms).orderBy("id").collect()]
    assert got == ["<PERSON> wrote to <EMAIL_ADDRESS>", "Annual Ann <LOCATION>", "<PERSON>"]
    only = [r["masked"] for r in scrub(df, key=["id"], terms=terms, entities=["PERSON"]).orderBy("id").collect()]
    assert only == ["<PERSON> wrote to a@b.org", "Annual Ann Leeds", "<PERSON>"]


def test_dict_and_table_of_terms_agree(spark):
    df = spark.createDataFrame([(1, "New York City and Yorkshire, York .NET ASP.NET")], "id int, text string")
    terms = [("New York City", "LOCATION"), ("York", "LOCATION"), (".NET", "NRP")]
    table = spark.createDataFrame(terms, "term string, entity_type string")
    listed = {"LOCATION": ["New York City", "York"], "NRP": [".NET"]}
    one = scrub(df, key=["id"], terms=table, entities=["LOCATION", "NRP"]).first()["masked"]
    assert one == scrub(df, terms=listed, entities=["LOCATION", "NRP"]).first()["masked"]
    plain = spark.createDataFrame([(1, "New York City and Yorkshire")], "id int, text string")
    assert scrub(plain, key=["id"], terms=table, entities=["LOCATION"]).first()["masked"] == "<LOCATION> and Yorkshire"
