"""A provider as a table function gives what the provider gives."""

import pytest

from sparkscrub.functions.tablefunctions import register_scope_function
from sparkscrub.plans.providers import model_provider, scrub_with_provider

ROWS = [
    (1, "s", "ann met bob"),
    (2, "s", "annual <US_SSN> SSN"),
    (3, "t", "ann"),
    (4, None, "ann ANN"),
    (5, "s", None),
    (6, "s", " "),
    (7, "t", "ann bob bobby Q"),
]


def load():
    def model(text):
        found = {"bob": "Q", "SSN": "<X>"} if "met" in text else {"ann": "<PERSON>", "Q": "ann", "": "x", "ANN": "ANN"}
        return found | ({"bob": "<PERSON>", "bobby": "<PERSON>"} if "bobby" in text else {})

    return model


def test_scopes_are_masked_alike(spark):
    register_scope_function(spark, load, "scrub_test")
    df = spark.createDataFrame(ROWS, "id int, s string, text string")
    df.createOrReplaceTempView("rows_of_scopes")
    got = spark.sql("SELECT * FROM scrub_test(TABLE(rows_of_scopes) PARTITION BY (s), 'text')")
    assert got.columns == ["id", "s", "text", "masked"]
    want = scrub_with_provider(df, model_provider(load), scope=["s"], key=["id"])
    assert {r.id: r.masked for r in got.collect()} == {r.id: r.masked for r in want.collect()}
    assert spark.sql("SELECT * FROM scrub_test(TABLE(SELECT * FROM rows_of_scopes WHERE id > 9) PARTITION BY (s), 'text')").count() == 0


def test_arguments_are_checked(spark):
    register_scope_function(spark, load, "scrub_test")
    spark.createDataFrame([(1, "a")], "id int, masked string").createOrReplaceTempView("with_masked")
    for call in ("TABLE(with_masked) PARTITION BY (id), 'masked'", "TABLE(rows_of_scopes) PARTITION BY (s), 'nothing'"):
        with pytest.raises(Exception, match="text column|not be found"):
            spark.sql(f"SELECT * FROM scrub_test({call})").collect()
