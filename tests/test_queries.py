"""Every registered query next to its SQL, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from checks import registry
from checks.compare import connect, difference

SF = "/root/testdata/sf0.001"
# The queries of sparkscrub/llm have tests of their own.
QUERIES, SQL = registry.QUERIES, registry.SQL


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "masked"] and df.count() == 200


def test_all_have_an_expected_result():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert difference(QUERIES[name](spark, SF), duck, SQL[name]) is None
