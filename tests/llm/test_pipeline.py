"""The registered queries and the pipeline against plain models at the smallest scale."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sparkscrub.llm import bpe, licenses, pii, quality
from sparkscrub.llm.common import materialize
from sparkscrub.plans import sizing

from . import models
from .models import by_key, sha

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def items():
    return duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()


def rows(spark, name, n=None):
    return by_key(r[:n] for r in map(tuple, QUERIES[name](spark, SF).collect()))


def test_simhash(spark, docs):
    assert rows(spark, "op2_simhash") == by_key(models.simhash_rows(docs))


def test_personal_data(spark, docs):
    expected = []
    for key, text in docs:
        spans = models.base_spans(text, pii.luhn)
        counts = [sum(k == n for _, k, _ in spans) for n in range(4)]
        expected.append((key, *counts, sha(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans))))
    assert rows(spark, "op3_personal_data", 6) == by_key(expected)


def test_decontamination(spark, docs, items):
    assert rows(spark, "op6_decontamination") == by_key(models.contaminated_rows(docs, items))


def test_substrings(spark, docs):
    assert rows(spark, "op7_substring_dedup") == by_key((*r[:3], sha(r[3])) for r in models.unrepeated_rows(docs))


def test_lines(spark, docs):
    """The bands may miss a link near the threshold, but no equal lines, and make none up."""
    got = {r[0]: r for r in rows(spark, "op5_line_dedup")}
    expected = {k: (k, n, m, sha(t)) for k, n, m, t in models.deduped_lines(docs)}
    assert len(got) == len(expected)
    differ = sum(got[k] != expected[k] for k in got)
    assert differ <= 0.03 * len(got)
    assert sum(r[2] for r in got.values()) >= 0.97 * sum(r[2] for r in expected.values())


def test_licenses(spark, docs):
    expected = [(k, *models.phrase_places(t, licenses.BASE_PHRASES)) for k, t in docs]
    assert rows(spark, "op9_license_scan", 6) == by_key(expected)


def test_quality(spark, docs):
    got = QUERIES["op10_quality_rules"](spark, SF).collect()
    own = {r.doc_id: tuple(r)[1:7] for r in got}
    for key, text in docs:
        c = models.base_counts(text)
        assert own[key] == (*c, c[0] < 50 or 100 * c[4] > 50 * c[0])
    assert all(not r.kept for r in got if r.base_failed)


def test_quality_rules_with_columns_of_their_names(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    more = documents.selectExpr("*", "'a' AS kept", "doc_id AS score", "'b' AS n_words", "1 AS c1", "2 AS `x.y`")
    got = corpus_pipeline.quality_rules(spark, more, SF)
    assert got.columns == more.columns
    expected = corpus_pipeline.quality_rules(spark, documents, SF)
    found = by_key(got.collect())
    assert [r[: len(documents.columns)] for r in found] == by_key(expected.collect())
    assert all(r[-5:] == ("a", r[0], "b", 1, 2) for r in found)


def test_stages_with_any_columns(spark):
    """Extra columns have any names and are handed on by all stages but the last."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["_k", "_id", "_key", "_text", "_lines", "_gone", "_kept", "_removed", "fp", "component", "k", "x.y", "c0", "kept"]
    more = documents
    for name in names:
        more = more.withColumn(name, F.col("doc_id"))
    for name, function in corpus_pipeline.STAGES[:-1]:
        got = materialize(function(spark, more, SF), "test")
        assert got.columns == more.columns and got.count() > 100
        assert got.where(" OR ".join(f"NOT doc_id <=> `{n}`" for n in names)).isEmpty()
    name, function = corpus_pipeline.STAGES[-1]
    assert function(spark, more, SF).count() == documents.count()


def test_stages_with_nulls_and_repeated_keys(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    odd = documents.limit(6).selectExpr("IF(doc_id % 2 = 0, NULL, 3) AS doc_id", "IF(doc_id % 3 = 0, NULL, text) AS text", "lang", "source", "n_chars")
    odd = materialize(odd.union(odd).unionByName(documents.limit(2).withColumn("text", F.lit(""))), "odd")
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, odd, SF).count() <= odd.count()
        assert function(spark, odd.limit(0), SF).count() == 0
    assert corpus_pipeline.byte_level_bpe(spark, odd, SF).count() == odd.count()


def test_pipeline_deletes_what_it_stored(spark):
    before = set(map(str, Path(sizing.scratch_dir(spark).removeprefix("file:")).glob("sparkscrub/*")))
    result = corpus_pipeline.run(spark, SF)
    after = set(map(str, Path(sizing.scratch_dir(spark).removeprefix("file:")).glob("sparkscrub/*")))
    # Only the input of the last stage is still read.
    assert len(after - before) == 1 and result.count() > 0


def test_pipeline(spark, docs, items):
    """Each stage against a plain model of it, on what the one before kept."""
    names, functions = zip(*corpus_pipeline.STAGES)
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    now, state = documents, {k: t for k, t in docs}
    for name, function in zip(names, functions):
        now = materialize(function(spark, now, SF), "test")
        found = {r.doc_id: r for r in now.collect()}
        if name == "quality rules":
            rated = quality.rate_quality(documents, spark.read.parquet(f"{SF}/labels.parquet")).collect()
            assert set(found) == {r.doc_id for r in rated if r.kept}
        elif name == "line dedup":
            assert set(found) == set(state)
            expected = {k: t for k, _, _, t in models.deduped_lines(list(state.items()))}
            assert sum(found[k].text != t for k, t in expected.items()) <= 0.03 * len(expected)
            assert all(r.n_chars == len(r.text) for r in found.values())
        elif name == "simhash near-dedup":
            assert set(found) == {r[2] for r in models.simhash_rows(list(state.items()))}
        elif name == "benchmark decontamination":
            expected = models.contaminated_rows(list(state.items()), items)
            assert set(found) == {r[0] for r in expected if not r[-1]} and len(found) < len(state)
        else:
            codec = bpe.codec(None, None)
            assert set(found) == set(state)
            assert all(codec.decode(r.ids) == state[k].encode() for k, r in found.items())
            break
        assert now.columns == documents.columns
        state = {k: r.text for k, r in found.items()}
    assert by_key(corpus_pipeline.run(spark, SF).collect()) == by_key(now.collect())
