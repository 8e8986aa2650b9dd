"""Reports that merge, and the index of files."""

import pytest
from pyspark.sql import functions as F

from sparkscrub.operators.detect import detect, explode_spans
from sparkscrub.operators.reports import entity_report
from sparkscrub.operators.sketches import entity_report_of, entity_sketches, merge_sketches, relative_error, sketch_report
from sparkscrub.sources.skipping import files_to_read, index_files, read_holding

CHOSEN = ["IP_ADDRESS", "EMAIL_ADDRESS"]


def texts(spark, n=4000):
    ip = "concat('10.', id % 7, '.', id div 250 % 250, '.', id % 250)"
    return spark.range(n).selectExpr(
        "id", "IF(id % 9 = 0, NULL, id % 5) AS day", f"concat({ip}, ' and ', {ip}, ' u', id % 300, '@b.org') AS text"
    )


def test_merged_estimates_are_within_their_bounds(spark):
    found = detect(texts(spark), entities=CHOSEN)
    exact = {r.entity_type: r.distinct_values for r in entity_report(explode_spans(found), CHOSEN).collect()}
    by_day = entity_sketches(found, ["day"])
    again = merge_sketches(merge_sketches(by_day, ["day"]))
    for stored in (entity_sketches(found), by_day, again):
        for r in sketch_report(stored).collect():
            assert r.low <= exact[r.entity_type] <= r.high
            assert r.high - r.low <= 7 * relative_error() * exact[r.entity_type] + 2
    hits = {r.entity_type: (r.hits, r.texts) for r in sketch_report(by_day).collect()}
    assert hits == {"IP_ADDRESS": (8000, 4000), "EMAIL_ADDRESS": (4000, 4000)}


def test_loads_are_merged_without_a_second_scan(spark):
    found = detect(texts(spark, 1000), entities=CHOSEN)
    loads = [entity_sketches(found.where(F.col("id") % 3 == n), ["day"]) for n in range(3)]
    merged = {(r.day, r.entity_type): r for r in sketch_report(loads[0].union(loads[1]).union(loads[2]), ["day"]).collect()}
    for r in explode_spans(found).groupBy("day", "entity_type").agg(F.countDistinct("value").alias("n"), F.count("*").alias("h")).collect():
        own = merged[r.day, r.entity_type]
        assert own.hits == r.h and own.low <= r.n <= own.high
    assert (None, "IP_ADDRESS") in merged


def test_types_without_hits_are_reported(spark):
    found = detect(spark.createDataFrame([(1, "1.2.3.4"), (2, None), (3, "")], "id int, text string"), entities=CHOSEN)
    report = {r.entity_type: (r.hits, r.distinct_values) for r in entity_report_of(entity_sketches(found), CHOSEN).collect()}
    assert report == {"IP_ADDRESS": (1, 1), "EMAIL_ADDRESS": (0, 0)}


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(f, i, t) for f, t in enumerate(["1.2.3.4", "a@b.org", "nothing", None, "x@y.org 4.3.2.1"]) for i in range(20)]
    for f in range(5):
        spark.createDataFrame([r for r in rows if r[0] == f], "f int, i int, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    return str(tmp_path / "t")


def test_only_files_that_may_hold_a_type_are_read(spark, folder):
    whole = spark.read.parquet(folder)
    index = index_files(whole).cache()
    assert index.count() == 5 and index.agg(F.sum("n_texts")).first()[0] == 100
    for chosen, files in ((["IP_ADDRESS"], {0, 4}), (["EMAIL_ADDRESS"], {1, 4}), (CHOSEN, {0, 1, 4}), (["CRYPTO"], set())):
        read = read_holding(spark, folder, index, chosen)
        assert {r.f for r in read.select("f").distinct().collect()} == files
        assert len(read.inputFiles()) == len(files)
        want = explode_spans(detect(whole, entities=chosen)).drop("text")
        assert explode_spans(detect(read, entities=chosen)).drop("text").exceptAll(want).count() == 0
        assert explode_spans(detect(read, entities=chosen)).count() == want.count()
    assert len(files_to_read(spark, folder, index, ["PERSON"])) == 5


def test_unknown_and_changed_files_are_read(spark, folder):
    index = index_files(spark.read.parquet(folder))
    index = spark.createDataFrame(index.collect(), index.schema)
    spark.createDataFrame([(9, 0, "plain")], "f int, i int, text string").coalesce(1).write.mode("append").parquet(folder)
    assert {r.f for r in read_holding(spark, folder, index, ["IP_ADDRESS"]).collect()} == {0, 4, 9}
    older = index.withColumn("file_size", F.col("file_size") + 1)
    assert len(files_to_read(spark, folder, older, ["IP_ADDRESS"])) == 6


def test_the_registered_report_searches_the_texts_once(spark, tmp_path):
    from checks.registry import QUERIES

    tables = {
        "customer": ("c_custkey long, c_name string, c_nationkey int", [(1, "Ann", 1), (2, "Bob", 1)]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(1, "PERU", 1)]),
        "region": ("r_regionkey int, r_name string", [(1, "AMERICA")]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate date", [(n, 1 + n % 2, None) for n in range(1, 9)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    report = QUERIES["entity_report_of_sketches"](spark, str(tmp_path))
    assert "regexp_extract_all" not in report._jdf.queryExecution().optimizedPlan().toString()
    assert all(r["estimate_holds"] for r in report.collect())
