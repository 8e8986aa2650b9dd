"""Tables in one file are spread; tables may be folders."""

from pyspark.sql import functions as F

from checks.registry import QUERIES
from sparkscrub.sources.tables import read_texts, spread_rows


def test_a_table_of_one_row_group_is_spread(spark, tmp_path):
    spark.range(4000).withColumn("text", F.lit("x")).coalesce(1).write.parquet(f"{tmp_path}/one")
    rows = read_texts(spark, f"{tmp_path}/one", ["id", "text"])
    assert rows.rdd.getNumPartitions() == 1
    spread = spread_rows(rows, ["id"])
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) * spark.sparkContext.defaultParallelism < 2 * 4000
    assert sorted(spread.collect()) == sorted(rows.collect())


def test_rows_that_are_spread_stay(spark):
    even = spark.range(0, 4000, 1, 2 * spark.sparkContext.defaultParallelism)
    assert spread_rows(even, ["id"]) is even
    empty = spark.range(0)
    assert spread_rows(empty, ["id"]) is empty


def test_a_stream_of_a_table_in_a_folder(spark, tmp_path):
    rows = [(1, "mail a@example.com", "s"), (2, None, "s"), (2, "call", None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["scrub_stream_documents"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.masked or "") for r in got) == [(1, "mail <EMAIL_ADDRESS>"), (2, ""), (2, "call")]


def test_spread_tables_fill_whole_rounds_of_cores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("sparkscrub.sources.tables.ROWS_EACH", 300)
    spark.range(4000).coalesce(1).write.parquet(f"{tmp_path}/one")
    spread = spread_rows(read_texts(spark, f"{tmp_path}/one", ["id"]), ["id"])
    assert spread.rdd.getNumPartitions() % spark.sparkContext.defaultParallelism == 0
