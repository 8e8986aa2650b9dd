"""From raw documents to token ids: quality, lines, near copies, benchmark passages, encoding.

Each stage takes what the one before kept and returns the columns of documents; the last
one returns the encoded documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscrub.llm.bpe import round_trip
from sparkscrub.llm.decontaminate import without_contaminated
from sparkscrub.llm.lines import without_repeated_lines
from sparkscrub.llm.quality import rate_quality
from sparkscrub.llm.simhash import without_near_copies
from sparkscrub.plans.sizing import delete_table, scratch, scratch_dir

# Rows of an Arrow batch. Buffers that an executor has taken for large batches stay with it, so
# that stages one after the other would add up.
BATCH_ROWS = 500


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_position(docs: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A step over ``doc_id``, ``text`` and the other columns under names that nothing clashes with."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    names = {c: c if c in ("doc_id", "text") else f"c{n}" for n, c in enumerate(docs.columns)}
    kept = step(docs.toDF(*names.values()))
    return kept.select(*(F.col(names[c]).alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or the forest rejects go."""
    labels = _table(spark, sf_dir, "labels")

    def step(rows):
        others = ("c", *(c for c in rows.columns if c not in ("doc_id", "text")))
        kept = rate_quality(rows.withColumn("c", F.col("text")), labels, keep=others).where("kept")
        return kept.withColumnRenamed("c", "text")

    return _by_position(docs, step)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; every document stays, if need be without text."""
    cut = _by_position(docs, without_repeated_lines)
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return _by_position(docs, lambda rows: without_near_copies(rows, shingle=4, radius=4))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    benchmark = _table(spark, sf_dir, "benchmark")
    return _by_position(docs, lambda rows: without_contaminated(rows, benchmark))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with the hashes of the ids and of the decoded bytes."""
    return round_trip(docs, keep=("lang", "source"), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level bpe", byte_level_bpe),
]

# SQL can express neither the forest nor the minima of hashes; the tests use plain models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each stage keeps is written before the next one reads it.

    What a stage stored on its way is deleted once its output is written, and its input
    once nothing reads it any more; the last stage's input stays.
    """
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{scratch_dir(spark)}/sparkscrub/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        if before:
            delete_table(spark, before)
        docs, before = spark.read.schema(kept.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
