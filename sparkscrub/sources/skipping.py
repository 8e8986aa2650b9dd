"""A stored index of files: which types can a file hold at all?

The cheap tests that stand before detection (``may_hold``) are kept per file. A later run for
some types opens only the files that may hold them; files that the index does not know, or
that changed since, are opened too. The result is that of reading everything.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscrub.catalog import RANKED_TYPES, select_entities
from sparkscrub.functions.detectors import families_for
from sparkscrub.functions.spans import may_hold_sql
from sparkscrub.functions.sqltext import column

_FILE = ["_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time"]


def _pattern_types() -> list[str]:
    return [t for t in RANKED_TYPES if families_for((t,))]


def index_files(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows ``file_path, file_size, file_modification_time, n_texts, types`` of a table read from files.

    ``types`` are those of which the file may hold a value. One pass, one row per file
    and partition is shuffled. Store the result, and add the rows of new files to it.
    """
    own = column(df, text)
    tests = [F.bool_or(F.expr(f"coalesce({may_hold_sql(own, [t])}, false)")).alias(t) for t in _pattern_types()]
    per_file = df.select("*", *_FILE).groupBy("file_path", "file_size", "file_modification_time")
    found = per_file.agg(F.count("*").alias("n_texts"), *tests)
    types = F.array_compact(F.array(*(F.when(F.col(t), F.lit(t)) for t in _pattern_types())))
    return found.select("file_path", "file_size", "file_modification_time", "n_texts", types.alias("types"))


def files_to_read(
    spark: SparkSession, path: str, index: DataFrame, entities: Iterable[str] | None = None, fmt: str = "parquet"
) -> list[str]:
    """The files of a folder that may hold the chosen types, or that the index does not know as they are.

    Types that are found by terms only may stand in any file.
    """
    chosen = select_entities(entities)
    present = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    present = present.option("pathGlobFilter", f"*.{fmt}").load(path)
    names = {"path": "file_path", "length": "file_size", "modificationTime": "file_modification_time"}
    present = present.select(*(F.col(c).alias(n) for c, n in names.items()))
    if any(t not in _pattern_types() for t in chosen):
        return sorted(r["file_path"] for r in present.collect())
    holds = F.arrays_overlap("types", F.array(*(F.lit(t) for t in chosen)))
    useless = index.where(~holds).select("file_path", "file_size", "file_modification_time")
    rows = present.join(useless, ["file_path", "file_size", "file_modification_time"], "left_anti")
    return sorted(r["file_path"] for r in rows.select("file_path").collect())


def read_holding(
    spark: SparkSession,
    path: str,
    index: DataFrame,
    entities: Iterable[str] | None = None,
    fmt: str = "parquet",
    **options: str,
) -> DataFrame:
    """The rows of the files that may hold the chosen types.

    Rows without a hit may be missing from it, rows with one never are. Lists the files
    when called, as every read does.
    """
    files = files_to_read(spark, path, index, entities, fmt)
    whole = spark.read.format(fmt).options(**options)
    if not files:
        return whole.load(path).where("false")
    return whole.schema(spark.read.format(fmt).options(**options).load(path).schema).load(files)
