"""Text tables in and masked tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows that a task is dealt, where there are more than all cores take at once.
ROWS_EACH = 100_000
# The largest split may have so many times its share of the rows.
MAX_UNEVEN = 1.25


def read_texts(
    spark: SparkSession, path: str, columns: list[str], fmt: str = "parquet", partitions: int | None = None
) -> DataFrame:
    """Read the columns of a text table; rows are not moved.

    Detection is bound by the processor, and a table in one small file is read by one
    task. ``partitions`` spreads such a table by a hash of its rows; leave it out for
    large tables, for which ``spark.sql.files.maxPartitionBytes`` sets the splits, or see
    ``spread_rows``, which counts.
    """
    df = spark.read.format(fmt).load(path).select(*columns)
    return df.repartition(partitions, *columns[:1]) if partitions else df


def spread_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """``df`` as it is, or dealt anew by a hash of ``key`` where its files would not keep all cores busy.

    A file is cut at its row groups only, so one task may read most of a table. The rows of
    each split are counted first; of files with footers that reads no column.
    """
    rows = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"))
    row = rows.agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not row["n"] or row["most"] * cores <= MAX_UNEVEN * row["n"]:
        return df
    # Whole rounds of all cores, so that none is left with a last task alone.
    rounds = max(1, -(-row["n"] // (ROWS_EACH * cores)))
    return df.repartition(rounds * cores, *key)


def text_parts(
    df: DataFrame, text: str = "text", scope: list[str] | None = None, key: list[str] | None = None, kind: str = "text"
) -> DataFrame:
    """Any text table as parts: ``scope_id, part_id, part_no, kind, text``.

    ``key`` identifies a row, its last column orders the rows of a scope; without
    ``scope`` each row is its own. Ids of several columns are joined by a slash.
    """
    key = key or [df.columns[0]]

    def ident(columns: list[str]):
        return F.concat_ws("/", *(F.col(c).cast("string") for c in columns))

    numeric = dict(df.dtypes)[key[-1]] in ("tinyint", "smallint", "int", "bigint")
    number = F.col(key[-1]).cast("long") if scope and numeric else F.lit(0).cast("long")
    return df.select(
        ident(scope or key).alias("scope_id"),
        ident(key).alias("part_id"),
        number.alias("part_no"),
        F.lit(kind).alias("kind"),
        F.col(text).alias("text"),
    )


def without_originals(df: DataFrame, keep: list[str] | None, drop: list[str] | None) -> DataFrame:
    """The columns to write; it takes a list of columns to keep or to drop."""
    if (keep is None) == (drop is None):
        raise ValueError("name the columns to keep=[...], or those with originals to drop=[...]")
    missing = set(keep or drop or ()) - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.select(*keep) if keep is not None else df.drop(*drop)


def write_masked(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    drop: list[str] | None = None,
    partition_by: list[str] | None = None,
    mode: str = "errorifexists",
    keep: list[str] | None = None,
) -> None:
    """Write a masked table: the columns in ``keep``, or all but those in ``drop``.

    One of the two must be given, so that columns with originals are not written by
    mistake.
    """
    writer = without_originals(df, keep, drop).write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
