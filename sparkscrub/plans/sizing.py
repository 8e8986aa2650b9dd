"""Decisions that need the size of the data: what to broadcast, which keys are hot,
and where to keep a small table that several steps read."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only below both bounds. The driver holds it several times (collected, hashed,
# in blocks), and a query several such sides at once.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 16 * 1024 * 1024

# A key is hot when it holds more than this share of the rows, so there are fewer
# than 1 / HOT_SHARE hot keys, however large the data.
HOT_SHARE = 0.002
HOT_MIN_ROWS = 100_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        # The executors of local-cluster are processes of their own.
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sparkscrub-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the planner the
    real size of the table.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/sparkscrub/{label}-{uuid.uuid4().hex}"
    _stored.append((spark.sparkContext.applicationId, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete a stored table, wherever Spark keeps it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


# Tables that this program has stored: application, path.
_stored: list[tuple[str, str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving the tables that were stored within.

    Stored tables hold values found in texts. Results that read them must be written or
    collected before the block ends::

        with scratch(spark):
            scrub(docs, scope=["source"], key=["doc_id"]).write.parquet(out)
    """
    before = len(_stored)
    try:
        yield
    finally:
        application = spark.sparkContext.applicationId
        made, rest = _stored[before:], []
        for owner, path in made:
            if owner == application:
                delete_table(spark, path)
            else:
                rest.append((owner, path))
        _stored[before:] = rest


@contextmanager
def last_stored(spark: SparkSession) -> Iterator[None]:
    """Of the tables that were stored within only the last one stays; nothing else may read the others.

    What was shuffled for them goes, too: Spark lets go of shuffle files once the driver's
    collector has seen that no plan names them, so it is asked to look.
    """
    before = len(_stored)
    yield
    passed = _stored[before:-1]
    for _, path in passed:
        delete_table(spark, path)
    if passed:
        del _stored[before:-1]
    spark._jvm.System.gc()


def fits_broadcast(df: DataFrame, max_rows: int | None = None) -> bool:
    """Does a table stay below the broadcast bounds? Counts rows and bytes of text."""
    max_rows = MAX_BROADCAST_ROWS if max_rows is None else max_rows
    size = F.lit(16 * len(df.columns))
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            size = size + F.coalesce(F.length(F.to_json(field.name)), F.lit(0))
    row = df.select(size.alias("size")).agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    return row["n"] <= max_rows and (row["size"] or 0) <= MAX_BROADCAST_BYTES


def hot_keys(
    df: DataFrame, keys: list[str], share: float = HOT_SHARE, min_rows: int | None = None
) -> DataFrame | None:
    """The keys that hold more than ``share`` of the rows, with the number of salts each needs.

    Counted with map-side aggregation. At most ``1 / share`` rows reach the driver.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = df.count()
    limit = max(HOT_MIN_ROWS if min_rows is None else min_rows, int(total * share))
    if total <= limit:
        return None
    rows = counts.where(F.col("_n") > limit).withColumn("_salts", F.ceil(F.col("_n") / limit).cast("int"))
    rows = rows.drop("_n")
    found = rows.collect()
    return df.sparkSession.createDataFrame(found, rows.schema) if found else None


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    hot: DataFrame | None,
    salt_on: list[str],
    how: str = "inner",
) -> DataFrame:
    """Join on ``keys``, the left rows of hot keys spread over several partitions.

    The right rows of a hot key are copied to each of its salts; other keys join as
    usual. ``how`` must keep left rows (inner, left, left_semi, left_anti).
    """
    if hot is None:
        return left.join(right, keys, how)
    hot = F.broadcast(hot)
    salt = F.pmod(F.xxhash64(*salt_on), F.col("_salts"))
    left = left.join(hot, keys, "left").withColumn("_salt", F.coalesce(salt, F.lit(0)).cast("int"))
    salts = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    right = right.join(hot, keys, "left").withColumn("_salt", F.explode(salts)).drop("_salts")
    return left.drop("_salts").join(right, [*keys, "_salt"], how).drop("_salt")


def join_vocabulary(
    rows: DataFrame, vocabulary: DataFrame, on: list[str], salt_on: list[str], max_rows: int | None = None
) -> DataFrame:
    """Inner join of very many rows (pieces of texts) with a table of distinct entries.

    A small vocabulary is broadcast. A large one is first cut to the entries that occur
    at all (counted with map-side combine, safe for frequent pieces); what remains is
    broadcast if small, else joined, with as many salts for a frequent piece as its count
    asks for, since one piece may occur in a third of all texts.
    """
    if fits_broadcast(vocabulary, max_rows):
        return rows.join(F.broadcast(vocabulary), on)
    counts = rows.groupBy(*on).agg(F.count("*").alias("_n"))
    counted = materialize(vocabulary.join(counts, on), "vocabulary")
    vocabulary = counted.drop("_n")
    if fits_broadcast(vocabulary, max_rows):
        return rows.join(F.broadcast(vocabulary), on)
    sizes = counted.groupBy(*on).agg(F.max("_n").alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    limit = max(HOT_MIN_ROWS, int(total * HOT_SHARE))
    frequent = sizes.where(F.col("_n") > limit).withColumn("_salts", F.ceil(F.col("_n") / limit).cast("int")).drop("_n")
    # At most 1 / HOT_SHARE rows.
    found = frequent.collect()
    hot = rows.sparkSession.createDataFrame(found, frequent.schema) if found else None
    return salted_join(rows, vocabulary, on, hot, salt_on)
