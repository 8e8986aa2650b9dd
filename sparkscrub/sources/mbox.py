"""Mailboxes (mbox): very many messages in files of any size.

Spark's own text reader splits the files by byte ranges, a message being what stands
between two ``From `` lines, so one large mailbox is read by many tasks, from any store
that Spark reads, once or as a stream. Bytes are kept as they are. What cannot be parsed is a
row with a status; it never fails the task that reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscrub.sources.mailbox import parse_messages

# A message begins after this; in messages such lines are written with a ``>`` in front.
SEPARATOR = "\nFrom "
# One character for each byte.
BYTES = "ISO-8859-1"


def _unquoted(body: Column) -> Column:
    return F.regexp_replace(body, r"(?m)^>(>*From )", "$1")


def _quoted(body: Column) -> Column:
    return F.regexp_replace(body, r"(?m)^(>*From )", ">$1")


def _messages(records: DataFrame) -> DataFrame:
    """Rows ``path, envelope, content``; a record is the rest of the ``From `` line and the message."""
    # The reader hands on bytes as they are; one character for each of them can be matched.
    # Only the first record of a file still has its own ``From ``.
    record = F.regexp_replace(F.decode(F.col("value").cast("binary"), BYTES), r"^\n*From ", "")
    line = F.regexp_extract("record", r"^([^\r\n]*)", 1)
    body = F.regexp_replace("record", r"^[^\r\n]*(?:\r?\n|$)", "")
    rows = records.withColumn("record", record).where(F.expr(r"record RLIKE r'[^\r\n]'"))
    rows = rows.select("file", line.alias("envelope"), _unquoted(F.regexp_replace(body, r"[\r\n]+\z", "")).alias("body"))
    content = F.encode("body", BYTES)
    # Copies of a message in one file share a name.
    path = F.concat("file", F.lit("#"), F.substring(F.sha2(F.concat(F.encode("envelope", BYTES), content), 256), 1, 16))
    return rows.select(path.alias("path"), "envelope", content.alias("content"))


def read_mbox(spark: SparkSession, path: str, glob: str = "*", stream: bool = False) -> DataFrame:
    """Rows ``path, envelope, content`` of the messages in the mailboxes of a folder, or of one file.

    ``envelope`` is what follows ``From `` in the line before a message, ``content`` its bytes,
    without line ends at its end. ``path`` names the file and the message. Give the rows to
    ``parse_messages``; with ``stream`` they are those of files as they land. Files without
    a message give no row.
    """
    reader = spark.readStream if stream else spark.read
    records = reader.format("text").option("lineSep", SEPARATOR)
    records = records.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return _messages(records.select("value", F.col("_metadata.file_path").alias("file")))


def read_mbox_messages(spark: SparkSession, path: str, glob: str = "*", stream: bool = False) -> DataFrame:
    """The messages of mailboxes, parsed: ``path, status, headers, parts``."""
    return parse_messages(read_mbox(spark, path, glob, stream).select("path", "content"))


def write_mbox(messages: DataFrame, path: str, envelope: str = "envelope", content: str = "content", **options: str) -> None:
    """Write rows ``envelope, content`` (bytes) as mailboxes, one file for each partition."""
    body = _quoted(F.regexp_replace(F.decode(content, BYTES), r"[\r\n]+\z", ""))
    line = F.regexp_replace(F.coalesce(F.col(envelope), F.lit("-")), r"[\r\n]+", " ")
    record = F.concat(F.encode(F.concat(F.lit("From "), line, F.lit("\n"), body, F.lit("\n")), BYTES)).cast("string")
    messages.select(record.alias("value")).write.options(**options).text(path)
