"""Masking as a continuous job: rows and files are masked as they land.

Here each row stands alone, so the stream holds no state and needs no watermark; a failed
run starts again from the stream checkpoint. ``streaming.scopes`` masks per scope.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sparkscrub.operators.scrub import scrub
from sparkscrub.sources.tables import without_originals


def read_text_stream(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", **options: str
) -> DataFrame:
    """A folder of files as a stream of rows."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def scrub_stream(
    stream: DataFrame,
    text: str = "text",
    entities: Iterable[str] | None = None,
    terms: dict | None = None,
    kind: str | None = None,
    output: str = "masked",
) -> DataFrame:
    """Add the masked text to a stream; the same expressions as in a batch."""
    if not stream.isStreaming:
        raise ValueError("not a stream; use scrub")
    if isinstance(terms, DataFrame):
        raise ValueError("a stream takes terms as a dict of short lists")
    return scrub(stream, text, entities=entities, terms=terms, kind=kind, output=output)


def write_masked_stream(
    masked: DataFrame,
    path: str,
    checkpoint: str,
    fmt: str = "parquet",
    drop: list[str] | None = None,
    available_now: bool = False,
    interval: str = "1 minute",
    keep: list[str] | None = None,
) -> StreamingQuery:
    """Start writing a masked stream: the columns in ``keep``, or all but those in ``drop``."""
    writer = without_originals(masked, keep, drop).writeStream.format(fmt).outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start(path)
