"""What the operators share: Python steps over texts, stored tables, row keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

import sparkscrub
from sparkscrub.plans.shipping import ship_package
from sparkscrub.plans.sizing import materialize

__all__ = ["doc_rows", "field_type", "map_rows", "map_texts", "materialize", "same", "sha256_of_words"]

# Characters handed to a worker function at once; a longer text goes alone.
CHUNK_CHARS = 4_000_000


def field_type(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def doc_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_id, text`` and nothing else, so that other columns cannot clash."""
    return df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def map_rows(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType):
    """One Python pass over Arrow batches; the workers get the package first."""
    ship_package(df.sparkSession, sparkscrub)
    return df.mapInArrow(step, schema)


def in_chunks(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Lists of texts of bounded total length, null as empty."""
    chunk, size = [], 0
    for text in texts:
        text = text or ""
        if chunk and size + len(text) > CHUNK_CHARS:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text)
    if chunk:
        yield chunk


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], list[tuple]]],
    fields: list[tuple[str, T.DataType]],
    key: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One output row per input row: the key, kept columns, and what ``make()`` computes from the text.

    ``make`` runs once per task and returns a function from a list of texts to a list
    of tuples. Only the key, the kept columns and the text leave the JVM.
    """
    names = [key, *keep]
    schema = T.StructType(
        [T.StructField(n, field_type(df, n)) for n in names] + [T.StructField(n, t) for n, t in fields]
    )
    arrow = to_arrow_schema(schema)
    own = [arrow.field(n).type for n, _ in fields]

    def step(batches):
        compute = make()
        for batch in batches:
            start = 0
            # A batch for each chunk, so that few results are held at once.
            for chunk in in_chunks(x.as_py() for x in batch.column(len(names))):
                made = [pa.array(list(c), t) for c, t in zip(zip(*compute(chunk)), own)]
                kept = [batch.column(i).slice(start, len(chunk)).cast(arrow.field(i).type) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(kept + made, schema=arrow)
                start += len(chunk)

    return map_rows(df.select(*(F.col(f"`{n}`") for n in names), F.col(f"`{text}`")), step, schema)


def sha256_of_words(words: Column) -> Column:
    return F.sha2(F.array_join(words, " "), 256)
