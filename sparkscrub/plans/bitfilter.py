"""Fixed-size filters: a set of bits that every member of a table passes and few others do.

Tested where rows are read, so that only what may meet a member is moved. A filter is made by
``bit_or`` over the cluster and comes to the driver in at most ``MAX_BITS / 64`` words, 64 MB,
whatever the size of the table; with more members it lets more pass, never fewer. A member
sets two bits, one for each half of its hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

import sparkscrub
from sparkscrub.plans.shipping import ship_package

MIN_BITS, MAX_BITS = 1 << 16, 1 << 29
# Bits for each member, where there is room.
BITS_EACH = 16
# Characters that are hashed at once.
CHUNK_CHARS = 1_000_000

_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


def bits_for(members: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (max(1, members) * BITS_EACH - 1).bit_length()))


class BitFilter:
    """Hashes that may be members; one for each worker process travels as a broadcast."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = np.uint64(len(words) * 64 - 1)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        passed = self._set(hashes)
        some = np.flatnonzero(passed)
        passed[some] = self._set(hashes[some] >> np.uint64(32))
        return passed

    def _set(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes & self.mask
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def bit_filter(hashes: DataFrame, members: int) -> BitFilter:
    """The filter of a table with one column of 64-bit hashes."""
    bits = bits_for(members)
    h = F.col(hashes.columns[0])
    hashes = hashes.select(F.explode(F.array(h, F.shiftrightunsigned(h, 32))).alias("h"))
    h = F.col("h")
    slot = h.bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    rows = hashes.select(F.shiftright(slot, 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    found = rows.toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found["w"].to_numpy()] = found["b"].to_numpy().astype(np.int64).view(np.uint64)
    return BitFilter(words)


def rows_in(df: DataFrame, hashed: Column, members: BitFilter) -> DataFrame:
    """The rows whose hash may be a member."""
    spark, arrow = df.sparkSession, to_arrow_schema(df.schema)
    own = _sent(spark, members)

    def step(batches):
        for batch in batches:
            passed = own.value.passes(_unsigned(batch.column(batch.num_columns - 1)))
            kept = batch.filter(pa.array(passed))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], schema=arrow)

    return df.select("*", hashed.alias("_h")).mapInArrow(step, df.schema)


def _sent(spark: SparkSession, members: BitFilter):
    ship_package(spark, sparkscrub)
    return spark.sparkContext.broadcast(members)


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _power(size: int) -> np.uint64:
    return np.uint64(pow(_BASE, size, 1 << 64))


def piece_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every piece of so many characters, by position."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # Hashes of twice the length are made of two; the length is put together from powers of two.
    out, built = np.full(n, np.uint64(length)), 0
    part, size = codes, 1
    while True:
        if length & size:
            out = out * _power(size) + part[built : built + n]
            built += size
        if built == length:
            break
        part = part[:-size] * _power(size) + part[size:]
        size *= 2
    out ^= out >> np.uint64(29)
    out *= _MIX
    return out ^ (out >> np.uint64(32))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Texts of bounded total length, with the number of the first one; a longer one goes alone."""
    start, held, size = 0, [], 0
    for n, text in enumerate(texts):
        if held and size + len(text) > CHUNK_CHARS:
            yield start, held
            start, held, size = n, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield start, held


def with_piece_hashes(df: DataFrame, piece: str, mix: Column) -> DataFrame:
    """A column ``h`` more: the hash that a piece has in ``pieces_in``; ``mix`` sets pieces of scopes apart."""
    ship_package(df.sparkSession, sparkscrub)
    schema = T.StructType([*df.schema, T.StructField("h", T.LongType())])
    arrow, at = to_arrow_schema(schema), df.columns.index(piece)

    def step(batches):
        for batch in batches:
            pieces = batch.column(at).to_pylist()
            h = _unsigned(batch.column(batch.num_columns - 1)).copy()
            sizes = np.array([len(p) for p in pieces])
            for size in set(sizes.tolist()):
                rows = np.flatnonzero(sizes == size)
                h[rows] ^= piece_hashes(_codes("".join(pieces[i] for i in rows)), size)[::size]
            columns = [c.cast(arrow.field(i).type) for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(h.view(np.int64))], schema=arrow)

    return df.select("*", mix.alias("_mix")).mapInArrow(step, schema)


def hashed_pieces(pieces: DataFrame, piece: str, mix: Column) -> DataFrame:
    """Rows ``h``: the hashes of pieces."""
    return with_piece_hashes(pieces.select("*"), piece, mix).select("h")


def pieces_in(
    df: DataFrame,
    text: str,
    keep: list[str],
    mix: Column,
    lengths: list[int],
    members: BitFilter,
    piece: str = "gram",
    reach: int = 0,
) -> DataFrame:
    """Rows ``keep, piece``: the distinct pieces of each text that may be members.

    Texts are read in Arrow batches and hashed at all positions at once. What leaves the step is
    one row for each text that has such pieces, so kept columns can be long. Null texts have no pieces.
    With ``reach`` there is a column ``around``: for each piece the stretches of the text that a string
    of up to so many characters takes which holds the piece where it stands.
    """
    own = _sent(df.sparkSession, members)
    rows = df.select(*keep, mix.alias("_mix"), text).where(F.col(text).isNotNull())
    kind = T.StructType([T.StructField(piece, T.StringType()), T.StructField("around", T.ArrayType(T.StringType()))])
    kind = T.ArrayType(kind if reach else T.StringType())
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField(piece, kind)])
    arrow = to_arrow_schema(schema)

    def step(batches):
        for batch in batches:
            mixes = _unsigned(batch.column(len(keep)))
            for start, texts in _chunks(batch.column(len(keep) + 1).to_pylist()):
                where, found = _found(texts, mixes[start : start + len(texts)], lengths, own.value, reach)
                if reach:
                    found = [[{piece: p, "around": around} for p, around in hits] for hits in found]
                taken = pa.array(np.array(where, np.int64) + start)
                columns = [batch.column(i).take(taken) for i in range(len(keep))]
                columns = [c.cast(arrow.field(i).type) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, arrow.field(len(keep)).type)], schema=arrow)

    found = rows.mapInArrow(step, schema)
    return found.select(*keep, F.inline(piece)) if reach else found.withColumn(piece, F.explode(piece))


def _found(texts: list[str], mixes: np.ndarray, lengths: list[int], members: BitFilter, reach: int = 0) -> tuple[list[int], list[list]]:
    """Numbers of texts that have pieces that pass, and their distinct pieces, with ``reach`` and what is around them."""
    joined = "".join(texts)
    codes = _codes(joined)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(texts)), sizes)
    mixed = mixes[row]
    hits: dict[int, dict[str, list[list[int]]]] = {}
    for length in lengths:
        hashes = piece_hashes(codes, length)
        own = np.flatnonzero(members.passes(hashes ^ mixed[: len(hashes)]))
        # Pieces that run over the end of a text are none.
        at = own[own + length <= ends[row[own]]]
        rows = row[at]
        begins = np.maximum(ends[rows] - sizes[rows], at - max(0, reach - length))
        stops = np.minimum(ends[rows], at + max(reach, length))
        for r, p, begin, stop in zip(rows.tolist(), at.tolist(), begins.tolist(), stops.tolist()):
            places = hits.setdefault(r, {}).setdefault(joined[p : p + length], [])
            # Stretches that touch become one, so that they are no longer than the text.
            if places and begin <= places[-1][1]:
                places[-1][1] = stop
            else:
                places.append([begin, stop])
    if reach:
        return list(hits), [[(p, [joined[b:e] for b, e in places]) for p, places in pieces.items()] for pieces in hits.values()]
    return list(hits), [list(pieces) for pieces in hits.values()]


def _pieces_of(texts: list[str], mixes: np.ndarray, lengths: tuple[int, ...], most: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """For the texts of each length: their numbers, the length of their pieces, where these stand and a row of
    hashes for each text; of texts with more than ``most`` pieces the first and the last ones."""
    sizes = np.array([len(t) for t in texts], np.int64)
    for size in set(sizes.tolist()) - {0}:
        numbers = np.flatnonzero(sizes == size)
        length = next(q for q in lengths if q <= size)
        hashes = piece_hashes(_codes("".join(texts[i] for i in numbers)), length)
        n = size - length + 1
        offsets = np.arange(n) if n <= most else np.r_[: most // 2, n - most // 2 : n]
        at = np.arange(len(numbers))[:, None] * size + offsets[None, :]
        yield numbers, length, offsets, hashes[at] ^ mixes[numbers][:, None]


def piece_counts(values: DataFrame, value: str, mix: Column, lengths: tuple[int, ...], most: int) -> DataFrame:
    """Rows ``h, n``: the hashes of pieces that stand in more than one value, or twice in one. A value has pieces
    of the longest of ``lengths`` that it can fill."""
    ship_package(values.sparkSession, sparkscrub)

    def step(batches):
        for batch in batches:
            mixes = _unsigned(batch.column(1))
            for start, texts in _chunks(batch.column(0).to_pylist()):
                found = [h.ravel() for *_, h in _pieces_of(texts, mixes[start : start + len(texts)], lengths, most)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

    counts = values.select(value, mix.alias("mix")).mapInArrow(step, "h long").groupBy("h").agg(F.count("*").alias("n"))
    return counts.where("n > 1")


def own_pieces(
    values: DataFrame, value: str, mix: Column, lengths: tuple[int, ...], most: int, shared: BitFilter, piece: str = "gram"
) -> DataFrame:
    """``values`` with a piece that no other value has; null where all of its pieces may be ``shared``."""
    own = _sent(values.sparkSession, shared)
    schema = T.StructType([*values.schema, T.StructField(piece, T.StringType())])
    arrow = to_arrow_schema(schema)
    at = values.columns.index(value)

    def step(batches):
        for batch in batches:
            texts, mixes = batch.column(at).to_pylist(), _unsigned(batch.column(batch.num_columns - 1))
            found: list[str | None] = [None] * len(texts)
            for start, some in _chunks(texts):
                for numbers, length, offsets, hashes in _pieces_of(some, mixes[start : start + len(some)], lengths, most):
                    alone = ~own.value.passes(hashes.ravel()).reshape(hashes.shape)
                    first = offsets[alone.argmax(axis=1)]
                    for i, o, any_alone in zip(numbers.tolist(), first.tolist(), alone.any(axis=1).tolist()):
                        if any_alone:
                            found[start + i] = some[i][o : o + length]
            columns = [c.cast(arrow.field(i).type) for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string())], schema=arrow)

    return values.select("*", mix.alias("_mix")).mapInArrow(step, schema)
