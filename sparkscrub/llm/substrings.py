"""Removal of passages that stand in an earlier document, by difference-cover anchors.

The positions of a difference cover modulo its period have every distance between them,
so two equal passages of ``window`` words share an anchor: a position that is in the
cover in both documents, at the same place of the passage. Only the word n-grams at
cover positions are hashed and grouped. Where an anchor stands in two documents, the
windows around it are hashed whole, grouped again, and give the verdict.

Before anything is shuffled, a task groups what its own batch holds: of equal n-grams
only those of the batch's smallest document travel on, so a passage that stands in a
third of all documents is one row per batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkscrub.llm.common import doc_rows, field_type, map_rows, materialize, same
from sparkscrub.plans.sizing import fits_broadcast

# Perfect difference sets (fixed values): period -> positions.
COVERS = {
    1: (0,),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (3, 6, 7, 12, 14),
    31: (1, 5, 11, 24, 25, 27),
}
REMEMBERED = 500_000
WINDOWS_AT_ONCE = 1_000_000
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MODULUS = 1 << 64


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The period and positions for a window: anchors keep at least a third of its words."""
    period = max(p for p in COVERS if p == 1 or p <= 0.65 * window)
    return period, COVERS[period]


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h
        return h


class Powers:
    """Powers of an odd base and of its inverse modulo 2 ** 64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, _MODULUS)
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (self._grown(b, size) for b in (self.base, self.inverse))

    @staticmethod
    def _grown(base: int, size: int) -> np.ndarray:
        factors = np.full(size + 1, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(hashes: np.ndarray, at: np.ndarray, size: int, powers: Powers) -> np.ndarray:
    """Hashes of the ``size`` words from each position, by prefix sums."""
    powers.need(len(hashes) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers.up[: len(hashes)], dtype=np.uint64)))
    return mixed((sums[at + size] - sums[at]) * powers.down[at])


def _travelling(group: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: is its document larger than the smallest of its group; does the group have two documents."""
    order = np.lexsort((rank, group))
    g, r = group[order], rank[order]
    first = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)
    number = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    low = r[starts]
    high = r[np.append(starts[1:], len(g)) - 1] if len(g) else low
    later, shared = np.empty(len(g), bool), np.empty(len(g), bool)
    later[order] = r > low[number]
    shared[order] = (high > low)[number]
    return later, shared


class _Runs:
    """Runs of equal keys over sorted batches."""

    def __init__(self):
        self.key, self.first = None, None

    def later(self, keys: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
        """Rows whose document is not the first one of their run."""
        change = np.zeros(len(ids), bool)
        change[0] = True
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        firsts = ids[change].copy()
        if tuple(k[0] for k in keys) == self.key:
            firsts[0] = self.first
        out = ids != firsts[np.cumsum(change) - 1]
        self.key, self.first = tuple(k[-1] for k in keys), firsts[-1]
        return out


def _key_values(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _anchor_step(window: int, schema: T.StructType):
    period, cover = cover_for(window)
    size = window - period + 1
    arrow = to_arrow_schema(schema)

    def step(batches):
        known, powers = WordHashes(), Powers(_BASES[0])
        in_cover = np.zeros(period, bool)
        in_cover[list(cover)] = True
        for batch in batches:
            parts = []
            for row, text in enumerate(batch.column(1)):
                words = (text.as_py() or "").encode().split()
                if len(words) < window:
                    continue
                hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                at = np.arange(len(words) - size + 1)
                at = at[in_cover[at % period]]
                parts.append((gram_hashes(hashes, at, size, powers), np.full(len(at), row), at))
            if not parts:
                continue
            h, row, at = (np.concatenate(x) for x in zip(*parts))
            ids = _key_values(batch.column(0))
            rank = np.unique(ids, return_inverse=True)[1]
            later, shared = _travelling(h, rank[row])
            # One block of a period for each anchor that the batch has decided; the others travel.
            block = at // period
            sent = np.flatnonzero(~later)
            done = np.flatnonzero(shared)
            done = done[np.unique(np.stack([row[done], block[done]]), axis=1, return_index=True)[1]] if len(done) else done
            pick = np.concatenate([sent, done])
            kind = np.concatenate([np.zeros(len(sent), np.int8), np.ones(len(done), np.int8)])
            spread = mixed(row[done].astype(np.uint64) * np.uint64(_BASES[1]) + block[done].astype(np.uint64))
            group = np.concatenate([h[sent], spread]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(kind),
                    pa.array(group),
                    batch.column(0).take(pa.array(row[pick])).cast(arrow.field(2).type),
                    pa.array(block[pick].astype(np.int32)),
                ],
                schema=arrow,
            )

    return step


def _shared_step(schema: T.StructType):
    """Of sorted anchors: ``doc_id, block`` of those that stand in two documents."""
    arrow = to_arrow_schema(schema)

    def step(batches):
        # rows of an open run that has shown one document so far
        pending, runs_key, several = None, None, False
        for batch in batches:
            table = pa.Table.from_batches([batch] if pending is None else [pending, batch]).combine_chunks()
            batch = table.to_batches()[0]
            kind, group, ids = (_key_values(batch.column(i)) for i in range(3))
            change = np.zeros(len(kind), bool)
            change[0] = True
            change[1:] = (kind[1:] != kind[:-1]) | (group[1:] != group[:-1])
            begin = np.flatnonzero(change)
            end = np.append(begin[1:], len(kind)) - 1
            two = (ids[begin] != ids[end]) | (kind[begin] == 1)
            if several and (kind[0], group[0]) == runs_key:
                two[0] = True
            runs_key, several = (kind[-1], group[-1]), bool(two[-1])
            rows = np.flatnonzero(two[np.cumsum(change) - 1])
            pending = None if several else batch.slice(int(begin[-1]))
            if len(rows):
                own = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([own.column(2).cast(arrow.field(0).type), own.column(3)], schema=arrow)

    return step


def _window_step(window: int, schema: T.StructType):
    period, _ = cover_for(window)
    arrow = to_arrow_schema(schema)

    def step(batches):
        known, powers = WordHashes(), [Powers(b) for b in _BASES]

        def flush(batch, parts, rank):
            h, c, row, at = (np.concatenate(x) for x in zip(*parts))
            both = mixed(h + c)  # groups within the batch; checked below by the full hash
            later, _ = _travelling(both, rank[row])
            order = np.lexsort((rank[row], both))
            # a group of the mixed hash must be one window: else everything travels
            g = both[order]
            clash = (g[1:] == g[:-1]) & ((h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1]))
            if clash.any():
                later[:] = False
            kind = later.astype(np.int8)
            spread = mixed(row.astype(np.uint64) * np.uint64(_BASES[1]) + at.astype(np.uint64))
            group = np.where(later, spread, h).view(np.int64)
            check = (c >> np.uint64(32)).astype(np.uint32).view(np.int32)
            take = pa.array(row)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(kind),
                    pa.array(group),
                    pa.array(check),
                    batch.column(0).take(take).cast(arrow.field(3).type),
                    batch.column(1).take(take),
                    pa.array(at.astype(np.int32)),
                ],
                schema=arrow,
            )

        for batch in batches:
            ids = _key_values(batch.column(0))
            rank = np.unique(ids, return_inverse=True)[1]
            parts, held = [], 0
            for row, (text, blocks) in enumerate(zip(batch.column(2), batch.column(3))):
                words = (text.as_py() or "").encode().split()
                n = len(words) - window + 1
                if n <= 0:
                    continue
                hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                wanted = np.zeros(n, bool)
                for b in blocks.as_py():
                    # windows that hold an anchor of the block whole
                    wanted[max(0, b * period - period + 1) : b * period + period] = True
                at = np.flatnonzero(wanted)
                h = gram_hashes(hashes, at, window, powers[0])
                c = gram_hashes(hashes ^ (hashes >> np.uint64(17)), at, window, powers[1])
                parts.append((h, c, np.full(len(at), row), at))
                held += len(at)
                if held > WINDOWS_AT_ONCE:
                    yield flush(batch, parts, rank)
                    parts, held = [], 0
            if held:
                yield flush(batch, parts, rank)

    return step


def _later_step(schema: T.StructType):
    """Of sorted windows: ``doc_id, k, at`` of those that stand in a document before."""
    arrow = to_arrow_schema(schema)

    def step(batches):
        runs = _Runs()
        for batch in batches:
            kind, group, check, ids = (_key_values(batch.column(i)) for i in range(4))
            rows = np.flatnonzero(runs.later([kind, group, check], ids) | (kind == 1))
            if len(rows):
                own = batch.take(pa.array(rows))
                columns = [own.column(3).cast(arrow.field(0).type), own.column(4), own.column(5)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return step


def _stretch_step(window: int, schema: T.StructType):
    """Window starts of a document to the stretches that they cover."""
    arrow = to_arrow_schema(schema)

    def step(batches):
        for batch in batches:
            starts, stops = [], []
            for at in batch.column(2):
                at = np.unique(at.values.to_numpy())
                gap = np.flatnonzero(np.diff(at) > window)
                starts.append(at[np.concatenate(([0], gap + 1))])
                stops.append(at[np.append(gap, len(at) - 1)] + window)
            columns = [batch.column(0).cast(arrow.field(0).type), batch.column(1)]
            columns += [pa.array(x, pa.list_(pa.int32())) for x in (starts, stops)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return step


def repeated_stretches(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """``doc_id, k, starts, stops``: the stretches of words that earlier documents hold, for documents that have any.

    ``k`` is a hash of the text; with the key it names a document. Runs several jobs when
    called; what they find is kept in the shared folder.
    """
    docs = doc_rows(df, key, text).dropna()
    kind = field_type(docs, "doc_id")

    def schema(**fields):
        types = {"id": kind, "long": T.LongType(), "int": T.IntegerType(), "byte": T.ByteType()}
        types |= {"ints": T.ArrayType(T.IntegerType())}
        return T.StructType([T.StructField(n, types[t]) for n, t in fields.items()])

    anchors = map_rows(docs, _anchor_step(window, s := schema(kind="byte", g="long", doc_id="id", block="int")), s)
    anchors = anchors.repartition("kind", "g").sortWithinPartitions("kind", "g", "doc_id")
    blocks = map_rows(anchors, _shared_step(s := schema(doc_id="id", block="int")), s)
    blocks = blocks.groupBy("doc_id").agg(F.collect_set("block").alias("blocks"))
    blocks = materialize(blocks, "shared-blocks")
    blocks = F.broadcast(blocks) if fits_broadcast(blocks) else blocks

    own = docs.join(blocks, "doc_id").select("doc_id", F.xxhash64("text").alias("k"), "text", "blocks")
    s = schema(kind="byte", g="long", c="int", doc_id="id", k="long", at="int")
    windows = map_rows(own, _window_step(window, s), s)
    windows = windows.repartition("kind", "g", "c").sortWithinPartitions("kind", "g", "c", "doc_id")
    later = map_rows(windows, _later_step(s := schema(doc_id="id", k="long", at="int")), s)
    per_doc = later.groupBy("doc_id", "k").agg(F.collect_list("at").alias("at"))
    stretches = map_rows(per_doc, _stretch_step(window, s := schema(doc_id="id", k="long", starts="ints", stops="ints")), s)
    return materialize(stretches, "repeated-stretches")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """``key, n_words, n_removed, kept`` for every row.

    A word goes if it lies in ``window`` consecutive words that also stand in a document
    of smaller key. ``kept`` holds the other words, joined by one space. Windows are
    judged on the input.

    Null texts have no words. Rows without a key lose nothing and take nothing from
    others. Repeated rows get the same result; rows with one key and different texts are
    different documents, neither of them smaller. Empty tables give an empty result;
    texts of any length are read whole; other columns are not read.
    """
    stretches = repeated_stretches(df, key, text, window)
    stretches = F.broadcast(stretches) if fits_broadcast(stretches) else stretches
    docs = doc_rows(df, key, text).withColumn("k", F.xxhash64("text"))
    marks = stretches.select(F.col("doc_id").alias("_id"), F.col("k").alias("_k"), "starts", "stops")
    rows = docs.join(marks, (F.col("k") == F.col("_k")) & same(F.col("doc_id"), F.col("_id")), "left")
    schema = T.StructType(
        [
            T.StructField(key, field_type(docs, "doc_id")),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept", T.StringType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def step(batches):
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, starts, stops in zip(*(batch.column(i) for i in (1, 2, 3))):
                words = (text.as_py() or "").encode().split()
                n = len(words)
                for a, b in reversed(list(zip(starts.as_py() or (), stops.as_py() or ()))):
                    del words[a:b]
                counts.append(n)
                removed.append(n - len(words))
                kept.append(b" ".join(words).decode())
            columns = [batch.column(0).cast(arrow.field(0).type), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, arrow.field(3).type)], schema=arrow)

    return map_rows(rows.select("doc_id", "text", "starts", "stops"), step, schema)
