"""Benchmark decontamination by winnowing.

Of every ``span`` consecutive words the k-gram of smallest hash is kept, so two texts
that share such a span share a kept k-gram. The kept k-grams of documents are joined
with those of the benchmark, and each hit is extended word by word on both sides.
Items shorter than a span are one window each: all their word n-grams are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from sparkscrub.llm.common import doc_rows, field_type, map_rows, map_texts, materialize, same
from sparkscrub.plans.sizing import fits_broadcast

# Lower-cases A-Z; ASCII that is neither letter nor digit becomes a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
# Bits of the filter of benchmark hashes that every task gets, whatever the benchmark's size.
FILTER_BITS = 1 << 26
REMEMBERED = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)

HITS = T.ArrayType(
    T.StructType(
        [
            T.StructField("h", T.LongType()),
            T.StructField("size", T.IntegerType()),  # words of the k-gram
            T.StructField("at", T.IntegerType()),  # its first word
            T.StructField("start", T.IntegerType()),  # first word of the surroundings
            T.StructField("words", T.StringType()),  # the surroundings
        ]
    )
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h
        return h


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A mixed 64-bit hash of every ``size`` consecutive words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(size))
    for i in range(size):
        out = out * _BASE + hashes[i : i + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the smallest hash (the last of equals) of some window."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, where = grams[:n].copy(), np.arange(n)
    for i in range(1, window):
        own = grams[i : i + n]
        smaller = own <= best
        best[smaller] = own[smaller]
        where[smaller] = np.flatnonzero(smaller) + i
    return np.unique(where)


def kept_grams(hashes: np.ndarray, span: int, k: int, short: tuple[int, ...]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(size, positions, hashes) of the kept k-grams, and of all n-grams of the short sizes."""
    grams = gram_hashes(hashes, k)
    at = winnowed(grams, span - k + 1)
    out = [(k, at, grams[at])]
    for size in short:
        grams = gram_hashes(hashes, size)
        # another hash than that of a kept k-gram of the same size
        out.append((-size, np.arange(len(grams)), grams ^ np.uint64(1)))
    return out


def _reader(span: int, k: int, short, members: tuple[np.ndarray, np.ndarray] | None):
    """Reads texts into word counts and hits; ``members``: the filter's non-zero words, None lets all pass."""

    def make():
        known = WordHashes()
        bits = None
        if members is not None:
            bits = np.zeros(FILTER_BITS // 64, np.uint64)
            bits[members[0]] = members[1].view(np.uint64)

        def one(text):
            words = words_of(text)
            if not words:
                return 0, []
            hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            sizes = short if short is not None else ((len(words),) if len(words) < span else ())
            hits = []
            for size, at, h in kept_grams(hashes, span, k, sizes):
                if bits is not None and len(h):
                    slot = h & np.uint64(FILTER_BITS - 1)
                    passed = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
                    at, h = at[passed > 0], h[passed > 0]
                around = span - k if size > 0 else 0
                for p, x in zip(at.tolist(), h.view(np.int64).tolist()):
                    start = max(0, p - around)
                    own = b" ".join(words[start : p + abs(size) + around]).decode("utf-8")
                    hits.append({"h": x, "size": size, "at": p, "start": start, "words": own})
            return len(words), hits

        return lambda texts: [one(t) for t in texts]

    return make


def _filter_words(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The set bits of the benchmark's hashes, at most FILTER_BITS / 64 words."""
    slot = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = (
        items.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast(h & 63 AS int))").alias("b"))
        .groupBy("w")
        .agg(F.expr("bit_or(b)").alias("b"))
        .toPandas()
    )
    return words["w"].to_numpy(np.int64), words["b"].to_numpy(np.int64)


def _extend(span: int):
    """Hits to runs: words of the document that equal the item's around the common k-gram."""

    def run(size, at, start, words, item_at, item_start, item_words):
        own, other = words.split(" "), item_words.split(" ")
        p, q, n = at - start, item_at - item_start, abs(size)
        if own[p : p + n] != other[q : q + n]:
            return None
        left = 0
        while left < min(p, q) and own[p - left - 1] == other[q - left - 1]:
            left += 1
        right = 0
        while right < min(len(own) - p, len(other) - q) - n and own[p + n + right] == other[q + n + right]:
            right += 1
        if size > 0 and left + n + right < span:
            return None
        return at - left, at + n + right

    return run


def benchmark_hits(
    df: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    span: int = 10,
    k: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``doc_id, k, n_words`` of every row, and the runs ``doc_id, k, item, start, stop``.

    ``k`` is a hash of the text; with the key it names a document. A run is a stretch of
    at least ``span`` words of a document (or a whole shorter item) that stands in the
    item; ``stop`` is exclusive. Runs several jobs when called.
    """
    items = doc_rows(benchmark, item_key, item_text).where("text is not null")
    hits = map_texts(items, _reader(span, k, None, None), [("n_words", T.LongType()), ("hits", HITS)])
    hits = materialize(
        hits.select(F.col("doc_id").alias("item"), F.explode("hits").alias("x")).select(
            "item", *(F.col(f"x.{n}").alias(n if n in ("h", "size") else f"item_{n}") for n in HITS.elementType.names)
        ),
        "benchmark-grams",
    )
    members = _filter_words(hits)
    short = tuple(sorted(-r["size"] for r in hits.where("size < 0").select("size").distinct().collect()))

    docs = doc_rows(df, key, text).withColumn("k", F.xxhash64("text"))
    fields = [("n_words", T.LongType()), ("hits", HITS)]
    read = materialize(map_texts(docs, _reader(span, k, short, members), fields, keep=("k",)), "document-grams")

    found = read.where(F.size("hits") > 0).select("doc_id", "k", F.explode("hits").alias("x")).select("doc_id", "k", "x.*")
    grams = F.broadcast(hits) if fits_broadcast(hits) else hits
    pairs = found.join(grams, ["h", "size"]).drop("h").select(
        "doc_id", "k", "item", "size", "at", "start", "words", "item_at", "item_start", "item_words"
    )
    schema = T.StructType(
        [
            T.StructField("doc_id", field_type(read, "doc_id")),
            T.StructField("k", T.LongType()),
            T.StructField("item", field_type(hits, "item")),
            T.StructField("start", T.IntegerType()),
            T.StructField("stop", T.IntegerType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def step(batches):
        run = _extend(span)
        for batch in batches:
            rows = [run(*r) for r in zip(*(batch.column(i).to_pylist() for i in range(3, 10)))]
            kept = batch.filter(pa.array([r is not None for r in rows], pa.bool_()))
            rows = [r for r in rows if r is not None]
            out = [kept.column(i).cast(arrow.field(i).type) for i in range(3)]
            out += [pa.array([r[i] for r in rows], pa.int32()) for i in range(2)]
            yield pa.RecordBatch.from_arrays(out, schema=arrow)

    return read.select("doc_id", "k", "n_words"), map_rows(pairs, step, schema).distinct()


def contamination(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``key, n_words, n_hit, n_items, items_sha256, contaminated`` for every row.

    ``n_hit``: words inside occurrences of an item's windows (``span`` consecutive words,
    or the whole of a shorter item). ``n_items``: items with such windows; their ids as
    strings, sorted and comma-joined, are hashed. Options as in ``benchmark_hits``.

    Null and empty texts have no words and no hits. Repeated rows each get a result; rows
    with one key and different texts are different documents. Items without text never
    hit; an item without id counts as hit words, but not as an item. Empty tables give
    empty or unhit results. Other columns are not read.
    """
    read, runs = benchmark_hits(df, benchmark, key=key, **options)
    runs = materialize(runs, "benchmark-runs")
    ordered = Window.partitionBy("doc_id", "k").orderBy("start", "stop")
    before = F.max("stop").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    stretches = runs.select("doc_id", "k", "start", "stop").distinct().withColumn("before", before)
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce("before", F.lit(0))))
    words = stretches.groupBy("doc_id", "k").agg(F.sum(new).cast("long").alias("n_hit"))
    ids = F.sort_array(F.collect_set(F.col("item").cast("string")))
    items = runs.groupBy("doc_id", "k").agg(ids.alias("ids"))

    def on(right, name):
        return right.select(F.col("doc_id").alias(f"{name}_id"), F.col("k").alias(f"{name}_k"), *right.columns[2:])

    words, items = on(words, "w"), on(items, "i")
    out = read.join(words, same(F.col("doc_id"), F.col("w_id")) & (F.col("k") == F.col("w_k")), "left")
    out = out.join(items, same(F.col("doc_id"), F.col("i_id")) & (F.col("k") == F.col("i_k")), "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        F.col("doc_id").alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def without_contaminated(
    df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """The rows of ``df`` that hold no window of a benchmark item; all columns stay. Options as in ``benchmark_hits``."""
    _, runs = benchmark_hits(df, benchmark, key=key, text=text, **options)
    hit = materialize(runs.select(F.col("doc_id").alias("_id"), F.col("k").alias("_k")).distinct(), "contaminated")
    hit = F.broadcast(hit) if fits_broadcast(hit) else hit
    found = (F.xxhash64(F.col(f"`{text}`")) == F.col("_k")) & same(F.col(f"`{key}`"), F.col("_id"))
    return df.join(hit, found, "left_anti")
