"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position carries a vector of radius + 1 bits. A table keeps the positions
whose vector has an odd product with the table's own vector. However up to ``radius``
differing bits lie, some table's vector is orthogonal to all of theirs, so the two
fingerprints look the same in that table: no pair within the radius is missed.

Only distinct fingerprints are compared. A bucket with very many of them is split by a
second covering over the bits that the first table ignores, so that no bucket can hold
more than the fingerprints of the few bits that are left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkscrub.llm.common import doc_rows, map_rows, map_texts, materialize, same
from sparkscrub.llm.components import connected_components

# Distinct fingerprints in a bucket before it is split; more are compared in one task.
MAX_BUCKET = 4096
BITS = 64
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str, shingle: int) -> int:
    """The 64-bit SimHash of a text, 0 without words."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    clean = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    n = max(1, len(words) - shingle + 1)
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, _SHINGLES_AT_ONCE):
        few = zip(starts[k : min(n, k + _SHINGLES_AT_ONCE)], stops[k : k + _SHINGLES_AT_ONCE])
        h = np.array([digest(clean[i:j], 42) for i, j in few], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Bit masks over ``positions`` of which some mask avoids any ``radius`` of them."""
    size = 2 ** (radius + 1)
    masks = []
    for table in range(1, size):
        mask = 0
        for i, position in enumerate(positions):
            if (table & (i % (size - 1) + 1)).bit_count() % 2:
                mask |= 1 << position
        masks.append(mask)
    return masks


def split_masks(mask: int, radius: int) -> list[int]:
    """The masks that split a bucket of ``mask``: it and a covering of the bits it ignores."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | m for m in covering_masks(free, radius)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def bucket_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within a bucket of distinct fingerprints: a forest, not all pairs."""
    links = []
    waiting = fps
    while len(waiting):
        frontier, waiting = [waiting[0]], waiting[1:]
        while frontier and len(waiting):
            x = frontier.pop()
            near = np.bitwise_count(waiting ^ x) <= radius
            if near.any():
                found = waiting[near]
                links += [(int(x), int(y)) for y in found]
                frontier += list(found)
                waiting = waiting[~near]
    return links


def fingerprint_links(fps: DataFrame, radius: int, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) that connect all pairs within the radius."""

    def bucketed(df, masks):
        tables = [
            F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in masks
        ]
        return df.select("fp", F.explode(F.array(*tables)).alias("x")).select("x.t", "x.k", "fp")

    masks = covering_masks(list(range(BITS)), radius)
    first = bucketed(fps, list(enumerate(masks)))
    hot = first.groupBy("t", "k").count().where(F.col("count") > max_bucket).select("t", "k")
    hot = materialize(hot, "hot-buckets")
    rows = first
    if not hot.isEmpty():
        # Few tables, so one branch for each; each bucket is split on its own.
        split = first.join(hot, ["t", "k"], "left_semi")
        parts = [bucketed(split.where(F.col("t") == t), _numbered(t, m, radius)) for t, m in enumerate(masks)]
        rows = first.join(hot, ["t", "k"], "left_anti")
        for part in parts:
            rows = rows.union(part)
    rows = rows.repartition("t", "k").sortWithinPartitions("t", "k")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    arrow = to_arrow_schema(schema)

    def step(batches):
        rest = np.zeros((3, 0), np.int64)
        for batch in _and_end(batches):
            if batch is not None:
                own = np.stack([np.asarray(c.cast(pa.int64())) for c in batch.columns])
                rest = np.concatenate([rest, own], axis=1)
            links, rest = _links_of_runs(rest, radius, batch is None)
            if len(links):
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], schema=arrow)

    return map_rows(rows, step, schema).distinct()


def _numbered(table: int, mask: int, radius: int) -> list[tuple[int, int]]:
    own = split_masks(mask, radius)
    return [((table + 1) * len(own) + i, m) for i, m in enumerate(own)]


def _and_end(batches):
    yield from batches
    yield None


def _links_of_runs(rows: np.ndarray, radius: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links within the complete runs of equal (t, k); the run that may go on is handed back."""
    t, k, fp = rows
    none = np.zeros((0, 2), np.int64)
    if not len(t):
        return none, rows
    starts = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (k[1:] != k[:-1]))))
    end = len(t) if last else starts[-1]
    starts = starts[starts < end]
    sizes = np.diff(starts, append=end)
    two = starts[sizes == 2]
    near = np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= radius
    links = [np.stack([fp[two[near]], fp[two[near] + 1]], axis=1)]
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        own = bucket_links(fp[s : s + n].view(np.uint64), radius)
        if own:
            links.append(np.array(own, np.uint64).view(np.int64))
    return np.concatenate(links) if links else none, rows[:, end:]


def _fingerprints(df: DataFrame, key: str, text: str, shingle: int, keep: tuple[str, ...] = ()) -> DataFrame:
    def make():
        return lambda texts: [(_signed(fingerprint(t, shingle)),) for t in texts]

    return materialize(map_texts(df, make, [("fp", T.LongType())], key, text, keep), "fingerprints")


def _with_components(distinct: DataFrame, radius: int) -> DataFrame:
    """Rows of distinct fingerprints with ``component``, the smallest fingerprint that links reach."""
    parts = connected_components(fingerprint_links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    return distinct.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def simhash_components(
    df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """``key, fingerprint, component_id`` for every row.

    Texts are linked when their fingerprints differ in at most ``radius`` bits; the
    component id is the smallest key that links reach, the row's own included.

    Runs several jobs when called; fingerprints and links are kept in the shared folder.
    A null or empty text has fingerprint 0 and is linked like any other. Repeated rows
    stay rows of one component. Rows without a key take part; a component without any
    key has no id. An empty table gives an empty result.
    """
    docs = _fingerprints(df, key, text, shingle)
    named = _with_components(docs.groupBy("fp").agg(F.min(key).alias("first")), radius)
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = materialize(named.join(smallest, "component").select("fp", "component_id"), "components")
    return docs.join(ids, "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(df: DataFrame, components: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose key is the id of its component; of repeated rows one stays.

    Only for tables where every row has a key and no two texts share one: the key is
    all that ``components`` tells of a row. ``without_near_copies`` has no such limit.
    """
    kept = components.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("_kept")).distinct()
    return df.join(kept, F.col(key).eqNullSafe(F.col("_kept")), "left_semi").dropDuplicates([key])


def without_near_copies(
    df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """One row of each component of near copies: smallest key (null last), then smallest text hash.

    A row is named by its key and the hash of its text, so a component keeps its row
    also where keys are null or stand with several texts. Of repeated rows (same key,
    same text) one stays. All columns are handed on; an empty table gives an empty result.
    """
    docs = _fingerprints(doc_rows(df, key, text).withColumn("k", F.xxhash64("text")), "doc_id", "text", shingle, ("k",))
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k")
    named = _with_components(docs.groupBy("fp").agg(F.min(row).alias("first")), radius)
    kept = named.groupBy("component").agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.doc_id").alias("_id"), F.col("first.k").alias("_k"))
    # Names by position, so that no column can clash.
    names = [f"c{n}" for n in range(len(df.columns))]
    own, words = (F.col(names[df.columns.index(c)]) for c in (key, text))
    rows = df.toDF(*names).withColumn("k", F.xxhash64(words)).withColumn("id", own)
    rows = rows.join(kept, (F.col("k") == F.col("_k")) & same(F.col("id"), F.col("_id")), "left_semi")
    return rows.dropDuplicates(["id", "k"]).select(*names).toDF(*df.columns)
