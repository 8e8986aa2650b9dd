"""A trie of conversations by time-forward processing.

A node is a distinct sequence of first turns. It is named by its smallest conversation and
its depth, so a conversation owns a run of nodes, and the parent of a node is one level up
in the same conversation or in a smaller one. Shards are ranges of (conversation, depth),
so a long conversation or a common opening is divided like anything else.

Within a shard the nodes come sorted in reverse level order; a node sends what its subtree
holds to its parent through a priority queue, which spills to disk. What is sent to nodes of
other shards is added up there: shard roots point to the nodes that they send to, those to
the ones that their own shard root sends to, and the totals move along these pointers,
twice as far in each round. A second pass over the shards adds them in.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkscrub.llm.common import map_rows, materialize

# Messages that a queue holds in memory, rows of a batch that leaves a step.
QUEUE = 200_000
BATCH = 20_000
# Conversation ids that are handed on as one text.
CHUNK = 50_000

_EMPTY = hashlib.sha256(b"").hexdigest()
_PLACE = ["part", "turn", "role", "tie", "x", "y", "id"]
_KEY = ["k1", "k2", "depth"]


# --- turns ------------------------------------------------------------------------------


def turn_digests(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One small row for each turn: its place, two hashes of role and text, its words.

    Null roles and texts are empty; rows without a conversation belong to none and are
    left out. Turns come by number (null first), then role, then the first characters of
    the text, then its hash; repeated rows are turns of their own. Stored, since ``id``
    must stay the same.
    """
    rows = df.select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    rows = rows.where("conv_id IS NOT NULL").select(
        "conv_id",
        F.lit(1).alias("part"),
        "turn",
        "role",
        F.left("text", F.lit(32)).alias("tie"),
        F.xxhash64("role", "text").alias("x"),
        F.xxhash64(F.lit(1), "text", "role").alias("y"),
        F.monotonically_increasing_id().alias("id"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    )
    return materialize(rows, "turns")


def _order(columns: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in columns]


def share_openings(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns in which each conversation opens like the first one of its family; and all conversations.

    Conversation c takes the first h turns of c - c % family (fewer, if it has fewer) in place
    of its own first h; h is the CRC-32 of c in decimal modulo ``most``.
    """
    window = Window.partitionBy("conv_id").orderBy(*_order(_PLACE))
    first = turns.withColumn("j", F.row_number().over(window)).where(F.col("j") < most)
    h = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most
    first = materialize(first.withColumn("h", h.cast("int")), "openings")
    convs = first.where("j = 1").select("conv_id", "h")
    heads = first.select(F.col("conv_id").alias("head"), "j", "role", "tie", "x", "y", "id", "words")
    taken = convs.withColumn("head", F.expr(f"conv_id - conv_id % {family}")).join(heads, "head").where("j <= h")
    taken = taken.select(
        "conv_id", F.lit(0).alias("part"), F.col("j").cast(turns.schema["turn"].dataType).alias("turn"),
        "role", "tie", "x", "y", "id", "words",
    )
    own = turns.join(first.where("j <= h").select("id"), "id", "left_anti")
    return taken.unionByName(own), convs.select("conv_id")


def _prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, k1, k2, p1, p2, words, last``: every first d turns with its key and its parent's.

    A key joins the hashes of the turns, each mixed with its place. Turns are sorted over
    the cluster and numbered range by range; what a conversation has in ranges before is
    added, which takes a few rows for each range.
    """
    spark = turns.sparkSession
    order = _order(["conv_id", *_PLACE])
    rows = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select(F.monotonically_increasing_id().alias("at"), "conv_id", "x", "y", "words")
    rows = materialize(rows, "sorted-turns").withColumn("p", F.shiftright("at", 33))

    ranges = rows.groupBy("p").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high")).orderBy("p").collect()
    cut = sorted({a["high"] for a, b in zip(ranges, ranges[1:]) if a["high"] == b["low"]})
    whole = Window.partitionBy("p", "conv_id").orderBy("at")
    rows = rows.withColumn("depth", F.row_number().over(whole))
    if cut:
        pieces = rows.where(F.col("conv_id").isin(cut)).groupBy("conv_id", "p").count().orderBy("conv_id", "p").collect()
        before, seen = [], {}
        for r in pieces:
            before.append((r["conv_id"], r["p"], seen.get(r["conv_id"], 0)))
            seen[r["conv_id"]] = before[-1][2] + r["count"]
        before = [(*b, seen[b[0]]) for b in before]
        pieces = spark.createDataFrame(before, "conv_id long, p long, before long, turns long")
        rows = rows.join(F.broadcast(pieces), ["conv_id", "p"], "left")
        rows = rows.withColumn("depth", F.col("depth") + F.coalesce("before", F.lit(0)))
        last = F.when(F.col("turns").isNull(), F.lead("at").over(whole).isNull()).otherwise(
            F.col("depth") == F.col("turns")
        )
    else:
        last = F.lead("at").over(whole).isNull()
    rows = rows.select(
        "p", "at", "conv_id", F.col("depth").cast("long").alias("depth"), "words", last.alias("last"),
        F.xxhash64("depth", "x").alias("m1"), F.xxhash64("depth", "y").alias("m2"),
    )
    until = whole.rowsBetween(Window.unboundedPreceding, 0)
    keys = rows.select("*", *(F.bit_xor(f"m{i}").over(until).alias(f"k{i}") for i in (1, 2)))
    if cut:
        sums = rows.where(F.col("conv_id").isin(cut)).groupBy("conv_id", "p").agg(
            F.bit_xor("m1").alias("m1"), F.bit_xor("m2").alias("m2")
        )
        carried, seen = [], {}
        for r in sums.orderBy("conv_id", "p").collect():
            a, b = seen.get(r["conv_id"], (0, 0))
            carried.append((r["conv_id"], r["p"], a, b))
            seen[r["conv_id"]] = a ^ r["m1"], b ^ r["m2"]
        carried = spark.createDataFrame(carried, "conv_id long, p long, c1 long, c2 long")
        keys = keys.join(F.broadcast(carried), ["conv_id", "p"], "left")
        keys = keys.withColumns({f"k{i}": F.expr(f"k{i} ^ coalesce(c{i}, 0)") for i in (1, 2)})
    keys = keys.select("conv_id", "depth", "k1", "k2", F.expr("k1 ^ m1").alias("p1"), F.expr("k2 ^ m2").alias("p2"), "words", "last")
    return materialize(keys, "prefixes")


# --- conversations that end at a node -----------------------------------------------------

_PIECES = T.StructType(
    [
        T.StructField("k1", T.LongType()),
        T.StructField("k2", T.LongType()),
        T.StructField("depth", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("sha", T.StringType()),
        T.StructField("first", T.LongType()),
        T.StructField("ids", T.StringType()),
    ]
)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _records(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def _hash_ids(batches):
    """Sorted ``k1, k2, depth, conv_id`` to a hash per key; ids of the first and of the last key of a
    range, which may go on in others, and very many ids are handed on as texts."""

    def rows():
        waits, first = None, True
        for key, group in itertools.groupby(_records(batches), lambda r: r[:3]):
            if waits:
                own, ids = waits
                yield (*own, len(ids), hashlib.sha256(_joined(ids).encode()).hexdigest(), None, None)
            ids, divided = [], first
            for *_, conv in group:
                if len(ids) >= CHUNK:
                    yield (*key, len(ids), None, ids[0], _joined(ids))
                    ids, divided = [], True
                ids.append(conv)
            if divided:
                yield (*key, len(ids), None, ids[0], _joined(ids))
            waits, first = None if divided else (key, ids), False
        if waits:
            own, ids = waits
            yield (*own, len(ids), None, ids[0], _joined(ids))

    yield from _batches(rows(), to_arrow_schema(_PIECES))


def _hash_texts(batches):
    """Pieces of ids, sorted by key and first id, to a hash per key."""

    def rows():
        for key, group in itertools.groupby(_records(batches), lambda r: r[:3]):
            state, n = hashlib.sha256(), 0
            for *_, count, _, _, ids in group:
                state.update(("," if n else "").encode() + ids.encode())
                n += count
            yield (*key, n, state.hexdigest(), None, None)

    yield from _batches(rows(), to_arrow_schema(_PIECES))


def _ends(ends: DataFrame) -> DataFrame:
    """``k1, k2, depth, n_ends, ends`` of the nodes at which conversations end (``k1, k2, depth, conv_id``)."""
    own = ends.select(*_KEY, "conv_id").repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    pieces = materialize(map_rows(own, _hash_ids, _PIECES), "ends")
    rest = pieces.where("sha IS NULL").repartition(*_KEY).sortWithinPartitions(*_KEY, "first")
    done = pieces.where("sha IS NOT NULL").union(map_rows(rest, _hash_texts, _PIECES))
    return done.select(*_KEY, F.col("n").alias("n_ends"), F.col("sha").alias("ends"))


# --- nodes ------------------------------------------------------------------------------


def _nodes(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, depth, parent, n_convs, saved, leaf, ends`` of each node, not summed up yet."""
    found = prefixes.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        *(F.any_value(c).alias(c) for c in ("p1", "p2", "words")),
    )
    ended = prefixes.where("last")
    silent = convs.join(ended.select("conv_id"), "conv_id", "left_anti")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(
        *(F.lit(0).cast("long").alias(c) for c in _KEY), "conv_id", "n_convs",
        *(F.lit(None).cast("long").alias(c) for c in ("p1", "p2")), F.lit(0).alias("words"),
    )
    nowhere = silent.select(*(F.lit(0).cast("long").alias(c) for c in _KEY), "conv_id")
    ends = _ends(ended.select(*_KEY, "conv_id").union(nowhere))
    found = materialize(found.unionByName(root), "nodes")
    # Each node is one row here, but one parent may be that of a third of them: the join is
    # one that Spark splits where a key is frequent.
    parents = found.select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent")
    )
    rows = found.join(parents, ["p1", "p2", "depth"], "left").join(ends, _KEY, "left")
    return rows.select(
        "conv_id", "depth", "parent", "n_convs",
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        (F.coalesce("n_ends", F.lit(0)) == F.col("n_convs")).cast("long").alias("leaf"),
        F.coalesce("ends", F.lit(_EMPTY)).alias("ends"),
    )


class Messages:
    """A priority queue of (key, value) that keeps its smallest part in memory and the rest in sorted runs.

    Runs are unnamed files of the task, gone when it ends.
    """

    def __init__(self, limit: int | None = None):
        self.limit = QUEUE if limit is None else limit
        self.heap: list = []
        self.heads: list = []
        self.runs: list = []

    def push(self, key: tuple, value: tuple) -> None:
        heapq.heappush(self.heap, (key, value))
        if len(self.heap) > self.limit:
            run = tempfile.TemporaryFile()
            for item in sorted(self.heap):
                pickle.dump(item, run)
            run.seek(0)
            self.runs.append(run)
            self.heap = []
            self._advance(len(self.runs) - 1)

    def _advance(self, run: int) -> None:
        try:
            heapq.heappush(self.heads, (pickle.load(self.runs[run]), run))
        except EOFError:
            self.runs[run].close()

    def until(self, key: tuple | None) -> Iterator[tuple]:
        """Take out what is not larger than a key, smallest first; None: all."""
        while self.heap or self.heads:
            spilled = bool(self.heads) and (not self.heap or self.heads[0][0] < self.heap[0])
            least = self.heads[0][0] if spilled else self.heap[0]
            if key is not None and least[0] > key:
                return
            if spilled:
                self._advance(heapq.heappop(self.heads)[1])
            else:
                heapq.heappop(self.heap)
            yield least


_SUMS = ("leaves", "saved", "children")
_PASS = T.StructType(
    [
        *(T.StructField(c, T.LongType()) for c in ("shard", "conv_id", "depth", "parent", "n_convs", "saved", "leaf")),
        T.StructField("ends", T.StringType()),
        # Of a shard root's subtree, sent to a node of another shard.
        *(T.StructField(f"sent_{c}", T.LongType()) for c in _SUMS),
        *(T.StructField(c, T.LongType()) for c in ("to_conv", "to_depth")),
        # A conversation's part in this shard hangs on a node of another one.
        T.StructField("hangs", T.BooleanType()),
    ]
)


def _within_shard(batches):
    """First pass over a shard in reverse level order: its nodes, what leaves it, where its parts hang."""
    shard = TaskContext.get().partitionId()

    def rows():
        queue, tops = Messages(), {}

        def leave(key, value):
            level, conv = key
            return (shard, *[None] * 7, *value, conv, -level, None)

        for conv, depth, parent, n_convs, saved, leaf, ends in _records(batches):
            total = [leaf, saved]
            for key, value in queue.until((-depth, conv)):
                if key == (-depth, conv):
                    total[0] += value[0]
                    total[1] += value[1]
                else:
                    yield leave(key, value)
            # The last one seen of a conversation is its uppermost here.
            tops[conv] = depth, parent
            yield (shard, conv, depth, parent, n_convs, saved, leaf, ends, *[None] * 5, None)
            if parent is not None:
                queue.push((1 - depth, parent), (*total, 1))
        for key, value in queue.until(None):
            yield leave(key, value)
        # Parents are smaller, so they are known before.
        out: dict = {}
        smallest = min(tops, default=None)
        for conv in sorted(tops):
            depth, parent = tops[conv]
            here = parent in tops and (parent != smallest or depth > tops[parent][0]) and parent != conv
            out[conv] = None if parent is None else out[parent] if here else (parent, depth - 1)
            if out[conv]:
                yield (shard, conv, *[None] * 9, *out[conv], True)

    yield from _batches(rows(), to_arrow_schema(_PASS))


_NODES = T.StructType(
    [
        *(T.StructField(c, T.LongType()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children")),
        *(T.StructField(c, T.LongType()) for c in ("n_leaves", "saved_tokens")),
        T.StructField("ends_sha256", T.StringType()),
    ]
)


def _with_messages(batches):
    """Second pass: shards in reverse level order, with what nodes got from other shards."""

    def rows():
        shard, queue = None, Messages()
        for own, conv, depth, parent, n_convs, saved, leaf, ends, *more, direct in _records(batches):
            if own != shard:
                shard, queue = own, Messages()
            leaves, saved, children = leaf + more[0], saved + more[1], direct
            for key, value in queue.until((-depth, conv)):
                if key == (-depth, conv):
                    leaves += value[0]
                    saved += value[1]
                    children += 1
            if parent is not None:
                queue.push((1 - depth, parent), (leaves, saved))
            yield (conv, depth, parent, n_convs, children, leaves, saved, ends)

    yield from _batches(rows(), to_arrow_schema(_NODES))


def _across_shards(passed: DataFrame) -> DataFrame | None:
    """``conv_id, depth, leaves, saved, children``: what nodes get from other shards, in all; None: nothing."""
    sums = [F.sum(f"sent_{c}").alias(c) for c in _SUMS]
    sent = passed.where("conv_id IS NULL").groupBy(F.col("to_conv").alias("conv_id"), F.col("to_depth").alias("depth"))
    sent = materialize(sent.agg(*sums), "shard-messages")
    if sent.isEmpty():
        return None
    places = passed.where("depth IS NOT NULL").select("conv_id", "depth", "shard")
    hangs = passed.where("hangs").select("shard", "conv_id", "to_conv", "to_depth")
    state = sent.join(places, ["conv_id", "depth"]).join(hangs, ["shard", "conv_id"], "left").drop("shard")
    state = materialize(state, "shard-roots")
    while not state.where("to_conv IS NOT NULL").isEmpty():
        moved = state.where("to_conv IS NOT NULL").groupBy("to_conv", "to_depth").agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        moved = moved.withColumnsRenamed({"to_conv": "conv_id", "to_depth": "depth"})
        further = state.select(
            F.col("conv_id").alias("to_conv"), F.col("depth").alias("to_depth"),
            F.col("to_conv").alias("next_conv"), F.col("to_depth").alias("next_depth"),
        )
        state = state.join(moved, ["conv_id", "depth"], "left").join(further, ["to_conv", "to_depth"], "left")
        state = state.select(
            "conv_id", "depth",
            *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")), "children",
            F.col("next_conv").alias("to_conv"), F.col("next_depth").alias("to_depth"),
        )
        state = materialize(state, "shard-roots")
    return state.select("conv_id", "depth", *_SUMS)


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None, shards: int | None = None) -> DataFrame:
    """The nodes of the trie of conversations, one row each.

    ``turns`` is a table of ``turn_digests`` (or of ``share_openings``), ``convs`` all
    conversations, those without a turn included. Columns: ``conv_id`` (smallest member),
    ``depth, parent_conv_id`` (null for the root), ``n_convs`` (members), ``n_children,
    n_leaves`` (nodes without children in the subtree, itself included), ``saved_tokens``
    (over the subtree, the words of each node's turn times its members but one) and
    ``ends_sha256`` (the ids of the members that end here, ascending, joined by commas).

    An empty table has no nodes. ``shards`` is the number of ranges that nodes are dealt
    to; by default Spark chooses it by their size. Runs jobs when called; what they find
    is kept in the shared folder.
    """
    convs = turns.select("conv_id").distinct() if convs is None else convs
    nodes = _nodes(_prefixes(turns), convs)
    # A row for each distinct (conv_id, depth), so ranges come out even.
    ranged = nodes.repartitionByRange(*([shards] if shards else []), "conv_id", "depth")
    ranged = ranged.sortWithinPartitions(F.desc("depth"), "conv_id")
    passed = materialize(map_rows(ranged, _within_shard, _PASS), "shards")
    got = _across_shards(passed)
    own = passed.where("depth IS NOT NULL").select(
        "shard", "conv_id", "depth", "parent", "n_convs", F.col("saved").alias("own"), "leaf", "ends"
    )
    if got is None:
        rows = own.withColumns({c: F.lit(0).cast("long") for c in _SUMS})
    else:
        rows = own.join(got, ["conv_id", "depth"], "left")
        rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in _SUMS})
    rows = rows.select("shard", "conv_id", "depth", "parent", "n_convs", "own", "leaf", "ends", *_SUMS)
    rows = rows.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "conv_id")
    return map_rows(rows, _with_messages, _NODES)
