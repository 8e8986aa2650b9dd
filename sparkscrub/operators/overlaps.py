"""Overlaps of very many spans of one text, in n log n.

Few spans are folded in the projection, as ``functions.spans`` and ``functions.mask`` do, which
takes the square of their number. Where a text has more, its spans go to a Python worker
and meet an ordered set of those accepted before, each only its neighbours. The result
is the same.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import sparkscrub
from sparkscrub.catalog import RANK
from sparkscrub.functions.mask import mask_spans_sql
from sparkscrub.functions.spans import rank_sql, resolve_overlaps_sql
from sparkscrub.functions.sqltext import column, name
from sparkscrub.plans.shipping import ship_package

# Spans of a text that are folded in place.
DIRECT = 200
# Ranges that a block of an ordered set holds at most.
BLOCK = 512
# Spans of a batch whose results are held at once; those of one text always are.
HELD = 1_000_000


class OrderedRanges:
    """Ranges by their start, none within another; a block is split when it is full."""

    def __init__(self):
        self.blocks: list[list[tuple[int, int]]] = []
        self.firsts: list[int] = []

    def before(self, position: int) -> tuple[tuple[int, int] | None, tuple[int, int] | None]:
        """The last range that starts at or before a position, and the one after it."""
        b = bisect_right(self.firsts, position) - 1
        if b < 0:
            return None, self.blocks[0][0] if self.blocks else None
        block = self.blocks[b]
        i = bisect_right(block, (position, float("inf"))) - 1
        after = block[i + 1] if i + 1 < len(block) else self.blocks[b + 1][0] if b + 1 < len(self.blocks) else None
        return block[i], after

    def add(self, start: int, end: int) -> None:
        if not self.blocks:
            self.blocks, self.firsts = [[(start, end)]], [start]
            return
        b = max(0, bisect_right(self.firsts, start) - 1)
        block = self.blocks[b]
        block.insert(bisect_right(block, (start, end)), (start, end))
        self.firsts[b] = block[0][0]
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks[b : b + 1] = [block[:half], block[half:]]
            self.firsts[b : b + 1] = [block[0][0], block[half][0]]

    def __iter__(self) -> Iterator[tuple[int, int]]:
        for block in self.blocks:
            yield from block


def _order(span: dict) -> tuple[int, int, int, int]:
    """Longest first, then by place and rank of the type."""
    start, end = span["start"], span["end"]
    return start - end, start, end, RANK.get(span["entity_type"], 0)


def accepted(spans: list[dict], threshold: float = 0.5) -> list[dict]:
    """Spans longest first (then by place, rank, type, value), without those that share more than
    ``threshold`` of their length with one before.

    What is accepted is as long at least, so none lies within another, and only the
    neighbours of a span can share the most with it.
    """
    ordered = sorted(spans, key=lambda s: (*_order(s), s["entity_type"] or "", s["value"] or ""))
    return [ordered[i] for i in accepted_ranges([s["start"] for s in ordered], [s["end"] for s in ordered], threshold)]


def accepted_ranges(starts: list[int], ends: list[int], threshold: float = 0.5) -> list[int]:
    """As ``accepted``, of ranges in order: the numbers of those that stay."""
    held, out = OrderedRanges(), []
    for i, (start, end) in enumerate(zip(starts, ends)):
        # Empty spans overlap nothing, and no part is more than the whole.
        if start < end and threshold < 1:
            left, right = held.before(start)
            shared = max(
                min(end, left[1]) - start if left else 0,
                min(end, right[1]) - right[0] if right else 0,
            )
            if shared > 0 and shared > threshold * (end - start):
                continue
            held.add(start, end)
        out.append(i)
    return out


def disjoint(spans: list[dict]) -> list[tuple[int, int, str]]:
    """``start, end, entity_type`` by place: of spans that share characters the longer (then the
    earlier) keeps its range, the other is cut to what is left of it."""
    ordered = sorted(spans, key=lambda s: (*_order(s), s["entity_type"] or ""))
    held, out = OrderedRanges(), []
    for span in ordered:
        start, end = span["start"], span["end"]
        while start < end and (left := held.before(start)[0]) and left[1] > start:
            start = left[1]
        while start < end and (right := held.before(end - 1)[0]) and right[1] >= end and right[0] < end:
            end = right[0]
        if start < end:
            held.add(start, end)
            out.append((start, end, span["entity_type"]))
    return sorted(out)


def masked_at(text: str, spans: list[dict]) -> str:
    """The text with its spans replaced by position."""
    out, at = [], 0
    for start, end, kind in disjoint(spans):
        out += (text[at:start], f"<{kind}>")
        at = end
    return "".join([*out, text[at:]])


def _in_parts(sizes: Iterator[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold a bounded number of elements together; a longer row goes alone."""
    first, held, row = 0, 0, -1
    for row, size in enumerate(sizes):
        if row > first and held + size > HELD:
            yield first, row
            first, held = row, 0
        held += size
    if row >= first:
        yield first, row + 1


def _sorter(threshold: float):
    """Of ranges in order (two arrays) the numbers of those that stay; a batch may hold very many, so
    one row's are Python objects at a time."""

    @F.arrow_udf("array<int>")
    def resolve(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for starts, ends in batches:
            sizes = (len(x) if x.is_valid else 0 for x in starts)
            for first, last in _in_parts(sizes):
                kept = []
                for row in range(first, last):
                    a, b = starts[row], ends[row]
                    found = accepted_ranges(a.as_py(), b.as_py(), threshold) if a.is_valid else None
                    kept.append(None if found is None else np.array(found, np.int32))
                yield pa.array(kept, pa.list_(pa.int32()))

    return resolve


def _masker():
    @F.arrow_udf("string")
    def mask(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            for first, last in _in_parts(len(x) if x.is_valid else 0 for x in spans):
                made = []
                for row in range(first, last):
                    both = texts[row].is_valid and spans[row].is_valid
                    made.append(masked_at(texts[row].as_py(), spans[row].as_py()) if both else None)
                yield pa.array(made, pa.string())

    return mask


def _ordered_sql(spans: str) -> str:
    """The order of ``accepted``: ``start, end`` and the place in the array."""
    x, i = name("x"), name("i")
    return (
        f"array_sort(transform({spans}, ({x}, {i}) -> struct({x}.start - {x}.end AS n, {x}.start AS start, {x}.end AS end, "
        f"coalesce({rank_sql(x + '.entity_type')}, 0) AS rank, coalesce({x}.entity_type, '') AS entity_type, "
        f"coalesce({x}.value, '') AS value, {i} AS i)))"
    )


def resolve_spans(df: DataFrame, spans: str = "spans", threshold: float = 0.5, direct: int = DIRECT) -> DataFrame:
    """``df`` with the spans that survive overlap resolution, longest first.

    The same as ``resolve_overlaps``, in n log n for texts with more than ``direct`` spans;
    only the ranges of their spans leave the JVM.
    """
    ship_package(df.sparkSession, sparkscrub)
    own = column(df, spans)
    many = F.expr(f"size({own}) > {direct}")
    few = F.when(~many, F.expr(resolve_overlaps_sql(own, threshold)))
    x = name("x")
    places = F.expr(f"transform(_ordered, {x} -> {x}.i)")
    rows = df.withColumn("_ordered", F.when(many, F.expr(_ordered_sql(own))))
    rows = rows.withColumn("_places", places).withColumn("_kept", _sorter(threshold)(F.col("_ordered.start"), F.col("_ordered.end")))
    sorted_out = F.expr(f"transform(_kept, {x} -> {own}[_places[{x}]])")
    return rows.withColumn(spans, F.when(many, sorted_out).otherwise(few)).drop("_ordered", "_places", "_kept")


def mask_spans_of(
    df: DataFrame, text: str = "text", spans: str = "spans", output: str = "masked", direct: int = DIRECT
) -> DataFrame:
    """Add ``output``: the text with its spans replaced by position.

    The same as ``mask_spans``, in n log n for texts with more than ``direct`` spans; only
    these and their spans leave the JVM.
    """
    ship_package(df.sparkSession, sparkscrub)
    own, found = column(df, text), column(df, spans)
    many = F.expr(f"size({found}) > {direct}")
    few = F.when(~many, F.expr(mask_spans_sql(own, found)))
    x = name("x")
    placed = F.expr(f"transform({found}, {x} -> struct({x}.start, {x}.end, {x}.entity_type))")
    spliced = _masker()(F.when(many, F.expr(own)), F.when(many, placed))
    return df.withColumn(output, F.when(many, spliced).otherwise(few))
