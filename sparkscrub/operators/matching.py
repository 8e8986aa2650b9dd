"""Find which of very many strings occur in which of very many texts.

Literal ``contains`` as an equi-join: each string is looked up by one of its pieces, the
one that the fewest other strings have, and compared in full where that piece stands.
Strings that begin alike, such as links, are so told apart before they are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscrub.plans import bitfilter
from sparkscrub.plans.expand import expand
from sparkscrub.plans.sizing import fits_broadcast, join_vocabulary, last_stored, materialize

# Lengths of the pieces that are looked up: a string uses the longest that it can fill.
# Values that differ in few places, such as phone numbers, need long ones, else a text meets
# all values that agree with one of its own at a piece.
GRAM_LENGTHS = (16, 8, 4, 1)
# Pieces of a string that are weighed against each other.
WEIGHED = 64
# Strings of up to REACH characters with pieces of PLACED at least are compared with what stands
# around such a piece; pieces that are shorter stand in too many places.
PLACED, REACH = 8, 64


def quote_sql(text: str) -> str:
    """A text as a literal pattern: whatever is not a letter or digit gets a backslash."""
    return f"regexp_replace({text}, r'([^\\p{{L}}\\p{{N}}])', r'\\\\$1')"


def _grams_sql(text: str, length: int) -> str:
    """SQL: all substrings of a length, by position; none begins inside a surrogate pair."""
    return f"regexp_extract_all({text}, r'(?s)(?=((?![\\x{{DC00}}-\\x{{DFFF}}]).{{{length}}}))', 1)"


def _mix(scope: list[str]) -> Column:
    """What sets the pieces of scopes apart."""
    return F.xxhash64(F.lit(1), *scope) if scope else F.lit(0).cast("long")


def _anchors(values: DataFrame, scope: list[str], keep: list[str] | None = None) -> DataFrame:
    """Rows ``scope, gram, value, keep``: the rarest piece of each value.

    Pieces are counted by their hashes, so values and pieces do not move with them. A value
    that has a piece of its own takes the first such; only the others weigh the counts of theirs.
    """
    rest = [*scope, "value", *(keep or [])]
    values = values.select(*rest)
    shared = materialize(bitfilter.piece_counts(values, "value", _mix(scope), GRAM_LENGTHS, WEIGHED), "shared-pieces")
    found = bitfilter.bit_filter(shared.select("h"), shared.count())
    found = materialize(bitfilter.own_pieces(values, "value", _mix(scope), GRAM_LENGTHS, WEIGHED, found), "own-pieces")
    alone = found.where(F.col("gram").isNotNull()).select(*scope, "gram", *rest[len(scope) :])
    return alone.unionByName(_weighed_anchors(found.where(F.col("gram").isNull()).drop("gram"), shared, scope, rest))


def _weighed_anchors(values: DataFrame, shared: DataFrame, scope: list[str], rest: list[str]) -> DataFrame:
    """The anchors of values whose pieces are all shared: each the one with the smallest count."""
    whens = " ".join(f"WHEN length(value) >= {q} THEN {_grams_sql('value', q)}" for q in GRAM_LENGTHS)
    # Of long values the first and the last pieces.
    some = f"IF(size(p) > {WEIGHED}, concat(slice(p, 1, {WEIGHED // 2}), slice(p, -{WEIGHED // 2}, {WEIGHED // 2})), p)"
    pieces = f"transform(array(CASE {whens} END), p -> {some})[0]"
    grams = expand(values, rest, F.posexplode_outer(F.expr(pieces)).alias("offset", "gram"), "gram")
    hashed = bitfilter.with_piece_hashes(grams, "gram", _mix(scope))
    # Null for a piece that only the filter takes for a shared one.
    best = hashed.join(shared, "h", "left").groupBy(*rest)
    best = best.agg(F.min(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "offset", "gram")).alias("best"))
    return best.select(*scope, "best.gram", *rest[len(scope) :])


def find_values(
    texts: DataFrame,
    values: DataFrame,
    scope: list[str],
    key: list[str],
    text: str = "text",
    max_broadcast_rows: int | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Rows ``scope, key, value``: the value of the scope occurs in the text.

    ``values`` has distinct ``scope..., value`` and other columns, of which those in ``keep``
    come with the value. Empty values occur nowhere. Runs jobs
    when called: the looked-up pieces are stored and counted. The pieces of texts that
    pass a filter of them are joined with them: at once, next to their text, if they can be
    broadcast, so that no text moves; else with as much of the text around them as a value
    takes. Very short and long values are looked up by themselves; if they
    are too many to be broadcast, the texts follow that share a piece with them.
    """
    rest = ["value", *(keep or [])]
    values = values.select(*scope, *rest).where("value <> ''")
    spark = values.sparkSession
    with last_stored(spark):
        anchors = materialize(_anchors(values, scope, keep), "anchors")
    placed = f"length(gram) >= {PLACED} AND length(value) <= {REACH}"
    sizes = anchors.groupBy(F.expr(placed).alias("placed"), F.expr("length(gram)").alias("q"))
    sizes = sizes.agg(F.max(F.length("value")).alias("longest")).collect()
    texts = texts.select(*scope, *key, F.col(text).alias("_text"))
    if not sizes:
        return texts.select(*scope, *key, *(F.lit(None).cast(values.schema[c].dataType).alias(c) for c in rest)).where("false")
    if fits_broadcast(anchors, max_broadcast_rows):
        return _next_to_texts(texts, anchors, scope, key, rest, sorted({r["q"] for r in sizes})).distinct()

    some, found = [r for r in sizes if r["placed"]], []
    if some:
        own = anchors.where(placed)
        with last_stored(spark):
            pieces = _pieces(texts, own, scope, key, [r["q"] for r in some], max(r["longest"] for r in some))
            near = join_vocabulary(materialize(pieces, "pieces"), own, [*scope, "gram"], key, max_broadcast_rows)
            near = near.where("exists(around, a -> contains(a, value))").select(*scope, *key, *rest)
            found.append(materialize(near, "found-pieces"))
    if others := sorted({r["q"] for r in sizes if not r["placed"]}):
        own = anchors.where(f"NOT ({placed})")
        by = _next_to_texts if fits_broadcast(own, max_broadcast_rows) else _with_texts
        found.append(by(texts, own, scope, key, rest, others))
    return found[0].unionByName(found[1]) if found[1:] else found[0]


def _next_to_texts(texts, anchors, scope, key, rest, lengths) -> DataFrame:
    """Pieces are joined where the texts are."""
    near = _pieces(texts, anchors, scope, [*key, "_text"], lengths).join(F.broadcast(anchors), [*scope, "gram"])
    return near.where("contains(_text, value)").select(*scope, *key, *rest)


def _with_texts(texts, anchors, scope, key, rest, lengths) -> DataFrame:
    """Pieces are joined by themselves, and only texts that hold one follow."""
    with last_stored(texts.sparkSession):
        pieces = materialize(_pieces(texts, anchors, scope, key, lengths), "pieces")
        near = join_vocabulary(pieces, anchors, [*scope, "gram"], key)
        pairs = materialize(near.select(*scope, *key, *rest).distinct(), "found-pieces")
    row = F.xxhash64(F.lit(0), *scope, *key)
    holds = bitfilter.bit_filter(pairs.select(row), pairs.count())
    pairs = pairs.join(bitfilter.rows_in(texts, row, holds), [*scope, *key])
    return pairs.where("contains(_text, value)").select(*scope, *key, *rest)


def _pieces(
    texts: DataFrame, anchors: DataFrame, scope: list[str], key: list[str], lengths: list[int], reach: int = 0
) -> DataFrame:
    """Rows ``scope, key, gram``: the pieces of each text that may be looked up in its scope.

    A filter of fixed size is tested where the texts are read, so about as many rows are
    moved as there are hits.
    """
    looked_up = anchors.select(*scope, "gram").distinct()
    members = bitfilter.bit_filter(bitfilter.hashed_pieces(looked_up, "gram", _mix(scope)), looked_up.count())
    return bitfilter.pieces_in(texts, "_text", [*scope, *key], _mix(scope), lengths, members, reach=reach)
