"""Fuzzy line dedup by MinHash, in DataFrame operations only.

A line is signed by its character shingles: those that start at characters of a fixed
class, and its first one, so similar lines sign with the same ones. The smallest hashes
are the line's sketch; what is smallest in the sketch under different masks forms bands.
Lines that share a band are compared by the exact Jaccard similarity of all their
shingles; links are joined to components, of which the first line stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscrub.llm.common import doc_rows, materialize, same
from sparkscrub.llm.components import connected_components
from sparkscrub.plans.sizing import fits_broadcast

# Characters that begin a signing shingle: code points divisible by 8 below U+0080 that can
# be printed, and all above.
_STARTS = r"[ 08@HPX`hpx\x80-\x{10FFFF}]"
_MASK = (1 << 64) - 1


def _mask(i: int) -> int:
    """A fixed 64-bit number for each i (splitmix)."""
    z = (i + 1) * 0x9E3779B97F4A7C15 & _MASK
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    z = (z ^ z >> 27) * 0x94D049BB133111EB & _MASK
    z ^= z >> 31
    return z - (1 << 64) if z >> 63 else z


def _hashed(pieces: str) -> str:
    return f"transform({pieces}, s -> xxhash64(s))"


def all_shingles(line: str, size: int) -> str:
    """SQL: the distinct hashes of all shingles; a line that is too short is one shingle."""
    found = rf"regexp_extract_all({line}, '(?s)(?=(.{{{size}}}))', 1)"
    return f"array_distinct({_hashed(f'IF(length({line}) < {size}, array({line}), {found})')})"


def band_hashes(line: str, size: int, bands: int, rows: int, sketch: int) -> str:
    """SQL: an array with the hash of each band of a line.

    A band has a mask; it holds the ``rows`` hashes of the sketch that are smallest
    under the mask, which agree for two lines as often as ``rows`` minima do.
    """
    pattern = f"(?s)(?=({_STARTS}.{{{size - 1}}}))".replace("\\", "\\\\")
    found = f"concat(array(left({line}, {size})), regexp_extract_all({line}, '{pattern}', 1))"
    smallest = f"slice(sort_array(array_distinct({_hashed(found)})), 1, {sketch})"
    own = ", ".join(
        f"xxhash64({b}, slice(sort_array(transform(k, x -> x ^ {_literal(_mask(b))})), 1, {rows}))"
        for b in range(bands)
    )
    # The one-element array names the sketch, so that it is computed once.
    return f"transform(array({smallest}), k -> array({own}))[0]"


def _literal(x: int) -> str:
    return f"({x}L)" if x > -(1 << 63) else "(-9223372036854775807L - 1L)"


def line_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, k, at, line, h, g`` of every line that is not blank; h and g are hashes of the trimmed line."""
    lines = docs.select("doc_id", "k", F.posexplode_outer(F.split("text", "\n")).alias("at", "raw"))
    lines = lines.select("doc_id", "k", "at", F.expr(r"btrim(raw, ' \t\r\f\u000B')").alias("line")).where("line <> ''")
    return lines.withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64("line", F.lit(1)))


def _similarities(pairs: DataFrame, lines: DataFrame, shingle: int, similarity: float | None = None) -> DataFrame:
    """``a, b, j``: exact Jaccard similarities of pairs of distinct lines.

    With ``similarity`` also what tells which other lines of a common ``a`` may be similar to b:
    ``size``, the shingles of b; ``fresh``, how many a does not have; ``lead``, all of these and, if
    they are fewer than a larger partner could all miss, the first others up to that number.
    """
    pairs = materialize(pairs, "line-pairs")
    wanted = pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).distinct()
    wanted = materialize(wanted, "paired-lines")
    wanted = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    texts = lines.join(wanted, "h", "left_semi").groupBy("h").agg(F.min("line").alias("line"))
    texts = materialize(texts, "paired-texts")
    one, other = (texts.select(F.col("h").alias(n), F.col("line").alias(f"line_{n}")) for n in "ab")
    rows = pairs.join(one, "a").join(other, "b")
    rows = rows.select("a", "b", *(F.expr(all_shingles(f"line_{n}", shingle)).alias(f"s_{n}") for n in "ab"))
    rows = rows.withColumn("both", F.size(F.array_intersect("s_a", "s_b")))
    j = F.col("both") / (F.size("s_a") + F.size("s_b") - F.col("both"))
    more = []
    if similarity is not None:
        lead = "concat(sort_array(array_except(s_b, s_a)), sort_array(array_intersect(s_b, s_a)))"
        lead = F.expr(f"slice({lead}, 1, greatest({_lead('size(s_b)', similarity)}, size(s_b) - both))")
        more = [F.size("s_b").alias("size"), (F.size("s_b") - F.col("both")).alias("fresh"), lead.alias("lead")]
    return materialize(rows.select("a", "b", j.alias("j"), *more), "line-similarities")


def _lead(size: str, share: float) -> str:
    """SQL: so many shingles of a line that a partner with this share of them has one, whatever their order."""
    return f"cast({size} - ceil({share!r}D * {size} - 1e-9D) + 1 AS int)"


def _candidates(members: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: pairs of ``first, h, part, j, size, fresh, lead`` with one ``first`` that can be similar.

    Similar lines share many shingles, so one of them is among the first ones of both in
    any common order; the smaller line needs fewer, since its partner is no smaller. What is not
    in the line all were compared with comes first, and of that what the fewest lines have:
    copies that were changed in ways of their own, or with words that many others have too,
    begin with what is theirs alone, so they do not meet.
    """
    own = ["first", "h", "part", "j", "size", "fresh"]
    rows = members.select(*own, F.posexplode("lead").alias("at", "g"))
    new = rows.where("at < fresh")
    held = new.groupBy("first", "g").agg(F.count("*").alias("n"), (F.min("part") < F.max("part")).alias("met"))
    ranked = F.sort_array(F.collect_list(F.struct("n", "g", "met"))).alias("lead")
    new = new.join(held, ["first", "g"]).groupBy(*own).agg(ranked)
    new = new.select(*own, F.posexplode(F.expr(f"slice(lead, 1, {_lead('size', similarity)})")).alias("at", "lead"))
    # What only lines of one component have keeps its place in the order, but joins nothing.
    new = new.where("lead.met").select(*own, "at", "lead.g")
    rows = materialize(new.union(rows.where("at >= fresh")), "line-leads")
    both = 2 * similarity / (1 + similarity)
    x, y = (rows.select("first", "g", *(F.col(c).alias(f"{c}_{n}") for c in rows.columns[1:7])) for n in "xy")
    x = x.where(F.expr(f"at_x < {_lead('size_x', both)}"))
    pairs = x.join(y, ["first", "g"]).where("part_x <> part_y AND (size_x < size_y OR size_x = size_y AND h_x < h_y)")
    pairs = pairs.where(F.col("size_x") >= similarity * F.col("size_y") - 1e-9)
    pairs = pairs.where(F.abs(F.col("j_x") - F.col("j_y")) <= 1 - similarity + 1e-9)
    # At the first shingle that two lines share, all that they share stands from there on in both.
    new = F.least(F.expr("size_x - fresh_x"), F.expr("size_y - fresh_y")) + F.least(F.expr("fresh_x - at_x"), F.expr("fresh_y - at_y"))
    shared = F.when(F.expr("at_x < fresh_x"), new).otherwise(F.least(F.expr("size_x - at_x"), F.expr("size_y - at_y")))
    pairs = pairs.where(shared >= both / 2 * (F.col("size_x") + F.col("size_y")) - 1e-6)
    return pairs.select(F.least("h_x", "h_y").alias("a"), F.greatest("h_x", "h_y").alias("b")).distinct()


def _parted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``band, h, j, part``: bucket members with their component, of buckets that hold several components."""
    parts = connected_components(links).withColumnRenamed("node", "h")
    parts = F.broadcast(parts) if fits_broadcast(parts) else parts
    rows = rows.join(parts, "h", "left").withColumn("part", F.coalesce("component", "h"))
    several = rows.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    return materialize(rows.join(several, "band", "left_semi").select("band", "h", "first", "part"), "parted-lines")


def line_links(distinct: DataFrame, lines: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links ``a, b`` between hashes of distinct lines (``h, n, bands``) that connect what shares a band and is similar.

    All lines of a bucket are compared with its most frequent one, the likeliest to be what
    others were made from. After that, only lines of a bucket that are not connected yet
    can add anything; of these the ones are compared that can be similar by their sizes,
    their distances from that line and the shingles that it does not have.
    """
    rows = distinct.select("h", "n", F.explode("bands").alias("band"))
    first = F.max_by("h", F.struct("n", "h")).alias("first")
    buckets = rows.groupBy("band").agg(F.count("*").alias("lines"), first).where("lines > 1").drop("lines")
    rows = materialize(rows.drop("n").join(buckets, "band"), "line-buckets")
    stars = rows.where("h <> first").select(F.col("first").alias("a"), F.col("h").alias("b")).distinct()
    known = _similarities(stars, lines, shingle, similarity)
    links = known.where(F.col("j") >= similarity).select("a", "b")

    rest = _parted(rows, links)
    if rest.isEmpty():
        return links
    members = rest.where("h <> first").select("first", "h", "part").distinct()
    members = members.join(known.select(F.col("a").alias("first"), F.col("b").alias("h"), "j", "size", "fresh", "lead"), ["first", "h"])
    more = _similarities(_candidates(members, similarity), lines, shingle).where(F.col("j") >= similarity)
    # Lines with one first line need not share a band.
    one, other = (distinct.select(F.col("h").alias(n), F.col("bands").alias(f"bands_{n}")) for n in "ab")
    more = more.join(one, "a").join(other, "b").where(F.arrays_overlap("bands_a", "bands_b"))
    return links.union(more.select("a", "b"))


def removed_lines(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = 10,
    similarity: float = 0.8,
    bands: int = 7,
    rows: int = 3,
    sketch: int = 40,
) -> DataFrame:
    """``doc_id, k, removed``: the line numbers (from 0) that go, for documents that lose any.

    ``k`` is a hash of the text; with the key it names a document. Runs several jobs when
    called; what they find is kept in the shared folder.
    """
    docs = doc_rows(df, key, text).withColumn("k", F.xxhash64("text"))
    lines = line_rows(docs)
    own = [F.col("bands")[b].alias(f"b{b}") for b in range(bands)]
    signed = lines.select("h", "g", F.expr(band_hashes("line", shingle, bands, rows, sketch)).alias("bands"))
    distinct = signed.select("h", "g", *own).groupBy("h").agg(
        F.count("*").alias("n"),
        F.min("g").alias("low"),
        F.max("g").alias("high"),
        *(F.min(f"b{b}").alias(f"b{b}") for b in range(bands)),
    )
    # Different lines of one hash (none to be expected) are left alone.
    distinct = materialize(distinct.where("low = high").drop("low", "high"), "distinct-lines")
    banded = distinct.select("h", "n", F.array(*(f"b{b}" for b in range(bands))).alias("bands"))
    parts = connected_components(line_links(banded, lines.select("h", "line"), shingle, similarity))
    parts = parts.withColumnRenamed("node", "h")
    repeated = distinct.select("h", "n").join(parts, "h", "left").where("n > 1 OR component IS NOT NULL")
    repeated = materialize(repeated.select("h", F.coalesce("component", "h").alias("component")), "repeated-lines")
    repeated = F.broadcast(repeated) if fits_broadcast(repeated) else repeated

    places = materialize(lines.select("doc_id", "k", "at", "h").join(repeated, "h").drop("h"), "line-places")
    first = places.groupBy("component").agg(F.min(F.struct("doc_id", "k", "at")).alias("first"))
    here = F.struct("doc_id", "k", "at")
    gone = places.join(first, "component").where(~same(here, F.col("first")))
    removed = gone.groupBy("doc_id", "k").agg(F.collect_set("at").alias("removed"))
    return materialize(removed, "removed-lines")


def _kept(df: DataFrame, key: str, text: str, removed: DataFrame) -> DataFrame:
    """``df`` with the columns ``_lines, _gone, _kept``."""
    marks = removed.select(F.col("doc_id").alias("_id"), F.col("k").alias("_k"), F.col("removed").alias("_removed"))
    marks = F.broadcast(marks) if fits_broadcast(marks) else marks
    rows = df.withColumn("_key", F.col(f"`{key}`")).withColumn("_text", F.col(f"`{text}`"))
    rows = rows.join(marks, (F.xxhash64("_text") == F.col("_k")) & same(F.col("_key"), F.col("_id")), "left")
    stay = "array_except(sequence(0, size(l) - 1), _removed)"
    joined = rf"transform(array(split(_text, '\n')), l -> array_join(transform({stay}, i -> l[i]), '\n'))[0]"
    return (
        rows.withColumn("_lines", F.when(F.col("_text").isNull(), 0).otherwise(F.size(F.split("_text", "\n"))))
        .withColumn("_gone", F.when(F.col("_removed").isNull(), 0).otherwise(F.size("_removed")))
        .withColumn("_kept", F.expr(f"IF(_removed IS NULL, _text, {joined})"))
    )


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``key, n_lines, n_removed, kept`` for every row.

    Of lines that are equal up to white space at their ends, or linked by a Jaccard
    similarity of at least ``similarity`` between their sets of shingles, the first one
    by key, then place, stays. Blank lines always stay. Options as in ``removed_lines``.

    A null text has no lines and stays null. Rows without a key come before all others.
    Repeated rows count as one document, so each keeps the same lines; rows with one key
    and different texts are different documents. Empty tables give an empty result.
    """
    rows = _kept(df.select(F.col(f"`{key}`"), F.col(f"`{text}`")), key, text, removed_lines(df, key, text, **options))
    return rows.select(
        F.col(f"`{key}`"),
        F.col("_lines").cast("long").alias("n_lines"),
        F.col("_gone").cast("long").alias("n_removed"),
        F.col("_kept").alias("kept"),
    )


def without_repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` with its texts cut to the lines that ``dedup_lines`` keeps; all rows and columns stay."""
    rows = _kept(df, key, text, removed_lines(df, key, text, **options))
    return rows.select(*(F.col("_kept").alias(c) if c == text else F.col(f"`{c}`") for c in df.columns))
