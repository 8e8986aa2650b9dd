"""Spelling variants by an index of variable-length grams.

Every pair of letters is a gram; a pair that stands at many places is followed by a third
letter, so a gram is long where it is common and short where it is rare. A word is cut into
the longest gram at each place, grams within others left out. One edit can change only so
many of a word's grams (its bound), so of two words one edit apart the rarest grams of each,
one more than its bound, share a gram that no edit has touched. The edit then stands to the
left or to the right of it: the words agree from their first letter to the gram's end, or from
the gram's start to their last letter. Words are listed under these parts, the lists of a
word are merged, and what meets is compared letter by letter. In a long list the words must
also agree in one half of what the part leaves of them, so no list is paired as a whole.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkscrub.llm.common import doc_rows, map_rows, materialize
from sparkscrub.plans.sizing import fits_broadcast

# Letters that words are made of: A-Z, a-z, U+00C0 to U+00FF, so 116 in all. There are no more
# than 116 ** 2 + 116 ** 3 = 1,574,352 grams, whatever the size of the data.
LETTERS = [*map(chr, range(0x41, 0x5B)), *map(chr, range(0x61, 0x7B)), *map(chr, range(0xC0, 0x100))]
WORD = "[A-Za-zÀ-ÿ]"
SHORT, LONG = 2, 3
# A list of more words is divided by the halves of what is left of them.
LONG_LIST = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_length: int = 7,
    min_count: int = 2,
    slips: int | None = None,
) -> DataFrame:
    """``word, n``: runs of letters (A-Z lower-cased) of at least so many code points, with their number.

    ``slips`` deletes one letter of the runs whose CRC-32 of ``key:run`` it divides, the
    one at the CRC modulo the length. A null text has no words; a null key is an empty
    one. Counted with map-side combine, whatever word holds most of the rows.
    """
    docs = doc_rows(df, key, text)
    # A run that is too short cannot become long enough.
    runs = F.explode(F.regexp_extract_all("text", F.lit(f"{WORD}{{{min_length},}}+"), F.lit(0)))
    rows = docs.select("doc_id", runs.alias("run")).withColumn("run", F.translate("run", _UPPER, _LOWER))
    word = F.col("run")
    if slips:
        named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")
        rows = rows.withColumn("h", F.crc32(F.encode(named, "UTF-8")))
        cut = "concat(substring(run, 1, cast(h % length(run) AS int)), substring(run, cast(h % length(run) AS int) + 2))"
        word = F.when(F.col("h") % slips == 0, F.expr(cut)).otherwise(F.col("run"))
    counts = rows.select(word.alias("word")).where(F.length("word") >= min_length)
    return counts.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


class Grams:
    """How often each gram stands in the words, and which pairs are common.

    Pairs are common that make up more than ``share`` of all pairs.
    """

    def __init__(self, counts: dict[str, int], share: float):
        pairs = {g: n for g, n in counts.items() if len(g) == SHORT}
        limit = share * sum(pairs.values())
        self.counts = counts
        self.common = frozenset(g for g, n in pairs.items() if n > limit)

    def cut(self, word: str) -> list[tuple[int, int]]:
        """Start and end of the grams of a word."""
        found, covered, size, common = [], 0, len(word), self.common
        for at in range(size - SHORT + 1):
            end = at + SHORT
            if end < size and word[at:end] in common:
                end += LONG - SHORT
            if end > covered:
                found.append((at, end))
                covered = end
        return found

    def bound(self, grams: list[tuple[int, int]], size: int) -> int:
        """The most grams that one edit can change, be it in letters or by others that cover them.

        An edit at letter e can change the gram that starts at p if it looks at e
        (p <= e < p + LONG), or if it starts after e and ends where a changed gram may end.
        """
        change = [0] * (size + 1)
        for start, end in grams:
            change[max(end - LONG, 0)] += 1
            change[min(start + LONG, size)] -= 1
        return max(accumulate(change))

    def parts(self, word: str) -> list[tuple[str, str]]:
        """What a word is listed under, and the rest of it: for its rarest grams, what ends with
        the gram, and what begins with it."""
        grams = self.cut(word)
        wanted = self.bound(grams, len(word)) + 1
        counts = self.counts
        rarest = sorted(grams, key=lambda g: (counts[word[g[0] : g[1]]], word[g[0] : g[1]], g[0]))[:wanted]
        return [p for a, b in rarest for p in ((f"<{word[:b]}", word[b:]), (f">{word[a:]}", word[:a]))]


def gram_counts(words: DataFrame) -> DataFrame:
    """``gram, n`` of all pairs and triples of letters of distinct words; bounded by the alphabet."""
    pieces = " ".join(
        f"transform(sequence(1, length(word) - {q - 1}), i -> substring(word, i, {q}))," for q in (SHORT, LONG)
    )
    return words.select(F.explode(F.expr(f"concat({pieces[:-1]})")).alias("gram")).groupBy("gram").count()


def near_words(words: DataFrame, common: float = 0.001) -> DataFrame:
    """``a, n_a, b, n_b``: pairs of words (``word, n``) that differ by one inserted, deleted or replaced letter.

    Words must be distinct, of ``LETTERS`` and of at least ``2 * LONG + 1`` of them: then
    some gram of each pair is out of reach of the edit. Runs jobs when called.
    """
    counts = gram_counts(words).collect()
    own = words.sparkSession.sparkContext.broadcast(Grams({r["gram"]: r["count"] for r in counts}, common))
    schema = T.StructType(
        [
            T.StructField("part", T.StringType()),
            T.StructField("rest", T.StringType()),
            T.StructField("word", T.StringType()),
            T.StructField("n", T.LongType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def step(batches):
        grams = own.value
        for batch in batches:
            rows, held = [], 0
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = grams.parts(word)
                rows += [(*part, word, n) for part in found]
                held += 2 * len(word) * len(found)
                # Few at once, since a word may be very long.
                if held > 4_000_000:
                    yield _batch(rows, arrow)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, arrow)

    listed = map_rows(words.select("word", "n"), step, schema).withColumn("k", F.lit(-1))
    listed = materialize(listed.withColumn("part", F.xxhash64("part")), "variant-lists")
    near = None
    while True:
        # Rests of a letter are as many as there are letters.
        crowded = listed.where("k NOT IN (0, 1)").groupBy("part").count().where(F.col("count") > LONG_LIST)
        crowded = materialize(crowded.select("part"), "long-lists")
        if crowded.isEmpty():
            met = _met(listed)
            return (met if near is None else near.union(met)).distinct()
        crowded = F.broadcast(crowded) if fits_broadcast(crowded) else crowded
        met = _met(listed.join(crowded, "part", "left_anti"))
        near = met if near is None else near.union(met)
        halves = listed.join(crowded, "part", "left_semi").select("word", "n", F.inline(F.expr(_HALVES)))
        listed = materialize(halves.select("part", "rest", "word", "n", "k"), "variant-lists")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


# Of two rests one edit apart the shorter has k letters, and either the first k / 2 of both
# agree or the last k - k / 2. At first a rest may be the shorter (k letters) or the longer one
# (k + 1); after that k is known.
_HALVES = (
    "flatten(transform(filter(IF(k >= 0, array(k), array(length(rest), length(rest) - 1)), c -> c >= 0), c -> array("
    "struct(xxhash64(part, c, 'first', left(rest, c div 2)) AS part, substring(rest, cast(c div 2 AS int) + 1) AS rest, "
    "cast(c - c div 2 AS int) AS k), "
    "struct(xxhash64(part, c, 'last', right(rest, cast(c - c div 2 AS int))) AS part, "
    "left(rest, cast(length(rest) - c + c div 2 AS int)) AS rest, cast(c div 2 AS int) AS k))))"
)


def _met(listed: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: words of one list that are one edit apart."""
    listed = listed.withColumn("left", F.length("rest"))
    a, b = (listed.select("part", *(F.col(c).alias(f"{c}_{x}") for c in ("word", "n", "k", "left"))) for x in "ab")
    # Of two words the shorter comes first, of equal length the smaller one. Each condition is
    # on both sides, so that both are the same rows and are shuffled once.
    more = F.col("left_b") - F.col("left_a")
    met = a.join(b, "part").where((more == 1) | ((more == 0) & (F.col("word_a") < F.col("word_b"))))
    near = met.where("least(k_a, k_b) < 0 OR left_a = greatest(k_a, k_b)")
    near = near.where(F.levenshtein("word_a", "word_b", 1) == 1)
    return near.select(F.col("word_a").alias("a"), "n_a", F.col("word_b").alias("b"), "n_b")


def group_variants(words: DataFrame, ratio: int = 10, common: float = 0.001) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of a table ``word, n`` of distinct words.

    A word's form is the near word of largest n (ties: the smallest in code-point order) if
    it has at least ``ratio`` times the word's n; the root is where the forms lead. Words
    without near words have ``n_near`` 0, no form, and are their own root. An empty table
    gives an empty result; other columns are ignored. Runs jobs when called; what they
    find is kept in the shared folder.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, else forms may lead in a circle")
    words = materialize(words.select("word", "n"), "variant-words")
    pairs = materialize(near_words(words, common), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n"))
    both = both.union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    rows = words.join(best, "word", "left")
    formed = -F.col("best.less") >= ratio * F.col("n")
    rows = rows.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best.other")).alias("form"),
        F.when(formed, -F.col("best.less")).alias("form_n"),
    )
    rows = materialize(rows, "variant-forms")
    roots = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # n grows by the ratio with each step, so there are few; every round doubles the steps taken.
    most, steps = rows.agg(F.max("n")).first()[0] or 1, 1
    while ratio**steps <= most:
        nexts = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(nexts, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        roots = materialize(roots, "variant-roots")
        steps *= 2
    rows = rows.join(roots, "word", "left")
    return rows.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
