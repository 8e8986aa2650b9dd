"""Personal data: fixed patterns as seeds, and contexts that seeds teach.

Base spans come from fixed patterns with checks. Beside them, looser shapes of the same
kinds are instances in doubt. The words beside an instance are its lexical patterns.
Spark scores the graph of patterns and instances in rounds: a pattern is as good as its
seeds and confirmed instances against what speaks for something else: seeds of other
kinds, shapes that fail their check, and instances in doubt beyond as many as it has
confirmed. An instance is as good as its patterns. Instances in doubt that good patterns
agree on become spans, too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscrub.llm.common import doc_rows, map_texts, materialize, same
from sparkscrub.plans.sizing import fits_broadcast

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match begins a run of digits: from inside a run it would end the same way.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# "at" in all its spellings, and what follows a local part. A local part begins at the left edge of its run, so that
# long runs take linear time.
_AT = re.compile(r"\bat\b", re.I)
_SPELLED = r" ?(?:\[at\]|\(at\)|\bat\b) ?[\w-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\bdot\b|\.) ?[\w-]{1,63}){1,8}"

# Shapes in doubt, by kind; none may touch a base span.
_LOOSE = (
    (0, re.compile(rf"(?<![\w.%+-])[\w.%+-]+{_SPELLED}", re.I)),
    (1, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![0-9A-Fa-f:])")),
    (2, re.compile(r"(?<![0-9])[0-9](?:[ .-]?[0-9]){11,18}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ .-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,4}(?![0-9])")),
)
_LATER = re.compile(rf"[\w.%+-]+{_SPELLED}", re.I)
_WORD = re.compile(r"[^\W\d_]+")
# Instances that are none, added to each pattern: with min_support seeds and nothing against it a pattern is good.
PRIOR = 0.25
# Characters beside a span in which its context is looked for.
_REACH = 80

MENTION = T.StructType(
    [
        T.StructField("kind", T.IntegerType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("stop", T.IntegerType()),
        T.StructField("value", T.StringType()),
        # null: a shape that fails its check
        T.StructField("seed", T.BooleanType()),
        T.StructField("left", T.StringType()),
        T.StructField("right", T.StringType()),
    ]
)
SPAN = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("start", "kind", "stop")]
)


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        x = int(d) * (1 + n % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str, failed: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of the base patterns, by start, then kind; ``failed`` takes addresses and numbers out of range."""
    spans, last = [], 0
    failed = [] if failed is None else failed
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                spans.append((start, 0, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        parts = (p.lstrip("0") for p in m[0].split("."))
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            spans.append((m.start(), 1, m.end()))
        else:
            failed.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append((m.start(), 3, m.end()))
            else:
                failed.append((m.start(), 3, m.end()))
    return sorted(spans)


def spelled_out(pattern: re.Pattern, text: str):
    """Matches from left to right; a sign that ends an address may begin the run of the next one."""
    m = pattern.search(text)
    while m:
        yield m
        end = m.end()
        m = (text[end : end + 1] in ("%", "+", "-") and _LATER.match(text, end + 1)) or pattern.search(text, end)


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of shapes in doubt that touch no base span."""
    found = []
    covered = None
    for kind, pattern in _LOOSE:
        if kind == 0 and not _AT.search(text):
            continue
        if kind == 1 and ":" not in text:
            continue
        for m in spelled_out(pattern, text) if kind == 0 else pattern.finditer(text):
            if kind == 3 and not 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                continue
            if covered is None:
                covered = bytearray(len(text))
                for a, _, b in base:
                    covered[a:b] = b"\1" * (b - a)
            a, b = m.span()
            if 1 not in covered[a:b]:
                found.append((a, kind, b))
                covered[a:b] = b"\1" * (b - a)
    return sorted(found)


def context(text: str, start: int, stop: int) -> tuple[str, str]:
    """The words next to a span, lower case; empty at the text's ends."""
    left = _WORD.findall(text[max(0, start - _REACH) : start])
    right = _WORD.search(text, stop, min(len(text), stop + _REACH))
    return (left[-1].lower() if left else ""), (right[0].lower() if right else "")


def mentions(text: str) -> tuple[list[tuple], list[dict]]:
    failed: list[tuple[int, int, int]] = []
    base = base_spans(text, failed)
    rows = []
    for spans, seed in ((base, True), (loose_spans(text, base), False), (failed, None)):
        for start, kind, stop in spans:
            left, right = context(text, start, stop)
            value = text[start:stop]
            rows.append(dict(zip(MENTION.names, (kind, start, stop, value, seed, left, right))))
    return [dict(zip(SPAN.names, s)) for s in base], rows


def learned_instances(
    found: DataFrame, rounds: int, min_support: int, min_pattern: float, min_instance: float
) -> DataFrame:
    """``kind, value`` of instances in doubt that the patterns of the seeds confirm.

    ``found``: mentions as rows. A pattern is a kind and the word left, right, or on both
    sides of an instance. It counts if it stands with at least ``min_support`` different
    seeds and its score is at least ``min_pattern``: its confirmed instances as a share of
    themselves, seeds of other kinds, failed shapes, what is in doubt beyond as many as are
    confirmed, and ``PRIOR``.
    """
    sides = F.array(
        F.when(F.col("left") != "", F.concat(F.lit("l:"), "left")),
        F.when(F.col("right") != "", F.concat(F.lit("r:"), "right")),
        F.when((F.col("left") != "") & (F.col("right") != ""), F.concat_ws(" ", F.lit("b:"), "left", "right")),
    )
    edges = found.select("kind", "value", "seed", F.explode(sides).alias("pattern")).where("pattern IS NOT NULL")
    # What is a seed anywhere is a seed everywhere.
    edges = edges.groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed"))
    counts = edges.groupBy("pattern", "kind").agg(
        F.count_if("seed").alias("own"),
        F.count_if(F.col("seed").isNull()).alias("failed"),
        F.count_if(~F.col("seed")).alias("doubtful"),
    )
    # Four kinds at most, so a pattern has few rows here.
    total = counts.groupBy("pattern").agg(F.sum("own").alias("all"))
    open_patterns = counts.where((F.col("doubtful") > 0) & (F.col("own") >= min_support)).join(total, "pattern")
    open_patterns = open_patterns.select("kind", "pattern", (F.col("all") - F.col("own") + F.col("failed")).alias("against"))
    edges = edges.where("seed IS NOT NULL").join(open_patterns, ["kind", "pattern"])
    edges = materialize(edges, "context-edges")
    scores = materialize(
        edges.where("NOT seed").select("kind", "value").distinct().withColumn("score", F.lit(0.0)), "context-scores"
    )
    if scores.isEmpty():
        return scores.select("kind", "value")
    for _ in range(rounds):
        weighed = edges.join(scores, ["kind", "value"], "left")
        weight = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
        patterns = weighed.groupBy("kind", "pattern").agg(
            F.sum(F.round(weight, 9)).alias("sure"),
            F.count("*").alias("n"),
            F.min("against").alias("against"),
            F.count_if("seed").alias("seeds"),
        )
        beyond = F.greatest(F.lit(0.0), F.col("n") - 2 * F.col("sure"))
        patterns = patterns.withColumn("quality", F.col("sure") / (F.col("sure") + F.col("against") + beyond + PRIOR))
        good = patterns.where((F.col("seeds") >= min_support) & (F.col("quality") >= min_pattern))
        good = good.select("kind", "pattern", "quality")
        doubt = edges.where("NOT seed").join(good, ["kind", "pattern"])
        missed = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("quality"))))
        scores = doubt.groupBy("kind", "value").agg((1 - F.exp(missed)).alias("score"))
        scores = materialize(scores, "context-scores")
    return scores.where(F.col("score") >= min_instance).select("kind", "value")


def find_personal_data(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    rounds: int = 3,
    min_support: int = 5,
    min_pattern: float = 0.9,
    min_instance: float = 0.95,
) -> DataFrame:
    """``key, base, added`` for every row: arrays of ``start, kind, stop`` (kind: index in ``KINDS``).

    ``base``: the fixed patterns, leftmost and without overlap per kind. ``added``: spans
    of instances that contexts confirm; they touch no base span. Runs several jobs when
    called; mentions and scores are kept in the shared folder.

    A null text is empty. Null keys and repeated rows get their own results; rows with
    one key and different texts are different documents. Empty tables give an empty
    result. Texts are read whole; other columns are not read.
    """
    docs = doc_rows(df, key, text).withColumn("k", F.xxhash64("text"))
    fields = [("base", T.ArrayType(SPAN)), ("mentions", T.ArrayType(MENTION))]
    read = materialize(map_texts(docs, lambda: lambda texts: [mentions(t) for t in texts], fields, keep=("k",)), "mentions")
    found = read.where(F.size("mentions") > 0).select("doc_id", "k", F.explode("mentions").alias("m"))
    found = found.select("doc_id", "k", "m.*")
    learned = learned_instances(found, rounds, min_support, min_pattern, min_instance)
    learned = F.broadcast(learned) if fits_broadcast(learned) else learned
    added = found.where("NOT seed").join(learned, ["kind", "value"])
    added = added.groupBy("doc_id", "k").agg(F.sort_array(F.collect_set(F.struct("start", "kind", "stop"))).alias("added"))
    added = materialize(added, "learned-spans").withColumnsRenamed({"doc_id": "_id", "k": "_k"})
    added = F.broadcast(added) if fits_broadcast(added) else added
    # A null text hashes to a number, too, so k is never null.
    rows = read.join(added, (F.col("k") == F.col("_k")) & same(F.col("doc_id"), F.col("_id")), "left")
    none = F.array().cast(T.ArrayType(SPAN))
    return rows.select(F.col("doc_id").alias(key), "base", F.coalesce("added", none).alias("added"))


def span_text(spans: Column) -> Column:
    """``kind:start:stop`` of spans in order, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    one = F.transform(
        F.sort_array(spans),
        lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string")),
    )
    return F.array_join(one, ",")


def personal_data_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, the base counts by kind, the hash of the base spans, and all spans as text."""
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {n})) AS long)").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select(
        key,
        *counts,
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.concat("base", "added")).alias("spans"),
    )
