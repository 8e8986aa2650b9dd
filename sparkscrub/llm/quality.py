"""Quality rules: statistics of each text and an isolation forest over them.

Base rules reject by fixed limits. Beyond them, trees of random splits are grown over
the statistics of labelled documents; a document that few splits isolate is anomalous.
The score above which it is rejected is the one that serves the labelled rows best.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkscrub.llm.common import field_type, in_chunks, map_rows, materialize
from sparkscrub.plans.sizing import fits_broadcast

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_ALNUM = _UPPER + bytes(range(97, 123)) + _DIGITS
# All bytes but ASCII punctuation and control characters.
_NO_MARK = _ALNUM + SPACES.encode() + bytes(range(128, 256))

# Scores are counted in so many ranges.
SCORE_RANGES = 1 << 16

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbols", "repeats", "duplicate_lines", "word_length", "upper", "digits", "punctuation")


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that stand twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, where, count = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    hit = count[where] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum())


def statistics(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The base counts and the features of one text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    duplicates = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    solid = max(1, len(b"".join(words)))
    marks = len(raw.translate(None, _NO_MARK))
    features = (
        symbols / max(1, n),
        repeats / max(1, n),
        duplicates / max(1, len(lines)),
        chars / max(1, n),
        (len(raw) - len(raw.translate(None, _UPPER))) / solid,
        (len(raw) - len(raw.translate(None, _DIGITS))) / solid,
        marks / solid,
    )
    return (n, chars, symbols, duplicates, repeats), features


def base_failed(counts: tuple[int, ...], min_words: int, max_repeat: int) -> bool:
    return counts[0] < min_words or 100 * counts[4] > max_repeat * counts[0]


def usual_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays (trees, nodes): feature (-1: leaf), split value, path length at a leaf.

    A point is how far each statistic lies outside the usual range of good documents.
    """

    low: np.ndarray
    high: np.ndarray
    feature: np.ndarray
    split: np.ndarray
    length: np.ndarray
    sample: int
    threshold: float = np.inf
    active: np.ndarray | float = 1.0

    @classmethod
    def fit(
        cls,
        good: np.ndarray,
        bad: np.ndarray,
        low: np.ndarray,
        high: np.ndarray,
        active: np.ndarray,
        trees: int,
        sample: int,
        seed: int,
        bad_share: float,
    ) -> Forest:
        """Each tree sees ``sample`` rows, of which ``bad_share`` are bad: anomalies must be few to be isolated."""
        random = np.random.default_rng(seed)
        depth = max(1, int(np.ceil(np.log2(max(2, sample)))))
        shape = (trees, 2 ** (depth + 1) - 1)
        forest = cls(low, high, np.full(shape, -1), np.zeros(shape), np.zeros(shape), sample, active=active)
        good, bad = forest.outside(good), forest.outside(bad)
        n_bad = max(1, round(sample * bad_share))
        for tree in range(trees):
            rows = [good[random.choice(len(good), sample - n_bad)], bad[random.choice(len(bad), n_bad)]]
            open_nodes = [(0, 0, np.concatenate(rows))]
            while open_nodes:
                node, level, own = open_nodes.pop()
                least, most = own.min(axis=0), own.max(axis=0)
                usable = np.flatnonzero(most > least)
                if level == depth or not len(usable):
                    forest.length[tree, node] = level + usual_path(len(own))
                    continue
                f = random.choice(usable)
                value = random.uniform(least[f], most[f])
                forest.feature[tree, node], forest.split[tree, node] = f, value
                left = own[:, f] <= value
                open_nodes += [(2 * node + 1, level + 1, own[left]), (2 * node + 2, level + 1, own[~left])]
        return forest

    def outside(self, stats: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, np.maximum(stats - self.high, self.low - stats)) * self.active

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Between 0 and 1, near 1 for rows that few splits isolate."""
        if not len(stats):
            return np.zeros(0)
        points = self.outside(stats)
        total = np.zeros(len(points))
        rows = np.arange(len(points))
        for feature, split, length in zip(self.feature, self.split, self.length):
            node = np.zeros(len(points), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = points[rows, np.maximum(f, 0)] > split[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / max(float(usual_path(self.sample)), 1e-9))


def calibrated(least: np.ndarray, most: np.ndarray, good: np.ndarray, bad: np.ndarray, max_good_lost: float) -> float:
    """The score above which rejecting gives the best balanced accuracy, losing few good rows.

    From ranges of scores that do not overlap: their least and greatest score, their good and bad rows.
    """
    order = np.argsort(-least, kind="stable")
    least, most = least[order], most[order]
    bad_hit = np.cumsum(bad[order]) / max(1, bad.sum())
    good_hit = np.cumsum(good[order]) / max(1, good.sum())
    gain = np.where(good_hit <= max_good_lost, bad_hit - good_hit, -1.0)
    best = int(np.argmax(gain)) if len(gain) else 0
    if not len(gain) or gain[best] <= 0:
        return np.inf
    below = most[best + 1] if best + 1 < len(most) else least[best] - 1
    return float((least[best] + below) / 2)


def _measured(df: DataFrame, names: list[str], finish) -> DataFrame:
    """Counts and features of each text, finished for a batch by ``finish`` into output arrays."""
    fields, compute = finish
    schema = T.StructType([*(T.StructField(n, field_type(df, n)) for n in names), *fields])
    arrow = to_arrow_schema(schema)

    def step(batches):
        for batch in batches:
            counts, features = [], []
            for chunk in in_chunks(x.as_py() for x in batch.column(len(names))):
                for text in chunk:
                    c, f = statistics(text)
                    counts.append(c)
                    features.append(f)
            c = np.array(counts, np.int64).reshape(-1, len(COUNTS))
            f = np.array(features, float).reshape(-1, len(FEATURES))
            kept = [batch.column(i).cast(arrow.field(i).type) for i in range(len(names))]
            made = compute(c, f)
            made = [pa.array(a, arrow.field(len(names) + i).type) for i, a in enumerate(made)]
            yield pa.RecordBatch.from_arrays(kept + made, schema=arrow)

    return map_rows(df, step, schema)


def _ends(rows: DataFrame, n: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The quantiles ``share`` and ``1 - share`` of each statistic of ``n`` rows, exact and interpolated.

    Only the rows beyond them are sorted in one place, and two numbers for each come to the driver.
    """
    place = share * (n - 1)
    first, part = int(place), place - int(place)
    wanted = []
    for i in range(len(FEATURES)):
        for sign in (1, -1):
            own = rows.select((sign * F.col("features")[i]).alias("v")).orderBy("v").limit(first + 2)
            two = own.orderBy(F.desc("v")).limit(2).agg(F.sort_array(F.collect_list("v")).alias("v"))
            wanted.append(two.select(F.lit(i).alias("i"), F.lit(sign).alias("sign"), "v"))
    found = wanted[0]
    for one in wanted[1:]:
        found = found.unionByName(one)
    low, high = np.zeros(len(FEATURES)), np.zeros(len(FEATURES))
    for i, sign, v in found.collect():
        value = v[0] if n == 1 else v[0] + part * (v[-1] - v[0])
        (low if sign > 0 else high)[i] = sign * value
    return low, high


def _scored(rows: DataFrame, forest: Forest, label: str) -> DataFrame:
    """Ranges of scores with their least and greatest score and their good and bad rows."""
    schema = T.StructType([T.StructField("score", T.DoubleType()), T.StructField(label, rows.schema[label].dataType)])
    arrow = to_arrow_schema(schema)

    def step(batches):
        for batch in batches:
            points = np.array(batch.column(0).to_pylist(), float).reshape(-1, len(FEATURES))
            score = pa.array(forest.score(points), pa.float64())
            yield pa.RecordBatch.from_arrays([score, batch.column(1).cast(arrow.field(1).type)], schema=arrow)

    scored = map_rows(rows.select("features", label), step, schema)
    return scored.groupBy(F.floor(F.col("score") * SCORE_RANGES).alias("range")).agg(
        F.min("score").alias("least"),
        F.max("score").alias("most"),
        F.count_if(F.col(label) > 0).alias("good"),
        F.count_if(F.col(label) <= 0).alias("bad"),
    )


def fit_forest(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    quality: str = "quality",
    trees: int = 100,
    sample: int = 256,
    seed: int = 7,
    bad_share: float = 0.05,
    usual: float = 0.998,
    margin: float = 0.5,
    min_lift: float = 5.0,
    max_good_lost: float = 0.002,
    min_words: int = 50,
    max_repeat: int = 50,
) -> Forest | None:
    """Grow the forest on the labelled documents and calibrate it on all of them.

    The usual range holds the share ``usual`` of good rows and is widened by ``margin``
    of its width on both sides, since among rows that are all alike the slightest
    difference would be isolated at once. A statistic takes part if bad rows leave its
    usual range far more often than good rows (``min_lift``).

    Ranges, statistics that take part and the score that rejects come from all labelled rows, counted by
    Spark. A tree of an isolation forest is grown on ``sample`` rows, drawn from as many good and bad rows
    as all trees take together, those of smallest hash. Rows without a key, text or
    label are left out, and keys that are labelled good and bad; without labelled rows
    of both kinds there is no forest (None).
    """
    ids = labels.select(F.col(f"`{key}`").alias(key), F.col(f"`{quality}`").cast("int").alias("_label"))
    # A key that is labelled good and bad says nothing.
    kinds = F.col("_label") > 0
    ids = ids.dropna().groupBy(key).agg(F.min("_label").alias("_label"), (F.min(kinds) == F.max(kinds)).alias("_sure"))
    ids = materialize(ids.where("_sure").drop("_sure"), "labels")
    texts = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text")).dropna()
    own = texts.join(F.broadcast(ids) if fits_broadcast(ids) else ids, key)
    own = own.select("_label", F.xxhash64(key).alias("_mark"), "_text")

    def finish(c, f):
        return [list(row) for row in f], c[:, 0], c[:, 4]

    fields = [
        T.StructField("features", T.ArrayType(T.DoubleType())),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
    ]
    rows = _measured(own, ["_label", "_mark"], (fields, finish))
    rows = rows.where(f"n_words >= {min_words} AND 100 * n_repeat_words <= {max_repeat} * n_words")
    rows = materialize(rows.select("_label", "_mark", "features"), "labelled")
    is_good = F.col("_label") > 0
    good, bad = rows.where(is_good), rows.where(~is_good)
    n_good, n_bad = rows.agg(F.count_if(is_good), F.count_if(~is_good)).first()
    if not n_good or not n_bad:
        return None
    low, high = _ends(good, n_good, (1 - usual) / 2)
    low, high = low - margin * (high - low), high + margin * (high - low)
    outside = [
        (F.col("features")[i] > float(high[i])) | (F.col("features")[i] < float(low[i])) for i in range(len(FEATURES))
    ]
    counts = rows.agg(*(F.count_if(kind & away) for kind in (is_good, ~is_good) for away in outside)).first()
    away_good, away_bad = np.array(counts[: len(outside)]) / n_good, np.array(counts[len(outside) :]) / n_bad
    active = away_bad >= min_lift * away_good + min_lift / (n_good + n_bad)

    def drawn(kind: DataFrame) -> np.ndarray:
        some = kind.orderBy(F.xxhash64("_mark", "features"), "_mark", "features").limit(trees * sample)
        # Whatever the hash of the key: the order of rows.
        return np.array([r["features"] for r in some.orderBy(F.xxhash64("features"), "_label").collect()], float)

    forest = Forest.fit(drawn(good), drawn(bad), low, high, active, trees, sample, seed, bad_share)
    ranges = _scored(rows, forest, "_label").toArrow()
    ranges = [ranges[c].to_numpy() for c in ("least", "most", "good", "bad")]
    forest.threshold = calibrated(*ranges, max_good_lost)
    return forest


def rate_quality(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    min_words: int = 50,
    max_repeat: int = 50,
    **options,
) -> DataFrame:
    """``key``, kept columns, the base counts, ``base_failed``, ``score`` and ``kept`` for every row.

    ``kept`` is false where a base rule fails (fewer than ``min_words`` words, or more
    than ``max_repeat`` % of the words in repeated three-word windows) or the forest's
    score is above its threshold. The other options go to ``fit_forest``, which runs
    when this is called.

    A null text has no words, so it fails. Null keys and repeated rows are rated one by
    one. Without usable labels the base rules decide alone, with score null. An empty
    table gives an empty result. Other columns are not read.
    """
    forest = fit_forest(df, labels, key, text, min_words=min_words, max_repeat=max_repeat, **options)

    def finish(c, f):
        failed = (c[:, 0] < min_words) | (100 * c[:, 4] > max_repeat * c[:, 0])
        if forest is None:
            return *c.T, failed, [None] * len(c), ~failed
        score = forest.score(f)
        return *c.T, failed, score, ~failed & (score <= forest.threshold)

    fields = [T.StructField(n, T.LongType()) for n in COUNTS] + [
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("kept", T.BooleanType()),
    ]
    names = list(dict.fromkeys([key, *keep]))
    own = df.select(*(F.col(f"`{n}`") for n in names), F.col(f"`{text}`").alias("_text"))
    return _measured(own, names, (fields, finish))
