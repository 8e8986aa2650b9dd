"""The ordered set accepts and cuts as the folds do."""

import random
import time

import pytest

from sparkscrub.functions.mask import mask_spans
from sparkscrub.functions.spans import SPANS_TYPE, resolve_overlaps
from sparkscrub.operators import overlaps
from sparkscrub.operators.overlaps import OrderedRanges, accepted, mask_spans_of, masked_at, resolve_spans

KINDS = ["URL", "PERSON", "US_SSN", "EMAIL_ADDRESS"]


def made(seed, n=60, width=80, most=14):
    pick = random.Random(seed)
    out = []
    for _ in range(pick.randint(0, n)):
        start = pick.randrange(width)
        out.append({"start": start, "end": min(width, start + pick.choice([0, 1, 2, 3, 5, 8, most])), "entity_type": pick.choice(KINDS), "value": str(pick.randrange(9))})
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, "é" * 40 + "x" * 40, s) for i, s in enumerate(rows)] + [(-1, None, None), (-2, "", [])], f"id int, text string, spans {SPANS_TYPE}")


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.5, 0.8, 1.0])
def test_spans_are_those_of_the_fold(spark, threshold):
    df = frame(spark, [made(i, n=10 + i % 60) for i in range(300)])
    want = {r.id: r.s for r in df.select("id", resolve_overlaps("spans", threshold).alias("s")).collect()}
    for direct in (0, 7):
        got = {r.id: r.spans for r in resolve_spans(df, threshold=threshold, direct=direct).collect()}
        assert got == want


def test_masked_texts_are_those_of_the_fold(spark):
    df = frame(spark, [made(1000 + i, n=10 + i % 60) for i in range(300)])
    want = {r.id: r.m for r in df.select("id", mask_spans("text", "spans").alias("m")).collect()}
    for direct in (0, 7):
        got = {r.id: r.masked for r in mask_spans_of(df, direct=direct).collect()}
        assert got == want


def test_many_spans_of_one_text_take_seconds():
    pick, n = random.Random(5), 100_000
    spans = [{"start": (s := pick.randrange(20 * n)), "end": s + pick.randrange(1, 60), "entity_type": "URL", "value": ""} for _ in range(n)]
    nested = [{"start": i, "end": 2 * n - i, "entity_type": "URL", "value": ""} for i in range(n)]
    start = time.time()
    kept = accepted(spans)
    assert len(kept) > n / 4 and len(accepted(nested)) == 1
    assert masked_at("x" * 20 * n, spans).count("<URL>") > n / 4
    assert time.time() - start < 30


def test_an_ordered_set_is_split_and_stays_in_order(monkeypatch):
    monkeypatch.setattr(overlaps, "BLOCK", 4)
    pick, held, plain = random.Random(6), OrderedRanges(), []
    assert held.before(3) == (None, None)
    for start in pick.sample(range(1000), 300):
        held.add(start, start + 5)
        plain = sorted([*plain, (start, start + 5)])
        at = pick.randrange(1000)
        left = [r for r in plain if r[0] <= at]
        right = [r for r in plain if r[0] > at]
        assert held.before(at) == (left[-1] if left else None, right[0] if right else None)
    assert list(held) == plain


def test_only_ranges_of_one_text_are_objects_at_a_time(spark, monkeypatch):
    """Strings stay in the JVM, and a batch is answered in parts of a bounded number of spans."""
    rows = [made(i, n=60) for i in range(40)]
    plan = resolve_spans(frame(spark, rows), direct=0)._jdf.queryExecution().optimizedPlan().toString()
    (call,) = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert "_ordered" in call and ".start" in call and ".end" in call and "value" not in call
    monkeypatch.setattr(overlaps, "HELD", 10)
    assert list(overlaps._in_parts([4, 4, 4, 30, 0, 1])) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(overlaps._in_parts([])) == []
