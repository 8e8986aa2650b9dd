"""Filters that are tested before rows move."""

import random

import numpy as np
from pyspark.sql import functions as F

from sparkscrub.operators import matching
from sparkscrub.operators.matching import find_values
from sparkscrub.plans import bitfilter


def test_members_pass_and_few_others(spark):
    rows = spark.range(3000).select(F.xxhash64("id").alias("h"))
    members = bitfilter.bit_filter(rows, 3000)
    hashes = np.array([r.h for r in rows.collect()], np.int64).view(np.uint64)
    assert members.passes(hashes).all()
    others = np.array([r.h for r in spark.range(10**6, 10**6 + 20000).select(F.xxhash64("id").alias("h")).collect()], np.int64)
    assert members.passes(others.view(np.uint64)).mean() < 0.1
    kept = bitfilter.rows_in(spark.range(2500, 10000).withColumn("t", F.lit("x")), F.xxhash64("id"), members)
    assert kept.columns == ["id", "t"] and kept.where("id < 3000").count() == 500 and kept.count() < 1500
    assert bitfilter.bits_for(0) == bitfilter.MIN_BITS and bitfilter.bits_for(10**12) == bitfilter.MAX_BITS


def test_a_full_filter_lets_all_pass(spark, monkeypatch):
    monkeypatch.setattr(bitfilter, "MAX_BITS", 1 << 16)
    rows = spark.range(400_000).select(F.xxhash64("id").alias("h"))
    members = bitfilter.bit_filter(rows, 400_000)
    assert len(members.words) == 1024 and members.passes(np.arange(1000, dtype=np.uint64)).mean() > 0.9


def test_pieces_are_found_wherever_they_stand(spark, monkeypatch):
    monkeypatch.setattr(bitfilter, "CHUNK_CHARS", 50)
    pick = random.Random(3)
    texts = [(i, "".join(pick.choice("abc😀é") for _ in range(pick.randint(0, 60)))) for i in range(80)] + [(90, None)]
    pieces = sorted({t[i : i + n] for _, t in texts[:9] for n in (1, 4, 8) for i in range(0, len(t) - n, 5) if len(t[i : i + n]) == n})
    df = spark.createDataFrame(texts, "id int, text string")
    known = spark.createDataFrame([(p,) for p in pieces], "gram string")
    none = F.lit(0).cast("long")
    members = bitfilter.bit_filter(bitfilter.hashed_pieces(known, "gram", none), len(pieces))
    got = bitfilter.pieces_in(df, "text", ["id"], none, [1, 4, 8], members).collect()
    assert len(got) == len(set(got))
    found = {(r.id, r.gram) for r in got if r.gram in set(pieces)}
    assert found == {(i, p) for i, t in texts if t for p in pieces if p in t}
    assert all(r.gram in dict(texts)[r.id] for r in got)


def test_about_as_many_rows_move_as_there_are_hits(spark, tight, monkeypatch):
    stored = {}
    keep = matching.materialize

    def counted(df, label):
        out = keep(df, label)
        stored[label] = out.count()
        return out

    monkeypatch.setattr(matching, "materialize", counted)
    texts = spark.range(400).selectExpr("id", "id % 4 AS s", "concat(repeat('some plain words ', 20), 'value-', id, '-end') AS text")
    # Known in another scope than the one that holds it: nothing to be found.
    values = spark.range(0, 400, 20).selectExpr("id % 4 + IF(id % 40 = 0, 0, 1) AS s", "concat('value-', id, '-end') AS value")
    got = find_values(texts, values, ["s"], ["id"]).collect()
    assert sorted(r.id for r in got) == list(range(0, 400, 40))
    # A text of 350 characters has about as many pieces.
    assert stored["pieces"] < 100 and stored["found-pieces"] < 100
