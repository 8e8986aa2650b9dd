import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkscrub.llm import bpe, queries
from sparkscrub.llm.tokens import count_tokens, counter

from .models import sha

ALPHABET = "".join(map(chr, range(256))) + "ΣςİıéñŒ中あ́​🙂ﬁ"
ODD = [None, "", "a", "'s 'll", "<|endoftext|>x<|startoftext|>", "aaaaaaa", "ΑΣ ΑΣ", " \t\n", "￿", "x" * 3000]


def texts(n, seed):
    pick = random.Random(seed)
    return ["".join(pick.choice(ALPHABET) for _ in range(pick.randint(1, 60))) for _ in range(n)]


def frame(spark, rows):
    # columns with the names of the output, which must not clash
    return spark.createDataFrame([(k, t, 5, "x") for k, t in rows], "doc_id long, text string, n_tokens int, k string")


def test_counts_equal_the_library():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    cases = texts(3000, 1) + [t for t in ODD if t] + [f"a{chr(i)}b{chr(i)}" for i in range(0x3000)]
    expected = [len(e.ids) for e in library.encode_batch(cases, add_special_tokens=False)]
    assert counter(None).count(cases) == expected


def test_long_texts_are_counted_whole():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    long = " ".join(texts(60_000, 2))
    assert counter(None).count([long]) == [len(library.encode(long, add_special_tokens=False).ids)]


def test_count_rows(spark):
    rows = list(enumerate(ODD)) + [(None, "a b"), (3, "'s 'll")]
    got = count_tokens(frame(spark, rows), limit=4).collect()
    expected = [(k, len((t or "").encode()), n, n > 4) for (k, t), n in zip(rows, counter(None).count([t or "" for _, t in rows]))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert count_tokens(frame(spark, rows).limit(0)).collect() == []


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(bpe, "PART", 20)
    monkeypatch.setattr(bpe, "LONG_SPACE", 5)
    monkeypatch.setattr(bpe, "_SPACES", bpe.re.compile(r"\s{5,}"))


def test_parts_encode_like_the_whole(small_parts):
    pick, codec = random.Random(3), bpe.codec(None, None)
    for _ in range(20_000):
        text = "".join(pick.choice("ab1 \n\t's.!é中 ") * pick.choice([1, 1, 2, 8]) for _ in range(pick.randint(1, 50)))
        ids = codec.encode(text)
        assert ids == codec.encoding.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_long_white_space():
    codec = bpe.codec(None, None)
    text = " " * 1_500_000 + "x" + "\n" * 1_000_000
    assert codec.decode(codec.encode(text)) == text.encode()


def test_round_trip_rows(spark):
    rows = list(enumerate(ODD)) + [(None, "a b"), (3, "a b")]
    df = frame(spark, rows)
    got = {(r.doc_id, r.decoded_sha256) for r in bpe.round_trip(df).collect()}
    assert got == {(k, sha(t or "")) for k, t in rows}
    ids = bpe.encode_texts(df)
    back = bpe.decode_ids(ids).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in back) == sorted((str(k), (t or "").encode()) for k, t in rows)
    assert bpe.round_trip(df.limit(0), with_ids=True).collect() == []


def test_long_words_take_seconds():
    """A word of any length, merged from a heap as in rounds."""
    pick = random.Random(8)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    words = ["".join(pick.choice("abcdefghij") for _ in range(n)) for n in (1999, 2000, 2001, 30_000)]
    words += ["a" * 20_001, "ab" * 9000, "the" * 4000, "é😀" * 3000, " ".join(["x" * 2500, "y", "xyz" * 900])]
    start = time.time()
    expected = [len(e.ids) for e in library.encode_batch(words, add_special_tokens=False)]
    assert counter(None).count(words) == expected
    million = "".join(pick.choice("abcdefghijklmnop") for _ in range(1_000_000))
    assert counter(None).count([million]) == [len(library.encode(million, add_special_tokens=False).ids)]
    assert time.time() - start < 60


def test_heap_and_rounds_agree():
    pick, merger = random.Random(9), counter(None).merger
    pieces = ["".join(pick.choice("abcaé") for _ in range(pick.randint(1, 300))).encode() for _ in range(300)]
    assert [merger.count_long(p) for p in pieces] == merger.counts(pieces).tolist()


def test_query_counts_like_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op1_token_counts"](spark, sf).collect()}
    for key, text in docs:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert got[key] == (len((text or "").encode()), n, n > 2048)


def test_byte_bpe_query_gives_the_ids_of_the_library(spark):
    sf, own = "/root/testdata/sf0.001", bpe.codec(None, None).encoding
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op4_byte_bpe"](spark, sf).collect()}
    for key, text in docs:
        ids = own.encode_ordinary(text or "")
        packed = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[key] == (len(ids), packed, sha(text or ""))
