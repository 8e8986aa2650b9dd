"""Backtracking BPE, the conversation trie and spelling variants next to plain models."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from checks.compare import connect, difference
from sparkscrub.llm import backtrack, queries, trie, variants

from . import models
from .models import sha

SF = "/root/testdata/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", "a", "'s 'll", "<|endoftext|>x<|endoftext|>", "aaaaaaa", " \t\n", "￿ ՘ ٣४", "x" * 3000, "中あ🙂 ﬁ　."]


# --- backtracking BPE -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


def made_texts(n, seed):
    pick = random.Random(seed)
    wide = "".join(map(chr, range(0x250))) + "ΑΣ中あ🙂ﬁ　 ՘\U0003fc36٣४½"
    out = []
    for i in range(n):
        letters = wide if i % 2 else "ab 's1\n"
        out.append("".join(pick.choice(letters) * pick.choice([1, 1, 2, 5]) for _ in range(pick.randint(1, 40))))
        if i % 50 == 0:
            out[-1] = f"{out[-1][:5]}<|endoftext|>{out[-1][5:]}"
    return out


def test_ids_equal_the_library(library):
    codec = backtrack.codec()
    for text in made_texts(6000, 1) + [t for t in ODD if t]:
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids == expected, text
        assert codec.decode(np.array(ids, np.int64)) == library.decode(expected, skip_special_tokens=False)


def test_every_character_is_cut_like_the_library(library):
    codec = backtrack.codec()
    for code in [*range(0x600), *range(0x600, 0x110000, 97)]:
        if not 0xD800 <= code < 0xE000:
            text = f"a{chr(code)}1{chr(code)}!{chr(code)}{chr(code)} b"
            cut = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
            assert codec.pieces.cut(text) == cut, hex(code)


def test_any_ids_decode_like_the_library(library):
    pick, codec = random.Random(2), backtrack.codec()
    for _ in range(500):
        ids = [pick.randrange(50257) for _ in range(20)]
        assert codec.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)
    assert codec.decode(np.array([70_000, -1])) == ""


def test_long_pieces_take_linear_time(library):
    pick, codec = random.Random(3), backtrack.codec()
    for text in ("a" * 300_000, "".join(pick.choice("abcdefgh") for _ in range(300_000)), " " * 500_000 + "x"):
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_memory_is_forgotten(library, monkeypatch):
    monkeypatch.setattr(backtrack, "MAX_MEMORY", 500)
    monkeypatch.setattr(backtrack, "MAX_PAIRS", 3)
    codec = backtrack.Codec(BYTE_BPE)
    for text in made_texts(200, 4):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(codec.known) < 20


def test_a_vocabulary_must_be_byte_level():
    with pytest.raises(ValueError, match="no byte-level vocabulary"):
        backtrack.Merges({"a": 0}, [])
    letters = {c: i for i, c in enumerate(backtrack.byte_letters())} | {"aaa": 256, "aa": 257}
    with pytest.raises(ValueError, match="two merges"):
        backtrack.Merges(letters, ["a a", ["aa", "a"], ["a", "aa"]])


def test_round_trip_rows(spark, library):
    rows = [*enumerate(ODD), (None, "a b"), (3, "a b"), (3, "a b")]
    df = spark.createDataFrame([(k, t, 5, "x") for k, t in rows], "doc_id long, text string, n_tokens int, ids string")
    expected = []
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        packed = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expected.append((k, len(ids), packed, sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(repr, map(tuple, backtrack.round_trip(df).collect()))) == sorted(map(repr, expected))
    back = backtrack.decode_ids(backtrack.encode_texts(df)).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in back) == sorted((str(k), t or "") for k, t in rows)
    assert backtrack.round_trip(df.limit(0)).collect() == []


def test_query_over_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op11_backtracking_bpe"](spark, SF).collect()}
    assert len(got) == len(docs)
    for key, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[key] == (len(ids), packed, sha(library.decode(ids, skip_special_tokens=False)))


# --- the conversation trie ------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth int, k1 string"


def turn_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)


def made_turns(seed):
    pick = random.Random(seed)
    rows = []
    for conv in [*pick.sample(range(400), 90), -7, -20, -21]:
        for turn in range(pick.choice([1, 1, 2, 3, 5, 9])):
            role, text = pick.choice(["user", "bot", None]), pick.choice(["hi", "hi there", "", None, f"so {conv % 3}"])
            rows.append((conv, pick.choice([turn, turn, turn, None]), role, text))
    # One opening of very many, one very long conversation, whole copies of a short one.
    rows += [(c, t, "user", "same") for c in range(500, 560) for t in range(4)]
    rows += [(777, t, "user", f"line {t % 5}") for t in range(400)] + [(779, t, "user", f"line {t % 5}") for t in range(300)]
    # Ties, repeated rows, rows without a conversation.
    rows += [(888, 1, "b", "x"), (888, 1, "a", "y"), (888, 1, "a", "x"), (888, 1, "a", "x"), (None, 1, "a", "x")]
    pick.shuffle(rows)
    return rows


@pytest.fixture
def many_ranges(spark):
    """Small inputs are dealt to several ranges, too."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "6"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("seed, shards, family", [(1, 1, 20), (2, 5, 20), (3, 40, 20), (4, 13, None)])
def test_trie(spark, many_ranges, monkeypatch, seed, shards, family):
    monkeypatch.setattr(trie, "CHUNK", 7)
    monkeypatch.setattr(trie, "BATCH", 50)
    rows = made_turns(seed)
    turns, convs = trie.turn_digests(turn_frame(spark, rows)), None
    if family:
        turns, convs = trie.share_openings(turns, family)
    got = sorted(map(tuple, trie.prefix_trie(turns, convs, shards).collect()))
    assert got == models.trie_nodes(rows, family)


def test_trie_of_one_in_the_next(spark, many_ranges):
    # Every conversation goes on where a smaller one ends, so totals cross all shards.
    rows = [(c, t, "user", "more") for c in range(60) for t in range(c + 1)]
    turns = trie.turn_digests(turn_frame(spark, rows))
    got = sorted(map(tuple, trie.prefix_trie(turns, None, 30).collect()))
    assert got == models.trie_nodes(rows, None)


def test_empty_trie(spark):
    turns, convs = trie.share_openings(trie.turn_digests(turn_frame(spark, [(None, 1, "a", "b")])))
    assert trie.prefix_trie(turns, convs).collect() == []


def test_a_queue_spills_in_order():
    pick, queue, out = random.Random(5), trie.Messages(limit=10), []
    items = [((pick.randint(0, 50), i), (i,)) for i in range(500)]
    for n, item in enumerate(items):
        queue.push(*item)
        if n == 250:
            out += queue.until((10, 0))
    taken = len(out)
    assert out == sorted(i for i in items[:251] if i[0] <= (10, 0)) and queue.runs
    out += queue.until(None)
    assert sorted(out) == sorted(items) and out[taken:] == sorted(out[taken:])
    assert list(queue.until(None)) == []


def test_trie_query_equals_its_sql(spark):
    name = "op12_conversation_trie"
    assert difference(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) is None


# --- spelling variants ----------------------------------------------------------------------


def made_words(seed, n=400):
    pick, words = random.Random(seed), set()
    while len(words) < n:
        word = "".join(pick.choice("abéÿ") for _ in range(pick.randint(7, 11)))
        words.add(word)
        for _ in range(3):
            at, letter = pick.randrange(len(word)), pick.choice("abcÀ")
            new = pick.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]])
            if len(new) >= 7:
                words.add(new)
    return [(w, pick.choice([2, 3, 20, 40, 500, 9000])) for w in sorted(words)]


@pytest.mark.parametrize("long_list, common", [(16, 0.001), (2, 0.02), (2, 1.0)])
def test_variants(spark, monkeypatch, long_list, common):
    monkeypatch.setattr(variants, "LONG_LIST", long_list)
    rows = made_words(6) + [("abc" * 400, 2), ("abc" * 400 + "d", 30), ("a" * 9, 5), ("a" * 10, 50), ("a" * 11, 500)]
    df = spark.createDataFrame([(w, n, "x") for w, n in rows], "word string, n long, part string")
    got = variants.group_variants(df, common=common).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted(map(tuple, got.collect())) == models.variant_rows(rows)


def test_one_edit_changes_no_more_grams_than_the_bound():
    pick = random.Random(7)
    words = [w for w, _ in made_words(8, 60)]
    counts = {}
    for w in words:
        for q in (variants.SHORT, variants.LONG):
            for i in range(len(w) - q + 1):
                counts[w[i : i + q]] = counts.get(w[i : i + q], 0) + 1
    grams = variants.Grams(counts, 0.05)
    for w in words:
        cut = grams.cut(w)
        bound = grams.bound(cut, len(w))
        assert len(cut) > bound
        for _ in range(60):
            at = pick.randrange(len(w) + 1)
            letter = pick.choice("abéÿc")
            new, shift = pick.choice([(w[:at] + letter + w[at:], 1), (w[:at] + letter + w[at + 1 :], 0), (w[:at] + w[at + 1 :], -1)])
            own = set(grams.cut(new))
            left = [(a, b) for a, b in cut if ((a, b) in own and b <= at) or ((a + shift, b + shift) in own and a >= at)]
            assert len(cut) - len(left) <= bound


def test_words_are_counted(spark):
    rows = [(i, "Another fine MORNING, another one; été façades") for i in range(70)] + [(None, "another morning"), (3, None), (4, "")]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, run string")
    for slips in (None, 31, 2):
        got = sorted(map(tuple, variants.count_words(df, slips=slips).collect()))
        assert got == models.word_counts(rows, slips)
    empty = variants.count_words(df.limit(0))
    assert variants.group_variants(empty).collect() == []


def test_variants_query_equals_the_model(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    expected = models.variant_rows(models.word_counts(docs, 31))
    got = queries.QUERIES["op13_spelling_variants"](spark, SF).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted(map(tuple, got.collect())) == expected
