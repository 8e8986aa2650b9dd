import random

import pytest

from sparkscrub.llm import lines, simhash
from sparkscrub.llm.components import connected_components
from sparkscrub.llm.decontaminate import benchmark_hits, contamination, without_contaminated
from sparkscrub.llm.substrings import COVERS, remove_repeats

from . import models
from .models import by_key

SCHEMA = "doc_id long, text string, k string, fp int, band int"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1, 2) for k, t in rows], SCHEMA)


def test_components(spark):
    pick = random.Random(1)
    edges = [(pick.randint(0, 300), pick.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 460)]
    edges += [(5, 5), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    nodes = sorted({x for e in edges if None not in e and e[0] != e[1] for x in e})
    links = {frozenset(e) for e in edges}
    roots = models.components(len(nodes), lambda i, j: frozenset((nodes[i], nodes[j])) in links)
    assert got == {n: nodes[r] for n, r in zip(nodes, roots)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def near_copies(seed, n=120):
    pick = random.Random(seed)
    base = [[f"w{pick.randint(0, 900)}" for _ in range(pick.choice([3, 40, 400]))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = list(pick.choice(base)) if i % 3 else [f"v{pick.randint(0, 900)}" for _ in range(60)]
        for _ in range(pick.choice([0, 0, 1, 3])):
            words[pick.randrange(len(words))] = f"X{pick.randint(0, 99)}"
        rows.append((pick.randint(0, 90), pick.choice([" ", "\n", "  "]).join(words)))
    return rows + [(None, rows[0][1]), (None, None), (95, None), (94, ""), rows[1], rows[1]]


def test_masks_cover_every_pair():
    pick = random.Random(2)
    masks = simhash.covering_masks(list(range(64)), 4)
    inner = simhash.split_masks(masks[5], 4)
    free = [i for i in range(64) if not masks[5] >> i & 1]
    for _ in range(5000):
        bits = sum(1 << i for i in pick.sample(range(64), 4))
        assert any(not m & bits for m in masks)
        bits = sum(1 << i for i in pick.sample(free, 4))
        assert any(not m & bits for m in inner)


@pytest.mark.parametrize("bucket", [4096, 2])
def test_simhash(spark, monkeypatch, bucket):
    rows = near_copies(3)
    monkeypatch.setattr(simhash, "MAX_BUCKET", bucket)
    monkeypatch.setattr(simhash.fingerprint_links, "__defaults__", (bucket,))
    got = simhash.simhash_components(frame(spark, rows))
    assert by_key(got.collect()) == by_key(models.simhash_rows(rows))
    kept = simhash.keep_one(frame(spark, rows), got)
    groups = {r[2] for r in models.simhash_rows(rows)}
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, groups))
    assert kept.columns == ["doc_id", "text", "k", "fp", "band"]


def test_simhash_empty(spark):
    assert simhash.simhash_components(frame(spark, [])).collect() == []
    assert simhash.without_near_copies(frame(spark, [])).collect() == []


def test_every_component_keeps_a_row(spark):
    """Null keys, one key with unrelated texts, and any order of rows."""
    pick = random.Random(6)
    a, b, c, d, e = (" ".join(f"w{pick.randint(0, 900)}" for _ in range(60)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (5, d), (2, d), (3, e), (None, e), (3, c)]
    expected = [(None, a), (None, b), (2, d), (3, c), (3, e)]
    for order in (rows, rows[::-1]):
        kept = simhash.without_near_copies(frame(spark, order).repartition(3))
        assert kept.columns == ["doc_id", "text", "k", "fp", "band"]
        assert by_key(kept.select("doc_id", "text").collect()) == by_key(expected)
    rows = near_copies(7)
    kept = simhash.without_near_copies(frame(spark, rows)).collect()
    roots = {}
    prints = [simhash.fingerprint(t or "", 4) for _, t in rows]
    for i, root in enumerate(models.components(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)):
        roots.setdefault(root, []).append(i)
    assert len(kept) == len(roots)
    for group in roots.values():
        keys = [rows[i][0] for i in group if rows[i][0] is not None]
        found = [r for r in kept if any((r.doc_id, r.text) == rows[i] for i in group)]
        assert [r.doc_id for r in found] == [min(keys, default=None)]


@pytest.mark.parametrize("window", [50, 12, 6, 1])
def test_repeats(spark, window):
    pick = random.Random(window)
    words = ["a", "B", "É"] + [f"w{i}" for i in range(30)]
    passages = [[pick.choice(words) for _ in range(n)] for n in (window, window + 1, window + 20, 3 * window)]
    rows = []
    for i in range(60):
        own = [pick.choice(words) for _ in range(pick.choice([0, 3, window, 100]))]
        for _ in range(pick.randint(0, 3)):
            at = pick.randint(0, len(own))
            own[at:at] = pick.choice(passages)[pick.randint(0, 1) :]
        rows.append((pick.randint(0, 50), " \n".join(own if i % 9 else ["x"] * 120)))
    rows += [(1, None), (None, rows[3][1]), (None, None), rows[4], rows[4], (2, "")]
    got = remove_repeats(frame(spark, rows).repartition(3), window=window)
    assert by_key(got.collect()) == by_key(models.unrepeated_rows(rows, window))


def test_covers_and_empty_table(spark):
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert remove_repeats(frame(spark, [])).collect() == []


@pytest.mark.parametrize("tightly", [False, True])
def test_decontamination(spark, tightly, request):
    if tightly:
        request.getfixturevalue("tight")
    pick = random.Random(5)
    words = ["a", "b", "É", "c1"]

    def some(n):
        return pick.choice([" ", "-", ". "]).join(pick.choice(words) for _ in range(n))

    items = [(i, some(n)) for i, n in enumerate([0, 1, 3, 5, 9, 10, 11, 12, 30, 30])] + [(None, "b b b b"), (99, None)]
    rows = [(i, some(pick.choice([0, 1, 5, 9, 10, 40, 200])) + ". " + (items[i % 10][1] if i % 3 else "")) for i in range(60)]
    rows += [(70, None), (None, "x"), (None, items[3][1]), rows[4], rows[4], (5, "other text")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(frame(spark, rows), benchmark)
    expected = models.contaminated_rows(rows, items)
    assert by_key(got.collect()) == by_key(expected)
    kept = without_contaminated(frame(spark, rows), benchmark)
    clean = [(*r, "x", 1, 2) for r, e in zip(rows, expected) if not e[-1]]
    assert by_key(kept.collect()) == by_key(clean)


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(frame(spark, []), none).collect() == []
    assert contamination(frame(spark, [(1, "a b")]), none).first()["contaminated"] is False
    _, runs = benchmark_hits(frame(spark, []), none)
    assert runs.collect() == []


def test_lines(spark):
    pick = random.Random(4)
    base = ["".join(pick.choice("abcdehilopst  éñ中") for _ in range(n)) for n in (5, 12, 60, 300, 400, 500)]

    def changed(line):
        letters = list(line)
        for _ in range(pick.choice([0, 0, 1])):
            letters[pick.randrange(len(letters))] = pick.choice("xyz")
        return "".join(letters)

    def line():
        return pick.choice(["", changed(pick.choice(base)), changed(pick.choice(base)) + " ", str(pick.random()) * 3])

    rows = [(i, "\n".join(line() for _ in range(pick.randint(0, 6)))) for i in range(100)]
    rows += [(None, "abc\nabc"), (500, None), (501, ""), rows[3], rows[3]]
    got = lines.dedup_lines(frame(spark, rows))
    assert by_key(got.collect()) == by_key(models.deduped_lines(rows))
    cut = lines.without_repeated_lines(frame(spark, rows))
    assert by_key(cut.select("doc_id", "text").collect()) == by_key((k, t) for k, _, _, t in models.deduped_lines(rows))
    assert cut.columns == ["doc_id", "text", "k", "fp", "band"]


def test_lines_of_an_empty_table(spark):
    assert lines.dedup_lines(frame(spark, [])).collect() == []


def test_lines_with_many_unlike_neighbours(spark):
    """Lines that share a band but are unlike the first of their bucket are still compared."""
    texts = ["a" * 30 + x * 40 for x in "bcdefg"] + ["g" * 41 + "h", "a" * 30 + "g" * 41]
    rows = list(enumerate(texts))
    got = lines.dedup_lines(frame(spark, rows), bands=12, rows=1)
    assert by_key(got.collect()) == by_key(models.deduped_lines(rows))


def test_lines_changed_in_ways_of_their_own_do_not_meet(spark):
    """Of copies that are unlike the line they were made from, only those are compared that can be similar."""
    pick = random.Random(9)
    base = "".join(pick.choice("abcdehilopst ") for _ in range(400))

    def changed(n):
        letters = list(base)
        for at in pick.sample(range(20, 380), n):
            letters[at] = pick.choice("0123456789")
        return "".join(letters)

    copies = [changed(pick.choice([2, 4, 8, 12])) for _ in range(60)] + [base[: 400 - 5 * i] for i in range(1, 40)]
    copies += [c[:200] + "#" + c[201:] for c in copies[:30]]
    lines_of = spark.createDataFrame(list(enumerate([base, *copies])), "h long, line string")
    stars = spark.createDataFrame([(0, i + 1) for i in range(len(copies))], "a long, b long")
    known = lines._similarities(stars, lines_of, 10, 0.8)
    members = known.selectExpr("a AS first", "b AS h", "b AS part", "j", "size", "fresh", "lead")
    got = {tuple(r) for r in lines._candidates(members, 0.8).collect()}
    sets = [models.char_shingles(c) for c in copies]
    n = range(len(copies))
    similar = {(i + 1, j + 1) for i in n for j in n[i + 1 :] if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert similar <= got
    assert len(got) < len(copies) ** 2 / 6


def test_lines_changed_with_common_words_do_not_all_meet(spark):
    """Copies that are unlike each other are not compared because a word of many stands in them."""
    pick = random.Random(4)
    base = "".join(pick.choice("abcdehilopst ") for _ in range(400))

    def changed():
        own = base
        for at in pick.sample(range(20, 360, 20), 8):
            own = own[:at] + "".join(pick.choice("0123456789") for _ in range(6)) + own[at + 6 :]
        # The same word at one of two places.
        at = pick.choice([0, 380])
        return own[:at] + "EVERYBODYHASTHIS" + own[at + 16 :]

    copies = [changed() for _ in range(80)]
    copies += [c[:5] + "#" + c[6:] for c in copies[:5]]
    lines_of = spark.createDataFrame(list(enumerate([base, *copies])), "h long, line string")
    stars = spark.createDataFrame([(0, i + 1) for i in range(len(copies))], "a long, b long")
    known = lines._similarities(stars, lines_of, 10, 0.8)
    members = known.selectExpr("a AS first", "b AS h", "b AS part", "j", "size", "fresh", "lead")
    got = {tuple(r) for r in lines._candidates(members, 0.8).collect()}
    assert {(i + 1, 81 + i) for i in range(5)} <= got
    assert len(got) < 20
