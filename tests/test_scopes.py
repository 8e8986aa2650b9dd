"""Group scope against brute force: folded maps, looked-up values, hot scopes, large maps."""

import random

import pytest

from sparkscrub.operators import matching
from sparkscrub.operators.matching import find_values
from sparkscrub.operators.scopes import scope_keys, scrub_with_keys
from sparkscrub.operators.scrub import scrub
from sparkscrub.plans import sizing
from tests import models

VALUES = ["user{}@example.com", "10.0.{}.1", "+1 (345) 555-{:04d}", "123-45-{:04d}", "n{}", "SSN", "US", "N> x", "é{}😀", "a{}"]


def corpus(seed, rows=80):
    """Texts full of pieces of each other's values; scope ``hot`` holds most of them."""
    rnd = random.Random(seed)
    out = []
    for i in range(rows):
        scope = "hot" if i % 3 else rnd.choice(["a", "b", None])
        words = [rnd.choice(VALUES).format(rnd.randrange(30)) for _ in range(rnd.randrange(6))]
        text = rnd.choice([" ", "", ", "]).join(words + rnd.choice([["SSN"], ["x"], [], ["<US_SSN>"]]))
        out.append((i, scope, text))
    return out


def some_keys(rows, seed):
    rnd = random.Random(seed)
    keys = {}
    for scope in {r[1] for r in rows}:
        pool = {rnd.choice(VALUES).format(rnd.randrange(30)) for _ in range(40)} | {"SSN", "S", "S_S", ">", "n1"}
        keys[scope] = {v: rnd.choice(["<US_SSN>", "<PERSON>", "<URL>"]) for v in pool}
    return keys


def expected(rows, keys):
    return {i: models.replace_all(t, keys.get(s, {})) for i, s, t in rows}


@pytest.mark.parametrize("max_folded", [0, 10, 1000])
@pytest.mark.parametrize("large", [False, True])
def test_scrub_with_keys(spark, request, max_folded, large):
    if large:
        request.getfixturevalue("tight")
    rows = corpus(1)
    keys = some_keys(rows, 2)
    df = spark.createDataFrame(rows, "id int, scope string, text string")
    flat = [(s, v, p) for s, m in keys.items() for v, p in m.items()]
    table = spark.createDataFrame(flat, "scope string, value string, placeholder string")
    got = scrub_with_keys(df, table, ["scope"], ["id"], max_folded_keys=max_folded)
    assert got.columns == ["id", "scope", "text", "masked"]
    assert {r["id"]: r["masked"] for r in got.collect()} == expected(rows, keys)


@pytest.mark.parametrize("max_folded", [0, 1000])
def test_scope_of_everything(spark, tight, max_folded):
    """One scope holds all rows; values spread to rows where they were not detected."""
    rows = [(i, f"mail user{i}@example.com xuser{i + 1}@example.comx 10.0.0.{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string").selectExpr("*", "1 AS one")
    got = scrub(df, scope=["one"], key=["id"], max_folded_keys=max_folded).collect()
    detected = {}
    for r in scope_keys(df, ["one"]).collect():
        detected[r["value"]] = r["placeholder"]
    assert len(detected) > 100
    assert {r["id"]: r["masked"] for r in got} == {i: models.replace_all(t, detected) for i, t in rows}


def test_missing_scope_is_masked(spark):
    df = spark.createDataFrame([(1, None, "a@b.org"), (2, None, "xa@b.orgx"), (3, "s", "a@b.orgx")], "id int, s string, text string")
    got = {r["id"]: r["masked"] for r in scrub(df, scope=["s"], key=["id"]).collect()}
    assert got[1] == "<EMAIL_ADDRESS>" and "a@b.org" not in got[2]


def test_scope_needs_a_key(spark):
    with pytest.raises(ValueError):
        scrub(spark.createDataFrame([("a", "b")], "s string, text string"), scope=["s"])


def test_html_and_text_parts_in_one_scope(spark):
    rows = [
        (1, 0, "text", "write to bob@x.com"),
        (1, 1, "html", '<a href="mailto:bob@x.com">bob@x.com</a> &amp; ann@y.org'),
        (1, 2, "text", "from ann@y.org"),
        (2, 0, "text", "nothing"),
    ]
    df = spark.createDataFrame(rows, "m int, n int, kind string, text string")
    for folded in (0, 100):
        got = scrub(df, scope=["m"], key=["m", "n"], kind="kind", max_folded_keys=folded).orderBy("m", "n").collect()
        assert [r["masked"] for r in got] == [
            "write to <EMAIL_ADDRESS>",
            '<a href="mailto:&lt;EMAIL_ADDRESS&gt;">&lt;EMAIL_ADDRESS&gt;</a> &amp; &lt;EMAIL_ADDRESS&gt;',
            "from <EMAIL_ADDRESS>",
            "nothing",
        ]


@pytest.mark.parametrize("large", [False, True])
def test_find_values(spark, request, large):
    if large:
        request.getfixturevalue("tight")
    rnd = random.Random(5)
    alphabet = "ab.é😀\n\\E$"
    texts = [(i, "".join(rnd.choices(alphabet, k=rnd.randrange(40)))) for i in range(60)] + [(99, "")]
    values = list({"".join(rnd.choices(alphabet, k=rnd.randrange(1, 12))) for _ in range(150)} | {t[2:14] for _, t in texts[:20]})
    df = spark.createDataFrame(texts, "id int, text string")
    known = spark.createDataFrame([(v,) for v in values], "value string")
    got = sorted((r["id"], r["value"]) for r in find_values(df, known, [], ["id"]).collect())
    assert got == sorted((i, v) for i, t in texts for v in values if v and v in t)


def test_find_no_values(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    assert find_values(df, spark.createDataFrame([("",)], "value string"), [], ["id"]).count() == 0


def test_salted_join(spark, tight):
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(40)], "id int, k string")
    right = spark.createDataFrame([("hot", 1), ("k2", 2), ("none", 3)], "k string, v int")
    hot = sizing.hot_keys(left, ["k"])
    assert [r["k"] for r in hot.collect()] == ["hot"] and hot.first()["_salts"] == 7
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(tuple, left.join(right, ["k"], how).collect()), key=repr)
        salted = sorted(map(tuple, sizing.salted_join(left, right, ["k"], hot, ["id"], how).collect()), key=repr)
        assert plain == salted


def test_few_hot_keys_reach_the_driver(spark):
    """However many keys there are, fewer than 1 / share of them can be hot."""
    df = spark.range(2000).selectExpr("id % 700 AS k")
    assert sizing.hot_keys(df, ["k"], min_rows=0, share=0.01) is None
    assert sizing.hot_keys(df.selectExpr("k % 50 AS k"), ["k"], min_rows=0, share=0.01).count() <= 100


def test_scopes_differ_by_microseconds_and_separators(spark):
    rows = [("2024-01-01 00:00:00.123001", "a|", "b", "a@b.org"), ("2024-01-01 00:00:00.123999", "a", "|b", "x a@b.orgs")]
    df = spark.createDataFrame(rows, "ts string, `p q` string, r string, text string").selectExpr(
        "cast(ts AS timestamp) AS ts", "`p q`", "r", "text", "monotonically_increasing_id() AS id"
    )
    for scope in (["ts"], ["p q", "r"]):
        keys = scope_keys(df.limit(1), scope, entities=["EMAIL_ADDRESS"])
        got = scrub_with_keys(df, keys, scope, ["id"]).orderBy("id").collect()
        assert [r["masked"] for r in got] == ["<EMAIL_ADDRESS>", "x a@b.orgs"]


@pytest.mark.parametrize("large", [False, True])
def test_values_that_begin_alike(spark, request, large):
    """Of n links in one text, each is compared where it stands, not all with all."""
    if large:
        request.getfixturevalue("tight")
    links = ["https://example.com/" + "p" * i + f"-{i}" for i in range(200)]
    texts = spark.createDataFrame([(1, " ".join(links)), (2, links[7] + "x"), (3, "https://example.com/")], "id int, text string")
    values = spark.createDataFrame([(v,) for v in links], "value string")
    got = find_values(texts, values, [], ["id"]).collect()
    assert sorted((r["id"], r["value"]) for r in got) == sorted(
        (i, v) for i, t in ((1, " ".join(links)), (2, links[7] + "x")) for v in links if v in t
    )
    anchors = matching._anchors(values, []).groupBy("gram").count().agg({"count": "max"}).first()[0]
    assert anchors <= 2


def test_values_that_differ_in_few_places(spark, tight, monkeypatch):
    """Phone numbers that end alike: a text meets its own ones, not all that share an ending."""
    stored = {}
    keep = matching.materialize

    def counted(df, label):
        out = keep(df, label)
        stored[label] = out.count()
        return out

    monkeypatch.setattr(matching, "materialize", counted)
    numbers = [f"+1 ({200 + i}) 555-{j:04}" for i in range(60) for j in range(5)]
    texts = spark.createDataFrame(list(enumerate(f"call {n}." for n in numbers)), "id int, text string")
    values = spark.createDataFrame([(n,) for n in numbers], "value string")
    got = find_values(texts, values, [], ["id"]).collect()
    assert sorted((r["id"], r["value"]) for r in got) == list(enumerate(numbers))
    assert stored["found-pieces"] < 2 * len(numbers)


def test_texts_stay_where_they_are(spark, tight):
    """Values are compared with what stands around their pieces: texts do not follow, passing tables go."""
    rnd = random.Random(8)
    values = [f"number-{i:05}" for i in range(60)]
    texts = [(i, f"{rnd.choice(values)}x, {rnd.choice(values)}{rnd.choice(values)}{' or so' * 30}") for i in range(40)]
    df = spark.createDataFrame(texts, "id int, text string")
    known = spark.createDataFrame([(v, f"<{i}>") for i, v in enumerate(values)], "value string, placeholder string")
    before = len(sizing._stored)
    found = find_values(df, known, [], ["id"], keep=["placeholder"])
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "Exchange" not in plan and "MapInArrow" not in plan
    labels = [path.rpartition("/")[2].rpartition("-")[0] for _, path in sizing._stored[before:]]
    assert labels == ["anchors", "found-pieces"]
    got = sorted((r["id"], r["value"], r["placeholder"]) for r in found.collect())
    assert got == sorted((i, v, f"<{n}>") for i, t in texts for n, v in enumerate(values) if v in t)


def test_values_of_all_lengths_together(spark, tight, monkeypatch):
    """Short and long values are looked up beside those that stand in a stretch; pieces may all be shared."""
    monkeypatch.setattr(matching, "WEIGHED", 4)
    rnd = random.Random(9)
    base = "".join(rnd.choices("ab😀", k=300))
    cuts = {base[i : i + n] for n in (1, 3, 7, 8, 9, 16, 17, 40, 64, 65, 90) for i in rnd.sample(range(200), 8)}
    texts = [(i, base[rnd.randrange(150) :][: rnd.randrange(140)] + rnd.choice(["", "a" * 70, base])) for i in range(30)]
    df = spark.createDataFrame([*texts, (98, None), (99, "")], "id int, text string")
    known = spark.createDataFrame([(v,) for v in sorted(cuts)], "value string")
    got = sorted((r["id"], r["value"]) for r in find_values(df, known, [], ["id"]).collect())
    assert got == sorted((i, v) for i, t in texts for v in cuts if v in t)
