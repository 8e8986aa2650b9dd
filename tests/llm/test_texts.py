import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkscrub.llm import article, licenses, pii, quality
from sparkscrub.llm.article import article_text, extract_articles

from . import models
from .models import by_key, sha


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 7, "x") for k, t in rows], "doc_id long, text string, score int, kept string")


# --- personal data -----------------------------------------------------------------


def test_base_spans_equal_the_patterns():
    pick = random.Random(1)
    for alphabet in ("a.@b-_ 12+%é(", "0123456789 -.+("):
        for _ in range(30_000):
            text = "".join(pick.choice(alphabet) for _ in range(pick.randint(1, 36)))
            assert pii.base_spans(text) == models.base_spans(text, pii.luhn)


@pytest.mark.parametrize("piece", ["1", "a", "1.", "ab:", "1 ", "a at ", "(12) ", "@", "a@b."])
def test_long_texts_take_linear_time(piece):
    begin = time.perf_counter()
    pii.mentions(piece * (400_000 // len(piece)))
    assert time.perf_counter() - begin < 10


def test_contexts_teach_new_instances(spark):
    def number(i):
        return f"+1 ({200 + i}) 555-0{100 + i}"

    rows = [(i, f"Please call {number(i)} today for item {i}") for i in range(40)]
    rows += [(100, "Please call (345) 555 0199 today for more"), (101, "order (345) 555 0198 shipped"), (102, None), (None, "")]
    rows += [(103, rows[0][1]), (103, rows[0][1])]
    got = {r.doc_id: r for r in pii.personal_data_digest(pii.find_personal_data(frame(spark, rows))).collect()}
    assert got[100].spans == "phone:12:26" and got[100].n_phone == 0 and got[100].base_sha256 == sha("")
    assert got[101].spans == "" and got[102].spans == "" and got[None].spans == ""
    assert got[0].spans == got[103].spans == "phone:12:29" and got[0].n_phone == 1
    assert pii.find_personal_data(frame(spark, [])).collect() == []


def phone(i):
    return f"+1 ({200 + i % 700}) 555-{1000 + i}"


def unseen(i):
    return f"({200 + i % 700}) 555 {1000 + i}"


def added_of(spark, texts):
    found = pii.find_personal_data(frame(spark, list(enumerate(texts))))
    return {r.doc_id for r in found.collect() if r.added}


def test_contexts_with_many_unseen_identifiers(spark):
    """10, 30 and 50 % unseen beside few and many seeds; other numbers stay out."""
    texts, true = [], set()
    cases = [("anna", 45, 5), ("bert", 35, 15), ("carl", 25, 25), ("dora", 5, 5), ("emil", 5, 1)]
    for n, (word, seeds, others) in enumerate(cases):
        texts += [f"{phone(1000 * n + i)} {word}" for i in range(seeds)]
        true |= set(range(len(texts), len(texts) + others))
        texts += [f"{unseen(1000 * n + i)} {word}" for i in range(500, 500 + others)]
    # four seeds; more in doubt than sure; seeds of another kind; failed shapes
    texts += [f"{phone(6000 + i)} few" for i in range(4)] + [f"{unseen(6500)} few"]
    texts += [f"{phone(7000 + i)} part" for i in range(20)] + [f"{unseen(7500 + i)} part" for i in range(40)]
    texts += [f"{phone(5000 + i)} host" for i in range(20)] + [f"10.0.0.{i} host" for i in range(5)] + [f"{unseen(5500)} host"]
    texts += [f"{phone(8000 + i)} code" for i in range(20)] + [f"+1 20 {i} code" for i in range(10, 15)] + [f"{unseen(8500)} code"]
    got = added_of(spark, texts)
    recall, precision = len(got & true) / len(true), len(got & true) / max(1, len(got))
    assert (recall, precision) == (1, 1)


def test_spelled_addresses_are_candidates_by_themselves():
    for one in ("john (at) example.com", "john at example.com", "john[AT]example.com", "a" * 99 + " at example dot com", "john\tat example.com"):
        for rest in ("", " Also a dot b."):
            found = {(k, one[a:b]) for a, k, b in pii.loose_spans(one + rest, []) if b <= len(one)}
            assert found == ({(0, one)} if "\t" not in one else set())
    assert [b - a for a, _, b in pii.loose_spans("a at b.c+dd at e.f", [])] == [8, 9]
    assert pii.loose_spans("we meet at noon", []) == pii.loose_spans("that [cat]a.b", []) == []


def test_digest(spark):
    text = "a.b@c.de 10.0.0.1, 4111 1111 1111 1111 +33 1 23 45 67 89 x@y.zz"
    row = pii.personal_data_digest(pii.find_personal_data(frame(spark, [(1, text)]))).first()
    spans = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in models.base_spans(text, pii.luhn))
    assert tuple(row) == (1, 2, 1, 1, 1, sha(spans), spans)


# --- licences ----------------------------------------------------------------------


def test_stems_cover_all_phrases():
    phrases = [p for p, _ in licenses.BASE_PHRASES]
    assert all(any(s in p for s in licenses._STEMS) for p in phrases)
    assert all(any(s in p for p in own for s in licenses._STEMS) for _, _, own in licenses.NOTICES)


def test_each_notice_is_found(spark):
    rows = [(n, f"Some code.\n{text.title()}, and more.") for n, (_, text, _) in enumerate(licenses.NOTICES)]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    for n, (label, _, _) in enumerate(licenses.NOTICES):
        assert label in got[n].labels.split(",") and 0.5 <= got[n].score <= 1, label


def test_short_mentions_are_found(spark):
    mentions = [
        ("agpl", "GNU Affero General Public License"),
        ("apache-2.0", "the Apache License, 2.0"),
        ("bsd", "BSD license"),
        ("cc-by", "Creative Commons Attribution"),
        ("cc-by-nc", "Attribution-NonCommercial"),
        ("cc-by-sa", "Attribution-ShareAlike"),
        ("cc0", "CC0 1.0"),
        ("gpl", "GNU General Public License"),
        ("lgpl", "GNU Lesser General Public License v2.1"),
        ("lgpl", "distributed under the GNU Lesser General Public License"),
        ("mit", "MIT License"),
        ("mpl-2.0", "Mozilla Public License 2.0"),
    ]
    rows = [(n, f"Some code here.\n{text}, and more.") for n, (_, text) in enumerate(mentions)]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    for n, (label, text) in enumerate(mentions):
        assert label in got[n].labels.split(",") and got[n].score >= 0.5, text


def test_each_notice_has_rare_words(spark):
    index = licenses.notice_index(spark).select("notice").distinct().collect()
    assert len(index) == len(licenses.NOTICES)


def test_license_rows(spark):
    rows = [
        (1, "Licensed under CC BY-NC 4.0."),
        (2, None),
        (3, ""),
        (4, "All all rights reserved ALL RIGHTS RESERVED"),
        (None, "é...cc...by"),
        (5, "the software license is granted with permission, rights and attribution"),
        (6, "Released under the MIT License."),
        (6, "Released under the MIT License."),
        (7, "general public\x00license"),
    ]
    got = by_key(licenses.scan_licenses(frame(spark, rows)).collect())
    assert [r[:6] for r in got] == by_key((k, *models.phrase_places(t, licenses.BASE_PHRASES)) for k, t in rows)
    labels = {r[0]: r[6] for r in got}
    assert labels == {1: "cc-by,cc-by-nc", 2: "", 3: "", 4: "reserved", None: "cc-by", 5: "", 6: "mit", 7: "gpl"}
    assert licenses.scan_licenses(frame(spark, [])).collect() == []


def test_license_phrases_near_their_notice(spark):
    filler = " word" * 60
    texts = {
        "mit": "Released under the MIT license." + filler,
        "": "Released under the license." + filler + " An MIT license elsewhere: MIT, license.",
        # Every place counts by itself, also where a text has very many of them.
        "bsd": ("Released under the BSD license." + filler) * 40,
    }
    notices = [("mit", "released under the mit license", ("mit license", "released under")), *licenses.NOTICES[4:5]]
    rows = [(n, text) for n, text in enumerate(texts.values())]
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(frame(spark, rows), notices=notices).collect()}
    assert [got[n] for n in range(3)] == list(texts)


def test_licenses_move_no_text(spark, tight):
    rows = [(n, f"Some code. {text}, and more.") for n, (_, text, _) in enumerate(licenses.NOTICES)]
    docs = frame(spark, rows).withColumn("k", F.xxhash64("text"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = licenses.confirmed_notices(docs)
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
        moved = [node for node in plan.split("\n\n") if re.search(r"\) Exchange\n", node)]
        assert moved and not any(re.search(r"words|text|around", node) for node in moved)
        assert found.count() >= len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


# --- quality -----------------------------------------------------------------------


def made_texts(seed, n):
    pick = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 8))) for _ in range(pick.randint(60, 200))]
        bad = i % 8 == 0
        out.append((i, " ".join(w + "###" * bad for w in words), int(not bad)))
    return out


def test_base_counts():
    pick = random.Random(2)
    for _ in range(2000):
        text = "".join(pick.choice("ab #\n\t\x0b|é\x85") for _ in range(pick.randint(0, 60)))
        assert quality.statistics(text)[0] == models.base_counts(text)


def test_forest_on_held_out_rows(spark):
    train, test = made_texts(3, 400), made_texts(4, 400)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in train], "doc_id long, quality int, toxic int")
    rows = [(i, t) for i, t, _ in train] + [(1000 + i, t) for i, t, _ in test]
    got = {r.doc_id: r for r in quality.rate_quality(frame(spark, rows), labels).collect()}
    right = [got[1000 + i].kept == bool(q) for i, _, q in test]
    assert np.mean(right) > 0.98
    assert all(got[1000 + i].kept for i, _, q in test if q)


def test_contradictory_labels_say_nothing(spark):
    """Whatever the order of rows, keys that are labelled good and bad are left out."""
    train = made_texts(5, 300)
    sure = [(i, q, 0) for i, _, q in train]
    torn = [(i, 1 - q, 0) for i, q, _ in sure[:100]]
    docs = frame(spark, [(i, t) for i, t, _ in train])

    def scores(rows):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        return sorted((r.doc_id, r.score) for r in quality.rate_quality(docs, labels).collect())

    expected = scores(sure[100:])
    assert scores(sure + torn) == scores(torn + sure[::-1] + sure) == expected


def test_quality_rows(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, good), (3, good), (None, good), (4, "a b c " * 30), (5, "a " * 49)]
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    got = by_key(quality.rate_quality(frame(spark, rows), labels).select("doc_id", "n_words", "kept").collect())
    assert got == by_key(
        [(1, 0, False), (2, 0, False), (3, 60, True), (3, 60, True), (None, 60, True), (4, 90, False), (5, 49, False)]
    )
    assert quality.rate_quality(frame(spark, []), labels.limit(0)).collect() == []


# --- pages -------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home sidebar-left">
<header><h1>Site</h1></header><nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies for many reasons, please agree to all of them.</div>
<div class=adBox><p>Buy now, the offer ends today, do not wait any longer than that!</div>
<article><header><h1>The &amp; title</h1></header><p>First <b>bold paragraph with words,
  on two lines.<p>Second&nbsp;one, a < b &lt; c<br>after a break.<script>var x = "<p>no</p>";</script>
<form><p>Your name</form><ul><li>one item<li>another item</ul>
<div id="comments"><p>Reader one says that this is a very good article indeed.</p></div></article>
<aside>More to read</aside><footer>&copy; all</footer><div hidden>secret</div><!-- <p>gone</p> --><p <a"""
TEXT = "The & title First bold paragraph with words, on two lines. Second one, a < b < c after a break. one item another item"


def test_article():
    assert article_text(PAGE) == TEXT
    assert article_text("plain 1 < 2 text") == "plain 1 < 2 text"
    assert article_text("<p>" * 100_000 + "x") == "x"
    assert article_text("<div>" * 50_000 + "x") == "x"
    assert article_text("<script>only") == article_text(" ") == article_text("<a 'b" * 2000) == ""


BODY = "<p>The first paragraph tells a story in many words.</p><p>The second one goes on with it for a while.</p>"
STORY = "The first paragraph tells a story in many words. The second one goes on with it for a while."


@pytest.mark.parametrize(
    "wrapper",
    [
        '<div style="overflow:hidden">',
        '<div data-state="hidden" title="the hidden coast">',
        "<div title='class=sidebar id=comments'>",
        '<div data-role="navigation" data-x=a/hidden>',
        '<div class="content has-sidebar">',
        '<div class="post comments-open">',
        '<section id="widget"><article>',
        '<div class="has-sidebar"><main>',
        '<article><div class="with-sidebar">',
    ],
)
def test_wrappers_of_the_article_stay(wrapper):
    assert article_text(f"<body>{wrapper}{BODY}</body>") == STORY


def test_words_of_links_stay():
    page = '<p>We wrote <a href="/list?id=comments">a long list</a> of <a title="a hidden one">things</a> for all.</p>'
    assert article_text(page) == "We wrote a long list of things for all."


@pytest.mark.parametrize(
    "noise",
    [
        "<div hidden>{}</div>",
        "<div HIDDEN=''>{}</div>",
        "<div title='x' aria-hidden = 'true'>{}</div>",
        "<div role=navigation>{}</div>",
        "<div class='sidebar'>{}</div>",
        "<div id=comments><article class=comment>{}</article></div>",
    ],
)
def test_noise_beside_the_article_goes(noise):
    other = noise.format("<p>Something else that stands beside it.</p>")
    assert article_text(f"<body><article>{BODY}</article>{other}</body>") == STORY
    assert article_text(f"<body><main><article>{BODY}</article>{other}</main></body>") == STORY
    long = noise.format("<p>Something that many readers said of it at length.</p>" * 9)
    if "<article" not in noise:
        assert article_text(f"<body><article>{BODY}{other}</article>{other}</body>") == STORY
        if "sidebar" not in noise:
            assert article_text(f"<body><article>{BODY}</article>{long}</body>") == STORY


def test_link_lists_stay_out():
    links = "<div>" + "".join(f"<a href={i}>Another story {i}</a> " for i in range(20)) + "</div>"
    body = "<div>" + "<p>A paragraph with many words that tell something of interest to us.</p>" * 5 + "</div>"
    assert article_text(f"<body>{links}{body}{links}</body>") == " ".join(
        ["A paragraph with many words that tell something of interest to us."] * 5
    )


def test_article_rows(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", PAGE, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_articles(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert by_key(got.collect()) == by_key([(1, "u", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (None, "v", "", 0)])
    assert extract_articles(df.limit(0)).collect() == []


_LONG = "long text of the story goes on here. " * 20


@pytest.mark.parametrize(
    "page",
    [
        "<article><h1>Title</h1><div><h2>One</h2><p>{}</p></div><div><h2>Two</h2><p>Short end.</p></div><p>By Ann.</p></article>",
        "<nav>menu</nav><main><h1>Title</h1><div><h2>One</h2><p>{}</p></div><section><h2>Two</h2><p>Short end.</p></section><p>By Ann.</p></main>",
        "<body><div id=content><div><h1>Title</h1><div><h2>One</h2><p>{}</p></div><div><h2>Two</h2><p>Short end.</p></div>"
        "<p>By Ann.</p></div></div><footer>foot <a href=x>y</a></footer></body>",
    ],
)
def test_whole_articles(page):
    """Titles, short sections and bylines around the densest block stay."""
    text = article.article_text(page.format(_LONG))
    assert text == f"Title One {_LONG.strip()} Two Short end. By Ann."


def test_lists_of_links_and_noise_do_not_join_the_article():
    links = "".join(f"<li><a href='/{i}'>Other story {i}</a></li>" for i in range(9))
    page = f"<body><div><h2>One</h2><p>{_LONG}</p></div><ul>{links}</ul><div class=sidebar>aside</div></body>"
    assert article.article_text(page) == f"One {_LONG.strip()}"


def test_no_text_of_the_given_pages_is_lost(spark):
    """Every text outside noise that stands in the page's article is in the result."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()
    for (html,) in pages:
        page = article.Page(html or "")
        cores = [i for i in page.cores if not page.noise[i]]
        text = page.article()
        for i, own in page.texts:
            above = i
            while above > 0 and above not in cores:
                above = page.parent[above]
            if above in cores and not page.noise[i] and len(cores) == 1:
                assert own in text


def test_the_threshold_of_a_forest_comes_from_all_labelled_rows(spark, monkeypatch):
    """More labelled rows than the trees take: quantiles, rates and the threshold are those of all of them."""
    train = made_texts(6, 600)
    docs = frame(spark, [(i, t) for i, t, _ in train])
    labels = spark.createDataFrame([(i, q) for i, _, q in train], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "calibrated", lambda *a, f=quality.calibrated: seen.append(a) or f(*a))
    forest = quality.fit_forest(docs, labels, trees=3, sample=16)
    stats = [(quality.statistics(t), q) for _, t, q in train]
    stats = [(f, q) for (c, f), q in stats if not quality.base_failed(c, 50, 50)]
    good = np.array([f for f, q in stats if q])
    low, high = np.quantile(good, [0.001, 0.999], axis=0)
    assert np.allclose(forest.low, low - 0.5 * (high - low)) and np.allclose(forest.high, high + 0.5 * (high - low))
    assert (seen[0][2].sum(), seen[0][3].sum()) == (len(good), len(stats) - len(good))
