import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkscrub.catalog import RANK
from sparkscrub.functions import mask, spans
from sparkscrub.operators.scrub import mask_fragments, scrub, scrub_by_position
from tests import models

FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

FIXED = [
    ("Ann Lee and Ann", {"Ann Lee": "<PERSON>", "Ann": "<PERSON>"}, "<PERSON> and <PERSON>"),
    ("Annual Ann", {"Ann": "<PERSON>"}, "<PERSON>ual <PERSON>"),
    ("SSN 1", {"1": "<X>", "SSN": "<Y>"}, "<Y> <X>"),
    ("123-45-6789 SSN", {"123-45-6789": "<US_SSN>", "SSN": "<NRP>"}, "<US_<NRP>> <NRP>"),
    ("ann Ann", {"Ann": "<PERSON>"}, "ann <PERSON>"),
    ("a.b axb", {"a.b": "<URL>"}, "<URL> axb"),
    ("$1 \\1", {"$1": "<X>", "\\": "<Y>"}, "<X> <Y>1"),
    ("text", {}, "text"),
    ("", {"a": "<X>"}, ""),
    ("same <X>", {"": "<Y>", "<X>": "<X>"}, "same <X>"),
]


def test_fixed_cases(spark):
    df = spark.createDataFrame([(t, m, e) for t, m, e in FIXED], "t string, m map<string,string>, e string")
    for r in df.withColumn("got", mask.mask_with_map("t", "m")).collect():
        assert r["got"] == r["e"]


def test_no_map_no_text(spark):
    df = spark.createDataFrame([(None, {"a": "b"}), ("a", None)], "t string, m map<string,string>")
    assert [r[0] for r in df.select(mask.mask_with_map("t", "m")).collect()] == [None, "a"]


words = st.text(alphabet="abAN<>_SU é😀", min_size=0, max_size=12)
keys = st.dictionaries(st.text(alphabet="abAN<>_SU é😀", max_size=3), st.sampled_from(["<US_SSN>", "<NRP>", "<A>", "b"]), max_size=5)


@FEW
@given(st.lists(st.tuples(words, keys), min_size=30, max_size=60))
def test_fold_is_the_model(spark, rows):
    df = spark.createDataFrame(rows, "t string, m map<string,string>")
    got = [r[0] for r in df.select(mask.mask_with_map("t", "m")).collect()]
    assert got == [models.replace_all(t, m) for t, m in rows]


TYPES = ["URL", "PERSON", "US_SSN"]
SPAN = st.tuples(st.integers(0, 16), st.integers(0, 7), st.sampled_from(TYPES)).map(
    lambda s: (s[0], s[0] + s[1], s[2], "v")
)


@FEW
@given(st.lists(st.lists(SPAN, max_size=8), min_size=30, max_size=60))
def test_overlaps_and_splicing_are_the_model(spark, rows):
    text = "abcdefghijklmnopqrstuvwxyz"
    df = spark.createDataFrame([(text, r) for r in rows], f"t string, s {spans.SPANS_TYPE}")
    out = df.select(
        spans.resolve_overlaps("s").alias("kept"),
        mask.mask_spans("t", spans.resolve_overlaps_sql("s")).alias("masked"),
    ).collect()
    for r, given_spans in zip(out, rows):
        kept = models.resolve(given_spans, RANK)
        assert [tuple(s) for s in r["kept"]] == kept
        assert r["masked"] == models.splice(text, kept, RANK)


def test_overlap_threshold(spark):
    def kept(*pairs):
        rows = [(s, e, "URL", "v") for s, e in pairs]
        df = spark.createDataFrame([(rows,)], f"s {spans.SPANS_TYPE}")
        return [(s["start"], s["end"]) for s in df.select(spans.resolve_overlaps("s")).first()[0]]

    assert kept((0, 4), (2, 6)) == [(0, 4), (2, 6)]  # half of the smaller: both stay
    assert kept((0, 6), (2, 5)) == [(0, 6)]
    assert kept((0, 4), (2, 2)) == [(0, 4), (2, 2)]  # an empty span overlaps nothing


PIECES = st.sampled_from(
    ["bob@x.com", "10.0.0.1", "4111111111111111", "+1 (345) 555-1234", " ", "a", "é", "😀", ", ", "1", "@", "x1", "\n"]
)


@FEW
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=30, max_size=60))
def test_positions_point_at_the_values(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", spans.detect_spans("t").alias("s"), mask.mask_text("t").alias("m")).collect():
        for s in r["s"]:
            assert r["t"][s["start"] : s["end"]] == s["value"]
        assert [s["start"] for s in r["s"]] == sorted(s["start"] for s in r["s"])
        best = {}
        for s in r["s"]:
            if s["value"] not in best or RANK[s["entity_type"]] < RANK[best[s["value"]]]:
                best[s["value"]] = s["entity_type"]
        assert r["m"] == models.replace_all(r["t"], {v: f"<{t}>" for v, t in best.items()})


def test_rank_decides(spark):
    df = spark.createDataFrame([("123456789 and 4111111111111111",)], "t string")
    assert df.select(spans.replacement_map("t")).first()[0] == {
        "4111111111111111": "<CREDIT_CARD>",
        "123456789": "<US_PASSPORT>",
    }


def test_position_masking_leaves_placeholders_alone(spark):
    df = spark.createDataFrame([("SSN 123-45-6789 SSN",)], "text string")
    terms = {"NRP": ["SSN"]}
    assert scrub(df, terms=terms).first()["masked"] == "<NRP> <US_<NRP>> <NRP>"
    assert scrub_by_position(df, terms=terms).first()["masked"] == "<NRP> <US_SSN> <NRP>"


def test_fragments(spark):
    df = spark.createDataFrame([(1, "Ann\nLee\nAnn Lee\n")], "id int, text string")
    rows = mask_fragments(df, terms={"PERSON": ["Ann Lee"]}).orderBy("fragment_no").collect()
    assert [(r["fragment_no"], r["fragment"], r["masked"]) for r in rows] == [
        (0, "Ann", "Ann"),
        (1, "Lee", "Lee"),
        (2, "Ann Lee", "<PERSON>"),
        (3, "", ""),
    ]


def test_headers(spark):
    headers = [(0, "To", "Ann"), (1, "content-type", "Ann"), (2, "Ann", ""), (3, "Received", "by Ann"), (4, "Received", "x")]
    df = spark.createDataFrame(
        [(headers, [("Ann", "<PERSON>")])],
        "h array<struct<ord:int,name:string,value:string>>, k array<struct<value:string,placeholder:string>>",
    )
    got = [tuple(h) for h in df.select(mask.mask_headers("h", "k")).first()[0]]
    assert got == [(0, "To", "<PERSON>"), (2, "Ann", ""), (3, "Received", "by <PERSON>"), (4, "Received", "x")]


@pytest.mark.parametrize(
    "name, kind, suffix",
    [("a.tar.gz", None, ".gz"), ("a", None, ""), (None, None, ".bin"), ("a", "text", ".txt"), (None, "text", ".txt"),
     ("a.csv", "text", ".csv"), ("a.doc", "docx", ".docx"), ("a", "pdf", ".pdf"), (".profile", "text", ".txt"), ("a.", None, "")],
)
def test_filenames(spark, name, kind, suffix):
    df = spark.createDataFrame([(name,)], "n string")
    for salt in (None, "s"):
        got = df.select(mask.pseudonymize_filename("n", kind, salt)).first()[0]
        assert re.fullmatch("[0-9a-f]{12}" + re.escape(suffix), got), got
    again = [df.select(mask.pseudonymize_filename("n", kind, "s")).first()[0] for _ in range(2)]
    assert again[0] == again[1]


def test_row_scope_plan(spark):
    """No shuffle and no Python in the row-wise job, and only the needed columns are read."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = scrub(df).select("doc_id", "masked").where(F.col("doc_id") > 5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text and "GreaterThan(doc_id,5)" in text


@pytest.mark.parametrize("separator", ["\n", "|", "$.", "\\"])
def test_fragments_across(spark, separator):
    """Put together, fragments are the masked text, wherever it is cut."""
    pick = random.Random(7)
    whole = ["mail a.b@c.org or 1.2.3.4 (a.b@c.org)", "1.2.3.4", "", "+1 (212) 555-0100, b@c.org$1 x", "none", "é😀 1.2.3.4😀"]
    rows = []
    for i in range(60):
        text, at = pick.choice(whole), 0
        cut = sorted(pick.choices(range(len(text) + 1), k=pick.randint(0, 5)))
        pieces = [text[a:b] for a, b in zip([0, *cut], [*cut, len(text)])]
        rows.append((i, text, separator.join(pieces), len(pieces)))
    df = spark.createDataFrame([*rows, (90, None, None, 0)], "id int, whole string, text string, n int")
    chosen = ["EMAIL_ADDRESS", "IP_ADDRESS", "PHONE_NUMBER"]
    want = {r.id: r.masked for r in scrub(df.drop("text"), "whole", entities=chosen).collect()}
    got = mask_fragments(df, separator=separator, entities=chosen, across=True).orderBy("id", "fragment_no").collect()
    together = {}
    for r in got:
        if r.fragment_no is not None:
            together.setdefault(r.id, []).append((r.fragment, r.masked))
    for i, text, cut, n in rows:
        assert len(together[i]) == n and separator.join(f for f, _ in together[i]) == cut
        assert "".join(m for _, m in together[i]) == want[i]


def test_fragments_across_need_a_separator(spark):
    df = spark.createDataFrame([("a",)], "text string")
    for separator in ("", "E", "<"):
        with pytest.raises(ValueError):
            mask_fragments(df, separator=separator, entities=["URL"], across=True)


def test_keys_and_spans_are_ordered_without_a_comparison_by_expressions(spark):
    from sparkscrub.functions.spans import keys_sql, spans_sql

    plan = spark.sql(f"SELECT {keys_sql('t')} AS k, {spans_sql('t')} AS s FROM VALUES ('a@example.com') AS v(t)")
    assert "array_sort" not in plan._jdf.queryExecution().analyzed().toString()
