import random
import time

import pytest
from pyspark.sql import functions as F

from sparkscrub.catalog import DEFAULT_TYPES, ENTITIES, RANK, select_entities
from sparkscrub.functions import detectors, spans
from sparkscrub.functions.detectors import FAMILIES, family_spans, term_families
from sparkscrub.functions.wallets import base58check_sql
from sparkscrub.operators.detect import detect, explode_spans
from sparkscrub.operators.scrub import scrub

CASES = [
    # type, text, expected values
    ("EMAIL_ADDRESS", "Mail bob.k+x@mail.example.co.uk. Not bob@local or @x.com", ["bob.k+x@mail.example.co.uk"]),
    ("EMAIL_ADDRESS", "é a@b.org,c@d.net", ["a@b.org", "c@d.net"]),
    ("PHONE_NUMBER", "+1 (345) 555-1234, (345) 555-1234 and 345-555-1234 or 345.555.1234",
     ["+1 (345) 555-1234", "(345) 555-1234", "345-555-1234", "345.555.1234"]),
    ("PHONE_NUMBER", "+49 30 1234567", ["+49 30 1234567"]),
    ("PHONE_NUMBER", "5551234 and 1+1 and 2024-01-02", []),
    ("CREDIT_CARD", "4111 1111 1111 1111, not 4111111111111112", ["4111 1111 1111 1111"]),
    ("CREDIT_CARD", "4111111111111111 4111-1111-1111-1111 3782 822463 10005",
     ["4111111111111111", "4111-1111-1111-1111", "3782 822463 10005"]),
    ("CREDIT_CARD", "a4111111111111111 in a token", []),
    ("US_SSN", "123-45-6789 000-12-3456 666-12-3456 912-45-6789 123-00-6789 123-45-0000", ["123-45-6789"]),
    ("US_SSN", "0123-45-6789 123-45-67890", []),
    ("DATE_TIME", "On 2024-01-02, 1/2/24, March 3, 2021, 4 Jul 2020 at 10:30 pm; see you tomorrow.",
     ["2024-01-02", "1/2/24", "March 3, 2021", "4 Jul 2020", "10:30 pm", "tomorrow"]),
    ("DATE_TIME", "yesterdays 12024-01-02", []),
    ("URL", "See https://a.example/b?c=1. Or (www.example.com), HTTP://X.Y/z!",
     ["https://a.example/b?c=1", "www.example.com", "HTTP://X.Y/z"]),
    ("IP_ADDRESS", "10.0.0.255 10.0.0.256 1.2.3 1.2.3.4.5", ["10.0.0.255"]),
    ("IP_ADDRESS", "2001:db8::1 fe80:0:0:0:1:2:3:4 10:20:30 a::b::c ::", ["2001:db8::1", "fe80:0:0:0:1:2:3:4"]),
    ("CRYPTO", "1BoatSLRHtKNngkdXEeobR76b53LETtpyT bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq",
     ["1BoatSLRHtKNngkdXEeobR76b53LETtpyT", "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq"]),
    ("CRYPTO", "1Boat0OIl", []),
    ("IBAN_CODE", "GB82WEST12345698765432 GB83WEST12345698765432", ["GB82WEST12345698765432"]),
    ("MEDICAL_LICENSE", "AB1234563 AB1234564", ["AB1234563"]),
    ("US_BANK_NUMBER", "12345678 1234567 123456789012345678 x12345678", ["12345678"]),
    ("US_DRIVER_LICENSE", "Driver license D1000123; driver's licence no. A1234567, D7654321", ["D1000123", "A1234567"]),
    ("US_ITIN", "912-70-1234 912701234 812-70-1234", ["912-70-1234", "912701234"]),
    ("US_PASSPORT", "C12345678 123456789 CC1234567", ["C12345678", "123456789"]),
]


def test_values_and_positions(spark):
    rows = [(i, t, text) for i, (t, text, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, t string, text string")
    found = explode_spans(detect(df)).where("entity_type = t")
    assert found.where("substring(text, start + 1, end - start) <> value").count() == 0
    got = {i: [] for i, _, _ in rows}
    for r in sorted(found.collect(), key=lambda r: (r["i"], r["start"])):
        got[r["i"]].append(r["value"])
    for i, (t, text, expected) in enumerate(CASES):
        assert got[i] == expected, (t, text)


def test_values_without_positions_are_the_same(spark):
    df = spark.createDataFrame([(text,) for _, text, _ in CASES], "text string")
    both = df.selectExpr(
        f"{spans.ranked_values_sql('text')} AS v", f"{spans.spans_sql('text')} AS s"
    ).selectExpr(
        "array_sort(transform(v, x -> x.value)) AS v",
        "array_sort(transform(array_distinct(transform(s, x -> struct(x.value AS value, x.entity_type))), x -> x.value)) AS s",
    )
    assert both.where("v <> s").count() == 0


def test_guards_are_necessary(spark):
    """A text that fails the guard of a type has no hit of the type."""
    df = spark.createDataFrame([(text,) for _, text, _ in CASES], "text string")
    for t in {t for t, _, _ in CASES}:
        open_ = df.where(f"size({spans.ranked_values_sql('text', [t])}) > 0")
        assert open_.where(~spans.may_hold("text", [t])).count() == 0


def test_nothing_to_find(spark):
    df = spark.createDataFrame([(None,), ("",), (" \t\n",), ("plain words",)], "text string")
    assert explode_spans(detect(df)).count() == 0


def test_long_and_odd_texts(spark):
    """No pattern may overflow the stack or take a quadratic time on a long text."""
    odd = ["a." * 40000 + "b@" + "c." * 40000, "1-" * 50000, "a:b:" * 30000, "9" * 100000, "(" * 50000, "x" * 200000]
    df = spark.createDataFrame([(t,) for t in odd], "text string")
    assert detect(df).where("size(spans) >= 0").count() == len(odd)


def test_catalog():
    assert len(ENTITIES) == 17 and sorted(RANK.values()) == list(range(1, 18))
    assert {t for t, _, _ in ENTITIES} == set(RANK)
    assert set(DEFAULT_TYPES) == {"PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "LOCATION", "US_SSN", "CREDIT_CARD"}
    assert len(select_entities(None)) == len(select_entities([])) == 17
    assert select_entities(["URL", "IBAN_CODE"]) == ("IBAN_CODE", "URL")
    with pytest.raises(ValueError):
        select_entities(["NOPE"])


def test_types_not_chosen_leave_no_trace(spark):
    plan = detect(spark.createDataFrame([("x",)], "text string"), entities=["URL"])
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "https?" in text and "IBAN" not in text.replace("IBAN_CODE", "") and "{7,15}" not in text
    assert {r.entity_type for f in FAMILIES for r in f.rules} == set(RANK) - {"PERSON", "LOCATION", "NRP"}


def test_inline_terms(spark):
    df = spark.createDataFrame([("Ann Lee met Annual Ann in New York (C++).",)], "text string")
    terms = {"PERSON": ["Ann", "Ann Lee"], "LOCATION": ["New York", "York"]}
    got = [(r.entity_type, r.value) for r in explode_spans(detect(df, entities=["PERSON", "LOCATION"], terms=terms)).collect()]
    assert got == [("PERSON", "Ann Lee"), ("PERSON", "Ann"), ("LOCATION", "New York")]
    with pytest.raises(ValueError):
        term_families({"URL": ["x"]})
    with pytest.raises(ValueError):
        term_families({"PERSON": [f"n{i}" for i in range(6000)]})


WHOLE_OR_NOT = [
    ("a" * 70 + "@b.com x", "<EMAIL_ADDRESS> x"),
    ("x@" + "ab." * 30 + "com y", "<EMAIL_ADDRESS> y"),
    ("a@b.co.", "<EMAIL_ADDRESS>."),
    ("+49 30 12 34 56 78 90", "<PHONE_NUMBER>"),
    ("+33 1 23 45 67 89", "<PHONE_NUMBER>"),
    ("1-800-555-1234 or 345 555 0001 now", "<PHONE_NUMBER> or <PHONE_NUMBER> now"),
    ("(345) 555-00012345", "(345) 555-00012345"),
    ("1 345 555 0001 2345", "1 345 555 0001 2345"),
    ("::ffff:10.0.0.1 z", "<IP_ADDRESS> z"),
    ("2001:db8::1: refused", "<IP_ADDRESS>: refused"),
    ("at 2001:db8:: x 10:30:00", "at <IP_ADDRESS> x 10:30:00"),
    ("driver license ABC12345678901234.", "driver license <US_DRIVER_LICENSE>."),
    ("driver license ABC1234567890123456.", "driver license ABC1234567890123456."),
]


def test_values_are_masked_whole_or_not_at_all(spark):
    types = ["EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS", "US_DRIVER_LICENSE"]
    df = spark.createDataFrame(WHOLE_OR_NOT, "text string, e string")
    for r in scrub(df, entities=types).collect():
        assert r["masked"] == r["e"], r["text"]


def test_long_runs_and_many_hits_take_linear_time(spark):
    texts = [
        "ACGT" * 250_000 + " 12345678",
        "a" * 1_000_000 + "-1 123-45-6789",
        " ".join(f"u{i}@x.com" for i in range(50_000)),
        "1:" * 200_000,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(1)
    begin = time.perf_counter()
    rows = {r["id"]: r["spans"] for r in detect(df).where("id < 4").collect()}
    assert time.perf_counter() - begin < 60
    assert [len(rows[i]) for i in range(4)] == [1, 1, 50_000, 0]
    last = rows[2][-1]
    assert texts[2][last["start"] : last["end"]] == last["value"] == "u49999@x.com"


def test_named_types_need_terms(spark):
    df = spark.createDataFrame([("Ann Lee",)], "`my text` string")
    with pytest.raises(ValueError):
        scrub(df, "my text", entities=["PERSON"])
    with pytest.warns(UserWarning):
        scrub(df, "my text")
    assert scrub(df, "my text", terms={"PERSON": ["Ann"]}).first()["masked"] == "<PERSON> Lee"


def test_few_and_many_hits_of_one_text(spark):
    """At once or in blocks, every hit is found at its place."""
    for n in (0, 1, 255, 256, 257, 600):
        parts = [f"{'é' * (i % 3)} 10.{i % 256}.0.{i % 7}, 10.{i}.0.999" for i in range(n)]
        text = "; ".join(parts)
        spans = detect(spark.createDataFrame([(text,)], "text string"), entities=["IP_ADDRESS"]).first()["spans"]
        assert [text[s["start"] : s["end"]] for s in spans] == [s["value"] for s in spans]
        assert [s["value"] for s in spans] == [f"10.{i % 256}.0.{i % 7}" for i in range(n)]


def test_marks_in_the_text_itself(spark):
    """Positions come from marks put around the matches; a text may hold these marks."""
    text = "\x01a@b.org\x02 on 2024-01-02\x01, \x02\x01call 345-555-1234 or 12345678\x02\x02 \x01"
    got = detect(spark.createDataFrame([(text,), ("\x01\x02",)], "text string")).collect()
    assert [(s["value"], s["entity_type"]) for s in got[0]["spans"]] == [
        ("a@b.org", "EMAIL_ADDRESS"), ("2024-01-02", "DATE_TIME"), ("345-555-1234", "PHONE_NUMBER"), ("12345678", "US_BANK_NUMBER"),
    ]
    assert all(text[s["start"] : s["end"]] == s["value"] for s in got[0]["spans"])
    assert got[0]["text"] == text and got[1]["spans"] == []



def test_positions_scan_each_text_once():
    """A second scan, by ``split`` with the same pattern, gave the positions before."""
    for family in FAMILIES:
        if not family.group:
            assert family_spans(family, "text").count(family.pattern) == 1


def test_long_wallets_take_few_steps():
    """Five digits a step: 7 steps over 7 limbs, not one for each of up to 35 digits over 9."""
    assert "split(" not in base58check_sql("v") and f"{58**5}L" in base58check_sql("v")


def test_phone_digits_are_counted_without_a_pattern(spark):
    """Patterns that replace cost more than the scan; a candidate holds nothing but digits and six signs."""
    rnd = random.Random(4)
    texts = ["".join(rnd.choices("0123456789" * 3 + "+-. ()x\u0661", k=40)) for _ in range(400)]
    texts += ["+1 (345) 555-0001", "(345) 555-0001", "345 555 0001", "+12 3456", "+1 " + "234 " * 9]
    found = f"regexp_extract_all(t, {detectors.raw(detectors.PHONE)}, 0)"
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.explode(F.expr(found)).alias("v"))
    own = detectors._phone_digits("v")
    assert "regexp" not in own and "regexp" not in detectors._luhn("v").lower()
    rows = rows.selectExpr("v", f"{own} AS got", "length(regexp_replace(v, '[^0-9]', '')) BETWEEN 7 AND 15 AS expected").collect()
    assert {r["expected"] for r in rows} == {True, False} and all(r["got"] == r["expected"] for r in rows)
