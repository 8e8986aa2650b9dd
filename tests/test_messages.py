import email
from email import policy
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from sparkscrub.operators import messages, reports
from sparkscrub.sources import mailbox


def mixed():
    m = EmailMessage()
    m["From"] = "Bob Gray <bob@x.com>"
    m["To"] = "ann@y.org"
    m["Subject"] = "Über bob@x.com"
    m["X-Empty"] = ""
    m["Received"] = "from 10.0.0.1"
    m["Received"] = "from 2001:db8::1"
    m.set_content("Dear bob@x.com, call +1 (345) 555-1234\n")
    m.add_alternative('<p>bob@x.com</p><a href="mailto:ann@y.org">x</a>', subtype="html")
    m.add_attachment("mail,ann@y.org\n", filename="people.csv", subtype="csv", cid="<c1>")
    m.add_attachment("<b>bob@x.com</b>", filename="page.html", subtype="html")
    m.add_attachment(b"%PDF junk", maintype="application", subtype="pdf", filename="cv.PDF")
    m.add_attachment(b"junk", maintype="application", subtype="msword", filename="a.doc")
    m.add_attachment(b"\x00\x01", maintype="image", subtype="png")
    m.preamble = "kept for ann@y.org"
    m.epilogue = "sent to ann@y.org"
    return m


MIXED = mixed().as_bytes()


def plain(text, charset="utf-8"):
    return f"Subject: hello\nContent-Type: text/plain; charset={charset}\n\n{text}".encode()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("mail")
    (base / "deep").mkdir()
    nested = EmailMessage()
    nested["Subject"] = "outer"
    nested.set_content("outer text")
    inner = EmailMessage()
    inner["Subject"] = "inner"
    inner.set_content("inner bob@x.com")
    nested.add_attachment(inner)
    files = {
        "mixed.eml": MIXED,
        "deep/plain.eml": plain("to bob@x.com"),
        "empty.eml": b"",  # no bytes: the file source gives no row
        "junk.eml": b"\n\x00\xff\x00 not a message",
        "charset.eml": plain("bob@x.com", "x-none"),
        "nested.eml": nested.as_bytes(),
        "other.txt": b"Subject: not read\n\n",
    }
    for name, raw in files.items():
        (base / name).write_bytes(raw)
    return str(base)


@pytest.fixture(scope="module")
def mail(spark, folder):
    read = mailbox.read_mailbox(spark, folder)
    return read.withColumn("path", F.element_at(F.split("path", "/"), -1)).cache()


def of(df, path):
    return df.where(F.col("path") == path)


def test_status(mail):
    assert {r["path"]: r["status"] for r in mail.collect()} == {
        "mixed.eml": "ok",
        "plain.eml": "ok",
        "charset.eml": "ok",
        "nested.eml": "ok",
        "junk.eml": "no_headers",
    }


def test_headers_keep_order_and_repeats(mail):
    rows = mailbox.message_headers(of(mail, "mixed.eml")).orderBy("ord").collect()
    names = [r["name"] for r in rows]
    assert names[:3] == ["From", "To", "Subject"] and names.count("Received") == 2
    assert "X-Empty" not in names and rows[2]["value"] == "Über bob@x.com"


def test_parts(mail):
    rows = mailbox.message_parts(of(mail, "mixed.eml")).orderBy("part_no").collect()
    assert [(r["part_path"], r["kind"]) for r in rows] == [
        ("0", "preamble"),
        ("0.0.0", "text"),
        ("0.0.1", "html"),
        ("0.1", "named_text"),
        ("0.2", "named_html"),
        ("0.3", "pdf"),
        ("0.4", "docx"),
        ("0.5", "other"),
        ("0", "epilogue"),
    ]
    assert rows[3]["content_id"] == "<c1>" and rows[3]["charset"] == "utf-8" and rows[5]["n_bytes"] == 9
    inner = mailbox.message_parts(of(mail, "nested.eml")).collect()
    assert any("inner bob@x.com" in (r["text"] or "") for r in inner)


def test_combined_text(mail):
    text = of(mail, "mixed.eml").select(messages.combined_text()).first()[0]
    raw = email.message_from_bytes(MIXED, policy=policy.default)
    lines = [f"{k}: {v}" for k, v in raw.items() if v]
    body, csv, page, *_ = raw.iter_parts()
    tops = ["\n".join(p.get_content() for p in body.iter_parts()), csv.get_content(), page.get_content()]
    assert text == "\n\n".join(lines + tops + ["Attachment: a.doc"])


def test_scrubbed_message(mail):
    done = messages.scrub_messages(mail, salt="s").cache()
    headers = {r["name"]: r["value"] for r in of(done, "mixed.eml").select(F.inline("headers")).collect()}
    assert headers["From"] == "Bob Gray <<EMAIL_ADDRESS>>" and headers["Subject"] == "Über <EMAIL_ADDRESS>"
    assert "Content-Type" not in headers and headers["X-Empty"] == ""
    parts = of(done, "mixed.eml").select(F.inline("parts")).orderBy("part_no").collect()
    assert [p["text"] for p in parts] == [
        "kept for <EMAIL_ADDRESS>",
        "Dear <EMAIL_ADDRESS>, call <PHONE_NUMBER>\n",
        '<p>&lt;EMAIL_ADDRESS&gt;</p><a href="mailto:&lt;EMAIL_ADDRESS&gt;">x</a>\n',
        "mail,<EMAIL_ADDRESS>\n",
        "<b>&lt;EMAIL_ADDRESS&gt;</b>\n",
        None,
        None,
        None,
        "sent to <EMAIL_ADDRESS>",
    ]
    assert all(p["content"] is None for p in parts)
    names = [p["filename"] for p in parts if p["filename"]]
    assert [n[12:] for n in names] == [".csv", ".html", ".pdf", ".docx"] and len({n[:12] for n in names}) == 4
    left = mailbox.message_parts(done).where("text IS NOT NULL")
    assert reports.residual_pii(left.select("path", "kind", "text"), "text", kind="kind").count() == 0
    found = messages.text_attachments(of(done, "mixed.eml")).orderBy("part_path").collect()
    assert [(r["maintype"], r["subtype"], r["disposition"]) for r in found] == [
        ("text", "csv", "attachment"),
        ("text", "html", "attachment"),
    ]
    assert bytes(found[0]["content"]) == b"mail,<EMAIL_ADDRESS>\n"


def test_names_differ_between_runs_without_a_salt(mail):
    def name():
        parts = mailbox.message_parts(messages.scrub_messages(of(mail, "mixed.eml")))
        return parts.where("kind = 'pdf'").first()["filename"]

    assert name() != name()


def test_quarantine(mail):
    rows = {(r["path"], r["status"]) for r in messages.quarantine(mail).collect()}
    assert rows == {
        ("mixed.eml", "binary_pdf"),
        ("mixed.eml", "binary_docx"),
        ("mixed.eml", "binary_other"),
        ("charset.eml", "unreadable_text"),
        ("junk.eml", "no_headers"),
    }
    kept = messages.scrub_messages(mail)
    assert kept.count() == 4


def test_attachment_report(mail):
    rows = reports.attachment_report(mailbox.message_parts(mail)).collect()
    assert {(r["content_type"], r["attachments"]) for r in rows} == {
        ("text/csv", 1),
        ("text/html", 1),
        ("application/pdf", 1),
        ("application/msword", 1),
    }


def test_message_scope_needs_no_shuffle(mail):
    plan = messages.scrub_messages(mail)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_headers_of_an_attached_message_are_masked(spark):
    inner = EmailMessage()
    inner["From"] = "Ann <ann@b.org>"
    inner["Subject"] = "call +1 (345) 555-1234"
    inner.set_content("see ann@b.org")
    outer = EmailMessage()
    outer["To"] = "x"
    outer.set_content("fwd")
    outer.add_attachment(inner)
    files = spark.createDataFrame([("m", bytearray(bytes(outer)))], "path string, content binary")
    masked = messages.scrub_messages(mailbox.parse_messages(files), entities=["EMAIL_ADDRESS", "PHONE_NUMBER"])
    parts = {r["part_path"] + r["kind"]: r["text"] for r in mailbox.message_parts(masked).collect()}
    head = parts["0.1.0headers"]
    assert "From: Ann <<EMAIL_ADDRESS>>" in head and "Subject: call <PHONE_NUMBER>" in head
    assert parts["0.1.0text"].strip() == "see <EMAIL_ADDRESS>"
    assert messages.quarantine(mailbox.parse_messages(files)).count() == 0


def test_plain_headers_are_not_parsed_and_read_the_same():
    from email import policy

    from sparkscrub.sources import mailbox

    plain = [("From", "Ann Lee <ann.lee@example.com>"), ("to", "desk-1@example.org"), ("Subject", "Note 1 (by) \"x\", y@z"), ("X-Trace", "a")]
    other = [("To", "a@b, c@d"), ("From", "A.B <a@b>"), ("From", "a@b (note)"), ("Subject", "=?utf-8?q?a?="), ("Subject", "a  b"), ("Subject", "é"), ("X", ""), ("Date", "today")]
    before = mailbox._parsed_header.cache_info().misses
    for name, value in plain:
        assert mailbox._POLICY.header_fetch_parse(name, value) == str(policy.default.header_fetch_parse(name, value)) == value
    assert mailbox._parsed_header.cache_info().misses == before
    for name, value in other:
        assert not mailbox._plain(name, value)
        assert str(mailbox._POLICY.header_fetch_parse(name, value)) == str(policy.default.header_fetch_parse(name, value))


PLAIN = {
    "alone": "Subject: a\nFrom: Bob Gray <bob@x.com>\n\nhello\n",
    "no headers": "\njunk",
    "no end of headers": "Subject: a\nFrom: b@x.com",
    "folded": "Subject: a\n b\n\nhello",
    "unknown charset": "Content-Type: text/plain; charset=x-none\n\nhello",
    "unknown charset, empty": "Content-Type: text/plain; charset=x-none\n\n",
    "letters": "Subject: a\nContent-Type: text/html; charset=utf-8\n\n<p>ä</p>",
    "encoded": "Content-Type: text/plain\nContent-Transfer-Encoding: base64\n\naGVsbG8=\n",
    "line ends": "Subject: a\r\n\r\nhello\r\n",
    "nested": "Content-Type: multipart/mixed; boundary=o\n\nbefore\n--o\nContent-Type: multipart/alternative; boundary=i\n\n"
    "--i\nContent-ID: <c>\n\ntext\n\n--i\n\nno headers\n--i-- \nafter i\n--o\nContent-Type: application/pdf\n"
    'Content-Disposition: attachment; filename="a.pdf"\n\njunk\n--o--\nafter\n',
    "not closed": "Content-Type: multipart/mixed; boundary=o\n\n--o\n\ntext\n",
    "closed first": "Content-Type: multipart/mixed; boundary=o\n\n--o--\n\ntext\n--o\n",
    "inner not closed": "Content-Type: multipart/mixed; boundary=o\n\n--o\nContent-Type: multipart/mixed; boundary=i\n\n"
    "--i\n\ntext\n--o--\n",
    "twice": "Content-Type: multipart/mixed; boundary=o\n\n--o\n--o\n\ntext\n--o--\n",
    "one boundary in another": "Content-Type: multipart/mixed; boundary=o\n\n--o\nContent-Type: multipart/mixed; boundary=o\n\n"
    "--o\n\ntext\n--o--\n",
    "a message": "Content-Type: multipart/mixed; boundary=o\n\n--o\nContent-Type: message/rfc822\n\nSubject: b\n\ninner\n--o--\n",
    "a name twice": 'Content-Disposition: attachment; filename="a"\nContent-Disposition: inline; filename="b"\n\nhello',
}


@pytest.mark.parametrize("shape", PLAIN)
def test_the_quick_parser_gives_what_the_library_gives(shape):
    def filled(parsed):
        return parsed[0], parsed[1], [{k: v for k, v in p.items() if v is not None} for p in parsed[2]]

    raw = PLAIN[shape].encode()
    assert filled(mailbox._parse(raw)) == filled(mailbox._parse_any(raw))


@pytest.mark.parametrize("shape", ["alone", "no headers", "unknown charset", "letters", "nested"])
def test_messages_of_plain_shape_are_not_given_to_the_library(shape, monkeypatch):
    monkeypatch.setattr(mailbox.email, "message_from_bytes", None)
    status, _, parts = mailbox._parse(PLAIN[shape].encode())
    assert status == "no_headers" if shape == "no headers" else status == "ok" and parts


def test_a_message_without_content_keeps_its_status(spark):
    rows = mailbox.parse_messages(spark.createDataFrame([("a", None)], "path string, content binary"))
    assert [(r["status"], r["headers"], r["parts"]) for r in rows.collect()] == [("error: AttributeError", [], [])]
