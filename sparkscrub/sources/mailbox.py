"""Email files as tables of headers and parts.

Only the MIME parsing itself is Python (in Arrow batches: messages of plain shape are cut
at their delimiters, the standard library's parser reads all others); everything after it
is Spark expressions. A message stays one row with an
array of headers and an array of parts, so message scope needs no shuffle.
"""

from __future__ import annotations

import codecs
import email
import re
from collections.abc import Iterator
from email import policy
from email.message import EmailMessage
from email.policy import EmailPolicy
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

import sparkscrub
from sparkscrub.functions.sqltext import name
from sparkscrub.plans.expand import expand
from sparkscrub.plans.shipping import ship_package

HEADERS_TYPE = "array<struct<ord:int,name:string,value:string>>"
PART_FIELDS = {
    "part_path": "string",
    "part_no": "int",
    "kind": "string",
    "maintype": "string",
    "subtype": "string",
    "charset": "string",
    "filename": "string",
    "disposition": "string",
    "content_id": "string",
    "text": "string",
    "content": "binary",
    "n_bytes": "bigint",
}
PARTS_TYPE = "array<struct<" + ",".join(f"{f}:{t}" for f, t in PART_FIELDS.items()) + ">>"


@lru_cache(maxsize=4096)
def _parsed_header(name_: str, value: str):
    return policy.default.header_fetch_parse(name_, value)


# Header values that the parser gives back as they are: words with single spaces, and one plain address.
_PLAIN_WORDS = re.compile(r"[!-~]+(?: [!-~]+)*")
_PLAIN_ADDRESS = re.compile(
    r"(?:(?:[A-Za-z0-9#_+-]+ )+<[A-Za-z0-9_+-]+(?:\.[A-Za-z0-9_+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*>"
    r"|[A-Za-z0-9_+-]+(?:\.[A-Za-z0-9_+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)"
)
_ADDRESSES = ("from", "to", "cc", "bcc", "reply-to", "sender")
# Headers with a grammar of their own; all others are words.
_STRUCTURED = set(policy.default.header_factory.registry) - {"subject"}


def _plain(name_: str, value: str) -> bool:
    """Is the value its own parsed form?"""
    low = name_.lower()
    if low in _ADDRESSES:
        return _PLAIN_ADDRESS.fullmatch(value) is not None
    return low not in _STRUCTURED and "=?" not in value and _PLAIN_WORDS.fullmatch(value) is not None


class _ReadPolicy(EmailPolicy):
    """The default policy; each distinct header is parsed once, not at each access, and a plain one not at all."""

    def header_fetch_parse(self, name, value):
        if type(value) is str and _plain(name, value):
            return value
        return _parsed_header(name, value)


_POLICY = _ReadPolicy()

# Rows per output batch of the parser; messages can be large.
_ROWS_OUT = 64


# Charsets in which bytes below 128 are themselves.
_ASCII = ("utf-8", "us-ascii", "ascii", "iso-8859-1")
_DESCRIBING = ("content-type", "content-disposition")


@lru_cache(maxsize=4096)
def _described(headers: tuple[tuple[str, str], ...]) -> dict:
    """What the headers of a part tell about it."""
    part = EmailMessage(policy=_POLICY)
    for name_, value in headers:
        part.set_raw(name_, value)
    return {
        "maintype": part.get_content_maintype(),
        "subtype": part.get_content_subtype(),
        "charset": part.get_content_charset(),
        "filename": part.get_filename(),
        "disposition": part.get_content_disposition(),
    }


def _leaf(part, path: str) -> dict:
    text = content = None
    raw = [(n.lower(), v) for n, v in part.raw_items()]
    described = _described(tuple(h for h in raw if h[0] in _DESCRIBING))
    payload = part.get_payload()
    # ASCII without an encoding is its own text.
    as_is = type(payload) is str and payload.isascii() and not any(n == "content-transfer-encoding" for n, _ in raw)
    if described["maintype"] == "text":
        try:
            text = payload if as_is and described["charset"] in _ASCII else part.get_content()
        except Exception:  # unknown charset: keep the bytes, the row is quarantined
            content = part.get_payload(decode=True)
    else:
        content = payload.encode("ascii") if as_is else part.get_payload(decode=True)
    return {
        "part_path": path,
        **described,
        "content_id": str(part["Content-ID"]) if part["Content-ID"] else None,
        "text": text,
        "content": content,
        "n_bytes": len(content if text is None else text.encode("utf-8", "replace")) if (text or content) else 0,
    }


def _walk(part, path: str) -> Iterator[dict]:
    """Leaves in document order, each multipart's preamble first and its epilogue last; of an
    attached message its headers first, a line each."""
    if not part.is_multipart():
        yield _leaf(part, path)
        return
    if part.preamble:
        yield {"part_path": path, "kind": "preamble", "text": part.preamble}
    for i, child in enumerate(part.iter_parts()):
        if part.get_content_maintype() == "message" and child.keys():
            lines = "\n".join(f"{n}: {v}" for n, v in child.items())
            yield {"part_path": f"{path}.{i}", "kind": "headers", "text": lines}
        yield from _walk(child, f"{path}.{i}")
    if part.epilogue:
        yield {"part_path": path, "kind": "epilogue", "text": part.epilogue}


# What the quick path takes as it stands: a header on one line, and encodings that change nothing.
_HEADER_LINE = re.compile(r"([!-9;-~]+):[ \t]*([^\n]*)")
_AS_IS = ("7bit", "8bit")
# File names differ from message to message, so their headers are not worth a cache.
_NAMED = re.compile(r'(attachment|inline); filename="([A-Za-z0-9_-][A-Za-z0-9._-]*)"')


def _value(name_: str, raw: str) -> str:
    return str(_POLICY.header_fetch_parse(name_, raw))


@lru_cache(maxsize=4096)
def _boundary(headers: tuple[tuple[str, str], ...]) -> str | None:
    part = EmailMessage(policy=_POLICY)
    for name_, value in headers:
        part.set_raw(name_, value)
    return part.get_boundary()


@lru_cache(maxsize=64)
def _delimiter(boundary: str) -> re.Pattern:
    return re.compile(r"^--" + re.escape(boundary) + r"(--)?[ \t]*(?:\n|\Z)", re.MULTILINE)


@lru_cache(maxsize=1024)
def _unknown_charset(charset: str) -> bool:
    try:
        codecs.lookup(charset)
    except LookupError:
        return True
    return False


class _NotPlain(Exception):
    """The standard library's parser must read this message."""


def _split_headers(text: str) -> tuple[list[tuple[str, str]], str]:
    if text.startswith("\n"):
        return [], text[1:]
    head, blank, body = text.partition("\n\n")
    lines = [_HEADER_LINE.fullmatch(line) for line in head.split("\n")]
    if not blank or not all(lines):
        raise _NotPlain
    return [line.groups() for line in lines], body


def _quick_leaf(headers: list[tuple[str, str]], described: dict, body: str, path: str, out: list[dict]) -> None:
    text = content = None
    charset = described["charset"]
    if described["maintype"] != "text":
        if not body.isascii():
            raise _NotPlain
        content = body.encode("ascii")
        size = len(content)
    elif body.isascii() and (charset is None or charset in _ASCII):
        text, size = body, len(body)
    elif body and charset == "utf-8":
        text = body.encode("ascii", "surrogateescape").decode("utf-8", "replace")
        size = len(text.encode("utf-8", "replace"))
    elif body and body.isascii() and _unknown_charset(charset):
        content = body.encode("ascii")
        size = len(content)
    else:
        raise _NotPlain
    content_id = next((_value(n, v) for n, v in headers if n.lower() == "content-id"), None)
    out.append(
        {"part_path": path, **described, "content_id": content_id or None, "text": text, "content": content, "n_bytes": size}
    )


def _quick_walk(headers: list[tuple[str, str]], body: str, path: str, outer: tuple[str, ...], out: list[dict]) -> None:
    """As ``_walk``, on the text of a part; it ends where a part around it has its next delimiter."""
    describing, named = [], None
    for name_, value in headers:
        low = name_.lower()
        if low in _DESCRIBING:
            if "*" in value or not value.isascii():
                raise _NotPlain
            if low == "content-disposition" and named is None and (named := _NAMED.fullmatch(value)):
                continue
            describing.append((low, value))
        elif low == "content-transfer-encoding" and value not in _AS_IS:
            raise _NotPlain
    described = _described(tuple(describing))
    if named:
        if any(low == "content-disposition" for low, _ in describing):
            raise _NotPlain
        described = {**described, "filename": named[2], "disposition": named[1]}
    if described["maintype"] != "multipart":
        if described["maintype"] == "message":
            raise _NotPlain
        # The line end before a delimiter belongs to the delimiter.
        _quick_leaf(headers, described, body[:-1] if outer and body.endswith("\n") else body, path, out)
        return
    boundary = _boundary(tuple(describing))
    if not boundary or boundary in outer or described["subtype"] == "digest":
        raise _NotPlain
    marks = []
    for mark in _delimiter(boundary).finditer(body):
        marks.append(mark)
        if mark[1]:
            break
    if len(marks) < 2 or not marks[-1][1]:
        raise _NotPlain
    preamble, epilogue = body[: marks[0].start()].removesuffix("\n"), body[marks[-1].end() :]
    if outer:
        epilogue = epilogue.removesuffix("\n")
    if not (preamble.isascii() and epilogue.isascii()):
        raise _NotPlain
    if preamble:
        out.append({"part_path": path, "kind": "preamble", "text": preamble})
    for i, (mark, following) in enumerate(zip(marks, marks[1:])):
        text = body[mark.end() : following.start()]
        if not text:
            raise _NotPlain
        _quick_walk(*_split_headers(text), f"{path}.{i}", (*outer, boundary), out)
    if epilogue:
        out.append({"part_path": path, "kind": "epilogue", "text": epilogue})


def _quick(raw: bytes | None) -> tuple[str, list[dict], list[dict]] | None:
    """What ``_parse`` gives for a message of plain shape, without objects for it; for others None.

    Plain are headers of one line each, closed multiparts and bodies that stand as they are.
    """
    if raw is None or b"\r" in raw:
        return None
    try:
        named, body = _split_headers(raw.decode("ascii", "surrogateescape"))
        if not named:
            return "no_headers", [], []
        headers = [{"ord": i, "name": n, "value": _value(n, v)} for i, (n, v) in enumerate(named)]
        parts: list[dict] = []
        _quick_walk(named, body, "0", (), parts)
    except _NotPlain:
        return None
    return "ok", headers, parts


def _parse(raw: bytes) -> tuple[str, list[dict], list[dict]]:
    """Status, headers and parts; fields that a part does not name are empty."""
    try:
        return _quick(raw) or _parse_any(raw)
    except Exception as error:  # a message that cannot be read must not fail the job
        return f"error: {type(error).__name__}", [], []


def _parse_any(raw: bytes) -> tuple[str, list[dict], list[dict]]:
    message = email.message_from_bytes(raw, policy=_POLICY)
    headers = [{"ord": i, "name": str(n), "value": str(v)} for i, (n, v) in enumerate(message.items())]
    if not headers:
        return "no_headers", [], []
    return "ok", headers, list(_walk(message, "0"))


def _lists(rows: list[list[dict]], kind: pa.ListType) -> pa.ListArray:
    """Lists of structs, made a field at a time."""
    ends = list(accumulate((len(row) for row in rows), initial=0))
    flat = [item for row in rows for item in row]
    fields = [pa.array([item.get(f.name) for item in flat], f.type) for f in kind.value_type]
    structs = pa.StructArray.from_arrays(fields, fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs, type=kind)


def _batch_parser(arrow: pa.Schema):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), _ROWS_OUT):
                rows = batch.slice(first, _ROWS_OUT)
                status, headers, parts = zip(*(_parse(raw) for raw in rows.column(1).to_pylist()))
                for found in parts:
                    for i, part in enumerate(found):
                        part["part_no"] = i
                made = [pa.array(status, arrow.field(1).type), *(_lists(x, arrow.field(i).type) for i, x in ((2, headers), (3, parts)))]
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(arrow.field(0).type), *made], schema=arrow)

    return step


def part_kind_sql(part: str = "") -> str:
    """The kind of a part from its main type, subtype and file name."""
    dot = f"{part}." if part else ""
    name_ = f"lower({dot}filename)"
    return (
        f"CASE WHEN {dot}maintype = 'text' AND {dot}text IS NULL THEN 'other' "
        f"WHEN {dot}maintype = 'text' AND {dot}subtype = 'html' THEN if({dot}filename IS NULL, 'html', 'named_html') "
        f"WHEN {dot}maintype = 'text' THEN if({dot}filename IS NULL, 'text', 'named_text') "
        f"WHEN endswith({name_}, '.pdf') THEN 'pdf' "
        f"WHEN endswith({name_}, '.docx') OR endswith({name_}, '.doc') THEN 'docx' "
        f"ELSE 'other' END"
    )


def classify_part() -> Column:
    """Column of the kind of a part, for tables with ``maintype, subtype, filename, text``."""
    return F.expr(part_kind_sql())


def parse_messages(files: DataFrame) -> DataFrame:
    """Rows ``path, content`` (raw bytes) to one row per message:
    ``path, status, headers, parts``. A message that cannot be parsed has a status
    other than ``ok`` and no parts."""
    ship_package(files.sparkSession, sparkscrub)
    schema = T._parse_datatype_string(f"path string, status string, headers {HEADERS_TYPE}, parts {PARTS_TYPE}")
    rows = files.select(F.col("path").cast("string"), F.col("content").cast("binary"))
    parsed = rows.mapInArrow(_batch_parser(to_arrow_schema(schema)), schema)
    p = name("p")
    fields = ", ".join(
        f"coalesce({p}.kind, {part_kind_sql(p)}) AS kind" if f == "kind" else f"{p}.{f} AS {f}" for f in PART_FIELDS
    )
    return parsed.withColumn("parts", F.expr(f"transform(parts, {p} -> struct({fields}))"))


def read_mailbox(spark: SparkSession, path: str, glob: str = "*.eml") -> DataFrame:
    """A folder of email files, read at any depth, to one row per message. A file
    without a single byte holds no message and gives no row.

    For small folders: the driver lists every file. Keep many messages as rows of a
    table ``path, content`` and give that to ``parse_messages``.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return parse_messages(files.select("path", "content"))


def message_headers(messages: DataFrame) -> DataFrame:
    """One row per header, in order, repeats kept, empty values dropped."""
    return expand(messages, ["path"], F.inline_outer("headers"), "ord").where("value <> ''")


def message_parts(messages: DataFrame) -> DataFrame:
    """One row per leaf part, with rows for preamble, epilogue and the headers of attached
    messages, in document order."""
    return expand(messages, ["path"], F.inline_outer("parts"), "part_no")
