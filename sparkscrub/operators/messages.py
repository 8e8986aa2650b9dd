"""Masking whole messages: one map for headers, bodies, named text parts, and the text
before and after the MIME parts. A message is one row, so nothing is shuffled and the
same expressions run on a stream of messages."""

from __future__ import annotations

import secrets
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscrub.functions.mask import filename_sql, mask_headers_sql
from sparkscrub.functions.spans import keys_sql
from sparkscrub.functions.sqltext import let, name
from sparkscrub.plans.handlers import Handler, analysed_sql, masked_sql
from sparkscrub.sources.mailbox import PART_FIELDS, message_parts

TEXT_KINDS = ("text", "html", "named_text", "named_html", "preamble", "epilogue", "headers")
_TEXT_KINDS = "(" + ", ".join(f"'{k}'" for k in TEXT_KINDS) + ")"


def combined_text_sql(
    headers: str, parts: str, visible: bool = False, handlers: Mapping[str, Handler] | None = None
) -> str:
    """The text a message is analysed on: ``Name: value`` lines, then the parts.

    Blank lines between headers and top parts, line ends between the parts nested in
    one top part. A part without text stands as ``Attachment: <name>``. ``visible``
    takes the analysed form of each part (of HTML its text), not the source.
    """
    h, p, x, acc = name("h"), name("p"), name("x"), name("acc")
    lines = (
        f"transform(filter({headers}, {h} -> {h}.value <> ''), "
        f"{h} -> struct(concat({h}.name, ': ', {h}.value) AS line, '' AS top))"
    )
    text = analysed_sql(f"{p}.text", f"{p}.kind", handlers) if visible else f"{p}.text"
    line = (
        f"CASE WHEN {p}.text IS NOT NULL THEN {text} WHEN {p}.kind = 'pdf' OR {p}.filename IS NULL "
        f"OR {p}.part_path = '0' THEN '' ELSE concat('Attachment: ', {p}.filename) END"
    )
    body = (
        f"transform(filter({parts}, {p} -> {p}.kind NOT IN ('preamble', 'epilogue')), "
        f"{p} -> struct({line} AS line, coalesce(get(split({p}.part_path, '[.]'), 1), '0') AS top))"
    )
    separator = (
        f"CASE WHEN {acc}.top IS NULL THEN '' WHEN {acc}.top <> '' AND {acc}.top = {x}.top THEN '\\n' ELSE '\\n\\n' END"
    )
    return (
        f"aggregate(filter(concat({lines}, {body}), {x} -> {x}.line <> ''), "
        f"struct('' AS line, cast(NULL AS string) AS top), ({acc}, {x}) -> "
        f"struct(concat({acc}.line, {separator}, {x}.line) AS line, {x}.top AS top)).line"
    )


def combined_text(headers: str = "headers", parts: str = "parts") -> Column:
    """Column of the text a message is analysed on."""
    return F.expr(combined_text_sql(headers, parts))


def _masked_parts_sql(parts: str, keys: str, salt: str, handlers) -> str:
    """Text parts masked; named ones get a new name; parts without text lose their bytes."""
    p = name("p")
    named = {"text": "('named_text', 'named_html')", "pdf": "('pdf')", "docx": "('docx')"}
    ident = f"concat(path, '/', {p}.part_path)"
    filename = (
        f"CASE WHEN {p}.filename IS NULL THEN NULL "
        + " ".join(
            f"WHEN {p}.kind IN {kinds} THEN {filename_sql(p + '.filename', k, salt, ident)}"
            for k, kinds in named.items()
        )
        + f" ELSE {filename_sql(p + '.filename', None, salt, ident)} END"
    )
    text = f"CASE WHEN {p}.text IS NOT NULL THEN {masked_sql(p + '.text', keys, p + '.kind', handlers)} END"
    new = {"text": text, "filename": filename, "content": "cast(NULL AS binary)"}
    fields = ", ".join(f"{new.get(f, f'{p}.{f}')} AS {f}" for f in PART_FIELDS)
    return f"transform({parts}, {p} -> struct({fields}))"


def scrub_messages(
    messages: DataFrame,
    entities: Iterable[str] | None = None,
    terms: dict | None = None,
    salt: str | None = None,
    handlers: Mapping[str, Handler] | None = None,
) -> DataFrame:
    """Mask the headers and parts of each message with the map of the whole message.

    Header names stay, ``Content-Type`` is left out. Attachments get names that tell
    only their kind; with a ``salt`` the names are the same in each run. Parts that
    hold no text keep their row but not their bytes; see ``quarantine``.
    """
    salt = salt or secrets.token_hex(8)
    combined = combined_text_sql("headers", "parts", True, handlers)
    masked = let(
        keys_sql(combined, entities, terms),
        lambda k: f"struct({mask_headers_sql('headers', k)} AS headers, "
        f"{_masked_parts_sql('parts', k, salt, handlers)} AS parts)",
        "k",
    )
    rest = [c for c in messages.columns if c not in ("headers", "parts")]
    return messages.where("status = 'ok'").select(*rest, F.expr(masked).alias("_m")).select(*rest, "_m.*")


def quarantine(messages: DataFrame) -> DataFrame:
    """What must not leave unseen: messages that could not be parsed, and parts that hold
    no readable text, with their bytes and a ``status`` that tells why.

    Departure: such parts are held back here; they are not passed on unmasked, and one
    of them does not fail the whole message.
    """
    fields = [f for f in PART_FIELDS if f not in ("text", "part_no")]
    unreadable = messages.where("status <> 'ok'").select(
        "path",
        "status",
        F.lit(None).cast("int").alias("part_no"),
        *(F.lit(None).cast(PART_FIELDS[f]).alias(f) for f in fields),
    )
    held = message_parts(messages.where("status = 'ok'")).where(f"text IS NULL OR kind NOT IN {_TEXT_KINDS}")
    reason = F.expr("CASE WHEN maintype = 'text' THEN 'unreadable_text' ELSE concat('binary_', kind) END")
    return held.select("path", reason.alias("status"), "part_no", *fields).unionByName(unreadable)


def text_attachments(scrubbed: DataFrame) -> DataFrame:
    """The masked named text parts: ``path, part_path, filename, content, maintype, subtype``,
    with disposition, charset and content id."""
    return (
        message_parts(scrubbed)
        .where("kind IN ('named_text', 'named_html')")
        .select(
            "path",
            "part_path",
            "filename",
            F.encode("text", "UTF-8").alias("content"),
            "maintype",
            "subtype",
            F.coalesce("disposition", F.lit("attachment")).alias("disposition"),
            F.coalesce("charset", F.lit("utf-8")).alias("charset"),
            "content_id",
        )
    )
