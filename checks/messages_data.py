"""Email files made by Spark from the notes table, and what must be read from them.

Every note becomes a message. Its shape depends on the note's number: plain text,
alternative text and HTML, mixed with attachments, HTML only, and two that cannot be
read (no headers; an unknown charset).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import oracle as o

SALT = "s1"

_HEAD = (
    "concat('From: ', c_name, ' <user', cust_id, '@example.com>\\n', 'To: desk', note_id, '@example.org\\n', "
    "'Subject: Note ', note_id, ' by user', cust_id, '@example.com\\n', "
    "'X-Trace: ', CASE WHEN note_id % 3 = 0 THEN '' ELSE n_name END, '\\n', 'MIME-Version: 1.0\\n')"
)
_HTML = (
    "concat('<p title=\"', c_name, '\">', c_name, ' &amp; co, <a href=\"mailto:user', cust_id, "
    "'@example.com\">write</a></p><script>var u=\"user', cust_id, '@example.com\"</script>')"
)
_ALTERNATIVE = (
    f"concat('Content-Type: multipart/alternative; boundary=\"{{b}}\"\\n\\n--{{b}}\\n"
    "Content-Type: text/plain; charset=\"utf-8\"\\n\\n', text, '\\n--{b}\\nContent-Type: text/html; charset=\"utf-8\"\\n\\n', "
    "{html}, '\\n--{b}--\\n')"
)


def _alternative(boundary: str) -> str:
    return _ALTERNATIVE.replace("{html}", _HTML).replace("{{b}}", boundary).replace("{b}", boundary)


_MIXED = (
    "concat('Content-Type: multipart/mixed; boundary=\"out\"\\n\\nKept for desk', note_id, '@example.org\\n--out\\n', "
    f"{_alternative('inn')}, '--out\\nContent-Type: text/csv; charset=\"utf-8\"\\nContent-ID: <c', note_id, '>\\n"
    "Content-Disposition: attachment; filename=\"list', note_id, '.csv\"\\n\\nmail,user', cust_id, '@example.com"
    "\\n--out\\nContent-Type: application/pdf\\nContent-Disposition: attachment; filename=\"Scan.PDF\"\\n\\n"
    "junk', note_id, '\\n--out--\\nSent to desk', note_id, '@example.org')"
)

RAW = f"""CASE WHEN note_id % 5 = 0 THEN concat({_HEAD}, 'Content-Type: text/plain; charset="utf-8"\\n\\n', text)
WHEN note_id % 5 = 1 THEN concat({_HEAD}, {_alternative('alt')})
WHEN note_id % 5 = 2 THEN concat({_HEAD}, {_MIXED})
WHEN note_id % 5 = 3 THEN concat({_HEAD}, 'Content-Type: text/html; charset="utf-8"\\n\\n', {_HTML})
WHEN note_id % 10 = 4 THEN concat('\\njunk ', note_id)
ELSE concat({_HEAD}, 'Content-Type: text/plain; charset="x-none"\\n\\n', text) END"""


def raw_messages(notes: DataFrame) -> DataFrame:
    """Rows ``path, content``, like files read as binary."""
    return notes.select(
        F.format_string("note-%d.eml", "note_id").alias("path"), F.encode(F.expr(RAW), "UTF-8").alias("content")
    )


# --- expected ---------------------------------------------------------------------------

_N = f"n AS (SELECT *, concat('note-', note_id, '.eml') AS path, note_id % 5 AS k FROM ({o.DUCK_NOTES}))"
_MAIL = "concat('user', cust_id, '@example.com')"
_FROM = f"concat(c_name, ' <', {_MAIL}, '>')"
_DUCK_HTML = _HTML.replace("\\n", "\n")
_TRACE = "CASE WHEN note_id % 3 = 0 THEN '' ELSE n_name END"
_CONTENT_TYPE = (
    "CASE k WHEN 0 THEN 'text/plain; charset=\"utf-8\"' WHEN 1 THEN 'multipart/alternative; boundary=\"alt\"' "
    "WHEN 2 THEN 'multipart/mixed; boundary=\"out\"' WHEN 3 THEN 'text/html; charset=\"utf-8\"' "
    "ELSE 'text/plain; charset=\"x-none\"' END"
)
_HEADERS = (
    f"h AS (SELECT path, 0 AS ord, 'From' AS name, {_FROM} AS value, note_id FROM n WHERE note_id % 10 <> 4 "
    "UNION ALL SELECT path, 1, 'To', concat('desk', note_id, '@example.org'), note_id FROM n WHERE note_id % 10 <> 4 "
    f"UNION ALL SELECT path, 2, 'Subject', concat('Note ', note_id, ' by ', {_MAIL}), note_id FROM n WHERE note_id % 10 <> 4 "
    f"UNION ALL SELECT path, 3, 'X-Trace', {_TRACE}, note_id FROM n WHERE note_id % 10 <> 4 "
    "UNION ALL SELECT path, 4, 'MIME-Version', '1.0', note_id FROM n WHERE note_id % 10 <> 4 "
    f"UNION ALL SELECT path, 5, 'Content-Type', {_CONTENT_TYPE}, note_id FROM n WHERE note_id % 10 <> 4)"
)


def _part(where: str, path: str, no: int, kind: str, main: str | None, sub: str | None, text: str, more: dict | None = None) -> str:
    more = more or {}

    def lit(value: str | None) -> str:
        return "CAST(NULL AS VARCHAR)" if value is None else f"'{value}'"

    return (
        f"SELECT path, '{path}' AS part_path, CAST({no} AS INTEGER) AS part_no, '{kind}' AS kind, {lit(main)} AS maintype, "
        f"{lit(sub)} AS subtype, {lit(more.get('charset'))} AS charset, {more.get('filename', 'CAST(NULL AS VARCHAR)')} AS filename, "
        f"{lit(more.get('disposition'))} AS disposition, {more.get('content_id', 'CAST(NULL AS VARCHAR)')} AS content_id, "
        f"{text} AS text, {more.get('n_bytes', f'strlen({text})')} AS n_bytes, note_id FROM n WHERE {where}"
    )


_UTF8 = {"charset": "utf-8"}
_EDGE = {"n_bytes": "CAST(NULL AS BIGINT)"}
_LIST = {
    "charset": "utf-8",
    "filename": "concat('list', note_id, '.csv')",
    "disposition": "attachment",
    "content_id": "concat('<c', note_id, '>')",
}
_SCAN = {"filename": "'Scan.PDF'", "disposition": "attachment", "n_bytes": "strlen(concat('junk', note_id))"}
_PARTS = "p AS (" + " UNION ALL ".join(
    [
        _part("k = 0", "0", 0, "text", "text", "plain", "text", _UTF8),
        _part("k = 1", "0.0", 0, "text", "text", "plain", "text", _UTF8),
        _part("k = 1", "0.1", 1, "html", "text", "html", _DUCK_HTML, _UTF8),
        _part("k = 2", "0", 0, "preamble", None, None, "concat('Kept for desk', note_id, '@example.org')", _EDGE),
        _part("k = 2", "0.0.0", 1, "text", "text", "plain", "text", _UTF8),
        _part("k = 2", "0.0.1", 2, "html", "text", "html", _DUCK_HTML, _UTF8),
        _part("k = 2", "0.1", 3, "named_text", "text", "csv", f"concat('mail,', {_MAIL})", _LIST),
        _part("k = 2", "0.2", 4, "pdf", "application", "pdf", "CAST(NULL AS VARCHAR)", _SCAN),
        _part("k = 2", "0", 5, "epilogue", None, None, "concat('Sent to desk', note_id, '@example.org')", _EDGE),
        _part("k = 3", "0", 0, "html", "text", "html", _DUCK_HTML, _UTF8),
        _part(
            "note_id % 10 = 9", "0", 0, "other", "text", "plain", "CAST(NULL AS VARCHAR)",
            {"charset": "x-none", "n_bytes": "strlen(text)"},
        ),
    ]
) + ")"

_COLUMNS = (
    "path, part_path, part_no, kind, maintype, subtype, charset, filename, disposition, content_id, text, n_bytes"
)
MESSAGES_SQL = (
    f"WITH {_N} SELECT path, CASE WHEN note_id % 10 = 4 THEN 'no_headers' ELSE 'ok' END AS status, "
    "CAST(CASE WHEN note_id % 10 = 4 THEN 0 ELSE 6 END AS INTEGER) AS n_headers, "
    "CAST(CASE WHEN note_id % 10 = 4 THEN 0 WHEN k = 1 THEN 2 WHEN k = 2 THEN 6 ELSE 1 END AS INTEGER) AS n_parts FROM n"
)
HEADERS_SQL = f"WITH {_N}, {_HEADERS} SELECT path, CAST(ord AS INTEGER) AS ord, name, value FROM h WHERE value <> ''"
PARTS_SQL = f"WITH {_N}, {_PARTS} SELECT {_COLUMNS} FROM p"
KINDS_SQL = f"WITH {_N}, {_PARTS} SELECT kind, count(*) AS n FROM p WHERE maintype IS NOT NULL GROUP BY kind"

# Headers, then parts: an empty line between top parts, a line end between nested ones.
_HEAD_TEXT = (
    f"concat('From: ', {_FROM}, chr(10), chr(10), 'To: desk', note_id, '@example.org', chr(10), chr(10), "
    f"'Subject: Note ', note_id, ' by ', {_MAIL}, chr(10), chr(10), "
    "CASE WHEN note_id % 3 = 0 THEN '' ELSE concat('X-Trace: ', n_name, chr(10), chr(10)) END, "
    f"'MIME-Version: 1.0', chr(10), chr(10), 'Content-Type: ', {_CONTENT_TYPE})"
)


def _combined(html: str) -> str:
    gap = "chr(10), chr(10)"
    return (
        f"CASE k WHEN 0 THEN concat({_HEAD_TEXT}, {gap}, text) "
        f"WHEN 1 THEN concat({_HEAD_TEXT}, {gap}, text, {gap}, {html}) "
        f"WHEN 2 THEN concat({_HEAD_TEXT}, {gap}, text, chr(10), {html}, {gap}, 'mail,', {_MAIL}) "
        f"WHEN 3 THEN concat({_HEAD_TEXT}, {gap}, {html}) ELSE {_HEAD_TEXT} END"
    )


COMBINED_SQL = f"WITH {_N} SELECT path, {_combined(_DUCK_HTML)} AS text FROM n WHERE note_id % 10 <> 4"

_VISIBLE = f"concat(c_name, ' & co, ', chr(10), 'mailto:', {_MAIL}, chr(10), 'write')"
_DEFAULT_PATTERNS = [t for t in o.DEFAULTS if t in o.PATTERN_TYPES]
_MASKING = (
    [_N, _HEADERS, _PARTS]
    + o.spans(f"SELECT note_id AS id, {_combined(_VISIBLE)} AS text FROM n WHERE note_id % 10 <> 4", _DEFAULT_PATTERNS)
    + o.keys()
    + o.folds()
)
MASKED_HEADERS_SQL = o.with_(
    _MASKING,
    f"SELECT path, CAST(ord AS INTEGER) AS ord, name, {o.fold('value')} AS value FROM h LEFT JOIN maps "
    "ON scope = note_id WHERE name <> 'Content-Type'",
)


def _masked_html() -> str:
    mail = o.fold(f"concat('mailto:', {_MAIL})")
    return (
        "concat('<p title=\"', c_name, '\">', c_name, ' &amp; co, <a href=\"', "
        f"replace(replace({mail}, '<', '&lt;'), '>', '&gt;'), '\">write</a></p><script>var u=\"', {_MAIL}, '\"</script>')"
    )


MASKED_PARTS_SQL = o.with_(
    _MASKING,
    f"SELECT p.path, part_path, kind, CASE WHEN kind = 'html' THEN {_masked_html()} ELSE {o.fold('p.text')} END AS text "
    "FROM p JOIN (SELECT note_id, cust_id, c_name FROM n) USING (note_id) LEFT JOIN maps ON scope = note_id "
    "WHERE p.text IS NOT NULL",
)
MASKED_EDGES_SQL = o.with_(
    _MASKING,
    f"SELECT path, kind, {o.fold('text')} AS text FROM p LEFT JOIN maps ON scope = note_id "
    "WHERE kind IN ('preamble', 'epilogue')",
)
ATTACHMENTS_SQL = o.with_(
    _MASKING,
    f"SELECT path, part_path, concat(substr(sha256(concat('{SALT}|', path, '/', part_path, '|', filename)), 1, 12), '.csv') "
    f"AS filename, {o.fold('text')} AS content, maintype, subtype, disposition, charset, content_id "
    "FROM p LEFT JOIN maps ON scope = note_id WHERE kind = 'named_text'",
)
QUARANTINE_SQL = (
    f"WITH {_N}, {_PARTS} SELECT p.path, CASE WHEN maintype = 'text' THEN 'unreadable_text' ELSE 'binary_pdf' END AS status, "
    "part_path, filename, CASE WHEN maintype = 'text' THEN n.text ELSE concat('junk', note_id) END AS content "
    "FROM p JOIN n USING (note_id) WHERE p.text IS NULL UNION ALL "
    "SELECT path, 'no_headers', NULL, NULL, NULL FROM n WHERE note_id % 10 = 4"
)
ATTACHMENT_REPORT_SQL = (
    f"WITH {_N}, {_PARTS} SELECT concat(maintype, '/', subtype) AS content_type, count(*) AS attachments "
    "FROM p WHERE filename IS NOT NULL GROUP BY 1"
)
