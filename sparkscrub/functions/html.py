"""Masking of HTML: text between tags and four attributes, markup kept.

The page is cut into tokens by one pattern and put together again, so everything
that is not masked stays byte for byte as it was; unclosed tags do not matter.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkscrub.functions.mask import replace_sql
from sparkscrub.functions.sqltext import let, literal, name, raw

# The token patterns, and the attributes that are masked. A tag starts with
# a letter or one of / ! ? after the bracket; in quotes a bracket does not end it.
TAG = r"<[A-Za-z/!?](?:[^>\x22\x27]|\x22[^\x22]*\x22|\x27[^\x27]*\x27)*+>|<[A-Za-z/!?][^>]*>"
HTML_TOKEN = (
    r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|" + TAG + r"|[^<]+|<"
)
MASKED_ATTRIBUTES = ("href", "src", "content", "value")
ATTRIBUTE_START = r"(?i)^\s(?:" + "|".join(MASKED_ATTRIBUTES) + r")\s*=\s*[\x22\x27]?"
TAG_PIECE = (
    r"(?is)\s(?:" + "|".join(MASKED_ATTRIBUTES) + r")\s*=\s*"
    r"(?:\x22[^\x22]*\x22|\x27[^\x27]*\x27|[^\s>\x22\x27]+)"
    r"|\x22[^\x22]*\x22|\x27[^\x27]*\x27|[^\s\x22\x27]+|."
)
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"

_NAMED = (
    "map("
    + ", ".join(
        f"{literal(entity)}, {literal(chr(code))}"
        for entity, code in sorted({**name2codepoint, "apos": 39}.items())
    )
    + ")"
)


def _entity_sql(entity: str) -> str:
    """The character of one entity; an unknown entity stays as it is."""

    def char(code: str) -> str:
        return let(
            code,
            lambda c: f"CASE WHEN {c} BETWEEN 1 AND 55295 OR {c} BETWEEN 57344 AND 1114111 "
            f"THEN decode(unhex(lpad(hex({c}), 8, '0')), 'UTF-32') ELSE {entity} END",
            "c",
        )

    inner = f"substring({entity}, 2, length({entity}) - 2)"
    hexa = f"cast(conv(substring({entity}, 4, length({entity}) - 4), 16, 10) AS int)"
    deci = f"cast(substring({entity}, 3, length({entity}) - 3) AS int)"
    return (
        f"CASE WHEN {entity} RLIKE '^&#[xX]' THEN {char(hexa)} WHEN {entity} RLIKE '^&#' THEN {char(deci)} "
        f"ELSE coalesce({_NAMED}[{inner}], {entity}) END"
    )


def unescape_sql(text: str) -> str:
    """Entities to characters."""
    e, g = name("e"), name("g")
    found = f"transform(regexp_extract_all({text}, {raw(ENTITY)}, 0), {e} -> {_entity_sql(e)})"
    gaps = f"split({text}, {raw(ENTITY)}, -1)"
    joined = (
        f"array_join(zip_with({gaps}, concat({found}, array('')), ({g}, {e}) -> concat({g}, {e})), '')"
    )
    return f"CASE WHEN contains({text}, '&') THEN {joined} ELSE {text} END"


def escape_sql(text: str) -> str:
    """The characters that must not stand in HTML text, to entities."""
    return f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def tokens_sql(html: str) -> str:
    return f"regexp_extract_all({html}, {raw(HTML_TOKEN)}, 0)"


def _is_comment(token: str) -> str:
    return f"({token} LIKE '<!--%-->' AND length({token}) >= 7)"


def _is_markup(token: str) -> str:
    return f"({token} RLIKE {raw('(?s)^<[A-Za-z/!?].*>$')})"


def _masked_value(value: str, keys: str, quoted: bool) -> str:
    """Decode, mask, encode; an untouched value keeps its spelling."""

    def body(plain: str) -> str:
        return let(
            replace_sql(plain, keys),
            lambda m: f"CASE WHEN {m} = {plain} THEN {value} ELSE "
            + (f"""replace({escape_sql(m)}, '"', '&quot;')""" if quoted else escape_sql(m))
            + " END",
            "m",
        )

    return let(unescape_sql(value), body, "u")


def _attribute_parts(piece: str) -> tuple[str, str, str]:
    """SQL of an attribute's name with the opening quote, its value, its closing quote."""
    start = f"regexp_extract({piece}, {raw(ATTRIBUTE_START)}, 0)"
    end = f"CASE WHEN right({start}, 1) IN ('\"', '\\'') THEN 1 ELSE 0 END"
    value = f"substring({piece}, length({start}) + 1, length({piece}) - length({start}) - {end})"
    return start, value, f"right({piece}, {end})"


def _mask_tag(tag: str, keys: str) -> str:
    p = name("p")
    start, value, end = _attribute_parts(p)
    masked = let(value, lambda v: f"concat({start}, {_masked_value(v, keys, True)}, {end})", "v")
    pieces = f"regexp_extract_all({tag}, {raw(TAG_PIECE)}, 0)"
    return (
        f"CASE WHEN contains({tag}, '=') THEN array_join(transform({pieces}, {p} -> "
        f"CASE WHEN {p} RLIKE {raw(ATTRIBUTE_START)} THEN {masked} ELSE {p} END), '') ELSE {tag} END"
    )


def mask_html_sql(html: str, keys: str) -> str:
    """Mask a page with ordered keys.

    Text within script and style stays; of those blocks only the attributes of the
    opening tag are masked. A comment is masked inside and stays a comment.
    """
    t = name("t")
    head = f"regexp_extract({t}, {raw('^(?:' + TAG + ')')}, 0)"
    comment = f"concat('<!--', {replace_sql(f'substring({t}, 5, length({t}) - 7)', keys)}, '-->')"
    tag = let(head, lambda h: f"concat({_mask_tag(h, keys)}, substring({t}, length({h}) + 1))", "h")
    token = (
        f"CASE WHEN {_is_comment(t)} THEN {comment} WHEN {_is_markup(t)} THEN {tag} "
        f"ELSE {_masked_value(t, keys, False)} END"
    )
    masked = f"array_join(transform({tokens_sql(html)}, {t} -> {token}), '')"
    return f"CASE WHEN size({keys}) = 0 THEN {html} ELSE {masked} END"


def html_text_sql(html: str) -> str:
    """What is analysed of a page: decoded text, comments and masked attributes, a line each.

    Departure: analysing decoded text, not the source, lets a value be found again
    where it is masked, also when it holds an entity.
    """
    t, p, x = name("t"), name("p"), name("x")
    _, value, _ = _attribute_parts(p)
    head = f"regexp_extract({t}, {raw('^(?:' + TAG + ')')}, 0)"
    pieces = f"regexp_extract_all({head}, {raw(TAG_PIECE)}, 0)"
    values = (
        f"CASE WHEN contains({t}, '=') THEN transform(filter({pieces}, {p} -> {p} RLIKE {raw(ATTRIBUTE_START)}), "
        f"{p} -> {let(value, unescape_sql, 'v')}) ELSE array() END"
    )
    lines = (
        f"flatten(transform({tokens_sql(html)}, {t} -> CASE "
        f"WHEN {_is_comment(t)} THEN array(substring({t}, 5, length({t}) - 7)) "
        f"WHEN {_is_markup(t)} THEN {values} ELSE array({unescape_sql(t)}) END))"
    )
    return f"array_join(filter({lines}, {x} -> {x} RLIKE {raw(chr(92) + 'S')}), '\\n')"


def mask_html(html: str, keys: str) -> Column:
    """Column of the page masked with a column of ordered keys."""
    return F.expr(let(html, lambda h: let(keys, lambda k: mask_html_sql(h, k), "k"), "h"))


def html_text(html: str) -> Column:
    """Column of the text of a page that detection looks at."""
    return F.expr(let(html, html_text_sql, "h"))
