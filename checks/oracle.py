"""The expected results in DuckDB SQL, written relationally: candidates are rows, not
arrays, and the patterns use RE2 without look-around or possessive quantifiers.

Each builder returns a list of common table expressions or a full statement.
"""

from __future__ import annotations

# Rank of the entity types.
RANKS = (
    "IBAN_CODE CREDIT_CARD CRYPTO MEDICAL_LICENSE EMAIL_ADDRESS URL IP_ADDRESS US_ITIN US_SSN "
    "PHONE_NUMBER DATE_TIME PERSON LOCATION NRP US_DRIVER_LICENSE US_PASSPORT US_BANK_NUMBER"
).split()
PATTERN_TYPES = [t for t in RANKS if t not in ("PERSON", "LOCATION", "NRP")]
FOUR = ["CREDIT_CARD", "EMAIL_ADDRESS", "IP_ADDRESS", "PHONE_NUMBER"]
DEFAULTS = ["PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "LOCATION", "US_SSN", "CREDIT_CARD"]

_TOKEN = r"\p{L}*[0-9][\p{L}0-9]*"
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]{0,6}"
SCANS = {
    "token": _TOKEN,
    "dashed": _TOKEN + r"(?:-[\p{L}0-9]+)+",
    "dotted": _TOKEN + r"(?:\.[\p{L}0-9]+)+",
    "colons": r"[\p{L}0-9]*:[\p{L}0-9]*:[\p{L}0-9:]*",
    "spaced": r"[0-9]{4}(?: [0-9]{4}){3}[\p{L}0-9]*|[0-9]{4} [0-9]{6} [0-9]{4,5}[\p{L}0-9]*|" + _TOKEN,
    "email": r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z0-9-]+",
    "url": r"(?i:https?://|www\.)[^\x00-\x20<>\x22\x27]*[^\x00-\x20<>\x22\x27.,;:!?)\]}]",
    "phone": r"\+[0-9]{1,3}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})){2,5}|\([0-9]{3}\) ?[0-9]{3}[.-][0-9]{4}",
    "dates": r"\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?"
    r"|[0-9]{1,2}/[0-9]{1,2}/(?:[0-9]{4}|[0-9]{2})|" + _MONTH + r"\.? [0-9]{1,2}(?:st|nd|rd|th)?,? [0-9]{4}"
    r"|[0-9]{1,2} " + _MONTH + r"\.? [0-9]{4}|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?: ?[AaPp][Mm])?"
    r"|(?i:yesterday|today|tomorrow|tonight|(?:last|next|this) (?:week|month|year)))\b",
    "licence": r"(?i:driver(?:[\x27’]?s)? licen[cs]e(?: (?:no\.?|number))?[ :#]{1,3})([A-Za-z0-9]{5,18})",
}


def _full(pattern: str) -> str:
    return f"regexp_full_match(value, '{pattern}')"


_DIGITS = "regexp_replace(value, '[ -]', '', 'g')"
_LUHN = (
    f"length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length({_DIGITS})), lambda i: "
    f"CASE WHEN i % 2 = 0 THEN CAST(substr(reverse({_DIGITS}), i + 1, 1) AS INT) "
    f"ELSE CAST(substr(reverse({_DIGITS}), i + 1, 1) AS INT) * 2 "
    f"- CASE WHEN CAST(substr(reverse({_DIGITS}), i + 1, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
)
_IBAN_DIGITS = (
    "list_aggregate(list_transform(string_split(concat(substr(value, 5), substr(value, 1, 4)), ''), "
    "lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), 'string_agg', '')"
)
# The remainder of a number of up to 68 digits, in steps of seven digits.
_MOD97 = (
    f"list_reduce(list_transform(range(10), lambda i: substr({_IBAN_DIGITS}, i * 7 + 1, 7)), lambda a, b: "
    "CASE WHEN b = '' THEN a ELSE CAST(CAST(concat(a, b) AS BIGINT) % 97 AS VARCHAR) END) = '1'"
)
_DEA = (
    "(CAST(substr(value,3,1) AS INT) + CAST(substr(value,5,1) AS INT) + CAST(substr(value,7,1) AS INT) + 2 * ("
    "CAST(substr(value,4,1) AS INT) + CAST(substr(value,6,1) AS INT) + CAST(substr(value,8,1) AS INT))) % 10 "
    "= CAST(substr(value,9,1) AS INT)"
)


_B58, _B32 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz", "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
# The number in base 58 as 50 hex digits: bytes, the smallest first, with a carry.
_B58_BYTES = (
    f"list_reduce(list_prepend(list_resize([0::BIGINT], 25, 0), list_transform(string_split(value, ''), "
    f"lambda c: [CAST(instr('{_B58}', c) - 1 AS BIGINT)])), lambda n, d: list_reduce(list_prepend([d[1]], "
    "list_transform(n, lambda x: [x])), lambda a, x: list_concat(list_concat([(x[1] * 58 + a[1]) // 256], a[2:]), [(x[1] * 58 + a[1]) % 256]))[2:])"
)
_HEX50 = f"list_aggregate(list_transform(list_reverse({_B58_BYTES}), lambda b: lower(lpad(to_hex(b), 2, '0'))), 'string_agg', '')"
_BASE58CHECK = (
    f"list_bool_and(list_transform([{_HEX50}], lambda h: length(h) = 50 AND right(h, 8) = "
    "left(sha256(unhex(sha256(unhex(left(h, 42))))), 8) "
    "AND length(regexp_extract(h, '^(?:00)*')) = 2 * length(regexp_extract(value, '^1*'))))"
)
_B32_LIST = f"list_transform(string_split(substr(value, 4), ''), lambda c: CAST(instr('{_B32}', c) - 1 AS BIGINT))"
_B32_SUM = (
    f"list_reduce(list_concat([1::BIGINT, 3, 3, 0, 2, 3], {_B32_LIST}), lambda k, v: list_reduce(list_concat("
    "[xor(((k & 33554431) << 5), v)], list_transform(range(5), lambda i: CASE WHEN ((k >> 25) >> i) & 1 = 1 THEN "
    "[996825010, 642813549, 513874426, 1027748829, 705979059][i + 1] ELSE 0 END)), lambda a, b: xor(a, b)))"
)
_B32_BITS = "(length(value) - 10) * 5"
_BECH32_CHECK = (
    f"CASE WHEN value[4] = 'q' THEN {_B32_BITS} // 8 IN (20, 32) AND {_B32_SUM} = 1 "
    f"ELSE instr('{_B32}', value[4]) <= 17 AND {_B32_BITS} // 8 BETWEEN 2 AND 40 AND {_B32_SUM} = 734539939 END "
    f"AND {_B32_BITS} % 8 < 5 AND (instr('{_B32}', value[-7]) - 1) % (1 << ({_B32_BITS} % 8)) = 0"
)


def _checked(shape: str, check: str) -> str:
    return f"CASE WHEN {shape} THEN {check} ELSE false END"


RULES = [
    ("token", "IBAN_CODE", _checked(_full("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"), _MOD97)),
    ("token", "CREDIT_CARD", _checked(_full("[0-9]{12,19}"), _LUHN)),
    (
        "token",
        "CRYPTO",
        _checked(
            _full("[13][1-9A-HJ-NP-Za-km-z]{25,34}"),
            _BASE58CHECK,
        )
        + " OR "
        + _checked(_full("bc1[02-9ac-hj-np-z]{11,71}"), _BECH32_CHECK),
    ),
    ("token", "MEDICAL_LICENSE", _checked(_full("[A-Za-z]{2}[0-9]{7}"), _DEA)),
    ("token", "US_ITIN", _full("9[0-9]{8}")),
    ("token", "US_PASSPORT", _full("[A-Za-z0-9][0-9]{8}")),
    ("token", "US_BANK_NUMBER", _full("[0-9]{8,17}")),
    ("dashed", "CREDIT_CARD", _checked(_full("[0-9]{4}(?:-[0-9]{1,6}){2,4}"), _LUHN)),
    ("dashed", "US_ITIN", _full("9[0-9]{2}-[0-9]{2}-[0-9]{4}")),
    (
        "dashed",
        "US_SSN",
        _full("[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}")
        + " AND value[1:3] NOT IN ('000', '666') AND value[5:6] <> '00' AND value[8:11] <> '0000'",
    ),
    ("dashed", "PHONE_NUMBER", _full("(?:1-)?[0-9]{3}-[0-9]{3}-[0-9]{4}")),
    (
        "dotted",
        "IP_ADDRESS",
        _checked(
            _full(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
            "list_max(list_transform(string_split(value, '.'), lambda o: CAST(o AS INT))) <= 255",
        ),
    ),
    ("dotted", "PHONE_NUMBER", _full(r"[0-9]{3}\.[0-9]{3}\.[0-9]{4}")),
    (
        "colons",
        "IP_ADDRESS",
        _full("(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}")
        + " OR ("
        + _full("(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?")
        + " AND len(regexp_extract_all(value, '[0-9A-Fa-f]+')) BETWEEN 1 AND 7)",
    ),
    (
        "spaced",
        "CREDIT_CARD",
        _checked(_full("[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{4,5}"), _LUHN),
    ),
    ("email", "EMAIL_ADDRESS", "regexp_matches(value, '@.*[.][A-Za-z]{2}')"),
    ("url", "URL", "true"),
    ("phone", "PHONE_NUMBER", "length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 7 AND 15"),
    ("dates", "DATE_TIME", "true"),
    ("licence", "US_DRIVER_LICENSE", _full("[A-Za-z]{0,3}[0-9]{4,14}[A-Za-z]?")),
]

NOTES = """SELECT o_orderkey AS note_id, o_custkey AS cust_id, r_name AS region, c_name, n_name, concat(
 'Order ', cast(o_orderkey AS string), ' for ', c_name, ' in ', n_name, ', ', r_name,
 ' on ', cast(cast(o_orderdate AS date) AS string),
 '. Mail user', cast(c_custkey AS string), '@example.com or call +1 (',
 cast(200 + c_custkey % 700 AS string), ') 555-', lpad(cast(o_orderkey % 10000 AS string), 4, '0'), '. ',
 CASE o_orderkey % 12
  WHEN 0 THEN concat('SSN ', cast(100 + c_custkey % 500 AS string), '-', lpad(cast(1 + c_custkey % 99 AS string), 2, '0'), '-', lpad(cast(1 + o_orderkey % 9999 AS string), 4, '0'))
  WHEN 1 THEN concat('See https://shop.example.com/o/', cast(o_orderkey AS string), '?x=1.')
  WHEN 2 THEN concat('From 10.', cast(c_custkey % 300 AS string), '.0.', cast(o_orderkey % 256 AS string))
  WHEN 3 THEN 'Card 4111 1111 1111 1111, not 4111111111111112'
  WHEN 4 THEN 'IBAN GB82WEST12345698765432, not GB83WEST12345698765432'
  WHEN 5 THEN 'Wallet 1BoatSLRHtKNngkdXEeobR76b53LETtpyT, not 1BoatSLRHtKNngkdXEeobR76b53LETtpyU'
  WHEN 6 THEN 'DEA AB1234563, not AB1234564'
  WHEN 7 THEN concat('Account ', cast(10000000000 + o_orderkey AS string))
  WHEN 8 THEN concat('Driver license D', cast(1000000 + c_custkey AS string))
  WHEN 9 THEN concat('ITIN 9', lpad(cast(c_custkey % 100 AS string), 2, '0'), '-70-', lpad(cast(o_orderkey % 10000 AS string), 4, '0'))
  WHEN 10 THEN concat('Passport C', cast(10000000 + o_orderkey AS string), '; host 2001:db8::1')
  ELSE concat('Spanish customer, seen yesterday. ', c_name, 'X is someone else.') END) AS text
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""

DUCK_NOTES = NOTES.format(orders="orders", customer="customer", nation="nation", region="region")
DOCUMENTS = "SELECT doc_id AS id, text FROM documents"
NOTE_TEXTS = f"SELECT note_id AS id, text FROM ({DUCK_NOTES})"
TERMS = (
    "SELECT DISTINCT c_name AS term, 'PERSON' AS entity_type FROM customer UNION ALL "
    "SELECT DISTINCT n_name, 'LOCATION' FROM nation UNION ALL SELECT DISTINCT r_name, 'LOCATION' FROM region "
    "UNION ALL SELECT unnest(['Spanish', 'French', 'German']), 'NRP'"
)


def with_(ctes: list[str], final: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + final


def _positions(name: str, pattern: str) -> list[str]:
    """Every match with its place, from the lengths of what stands before it."""
    value = f"regexp_extract_all(text, '{pattern}', {1 if name == 'licence' else 0})"
    return [
        f"{name}_all AS MATERIALIZED (SELECT id, regexp_extract_all(text, '{pattern}') AS m, {value} AS v, "
        f"string_split_regex(text, '{pattern}') AS g FROM src)",
        f"{name}_at AS MATERIALIZED (SELECT id, unnest(range(1, len(m) + 1)) AS i, m, v, g FROM {name}_all WHERE len(m) > 0)",
        f"{name}_hits AS MATERIALIZED (SELECT id, v[i] AS value, list_sum(list_transform(g[1:i], lambda x: length(x))) "
        f"+ list_sum(list_transform(m[1:i], lambda x: length(x))) AS stop FROM {name}_at)",
    ]


def spans(src: str, entities: list[str]) -> list[str]:
    """CTE ``spans(id, start, end, entity_type, value)`` over ``src(id, text)``."""
    rules = [r for r in RULES if r[1] in entities]
    ctes = [f"src AS MATERIALIZED ({src})"]
    for scan in dict.fromkeys(r[0] for r in rules):
        ctes += _positions(scan, SCANS[scan])
    found = " UNION ALL ".join(
        f"SELECT id, CAST(stop - length(value) AS INTEGER) AS start, CAST(stop AS INTEGER) AS \"end\", "
        f"'{t}' AS entity_type, value FROM {scan}_hits WHERE {test}"
        for scan, t, test in rules
    )
    return ctes + [f"spans AS MATERIALIZED ({found})"]


def term_spans(terms: str = TERMS) -> list[str]:
    """CTE ``spans`` for a table of terms that never overlap, over ``src``."""
    edge = r"[\p{L}0-9]"
    return [
        f"terms AS MATERIALIZED ({terms})",
        # Each term is cut out of the text; the pieces before it give its place.
        "pieces AS (SELECT id, text, term, entity_type, string_split(text, term) AS g FROM src JOIN terms "
        "ON contains(text, term))",
        "places AS (SELECT id, text, term, entity_type, g, unnest(range(1, len(g))) AS i FROM pieces)",
        "located AS (SELECT id, text, term, entity_type, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) "
        "+ (i - 1) * length(term) AS INTEGER) AS start FROM places)",
        "spans AS (SELECT id, start, CAST(start + length(term) AS INTEGER) AS \"end\", entity_type, term AS value "
        f"FROM located WHERE NOT regexp_matches(concat(substr(text, start, CASE WHEN start = 0 THEN 0 ELSE 1 END), ' '), '^{edge}') "
        f"AND NOT regexp_matches(concat(substr(text, start + length(term) + 1, 1), ' '), '^{edge}'))",
    ]


RANK_CASE = "CASE entity_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(RANKS, 1)) + " END"


def keys(scope: str = "id", spans_table: str = "spans") -> list[str]:
    """CTE ``keys(scope, value, placeholder)``: one type per value, the first rank."""
    return [
        f"keys AS MATERIALIZED (SELECT {scope} AS scope, value, concat('<', arg_min(entity_type, {RANK_CASE}), '>') "
        f"AS placeholder FROM {spans_table} GROUP BY {scope}, value)"
    ]


def folds(group: str = "scope", table: str = "keys") -> list[str]:
    """CTE ``maps(scope, k)``: the keys of a scope in masking order."""
    return [
        f"maps AS MATERIALIZED (SELECT {group} AS scope, list(struct_pack(t := value, r := placeholder) "
        f"ORDER BY length(value) DESC, value) AS k FROM {table} GROUP BY {group})"
    ]


def fold(text: str, k: str = "k") -> str:
    """Replace the keys one after the other."""
    return (
        f"CASE WHEN {k} IS NULL THEN {text} ELSE list_reduce({k}, lambda a, x: "
        f"struct_pack(t := replace(a.t, x.t, x.r), r := ''), struct_pack(t := {text}, r := '')).t END"
    )


def scrubbed(src: str, entities: list[str], id_name: str, extra: str = "") -> str:
    """Row scope: each text masked with its own keys."""
    return with_(
        spans(src, entities) + keys() + folds(),
        f"SELECT id AS {id_name}, {fold('text')} AS masked{extra} FROM src LEFT JOIN maps ON scope = id",
    )


def scoped(src: str, entities: list[str], id_name: str, spans_ctes: list[str] | None = None) -> str:
    """Group scope over ``src(id, scope_id, text)``; only keys that a text holds are folded."""
    ctes = spans_ctes or spans(src, entities)
    return with_(
        ctes
        + ["scoped_spans AS (SELECT scope_id, value, entity_type FROM spans JOIN src USING (id))"]
        + keys("scope_id", "scoped_spans")
        + [
            "held AS MATERIALIZED (SELECT id, value, placeholder FROM src JOIN keys ON scope = scope_id "
            "AND contains(text, value))"
        ]
        + folds("id", "held"),
        f"SELECT id AS {id_name}, {fold('text')} AS masked FROM src LEFT JOIN maps ON scope = id",
    )
