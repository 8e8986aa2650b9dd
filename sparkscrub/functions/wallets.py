"""Checksums of wallet addresses, as SQL expressions over one candidate.

Base58Check: 25 bytes written in base 58, of which the last four begin the double SHA-256 of
the others. Bech32 and Bech32m: symbols of five bits whose checksum is a polynomial
remainder; version 0 has the constant of the first, later versions that of the second.
"""

from __future__ import annotations

from sparkscrub.functions.sqltext import let, literal, name

# Fixed values of the published address formats.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATORS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
BECH32_CONSTANT, BECH32M_CONSTANT = 1, 0x2BC830A3

BASE58_SHAPE = "[13][1-9A-HJ-NP-Za-km-z]{25,34}"
BECH32_SHAPE = "bc1[02-9ac-hj-np-z]{11,71}"

# An address of 35 digits has 206 bits: seven limbs of 32 bits, the smallest first, take five
# digits in each step (58 ** 5 is below 2 ** 30, so no product leaves 63 bits).
_LIMBS, _BITS = 7, 32
_DIGITS, _STEP = 35, 5


def _symbols(value: str, alphabet: str) -> str:
    c = name("c")
    return f"transform(split({value}, ''), {c} -> cast(position({c}, {literal(alphabet)}) - 1 AS bigint))"


def _number_hex(value: str) -> str:
    """The number that base-58 digits write, as 56 hex digits."""
    n, d, s, x, h, i, v = (name(c) for c in "ndsxhiv")
    limb, base = (1 << _BITS) - 1, 58**_STEP
    # Written at full length; the first digit of the alphabet is zero.
    digits = [
        f"(position(substring({v}, {i} + {k}, 1), {literal(BASE58)}) - 1L) * {58 ** (_STEP - 1 - k)}L" for k in range(_STEP)
    ]
    starts = ", ".join(str(1 + k) for k in range(0, _DIGITS, _STEP))
    symbols = let(
        f"lpad({value}, {_DIGITS}, '{BASE58[0]}')", lambda own: f"transform(array({starts}), {i} -> {' + '.join(digits)})".replace(v, own)
    )
    step = (
        f"aggregate({n}, named_struct('carry', {d}, 'out', cast(array() AS array<bigint>)), ({s}, {x}) -> "
        f"named_struct('carry', shiftrightunsigned({x} * {base}L + {s}.carry, {_BITS}), "
        f"'out', array_append({s}.out, ({x} * {base}L + {s}.carry) & {limb}L)), {s} -> {s}.out)"
    )
    limbs = f"aggregate({symbols}, array_repeat(0L, {_LIMBS}), ({n}, {d}) -> {step})"
    return f"array_join(transform(reverse({limbs}), {h} -> lpad(lower(hex({h})), 8, '0')), '')"


def base58check_sql(value: str) -> str:
    """SQL test of an address of ``BASE58_SHAPE``."""

    def check(h: str) -> str:
        sha = f"sha2(unhex(sha2(unhex(substring({h}, 7, 42)), 256)), 256)"
        zeros = f"length(regexp_extract(substring({h}, 7), '^(?:00)*', 0))"
        ones = f"length(regexp_extract({value}, '^1*', 0))"
        return f"left({h}, 6) = '000000' AND right({h}, 8) = left({sha}, 8) AND {zeros} = 2 * {ones}"

    return f"({let(_number_hex(value), check, 'h')})"


def _remainder(symbols: str) -> str:
    """The polynomial remainder of the symbols after the prefix ``bc``."""
    k, v, g = name("k"), name("v"), name("g")
    terms = " ^ ".join(f"IF({g}.top & {1 << i}L = 0, 0L, {x}L)" for i, x in enumerate(GENERATORS))
    mixed = let(
        f"named_struct('top', shiftright({k}, 25), 'rest', shiftleft({k} & 33554431L, 5) ^ {v})",
        lambda own: f"{own}.rest ^ " + terms.replace(g, own),
        "g",
    )
    return f"aggregate(concat(array(3L, 3L, 0L, 2L, 3L), {symbols}), 1L, ({k}, {v}) -> {mixed})"


def bech32_sql(value: str) -> str:
    """SQL test of an address of ``BECH32_SHAPE``: checksum, version, length and padding."""

    def check(s: str) -> str:
        version = f"element_at({s}, 1)"
        constant = f"IF({version} = 0, {BECH32_CONSTANT}L, {BECH32M_CONSTANT}L)"
        # Symbols of the program; its bits are whole bytes and fewer than five zeros.
        size = f"(size({s}) - 7)"
        left = f"({size} * 5 % 8)"
        padded = f"{left} < 5 AND element_at({s}, -7) & (shiftleft(1L, {left}) - 1) = 0"
        length = f"IF({version} = 0, {size} * 5 div 8 IN (20, 32), {size} * 5 div 8 BETWEEN 2 AND 40)"
        return f"{version} <= 16 AND {length} AND {padded} AND {_remainder(s)} = {constant}"

    return f"({let(_symbols(f'substring({value}, 4)', BECH32), check, 's')})"


def wallet_sql(value: str) -> str:
    """SQL test: is a candidate a wallet address?"""
    return (
        f"CASE WHEN {value} RLIKE r'^(?:{BASE58_SHAPE})$' THEN {base58check_sql(value)} "
        f"WHEN {value} RLIKE r'^(?:{BECH32_SHAPE})$' THEN {bech32_sql(value)} ELSE false END"
    )
