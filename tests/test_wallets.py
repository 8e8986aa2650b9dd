"""Wallet addresses by their checksums, next to plain models and the SQL of the checks."""

import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from checks import oracle
from sparkscrub.functions.wallets import BASE58, BECH32, wallet_sql
from sparkscrub.operators.detect import detect

# Published examples.
VALID = [
    "1BoatSLRHtKNngkdXEeobR76b53LETtpyT",
    "1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2",
    "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa",
    "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy",
    "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq",
    "bc1qrp33g0q5c5txsp9arysrx4k6zdkfs4nce4xj0gdcccefvpysxf3qccfmv3",
    "bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0",
]


def base58check(version, payload):
    raw = bytes([version]) + payload
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, d = divmod(n, 58)
        out = BASE58[d] + out
    return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + out


def bech32(version, program, constant=None):
    bits = "".join(f"{b:08b}" for b in program)
    data = [version] + [int(bits[i : i + 5].ljust(5, "0"), 2) for i in range(0, len(bits), 5)]

    def remainder(values):
        k = 1
        for v in values:
            top, k = k >> 25, (k & 0x1FFFFFF) << 5 ^ v
            for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
                k ^= g if top >> i & 1 else 0
        return k

    constant = constant or (1 if version == 0 else 0x2BC830A3)
    end = remainder([3, 3, 0, 2, 3, *data, *[0] * 6]) ^ constant
    return "bc1" + "".join(BECH32[d] for d in data + [end >> 5 * (5 - i) & 31 for i in range(6)])


def made():
    pick = random.Random(4)
    good = list(VALID)
    for _ in range(40):
        zeros = pick.choice([0, 0, 2])
        good.append(base58check(pick.choice([0, 5]), bytes(zeros) + pick.randbytes(20 - zeros)))
        good.append(bech32(0, pick.randbytes(pick.choice([20, 32]))))
        good.append(bech32(pick.randrange(1, 17), pick.randbytes(pick.randrange(6, 41))))
    bad = [bech32(0, pick.randbytes(24)), bech32(0, pick.randbytes(20), 0x2BC830A3), bech32(1, pick.randbytes(32), 1)]
    for g in list(good):
        i = pick.randrange(4, len(g))
        letters = BECH32 if g.startswith("bc1") else BASE58
        bad.append(g[:i] + pick.choice([c for c in letters if c != g[i]]) + g[i + 1 :])
        bad.append("1" + g if g[0] == "1" else g[:-1])
    bad += ["1" * 30, "3" + "z" * 34, "34223dad6b454724135a384f69ba12c7d", "", "1Boat0OIl", "bc1" + "q" * 40]
    return good, [b for b in bad if b not in set(good)]


def test_checksums(spark):
    good, bad = made()
    assert len(good) > 100 and len(bad) > 150
    df = spark.createDataFrame([(v,) for v in [*good, *bad]], "value string")
    got = {r.value for r in df.where(F.expr(wallet_sql("value"))).collect()}
    assert got == set(good)


def test_the_sql_of_the_checks_agrees():
    good, bad = made()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (value VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [[v] for v in [*good, *bad]])
    rule = next(test for _, kind, test in oracle.RULES if kind == "CRYPTO")
    assert {r[0] for r in con.execute(f"SELECT value FROM t WHERE {rule}").fetchall()} == set(good)


def test_only_valid_addresses_are_found(spark):
    text = f"pay {VALID[0]}, not {VALID[0][:-1]}x or 3ef4d6b2755a36d7d9c25bd72c4d5f67e; {VALID[6]}."
    df = detect(spark.createDataFrame([(text,)], "text string"), entities=["CRYPTO"])
    assert [s["value"] for s in df.first()["spans"]] == [VALID[0], VALID[6]]
