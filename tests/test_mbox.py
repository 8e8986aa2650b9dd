"""Mailboxes, read by byte ranges and as a stream."""

import random

import pytest
from pyspark.sql import functions as F

from sparkscrub.sources.mbox import read_mbox, read_mbox_messages, write_mbox

HEAD = b"From: a@b.org\nSubject: x\nContent-Type: text/plain; charset=\"utf-8\"\n\n"


def made(n=200):
    pick = random.Random(3)
    lines = [b"From here on", b">From there", b">>From", b"plain", b"", b"\xff\xfe\x00 bytes", "Größe 😀".encode(), b"From", b" From x"]
    rows = []
    for i in range(n):
        body = b"\n".join(pick.choice(lines) for _ in range(pick.randint(0, 30)))
        rows.append((f"m{i} Thu Jan  1 00:00:00 1970", bytearray(HEAD + body.rstrip(b"\n"))))
    return rows


@pytest.mark.parametrize("size", ["64m", "700"])
def test_messages_come_back_as_they_were(spark, tmp_path, size):
    rows, folder = made(), str(tmp_path / "box")
    write_mbox(spark.createDataFrame(rows, "envelope string, content binary").coalesce(2), folder)
    before = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        read = read_mbox(spark, folder)
        # One mailbox is read by many tasks.
        assert read.rdd.getNumPartitions() > (20 if size == "700" else 0)
        got = {r.envelope: bytes(r.content) for r in read.collect()}
        assert read.select("path").distinct().count() == len(rows)
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert got == {e: bytes(c).rstrip(b"\n") for e, c in rows}


def test_other_writers_mailboxes(spark, tmp_path):
    first = b"From a\r\nSubject: one\r\n\r\nhello\r\n\r\nFrom b\r\nSubject: two\r\n\r\n>From me\r\n"
    (tmp_path / "a.mbox").write_bytes(first)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.mbox").write_bytes(b"\nFrom c\nno header at all\n\nFrom d\n")
    (tmp_path / "sub" / "empty.mbox").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"From x\nSubject: not read\n\n")
    rows = {r.envelope: bytes(r.content) for r in read_mbox(spark, str(tmp_path), "*.mbox").collect()}
    assert rows == {"a": b"Subject: one\r\n\r\nhello", "b": b"Subject: two\r\n\r\nFrom me", "c": b"no header at all", "d": b""}
    parsed = read_mbox_messages(spark, str(tmp_path), "*.mbox").collect()
    assert sorted(r.status for r in parsed) == ["no_headers", "no_headers", "ok", "ok"]


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    rows = made(60)
    df = spark.createDataFrame(rows, "envelope string, content binary")

    def run():
        stream = read_mbox(spark, str(tmp_path / "in"), stream=True).select("envelope", F.length("content").alias("n"))
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True)
        query.format("parquet").start(str(tmp_path / "out")).awaitTermination()

    for n in range(2):
        part = df.where(F.crc32(F.encode("envelope", "UTF-8")) % 2 == n)
        write_mbox(part, str(tmp_path / "in" / str(n)))
        run()
    got = [r.envelope for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(e for e, _ in rows)
