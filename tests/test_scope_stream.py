"""Masking per scope as rows arrive."""

import pytest

from sparkscrub.operators.scrub import scrub
from sparkscrub.streaming.jobs import read_text_stream, write_masked_stream
from sparkscrub.streaming.scopes import scrub_scope_stream

SCHEMA = "c int, t int, text string, kind string"


class Feed:
    """Each call lands a file and runs the stream until all is read."""

    def __init__(self, spark, base, **options):
        self.spark, self.base, self.options = spark, str(base), options

    def __call__(self, rows, seconds=None):
        df = self.spark.createDataFrame(rows, SCHEMA).coalesce(1)
        df.write.mode("append").parquet(f"{self.base}/in")
        stream = read_text_stream(self.spark, f"{self.base}/in", df.schema)
        masked = scrub_scope_stream(stream, ["c"], entities=["EMAIL_ADDRESS", "IP_ADDRESS"], **self.options)
        trigger = {"available_now": True} if seconds is None else {"interval": "500 milliseconds"}
        query = write_masked_stream(masked, f"{self.base}/out", f"{self.base}/log", keep=["c", "t", "masked"], **trigger)
        query.awaitTermination(seconds)
        query.stop()

    def masked(self):
        return {(r.c, r.t): r.masked for r in self.spark.read.parquet(f"{self.base}/out").collect()}


def test_values_are_known_from_their_batch_on(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed([(1, 0, "xa@b.org? a@b.org", None), (1, 1, "q a@b.orgz", None), (2, 0, "q a@b.orgz", None)])
    feed([(1, 2, "q a@b.orgz 1.2.3.4x", None), (2, 1, "1.2.3.4", None), (2, 2, None, None), (None, 1, "a@b.org", None)])
    feed([(2, 3, "q1.2.3.4", None), (1, 3, "q1.2.3.4", None), (None, 2, "qa@b.orgz.", None), (3, 1, "", None)])
    got = feed.masked()
    assert got[1, 0] == "<EMAIL_ADDRESS>? <EMAIL_ADDRESS>"
    # The whole token is a value of its own; in a later batch the known part of it is masked.
    assert got[1, 1] == got[2, 0] == "q <EMAIL_ADDRESS>"
    assert got[1, 2].startswith("q <EMAIL_ADDRESS>") and got[2, 1] == "<IP_ADDRESS>" and got[2, 2] is None
    assert got[2, 3] == "q<IP_ADDRESS>" and got[1, 3] == "q1.2.3.4"
    assert got[None, 1] == "<EMAIL_ADDRESS>" and "a@b.org" not in got[None, 2] and got[3, 1] == ""


def test_one_batch_is_what_a_batch_job_does(spark, tmp_path):
    rows = [(c, t, text, None) for c in range(4) for t, text in enumerate(["a@b.org 1.2.3.4 ADDRESS", f"b{c}@b.org q1.2.3.4"])]
    feed = Feed(spark, tmp_path)
    feed(rows)
    want = scrub(spark.createDataFrame(rows, SCHEMA), scope=["c"], key=["t"], entities=["EMAIL_ADDRESS", "IP_ADDRESS"])
    assert feed.masked() == {(r.c, r.t): r.masked for r in want.collect()}


def test_pages_are_masked_as_pages(spark, tmp_path):
    feed = Feed(spark, tmp_path, kind="kind")
    feed([(1, 0, "a&amp;1.2.3.4", "text")])
    feed([(1, 1, "<p title='1.2.3.4'>x1.2.3.4</p>", "html")])
    assert feed.masked()[1, 1] == "<p title='1.2.3.4'>x&lt;IP_ADDRESS&gt;</p>"


def test_unseen_values_are_forgotten(spark, tmp_path):
    feed = Feed(spark, tmp_path, live=1)
    feed([(1, 0, "1.2.3.4", None)], 8)
    feed([(1, 1, "q1.2.3.4", None)], 8)
    assert feed.masked() == {(1, 0): "<IP_ADDRESS>", (1, 1): "q1.2.3.4"}


def test_limits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    with pytest.raises(ValueError):
        scrub_scope_stream(docs, ["source"])
    stream = read_text_stream(spark, "/root/testdata/sf0.001", docs.schema, pathGlobFilter="documents.parquet")
    with pytest.raises(ValueError):
        scrub_scope_stream(stream, ["source"], terms=spark.createDataFrame([("a", "PERSON")], "term string, entity_type string"))
