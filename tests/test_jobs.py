"""Streams, plug-ins, SQL functions, sources, sinks and reports."""

import pytest
from pyspark.sql import functions as F

from sparkscrub.functions import mask
from sparkscrub.functions.sqlfunctions import register_functions
from sparkscrub.operators import reports
from sparkscrub.operators.detect import detect, explode_spans, select_spans
from sparkscrub.operators.scrub import scrub
from sparkscrub.plans.handlers import Handler
from sparkscrub.plans.providers import model_provider, pattern_provider, scrub_with_provider
from sparkscrub.sources.tables import text_parts, write_masked
from sparkscrub.streaming.jobs import read_text_stream, scrub_stream, write_masked_stream

DOCS = "/root/testdata/sf0.001/documents.parquet"


def test_stream_is_batch(spark, tmp_path):
    schema = spark.read.parquet(DOCS).schema
    source = str(tmp_path / "in")
    docs = spark.read.parquet(DOCS)
    docs.where("doc_id % 2 = 0").write.parquet(source)

    def run():
        stream = read_text_stream(spark, source, schema, maxFilesPerTrigger="1")
        masked = scrub_stream(stream, entities=["EMAIL_ADDRESS", "IP_ADDRESS"])
        query = write_masked_stream(
            masked, str(tmp_path / "out"), str(tmp_path / "log"), drop=["text"], available_now=True
        )
        query.awaitTermination()

    run()
    docs.where("doc_id % 2 = 1").write.mode("append").parquet(source)
    run()  # goes on where the first run stopped
    got = spark.read.parquet(str(tmp_path / "out"))
    assert "text" not in got.columns
    want = scrub(docs, entities=["EMAIL_ADDRESS", "IP_ADDRESS"]).select("doc_id", "masked")
    assert got.count() == docs.count()
    assert got.select("doc_id", "masked").exceptAll(want).count() == 0


def test_stream_limits(spark):
    docs = spark.read.parquet(DOCS)
    with pytest.raises(ValueError):
        scrub_stream(docs)
    stream = read_text_stream(spark, "/root/testdata/sf0.001", docs.schema, pathGlobFilter="documents.parquet")
    with pytest.raises(ValueError):
        scrub_stream(stream, terms=spark.createDataFrame([("a", "PERSON")], "term string, entity_type string"))


def test_write_masked(spark, tmp_path):
    masked = scrub(spark.read.parquet(DOCS), entities=["EMAIL_ADDRESS"])
    write_masked(masked, str(tmp_path / "p"), drop=["text"], partition_by=["lang"])
    back = spark.read.parquet(str(tmp_path / "p"))
    assert "text" not in back.columns and back.count() == masked.count()
    write_masked(masked, str(tmp_path / "j"), "json", drop=["text"])
    assert spark.read.json(str(tmp_path / "j")).count() == masked.count()
    with pytest.raises(ValueError):
        write_masked(masked, str(tmp_path / "x"), drop=["no_such"])


def test_text_parts(spark):
    turns = spark.createDataFrame([(7, 0, "a"), (7, 1, "b")], "conv int, turn int, t string")
    rows = text_parts(turns, "t", ["conv"], ["conv", "turn"]).orderBy("part_no").collect()
    assert [tuple(r) for r in rows] == [("7", "7/0", 0, "text", "a"), ("7", "7/1", 1, "text", "b")]
    assert text_parts(turns, "t", key=["turn"], kind="html").first()["kind"] == "html"


def test_model_is_loaded_once_per_worker(spark):
    def load():
        calls = []

        def model(text):
            calls.append(text)
            return {text.split()[0]: f"<{'' if calls else 'X'}W>"}

        return model

    df = spark.createDataFrame([(1, "ann went"), (2, " "), (3, None), (4, "bob")], "id int, text string").coalesce(1)
    got = scrub_with_provider(df, model_provider(load)).orderBy("id").collect()
    assert [r["masked"] for r in got] == ["<W> went", " ", None, "<W>"]


def test_provider_in_a_scope(spark):
    rows = [(1, "s", "ann met bob"), (2, "s", "annual"), (3, "t", "ann")]
    df = spark.createDataFrame(rows, "id int, s string, text string")
    provider = lambda text: F.when(text.contains("met"), F.create_map(F.lit("ann"), F.lit("<P>"), F.lit("bob"), F.lit("Q")))
    for folded in (0, 10):
        got = scrub_with_provider(df, provider, scope=["s"], key=["id"], max_folded_keys=folded).orderBy("id").collect()
        assert [r["masked"] for r in got] == ["<P> met Q", "<P>ual", "ann"]
    with pytest.raises(ValueError):
        scrub_with_provider(df, provider, scope=["s"])


def test_model_serves_the_tasks_of_a_worker(spark, tmp_path):
    """Several partitions, fewer workers: no more loads than workers."""
    log = str(tmp_path)

    def load():
        import os
        import tempfile

        tempfile.mkstemp(dir=log, prefix=f"{os.getpid()}-")
        return lambda text: {text: "<X>"}

    df = spark.range(400).selectExpr("id", "concat('v', id) AS text").repartition(40)
    assert scrub_with_provider(df, model_provider(load)).where("masked = '<X>'").count() == 400
    loads = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(loads) == len(set(loads)) < 40


def test_replacements_of_a_provider_are_left_alone(spark):
    """The same result whether a scope is folded or looked up."""
    pairs = {"alpha": "name-of-ann", "ann": "X", "beta": "<XW>", "XW": "<Q>", "12345": "<US_SSN>", "SSN": "2"}
    made = F.create_map(*(F.lit(x) for p in pairs.items() for x in p))
    df = spark.createDataFrame([(1, "s", "alpha ann beta XW 12345 SSN \u20ac")], "id int, s string, text string")
    expected = "name-of-ann X <XW> <Q> <US_2> 2 \u20ac"
    assert scrub_with_provider(df, lambda text: made).first()["masked"] == expected
    for folded in (0, 200):
        got = scrub_with_provider(df, lambda text: made, scope=["s"], key=["id"], max_folded_keys=folded)
        assert got.first()["masked"] == expected


def test_stored_tables_are_deleted(spark):
    from pathlib import Path

    from sparkscrub.plans.sizing import _stored, scratch

    df = spark.createDataFrame([(1, "s", "a@b.org")], "id int, s string, text string")
    before = len(_stored)
    with scratch(spark):
        assert scrub(df, scope=["s"], key=["id"], entities=["EMAIL_ADDRESS"]).first()["masked"] == "<EMAIL_ADDRESS>"
        made = [p for _, p in _stored[before:]]
        assert made
    assert len(_stored) == before
    assert not any(Path(p.removeprefix("file:")).exists() for p in made)


def test_sink_asks_for_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "b")], "id int, text string, masked string")
    with pytest.raises(ValueError):
        write_masked(df, str(tmp_path / "a"))
    write_masked(df, str(tmp_path / "b"), keep=["id", "masked"])
    assert spark.read.parquet(str(tmp_path / "b")).columns == ["id", "masked"]


def test_built_in_provider_as_provider(spark):
    df = spark.createDataFrame([("a@b.org",)], "`my text` string")
    got = scrub_with_provider(df, pattern_provider(["EMAIL_ADDRESS"]), "my text").first()
    assert got["masked"] == "<EMAIL_ADDRESS>"


def test_built_in_provider(spark):
    df = spark.createDataFrame([("a@b.org",)], "text string")
    assert df.select(pattern_provider(["EMAIL_ADDRESS"])("text")).first()[0] == {"a@b.org": "<EMAIL_ADDRESS>"}


def test_handler_for_another_kind(spark):
    """A kind whose parts are written backwards."""
    back = Handler(
        mask=lambda text, keys: f"reverse({mask.replace_sql(f'reverse({text})', keys)})",
        analyse=lambda text: f"reverse({text})",
    )
    df = spark.createDataFrame([(1, "text", "a@b.org"), (2, "back", "gro.b@a yb")], "id int, kind string, text string")
    got = scrub(df, kind="kind", handlers={"back": back}).orderBy("id").collect()
    assert [r["masked"] for r in got] == ["<EMAIL_ADDRESS>", "".join(reversed("by <EMAIL_ADDRESS>"))]
    scoped = scrub(df, scope=["kind"], key=["id"], kind="kind", handlers={"back": back}).orderBy("id").collect()
    assert [r["masked"] for r in scoped] == [r["masked"] for r in got]


def test_sql_functions(spark):
    names = register_functions(spark, ["EMAIL_ADDRESS"], {"PERSON": ["Ann"]}, prefix="t_")
    assert names == ["t_spans", "t_map", "t_mask", "t_mask_positions", "t_mask_html"]
    row = spark.sql(
        "SELECT t_mask(x) AS m, t_map(x) AS p, size(t_spans(x)) AS n, t_mask_positions(x) AS q, "
        "t_mask_html(concat('<p>', x, '</p>')) AS h FROM VALUES ('to a@b.org 10.0.0.1') AS v(x)"
    ).first()
    assert row["m"] == row["q"] == "to <EMAIL_ADDRESS> 10.0.0.1" and row["n"] == 1
    assert row["p"] == {"a@b.org": "<EMAIL_ADDRESS>"} and row["h"] == "<p>to &lt;EMAIL_ADDRESS&gt; 10.0.0.1</p>"
    plan = spark.sql("SELECT t_mask(text) FROM VALUES ('a') AS v(text)")
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_reports(spark):
    df = spark.createDataFrame(
        [(1, "s", "a@b.org a@b.org 10.0.0.1"), (2, "s", "a@b.org"), (3, "t", "none"), (4, "t", None)],
        "id int, s string, text string",
    )
    found = detect(df)
    report = {r["entity_type"]: (r["hits"], r["distinct_values"]) for r in reports.entity_report(explode_spans(found)).collect()}
    assert len(report) == 17 and report["EMAIL_ADDRESS"] == (3, 1) and report["IP_ADDRESS"] == (1, 1) and report["URL"] == (0, 0)
    chosen = reports.entity_report(explode_spans(found), ["URL"]).collect()
    assert [(r["entity_type"], r["hits"]) for r in chosen] == [("URL", 0)]
    scopes = {r["s"]: (r["parts"], r["hits"], r["distinct_values"]) for r in reports.scope_report(found, ["s"]).collect()}
    assert scopes == {"s": (2, 4, 2), "t": (2, 0, 0)}
    only = select_spans(explode_spans(found), ["IP_ADDRESS"])
    assert only.count() == 1 and select_spans(explode_spans(found), []).count() == 4

    masked = scrub(df, entities=["EMAIL_ADDRESS"])
    sizes = reports.size_report(masked.where("id < 3"), by=["s"]).first()
    assert (sizes["n_texts"], sizes["original_bytes"], sizes["masked_bytes"]) == (2, 31, 55)
    assert [r["id"] for r in reports.residual_pii(masked).collect()] == [1]
    assert reports.residual_pii(masked, entities=["EMAIL_ADDRESS"]).count() == 0
    broken = masked.withColumn("masked", F.when(F.col("id") == 2, F.col("text")).otherwise(F.col("masked")))
    assert [r["id"] for r in reports.unmasked_rows(broken).collect()] == [2]
    assert sorted(r["id"] for r in reports.rows_without_hits(df, explode_spans(found), ["id"]).collect()) == [3, 4]
    known = spark.createDataFrame([("a@b.org",), ("10.0.0.1",), ("b.or",)], "value string")
    checks = {r["value"]: (r["n_texts"], r["leaked"]) for r in reports.leak_check(broken, known, "masked", ["id"]).collect()}
    assert checks == {"a@b.org": (1, True), "10.0.0.1": (1, True), "b.or": (1, True)}
