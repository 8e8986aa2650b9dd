"""The registered queries: for each a Spark query over the given tables and, where SQL
can say it, the expected result in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import checks
from checks import messages_data
from checks import oracle as o
from sparkscrub.catalog import entity_catalog, placeholder
from sparkscrub.functions import html as html_functions
from sparkscrub.functions import mask, spans
from sparkscrub.functions.sqlfunctions import register_functions
from sparkscrub.functions.tablefunctions import register_scope_function
from sparkscrub.operators import messages, reports
from sparkscrub.operators import scrub as scrubbing
from sparkscrub.operators.ambiguous import typed_spans
from sparkscrub.operators.automaton import automaton_spans, automaton_values
from sparkscrub.operators.detect import detect, explode_spans, select_spans
from sparkscrub.operators.gazetteer import gazetteer_spans
from sparkscrub.operators.incremental import current_rows, mask_load, rewritten_rows
from sparkscrub.operators.matching import find_values
from sparkscrub.operators.overlaps import mask_spans_of, resolve_spans
from sparkscrub.operators.scopes import scope_keys, scrub_with_keys
from sparkscrub.operators.sketches import entity_sketches, sketch_report
from sparkscrub.plans import providers
from sparkscrub.plans.expand import expand
from sparkscrub.plans.handlers import Handler
from sparkscrub.plans.shipping import ship_package
from sparkscrub.plans.sizing import materialize, scratch_dir
from sparkscrub.sources import mailbox, mbox
from sparkscrub.sources.skipping import index_files, read_holding
from sparkscrub.sources.tables import read_texts, spread_rows, text_parts, write_masked
from sparkscrub.streaming.jobs import read_text_stream, scrub_stream, write_masked_stream
from sparkscrub.streaming.scopes import scrub_scope_stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """A table may be one file: its rows are spread over the cores."""
    return spread_rows(read_texts(spark, f"{sf_dir}/{name}.parquet", columns), columns[:1])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, "documents", ["doc_id", "source", "text"])


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, "pages", ["page_id", "html"])


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note per order, with values of all entity types."""
    names = ("customer", "nation", "region")
    orders = _texts(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    files = {n: f"parquet.`{sf_dir}/{n}.parquet`" for n in names}
    return spark.sql(o.NOTES.format(orders="{orders}", **files), orders=orders)


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as persons, nations and regions as places, three nationalities."""

    def listed(name: str, column: str, entity_type: str) -> DataFrame:
        found = table(spark, sf_dir, name).select(F.col(column).alias("term")).distinct()
        return found.withColumn("entity_type", F.lit(entity_type))

    groups = spark.createDataFrame(
        [(t, "NRP") for t in ("Spanish", "French", "German")], "term string, entity_type string"
    )
    return (
        listed("customer", "c_name", "PERSON")
        .unionByName(listed("nation", "n_name", "LOCATION"))
        .unionByName(listed("region", "r_name", "LOCATION"))
        .unionByName(groups)
    )


SPAN_COLUMNS = 'start, "end", entity_type, value'

# --- sources, sinks, streams ------------------------------------------------------

for _name, _text, _key, _scope, _sql in (
    (
        "documents",
        "text",
        ["doc_id"],
        None,
        "SELECT CAST(doc_id AS VARCHAR) AS scope_id, CAST(doc_id AS VARCHAR) AS part_id, "
        "CAST(0 AS BIGINT) AS part_no, 'text' AS kind, text FROM documents",
    ),
    (
        "conversations",
        "text",
        ["conv_id", "turn"],
        ["conv_id"],
        "SELECT CAST(conv_id AS VARCHAR) AS scope_id, concat(conv_id, '/', turn) AS part_id, "
        "turn AS part_no, 'text' AS kind, text FROM conversations",
    ),
    (
        "pages",
        "html",
        ["page_id"],
        None,
        "SELECT CAST(page_id AS VARCHAR) AS scope_id, CAST(page_id AS VARCHAR) AS part_id, "
        "CAST(0 AS BIGINT) AS part_no, 'html' AS kind, html AS text FROM pages",
    ),
):

    @query(f"text_parts_{_name}", _sql)
    def _text_parts(spark, sf_dir, name=_name, text=_text, key=_key, scope=_scope):
        kind = "html" if text == "html" else "text"
        return text_parts(table(spark, sf_dir, name), text, scope, key, kind)


@query("write_masked_documents", o.scrubbed(o.DOCUMENTS, o.FOUR, "doc_id"))
def _write_masked(spark, sf_dir):
    path = f"{scratch_dir(spark)}/masked-documents-{uuid.uuid4().hex}"
    masked = scrubbing.scrub(documents(spark, sf_dir), entities=o.FOUR)
    write_masked(masked, path, drop=["text", "source"], mode="overwrite")
    return spark.read.parquet(path)


@query("scrub_stream_documents", o.scrubbed(o.DOCUMENTS, o.FOUR, "doc_id"))
def _scrub_stream(spark, sf_dir):
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "documents").schema
    # A pattern, since the table may be one file or a folder of files.
    stream = read_text_stream(spark, f"{sf_dir}/documents.parque[t]", schema)
    masked = scrub_stream(stream.select("doc_id", "text"), entities=o.FOUR)
    write_masked_stream(masked, f"{base}/out", f"{base}/log", drop=["text"], available_now=True).awaitTermination()
    return spark.read.parquet(f"{base}/out")


# Conversations arrive in three loads, two turns of each at a time.
_LOAD = "least(coalesce(turn, 0) div 2, 2)"


def scope_stream_sql() -> str:
    """Each turn is masked with what its conversation has shown up to its load."""
    src = (
        "SELECT conv_id * 1000 + turn AS id, conv_id AS scope_id, text, "
        f"{_LOAD.replace(' div ', ' // ')} AS load FROM conversations"
    )
    return o.with_(
        o.spans(src, o.FOUR)
        + [
            "seen AS MATERIALIZED (SELECT scope_id, load, value, entity_type FROM spans JOIN src USING (id))",
            f"held AS (SELECT src.id, value, concat('<', arg_min(entity_type, {o.RANK_CASE}), '>') AS placeholder FROM src "
            "JOIN seen ON seen.scope_id = src.scope_id AND seen.load <= src.load AND contains(text, value) "
            "GROUP BY src.id, value)",
        ]
        + o.folds("id", "held"),
        f"SELECT id, {o.fold('text')} AS masked FROM src LEFT JOIN maps ON scope = id",
    )


@query("scrub_stream_conversations", scope_stream_sql())
def _scrub_scope_stream(spark, sf_dir):
    """The stream is stopped after each load and goes on with the next one."""
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    turns = table(spark, sf_dir, "conversations").withColumn("load", F.expr(_LOAD))
    for load in range(3):
        turns.where(F.col("load") == load).drop("load").write.mode("append").parquet(f"{base}/in")
        stream = read_text_stream(spark, f"{base}/in", turns.drop("load").schema)
        masked = scrub_scope_stream(stream, ["conv_id"], entities=o.FOUR)
        masked = masked.select(F.expr("conv_id * 1000 + turn").alias("id"), "masked")
        write_masked_stream(masked, f"{base}/out", f"{base}/log", keep=["id", "masked"], available_now=True).awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query(
    "detect_with_skipping_index",
    o.with_(o.spans(o.DOCUMENTS, ["CREDIT_CARD", "IP_ADDRESS"]), f"SELECT id AS doc_id, {SPAN_COLUMNS} FROM spans"),
)
def _skipping(spark, sf_dir):
    """The documents in many files; only those are read again that the index names."""
    folder = f"{scratch_dir(spark)}/indexed-{uuid.uuid4().hex}"
    table(spark, sf_dir, "documents").select("doc_id", "text").repartitionByRange(40, "doc_id").write.parquet(folder)
    index = materialize(index_files(spark.read.parquet(folder)), "file-index")
    chosen = ["CREDIT_CARD", "IP_ADDRESS"]
    return explode_spans(detect(read_holding(spark, folder, index, chosen), entities=chosen)).drop("text")


# --- catalogue and selection --------------------------------------------------------


@query(
    "entity_catalog",
    o.with_(
        o.spans(o.NOTE_TEXTS, o.PATTERN_TYPES),
        "SELECT t AS entity_type, CAST(r AS INTEGER) AS rank, t IN ("
        + ", ".join(f"'{t}'" for t in o.DEFAULTS)
        + ") AS selected, count(id) AS hits FROM (SELECT unnest(["
        + ", ".join(f"'{t}'" for t in o.RANKS)
        + "]) AS t, unnest(range(1, 18)) AS r) LEFT JOIN spans ON entity_type = t GROUP BY t, r",
    ),
)
def _catalog(spark, sf_dir):
    hits = explode_spans(detect(notes(spark, sf_dir))).groupBy("entity_type").agg(F.count("*").alias("hits"))
    return (
        entity_catalog(spark)
        .join(F.broadcast(hits), "entity_type", "left")
        .select("entity_type", "rank", "selected", F.coalesce("hits", F.lit(0)).alias("hits"))
    )


@query(
    "select_spans_of_default_types",
    o.with_(
        o.spans(o.NOTE_TEXTS, [t for t in o.DEFAULTS if t in o.PATTERN_TYPES]),
        f"SELECT id AS note_id, {SPAN_COLUMNS} FROM spans",
    ),
)
def _select(spark, sf_dir):
    found = explode_spans(detect(notes(spark, sf_dir).select("note_id", "text"))).drop("text")
    return select_spans(found, o.DEFAULTS)


_BLANKS = "CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN concat(chr(9), ' ', chr(10)) WHEN 2 THEN NULL ELSE text END"


@query(
    "blank_texts",
    f"SELECT conv_id, turn, CAST(0 AS INTEGER) AS spans, {_BLANKS} AS masked FROM conversations",
)
def _blank(spark, sf_dir):
    texts = table(spark, sf_dir, "conversations").withColumn("text", F.expr(_BLANKS))
    return scrubbing.scrub(detect(texts)).select("conv_id", "turn", F.size("spans").alias("spans"), "masked")


@query(
    "prefilter_documents",
    "SELECT doc_id, contains(text, '@') AS email, regexp_matches(text, '://|(?i:www)\\.') AS url, "
    "regexp_matches(text, '[0-9]\\.[0-9]{1,3}\\.[0-9]') OR regexp_matches(text, ':[0-9A-Fa-f]{0,4}:') AS ip, "
    "regexp_matches(text, '[0-9]{7}') AS bank FROM documents",
)
def _prefilter(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id",
        spans.may_hold("text", ["EMAIL_ADDRESS"]).alias("email"),
        spans.may_hold("text", ["URL"]).alias("url"),
        spans.may_hold("text", ["IP_ADDRESS"]).alias("ip"),
        spans.may_hold("text", ["US_BANK_NUMBER"]).alias("bank"),
    )


# --- detectors ------------------------------------------------------------------------

for _t in o.PATTERN_TYPES:

    @query(
        f"detect_{_t.lower()}_in_notes",
        o.with_(o.spans(o.NOTE_TEXTS, [_t]), f"SELECT id AS note_id, {SPAN_COLUMNS} FROM spans"),
    )
    def _detect_type(spark, sf_dir, entity_type=_t):
        return explode_spans(detect(notes(spark, sf_dir).select("note_id", "text"), entities=[entity_type])).drop("text")


for _t in ("PERSON", "LOCATION", "NRP"):

    @query(
        f"detect_{_t.lower()}_in_notes",
        o.with_(
            [f"src AS ({o.NOTE_TEXTS})", *o.term_spans(f"SELECT * FROM ({o.TERMS}) WHERE entity_type = '{_t}'")],
            f"SELECT id AS note_id, {SPAN_COLUMNS} FROM spans",
        ),
    )
    def _detect_term(spark, sf_dir, entity_type=_t):
        listed = terms(spark, sf_dir).where(F.col("entity_type") == entity_type)
        return gazetteer_spans(notes(spark, sf_dir), listed, "text", ["note_id"])


for _t in ("EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "IP_ADDRESS", "US_BANK_NUMBER"):

    @query(
        f"detect_{_t.lower()}_in_documents",
        o.with_(o.spans(o.DOCUMENTS, [_t]), f"SELECT id AS doc_id, {SPAN_COLUMNS} FROM spans"),
    )
    def _detect_documents(spark, sf_dir, entity_type=_t):
        found = detect(documents(spark, sf_dir).select("doc_id", "text"), entities=[entity_type])
        return explode_spans(found).drop("text")


@query(
    "detect_url_in_page_addresses",
    o.with_(
        o.spans("SELECT page_id AS id, url AS text FROM pages", ["URL"]),
        f"SELECT id AS page_id, {SPAN_COLUMNS} FROM spans",
    ),
)
def _detect_url(spark, sf_dir):
    found = detect(table(spark, sf_dir, "pages").select("page_id", "url"), "url", ["URL"])
    return explode_spans(found).drop("url")


@query(
    "detect_all_types_in_documents",
    o.with_(o.spans(o.DOCUMENTS, o.PATTERN_TYPES), f"SELECT id AS doc_id, {SPAN_COLUMNS} FROM spans"),
)
def _detect_all(spark, sf_dir):
    return explode_spans(detect(documents(spark, sf_dir).select("doc_id", "text"))).drop("text")


@query(
    "gazetteer_spans_in_notes",
    o.with_(
        [f"src AS ({o.NOTE_TEXTS})", *o.term_spans()], f"SELECT id AS note_id, {SPAN_COLUMNS} FROM spans"
    ),
)
def _gazetteer(spark, sf_dir):
    return gazetteer_spans(notes(spark, sf_dir), terms(spark, sf_dir), "text", ["note_id"])


@query("automaton_spans_in_notes", SQL["gazetteer_spans_in_notes"])
def _automaton(spark, sf_dir):
    return automaton_spans(notes(spark, sf_dir), terms(spark, sf_dir), "text", ["note_id"])


@query(
    "typed_spans_in_notes",
    # Every third nation may be a person, too; where it stands says that it is none.
    o.with_(
        [f"src AS ({o.NOTE_TEXTS})", *o.term_spans()], f"SELECT id AS note_id, {SPAN_COLUMNS} FROM spans"
    ),
)
def _typed(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0")
    people = nations.select(F.col("n_name").alias("term"), F.lit("PERSON").alias("entity_type"))
    return typed_spans(notes(spark, sf_dir), terms(spark, sf_dir).union(people), "text", ["note_id"])


# --- spans and maps -------------------------------------------------------------------


@query(
    "explode_spans_with_placeholder",
    o.with_(
        o.spans(o.NOTE_TEXTS, o.PATTERN_TYPES),
        "SELECT id AS note_id, start, \"end\", concat('<', entity_type, '>') AS placeholder, "
        "substr(text, start + 1, \"end\" - start) AS found FROM spans JOIN src USING (id)",
    ),
)
def _placeholder(spark, sf_dir):
    found = explode_spans(detect(notes(spark, sf_dir).select("note_id", "text")))
    return found.select(
        "note_id",
        "start",
        "end",
        spans.entity_placeholder("entity_type").alias("placeholder"),
        F.expr("substring(text, start + 1, end - start)").alias("found"),
    )


@query(
    "replacement_map_per_note",
    o.with_(o.spans(o.NOTE_TEXTS, o.PATTERN_TYPES) + o.keys(), "SELECT scope AS note_id, value, placeholder FROM keys"),
)
def _map(spark, sf_dir):
    return notes(spark, sf_dir).select(
        "note_id", F.explode(spans.replacement_map("text")).alias("value", "placeholder")
    )


_BY_CUSTOMER = [
    *o.spans(o.NOTE_TEXTS, o.PATTERN_TYPES),
    f"owner AS (SELECT note_id AS id, cust_id FROM ({o.DUCK_NOTES}))",
    "scoped_spans AS (SELECT cust_id, value, entity_type FROM spans JOIN owner USING (id))",
]


@query(
    "replacement_map_per_customer",
    o.with_(_BY_CUSTOMER + o.keys("cust_id", "scoped_spans"), "SELECT scope AS cust_id, value, placeholder FROM keys"),
)
def _scope_map(spark, sf_dir):
    return scope_keys(notes(spark, sf_dir), ["cust_id"])


@query(
    "map_ordering",
    o.with_(
        o.spans(o.NOTE_TEXTS, o.PATTERN_TYPES) + o.keys(),
        "SELECT scope AS note_id, CAST(row_number() OVER (PARTITION BY scope ORDER BY length(value) DESC, value) - 1 "
        "AS INTEGER) AS pos, value FROM keys",
    ),
)
def _ordering(spark, sf_dir):
    keys = notes(spark, sf_dir).select("note_id", F.posexplode(spans.replacement_keys("text")).alias("pos", "key"))
    return keys.select("note_id", "pos", "key.value")


# Spans of many shapes and overlaps, from the line items of each order.
_LINE_SPANS = (
    "SELECT l_orderkey, CAST(l_linenumber * 3 + l_suppkey % 4 AS INT) AS start, "
    "CAST(l_linenumber * 3 + l_suppkey % 4 + l_quantity % 9 AS INT) AS stop, "
    "CASE l_partkey % 3 WHEN 0 THEN 'URL' WHEN 1 THEN 'PERSON' ELSE 'US_SSN' END AS entity_type, "
    "concat(l_partkey, '/', l_linenumber) AS value FROM {lineitem}"
)
_LINE_ORDER = f"ORDER BY start - stop, start, stop, {o.RANK_CASE}, entity_type, value"
_DUCK_RESOLVED = [
    f"lines AS ({_LINE_SPANS.format(lineitem='lineitem')})",
    "ordered AS (SELECT l_orderkey, list([struct_pack(s := start, e := stop, t := entity_type, v := value)] "
    f"{_LINE_ORDER}) AS x FROM lines GROUP BY l_orderkey)",
    "resolved AS (SELECT l_orderkey, list_reduce(x, lambda acc, y: CASE WHEN len(list_filter(acc, lambda a: "
    "least(a.e, y[1].e) - greatest(a.s, y[1].s) > 0 AND 2 * (least(a.e, y[1].e) - greatest(a.s, y[1].s)) > "
    "least(a.e - a.s, y[1].e - y[1].s))) > 0 THEN acc ELSE list_concat(acc, y) END) AS x FROM ordered)",
]


def _line_spans(spark, sf_dir):
    lines = spark.sql(_LINE_SPANS.format(lineitem=f"parquet.`{sf_dir}/lineitem.parquet`"))
    span = F.struct("start", F.col("stop").alias("end"), "entity_type", "value")
    return lines.groupBy("l_orderkey").agg(F.collect_list(span).alias("spans"))


@query(
    "resolve_overlaps",
    o.with_(
        _DUCK_RESOLVED,
        'SELECT l_orderkey, y.s AS start, y.e AS "end", y.t AS entity_type, y.v AS value '
        "FROM (SELECT l_orderkey, unnest(x) AS y FROM resolved)",
    ),
)
def _resolve(spark, sf_dir):
    kept = _line_spans(spark, sf_dir).select("l_orderkey", spans.resolve_overlaps("spans").alias("spans"))
    return explode_spans(kept)


# All line items of a supplier as spans of one long text.
_SUPPLIER_SPANS = (
    "SELECT l_suppkey, CAST(l_orderkey * 2 + l_linenumber * 3 AS INT) AS start, "
    "CAST(l_orderkey * 2 + l_linenumber * 3 + l_quantity % 9 AS INT) AS stop, "
    "CASE l_partkey % 3 WHEN 0 THEN 'URL' WHEN 1 THEN 'PERSON' ELSE 'US_SSN' END AS entity_type, "
    "concat(l_partkey, '/', l_linenumber) AS value FROM {lineitem}"
)


@query(
    "resolve_overlaps_of_suppliers",
    o.with_(
        [_DUCK_RESOLVED[0].replace(_LINE_SPANS.format(lineitem="lineitem"), _SUPPLIER_SPANS.format(lineitem="lineitem"))]
        + [c.replace("l_orderkey", "l_suppkey") for c in _DUCK_RESOLVED[1:]],
        'SELECT l_suppkey, y.s AS start, y.e AS "end", y.t AS entity_type, y.v AS value '
        "FROM (SELECT l_suppkey, unnest(x) AS y FROM resolved)",
    ),
)
def _resolve_long(spark, sf_dir):
    lines = spark.sql(_SUPPLIER_SPANS.format(lineitem=f"parquet.`{sf_dir}/lineitem.parquet`"))
    span = F.struct("start", F.col("stop").alias("end"), "entity_type", "value")
    return explode_spans(resolve_spans(lines.groupBy("l_suppkey").agg(F.collect_list(span).alias("spans"))))


_NO_OPS = "map(c_name, '<PERSON>', '', '<X>', n_name, n_name, region, '<LOCATION>')"


@query(
    "no_op_replacements",
    "SELECT note_id, replace(replace(text, c_name, '<PERSON>'), region, '<LOCATION>') AS masked "
    f"FROM ({o.DUCK_NOTES})",
)
def _no_op(spark, sf_dir):
    mapped = notes(spark, sf_dir).withColumn("m", F.expr(_NO_OPS))
    return mapped.select("note_id", mask.mask_with_map("text", "m").alias("masked"))


# --- masking ----------------------------------------------------------------------------


@query("scrub_documents", o.scrubbed(o.DOCUMENTS, o.FOUR, "doc_id"))
def _scrub_documents(spark, sf_dir):
    return scrubbing.scrub(documents(spark, sf_dir), entities=o.FOUR).select("doc_id", "masked")


@query("scrub_documents_all_types", o.scrubbed(o.DOCUMENTS, o.PATTERN_TYPES, "doc_id"))
def _scrub_documents_all(spark, sf_dir):
    return scrubbing.scrub(documents(spark, sf_dir)).select("doc_id", "masked")


@query("scrub_notes_all_types", o.scrubbed(o.NOTE_TEXTS, o.PATTERN_TYPES, "note_id"))
def _scrub_notes(spark, sf_dir):
    return scrubbing.scrub(notes(spark, sf_dir)).select("note_id", "masked")


@query(
    "mask_replace_with_terms",
    # Keys that are pieces of placeholders: later keys hit placeholders placed before.
    "SELECT note_id, replace(replace(replace(text, 'Order', '<US_SSN>'), 'SSN', '<NRP>'), 'US', '<X>') AS masked "
    f"FROM ({o.DUCK_NOTES})",
)
def _mask_replace(spark, sf_dir):
    mapped = notes(spark, sf_dir).withColumn("m", F.expr("map('US', '<X>', 'SSN', '<NRP>', 'Order', '<US_SSN>')"))
    return mapped.select("note_id", mask.mask_with_map("text", "m").alias("masked"))


@query(
    "scrub_notes_by_position",
    o.with_(
        # The types of this query never overlap in the notes: splice from the right.
        o.spans(o.NOTE_TEXTS, ["EMAIL_ADDRESS", "PHONE_NUMBER", "DATE_TIME", "US_SSN"])
        + [
            "steps AS (SELECT id, list(struct_pack(t := '', s := start, e := \"end\", r := concat('<', entity_type, '>')) "
            "ORDER BY start DESC) AS k FROM spans GROUP BY id)"
        ],
        "SELECT id AS note_id, CASE WHEN k IS NULL THEN text ELSE list_reduce(k, lambda a, x: struct_pack(t := "
        "concat(substr(a.t, 1, x.s), x.r, substr(a.t, x.e + 1)), s := x.s, e := x.e, r := x.r), "
        "struct_pack(t := text, s := 0, e := 0, r := '')).t END AS masked FROM src LEFT JOIN steps USING (id)",
    ),
)
def _by_position(spark, sf_dir):
    chosen = ["EMAIL_ADDRESS", "PHONE_NUMBER", "DATE_TIME", "US_SSN"]
    return scrubbing.scrub_by_position(notes(spark, sf_dir), entities=chosen).select("note_id", "masked")


@query(
    "mask_spans_of_customers",
    # All notes of a customer as one text, with the spans of each at its place.
    o.with_(
        o.spans(f"SELECT note_id AS id, cust_id, text FROM ({o.DUCK_NOTES})", ["EMAIL_ADDRESS", "PHONE_NUMBER", "US_SSN"])
        + [
            "steps AS (SELECT id, list(struct_pack(t := '', s := start, e := \"end\", r := concat('<', entity_type, '>')) "
            "ORDER BY start DESC) AS k FROM spans GROUP BY id)",
            "masked AS (SELECT id, cust_id, CASE WHEN k IS NULL THEN text ELSE list_reduce(k, lambda a, x: struct_pack(t := "
            "concat(substr(a.t, 1, x.s), x.r, substr(a.t, x.e + 1)), s := x.s, e := x.e, r := x.r), "
            "struct_pack(t := text, s := 0, e := 0, r := '')).t END AS m FROM src LEFT JOIN steps USING (id))",
        ],
        "SELECT cust_id, string_agg(m, chr(10) ORDER BY id) AS masked FROM masked GROUP BY cust_id",
    ),
)
def _mask_long(spark, sf_dir):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("note_id", "text"))), lambda n: n["text"])
    texts = notes(spark, sf_dir).groupBy("cust_id").agg(F.array_join(lines, "\n").alias("text"))
    found = detect(texts, entities=["EMAIL_ADDRESS", "PHONE_NUMBER", "US_SSN"])
    return mask_spans_of(found, direct=20).select("cust_id", "masked")


_SOURCES = "SELECT doc_id AS id, source AS scope_id, text FROM documents"
_CUSTOMERS = f"SELECT note_id AS id, cust_id AS scope_id, text FROM ({o.DUCK_NOTES})"
_REGIONS = f"SELECT note_id AS id, region AS scope_id, text FROM ({o.DUCK_NOTES})"
_TURNS = "SELECT conv_id * 1000 + turn AS id, conv_id AS scope_id, text FROM conversations"


@query("scrub_scope_source", o.scoped(_SOURCES, o.FOUR, "doc_id"))
def _scope_source(spark, sf_dir):
    masked = scrubbing.scrub(documents(spark, sf_dir), scope=["source"], key=["doc_id"], entities=o.FOUR)
    return masked.select("doc_id", "masked")


@query("scrub_scope_customer", o.scoped(_CUSTOMERS, o.PATTERN_TYPES, "note_id"))
def _scope_customer(spark, sf_dir):
    masked = scrubbing.scrub(notes(spark, sf_dir), scope=["cust_id"], key=["note_id"])
    return masked.select("note_id", "masked")


@query("scrub_with_customer_keys", o.scoped(_CUSTOMERS, o.PATTERN_TYPES, "note_id"))
def _with_keys(spark, sf_dir):
    """The same in two steps: one stored table of keys, applied to the notes."""
    rows = notes(spark, sf_dir)
    keys = materialize(scope_keys(rows, ["cust_id"]), "scope-keys")
    return scrub_with_keys(rows, keys, ["cust_id"], ["note_id"]).select("note_id", "masked")


@query("scrub_scope_region", o.scoped(_REGIONS, o.PATTERN_TYPES, "note_id"))
def _scope_region(spark, sf_dir):
    """Five scopes with thousands of values each: looked up, not folded."""
    masked = scrubbing.scrub(notes(spark, sf_dir), scope=["region"], key=["note_id"])
    return masked.select("note_id", "masked")


def _two_loads(spark, sf_dir) -> str:
    """Every third note comes in a second load."""
    store = f"{scratch_dir(spark)}/loads-{uuid.uuid4().hex}"
    rows = notes(spark, sf_dir).select("note_id", "region", "text")
    first, second = rows.where("note_id % 3 > 0"), rows.where("note_id % 3 = 0")
    mask_load(store, 0, first, None, ["region"], ["note_id"])
    mask_load(store, 1, second, first, ["region"], ["note_id"])
    return store


@query("scrub_notes_in_two_loads", o.scoped(_REGIONS, o.PATTERN_TYPES, "note_id"))
def _loads(spark, sf_dir):
    return current_rows(spark, _two_loads(spark, sf_dir), 2, ["note_id"])


@query(
    "notes_masked_anew",
    # Notes of the first load that hold a value which only the second one showed in their region.
    o.with_(
        o.spans(_REGIONS, o.PATTERN_TYPES)
        + [
            "shown AS MATERIALIZED (SELECT scope_id, value, bool_or(id % 3 > 0) AS known FROM spans JOIN src USING (id) "
            "GROUP BY scope_id, value)"
        ],
        "SELECT DISTINCT id AS note_id FROM src JOIN shown USING (scope_id) WHERE id % 3 > 0 AND NOT known AND contains(text, value)",
    ),
)
def _anew(spark, sf_dir):
    return rewritten_rows(spark, _two_loads(spark, sf_dir), 1, ["note_id"])


@query("scrub_scope_conversation", o.scoped(_TURNS, o.PATTERN_TYPES, "id"))
def _scope_conversation(spark, sf_dir):
    masked = scrubbing.scrub(table(spark, sf_dir, "conversations"), scope=["conv_id"], key=["conv_id", "turn"])
    return masked.select(F.expr("conv_id * 1000 + turn").alias("id"), "masked")


@query(
    "provider_of_patterns",
    o.scrubbed(o.NOTE_TEXTS, o.PATTERN_TYPES, "note_id"),
)
def _pattern_provider(spark, sf_dir):
    provider = providers.pattern_provider(o.PATTERN_TYPES)
    return providers.scrub_with_provider(notes(spark, sf_dir), provider).select("note_id", "masked")


@query(
    "scrub_notes_with_terms",
    o.scoped(
        f"SELECT note_id AS id, note_id AS scope_id, text FROM ({o.DUCK_NOTES})",
        o.DEFAULTS,
        "note_id",
        [
            *(c.replace("spans AS", "pattern_spans AS") if c.startswith("spans AS") else c
              for c in o.spans(f"SELECT note_id AS id, note_id AS scope_id, text FROM ({o.DUCK_NOTES})",
                               [t for t in o.DEFAULTS if t in o.PATTERN_TYPES])),
            *(c.replace("spans AS", "listed_spans AS") if c.startswith("spans AS") else c
              for c in o.term_spans(f"SELECT * FROM ({o.TERMS}) WHERE entity_type <> 'NRP'")),
            "spans AS (SELECT * FROM pattern_spans UNION ALL SELECT * FROM listed_spans)",
        ],
    ),
)
def _scrub_terms(spark, sf_dir):
    masked = scrubbing.scrub(
        notes(spark, sf_dir), key=["note_id"], entities=o.DEFAULTS, terms=terms(spark, sf_dir)
    )
    return masked.select("note_id", "masked")


@query(
    "mask_fragments_of_documents",
    o.with_(
        o.spans(o.DOCUMENTS, o.FOUR)
        + o.keys()
        + o.folds()
        + [
            "lines AS (SELECT id, k, string_split(text, chr(10)) AS f FROM src LEFT JOIN maps ON scope = id)",
            "numbered AS (SELECT id, k, unnest(f) AS fragment, unnest(range(len(f))) AS fragment_no FROM lines)",
        ],
        f"SELECT id AS doc_id, CAST(fragment_no AS INTEGER) AS fragment_no, {o.fold('fragment')} AS masked FROM numbered",
    ),
)
def _fragments(spark, sf_dir):
    found = scrubbing.mask_fragments(documents(spark, sf_dir).drop("source"), entities=o.FOUR)
    return found.select("doc_id", "fragment_no", "masked")


@query(
    "mask_fragments_across",
    # Notes cut into pieces of 17 characters, in the middle of values: together they are the masked note.
    o.scrubbed(o.NOTE_TEXTS, o.PATTERN_TYPES, "note_id", ", CAST(1 + length(text) // 17 AS BIGINT) AS n_fragments"),
)
def _fragments_across(spark, sf_dir):
    cut = F.regexp_replace("text", "(?s)(.{17})", "$1|")
    rows = notes(spark, sf_dir).select("note_id", cut.alias("text"))
    found = scrubbing.mask_fragments(rows, separator="|", across=True)
    pieces = F.array_sort(F.collect_list(F.struct("fragment_no", "masked")))
    per_note = found.groupBy("note_id").agg(pieces.alias("pieces"), F.count("*").alias("n_fragments"))
    return per_note.select("note_id", F.array_join("pieces.masked", "").alias("masked"), "n_fragments")


# --- pages ------------------------------------------------------------------------------

_TOKENS = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|[^<]+|<"
_ATTRIBUTES = r"(?is)\s(?:href|src|content|value)\s*=\s*(?:\x22[^\x22]*\x22|\x27[^\x27]*\x27|[^\s>\x22\x27]+)"
_ATTRIBUTE_VALUE = r"(?is)=\s*[\x22\x27]?(.*?)[\x22\x27]?$"


def _unescaped(text: str) -> str:
    """The entities that the pages hold."""
    plain = text
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        plain = f"replace({plain}, '{entity}', '{char}')"
    return plain


def _escaped(text: str) -> str:
    return f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_HTML_TOKENS = [
    f"cut AS (SELECT page_id AS id, regexp_extract_all(html, '{_TOKENS}') AS x FROM pages)",
    "tokens AS MATERIALIZED (SELECT id, unnest(range(len(x))) AS n, unnest(x) AS tok FROM cut)",
    "typed AS MATERIALIZED (SELECT id, n, tok, CASE WHEN starts_with(tok, '<!--') THEN 'comment' "
    "WHEN starts_with(tok, '<') AND length(tok) > 1 THEN 'tag' ELSE 'text' END AS kind, "
    f"regexp_extract_all(regexp_extract(tok, '^<[^>]*>'), '{_ATTRIBUTES}') AS attrs FROM tokens)",
    "lines AS (SELECT id, n, 0 AS m, " + _unescaped("tok") + " AS line FROM typed WHERE kind = 'text' UNION ALL "
    "SELECT id, n, 0, substr(tok, 5, length(tok) - 7) FROM typed WHERE kind = 'comment' UNION ALL "
    f"SELECT id, n, m, {_unescaped(f'regexp_extract(a, {chr(39)}{_ATTRIBUTE_VALUE}{chr(39)}, 1)')} FROM "
    "(SELECT id, n, unnest(range(len(attrs))) AS m, unnest(attrs) AS a FROM typed WHERE kind = 'tag'))",
    "visible AS MATERIALIZED (SELECT id, string_agg(line, chr(10) ORDER BY n, m) AS text FROM lines "
    r"WHERE regexp_matches(line, '\S') GROUP BY id)",
]
_PAGE_SPANS = _HTML_TOKENS + o.spans("SELECT id, text FROM visible", o.PATTERN_TYPES)
_MASKED_ATTR = (
    "concat(regexp_extract(a, '(?is)^\\s[a-z]+\\s*=\\s*[\\x22\\x27]?'), "
    + _escaped(o.fold(_unescaped(f"regexp_extract(a, '{_ATTRIBUTE_VALUE}', 1)")))
    + ", regexp_extract(a, '[\\x22\\x27]$'))"
)
_MASKED_TEXT = o.fold(_unescaped("tok"))


@query(
    "html_tokens",
    o.with_(_HTML_TOKENS, "SELECT id AS page_id, CAST(n AS INTEGER) AS n, tok AS token FROM tokens"),
)
def _tokens(spark, sf_dir):
    return pages(spark, sf_dir).select(
        "page_id", F.posexplode(F.expr(html_functions.tokens_sql("html"))).alias("n", "token")
    )


@query("html_text", o.with_(_HTML_TOKENS, "SELECT id AS page_id, text FROM visible"))
def _html_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", html_functions.html_text("html").alias("text"))


@query(
    "scrub_pages",
    o.with_(
        _PAGE_SPANS
        + o.keys()
        + o.folds()
        + [
            "masked_tokens AS (SELECT id, n, CASE WHEN k IS NULL THEN tok "
            f"WHEN kind = 'comment' THEN concat('<!--', {o.fold('substr(tok, 5, length(tok) - 7)')}, '-->') "
            f"WHEN kind = 'text' THEN CASE WHEN {_MASKED_TEXT} = {_unescaped('tok')} THEN tok ELSE {_escaped(_MASKED_TEXT)} END "
            "ELSE list_reduce(attrs, lambda t, a: CASE WHEN " + _MASKED_ATTR + " LIKE '%&lt;%' "
            f"THEN replace(t, a, {_MASKED_ATTR}) ELSE t END, tok) END AS tok FROM typed LEFT JOIN maps ON scope = id)"
        ],
        "SELECT id AS page_id, string_agg(tok, '' ORDER BY n) AS masked FROM masked_tokens GROUP BY id",
    ),
)
def _scrub_pages(spark, sf_dir):
    return scrubbing.scrub_html(pages(spark, sf_dir)).select("page_id", "masked")


@query(
    "html_pass_through",
    "SELECT page_id, html AS masked FROM pages",
)
def _pass_through(spark, sf_dir):
    keyed = pages(spark, sf_dir).withColumn("k", F.expr(spans.NO_KEYS))
    return keyed.select("page_id", html_functions.mask_html("html", "k").alias("masked"))




@query(
    "mask_html_attributes",
    # A key that stands in every link: no '/' is left in any href.
    o.with_(
        _HTML_TOKENS,
        "SELECT id AS page_id, count(*) FILTER (WHERE kind = 'tag' AND len(list_filter(attrs, lambda a: "
        "contains(lower(a), 'href') AND contains(a, '/'))) > 0) AS links_before, CAST(0 AS BIGINT) AS links_after "
        "FROM typed GROUP BY id",
    ),
)
def _html_attributes(spark, sf_dir):
    keys = spans.keys_from_map_sql("map('/', '<LOCATION>')")
    masked = pages(spark, sf_dir).withColumn("masked", html_functions.mask_html("html", keys))
    link = r"(?i)<[^>]*\shref\s*=\s*\x22?[^\x22\s>]*/[^>]*>"

    def links(column: str):
        return F.expr(f"cast(size(regexp_extract_all({column}, r'{link}', 0)) AS bigint)")

    return masked.select("page_id", links("html").alias("links_before"), links("masked").alias("links_after"))


# --- messages -----------------------------------------------------------------------------


def _messages(spark, sf_dir):
    return mailbox.parse_messages(messages_data.raw_messages(notes(spark, sf_dir)))


@query("mailbox_messages", messages_data.MESSAGES_SQL)
def _mailbox(spark, sf_dir):
    return _messages(spark, sf_dir).select(
        "path", "status", F.size("headers").alias("n_headers"), F.size("parts").alias("n_parts")
    )


def _mbox_folder(spark, sf_dir) -> str:
    """The messages as mailboxes, the names in the lines before them."""
    folder = f"{scratch_dir(spark)}/mbox-{uuid.uuid4().hex}"
    raw = messages_data.raw_messages(notes(spark, sf_dir))
    mbox.write_mbox(raw, folder, "path")
    return folder


def _named(rows: DataFrame) -> DataFrame:
    return mailbox.parse_messages(rows.select(F.col("envelope").alias("path"), "content"))


@query("mbox_messages", messages_data.MESSAGES_SQL)
def _mbox(spark, sf_dir):
    return _named(mbox.read_mbox(spark, _mbox_folder(spark, sf_dir))).select(
        "path", "status", F.size("headers").alias("n_headers"), F.size("parts").alias("n_parts")
    )


@query("mbox_stream_headers", messages_data.HEADERS_SQL)
def _mbox_stream(spark, sf_dir):
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    read = _named(mbox.read_mbox(spark, _mbox_folder(spark, sf_dir), stream=True))
    found = mailbox.message_headers(read)
    write_masked_stream(found, f"{base}/out", f"{base}/log", keep=found.columns, available_now=True).awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("mailbox_headers", messages_data.HEADERS_SQL)
def _headers(spark, sf_dir):
    return mailbox.message_headers(_messages(spark, sf_dir))


@query("mailbox_parts", messages_data.PARTS_SQL)
def _parts(spark, sf_dir):
    return mailbox.message_parts(_messages(spark, sf_dir)).drop("content")


@query("classify_parts", messages_data.KINDS_SQL)
def _classify(spark, sf_dir):
    parts = mailbox.message_parts(_messages(spark, sf_dir)).where("maintype IS NOT NULL")
    return parts.groupBy(mailbox.classify_part().alias("kind")).agg(F.count("*").alias("n"))


@query("combined_text_of_messages", messages_data.COMBINED_SQL)
def _combined(spark, sf_dir):
    read = _messages(spark, sf_dir).where("status = 'ok'")
    return read.select("path", messages.combined_text().alias("text"))


def _scrubbed_messages(spark, sf_dir):
    return messages.scrub_messages(_messages(spark, sf_dir), entities=o.DEFAULTS, salt=messages_data.SALT)


@query("mask_message_headers", messages_data.MASKED_HEADERS_SQL)
def _masked_headers(spark, sf_dir):
    return expand(_scrubbed_messages(spark, sf_dir), ["path"], F.inline_outer("headers"), "ord")


@query("mask_message_parts", messages_data.MASKED_PARTS_SQL)
def _masked_parts(spark, sf_dir):
    parts = mailbox.message_parts(_scrubbed_messages(spark, sf_dir))
    return parts.where("text IS NOT NULL").select("path", "part_path", "kind", "text")


@query("mask_preamble_epilogue", messages_data.MASKED_EDGES_SQL)
def _edges(spark, sf_dir):
    parts = mailbox.message_parts(_scrubbed_messages(spark, sf_dir))
    return parts.where("kind IN ('preamble', 'epilogue')").select("path", "kind", "text")


@query("mask_text_attachments", messages_data.ATTACHMENTS_SQL)
def _attachments(spark, sf_dir):
    found = messages.text_attachments(_scrubbed_messages(spark, sf_dir))
    return found.withColumn("content", F.decode("content", "UTF-8"))


@query("quarantine_messages", messages_data.QUARANTINE_SQL)
def _quarantine(spark, sf_dir):
    held = messages.quarantine(_messages(spark, sf_dir))
    return held.select("path", "status", "part_path", "filename", F.decode("content", "UTF-8").alias("content"))


@query("attachment_report", messages_data.ATTACHMENT_REPORT_SQL)
def _attachment_report(spark, sf_dir):
    return reports.attachment_report(mailbox.message_parts(_messages(spark, sf_dir)))


@query(
    "pseudonymize_filenames",
    "SELECT p_partkey, concat(substr(sha256(concat('s1|', p_partkey, '|', p_name, '.tar.gz')), 1, 12), '.gz') AS other, "
    "concat(substr(sha256(concat('s1|', p_partkey, '|', p_name)), 1, 12), '.txt') AS text_name, "
    "concat(substr(sha256(concat('s1|', p_partkey, '|', p_name)), 1, 12), '.pdf') AS pdf_name, "
    "concat(substr(sha256(concat('s1|', p_partkey)), 1, 12), '.bin') AS no_name FROM part",
)
def _filenames(spark, sf_dir):
    ident = "cast(p_partkey AS string)"
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        mask.pseudonymize_filename("concat(p_name, '.tar.gz')", None, "s1", ident).alias("other"),
        mask.pseudonymize_filename("p_name", "text", "s1", ident).alias("text_name"),
        mask.pseudonymize_filename("p_name", "pdf", "s1", ident).alias("pdf_name"),
        mask.pseudonymize_filename("cast(NULL AS string)", None, "s1", ident).alias("no_name"),
    )


# --- joins and reports ------------------------------------------------------------------


@query(
    "scope_join",
    o.with_(
        _BY_CUSTOMER + o.keys("cust_id", "scoped_spans"),
        "SELECT id AS note_id, count(value) AS known_values, count(value) FILTER (WHERE contains(text, value)) AS present "
        "FROM src JOIN owner USING (id) LEFT JOIN keys ON scope = cust_id GROUP BY id",
    ),
)
def _scope_join(spark, sf_dir):
    rows = notes(spark, sf_dir)
    keys = materialize(scope_keys(rows, ["cust_id"]), "scope-keys")
    joined = rows.select("note_id", "cust_id", "text").join(keys, "cust_id", "left")
    return joined.groupBy("note_id").agg(
        F.count("value").alias("known_values"), F.count_if(F.expr("contains(text, value)")).alias("present")
    )


_KNOWN = "SELECT c_name AS value FROM customer UNION SELECT n_name FROM nation UNION SELECT r_name FROM region"


@query(
    "find_known_values",
    f"SELECT note_id, value FROM ({o.DUCK_NOTES}) JOIN ({_KNOWN}) ON contains(text, value)",
)
def _find(spark, sf_dir):
    known = terms(spark, sf_dir).where("entity_type <> 'NRP'").select(F.col("term").alias("value")).distinct()
    return find_values(notes(spark, sf_dir), known, [], ["note_id"])


@query(
    "leak_check",
    o.with_(
        [
            f"masked AS ({o.scrubbed(o.NOTE_TEXTS, o.PATTERN_TYPES, 'id')})",
            "known AS (SELECT DISTINCT concat('user', c_custkey, '@example.com') AS value FROM customer "
            "UNION SELECT c_name FROM customer)",
            "found AS (SELECT value, count(*) AS n FROM masked JOIN known ON contains(masked, value) GROUP BY value)",
        ],
        "SELECT value, coalesce(n, 0) AS n_texts, n IS NOT NULL AS leaked FROM known LEFT JOIN found USING (value)",
    ),
)
def _leaks(spark, sf_dir, automaton=False):
    masked = scrubbing.scrub(notes(spark, sf_dir)).select("note_id", "masked")
    customers = table(spark, sf_dir, "customer")
    known = customers.select(F.expr("concat('user', c_custkey, '@example.com')").alias("value")).union(
        customers.select("c_name")
    )
    return reports.leak_check(masked, known, "masked", ["note_id"], automaton)


@query("automaton_known_values", SQL["find_known_values"])
def _automaton_find(spark, sf_dir):
    known = terms(spark, sf_dir).where("entity_type <> 'NRP'").select(F.col("term").alias("value")).distinct()
    return automaton_values(notes(spark, sf_dir), known, [], ["note_id"])


@query("automaton_leak_check", SQL["leak_check"])
def _automaton_leaks(spark, sf_dir):
    return _leaks(spark, sf_dir, automaton=True)


@query(
    "residual_pii",
    # Only the chosen types were masked; the others are what is left.
    o.with_(
        [f"masked AS MATERIALIZED ({o.scrubbed(o.NOTE_TEXTS, o.FOUR, 'id')})"]
        + o.spans("SELECT id, masked AS text FROM masked", o.PATTERN_TYPES),
        "SELECT id AS note_id, entity_type, count(*) AS hits FROM spans GROUP BY id, entity_type",
    ),
)
def _residual(spark, sf_dir):
    masked = scrubbing.scrub(notes(spark, sf_dir).select("note_id", "text"), entities=o.FOUR)
    left = reports.residual_pii(masked.select("note_id", "masked"))
    return left.groupBy("note_id", "entity_type").agg(F.count("*").alias("hits"))


@query(
    "unmasked_rows",
    # A masking run that covered URLs only, checked for URLs and dates.
    o.with_(
        [f"masked AS MATERIALIZED ({o.scrubbed(o.NOTE_TEXTS, ['URL'], 'id')})"]
        + o.spans(o.NOTE_TEXTS, ["URL", "US_SSN"]),
        "SELECT id AS note_id FROM masked JOIN src USING (id) WHERE masked = text AND id IN (SELECT id FROM spans)",
    ),
)
def _unmasked(spark, sf_dir):
    before = notes(spark, sf_dir)
    after = scrubbing.scrub(before, entities=["URL"]).select("note_id", "masked")
    both = reports.before_and_after(before, after, ["note_id"])
    return reports.unmasked_rows(both, entities=["URL", "US_SSN"]).select("note_id")


@query(
    "rows_without_hits",
    o.with_(
        o.spans(o.DOCUMENTS, o.FOUR), "SELECT id AS doc_id FROM src WHERE id NOT IN (SELECT id FROM spans)"
    ),
)
def _without_hits(spark, sf_dir):
    rows = documents(spark, sf_dir)
    found = explode_spans(detect(rows, entities=o.FOUR))
    return reports.rows_without_hits(rows, found, ["doc_id"]).select("doc_id")


@query(
    "size_report",
    o.with_(
        [f"masked AS ({o.scrubbed(o.DOCUMENTS, o.FOUR, 'doc_id')})"],
        "SELECT source, count(*) AS n_texts, CAST(sum(strlen(text)) AS BIGINT) AS original_bytes, "
        "CAST(sum(strlen(masked)) AS BIGINT) AS masked_bytes FROM documents JOIN masked USING (doc_id) GROUP BY source",
    ),
)
def _sizes(spark, sf_dir):
    return reports.size_report(scrubbing.scrub(documents(spark, sf_dir), entities=o.FOUR), by=["source"])


@query(
    "entity_report",
    o.with_(
        o.spans(o.NOTE_TEXTS, o.PATTERN_TYPES),
        "SELECT t AS entity_type, count(value) AS hits, count(DISTINCT value) AS distinct_values FROM (SELECT unnest(["
        + ", ".join(f"'{t}'" for t in o.RANKS)
        + "]) AS t) LEFT JOIN spans ON entity_type = t GROUP BY t",
    ),
)
def _entities(spark, sf_dir):
    found = explode_spans(detect(notes(spark, sf_dir)))
    return reports.entity_report(found).drop("description")


@query(
    "entity_report_of_sketches",
    # The estimate is checked against the exact number: three standard errors hold.
    o.with_(
        o.spans(o.NOTE_TEXTS, o.PATTERN_TYPES),
        "SELECT entity_type, count(*) AS hits, count(DISTINCT id) AS texts, count(DISTINCT value) AS distinct_values, "
        "true AS estimate_holds FROM spans GROUP BY entity_type",
    ),
)
def _sketches(spark, sf_dir):
    """One row per region and type is stored, and all regions are put together."""
    # Both the sketches and the exact numbers read the spans, so that no text is searched twice.
    found = materialize(detect(notes(spark, sf_dir)).select("region", "spans"), "detected")
    stored = materialize(entity_sketches(found, ["region"]), "sketches")
    exact = reports.entity_report(explode_spans(found)).select("entity_type", F.col("distinct_values").alias("exact"))
    report = sketch_report(stored).join(F.broadcast(exact), "entity_type")
    holds = F.col("exact").between(F.col("low"), F.col("high")).alias("estimate_holds")
    return report.select("entity_type", "hits", "texts", F.col("exact").alias("distinct_values"), holds)


@query(
    "scope_report",
    o.with_(
        o.spans(_SOURCES, o.FOUR),
        "SELECT scope_id AS source, count(DISTINCT id) AS parts, count(value) AS hits, "
        "count(DISTINCT value) AS distinct_values FROM src LEFT JOIN spans USING (id) GROUP BY scope_id",
    ),
)
def _scopes(spark, sf_dir):
    return reports.scope_report(detect(documents(spark, sf_dir), entities=o.FOUR), ["source"])


@query(
    "labels_with_hits",
    o.with_(
        o.spans(o.DOCUMENTS, o.FOUR),
        "SELECT quality, toxic, count(DISTINCT doc_id) AS documents, count(value) AS hits FROM labels "
        "JOIN src ON id = doc_id LEFT JOIN spans USING (id) GROUP BY quality, toxic",
    ),
)
def _labels(spark, sf_dir):
    # Only hits meet the labels, not the texts.
    hits = detect(documents(spark, sf_dir), entities=o.FOUR).select("doc_id", "spans")
    found = hits.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", "toxic", "spans")
    report = reports.scope_report(found, ["quality", "toxic"])
    return report.select("quality", "toxic", F.col("parts").alias("documents"), "hits")


# --- plug-ins and SQL ----------------------------------------------------------------------


def _load_marker():
    """A stand-in for a model: e-mail addresses and what follows 'for '."""
    import re

    address = re.compile(r"user[0-9]+@example\.com")
    person = re.compile(r"Customer#[0-9]+")
    return lambda text: {
        **{a: placeholder("EMAIL_ADDRESS") for a in address.findall(text)},
        **{p: placeholder("PERSON") for p in person.findall(text)},
    }


_MARKED = [
    f"src AS MATERIALIZED ({o.NOTE_TEXTS})",
    "spans AS (SELECT id, 'EMAIL_ADDRESS' AS entity_type, unnest(regexp_extract_all(text, 'user[0-9]+@example\\.com')) "
    "AS value FROM src UNION ALL SELECT id, 'PERSON', unnest(regexp_extract_all(text, 'Customer#[0-9]+')) FROM src)",
]


@query(
    "provider_plug_in",
    o.with_(
        _MARKED + o.keys() + o.folds(),
        f"SELECT id AS note_id, {o.fold('text')} AS masked FROM src LEFT JOIN maps ON scope = id",
    ),
)
def _provider(spark, sf_dir):
    ship_package(spark, checks)
    provider = providers.model_provider(_load_marker)
    return providers.scrub_with_provider(notes(spark, sf_dir), provider).select("note_id", "masked")


@query(
    "provider_plug_in_customer_scope",
    o.with_(
        [f"src AS MATERIALIZED ({_CUSTOMERS})", _MARKED[1]]
        + ["scoped_spans AS (SELECT scope_id, value, entity_type FROM spans JOIN src USING (id))"]
        + o.keys("scope_id", "scoped_spans")
        + o.folds(),
        f"SELECT id AS note_id, {o.fold('text')} AS masked FROM src LEFT JOIN maps ON scope = scope_id",
    ),
)
def _provider_scope(spark, sf_dir):
    ship_package(spark, checks)
    provider = providers.model_provider(_load_marker)
    masked = providers.scrub_with_provider(notes(spark, sf_dir), provider, scope=["cust_id"], key=["note_id"])
    return masked.select("note_id", "masked")


@query("scope_table_function", SQL["provider_plug_in_customer_scope"])
def _table_function(spark, sf_dir):
    ship_package(spark, checks)
    register_scope_function(spark, _load_marker, "scrub_customer")
    rows = notes(spark, sf_dir).select("note_id", "cust_id", "text")
    return spark.sql(
        "SELECT note_id, masked FROM scrub_customer(TABLE(SELECT * FROM {rows}) PARTITION BY (cust_id), 'text')", rows=rows
    )


@query(
    "handler_plug_in",
    # Parts of kind 'upper' are masked and shouted; other kinds as usual.
    o.with_(
        o.spans(o.NOTE_TEXTS, o.FOUR) + o.keys() + o.folds(),
        f"SELECT id AS note_id, CASE WHEN id % 2 = 0 THEN upper({o.fold('text')}) ELSE {o.fold('text')} END AS masked "
        "FROM src LEFT JOIN maps ON scope = id",
    ),
)
def _handler(spark, sf_dir):
    upper = Handler(mask=lambda text, keys: f"upper({mask.replace_sql(text, keys)})")
    rows = notes(spark, sf_dir).withColumn("kind", F.expr("if(note_id % 2 = 0, 'upper', 'text')"))
    masked = scrubbing.scrub(rows, entities=o.FOUR, kind="kind", handlers={"upper": upper})
    return masked.select("note_id", "masked")


@query("sql_functions", o.scrubbed(o.DOCUMENTS, o.FOUR, "doc_id", ", coalesce(len(k), 0) AS n_values"))
def _sql(spark, sf_dir):
    register_functions(spark, o.FOUR, prefix="four_")
    return spark.sql(
        "SELECT doc_id, four_mask(text) AS masked, cast(size(four_map(text)) AS bigint) AS n_values "
        f"FROM parquet.`{sf_dir}/documents.parquet`"
    )
