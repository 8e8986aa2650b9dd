"""Masking per scope as rows arrive: a value seen in any part of a message or conversation is
masked in every later part of it.

The values of a scope are keyed state, kept in the stream's checkpoint, so a failed or
stopped run goes on with what it knew. Only values pass through the state; masking itself is
the same projection as in a batch.

* A row is masked with all values that its scope has shown up to its own micro-batch,
  whatever the order of rows within it.
* A value that comes late masks what comes with it and after it. Rows that are written
  already stay as they are; ``operators.incremental`` masks them anew.
* A value that was not seen for the time to live is forgotten; each sighting starts its time
  again. Spark runs such a stream also when nothing arrives, so it takes an interval as
  trigger and ends when it is stopped, not when all input is read.
* A scope's rows of one micro-batch are held by one task, so bound the batch
  (``maxFilesPerTrigger``, ``maxBytesPerTrigger``).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkscrub.catalog import RANKED_TYPES, placeholder
from sparkscrub.functions.spans import KEYS_TYPE, order_keys_sql, ranked_values_sql
from sparkscrub.functions.sqltext import column, let
from sparkscrub.plans.handlers import Handler, analysed_sql, masked_sql

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

_PLACED = [placeholder(t) for t in RANKED_TYPES]
# Strings that may first match once a placeholder stands in the text.
_MEETS = re.compile("<$|<[A-Z<]|^>|[A-Z>]>")


def _scope_values(live_ms: int | None) -> StatefulProcessor:
    # A class of its own for each stream travels as it is: the driver, too, starts a Python
    # process for it, which does not have the modules that the executors are sent.
    class ScopeValues(StatefulProcessor):
        """Remembers the values of a scope and gives each row those that it can hold."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.known = handle.getMapState("values", "value string", "rank int", live_ms)

        def handleInputRows(self, key, rows, timerValues):
            held, found = [], {}
            for row in rows:
                held.append(row)
                for hit in row["_found"] or ():
                    found[hit["value"]] = min(hit["rank"], found.get(hit["value"], hit["rank"]))
            known = {value[0]: rank[0] for value, rank in self.known.iterator()}
            for value, rank in found.items():
                best = min(rank, known.get(value, rank))
                if live_ms is not None or known.get(value) != best:
                    self.known.updateValue((value,), (best,))
                known[value] = best
            marks = [Row(value=value, placeholder=_PLACED[rank - 1]) for value, rank in known.items()]
            anywhere = [m for m in marks if _MEETS.search(m.value) or any(m.value in p for p in _PLACED)]
            for row in held:
                text = row["_analysed"] or ""
                keys = [m for m in marks if m.value in text] + [m for m in anywhere if m.value not in text]
                own = {c: x for c, x in row.asDict().items() if c not in ("_found", "_analysed")}
                yield Row(**own, _keys=keys)

        def close(self) -> None:
            pass

    return ScopeValues()


def scrub_scope_stream(
    stream: DataFrame,
    scope: list[str],
    text: str = "text",
    entities: Iterable[str] | None = None,
    terms: dict | None = None,
    kind: str | None = None,
    handlers: Mapping[str, Handler] | None = None,
    live: int | None = None,
    output: str = "masked",
) -> DataFrame:
    """Add the masked text to a stream, with one replacement map per scope that grows with the stream.

    ``live``: seconds that an unseen value is remembered; None: for ever, so that the state
    grows with the distinct values. Rows without a scope share one. The state needs
    RocksDB, which is set in the session where it is not.
    """
    if not stream.isStreaming:
        raise ValueError("not a stream; use scrub")
    if isinstance(terms, DataFrame):
        raise ValueError("a stream takes terms as a dict of short lists")
    spark = stream.sparkSession
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)
    text, kind = column(stream, text), kind and column(stream, kind)
    analysed = let(text, lambda t: analysed_sql(t, kind, handlers), "t")
    rows = stream.withColumn("_analysed", F.expr(analysed))
    rows = rows.withColumn("_found", F.expr(ranked_values_sql("_analysed", entities, terms)))
    keyed = T.StructType([*stream.schema.fields, T.StructField("_keys", T._parse_datatype_string(KEYS_TYPE))])
    with_keys = rows.groupBy(*scope).transformWithState(
        statefulProcessor=_scope_values(None if live is None else live * 1000),
        outputStructType=keyed,
        outputMode="Append",
        timeMode="None" if live is None else "ProcessingTime",
    )
    masked = let(order_keys_sql("_keys"), lambda k: masked_sql(text, k, kind, handlers), "k")
    return with_keys.withColumn(output, F.expr(masked)).drop("_keys")
