"""Licence scans by a positional index of rare words, in DataFrame operations only.

The index holds the words of licence notices that stand in few of them, with their
positions. A file's rare words are looked up; hits that keep their distance point to
one notice at one place. A notice is confirmed if enough of its rare words, weighted by
IDF, lie there and all its key phrases stand in the place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscrub.functions.sqltext import literal, name
from sparkscrub.llm.common import doc_rows, materialize, same
from sparkscrub.plans.sizing import fits_broadcast

# Phrases whose places count as they are.
BASE_PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Label, words of a notice, key phrases that must stand in it.
NOTICES = (
    ("agpl", "gnu affero general public license", ("affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at"
        " http www apache org licenses license 2 0",
        ("compliance with the license", "apache org"),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided"
        " that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    ("bsd", "released under the bsd license", ("bsd license",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "creative commons attribution noncommercial international license", ("attribution noncommercial",)),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0", ("cc by nc nd",)),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", ("cc by nc sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-sa", "creative commons attribution sharealike international license", ("attribution sharealike",)),
    ("cc0", "cc0 1 0 universal public domain dedication", ("cc0",)),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
        " public license as published by the free software foundation",
        ("free software", "general public license"),
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is"
        " hereby granted",
        ("with or without fee is hereby granted",),
    ),
    ("lgpl", "gnu lesser general public license version 3", ("lesser general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("reserved", "copyright all rights reserved", ("all rights reserved",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    # Short mentions: the key phrase is the whole notice.
    ("cc-by-nc", "attribution noncommercial", ("attribution noncommercial",)),
    ("cc-by-sa", "attribution sharealike", ("attribution sharealike",)),
    ("cc0", "cc0", ("cc0",)),
    ("lgpl", "lesser general public license", ("lesser general public license",)),
    ("mpl-2.0", "mozilla public license", ("mozilla public license",)),
)

# No key phrase or base phrase is in a text without one of these.
_STEMS = ("licen", "rights", "permission", "redistribution", "attribution", "compliance", "software", "granted", "cc")
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Hits of one notice may drift by half of this many words, for names and years put in.
DRIFT = 16


def lowered(text: str) -> Column:
    """A-Z to lower case, null as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _UPPER.lower())


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _BETWEEN), "")


def may_hold(text: Column) -> Column:
    def test(low: Column) -> Column:
        found = F.lit(False)
        for stem in _STEMS:
            found = found | F.contains(low, F.lit(stem))
        return found

    # The one-element array names the text, so that it is made once.
    return F.exists(F.array(text), test)


def phrase_places(words: str, phrase: str) -> str:
    """SQL: the positions (from 0) where the words of a phrase stand one after the other."""
    parts = phrase.split(" ")
    found = " AND ".join(f"w[i + {n}] = '{p}'" for n, p in enumerate(parts))
    last = len(parts) - 1
    steps = f"filter(sequence(0, size(w) - {last + 1}), i -> {found})"
    return f"transform(array({words}), w -> IF(size(w) > {last}, {steps}, array()))[0]"


def notice_index(spark: SparkSession, notices=NOTICES, rare: float = 0.25) -> DataFrame:
    """``word, notice, label, q, idf, total, length, phrases``: a row for each place of a rare word.

    Rare words stand in at most ``rare`` of the notices. ``total``: the notice's IDF
    weight. The table is as small as the list of notices.
    """
    rows = [(n, label, text.split(" "), list(phrases)) for n, (label, text, phrases) in enumerate(notices)]
    table = spark.createDataFrame(rows, "notice int, label string, words array<string>, phrases array<string>")
    places = table.select("notice", "label", F.size("words").alias("length"), "phrases", F.posexplode("words").alias("q", "word"))
    counts = places.groupBy("word").agg(F.count_distinct("notice").alias("df"))
    weight = F.log(F.lit(float(len(rows))) / F.col("df"))
    found = places.join(counts.where(F.col("df") <= max(1.0, rare * len(rows))), "word").withColumn("idf", weight)
    total = found.groupBy("notice").agg(F.sum("idf").alias("total"))
    return found.join(total, "notice").drop("df")


def _phrases(notices) -> list[str]:
    return list(dict.fromkeys(phrase for _, _, phrases in notices for phrase in phrases))


def _marked_sql(words: str, notices) -> str:
    """SQL: the notices whose key phrases all stand in a text, with its words and the places of
    these phrases as ``p, word``; null for a text without such a notice. A phrase is written with a
    space before it, as no word is.
    """
    phrases = _phrases(notices)
    w, s, h, c, x, i = (name(v) for v in "wshcxi")
    holds = f"array({', '.join(f'contains({s}, {literal(f" {phrase} ")})' for phrase in phrases)})"
    tests = (" AND ".join(f"{h}[{phrases.index(p)}]" for p in dict.fromkeys(own)) or "true" for _, _, own in notices)
    chosen = f"array_compact(array({', '.join(f'IF({test}, {n}, NULL)' for n, test in enumerate(tests))}))"
    entries = [f"transform({w}, ({x}, {i}) -> struct({i} AS p, {x} AS word))"]
    for n, phrase in enumerate(phrases):
        places = f"transform({phrase_places(w, phrase)}, {i} -> struct({i} AS p, {literal(f' {phrase}')} AS word))"
        entries.append(f"IF({h}[{n}], {places}, cast(array() AS array<struct<p:int,word:string>>))")
    found = f"IF(size({c}) = 0, NULL, struct({c} AS notices, concat({', '.join(entries)}) AS entries))"
    found = f"transform(array({chosen}), {c} -> {found})[0]"
    found = f"transform(array({holds}), {h} -> {found})[0]"
    found = f"transform(array(concat(' ', array_join({w}, ' '), ' ')), {s} -> {found})[0]"
    return f"transform(array({words}), {w} -> {found})[0]"


def confirmed_notices(
    docs: DataFrame, notices=NOTICES, rare: float = 0.25, min_score: float = 0.5
) -> DataFrame:
    """``doc_id, k, label, score`` of the notices that stand in ``docs`` (``doc_id, k, text``).

    No text is moved: only notices whose key phrases stand somewhere in a text are looked
    for, and what leaves the text are numbers, the places of rare words and of phrases.
    """
    spark = docs.sparkSession
    index = notice_index(spark, notices, rare)
    phrases = [(f" {p}", n, -1 - j, len(p.split(" "))) for n, (_, _, own) in enumerate(notices) for j, p in enumerate(dict.fromkeys(own))]
    marks = spark.createDataFrame(phrases, "word string, notice int, q int, width int")
    sizes = [(n, len(dict.fromkeys(own))) for n, (_, _, own) in enumerate(notices)]
    about = index.select("notice", "label", "total", "length").distinct()
    about = about.join(spark.createDataFrame(sizes, "notice int, n_phrases int"), "notice")
    looked_up = index.select("word", "notice", "q").unionByName(marks.drop("width"))

    low = lowered("text")
    files = docs.where(may_hold(low)).select("doc_id", "k", words_of(low).alias("words"))
    files = files.select("doc_id", "k", F.expr(_marked_sql("words", notices)).alias("_m"))
    # An outer generator, so that the texts are searched once.
    tokens = files.select("doc_id", "k", F.col("_m.notices").alias("notices"), F.expr("inline_outer(_m.entries)"))
    tokens = tokens.where(F.col("word").isNotNull())
    hits = tokens.join(F.broadcast(looked_up), "word").where("array_contains(notices, notice)")
    # Places of phrases as they are, of words by where the notice would begin.
    place = F.when(F.col("q") < 0, F.col("p")).otherwise(F.col("p") - F.col("q")).alias("place")
    hits = materialize(hits.select("doc_id", "k", "notice", "q", place), "notice-hits")

    # Two grids, so that hits with little drift share a cell of one of them.
    cells = F.array(F.floor(F.col("place") / DRIFT), F.floor((F.col("place") + DRIFT / 2) / DRIFT) + F.lit(1 << 40))
    cell = ("doc_id", "k", "notice", "cell")
    once = hits.where("q >= 0").withColumn("cell", F.explode(cells)).groupBy(*cell, "q").agg(F.min("place").alias("place"))
    once = once.join(F.broadcast(index.select("notice", "q", "idf")), ["notice", "q"])
    found = once.groupBy(*cell).agg(F.sum("idf").alias("weight"), F.min("place").alias("start"))
    found = found.join(F.broadcast(about), "notice").withColumn("score", F.col("weight") / F.col("total"))
    found = found.where(F.col("score") >= min_score).select(*cell, "start", "label", "length", "n_phrases", "score")

    # Phrases count from a little before the notice to a little behind it. Both sides meet by
    # blocks of words, so a notice that a text repeats does not meet all of its phrases.
    block = max(len(text.split(" ")) for _, text, _ in notices) + 2 * DRIFT
    spots = hits.where("q < 0").join(F.broadcast(marks.drop("word")), ["notice", "q"]).withColumn("block", F.floor(F.col("place") / block))
    spots = spots.withColumnsRenamed({c: f"_{c}" for c in ("doc_id", "k", "notice", "block")}).distinct()
    begin = F.greatest(F.lit(0), F.col("start") - DRIFT)
    end = begin + F.col("length") + 2 * DRIFT
    found = found.withColumn("block", F.explode(F.sequence(F.floor(begin / block), F.floor((end - 1) / block))))
    own = (F.col("k") == F.col("_k")) & same(F.col("doc_id"), F.col("_doc_id"))
    own = own & (F.col("notice") == F.col("_notice")) & (F.col("block") == F.col("_block"))
    near = found.join(spots, own & (F.col("place") >= begin) & (F.col("place") + F.col("width") <= end), "left")
    confirmed = near.groupBy(*cell, "label", "n_phrases", "score").agg(F.count_distinct("q").alias("n"))
    confirmed = confirmed.where(F.col("n") == F.col("n_phrases"))
    return confirmed.groupBy("doc_id", "k", "label").agg(F.least(F.lit(1.0), F.max("score")).alias("score"))


def scan_licenses(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    notices=NOTICES,
    rare: float = 0.25,
    min_score: float = 0.5,
) -> DataFrame:
    """``key, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row.

    ``n_base``: places of the base phrases; the first and last of their starts count
    words from 0. ``labels``: those of base phrases and of confirmed notices. ``score``:
    1 with a base phrase, else the best share of a confirmed notice's weight, else 0.

    A null text is empty: no words, no labels. Rows without a key and repeated rows are
    scanned one by one; equal rows get equal results. Empty tables give an empty result.
    Whole texts are scanned; other columns are not read.
    """
    docs = doc_rows(df, key, text).withColumn("k", F.xxhash64("text"))
    found = confirmed_notices(docs, notices, rare, min_score).groupBy("doc_id", "k")
    found = found.agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    found = materialize(found, "notices").withColumnsRenamed({"doc_id": "_id", "k": "_k"})
    found = F.broadcast(found) if fits_broadcast(found) else found
    low = lowered("text")
    rows = docs.select("doc_id", "k", low.alias("low")).select("doc_id", "k", words_of(F.col("low")).alias("words"), may_hold(F.col("low")).alias("may"))
    for n, (phrase, _) in enumerate(BASE_PHRASES):
        places = f"IF(may, {phrase_places('words', phrase)}, cast(array() AS array<int>))"
        rows = rows.withColumn(f"_{n}", F.expr(places))
    numbers = range(len(BASE_PHRASES))
    rows = rows.select("doc_id", "k", F.size("words").cast("long").alias("n_words"), *(f"_{n}" for n in numbers))
    rows = rows.withColumn("places", F.concat(*(f"_{n}" for n in numbers)))
    base = [F.when(F.size(f"_{n}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for n, (_, label) in enumerate(BASE_PHRASES)]
    rows = rows.withColumn("base", F.sort_array(F.array_distinct(F.concat(*base))))
    rows = rows.join(found, (F.col("k") == F.col("_k")) & same(F.col("doc_id"), F.col("_id")), "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return rows.select(
        F.col("doc_id").alias(key),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", more)), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.round("best", 6), F.lit(0.0))).alias("score"),
    )
