"""The registered queries of these operators and their SQL where DuckDB can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscrub.llm import backtrack, trie, variants
from sparkscrub.llm.article import extract_articles
from sparkscrub.llm.bpe import round_trip
from sparkscrub.llm.decontaminate import contamination
from sparkscrub.llm.licenses import scan_licenses
from sparkscrub.llm.lines import dedup_lines
from sparkscrub.llm.pii import find_personal_data, personal_data_digest
from sparkscrub.llm.quality import rate_quality
from sparkscrub.llm.simhash import simhash_components
from sparkscrub.llm.substrings import remove_repeats
from sparkscrub.llm.tokens import count_tokens

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))


def op2_simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))


def op3_personal_data(spark, sf_dir):
    return personal_data_digest(find_personal_data(table(spark, sf_dir, "documents")))


def op4_byte_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark, sf_dir):
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark, sf_dir):
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_html_article(spark, sf_dir):
    return extract_articles(table(spark, sf_dir, "pages"))


def op9_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark, sf_dir):
    return rate_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_backtracking_bpe(spark, sf_dir):
    return backtrack.round_trip(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark, sf_dir):
    turns = trie.turn_digests(table(spark, sf_dir, "conversations"))
    return trie.prefix_trie(*trie.share_openings(turns, family=20, most=4))


def op13_spelling_variants(spark, sf_dir):
    words = variants.count_words(table(spark, sf_dir, "documents"), min_length=7, min_count=2, slips=31)
    return variants.group_variants(words, ratio=10)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_simhash,
        op3_personal_data,
        op4_byte_bpe,
        op5_line_dedup,
        op6_decontamination,
        op7_substring_dedup,
        op8_html_article,
        op9_license_scan,
        op10_quality_rules,
        op11_backtracking_bpe,
        op12_conversation_trie,
        op13_spelling_variants,
    )
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTER_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
# CRC-32 of a number in decimal, bit by bit.
_CRC32 = (
    "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), "
    "lambda x: CAST(ascii(x) AS BIGINT))), lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), "
    "lambda b, i: CASE WHEN b & 1 = 1 THEN xor(b >> 1, CAST(3988292384 AS BIGINT)) ELSE b >> 1 END)), "
    "CAST(4294967295 AS BIGINT))"
)
_TURNS_KEY = (
    "md5(array_to_string(list_transform({}, lambda t: concat(length(t.r), ':', t.r, length(t.x), ':', t.x)), ''))"
)

# Expected results where DuckDB can say them; the other queries are tested against plain models.
SQL: dict[str, str] = {
    "op6_decontamination": f"""
WITH docs AS (SELECT doc_id, {_LETTER_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_LETTER_WORDS} AS w FROM benchmark),
spans AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(greatest(1, len(w) - 9)),
    lambda i: array_to_string(w[i + 1:i + 10], ' '))) AS g FROM items WHERE len(w) > 0),
places AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS s
    FROM docs, (SELECT DISTINCT n FROM spans) WHERE len(w) >= n),
hits AS MATERIALIZED (SELECT doc_id, s, n, item_id
    FROM (SELECT doc_id, s, n, array_to_string(w[s + 1:s + n], ' ') AS g FROM places) JOIN spans USING (n, g)),
words AS (SELECT doc_id, count(*) AS n_hit FROM
    (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op7_substring_dedup": f"""
WITH docs AS (SELECT doc_id, {_SPACE_WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(len(w) - 49)) AS s FROM docs WHERE len(w) >= 50),
windows AS MATERIALIZED (SELECT doc_id, s, md5(array_to_string(w[s + 1:s + 50], ' ')) AS g FROM places),
firsts AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g),
gone AS MATERIALIZED (SELECT doc_id, list_distinct(flatten(list(range(s, s + 50)))) AS p
    FROM windows JOIN firsts USING (g) WHERE doc_id > first GROUP BY doc_id),
kept AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs),
lost AS (SELECT doc_id, unnest(p) AS i FROM gone),
rest AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM kept ANTI JOIN lost USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(p), 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN gone USING (doc_id) LEFT JOIN rest USING (doc_id)""",
    "op12_conversation_trie": rf"""
WITH own AS MATERIALIZED (SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, ''))
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT c, s, c - c % 20 AS head, {_CRC32} % 4 AS h FROM own),
built AS (SELECT o.c, list_concat(coalesce(f.s[1:h], []), o.s[h + 1:]) AS s FROM heads o LEFT JOIN own f ON f.c = o.head),
steps AS (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM built),
paths AS MATERIALIZED (SELECT c, d, d = len(s) AS last, {_TURNS_KEY.format("s[1:d]")} AS k,
    CASE WHEN d > 0 THEN {_TURNS_KEY.format("s[1:d - 1]")} END AS up,
    CASE WHEN d > 0 THEN len(regexp_extract_all(s[d].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS w FROM steps),
nodes AS MATERIALIZED (SELECT k, d, min(c) AS conv_id, any_value(up) AS up, count(*) AS n,
    (count(*) - 1) * any_value(w) AS saved, count(*) FILTER (last) = count(*) AS leaf,
    string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last) AS ends FROM paths GROUP BY k, d),
below AS (SELECT p.k, p.d, CAST(count(*) FILTER (leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved
    FROM nodes t JOIN paths p ON p.c = t.conv_id AND p.d <= t.d GROUP BY p.k, p.d),
children AS (SELECT up AS k, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY up, d)
SELECT t.conv_id, t.d AS depth, f.conv_id AS parent_conv_id, t.n AS n_convs, coalesce(n_children, 0) AS n_children,
    n_leaves, b.saved AS saved_tokens, sha256(coalesce(t.ends, '')) AS ends_sha256
FROM nodes t JOIN below b USING (k, d) LEFT JOIN children USING (k, d)
LEFT JOIN nodes f ON f.k = t.up AND f.d = t.d - 1""",
}
