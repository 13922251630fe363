"""Queries that apply the operators of this subpackage to their whole tables, and SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, langid, license_scan, linedup, media, packing, quality, rules, simhash
from .common import documents, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(documents(spark, sf_dir))
    return found.select("doc_id", "template", "start_word", "n_words", "containment")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(documents(spark, sf_dir)).drop("error")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), with_ids=False).drop("ids")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    planted = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(*planted.columns)
    return chat.read_back(chat.format_conversations(turns.unionAll(planted)))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return linedup.keep_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(documents(spark, sf_dir)).drop("text")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(documents(spark, sf_dir))
    return near.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_media": op2_media,
    "op3_packing": op3_packing,
    "op4_chat": op4_chat,
    "op5_line_dedup": op5_line_dedup,
    "op6_langid": op6_langid,
    "op7_rules": op7_rules,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLES: dict[str, str] = {
    "op1_license_scan": license_scan.oracle_sql(),
    "op5_line_dedup": r"""
WITH lines AS (
    SELECT doc_id, r, i AS pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, hash(coalesce(text, '')) AS r, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), frequent AS (
    SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT (doc_id, r)) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f USING (key)
GROUP BY doc_id
""",
    "op7_rules": r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), grams AS (
    SELECT r, i, list_slice(words, i, i + 4) AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM docs WHERE len(words) >= 5)
), twice AS (
    SELECT r, i FROM grams SEMI JOIN (SELECT r, gram FROM grams GROUP BY r, gram HAVING count(*) > 1) USING (r, gram)
), covered AS (
    SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) AS o(k) GROUP BY r
), raw AS (
    SELECT r, doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM docs
), lines AS (
    SELECT r, doc_id, source, text, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM raw
), frequent AS (
    SELECT source, key FROM lines WHERE key <> '' GROUP BY source, key HAVING count(DISTINCT (doc_id, text)) >= 20
), sums AS (
    SELECT r, count(*) - count(DISTINCT line) AS dup, sum(length(l.key)) AS everything,
           coalesce(sum(length(l.key)) FILTER (WHERE f.key IS NULL), 0) AS remaining
    FROM lines l LEFT JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.key = f.key WHERE l.key <> '' GROUP BY r
), counts AS (
    SELECT r, doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0) AS word_chars,
           length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
           coalesce(n, 0) AS n_repeat_words, coalesce(remaining < 0.3 * everything, false) AS depleted
    FROM docs LEFT JOIN covered USING (r) LEFT JOIN sums USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT depleted AS kept
FROM counts
""",
}
