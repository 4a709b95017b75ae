"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, blocknames, dartminhash, editmatch, interpolation, packing, pagediff, records, subwords, urldigest, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_framed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = base.scratch_path(spark, "records")
    records.write_records(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return records.read_records(spark, path, ("doc_id", "start", "n_tokens", "ids_crc32"))


def op3_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


#: The rules that the query judges by.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op4_digest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urldigest.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


OP4_SQL = r"""
WITH rules(rule, action) AS (
  VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
parts AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM parts, rules
  WHERE ('.' || host) LIKE ('%.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN fits USING (n)
"""


def op5_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = blocknames.exact_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", "text_sha256")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

def op6_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = subwords.score(docs, subwords.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (base.id_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_pigeonhole_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = editmatch.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "distance", "start", "end")


def op8_sequential_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = base.scratch_path(spark, "warc")
    files = warc.write_warc(_table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path, [f["file"] for f in files if f["records"]], ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


OP8_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, row_number() OVER () AS n FROM pages),
d AS (
  SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex,
         row_number() OVER (PARTITION BY body ORDER BY page_id DESC NULLS LAST, n DESC) AS place,
         first_value(page_id) OVER (PARTITION BY body ORDER BY page_id DESC NULLS LAST, n DESC) AS first
  FROM p)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + (CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) // (1::BIGINT << (15 - 5 * (i % 4)))) % 32 AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN first END AS refers_to
FROM d
"""


def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score(_table(spark, sf_dir, "documents"))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dartminhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", F.col("class_size").cast("long").alias("class_size"), "representative")


QUERIES = {
    "op1_bin_slack": op1_bin_slack,
    "op2_framed_records": op2_framed_records,
    "op3_page_differencing": op3_page_differencing,
    "op4_digest_filter": op4_digest_filter,
    "op5_block_naming": op5_block_naming,
    "op6_subword_quality": op6_subword_quality,
    "op7_pigeonhole_edit": op7_pigeonhole_edit,
    "op8_sequential_warc": op8_sequential_warc,
    "op9_deleted_interpolation": op9_deleted_interpolation,
    "op10_dart_minhash": op10_dart_minhash,
}
ORACLE_SQL = {
    "op4_digest_filter": OP4_SQL,
    "op5_block_naming": OP5_SQL,
    "op8_sequential_warc": OP8_SQL,
}
