"""The operators as queries over the tables of a folder, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marlspike.llm import byte_bpe, exact_dedup, language_id, license_scan, mixing, quality, secret_scan, simhash, token_counts, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a cache of its own, so that a call does all the work
    tokenizer = token_counts.Tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"), windows=True)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return secret_scan.scan(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH s AS (
  SELECT doc_id, source, md5(coalesce(doc_id::varchar, '')) AS place,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source
), weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER o - 1) % 3 + 1 AS INT)] AS w,
         row_number() OVER o AS i
  FROM per WINDOW o AS (ORDER BY source ASC NULLS LAST)
), leveled AS (
  SELECT *, CAST(2 * source_size AS DOUBLE) AS cap,
         (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
          - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / sum(w) OVER (ORDER BY 2 * source_size / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fair
  FROM weighed
), stats AS (
  SELECT source, source_size, least(cap, max(fair) OVER () * w) AS target FROM leveled
), queued AS (
  SELECT s.*, t.source_size, t.target,
         CAST(sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id ASC NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS until
  FROM s JOIN stats t ON s.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT doc_id, source, place, size, source_size, target, until + r * source_size AS c,
         CASE WHEN target > 0 THEN (until + r * source_size) / target END AS finish
  FROM queued, (VALUES (0), (1)) AS rounds(r)
), budget AS (
  SELECT 1.5::DOUBLE * (SELECT CAST(sum(size) AS DOUBLE) FROM s) - CAST((SELECT sum(size) FROM copies WHERE c <= target) AS DOUBLE) AS words_left
), tail AS (
  SELECT *, sum(size) OVER (ORDER BY finish, coalesce(source, ''), place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent
  FROM copies WHERE finish > 1 AND size > 0
), taken AS (
  SELECT doc_id, place, sum(size) AS words FROM (
    SELECT doc_id, place, size FROM copies WHERE c <= target
    UNION ALL
    SELECT doc_id, place, size FROM tail, budget WHERE spent <= words_left
  ) GROUP BY doc_id, place
)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(t.words, 0) AS BIGINT) AS taken
FROM queued q LEFT JOIN taken t ON q.doc_id = t.doc_id
"""


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_language_id": op3_language_id,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_license_scan": op5_license_scan,
        "op6_quality_rules": op6_quality_rules,
        "op7_secret_scan": op7_secret_scan,
        "op8_url_filter": op8_url_filter,
        "op9_source_mix": op9_source_mix,
        "op10_simhash_near_dedup": op10_simhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op5_license_scan": license_scan.scan_sql(windows=True), "op9_source_mix": OP9_SQL}
