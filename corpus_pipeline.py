"""The corpus pipeline: quality rules, exact and near duplicates, the mix of sources, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.llm import byte_bpe, common, exact_dedup, mixing, quality, simhash, similar

RANKS = "byte_bpe_50k.tiktoken"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the cutoffs of their language reject go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the smallest doc_id stays.

    Documents are near duplicates if their 64-bit fingerprints differ by 3 bits or less, or if their
    five-word shingles have a similarity of 0.8 or more."""
    return simhash.keep_one(docs, groups=similar.similar_groups(docs))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it: never, once or twice."""
    return mixing.mix_documents(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids: the whole text's token ids, 32-bit and little-endian.

    Every text is decoded again; a difference to its bytes would fail the stage."""
    encoded = byte_bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, verify=True)
    return encoded.select("doc_id", "lang", "source", F.col("n_tokens"), F.col("ids"))


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("source_mix", mix_stage),
    ("byte_bpe", tokens_stage),
]

#: Exact binomial bounds, 64-bit hashes, components and merges of byte pairs have no SQL form; tests
#: hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`. Each stage's rows are written to the shared folder and read again; what a later stage has read is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = common.shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            common.delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
