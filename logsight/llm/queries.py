"""The registered queries of this subpackage: each numbered operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logsight.llm import alignment, digests, embed_dedup, minhash_dedup, mixing, ngram_rules, oracles, packing, pii, quality, shards, spelling, substring_dedup, token_files

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(_table(spark, sf_dir, "documents"))
    return token_files.read_token_documents(spark, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.byte_shards(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(_table(spark, sf_dir, "documents")))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find_spans(_table(spark, sf_dir, "documents")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return quality.classify(documents, quality.fit(documents, _table(spark, sf_dir, "labels")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_rules.quality_rules(_table(spark, sf_dir, "documents"))


_OPERATORS = (
    op1_embedding_dedup, op2_token_files, op3_byte_shards, op4_substring_dedup, op5_minhash_dedup, op6_packing, op7_mix_sources,
    op8_fingerprints, op9_pii, op10_quality, op11_spelling_variants, op12_token_alignment, op13_quality_rules,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _OPERATORS}
ORACLE_SQL: dict[str, str] = dict(oracles.ORACLE_SQL)
