"""The registered queries of the training-data operators, with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import sql
from tidemark.llm.kit import materialize, n_words

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pq_dedup import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.98)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.bloom_lm import score

    return score(_documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix

    sized = materialize(_documents(spark, sf_dir).select("doc_id", "source", n_words(F.col("text")).alias("n_words")))
    return mix(sized, size_column="n_words").select("doc_id", "size", "source_size", "target", "taken", "shards")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.kd_shard import shard

    rows = shard(_documents(spark, sf_dir), n_shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import byte_bpe_path, pack

    return pack(_documents(spark, sf_dir), byte_bpe_path(), capacity=2048, end_id=0)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.kn_quality import judge

    rows = judge(_documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "language", "log_perplexity", "low", "high")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.line_dedup import dedup_lines

    rows = dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"), min_words=8)
    return rows.select("doc_id", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffix_dedup import digests

    return digests(_documents(spark, sf_dir), length=100)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.url_rules import judge

    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ngram_join import join

    return join(_documents(spark, sf_dir), width=5, threshold=0.75)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_near_dedup, op2_lm_scoring, op3_mixing, op4_sharding, op5_packing, op6_quality_rules, op7_line_dedup, op8_suffix_array_dedup, op9_url_filters, op10_ngram_jaccard, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": sql.NEAR_VECTORS, "op10_ngram_jaccard": sql.NGRAM_JACCARD, "op7_line_dedup": sql.REPEATED_LINES, "op8_suffix_array_dedup": sql.REPEATED_BYTES, "op9_url_filters": sql.url_filters(URL_RULES)}
