"""From raw documents to packed training sequences, in five stages of the operators in tidemark.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. Stages accept null values in any column, empty tables and extra columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.kit import materialize
from tidemark.llm.kn_quality import keep
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import mixed_rows
from tidemark.llm.ngram_join import join
from tidemark.llm.packing import byte_bpe_path, pack

#: Kneser-Ney bands, suffix order of lines, and packing have no SQL form.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave their language's perplexity band go."""
    return keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of maximal repeated runs of lines go whole; so do documents that have nothing else."""
    return dedup_lines(docs, min_words=8, drop_empty=True).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the smallest id, then the smallest hash of the text, then of the other columns.

    Rows are judged one by one where ids repeat; equal rows are one. Rows without an id stay.
    """
    if docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        groups = materialize(join(docs))
        gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    others = F.to_json(F.struct(F.lit(0).alias("_nd_0"), *(F.col(c) for c in docs.columns if c not in ("doc_id", "text"))))
    rows = docs.filter("doc_id is not null").withColumn("_nd_x", F.xxhash64("text")).withColumn("_nd_y", F.xxhash64(others))
    keys = ["doc_id", "_nd_x", "_nd_y"]
    named = materialize(rows.select(*keys).distinct().orderBy(*keys).select(*keys, F.monotonically_increasing_id().alias("_nd_row")))
    rows = materialize(rows.join(named, keys).dropDuplicates(["_nd_row"]))
    groups = materialize(join(rows.select(F.col("_nd_row").alias("doc_id"), "text")))
    kept = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("_nd_row"))
    return rows.join(kept, "_nd_row", "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, cut where it takes a part."""
    return mixed_rows(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place in it."""
    return pack(docs, byte_bpe_path(), capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
