"""Parquet tables and the logical views over them: resting orders, market orders, transactions, changes, ticks and so on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Operation codes of the transaction kinds that events stand for.
OP_CODES = {"signup": 41, "view": 0, "click": 61, "purchase": 65, "error": 62}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: Column) -> Column:
    return F.round(c * 100).cast("bigint")


def slot_of(trader: Column, size: Column) -> Column:
    """Priority slot of an order: VIP traders, then small orders, then twelve slots by trader."""
    return F.when(trader < 100, 1).when(size < 1000, 2).otherwise(3 + trader % 12).cast("int")


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resting orders of a book that is not crossed."""
    o = table(spark, sf_dir, "orders")
    c = cents(F.col("o_totalprice"))
    even = F.col("o_orderkey") % 2 == 0
    out = o.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_custkey").alias("trader_id"),
        F.when(even, "BUY").otherwise("SELL").alias("side"),
        (F.lit(6500000) + F.when(even, -1).otherwise(1) * (1 + c % 500)).cast("bigint").alias("price"),
        (100 + c % 20000).alias("size"),
        F.col("o_orderstatus").alias("status"),
        (101 + F.col("o_custkey") % 11).alias("symbol"),
    )
    filled = F.when(F.col("status") == "F", F.col("size")).when(F.col("status") == "P", F.expr("size div 2")).otherwise(0).cast("bigint")
    out = out.withColumn("filled", filled).withColumn("remaining", F.col("size") - F.col("filled"))
    return out.withColumn("slot", slot_of(F.col("trader_id"), F.col("size"))).drop("status")


def takers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market buys, in the order of their arrival."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("taker_id")).agg(F.sum("l_quantity").cast("bigint").alias("size")).withColumn("arrival", F.col("taker_id"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of transactions by arrival; every seventeenth repeats its predecessor's signature."""
    e = table(spark, sf_dir, "events")
    op = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in OP_CODES.items()))
    n = F.col("event_id") - F.when((F.col("event_id") % 17 == 0) & (F.col("event_id") > 0), 1).otherwise(0)
    return e.select(
        F.col("event_id").alias("arrival"),
        (F.col("user_id") + 1).cast("bigint").alias("uid"),
        (F.col("event_id") + (F.col("event_id") * 7919) % 50).alias("nonce"),
        op.alias("op_code"),
        (F.get_json_object("props", "$.k").cast("bigint") % 128).alias("market"),
        "ts",
        cents(F.col("value")).alias("amount"),
        F.sha2(F.concat(F.lit("sig:"), n.cast("string")), 256).alias("sig"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known users: customers, but for those with a large debt."""
    c = table(spark, sf_dir, "customer").filter("c_acctbal >= -500")
    return c.select(F.col("c_custkey").alias("uid"), F.lit(0).cast("bigint").alias("init_nonce"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log: upserts and deletes of keys, in sequence."""
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("bigint").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), cents(F.col("value")).alias("value"))


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named tables in one frame."""
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("tree"), F.col("doc_id").alias("id"), F.col("text").alias("value"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("uid"), (F.col("c_custkey") % 5).cast("int").alias("status"), F.col("c_custkey").bitwiseXOR(F.lit(3405691582)).alias("email_hash"))


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("bigint").alias("asset_id"), F.abs(cents(F.col("c_acctbal"))).alias("available"))
    return c.withColumn("locked", F.expr("available div 10"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batched payloads: one row per order with its lines as an array, in a fixed order."""
    line = F.struct("l_linenumber", "l_partkey", cents(F.col("l_extendedprice")).alias("price"), F.col("l_quantity").cast("bigint").alias("quantity"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tx_id")).agg(F.array_sort(F.collect_list(line)).alias("items"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("ts", cents(F.col("value")).alias("price"), F.col("event_id").alias("arrival"))


def mirror_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("key"), (F.col("p_partkey") % 2).cast("int").alias("side"), cents(F.col("p_retailprice")).alias("price"), F.col("p_size").cast("bigint").alias("qty"))


def mirror_managed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in the market now: some targets at their price, some off it, some that are no longer wanted."""
    t = mirror_target(spark, sf_dir)
    live = t.filter(F.col("key") % 10 < 8).withColumn("price", F.col("price") + F.when(F.col("key") % 3 == 0, 25).otherwise(0))
    old = t.filter(F.col("key") % 50 == 0).withColumn("key", F.col("key") + 1000000)
    return live.unionByName(old)
