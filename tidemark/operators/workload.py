"""Deterministic generators: every value comes from a hash of the row's number, so any partitioning gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed counts of each operation in a round: noop, reserve, create, cancel, cancel all, cancel and replace, amend.
OPERATIONS = ((0, 100), (31, 50), (61, 15_000), (62, 10_000), (63, 1_000), (64, 3_000), (65, 25_000))
ROUND = sum(n for _, n in OPERATIONS)


def draw(n: int, *keys) -> Column:
    return F.pmod(F.xxhash64(*(F.lit(k) if isinstance(k, (int, str)) else k for k in keys)), F.lit(n))


def transactions(spark: SparkSession, n: int, users: int = 10_000) -> DataFrame:
    """Rounds of OPERATIONS, each mixed: a row's place in its round is its number times a factor without a common divisor."""
    id_ = F.col("id")
    r, upto, op = F.pmod(id_ * 7919, F.lit(ROUND)), 0, None
    for code, share in OPERATIONS:
        upto += share
        op = F.when(r < upto, code) if op is None else op.when(r < upto, code)
    items = F.when(draw(10, 2, id_) == 0, 2 + draw(11, 3, id_)).otherwise(1)
    return spark.range(n).select(id_.alias("arrival"), (1 + draw(users, 4, id_)).alias("uid"), op.otherwise(65).alias("op_code"), draw(128, 5, id_).alias("market"), items.cast("int").alias("n_items"), F.sha2(F.concat(F.lit("tx:"), id_.cast("string")), 256).alias("sig"))


def traders(spark: SparkSession, n: int = 10_000) -> DataFrame:
    """5 % market makers, 10 % whales, 30 % bots, the rest retail, with their spreads, sizes and cancel rates."""
    r = draw(100, 6, F.col("id"))
    kind = F.when(r < 5, "mm").when(r < 15, "whale").when(r < 45, "bot").otherwise("retail")
    return spark.range(n).select(F.col("id").alias("trader_id"), kind.alias("kind")).select("*", F.when(F.col("kind") == "mm", 10).when(F.col("kind") == "bot", 50).otherwise(200).alias("spread"), F.when(F.col("kind") == "whale", 50_000).when(F.col("kind") == "mm", 5_000).otherwise(500).alias("order_size"), F.when(F.col("kind") == "mm", 0.5).when(F.col("kind") == "bot", 0.4).otherwise(0.1).alias("cancel_rate"))


def order_flow(spark: SparkSession, n: int, base: int = 6_500_000) -> DataFrame:
    """Operations in an exact mix of 25 % market, 35 % limit, 20 % cancel, 20 % modify; round prices draw more orders."""
    id_ = F.col("id")
    k = F.pmod(id_ * 7, F.lit(20))
    kind = F.when(k < 5, "market").when(k < 12, "limit").when(k < 16, "cancel").otherwise("modify")
    away = draw(500, 7, id_) + 1
    round_ = F.when(draw(4, 8, id_) == 0, F.expr("100 * ((1 + pmod(xxhash64(7, id), 500)) div 100)")).otherwise(away)
    side = F.when(draw(2, 9, id_) == 0, "BUY").otherwise("SELL")
    rows = spark.range(n).select(id_.alias("seq"), kind.alias("kind"), side.alias("side"), round_.alias("away"), (1 + draw(20_000, 10, id_)).alias("size"), draw(10_000, 11, id_).alias("trader"))
    return rows.withColumn("price", F.lit(base) + F.when(F.col("side") == "BUY", -F.col("away")).otherwise(F.col("away"))).drop("away")
