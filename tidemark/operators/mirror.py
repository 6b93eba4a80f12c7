"""Reconciling what is in a market with what should be there: create, amend, keep, cancel; level and split plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile(target: DataFrame, managed: DataFrame, price_step: int = 10, qty_step: int = 1) -> DataFrame:
    """key, action, price, qty. An order is amended if its price or quantity is off by more than a step."""
    t = target.select("key", F.col("price").alias("t_price"), F.col("qty").alias("t_qty"))
    m = managed.select("key", F.col("price").alias("m_price"), F.col("qty").alias("m_qty"))
    off = (F.abs(F.col("t_price") - F.col("m_price")) > price_step) | (F.abs(F.col("t_qty") - F.col("m_qty")) > qty_step)
    action = F.when(F.col("m_price").isNull(), "create").when(F.col("t_price").isNull(), "cancel").when(off, "amend").otherwise("keep")
    out = t.join(m, "key", "full_outer").withColumn("action", action)
    return out.select("key", "action", F.coalesce("t_price", "m_price").alias("price"), F.coalesce("t_qty", "m_qty").alias("qty"))


def outdated(target: DataFrame, managed: DataFrame) -> DataFrame:
    return managed.join(target.select("key"), "key", "left_anti")


def level_plan(levels: DataFrame, most_levels: int = 11, split_above: int = 1000, splits: int = 10, tick: int = 10) -> DataFrame:
    """Orders for the first levels of each side: a level whose price times quantity is large is split, prices spread by a part of a tick.

    levels: side, price, volume. Returns order_key, side, level, split, price, qty.
    """
    order = Window.partitionBy("side").orderBy(F.when(F.col("side") == "BUY", -F.col("price")).otherwise(F.col("price")))
    top = levels.withColumn("level", F.row_number().over(order)).filter(F.col("level") <= most_levels)
    n = F.when(F.col("price") * F.col("volume") > split_above, splits).otherwise(1)
    rows = top.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("split"))
    away = F.floor(F.lit(tick) * F.col("split") / splits)
    price = F.when(F.col("side") == "BUY", F.col("price") - away).otherwise(F.col("price") + away)
    key = F.concat_ws("-", "side", F.lit("lvl"), F.col("level").cast("string"), F.lit("split"), F.col("split").cast("string"))
    return rows.select(key.alias("order_key"), "side", "level", "split", price.alias("price"), F.floor(F.col("volume") / F.col("n")).alias("qty"))


def to_ints(price, qty, price_decimals: int, qty_decimals: int, truncate: bool):
    """Scaled integers of doubles: truncated where an order is created, rounded where one is amended."""
    f = (lambda c: F.floor(c)) if truncate else (lambda c: F.round(c))
    return f(price * 10**price_decimals).cast("bigint"), f(qty * 10**qty_decimals).cast("bigint")
