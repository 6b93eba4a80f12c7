"""A bitmap membership filter built with aggregates, in front of an exact semi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEEDS = (11, 29)


def _places(key: str, bits: int) -> Column:
    return F.array(*(F.pmod(F.xxhash64(F.lit(s), key), F.lit(bits)) for s in SEEDS))


def bitmap(keys: DataFrame, key: str, bits: int = 1 << 20) -> DataFrame:
    """word, mask: the non-zero 64-bit words of a filter of `bits` bits with two probes."""
    at = keys.select(F.explode(_places(key, bits)).alias("p"))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))
    return at.groupBy(F.expr("p div 64").alias("word")).agg(F.bit_or(mask).alias("mask"))


def may_contain(probes: DataFrame, filter_: DataFrame, key: str, bits: int = 1 << 20) -> DataFrame:
    """Probes whose bits are all set. The filter has at most bits / 64 words, so it may be broadcast."""
    out = probes
    for i, s in enumerate(SEEDS):
        f = filter_.select(F.col("word").alias(f"_w{i}"), F.col("mask").alias(f"_m{i}"))
        p = F.pmod(F.xxhash64(F.lit(s), key), F.lit(bits))
        bit = F.call_function("shiftrightunsigned", F.col(f"_m{i}"), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
        out = out.withColumn(f"_w{i}", F.floor(p / 64)).join(F.broadcast(f), f"_w{i}").filter(bit).drop(f"_w{i}", f"_m{i}")
    return out


def filtered_semi_join(probes: DataFrame, keys: DataFrame, key: str, bits: int = 1 << 20) -> DataFrame:
    return may_contain(probes, bitmap(keys, key, bits), key, bits).join(keys.select(key), key, "left_semi")
