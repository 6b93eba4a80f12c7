"""Sharding by a k-d tree over document metadata. DataFrame functions only.

Law `bytes`. Equal texts form a group that stays together. Each leaf of the tree is a shard: a node that has several shards to make
is split, as evenly as their number allows, at the weighted median (bytes) of the dimension in which the node is widest, measured
against the whole table. With target_bytes a node makes as many shards as its bytes ask for, so leaves stop at that size. Dimensions:
the group's smallest doc_id, the logarithm of its text's bytes, and the rank of the language and source of its smallest document among
all such values; a hash breaks ties. Medians are found for all nodes of a level at once by rounds of histograms; one row per node
reaches the driver, and goes back as a table that is joined.

Nulls: a null text has no bytes and goes with empty texts; nulls in metadata count as the smallest value. Texts of any length count
whole; one that is larger than a shard's share makes its shard larger. Repeated rows keep their own slots. Empty tables give empty
results. Extra columns pass through, whatever their names; shard, slot, size and text_crc32 columns of docs are replaced.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.kit import materialize, unit

BINS, ROUNDS = 4096, 3
SUBS = 256
MOST_BROADCAST = 100_000  # rows of a few numbers
STATE = "node: bigint, k: int, lo: double, width: double, below: double, goal: double"
SPLIT = "node: bigint, k: int, at: double, half: bigint"


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a table: one literal in the plan, read by the JVM."""
    names = [c.split(":")[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def _few(df: DataFrame) -> DataFrame:
    """With a hint to broadcast, if there are so few rows."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _coordinate(k: Column, dims: int) -> Column:
    return F.element_at(F.array(*(F.col(f"d{i}") for i in range(dims))), k + 1)


def _medians(points: DataFrame, dims: int, share: dict[int, float]) -> dict[int, tuple[int, float]]:
    """For each node: its widest dimension and the point of it below which its share of the weight lies."""
    spans = points.groupBy("node").agg(F.sum("weight").alias("w"), *(f(f"d{k}").alias(f"{n}{k}") for k in range(dims) for n, f in (("lo", F.min), ("hi", F.max)))).collect()
    state = {}
    for r in spans:
        k = max(range(dims), key=lambda k: (r[f"hi{k}"] - r[f"lo{k}"], -k))
        lo, hi = r[f"lo{k}"], r[f"hi{k}"]
        # dimension, start and width of the bin with the median, weight below it, the weight sought, weight up to its end
        state[r["node"]] = [k, lo, max((hi - lo) * (1 + 1e-9), 1e-12), 0.0, r["w"] * share[r["node"]], float(r["w"])]
    for _ in range(ROUNDS):
        rows = _table(points.sparkSession, [(node, s[0], s[1], s[2], float(s[3]), float(s[4])) for node, s in state.items()], STATE)
        bin_ = F.floor((_coordinate(F.col("k"), dims) - F.col("lo")) / F.col("width") * BINS)
        bins = points.join(_few(rows), "node").withColumn("bin", bin_).filter(F.col("bin").between(0, BINS - 1))
        sums = bins.groupBy("node", "bin", "below", "goal").agg(F.sum("weight").alias("w"))
        reached = F.sum("w").over(Window.partitionBy("node").orderBy("bin")) + F.col("below")
        found = sums.withColumn("to", reached).filter("to >= goal").groupBy("node").agg(F.min(F.struct("bin", "to", "w")).alias("m")).select("node", "m.*").collect()
        for r in found:
            s = state[r["node"]]
            s[1], s[2], s[3] = s[1] + s[2] * r["bin"] / BINS, s[2] / BINS, r["to"] - r["w"]
            s[5:] = [r["to"]]
    # The bin with the median goes left if that comes nearer to the share.
    return {node: (k, lo + width if to - goal < goal - below else lo) for node, (k, lo, width, below, goal, to) in state.items()}


def _ranks(values: DataFrame) -> DataFrame:
    """v, rank (0 to 1, in order) of distinct values: numbered within sorted ranges, whose counts come first."""
    ids = materialize(values.select("v").distinct().orderBy("v").withColumn("id", F.monotonically_increasing_id()))
    ids = ids.withColumn("part", F.shiftright("id", 33)).withColumn("at", F.col("id").bitwiseAND(F.lit((1 << 33) - 1)))
    parts = ids.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"))  # a row for each range
    total = max(1, ids.count() - 1)
    return ids.join(F.broadcast(parts), "part").select("v", ((F.col("before") + F.col("at")) / total).alias("rank"))


def shard(docs: DataFrame, n_shards: int = 16, target_bytes: int | None = None) -> DataFrame:
    """docs' columns with size, text_crc32, shard and slot. target_bytes sets the number of shards from the table's bytes."""
    if n_shards < 1 or (target_bytes is not None and target_bytes < 1):
        raise ValueError("there must be a shard")
    docs = docs.drop("size", "text_crc32", "shard", "slot")
    names = [c for c in ("lang", "source") if c in docs.columns]
    own = {c: f"_kd_{i}" for i, c in enumerate(docs.columns)}
    text = F.coalesce(F.col("text"), F.lit(""))
    # xxhash64 decides which rows stay together; unequal texts with one hash would share a shard, no more than that.
    named = docs.select(*(F.col(c).alias(n) for c, n in own.items()), "doc_id", *names, F.xxhash64(text).alias("group"), (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    thin = materialize(named.select("doc_id", "group", "size", *names))
    groups = thin.groupBy("group").agg(F.sum("size").alias("weight"), F.max("size").alias("bytes"), F.min(F.struct("doc_id", *names)).alias("m"))
    ranked = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n"))
    groups = groups.select("group", "weight", F.coalesce(F.col("m.doc_id").cast("double"), F.lit(-1.0)).alias("r0"), F.log2(F.col("bytes").cast("double")).alias("r1"), *(ranked(f"m.{c}").alias(f"v{k}") for k, c in enumerate(names, 2)))
    groups = materialize(groups)
    dims = 2 + len(names)
    for k in range(2, dims):
        ranks = materialize(_ranks(groups.select(F.col(f"v{k}").alias("v"))))
        groups = groups.join(_few(ranks.select(F.col("v").alias(f"v{k}"), F.col("rank").alias(f"r{k}"))), f"v{k}").drop(f"v{k}")
    groups = materialize(groups)
    whole = groups.agg(F.sum("weight").alias("w"), *(f(f"r{k}").alias(f"{n}{k}") for k in range(dims) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    if target_bytes:
        n_shards = max(1, math.ceil((whole["w"] or 0) / target_bytes))
    tie = lambda k: unit(F.xxhash64(F.lit(k), "group"))
    scaled = lambda k: (F.col(f"r{k}") - (whole[f"lo{k}"] or 0)) / max((whole[f"hi{k}"] or 0) - (whole[f"lo{k}"] or 0), 1e-9)
    points = materialize(groups.select("group", "weight", F.lit(0).cast("bigint").alias("node"), *((scaled(k) * (1 - 2.0**-16) + tie(k) * 2.0**-16).alias(f"d{k}") for k in range(dims))))
    # A node is named by the first of its shards.
    to_make = {0: n_shards}
    while any(n > 1 for n in to_make.values()):
        open_ = [node for node, n in to_make.items() if n > 1]
        some = points.filter(F.col("node").isin(open_)) if len(open_) < len(to_make) and len(open_) <= 1000 else points
        cut = _medians(some, dims, {node: (n // 2) / n if n > 1 else 0.5 for node, n in to_make.items()})
        rows = [(node, *cut.get(node, (0, 0.0)), to_make[node] // 2) for node in open_]
        split = _table(points.sparkSession, rows, SPLIT)
        beyond = _coordinate(F.col("k"), dims) >= F.col("at")
        points = points.join(_few(split), "node", "left").withColumn("node", F.col("node") + F.when(F.coalesce(beyond, F.lit(False)), F.col("half")).otherwise(0)).drop("k", "at", "half")
        points = materialize(points)
        to_make = {b: m for node, n in to_make.items() for b, m in ([(node, n // 2), (node + n // 2, n - n // 2)] if n > 1 else [(node, 1)])}
    leaves = materialize(points.select("group", F.col("node").cast("int").alias("shard")))
    out = _slots(named.join(leaves, "group"), thin.join(leaves, "group"))
    return out.select(*(F.col(n).alias(c) for c, n in own.items()), "size", "text_crc32", "shard", "slot")


def _slots(out: DataFrame, thin: DataFrame) -> DataFrame:
    """Number the rows of each shard: shards fall into SUBS parts by hash, whose counts give each part its first slot."""
    sub = F.pmod(F.xxhash64("doc_id", "group", "size"), F.lit(SUBS)).cast("int")
    counts = thin.withColumn("_sub", sub).groupBy("shard", "_sub").agg(F.count(F.lit(1)).alias("n"))
    first = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select("shard", "_sub", first.alias("_first"))
    place = Window.partitionBy("shard", "_sub").orderBy("doc_id", "group", "size")
    return out.withColumn("_sub", sub).join(firsts, ["shard", "_sub"]).withColumn("slot", F.col("_first") + F.row_number().over(place) - 1)
