"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

Every source is cut into blocks by a hash of its documents, which is also their random permutation. A source's target is met by
whole passes over its blocks and one last pass that stops at a boundary block; within that block documents follow in hash order,
and the one at the boundary is taken in part, so that each source gives its rounded target exactly. The (source, pass, block)
draws are dealt to output shards by a tree: the root holds the exact block quotas of all sources, and each node gives its left
child a multivariate-hypergeometric draw of them. Shards take consecutive, so disjoint, draws of every source; rows of a shard
are in hash order.

Nulls: a null text has no words, a null source is a source of its own and the last one, null ids hash like any value. Documents
without words are never taken. A text of any length is one document; only the one at a source's boundary is cut. Documents of one
hash follow in order of id and size. Repeated rows share what is taken of them evenly. Empty tables give empty results. Extra columns
pass through, whatever their names, but for those that the mix adds, which it replaces. All sources' quotas make one row of the tree:
sources are to be counted in millions at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.kit import materialize, n_words, seed_hash, unit

MOST_SOURCES_TO_BROADCAST = 10_000


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per source: source_key, source, source_size, target. Shares above the cap are dealt again by weight.

    The cap binds for the sources with the least cap / weight, so the level at which the rest stop comes from sums over that order.
    """
    src = sized.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    src = src.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    src = src.withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    src = src.withColumn("level", level)
    # The first source, in this order, that isn't capped at its own level sets the level of all after it.
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)
    return src.withColumn("level", free["level"]).withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap"))).drop("level", "cap")


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """The number of marked items among those drawn without replacement, from one uniform number.

    Weights come from ratios of neighbouring probabilities, outward from the mode and as far as 12 deviations, so nothing overflows.
    """
    n, k, d = (x.cast("double") for x in (total, marked, drawn))
    low, high = F.greatest(F.lit(0), drawn - (total - marked)), F.least(drawn, marked)
    mode = F.least(high, F.greatest(low, F.floor((d + 1) * (k + 1) / (n + 2))))
    share = k / F.greatest(n, F.lit(1.0))
    reach = (F.lit(12) * F.sqrt(F.greatest(F.lit(0.0), d * share * (1 - share) * (n - d) / F.greatest(n - 1, F.lit(1.0)))) + 8).cast("bigint")
    bottom, top = F.greatest(low, mode - reach), F.least(high, mode + reach)

    def walk(start: dict[str, Column], steps: Column, ratio, at, r: Column | None) -> Column:
        def step(s: Column, i: Column) -> Column:
            w = s["w"] * ratio(i)
            sum_ = s["sum"] + w
            return F.struct(w.alias("w"), sum_.alias("sum"), (F.coalesce(s["pick"], F.when(sum_ > r, at(i))) if r is not None else s["pick"]).alias("pick"))

        return F.aggregate(steps, F.struct(*(v.alias(name) for name, v in start.items())), step)

    none = F.lit(None).cast("bigint")
    up = F.when(top > mode, F.sequence(mode, top - 1)).otherwise(F.array().cast("array<bigint>"))
    down = F.when(mode > bottom, F.sequence(F.lit(0).cast("bigint"), mode - bottom - 1)).otherwise(F.array().cast("array<bigint>"))
    more = lambda i: (k - i) * (d - i) / ((i + 1) * (n - k - d + i + 1))  # noqa: E731  from i to i + 1
    less = lambda i: (mode - i) * (n - k - d + mode - i) / ((k - mode + i + 1) * (d - mode + i + 1))  # noqa: E731  from mode - i to mode - i - 1
    begin = lambda s: {"w": F.lit(1.0), "sum": s, "pick": none}
    above = walk(begin(F.lit(1.0)), up, more, lambda i: i + 1, None)["sum"]
    whole = walk(begin(above), down, less, lambda i: mode - i - 1, None)["sum"]
    r = u * whole
    picked = F.coalesce(walk(begin(F.lit(1.0)), up, more, lambda i: i + 1, r)["pick"], walk(begin(above), down, less, lambda i: mode - i - 1, r)["pick"])
    return F.when(r < 1, mode).otherwise(F.coalesce(picked, mode))


def split_quotas(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """quotas: source_key, quota. Returns source_key, shard, blocks for 2**depth shards whose totals differ by one at most."""
    tree = quotas.agg(F.array_sort(F.collect_list(F.struct("source_key", F.col("quota").cast("bigint").alias("quota")))).alias("q")).select(F.lit(0).alias("node"), "q")
    for level in range(depth):
        total = F.aggregate("q", F.lit(0).cast("bigint"), lambda a, x: a + x["quota"])
        tree = tree.withColumn("total", total).withColumn("left", F.ceil(F.col("total") / 2).cast("bigint"))
        start = F.struct(F.col("total").alias("n"), F.col("left").alias("d"), F.array().cast("array<bigint>").alias("out"))
        salt = [F.lit(seed), F.lit(level), F.col("node")]

        def draw(s: Column, x: Column) -> Column:
            u = unit(F.xxhash64(*salt, x["source_key"]))  # noqa: B023
            got = hypergeometric(s["n"], x["quota"], s["d"], u).cast("bigint")
            return F.struct((s["n"] - x["quota"]).alias("n"), (s["d"] - got).alias("d"), F.concat(s["out"], F.array(got)).alias("out"))

        # As a column of its own, so that the draw is made once and both children see the same one.
        tree = materialize(tree.select("node", "q", F.aggregate("q", start, draw)["out"].alias("got")))
        side = lambda right: F.zip_with("q", "got", lambda x, g: F.struct(x["source_key"].alias("source_key"), ((x["quota"] - g) if right else g).alias("quota")))
        tree = tree.select(F.explode(F.array(*(F.struct((F.col("node") * 2 + right).alias("node"), side(right).alias("q")) for right in (0, 1)))).alias("c")).select("c.*")
    return tree.select(F.col("node").alias("shard"), F.explode("q").alias("x")).select("x.source_key", "shard", F.col("x.quota").alias("blocks"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, depth: int = 4, block_words: int = 8_192, most_blocks: int = 65_536, seed: int = 20_240_501, size_column: str | None = None) -> DataFrame:
    """size_column: a column that has the number of words already; else they are counted.

    The documents' rows with size, source_size, target, passes (whole copies), part (words of one more, shorter copy), taken
    and shards (the output shard of each copy, whole ones first). Columns of that name in docs are replaced.
    """
    own = ["size", "source_size", "target", "passes", "part", "taken", "shards"]
    size = F.col(size_column) if size_column else n_words(F.col("text"))
    # Other names while mixing, so that no column of docs clashes with the mix's own.
    kept = {c: f"_mo_{i}" for i, c in enumerate(docs.columns) if c not in own}
    docs = docs.select(*(F.col(c).alias(n) for c, n in kept.items()), "doc_id", "source", size.alias("_mx_size"))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    add = lambda d: d.withColumn("_mx_key", key).withColumn("_mx_h", seed_hash(seed, F.col("doc_id"), F.col("_mx_size")))
    sized = materialize(add(docs).select("doc_id", "source", F.col("_mx_key").alias("source_key"), F.col("_mx_size").alias("size"), F.col("_mx_h").alias("h")))
    targets = source_targets(sized, weights, most)
    blocks = F.least(F.lit(most_blocks), F.ceil(F.col("source_size") / block_words)).cast("bigint")
    quota = F.least(F.round("target").cast("bigint"), F.col("source_size") * most)
    src = targets.withColumn("n_blocks", F.greatest(F.lit(1), blocks)).withColumn("quota", quota)
    src = src.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0).cast("bigint"))
    src = materialize(src.withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size")))
    few = src.count() <= MOST_SOURCES_TO_BROADCAST
    hint = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    block = F.pmod(F.shiftrightunsigned("h", 16), F.col("n_blocks")).alias("block")

    placed = sized.filter("size > 0").join(hint(src.select("source_key", "n_blocks", "rest")), "source_key").select("source_key", "rest", block, "doc_id", "size", "h")
    sums = placed.groupBy("source_key", "rest", "block").agg(F.sum("size").alias("words"))
    until = F.coalesce(F.sum("words").over(Window.partitionBy("source_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The boundary block holds the last word of the last pass; blocks before it go whole.
    edge = materialize(sums.withColumn("before", until).filter("before < rest").groupBy("source_key", "rest").agg(F.max("block").alias("edge"), F.max("before").alias("before")))
    near = sized.filter("size > 0").join(hint(src.select("source_key", "n_blocks")), "source_key").withColumn("block", block).join(hint(edge), "source_key").filter("block = edge")
    alike = near.groupBy("source_key", "rest", "before", "h", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))
    ahead = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(Window.partitionBy("source_key").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.col("rest") - F.col("before") - ahead
    parts = alike.withColumn("edge_part", F.least("size", F.greatest(F.lit(0), F.floor(left / F.col("copies")))).cast("bigint")).filter("edge_part > 0")
    parts = materialize(parts.select(F.col("source_key").alias("_mx_key"), F.col("doc_id").alias("_mx_doc"), F.col("size").alias("_mx_n"), F.col("edge_part").alias("_mx_part")))

    drawn = src.join(edge.select("source_key", "edge"), "source_key", "left").withColumn("quota", F.when(F.col("source_size") > 0, F.col("passes") * F.col("n_blocks")).otherwise(0) + F.coalesce(F.col("edge") + 1, F.lit(0)))
    split = split_quotas(drawn.select("source_key", "quota"), depth, seed)
    ends = F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"])
    cuts = split.withColumn("end", F.sum("blocks").over(Window.partitionBy("source_key").orderBy("shard"))).groupBy("source_key").agg(ends.alias("cuts"))
    plan = materialize(drawn.join(cuts, "source_key", "left").select(F.col("source_key").alias("_mx_key"), "source_size", "target", F.col("passes").alias("_mx_passes"), F.col("n_blocks").alias("_mx_blocks"), F.col("edge").alias("_mx_edge"), F.col("cuts").alias("_mx_cuts")))

    out = add(docs).join(hint(plan), "_mx_key").withColumn("_mx_block", F.pmod(F.shiftrightunsigned("_mx_h", 16), F.col("_mx_blocks")))
    # Only documents of boundary blocks can have a part: there are a few blocks' worth of them, one block for each source.
    at_edge = parts.count() <= 1_000_000
    out = out.join(F.broadcast(parts) if at_edge else parts, [out["_mx_key"] == parts["_mx_key"], out["doc_id"].eqNullSafe(parts["_mx_doc"]), out["_mx_size"] == parts["_mx_n"], out["_mx_block"] == out["_mx_edge"]], "left").drop(parts["_mx_key"])
    part = F.when(F.col("_mx_size") == 0, 0).when(F.col("_mx_block") < F.col("_mx_edge"), F.col("_mx_size")).when(F.col("_mx_block") == F.col("_mx_edge"), F.coalesce("_mx_part", F.lit(0))).otherwise(0).cast("bigint")
    passes = F.when(F.col("_mx_size") > 0, F.col("_mx_passes")).otherwise(0).cast("int")
    out = out.withColumn("passes", passes).withColumn("part", part).withColumn("taken", F.col("passes") * F.col("_mx_size") + F.col("part"))
    copies = F.col("passes") + (F.col("part") > 0).cast("int")
    shard = lambda e: F.size(F.filter("_mx_cuts", lambda c: c <= e * F.col("_mx_blocks") + F.col("_mx_block")))
    shards = F.when(copies > 0, F.transform(F.sequence(F.lit(0), copies - 1), shard)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("shards", shards).withColumn("size", F.col("_mx_size"))
    return out.select(*(F.col(n).alias(c) for c, n in kept.items()), *own)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' columns once for each copy, with text cut after `part` words in a partial copy, plus mix_shard and
    mix_key, by which rows of a shard are in random order. n_chars, where docs have it, follows the text.
    """
    docs = docs.drop("mix_shard", "mix_key")
    # Other names while mixing, so that no column of docs clashes with the mix's own.
    own = {c: f"_mr_{i}" for i, c in enumerate(docs.columns)}
    mixed = mix(docs.select(*(F.col(c).alias(n) for c, n in own.items()), *(F.col(c) for c in ("doc_id", "text", "source"))), **options)
    copy = mixed.select("*", F.posexplode("shards").alias("_mr_copy", "mix_shard"))
    partial = (F.col("_mr_copy") >= F.col("passes")) & (F.col("part") < F.col("size"))
    # A text splits after each word, separators leading the next; leading separators stay with the first word.
    words = F.split(F.col("text"), "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])")
    text = F.when(partial, F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), "")).otherwise(F.col("text"))
    copy = copy.withColumn("text", text).withColumn("mix_key", F.xxhash64(F.lit(1), "doc_id", "_mr_copy", "mix_shard"))
    value = {c: F.col(n) for c, n in own.items()} | {"text": F.col("text")}
    if "n_chars" in own:
        value["n_chars"] = F.when(partial, F.length("text")).otherwise(F.col(own["n_chars"])).cast(dict(docs.dtypes)["n_chars"])
    return copy.select(*(v.alias(c) for c, v in value.items()), "mix_shard", "mix_key")
