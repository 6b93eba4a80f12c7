"""Integrity of tables: row digests and codecs, prefix-tree roots, a root over all tables, proofs, sparse and dense trees.

Digests are SHA-256 in lower-case hexadecimal. Trees are built level by level: nodes of one level are grouped by the prefix that
they share, so a level is one shuffle of what the level below left, and no node of width w gathers more than w children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.encoding import be, be64, from_be

ZERO = "00" * 32
DELETED = "__DELETED_NODE__"
KEY_BITS, KEY_LEVELS = 11, 6  # of state_root: six levels hold 64 bits


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def row_digest(key: Column, *fields: Column) -> Column:
    """Digest of a key and integer fields, all as big-endian 64-bit words."""
    return digest(be64(key), *(be64(f) for f in fields))


def pack(*fields: tuple[Column, int]) -> Column:
    """Fixed-width big-endian row."""
    return F.concat(*(be(c, w) for c, w in fields))


def unpack(row: Column, widths: list[int]) -> list[Column]:
    out, at = [], 1
    for w in widths:
        out.append(F.when(F.length(row) == sum(widths), from_be(row, at, w)))
        at += w
    return out


def leaves(store: DataFrame, width: int = 8) -> DataFrame:
    """tree, key (hexadecimal, width bytes), hash of a store's rows. An id that doesn't fit the width is an error."""
    if width < 8:
        fits = (F.col("id") >= 0) & (F.col("id") < F.lit(1 << 8 * width))
        store = store.withColumn("id", F.when(fits, F.col("id")).otherwise(F.raise_error(F.format_string(f"id %d needs more than {width} bytes", "id")).cast("bigint")))
    key = F.right(F.lpad(F.hex("id"), F.lit(16), F.lit("0")), F.lit(2 * width))
    value = F.coalesce(F.col("value").cast("binary"), F.lit("").cast("binary"))
    return store.select("tree", key.alias("key"), digest(be64(F.col("id")), value).alias("hash"))


def tombstones(rows: DataFrame, deleted: Column) -> DataFrame:
    """Leaves whose rows are deleted keep their place, with the digest of a marker."""
    return rows.withColumn("hash", F.when(deleted, F.sha2(F.lit(DELETED).cast("binary"), 256)).otherwise(F.col("hash")))


def _children(hash_first: str = "key") -> Column:
    """Children in order of their last byte, each as byte and digest."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.right(F.col("key"), F.lit(2)).alias("b"), "hash"))), lambda x: F.concat(x["b"], x["hash"])), "")


def node_level(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes of `depth` bytes of prefix from those of depth + 1."""
    return nodes.groupBy("tree", F.substring("key", 1, 2 * depth).alias("prefix")).agg(F.sha2(F.unhex(_children()), 256).alias("hash")).select("tree", F.col("prefix").alias("key"), "hash")


def tree_roots(store: DataFrame, width: int = 8) -> DataFrame:
    """tree, root. A tree of no rows isn't there; its root is 32 zero bytes by convention."""
    nodes = leaves(store, width)
    for depth in range(width - 1, -1, -1):
        nodes = node_level(nodes, depth)
    return nodes.select("tree", F.col("hash").alias("root"))


def all_nodes(store: DataFrame, width: int = 8) -> DataFrame:
    """tree, depth, key, hash of every node, for proofs and for recomputing what changed."""
    nodes = leaves(store, width)
    out = nodes.withColumn("depth", F.lit(width))
    for depth in range(width - 1, -1, -1):
        nodes = node_level(nodes, depth)
        out = out.unionByName(nodes.withColumn("depth", F.lit(depth)))
    return out


def update_nodes(nodes: DataFrame, changed: DataFrame, width: int = 8) -> DataFrame:
    """all_nodes after the leaves in `changed` (tree, key, hash; a null hash deletes): only nodes on changed paths are made again."""
    keep = nodes.filter(F.col("depth") == width).join(changed.select("tree", "key"), ["tree", "key"], "left_anti").select("tree", "key", "hash")
    level = keep.unionByName(changed.filter("hash is not null").select("tree", "key", "hash"))
    out = level.withColumn("depth", F.lit(width))
    touched = changed.select("tree", "key")
    for depth in range(width - 1, -1, -1):
        touched = touched.select("tree", F.substring("key", 1, 2 * depth).alias("key")).distinct()
        below = level.withColumn("_p", F.substring("key", 1, 2 * depth)).join(touched.withColumnRenamed("key", "_p"), ["tree", "_p"], "left_semi").drop("_p")
        same = nodes.filter(F.col("depth") == depth).join(touched, ["tree", "key"], "left_anti").select("tree", "key", "hash")
        level = same.unionByName(node_level(below, depth))
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
    return out


def _fold_once(level: Column) -> Column:
    pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: F.sha2(F.unhex(F.concat(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit(ZERO)))), 256))


def fold_levels(roots: DataFrame, most: int = 31) -> DataFrame:
    """One row with the levels of the binary fold over tables by name; one table passes through. There are few tables: a list, which
    can't have more than 2**31 entries, so `most` levels always reach one node.
    """
    out = roots.agg(F.array_sort(F.collect_list(F.struct("tree", "root"))).alias("t")).select(F.transform("t", lambda x: x["tree"]).alias("trees"), F.transform("t", lambda x: x["root"]).alias("l0"))
    levels = F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.array("l0"), lambda ls, _: F.when(F.size(F.element_at(ls, -1)) > 1, F.concat(ls, F.array(_fold_once(F.element_at(ls, -1))))).otherwise(ls))
    return out.select("trees", levels.alias("levels"))


def global_root(roots: DataFrame) -> DataFrame:
    top = F.element_at(F.element_at("levels", -1), 1)
    return fold_levels(roots).select(F.when(F.size("trees") == 0, F.lit(ZERO)).otherwise(top).alias("global_root"))


def proofs(roots: DataFrame) -> DataFrame:
    """tree, root, path: for each level the sibling and whether it is on the left."""
    f = fold_levels(roots)
    rows = f.select("levels", F.posexplode("trees").alias("pos", "tree"))
    sibling = lambda i: F.struct(F.coalesce(F.get(F.get(F.col("levels"), i), F.call_function("shiftright", F.col("pos"), i).bitwiseXOR(F.lit(1))), F.lit(ZERO)).alias("sibling"), (F.call_function("shiftright", F.col("pos"), i).bitwiseAND(F.lit(1)) == 1).alias("left"))
    steps = F.when(F.size("levels") > 1, F.transform(F.sequence(F.lit(0), F.size("levels") - 2), sibling)).otherwise(F.array().cast("array<struct<sibling:string,left:boolean>>"))
    return rows.select("tree", F.get(F.get("levels", F.lit(0)), F.col("pos")).alias("root"), steps.alias("path"))


def verify_path(leaf: Column, path: Column, root: Column) -> Column:
    """Whether folding a leaf with its siblings gives the root."""
    step = lambda h, s: F.sha2(F.unhex(F.when(s["left"], F.concat(s["sibling"], h)).otherwise(F.concat(h, s["sibling"]))), 256)
    return F.aggregate(path, leaf, step) == root


def state_root(rows: DataFrame, key: str, value: Column, deleted: Column) -> DataFrame:
    """Digest of sorted (key, digest) pairs, deleted ones as the bytes DE AD, in levels: keys that share all but their last KEY_BITS
    bits make a node, whose key is the rest, and so on up to one node. No node gathers more than 2**KEY_BITS children.
    """
    h = F.when(deleted, F.lit("DEAD")).otherwise(F.sha2(value.cast("string").cast("binary"), 256))
    level = rows.select(F.col(key).alias("k"), h.alias("h"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: F.concat(F.lpad(F.hex(x["k"]), F.lit(16), F.lit("0")), x["h"])), "")
    for _ in range(KEY_LEVELS):
        level = level.groupBy(F.shiftrightunsigned("k", KEY_BITS).alias("p")).agg(F.sha2(F.unhex(ordered), 256).alias("h")).select(F.col("p").alias("k"), "h")
    return level.select(F.col("h").alias("state_root"))


def sparse_tree(keyed: DataFrame, depth: int = 8) -> DataFrame:
    """Root of a 256-ary sparse tree of (key, value): key hexadecimal digests, value binary.

    Leaf H(1, key, value); inner H(0, bitmap of children, child digests); a subtree of one leaf is that leaf. Keys are told apart by
    their first `depth` bytes, which hold for digests; leaves that share them hang below one node in order.
    """
    nodes = keyed.select(F.substring("key", 1, 2 * depth).alias("key"), F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex("key"), F.col("value")), 256).alias("hash"), F.lit(1).alias("leaf"))
    for d in range(depth - 1, -1, -1):
        one = F.struct(F.conv(F.right("key", F.lit(2)), 16, 10).cast("int").alias("b"), "hash")
        groups = nodes.groupBy(F.substring("key", 1, 2 * d).alias("p")).agg(F.array_sort(F.collect_list(one)).alias("c"), F.count(F.lit(1)).alias("n"), F.min("leaf").alias("leaf"))
        bitmap = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.lpad(F.hex(F.aggregate(F.filter("c", lambda x: F.floor(x["b"] / 8) == i), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), 7 - x["b"] % 8)))), 2, "0")), "")
        inner = F.sha2(F.unhex(F.concat(F.lit("00"), bitmap, F.array_join(F.transform("c", lambda x: x["hash"]), ""))), 256)
        nodes = groups.select(F.col("p").alias("key"), F.when((F.col("n") == 1) & (F.col("leaf") == 1), F.col("c")[0]["hash"]).otherwise(inner).alias("hash"), F.when((F.col("n") == 1) & (F.col("leaf") == 1), 1).otherwise(0).alias("leaf"))
    return nodes.select(F.col("hash").alias("root"))


def dense_nodes(keyed: DataFrame, depth: int = 8, width: int = 128) -> DataFrame:
    """level, path, hash of every node of a dense tree: a node hashes `width` child digests, zeros where there is none.

    The path of a key takes byte & (width - 1) of its first `depth` bytes; rows of one path are folded in order of their keys.
    """
    step = lambda i: F.lpad(F.hex(F.conv(F.substring("key", 2 * i + 1, 2), 16, 10).cast("bigint").bitwiseAND(F.lit(width - 1))), 2, "0")
    leaf = F.sha2(F.concat(F.unhex("key"), F.col("value")), 256)
    rows = keyed.select("key", F.concat(*(step(i) for i in range(depth))).alias("path"), leaf.alias("h"))
    order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "h"))), lambda x: x["h"]), "")
    level = rows.groupBy("path").agg(F.sha2(F.unhex(order), 256).alias("hash"))
    out = level.withColumn("level", F.lit(depth))
    for d in range(depth - 1, -1, -1):
        child = F.map_from_entries(F.collect_list(F.struct(F.conv(F.right("path", F.lit(2)), 16, 10).cast("int"), "hash")))
        filled = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(ZERO))), "")
        level = level.groupBy(F.substring("path", 1, 2 * d).alias("p")).agg(child.alias("m")).select(F.col("p").alias("path"), F.sha2(F.unhex(filled), 256).alias("hash"))
        out = out.unionByName(level.withColumn("level", F.lit(d)))
    return out


def bundle_proof(nodes: DataFrame, paths: DataFrame, depth: int = 8) -> DataFrame:
    """The distinct nodes that a proof of several paths needs: each path's nodes and their siblings, once."""
    steps = paths.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: F.struct((i + 1).alias("level"), F.substring(F.col("path"), F.lit(1), 2 * i).alias("parent")))).alias("s")).select("s.*").distinct()
    return nodes.withColumn("parent", F.expr("left(path, greatest(length(path) - 2, 0))")).join(steps, ["level", "parent"], "left_semi").drop("parent")


def verify_bundle(bundle: DataFrame, paths: DataFrame, root: str, depth: int = 8, width: int = 128) -> DataFrame:
    """One row: n_paths and valid, whether the bundle's nodes (level, path, hash) lead from every path's leaf to the root.

    Every node above a leaf must hash its `width` children, zeros where the bundle has none, and every path must have its leaf.
    """
    child = F.map_from_entries(F.collect_list(F.struct(F.conv(F.right("path", F.lit(2)), 16, 10).cast("int"), "hash")))
    filled = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(ZERO))), "")
    parent = F.expr("left(path, greatest(length(path) - 2, 0))")
    made = bundle.filter("level > 0").groupBy((F.col("level") - 1).alias("level"), parent.alias("path")).agg(child.alias("m")).select("level", "path", F.sha2(F.unhex(filled), 256).alias("made"))
    top = bundle.sparkSession.createDataFrame([(0, "", root)], "level int, path string, hash string")
    known = bundle.filter("level > 0").select("level", "path", "hash").unionByName(top)
    wrong = made.join(known, ["level", "path"], "left").filter(~F.col("made").eqNullSafe(F.col("hash"))).agg(F.count(F.lit(1)).alias("wrong"))
    asked = paths.select("path").distinct().join(bundle.filter(F.col("level") == depth).select("path", F.lit(True).alias("there")), "path", "left")
    counts = asked.agg(F.count(F.lit(1)).alias("n_paths"), F.count_if(F.col("there").isNull()).alias("missing"))
    return counts.crossJoin(wrong).select("n_paths", ((F.col("wrong") == 0) & (F.col("missing") == 0)).alias("valid"))


def sibling_ranks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("rank", F.row_number().over(Window.partitionBy("tree", "depth").orderBy("key")))
