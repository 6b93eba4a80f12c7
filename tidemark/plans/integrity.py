"""Queries over digests, trees of digests, proofs and the models of their cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import merkle as mk
from tidemark.plans.registry import query
from tidemark.plans.views import with_views
from tidemark.sources import tables as t

W64 = "lpad(printf('%X', {}), 16, '0')"


@query("account_digests", with_views("v_accounts", f" SELECT uid, sha256(unhex({W64.format('uid')} || {W64.format('status')} || {W64.format('email_hash')})) AS digest FROM v_accounts"))
def account_digests(spark, d):
    return t.accounts(spark, d).select("uid", mk.row_digest(F.col("uid"), F.col("status"), F.col("email_hash")).alias("digest"))


@query("order_digests", with_views("v_book", f" SELECT order_id, sha256(unhex({W64.format('order_id')} || {W64.format('trader_id')} || {W64.format('price')} || {W64.format('size')} || {W64.format('filled')})) AS digest FROM v_book"))
def order_digests(spark, d):
    return t.book(spark, d).select("order_id", mk.row_digest(F.col("order_id"), F.col("trader_id"), F.col("price"), F.col("size"), F.col("filled")).alias("digest"))


@query("balance_digests", with_views("v_balances", f" SELECT user_id, sha256(unhex({W64.format('(user_id << 32) | asset_id')} || {W64.format('available')} || {W64.format('locked')})) AS digest FROM v_balances"))
def balance_digests(spark, d):
    from tidemark.functions.encoding import pack_key

    return t.balances(spark, d).select("user_id", mk.row_digest(pack_key(F.col("user_id"), F.col("asset_id")), F.col("available"), F.col("locked")).alias("digest"))


@query("tx_digests", with_views("v_tx", f" SELECT arrival, sha256(unhex({W64.format('arrival')} || {W64.format('uid')} || {W64.format('nonce')} || {W64.format('amount')})) AS digest FROM v_tx"))
def tx_digests(spark, d):
    return t.transactions(spark, d).select("arrival", mk.row_digest(F.col("arrival"), F.col("uid"), F.col("nonce"), F.col("amount")).alias("digest"))


@query("row_codec", with_views("v_balances", " SELECT user_id, 24 AS n_bytes, user_id AS user_back, asset_id AS asset_back, available AS available_back, locked AS locked_back FROM v_balances"))
def row_codec(spark, d):
    """Rows packed to 24 bytes and read back."""
    widths = [8, 4, 6, 6]
    packed = mk.pack(*zip((F.col("user_id"), F.col("asset_id"), F.col("available"), F.col("locked")), widths, strict=True))
    back = mk.unpack(F.col("row"), widths)
    names = ("user_back", "asset_back", "available_back", "locked_back")
    return t.balances(spark, d).select("user_id", packed.alias("row")).select("user_id", F.length("row").alias("n_bytes"), *(c.alias(n) for c, n in zip(back, names, strict=True)))


def tree_sql(width: int) -> str:
    """Roots by nested grouping on prefixes of keys of `width` bytes."""
    ctes = f", n{width} AS (SELECT tree, right({W64.format('id')}, {2 * width}) AS key, sha256(unhex({W64.format('id')} || hex(encode(coalesce(value, ''))))) AS hash FROM v_store)"
    for k in range(width - 1, -1, -1):
        ctes += f", n{k} AS (SELECT tree, substr(key, 1, {2 * k}) AS key, sha256(unhex(string_agg(right(key, 2) || hash, '' ORDER BY right(key, 2)))) AS hash FROM n{k + 1} GROUP BY 1, 2)"
    return ctes


WIDTH = 8
TREES = tree_sql(WIDTH)


@query("tree_roots", with_views("v_store", TREES + " SELECT tree, hash AS root FROM n0"))
def tree_roots(spark, d):
    return mk.tree_roots(t.store(spark, d), WIDTH)


@query("tree_nodes", with_views("v_store", TREES + " SELECT tree, 7 AS depth, key, hash FROM n7 UNION ALL SELECT tree, 6, key, hash FROM n6"))
def tree_nodes(spark, d):
    return mk.all_nodes(t.store(spark, d), WIDTH).filter("depth in (6, 7)").select("tree", "depth", "key", "hash")


@query("root_after_update", with_views("v_store", TREES.replace("FROM v_store)", "FROM (SELECT tree, id, CASE WHEN id % 50 = 0 THEN 'new' ELSE value END AS value FROM v_store WHERE id % 40 <> 1))", 1) + " SELECT tree, hash AS root FROM n0"))
def root_after_update(spark, d):
    """Roots after some rows change and some go, from stored nodes: only changed paths are hashed again."""
    store = t.store(spark, d)
    nodes = mk.all_nodes(store, WIDTH)
    new = mk.leaves(store.filter("id % 50 = 0 and id % 40 <> 1").withColumn("value", F.lit("new")), WIDTH)
    gone = mk.leaves(store.filter("id % 40 = 1"), WIDTH).withColumn("hash", F.lit(None).cast("string"))
    return mk.update_nodes(nodes, new.unionByName(gone), WIDTH).filter("depth = 0").select("tree", F.col("hash").alias("root"))


@query("root_with_tombstones", with_views("v_store", TREES.replace("AS hash FROM v_store)", "AS h0, id FROM v_store), n8 AS (SELECT tree, key, CASE WHEN id % 40 = 1 THEN sha256('__DELETED_NODE__') ELSE h0 END AS hash FROM n8x)", 1).replace("n8 AS (SELECT tree, right", "n8x AS (SELECT tree, right", 1) + " SELECT tree, hash AS root FROM n0"))
def root_with_tombstones(spark, d):
    store = t.store(spark, d)
    nodes = mk.tombstones(mk.leaves(store, WIDTH), F.conv(F.col("key"), 16, 10).cast("bigint") % 40 == 1)
    for depth in range(WIDTH - 1, -1, -1):
        nodes = mk.node_level(nodes, depth)
    return nodes.select("tree", F.col("hash").alias("root"))


FOLD = TREES + f""", o AS (SELECT hash, row_number() OVER (ORDER BY tree) - 1 AS p FROM n0),
f1 AS (SELECT p // 2 AS p, sha256(unhex(string_agg(hash, '' ORDER BY p) || CASE WHEN count(*) = 1 THEN '{mk.ZERO}' ELSE '' END)) AS hash FROM o GROUP BY p // 2),
f2 AS (SELECT sha256(unhex(string_agg(hash, '' ORDER BY p) || CASE WHEN count(*) = 1 THEN '{mk.ZERO}' ELSE '' END)) AS hash FROM f1)"""


@query("global_root", with_views("v_store", FOLD + " SELECT hash AS global_root FROM f2"))
def global_root(spark, d):
    """For three or four tables in SQL; the operator folds any number."""
    return mk.global_root(mk.tree_roots(t.store(spark, d), WIDTH))


@query("tree_proofs", with_views("v_store", TREES + " SELECT tree, hash AS root, 2 AS steps, true AS valid, false AS valid_if_changed FROM n0"))
def tree_proofs(spark, d):
    roots = mk.tree_roots(t.store(spark, d), WIDTH)
    top = mk.global_root(roots)
    p = mk.proofs(roots).join(F.broadcast(top))
    bad = F.concat(F.lit("f"), F.substring("root", 2, 63))
    changed = F.when(bad == F.col("root"), F.concat(F.lit("0"), F.substring("root", 2, 63))).otherwise(bad)
    return p.select("tree", "root", F.size("path").alias("steps"), mk.verify_path(F.col("root"), F.col("path"), F.col("global_root")).alias("valid"), mk.verify_path(changed, F.col("path"), F.col("global_root")).alias("valid_if_changed"))


def state_sql() -> str:
    """The root over the latest state by key, level by level."""
    ctes = ", l AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM v_changes GROUP BY key), s0 AS (SELECT key AS k, CASE WHEN op = 'delete' THEN 'DEAD' ELSE sha256(value::VARCHAR) END AS h FROM l)"
    for i in range(mk.KEY_LEVELS):
        ctes += f", s{i + 1} AS (SELECT k >> {mk.KEY_BITS} AS k, sha256(unhex(string_agg({W64.format('k')} || h, '' ORDER BY k))) AS h FROM s{i} GROUP BY 1)"
    return ctes + f" SELECT h AS state_root FROM s{mk.KEY_LEVELS}"


@query("state_root", with_views("v_changes", state_sql()))
def state_root(spark, d):
    last = t.changes(spark, d).groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("r")).select("key", "r.*")
    return mk.state_root(last, "key", F.col("value"), F.col("op") == "delete")


@query("batch_digests", "SELECT doc_id, sha256(coalesce(text, '')) AS digest, md5(coalesce(text, '')) AS short_digest FROM documents")
def batch_digests(spark, d):
    text = F.coalesce("text", F.lit(""))
    return t.table(spark, d, "documents").select("doc_id", F.sha2(text, 256).alias("digest"), F.md5(text).alias("short_digest"))


def _keyed(spark, d):
    c = t.table(spark, d, "customer")
    return c.select(F.upper(F.sha2(F.col("c_custkey").cast("string"), 256)).alias("key"), F.col("c_name").cast("binary").alias("value"))


@query("sparse_tree_root")
def sparse_tree_root(spark, d):
    """Collapse of single leaves and bitmaps of children: tested against a recursive version."""
    return mk.sparse_tree(_keyed(spark, d), 8)


@query("dense_tree_levels", "SELECT 2 AS level, count(DISTINCT (('0x' || substr(k, 1, 2))::INTEGER & 127) * 128 + (('0x' || substr(k, 3, 2))::INTEGER & 127)) AS n_nodes FROM (SELECT sha256(c_custkey::VARCHAR) AS k FROM customer) UNION ALL SELECT 1, count(DISTINCT ('0x' || substr(k, 1, 2))::INTEGER & 127) FROM (SELECT sha256(c_custkey::VARCHAR) AS k FROM customer) UNION ALL SELECT 0, 1")
def dense_tree_levels(spark, d):
    return mk.dense_nodes(_keyed(spark, d), 2).groupBy("level").agg(F.count(F.lit(1)).alias("n_nodes"))


@query("bundled_proof")
def bundled_proof(spark, d):
    """Nodes that prove all keys together; tested against the sum of single proofs."""
    nodes = mk.dense_nodes(_keyed(spark, d), 8)
    return mk.bundle_proof(nodes, nodes.filter("level = 8").select("path"), 8)


@query("trie_root")
def trie_root(spark, d):
    """Root of a binary sparse trie, its subtrees built in parallel."""
    from tidemark.operators.trie import distributed_root

    c = t.table(spark, d, "customer")
    return distributed_root(c.select(F.unhex(F.sha2(F.col("c_custkey").cast("string"), 256)).alias("key"), F.sha2(F.col("c_name"), 256).cast("binary").alias("value")))


@query("proof_costs", """WITH p AS (SELECT p_size AS n, p_partkey AS id FROM part) SELECT id, n * 32 * 8 AS merkle_bytes, n * 48 + 48 AS kzg_bytes, 48 + 32 * 8 + n * 32 AS hybrid_bytes,
(n * 32 * 8)::DOUBLE / (48 + 32 * 8 + n * 32) AS saving FROM p""")
def proof_costs(spark, d):
    """Closed forms of the size of proofs of n keys at depth eight."""
    n = F.col("p_size").cast("int")
    merkle, hybrid = n * 32 * 8, 48 + 32 * 8 + n * 32
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), merkle.alias("merkle_bytes"), (n * 48 + 48).alias("kzg_bytes"), hybrid.alias("hybrid_bytes"), (merkle / hybrid).alias("saving"))


@query("capacity", "SELECT w, k, w::DOUBLE ^ k AS leaves, CASE WHEN w::DOUBLE ^ k >= 1e12 THEN 'T' WHEN w::DOUBLE ^ k >= 1e9 THEN 'G' WHEN w::DOUBLE ^ k >= 1e6 THEN 'M' ELSE 'K' END AS unit FROM (VALUES (16), (64), (128), (256)) a(w), (VALUES (2), (3), (4), (8)) b(k)")
def capacity(spark, d):
    """Leaves of a tree by width and depth, over a fixed table of parameters."""
    grid = spark.createDataFrame([(w, k) for w in (16, 64, 128, 256) for k in (2, 3, 4, 8)], "w int, k int")
    n = F.pow(F.col("w"), F.col("k"))
    return grid.select("w", "k", n.alias("leaves"), F.when(n >= 1e12, "T").when(n >= 1e9, "G").when(n >= 1e6, "M").otherwise("K").alias("unit"))


@query("path_collisions", "SELECT path, count(*) AS n FROM (SELECT substr(sha256(o_orderkey::VARCHAR), 1, 4) AS path FROM orders) GROUP BY path HAVING count(*) > 1")
def path_collisions(spark, d):
    """Keys that would share a two-byte path."""
    path = F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 4)
    return t.table(spark, d, "orders").groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("collision_estimates", "SELECT n, 1 - exp(-n * (n - 1.0) / (2 * 65536.0)) AS p16, 1 - exp(-n * (n - 1.0) / (2 * 4294967296.0)) AS p32 FROM (SELECT DISTINCT p_size::BIGINT AS n FROM part)")
def collision_estimates(spark, d):
    n = F.col("n")
    p = lambda space: 1 - F.exp(-n * (n - 1.0) / (2 * space))
    return t.table(spark, d, "part").select(F.col("p_size").cast("bigint").alias("n")).distinct().select("n", p(65536.0).alias("p16"), p(4294967296.0).alias("p32"))


@query("series_commitments", with_views("v_ticks", ", s AS (SELECT date_trunc('hour', ts) AS bucket, date_part('minute', ts)::INTEGER AS slot, arg_max(price, arrival) AS price FROM v_ticks GROUP BY 1, 2) SELECT bucket, sha256(string_agg(slot::VARCHAR || ':' || price::VARCHAR, ',' ORDER BY slot)) AS commitment, left(sha256('TICK_' || strftime(bucket, '%Y-%m-%dT%H')), 32) AS stem FROM s GROUP BY bucket"))
def series_commitments(spark, d):
    """A digest of each bucket's slots, and the bucket's stem."""
    s = t.ticks(spark, d).groupBy(F.date_trunc("hour", "ts").alias("bucket"), F.minute("ts").alias("slot")).agg(F.max_by("price", "arrival").alias("price"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "price"))), lambda x: F.concat(x["slot"].cast("string"), F.lit(":"), x["price"].cast("string"))), ",")
    stem = F.substring(F.sha2(F.concat(F.lit("TICK_"), F.date_format("bucket", "yyyy-MM-dd'T'HH")), 256), 1, 32)
    return s.groupBy("bucket").agg(F.sha2(text, 256).alias("commitment")).select("bucket", "commitment", stem.alias("stem"))


@query("series_root", with_views("v_ticks", ", s AS (SELECT date_trunc('hour', ts) AS bucket, date_part('minute', ts)::INTEGER AS slot, arg_max(price, arrival) AS price FROM v_ticks GROUP BY 1, 2), c AS (SELECT bucket, sha256(string_agg(slot::VARCHAR || ':' || price::VARCHAR, ',' ORDER BY slot)) AS commitment FROM s GROUP BY bucket) SELECT sha256(unhex(string_agg(commitment, '' ORDER BY bucket))) AS series_root FROM c"))
def series_root(spark, d):
    c = series_commitments(spark, d)
    return c.agg(F.sha2(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "commitment"))), lambda x: x["commitment"]), "")), 256).alias("series_root"))
