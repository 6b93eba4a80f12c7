"""Queries over keyed tables and change logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import encoding as enc
from tidemark.operators import keyed as kv
from tidemark.plans.registry import query
from tidemark.plans.views import with_views
from tidemark.sources import tables as t


def sql(body: str, views: str = "v_store") -> str:
    return with_views(views, body)


@query("scan_store", sql(" SELECT * FROM v_store"))
def scan_store(spark, d):
    return t.store(spark, d)


@query("scan_by_kind", "SELECT 'account' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'order', count(*) FROM orders UNION ALL SELECT 'trade', count(*) FROM lineitem")
def scan_by_kind(spark, d):
    """One key space with a kind, split by kind."""
    parts = [t.table(spark, d, n).select(F.lit(k).alias("kind")) for k, n in (("account", "customer"), ("order", "orders"), ("trade", "lineitem"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("get_by_id", sql(" SELECT * FROM v_store WHERE id = 77"))
def get_by_id(spark, d):
    return kv.get(t.store(spark, d), 77)


@query("get_from_tree", sql(" SELECT * FROM v_store WHERE id = 100 AND tree = 'de'"))
def get_from_tree(spark, d):
    return kv.get(t.store(spark, d), 100, "de")


@query("exists_ids", "SELECT o_orderkey AS id, o_orderkey IN (SELECT doc_id FROM documents) AS found FROM orders")
def exists_ids(spark, d):
    ids = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return kv.exists(t.store(spark, d), ids)


@query("get_multiple", "SELECT o_custkey AS pos, o_orderkey AS id, text AS value FROM orders LEFT JOIN documents ON doc_id = o_orderkey")
def get_multiple(spark, d):
    ids = t.table(spark, d, "orders").select(F.col("o_custkey").alias("pos"), F.col("o_orderkey").alias("id"))
    return kv.get_multiple(t.store(spark, d), ids)


for _a in (True, False):
    for _b in (True, False):
        _name = f"range_{'closed' if _a else 'open'}_{'closed' if _b else 'open'}"
        query(_name, sql(f" SELECT tree, id FROM v_store WHERE id {'>=' if _a else '>'} 50 AND id {'<=' if _b else '<'} 150"))(lambda spark, d, a=_a, b=_b: kv.range_query(t.store(spark, d), 50, 150, a, b).select("tree", "id").orderBy("id"))


@query("range_empty", sql(" SELECT tree, id FROM v_store WHERE id > 50 AND id < 50"))
def range_empty(spark, d):
    return kv.range_query(t.store(spark, d), 50, 50, False, False).select("tree", "id")


@query("cross_table_range", sql(", b(tree, lo, hi) AS (VALUES ('en', 10, 60), ('de', 100, 400), ('fr', 0, 1000), ('en', 500, 520)) SELECT v.tree, v.id, b.lo, b.hi FROM v_store v JOIN b ON b.tree = v.tree AND v.id >= b.lo AND v.id < b.hi"))
def cross_table_range(spark, d):
    bounds = spark.createDataFrame([("en", 10, 60), ("de", 100, 400), ("fr", 0, 1000), ("en", 500, 520)], "tree string, lo int, hi int")
    return kv.range_join(t.store(spark, d), bounds).select("tree", "id", "lo", "hi")


@query("trades_by_order", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey = 11 OR l_suppkey = 11")
def trades_by_order(spark, d):
    """Trades in which an id is on either side."""
    return t.table(spark, d, "lineitem").filter("l_partkey = 11 or l_suppkey = 11").select("l_orderkey", "l_partkey", "l_suppkey")


@query("trades_by_trader", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 5 OR o_orderkey = 5")
def trades_by_trader(spark, d):
    return t.table(spark, d, "orders").filter("o_custkey = 5 or o_orderkey = 5").select("o_orderkey", "o_custkey")


@query("nonempty_levels", with_views("v_book", " SELECT side, price, sum(remaining)::BIGINT AS volume FROM v_book GROUP BY side, price HAVING sum(remaining) > 0"))
def nonempty_levels(spark, d):
    return t.book(spark, d).groupBy("side", "price").agg(F.sum("remaining").alias("volume")).filter("volume > 0")


@query("order_predicates", with_views("v_book", " SELECT order_id, filled >= size AS is_filled, greatest(size - filled, 0)::BIGINT AS remaining_size FROM v_book"))
def order_predicates(spark, d):
    return t.book(spark, d).select("order_id", (F.col("filled") >= F.col("size")).alias("is_filled"), enc.saturating_sub(F.col("size"), F.col("filled")).alias("remaining_size"))


@query("balance_predicates", with_views("v_balances", " SELECT user_id, available + locked AS total, available >= 250000 AS can_withdraw FROM v_balances"))
def balance_predicates(spark, d):
    return t.balances(spark, d).select("user_id", (F.col("available") + F.col("locked")).alias("total"), (F.col("available") >= 250000).alias("can_withdraw"))


@query("composite_keys", with_views("v_balances", " SELECT user_id, asset_id, (user_id << 32) | asset_id AS id, ((user_id << 32) | asset_id) >> 32 AS user_back, ((user_id << 32) | asset_id) & 4294967295 AS asset_back FROM v_balances"))
def composite_keys(spark, d):
    key = enc.pack_key(F.col("user_id"), F.col("asset_id"))
    return t.balances(spark, d).select("user_id", "asset_id", key.alias("id")).withColumn("user_back", F.shiftright("id", 32)).withColumn("asset_back", F.col("id").bitwiseAND(F.lit(4294967295)))


@query("order_slots", with_views("v_book", " SELECT order_id, slot FROM v_book"))
def order_slots(spark, d):
    return t.book(spark, d).select("order_id", "slot")


@query("saturating_math", with_views("v_balances", " SELECT user_id, greatest(locked - available, 0)::BIGINT AS sub, CASE WHEN available > 100000 THEN 9223372036854775807 ELSE 9223372036854675807 + available END AS added FROM v_balances"))
def saturating_math(spark, d):
    b = t.balances(spark, d)
    return b.select("user_id", enc.saturating_sub(F.col("locked"), F.col("available")).alias("sub"), enc.saturating_add(F.lit(9223372036854675807), F.col("available")).alias("added"))


LATEST = ", l AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value, max(seq) AS seq FROM v_changes {} GROUP BY key)"


def _live(where: str = "") -> str:
    return LATEST.format(where) + " SELECT key, value, seq FROM l WHERE op <> 'delete'"


@query("latest_per_key", with_views("v_changes", _live()))
def latest_per_key(spark, d):
    return kv.latest(t.changes(spark, d))


@query("read_version", with_views("v_changes", _live("WHERE seq <= 3000")))
def read_version(spark, d):
    """The table as of a sequence number."""
    return kv.latest(t.changes(spark, d), 3000)


@query("revert_changes", with_views("v_changes", ", l AS (SELECT key, arg_max(op, seq) AS op, max(seq) AS seq FROM v_changes WHERE seq <= 5000 GROUP BY key) SELECT count(*) AS n_live, max(seq) AS last_seq FROM l WHERE op <> 'delete'"))
def revert_changes(spark, d):
    return kv.latest(t.changes(spark, d), 5000).agg(F.count(F.lit(1)).alias("n_live"), F.max("seq").alias("last_seq"))


@query("apply_changes", with_views("v_changes", _live()))
def apply_changes(spark, d):
    """A version and the changes after it make the latest state."""
    log = t.changes(spark, d)
    return kv.apply_changes(kv.latest(log, 4000), log.filter("seq > 4000"))


@query("staged_reads", with_views("v_changes", ", l AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM v_changes WHERE seq <= 4000 OR key % 2 = 0 GROUP BY key) SELECT key, value FROM l WHERE op <> 'delete'"))
def staged_reads(spark, d):
    """Reads see pending writes: here those of even keys."""
    log = t.changes(spark, d)
    return kv.apply_changes(kv.latest(log, 4000), log.filter("seq > 4000 and key % 2 = 0")).select("key", "value")


@query("version_diff", with_views("v_changes", LATEST.format("WHERE seq <= 3000") + ", o AS (SELECT key, value FROM l WHERE op <> 'delete'), m AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM v_changes GROUP BY key), n AS (SELECT key, value FROM m WHERE op <> 'delete') SELECT key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'deleted' ELSE 'modified' END AS change, o.value AS old_value, n.value AS new_value FROM o FULL JOIN n USING (key) WHERE o.key IS NULL OR n.key IS NULL OR o.value IS DISTINCT FROM n.value"))
def version_diff(spark, d):
    log = t.changes(spark, d)
    return kv.diff(kv.latest(log, 3000), kv.latest(log))


@query("delete_batch", sql(" SELECT tree, id FROM v_store WHERE id % 9 <> 0"))
def delete_batch(spark, d):
    s = t.store(spark, d)
    return s.join(s.filter("id % 9 = 0").select("id"), "id", "left_anti").select("tree", "id")


@query("reinsert_after_delete", with_views("v_changes", " SELECT a.key, max(a.seq) AS deleted_at, min(b.seq) AS back_at FROM v_changes a JOIN v_changes b ON a.key = b.key AND a.op = 'delete' AND b.op = 'upsert' AND b.seq > a.seq AND a.seq < 2000 AND b.seq >= 2000 GROUP BY a.key"))
def reinsert_after_delete(spark, d):
    """Keys deleted before a point and written after it."""
    log = t.changes(spark, d)
    gone = log.filter("op = 'delete' and seq < 2000").groupBy("key").agg(F.max("seq").alias("deleted_at"))
    return gone.join(log.filter("op = 'upsert' and seq >= 2000").groupBy("key").agg(F.min("seq").alias("back_at")), "key")


@query("min_max_key", sql(" SELECT min(id) AS min_id, max(id) AS max_id, arg_min(tree, id) AS min_tree, arg_max(tree, id) AS max_tree FROM v_store"))
def min_max_key(spark, d):
    return t.store(spark, d).agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.min_by("tree", "id").alias("min_tree"), F.max_by("tree", "id").alias("max_tree"))


@query("min_max_per_tree", sql(" SELECT tree, min(id) AS min_id, max(id) AS max_id FROM v_store GROUP BY tree"))
def min_max_per_tree(spark, d):
    return t.store(spark, d).groupBy("tree").agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"))


@query("top_max", sql(" SELECT tree, id FROM v_store ORDER BY id DESC LIMIT 25"))
def top_max(spark, d):
    return kv.top(t.store(spark, d).select("tree", "id"), 25, True)


@query("top_min", sql(" SELECT tree, id FROM v_store ORDER BY id LIMIT 25"))
def top_min(spark, d):
    return kv.top(t.store(spark, d).select("tree", "id"), 25, False)


@query("top_per_tree", sql(" SELECT tree, id, k::INTEGER AS k FROM (SELECT tree, id, row_number() OVER (PARTITION BY tree ORDER BY id DESC) AS k FROM v_store) WHERE k <= 5"))
def top_per_tree(spark, d):
    return kv.top_per_tree(t.store(spark, d).select("tree", "id"), 5)


@query("take_while", with_views("v_changes", " SELECT seq, key FROM v_changes WHERE seq < (SELECT min(seq) FROM v_changes WHERE value > 15000)"))
def take_while(spark, d):
    return kv.take_while(t.changes(spark, d), "seq", F.col("value") <= 15000).select("seq", "key")


@query("keys_descending", sql(" SELECT id FROM v_store ORDER BY id DESC"))
def keys_descending(spark, d):
    return t.store(spark, d).select("id").orderBy(F.desc("id"))


@query("tables_by_name", sql(" SELECT tree, row_number() OVER (ORDER BY tree)::INTEGER AS pos FROM (SELECT DISTINCT tree FROM v_store)"))
def tables_by_name(spark, d):
    from pyspark.sql import Window

    return t.store(spark, d).select("tree").distinct().withColumn("pos", F.row_number().over(Window.orderBy("tree")))


@query("store_stats", sql(" SELECT coalesce(tree, 'ALL') AS tree, count(*) AS n_items, sum(strlen(value))::BIGINT AS n_bytes, min(id) AS min_id, max(id) AS max_id FROM v_store GROUP BY ROLLUP (tree)"))
def store_stats(spark, d):
    return kv.tree_stats(t.store(spark, d))


@query("live_and_deleted", with_views("v_changes", LATEST.format("") + " SELECT count(*) FILTER (op <> 'delete') AS n_live, count(*) FILTER (op = 'delete') AS n_deleted, count(*) AS n_keys FROM l"))
def live_and_deleted(spark, d):
    last = t.changes(spark, d).groupBy("key").agg(F.max_by("op", "seq").alias("op"))
    return last.agg(F.count_if(F.col("op") != "delete").alias("n_live"), F.count_if(F.col("op") == "delete").alias("n_deleted"), F.count(F.lit(1)).alias("n_keys"))


@query("clone_and_union", sql(" SELECT tree, count(*) AS n FROM (SELECT tree, id FROM v_store UNION ALL SELECT 'copy' AS tree, id FROM v_store WHERE tree = 'fr') GROUP BY tree"))
def clone_and_union(spark, d):
    s = t.store(spark, d).select("tree", "id")
    return s.unionByName(s.filter("tree = 'fr'").withColumn("tree", F.lit("copy"))).groupBy("tree").agg(F.count(F.lit(1)).alias("n"))


@query("clear_tree", sql(" SELECT tree, count(*) AS n FROM v_store WHERE tree <> 'es' GROUP BY tree"))
def clear_tree(spark, d):
    return t.store(spark, d).filter("tree <> 'es'").groupBy("tree").agg(F.count(F.lit(1)).alias("n"))


@query("size_limited_batch", with_views("v_store", " SELECT id, strlen(value) AS n_bytes FROM v_store WHERE strlen(value) <= 8192"))
def size_limited_batch(spark, d):
    """A batch write drops documents above the size limit."""
    return t.store(spark, d).select("id", F.octet_length("value").cast("bigint").alias("n_bytes")).filter("n_bytes <= 8192")


_COUNTERS = ", ".join(f"count(*) FILTER (nonce % 16 = {i})" for i in range(16))


@query("nonce_counters", with_views("v_tx", f" SELECT uid, [{_COUNTERS}] AS counters FROM v_tx GROUP BY uid"))
def nonce_counters(spark, d):
    return kv.add_counters(t.transactions(spark, d), (F.col("nonce") % 16).cast("int"))


@query("account_upserts", "SELECT c_custkey AS uid, CASE WHEN c_custkey % 4 = 0 THEN 9 ELSE c_custkey % 5 END::INTEGER AS status FROM customer UNION ALL SELECT 10000000 + c_custkey, 1 FROM customer WHERE c_custkey % 100 = 0")
def account_upserts(spark, d):
    """Inserts and updates in one batch over the accounts."""
    a = t.accounts(spark, d)
    old = a.select(F.col("uid").alias("key"), F.col("status").alias("value"), F.lit(0).cast("bigint").alias("seq"))
    changed = a.filter("uid % 4 = 0").select(F.col("uid").alias("key"), F.lit(1).cast("bigint").alias("seq"), F.lit("upsert").alias("op"), F.lit(9).alias("value"))
    added = a.filter("uid % 100 = 0").select((F.col("uid") + 10000000).alias("key"), F.lit(2).cast("bigint").alias("seq"), F.lit("upsert").alias("op"), F.lit(1).alias("value"))
    return kv.apply_changes(old, changed.unionByName(added)).select(F.col("key").alias("uid"), F.col("value").alias("status"))


@query("snapshot_catalog", with_views("v_changes", ", v AS (SELECT seq // 1000 AS version, count(*) AS n_rows, sum(length(v_changes.value::VARCHAR))::BIGINT AS n_bytes, max(ts) AS taken FROM v_changes JOIN events ON event_id = seq GROUP BY 1) SELECT count(*) AS n_versions, min(version) AS first_version, max(version) AS last_version, sum(n_rows)::BIGINT AS n_rows, sum(n_bytes)::BIGINT AS n_bytes, arg_max(version, taken) AS newest FROM v"))
def snapshot_catalog(spark, d):
    """First, last and total of the versions in a snapshot catalog."""
    log = t.changes(spark, d).join(t.table(spark, d, "events").select(F.col("event_id").alias("seq"), "ts"), "seq")
    v = log.groupBy(F.expr("seq div 1000").alias("version")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length(F.col("value").cast("string"))).alias("n_bytes"), F.max("ts").alias("taken"))
    return v.agg(F.count(F.lit(1)).alias("n_versions"), F.min("version").alias("first_version"), F.max("version").alias("last_version"), F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"), F.max_by("version", "taken").alias("newest"))


@query("latest_side", with_views("v_book", ", l AS (SELECT side, symbol, max(seq) AS seq FROM v_book GROUP BY side, symbol) SELECT side, symbol, price, remaining FROM v_book JOIN l USING (side, symbol, seq)"))
def latest_side(spark, d):
    """A side's last message replaces the ones before it."""
    return t.book(spark, d).groupBy("side", "symbol").agg(F.max_by(F.struct("price", "remaining"), "seq").alias("m")).select("side", "symbol", "m.*")
