"""Queries that write files or run streams of several stages, and read back what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import codec, digests
from tidemark.operators import keyed as kv
from tidemark.operators import merkle as mk
from tidemark.operators import orderbook as ob
from tidemark.operators import trie
from tidemark.operators.txflow import batches
from tidemark.plans.integrity import FOLD, TREES, W64, WIDTH, _keyed, series_commitments, state_sql
from tidemark.plans.mirror import BODY, _blocks
from tidemark.plans.registry import query
from tidemark.plans.views import with_views
from tidemark.sources import files
from tidemark.sources import tables as t
from tidemark.sources.storage import Snapshots, scratch_dir
from tidemark.streaming import ingest


@query("block_files", with_views("v_tx", f" SELECT arrival // 500 AS block, (arrival % 500 - min(arrival % 500) OVER (PARTITION BY arrival // 500))::INTEGER AS pos, sig, sha256({BODY}) AS body_hash FROM v_tx"))
def block_files(spark, d):
    """Blocks as files of their own, read by the binary file source."""
    path = scratch_dir(spark)
    files.write_block_files(codec.encode_blocks(_blocks(spark, d)), path)
    back = files.read_block_files(spark, path)
    return back.select("block", "pos", F.lower(F.substring(F.hex("sig"), 1, 64)).alias("sig"), F.sha2("body", 256).alias("body_hash"))


@query("block_rows", with_views("v_tx", f" SELECT arrival // 500 AS block, count(*) AS n, sum(strlen({BODY}))::BIGINT AS n_bytes FROM v_tx GROUP BY 1"))
def block_rows(spark, d):
    """Blocks opened by a table function in SQL."""
    digests.register(spark)
    blocks = codec.encode_blocks(_blocks(spark, d)).select("block", "data")
    rows = spark.sql("SELECT b.block, r.body FROM {blocks} b, LATERAL open_block(b.data) r WHERE r.error IS NULL", blocks=blocks)
    return rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("n_bytes"))


@query("kind_dispatch", with_views("v_accounts v_balances v_book", " SELECT 'account' AS kind, uid AS id, status::BIGINT AS value FROM v_accounts UNION ALL SELECT 'balance', user_id, available FROM v_balances UNION ALL SELECT 'order', order_id, price FROM v_book"))
def kind_dispatch(spark, d):
    """Three kinds of rows written as one key space, and told apart by the first byte of their keys."""
    from tidemark.functions.encoding import be64, from_be

    path = scratch_dir(spark)
    a, b, o = t.accounts(spark, d), t.balances(spark, d), t.book(spark, d)
    space = files.key_space({"account": (a, F.col("uid"), be64(F.col("status").cast("bigint"))), "balance": (b, F.col("user_id"), be64(F.col("available"))), "order": (o, F.col("order_id"), be64(F.col("price")))})
    space.write.parquet(path)
    out = None
    for kind, rows in files.by_kind(spark.read.parquet(path)).items():
        part = rows.select(F.lit(kind).alias("kind"), "id", from_be(F.col("value"), 1, 8).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("feed_levels", "SELECT 'S' || (user_id % 5)::VARCHAR AS symbol, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, value AS price, (event_id % 10)::DOUBLE AS qty, event_id AS ts FROM events WHERE user_id % 5 < 3 AND event_id % 9 <> 0")
def feed_levels(spark, d):
    """JSON messages of a feed as a stream; some are broken, some of topics that nobody follows."""
    path = scratch_dir(spark)
    e = t.table(spark, d, "events")
    level = F.format_string('[["%s","%d"]]', F.col("value").cast("string"), F.col("event_id") % 10)
    sides = F.when(F.col("event_id") % 2 == 0, F.format_string('"b":%s', level)).otherwise(F.format_string('"a":%s,"b":[["7"]]', level))
    line = F.format_string('{"topic":"orderbook.50.S%d","type":"delta","ts":%d,"data":{%s}}', (F.col("user_id") % 5).cast("int"), "event_id", sides)
    e.select(F.when(F.col("event_id") % 9 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    return spark.read.parquet(ingest.run(files.feed_stream(spark, path, ["S0", "S1", "S2"]).select("symbol", "side", "price", "qty", "ts")))


@query("dictionary_files", with_views("v_tx", f", k AS (SELECT row_number() OVER (ORDER BY arrival) - 1 AS k, {BODY} AS body FROM v_tx) SELECT ((k // 50) % 1000)::INTEGER AS sample, count(*) AS n, sum(strlen(body))::BIGINT AS n_bytes FROM k GROUP BY 1"))
def dictionary_files(spark, d):
    """Bodies in blocks of fifty dealt to a thousand sample folders for a dictionary."""
    path = scratch_dir(spark)
    rows = batches(_blocks(spark, d).withColumnRenamed("seq", "arrival"), 50)
    rows.select((F.col("batch") % 1000).cast("int").alias("sample"), "body").repartition("sample").write.partitionBy("sample").parquet(path)
    return spark.read.schema("body binary, sample int").parquet(path).groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("n_bytes"))


@query("binary_dump", with_views("v_tx", " SELECT arrival, uid, nonce, amount + 1 AS price FROM v_tx"))
def binary_dump(spark, d):
    """Messages appended to a dump in binary, half by half, and read back."""
    path = scratch_dir(spark)
    m = codec.order_message("uid", "nonce", F.col("amount") + 1, "amount", "market", "op_code")
    rows = t.transactions(spark, d).select("arrival", m.alias("m"))
    for half in (0, 1):
        rows.filter(F.pmod(F.col("arrival"), F.lit(2)) == half).write.mode("append").parquet(path)
    return spark.read.parquet(path).select("arrival", codec.parse_order("m").alias("p")).select("arrival", "p.uid", "p.nonce", "p.price")


@query("tree_dump", with_views("v_store", TREES + " SELECT r.tree, r.hash AS root, " + " + ".join(f"(SELECT count(*) FROM n{k} WHERE n{k}.tree = r.tree)" for k in range(WIDTH + 1)) + " AS n_nodes, true AS valid FROM n0 r"))
def tree_dump(spark, d):
    """Trees written by level and loaded; the upper levels must hash to the roots that were written."""
    path = scratch_dir(spark)
    files.dump_tree(mk.all_nodes(t.store(spark, d), WIDTH), path)
    nodes, heads = files.load_tree(spark, path)
    again = mk.node_level(nodes.filter("depth = 1").select("tree", "key", "hash"), 0).select("tree", F.col("hash").alias("made"))
    return heads.join(again, "tree").select("tree", "root", "n_nodes", (F.col("made") == F.col("root")).alias("valid"))


@query("series_dump", with_views("v_ticks", ", s AS (SELECT date_trunc('hour', ts) AS bucket, date_part('minute', ts)::INTEGER AS slot, arg_max(price, arrival) AS price FROM v_ticks GROUP BY 1, 2) SELECT left(sha256('TICK_' || strftime(bucket, '%Y-%m-%dT%H')), 32) AS stem, sha256(string_agg(slot::VARCHAR || ':' || price::VARCHAR, ',' ORDER BY slot)) AS commitment, 32::INTEGER AS n_bytes FROM s GROUP BY bucket"))
def series_dump(spark, d):
    """A series' commitments and stems dumped in binary."""
    path = scratch_dir(spark)
    series_commitments(spark, d).select(F.unhex("commitment").alias("commitment"), F.unhex("stem").alias("stem")).write.parquet(path)
    return spark.read.parquet(path).select(F.lower(F.hex("stem")).alias("stem"), F.lower(F.hex("commitment")).alias("commitment"), F.length("commitment").alias("n_bytes"))


@query("snapshot_by_root", with_views("v_store", FOLD + " SELECT f2.hash AS version, tree, count(*) AS n FROM v_store, f2 GROUP BY ALL"))
def snapshot_by_root(spark, d):
    """A version called by the store's root, written in the background beside one that is deleted; its tables and rows."""
    s, store = Snapshots(spark, scratch_dir(spark)), t.store(spark, d)
    s.create(store.filter("id < 50"), "ffff", 1)
    version = s.create_async(store, None, 2).result()
    s.delete("ffff")
    s.compact()
    rows = s.load(version).groupBy("tree").agg(F.count(F.lit(1)).alias("n")).join(s.trees(version), "tree")
    return rows.crossJoin(s.versions(first="0").select("version")).select("version", "tree", "n")


@query("stream_flushes", "SELECT ((row_number() OVER (ORDER BY event_id) - 1) // 8192)::INTEGER AS flush, event_id AS seq FROM events")
def stream_flushes(spark, d):
    """A stream written in flushes of 8192 rows at most."""
    base = scratch_dir(spark)
    rows = ingest.event_stream(spark, d).select(F.col("event_id").alias("seq"), "event_type")
    rows.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}-state").foreachBatch(ingest.buffered_sink(base)).start().awaitTermination()
    return spark.read.schema("seq long, event_type string, batch int, flush int").parquet(base).select("flush", "seq")


@query("stream_roots", with_views("v_changes", state_sql().replace("SELECT h AS state_root", "SELECT 'head' AS tag, h AS root")))
def stream_roots(spark, d):
    """The root after the last batch of a stream of changes, as it was published."""
    base = scratch_dir(spark)
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    log = ingest.event_stream(spark, d).select(F.col("user_id").cast("bigint").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), t.cents(F.col("value")).alias("value"))
    log.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}-state").foreachBatch(ingest.root_sink(base)).start().awaitTermination()
    return spark.createDataFrame([ingest.published(spark, base)], "tag string, batch long, root string").select("tag", "root")


PIPELINE = """, v AS (SELECT * FROM v_tx WHERE op_code <> 62 AND amount > 0), f AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY arrival) AS k FROM v),
p AS (SELECT * FROM f WHERE k = 1), s AS (SELECT *, max(nonce) OVER (PARTITION BY uid ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM p)
SELECT arrival, uid, nonce, op_code FROM s WHERE nonce > coalesce(seen, 0)"""


@query("stream_pipeline", with_views("v_tx", PIPELINE))
def stream_pipeline(spark, d):
    """Binary messages decoded, verified, prepared and executed by one stream."""
    base = scratch_dir(spark)
    source = f"{base}-messages"
    rows = t.transactions(spark, d)
    body = codec.order_message("uid", "nonce", F.col("amount") + 1, "amount", "market", "op_code")
    rows.select("arrival", "sig", body.alias("body")).write.parquet(source)
    stream = spark.readStream.schema("arrival long, sig string, body binary").option("maxFilesPerTrigger", 100).parquet(source)
    sink = ingest.pipeline_sink(base, lambda m: m.filter("op_code <> 62 and amount > 0"))
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}-state").foreachBatch(sink).start().awaitTermination()
    rows = spark.read.schema("arrival long, uid long, nonce long, op_code long, batch int").parquet(f"{base}/executed")
    return rows.select("arrival", "uid", "nonce", F.col("op_code").cast("int").alias("op_code"))


@query("last_writes", "SELECT lang AS account, arg_max(doc_id, doc_id) AS seq, arg_max(strlen(text), doc_id) AS n_bytes FROM documents WHERE strlen(text) <= 8192 AND lang IS NOT NULL GROUP BY lang")
def last_writes(spark, d):
    """A batch keeps each account's last write among those within the size limit."""
    size = F.octet_length("text").cast("bigint")
    rows = t.table(spark, d, "documents").filter((size <= 8192) & F.col("lang").isNotNull())
    return rows.groupBy(F.col("lang").alias("account")).agg(F.max("doc_id").alias("seq"), F.max_by(size, "doc_id").alias("n_bytes"))


@query("repaired_book", with_views("v_book", """, b AS (SELECT side, price, size, least(CASE WHEN order_id % 13 = 0 THEN size + 9 ELSE filled END, size) AS filled FROM v_book WHERE price BETWEEN 6499600 AND 6500400 AND size <= 18000),
r AS (SELECT side, price, sum(remaining) AS volume FROM v_book WHERE remaining > 0 GROUP BY side, price), l AS (SELECT side, price, sum(size - filled)::BIGINT AS volume FROM b WHERE size > filled GROUP BY side, price)
SELECT l.side, l.price, l.volume, l.volume IS DISTINCT FROM r.volume AS changed FROM l LEFT JOIN r USING (side, price)"""))
def repaired_book(spark, d):
    """Impossible orders go or are mended, and the levels that this changes are told."""
    book = t.book(spark, d)
    bad = book.withColumn("filled", F.when(F.col("order_id") % 13 == 0, F.col("size") + 9).otherwise(F.col("filled")))
    return ob.repaired_levels(ob.repair(bad, 6499600, 6500400, 18000), ob.levels(book).select("side", "price", "volume"))


@query("trie_proofs", "SELECT c_custkey AS id, true AS included, true AS valid, false AS valid_if_changed FROM customer UNION ALL SELECT c_custkey + 1000000000, false, true, false FROM customer")
def trie_proofs(spark, d):
    """Inclusion of all customers and exclusion of as many others, proved and verified; a claim that was changed must fail."""
    c = t.table(spark, d, "customer")
    key = lambda x: F.unhex(F.sha2(x.cast("string"), 256))
    keyed = c.select(key(F.col("c_custkey")).alias("key"), F.sha2(F.col("c_name"), 256).cast("binary").alias("value"))
    wanted = c.select(F.col("c_custkey").alias("id"), key(F.col("c_custkey")).alias("key"), F.sha2(F.col("c_name"), 256).cast("binary").alias("value"))
    wanted = wanted.unionByName(c.select((F.col("c_custkey") + 1_000_000_000).alias("id"), key(F.col("c_custkey") + 1_000_000_000).alias("key"), F.lit(None).cast("binary").alias("value")))
    proofs = trie.prove(keyed, wanted).join(wanted, "key")
    good = trie.verified(proofs).select("id", F.col("value").isNotNull().alias("included"), "valid")
    other = F.when(F.col("value").isNull(), F.lit("x").cast("binary"))  # the opposite claim
    bad = trie.verified(proofs.withColumn("value", other)).select("id", F.col("valid").alias("valid_if_changed"))
    return good.join(bad, "id")


def dense_sql(depth: int) -> str:
    """Nodes of the dense tree over customers, level by level; level 0 is the root."""
    path = " || ".join(f"printf('%02X', ('0x' || substr(k, {2 * i + 1}, 2))::INTEGER & 127)" for i in range(depth))
    sql = f"WITH c AS (SELECT upper(sha256(c_custkey::VARCHAR)) AS k, c_name FROM customer), l AS (SELECT {path} AS path, k, sha256(unhex(k || hex(encode(c_name)))) AS h FROM c), d{depth} AS (SELECT path, sha256(unhex(string_agg(h, '' ORDER BY k))) AS hash FROM l GROUP BY path)"
    for i in range(depth - 1, -1, -1):
        sql += f", d{i} AS (SELECT p.path, sha256(unhex(string_agg(coalesce(n.hash, '{mk.ZERO}'), '' ORDER BY s.i))) AS hash FROM (SELECT DISTINCT substr(path, 1, {2 * i}) AS path FROM d{i + 1}) p CROSS JOIN range(128) s(i) LEFT JOIN d{i + 1} n ON n.path = p.path || printf('%02X', s.i) GROUP BY p.path)"
    return sql


DENSE = 8


@query("dense_tree_nodes", dense_sql(DENSE) + " " + " UNION ALL ".join(f"SELECT {i} AS level, path, hash FROM d{i}" for i in range(DENSE + 1)))
def dense_tree_nodes(spark, d):
    return mk.dense_nodes(_keyed(spark, d), DENSE).select("level", "path", "hash")


@query("dense_tree_root", dense_sql(DENSE) + " SELECT hash FROM d0")
def dense_tree_root(spark, d):
    return mk.dense_nodes(_keyed(spark, d), DENSE).filter("level = 0").select("hash")


@query("bundle_valid", "SELECT count(DISTINCT substr(sha256(c_custkey::VARCHAR), 1, 16)) AS n_paths, true AS valid, false AS valid_if_cut FROM customer")
def bundle_valid(spark, d):
    """A proof of all customers together is verified, and one that lacks a node fails."""
    nodes = mk.dense_nodes(_keyed(spark, d), DENSE)
    paths = nodes.filter(F.col("level") == DENSE).select("path")
    root = nodes.filter("level = 0").first()["hash"]
    bundle = mk.bundle_proof(nodes, paths, DENSE)
    cut = bundle.join(F.broadcast(bundle.filter(F.col("level") == 3).agg(F.min("path").alias("path")).withColumn("level", F.lit(3))), ["level", "path"], "left_anti")
    return mk.verify_bundle(bundle, paths, root, DENSE).join(mk.verify_bundle(cut, paths, root, DENSE).select(F.col("valid").alias("valid_if_cut")))


@query("digest_kinds", with_views("v_accounts", f" SELECT uid, sha256(unhex({W64.format('uid')} || {W64.format('status')})) AS by_sha256, md5(uid || '|' || status) AS text_md5, 64::INTEGER AS blake2b_digits FROM v_accounts"))
def digest_kinds(spark, d):
    """Digests and row encoders chosen by name."""
    fields = F.col("uid"), F.col("status").cast("bigint")
    return t.accounts(spark, d).select("uid", digests.digest_of(*fields).alias("by_sha256"), digests.digest_of(*fields, digest="md5", encoder="text").alias("text_md5"), F.length(digests.digest_of(*fields, digest="blake2b")).alias("blake2b_digits"))


@query("point_lookup", with_views("v_store", " SELECT tree, id, strlen(value) AS n_bytes FROM v_store WHERE id = (SELECT max(id) FROM v_store)"))
def point_lookup(spark, d):
    """The row of an id in its table; `get_one` raises where there is none."""
    store = t.store(spark, d)
    last = store.orderBy(F.desc("id")).select("tree", "id").first()
    row = kv.get_one(store, last["id"], last["tree"])
    return spark.createDataFrame([(row["tree"], row["id"], len(row["value"].encode()))], "tree string, id long, n_bytes long")
