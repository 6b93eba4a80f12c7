"""Files, snapshots, cursors, streams of several batches and proofs as tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codec, digests
from tidemark.operators import keyed as kv
from tidemark.operators import merkle as mk
from tidemark.operators import orderbook as ob
from tidemark.operators import trie
from tidemark.sources import files
from tidemark.sources.storage import Snapshots
from tidemark.streaming import ingest


def test_cursor(spark):
    c = files.Cursor(spark.range(10).orderBy("id"))
    assert c.has_next() and c.peek()["id"] == 0 and c.next()["id"] == 0 and c.remaining() == 9
    assert [r["id"] for r in c.to_list(3)] == [1, 2, 3]
    seen = []
    c.for_each(lambda r: seen.append(r["id"]))
    assert seen == [4, 5, 6, 7, 8, 9] and not c.has_next()
    with pytest.raises(StopIteration):
        c.next()
    c.reset()
    assert c.peek()["id"] == 0 and c.remaining() == 10


def test_snapshots_by_root(spark, tmp_path):
    store = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 5, "z")], "tree string, id long, value string")
    s = Snapshots(spark, str(tmp_path))
    first = s.create(store.filter("id < 3"), None, 1)
    last = s.create_async(store, None, 2).result()
    assert last == mk.global_root(mk.tree_roots(store)).first()["global_root"] != first
    assert s.load().count() == 3 and {r["tree"] for r in s.trees(last).collect()} == {"a", "b"}
    assert [r["version"] for r in s.versions(first=max(first, last)).collect()] == [max(first, last)]
    assert [r["version"] for r in s.versions(before=max(first, last)).collect()] == [min(first, last)]
    s.delete(first)
    assert [r["version"] for r in s.versions().collect()] == [last] and s.stats().first()["n_versions"] == 1
    with pytest.raises(KeyError):
        s.load(first)
    store.write.parquet(f"{tmp_path}/data/version=left-by-a-failure")
    assert s.compact() == 1 and s.load(last).count() == 3
    assert s.create(store.filter("id < 3"), first, 3) == first and s.load().count() == 2


def test_block_files(spark, tmp_path):
    rows = [(b, i, bytes([b]) * 64, f"body {b} {i}".encode()) for b in range(3) for i in range(4)]
    blocks = codec.encode_blocks(spark.createDataFrame(rows, "block long, seq long, sig binary, body binary"))
    assert files.write_block_files(blocks, f"{tmp_path}/blocks") == 3
    (tmp_path / "blocks" / "block-000000000009.bin").write_bytes(b"junk")
    back = files.read_block_files(spark, f"{tmp_path}/blocks").collect()
    assert sorted((r["block"], r["pos"], bytes(r["sig"]), bytes(r["body"])) for r in back if r["error"] is None) == [(b, i, s, x) for b, i, s, x in rows]
    assert [r["block"] for r in back if r["error"]] == [9]
    digests.register(spark)
    opened = spark.sql("SELECT r.* FROM VALUES (X'00') AS t(data), LATERAL open_block(t.data) r").collect()
    assert len(opened) == 1 and opened[0]["error"]


def test_feed_skips_what_is_broken(spark):
    lines = ['{"topic":"orderbook.50.S1","type":"snapshot","ts":5,"data":{"b":[["1.5","2"],["9"]],"a":[["x","1"]]}}', "{broken", '{"topic":"trade.S1"}', '{"topic":"orderbook.50.S9","data":{"b":[["1","2"]]}}', None]
    got = [tuple(r) for r in files.parse_feed(spark.createDataFrame([(x,) for x in lines], "value string"), ["S1"]).collect()]
    assert got == [("S1", "snapshot", 5, "BUY", 1.5, 2.0), ("S1", "snapshot", 5, "SELL", None, 1.0)]


def _stream(spark, tmp_path, parts, schema):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def _run(stream, sink, tmp_path):
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").foreachBatch(sink).start().awaitTermination()


def test_pipeline_over_batches(spark, tmp_path):
    rng = random.Random(1)
    rows, n = [], 0
    for _ in range(4):
        rows.append([])
        for _ in range(25):
            n += 1
            rows[-1].append((n, f"s{rng.randrange(60)}", codec.encode_order({"uid": 1 + rng.randrange(3), "nonce": n + rng.randrange(30), "op_code": 62 if n % 7 == 0 else 61, "amount": 5})))
    rows[1].append((200, "broken", b"\xff\xff"))
    base = f"{tmp_path}/out"
    _run(_stream(spark, tmp_path, rows, "arrival long, sig string, body binary"), ingest.pipeline_sink(base, lambda m: m.filter("op_code <> 62")), tmp_path)
    seen, top, want = set(), {}, set()
    for batch in rows:
        for a, sig, body in batch:
            if sig == "broken" or sig in seen:
                continue
            m = codec.decode_order(body)
            if m["op_code"] == 62:
                continue
            seen.add(sig)
            if m["nonce"] > top.get(m["uid"], 0):
                want.add((a, m["uid"], m["nonce"]))
                top[m["uid"]] = m["nonce"]
    got = {(r["arrival"], r["uid"], r["nonce"]) for r in spark.read.parquet(f"{base}/executed").collect()}
    assert spark.read.parquet(f"{base}/prepared").select("batch").distinct().count() == 4
    assert got == want


def test_roots_and_flushes_over_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [[(rng.randrange(9), 100 * b + i, rng.choice(["upsert", "upsert", "delete"]), rng.randrange(99)) for i in range(30)] for b in range(3)]
    schema = "key long, seq long, op string, value long"
    base = f"{tmp_path}/roots"
    flushes = ingest.buffered_sink(f"{tmp_path}/flushes", 8)
    root = ingest.root_sink(base)
    _run(_stream(spark, tmp_path, rows, schema), lambda df, n: (root(df, n), flushes(df, n)), tmp_path)
    last = {k: (op, v) for batch in rows for k, _, op, v in sorted(batch, key=lambda r: r[1])}
    state = spark.createDataFrame([(k, op, v) for k, (op, v) in last.items()], "key long, op string, value long")
    want = mk.state_root(state, "key", F.col("value"), F.col("op") == "delete").first()["state_root"]
    assert ingest.published(spark, base) == {"tag": "head", "batch": 2, "root": want}
    assert ingest.published(spark, base, "other") is None
    root(spark.createDataFrame(rows[2], schema), 2)  # run again after a failure
    assert ingest.published(spark, base)["root"] == want
    sizes = spark.read.parquet(f"{tmp_path}/flushes").groupBy("batch", "flush").count().collect()
    assert sorted(r["count"] for r in sizes) == [6, 6, 6] + [8] * 9


def test_proofs_as_tables(spark):
    rng = random.Random(3)
    rows = sorted((hashlib.sha256(str(i).encode()).digest(), f"v{i}".encode()) for i in range(60))
    keyed = spark.createDataFrame(rows, "key binary, value binary")
    asked = [k for k, _ in rows[::3]] + [hashlib.sha256(f"x{i}".encode()).digest() for i in range(30)]
    asked.append(bytes([rows[0][0][0] ^ 1]) + rows[0][0][1:])
    for bits in (1, 4, 8):
        got = {bytes(r["key"]): r for r in trie.prove(keyed, spark.createDataFrame([(k,) for k in asked], "key binary"), bits).collect()}
        assert set(got) == set(asked)
        for k, r in got.items():
            siblings, end = trie.proof(rows, k)
            assert [bytes(x) for x in r["siblings"]] == siblings and bytes(r["root"]) == trie.root(rows)
            assert (None if r["end_key"] is None else (bytes(r["end_key"]), bytes(r["end_value"]))) == end
            assert trie.Nodes(rows).proof(k) == (siblings, end)
    assert rng and trie.prove(keyed.limit(0), keyed.select("key").limit(2)).count() == 2


def test_bundle_that_was_changed(spark):
    keyed = spark.createDataFrame([(hashlib.sha256(str(i).encode()).hexdigest().upper(), b"v%d" % i) for i in range(40)], "key string, value binary")
    nodes = mk.dense_nodes(keyed, 3)
    root = nodes.filter("level = 0").first()["hash"]
    paths = nodes.filter("level = 3").orderBy("path").limit(7).select("path")
    bundle = mk.bundle_proof(nodes, paths, 3)
    assert tuple(mk.verify_bundle(bundle, paths, root, 3).first()) == (7, True)
    assert not mk.verify_bundle(bundle, paths, "00" * 32, 3).first()["valid"]
    assert not mk.verify_bundle(bundle.withColumn("hash", F.when(F.col("level") == 3, F.sha2(F.col("hash"), 256)).otherwise(F.col("hash"))), paths, root, 3).first()["valid"]
    assert not mk.verify_bundle(bundle, nodes.filter("level = 3").select("path"), root, 3).first()["valid"]


def test_digests_by_name(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    raw = (1).to_bytes(8) + (2).to_bytes(8)
    one = lambda **k: df.select(digests.digest_of(F.col("a"), F.col("b"), **k)).first()[0]
    assert one() == hashlib.sha256(raw).hexdigest() and one(digest="blake2b") == hashlib.blake2b(raw, digest_size=32).hexdigest()
    assert one(digest="md5", encoder="text") == hashlib.md5(b"1|2").hexdigest()
    digests.register_digest("twice", lambda c: F.sha2(F.sha2(c, 256), 256))
    assert one(digest="twice") == hashlib.sha256(hashlib.sha256(raw).hexdigest().encode()).hexdigest()
    with pytest.raises(KeyError, match="no digest"):
        one(digest="none")


def test_lookup_and_repair(spark):
    store = spark.createDataFrame([("a", 1, "x")], "tree string, id long, value string")
    assert kv.get_one(store, 1, "a")["value"] == "x"
    with pytest.raises(KeyError):
        kv.get_one(store, 2, "a")
    orders = spark.createDataFrame([(1, 10, 5, 9), (2, 10, 5, 1), (3, 99, 5, 0), (4, 10, 500, 0)], "order_id long, price long, size long, filled long").withColumn("remaining", F.col("size") - F.col("filled"))
    got = {r["order_id"]: r["remaining"] for r in ob.repair(orders, 1, 50, 100).collect()}
    assert got == {1: 0, 2: 4}
