"""Codecs, tries, trees and keyed tables: round trips, models and edge cases."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.functions import encoding as enc
from tidemark.operators import keyed, merkle, trie, txflow
from tidemark.operators.sketches import filtered_semi_join
from tidemark.sources.storage import Snapshots


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=64, max_size=64), st.binary(max_size=300)), max_size=20), st.sampled_from(sorted(codec.CODECS)))
def test_block_round_trip(txs, name):
    assert codec.decode_block(codec.encode_block(txs, name)) == txs


def test_broken_blocks():
    good = codec.encode_block([(b"s" * 64, b"body")], "none")
    for bad in (b"", good[:20], good[:-1], b"\x00" + good[1:], good[: codec.HEADER.size + 64] + b"\x00" + good[codec.HEADER.size + 65 :]):
        with pytest.raises(ValueError):
            codec.decode_block(bad)
    shared = b"the same words again " * 20
    packed = codec.encode_block([(b"s" * 64, shared)], "zstd", shared)
    assert codec.decode_block(packed, shared) == [(b"s" * 64, shared)]


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**64 - 1))
def test_varint(n):
    assert codec.get_varint(codec.put_varint(n), 0) == (n, len(codec.put_varint(n)))


def test_messages():
    row = {"uid": 7, "nonce": 300, "price": 0, "amount": 2**40, "signature": b"abc", "symbol": 5, "op_code": 61}
    b = codec.encode_order(row)
    assert codec.decode_order(b) == row and codec.scan_wire(b)
    assert not codec.scan_wire(b[:-1]) and not codec.scan_wire(b"") and not codec.scan_wire(b"\x07")


def test_ed25519():
    # First test vector of RFC 8032, section 7.1.
    key = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    public = bytes.fromhex("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a")
    assert codec.public_key(key) == public
    signature = codec.sign(key, b"")
    assert signature.hex().startswith("e5564300c360ac729086e2cc806e828a")
    assert codec.verify(public, b"", signature)
    assert not codec.verify(public, b"x", signature) and not codec.verify(public, b"", signature[:-1] + b"\x01")


def test_trie_proofs():
    rng = random.Random(1)
    rows = sorted((hashlib.sha256(bytes([i])).digest(), rng.randbytes(rng.randrange(1, 40))) for i in range(60))
    top = trie.root(rows)
    for key, value in rows[::7]:
        path, end = trie.proof(rows, key)
        assert trie.verify(top, key, path, end, value) and trie.expand(trie.compress(path)) == path
        assert not trie.verify(top, key, path, end, value + b"x") and not trie.verify(top, key, path, end, None)
    for i in range(100, 130):
        key = hashlib.sha256(bytes([i])).digest()
        path, end = trie.proof(rows, key)
        assert trie.verify(top, key, path, end, None) and not trie.verify(top, key, path, end, b"v")
    assert trie.root([]) == trie.EMPTY
    assert trie.root(rows[:1]) == trie.leaf(*rows[0], 256)


def test_distributed_trie(spark):
    rows = sorted((hashlib.sha256(str(i).encode()).digest(), bytes([i % 250 + 1])) for i in range(700))
    df = spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in rows], "key binary, value binary")
    for n in (0, 1, 2, 3, 700):
        got = trie.distributed_root(df.limit(n) if n < 700 else df).collect()
        some = rows[:n]
        if n in (1, 2, 3):
            some = sorted((bytes(r[0]), bytes(r[1])) for r in df.limit(n).collect())
        assert [r[0] for r in got] == ([trie.root(some).hex()] if n else [])


def _sparse(rows, depth=0):
    if len(rows) == 1:
        return hashlib.sha256(b"\x01" + rows[0][0] + rows[0][1]).digest()
    groups = {}
    for k, v in rows:
        groups.setdefault(k[depth], []).append((k, v))
    bitmap = bytearray(32)
    for b in groups:
        bitmap[b // 8] |= 128 >> b % 8
    return hashlib.sha256(b"\x00" + bytes(bitmap) + b"".join(_sparse(groups[b], depth + 1) for b in sorted(groups))).digest()


def test_sparse_tree(spark):
    rows = [(hashlib.sha256(str(i).encode()).digest(), b"v%d" % i) for i in range(400)]
    df = spark.createDataFrame([(k.hex().upper(), bytearray(v)) for k, v in rows], "key string, value binary")
    # Bytes below the cut have no nodes of their own here, since no two of these keys share so many.
    assert merkle.sparse_tree(df, 4).first()[0] == _sparse(rows).hex()


def test_tree_is_updated_like_built(spark):
    store = spark.createDataFrame([("a", i, f"v{i}") for i in (0, 1, 257, 65537, 70000)] + [("b", 5, "x")], "tree string, id long, value string")
    nodes = merkle.all_nodes(store, 4)
    gone = merkle.leaves(store.filter("id = 257"), 4).withColumn("hash", F.lit(None).cast("string"))
    new = merkle.leaves(spark.createDataFrame([("a", 9, "n"), ("b", 5, "y")], "tree string, id long, value string"), 4)
    got = {tuple(r) for r in merkle.update_nodes(nodes, gone.unionByName(new), 4).filter("depth = 0").select("tree", "hash").collect()}
    after = spark.createDataFrame([("a", i, f"v{i}") for i in (0, 1, 65537, 70000)] + [("a", 9, "n"), ("b", 5, "y")], "tree string, id long, value string")
    assert got == {tuple(r) for r in merkle.tree_roots(after, 4).collect()}


def test_global_root(spark):
    def fold(level):
        while len(level) > 1:
            level = level + [bytes(32)] * (len(level) % 2)
            level = [hashlib.sha256(level[i] + level[i + 1]).digest() for i in range(0, len(level), 2)]
        return level[0] if level else bytes(32)

    for n in (0, 1, 2, 3, 5, 8):
        roots = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        df = spark.createDataFrame([(f"t{i}", r.hex()) for i, r in enumerate(roots)], "tree string, root string")
        assert merkle.global_root(df).first()[0] == fold(roots).hex()
        p = merkle.proofs(df).select(merkle.verify_path(F.col("root"), F.col("path"), F.lit(fold(roots).hex()))).collect()
        assert len(p) == n and all(r[0] for r in p)


def test_bundle_has_the_nodes_of_single_proofs(spark):
    df = spark.createDataFrame([(hashlib.sha256(bytes([i])).hexdigest().upper(), bytearray(b"v")) for i in range(50)], "key string, value binary")
    nodes = merkle.dense_nodes(df, 2)
    paths = [r[0] for r in nodes.filter("level = 2").select("path").collect()][:5]
    got = {(r["level"], r["path"]) for r in merkle.bundle_proof(nodes, spark.createDataFrame([(p,) for p in paths], "path string"), 2).collect()}
    everything = {(r["level"], r["path"]) for r in nodes.collect()}
    want = {(level, path) for level, path in everything if level and any(p[: 2 * (level - 1)] == path[:-2] for p in paths)}
    assert got == want


def test_contiguous_nonces(spark):
    tx = spark.createDataFrame([(1, 7, 2), (2, 7, 1), (3, 7, 1), (4, 7, 4), (5, 7, 3), (6, 8, 5)], "arrival long, uid long, nonce long")
    users = spark.createDataFrame([(7, 0), (8, 0)], "uid long, init_nonce long")
    got = sorted(tuple(r) for r in txflow.contiguous_nonces(tx, users).collect())
    assert got == [(7, 1, 2, 2), (7, 2, 1, 2), (7, 3, 5, 5), (7, 4, 4, 5)]


def test_monotonic_nonces(spark):
    tx = spark.createDataFrame([(1, 7, 1), (2, 7, 1), (3, 7, 1001), (4, 7, 3), (5, 7, 1002), (6, 9, 1)], "arrival long, uid long, nonce long")
    users = spark.createDataFrame([(7, 0)], "uid long, init_nonce long")
    assert sorted(r["arrival"] for r in txflow.monotonic_nonces(tx, users).collect()) == [1, 3, 5]


def test_alarm(spark):
    rows = [(i, s, 0) for s, n in ((1, 1), (2, 99), (3, 100), (4, 1001), (5, 500), (6, 50)) for i in range(n + 1)]
    tx = spark.createDataFrame([(k, f"2024-01-01 00:00:{s:02}", f"s{s}") for k, (i, s, _) in enumerate(rows)], "arrival long, ts string, sig string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = [(r["n_dup"], r["alarm"]) for r in txflow.duplicate_alarm(tx).orderBy("window_start").collect()]
    assert got == [(1, False), (99, False), (100, False), (1001, True), (500, True), (50, False)]


def test_routing(spark):
    rows = spark.createDataFrame([(100, 5), (101, 0), (101, 64), (101, 65), (101, 1)], "uid long, market long")
    got = [r[0] for r in rows.select(txflow.route_market(F.col("uid"), F.col("market"), 100, 16)).collect()]
    assert got == [0, 65, 64, 66, 1]
    assert rows.select(txflow.route_user(F.col("uid"), 1, 10)).distinct().collect()[0][0] == 0


def test_uuid7(spark):
    now = 1_700_000_000_000
    df = spark.createDataFrame([(now + k,) for k in (-60_001, -60_000, 0, 60_000, 60_001)], "ms long")
    got = [r[0] for r in df.select(enc.uuid7_valid(enc.uuid7(F.col("ms"), F.col("ms")), F.lit(now))).collect()]
    assert got == [False, True, True, True, False]
    short = df.select(enc.uuid7_valid(F.substring(enc.uuid7(F.col("ms"), F.col("ms")), 1, 15), F.lit(now))).collect()
    assert not any(r[0] for r in short)


def test_encoding(spark):
    df = spark.createDataFrame([(0,), (1,), (255,), (2**40 + 3,), (2**62,)], "n long")
    for r in df.select("n", enc.be64(F.col("n")).alias("b"), enc.le64(F.col("n")).alias("l"), enc.from_be(enc.be64(F.col("n")), 1, 8).alias("back")).collect():
        assert bytes(r["b"]) == r["n"].to_bytes(8, "big") and bytes(r["l"]) == r["n"].to_bytes(8, "little") and r["back"] == r["n"]


def test_catalog(spark):
    c = keyed.Catalog(spark, "t")
    df = spark.range(3)
    c.create("a", df)
    with pytest.raises(ValueError):
        c.create("a", df)
    c.rename("a", "b")
    c.clone("b", "c")
    assert c.names() == ["b", "c"] and c.union().count() == 6
    c.clear("b")
    assert c.get("b").count() == 0 and c.exists("c")
    with pytest.raises(KeyError):
        c.get("a")
    c.remove_all()
    assert c.names() == []


def test_changes_and_diff(spark):
    log = spark.createDataFrame([(1, 1, "upsert", 5), (1, 2, "delete", 0), (1, 3, "upsert", 6), (2, 4, "upsert", 1), (3, 5, "upsert", 1), (3, 6, "delete", 0)], "key long, seq long, op string, value long")
    assert {(r["key"], r["value"]) for r in keyed.latest(log).collect()} == {(1, 6), (2, 1)}
    d = keyed.diff(keyed.latest(log, 1), keyed.latest(log))
    assert {(r["key"], r["change"]) for r in d.collect()} == {(1, "modified"), (2, "added")}
    empty = keyed.latest(log.limit(0))
    assert keyed.diff(empty, empty).count() == 0


def test_filtered_semi_join(spark):
    keys, probes = spark.range(0, 1000, 2).toDF("k"), spark.range(3000).toDF("k")
    assert sorted(r[0] for r in filtered_semi_join(probes, keys, "k", 1 << 12).collect()) == list(range(0, 1000, 2))


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    with pytest.raises(KeyError):
        s.load()
    a = spark.createDataFrame([("x", 1, "v")], "tree string, id long, value string")
    s.create(a, "v1", 1)
    s.create(a.limit(0), "v0", 0)
    s.create(a.withColumn("id", F.col("id") + 1), "v2", 2)
    assert s.load().first()["id"] == 2 and s.load("v1").first()["id"] == 1
    s.delete("v2")
    assert s.load().first()["id"] == 1 and s.stats().first()["n_versions"] == 2


def test_messages_by_batch_are_those_by_row():
    """Readers and writers of whole batches against the ones that take a message at a time."""
    import random

    import numpy as np
    import pandas as pd

    rng = random.Random(7)
    rows = [{k: rng.choice([0, 1, 127, 128, 300, 2**31, 2**62]) for k in ("uid", "nonce", "price", "amount", "symbol", "op_code")} for _ in range(200)]
    assert codec.encode_orders({k: np.array([r[k] for r in rows]) for k in rows[0]}) == [codec.encode_order(r) for r in rows]
    messages = [codec.encode_order(r | {"signature": rng.choice([b"", b"s" * 64])}) for r in rows]
    messages += [bytes(rng.randrange(256) for _ in range(rng.randrange(12))) for _ in range(800)]
    messages += [m[: rng.randrange(len(m))] for m in messages[:100] if m] + [b"", bytes([9]) + bytes(8) + bytes([61, 1, 2, 3, 4]), bytes([0xFF] * 12), None]
    got = codec.parse_order.func(pd.Series(messages, dtype=object))
    ok = codec.wire_ok.func(pd.Series(messages, dtype=object)).tolist()
    for i, m in enumerate(messages):
        assert bool(ok[i]) == (m is not None and codec.scan_wire(m)), m
        try:
            want = codec.decode_order(m)
        except (ValueError, TypeError):
            want = None
        row = got.iloc[i]
        if want is None:
            assert pd.isna(row["uid"]) and row["signature"] is None, m
        elif all(isinstance(v, int) == (k != "signature") and (k == "signature" or v < 2**63) for k, v in want.items()):
            assert all(row[k] == v for k, v in want.items()), m
