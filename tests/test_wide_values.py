"""Gaps, ids beyond 32 bits, many tables, large volumes, folders of files and streams of several batches."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.operators import merkle as mk
from tidemark.operators import orderbook as ob
from tidemark.operators import txflow
from tidemark.streaming import ingest


def test_bursts_over_gaps(spark):
    rng = random.Random(3)
    arrivals = sorted(rng.sample(range(100_000), 600))
    rows = [(a, rng.choice([1, 1, 1, 2])) for a in arrivals]
    want, last, n = [], None, 0
    for a, u in rows:
        if u != last or n == 3:
            want.append([a, u, 0])
            last, n = u, 0
        n += 1
        want[-1][2] += 1
    got = sorted(list(r) for r in txflow.bursts(spark.createDataFrame(rows, "arrival long, uid long"), 3).collect())
    assert got == want


def test_running_sums_of_uneven_ranges(spark):
    rng = random.Random(4)
    keys = sorted(set(rng.sample(range(1000), 300)) | {10**15 + i for i in range(20)} | {-(10**12)})
    rows = [(k, rng.randrange(100), rng.choice([None, k])) for k in keys]
    df = spark.createDataFrame(rows, "k long, v long, w long")
    total, last, sums, lasts = 0, None, {}, {}
    for k, v, w in rows:
        total += v
        last = w if w is not None else last
        sums[k], lasts[k] = total, last
    assert {r["k"]: r["running"] for r in ob.running_sum(df, "k", "v").collect()} == sums
    assert {r["k"]: r["w"] for r in ob.running_last(df, "k", ["w"]).collect()} == lasts


@pytest.mark.parametrize("side", ["BUY", "SELL"])
def test_sweep_of_large_volumes(spark, side):
    rng = random.Random(5)
    other = "SELL" if side == "BUY" else "BUY"
    sizes = [10**13, 1, 1, 1, 5, 10**12, *(rng.randrange(1, 9) for _ in range(200))]
    orders = [(i, i, 7 + i % 3, other, 100 + i % 5, s, 0, s, 1, 101) for i, s in enumerate(sizes)]
    orders.append((9000, 9000, 1, side, 50, 77, 0, 77, 1, 101))
    takers = [(i, rng.choice([1, 3, 0, 10**11, 10**12]), i) for i in range(60)]
    book = spark.createDataFrame(orders, "order_id long, seq long, trader_id long, side string, price long, size long, filled long, remaining long, slot int, symbol long")
    got = sorted(tuple(r) for r in ob.sweep(book, spark.createDataFrame(takers, "taker_id long, size long, arrival long"), side).collect())
    queue = [[r["order_id"], r["trader_id"], r["price"], r["remaining"]] for r in ob.execution_rank(book.filter(F.col("side") == other)).orderBy("depth").collect()]
    want = []
    for taker, size, _ in takers:
        while size and queue:
            m = queue[0]
            n = min(size, m[3])
            size, m[3] = size - n, m[3] - n
            want.append((taker, m[0], m[1], m[2], n, size > 0, m[3] > 0))
            if not m[3]:
                queue.pop(0)
    assert got == sorted(want) and want


def test_tree_keeps_ids_beyond_32_bits_apart(spark):
    rows = [("a", 5, "x"), ("a", 5 + (1 << 32), "y"), ("a", 6, "z")]
    store = spark.createDataFrame(rows, "tree string, id long, value string")
    nodes = mk.all_nodes(store)
    gone = mk.leaves(store.filter("id = 5")).withColumn("hash", F.lit(None).cast("string"))
    left = mk.update_nodes(nodes, gone)
    assert left.filter("depth = 8").count() == 2
    assert left.filter("depth = 0").first()["hash"] == mk.tree_roots(store.filter("id <> 5")).first()["root"]
    with pytest.raises(Exception, match="needs more than 4 bytes"):
        mk.leaves(store, 4).collect()
    assert mk.leaves(store.filter("id < 100"), 4).count() == 2


def test_fold_of_many_tables(spark):
    n = 70_000
    names = [f"{i:06d}" for i in range(n)]
    level = [hashlib.sha256(x.encode()).hexdigest() for x in names]
    roots = spark.createDataFrame(list(zip(names, level, strict=True)), "tree string, root string")
    while len(level) > 1:
        level += [mk.ZERO] * (len(level) % 2)
        level = [hashlib.sha256(bytes.fromhex(a + b)).hexdigest() for a, b in zip(level[::2], level[1::2], strict=True)]
    assert mk.global_root(roots).first()["global_root"] == level[0]


def test_state_root_in_levels(spark):
    rng = random.Random(6)
    keys = sorted({rng.randrange(1 << k) for k in (3, 12, 30, 40, 62, 63) for _ in range(40)})
    rows = [(k, k % 97, k % 5 == 0) for k in keys]
    level = [(k, b"\xde\xad" if gone else hashlib.sha256(str(v).encode()).digest()) for k, v, gone in rows]
    for _ in range(mk.KEY_LEVELS):
        parts = {}
        for k, h in level:
            parts.setdefault(k >> mk.KEY_BITS, []).append(k.to_bytes(8) + h)
        level = [(p, hashlib.sha256(b"".join(x)).digest()) for p, x in sorted(parts.items())]
    df = spark.createDataFrame(rows, "k long, v long, gone boolean")
    assert mk.state_root(df, "k", F.col("v"), F.col("gone")).first()["state_root"] == level[0][1].hex()


def test_block_layout():
    sig, body = bytes(range(64)), b"hello"
    block = codec.encode_block([(sig, body), (b"", b"")], "none")
    bodies = bytes([codec.MARK, 5]) + body + bytes([codec.MARK, 0])
    assert block == bytes([codec.MAGIC, 0]) + (2).to_bytes(8, "little") + len(bodies).to_bytes(8, "little") * 2 + sig + bytes(64) + bodies
    assert codec.decode_block(block) == [(sig, body), (bytes(64), b"")]
    with pytest.raises(ValueError, match="signature 0"):
        codec.encode_block([(b"short", body)])
    with pytest.raises(ValueError, match="after the last"):
        codec.decode_block(codec.encode_block([(sig, body)], "none").replace((7).to_bytes(8, "little") * 2, (8).to_bytes(8, "little") * 2) + b"x")


def test_streams_of_several_batches(spark, tmp_path):
    """A folder of part files, one a batch: signatures and nonces are remembered across batches and hours."""
    rows = [(i, i % 4, "view", f"2024-01-0{1 + i // 10} 00:00:00", 1.0, '{"k": 1}') for i in range(1, 40)]
    schema = "event_id long, user_id int, event_type string, ts string, value double, props string"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for day in range(4):
        df.filter(F.floor(F.col("event_id") / 10) == day).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    tx = ingest.as_transactions(ingest.event_stream(spark, str(tmp_path)))
    seen = tx.withColumn("sig", F.when(F.col("arrival") % 10 < 3, F.lit("again")).otherwise(F.col("sig")))
    out = spark.read.parquet(ingest.run(ingest.without_duplicates(seen).select("sig", "arrival")))
    assert out.filter("sig = 'again'").count() == 1
    assert out.count() == out.select("sig").distinct().count()
    got = {(r["uid"], r["nonce"]) for r in spark.read.parquet(ingest.run(ingest.monotonic(tx))).collect()}
    best, want = {}, set()
    for i, u, *_ in rows:
        nonce = i + (i * 7919) % 50
        if nonce > best.get(u + 1, 0):
            best[u + 1] = nonce
            want.add((u + 1, nonce))
    assert got == want
