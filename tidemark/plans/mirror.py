"""Queries of reconciliation, matching, blocks, generators and sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.operators import matching as mt
from tidemark.operators import mirror as mr
from tidemark.operators import orderbook as ob
from tidemark.operators import sketches, workload
from tidemark.plans.registry import query
from tidemark.plans.views import with_views
from tidemark.sources import tables as t


@query("mirror_diff", with_views("v_target v_managed", " SELECT coalesce(t.key, m.key) AS key, CASE WHEN m.key IS NULL THEN 'create' WHEN t.key IS NULL THEN 'cancel' WHEN abs(t.price - m.price) > 10 OR abs(t.qty - m.qty) > 1 THEN 'amend' ELSE 'keep' END AS action, coalesce(t.price, m.price) AS price, coalesce(t.qty, m.qty) AS qty FROM v_target t FULL JOIN v_managed m ON t.key = m.key"))
def mirror_diff(spark, d):
    return mr.reconcile(t.mirror_target(spark, d), t.mirror_managed(spark, d))


@query("mirror_outdated", with_views("v_target v_managed", " SELECT * FROM v_managed WHERE key NOT IN (SELECT key FROM v_target)"))
def mirror_outdated(spark, d):
    return mr.outdated(t.mirror_target(spark, d), t.mirror_managed(spark, d))


@query("mirror_levels", with_views("v_book", """, lv AS (SELECT side, price, sum(remaining) AS volume FROM v_book WHERE remaining > 0 GROUP BY side, price),
rk AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY CASE WHEN side = 'BUY' THEN -price ELSE price END) AS level FROM lv),
n AS (SELECT *, CASE WHEN price * volume > 1000000000000 THEN 10 ELSE 1 END AS n FROM rk WHERE level <= 11), s AS (SELECT *, unnest(range(n)) AS split FROM n)
SELECT side || '-lvl-' || level || '-split-' || split AS order_key, side, level::INTEGER AS level, split::INTEGER AS split, (price + CASE WHEN side = 'BUY' THEN -1 ELSE 1 END * split)::BIGINT AS price, (volume // n)::BIGINT AS qty FROM s"""))
def mirror_levels(spark, d):
    return mr.level_plan(ob.levels(t.book(spark, d)), split_above=10**12)


@query("scaled_prices", "SELECT p_partkey AS key, floor(p_retailprice * 1.37 * 100)::BIGINT AS created_price, round(p_retailprice * 1.37 * 100)::BIGINT AS amended_price FROM part")
def scaled_prices(spark, d):
    p, q = F.col("p_retailprice") * 1.37, F.lit(1.0)
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("key"), mr.to_ints(p, q, 2, 0, True)[0].alias("created_price"), mr.to_ints(p, q, 2, 0, False)[0].alias("amended_price"))


def _flow(spark, d):
    """Limit orders of both sides that cross, market orders, cancels and modifies, from the orders table."""
    b = t.book(spark, d)
    near = F.col("price") + F.when(F.col("side") == "BUY", 260).otherwise(-260)
    k = F.col("seq") % 20
    kind = F.when(k < 12, "limit").when(k < 15, "market").when(k < 17, "cancel").when(k < 19, "modify").otherwise("cancel_trader")
    own = F.when(kind.isin("cancel", "modify"), F.greatest(F.col("order_id") - 11, F.lit(0))).otherwise(F.col("order_id"))
    trader = F.when(kind == "cancel_trader", F.col("trader_id") % 50).otherwise(F.col("trader_id"))
    return b.select("symbol", "seq", kind.alias("kind"), own.alias("id"), trader.alias("trader"), "side", F.when(kind.isin("limit", "modify"), near).alias("price"), F.when(kind != "cancel", F.col("size")).alias("size"))


@query("match_stream")
def match_stream(spark, d):
    """Trades of a mixed flow; checked against a plain model of the book in the tests."""
    return mt.match(_flow(spark, d))


@query("match_no_cross", "SELECT 0 AS n_trades")
def match_no_cross(spark, d):
    """A book that isn't crossed trades nothing."""
    b = t.book(spark, d).select("symbol", "seq", F.lit("limit").alias("kind"), F.col("order_id").alias("id"), F.col("trader_id").alias("trader"), "side", "price", "size")
    return mt.match(b).agg(F.count(F.lit(1)).alias("n_trades"))


def _blocks(spark, d, size=500):
    tx = t.transactions(spark, d)
    body = F.concat_ws("|", *(F.col(c).cast("string") for c in ("uid", "nonce", "op_code", "market", "amount"))).cast("binary")
    return tx.select(F.floor(F.col("arrival") / size).alias("block"), F.col("arrival").alias("seq"), F.unhex(F.concat("sig", "sig")).alias("sig"), body.alias("body"))


BODY = "uid || '|' || nonce || '|' || op_code || '|' || market || '|' || amount"


@query("block_sizes", with_views("v_tx", f" SELECT arrival // 500 AS block, count(*) AS n, sum(1 + 1 + strlen({BODY}))::BIGINT AS raw_size FROM v_tx GROUP BY 1"))
def block_sizes(spark, d):
    return codec.encode_blocks(_blocks(spark, d)).select("block", "n", "raw_size")


@query("block_round_trip", with_views("v_tx", f" SELECT arrival // 500 AS block, sig, sha256({BODY}) AS body_hash FROM v_tx"))
def block_round_trip(spark, d):
    back = codec.decode_blocks(codec.encode_blocks(_blocks(spark, d)))
    return back.select("block", F.lower(F.substring(F.hex("sig"), 1, 64)).alias("sig"), F.sha2("body", 256).alias("body_hash"))


@query("compression_ratios")
def compression_ratios(spark, d):
    out = None
    for name in ("none", "zstd", "lz4", "s2", "gzip"):
        b = codec.encode_blocks(_blocks(spark, d), codec=name).agg(F.lit(name).alias("codec"), F.sum("raw_size").alias("raw_size"), F.sum(F.length("data")).alias("packed_size"))
        out = b if out is None else out.unionByName(b)
    return out.withColumn("ratio", F.col("raw_size") / F.col("packed_size"))


@query("raw_tx_sizes", with_views("v_tx", f" SELECT sum(strlen({BODY}))::BIGINT AS n_bytes, avg(strlen({BODY})) AS mean_bytes FROM v_tx"))
def raw_tx_sizes(spark, d):
    return _blocks(spark, d).agg(F.sum(F.length("body")).alias("n_bytes"), F.avg(F.length("body")).alias("mean_bytes"))


@query("message_round_trip", with_views("v_tx", " SELECT arrival, uid, nonce, amount, op_code, true AS wire_ok FROM v_tx"))
def message_round_trip(spark, d):
    """Messages written and read in wire format, and scanned."""
    m = codec.order_message("uid", "nonce", F.col("amount") + 1, "amount", "market", "op_code")
    rows = t.transactions(spark, d).select("arrival", m.alias("m"))
    return rows.select("arrival", codec.parse_order("m").alias("p"), codec.wire_ok("m").alias("wire_ok")).select("arrival", "p.uid", "p.nonce", "p.amount", F.col("p.op_code").cast("int").alias("op_code"), "wire_ok")


@query("dictionary_samples", with_views("v_tx", " SELECT (k - 1) % 100 AS sample, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY arrival) AS k FROM v_tx) GROUP BY 1"))
def dictionary_samples(spark, d):
    """Transactions dealt to sample files for a dictionary."""
    from tidemark.operators.txflow import batches

    return batches(t.transactions(spark, d), 1).groupBy((F.col("batch") % 100).alias("sample")).agg(F.count(F.lit(1)).alias("n"))


@query("signature_membership", with_views("v_tx", ", m AS (SELECT max(arrival) // 2 AS half FROM v_tx) SELECT count(DISTINCT sig) FILTER (arrival < half) AS n_known, count(*) FILTER (arrival >= half AND sig IN (SELECT sig FROM v_tx, m WHERE arrival < half)) AS n_hit FROM v_tx, m"))
def signature_membership(spark, d):
    """A bitmap filter first, exact lookups for what passes it: the second half of the arrivals against the first."""
    tx = t.transactions(spark, d)
    half = tx.agg(F.max("arrival").alias("half")).select(F.floor(F.col("half") / 2).alias("half"))
    tx = tx.crossJoin(F.broadcast(half))
    known, probes = tx.filter("arrival < half").select("sig").distinct(), tx.filter("arrival >= half")
    hit = sketches.filtered_semi_join(probes, known, "sig")
    return known.agg(F.count(F.lit(1)).alias("n_known")).join(hit.agg(F.count(F.lit(1)).alias("n_hit")))


@query("generated_transactions")
def generated_transactions(spark, d):
    return workload.transactions(spark, workload.ROUND)


@query("generated_counts", "SELECT * FROM (VALUES (0, 200), (31, 100), (61, 30000), (62, 20000), (63, 2000), (64, 6000), (65, 50000)) o(op_code, n)")
def generated_counts(spark, d):
    """Two rounds have every operation as often as it is meant to be there."""
    return workload.transactions(spark, 2 * workload.ROUND).groupBy("op_code").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("generated_traders")
def generated_traders(spark, d):
    return workload.traders(spark, 20_000)


@query("generated_orders")
def generated_orders(spark, d):
    return workload.order_flow(spark, 20_000)


@query("generated_mix", "SELECT * FROM (VALUES ('cancel', 4000), ('limit', 7000), ('market', 5000), ('modify', 4000)) m(kind, n)")
def generated_mix(spark, d):
    """The mix of a generated flow: a quarter market, 35 % limit, a fifth each of cancels and modifies."""
    return workload.order_flow(spark, 20_000).groupBy("kind").agg(F.count(F.lit(1)).cast("int").alias("n"))
