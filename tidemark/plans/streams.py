"""Queries that run a stream to its end and read what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import keyed as kv
from tidemark.operators import merkle as mk
from tidemark.plans.integrity import TREES
from tidemark.plans.registry import query
from tidemark.plans.views import with_views
from tidemark.sources import tables as t
from tidemark.sources.storage import Snapshots, scratch_dir
from tidemark.streaming import ingest


@query("stream_dedup", with_views("v_tx", " SELECT DISTINCT sig FROM v_tx"))
def stream_dedup(spark, d):
    return spark.read.parquet(ingest.run(ingest.without_duplicates(ingest.as_transactions(ingest.event_stream(spark, d))).select("sig")))


@query("stream_bounds", with_views("v_tx", " SELECT arrival, ts FROM v_tx WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' + INTERVAL 60 SECOND"))
def stream_bounds(spark, d):
    """Transactions of a stream that aren't more than a minute ahead of a clock."""
    tx = ingest.within_bounds(ingest.as_transactions(ingest.event_stream(spark, d)), now=F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return spark.read.parquet(ingest.run(tx.select("arrival", "ts"))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_window_counts", "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark, d):
    out = spark.read.parquet(ingest.run(ingest.window_counts(ingest.as_transactions(ingest.event_stream(spark, d))), "complete"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_monotonic", with_views("v_tx", ", s AS (SELECT *, max(nonce) OVER (PARTITION BY uid ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM v_tx) SELECT arrival, uid, nonce FROM s WHERE nonce > greatest(coalesce(seen, 0), 0)"))
def stream_monotonic(spark, d):
    return spark.read.parquet(ingest.run(ingest.monotonic(ingest.as_transactions(ingest.event_stream(spark, d)))))


@query("stream_upserts", with_views("v_changes", ", l AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value, max(seq) AS seq FROM v_changes GROUP BY key) SELECT key, value, seq FROM l WHERE op <> 'delete'"))
def stream_upserts(spark, d):
    """Batches of changes written as they come, and read as the latest state."""
    base = scratch_dir(spark)
    events = ingest.event_stream(spark, d)
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    log = events.select(F.col("user_id").cast("bigint").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), t.cents(F.col("value")).alias("value"))
    log.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}-state").foreachBatch(ingest.upsert_sink(base)).start().awaitTermination()
    return kv.latest(spark.read.parquet(base).select("key", "seq", "op", "value"))


@query("snapshot_time_travel", "SELECT lang AS tree, doc_id AS id, strlen(text) AS n_bytes FROM documents WHERE doc_id % 2 = 0")
def snapshot_time_travel(spark, d):
    """Two versions are written; the first is read."""
    s, store = Snapshots(spark, scratch_dir(spark)), t.store(spark, d)
    s.create(store.filter("id % 2 = 0"), "a1", 1)
    s.create(store.filter("id % 3 = 0"), "b2", 2)
    return s.load("a1").select("tree", "id", F.octet_length("value").cast("long").alias("n_bytes"))


@query("snapshot_versions", "SELECT 'b2' AS last, 'a1' AS first, 2::BIGINT AS n_versions, (count(*) FILTER (doc_id % 2 = 0) + count(*) FILTER (doc_id % 3 = 0))::BIGINT AS n_rows FROM documents")
def snapshot_versions(spark, d):
    s, store = Snapshots(spark, scratch_dir(spark)), t.store(spark, d)
    s.create(store.filter("id % 2 = 0"), "a1", 1)
    s.create(store.filter("id % 3 = 0"), "b2", 2)
    return s.stats()


@query("report_json", with_views("v_book", " SELECT side, count(*) AS n FROM (SELECT DISTINCT side, price FROM v_book WHERE remaining > 0) GROUP BY side"))
def report_json(spark, d):
    """A report written as JSON and read again."""
    from tidemark.operators import orderbook as ob

    path = scratch_dir(spark)
    ob.tree_stats(t.book(spark, d)).filter("side <> 'BOOK'").write.json(path)
    return spark.read.schema("side string, n_levels long").json(path).select("side", F.col("n_levels").alias("n"))


@query("report_text", with_views("v_book", " SELECT side, count(DISTINCT price) AS n_levels, count(*) AS n_orders, sum(remaining)::BIGINT AS volume FROM v_book WHERE remaining > 0 GROUP BY side"))
def report_text(spark, d):
    """A report as lines of text, read again."""
    from tidemark.operators import orderbook as ob

    path = scratch_dir(spark)
    rows = ob.tree_stats(t.book(spark, d)).filter("side <> 'BOOK'")
    rows.select(F.format_string("%s levels=%d orders=%d volume=%d", "side", "n_levels", "n_orders", "volume").alias("line")).write.text(path)
    number = lambda name: F.regexp_extract("value", f"{name}=(\\d+)", 1).cast("bigint").alias(f"n_{name}" if name != "volume" else name)
    return spark.read.text(path).select(F.split("value", " ")[0].alias("side"), number("levels"), number("orders"), number("volume"))


@query("tagged_roots", with_views("v_store", TREES + " SELECT tree AS tag, hash AS root FROM n0"))
def tagged_roots(spark, d):
    """Two batches of roots published under tags; the last one of a tag counts."""
    path, store = scratch_dir(spark), t.store(spark, d)
    for number, rows in enumerate((store.filter("id < 100"), store)):
        mk.tree_roots(rows).select(F.col("tree").alias("tag"), F.lit(number).alias("batch"), "root").write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("tag").agg(F.max_by("root", "batch").alias("root"))
