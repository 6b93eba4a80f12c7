"""Queries over the transaction stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import encoding as enc
from tidemark.operators import txflow as tx
from tidemark.plans.registry import query
from tidemark.plans.views import with_views
from tidemark.sources import tables as t


def sql(body: str, views: str = "v_tx") -> str:
    return with_views(views, body)


@query("distinct_signatures", sql(" SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY arrival) AS k FROM v_tx) WHERE k = 1"))
def distinct_signatures(spark, d):
    return tx.first_by(t.transactions(spark, d), "sig")


@query("duplicate_signatures", sql(" SELECT arrival, uid, sig FROM (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY arrival) AS k FROM v_tx) WHERE k > 1"))
def duplicate_signatures(spark, d):
    return tx.duplicates(t.transactions(spark, d)).select("arrival", "uid", "sig")


GATE = ", g AS (SELECT v_tx.*, CASE WHEN row_number() OVER (PARTITION BY sig ORDER BY arrival) > 1 THEN 'duplicate' WHEN v_tx.uid NOT BETWEEN 3 AND (SELECT max(uid) FROM v_users) THEN 'bad_uid' WHEN u.uid IS NULL THEN 'unknown_user' END AS reject_reason FROM v_tx LEFT JOIN v_users u ON u.uid = v_tx.uid)"


def _gate(spark, d):
    users = t.users(spark, d)
    return tx.gate(t.transactions(spark, d), users, 3, users.agg(F.max("uid")).first()[0])


@query("ingest_gate", sql(GATE + " SELECT arrival, uid, reject_reason FROM g", "v_tx v_users"))
def ingest_gate(spark, d):
    return _gate(spark, d).select("arrival", "uid", "reject_reason")


@query("reject_counts", sql(GATE + " SELECT coalesce(reject_reason, 'accepted') AS reason, count(*) AS n FROM g GROUP BY ALL", "v_tx v_users"))
def reject_counts(spark, d):
    return _gate(spark, d).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("tx_with_user", sql(" SELECT arrival, uid, nonce, init_nonce FROM v_tx JOIN v_users USING (uid)", "v_tx v_users"))
def tx_with_user(spark, d):
    return t.transactions(spark, d).join(t.users(spark, d), "uid").select("arrival", "uid", "nonce", "init_nonce")


@query("unknown_users", sql(" SELECT arrival, uid FROM v_tx WHERE uid NOT IN (SELECT uid FROM v_users)", "v_tx v_users"))
def unknown_users(spark, d):
    return t.transactions(spark, d).join(t.users(spark, d), "uid", "left_anti").select("arrival", "uid")


@query("monotonic_nonces", sql(", s AS (SELECT v_tx.*, init_nonce, max(nonce) OVER (PARTITION BY uid ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM v_tx JOIN v_users USING (uid)) SELECT arrival, uid, nonce FROM s WHERE nonce > greatest(coalesce(seen, init_nonce), init_nonce)", "v_tx v_users"))
def monotonic_nonces(spark, d):
    return tx.monotonic_nonces(t.transactions(spark, d), t.users(spark, d)).select("arrival", "uid", "nonce")


@query("late_nonces", sql(", s AS (SELECT v_tx.*, init_nonce, max(nonce) OVER (PARTITION BY uid ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM v_tx JOIN v_users USING (uid)) SELECT uid, count(*) AS n_late FROM s WHERE nonce <= greatest(coalesce(seen, init_nonce), init_nonce) GROUP BY uid", "v_tx v_users"))
def late_nonces(spark, d):
    all_ = t.transactions(spark, d).join(t.users(spark, d), "uid", "left_semi")
    return all_.join(tx.monotonic_nonces(t.transactions(spark, d), t.users(spark, d)).select("arrival"), "arrival", "left_anti").groupBy("uid").agg(F.count(F.lit(1)).alias("n_late"))


@query("contiguous_nonces")
def contiguous_nonces(spark, d):
    """The user's transactions renumbered so that gaps of the stream's own numbering can fill."""
    from pyspark.sql import Window

    rows = t.transactions(spark, d).withColumn("nonce", F.row_number().over(Window.partitionBy("uid").orderBy("nonce", "arrival")).cast("bigint"))
    return tx.contiguous_nonces(rows, t.users(spark, d))


@query("user_bursts", sql(", m AS (SELECT arrival, uid, CASE WHEN lag(uid) OVER (ORDER BY arrival) IS DISTINCT FROM uid THEN 1 ELSE 0 END AS new FROM v_tx), r AS (SELECT *, sum(new) OVER (ORDER BY arrival) AS run FROM m), s AS (SELECT *, (row_number() OVER (PARTITION BY run ORDER BY arrival) - 1) // 50 AS part FROM r) SELECT min(arrival) AS burst_start, uid, count(*) AS n FROM s GROUP BY run, part, uid"))
def user_bursts(spark, d):
    return tx.bursts(t.transactions(spark, d))


for _size in (100, 512):

    def _batches(spark, d, size=_size):
        b = tx.batches(t.transactions(spark, d), size)
        return b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("arrival").alias("first_arrival"), F.sum("amount").alias("amount"))

    query(f"batches_of_{_size}", sql(f", b AS (SELECT *, (row_number() OVER (ORDER BY arrival) - 1) // {_size} AS batch FROM v_tx) SELECT batch, count(*) AS n, min(arrival) AS first_arrival, sum(amount)::BIGINT AS amount FROM b GROUP BY batch"))(_batches)


@query("batch_verdicts", sql(", b AS (SELECT *, (row_number() OVER (ORDER BY arrival) - 1) // 100 AS batch FROM v_tx) SELECT batch, bool_and(amount % 97 <> 0) AS valid, count(*) AS n FROM b GROUP BY batch"))
def batch_verdicts(spark, d):
    return tx.batch_verdicts(t.transactions(spark, d), 100, F.col("amount") % 97 != 0)


@query("route_by_user", sql(" SELECT arrival, uid, (CASE WHEN uid = 42 THEN 7 % 8 WHEN uid <= 10 THEN 0 ELSE 1 + uid % 7 END)::INTEGER AS shard FROM v_tx"))
def route_by_user(spark, d):
    return t.transactions(spark, d).select("arrival", "uid", tx.route_user(F.col("uid"), 8, 10, {42: 7}).alias("shard"))


@query("route_by_market", sql(" SELECT (CASE WHEN uid <= 100 THEN 0 WHEN market BETWEEN 1 AND 64 THEN market ELSE 65 + market % 16 END)::INTEGER AS worker, count(*) AS n, min(arrival) AS first_arrival, max(arrival) AS last_arrival FROM v_tx GROUP BY 1"))
def route_by_market(spark, d):
    rows = tx.ordered_by_worker(t.transactions(spark, d), tx.route_market(F.col("uid"), F.col("market"), 100, 16))
    return rows.groupBy("worker").agg(F.count(F.lit(1)).alias("n"), F.min("arrival").alias("first_arrival"), F.max("arrival").alias("last_arrival"))


@query("execution_results", sql(" SELECT arrival, (CASE WHEN uid <= 100 THEN 0 WHEN market BETWEEN 1 AND 64 THEN market ELSE 65 + market % 16 END)::INTEGER AS worker, sha256(sig || ':' || nonce::VARCHAR) AS tx_hash, CASE WHEN op_code = 62 THEN 'failed' END AS error FROM v_tx"))
def execution_results(spark, d):
    rows = t.transactions(spark, d)
    return rows.select("arrival", tx.route_market(F.col("uid"), F.col("market"), 100, 16).alias("worker"), F.sha2(F.concat("sig", F.lit(":"), F.col("nonce").cast("string")), 256).alias("tx_hash"), F.when(F.col("op_code") == 62, "failed").alias("error"))


@query("duplicate_alarm", sql(", x AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY arrival) AS k FROM v_tx), n AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, count(*) AS n_dup FROM x WHERE k > 1 GROUP BY 1) SELECT window_start, n_dup, coalesce(last_value(CASE WHEN n_dup > 2 THEN true WHEN n_dup < 1 THEN false END IGNORE NULLS) OVER (ORDER BY window_start ROWS UNBOUNDED PRECEDING), false) AS alarm FROM n"))
def duplicate_alarm(spark, d):
    return tx.duplicate_alarm(t.transactions(spark, d), "1 hour", 2, 1)


@query("within_skew", sql(" SELECT arrival, ts FROM v_tx WHERE abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-03 00:00:00')) <= 3600000000"))
def within_skew(spark, d):
    return tx.within_skew(t.transactions(spark, d), F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"), 3600).select("arrival", "ts")


@query("height_window", sql(" SELECT arrival FROM v_tx WHERE 5000 BETWEEN nonce - 1000 AND nonce + 1000"))
def height_window(spark, d):
    return t.transactions(spark, d).filter(F.lit(5000).between(F.col("nonce") - 1000, F.col("nonce") + 1000)).select("arrival")


@query("op_counts", sql(" SELECT op_code, count(*) AS n, count(DISTINCT uid) AS n_users, sum(amount)::BIGINT AS amount FROM v_tx GROUP BY op_code"))
def op_counts(spark, d):
    return t.transactions(spark, d).groupBy("op_code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("uid").alias("n_users"), F.sum("amount").alias("amount"))


@query("item_counts", "SELECT l_orderkey % 8 AS op_code, count(DISTINCT l_orderkey) AS n_tx, count(*) AS n_items FROM lineitem GROUP BY 1")
def item_counts(spark, d):
    """Transactions against the items that their payloads hold."""
    return t.items(spark, d).groupBy((F.col("tx_id") % 8).alias("op_code")).agg(F.count(F.lit(1)).alias("n_tx"), F.sum(F.size("items")).cast("bigint").alias("n_items"))


@query("expand_batches", "SELECT l_orderkey AS tx_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, round(l_extendedprice * 100)::BIGINT, l_quantity::BIGINT) - 1)::INTEGER AS item_index, l_partkey AS part, l_quantity::BIGINT AS quantity FROM lineitem")
def expand_batches(spark, d):
    return tx.expand_batches(t.items(spark, d)).select("tx_id", "item_index", F.col("item.l_partkey").alias("part"), F.col("item.quantity").alias("quantity"))


@query("first_order_id", "SELECT l_orderkey AS tx_id, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1")
def first_order_id(spark, d):
    """The id of the first item of a payload stands for all."""
    return t.items(spark, d).select("tx_id", F.col("items")[0]["l_linenumber"].alias("first_line"))


MESSAGE = ", msg AS (SELECT doc_id, encode(coalesce(text, '')) AS m FROM documents)"


@query("message_split", "WITH msg AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents) SELECT doc_id, CASE WHEN length(h) > 128 THEN sha256(unhex(substr(h, 1, 128))) END AS sig_hash, CASE WHEN length(h) > 128 THEN sha256(unhex(substr(h, 129))) END AS body_hash FROM msg")
def message_split(spark, d):
    sig, body = tx.split_message(F.coalesce("text", F.lit("")).cast("binary"))
    return t.table(spark, d, "documents").select("doc_id", F.sha2(sig, 256).alias("sig_hash"), F.sha2(body, 256).alias("body_hash"))


@query("header_scan", "WITH msg AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents) SELECT doc_id, substr(h, 1, 2) IN ('0A', '12') AND length(h) BETWEEN 4 AND 16777216 AS plausible FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '0A' || h ELSE h END AS h FROM msg)")
def header_scan(spark, d):
    body = F.coalesce("text", F.lit("")).cast("binary")
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("0A")), body)).otherwise(body)
    return t.table(spark, d, "documents").select("doc_id", tx.header_scan(body).alias("plausible"))


@query("uuid7_check", """WITH e AS (SELECT event_id, round(epoch_us(ts) / 1000)::BIGINT AS ms, sha256(event_id::VARCHAR) AS h, CASE WHEN event_id % 7 = 0 THEN '4' ELSE '7' END AS v, CASE WHEN event_id % 11 = 0 THEN 'C' ELSE '8' END AS r FROM events)
SELECT event_id, v = '7' AND r = '8' AND abs(ms - 1704243600000) <= 3600000 AS valid, ms AS embedded_ms FROM e""")
def uuid7_check(spark, d):
    """Times and marks of UUIDs, some of them of the wrong version or variant."""
    e = t.table(spark, d, "events")
    digits = F.hex(enc.uuid7(F.round(enc.epoch_micros(F.col("ts")) / 1000), F.col("event_id")))
    version = F.when(F.col("event_id") % 7 == 0, "4").otherwise("7")
    variant = F.when(F.col("event_id") % 11 == 0, "C").otherwise("8")
    id_ = F.unhex(F.concat(F.substring(digits, 1, 12), version, F.substring(digits, 14, 3), variant, F.substring(digits, 18, 15)))
    return e.select("event_id", enc.uuid7_valid(id_, F.lit(1704243600000), 3_600_000).alias("valid"), enc.uuid7_ms(id_).alias("embedded_ms"))


@query("topic_symbol", "SELECT event_id, 'S' || (user_id % 5)::VARCHAR AS symbol FROM events WHERE user_id % 5 < 3")
def topic_symbol(spark, d):
    """The symbol in a topic's third part, for the symbols that are followed."""
    topic = F.format_string("orderbook.50.S%d", (F.col("user_id") % 5).cast("int"))
    rows = t.table(spark, d, "events").select("event_id", F.split(topic, "\\.")[2].alias("symbol"))
    return rows.filter(F.col("symbol").isin("S0", "S1", "S2"))


@query("price_pairs", "SELECT event_id, value AS price, (event_id % 10)::DOUBLE AS qty FROM events WHERE event_id % 4 <> 0")
def price_pairs(spark, d):
    """Levels as pairs of strings in JSON; those without two parts go."""
    pair = F.when(F.col("event_id") % 4 == 0, F.format_string('["%s"]', F.col("value").cast("string"))).otherwise(F.format_string('["%s","%d"]', F.col("value").cast("string"), F.col("event_id") % 10))
    rows = t.table(spark, d, "events").select("event_id", F.explode(F.from_json(F.concat(F.lit("["), pair, F.lit("]")), "array<array<string>>")).alias("p"))
    return rows.filter(F.size("p") == 2).select("event_id", F.col("p")[0].try_cast("double").alias("price"), F.col("p")[1].try_cast("double").alias("qty"))


@query("last_per_second", with_views("v_ticks", " SELECT date_trunc('minute', ts) AS minute, extract(second FROM ts)::INTEGER AS second, arg_max(price, arrival) AS price FROM v_ticks GROUP BY 1, 2").replace("extract(second FROM ts)::INTEGER", "date_part('second', ts)::INTEGER"))
def last_per_second(spark, d):
    return tx.last_per_second(t.ticks(spark, d))


@query("minute_occupancy", with_views("v_ticks", " SELECT hour(ts)::INTEGER AS hour, minute(ts)::INTEGER AS minute, count(DISTINCT second(ts))::INTEGER AS slots FROM v_ticks GROUP BY 1, 2"))
def minute_occupancy(spark, d):
    return tx.occupancy(t.ticks(spark, d))


@query("pipeline_report", sql(" SELECT count(*) AS n_tx, count(DISTINCT uid) AS n_users, count(DISTINCT market) AS n_markets, avg(amount) AS mean_amount, (count(*) / (epoch(max(ts)) - epoch(min(ts))))::DOUBLE AS per_second FROM v_tx"))
def pipeline_report(spark, d):
    span = (enc.epoch_micros(F.max("ts")) - enc.epoch_micros(F.min("ts"))) / 1e6
    return t.transactions(spark, d).agg(F.count(F.lit(1)).alias("n_tx"), F.count_distinct("uid").alias("n_users"), F.count_distinct("market").alias("n_markets"), F.avg("amount").alias("mean_amount"), (F.count(F.lit(1)) / span).alias("per_second"))


@query("pipeline_stages", sql(GATE + """, s AS (SELECT v_tx.*, row_number() OVER (PARTITION BY sig ORDER BY arrival) AS k, g.reject_reason FROM v_tx JOIN g USING (arrival)),
u AS (SELECT 1 AS stage, amount FROM v_tx UNION ALL SELECT 2, amount FROM s WHERE k = 1 UNION ALL SELECT 3, amount FROM s WHERE reject_reason IS NULL)
SELECT stage, count(*) AS n, avg(amount) AS mean_amount, count(*) / (SELECT count(*) FROM v_tx)::DOUBLE AS share FROM u GROUP BY stage""".replace("SELECT v_tx.*, row_number() OVER (PARTITION BY sig ORDER BY arrival) AS k, g.reject_reason", "SELECT v_tx.amount, row_number() OVER (PARTITION BY v_tx.sig ORDER BY arrival) AS k, g.reject_reason"), "v_tx v_users"))
def pipeline_stages(spark, d):
    """What each stage of the gate passes on, observed as one run goes by."""
    from pyspark.sql import Observation

    rows = _gate(spark, d)
    seen = {1: Observation(), 2: Observation(), 3: Observation()}
    mark = lambda cond: (F.count_if(cond).alias("n"), F.avg(F.when(cond, F.col("amount"))).alias("mean"))
    once = F.coalesce(F.col("reject_reason") != "duplicate", F.lit(True))
    for stage, cond in ((1, F.lit(True)), (2, once), (3, F.col("reject_reason").isNull())):
        rows = rows.observe(seen[stage], *mark(cond))
    rows.write.format("noop").mode("overwrite").save()
    got = {k: o.get for k, o in seen.items()}
    return spark.createDataFrame([(k, v["n"], v["mean"], v["n"] / got[1]["n"]) for k, v in got.items()], "stage int, n long, mean_amount double, share double")


@query("shuffled_stream")
def shuffled_stream(spark, d):
    """A random but repeatable order."""
    return t.transactions(spark, d).withColumn("position_key", F.xxhash64(F.lit(7), "arrival")).orderBy("position_key")
