"""Queries over the order book."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import orderbook as ob
from tidemark.plans.registry import query
from tidemark.plans.views import with_views
from tidemark.sources import tables as t

LIVE = ", live AS (SELECT * FROM v_book WHERE remaining > 0)"
LEVELS = LIVE + ", lv AS (SELECT side, price, sum(remaining)::BIGINT AS volume, count(*) AS n_orders FROM live GROUP BY side, price)"
RANKED = LEVELS + ", rk AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY CASE WHEN side = 'BUY' THEN -price ELSE price END) AS level FROM lv)"


def sql(body: str, views: str = "v_book") -> str:
    return with_views(views, body)


@query("price_levels", sql(LEVELS + " SELECT * FROM lv"))
def price_levels(spark, d):
    return ob.levels(t.book(spark, d))


@query("slot_levels", sql(LIVE + " SELECT side, price, slot, sum(remaining)::BIGINT AS volume, count(*) AS n_orders FROM live GROUP BY side, price, slot"))
def slot_levels(spark, d):
    return ob.slot_levels(t.book(spark, d))


_PIVOT = ", ".join(f"coalesce(sum(remaining) FILTER (slot = {i}), 0)::BIGINT AS s{i}" for i in range(16))


@query("slot_pivot", sql(LIVE + f" SELECT side, price, {_PIVOT} FROM live GROUP BY side, price"))
def slot_pivot(spark, d):
    return ob.slot_pivot(t.book(spark, d))


@query("best_prices", sql(LIVE + ", b AS (SELECT max(price) FILTER (side = 'BUY') AS best_bid, min(price) FILTER (side = 'SELL') AS best_ask FROM live) SELECT *, best_ask - best_bid AS spread, coalesce(best_bid >= best_ask, false) AS crossed FROM b"))
def best_prices(spark, d):
    return ob.best_prices(t.book(spark, d))


@query("book_tree_stats", sql(LEVELS + " SELECT coalesce(side, 'BOOK') AS side, count(*) AS n_levels, sum(n_orders)::BIGINT AS n_orders, sum(volume)::BIGINT AS volume FROM lv GROUP BY ROLLUP (side)"))
def book_tree_stats(spark, d):
    return ob.tree_stats(t.book(spark, d))


@query("book_counters", sql(" SELECT count(*) AS n_orders, count(*) FILTER (remaining = 0) AS n_filled, count(*) FILTER (filled > 0 AND remaining > 0) AS n_partial, count(*) FILTER (filled = 0) AS n_open, sum(filled)::BIGINT AS matched_volume FROM v_book"))
def book_counters(spark, d):
    return ob.counters(t.book(spark, d))


@query("execution_rank", sql(LIVE + " SELECT order_id, side, row_number() OVER w AS rank, sum(remaining) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS depth FROM live WINDOW w AS (PARTITION BY side ORDER BY CASE WHEN side = 'BUY' THEN -price ELSE price END, slot, seq)"))
def execution_rank(spark, d):
    return ob.execution_rank(t.book(spark, d)).select("order_id", "side", "rank", "depth")


@query("fifo_position", sql(LIVE + " SELECT order_id, row_number() OVER (PARTITION BY side, price, slot ORDER BY seq)::INTEGER AS position FROM live"))
def fifo_position(spark, d):
    return ob.fifo_position(t.book(spark, d)).select("order_id", "position")


@query("level_depth", sql(RANKED + " SELECT side, price, volume, n_orders, level::INTEGER AS level, sum(volume) OVER (PARTITION BY side ORDER BY level)::BIGINT AS cum_volume FROM rk"))
def level_depth(spark, d):
    return ob.level_depth(t.book(spark, d))


@query("top_levels", sql(RANKED + " SELECT side, price, volume, n_orders, level::INTEGER AS level FROM rk WHERE level <= 10"))
def top_levels(spark, d):
    return ob.top_levels(t.book(spark, d), 10)


GROUPS = LEVELS + ", gr AS (SELECT side, price, ((row_number() OVER (PARTITION BY side ORDER BY price) - 1) // ceil(count(*) OVER (PARTITION BY side) / 16)::BIGINT)::INTEGER AS group_index FROM lv)"


@query("level_groups", sql(GROUPS + " SELECT * FROM gr"))
def level_groups(spark, d):
    return ob.level_groups(t.book(spark, d))


_NAMES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(ob.SLOT_NAMES))


@query("slot_names", sql(LIVE + f", s(slot, slot_name) AS (VALUES {_NAMES}) SELECT slot, sum(remaining)::BIGINT AS volume, count(*) AS n_orders, slot_name FROM live JOIN s USING (slot) GROUP BY slot, slot_name"))
def slot_names(spark, d):
    return ob.by_slot_name(t.book(spark, d))


@query("cancel_orders", sql(" SELECT order_id, side, price, remaining FROM v_book WHERE order_id % 7 <> 3"))
def cancel_orders(spark, d):
    book = t.book(spark, d)
    return ob.cancel(book, book.select("order_id").filter("order_id % 7 = 3")).select("order_id", "side", "price", "remaining")


@query("cancel_all_by_trader", sql(" SELECT order_id, trader_id FROM v_book WHERE trader_id % 10 <> 4"))
def cancel_all_by_trader(spark, d):
    book = t.book(spark, d)
    return ob.cancel_trader(book, book.filter("trader_id % 10 = 4").select("trader_id").distinct()).select("order_id", "trader_id")


@query("cancel_count_by_trader", sql(LIVE + " SELECT trader_id, count(*) AS n_cancelled FROM live WHERE trader_id % 10 = 4 GROUP BY trader_id"))
def cancel_count_by_trader(spark, d):
    return ob.live(t.book(spark, d)).filter("trader_id % 10 = 4").groupBy("trader_id").agg(F.count(F.lit(1)).alias("n_cancelled"))


SWEEP = LIVE + """, m AS (SELECT *, sum(remaining) OVER (ORDER BY price, slot, seq ROWS UNBOUNDED PRECEDING) AS m_end FROM live WHERE side = 'SELL'),
tk AS (SELECT *, sum(size) OVER (ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS t_end FROM v_takers),
tr AS (SELECT taker_id, order_id AS maker_id, trader_id AS maker_trader, price, least(m_end, t_end) - greatest(m_end - remaining, t_end - tk.size) AS fill, t_end > least(m_end, t_end) AS taker_partial, m_end > least(m_end, t_end) AS maker_partial
  FROM m JOIN tk ON m_end - remaining < t_end AND t_end - tk.size < m_end)"""


@query("market_sweep", sql(SWEEP + " SELECT taker_id, maker_id, maker_trader, price, fill::BIGINT AS size, taker_partial, maker_partial FROM tr", "v_book v_takers"))
def market_sweep(spark, d):
    return ob.sweep(t.book(spark, d), t.takers(spark, d))


@query("market_order_summary", sql(SWEEP + " SELECT v.taker_id, v.size AS wanted, coalesce(sum(fill), 0)::BIGINT AS filled, count(tr.maker_id) AS n_trades FROM v_takers v LEFT JOIN tr ON tr.taker_id = v.taker_id GROUP BY v.taker_id, v.size", "v_book v_takers"))
def market_order_summary(spark, d):
    takers = t.takers(spark, d)
    fills = ob.sweep(t.book(spark, d), takers).groupBy("taker_id").agg(F.sum("size").alias("filled"), F.count(F.lit(1)).alias("n"))
    return takers.join(fills, "taker_id", "left").select("taker_id", F.col("size").alias("wanted"), F.coalesce("filled", F.lit(0)).alias("filled"), F.coalesce("n", F.lit(0)).alias("n_trades"))


@query("recent_trades", sql(SWEEP + " SELECT taker_id, maker_id, price, fill::BIGINT AS size FROM tr ORDER BY taker_id DESC, maker_id DESC LIMIT 100", "v_book v_takers"))
def recent_trades(spark, d):
    """The last hundred trades; the limit is the operator."""
    trades = ob.sweep(t.book(spark, d), t.takers(spark, d))
    return trades.select("taker_id", "maker_id", "price", "size").orderBy(F.desc("taker_id"), F.desc("maker_id")).limit(100)


@query("clear_old_trades", sql(SWEEP + " SELECT count(*) AS n_trades, sum(fill)::BIGINT AS volume FROM tr WHERE taker_id >= 1000", "v_book v_takers"))
def clear_old_trades(spark, d):
    """What is left of the trades after those before a cut-off are cleared."""
    return ob.sweep(t.book(spark, d), t.takers(spark, d)).filter("taker_id >= 1000").agg(F.count(F.lit(1)).alias("n_trades"), F.sum("size").alias("volume"))


@query("validate_orders", sql(" SELECT order_id, reason FROM (SELECT order_id, CASE WHEN price NOT BETWEEN 6499600 AND 6500400 THEN 'price' WHEN size > 18000 THEN 'size' WHEN filled > size THEN 'filled' END AS reason FROM v_book) WHERE reason IS NOT NULL"))
def validate_orders(spark, d):
    return ob.validate(t.book(spark, d), 6499600, 6500400, 18000)


@query("volume_mismatch", sql(LEVELS + ", rep AS (SELECT side, price, volume + CASE WHEN price % 10 = 0 THEN 5 ELSE 0 END AS volume FROM lv WHERE price % 7 <> 0) SELECT side, price, lv.volume AS actual, rep.volume AS reported FROM lv FULL JOIN rep USING (side, price) WHERE lv.volume IS DISTINCT FROM rep.volume"))
def volume_mismatch(spark, d):
    book = t.book(spark, d)
    reported = ob.levels(book).filter("price % 7 <> 0").withColumn("volume", F.col("volume") + F.when(F.col("price") % 10 == 0, 5).otherwise(0))
    return ob.volume_mismatch(book, reported)


_WORD64 = "lpad(printf('%X', {}), 16, '0')"
_SLOTS_HEX = " || ".join(_WORD64.format(f"s{i}") for i in range(16))
_TOTAL = " + ".join(f"s{i}" for i in range(16))
HASHES = GROUPS + f", pv AS (SELECT side, price, {_PIVOT} FROM live GROUP BY side, price), lh AS (SELECT side, price, sha256(unhex({_WORD64.format('price')} || {_WORD64.format(_TOTAL)} || {_SLOTS_HEX})) AS hash FROM pv)"


@query("level_hashes", sql(HASHES + " SELECT * FROM lh"))
def level_hashes(spark, d):
    return ob.level_hashes(t.book(spark, d))


@query("book_hash", sql(HASHES + """, g AS (SELECT side, group_index, sha256(unhex(string_agg(hash, '' ORDER BY price))) AS hash FROM lh JOIN gr USING (side, price) GROUP BY side, group_index),
s AS (SELECT side, sha256(unhex(string_agg(hash, '' ORDER BY group_index))) AS hash FROM g GROUP BY side) SELECT sha256(unhex(string_agg(hash, '' ORDER BY side))) AS book_hash FROM s"""))
def book_hash(spark, d):
    return ob.book_hash(t.book(spark, d))


@query("nibble_tree", sql(LIVE + f" SELECT side, substr({_WORD64.format('price')}, 1, 14) AS prefix, count(*) AS n_orders, min(price) AS lowest, max(price) AS highest FROM live GROUP BY ALL"))
def nibble_tree(spark, d):
    return ob.live(t.book(spark, d)).groupBy("side", ob.nibble_prefix(F.col("price"), 14).alias("prefix")).agg(F.count(F.lit(1)).alias("n_orders"), F.min("price").alias("lowest"), F.max("price").alias("highest"))


@query("cancel_batches", sql(LIVE + ", n AS (SELECT *, (row_number() OVER (ORDER BY order_id) - 1) // 512 AS batch FROM live) SELECT symbol, batch, list(order_id ORDER BY order_id) AS order_ids FROM n GROUP BY symbol, batch"))
def cancel_batches(spark, d):
    return ob.cancel_batches(t.book(spark, d))


@query("depth_report", sql(RANKED + " SELECT side, level::INTEGER AS level, price, volume, n_orders FROM rk WHERE level <= 10"))
def depth_report(spark, d):
    return ob.depth_report(t.book(spark, d)).select("side", F.explode("levels").alias("l")).select("side", "l.level", "l.price", "l.volume", "l.n_orders")


@query("full_report")
def full_report(spark, d):
    return ob.full_report(t.book(spark, d))


@query("full_report_levels", sql(RANKED + ", s AS (SELECT live.*, rk.level, row_number() OVER (PARTITION BY live.side, live.price, slot ORDER BY seq) AS p FROM live JOIN rk USING (side, price) WHERE level <= 20) SELECT side, price, level::INTEGER AS level, slot, sum(remaining)::BIGINT AS volume, count(*) FILTER (p <= 5) AS n_shown, min(order_id) FILTER (p = 1) AS first_order FROM s GROUP BY ALL"))
def full_report_levels(spark, d):
    """The nested report written as JSON and read back, a row for each slot."""
    from tidemark.sources.storage import scratch_dir

    path = scratch_dir(spark)
    ob.full_report(t.book(spark, d)).write.json(path)
    slots = "array<struct<slot: int, volume: bigint, orders: array<struct<p: int, order_id: bigint, remaining: bigint>>>>"
    rows = spark.read.schema("side string, price long, level int, slots string").json(path)
    rows = rows.select("side", "price", "level", F.explode(F.from_json("slots", slots)).alias("s"))
    return rows.select("side", "price", "level", "s.slot", "s.volume", F.size("s.orders").cast("bigint").alias("n_shown"), F.col("s.orders")[0]["order_id"].alias("first_order"))


@query("market_sell_sweep", sql(LIVE + """, m AS (SELECT *, sum(remaining) OVER (ORDER BY price DESC, slot, seq ROWS UNBOUNDED PRECEDING) AS m_end FROM live WHERE side = 'BUY'),
tk AS (SELECT *, sum(size) OVER (ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS t_end FROM v_takers)
SELECT taker_id, order_id AS maker_id, price, (least(m_end, t_end) - greatest(m_end - remaining, t_end - tk.size))::BIGINT AS size FROM m JOIN tk ON m_end - remaining < t_end AND t_end - tk.size < m_end""", "v_book v_takers"))
def market_sell_sweep(spark, d):
    """Market sells against the bids."""
    return ob.sweep(t.book(spark, d), t.takers(spark, d), "SELL").select("taker_id", "maker_id", "price", "size")


@query("books_by_symbol", sql(LIVE + " SELECT symbol, count(*) AS n_orders, max(price) FILTER (side = 'BUY') AS best_bid, min(price) FILTER (side = 'SELL') AS best_ask, sum(remaining)::BIGINT AS volume FROM live GROUP BY symbol"))
def books_by_symbol(spark, d):
    b = t.book(spark, d)
    bid, ask = F.max(F.when(F.col("side") == "BUY", F.col("price"))), F.min(F.when(F.col("side") == "SELL", F.col("price")))
    return ob.live(b).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_orders"), bid.alias("best_bid"), ask.alias("best_ask"), F.sum("remaining").alias("volume"))
