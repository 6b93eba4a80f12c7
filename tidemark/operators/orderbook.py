"""Operators over resting orders: levels, slots, best prices, depth, ranks, sweeps of market orders, validation and fingerprints.

Orders have order_id, seq (arrival), trader_id, side, price, size, filled, remaining, slot and symbol; prices are scaled integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.encoding import be64

SLOTS = 16
#: Names and descriptions of the priority slots, by index.
SLOT_NAMES = ["reserved", "vip", "small", *(f"pool_{i}" for i in range(1, 13)), "spare"]


def live(orders: DataFrame) -> DataFrame:
    return orders.filter("remaining > 0")


def levels(orders: DataFrame) -> DataFrame:
    """Volume and number of live orders of each price level."""
    return live(orders).groupBy("side", "price").agg(F.sum("remaining").alias("volume"), F.count(F.lit(1)).alias("n_orders"))


def slot_levels(orders: DataFrame) -> DataFrame:
    return live(orders).groupBy("side", "price", "slot").agg(F.sum("remaining").alias("volume"), F.count(F.lit(1)).alias("n_orders"))


def slot_pivot(orders: DataFrame) -> DataFrame:
    """One row per level with a volume column for each slot; the slots are given, so no extra pass finds them."""
    wide = live(orders).groupBy("side", "price").pivot("slot", list(range(SLOTS))).agg(F.sum("remaining"))
    return wide.select("side", "price", *(F.coalesce(F.col(str(i)), F.lit(0)).alias(f"s{i}") for i in range(SLOTS)))


def best_prices(orders: DataFrame) -> DataFrame:
    """Best bid, best ask, spread and whether the book is crossed, in one pass."""
    bid = F.max(F.when(F.col("side") == "BUY", F.col("price")))
    ask = F.min(F.when(F.col("side") == "SELL", F.col("price")))
    out = live(orders).agg(bid.alias("best_bid"), ask.alias("best_ask"))
    return out.withColumn("spread", F.col("best_ask") - F.col("best_bid")).withColumn("crossed", F.coalesce(F.col("best_bid") >= F.col("best_ask"), F.lit(False)))


def tree_stats(orders: DataFrame) -> DataFrame:
    """Levels, orders and volume of each side and of the book, the side BOOK."""
    out = levels(orders).rollup("side").agg(F.grouping("side").alias("g"), F.count(F.lit(1)).alias("n_levels"), F.sum("n_orders").alias("n_orders"), F.sum("volume").alias("volume"))
    return out.select(F.when(F.col("g") == 1, "BOOK").otherwise(F.col("side")).alias("side"), "n_levels", "n_orders", "volume")


def priority(orders: DataFrame) -> Window:
    """Execution order: best price, slot, arrival. Signs make both sides one ordering."""
    return Window.partitionBy("side").orderBy(F.when(F.col("side") == "BUY", -F.col("price")).otherwise(F.col("price")), "slot", "seq")


def execution_rank(orders: DataFrame) -> DataFrame:
    """Rank of each live order on its side. Levels are ranked by sums over levels first; only orders of a level meet in a task."""
    alive = live(orders)
    per = alive.groupBy("side", "price").agg(F.count(F.lit(1)).alias("n"), F.sum("remaining").alias("v"))
    order = Window.partitionBy("side").orderBy(F.when(F.col("side") == "BUY", -F.col("price")).otherwise(F.col("price"))).rowsBetween(Window.unboundedPreceding, -1)
    ahead = per.select("side", "price", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("n_ahead"), F.coalesce(F.sum("v").over(order), F.lit(0)).alias("v_ahead"))
    inside = Window.partitionBy("side", "price").orderBy("slot", "seq")
    out = alive.join(ahead, ["side", "price"]).withColumn("rank", F.col("n_ahead") + F.row_number().over(inside))
    depth = F.col("v_ahead") + F.sum("remaining").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn("depth", depth).drop("n_ahead", "v_ahead")


def fifo_position(orders: DataFrame) -> DataFrame:
    """Place of each order in its level's slot."""
    return live(orders).withColumn("position", F.row_number().over(Window.partitionBy("side", "price", "slot").orderBy("seq")))


def level_depth(orders: DataFrame) -> DataFrame:
    """Levels with their rank from the best and the volume up to and with them."""
    order = Window.partitionBy("side").orderBy(F.when(F.col("side") == "BUY", -F.col("price")).otherwise(F.col("price")))
    return levels(orders).withColumn("level", F.row_number().over(order)).withColumn("cum_volume", F.sum("volume").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def top_levels(orders: DataFrame, n: int = 10) -> DataFrame:
    order = Window.partitionBy("side").orderBy(F.when(F.col("side") == "BUY", -F.col("price")).otherwise(F.col("price")))
    return levels(orders).withColumn("level", F.row_number().over(order)).filter(F.col("level") <= n)


def level_groups(orders: DataFrame, width: int = 16) -> DataFrame:
    """Levels in `width` groups of ceil(n / width), as they hang below an index node."""
    side = Window.partitionBy("side")
    ranked = levels(orders).withColumn("n", F.count(F.lit(1)).over(side)).withColumn("rank", F.row_number().over(side.orderBy("price")) - 1)
    return ranked.select("side", "price", F.floor(F.col("rank") / F.ceil(F.col("n") / width)).cast("int").alias("group_index"))


def counters(orders: DataFrame) -> DataFrame:
    full, part = F.col("remaining") == 0, (F.col("filled") > 0) & (F.col("remaining") > 0)
    return orders.agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(full).alias("n_filled"), F.count_if(part).alias("n_partial"), F.count_if(F.col("filled") == 0).alias("n_open"), F.sum("filled").cast("bigint").alias("matched_volume"))


def by_slot_name(orders: DataFrame) -> DataFrame:
    """Live volume by slot with the slot's name; the dimension has sixteen rows."""
    slots = orders.sparkSession.createDataFrame([(i, n) for i, n in enumerate(SLOT_NAMES)], "slot int, slot_name string")
    return live(orders).groupBy("slot").agg(F.sum("remaining").alias("volume"), F.count(F.lit(1)).alias("n_orders")).join(F.broadcast(slots), "slot")


def cancel(orders: DataFrame, ids: DataFrame) -> DataFrame:
    """The book without the orders of those ids."""
    return orders.join(ids.select("order_id"), "order_id", "left_anti")


def cancel_trader(orders: DataFrame, traders: DataFrame) -> DataFrame:
    return orders.join(traders.select("trader_id"), "trader_id", "left_anti")


def sweep(orders: DataFrame, takers: DataFrame, side: str = "BUY") -> DataFrame:
    """Trades of market orders of a side, in their order of arrival, against the other side of a fixed book.

    Makers in execution order and takers in arrival order cut the same axis of volume into intervals, none of a side overlapping. A
    trade begins where an interval of either side does; its maker and taker are the last ones that began, and it ends where the
    first of them does. So there are no more trades than orders, whatever their volumes.
    """
    against = execution_rank(orders.filter(F.col("side") == ("SELL" if side == "BUY" else "BUY"))).filter("remaining > 0")
    maker = F.struct(F.col("order_id").alias("id"), "trader_id", "price", F.col("depth").alias("end"))
    makers = against.select((F.col("depth") - F.col("remaining")).alias("at"), maker.alias("maker"))
    want = running_sum(takers.filter("size > 0"), "arrival", "size")
    taker = F.struct(F.col("taker_id").alias("id"), F.col("running").alias("end"))
    starts = makers.unionByName(want.select((F.col("running") - F.col("size")).alias("at"), taker.alias("taker")), allowMissingColumns=True)
    points = starts.groupBy("at").agg(F.first("maker", ignorenulls=True).alias("maker"), F.first("taker", ignorenulls=True).alias("taker"))
    both = running_last(points, "at", ["maker", "taker"])
    high = F.least("maker.end", "taker.end")
    hit = both.filter(F.col("maker").isNotNull() & F.col("taker").isNotNull() & (high > F.col("at")))
    return hit.select(F.col("taker.id").alias("taker_id"), F.col("maker.id").alias("maker_id"), F.col("maker.trader_id").alias("maker_trader"), "maker.price", (high - F.col("at")).alias("size"), (F.col("taker.end") > high).alias("taker_partial"), (F.col("maker.end") > high).alias("maker_partial"))


ROWS_IN_PART = 100_000


def _parts(df: DataFrame, order: str) -> DataFrame:
    """df with `_part`: equal parts of the column's range, 64 or as many as the rows need, four times over for uneven ranges."""
    ends = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.greatest(F.lit(64), F.ceil(F.count(F.lit(1)) * 4 / ROWS_IN_PART)).alias("parts"))
    share = (F.col(order) - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo") + 1).cast("double")
    part = F.least(F.col("parts") - 1, F.floor(share * F.col("parts"))).cast("int")
    return df.crossJoin(F.broadcast(ends)).withColumn("_part", part).drop("lo", "hi", "parts")


def running_sum(df: DataFrame, order: str, value: str) -> DataFrame:
    """df with `running`, the sum of value up to and with the row in the order of a unique column, without one task seeing all rows.

    The column's range is cut into parts whose sums come first; rows then add up within their part.
    """
    cut = _parts(df, order)
    sums = cut.groupBy("_part").agg(F.sum(value).alias("s"))
    before = sums.select("_part", F.coalesce(F.sum("s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cut.join(F.broadcast(before), "_part").withColumn("running", F.col("_before") + inside).drop("_part", "_before")


def running_last(df: DataFrame, order: str, values: list[str]) -> DataFrame:
    """df with each of the values replaced by the last one that isn't null up to and with the row, part by part like running_sum."""
    cut = _parts(df, order)
    ends = cut.groupBy("_part").agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values))
    past = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("_part", *(F.last(v, ignorenulls=True).over(past).alias(f"_b{i}") for i, v in enumerate(values)))
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cut.join(F.broadcast(before), "_part")
    found = {v: F.coalesce(F.last(v, ignorenulls=True).over(inside), F.col(f"_b{i}")) for i, v in enumerate(values)}
    return out.select(*(c for c in df.columns if c not in values), *(f.alias(v) for v, f in found.items()))


def validate(orders: DataFrame, low: int, high: int, most: int) -> DataFrame:
    """Orders that break a rule, with the rule."""
    reason = F.when(~F.col("price").between(low, high), "price").when(F.col("size") > most, "size").when(F.col("filled") > F.col("size"), "filled")
    return orders.withColumn("reason", reason).filter("reason is not null").select("order_id", "reason")


def repair(orders: DataFrame, low: int, high: int, most: int) -> DataFrame:
    """Orders without those of an impossible price or size; where more is filled than ordered, all of it counts as filled."""
    sane = orders.filter(F.col("price").between(low, high) & F.col("size").between(0, most))
    filled = F.least(F.greatest("filled", F.lit(0)), "size")
    return sane.withColumn("filled", filled).withColumn("remaining", F.col("size") - F.col("filled"))


def repaired_levels(orders: DataFrame, reported: DataFrame) -> DataFrame:
    """side, price, volume, changed: the levels' volumes from their orders, and whether the reported ones differ; empty levels go."""
    own = levels(orders).select("side", "price", "volume")
    both = own.join(reported.select("side", "price", F.col("volume").alias("reported")), ["side", "price"], "left")
    return both.select("side", "price", "volume", (~F.col("volume").eqNullSafe(F.col("reported"))).alias("changed"))


def volume_mismatch(orders: DataFrame, reported: DataFrame) -> DataFrame:
    """Levels whose reported volume isn't the sum of what their orders have left; reported: side, price, volume."""
    own = levels(orders).select("side", "price", F.col("volume").alias("actual"))
    both = own.join(reported.select("side", "price", F.col("volume").alias("reported")), ["side", "price"], "full_outer")
    return both.filter(~F.col("actual").eqNullSafe(F.col("reported")))


def level_hashes(orders: DataFrame) -> DataFrame:
    """Digest of each level: price, total and the sixteen slots' volumes, as big-endian words."""
    wide = slot_pivot(orders)
    slots = [F.col(f"s{i}") for i in range(SLOTS)]
    total = sum(slots[1:], slots[0])
    return wide.select("side", "price", F.sha2(F.concat(be64(F.col("price")), be64(total), *(be64(s) for s in slots)), 256).alias("hash"))


def book_hash(orders: DataFrame, width: int = 16) -> DataFrame:
    """Digest of the book: levels by price in groups, groups of a side, both sides."""
    grouped = level_hashes(orders).join(level_groups(orders, width), ["side", "price"])
    fold = lambda *keys: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, "hash"))), lambda x: x["hash"]), "")
    groups = grouped.groupBy("side", "group_index").agg(F.sha2(F.unhex(fold("price")), 256).alias("hash"))
    sides = groups.groupBy("side").agg(F.sha2(F.unhex(fold("group_index")), 256).alias("hash"))
    return sides.agg(F.sha2(F.unhex(fold("side")), 256).alias("book_hash"))


def nibble_prefix(price: Column, depth: int) -> Column:
    """The first `depth` nibbles of a big-endian price: its node on that level of a nibble tree."""
    return F.substring(F.lpad(F.hex(price), 16, "0"), 1, depth)


def cancel_batches(orders: DataFrame, size: int = 512) -> DataFrame:
    """Batches of ids, of one symbol and at most `size` each, that cancel all live orders: orders are numbered by id over all symbols,
    and each run of `size` numbers has a batch for every symbol in it.
    """
    rows = running_sum(live(orders).withColumn("_one", F.lit(1)), "order_id", "_one").withColumn("batch", F.floor((F.col("running") - 1) / size))
    return rows.groupBy("symbol", "batch").agg(F.array_sort(F.collect_list("order_id")).alias("order_ids"))


def depth_report(orders: DataFrame, n: int = 10) -> DataFrame:
    """Compact state: the first n levels of each side as nested rows, with totals."""
    top = top_levels(orders, n).groupBy("side").agg(F.array_sort(F.collect_list(F.struct("level", "price", "volume", "n_orders"))).alias("levels"))
    return top.join(tree_stats(orders), "side", "left")


def full_report(orders: DataFrame, most_levels: int = 20, most_orders: int = 5) -> DataFrame:
    """Nested state as JSON, one row per level: slots that hold orders, each with its first orders."""
    position = F.row_number().over(Window.partitionBy("side", "price", "slot").orderBy("seq"))
    some = live(orders).join(top_levels(orders, most_levels).select("side", "price", "level"), ["side", "price"]).withColumn("p", position)
    first = F.array_sort(F.collect_list(F.when(F.col("p") <= most_orders, F.struct("p", "order_id", "remaining"))))
    slots = some.groupBy("side", "price", "level", "slot").agg(F.sum("remaining").alias("volume"), first.alias("orders"))
    return slots.groupBy("side", "price", "level").agg(F.to_json(F.array_sort(F.collect_list(F.struct("slot", "volume", "orders")))).alias("slots"))
