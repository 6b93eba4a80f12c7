"""Operators of the transaction pipeline: gates, duplicates, time bounds, nonce order, batching, routing, reports.

Transactions have arrival (unique, increasing), uid, nonce, op_code, market, ts, amount and sig.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.encoding import epoch_micros

SHORTEST, LONGEST, SIGNATURE = 64, 8 << 20, 64


def split_message(message: Column) -> tuple[Column, Column]:
    """Signature and body of a binary message; nulls if it is too short for both."""
    ok = F.length(message) > SIGNATURE
    return F.when(ok, F.substring(message, 1, SIGNATURE)), F.when(ok, F.substr(message, F.lit(SIGNATURE + 1)))


def header_scan(body: Column) -> Column:
    """Whether a body can hold a header: a first field of number 1 or 2 that is length-delimited, and a sane length."""
    return F.coalesce(F.substring(body, 1, 1).isin(F.unhex(F.lit("0A")), F.unhex(F.lit("12"))) & F.length(body).between(2, LONGEST), F.lit(False))


def first_by(df: DataFrame, key: str, order: str = "arrival") -> DataFrame:
    """The first row of each key: min_by combines before the shuffle, so a key of any size sends a row from each task."""
    rest = F.struct(*df.columns)
    return df.groupBy(key).agg(F.min_by(rest, F.col(order)).alias("_r")).select("_r.*")


def duplicates(df: DataFrame, key: str = "sig", order: str = "arrival") -> DataFrame:
    """All rows but the first of each key."""
    first = df.groupBy(key).agg(F.min(order).alias("_first"))
    return df.join(first, key).filter(F.col(order) > F.col("_first")).drop("_first")


def gate(tx: DataFrame, users: DataFrame, first_uid: int = 1, last_uid: int = 1 << 31) -> DataFrame:
    """Every transaction with reject_reason: duplicate, bad_uid, unknown_user or null for those that pass."""
    first = tx.groupBy("sig").agg(F.min("arrival").alias("_first"))
    known = users.select("uid").distinct().withColumn("_known", F.lit(True))
    reason = F.when(F.col("arrival") > F.col("_first"), "duplicate").when(~F.col("uid").between(first_uid, last_uid), "bad_uid").when(F.col("_known").isNull(), "unknown_user")
    return tx.join(first, "sig").join(known, "uid", "left").withColumn("reject_reason", reason).drop("_first", "_known")


def within_skew(tx: DataFrame, now: Column, seconds: int = 60) -> DataFrame:
    return tx.filter(F.abs(epoch_micros(F.col("ts")) - epoch_micros(now)) <= seconds * 1_000_000)


def monotonic_nonces(tx: DataFrame, users: DataFrame) -> DataFrame:
    """Accepted transactions: the nonce is above all earlier ones of the user, and the user's initial one."""
    w = Window.partitionBy("uid").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    known = tx.join(users, "uid").withColumn("_seen", F.max("nonce").over(w))
    return known.filter(F.col("nonce") > F.greatest(F.coalesce("_seen", "init_nonce"), F.col("init_nonce"))).drop("_seen", "init_nonce")


def contiguous_nonces(tx: DataFrame, users: DataFrame, buffer: int = 1024) -> DataFrame:
    """uid, nonce, arrival, released: transactions in nonce order without gaps; a gap holds back up to `buffer` later ones.

    The order in which gaps fill is sequential by user, so users are grouped, as Arrow batches.
    """

    def run(key, batches):
        import heapq

        import pyarrow as pa

        rows = sorted((a, n, i) for b in batches for a, n, i in zip(b.column("arrival").to_pylist(), b.column("nonce").to_pylist(), b.column("init_nonce").to_pylist(), strict=True))
        expected, held, out = rows[0][2] + 1, [], []
        for arrival, nonce, _ in rows:
            if nonce < expected or len(held) >= buffer and nonce > expected:
                continue
            heapq.heappush(held, (nonce, arrival))
            while held and held[0][0] <= expected:
                n, a = heapq.heappop(held)
                if n == expected:
                    out.append((key[0].as_py(), n, a, arrival))
                    expected += 1
        return pa.table({k: pa.array([r[i] for r in out], pa.int64()) for i, k in enumerate(("uid", "nonce", "arrival", "released"))})

    def whole(key, table):
        return run(key, table.to_batches())

    grouped = tx.join(users, "uid").select("uid", "nonce", "arrival", "init_nonce").groupBy("uid")
    return grouped.applyInArrow(whole, "uid long, nonce long, arrival long, released long")


def bursts(tx: DataFrame, most: int = 50) -> DataFrame:
    """Consecutive transactions of one user, cut after `most`: burst_start, uid, n.

    Rows are numbered by arrival without gaps; a row whose predecessor is another user's starts a run. Runs are numbered by running
    sums over ranges of arrival, so neither a user nor a run has to fit one task.
    """
    from tidemark.operators.orderbook import running_sum

    rows = running_sum(tx.select("arrival", "uid").withColumn("_one", F.lit(1)), "arrival", "_one").select("arrival", "uid", F.col("running").alias("_n"))
    before = rows.select((F.col("_n") + 1).alias("_n"), F.col("uid").alias("_uid"), F.lit(True).alias("_has"))
    new = ~F.coalesce(F.col("_has") & F.col("uid").eqNullSafe(F.col("_uid")), F.lit(False))
    marked = rows.join(before, "_n", "left").withColumn("_new", new.cast("int")).drop("_uid", "_has")
    runs = running_sum(marked, "_n", "_new")
    first = runs.filter("_new = 1").select("running", F.col("_n").alias("_first"))
    part = F.floor((F.col("_n") - F.col("_first")) / most)
    return runs.join(first, "running").groupBy("running", part.alias("_part")).agg(F.min("arrival").alias("burst_start"), F.first("uid").alias("uid"), F.count(F.lit(1)).alias("n")).select("burst_start", "uid", "n")


def batches(tx: DataFrame, size: int) -> DataFrame:
    """tx with batch: rows numbered by arrival, `size` to a batch. Numbers come from counts of ranges of arrival first."""
    from tidemark.operators.orderbook import running_sum

    return running_sum(tx.withColumn("_one", F.lit(1)), "arrival", "_one").withColumn("batch", F.floor((F.col("running") - 1) / size)).drop("running", "_one")


def batch_verdicts(tx: DataFrame, size: int, valid: Column) -> DataFrame:
    """A batch holds only if every signature in it does."""
    return batches(tx.withColumn("_valid", valid), size).groupBy("batch").agg(F.every("_valid").alias("valid"), F.count(F.lit(1)).alias("n"))


def route_user(uid: Column, shards: int, last_system: int, manual: dict[int, int] | None = None) -> Column:
    """Shard of a user: a manual one, 0 for system users, else one of the others by remainder."""
    out = F.when(uid <= last_system, 0) if not manual else None
    for k, w in (manual or {}).items():
        out = F.when(uid == k, w % shards) if out is None else out.when(uid == k, w % shards)
    if manual:
        out = out.when(uid <= last_system, 0)
    return (out.when(F.lit(shards) <= 1, 0).otherwise(1 + uid % max(shards - 1, 1))).cast("int")


def route_market(uid: Column, market: Column, last_system: int, workers: int) -> Column:
    """Worker of a transaction: 0 for system users, one each for markets 1 to 64, the others shared."""
    return F.when(uid <= last_system, 0).when(market.between(1, 64), market).otherwise(65 + market % workers).cast("int")


def ordered_by_worker(tx: DataFrame, worker: Column) -> DataFrame:
    """tx in partitions by worker, in order of arrival within each."""
    return tx.withColumn("worker", worker).repartition("worker").sortWithinPartitions("worker", "arrival")


def duplicate_alarm(tx: DataFrame, window: str = "1 second", on: int = 1000, off: int = 100) -> DataFrame:
    """Duplicates per window with a hysteresis alarm: it goes on above `on`, off below `off`, and else stays."""
    n = duplicates(tx).groupBy(F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n_dup"))
    signal = F.when(F.col("n_dup") > on, True).when(F.col("n_dup") < off, False)
    last = F.last(signal, ignorenulls=True).over(Window.orderBy("window_start").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # One row per window that has duplicates is left here: a time axis, not the data.
    return n.select(F.col("w.start").alias("window_start"), "n_dup").withColumn("alarm", F.coalesce(last, F.lit(False)))


def expand_batches(tx: DataFrame, payload: str = "items") -> DataFrame:
    """One row per item of a batched payload, the batch's own columns inherited."""
    rest = [c for c in tx.columns if c != payload]
    return tx.select(*rest, F.posexplode(payload).alias("item_index", "item"))


def last_per_second(ticks: DataFrame) -> DataFrame:
    """Last price of each occupied second slot of each minute bucket."""
    return ticks.groupBy(F.date_trunc("minute", "ts").alias("minute"), F.second("ts").alias("second")).agg(F.max_by("price", "arrival").alias("price"))


def occupancy(ticks: DataFrame) -> DataFrame:
    """Occupied second slots of each hour-and-minute bucket: bits of a map that is combined by or."""
    return ticks.groupBy(F.hour("ts").alias("hour"), F.minute("ts").alias("minute")).agg(F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.second("ts")))).alias("slots"))
