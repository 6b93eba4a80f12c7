"""Structured Streaming forms of the transaction pipeline: sources, gates, stateful stages and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import codec
from tidemark.operators.merkle import state_root
from tidemark.operators.orderbook import running_sum
from tidemark.sources import tables as t
from tidemark.sources.storage import scratch_dir


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table, one file or a folder of part files, as a stream of files."""
    schema = t.table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    rows = reader.parquet(f"{sf_dir}/events.parquet") if folder else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def as_transactions(events: DataFrame) -> DataFrame:
    n = F.col("event_id") - F.when((F.col("event_id") % 17 == 0) & (F.col("event_id") > 0), 1).otherwise(0)
    return events.select(F.col("event_id").alias("arrival"), (F.col("user_id") + 1).cast("bigint").alias("uid"), (F.col("event_id") + (F.col("event_id") * 7919) % 50).alias("nonce"), "event_type", "ts", F.sha2(F.concat(F.lit("sig:"), n.cast("string")), 256).alias("sig"))


def without_duplicates(tx: DataFrame, within: str | None = None) -> DataFrame:
    """One transaction per signature. A signature is never forgotten, so state grows with the stream (keep it in RocksDB); with
    `within`, duplicates are only looked for within the watermark's delay, and state is dropped behind it.
    """
    return tx.dropDuplicates(["sig"]) if within is None else tx.withWatermark("ts", within).dropDuplicatesWithinWatermark(["sig"])


def window_counts(tx: DataFrame, window: str = "1 hour", late: str = "1 minute") -> DataFrame:
    return tx.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def monotonic(tx: DataFrame) -> DataFrame:
    """arrival, uid, nonce of transactions above all earlier nonces of their user; the greatest one so far is the state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("arrival")
        seen = state.get[0] if state.exists else 0
        before = rows["nonce"].cummax().shift(fill_value=seen).clip(lower=seen)
        state.update((max(seen, int(rows["nonce"].max())),))
        yield rows[rows["nonce"] > before][["arrival", "uid", "nonce"]]

    return tx.select("arrival", "uid", "nonce").groupBy("uid").applyInPandasWithState(step, "arrival long, uid long, nonce long", "seen long", "append", GroupStateTimeout.NoTimeout)


def run(stream: DataFrame, mode: str = "append", path: str | None = None) -> str:
    """Work off what is there now into a Parquet folder; in complete mode each batch replaces the last."""
    spark = stream.sparkSession
    path = path or scratch_dir(spark)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}-state").outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").start(path)
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return path


def upsert_sink(base: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the last change of each key of a batch goes to the batch's own folder, so a retried batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("key").agg(F.max_by(F.struct("op", "value", "seq"), "seq").alias("r")).select("key", "r.*")
        last.write.mode("overwrite").parquet(f"{base}/batch={number}")

    return write


def buffered_sink(base: str, most: int = 8192) -> Callable[[DataFrame, int], None]:
    """For foreachBatch with a short trigger interval: a batch is written in flushes of at most `most` rows, in order of seq.

    The interval is the trigger's; whichever of the two comes first ends a flush.
    """

    def write(batch: DataFrame, number: int) -> None:
        flush = F.floor((F.col("running") - 1) / most).cast("int")
        rows = running_sum(batch.withColumn("_one", F.lit(1)), "seq", "_one").withColumn("flush", flush).drop("running", "_one")
        rows.write.mode("overwrite").partitionBy("flush").parquet(f"{base}/batch={number}")

    return write


def pipeline_sink(base: str, valid: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: decode, verify, prepare and execute binary messages (arrival, sig, body).

    Verified messages whose signature hasn't been seen, in this batch or before, are prepared; of those, messages above all nonces that
    their user's prepared messages had are executed. Signatures and greatest nonces are kept in folders by batch, so a batch that is
    run again replaces its own and sees only those before it.
    """

    def before(spark: SparkSession, name: str, schema: str, number: int) -> DataFrame:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
        rows = spark.read.schema(f"{schema}, batch int").parquet(f"{base}/{name}") if there else spark.createDataFrame([], f"{schema}, batch int")
        return rows.filter(F.col("batch") < number).drop("batch")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        decoded = batch.select("arrival", "sig", codec.parse_order("body").alias("m"), codec.wire_ok("body").alias("wire_ok")).select("arrival", "sig", "m.*", "wire_ok")
        verified = valid(decoded.filter("wire_ok"))
        first = verified.groupBy("sig").agg(F.min_by(F.struct("arrival", "uid", "nonce", "op_code", "amount"), "arrival").alias("r")).select("sig", "r.*")
        first.join(before(spark, "seen", "sig string", number), "sig", "left_anti").write.mode("overwrite").parquet(f"{base}/prepared/batch={number}")
        prepared = spark.read.schema(first.schema).parquet(f"{base}/prepared/batch={number}")
        prepared.select("sig").write.mode("overwrite").parquet(f"{base}/seen/batch={number}")
        known = before(spark, "nonces", "uid long, top long", number).groupBy("uid").agg(F.max("top").alias("top"))
        earlier = F.max("nonce").over(Window.partitionBy("uid").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
        marked = prepared.withColumn("earlier", earlier).join(known, "uid", "left")
        done = marked.filter(F.col("nonce") > F.greatest(F.coalesce("earlier", F.lit(0)), F.coalesce("top", F.lit(0))))
        done.select("arrival", "uid", "nonce", "op_code").write.mode("overwrite").parquet(f"{base}/executed/batch={number}")
        prepared.groupBy("uid").agg(F.max("nonce").alias("top")).write.mode("overwrite").parquet(f"{base}/nonces/batch={number}")

    return write


def root_sink(base: str, tag: str = "head") -> Callable[[DataFrame, int], None]:
    """For foreachBatch, with the interval of the trigger: fold a batch of changes (key, seq, op, value) into the state and publish its root.

    The state of a batch is written first and its row of tag, batch and root last; readers take the last row of a tag, whose state is
    there. A batch that is run again replaces both.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = "key long, op string, value long, seq long"
        new = batch.select("key", "op", "value", "seq")
        last = published(spark, base, tag, number)
        old = spark.read.schema(schema).parquet(f"{base}/state/batch={last['batch']}") if last else spark.createDataFrame([], schema)
        whole = old.unionByName(new).groupBy("key").agg(F.max_by(F.struct("op", "value", "seq"), "seq").alias("r")).select("key", "r.*")
        whole.write.mode("overwrite").parquet(f"{base}/state/batch={number}")
        state = spark.read.schema(schema).parquet(f"{base}/state/batch={number}")
        root = state_root(state, "key", F.col("value"), F.col("op") == "delete")
        root.select(F.lit(tag).alias("tag"), F.lit(number).cast("long").alias("batch"), F.col("state_root").alias("root")).coalesce(1).write.mode("overwrite").parquet(f"{base}/roots/n={number}")

    return write


def published(spark: SparkSession, base: str, tag: str = "head", before: int | None = None) -> dict | None:
    """The last row (tag, batch, root) that was published, or the last one before a batch."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/roots")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    rows = spark.read.schema("tag string, batch long, root string").parquet(f"{base}/roots").filter(F.col("tag") == tag)
    row = (rows if before is None else rows.filter(F.col("batch") < before)).orderBy(F.desc("batch")).select("tag", "batch", "root").first()
    return row.asDict() if row else None


def within_bounds(tx: DataFrame, late: str = "60 seconds", ahead: str = "60 seconds", now: Column | None = None) -> DataFrame:
    """Rows no later than the watermark allows, and not further in the future of the clock (or `now`) than `ahead`."""
    return tx.withWatermark("ts", late).filter(F.col("ts") <= (F.current_timestamp() if now is None else now) + F.expr(f"INTERVAL {ahead}"))


def send_sink(send: Callable[[list[dict]], None], most: int = 1000) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: hand rows to a sender on the executors, `most` at a time."""

    def part(rows: Iterator) -> None:
        held: list[dict] = []
        for r in rows:
            held.append(r.asDict())
            if len(held) >= most:
                send(held)
                held = []
        if held:
            send(held)

    return lambda batch, _: batch.foreachPartition(part)
