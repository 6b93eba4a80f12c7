"""Files of other formats: blocks and dumps of binary rows, trees by level, feeds of JSON, one key space of several kinds."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.functions.encoding import be64, from_be

#: The first byte of a key by kind, and the mark of a dumped tree.
KINDS = {"account": "41", "balance": "42", "order": "4F"}
TREE_MARK = "VKL2"


def write_block_files(blocks: DataFrame, path: str) -> int:
    """Each row (block, data) as a file of its own below path; blocks go through the driver one at a time."""
    spark = blocks.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    n = 0
    for r in blocks.select("block", "data").toLocalIterator():
        out = fs.create(fs_path(f"{path}/block-{r['block']:012d}.bin"), True)
        out.write(bytearray(r["data"]))
        out.close()
        n += 1
    return n


def read_block_files(spark: SparkSession, path: str) -> DataFrame:
    """block, pos, sig, body, error of all transactions in the block files below path."""
    number = F.regexp_extract("path", r"block-(\d+)\.bin$", 1).cast("bigint")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "block-*.bin").load(path)
    return codec.decode_blocks(files.select(number.alias("block"), F.col("content").alias("data")))


def key_space(kinds: dict[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """One frame (key, value) of several kinds: the kind's byte and the id as a key, binary values."""
    out = None
    for kind, (rows, id_, value) in kinds.items():
        part = rows.select(F.concat(F.unhex(F.lit(KINDS[kind])), be64(id_)).alias("key"), value.cast("binary").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def by_kind(space: DataFrame) -> dict[str, DataFrame]:
    """The kinds of a key space, told by the first byte of the key: id, value each."""
    return {k: space.filter(F.substring("key", 1, 1) == F.unhex(F.lit(b))).select(from_be(F.col("key"), 2, 8).alias("id"), "value") for k, b in KINDS.items()}


def dump_tree(nodes: DataFrame, path: str) -> None:
    """A tree's nodes (tree, depth, key, hash) by level; the mark and the roots are written last, so a dump without them isn't there."""
    nodes.write.partitionBy("depth").parquet(f"{path}/nodes")
    back = nodes.sparkSession.read.parquet(f"{path}/nodes")
    heads = back.groupBy("tree").agg(F.max_by("hash", -F.col("depth")).alias("root"), F.count(F.lit(1)).alias("n_nodes"))
    heads.withColumn("mark", F.lit(TREE_MARK)).coalesce(1).write.parquet(f"{path}/heads")


def load_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and heads (tree, root, n_nodes) of a dump."""
    heads = spark.read.parquet(f"{path}/heads")
    if heads.filter(F.col("mark") != TREE_MARK).limit(1).count():
        raise ValueError("not a dumped tree")
    return spark.read.schema("tree string, key string, hash string, depth int").parquet(f"{path}/nodes"), heads.drop("mark")


FEED = "topic string, type string, ts bigint, data struct<s: string, b: array<array<string>>, a: array<array<string>>>"


def parse_feed(lines: DataFrame, symbols: list[str]) -> DataFrame:
    """symbol, type, ts, side, price, qty of the levels in JSON messages of followed topics; broken messages and levels go."""
    rows = lines.select(F.from_json("value", FEED).alias("m")).filter("m is not null")
    rows = rows.withColumn("symbol", F.get(F.split("m.topic", "\\."), 2)).filter(F.col("symbol").isin(symbols))
    side = lambda name, c: F.transform(F.coalesce(c, F.array().cast("array<array<string>>")), lambda x: F.struct(F.lit(name).alias("side"), x.alias("pair")))
    levels = rows.select("symbol", "m.type", "m.ts", F.explode(F.concat(side("BUY", F.col("m.data.b")), side("SELL", F.col("m.data.a")))).alias("x"))
    return levels.filter(F.size("x.pair") == 2).select("symbol", "type", "ts", "x.side", F.get("x.pair", F.lit(0)).try_cast("double").alias("price"), F.get("x.pair", F.lit(1)).try_cast("double").alias("qty"))


def feed_stream(spark: SparkSession, path: str, symbols: list[str], files_per_trigger: int = 16) -> DataFrame:
    """Files of JSON lines as a stream of levels."""
    return parse_feed(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path), symbols)


class Cursor:
    """Walks over sorted rows on the driver, a partition at a time."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.reset()

    def reset(self) -> None:
        self.left: Iterator = self.rows.toLocalIterator()
        self.head: list = []
        self.taken = 0

    def has_next(self) -> bool:
        if not self.head:
            self.head = [r for r in [next(self.left, None)] if r is not None]
        return bool(self.head)

    def peek(self):
        if not self.has_next():
            raise StopIteration("no more rows")
        return self.head[0]

    def next(self):
        row = self.peek()
        self.head.clear()
        self.taken += 1
        return row

    def remaining(self) -> int:
        return self.rows.count() - self.taken

    def to_list(self, most: int) -> list:
        out = []
        while len(out) < most and self.has_next():
            out.append(self.next())
        return out

    def for_each(self, f) -> None:
        while self.has_next():
            f(self.next())
