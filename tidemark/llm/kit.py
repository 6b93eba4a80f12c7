"""Helpers shared by the training-data operators: shared storage, word scanning, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
BLOCK_BYTES = 512 << 10  # array operations on a block hold a hundred times as much at once


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which executors share; a local one only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


#: Spark deletes a finished step's shuffle files when the driver collects garbage; what has been written needs them no more.
SECONDS_BETWEEN_CLEANING = 2.0
_cleaned = [0.0]


def clean(spark: SparkSession) -> None:
    if time.monotonic() - _cleaned[0] > SECONDS_BETWEEN_CLEANING:
        spark.range(1).count()  # the session holds on to what it ran last
        gc.collect()
        spark._jvm.System.gc()
        _cleaned[0] = time.monotonic()


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While it holds, Python workers get at most so many rows at once: for steps that hold much else."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def let_go() -> None:
    """Give freed memory back to the system; the allocators of Arrow and of the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run for a worker that keeps nothing of it, nor of tasks before: idle workers and the next step's share an executor's memory."""

    def tidied(batches: Batches) -> Batches:
        let_go()
        yield from run(batches)
        let_go()

    return tidied


def materialize(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Cut the lineage: write as Parquet to shared storage and read again. Survives lost executors."""
    clean(df.sparkSession)
    path = shared_dir(df.sparkSession)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._tidemark_path = path
    return back


def release(df: DataFrame) -> None:
    """Delete a materialized table that no later step reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._tidemark_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores more as no column of df needs."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def fold(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _byte_values() -> np.ndarray:
    return fold(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


VALUES = _byte_values()
LOWER_VALUES = VALUES.copy()
LOWER_VALUES[65:91] = VALUES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0], _powers[1]


class Spans:
    """Hashes of any byte spans of one block, from prefix sums of base**i * value(byte i)."""

    def __init__(self, data: np.ndarray, values: np.ndarray = VALUES):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return fold((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and len + 1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buffer = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def text_blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most so many bytes of text, or one row."""
    at = batch.schema.get_field_index(column)
    _, offsets = text_bytes(batch.column(at))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        part = batch.slice(i, j - i)
        data, own = text_bytes(part.column(at))
        yield part, data, own
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of the first word of each row (len + 1 of them)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = solid[1:] != solid[:-1]
    edge[0] = edge[-1] = True
    edge[offsets] = True
    at = np.flatnonzero(edge)
    keep = solid[at[:-1]]
    starts, ends = at[:-1][keep], at[1:][keep]
    return starts, ends, np.searchsorted(starts, offsets)


def packed(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """The bytes of values[cut[i]:cut[i + 1]] as row i."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(cut) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def seed_hash(seed: int, *columns: Column) -> Column:
    """A 64-bit hash of the columns that depends on the seed."""
    return F.xxhash64(F.lit(seed), *columns)


def unit(h: Column) -> Column:
    """A hash as a number in [0, 1)."""
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)
