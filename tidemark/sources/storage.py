"""Shared scratch folders and versioned snapshots of named tables."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA_VERSION = 1
META = "version string, created long, n_tables int, n_rows long, schema_version int, columns string"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which executors share; a local one only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


class Snapshots:
    """Versions of a store (tree, id, value) as Parquet partitioned by version and tree, with a metadata row each.

    The metadata row is written last, so a version without one isn't there. A deleted version gets a row that says so, again the last
    thing that readers see; `compact` then writes the catalog anew and removes what no version needs.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def create(self, store: DataFrame, version: str | None, created: int) -> str:
        """Write a version; without a name it is called by the store's root."""
        if version is None:
            from tidemark.operators.merkle import global_root, tree_roots

            version = global_root(tree_roots(store)).first()["global_root"]
        store.write.mode("overwrite").partitionBy("tree").parquet(f"{self.base}/data/version={version}")
        rows = self.spark.read.schema(store.schema).parquet(f"{self.base}/data/version={version}")
        meta = rows.agg(F.count_distinct("tree").cast("int").alias("n_tables"), F.count(F.lit(1)).alias("n_rows"))
        self._put(meta.select(F.lit(version).alias("version"), F.lit(created).cast("long").alias("created"), "n_tables", "n_rows", F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(store.schema.json()).alias("columns")))
        return version

    def create_async(self, store: DataFrame, version: str | None, created: int) -> Future:
        """The same in the background; the store is read as it is when the job runs. The future gives the version's name."""
        pool = ThreadPoolExecutor(1)
        future = pool.submit(self.create, store, version, created)
        pool.shutdown(wait=False)
        return future

    def _put(self, row: DataFrame) -> None:
        row.withColumn("put", F.lit(time.time_ns())).coalesce(1).write.mode("append").parquet(f"{self.base}/meta")

    def versions(self, first: str | None = None, before: str | None = None) -> DataFrame:
        """The catalog's versions, from `first` on and before `before`."""
        fs, p = self._fs(f"{self.base}/meta")
        if not fs.exists(p):
            return self.spark.createDataFrame([], META)
        rows = self.spark.read.schema(f"{META}, put long").parquet(f"{self.base}/meta")
        if first is not None:
            rows = rows.filter(F.col("version") >= first)
        if before is not None:
            rows = rows.filter(F.col("version") < before)
        names = [c.split()[0] for c in META.split(", ")]
        return rows.groupBy("version").agg(F.max_by(F.struct(*names[1:]), "put").alias("r")).select("version", "r.*").filter("n_tables >= 0")

    def trees(self, version: str) -> DataFrame:
        """The names of a version's tables, from its folders alone."""
        self._row(version)
        return self.spark.read.schema("tree string").option("basePath", f"{self.base}/data/version={version}").parquet(f"{self.base}/data/version={version}").select("tree").distinct()

    def _row(self, version: str | None):
        rows = self.versions()
        row = rows.filter(F.col("version") == version).first() if version else rows.orderBy(F.desc("created")).first()
        if row is None:
            raise KeyError(f"no version {version or 'yet'}")
        return row

    def load(self, version: str | None = None) -> DataFrame:
        """A version, or the latest."""
        row = self._row(version)
        if row["schema_version"] != SCHEMA_VERSION:
            raise ValueError(f"schema version {row['schema_version']}")
        columns = StructType.fromJson(json.loads(row["columns"]))
        return self.spark.read.schema(columns).parquet(f"{self.base}/data/version={row['version']}")

    def delete(self, version: str) -> None:
        """Mark a version as gone, then remove its folder; readers see it or don't, and a failure between leaves a folder for compact."""
        row = self._row(version)
        self._put(self.spark.createDataFrame([(version, row["created"], -1, 0, SCHEMA_VERSION, row["columns"])], META))
        fs, p = self._fs(f"{self.base}/data/version={version}")
        fs.delete(p, True)

    def compact(self) -> int:
        """Write the catalog into one file and remove folders without a version; how many went."""
        fs, meta = self._fs(f"{self.base}/meta")
        fresh = f"{self.base}/meta-{uuid.uuid4().hex}"
        self.versions().withColumn("put", F.lit(time.time_ns())).coalesce(1).write.parquet(fresh)
        names = {r["version"] for r in self.spark.read.schema(META).parquet(fresh).select("version").toLocalIterator()}
        fs.delete(meta, True)
        fs.rename(self._fs(fresh)[1], meta)
        _, data = self._fs(f"{self.base}/data")
        gone = [f.getPath() for f in fs.listStatus(data) if f.getPath().getName().removeprefix("version=") not in names] if fs.exists(data) else []
        for p in gone:
            fs.delete(p, True)
        return len(gone)

    def stats(self) -> DataFrame:
        return self.versions().agg(F.count(F.lit(1)).alias("n_versions"), F.min_by("version", "created").alias("first"), F.max_by("version", "created").alias("last"), F.sum("n_rows").alias("n_rows"))
