"""Operators of keyed tables: lookups, ranges, latest rows, merges, diffs, versions, top-n and catalog operations.

A change log has key, seq (unique, increasing), op (upsert or delete) and value; a store has tree, id and value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def get(store: DataFrame, id_: int, tree: str | None = None) -> DataFrame:
    """Point lookup; both filters reach the scan."""
    return store.filter((F.col("id") == id_) & (F.col("tree") == tree if tree is not None else F.lit(True)))


def get_multiple(store: DataFrame, ids: DataFrame) -> DataFrame:
    """pos, id, value for each wanted id in its place, null where there is none; ids: pos, id."""
    return ids.join(store.select("id", "value"), "id", "left").select("pos", "id", "value")


def exists(store: DataFrame, ids: DataFrame) -> DataFrame:
    found = store.select("id").distinct().withColumn("_there", F.lit(True))
    return ids.join(found, "id", "left").select("id", F.coalesce("_there", F.lit(False)).alias("found"))


def between(c: Column, start, end, with_start: bool = True, with_end: bool = False) -> Column:
    """Range predicate in one of four boundary modes."""
    return (c >= start if with_start else c > start) & (c <= end if with_end else c < end)


def range_query(store: DataFrame, start: int, end: int, with_start: bool = True, with_end: bool = False) -> DataFrame:
    return store.filter(between(F.col("id"), start, end, with_start, with_end))


def range_join(store: DataFrame, bounds: DataFrame, bucket: int = 1024) -> DataFrame:
    """Rows of each tree within any of its (tree, lo, hi) bounds, hi exclusive: an equi-join on tree and bucket, then a filter."""
    cut = bounds.select("*", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor((F.col("hi") - 1) / bucket))).alias("_b"))
    return store.withColumn("_b", F.floor(F.col("id") / bucket)).join(cut, ["tree", "_b"]).filter((F.col("id") >= F.col("lo")) & (F.col("id") < F.col("hi"))).drop("_b")


def latest(log: DataFrame, until: int | None = None) -> DataFrame:
    """Live rows of a change log, up to and with a sequence number: one pass with a combine before the shuffle."""
    log = log.filter(F.col("seq") <= until) if until is not None else log
    last = log.groupBy("key").agg(F.max_by(F.struct("op", "value", "seq"), "seq").alias("r"))
    return last.filter("r.op <> 'delete'").select("key", "r.value", "r.seq")


def apply_changes(state: DataFrame, log: DataFrame) -> DataFrame:
    """state (key, value, seq) after a change log: changes win over rows, deletes take them away."""
    last = log.groupBy("key").agg(F.max_by(F.struct("op", "value", "seq"), "seq").alias("r"))
    both = state.join(last, "key", "full_outer").filter("r is null or r.op <> 'delete'")
    return both.select("key", F.coalesce("r.value", "value").alias("value"), F.coalesce("r.seq", "seq").alias("seq"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, change (added, modified, deleted), old_value, new_value."""
    o, n = old.select("key", F.col("value").alias("old_value"), F.lit(True).alias("_o")), new.select("key", F.col("value").alias("new_value"), F.lit(True).alias("_n"))
    both = o.join(n, "key", "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "deleted").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "modified")
    return both.withColumn("change", change).filter("change is not null").select("key", "change", "old_value", "new_value")


def top(store: DataFrame, n: int, largest: bool = True) -> DataFrame:
    return store.orderBy(F.desc("id") if largest else F.asc("id")).limit(n)


def top_per_tree(store: DataFrame, n: int) -> DataFrame:
    return store.withColumn("k", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("id")))).filter(F.col("k") <= n)


def take_while(rows: DataFrame, order: str, predicate: Column) -> DataFrame:
    """Rows before the first one, in order, that breaks the predicate."""
    stop = rows.filter(~predicate).agg(F.min(order).alias("_stop"))
    return rows.join(F.broadcast(stop)).filter(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")


def tree_stats(store: DataFrame) -> DataFrame:
    """Rows and bytes of each table, and of all as the table ALL."""
    out = store.rollup("tree").agg(F.grouping("tree").alias("g"), F.count(F.lit(1)).alias("n_items"), F.sum(F.octet_length("value")).alias("n_bytes"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))
    return out.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("tree")).alias("tree"), "n_items", "n_bytes", "min_id", "max_id")


def add_counters(rows: DataFrame, counter: Column, width: int = 16) -> DataFrame:
    """uid and its counters as an array: increments in long form, added up, then laid out."""
    sums = rows.groupBy("uid", counter.alias("c")).agg(F.count(F.lit(1)).alias("n"))
    packed = sums.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("m"))
    return packed.select("uid", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0))).alias("counters"))


def get_one(store: DataFrame, id_: int, tree: str):
    """The row of an id in a named table; an error if there is none."""
    row = get(store, id_, tree).first()
    if row is None:
        raise KeyError(f"no {id_} in {tree}")
    return row


class Catalog:
    """Named tables as views of one session, with the errors of a strict catalog."""

    def __init__(self, spark: SparkSession, prefix: str = "tidemark"):
        self.spark, self.prefix, self.tables = spark, prefix, {}

    def create(self, name: str, df: DataFrame) -> DataFrame:
        if name in self.tables:
            raise ValueError(f"table {name} exists")
        self.tables[name] = df
        df.createOrReplaceTempView(f"{self.prefix}_{name}")
        return df

    def get(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"no table {name}")
        return self.tables[name]

    def get_or_create(self, name: str, df: DataFrame) -> DataFrame:
        return self.tables[name] if name in self.tables else self.create(name, df)

    def exists(self, name: str) -> bool:
        return name in self.tables

    def names(self) -> list[str]:
        return sorted(self.tables)

    def rename(self, old: str, new: str) -> None:
        df = self.get(old)
        self.create(new, df)
        self.remove(old)

    def clone(self, old: str, new: str) -> DataFrame:
        return self.create(new, self.get(old))

    def clear(self, name: str) -> None:
        df = self.get(name).limit(0)
        self.tables[name] = df
        df.createOrReplaceTempView(f"{self.prefix}_{name}")

    def remove(self, name: str) -> None:
        self.get(name)
        del self.tables[name]
        self.spark.catalog.dropTempView(f"{self.prefix}_{name}")

    def remove_all(self) -> None:
        for name in self.names():
            self.remove(name)

    def union(self) -> DataFrame | None:
        out = None
        for name in self.names():
            df = self.tables[name].withColumn("tree", F.lit(name))
            out = df if out is None else out.unionByName(df)
        return out
