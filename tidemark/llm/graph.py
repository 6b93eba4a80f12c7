"""Connected components of a link table: forests within tasks, then large-star and small-star steps until the edges are stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kit import materialize, release

CHUNK = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of these edges as stars: each node but the smallest with the smallest."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, top = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = top[a], top[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(top, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(top, top[top]):
            top = top[top]
    moved = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[moved], nodes[top[moved]]


def _contract(edges: DataFrame, chunk: int) -> DataFrame:
    """Edges with the same components, fewer of them: every chunk of a task's edges becomes stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            u, v = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            for i in range(0, b.num_rows, chunk):
                held.append(tuple(b.column(c).slice(i, chunk).to_numpy() for c in ("u", "v")))
                count += len(held[-1][0])
                if count >= chunk:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, roots: bool = True, chunk: int = CHUNK) -> DataFrame:
    """edges: u, v (long, any direction, repeats and loops allowed). Returns node, component (the smallest node of each component).

    roots: with a row for the smallest nodes themselves. Up to `chunk` edges are one task's work. Beyond that, minima are taken before
    the join (a hub's neighbours are pre-aggregated), a hub's edges go through a plain equi-join that adaptive execution splits, and
    tasks contract what they hold. Each round is written to shared storage; only a count and a checksum reach the driver.
    """
    mark = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")))
    whole = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v"))
    n = whole.count()
    e = materialize(_contract(whole.coalesce(max(1, -(-n // chunk))), chunk))
    release(whole)
    before = None if n > chunk else ()
    while before != ():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = materialize(_contract(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v"), chunk))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small)
        release(large)
        release(e)
        e, now = after, after.agg(mark.alias("m")).first()["m"]
        if now == before:
            break
        before = now
    moved = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return moved.unionByName(moved.select(F.col("component").alias("node"), "component").distinct()) if roots else moved


class Forest:
    """Union-find over 0..n-1 within one task."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True
