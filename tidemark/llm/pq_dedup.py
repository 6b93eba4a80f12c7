"""Embedding near-duplicates by product quantisation.

Coarse centroids make inverted lists; residuals are coded in subspaces. A vector within the link distance of a query lies in a list
whose cell comes within that distance: the hyperplane between the list's centroid and the query's own is no farther. The difference
of two such vectors points that way by a share of about 1 / sqrt(dimensions), so lists are probed up to `sigmas` times that share of
the link distance: all of it, which misses nothing, in up to sigmas**2 dimensions, and beyond that with a chance of a miss as small
as that of so many standard deviations. In a list, table-lookup distances to the codes, widened by each code's own known error,
leave candidates; their cosines are then taken exactly, in double precision. A test measures recall against brute force.

Centroids and codebooks are fitted on a bounded sample (`sample` vectors); every vector is indexed and every vector is a query. The
number of lists follows the largest label up to `most_lists`. Equal vectors of a label are one entry with a count. Queries travel
in packs of one list. Lists are worked on in blocks of members and queries, so a list that holds a third of all rows spreads over
many tasks; a block returns counts and a spanning forest of its links, never all pairs.

Only vectors of one label and one dimension are compared. Null labels, null or zero vectors, vectors with null or non-finite
components and rows with null vec_id link with nothing: no links, a component of their own; where vec_id is null, component_id and
kept are null too. Lengths are taken after scaling by the largest component, so very large and very small vectors keep their
direction. Rows that repeat a vec_id count as vectors, and share its component; ties at the threshold are links. Empty tables give
empty results. There are no texts; other columns of the table, whatever their names, aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import Forest, components, stars
from tidemark.llm.kit import materialize, seed_hash

MEMBERS, QUERIES = 1024, 4096


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from a random start; an empty cluster keeps its place."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((c * c).sum(1) - 2 * x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Quantiser:
    """Coarse centroids and a codebook for each subspace of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int = 8, codes: int = 256, seed: int = 11):
        d = sample.shape[1]
        self.coarse = kmeans(sample, min(lists, len(sample)), 8, seed)
        self.edges = np.linspace(0, d, min(parts, d) + 1).astype(int)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.books = [kmeans(rest[:, a:b], min(codes, len(rest)), 6, seed + a) for a, b in zip(self.edges, self.edges[1:], strict=False)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and error (distance to the decoded vector) of each row."""
        at = nearest(x, self.coarse)
        rest = x - self.coarse[at]
        spans = list(zip(self.edges, self.edges[1:], strict=False))
        codes = np.stack([nearest(rest[:, a:b], book) for (a, b), book in zip(spans, self.books, strict=True)], axis=1)
        decoded = np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], axis=1)
        return at, codes.astype(np.uint8), np.sqrt(((rest - decoded) ** 2).sum(1))

    def probes(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for every list whose cell comes within `reach` of the row; the row's own among them."""
        c = self.coarse
        d2 = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
        own = d2.argmin(1)
        apart = np.sqrt(np.maximum(0, (c[own] ** 2).sum(1)[:, None] - 2 * c[own] @ c.T + (c * c).sum(1)))
        near = d2 - d2[np.arange(len(x)), own][:, None] <= 2 * apart * reach + 1e-9
        near[np.arange(len(x)), own] = True
        return np.nonzero(near)

    def lookup(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distances from each query to each code of a list, from one table per subspace."""
        rest = x - self.coarse[cell]
        total = np.zeros((len(x), len(codes)))
        for k, (a, b) in enumerate(zip(self.edges, self.edges[1:], strict=False)):
            q, book = rest[:, a:b], self.books[k]
            table = (q * q).sum(1)[:, None] - 2 * q @ book.T + (book * book).sum(1)
            total += table[:, codes[:, k]]
        return np.sqrt(np.maximum(total, 0))


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, initial=0.0, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _units(column: pd.Series) -> np.ndarray:
    return units(np.stack(column.to_numpy()).astype(np.float64))


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, sample: int = 65_536, list_size: int = 64, most_lists: int = 4096, sigmas: float = 5.0) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings (vec_id, embedding, label)."""
    rows = embeddings.select("vec_id", "embedding", "label")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    able = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~bad & some, F.lit(False))
    reps = materialize(rows.filter(able).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    links = None
    for d in sorted(r[0] for r in reps.select(F.size("embedding")).distinct().collect()):
        found = _links(reps.filter(F.size("embedding") == d), threshold, sample, list_size, most_lists, sigmas)
        links = found if links is None else links.unionByName(found)
    if links is None:
        own = rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
        return own.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    links = materialize(links)
    counts = links.filter("v is null").groupBy("u").agg(F.sum("n").alias("n"))
    # Copies of one vector are linked too: their ids hang on the smallest.
    same = rows.filter(able).join(reps.select("label", "embedding", "rep"), ["label", "embedding"]).select(F.col("vec_id").alias("u"), F.col("rep").alias("v"))
    whole = components(links.filter("v is not null").select("u", "v").unionByName(same.filter("u <> v")))
    out = rows.withColumn("_able", able).join(reps.select("label", "embedding", "rep"), ["label", "embedding"], "left")
    out = out.withColumn("rep", F.when(F.col("_able"), F.col("rep"))).select("vec_id", "rep")
    out = out.join(counts.withColumnRenamed("u", "rep"), "rep", "left").join(whole.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _links(reps: DataFrame, threshold: float, sample: int, list_size: int, most_lists: int, sigmas: float) -> DataFrame:
    """u, v, n: edges of spanning forests (n 0), and for each representative its number of links (v null)."""
    n = reps.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    lists = max(1, min(most_lists, n // list_size))
    drawn = np.stack([np.array(r[0], float) for r in reps.select("embedding").orderBy(seed_hash(3, F.col("embedding")), "embedding").limit(min(sample, max(16_384, 16 * lists))).collect()])
    model = Quantiser(units(drawn), lists)
    book = reps.sparkSession.sparkContext.broadcast(model)  # fixed size: lists and codes are bounded
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    share = min(1.0, sigmas / math.sqrt(drawn.shape[1]))
    kinds = dict(reps.dtypes)
    real = "<f4" if kinds["embedding"] == "array<float>" else "<f8"

    def encode(batches):
        for b in batches:
            for i in range(0, len(b), 2048):
                p = b.iloc[i : i + 2048]
                x = np.stack(p["embedding"].to_numpy()).astype(np.float64)
                cell, codes, error = book.value.encode(units(x))
                yield pd.DataFrame({"label": p["label"].to_numpy(), "cell": cell, "rep": p["rep"].to_numpy(), "copies": p["copies"].to_numpy(), "vector": [r.tobytes() for r in x.astype(real)], "codes": [c.tobytes() for c in codes], "error": error})

    def probe(batches):
        for b in batches:
            for i in range(0, len(b), QUERIES):
                p = b.iloc[i : i + QUERIES]
                x = np.stack(p["embedding"].to_numpy()).astype(np.float64)
                row, cell = book.value.probes(units(x), reach * share)
                label, rep, copies, x = p["label"].to_numpy(), p["rep"].to_numpy(), p["copies"].to_numpy(), x.astype(real)
                code, names = pd.factorize(label)
                order = np.lexsort((row, cell, code[row]))
                row, cell = row[order], cell[order]
                new = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (code[row][1:] != code[row][:-1])))
                packs = [row[s:e] for s, e in zip(new, np.append(new[1:], len(row)), strict=True)]
                yield pd.DataFrame({"label": [names[code[k[0]]] for k in packs], "cell": cell[new], "n": [len(k) for k in packs], "reps": [rep[k].astype("<i8").tobytes() for k in packs], "many": [copies[k].astype("<i8").tobytes() for k in packs], "vectors": [x[k].tobytes() for k in packs]})

    members = materialize(reps.mapInPandas(encode, f"label {kinds['label']}, cell int, rep long, copies long, vector binary, codes binary, error double"))
    queries = materialize(reps.mapInPandas(probe, f"label {kinds['label']}, cell int, n long, reps binary, many binary, vectors binary"))
    sizes = members.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks"))
    asks = queries.groupBy("label", "cell").agg(F.ceil(F.sum("n") / QUERIES).cast("int").alias("chunks"))
    both = materialize(sizes.join(asks, ["label", "cell"]))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c, s, k: F.pmod(F.xxhash64(F.lit(s), k), F.col(c)).cast("int")
    key = ["label", "cell", "block", "chunk"]
    left = members.join(both, ["label", "cell"]).withColumn("block", part("blocks", 1, "rep")).withColumn("chunk", upto("chunks"))
    right = queries.join(both.toDF(*both.columns), ["label", "cell"]).withColumn("chunk", part("chunks", 2, "reps")).withColumn("block", upto("blocks"))

    def match(m: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(m) or not len(q):
            return pd.DataFrame({"u": [], "v": [], "n": []}).astype({"u": "int64", "v": "Int64", "n": "int64"})
        unpack = lambda c, kind: np.frombuffer(b"".join(c), kind)
        ids, many, error = m["rep"].to_numpy(), m["copies"].to_numpy(), m["error"].to_numpy()
        x = units(unpack(m["vector"], real).reshape(len(m), -1).astype(np.float64))
        codes = unpack(m["codes"], np.uint8).reshape(len(m), -1)
        asked, own = unpack(q["reps"], "<i8"), unpack(q["many"], "<i8")
        y = units(unpack(q["vectors"], real).reshape(len(asked), -1).astype(np.float64))
        nodes, at = np.unique(np.concatenate([ids, asked]), return_inverse=True)
        forest, counts = Forest(len(nodes)), np.zeros(len(asked), np.int64)
        for i in range(0, len(asked), 512):
            near = book.value.lookup(y[i : i + 512], int(m["cell"].iloc[0]), codes) <= reach + error[None, :] + 1e-9
            a, b = np.nonzero(near)
            for j in range(0, len(a), 200_000):
                s, t = a[j : j + 200_000] + i, b[j : j + 200_000]
                cosine = np.einsum("ij,ij->i", y[s], x[t])
                hit = (cosine >= threshold) & (asked[s] != ids[t])
                s, t = s[hit], t[hit]
                np.add.at(counts, s, many[t])
                for c, d in zip(*stars(at[len(ids) + s], at[t]), strict=True):
                    forest.union(int(c), int(d))
        counts += np.where(np.isin(asked, ids), own - 1, 0)
        roots = np.array([forest.find(k) for k in range(len(nodes))])
        moved = roots != np.arange(len(nodes))
        some = counts > 0
        u = np.concatenate([nodes[moved], asked[some]])
        v = pd.array(np.concatenate([nodes[roots[moved]], np.zeros(some.sum(), np.int64)]), dtype="Int64")
        v[int(moved.sum()) :] = pd.NA
        return pd.DataFrame({"u": u, "v": v, "n": np.concatenate([np.zeros(moved.sum(), np.int64), counts[some]])})

    return left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(lambda m, q: match(m, q), "u long, v long, n long")
