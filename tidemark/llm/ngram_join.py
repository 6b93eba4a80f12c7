"""N-gram Jaccard join: a size-aware, heavy-light self-join of the documents' shingle sets.

Documents with the same set are one node. Sets order their shingles by a hash, heavy shingles last; two sets that are similar
enough must share k of their first (size - least overlap + k) shingles. Small sets list the fixed-size subsets (pairs, k = 2) of
those as signatures, so that a frequent shingle alone brings nothing together; large sets go into the inverted list of each such
shingle (k = 1). Where small ends is chosen by cost: subsets listed against list entries scanned, the latter estimated from the
lists of 1/64 of the hash space. Sets just below the boundary also go into the lists, where they meet large sets only.

Lists of up to `heavy` nodes give their pairs. A shingle with a longer list is heavy, and documents with one among their first
shingles go through once more, heavy ones last. What is still in long lists is compared with one node of the list, and after that
only across components that are still apart; one table of labels says which those are and takes in every new link. Candidates first meet as parity bitmaps of about two bits a shingle: two sets
differ in at least as many shingles as their bitmaps do in bits, so pairs that differ in too many go without loss. The others are
verified exactly on whole sets, which travel once to the task of their candidate component (or slice of a large one); the links it
returns are a spanning forest.

Null ids link with nothing; null texts are empty; documents without words have no shingles and link with nothing. Texts of any length
give their whole sets. Pairs right at the threshold link; a component is called by its smallest doc_id, and of rows that repeat a
doc_id every one gets a row. Empty tables give empty results. Extra columns, whatever their names, aren't carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import Forest, components
from tidemark.llm.kit import LOWER_VALUES, Spans, fold, materialize, packed, text_blocks, word_spans

MULT = np.uint64(0x9FB21C651E98DF25)
SAMPLED = 64
BOUNDARIES = (0, 4, 8, 12, 16, 24, 32, 48)
FLUSH = 1_000_000
PAIRS_AT_ONCE = 500_000
MOST_LISTS = 64
MOST_BROADCAST = 4_000_000  # ids or shingles, eight bytes each


class Sets:
    """The shingle sets of one block of texts: sorted hashes end to end, their row and where each row's set begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int):
        starts, ends, first = word_spans(data, offsets)
        n_rows, words = len(offsets) - 1, np.diff(first)
        h = Spans(data, LOWER_VALUES).hash(starts, ends)
        row = np.repeat(np.arange(n_rows), words)
        m = max(len(h) - width + 1, 0)
        acc = np.zeros(m, np.uint64)
        for j in range(width):
            acc = acc * MULT + h[j : j + m]
        ok = row[:m] == row[width - 1 :] if m else np.zeros(0, bool)
        keys, of = [fold(acc[ok])], [row[:m][ok]]
        short = np.flatnonzero((words > 0) & (words < width))
        if len(short):
            acc = words[short].astype(np.uint64)
            for j in range(width - 1):
                there = words[short] > j
                acc[there] = acc[there] * MULT + h[first[short[there]] + j]
            keys.append(fold(acc ^ np.uint64(0x5851F42D4C957F2D)))
            of.append(short)
        key, of = np.concatenate(keys), np.concatenate(of)
        order = np.lexsort((key, of))
        key, of = key[order], of[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
        self.hash, self.row = key[new], of[new]
        self.size = np.bincount(self.row, minlength=n_rows)
        self.begin = np.append(0, np.cumsum(self.size))
        sums = np.append(np.uint64(0), np.cumsum(fold(self.hash ^ np.uint64(0x2545F4914F6CDD1D))))
        total = sums[self.begin[1:]] - sums[self.begin[:-1]]
        self.node = fold(total + self.size.astype(np.uint64) * MULT).astype(np.int64)


def least_overlap(size: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(size * threshold - 1e-9).astype(np.int64)


def firsts(sets: Sets, chosen: np.ndarray, k: int, threshold: float, heavy: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and rank of the first (size - least overlap + k) shingles of each chosen row, in the order hash, or heavy then hash."""
    key, of, size = sets.hash, sets.row, sets.size
    if heavy is not None and len(heavy):
        last = np.isin(key, heavy)
        order = np.lexsort((key, last, of))
        key = key[order]
    rank = np.arange(len(of)) - sets.begin[:-1][of]
    take = chosen[of] & (rank < (size - least_overlap(size, threshold) + k)[of])
    return of[take], key[take], rank[take]


def subsets(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every pair of a row's shingles; rows come in order."""
    rows, keys = [], []
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(row)))
    for n in np.unique(size):
        at = begin[size == n]
        a, b = np.triu_indices(n, 1)
        x, y = key[at[:, None] + a].ravel(), key[at[:, None] + b].ravel()
        keys.append(fold(np.minimum(x, y) * MULT + np.maximum(x, y)))
        rows.append(np.repeat(row[at], len(a)))
    return (np.concatenate(rows), np.concatenate(keys)) if rows else (row[:0], key[:0])


def signatures(sets: Sets, boundary: int, threshold: float, heavy: np.ndarray | None = None, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, signature and what its list says of the row. Sets of one or two shingles have no unequal partner."""
    able = (sets.size > 2) & (rows if rows is not None else True)
    small = able & (sets.size <= boundary)
    r1, k1 = subsets(*firsts(sets, small, 2, threshold, heavy)[:2])
    r2, k2, rank = firsts(sets, able & (sets.size > boundary * threshold - 1e-9), 1, threshold, heavy)
    row = np.concatenate([r1, r2])
    about = described(sets.size[row], np.concatenate([np.zeros(len(r1), np.int64), rank]), np.concatenate([np.zeros(len(r1), bool), small[r2]]))
    return row, np.concatenate([k1, k2]), about


MOST_SIZE, SHARES = (1 << 24) - 1, 512


def described(size: np.ndarray, rank: np.ndarray, only: np.ndarray) -> np.ndarray:
    """In 32 bits: a set's size (up to MOST_SIZE), the rank of its shingle as a share of it, rounded down, and whether it may only
    meet large sets."""
    share = np.where(size < MOST_SIZE, np.minimum(rank * SHARES // np.maximum(size, 1), 127), 0)
    return (np.minimum(size, MOST_SIZE).astype(np.uint32) << np.uint32(8)) | (share.astype(np.uint32) << np.uint32(1)) | only.astype(np.uint32)


def may_link(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether two sets of a list can be similar: their sizes, and, if this is the first shingle they share, what is left after it."""
    m, n = (x >> np.uint32(8)).astype(np.float64), (y >> np.uint32(8)).astype(np.float64)
    left = lambda size, z: size - np.floor(size * ((z >> np.uint32(1)) & np.uint32(127)).astype(np.float64) / SHARES)
    enough = np.minimum(left(m, x), left(n, y)) >= (m + n) * (threshold / (1 + threshold)) - 1e-6
    return (np.minimum(m, n) >= threshold * np.maximum(m, n) - 1e-9) & (enough | (np.maximum(m, n) >= MOST_SIZE)) & ~((x & y & np.uint32(1)).astype(bool))


def bitmaps(sets: Sets) -> list[bytes]:
    """For each row the parity of its shingles at each of at least two bits a shingle; shorter ones are folds of longer ones."""
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(2 * sets.size, 1))).astype(np.int64))
    end = np.cumsum(bits)
    at = (end - bits)[sets.row] + ((sets.hash >> np.uint64(8)) & (bits[sets.row] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits(np.bincount(at, minlength=end[-1] if len(end) else 0) & 1 == 1).tobytes()
    return [packed[(e - b) // 8 : e // 8] for b, e in zip(bits.tolist(), end.tolist(), strict=True)]


def plausible(nodes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose bitmaps allow enough overlap."""
    one = nodes.select("node", "n_shingles", "bitmap")
    if pairs.count() <= MOST_BROADCAST // 4:  # so few that the other nodes needn't travel
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        one = materialize(one.join(F.broadcast(ends), "node", "left_semi"))
    both = pairs.join(one.toDF("a", "na", "xa"), "a").join(one.toDF("b", "nb", "xb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for x, y, m, n in zip(*(batch.column(c).to_pylist() for c in ("xa", "xb", "na", "nb")), strict=True):
                if len(x) < len(y):
                    x, y = y, x
                i, j, bits = int.from_bytes(x), int.from_bytes(y), len(x) * 4
                while bits >= len(y) * 8:
                    i = (i >> bits) ^ (i & ((1 << bits) - 1))
                    bits //= 2
                fine.append((i ^ j).bit_count() <= (m + n) * (1 - threshold) / (1 + threshold) + 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return materialize(both.mapInArrow(run, "a long, b long"))


def describe(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """doc_id, n_shingles, node, bitmap, and the first shingles that fall in the sampled part of the hash space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_blocks(batch):
                sets = Sets(data, offsets, width)
                row, key, _ = firsts(sets, sets.size > 2, 1, threshold, None)
                some = key % np.uint64(SAMPLED) == 0
                at = np.append(0, np.cumsum(np.bincount(row[some], minlength=rows.num_rows)))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(sets.size), pa.array(sets.node), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(key[some].view(np.int64))), pa.array(bitmaps(sets), pa.binary())], ["doc_id", "n_shingles", "node", "sampled", "bitmap"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, node long, sampled array<long>, bitmap binary")


def choose_boundary(about: DataFrame, threshold: float) -> int:
    """The size up to which listing subsets costs less than scanning inverted lists."""
    entries = about.filter("node is not null").select("node", "n_shingles", F.explode("sampled").alias("h"))
    lists = entries.groupBy("h").agg(F.count_distinct("node").alias("f"))
    scanned = entries.join(lists, "h").filter(F.col("n_shingles") <= BOUNDARIES[-1]).groupBy("n_shingles").agg((F.sum("f") * SAMPLED).alias("c")).collect()
    many = about.filter(F.col("n_shingles") <= BOUNDARIES[-1]).groupBy("n_shingles").count().collect()
    scan, listed = {r[0]: r[1] for r in scanned}, {}
    for size, n in many:
        p = size - int(least_overlap(np.array([size]), threshold)[0]) + 2
        listed[size] = n * p * (p - 1) // 2
    cost = lambda x: sum(c for s, c in listed.items() if s <= x) + sum(c for s, c in scan.items() if s > x * threshold)
    return min(BOUNDARIES, key=lambda x: (cost(x), x))


def _list_entries(docs: DataFrame, width: int, threshold: float, boundary: int, segments: int, heavy, most: int) -> DataFrame:
    """List entries as arrays by segment of the hash space. A task sends at most most + 1 nodes of a signature to its segment: that
    many make it heavy. The second time (heavy given) what a task holds beyond that is in a long list anyway; such rows have negative
    segments, each its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.sort(heavy.value) if heavy is not None else None
        held: list[tuple[np.ndarray, ...]] = []
        count, beyond = 0, -1 - (TaskContext.get().partitionId() << 8)

        def rows(segment: np.ndarray, cut: np.ndarray, key, node, about) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(segment, pa.int64()), packed(key, cut), packed(node, cut), packed(about, cut)], ["segment", "keys", "nodes", "sizes"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal beyond
            key, node, about = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((node, key))
            key, node, about = key[order], node[order], about[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node, about = key[new], node[new], about[new]
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            rank = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
            more = rank > most
            if late is not None and more.any():
                yield rows(np.array([beyond]), np.array([0, more.sum()]), key[more], node[more], about[more])
                beyond -= 1
            key, node, about = key[~more], node[~more], about[~more]
            seg = (key >> np.uint64(40)).astype(np.int64) % segments
            order = np.argsort(seg, kind="stable")
            seg = seg[order]
            first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1])) if len(seg) else np.zeros(0, np.int64)
            if len(seg):
                yield rows(seg[first], np.append(first, len(seg)), key[order], node[order], about[order])

        for batch in batches:
            for part, data, offsets in text_blocks(batch):
                sets = Sets(data, offsets, width)
                able = ~part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                if late is not None:  # only rows with a heavy signature go through again
                    row, key, _ = signatures(sets, boundary, threshold, None, able)
                    able = able & (np.bincount(row[np.isin(key, late)], minlength=len(able)) > 0)
                row, key, about = signatures(sets, boundary, threshold, late, able)
                held.append((key, sets.node[row], about))
                count += len(key)
                if count >= FLUSH:
                    yield from flush()
                    count = 0
        if held:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, "segment long, keys binary, nodes binary, sizes binary")


def _unpack(p: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """key, node and description of the distinct entries, sorted."""
    key, node, about = (np.concatenate([np.frombuffer(x, t) for x in p[c]]) for c, t in (("keys", np.uint64), ("nodes", np.int64), ("sizes", np.uint32)))
    order = np.lexsort((node, key))
    key, node, about = key[order], node[order], about[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    return key[new], node[new], about[new]


def _pairs_of_lists(key, node, about, threshold: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of nodes of lists with up to `most` entries, and the entries of longer ones as a mask."""
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    length = np.diff(np.append(begin, len(key)))
    names, of = np.unique(node, return_inverse=True)
    found, held = [np.zeros(0, np.int64)], 0
    for n in np.unique(length[(length > 1) & (length <= most)]):
        at = begin[length == n]
        a, b = np.triu_indices(n, 1)
        step = max(1, PAIRS_AT_ONCE // len(a))
        for i in range(0, len(at), step):
            x, y = (at[i : i + step, None] + a).ravel(), (at[i : i + step, None] + b).ravel()
            fine = may_link(about[x], about[y], threshold)
            found.append(np.unique(of[x[fine]] * len(names) + of[y[fine]]))
            held += len(found[-1])
            if held > 4 * PAIRS_AT_ONCE:
                found = [np.unique(np.concatenate(found))]
                held = 0
    pairs = np.unique(np.concatenate(found))
    return names[pairs // max(len(names), 1)], names[pairs % max(len(names), 1)], np.repeat(length > most, length)


def join(docs: DataFrame, width: int = 5, threshold: float = 0.75, heavy: int = 32, boundary: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text). The threshold is above 2/3."""
    if not 2 / 3 < threshold <= 1:  # below, sets of two shingles have unequal partners, and signatures of pairs miss some
        raise ValueError(f"threshold {threshold} is not above 2/3 and at most 1")
    sc = docs.sparkSession.sparkContext
    about = materialize(describe(docs, width, threshold))
    if boundary is None:
        boundary = choose_boundary(about, threshold)
    total = about.agg(F.sum(F.col("n_shingles") * (1 - threshold) + 1)).first()[0] or 0
    segments = max(16, min(1 << 18, 1 << int(np.ceil(np.log2(max(1, total / 200_000))))))
    nodes = materialize(about.filter("doc_id is not null").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("bitmap").alias("bitmap"), F.min("doc_id").alias("doc_id")))

    def split(p: pd.DataFrame) -> pd.DataFrame:
        key, node, about = _unpack(p)
        a, b, long = _pairs_of_lists(key, node, about, threshold, heavy)
        late = np.unique(key[long]).view(np.int64)
        return pd.DataFrame({"kind": np.repeat([0, 1], [len(a), len(late)]), "a": np.concatenate([a, late]), "b": np.concatenate([b, late])})

    first = materialize(_list_entries(docs, width, threshold, boundary, segments, None, heavy).groupBy("segment").applyInPandas(split, "kind int, a long, b long"))
    pairs = first.filter("kind = 0").select("a", "b")
    late = materialize(first.filter("kind = 1").select("a").distinct())
    n_late = late.count()
    lists = None
    if n_late:
        chunks = -(-n_late // MOST_BROADCAST)  # more heavy signatures than that go round by round
        schema = "kind int, a long, b long, size long, small boolean"

        def entries(key, node, about) -> dict[str, np.ndarray]:
            return {"kind": np.ones(len(key), np.int64), "a": key.view(np.int64), "b": node, "size": (about >> np.uint32(8)).astype(np.int64), "small": (about & np.uint32(1)).astype(bool)}

        def again(p: pd.DataFrame) -> pd.DataFrame:
            key, node, about = _unpack(p)
            if p["segment"].iloc[0] < 0:
                return pd.DataFrame(entries(key, node, about))
            a, b, long = _pairs_of_lists(key, node, about, threshold, heavy)
            short = {"kind": np.zeros(len(a), np.int64), "a": a, "b": b, "size": np.zeros(len(a), np.int64), "small": np.zeros(len(a), bool)}
            return pd.DataFrame({c: np.concatenate([x, y]) for (c, x), y in zip(short.items(), entries(key[long], node[long], about[long]).values(), strict=True)})

        second = None
        for c in range(chunks):
            part = late if chunks == 1 else late.filter(F.pmod(F.xxhash64("a"), F.lit(chunks)) == c)
            values = sc.broadcast(np.array([r[0] for r in part.toLocalIterator()], np.int64).view(np.uint64))
            found = materialize(_list_entries(docs, width, threshold, boundary, segments, values, heavy).groupBy("segment").applyInPandas(again, schema))
            second = found if second is None else second.unionByName(found)
        pairs = pairs.unionByName(second.filter("kind = 0").select("a", "b"))
        lists = _distinct_lists(second.filter("kind = 1").select(F.col("a").alias("h"), F.col("b").alias("node"), "size", "small").distinct())
        lead = lists.groupBy("h").agg(F.min_by("node", F.xxhash64("node")).alias("lead"))
        pairs = pairs.unionByName(lists.join(lead, "h").filter("node <> lead").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")))
    pairs = materialize(pairs.distinct())
    labels = components(_verify(docs, nodes, pairs, width, threshold), roots=False)
    if lists is not None:
        labels = _long_lists(docs, nodes, lists, labels, width, threshold)
    base = about.select("doc_id", "n_shingles", "node")
    joined = base.filter("n_shingles > 0 and doc_id is not null").join(labels, "node", "left").withColumn("c", F.coalesce("component", "node"))
    smallest = joined.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    # A doc_id may come twice with different texts: its nodes then belong together through it; the smaller component stands.
    found = joined.join(smallest, "c").select("doc_id", "n_shingles", "component_id")
    rest = base.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(rest)


def _distinct_lists(lists: DataFrame) -> DataFrame:
    """One of all lists with the same nodes."""
    lists = materialize(lists)
    whole = lists.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node", "small")).alias("x"), F.sum(F.pmod(F.xxhash64(F.lit(5), "node", "small"), F.lit(1 << 30))).alias("s"))
    return materialize(lists.join(whole.groupBy("n", "x", "s").agg(F.min("h").alias("h")).select("h"), "h", "left_semi"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, component; without the components' own nodes) after more links u, v."""
    of = lambda c: links.join(labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of")), c, "left").withColumn(c, F.coalesce(f"{c}_of", c)).drop(f"{c}_of")
    links = of("u")
    both = components(of("v"), roots=False)
    moved = labels.join(both.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return materialize(moved.unionByName(both))


def _long_lists(docs: DataFrame, nodes: DataFrame, lists: DataFrame, labels: DataFrame, width: int, threshold: float, rounds: int = 2, block: int = 4096, few: int = 64, best: int = 1) -> DataFrame:
    """The labels with those links that long lists add.

    In each round every list that still spans components compares two of its nodes, one of its largest component and one of the
    others, with all nodes outside their components: at most two pairs for each list entry. When lists have no more than `few` nodes
    outside on average, or after the last round, what lies outside a list's largest component meets the list's nodes in blocks, bitmap
    against bitmap: first each of them with the `best` most alike nodes of a block, which settles most, then with all that the bitmaps
    allow, if it still lies outside.
    """

    def spanning() -> tuple[DataFrame, DataFrame]:
        apart = lists.join(labels.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
        each = apart.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("node", "size", "small"), F.xxhash64("node", F.lit(turn))).alias("lead"))
        one = F.struct("n", "c", "lead.node", "lead.size", "lead.small")
        share = each.groupBy("h").agg(F.max(one).alias("first"), F.min(one).alias("other"), F.sum("n").alias("n")).withColumn("out", F.col("n") - F.col("first.n")).filter("out > 0")
        share = materialize(share)
        return apart, share

    fit = lambda x, y: F.least(x, y) >= F.lit(threshold) * F.greatest(x, y) - 1e-9
    for turn in range(1, rounds + 2):
        apart, share = spanning()
        n, cost = share.agg(F.sum("n"), F.sum(F.col("n") * F.col("out"))).first()
        if not n:
            return labels
        if cost <= few * n or turn > rounds:
            break
        leads = share.select("h", F.explode(F.array("first", "other")).alias("lead"))
        pairs = apart.join(leads, "h").filter((F.col("c") != F.col("lead.c")) & fit(F.col("size"), F.col("lead.size")) & ~(F.col("small") & F.col("lead.small")))
        pairs = materialize(pairs.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct())
        labels = _merged(labels, _verify(docs, nodes, pairs, width, threshold))
    labels = _merged(labels, _verify(docs, nodes, _alike(apart, share, nodes, threshold, block, best), width, threshold))
    turn += 1
    apart, share = spanning()
    if share.isEmpty():
        return labels
    return _merged(labels, _verify(docs, nodes, _alike(apart, share, nodes, threshold, block, None), width, threshold))


def _alike(apart: DataFrame, share: DataFrame, nodes: DataFrame, threshold: float, block: int, best: int | None) -> DataFrame:
    """Pairs, of a list's nodes outside its largest component with its others, that bitmaps allow.

    With `best`, each of them asks only its largest list, and gets the `best` most alike nodes of a block. Else a pair that shares
    several lists comes from the first of them: rows carry their nodes' lists (the first MOST_LISTS, beyond which a pair may come twice).
    """
    share = share.select("h", "n", F.col("first.c").alias("main"), F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil(F.col("out") / block).cast("int").alias("chunks"))
    rows = apart.join(share, "h").join(nodes.select("node", "bitmap"), "node")
    if best is None:
        own = apart.join(share.select("h"), "h", "left_semi").groupBy("node").agg(F.slice(F.array_sort(F.collect_set("h")), 1, MOST_LISTS).alias("others"))
        rows = rows.join(own, "node")
    else:
        rows = rows.withColumn("others", F.array().cast("array<long>"))
    rows = materialize(rows)
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c, seed: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(c)).cast("int")
    cols, key = ["h", "block", "chunk", "node", "size", "small", "c", "bitmap", "others"], ["h", "block", "chunk"]
    members = rows.withColumn("block", part("blocks", 1)).withColumn("chunk", upto("chunks")).select(cols)
    others = rows.toDF(*rows.columns).filter("c <> main")
    if best is not None:
        others = others.groupBy("node").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "node")), F.struct("n", "h")).alias("r")).select("node", "r.*")
    others = others.withColumn("chunk", part("chunks", 2)).withColumn("block", upto("blocks")).select(cols)

    def match(m: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros((0, 2), np.int64)]
        if len(m) and len(o):
            pack = lambda p: {n: (np.flatnonzero(p["bitmap"].map(len) == n), np.stack([np.frombuffer(x, np.uint8) for x in p["bitmap"][p["bitmap"].map(len) == n]])) for n in sorted(set(p["bitmap"].map(len)))}
            fold_ = lambda x, n: x if x.shape[1] == n else fold_(x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :], n)
            cols_ = lambda p: (p["node"].to_numpy(), p["size"].to_numpy(), p["c"].to_numpy(), p["small"].to_numpy())
            (node, size, comp, small), (node2, size2, comp2, small2) = cols_(m), cols_(o)
            own, lists_m, lists_o = int(m["h"].iloc[0]), m["others"].to_list(), o["others"].to_list()
            before = {"m": {}, "o": {}}

            def first_here(a: int, b: int) -> bool:
                for name, lists, k in (("m", lists_m, a), ("o", lists_o, b)):
                    if k not in before[name]:
                        before[name][k] = {x for x in lists[k].tolist() if x < own}
                return before["m"][a].isdisjoint(before["o"][b])

            for n, (i, x) in pack(m).items():
                for k, (j, y) in pack(o).items():
                    if max(n, k) > 2 * min(n, k):
                        continue  # sizes differ too much
                    u, v = fold_(x, min(n, k)), fold_(y, min(n, k))
                    step = max(1, (4 << 20) // u.size)
                    for at in range(0, len(j), step):
                        t = j[at : at + step]
                        apart_ = np.bitwise_count(u[None, :, :] ^ v[at : at + step, None, :]).sum(2, dtype=np.int32)
                        total = size[i][None, :] + size2[t][:, None]
                        ok = (apart_ <= total * (1 - threshold) / (1 + threshold) + 1e-9) & (comp[i][None, :] != comp2[t][:, None]) & ~(small[i][None, :] & small2[t][:, None])
                        ok &= np.minimum(size[i][None, :], size2[t][:, None]) >= threshold * np.maximum(size[i][None, :], size2[t][:, None]) - 1e-9
                        if best is not None and ok.shape[1] > best:  # the most alike of each
                            near = np.argpartition(np.where(ok, apart_ - total, np.iinfo(np.int32).max), best - 1, axis=1)[:, :best]
                            some = np.zeros_like(ok)
                            np.put_along_axis(some, near, True, axis=1)
                            ok &= some
                        p, q = np.nonzero(ok)
                        if best is None:
                            fine = np.fromiter((first_here(a, b) for a, b in zip(i[q].tolist(), t[p].tolist(), strict=True)), bool, len(p))
                            p, q = p[fine], q[fine]
                        found.append(np.sort(np.stack([node2[t][p], node[i][q]], 1), axis=1))
        out = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})

    return materialize(members.groupBy(key).cogroup(others.groupBy(key)).applyInPandas(match, "a long, b long").distinct())


def _verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, threshold: float, slice_: int = 2048) -> DataFrame:
    """Links u, v among candidate pairs a, b: exact on whole sets, a spanning forest of each task's links.

    A component with many pairs is cut into slices by its pairs' first nodes; a node that is first in very many is cut by the others.
    """
    spark = docs.sparkSession
    pairs = plausible(nodes, pairs, threshold)
    whole = materialize(components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), roots=False))
    keyed = pairs.join(whole, pairs["a"] == whole["node"], "left").withColumn("component", F.coalesce("component", "a")).drop("node")
    sizes = keyed.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / slice_).cast("int").alias("slices"))
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) * 4 / slice_).cast("int").alias("parts")).filter("parts > 1")
    part = F.pmod(F.xxhash64(F.lit(7), "b"), F.coalesce("parts", F.lit(1)))
    keyed = keyed.join(sizes, "component").join(hubs, "a", "left").withColumn("slice", F.pmod(F.xxhash64("a", part), F.col("slices")).cast("int"))
    keyed = materialize(keyed.select("a", "b", "component", "slice"))
    ends = keyed.select(F.explode(F.array("a", "b")).alias("node"), "component", "slice").distinct()
    needed = materialize(ends.select("node").distinct().join(nodes.select("node", "doc_id"), "node"))
    n = needed.count()
    few = n <= MOST_BROADCAST
    ids = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in needed.select("doc_id").toLocalIterator()], np.int64)) if few else None)
    chosen = docs.select("doc_id", "text") if few else docs.select("doc_id", "text").join(needed.select("doc_id"), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = pa.array(ids.value) if ids.value is not None else None
        for batch in batches:
            if some is not None:
                batch = batch.filter(pa.compute.is_in(batch.column("doc_id").cast(pa.int64()), some))
            for _, data, offsets in text_blocks(batch):
                sets = Sets(data, offsets, width)
                cut = [sets.hash[a:b].tobytes() for a, b in zip(sets.begin[:-1], sets.begin[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(sets.node), pa.array(cut, pa.binary())], ["node", "hashes"])

    sets = chosen.mapInArrow(run, "node long, hashes binary").join(ends, "node").select("component", "slice", "node", "hashes")

    def match(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        of = dict(zip(s["node"].tolist(), s["hashes"], strict=True))
        names = {n: k for k, n in enumerate(of)}
        forest, u, v, ready = Forest(len(names)), [], [], {}

        def get(x: int) -> np.ndarray:
            if x not in ready:
                if len(ready) > 256:
                    ready.clear()
                ready[x] = np.frombuffer(of[x], np.uint64)
            return ready[x]

        for a, b in sorted(zip(p["a"].tolist(), p["b"].tolist(), strict=True)):
            if a in names and b in names and forest.find(names[a]) != forest.find(names[b]):
                x, y = get(a), get(b)
                same = len(np.intersect1d(x, y, assume_unique=True))
                if same >= threshold * (len(x) + len(y) - same) - 1e-9:
                    forest.union(names[a], names[b])
                    u.append(a), v.append(b)
        return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    key = ["component", "slice"]
    return materialize(keyed.toDF(*keyed.columns).groupBy(key).cogroup(sets.groupBy(key)).applyInPandas(match, "u long, v long"))
