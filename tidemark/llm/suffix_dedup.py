"""Suffix-array dedup: every byte of a string of `length` bytes that also starts earlier is removed.

A sparse suffix array is enough: each window of `length` bytes picks one anchor, the position of its least `gram`-byte hash, and
equal windows pick the same one. An anchor's context is what its windows can reach, to the right and, reversed, to the left. First
the anchors' hashes are counted over the corpus, and a Bloom filter of those that repeat leaves anchors that may have a partner
(beyond `most_filter_bytes` there is no filter; the result is the same, more contexts travel). Then the contexts go through a
common-prefix-aware merge sort: tasks sort runs, of equal contexts keep the first and settle the others at once, and exchange runs
front-coded between sampled splitters; a loser tree merges the runs of a range and never compares a known common prefix again.
In the sorted order, common-prefix intervals tell which windows are equal: a window with d bytes left of its anchor occurs earlier
if an earlier context is in its interval of length - d to the right and in its interval of d to the left. Decisions are exact.

Null and empty texts have nothing to remove, and texts of any length are compared whole. Of equal strings the one with the smallest
doc_id and start stays; there are no other ties. Rows with a null doc_id have no place in that order, so they are neither compared nor
cut; rows that repeat a doc_id count as one document. Empty tables give empty results. Extra columns pass through `cut_repeats`,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kit import Spans, fresh, let_go, materialize, release, small_batches, text_blocks, tidy

LOW = np.uint64(0xFFFFFFFF)
RUN = 100_000
CUT_AT_ONCE = 4096  # contexts; their places take nine bytes for each byte
SPLIT = 32  # bytes of a context that ranges are cut by; equal windows share a gram, which isn't shorter
SAMPLED, MOST_SAMPLES, MOST_OF_GROUP = 512, 1024, 4096  # one anchor of so many; samples of one task, and of a group of tasks


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """position, hash, row and the least and greatest number of bytes left of it in the windows that pick it."""
    n, wide = len(data), length - gram + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    if n < length:
        return none
    at = np.arange(n - gram + 1)
    h = Spans(data).hash(at, at + gram)
    key = (h & ~LOW) | at.astype(np.uint64)  # leftmost of equal hashes; the order is the content's
    least, span = key, 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    if not len(row):
        return none
    starts = np.repeat(offsets[:-1], np.maximum(sizes - length + 1, 0))
    first = np.repeat(np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0), np.maximum(sizes - length + 1, 0))
    p = starts + np.arange(len(row)) - first
    owner = (least[p] & LOW).astype(np.int64)
    change = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    end = np.append(change[1:], len(owner)) - 1
    a = owner[change]
    return a, h[a], row[change], a - p[end], a - p[change]


def contexts(data: np.ndarray, offsets: np.ndarray, a: np.ndarray, row: np.ndarray, length: int, gram: int) -> np.ndarray:
    """A row of bytes for each anchor: `length` to the right, length - gram to the left reversed, and both true lengths."""
    left = length - gram
    steps = np.concatenate([np.arange(length), -1 - np.arange(left)])
    low, high = offsets[row], offsets[row + 1]
    out = np.zeros((len(a), length + left + 4), np.uint8)
    for i in range(0, len(a), CUT_AT_ONCE):
        s = slice(i, i + CUT_AT_ONCE)
        at = a[s, None] + steps
        inside = (at >= low[s, None]) & (at < high[s, None])
        out[s, : length + left] = np.where(inside, data[np.clip(at, 0, len(data) - 1)], 0)
    lens = np.stack([np.minimum(high - a, length), np.minimum(a - low, left)], 1).astype(">u2")
    out[:, length + left :] = lens.view(np.uint8).reshape(len(a), 4)
    return out


def sorted_order(rows: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable") if len(rows) else np.zeros(0, np.int64)


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before; 0 for the first."""
    if not len(rows):
        return np.zeros(0, np.int64)
    out = np.zeros(len(rows), np.int64)
    for i in range(1, len(rows), 20_000):
        differ = rows[i : i + 20_000] != rows[i - 1 : i - 1 + len(rows[i : i + 20_000])]
        out[i : i + 20_000] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def front_code(rows: np.ndarray) -> tuple[bytes, bytes]:
    """Common prefix lengths (two bytes each) and the bytes after them of sorted rows."""
    shared = common_prefixes(rows)
    return shared.astype("<u2").tobytes(), rows[np.arange(rows.shape[1])[None, :] >= shared[:, None]].tobytes()


def front_decode(shared: bytes | pa.Buffer, rest: bytes | pa.Buffer, width: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(shared, "<u2").astype(np.int64)
    rows = np.zeros((len(n), width), np.uint8)
    own = np.arange(width)[None, :] >= n[:, None]
    rows[own] = np.frombuffer(rest, np.uint8)
    index = np.arange(len(n))
    for c in range(int(n.max(initial=0))):
        source = np.maximum.accumulate(np.where(own[:, c], index, 0))
        rows[:, c] = rows[source, c]
    return rows, n


class Strings:
    """Rows of bytes as strings, each made when it is asked for."""

    def __init__(self, rows: np.ndarray):
        self.n, self.width = rows.shape
        self.bytes = memoryview(np.ascontiguousarray(rows).ravel())

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> bytes:
        return self.bytes[i * self.width : (i + 1) * self.width].tobytes()


class LoserTree:
    """Merges sorted runs of equally long strings; runs: (strings, common prefix with the string before in the run).

    Each inner node keeps the loser of its match with the loser's common prefix to that match's winner. Of two contenders, both
    measured against the last winner, the one that shares more with it is smaller; only on a tie are bytes compared, from there on.
    """

    def __init__(self, runs: list[tuple[list[bytes] | Strings, list[int]]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.k = 1 << max(1, (len(runs) - 1).bit_length())
        self.loser = [-1] * self.k
        self.shared = [0] * self.k
        self.head: list[bytes | None] = [r[0][0] if len(r[0]) else None for r in runs] + [None] * (self.k - len(runs))
        self.with_last = [0] * self.k
        self.winner = self._build(1)

    def _play(self, x: int, y: int) -> tuple[int, int, int]:
        """Winner, loser, and the loser's common prefix with the winner."""
        a, b = self.head[x], self.head[y]
        if a is None:
            return y, x, 0
        if b is None:
            return x, y, 0
        p, q = self.with_last[x], self.with_last[y]
        if p > q:
            return x, y, q
        if q > p:
            return y, x, p
        s, t = a[p:], b[p:]
        if s == t:
            return (x, y, len(a)) if x < y else (y, x, len(a))
        d = int.from_bytes(s) ^ int.from_bytes(t)
        shared = len(a) - (d.bit_length() + 7) // 8
        return (x, y, shared) if s < t else (y, x, shared)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        w, lost, shared = self._play(self._build(2 * node), self._build(2 * node + 1))
        self.loser[node], self.shared[node] = lost, shared
        if self.head[lost] is not None:
            self.with_last[lost] = shared
        return w

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(run, index in the run, common prefix with the string put out before) in order."""
        while self.head[self.winner] is not None:
            w = self.winner
            yield w, self.at[w], self.with_last[w]
            strings, shared = self.runs[w]
            self.at[w] += 1
            i = self.at[w]
            if i < len(strings):
                self.head[w], self.with_last[w] = strings[i], shared[i]
            else:
                self.head[w] = None
            node = (w + self.k) >> 1
            while node:
                other = self.loser[node]
                best, lost, common = self._play(w, other)
                self.loser[node] = lost
                if self.head[lost] is not None:
                    self.with_last[lost] = common
                w = best
                node >>= 1
            self.winner = w


def settle(rows: np.ndarray, shared: np.ndarray, doc: np.ndarray, pos: np.ndarray, least: np.ndarray, most: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context of a sorted list: least and greatest d of its windows that occur earlier (d left bytes); -1 if none."""
    n, left = len(rows), length - gram
    low, high = np.full(n, -1), np.full(n, -1)
    back = np.ascontiguousarray(rows[:, length : length + left])
    by_left = sorted_order(back)
    left_shared = common_prefixes(back[by_left])
    rank = np.empty(n, np.int64)
    rank[np.lexsort((pos, doc))] = np.arange(n)
    for d in range(left + 1):
        some = np.flatnonzero((least <= d) & (d <= most))
        if len(some) < 2:
            continue
        right_id = np.cumsum(shared < length - d)
        left_id = np.empty(n, np.int64)
        left_id[by_left] = np.cumsum(left_shared < d)
        key = right_id[some] * (n + 1) + left_id[some]
        order = np.lexsort((rank[some], key))
        key, some = key[order], some[order]
        new = np.append(True, key[1:] != key[:-1])
        first = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
        again = some[(doc[first] != doc[some]) | (pos[first] != pos[some])]
        low[again] = np.where(low[again] < 0, d, low[again])
        high[again] = d
    return low, high


def _merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as maximal runs."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def thinned(ordered, most: int):
    """At most so many of a sorted list, from all of its length."""
    return ordered[:: max(1, -(-len(ordered) // most))]


def doc_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, start and end of the maximal spans of each document."""
    if not len(doc):
        return doc, start, end
    docs, of = np.unique(doc, return_inverse=True)
    room = int(end.max()) + 2  # documents end to end, a gap between them
    first, last = _merge_spans(of * room + start, of * room + end)
    return docs[first // room], first % room, last % room


def merge_runs(p: pa.Table, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, start and end of what the front-coded runs of one range repeat."""
    width = 2 * length - gram + 4

    keys = [*zip(p["doc"].to_pylist(), p["pos"].to_pylist(), strict=True)]
    runs = sorted(range(len(keys)), key=keys.__getitem__)  # any fixed order

    def buffers(name: str) -> list[pa.Buffer]:
        found = [x.as_buffer() for x in p[name]]
        return [found[i] for i in runs]

    doc, pos, least, most = (np.concatenate([np.frombuffer(x, t) for x in buffers(c)]).astype(np.int64) for c, t in (("doc", "<i8"), ("pos", "<i8"), ("least", "<u2"), ("most", "<u2")))
    if p["segment"][0].as_py() < 0:  # settled before: all windows are repeats
        return doc_spans(doc, pos - most, pos - least + length)
    base = np.cumsum([0, *(len(keys[i][0]) // 8 for i in runs)])
    whole, prefixes = np.empty((base[-1], width), np.uint8), []
    for i, j, s, r in zip(base[:-1], base[1:], buffers("shared"), buffers("rest"), strict=True):
        whole[i:j], n = front_decode(s, r, width)
        prefixes.append(n.tolist())
    tree = LoserTree([(Strings(whole[i:j]), n) for i, j, n in zip(base[:-1], base[1:], prefixes, strict=True)])
    order, shared = np.empty(base[-1], np.int64), np.empty(base[-1], np.int64)
    for k, (run, i, common) in enumerate(tree):
        order[k], shared[k] = base[run] + i, common
    del tree, prefixes
    whole, doc, pos, least, most = (x[order] for x in (whole, doc, pos, least, most))
    low, high = settle(whole, shared, doc, pos, least, most, length, gram)
    hit = low >= 0
    return doc_spans(doc[hit], pos[hit] - high[hit], pos[hit] - low[hit] + length)


def repeated_spans(docs: DataFrame, length: int = 100, gram: int = 36, most_filter_bytes: int = 256 << 20) -> DataFrame:
    """doc_id, start, end: byte spans whose union is to be removed."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    about = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = max(8, min(1 << 14, about // (8 << 20)))
    split = min(SPLIT, gram)
    prefix, sample = f"S{split}", f"S{split + 8}"  # of a context, and with its anchor's hash

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, samples, seen = [], 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            seg = (key >> np.uint64(33)).astype(np.int64) % segments
            order = np.argsort(seg, kind="stable")
            cut = np.searchsorted(seg[order], np.arange(segments + 1))
            small, twice = (key & LOW).astype("<u4")[order], n[order] > 1
            for s in range(segments):
                i, j = cut[s], cut[s + 1]
                if j > i:
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([small[i:j].tobytes()]), pa.array([np.packbits(twice[i:j]).tobytes()])], ["segment", "keys", "twice"])

        for batch in batches:
            for _, data, offsets in text_blocks(batch):
                a, h, *_ = anchors(data, offsets, length, gram)
                held.append(h)
                count += len(h)
                picked = np.arange(-seen % SAMPLED, len(a), SAMPLED)  # by place: by content, a common string is in with all its copies or not at all
                seen += len(a)
                samples += [data[i : i + split].tobytes() + x.tobytes() for i, x in zip(a[picked].tolist(), h[picked].astype("<u8"), strict=True)]
                if count > 2_000_000:
                    yield from flush()
                    count = 0
        if held:
            yield from flush()
        chosen = b"".join(thinned(sorted(samples), MOST_SAMPLES))
        yield pa.RecordBatch.from_arrays([pa.array([-1 - TaskContext.get().partitionId() % 64], pa.int32()), pa.array([chosen], pa.binary()), pa.array([b""])], ["segment", "keys", "twice"])

    # The filter has a part for each segment of the hash space, and twelve bits or more for each repeated hash. The counts travel
    # once; only hashes that repeat are written, and the filter is filled where they lie.
    def repeats(p: pd.DataFrame) -> pd.DataFrame:
        segment = int(p["segment"].iloc[0])
        if segment < 0:  # samples of one group of tasks
            some = np.sort(np.frombuffer(b"".join(p["keys"]), sample))
            return pd.DataFrame({"segment": [segment], "n": [0], "keys": [thinned(some, MOST_OF_GROUP).tobytes()]})
        keys = np.concatenate([np.frombuffer(x, "<u4") for x in p["keys"]])
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(k) // 4) for k, t in zip(p["keys"], p["twice"], strict=True)]).astype(bool)
        order = np.argsort(keys, kind="stable")
        keys, twice = keys[order], twice[order]
        again = np.unique(np.concatenate([keys[twice], keys[1:][keys[1:] == keys[:-1]]]))
        return pd.DataFrame({"segment": [segment], "n": [len(again)], "keys": [again.tobytes()]})

    with small_batches(spark):
        repeated = materialize(texts.mapInArrow(tidy(hashes), "segment int, keys binary, twice binary").groupBy("segment").applyInPandas(repeats, "segment int, n long, keys binary"))
    sampled = np.concatenate([np.zeros(0, sample), *(np.frombuffer(r[0], sample) for r in repeated.filter("segment < 0").select("keys").collect())])
    largest = repeated.agg(F.max("n")).first()[0] or 0
    bits = 1 << max(10, int(np.ceil(np.log2(12 * max(largest, 1)))))
    use = segments * bits // 8 <= most_filter_bytes

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for segment, keys in zip(p["segment"], p["keys"], strict=True):
                table = np.zeros(bits, bool)
                for x in _probes(np.frombuffer(keys, "<u4").astype(np.uint64), bits):
                    table[x] = True
                yield pd.DataFrame({"segment": [segment], "bits": [np.packbits(table).tobytes()]})

    def passes(h: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Which hashes the filter has."""
        seg, fine = (h >> np.uint64(33)).astype(np.int64) % segments, np.ones(len(h), bool)
        for x in _probes(h & LOW, bits):
            fine &= (whole[seg, x >> np.uint64(3)] >> (np.uint8(7) - (x & np.uint64(7)).astype(np.uint8))) & 1 == 1
        return fine

    parts = sampled.view(np.uint8).reshape(-1, split + 8)
    filter_ = None
    if use:
        whole = np.zeros((segments, bits // 8), np.uint8)
        for r in repeated.filter("segment >= 0").select("segment", "keys").mapInPandas(fill, "segment int, bits binary").toLocalIterator():
            whole[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
        parts = parts[passes(np.ascontiguousarray(parts[:, split:]).view("<u8").ravel(), whole)]  # contexts that travel are cut evenly, not all
        filter_ = sc.broadcast(whole)
    starts = np.sort(np.ascontiguousarray(parts[:, :split]).view(prefix).ravel())
    splitters = np.unique(starts[np.arange(1, segments) * len(starts) // segments]) if len(starts) else np.zeros(0, prefix)
    release(repeated)
    width = 2 * length - gram + 4

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def row(seg, doc, pos, least, most, shared, rest):
            return pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), *(pa.array([x.astype(t).tobytes()]) for x, t in ((doc, "<i8"), (pos, "<i8"), (least, "<u2"), (most, "<u2"))), pa.array([shared]), pa.array([rest])], ["segment", "doc", "pos", "least", "most", "shared", "rest"])

        def flush() -> Iterator[pa.RecordBatch]:
            rows, doc, pos, least, most = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((pos, doc))
            order = order[sorted_order(rows[order])]
            rows, doc, pos, least, most = (x[order] for x in (rows, doc, pos, least, most))
            shared = common_prefixes(rows)
            same = shared == width
            first = np.maximum.accumulate(np.where(~same, np.arange(len(rows)), 0))
            again = same & ((doc != doc[first]) | (pos != pos[first]))
            if again.any():  # an equal context comes earlier: all windows of these are repeats
                yield row(-1 - TaskContext.get().partitionId() % segments, doc[again], pos[again], least[again], most[again], b"", b"")
            rows, doc, pos, least, most = (x[~same] for x in (rows, doc, pos, least, most))
            seg = np.searchsorted(splitters, np.ascontiguousarray(rows[:, :split]).view(prefix).ravel(), "right")
            cut = np.searchsorted(seg, np.arange(len(splitters) + 2))
            for s in range(len(splitters) + 1):
                i, j = cut[s], cut[s + 1]
                if j > i:
                    yield row(s, doc[i:j], pos[i:j], least[i:j], most[i:j], *front_code(rows[i:j]))

        for batch in batches:
            for part, data, offsets in text_blocks(batch):
                a, h, of, least, most = anchors(data, offsets, length, gram)
                if filter_ is not None and len(a):
                    fine = passes(h, filter_.value)
                    a, of, least, most = (x[fine] for x in (a, of, least, most))
                ids = part.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
                for i in range(0, len(a), RUN):
                    s = slice(i, i + RUN)
                    held.append((contexts(data, offsets, a[s], of[s], length, gram), ids[of[s]], a[s] - offsets[of[s]], least[s], most[s]))
                    count += len(a[s])
                    if count >= RUN:
                        yield from flush()
                        count = 0
        if count:
            yield from flush()

    def merge(p: pa.Table) -> pa.Table:
        let_go()
        found = merge_runs(p, length, gram)
        let_go()
        return pa.table(dict(zip(("doc_id", "start", "end"), found, strict=True)))

    schema = "segment int, doc binary, pos binary, least binary, most binary, shared binary, rest binary"
    return texts.mapInArrow(tidy(runs), schema).groupBy("segment").applyInArrow(merge, "doc_id long, start long, end long")


def _probes(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64(bits - 1)
    return [(keys * np.uint64(m) >> np.uint64(24)) & mask for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def with_spans(docs: DataFrame, name: str, **options) -> DataFrame:
    """docs with a column of this name: the sorted maximal spans (start, end) of bytes to remove; null if there are none."""
    found = repeated_spans(docs, **options)
    with small_batches(docs.sparkSession):
        found = materialize(found)
    id_ = fresh(docs, "_sd_doc")[0]
    lists = found.groupBy(F.col("doc_id").alias(id_)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(name))
    return docs.join(lists, docs["doc_id"] == F.col(id_), "left").drop(id_)


def _kept(raw: bytes, spans) -> tuple[bytes, int, int]:
    """What is left of the bytes, how many are removed, in how many maximal runs."""
    if spans is None or not len(spans):
        return raw, 0, 0
    start, end = _merge_spans(np.array([s["start"] for s in spans]), np.array([s["end"] for s in spans]))
    end = np.minimum(end, len(raw))
    parts = [raw[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(raw)], strict=True)]
    return b"".join(parts), int((end - start).sum()), len(start)


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs."""
    marked = with_spans(docs.select("doc_id", "text"), "spans", **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = (text.as_py() or "").encode()
                kept, removed, n = _kept(raw, spans.as_py())
                out.append((len(raw), removed, n, hashlib.sha256(kept).hexdigest()))
            a, b, c, d = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with their texts cut; where a cut parts a character, what is left of it goes too."""
    name = fresh(docs, "_sd_spans")[0]
    marked = with_spans(docs, name, **options)
    schema = marked.drop(name).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [None if t.as_py() is None else _kept(t.as_py().encode(), s.as_py())[0].decode(errors="ignore") for t, s in zip(batch.column("text"), batch.column(name), strict=True)]
            batch = batch.set_column(at, "text", pa.array(texts, pa.string()))
            yield batch.drop_columns([name])

    return marked.mapInArrow(run, schema)
