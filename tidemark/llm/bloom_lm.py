"""Language-model scoring with a log-frequency Bloom filter.

Training counts words and pairs of words exactly, in segments of the hash space. A count is quantised to a level of a roughly
geometric scale, and the filter holds (n-gram, 1), (n-gram, 2), ... up to its level, so that probing until one is missing gives the
level back: false positives can only raise a count, and ever less likely the further. Kept are all words, all pairs and, for each word
that begins a pair, the mass that discounting leaves for other words; it begins as many pairs as there are of it. A text's probability is the product over its
words and its end of

    P(w | h) = (max(c(h w) - D, 0) + left(h) * P1(w)) / c(h)   or P1(w) where h begins no pair,

with P1 the additively smoothed share of w, all counts being read from the filter. The filter and the exact word counts, for the
base score, are broadcast to the workers if they have `most_bytes` or less together. Larger ones stay in their segments: groups of
texts send each distinct word and pair there once, get its count and levels back and are scored where the group's tokens went, with
the same result. Workers read what is broadcast in place, in the file that Spark keeps of it, so a machine holds it once however many
workers it has, and none of it is a worker's own memory. There are as many segments as the texts need, so what a task sends is gathered
first: a row for each segment comes from `GROUP` tokens, and in training from up to `PAIRS` distinct pairs, not from each block of texts.

Words that are frequent in a sample of the texts (a share of `FREQUENT` or more, so a hundred thousand at most) are told apart: their
own counts are broadcast, and the pairs that the most frequent of them (`SPLIT`) begin are dealt to segments by both words. Which
words those are changes nothing but where the work is done; all counts are over all training texts.

Null texts are empty: one end token. A null doc_id counts as the empty string, so it is held out. Texts are split into words whole,
however long. Repeated rows get a score each. An empty training set gives finite scores from the smoothing alone; an empty table
gives an empty result. Extra columns, whatever their names, aren't carried.
"""

from __future__ import annotations

import copy
import mmap
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, SparkContext, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kit import LOWER_VALUES, Spans, fold, clean, materialize, packed, release, small_batches, text_blocks, word_spans

END = np.uint64(0x1F83D9ABFB41BD6B)
MULT = np.uint64(0x9FB21C651E98DF25)
WORD, PAIR, LEFT = (np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0))
DISCOUNT, ALPHA = 0.75, 0.1
BITS_PER_ITEM, MARKS = 16, 5
BLOCK, FLUSH = 1 << 20, 500_000  # bytes of text, tokens
NEAR, GROUP, PAIRS = 200_000, 1_000_000, 2_000_000  # tokens scored at once where counts are, or by exchange; distinct pairs held before they are sent
KEYS = 1 << 14  # put into a filter at once
MARK, LEAST = b"tidemark numbers", 1 << 17  # ahead of broadcast numbers; bytes that pickle writes apart from its frames
SAMPLE_BYTES, FREQUENT, SPLIT = 64 << 20, 1e-5, 1e-3


def _levels(growth: float = 1.2) -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 50:
        out.append(max(out[-1] + 1, int(out[-1] * growth)))
    return np.array(out, np.int64)


LEVELS = _levels()
VALUES_OF = np.append(0.0, (LEVELS[:-1] + LEVELS[1:] - 1) / 2)


STEPS = np.arange(len(LEVELS) + 1, dtype=np.uint64) * MULT


def level(count: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, count, "right")


def _items(keys: np.ndarray, levels: np.ndarray, kind: np.uint64, first: int = 1) -> np.ndarray:
    """One item for each level from `first` to the key's own."""
    n = np.maximum(levels - first + 1, 0)
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first
    return fold(np.repeat(keys, n) ^ (kind + STEPS)[j])


def _marks(items: np.ndarray) -> np.ndarray:
    """The bits of an item within its 64-bit word."""
    out = np.zeros(len(items), np.uint64)
    for i in range(MARKS):
        out |= np.uint64(1) << ((items >> np.uint64(6 * i)) & np.uint64(63))
    return out


def _word(items: np.ndarray, words) -> np.ndarray:
    return ((items >> np.uint64(32)) * words >> np.uint64(32)).astype(np.int64)


def _table(items: np.ndarray | Iterator[np.ndarray], count: int | None = None) -> bytes:
    """A blocked filter: one word of memory, so one look, for each item. Items may come in several arrays, with their number."""
    n = max(1, -(-(len(items) if count is None else count) * BITS_PER_ITEM // 64))
    table = np.zeros(n, np.uint64)
    for some in [items] if count is None else items:
        at, marks = _word(some, np.uint64(n)), _marks(some)
        order = np.argsort(at, kind="stable")
        at, marks = at[order], marks[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
        if len(first):
            table[at[first]] |= np.bitwise_or.reduceat(marks, first)
    return table.astype("<u8").tobytes()


def _filled(*sets: tuple[np.ndarray, np.ndarray, np.uint64]) -> bytes:
    """The filter of keys, their levels and kind; made of some keys at a time."""
    some = (_items(keys[i : i + KEYS], levels[i : i + KEYS], kind) for keys, levels, kind in sets for i in range(0, len(keys), KEYS))
    return _table(some, sum(int(levels.sum()) for _, levels, _ in sets))


class Filter:
    """The tables of some segments end to end."""

    def __init__(self, segments: int, tables: dict[int, bytes]):
        self.loaded = np.zeros(segments, bool)
        self.base, self.size, self.used = np.zeros(segments, np.int64), np.ones(segments, np.uint64), 0
        self.words = np.zeros(sum(map(len, tables.values())) // 8, "<u8")
        for s, t in tables.items():
            self.put(s, t)

    def put(self, segment: int, table: bytes) -> None:
        self.loaded[segment], self.base[segment], self.size[segment] = True, self.used, len(table) // 8
        self.words[self.used : self.used + len(table) // 8] = np.frombuffer(table, "<u8")
        self.used += len(table) // 8

    def has(self, segment: np.ndarray, items: np.ndarray) -> np.ndarray:
        marks = _marks(items)
        return self.words[self.base[segment] + _word(items, self.size[segment])] & marks == marks

    def levels(self, segment: np.ndarray, keys: np.ndarray, kind: np.uint64, first: int = 1) -> np.ndarray:
        """Levels by repeated membership probes."""
        out = np.full(len(keys), first - 1, np.int64)
        live, j = np.flatnonzero(self.loaded[segment]), first
        steps = kind + STEPS
        while len(live) and j < len(LEVELS):
            live = live[self.has(segment[live], fold(keys[live] ^ steps[j]))]
            out[live] = j
            j += 1
        return np.where(out == first - 1, 0, out)


def held_out(ids: list) -> np.ndarray:
    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i in ids), bool, len(ids))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, each text's followed by the end, and where each text's begin."""
    starts, ends, first = word_spans(data, offsets)
    words = Spans(data, LOWER_VALUES).hash(starts, ends) if len(data) else np.zeros(0, np.uint64)
    out = np.insert(words, first[1:], END)
    return out, first + np.arange(len(first))


def histories(t: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The token before each; a text begins after an end."""
    h = np.append(END, t[:-1])
    h[begin[:-1]] = END
    return h


def _segment(keys: np.ndarray, segments: int) -> np.ndarray:
    """Ranges of the hash space, so that segments one after another are sorted."""
    return (keys >> np.uint64(44)).astype(np.int64) * segments >> 20


def _among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys if len(some) else np.zeros(len(keys), bool)


class Layout:
    """Which segment holds a word and a pair; frequent words have one of their own, the last."""

    def __init__(self, segments: int, frequent: np.ndarray, split: np.ndarray):
        self.segments, self.frequent, self.split = segments, np.sort(frequent), np.sort(split)

    def word(self, w: np.ndarray) -> np.ndarray:
        return np.where(_among(w, self.frequent), self.segments, _segment(w, self.segments))

    def pair(self, h: np.ndarray, key: np.ndarray) -> np.ndarray:
        return np.where(_among(h, self.split), _segment(key, self.segments), _segment(h, self.segments))


def pair_keys(h: np.ndarray, w32: np.ndarray) -> np.ndarray:
    return fold(h * MULT + w32.astype(np.uint64))


def frequent_words(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Words, as hashes, that are frequent in a sample of the texts, and the most frequent of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_blocks(batch, most=BLOCK):
                w, n = np.unique(tokens(data, offsets)[0], return_counts=True)
                some = n >= FREQUENT / 10 * n.sum()  # rarer ones here don't count
                yield pa.RecordBatch.from_arrays([pa.array(np.append(w[some].view(np.int64), 0)), pa.array(np.append(n[some], 0)), pa.array(np.append(np.zeros(some.sum(), np.int64), n.sum()))], ["w", "n", "tokens"])

    drawn = docs.select("text") if size <= SAMPLE_BYTES else docs.select("text").sample(SAMPLE_BYTES / size, seed=17)
    counted = drawn.mapInArrow(run, "w long, n long, tokens long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    counted = materialize(counted)
    total = counted.agg(F.sum("tokens")).first()[0] or 0
    rows = counted.filter((F.col("n") > 0) & (F.col("n") >= FREQUENT * total)).select("w", "n").collect()
    words, many = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)
    return words, words[many >= SPLIT * total]


def _left(word: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    return word, level(np.rint(DISCOUNT * kinds).astype(np.int64) + 1), LEFT


def pair_batches(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    """Pairs of words of the training texts and their counts, as few rows a segment as memory allows. A column goes when its next form is there."""
    held, count, sets, distinct = [], 0, [], 0

    def joined(rows: list[tuple | list]) -> list[np.ndarray]:
        columns = [list(x) for x in zip(*rows, strict=True)]
        rows.clear()
        for i, x in enumerate(columns):
            columns[i] = np.concatenate(x)
            x.clear()
        return columns

    def taken(columns: list[np.ndarray], at: np.ndarray) -> None:
        for i in range(len(columns)):
            columns[i] = columns[i][at]

    def summed(columns: list[np.ndarray]) -> list[np.ndarray]:
        taken(columns, np.lexsort((columns[1], columns[0])))
        new = np.flatnonzero(np.append(True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])))
        n = np.add.reduceat(columns.pop(), new)
        taken(columns, new)
        return [*columns, n]

    def count_held() -> None:
        h, w = joined(held)
        sets.append(summed([h, (w >> np.uint64(32)).astype(np.uint32), np.ones(len(h), np.int64)]))

    def merge() -> None:
        if len(sets) > 1:
            sets.append(summed(joined(sets)))

    def flush() -> pa.RecordBatch:
        columns = sets.pop()
        some = ([x[i : i + KEYS] for x in columns[:2]] for i in range(0, len(columns[0]), KEYS))
        columns.append(np.concatenate([layout.pair(h, pair_keys(h, w)).astype(np.int32) for h, w in some]))
        taken(columns, np.argsort(columns[3], kind="stable"))
        h, w, n, seg = columns
        columns.clear()
        head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (seg[1:] != seg[:-1])))
        fan = np.diff(np.append(head, len(h))).astype("<u4")
        h = h[head]
        first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        cut = np.append(first, len(seg))
        heads, seg, big = np.searchsorted(head, cut), seg[first], n > 254
        del head
        large = packed(n[big].astype("<i8"), np.append(0, np.cumsum(big))[cut])
        n = np.minimum(n, 255).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array(seg), packed(h, heads), packed(fan, heads), packed(w, cut), packed(n, cut), large], ["segment", "heads", "fans", "nexts", "counts", "large"])

    for batch in batches:
        for part, data, offsets in text_blocks(batch, most=BLOCK):
            t, begin = tokens(data, offsets)
            use = np.repeat(~held_out(part.column("doc_id").to_pylist()), np.diff(begin))
            held.append((histories(t, begin)[use], t[use]))
            count += int(use.sum())
            if count > FLUSH:
                count_held()
                count, distinct = 0, distinct + len(sets[-1][0])
            if distinct > PAIRS:
                merge()
                if len(sets[0][0]) > PAIRS // 2:
                    yield flush()
                distinct = sum(len(x[0]) for x in sets)
    if count:
        count_held()
    if sets:
        merge()
        yield flush()


def train(docs: DataFrame, layout: Layout) -> DataFrame:
    """One row per segment: words and counts (sorted by word; without frequent ones), the tables of words and of pairs, n_tokens,
    n_types, and what the segment has of frequent words: their hashes, counts and numbers of kinds of followers."""

    def build(p: pd.DataFrame) -> pd.DataFrame:
        cat = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in p[c]])
        h = np.repeat(cat("heads", np.uint64), cat("fans", "<u4"))
        w, n = cat("nexts", np.uint32), cat("counts", np.uint8).astype(np.int64)
        n[n == 255] = cat("large", "<i8")
        order = np.lexsort((w, h))
        h, w, n = h[order], w[order], n[order]
        new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])))
        h, w, n = h[new], w[new], np.add.reduceat(n, new)
        head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        word, total, kinds = h[head], np.add.reduceat(n, head), np.diff(np.append(head, len(h)))
        often = _among(word, layout.frequent)
        own, sums, many = word[~often], total[~often], kinds[~often]
        pairs = [(pair_keys(h, w), level(n), PAIR), _left(own, many)]
        some = [x[often].tobytes() for x in (word, total.astype("<i8"), kinds.astype("<i8"))]
        return pd.DataFrame([(p["segment"].iloc[0], own.tobytes(), sums.astype("<i8").tobytes(), _filled((own, level(sums), WORD)), _filled(*pairs), int(total.sum()), len(own), *some)], columns=["segment", "words", "counts", "word_bits", "pair_bits", "n_tokens", "n_types", "often", "often_counts", "often_kinds"])

    shuffled = docs.select("doc_id", "text").mapInArrow(lambda batches: pair_batches(batches, layout), "segment int, heads binary, fans binary, nexts binary, counts binary, large binary")
    return shuffled.groupBy("segment").applyInPandas(build, "segment int, words binary, counts binary, word_bits binary, pair_bits binary, n_tokens long, n_types long, often binary, often_counts binary, often_kinds binary")


def numbers_to_send(count: int) -> tuple[bytearray, np.ndarray]:
    """Bytes to broadcast and as many numbers of 64 bits in them, aligned in the file of the broadcast."""
    head = pickle.dumps(bytearray(MARK + bytes(LEAST)), pickle.HIGHEST_PROTOCOL).index(MARK)
    pad = -(head + len(MARK)) % 8
    store = bytearray(pad + len(MARK) + max(8 * count, LEAST))
    store[pad : pad + len(MARK)] = MARK
    return store, np.frombuffer(store, "<u8", count, pad + len(MARK))


def numbers_sent(shared: Broadcast, count: int) -> np.ndarray:
    """These numbers in a worker: its machine's file of the broadcast, mapped. A copy if there is none (Spark encrypts it) or it is laid out differently."""
    if getattr(shared, "_path", None):
        with open(shared._path, "rb") as file:
            held = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        at = held.find(MARK, 0, 256) + len(MARK)
        if at >= len(MARK) and at % 8 == 0 and at + 8 * count <= len(held):
            return np.frombuffer(held, "<u8", count, at)
    return np.frombuffer(shared.value, "<u8", count, shared.value.index(MARK) + len(MARK)).copy()


class Model:
    """What is broadcast: exact counts of frequent words and their part of the filter, and, if they fit, all of both. Its numbers go apart."""

    def __init__(self, model: DataFrame, layout: Layout, most_bytes: int):
        columns, last = ("words", "counts", "word_bits", "pair_bits"), layout.segments
        sums = model.agg(F.sum("n_tokens"), F.sum("n_types"), *(F.sum(F.length(c)) for c in columns)).first()

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                cat = lambda c, t, p=p: np.concatenate([np.zeros(0, t), *(np.frombuffer(x, t) for x in p[c])])
                yield pd.DataFrame({"w": cat("often", "<i8"), "n": cat("often_counts", "<i8"), "kinds": cat("often_kinds", "<i8")})

        often = model.select("often", "often_counts", "often_kinds").mapInPandas(each, "w long, n long, kinds long").groupBy("w").agg(F.sum("n"), F.sum("kinds")).collect()
        often = np.array([tuple(r) for r in often], np.int64).reshape(-1, 3)
        often = often[np.argsort(often[:, 0].view(np.uint64))]
        words, counts = often[:, 0].copy().view(np.uint64), often[:, 1].copy()
        self.total, self.types = sums[0] or 0, (sums[1] or 0) + len(often)
        room = [x or 0 for x in sums[2:]]
        self.whole = sum(room) <= most_bytes
        if not self.whole:
            room = [0] * 4
        tables = _filled((words, level(counts), WORD)), _filled(_left(words, often[:, 2]))
        self.word_filter, self.pair_filter = Filter(last + 1, {}), Filter(last + 1, {})
        sizes = [len(often), len(often), room[0] // 8, room[1] // 8, *((len(t) + x) // 8 for t, x in zip(tables, room[2:], strict=True))]
        self.ends = np.cumsum(sizes)
        self.store, numbers = numbers_to_send(int(self.ends[-1]))
        self.place(numbers)
        self.often[:], self.often_counts[:] = words, counts
        for f, t in zip((self.word_filter, self.pair_filter), tables, strict=True):
            f.put(last, t)
        if not self.whole:
            return
        lengths = sorted((r[0], r[1] // 8) for r in model.select("segment", F.length("words")).collect())
        begin = dict(zip([k for k, _ in lengths], np.cumsum([0, *(n for _, n in lengths)]).tolist()))
        for r in model.select("segment", *columns).toLocalIterator():
            own, at = np.frombuffer(r["words"], np.uint64), begin[r["segment"]]
            self.words[at : at + len(own)], self.counts[at : at + len(own)] = own, np.frombuffer(r["counts"], "<i8")
            self.word_filter.put(r["segment"], r["word_bits"])
            self.pair_filter.put(r["segment"], r["pair_bits"])

    def place(self, numbers: np.ndarray) -> None:
        self.often, often_counts, self.words, counts, self.word_filter.words, self.pair_filter.words = np.split(numbers, self.ends[:-1])
        self.often_counts, self.counts = often_counts.view("<i8"), counts.view("<i8")

    def send(self, context: SparkContext) -> tuple[Broadcast, Broadcast]:
        """Broadcast; what is here is empty then."""
        self.place(np.zeros(0, "<u8"))
        store, self.store = self.store, None
        return context.broadcast(self), context.broadcast(store)

    @staticmethod
    def sent(shared: tuple[Broadcast, Broadcast]) -> Model:
        """In a worker. Nothing of it stays when it goes."""
        out = copy.deepcopy(shared[0].value)
        out.place(numbers_sent(shared[1], int(out.ends[-1])))
        return out

    def exact(self, w: np.ndarray) -> np.ndarray:
        """Counts of the words that it has; 0 for any other."""
        out = np.zeros(len(w), np.int64)
        for words, counts in ((self.often, self.often_counts), (self.words, self.counts)):
            if len(words):
                at = np.minimum(np.searchsorted(words, w), len(words) - 1)
                out = np.where(words[at] == w, counts[at], out)
        return out


class Parts:
    """The distinct words (sorted) and pairs of a group, and where its tokens find theirs. Every history is a word or an end of the group."""

    def __init__(self, word: np.ndarray, of_word: np.ndarray, begin: np.ndarray, layout: Layout):
        self.word, self.of_word = word, of_word
        n, end = len(self.word), np.searchsorted(self.word, END)
        self.of_head = np.append(end, self.of_word[:-1])[: len(of_word)]
        self.of_head[begin[:-1]] = end
        pair, self.of_pair = np.unique(self.of_head * n + self.of_word, return_inverse=True)
        h = self.word[pair // n] if n else self.word
        self.pair = pair_keys(h, (self.word[pair % n] >> np.uint64(32)).astype(np.uint32)) if n else self.word
        self.word_at, self.pair_at = layout.word(self.word), layout.pair(h, self.pair)

    def probe(self, words: Filter, pairs: Filter) -> tuple[np.ndarray, ...]:
        """Levels of words, of what they leave as histories and of pairs; 0 where the segment isn't loaded."""
        return words.levels(self.word_at, self.word, WORD), pairs.levels(self.word_at, self.word, LEFT), pairs.levels(self.pair_at, self.pair, PAIR)

    def logs(self, levels: tuple[np.ndarray, ...], total: int, types: int) -> np.ndarray:
        """log10 P of each token after its history."""
        word, left, pair = (VALUES_OF[x] for x in levels)
        p1 = ((word + ALPHA) / (total + ALPHA * (types + 1)))[self.of_word]
        rest, n, begins = (x[self.of_head] for x in (np.maximum(left - 1, 0.5), word, (left > 0) & (word > 0)))
        c = np.minimum(pair[self.of_pair], n)
        p = np.where(begins, (np.where(c > 0, c - DISCOUNT, 0) + rest * p1) / np.maximum(n, rest), p1)
        return np.log10(np.minimum(p, 1.0))


def groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of some rows, of about so many tokens, which of them are held out, their tokens, and where each row's begin."""
    ids, held, some, sizes, count = [], [], [], [], 0

    def group() -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        out = list(ids), np.concatenate(held), np.concatenate(some), np.append(0, np.cumsum(np.concatenate(sizes)))
        for x in (ids, held, some, sizes):
            x.clear()
        return out

    for batch in batches:
        for part, data, offsets in text_blocks(batch, most=BLOCK):
            t, begin = tokens(data, offsets)
            ids += part.column("doc_id").cast(pa.int64()).to_pylist()
            held.append(held_out(part.column("doc_id").to_pylist()))
            some.append(t)
            sizes.append(np.diff(begin))
            count += len(t)
            if count >= most:
                yield group()
                count = 0
    if count:
        yield group()


def _planes(x: np.ndarray) -> np.ndarray:
    """Numbers as four planes of bytes, the upper ones almost all zeros, which shuffles compress."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel()


def _of_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _row_sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begin[:-1]) if len(begin) > 1 else np.zeros(0)


def score(docs: DataFrame, segments: int | None = None, most_bytes: int = 256 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text)."""
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    if segments is None:  # a segment's counts fit a task's memory
        segments = max(8, min(1 << 17, size // (8 << 20)))
    spark = docs.sparkSession
    layout = Layout(segments, *frequent_words(docs, size))
    with small_batches(spark):
        trained = materialize(train(docs, layout))
    model = Model(trained, layout, most_bytes)
    total, types, whole = model.total, model.types, model.whole
    shared = model.send(spark.sparkContext)
    del model  # the driver needs its copy no more
    scored = ["doc_id", "held_out", "n_tokens", "log_sum", "n_known", "score"]

    def sums(parts: Parts, begin: np.ndarray, exact: np.ndarray, levels: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        """Of each row: tokens, the base score's sum of logarithms, known tokens, score."""
        return [np.diff(begin), _row_sums(np.log10(exact + ALPHA)[parts.of_word], begin), _row_sums((exact > 0).astype(np.int64)[parts.of_word], begin), _row_sums(parts.logs(levels, total, types), begin)]

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.sent(shared)
        for ids, held, t, begin in groups(batches, NEAR):
            parts = Parts(*np.unique(t, return_inverse=True), begin, layout)
            rows = sums(parts, begin, model.exact(parts.word), parts.probe(model.word_filter, model.pair_filter))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held), *map(pa.array, rows)], scored)

    names = ["segment", "block", "ids", "known_ids", "held", "vocabulary", "codes", "begin", "words", "pairs"]
    out = [*names[:8], "answers"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each group of texts a row of its own (negative segment), and one for each segment that has something to say of it."""
        block = TaskContext.get().partitionId() << 32
        for ids, held, t, begin in groups(batches, GROUP):
            parts, at = Parts(*np.unique(t, return_inverse=True), begin, layout), []
            for own, keys in ((parts.word_at, parts.word), (parts.pair_at, parts.pair)):
                order = np.argsort(own, kind="stable")
                order = order[: np.searchsorted(own[order], segments)]
                at.append((own[order], keys[order]))
            used = np.unique(np.concatenate([seg for seg, _ in at]))
            columns = [pa.array(np.append(-1 - block, used)), pa.array(np.full(len(used) + 1, block))]
            alone = [np.array([i or 0 for i in ids], "<i8"), np.array([i is not None for i in ids], np.uint8), held.astype(np.uint8), parts.word, _planes(parts.of_word), begin.astype("<i8")]
            columns += [packed(x, np.append([0], np.full(len(used) + 1, len(x)))) for x in alone]
            columns += [packed(keys, np.concatenate([[0], np.searchsorted(seg, used), [len(seg)]])) for seg, keys in at]
            yield pa.RecordBatch.from_arrays(columns, names)
            block += 1

    def look(p: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        """Rows of groups pass; others become counts and levels of what was asked."""
        if not len(p):
            return pd.DataFrame({c: [] for c in out}).astype({"segment": "int64", "block": "int64"})
        if p["segment"].iloc[0] < 0:
            return p.assign(answers=b"")[out]
        words = np.frombuffer(m["words"].iloc[0], np.uint64) if len(m) else np.zeros(0, np.uint64)
        counts = np.frombuffer(m["counts"].iloc[0], "<i8") if len(m) else np.zeros(0, np.int64)
        bits = [Filter(1, {0: bytes(m[c].iloc[0]) if len(m) else bytes(8)}) for c in ("word_bits", "pair_bits")]
        answers = []
        for w, pairs in zip(p["words"], p["pairs"], strict=True):
            w, pairs = np.frombuffer(w, np.uint64), np.frombuffer(pairs, np.uint64)
            at = np.minimum(np.searchsorted(words, w), max(len(words) - 1, 0))
            n = np.where(words[at] == w, counts[at], 0) if len(words) else np.zeros(len(w), np.int64)
            levels = [f.levels(np.zeros(len(k), np.int64), k, kind) for f, k, kind in ((bits[0], w, WORD), (bits[1], w, LEFT), (bits[1], pairs, PAIR))]
            answers.append(n.astype("<i8").tobytes() + np.concatenate(levels).astype(np.uint8).tobytes())
        return p[["segment", "block"]].assign(**dict.fromkeys(names[2:8], b""), answers=answers)

    def add(p: pd.DataFrame) -> pd.DataFrame:
        """The rows of a group with everything that segments know of them."""
        p = p.sort_values("segment")
        own, model = p.iloc[0], Model.sent(shared)
        begin = np.frombuffer(own["begin"], "<i8")
        parts = Parts(np.frombuffer(own["vocabulary"], np.uint64), _of_planes(own["codes"]), begin, layout)
        exact, levels = model.exact(parts.word), parts.probe(model.word_filter, model.pair_filter)  # of frequent words
        asked = []
        for at in (parts.word_at, parts.pair_at):
            order = np.argsort(at, kind="stable")
            asked.append((order, np.searchsorted(at[order], p["segment"].to_numpy(), "left"), np.searchsorted(at[order], p["segment"].to_numpy(), "right")))
        for i, got in enumerate(p["answers"]):
            if i:
                w, pairs = (order[a[i] : b[i]] for order, a, b in asked)
                exact[w] = np.frombuffer(got, "<i8", len(w))
                a = 8 * len(w)
                for k, level_ in zip((w, w, pairs), levels, strict=True):
                    level_[k] = np.frombuffer(got, np.uint8, len(k), a)
                    a += len(k)
        ids = pd.array(np.frombuffer(own["ids"], "<i8"), dtype="Int64")
        ids[np.frombuffer(own["known_ids"], np.uint8) == 0] = pd.NA
        return pd.DataFrame(dict(zip(scored, [ids, np.frombuffer(own["held"], np.uint8) > 0, *sums(parts, begin, exact, levels)], strict=True)))

    kinds = {"segment": "long", "block": "long"}
    schema = lambda columns: ", ".join(f"{c} {kinds.get(c, 'binary')}" for c in columns)
    row = "doc_id long, held_out boolean, n_tokens long, log_sum double, n_known long, score double"
    texts = docs.select("doc_id", "text")
    if whole:
        rows = texts.mapInArrow(here, row)
    else:
        own = trained.select(F.col("segment").cast("long").alias("segment"), "words", "counts", "word_bits", "pair_bits")
        looked = texts.mapInArrow(send, schema(names)).groupBy("segment").cogroup(own.groupBy("segment")).applyInPandas(look, schema(out))
        rows = looked.groupBy("block").applyInPandas(add, row)
    clean(spark)
    with small_batches(spark):
        rows = materialize(rows)
    for x in shared:
        x.destroy()
    release(trained)
    norm = float(np.log10(total + ALPHA * (types + 1)))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("log_sum") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score")
