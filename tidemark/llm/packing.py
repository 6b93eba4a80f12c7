"""Best-fit packing by a configuration linear program over the length histogram.

Tokenizing gives pieces of at most `capacity` tokens. Their histogram, at most `capacity` counts whatever the corpus, goes to the
driver, where the covering program (patterns of lengths that fit one sequence, every length covered as often as it occurs) is
solved by multiplicative weights: lengths that lag behind gain weight, and a knapsack dynamic program prices the next pattern, with
no length used more often than it occurs. Patterns that fill a sequence to the last token are rounded to whole numbers, as far as
pieces last, and the program is solved again for the rest, until that places little more. Best fit packs the remainder, pattern by
pattern. Best fit by itself is tried as well; its plan stands only if it has fewer sequences. Every piece finds its sequence and
offset from its rank among the pieces of its length.

Nulls: a null text is empty, one end id; null ids stay null. A text of any length is cut into pieces of `capacity`, the first one
may be shorter. Pieces of one length are ranked by task and place in it, so ties and repeated rows, which are packed each, never
share a place. Empty tables give empty results. Columns of docs other than doc_id and text, whatever their names, aren't carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.kit import materialize, small_batches, text_blocks, tidy

POWER, RATE = 1.02, 8.0  # of the weights: start by length, fall with coverage
PRICED, SOLVES, LITTLE = 192, 12, 0.9  # lengths priced at once; solves; go on while a solve leaves less than this
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def byte_bpe_path() -> str:
    """The public byte-level vocabulary; any other tokenizer file may be given instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents. part and place: the task, and the piece's rank in it among those of its length."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidemark.llm.bpe import encoder

        encode, part, seen = encoder(tokenizer).encode, TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows, data, offsets in text_blocks(batch):
                ids, of = encode(data, offsets)
                n = of[1:] - of[:-1] + 1  # with the end
                whole = np.insert(ids, of[1:], end_id).astype("<u4")
                at = np.append(0, np.cumsum(n))
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = n - (pieces - 1) * capacity
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                begin = at[row] + start
                view = memoryview(whole.tobytes())
                crc = np.fromiter((zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(begin.tolist(), (begin + length).tolist(), strict=True)), np.int64, len(row))
                order = np.argsort(length, kind="stable")
                sorted_ = length[order]
                place = np.empty(len(row), np.int64)
                place[order] = np.arange(len(row)) - np.searchsorted(sorted_, sorted_)
                place += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [rows.column("doc_id").cast(pa.int64()).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc), pa.array(np.full(len(row), part), pa.int32()), pa.array(place)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
                if with_ids:  # pieces of a document follow each other without gaps
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(whole.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def best_pattern(weights: np.ndarray, lengths: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack by dynamic programming: how often each length, at most so often, is used in a pattern of the greatest weight."""
    best, taken = np.zeros(capacity + 1), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        left, copies = int(min(most[i], capacity // lengths[i])), 1
        while left:  # copies in powers of two
            copies = min(copies, left)
            size = int(lengths[i]) * copies
            value = best[: capacity + 1 - size] + weights[i] * copies
            better = value > best[size:]
            best[size:] = np.where(better, value, best[size:])
            taken.append((i, copies, size, better))
            left, copies = left - copies, copies * 2
    used, room = np.zeros(len(lengths), np.int64), int(best.argmax())
    for i, copies, size, better in reversed(taken):
        if room >= size and better[room - size]:
            used[i] += copies
            room -= size
    return used


Pattern = tuple[np.ndarray, np.ndarray]  # indexes of lengths, and how often each is used: a few numbers, whatever the histogram


def fractional(size: np.ndarray, want: np.ndarray, capacity: int, rounds: int, step: float, rng: np.random.Generator) -> list[tuple[Pattern, float]]:
    """Patterns and how often the covering program uses each, by multiplicative weights, in the order they were priced.

    Weights start a little above proportion to length, so that of two full patterns the one of longer pieces wins and short pieces are
    left to fill gaps. With many lengths a round prices some of them: those that lag most, and others at random.
    """
    start, cover, found = (size / capacity) ** POWER, np.zeros(len(size)), {}
    for _ in range(max(rounds, 2 * len(size))):
        share = cover / want
        if share.min() >= 1:
            break
        some = np.arange(len(size))
        if len(size) > PRICED:
            some = np.unique(np.concatenate([np.argsort(share, kind="stable")[: PRICED // 2], rng.choice(len(size), PRICED // 2, replace=False)]))
        dual = start[some] * np.exp(-RATE * (share[some] - share.min()))
        used = best_pattern(dual, size[some], want[some], capacity)
        hit, used = some[used > 0], used[used > 0]
        amount = max(1.0, float((want[hit] // used).min()) * step)
        name = hit.tobytes(), used.tobytes()
        found[name] = found.get(name, 0.0) + amount
        cover[hit] += used * amount
    return [((np.frombuffer(hit, np.int64), np.frombuffer(used, np.int64)), x) for (hit, used), x in found.items()]


def program(lengths: np.ndarray, left: np.ndarray, capacity: int, rounds: int, step: float) -> tuple[list[tuple[Pattern, int]], np.ndarray]:
    """The program's whole patterns, and what they leave of each length."""
    rng, plan, left = np.random.default_rng(1), [], left.copy()
    for _ in range(SOLVES):
        live = np.flatnonzero(left > 0)
        before = int((left * lengths).sum())
        if not before:
            break
        for (hit, used), x in fractional(lengths[live], left[live], capacity, rounds, step, rng):
            hit = live[hit]
            if int((used * lengths[hit]).sum()) < capacity:
                continue
            m = min(int(x + 0.5), int((left[hit] // used).min()))
            if m > 0:
                plan.append(((hit, used), m))
                left[hit] -= used * m
        if int((left * lengths).sum()) > LITTLE * before:
            break
    return plan, left


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """The longest piece, then always the longest that still fits; a pattern is used as often as its pieces last."""
    plan, left = [], left.copy()
    while left.any():
        whole, room = np.zeros(len(lengths), np.int64), capacity
        k = len(lengths) - 1
        while True:
            fits = np.flatnonzero((left[: k + 1] > whole[: k + 1]) & (lengths[: k + 1] <= room))
            if not len(fits):
                break
            k = int(fits[-1])
            count = min(int(left[k] - whole[k]), room // int(lengths[k]))
            whole[k] += count
            room -= count * int(lengths[k])
        hit = np.flatnonzero(whole)
        m = int((left[hit] // whole[hit]).min())
        plan.append(((hit, whole[hit]), m))
        left[hit] -= whole[hit] * m
    return plan


def solve(histogram: dict[int, int], capacity: int, rounds: int = 300, step: float = 1.0) -> list[tuple[list[int], int]]:
    """Patterns (lengths, longest first) and how often each is used; they cover the histogram exactly. rounds=0: best fit only."""
    lengths = np.array(sorted(histogram), np.int64)
    need = np.array([histogram[int(x)] for x in lengths], np.int64)
    plan = best_fit(lengths, need, capacity)
    if rounds:
        full = [((np.array([i]), np.array([1])), int(need[i])) for i in np.flatnonzero(lengths == capacity)]  # alone in any pattern
        patterns, rest = program(lengths, np.where(lengths == capacity, 0, need), capacity, rounds, step)
        patterns = full + patterns + best_fit(lengths, rest, capacity)
        if sum(m for _, m in patterns) <= sum(m for _, m in plan):
            plan = patterns
    return [([int(lengths[i]) for i, n in zip(hit[::-1].tolist(), used[::-1].tolist(), strict=True) for _ in range(n)], m) for (hit, used), m in plan]


def slots(plan: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For ranges of ranks of each length: key (length and first rank), sequence of the first rank, offset in the sequence."""
    rows, taken, base = [], {}, 0
    for lengths, m in plan:
        offset = 0
        for n in lengths:
            rank = taken.get(n, 0)
            rows.append(((n << 44) | rank, rank, base, offset))
            taken[n] = rank + m
            offset += n
        base += m
    return tuple(np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids."""
    with small_batches(docs.sparkSession):
        pieces = materialize(tokenize_pieces(docs, tokenizer, capacity, end_id, with_ids))
    counts = materialize(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    plan = solve({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    keys, first, sequence, offset = slots(plan)
    table = docs.sparkSession.sparkContext.broadcast((keys, first, sequence, offset))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(counts.select("part", "length", before.alias("before")), ["part", "length"]).withColumn("rank", F.col("before") + F.col("place")).drop("before", "place", "part")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, sequence, offset = table.value
        for b in batches:
            rank, n = b.column("rank").to_numpy(), b.column("length").to_numpy()
            at = np.searchsorted(keys, (n << 44) | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], [*names, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(tidy(run), schema)
