"""Quality rules: base rules on words and lines, and a language's character n-gram perplexity.

Spark counts the trigrams of UTF-16 units in each language over all documents, with nothing folded together: a trigram is its 48 bits.
(Orders up to 4 fit a 64-bit key; with 4, small tables hold their own junk by heart.) Counts are dealt to segments by language and context, so a language of any share spreads out, and each order's continuation counts
come from the distinct n-grams of the order above. With each order's modified Kneser-Ney discounts, taken from its counts of counts,
a segment's n-grams become arrays sorted by 64-bit hashes of language, order and n-gram: the n-grams' discounted shares and the
contexts' back-off weights. A text's probabilities are looked up there by binary search and interpolated down to single units.

The arrays are broadcast if they have `most_bytes` or less. Larger ones go in groups of segments within this bound (of languages, too,
if need be), one pass over the texts each; every unit's probability is found whole in one pass, so the passes' sums add up.

A document's log perplexity per unit is held against its language's band, which is the median plus and minus a multiple of the median
deviation, widened for short texts, whose mean is less certain.

Nulls: a null text is empty (it fails the base rules), a null language is a language of its own. A language of few documents has
bands around its own median like any other, and one without any text has none: its documents are judged by the base rules alone.
Texts of any length are read whole. Texts on a bound of the band are kept. Repeated rows are judged each. Empty tables give empty
results. Extra columns pass through `keep`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kit import SPACE, Spans, fold, materialize, packed, release, small_batches, text_blocks, tidy, word_spans

ORDER, UNIT = 3, 16  # units of 16 bits
LINE = 10  # a text begins after line ends
MULT = 0x9FB21C651E98DF25
FLUSH = 1_000_000
MOST_LANGUAGES_TO_BROADCAST = 10_000
SYMBOLS = b"#*$%&|<>"
WINDOW = 8


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-16 units of texts end to end, and len + 1 offsets. Bytes that aren't UTF-8 are read as U+FFFD."""
    try:
        text = data.tobytes().decode()
    except UnicodeDecodeError:
        parts = [data[a:e].tobytes().decode(errors="replace") for a, e in zip(offsets[:-1], offsets[1:], strict=True)]
        data = np.frombuffer("".join(parts).encode(), np.uint8)
        offsets = np.append(0, np.cumsum([len(x.encode()) for x in parts]))
        text = "".join(parts)
    lead = (data & 0xC0) != 0x80
    n = np.append(0, np.cumsum(lead.astype(np.int8) + (data >= 0xF0), dtype=np.int64))
    return np.frombuffer(text.encode("utf-16-le"), "<u2"), n[offsets]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of ORDER units that ends at each unit, and where each text's begin."""
    u, begin = units(data, offsets)
    out = u.astype(np.uint64)
    before = u
    row_start = begin[:-1][begin[1:] > begin[:-1]]
    for k in range(1, ORDER):
        shifted = np.empty_like(before)
        shifted[1:] = before[:-1]
        shifted[row_start] = LINE
        out |= shifted.astype(np.uint64) << np.uint64(UNIT * k)
        before = shifted
    return out, begin


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values))
    return total[offsets[1:]] - total[offsets[:-1]]


def base_features(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    starts, ends, first = word_spans(data, offsets)
    n_words, n = np.diff(first), len(offsets) - 1
    solid = ~SPACE[data]
    row = np.repeat(np.arange(n), n_words)
    salt = fold(np.arange(n, dtype=np.uint64) + np.uint64(1))
    spans = Spans(data)
    # Lines: what lies between text starts, line ends and text ends.
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    stop = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, begin)], offsets[np.searchsorted(offsets, begin, "right")]) if len(begin) else begin
    wordy = np.append(0, np.cumsum(solid))
    with_word = wordy[stop] > wordy[begin]
    begin, stop = begin[with_word], stop[with_word]
    of = np.searchsorted(offsets, begin, "right") - 1
    keys = np.unique(spans.hash(begin, stop) ^ salt[of], return_index=True)[1]
    dup = np.bincount(of, minlength=n) - np.bincount(of[keys], minlength=n)
    repeat = np.zeros(n, np.int64)
    if len(starts) >= WINDOW:
        h = spans.hash(starts, ends)
        m = len(h) - WINDOW + 1
        ok = row[:m] == row[WINDOW - 1 :]
        acc = salt[row[:m]].copy()
        for j in range(WINDOW):
            acc = acc * np.uint64(0x9FB21C651E98DF25) + h[j : j + m]
        at = np.flatnonzero(ok)
        _, inverse, counts = np.unique(acc[at], return_inverse=True, return_counts=True)
        twice = at[counts[inverse] > 1]
        mark = np.zeros(len(h) + 1, np.int32)
        np.add.at(mark, twice, 1)
        np.add.at(mark, twice + WINDOW, -1)
        repeat = np.bincount(row, weights=np.cumsum(mark[:-1]) > 0, minlength=n).astype(np.int64)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    chars = _sums(solid & ((data < 0x80) | (data >= 0xC0)), offsets)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": _sums(symbol[data], offsets), "n_dup_lines": dup, "n_repeat_words": repeat}


def _languages(b: pa.RecordBatch) -> list[str]:
    return ["n" if x is None else f"s{x}" for x in b.column("lang").to_pylist()]


def language_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("lang").cast("string")), F.lit("n"))


def salt(language: str) -> int:
    return int.from_bytes(hashlib.blake2b(language.encode(errors="surrogatepass"), digest_size=8).digest(), "little")


def hashes(language: int, order: int, gram: np.ndarray) -> np.ndarray:
    """Hashes of n-grams of a language; contexts of an order have the order plus 8."""
    return fold(gram * np.uint64(MULT) + np.uint64((language + (order + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF))


def _segment(language: int, context: np.ndarray, segments: int) -> np.ndarray:
    return (hashes(language, 31, context) >> np.uint64(33)).astype(np.int64) % segments


def _dealt(language: str, gram: np.ndarray, counts: np.ndarray, segments: int) -> pa.RecordBatch:
    """n-grams and counts of a language by the segment of their context."""
    seg = _segment(salt(language), gram >> np.uint64(UNIT), segments)
    order = np.argsort(seg, kind="stable")
    gram, counts, seg = gram[order], counts[order], seg[order]
    first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1])) if len(seg) else np.zeros(0, np.int64)
    cut = np.append(first, len(seg))
    return pa.RecordBatch.from_arrays([pa.array([language] * len(first), pa.string()), pa.array(seg[first].astype(np.int32)), packed(gram, cut), packed(counts.astype("<i8"), cut)], ["language", "segment", "grams", "counts"])


COUNTS = "language string, segment int, grams binary, counts binary"


def _merged(gram: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(gram, kind="stable")
    gram, counts = gram[order], counts[order]
    new = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
    return gram[new], np.add.reduceat(counts, new) if len(new) else counts


def _summed(sent: DataFrame) -> DataFrame:
    def run(p: pd.DataFrame) -> pd.DataFrame:
        gram, n = _merged(np.concatenate([np.frombuffer(x, np.uint64) for x in p["grams"]]), np.concatenate([np.frombuffer(x, "<i8") for x in p["counts"]]))
        return pd.DataFrame({"language": [p["language"].iloc[0]], "segment": [p["segment"].iloc[0]], "grams": [gram.tobytes()], "counts": [n.tobytes()]})

    return sent.groupBy("language", "segment").applyInPandas(run, COUNTS)


def count_grams(docs: DataFrame, segments: int) -> DataFrame:
    """language, segment, grams, counts: the n-grams of all documents; each task adds up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                yield _dealt(name, *_merged(*(np.concatenate(x) for x in zip(*parts, strict=True))), segments)
            held.clear()

        for batch in batches:
            for rows, data, offsets in text_blocks(batch):
                gram, begin = grams(data, offsets)
                names, of = np.unique(np.array(_languages(rows), object), return_inverse=True)
                of = np.repeat(of, np.diff(begin)) if len(names) > 1 else None
                for k, name in enumerate(names.tolist()):
                    own, n = np.unique(gram if of is None else gram[of == k], return_counts=True)
                    if len(own):
                        held.setdefault(name, []).append((own, n.astype(np.int64)))
                        count += len(own)
                if count > FLUSH:
                    yield from flush()
                    count = 0
        yield from flush()

    return _summed(docs.select("lang", "text").mapInArrow(tidy(run), COUNTS))


def continuations(counts: DataFrame, order: int, segments: int) -> DataFrame:
    """The counts of the n-grams one unit shorter: how many distinct units precede each."""
    mask = np.uint64((1 << UNIT * (order - 1)) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, x in zip(b.column("language").to_pylist(), b.column("grams").to_pylist(), strict=True):
                yield _dealt(name, *np.unique(np.frombuffer(x, np.uint64) & mask, return_counts=True), segments)

    return _summed(counts.mapInArrow(run, COUNTS))


def discounts(ones: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney: the discounts of counts 1, 2 and 3 or more, from how many n-grams have counts 1 to 4."""
    y = ones[0] / max(ones[0] + 2 * ones[1], 1)
    return tuple(max(0.05, min(k - 0.05, k - (k + 1) * y * ones[k] / max(ones[k - 1], 1))) for k in (1, 2, 3))


def shares(language: int, order: int, gram: np.ndarray, n: np.ndarray, cuts: tuple[float, float, float]) -> tuple[np.ndarray, ...]:
    """Hashes and discounted shares of n-grams whose contexts are whole, and hashes and back-off weights of the contexts."""
    context = gram >> np.uint64(UNIT)
    new = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    total = np.add.reduceat(n, new)
    cut = np.where(n > 2, cuts[2], np.where(n == 2, cuts[1], cuts[0]))
    size = np.diff(np.append(new, len(gram)))
    return hashes(language, order, gram), (n - cut) / np.repeat(total, size), hashes(language, order + 8, context[new]), np.add.reduceat(cut, new) / total


def train(docs: DataFrame, segments: int) -> DataFrame:
    """language, segment, order, keys and values (hashes, log-free shares and weights): the model's rows, and how many bytes each has."""
    levels = {ORDER: materialize(count_grams(docs, segments))}
    for order in range(ORDER, 1, -1):
        levels[order - 1] = materialize(continuations(levels[order], order, segments))
    out = None
    for order, counts in levels.items():

        def ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = [np.bincount(np.minimum(np.frombuffer(x, "<i8"), 5), minlength=6) for x in b.column("counts").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("language"), *(pa.array([int(x[k]) for x in n], pa.int64()) for k in range(1, 5)), pa.array([int(x.sum()) for x in n], pa.int64())], ["language", "n1", "n2", "n3", "n4", "types"])

        def fit(batches: Iterator[pa.RecordBatch], order=order) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for r in b.to_pylist():
                    key, share, context, weight = shares(salt(r["language"]), order, np.frombuffer(r["grams"], np.uint64), np.frombuffer(r["counts"], "<i8"), discounts([r["n1"], r["n2"], r["n3"], r["n4"]]))
                    if order == 1:  # below single units, all that the language has, and one more for any other, are alike
                        weight = weight / (r["types"] + 1)
                    keys, values = np.concatenate([key, context]), np.concatenate([share, weight])
                    by = np.argsort(keys)
                    rows.append((salt(r["language"]) % (1 << 30), r["segment"], order, keys[by].tobytes(), values[by].astype("<f4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["language", "segment", "order", "keys", "values"])

        found = counts.mapInArrow(ones, "language string, n1 long, n2 long, n3 long, n4 long, types long").groupBy("language").agg(*(F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "types")))
        part = counts.join(found, "language").mapInArrow(fit, "language int, segment int, order int, keys binary, values binary")
        out = part if out is None else out.unionByName(part)
    model = materialize(out)
    for counts in levels.values():
        release(counts)
    return model


class Tables:
    """Sorted arrays of hashes with their values; a hash that isn't there is worth `absent`."""

    def __init__(self, rows: list):
        keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["keys"], np.uint64) for r in rows)])
        values = np.concatenate([np.zeros(0, "<f4"), *(np.frombuffer(r["values"], "<f4") for r in rows)])
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def get(self, keys: np.ndarray, absent: float) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), absent)
        order = np.argsort(keys)  # looked up in order, neighbours share what the search has touched
        at = np.empty(len(keys), np.int64)
        at[order] = np.minimum(np.searchsorted(self.keys, keys[order]), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], absent).astype(np.float64)


def probabilities(tables: Tables, language: int, gram: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Interpolated probabilities of distinct n-grams' last units after the others."""
    if order == 0:
        return np.full(len(gram), 1.0)
    key = gram
    shorter, of = np.unique(key & np.uint64((1 << UNIT * (order - 1)) - 1), return_inverse=True)
    below = probabilities(tables, language, shorter, order - 1)[of]
    context, of = np.unique(key >> np.uint64(UNIT), return_inverse=True)
    # A language without any text has no weight for single units either: all units are alike then.
    weight = tables.get(hashes(language, order + 8, context), 1.0 if order > 1 else 2.0**-UNIT)[of]
    return tables.get(hashes(language, order, key), 0.0) + weight * below


def score(docs: DataFrame, model: DataFrame, columns: list[str], segments: int, most_bytes: int = 128 << 20) -> DataFrame:
    """`columns` of docs with language, base features, n_units and log_perplexity (per unit; null for empty texts)."""
    spark = docs.sparkSession
    size = F.length("keys") + F.length("values")
    total = model.agg(F.sum(size), F.sum(F.when(F.col("order") < ORDER, size))).first()
    top, low = (total[0] or 0) - (total[1] or 0), total[1] or 0
    by_language = max(1, -(-2 * low // most_bytes))
    by_context = max(1, -(-2 * top // (most_bytes * by_language)))
    passes = [(i, j) for i in range(by_language) for j in range(by_context)]
    schema = docs.select(*columns).schema.add("language", "string")
    feature_names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for f in feature_names:
        schema = schema.add(f, "long")
    schema = schema.add("n_units", "long").add("log_sum", "double")
    if len(passes) > 1:
        schema = schema.add("row_key", "long").add("pass", "integer")
    out = None
    for turn, (i, j) in enumerate(passes):
        rows = model.filter((F.col("language") % by_language == i) & ((F.col("order") < ORDER) | (F.col("segment") % by_context == j)))
        shared = spark.sparkContext.broadcast(Tables(list(rows.select("keys", "values").toLocalIterator())))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, i=i, j=j, turn=turn) -> Iterator[pa.RecordBatch]:
            tables = shared.value
            for batch in batches:
                for rows, data, offsets in text_blocks(batch):
                    gram, begin = grams(data, offsets)
                    names = _languages(rows)
                    kinds, of = np.unique(np.array(names, object), return_inverse=True)
                    of = np.repeat(of, np.diff(begin)) if len(kinds) > 1 else np.zeros(len(gram), np.int64)
                    logs = np.zeros(len(gram))
                    for k, name in enumerate(kinds.tolist()):
                        own = salt(name)
                        if own % (1 << 30) % by_language != i:
                            continue
                        at = np.flatnonzero(of == k) if len(kinds) > 1 else slice(None)
                        some, back = np.unique(gram[at], return_inverse=True)
                        p = np.log10(np.maximum(probabilities(tables, own, some), 1e-30))
                        if by_context > 1:
                            p[_segment(own, some >> np.uint64(UNIT), segments) % by_context != j] = 0.0
                        logs[at] = p[back]
                    f = base_features(data, offsets) if not turn else {c: np.zeros(rows.num_rows, np.int64) for c in feature_names}
                    arrays = [*(rows.column(c) for c in columns), pa.array(names, pa.string()), *(pa.array(f[c].astype(np.int64)) for c in feature_names), pa.array(np.diff(begin)), pa.array(_sums(logs, begin))]
                    if len(passes) > 1:
                        arrays += [_row_keys(rows, data, offsets), pa.array(np.full(rows.num_rows, turn), pa.int32())]
                    yield pa.RecordBatch.from_arrays(arrays, schema.names)

        part = docs.select(*dict.fromkeys([*columns, "lang", "text"])).mapInArrow(tidy(run), schema)
        if len(passes) > 1:
            part = materialize(part)
        out = part if out is None else out.unionByName(part)
    if len(passes) > 1:  # the passes' sums; rows alike are as many in each pass and share sums evenly
        sums = out.groupBy("row_key").agg(F.sum("log_sum").alias("log_sum"), F.sum((F.col("pass") == 0).cast("int")).alias("rows"))
        out = out.filter("pass = 0").drop("pass", "log_sum").join(sums, "row_key").withColumn("log_sum", F.col("log_sum") / F.col("rows")).drop("row_key", "rows")
    mean = F.when(F.col("n_units") > 0, -F.col("log_sum") / F.col("n_units"))
    return out.withColumn("log_perplexity", mean).drop("log_sum")


def _row_keys(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A hash of a row's text and language."""
    named = np.array([salt(x) for x in _languages(rows)], np.uint64)
    return pa.array(fold(Spans(data).hash(offsets[:-1], offsets[1:]) + named).view(np.int64)) if rows.num_rows else pa.array([], pa.int64())


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def language_bands(scored: DataFrame) -> DataFrame:
    """language, middle, deviation: medians of log perplexity, and of the distance from it, among texts that pass the base rules."""
    fair = scored.filter(~base_failed() & F.col("log_perplexity").isNotNull())
    middle = materialize(fair.groupBy("language").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("middle")))
    few = middle.count() <= MOST_LANGUAGES_TO_BROADCAST
    off = fair.join(F.broadcast(middle) if few else middle, "language").withColumn("off", F.abs(F.col("log_perplexity") - F.col("middle")))
    return off.groupBy("language").agg(F.first("middle").alias("middle"), F.percentile_approx("off", 0.5, 10_000).alias("deviation"))


def _verdicts(scored: DataFrame, bands: DataFrame, spread: float, floor: float, short: float) -> DataFrame:
    few = bands.count() <= MOST_LANGUAGES_TO_BROADCAST
    out = scored.withColumn("base_failed", base_failed()).join(F.broadcast(bands) if few else bands, "language", "left")
    width = F.lit(spread) * F.greatest(F.col("deviation"), F.lit(floor)) + F.lit(short) / F.sqrt(F.greatest("n_units", F.lit(1)))
    out = out.withColumn("low", F.col("middle") - width).withColumn("high", F.col("middle") + width)
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return out.withColumn("kept", kept).drop("middle", "deviation", "n_units")


def segments_for(docs: DataFrame) -> int:
    """As many that a segment's n-grams fit a task's memory."""
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(4, min(1 << 17, size // (16 << 20)))


SPREAD, FLOOR, SHORT = 2.0, 0.01, 1.0


def judge(docs: DataFrame, spread: float = SPREAD, floor: float = FLOOR, short: float = SHORT, columns: list[str] | None = None, most_bytes: int = 128 << 20) -> DataFrame:
    """`columns` (doc_id unless given) with the base features, base_failed, log_perplexity, low, high and kept.

    A text of n units may lie `spread` median deviations (at least `floor`) and short / sqrt(n) from its language's median.
    """
    segments = segments_for(docs)
    model = train(docs, segments)
    scored = materialize(score(docs, model, columns or ["doc_id"], segments, most_bytes))
    return _verdicts(scored, materialize(language_bands(scored)), spread, floor, short)


def keep(docs: DataFrame, spread: float = SPREAD, floor: float = FLOOR, short: float = SHORT, most_bytes: int = 128 << 20) -> DataFrame:
    """The rows of docs that are kept. Bands come from a narrow table; then one more pass judges each row as it streams by."""
    segments = segments_for(docs)
    with small_batches(docs.sparkSession):
        model = train(docs, segments)
        bands = materialize(language_bands(materialize(score(docs, model, ["doc_id"], segments, most_bytes))))
    # Other names while judging, so that no column of docs clashes with the features.
    own = {c: f"_kq_{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*(F.col(c).alias(n) for c, n in own.items()), *(F.col(c) for c in ("lang", "text")))
    kept = _verdicts(score(named, model, list(own.values()), segments, most_bytes), bands, spread, floor, short).filter("kept")
    return kept.select(*(F.col(n).alias(c) for c, n in own.items()))
