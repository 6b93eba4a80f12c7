"""Cases that an operator once did only in part."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict


import numpy as np
import pyarrow as pa
import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _whole_runs(rows, min_words):
    """Each later position's longest run that starts at an earlier position too goes if it has the words; by comparing all positions."""
    docs = {i: [(k, x) for k, x in enumerate(t.split("\n")) if WORDS.search(x)] for i, t in rows}
    places = [(i, k) for i in sorted(docs) for k in range(len(docs[i]))]
    gone = defaultdict(set)
    for n, (i, k) in enumerate(places):
        longest = 0
        for j, q in places[:n]:
            m = 0
            while k + m < len(docs[i]) and q + m < len(docs[j]) and docs[i][k + m][1] == docs[j][q + m][1]:
                m += 1
            longest = max(longest, m)
        run = docs[i][k : k + longest]
        if sum(len(WORDS.findall(x)) for _, x in run) >= min_words:
            gone[i] |= {at for at, _ in run}
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def test_line_dedup_stage_deletes_whole_runs(spark):
    from corpus_pipeline import line_dedup
    from tidemark.llm.line_dedup import dedup_lines

    first = "one two three four five six seven eight nine\nyours truly me\nonly here"
    later = "something else\none two three four five six seven eight nine\nyours truly me\nnot there"
    rng = random.Random(11)
    pool = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 12))) for _ in range(14)]
    rows = [(0, first), (1, later)] + [(2 + i, "\n".join(rng.choice([*pool, "", f"u{i} {j}"]) for j in range(rng.randrange(12)))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).repartition(3)
    want = _whole_runs(rows, 8)
    assert want[1] == "something else\nnot there"
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs, 8).collect()}
    assert got == want
    staged = {r["doc_id"]: r["text"] for r in line_dedup(spark, docs, "").collect()}
    assert staged == {i: t for i, t in want.items() if t == dict(rows)[i] or WORDS.search(t)}


def test_language_model_holds_every_pair(spark):
    """Scores from exact counts, pairs seen once among them; the filter's rare false positives may raise a few."""
    from tidemark.llm.bloom_lm import score

    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(20)) for _ in range(60)]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    pairs = Counter(p for i, t in enumerate(texts) if not held(i) for w in [[None, *t.split(), None]] for p in zip(w, w[1:]))
    ones, ahead, kinds = Counter(), Counter(), Counter()
    for (h, w), n in pairs.items():
        ones[w] += n
        ahead[h] += n
        kinds[h] += 1
    total, types = sum(ones.values()), len(ones)
    assert sum(n == 1 for n in pairs.values()) > 0.9 * len(pairs) and max(n for w, n in ones.items() if w) <= 10

    def log10(h, w):
        p1 = (ones[w] + 0.1) / (total + 0.1 * (types + 1))
        if not ahead[h]:
            return math.log10(p1)
        rest = max(round(0.75 * kinds[h]), 0.5)
        return math.log10((max(pairs[h, w] - 0.75, 0) + rest * p1) / max(ahead[h], rest))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    near = 0
    for r in score(docs).collect():
        w = texts[r["doc_id"]].split()
        # Ends and the words after them have counts above 10, which the filter rounds.
        want = sum(log10(a, b) for a, b in zip([None, *w], [*w, None]))
        near += abs(r["score"] - want) < 0.3
    # About one probe of 200 is a false positive, so one text of ten has a pair that is raised.
    assert near >= 0.8 * len(texts)


@pytest.mark.parametrize("frequent", [(1e-5, 0.1), (0.02, 0.02), (2.0, 2.0)])
def test_language_model_scores_alike_wherever_filters_lie(spark, monkeypatch, frequent):
    """Against the formula over exact counts brought to the filter's levels; broadcast or by exchange, frequent words apart or not."""
    from tidemark.llm import bloom_lm as b

    monkeypatch.setattr(b, "FREQUENT", frequent[0])
    monkeypatch.setattr(b, "SPLIT", frequent[1])
    rng = random.Random(13)
    texts = [" ".join(f"u{int(rng.paretovariate(0.9))}" for _ in range(rng.choice([0, 3, 40]))) for _ in range(150)] + [None]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    pairs = Counter(p for i, t in enumerate(texts) if not held(i) for w in [[None, *(t or "").split(), None]] for p in zip(w, w[1:]))
    ones, ahead, kinds = Counter(), Counter(), Counter()
    for (h, w), n in pairs.items():
        ones[w] += n
        ahead[h] += n
        kinds[h] += 1
    total, types = sum(ones.values()), len(ones)
    value = lambda n: float(b.VALUES_OF[b.level(np.array([n]))][0])

    def log10(h, w):
        p1 = (value(ones[w]) + 0.1) / (total + 0.1 * (types + 1))
        if not ahead[h]:
            return math.log10(min(p1, 1.0))
        n, rest = value(ahead[h]), max(value(round(0.75 * kinds[h]) + 1) - 1, 0.5)
        c = min(value(pairs[h, w]), n)
        return math.log10(min(1.0, (max(c - 0.75, 0) + rest * p1) / max(n, rest)))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    whole = {r["doc_id"]: r for r in b.score(docs).collect()}
    parts = {r["doc_id"]: r for r in b.score(docs, segments=7, most_bytes=0).collect()}
    near = [0, 0]
    for i, t in enumerate(texts):
        w = (t or "").split()
        want = sum(log10(a, c) for a, c in zip([None, *w], [*w, None]))
        for k, r in enumerate((whole[i], parts[i])):
            near[k] += abs(r["score"] - want) < 0.03 * abs(want) + 1e-6  # a false positive raises a count by a level
            assert r["n_tokens"] == len(w) + 1 and r["train_tokens"] == total and r["n_known"] == sum(ones[x] > 0 for x in [*w, None])
    assert min(near) >= 0.85 * len(texts)


def test_language_model_sends_few_rows(spark, monkeypatch):
    """A segment gets a row from each task, not from each block of texts; small groups and sets change no result."""
    from tidemark.llm import bloom_lm as b

    texts = [" ".join(f"x{(i * j) % 41}" for j in range(60)) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = {r["doc_id"]: r for r in b.score(docs, segments=6).collect()}
    monkeypatch.setattr(b, "BLOCK", 600)
    monkeypatch.setattr(b, "FLUSH", 300)
    layout = b.Layout(6, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    batches = docs.select("doc_id", "text").toArrow().to_batches()
    assert sum(x.num_rows for x in b.pair_batches(iter(batches), layout)) <= 6
    assert [len(ids) for ids, *_ in b.groups(iter(batches), b.GROUP)] == [200]
    monkeypatch.setattr(b, "PAIRS", 200)
    assert sum(x.num_rows for x in b.pair_batches(iter(batches), layout)) > 6
    kept = [t.split() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    trained = b.train(docs, layout).toPandas()
    assert trained["n_tokens"].sum() == sum(len(w) + 1 for w in kept) and trained["n_types"].sum() == len({x for w in kept for x in w}) + 1
    for most in (1 << 30, 0):
        again = {r["doc_id"]: r for r in b.score(docs, segments=6, most_bytes=most).collect()}
        assert again.keys() == want.keys() and all(math.isclose(again[i][c], want[i][c], rel_tol=1e-9) for i in want for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score"))


def test_language_model_is_held_once_by_all_workers(spark):
    """A worker that reads all of a broadcast model takes hardly any memory of its own; a copy stands in where no file can be read."""
    from tidemark.llm import bloom_lm as b

    rng = np.random.default_rng(14)
    n = 4_000_000
    frequent = np.sort(rng.integers(0, 1 << 62, 50).astype(np.uint64))
    own = np.sort(b.fold(np.arange(n, dtype=np.uint64)))
    size = {"words": own.tobytes(), "counts": np.arange(n).tobytes(), "word_bits": bytes(8), "pair_bits": bytes(8)}
    often = {"often": frequent.tobytes(), "often_counts": np.arange(50).tobytes(), "often_kinds": np.ones(50, np.int64).tobytes()}
    row = [0, *size.values(), 7, n, *often.values()]
    names = ["segment", *size, "n_tokens", "n_types", *often]
    trained = spark.createDataFrame([row], ", ".join(f"{c} {'binary' if isinstance(x, bytes) else 'long'}" for c, x in zip(names, row)))
    layout = b.Layout(1, frequent, frequent[:0])
    shared = b.Model(trained, layout, 1 << 30).send(spark.sparkContext)
    some = np.append(own[::1000], frequent)
    want = np.append(np.arange(n)[::1000], np.arange(50))

    def memory():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(x.split()[1]) for x in f if re.match(r"(Pss_Anon|Pss_Shmem):", x)) / 1024

    def look(_):
        before = memory()
        model = b.Model.sent(shared)
        right = bool((model.exact(some) == want).all()) and int(model.words[:].max()) == int(own[-1])
        yield right, memory() - before

    got = spark.sparkContext.parallelize(range(2), 2).mapPartitions(look).collect()
    assert all(right for right, _ in got)
    assert max(mb for _, mb in got) < 16 < sum(map(len, size.values())) / 2**20

    class Unmapped:
        value = b.numbers_to_send(3)[0]

    numbers = b.numbers_sent(Unmapped, 3)
    assert len(numbers) == 3 and not numbers.any() and numbers.flags.aligned


def test_language_model_training_holds_few_copies_of_its_pairs():
    """At most, memory for the pairs that are held, their order, and one column more."""
    from tidemark.llm import bloom_lm as b

    rng = np.random.default_rng(15)
    texts = [" ".join(map(str, rng.integers(0, 1 << 40, 1000))) for _ in range(2400)]
    batches = pa.table({"doc_id": np.arange(len(texts)), "text": texts}).to_batches(max_chunksize=500)
    layout = b.Layout(9, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    rows = 0
    tracemalloc.start()
    for x in b.pair_batches(iter(batches), layout):
        rows += sum(len(c) // 4 for c in x.column(3).to_pylist())
        del x
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > b.PAIRS
    assert peak < 70 * b.PAIRS


def test_near_dedup_stage_judges_rows(spark):
    """By comparing all pairs of rows; ids repeat with equal texts and with different ones."""
    from corpus_pipeline import near_dedup

    rng = random.Random(13)
    long = [" ".join(f"n{rng.randrange(500)}" for _ in range(40)) for _ in range(12)]
    near = lambda t: t.rsplit(" ", 1)[0] + " end"
    rows = [(1, long[0]), (5, near(long[0])), (5, long[1]), (7, long[2]), (7, long[2]), (None, long[0]), (None, long[0])]
    rows += [(rng.randrange(8, 20), rng.choice([str, near])(rng.choice(long[3:]))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).repartition(3)

    def shingles(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    left, groups = [r for r in rows if r[0] is not None], []
    while left:
        group, todo = [], [left.pop()]
        while todo:
            a = todo.pop()
            group.append(a)
            x = shingles(a[1])
            todo += (more := [b for b in left if 4 * len(x & shingles(b[1])) >= 3 * len(x | shingles(b[1]))])
            for b in more:
                left.remove(b)
        groups.append(group)
    got = [(r["doc_id"], r["text"]) for r in near_dedup(spark, docs, "").collect()]
    assert got.count((None, long[0])) == 2 and (5, long[1]) in got and got.count((7, long[2])) == 1
    assert len(got) == len(groups) + 2
    for g in groups:
        stay = [r for r in got if r in g]
        assert len(stay) == 1 and stay[0][0] == min(i for i, _ in g)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 2 / 3])
def test_ngram_join_refuses_thresholds_it_would_search_in_part(threshold):
    from tidemark.llm.ngram_join import join

    with pytest.raises(ValueError, match="threshold"):
        join(None, threshold=threshold)


class _Tasks:
    """Stands in for a table: gives the function that its tasks would run."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def test_packing_holds_small_blocks_of_texts(spark, monkeypatch):
    from tidemark.llm import packing as p

    monkeypatch.setattr(p, "TaskContext", type("Context", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 0)}))
    texts = ["some words that come again " * 80] * 2000 + ["", None]
    run = p.tokenize_pieces(_Tasks(), p.byte_bpe_path())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    assert sum(b.num_rows for b in run(iter([batch.slice(0, 10)]))) == 10  # the tokenizer is loaded once for all
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts)
    assert most < 32 << 20, most

    sizes, materialize = [], p.materialize
    monkeypatch.setattr(p, "materialize", lambda df: sizes.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))) or materialize(df))
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert p.pack(docs, p.byte_bpe_path()).count() == 2
    assert sizes[0] <= 1000


def test_suffix_dedup_holds_few_copies_of_its_contexts():
    from tidemark.llm import suffix_dedup as s

    rng = np.random.default_rng(4)
    data, offsets = rng.integers(97, 123, 1 << 20).astype(np.uint8), np.arange(0, (1 << 20) + 1, 1 << 12)
    a, _, row, _, _ = s.anchors(data, offsets, 100, 36)
    tracemalloc.start()
    got = s.contexts(data, offsets, a, row, 100, 36)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3 * got.nbytes + (16 << 20), most
    for i in range(0, len(a), 997):
        low, high, at = offsets[row[i]], offsets[row[i] + 1], a[i]
        right, left = data[at : min(high, at + 100)].tobytes(), data[max(low, at - 64) : at][::-1].tobytes()
        assert got[i].tobytes() == right.ljust(100, b"\0") + left.ljust(64, b"\0") + len(right).to_bytes(2) + len(left).to_bytes(2)


@pytest.mark.parametrize("n", [0, 1, 900, 1024, 1025, 5000])
def test_samples_are_thinned_over_all_their_length(n):
    from tidemark.llm.suffix_dedup import thinned

    some = thinned(list(range(n)), 1024)
    assert len(some) <= 1024
    assert not n or (some[0] == 0 and some[-1] >= n - -(-n // 1024))
