"""The training-data operators against brute-force versions on small tables that hold every awkward case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, d string, x string, k string, node string, spans string, kept string, rest string"


def sentence(rng, n, words="alpha beta gamma delta eps zeta eta theta iota kappa été straße".split()):
    return " ".join(rng.choice(words) + (rng.choice(["", "", "s", "ed"]) + str(rng.randrange(40))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls in every column, empty and long texts, exact and near copies, repeated lines, repeated rows, a hot source."""
    rng = random.Random(4)
    base = [sentence(rng, rng.randrange(30, 120)) for _ in range(60)]
    line = sentence(rng, 14)
    texts = list(base)
    texts += [base[i % 3] for i in range(25)]
    texts += [" ".join(w for k, w in enumerate(base[5].split(" ")) if k != i) for i in range(12)]
    texts += ["\n".join([sentence(rng, 9), line, "", sentence(rng, 3), line]) for _ in range(10)]
    texts += ["", " ", None, "one", "one two", "One TWO", sentence(rng, 6000), "\n\n", "ab " * 300, "a|b ### $$$"]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0"] * 5 + ["s1", "s2", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[3], out[3], (None, base[0], "en", "s0", 5), (None, None, None, None, None)]
    return [(*r, *"abcdefghi") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(t):
    return WORDS.findall((t or "").translate(LOWER))


def test_embeddings(spark):
    from tidemark.llm.pq_dedup import near_duplicates

    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    vecs = [base[i % 40] + rng.normal(size=16) * rng.choice([0.02, 0.05, 0.2]) for i in range(300)] + [base[0]] * 30
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 3)) for i, v in enumerate(vecs)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [1.0] * 15 + [None], 1), (n + 3, [float("nan")] * 16, 1), (n + 4, rows[0][1], None), (n + 5, [1.0, 2.0], 1), (n + 6, [2.0, 4.0], 1), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    able = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if i is not None and v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = defaultdict(set)
    for a, x, la in able:
        for b, y, lb in able:
            if a != b and la == lb and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a].add(b)
    want = {}
    for a, *_ in rows:
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        want[a] = (len(links[a]), min(seen) if a is not None else None)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicates(df, list_size=8).collect()}
    assert got == want and sum(v[0] for v in want.values()) > 500
    assert near_duplicates(df.limit(0)).count() == 0


def test_embeddings_recall_in_many_dimensions(spark):
    from tidemark.llm.pq_dedup import near_duplicates

    rng = np.random.default_rng(5)
    base = rng.normal(size=(500, 64))
    x = np.concatenate([base, base[:400] + rng.normal(size=(400, 64)) * 0.18, base[:100] + np.eye(64)[rng.integers(0, 64, 100)] * 1.2])
    u = x / np.sqrt((x * x).sum(1))[:, None]
    near = (u @ u.T >= 0.98) & ~np.eye(len(x), dtype=bool)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in near_duplicates(df, list_size=8).collect()}
    found, all_ = sum(got.values()), int(near.sum())
    assert all_ > 500 and 0.9 * all_ <= found <= all_
    assert all(n <= near[i].sum() for i, n in got.items())


def test_embeddings_of_extreme_length(spark):
    from tidemark.llm.pq_dedup import near_duplicates

    rows = [(0, [1e200, 1e200], "a"), (1, [1e200, 1.01e200], "a"), (2, [1.0, 1.0], "a"), (3, [1e-200, 1e-200], "a"), (4, [-1.0, 1.0], "a")]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {0: (3, 0, True), 1: (3, 0, False), 2: (3, 0, False), 3: (3, 0, False), 4: (0, 4, True)}


@pytest.mark.parametrize("options", [{}, {"most_bytes": 0, "segments": 5}])
def test_language_model(docs, rows, options):
    from tidemark.llm.bloom_lm import score

    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    train = Counter(w for i, t, *_ in rows if not held(i) for w in [*words_of(t), None])
    n, v = sum(train.values()), len(train)
    got = [tuple(r) for r in score(docs, **options).collect()]
    want = []
    for i, t, *_ in rows:
        w = [*words_of(t), None]
        want.append((i, held(i), len(w), sum(train[x] > 0 for x in w), n, sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and -1e6 < g[6] <= 0
    assert sum(g[6] for g in got) > sum(g[5] for g in got)


def test_language_model_filter_has_no_false_negatives():
    from tidemark.llm import bloom_lm as b

    keys = b.fold(np.arange(1, 5000, dtype=np.uint64))
    counts = np.arange(1, 5000)
    f = b.Filter(1, {0: b._table(b._items(keys, b.level(counts), b.WORD))})
    found = f.levels(np.zeros(len(keys), np.int64), keys, b.WORD)
    assert (found >= b.level(counts)).all() and (found > b.level(counts)).mean() < 0.01
    other = b.fold(np.arange(10_000, 30_000, dtype=np.uint64))
    assert (f.levels(np.zeros(len(other), np.int64), other, b.WORD) > 0).mean() < 0.01


def test_mixing(docs, rows, empty):
    from tidemark.llm.mixing import mix, mixed_rows

    got = mix(docs, block_words=200).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and len(r["shards"]) == r["passes"] + (r["part"] > 0)
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 3  # repeated rows share what is left evenly
    assert len(got) == len(rows)
    again = mix(docs.repartition(3), block_words=200).collect()
    key = lambda r: str((r["doc_id"], r["text"], r["taken"], r["shards"]))
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixed_rows(docs, block_words=200)
    assert mixed.columns == [*docs.columns, "mix_shard", "mix_key"]
    assert sum(len(words_of(r["text"])) for r in mixed.select("text").collect()) == sum(taken.values())
    assert mix(empty).count() == 0


def test_hypergeometric_draw(spark):
    from tidemark.llm.mixing import hypergeometric

    df = spark.range(20_000).select(((F.col("id") + 0.5) / 20_000).alias("u"))
    got = Counter(r[0] for r in df.select(hypergeometric(F.lit(50).cast("bigint"), F.lit(20).cast("bigint"), F.lit(10).cast("bigint"), F.col("u"))).collect())
    for k in range(11):
        p = math.comb(20, k) * math.comb(30, 10 - k) / math.comb(50, 10)
        assert abs(got[k] / 20_000 - p) < 1e-3


def test_quotas_are_kept(spark):
    from tidemark.llm.mixing import split_quotas

    q = {"a": 1000, "b": 7, "c": 0, "d": 333}
    got = split_quotas(spark.createDataFrame(list(q.items()), "source_key string, quota long"), 3, 1).collect()
    for s, n in q.items():
        assert sum(r["blocks"] for r in got if r["source_key"] == s) == n
    totals = Counter()
    for r in got:
        totals[r["shard"]] += r["blocks"]
    assert max(totals.values()) - min(totals.values()) <= 3


def test_sharding(docs, rows, empty):
    from tidemark.llm.kd_shard import shard

    got = shard(docs, 4).collect()
    assert len(got) == len(rows)
    by_text, slots, weight = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        raw = (r["text"] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        by_text[raw].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        weight[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard(empty, 4).count() == 0 and shard(docs, 1).select("shard").distinct().collect()[0][0] == 0
    assert shard(docs, target_bytes=20_000).select(F.max("shard")).first()[0] >= 3


def test_sharding_into_any_number(spark):
    """Numbers that aren't powers of two, a target size, sources that differ late, and columns named like internal ones."""
    from tidemark.llm.kd_shard import shard

    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randrange(5, 40)), "en", f"https://example.org/part-{i % 3}", i, i, i, i) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `_kd_0` long, node long, `group` long, _sub long").repartition(4)
    for n in (3, 5, 12):
        got = shard(docs, n).collect()
        weight, slots = Counter(), defaultdict(list)
        for r in got:
            assert r["_kd_0"] == r["node"] == r["group"] == r["_sub"] == r["doc_id"]
            weight[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert sorted(weight) == list(range(n)) and max(weight.values()) < 1.1 * sum(weight.values()) / n
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    total = sum(len(t.encode()) + 1 for _, t, *_ in rows)
    parts = shard(docs, target_bytes=total // 7).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(parts) == 8 and max(r["n"] for r in parts) < 1.1 * total // 7
    by_source = docs.withColumn("text", F.lit("same length")).withColumn("text", F.concat("text", F.lpad("doc_id", 4, "0"))).withColumn("doc_id", F.lit(1).cast("long"))
    split = shard(by_source, 3).groupBy("shard").agg(F.count_distinct("source").alias("n")).collect()
    assert sum(r["n"] for r in split) <= 5
    with pytest.raises(ValueError, match="must be a shard"):
        shard(docs, 0)


def test_columns_named_like_internal_ones(spark):
    """Operators that carry other columns carry these too, and a text that is larger than a block of work."""
    from tidemark.llm.line_dedup import dedup_lines
    from tidemark.llm.mixing import mix, mixed_rows
    from tidemark.llm.suffix_dedup import cut_repeats

    names = ["_mx_size", "_mx_key", "_mx_h", "_mr_0", "_mo_0", "_ld_d", "_ld_x", "_ld_at", "_ld_k", "_ld_y", "_sd_spans", "_sd_doc"]
    long = "\n".join(f"line {i} of a text that is larger than a block" for i in range(60_000))
    rows = [(i, t, "en", "s", *[i] * len(names)) for i, t in enumerate(["a b c", long, "x\n" + long[:5000], None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} long" for n in names))
    for out in (mix(docs), dedup_lines(docs), cut_repeats(docs)):
        got = out.collect()
        assert len(got) == 4 and all(r[n] == r["doc_id"] for r in got for n in names)
    assert mixed_rows(docs).columns[: len(docs.columns)] == docs.columns
    cut = {r["doc_id"]: r["text"] for r in cut_repeats(docs).collect()}
    assert cut[1] == long and len(cut[2]) < 110
    lines = {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()}
    assert lines[1] == long and lines[2] in ("x", "x\n" + long[:5000].split("\n")[-1])


def test_tokenizer_pieces():
    import public_tokenizers

    from tidemark.llm import bpe, kit

    e = bpe.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    alphabet = [*"  abst'reveldm09.,!\n\t \u0085é²ª×ł", "'s", "'re", " '", "’", "中", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(4000)] + ["", "  ", " a", "a ", "'ll've"]
    ids, of = e.encode(*kit.text_bytes(pa.array(texts)))
    for i, x in enumerate(e.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert list(ids[of[i] : of[i + 1]]) == x.ids


def test_packing(docs, rows, empty):
    from tidemark.llm import bpe
    from tidemark.llm.packing import byte_bpe_path, pack

    e = bpe.encoder(byte_bpe_path())
    got = pack(docs, byte_bpe_path(), capacity=256, with_ids=True).collect()
    want = Counter()
    for r in rows:
        ids = [*e.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        head = len(ids) % 256 or 256
        cuts = [0, *range(head, len(ids), 256), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    assert len(sequences) <= 1.05 * -(-sum(r["length"] for r in got) // 256) + 1
    assert pack(empty, byte_bpe_path()).count() == 0


def test_packing_program_covers_the_histogram():
    from tidemark.llm.packing import slots, solve

    rng = random.Random(3)
    for scale in (1, 1000):
        h = {n: rng.randrange(1, 9) * scale for n in rng.sample(range(1, 129), 60)}
        plan = solve(h, 128, rounds=60)
        used = Counter()
        for lengths, m in plan:
            assert sum(lengths) <= 128
            for n in lengths:
                used[n] += m
        assert used == Counter(h)
        bins = Counter()  # free room of the bins of first fit, longest first, by counts
        for n in sorted(h, reverse=True):
            for _ in range(h[n] // scale):
                room = min((r for r in bins if r >= n and bins[r]), default=None)
                if room is not None:
                    bins[room] -= 1
                bins[(room if room is not None else 128) - n] += 1
        assert sum(m for _, m in plan) <= 1.02 * scale * sum(bins.values()) + 2
        assert len(slots(plan)[0]) == sum(len(x) for x, _ in plan)


@pytest.mark.parametrize("scale", [1, 6])
def test_packing_program_makes_the_plan(scale):
    """On lengths like those of documents most pieces lie in the program's patterns, and best fit alone needs no fewer sequences."""
    from tidemark.llm.packing import best_fit, program, solve

    rng = np.random.default_rng(7)
    drawn = np.clip(np.exp(rng.normal(6.3, 0.9, 900)), 2, 2048).astype(int)
    h = {int(n): int(c) * scale for n, c in zip(*np.unique(drawn, return_counts=True), strict=True)}
    lengths, need = np.array(sorted(h)), np.array([h[n] for n in sorted(h)])
    patterns, rest = program(lengths, need, 2048, 300, 1.0)
    assert all(int((used * lengths[hit]).sum()) == 2048 for (hit, used), _ in patterns)
    placed = np.zeros(len(lengths), np.int64)
    for (hit, used), m in patterns:
        placed[hit] += used * m
    assert (placed + rest == need).all()
    assert (need - rest).sum() > 0.6 * need.sum()
    plan, alone = solve(h, 2048), solve(h, 2048, rounds=0)
    count = lambda p: sum(m for _, m in p)
    assert count(alone) == sum(m for _, m in best_fit(lengths, need, 2048))
    assert -(-sum(n * c for n, c in h.items()) // 2048) <= count(plan) <= count(alone)
    assert sorted(map(str, plan)) != sorted(map(str, alone))


def test_knapsack_by_trying_all():
    from itertools import product

    from tidemark.llm.packing import best_pattern

    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths, most, weights = rng.choice(np.arange(1, 20), 4, replace=False), rng.integers(0, 4, 4), rng.random(4)
        used = best_pattern(weights, lengths, most, 25)
        fits = [u for u in product(*(range(m + 1) for m in most)) if np.dot(u, lengths) <= 25]
        assert tuple(used) in fits and np.dot(used, weights) == pytest.approx(max(np.dot(u, weights) for u in fits))


def test_quality_rules(docs, rows, empty):
    from tidemark.llm.kn_quality import judge, keep

    def base(t):
        t = t or ""
        w = WORDS.findall(t)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n, cover = Counter(windows), set()
        for i, x in enumerate(windows):
            if n[x] > 1:
                cover |= set(range(i, i + 8))
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)

    got = judge(docs, columns=["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base(r["text"])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    kept = keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert judge(empty).count() == 0 and keep(empty).count() == 0


def test_perplexity_separates(spark, sf_dir):
    from tidemark.llm.kn_quality import judge

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("n_chars > 400")
    junk = docs.filter("doc_id % 10 = 0").withColumn("text", F.translate("text", "etaoinsr", "zqxjvkwy")).withColumn("doc_id", -F.col("doc_id") - 1)
    got = judge(docs.unionByName(junk)).filter("not base_failed").collect()
    clean = [r["kept"] for r in got if r["doc_id"] >= 0]
    bad = [r["kept"] for r in got if r["doc_id"] < 0]
    assert np.mean(clean) > 0.75 and np.mean(bad) < 0.2


def _kneser_ney(texts):
    """log10 probabilities by dictionaries: {text: mean of -log10 P over its units}, for the texts of one language."""
    from tidemark.llm.kn_quality import ORDER

    units = lambda t: "".join(map(chr, np.frombuffer(t.encode("utf-16-le"), "<u2").tolist()))
    windows = lambda t: [("\n" * (ORDER - 1) + t)[i : i + ORDER] for i in range(len(t))]
    counts = {ORDER: Counter(x for t in texts for x in windows(units(t)))}
    for m in range(ORDER - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    total, weight, cuts = {}, {}, {}
    for m, c in counts.items():
        ones = Counter(c.values())
        y = ones[1] / max(ones[1] + 2 * ones[2], 1)
        cut = [max(0.05, min(k - 0.05, k - (k + 1) * y * ones[k + 1] / max(ones[k], 1))) for k in (1, 2, 3)]
        cuts[m] = lambda n, cut=cut: cut[min(n, 3) - 1]
        total[m], left = Counter(), Counter()
        for g, n in c.items():
            total[m][g[:-1]] += n
            left[g[:-1]] += cuts[m](n)
        weight[m] = {x: left[x] / total[m][x] for x in total[m]}

    def p(g):
        m = len(g)
        if not m:
            return 1 / (len(counts[1]) + 1)
        n = counts[m].get(g, 0)
        return ((n - cuts[m](n)) / total[m][g[:-1]] if n else 0) + weight[m].get(g[:-1], 1.0) * p(g[1:])

    return {t: -sum(math.log10(p(x)) for x in windows(units(t))) / len(units(t)) for t in texts if t}, p, counts


@pytest.mark.parametrize("most_bytes", [1 << 30, 3000])
def test_kneser_ney_by_dictionaries(spark, most_bytes):
    """Against plain Kneser-Ney in three scripts, with many languages, some of them without any text; in one pass and in several."""
    from tidemark.llm.kn_quality import judge

    rng = random.Random(21)
    alphabets = {"en": "abcde \n", "el": "αβγδε ", "zh": "的一是不了人我 ", None: "xyz😀 "}
    rows = [("".join(rng.choice(a) for _ in range(rng.randrange(60))), lang) for lang, a in alphabets.items() for _ in range(25)]
    rows += [(x, f"l{i}") for i in range(140) for x in (None, "")] + [(f"ab{i}", f"m{i}") for i in range(20)] + [rows[3], rows[3]]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").repartition(4)
    got = {r["doc_id"]: r for r in judge(docs, most_bytes=most_bytes).collect()}
    assert sorted(got) == list(range(len(rows)))
    want = {lang: _kneser_ney([t for t, x in rows if x == lang and t])[0] for lang in {x for _, x in rows}}
    for i, (t, lang) in enumerate(rows):
        assert got[i]["log_perplexity"] == (pytest.approx(want[lang][t], rel=1e-5) if t else None)


def test_kneser_ney_sums_to_one():
    texts = ["abcabd", "abde abc", "bca"]
    _, p, counts = _kneser_ney(texts)
    for g in list(counts[max(counts)])[:8]:
        seen = sum(p(g[:-1] + x) for x in counts[1])
        assert seen < 1 and seen + p(g[:-1] + "?") == pytest.approx(1)


def test_scripts_of_three_bytes_are_told_apart(spark):
    from tidemark.llm.kn_quality import judge

    rng = random.Random(22)
    words = ["".join(chr(0x4E00 + rng.randrange(300)) for _ in range(rng.randrange(2, 5))) for _ in range(80)]
    texts = ["".join(rng.choice(words) + " " for _ in range(60)) for _ in range(120)]
    mixed = ["".join(rng.sample(t, len(t))) for t in texts[:15]]
    got = judge(spark.createDataFrame([(i, t, "zh") for i, t in enumerate(texts + mixed)], "doc_id long, text string, lang string"), spread=5.0).collect()
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert np.mean([kept[i] for i in range(120)]) > 0.9 and not any(kept[i] for i in range(120, 135))


def _cut_lines(rows, min_words):
    """Every run of lines with min_words words that also starts earlier goes, whatever its length; all lengths are tried."""
    seen, gone = set(), defaultdict(set)
    order = sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None})
    for i, t in order:
        lines = t.split("\n")
        wordy = [k for k, x in enumerate(lines) if WORDS.search(x)]
        counts = [len(WORDS.findall(lines[k])) for k in wordy]
        for a in range(len(wordy)):
            for e in range(a + 1, len(wordy) + 1):
                run = tuple(lines[k] for k in wordy[a:e])
                if run in seen and sum(counts[a:e]) >= min_words:
                    gone[i] |= set(wordy[a:e])
                seen.add(run)
    return {(i, t): "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in order}


@pytest.mark.parametrize("min_words", [1, 5, 8])
def test_line_dedup(spark, docs, rows, empty, min_words):
    from tidemark.llm.line_dedup import dedup_lines

    rng = random.Random(9)
    pool = [sentence(rng, rng.randrange(1, 5)) for _ in range(12)]
    more = [(1000 + i, "\n".join(rng.choice([*pool, "", sentence(rng, 4)]) for _ in range(rng.randrange(12))), "en", "s", 1, *"abcdefghi") for i in range(80)]
    song = [sentence(rng, rng.randrange(1, 3)) for _ in range(40)]
    more += [(1100 + i, "\n".join(song[a:e]), "en", "s", 1, *"abcdefghi") for i, (a, e) in enumerate([(0, 40), (3, 29), (5, 22), (10, 27), (30, 40), (0, 7)])]
    both = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    want = _cut_lines([*rows, *more], min_words)
    got = dedup_lines(both, min_words)
    assert got.columns == [*docs.columns, "n_removed", "n_runs"]
    out = got.select("doc_id", "text").collect()
    assert len(out) == len(rows) + len(more)
    assert Counter(r["text"] for r in out if r["doc_id"] is not None and r["text"] is not None) == Counter(want[r[0], r[1]] for r in [*rows, *more] if r[0] is not None and r[1] is not None)
    assert dedup_lines(empty).count() == 0


def _cut_bytes(rows, length):
    seen, out = set(), {}
    for i, t in sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest()
    return out


@pytest.mark.parametrize("options", [{}, {"most_filter_bytes": 0}])
def test_suffix_dedup(docs, rows, empty, options, monkeypatch):
    from tidemark.llm import suffix_dedup as s

    monkeypatch.setattr(s, "RUN", 300)
    got = s.digests(docs, length=40, gram=14, **options).collect()
    want = _cut_bytes(rows, 40)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert tuple(r)[1:] == want[r["doc_id"]]
        else:
            assert r["n_removed"] == 0
    cut = s.cut_repeats(docs, length=40, gram=14)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert s.digests(empty).count() == 0


def test_loser_tree():
    from tidemark.llm.suffix_dedup import LoserTree, common_prefixes, front_code, front_decode, sorted_order

    rng = np.random.default_rng(3)
    runs, everything = [], []
    for n in (0, 1, 50, 33, 7):
        rows = rng.integers(97, 99, (n, 12)).astype(np.uint8)
        rows = rows[sorted_order(rows)]
        back, shared = front_decode(*front_code(rows), 12)
        assert (back == rows).all()
        runs.append(([x.tobytes() for x in rows], shared.tolist()))
        everything += runs[-1][0]
    merged = [(runs[r][0][i], common) for r, i, common in LoserTree(runs)]
    assert [x for x, _ in merged] == sorted(everything)
    assert [c for _, c in merged] == common_prefixes(np.array([list(x) for x, _ in merged], np.uint8)).tolist()


def test_url_rules(spark):
    from tidemark.llm.url_rules import judge

    rng = random.Random(2)
    labels, parts = ["a", "b", "ab", "org", "x-y"], ["", "/", "/a", "/a/", "/a/b?q=1", "/ab#f", "?x"]
    urls = [f"http{rng.choice(['', 's'])}://{'.'.join(rng.choice(labels) for _ in range(rng.randrange(1, 4))).upper()}{rng.choice(parts)}" for _ in range(700)] + [None, "", "no scheme/a", "x://", "a://b://c"] + ["http://a.org/a/b"] * 300
    rules = {(".".join(rng.choice(labels) for _ in range(rng.randrange(1, 3))), rng.choice(["/", "/a", "/a/", ""])): rng.choice(["allow", "block"]) for _ in range(20)}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(4)
    given = spark.createDataFrame([(a, h, p) for (h, p), a in rules.items()], "action string, host string, path string")
    for ranges in (1, 7):
        got = {r["page_id"]: tuple(r)[1:] for r in judge(pages, given, ranges=ranges).collect()}
        for i, u in enumerate(urls):
            m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
            host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
            fits = [(len(h + p), len(h), h + p, a) for (h, p), a in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
            best = max(fits, default=None)
            assert got[i][:2] == (host, path)
            assert got[i][3] == (best[3] if best else "allow") or best and sum(f[:2] == best[:2] for f in fits) > 1
            assert (got[i][2] is None) == (best is None)
    assert judge(pages.limit(0), given).count() == 0
    assert judge(pages, given.limit(0)).filter("verdict <> 'allow'").count() == 0


def _components(rows, width=5):
    sets = {}
    for i, t, *_ in rows:
        w = words_of(t)
        if i is not None:
            sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("options", [{}, {"heavy": 3}, {"boundary": 48, "heavy": 4}, {"boundary": 16}])
def test_ngram_join(spark, docs, rows, empty, options):
    from tidemark.llm.ngram_join import join

    rng = random.Random(6)
    short = [sentence(rng, rng.randrange(4, 30)) for _ in range(10)]
    more = []
    for i in range(120):
        w = rng.choice(short).split(" ")
        for _ in range(rng.randrange(0, 3)):
            w[rng.choice([0, -1])] = str(rng.randrange(99))
        more.append((2000 + i, " ".join(w), "en", "s", 1, *"abcdefghi"))
    both = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    want = _components([*rows, *more])
    got = join(both, **options).collect()
    assert len(got) == len(rows) + len(more)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        else:
            assert r["component_id"] is None
    if not options:
        assert join(empty).count() == 0


@pytest.mark.parametrize("heavy", [3, 32])
def test_ngram_join_of_a_large_cluster(spark, heavy):
    """Variants of one text, many of them too far apart for a link, some reached only through others."""
    from tidemark.llm.ngram_join import join

    rng = random.Random(16)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join(spark.createDataFrame(rows, "doc_id long, text string"), heavy=heavy).collect()}
    assert got == _components(rows)


def test_components(spark):
    from tidemark.llm.graph import components

    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(200)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    for chunk in (1 << 20, 40):
        got = {r["node"]: r["component"] for r in components(df, chunk=chunk).collect()}
        assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
        moved = {r["node"]: r["component"] for r in components(df, roots=False, chunk=chunk).collect()}
        assert moved == {x: r for x, r in got.items() if x != r}


def test_pipeline(spark, docs, rows, empty):
    """Each stage against a brute-force version on what its predecessor kept."""
    import corpus_pipeline as p
    from tidemark.llm.bpe import encoder
    from tidemark.llm.kit import materialize
    from tidemark.llm.kn_quality import judge
    from tidemark.llm.packing import byte_bpe_path

    stages, now = dict(p.STAGES), docs
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    kept = Counter(tuple(r[c] for c in ("doc_id", "text")) for r in judge(docs, columns=["doc_id", "text"]).filter("kept").collect())
    now = materialize(stages["quality_rules"](spark, now, ""))
    assert now.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in now.collect()) == kept

    before = [(r["doc_id"], r["text"]) for r in now.collect()]
    cut = _cut_lines(before, 8)
    now = materialize(stages["line_dedup"](spark, now, ""))
    want = [(i, cut.get((i, t), t)) for i, t in before]
    want = Counter(x for x, y in zip(want, before, strict=True) if x[1] == y[1] or WORDS.search(x[1]))
    assert now.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in now.collect()) == want
    assert all(r["n_chars"] == len(r["text"]) for r in now.collect() if (r["doc_id"], r["text"]) not in kept)

    before = [(r["doc_id"], r["text"]) for r in now.collect()]
    groups = _components(before)
    now = materialize(stages["near_dedup"](spark, now, ""))
    after = now.collect()
    assert now.columns == docs.columns
    assert sorted({groups[i][1] for i, _ in before if i is not None}) == sorted(r["doc_id"] for r in after if r["doc_id"] is not None)
    assert sum(r["doc_id"] is None for r in after) == sum(i is None for i, _ in before)

    texts = {(r["doc_id"], r["source"]): r["text"] for r in after}
    size = Counter()
    for r in after:
        size[r["source"]] += len(WORDS.findall(r["text"] or ""))
    order = sorted(size, key=lambda x: (x is None, x or ""))
    weight, target, free = {x: i % 3 + 1 for i, x in enumerate(order)}, {}, set(order)
    while True:
        left = sum(size.values()) - sum(target.values())
        share = {x: left * weight[x] / sum(weight[y] for y in free) for x in free}
        over = {x for x in free if share[x] > 3 * size[x]}
        if not over:
            break
        target |= {x: 3 * size[x] for x in over}
        free -= over
    target |= share
    now = materialize(stages["mixing"](spark, now, ""))
    mixed, taken, copies = now.collect(), Counter(), Counter()
    for r in mixed:
        whole = texts[r["doc_id"], r["source"]]
        assert r["text"] and whole.startswith(r["text"]) and WORDS.findall(r["text"]) == WORDS.findall(whole)[: len(WORDS.findall(r["text"]))]
        taken[r["source"]] += len(WORDS.findall(r["text"]))
        copies[r["doc_id"], r["source"]] += 1
    assert now.columns == docs.columns and max(copies.values()) <= 3
    assert all(abs(taken[x] - target[x]) <= 1 for x in order)

    packed = stages["packing"](spark, now, "").collect()
    encode, lengths = encoder(byte_bpe_path()).encode, Counter()
    for r in mixed:
        raw = np.frombuffer(r["text"].encode(), np.uint8)
        lengths[r["doc_id"]] += len(encode(raw, np.array([0, len(raw)]))[0]) + 1
    got, rooms = Counter(), defaultdict(list)
    for r in packed:
        got[r["doc_id"]] += r["length"]
        rooms[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == lengths
    for pieces in rooms.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 2048

    now = empty
    for _, stage in p.STAGES:
        now = materialize(stage(spark, now, ""))
    assert now.count() == 0
