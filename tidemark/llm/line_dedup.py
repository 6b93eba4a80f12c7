"""Line dedup: later copies of maximal repeated runs of lines are deleted. DataFrame functions only.

A document is its sequence of lines that hold a word. Prefix doubling builds the suffix array over all documents' sequences: runs of
1, 2, 4, ... lines that occur more than once are named by their rank, names of runs twice as long come from sorted pairs of names,
and so on until no run of that length repeats; a position whose run is unique or whose document ends drops out. Positions with one
name are an interval of the suffix array whose common prefix has that many lines at least; all but its first position (doc_id, then
line) are later copies.

Every later position takes the longest doubled run that it shares with an earlier one; runs of min_words lines or more hold as many
words. Since the position after it shares a run that is shorter by a line at most, these runs together cover a maximal repeated run
to its end. Shorter runs are looked up line by line: the shortest one with min_words words from each position, and the shortest one
up to it, are intervals whose common prefix is a pair of overlapping doubled runs. A line of a maximal run that is in neither kind
would leave fewer than min_words words on both sides of it, so nothing of a maximal run with min_words words stays.

Lines are told apart by 128-bit hashes. Lines without a word are never deleted. Null texts stay null, texts of any length are compared
whole, rows with a null doc_id stay as they are, equal rows get equal results (neither is earlier), and rows that share a doc_id but
not the text are ordered by a hash of it. Empty tables give empty results. Extra columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.kit import WORD, fresh, materialize, release

POSITION = ["d", "x", "k"]


def _lines(docs: DataFrame) -> DataFrame:
    """d, x (row identity), k (position among lines with a word), at (position among all lines), h, g (the line's hash), words."""
    line = lambda s, i: F.struct(i.alias("at"), F.xxhash64(s).alias("h"), F.xxhash64(F.lit(1), s).alias("g"), F.regexp_count(s, F.lit(WORD)).alias("words"))
    found = F.filter(F.transform(F.split("text", "\n"), line), lambda s: s["words"] > 0)
    rows = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("x"), "text").dropDuplicates(["d", "x"])
    return rows.select("d", "x", F.posexplode(found).alias("k", "s")).select("d", "x", "k", "s.at", "s.h", "s.g", "s.words")


def _ranked(runs: DataFrame, keys: list[str]) -> DataFrame:
    """d, x, k, r: positions whose keys occur more than once, with the rank of the keys."""
    names = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(*keys).select(*keys, F.monotonically_increasing_id().alias("rank"))
    names = materialize(names)
    return materialize(runs.join(names, keys).select(*POSITION, F.col("rank").alias("r")))


def _later(hit: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of an interval (of equal keys) but for its first position."""
    first = materialize(hit.groupBy(*keys).agg(F.min(F.struct(*POSITION)).alias("p"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    return hit.join(first, keys).filter(F.struct(*POSITION) > F.col("p")).drop("p")


def _shortest(known: DataFrame, min_words: int, step: int) -> DataFrame:
    """d, x, k, m: the shortest run of m known lines from k on (step 1) or up to k (step -1) with min_words words."""
    # From running sums: at most min_words lines, since each line has a word.
    near = known.select("d", "x", "k", F.explode(F.sequence(F.lit(0), F.lit(min_words - 1))).alias("o"), "words").select("d", "x", (F.col("k") - step * F.col("o")).alias("k"), F.struct("o", "words").alias("w"))
    near = near.filter("k >= 0").groupBy("d", "x", "k").agg(F.array_sort(F.collect_list("w")).alias("w"))
    total = F.aggregate("w", F.struct(F.lit(0).alias("m"), F.lit(0).alias("sum"), F.lit(True).alias("ok")), lambda s, w: F.when((s["sum"] >= min_words) | ~s["ok"] | (w["o"] != s["m"]), F.struct(s["m"].alias("m"), s["sum"].alias("sum"), (s["ok"] & (s["sum"] >= min_words)).alias("ok"))).otherwise(F.struct((s["m"] + 1).alias("m"), (s["sum"] + w["words"]).alias("sum"), s["ok"])))
    return near.withColumn("t", total).filter("t.sum >= " + str(min_words)).select("d", "x", "k", F.col("t.m").alias("m"))


def repeated_lines(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """d, x, k, at of the lines to delete."""
    lines = materialize(_lines(docs))
    levels = [_ranked(lines.select(*POSITION, "h", "g"), ["h", "g"])]
    while not levels[-1].isEmpty():
        size = 1 << (len(levels) - 1)
        after = levels[-1].select("d", "x", (F.col("k") - size).alias("k"), F.col("r").alias("s"))
        pairs = materialize(levels[-1].join(after, POSITION))
        levels.append(_ranked(pairs, ["r", "s"]))
        release(pairs)
    known = lines.join(levels[0], POSITION, "left_semi")
    ending = _shortest(known, min_words, -1).withColumn("k", F.col("k") - F.col("m") + 1)
    need = materialize(_shortest(known, min_words, 1).unionByName(ending).distinct())
    gone = []
    for level, ranks in enumerate(levels[:-1]):
        size = 1 << level
        if size >= min_words:
            gone.append(_later(ranks, ["r"]).select(*POSITION, (F.col("k") + size).alias("end")))
            continue
        own = need.filter((F.col("m") >= size) & (F.col("m") < min(2 * size, min_words)))
        first = ranks.select(*POSITION, F.col("r").alias("a"))
        last = ranks.select("d", "x", F.col("k").alias("j"), F.col("r").alias("b"))
        hit = materialize(own.join(first, POSITION).withColumn("j", F.col("k") + F.col("m") - size).join(last, ["d", "x", "j"]).select(*POSITION, "m", "a", "b"))
        gone.append(_later(hit, ["m", "a", "b"]).select(*POSITION, (F.col("k") + F.col("m")).alias("end")))
        if size < min_words < 2 * size:  # runs of min_words lines have no level of their own
            own = ranks.join(ranks.select("d", "x", (F.col("k") - (min_words - size)).alias("k"), F.col("r").alias("b")), POSITION).withColumnRenamed("r", "a")
            gone.append(_later(materialize(own), ["a", "b"]).select(*POSITION, (F.col("k") + min_words).alias("end")))
    runs = gone[0] if gone else lines.limit(0).select(*POSITION, F.col("k").alias("end"))
    for more in gone[1:]:
        runs = runs.unionByName(more)
    runs = materialize(runs.groupBy(*POSITION).agg(F.max("end").alias("end")))
    # A line goes if a run that began at it or before reaches beyond it.
    reach = F.max("end").over(Window.partitionBy("d", "x").orderBy("k"))
    some = lines.join(runs.select("d", "x").distinct(), ["d", "x"], "left_semi").join(runs, POSITION, "left")
    return some.withColumn("reach", reach).filter("reach > k").select(*POSITION, "at")


def dedup_lines(docs: DataFrame, min_words: int = 8, drop_empty: bool = False) -> DataFrame:
    """docs with their texts, n_chars where there is such a column, and n_removed and n_runs (deleted lines and maximal runs of them).

    drop_empty: leave out documents that lost lines and have no word left.
    """
    docs = docs.drop("n_removed", "n_runs")
    ld_d, ld_y, ld_k, ld_at, ld_x = fresh(docs, "_ld_d", "_ld_y", "_ld_k", "_ld_at", "_ld_x")
    gone = repeated_lines(docs, min_words)
    per = gone.groupBy(F.col("d").alias(ld_d), F.col("x").alias(ld_y)).agg(F.array_sort(F.collect_list("k")).alias(ld_k), F.array_sort(F.collect_list("at")).alias(ld_at))
    out = docs.withColumn(ld_x, F.xxhash64("text")).join(per, (F.col("doc_id") == F.col(ld_d)) & (F.col(ld_x) == F.col(ld_y)), "left")
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(ld_at))
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    out = out.withColumn("text", F.when(F.col(ld_at).isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(ld_at).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    runs = F.aggregate(ld_k, F.struct(F.lit(-2).alias("last"), F.lit(0).alias("n")), lambda s, k: F.struct(k.alias("last"), (s["n"] + (k != s["last"] + 1).cast("int")).alias("n")))["n"]
    out = out.withColumn("n_removed", F.when(F.col(ld_k).isNull(), 0).otherwise(F.size(ld_k)).cast("bigint")).withColumn("n_runs", F.coalesce(runs, F.lit(0)).cast("bigint"))
    if drop_empty:
        out = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    return out.select(*docs.columns, "n_removed", "n_runs")
