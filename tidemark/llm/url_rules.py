"""URL filters by a sort-merge range join.

A host's labels in reverse, each with a dot, make a key in which a rule's host and all of its subdomains are one interval. Rules and
urls are dealt to ranges of (key, path) between sampled splitters, a rule to every range that its interval meets; each range is
sorted, and one sweep keeps the stack of the rules whose intervals are open. They nest, since they are prefixes. For a url, rules
on the stack whose path starts the url's path fit it; the longest of them (host and path together, then host) decides.

A key that fills several ranges by itself is dealt over them by the row's hash, so one hot url doesn't make one large task.
Null urls and urls without "://" have an empty host and path and no rule. Repeated rows are judged each; rules may repeat (of equal
rules with different actions block wins). Empty tables give empty results. Only the named columns are carried.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kit import materialize

PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = "\U0010ffff"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id", url_column: str = "url", ranges: int | None = None) -> DataFrame:
    """rules: action (allow or block), host, path. Returns the id, host, path, rule and verdict of every page."""
    spark = pages.sparkSession
    urls = pages.select(F.col(id_column).alias("id"), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path"))
    urls = materialize(urls.withColumn("key", host_key(F.col("host"))))
    n = urls.count()
    ranges = ranges or max(1, min(4096, n // 20_000 + 1))
    # 64 keys a range are drawn on average: a bounded number, and only the balance of the ranges depends on them.
    sample = urls.select("key", "path").sample(min(1.0, 64 * ranges / max(n, 1)), seed=7).limit(256 * ranges)
    drawn = sorted((r["key"].encode(), r["path"].encode()) for r in sample.collect()) if ranges > 1 else []
    splitters = [drawn[len(drawn) * i // ranges] for i in range(1, ranges)] if drawn else []
    cuts = spark.sparkContext.broadcast(splitters)

    def deal_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, turn = cuts.value, 0
        for b in batches:
            to = []
            for key, path in zip(b.column("key").to_pylist(), b.column("path").to_pylist(), strict=True):
                k = (key.encode(), path.encode())
                low, high = bisect_left(at, k), bisect_right(at, k)
                turn += 1
                to.append(low + turn % (high - low + 1))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([1] * len(to), pa.int32()), *(b.column(c) for c in ("key", "path", "host", "id")), pa.nulls(len(to), pa.string())], ["range", "kind", "key", "path", "host", "id", "action"])

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = cuts.value
        for b in batches:
            out = []
            for r in b.to_pylist():
                first, last = bisect_left(at, (r["key"].encode(), b"")), bisect_right(at, ((r["key"] + LAST).encode(), b""))
                out += [{"range": i, "kind": 0, "key": r["key"], "path": r["path"], "host": r["host"], "id": None, "action": r["action"]} for i in range(first, last + 1)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("range", pa.int32()), ("kind", pa.int32()), ("key", pa.string()), ("path", pa.string()), ("host", pa.string()), ("id", pa.int64()), ("action", pa.string())]))

    schema = "range int, kind int, key string, path string, host string, id long, action string"
    own = rules.select("action", F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")).withColumn("key", host_key(F.col("host")))
    dealt = urls.mapInArrow(deal_urls, schema).unionByName(own.mapInArrow(deal_rules, schema))
    swept = dealt.repartition(max(ranges, 1), "range").sortWithinPartitions("range", "key", "kind", "path")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, stack = None, []  # of (key, {path: (action, rule)}, lengths of paths)
        for b in batches:
            ids, hosts, paths, names, verdicts = [], [], [], [], []
            for where, kind, key, path, host, id_, action in zip(*(b.column(c).to_pylist() for c in ("range", "kind", "key", "path", "host", "id", "action")), strict=True):
                if where != here:
                    here, stack = where, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not kind:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    known = stack[-1][1]
                    if path not in known or action == "block":
                        known[path] = (action, host + path)
                    if len(path) not in stack[-1][2]:
                        stack[-1][2].append(len(path))
                        stack[-1][2].sort(reverse=True)
                    continue
                best = None
                for rule_key, known, lengths in stack:
                    for n in lengths:
                        if n <= len(path) and (found := known.get(path[:n])):
                            rank = (len(found[1]), len(rule_key))
                            if best is None or rank > best[0]:
                                best = (rank, found)
                            break
                ids.append(id_), hosts.append(host), paths.append(path)
                names.append(best[1][1] if best else None)
                verdicts.append(best[1][0] if best else default)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(names, pa.string()), pa.array(verdicts, pa.string())], ["id", "host", "path", "rule", "verdict"])

    out = swept.mapInArrow(sweep, "id long, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_column)
