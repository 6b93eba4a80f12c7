"""A compressed binary sparse trie over 32-byte keys: roots, inclusion and exclusion proofs.

A subtree of one key is its leaf H(key, value, height), height being the bits left below it; a subtree of none is one zero byte;
an inner node is H(left, right). Subtrees of the first bits are built by tasks of their own and joined at the top.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMPTY = b"\x00"
BITS = 256


def _hash(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).digest()


def bit(key: bytes, i: int) -> int:
    return key[i >> 3] >> (7 - (i & 7)) & 1


def leaf(key: bytes, value: bytes, height: int) -> bytes:
    return _hash(key, value, height.to_bytes(2, "big"))


def _split(rows: list[tuple[bytes, bytes]], low: int, high: int, depth: int) -> int:
    """First row of rows[low:high] whose bit at depth is one; rows are sorted."""
    first = rows[low][0]
    pivot = bytearray(first[: depth >> 3]) + bytes([(first[depth >> 3] & (0xFF00 >> (depth & 7)) & 0xFF) | (0x80 >> (depth & 7))])
    return bisect_left(rows, (bytes(pivot).ljust(len(first), b"\0"), b""), low, high)


def root(rows: list[tuple[bytes, bytes]], depth: int = 0, low: int = 0, high: int | None = None) -> bytes:
    """Root of sorted (key, value) rows below a prefix of `depth` bits."""
    high = len(rows) if high is None else high
    if high == low:
        return EMPTY
    if high - low == 1:
        return leaf(*rows[low], BITS - depth)
    mid = _split(rows, low, high, depth)
    return _hash(root(rows, depth + 1, low, mid), root(rows, depth + 1, mid, high))


def proof(rows: list[tuple[bytes, bytes]], key: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
    """Siblings from the top down to where the key's path ends, and the row there: the key's own, another's, or none."""
    out, low, high, depth = [], 0, len(rows), 0
    while high - low > 1:
        mid = _split(rows, low, high, depth)
        if bit(key, depth):
            out.append(root(rows, depth + 1, low, mid))
            low = mid
        else:
            out.append(root(rows, depth + 1, mid, high))
            high = mid
        depth += 1
    return out, rows[low] if high > low else None


def compress(siblings: list[bytes]) -> tuple[bytes, int, list[bytes]]:
    """A bitmap of the siblings that aren't empty, their number, and those."""
    marks = 0
    for s in siblings:
        marks = marks << 1 | (s != EMPTY)
    return marks.to_bytes((len(siblings) + 7) // 8, "big"), len(siblings), [s for s in siblings if s != EMPTY]


def expand(packed: tuple[bytes, int, list[bytes]]) -> list[bytes]:
    marks, n, kept = int.from_bytes(packed[0], "big"), packed[1], iter(packed[2])
    return [next(kept) if marks >> (n - 1 - i) & 1 else EMPTY for i in range(n)]


def verify(top: bytes, key: bytes, siblings: list[bytes], end: tuple[bytes, bytes] | None, value: bytes | None) -> bool:
    """Inclusion of (key, value), or exclusion of key if value is None."""
    depth = len(siblings)
    if value is None:
        if end is not None and (end[0] == key or any(bit(end[0], i) != bit(key, i) for i in range(depth))):
            return False
    elif end != (key, value):
        return False
    node = EMPTY if end is None else leaf(*end, BITS - depth)
    for i in range(depth - 1, -1, -1):
        node = _hash(siblings[i], node) if bit(key, i) else _hash(node, siblings[i])
    return node == top


def _prefix(top_bits: int):
    return F.call_function("shiftrightunsigned", F.conv(F.hex(F.substring("key", 1, 2)), 16, 10).cast("int"), F.lit(16 - top_bits))


class Nodes:
    """All nodes of the trie over sorted rows below a prefix, each hashed once: proofs walk down them."""

    def __init__(self, rows: list[tuple[bytes, bytes]], depth: int = 0):
        self.rows, self.depth, self.inner = rows, depth, {}
        self.top = self._build(0, len(rows), depth)

    def _build(self, low: int, high: int, depth: int) -> bytes:
        if high - low < 2:
            return leaf(*self.rows[low], BITS - depth) if high > low else EMPTY
        mid = _split(self.rows, low, high, depth)
        left, right = self._build(low, mid, depth + 1), self._build(mid, high, depth + 1)
        self.inner[low, high, depth] = mid, left, right
        return _hash(left, right)

    def proof(self, key: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
        """Siblings from the prefix down to where the key's path ends, and the row there, if any."""
        out, low, high, depth = [], 0, len(self.rows), self.depth
        while (low, high, depth) in self.inner:
            mid, left, right = self.inner[low, high, depth]
            out.append(left if bit(key, depth) else right)
            low, high, depth = (mid, high, depth + 1) if bit(key, depth) else (low, mid, depth + 1)
        return out, self.rows[low] if high > low else None


def prove(keyed: DataFrame, wanted: DataFrame, top_bits: int = 8) -> DataFrame:
    """A row for each wanted key: key, siblings from the top down, end_key and end_value (the row where the path ends, if any), root.

    The subtrees of the first bits prove in tasks of their own; their roots, at most 2**top_bits, are broadcast for the steps above.
    """
    prefix = _prefix(top_bits)
    rows = keyed.select("key", "value").withColumn("p", prefix)

    def roots(key: tuple, table: pa.Table) -> pa.Table:
        own = sorted(zip(table["key"].to_pylist(), table["value"].to_pylist(), strict=True))
        return pa.table({"p": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(own)]), "hash": pa.array([root(own, top_bits)], pa.binary()), "key": pa.array([own[0][0]], pa.binary()), "value": pa.array([own[0][1]], pa.binary())})

    subtrees = {r["p"]: (r["n"], bytes(r["hash"]), bytes(r["key"]), bytes(r["value"])) for r in rows.groupBy("p").applyInArrow(roots, "p int, n long, hash binary, key binary, value binary").collect()}
    # levels[d][q]: number of rows, hash and the only row of the node of d bits with prefix q
    levels = [{} for _ in range(top_bits)] + [{p: (n, h, (k, v) if n == 1 else None) for p, (n, h, k, v) in subtrees.items()}]
    for depth in range(top_bits - 1, -1, -1):
        for q in {p >> 1 for p in levels[depth + 1]}:
            left, right = (levels[depth + 1].get(2 * q + i, (0, EMPTY, None)) for i in (0, 1))
            one = left[2] or right[2]
            n = left[0] + right[0]
            levels[depth][q] = (n, leaf(*one, BITS - depth), one) if n == 1 else (n, _hash(left[1], right[1]), None)
    shared = keyed.sparkSession.sparkContext.broadcast(levels)
    top = levels[0].get(0, (0, EMPTY, None))[1]

    def run(key: tuple, asked: pa.Table, own: pa.Table) -> pa.Table:
        p, levels = key[0].as_py(), shared.value
        below = Nodes(sorted(zip(own["key"].to_pylist(), own["value"].to_pylist(), strict=True)), top_bits) if own.num_rows else None
        out = []
        for k in asked["key"].to_pylist():
            siblings, end, ended = [], None, False
            for depth in range(top_bits):
                n, _, one = levels[depth].get(p >> (top_bits - depth), (0, EMPTY, None))
                if n < 2:
                    end, ended = one, True
                    break
                siblings.append(levels[depth + 1].get((p >> (top_bits - depth - 1)) ^ 1, (0, EMPTY, None))[1])
            if not ended and below is not None:
                more, end = below.proof(k)
                siblings += more
            out.append((k, siblings, end[0] if end else None, end[1] if end else None, top))
        kinds = (pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary())
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(zip(("key", "siblings", "end_key", "end_value", "root"), kinds, strict=True))})

    asked = wanted.select("key").withColumn("p", prefix)
    return asked.groupBy("p").cogroup(rows.groupBy("p")).applyInArrow(run, "key binary, siblings array<binary>, end_key binary, end_value binary, root binary")


def verified(proofs: DataFrame) -> DataFrame:
    """proofs with `value` (null: exclusion is claimed) and `valid`, whether each row proves its claim."""

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("root", "key", "siblings", "end_key", "end_value", "value")), strict=True)
            ok = [verify(r, k, s, None if ek is None else (ek, ev), v) for r, k, s, ek, ev, v in rows]
            yield b.append_column("valid", pa.array(ok, pa.bool_()))

    return proofs.mapInArrow(run, T.StructType([*proofs.schema.fields, T.StructField("valid", T.BooleanType())]))


def distributed_root(keyed: DataFrame, top_bits: int = 8) -> DataFrame:
    """One row with the root of (key, value). Keys are digests, so the subtrees of the first bits are of even size."""
    rows = keyed.withColumn("p", _prefix(top_bits))

    def below(key: tuple, table: pa.Table) -> pa.Table:
        own = sorted(zip(table["key"].to_pylist(), table["value"].to_pylist(), strict=True))
        single = own[0] if len(own) == 1 else (None, None)
        return pa.table({"p": pa.array([key[0].as_py()], pa.int32()), "hash": pa.array([root(own, top_bits)], pa.binary()), "key": pa.array([single[0]], pa.binary()), "value": pa.array([single[1]], pa.binary())})

    def join(table: pa.Table) -> pa.Table:
        level = {p: (h, (k, v) if k is not None else None) for p, h, k, v in zip(*(table[c].to_pylist() for c in ("p", "hash", "key", "value")), strict=True)}
        for depth in range(top_bits - 1, -1, -1):
            above = {}
            for p in {p >> 1 for p in level}:
                left, right = level.get(2 * p, (EMPTY, None)), level.get(2 * p + 1, (EMPTY, None))
                one = [x[1] for x in (left, right) if x[0] != EMPTY]
                if len(one) == 1 and one[0] is not None:
                    above[p] = (leaf(*one[0], BITS - depth), one[0])
                else:
                    above[p] = (_hash(left[0], right[0]), None)
            level = above
        return pa.table({"root": pa.array([level.get(0, (EMPTY, None))[0].hex()])})

    subtrees = rows.select("p", "key", "value").groupBy("p").applyInArrow(below, "p int, hash binary, key binary, value binary")
    # At most 2**top_bits rows meet at the top.
    return subtrees.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(lambda table: join(table), "root string")
