"""Binary codecs: varints, the wire format of messages, blocks of transactions, and UDFs around them."""

from __future__ import annotations

import gzip
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the block format: magic byte, body mark, codec numbers, header layout.
MAGIC, MARK = 0xBA, 0xEE
CODECS = {"none": 0, "zstd": 1, "lz4": 2, "s2": 3, "gzip": 4}
HEADER = struct.Struct("<BBQQQ")
SIGNATURE = 64


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def get_varint(b: bytes, at: int) -> tuple[int, int]:
    """Value and the position after it; at most ten bytes."""
    n = 0
    for k in range(10):
        if at + k >= len(b):
            break
        n |= (b[at + k] & 127) << 7 * k
        if b[at + k] < 128:
            return n, at + k + 1
    raise ValueError("bad varint")


def scan_wire(b: bytes, most_depth: int = 0) -> bool:
    """Whether bytes are a whole sequence of wire-format fields."""
    at = 0
    try:
        while at < len(b):
            tag, at = get_varint(b, at)
            if not tag >> 3:
                return False
            kind = tag & 7
            if kind == 0:
                _, at = get_varint(b, at)
            elif kind == 1:
                at += 8
            elif kind == 5:
                at += 4
            elif kind == 2:
                n, at = get_varint(b, at)
                at += n
            else:
                return False
        return at == len(b) and at > 0
    except ValueError:
        return False


def _compress(b: bytes, codec: str, dictionary: bytes | None) -> bytes:
    if codec == "none":
        return b
    if codec == "zstd":
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
        return zstandard.ZstdCompressor(level=3, dict_data=d).compress(b)
    if codec == "gzip":
        return gzip.compress(b, mtime=0)
    codecs = {"lz4": "lz4_raw", "s2": "snappy"}
    return pa.compress(b, codec=codecs[codec], asbytes=True)


def _expand(b: bytes, codec: int, raw: int, dictionary: bytes | None) -> bytes:
    name = next((k for k, v in CODECS.items() if v == codec), None)
    if name is None:
        raise ValueError("unknown codec")
    if name == "none":
        return b
    if name == "zstd":
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
        return zstandard.ZstdDecompressor(dict_data=d).decompress(b, max_output_size=raw)
    if name == "gzip":
        return gzip.decompress(b)
    return pa.decompress(b, decompressed_size=raw, codec={"lz4": "lz4_raw", "s2": "snappy"}[name], asbytes=True)


def encode_block(txs: list[tuple[bytes, bytes]], codec: str = "zstd", dictionary: bytes | None = None) -> bytes:
    """(signature, body) pairs: header, plain signatures as one column, and marked, length-led bodies as the other, compressed.

    The header's sizes are those of the bodies. An empty signature is zeros; one of any other length is an error.
    """
    for i, (s, _) in enumerate(txs):
        if len(s) not in (0, SIGNATURE):
            raise ValueError(f"signature {i} has {len(s)} bytes")
    raw = b"".join(bytes([MARK]) + put_varint(len(b)) + b for _, b in txs)
    packed = _compress(raw, codec, dictionary)
    return HEADER.pack(MAGIC, CODECS[codec], len(txs), len(raw), len(packed)) + b"".join(s.ljust(SIGNATURE, b"\0") for s, _ in txs) + packed


def raw_size(block: bytes) -> int:
    """Bytes of a block's bodies before compression, from its header."""
    return HEADER.unpack_from(block)[3]


def decode_block(block: bytes, dictionary: bytes | None = None) -> list[tuple[bytes, bytes]]:
    if len(block) < HEADER.size:
        raise ValueError("truncated block")
    magic, codec, n, size_raw, size_packed = HEADER.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("bad magic")
    signatures, bodies = HEADER.size, HEADER.size + n * SIGNATURE
    if len(block) != bodies + size_packed:
        raise ValueError("truncated block")
    raw = _expand(block[bodies:], codec, size_raw, dictionary)
    if len(raw) != size_raw:
        raise ValueError("bad size")
    at, out = 0, []
    for i in range(n):
        if at >= len(raw) or raw[at] != MARK:
            raise ValueError("bad mark")
        size, at = get_varint(raw, at + 1)
        if at + size > len(raw):
            raise ValueError("truncated body")
        out.append((block[signatures + i * SIGNATURE : signatures + (i + 1) * SIGNATURE], raw[at : at + size]))
        at += size
    if at != len(raw):
        raise ValueError("bytes after the last body")
    return out


def encode_blocks(txs: DataFrame, block_size: int = 1000, codec: str = "zstd") -> DataFrame:
    """Rows (block, seq, sig, body) into one binary row per block, in order of seq."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["seq"].to_pylist(), table["sig"].to_pylist(), table["body"].to_pylist(), strict=True))
        data = encode_block([(s, b) for _, s, b in rows], codec)
        raw = raw_size(data)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(rows)], pa.int64()), "raw_size": pa.array([raw], pa.int64()), "data": pa.array([data], pa.binary())})

    return txs.select("block", "seq", "sig", "body").groupBy("block").applyInArrow(run, "block long, n long, raw_size long, data binary")


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """block, pos, sig, body of every transaction; a broken block gives one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for block, data in zip(b.column("block").to_pylist(), b.column("data").to_pylist(), strict=True):
                try:
                    out += [(block, i, s, body, None) for i, (s, body) in enumerate(decode_block(data))]
                except (ValueError, OSError, zstandard.ZstdError) as e:
                    out.append((block, None, None, None, str(e)))
            types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["block", "pos", "sig", "body", "error"])

    return blocks.select("block", "data").mapInArrow(run, "block long, pos int, sig binary, body binary, error string")


class Wire:
    """A batch of messages end to end, read a field of every message at a time."""

    def __init__(self, messages: pd.Series):
        parts = [b"" if x is None else bytes(x) for x in messages]
        self.data = np.frombuffer(b"".join(parts) + bytes(1), np.uint8)  # a byte more, so that any position up to the end can be read
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        self.end = np.cumsum(size)
        self.at = self.end - size
        self.bad = np.fromiter((x is None for x in messages), bool, len(parts))

    def varint(self, rows: np.ndarray) -> np.ndarray:
        """The next varint of these messages; those that have none are bad."""
        value, open_ = np.zeros(len(rows), np.uint64), np.ones(len(rows), bool)
        for k in range(10):
            on = np.flatnonzero(open_ & (self.at[rows] < self.end[rows]))
            if not len(on):
                break
            byte = self.data[self.at[rows[on]]]
            value[on] |= (byte & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
            self.at[rows[on]] += 1
            open_[on[byte < 128]] = False
        self.bad[rows[open_]] = True
        return value

    def fields(self) -> Iterator[tuple[np.ndarray, ...]]:
        """message, field number, kind and value of the messages' first fields, then of their second ones, and so on.

        The value of a length-delimited field is its length; its bytes end at `at`.
        """
        while len(rows := np.flatnonzero(~self.bad & (self.at < self.end))):
            tag = self.varint(rows)
            number, kind = (tag >> np.uint64(3)).astype(np.int64), (tag & np.uint64(7)).astype(np.int64)
            self.bad[rows[~np.isin(kind, (0, 1, 2, 5))]] = True
            value = np.zeros(len(rows), np.uint64)
            some = np.flatnonzero(((kind == 0) | (kind == 2)) & ~self.bad[rows])
            value[some] = self.varint(rows[some])
            skip = np.select([kind == 1, kind == 5, kind == 2], [8, 4, np.minimum(value, np.uint64(1 << 40)).astype(np.int64)], 0)
            self.at[rows] += np.where(self.bad[rows], 0, skip)
            for size in (4, 8):  # little-endian numbers
                on = np.flatnonzero((kind == (5 if size == 4 else 1)) & (self.at[rows] <= self.end[rows]) & ~self.bad[rows])
                for k in range(size):
                    value[on] |= self.data[self.at[rows[on]] - size + k].astype(np.uint64) << np.uint64(8 * k)
            self.bad[rows[self.at[rows] > self.end[rows]]] = True
            fine = ~self.bad[rows]
            yield rows[fine], number[fine], kind[fine], value[fine]


@F.pandas_udf(T.BooleanType())
def wire_ok(b: pd.Series) -> pd.Series:
    """scan_wire, a batch at a time."""
    wire = Wire(b)
    some = wire.at < wire.end
    for rows, number, _, _ in wire.fields():
        wire.bad[rows[number == 0]] = True
    return pd.Series(some & ~wire.bad)


# Messages: a flat order in wire format. Field numbers and kinds are fixed values of the format.
ORDER_FIELDS = {"uid": (1, 0), "nonce": (2, 0), "price": (3, 0), "amount": (4, 0), "signature": (6, 2), "symbol": (8, 0), "op_code": (9, 0)}


def encode_order(row: dict) -> bytes:
    out = b""
    for name, (number, kind) in ORDER_FIELDS.items():
        v = row.get(name)
        if v:
            out += put_varint(number << 3 | kind) + (put_varint(int(v)) if kind == 0 else put_varint(len(v)) + bytes(v))
    return out


def decode_order(b: bytes) -> dict:
    """Known fields of a message; unknown ones are skipped, absent ones are 0 or empty."""
    names = {n: k for k, (n, _) in ORDER_FIELDS.items()}
    out: dict = {k: 0 if kind == 0 else b"" for k, (_, kind) in ORDER_FIELDS.items()}
    at = 0
    while at < len(b):
        tag, at = get_varint(b, at)
        kind = tag & 7
        if kind == 0:
            v, at = get_varint(b, at)
        elif kind == 2:
            n, at = get_varint(b, at)
            if at + n > len(b):
                raise ValueError("truncated")
            v, at = b[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            if at + n > len(b):
                raise ValueError("truncated")
            v, at = int.from_bytes(b[at : at + n], "little"), at + n
        else:
            raise ValueError("bad kind")
        if tag >> 3 in names:
            out[names[tag >> 3]] = v
    return out


MESSAGE = T.StructType([T.StructField(name, T.LongType() if kind == 0 else T.BinaryType()) for name, (_, kind) in ORDER_FIELDS.items()])


def encode_orders(columns: dict[str, np.ndarray]) -> list[bytes]:
    """encode_order of many rows, a byte of every row at a time; columns: numbers by name of the field."""
    n = len(next(iter(columns.values())))
    sizes, values = [], []
    for name in columns:
        v = columns[name].astype(np.int64).view(np.uint64)
        bits = np.zeros(n, np.int64)
        rest = v.copy()
        for k in range(10):
            bits += rest > 0
            rest = rest >> np.uint64(7)
        values.append(v)
        sizes.append(np.where(v > 0, 1 + bits, 0))  # field numbers below 16: the tag is one byte
    end = np.cumsum(np.sum(sizes, axis=0))
    out = np.zeros(int(end[-1]) if n else 0, np.uint8)
    at = end - np.sum(sizes, axis=0) if n else end
    start = at.copy()
    for (name, v), size in zip(zip(columns, values, strict=True), sizes, strict=True):
        number, kind = ORDER_FIELDS[name]
        on = np.flatnonzero(size)
        out[at[on]] = number << 3 | kind
        for k in range(int(size.max(initial=1)) - 1):
            on = np.flatnonzero(size > k + 1)
            more = (size[on] > k + 2).astype(np.uint8) << np.uint8(7)
            out[at[on] + 1 + k] = ((v[on] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
        at = at + size
    raw = out.tobytes()
    return [raw[a:e] for a, e in zip(start.tolist(), end.tolist(), strict=True)]


@F.pandas_udf(T.BinaryType())
def order_message(uid: pd.Series, nonce: pd.Series, price: pd.Series, amount: pd.Series, symbol: pd.Series, op_code: pd.Series) -> pd.Series:
    names = ("uid", "nonce", "price", "amount", "symbol", "op_code")
    return pd.Series(encode_orders({k: c.fillna(0).to_numpy() for k, c in zip(names, (uid, nonce, price, amount, symbol, op_code), strict=True)}), dtype=object)


@F.pandas_udf(MESSAGE)
def parse_order(b: pd.Series) -> pd.DataFrame:
    """Fields of messages; a broken message has nulls."""
    wire, by_number = Wire(b), {number: name for name, (number, _) in ORDER_FIELDS.items()}
    out = {name: np.zeros(len(b), np.uint64) if kind == 0 else np.full(len(b), b"", object) for name, (_, kind) in ORDER_FIELDS.items()}
    for rows, number, kind, value in wire.fields():
        for k in np.intersect1d(number, list(by_number)).tolist():
            name, on = by_number[k], np.flatnonzero(number == k)
            if ORDER_FIELDS[name][1] == 0:
                on = on[kind[on] != 2]
                out[name][rows[on]] = value[on]
            else:
                for i in on[kind[on] == 2].tolist():
                    e = int(wire.at[rows[i]])
                    out[name][rows[i]] = wire.data[e - int(value[i]) : e].tobytes()
    frame = {}
    for name, (_, kind) in ORDER_FIELDS.items():
        frame[name] = pd.array(out[name].view(np.int64), dtype="Int64") if kind == 0 else pd.Series(out[name])
        frame[name][wire.bad] = pd.NA if kind == 0 else None
    return pd.DataFrame(frame, columns=list(ORDER_FIELDS))


# Ed25519 by RFC 8032, in plain integers: for tests and for small streams.
_P = 2**255 - 19
_L = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, -1, _P) % _P


def _add(p, q):
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % _P, (p[1] + p[0]) * (q[1] + q[0]) % _P
    c, d = 2 * p[3] * q[3] * _D % _P, 2 * p[2] * q[2] % _P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _times(n, p):
    q = (0, 1, 1, 0)
    while n:
        if n & 1:
            q = _add(q, p)
        p, n = _add(p, p), n >> 1
    return q


def _x_of(y, sign):
    if y >= _P:
        return None
    x2 = (y * y - 1) * pow(_D * y * y + 1, -1, _P) % _P
    x = pow(x2, (_P + 3) // 8, _P)
    if (x * x - x2) % _P:
        x = x * pow(2, (_P - 1) // 4, _P) % _P
    if (x * x - x2) % _P or not x and sign:
        return None
    return _P - x if x & 1 != sign else x


_Y = 4 * pow(5, -1, _P) % _P
_G = (_x_of(_Y, 0), _Y, 1, _x_of(_Y, 0) * _Y % _P)


def _pack(p):
    z = pow(p[2], -1, _P)
    x, y = p[0] * z % _P, p[1] * z % _P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(b):
    n = int.from_bytes(b, "little")
    y, sign = n & (1 << 255) - 1, n >> 255
    x = _x_of(y, sign)
    return None if x is None else (x, y, 1, x * y % _P)


def _secret(key: bytes):
    h = hashlib.sha512(key).digest()
    a = int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254
    return a, h[32:]


def public_key(key: bytes) -> bytes:
    return _pack(_times(_secret(key)[0], _G))


def sign(key: bytes, message: bytes) -> bytes:
    a, prefix = _secret(key)
    r = int.from_bytes(hashlib.sha512(prefix + message).digest(), "little") % _L
    point = _pack(_times(r, _G))
    k = int.from_bytes(hashlib.sha512(point + public_key(key) + message).digest(), "little") % _L
    return point + ((r + k * a) % _L).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _unpack(public), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= _L:
        return False
    k = int.from_bytes(hashlib.sha512(signature[:32] + public + message).digest(), "little") % _L
    x, y = _times(s, _G), _add(r, _times(k, a))
    return (x[0] * y[2] - y[0] * x[2]) % _P == 0 and (x[1] * y[2] - y[1] * x[2]) % _P == 0


@F.pandas_udf(T.BooleanType())
def signature_ok(public: pd.Series, message: pd.Series, signature: pd.Series) -> pd.Series:
    return pd.Series([None not in (p, m, s) and verify(bytes(p), bytes(m), bytes(s)) for p, m, s in zip(public, message, signature, strict=True)])


def compression(column: Column, codec: str) -> Column:
    """Compressed size of each value, for ratios."""

    @F.pandas_udf(T.LongType())
    def size(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else len(_compress(bytes(x), codec, None)))

    return size(column)
