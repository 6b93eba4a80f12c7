"""A registry of digests and row encoders by name, and the table function that opens blocks.

Digests of the JVM are column expressions. `blake3` is there only where a library for it can be imported; `blake2b` always is. Both
work on Arrow batches. More can be registered.
"""

from __future__ import annotations

import hashlib
import importlib.util
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.codec import decode_block
from tidemark.functions.encoding import be64


@F.pandas_udf(T.StringType())
def _blake2b(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else hashlib.blake2b(x, digest_size=32).hexdigest())


@F.pandas_udf(T.StringType())
def _blake3(b: pd.Series) -> pd.Series:
    from blake3 import blake3

    return b.map(lambda x: None if x is None else blake3(x).hexdigest())


DIGESTS: dict[str, Callable[[Column], Column]] = {
    "sha256": lambda c: F.sha2(c, 256),
    "sha512": lambda c: F.sha2(c, 512),
    "sha1": F.sha1,
    "md5": F.md5,
    "blake2b": lambda c: _blake2b(c),
}
if importlib.util.find_spec("blake3"):
    DIGESTS["blake3"] = lambda c: _blake3(c)

ENCODERS: dict[str, Callable[..., Column]] = {
    "be64": lambda *fields: F.concat(*(be64(f) for f in fields)),
    "text": lambda *fields: F.concat_ws("|", *(f.cast("string") for f in fields)).cast("binary"),
}


def register_digest(name: str, digest: Callable[[Column], Column]) -> None:
    """digest: from a binary column to hexadecimal digits."""
    DIGESTS[name] = digest


def register_encoder(name: str, encoder: Callable[..., Column]) -> None:
    """encoder: from a row's columns to one binary column."""
    ENCODERS[name] = encoder


def digest_of(*fields: Column, digest: str = "sha256", encoder: str = "be64") -> Column:
    """The digest of a row's fields by the names of its digest and its encoder."""
    if digest not in DIGESTS:
        raise KeyError(f"no digest {digest}; there are {', '.join(sorted(DIGESTS))}")
    if encoder not in ENCODERS:
        raise KeyError(f"no encoder {encoder}; there are {', '.join(sorted(ENCODERS))}")
    return DIGESTS[digest](ENCODERS[encoder](*fields))


@F.udtf(returnType="pos int, sig binary, body binary, error string")
class OpenBlock:
    """The transactions of a block, one row each; one row with the error of a block that is broken."""

    def eval(self, data: bytes) -> Iterator[tuple]:
        if data is None:
            return
        try:
            rows = decode_block(bytes(data))
        except Exception as e:  # noqa: BLE001  whatever the codecs raise
            yield None, None, None, str(e)
            return
        for i, (sig, body) in enumerate(rows):
            yield i, sig, body, None


def register(spark: SparkSession) -> None:
    """Names for SQL: open_block(data)."""
    spark.udtf.register("open_block", OpenBlock)
