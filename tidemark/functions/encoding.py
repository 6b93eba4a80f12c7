"""Binary encodings as column expressions: fixed-width big- and little-endian words, packed keys, UUIDs of version 7."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def be(c: Column, width: int) -> Column:
    """A non-negative integer, or a negative one's two's complement, as big-endian bytes."""
    return F.unhex(F.right(F.lpad(F.hex(c.cast("bigint")), F.lit(16), F.lit("0")), F.lit(2 * width)))


def be64(c: Column) -> Column:
    return be(c, 8)


def le64(c: Column) -> Column:
    """Little-endian bytes: the big-endian pairs of digits in reverse."""
    digits = F.lpad(F.hex(c.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(8))))


def from_be(b: Column, at: int, width: int) -> Column:
    """The unsigned integer in `width` (under eight) bytes from position `at` (from 1); eight bytes wrap to a signed one."""
    digits = F.hex(F.substring(b, at, width))
    if width < 8:
        return F.conv(digits, 16, 10).cast("bigint")
    high, low = F.conv(F.substring(digits, 1, 8), 16, 10).cast("bigint"), F.conv(F.substring(digits, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


def pack_key(user: Column, asset: Column) -> Column:
    """One 64-bit key of two 32-bit ones."""
    return F.shiftleft(user.cast("bigint"), 32).bitwiseOR(asset.cast("bigint"))


def uuid7(ms: Column, seed: Column) -> Column:
    """Sixteen bytes: a millisecond time, version 7, variant 2, the rest from a hash of the seed."""
    h = F.sha2(seed.cast("string"), 256)
    return F.unhex(F.concat(F.right(F.lpad(F.hex(ms.cast("bigint")), F.lit(12), F.lit("0")), F.lit(12)), F.lit("7"), F.substring(h, 1, 3), F.lit("8"), F.substring(h, 5, 15)))


def uuid7_ms(b: Column) -> Column:
    return from_be(b, 1, 6)


def uuid7_valid(b: Column, now_ms: Column, skew_ms: int = 60_000) -> Column:
    """Sixteen bytes of version 7 and variant 2 whose time is within `skew_ms` of now."""
    digits = F.hex(b)
    right = (F.length(b) == 16) & (F.substring(digits, 13, 1) == "7") & F.substring(digits, 17, 1).isin("8", "9", "A", "B")
    return F.coalesce(right & (F.abs(uuid7_ms(b) - now_ms) <= skew_ms), F.lit(False))


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0).cast("bigint"))


def saturating_add(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(a, b), F.lit(9223372036854775807))


def epoch_micros(ts: Column) -> Column:
    """Microseconds from 1970 to a timestamp without time zone, whatever the session's zone."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))
