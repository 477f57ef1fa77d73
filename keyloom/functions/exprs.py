"""Column builders for visibility, expiry arithmetic, integers and byte ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import INT64_MAX, INT64_MIN, RECORD_OVERHEAD


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_live(now, expire_at="expire_at") -> Column:
    """Visible at ``now``: never expires, or expires later; equality is expired."""
    e = _col(expire_at)
    return (e == 0) | (e > now)


def sat_add(now, delta) -> Column:
    """Sum of two 64-bit numbers, held at the bounds."""
    d = _col(delta)
    return F.coalesce(F.try_add(_col(now), d), F.when(d > 0, F.lit(INT64_MAX)).otherwise(F.lit(INT64_MIN)))


def strict_int(text) -> Column:
    """The value as a 64-bit integer, null where the store doesn't count it as one."""
    t = _col(text)
    return F.when(t.rlike(r"^(\+[0-9]+|-?(0|[1-9][0-9]*))$") & (F.octet_length(t) <= 20), t.try_cast("bigint"))


def argument_int(text) -> Column:
    """A command argument as a 64-bit integer; leading zeros pass, spaces don't."""
    t = _col(text)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))


def ttl(now, unit: int = 1, expire_at="expire_at") -> Column:
    """-1 without expiry, else what is left in units of ``unit`` ms, rounded up."""
    e = _col(expire_at)
    left = e - now
    return F.when(e == 0, F.lit(-1)).otherwise(F.floor((left + (unit - 1)) / unit) if unit > 1 else left).cast("bigint")


def get_range(value, start: int, end: int) -> Column:
    """Bytes start..end, both included, negative ones from the end; clamped to the value."""
    v = _col(value)
    n = F.octet_length(v)
    lo = F.greatest(F.lit(start) if start >= 0 else n + start, F.lit(0))
    hi = F.least(F.greatest(F.lit(end) if end >= 0 else n + end, F.lit(0)), n - 1)
    backwards = (start < 0) & (end < 0) & (start > end)
    return F.when(F.lit(backwards) | (lo > hi), F.lit(b"")).otherwise(F.substring(v, lo + 1, hi - lo + 1))


def set_range(value, offset: int, patch: bytes) -> Column:
    """The value with ``patch`` written at ``offset``, zeros filling any gap."""
    v = F.coalesce(_col(value), F.lit(b""))
    if not patch:
        return v
    padded = F.rpad(v, F.greatest(F.octet_length(v), F.lit(offset)), F.lit(b"\0"))
    return F.overlay(padded, F.lit(patch), F.lit(offset + 1))


def memory_usage(key="key", value="value") -> Column:
    return (F.octet_length(_col(key)) + F.octet_length(_col(value)) + RECORD_OVERHEAD).cast("bigint")


def histogram_bucket(v) -> Column:
    """Index of the log-linear bucket: exact below 256, then 128 steps an octave."""
    x = _col(v)
    msb = F.length(F.bin(x)) - 1
    sub = F.call_function("shiftright", x.cast("bigint"), msb - 7)
    return F.when(x < 256, x).otherwise(256 + (msb - 8) * 128 + sub.bitwiseAND(127)).cast("bigint")


def bucket_floor(index) -> Column:
    """Smallest value of a bucket."""
    i = _col(index)
    shift = F.call_function("shiftright", i - 256, F.lit(7)).cast("int") + 1
    return F.when(i < 256, i).otherwise(F.call_function("shiftleft", (128 + (i - 256) % 128).cast("bigint"), shift)).cast("bigint")
