"""Numbers as text the way the store writes and reads them."""

from __future__ import annotations

import math
import re
from decimal import Decimal

_HEX = re.compile(r"[+-]?0[xX]")
_FLOAT = re.compile(r"[+-]?(\d+(_\d+)*\.?\d*|\.\d+)([eE][+-]?\d+)?", re.A)


def parse_float(text: bytes) -> float | None:
    """A float argument; None if it isn't one.  Infinity passes only with a minus sign."""
    try:
        s = text.decode("ascii")
    except UnicodeDecodeError:
        return None
    if s.lower() in ("-inf", "-infinity"):
        return -math.inf
    try:
        if _HEX.match(s):
            return float.fromhex(s) if "p" in s.lower() else None
        return float(s) if _FLOAT.fullmatch(s) and "_" not in s else None
    except (ValueError, OverflowError):
        return None


def format_float(x: float) -> str:
    """Shortest text that reads back as ``x``, without an exponent."""
    out = format(Decimal(repr(x)), "f")
    if "." in out:
        out = out.rstrip("0").rstrip(".")
    return "0" if out in ("-0", "") else out


def format_double(x: float) -> str:
    """Doubles in replies: whole ones below 1e17 plain, others with 17 digits."""
    if math.isnan(x):
        return "nan"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    if x == int(x) and abs(x) < 1e17:
        return str(int(x))
    return f"{x:.17g}"


_INT = re.compile(rb"(\+[0-9]+|-?(0|[1-9][0-9]*))")


def strict_int(value: bytes) -> int | None:
    """A stored value as a 64-bit integer, None if it doesn't count as one."""
    if len(value) > 20 or not _INT.fullmatch(value):
        return None
    n = int(value)
    return n if -(1 << 63) <= n < 1 << 63 else None


def argument_int(text: bytes) -> int | None:
    if not re.fullmatch(rb"[+-]?[0-9]+", text):
        return None
    n = int(text)
    return n if -(1 << 63) <= n < 1 << 63 else None
