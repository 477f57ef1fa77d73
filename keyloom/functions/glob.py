"""Glob patterns over bytes as Java regular expressions.

Keys are read as ISO-8859-1, so that a character is a byte.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tokens(pattern: bytes):
    """Yields ("any",), ("one",), ("set", members, negated) and ("byte", b)."""
    at, n = 0, len(pattern)
    while at < n:
        c = pattern[at : at + 1]
        at += 1
        if c == b"*":
            yield ("any",)
        elif c == b"?":
            yield ("one",)
        elif c == b"[":
            negated = pattern[at : at + 1] == b"^"
            at += negated
            members: set[int] = set()
            while at < n and pattern[at : at + 1] != b"]":
                if pattern[at : at + 1] == b"\\" and at + 1 < n:
                    members.add(pattern[at + 1])
                    at += 2
                elif pattern[at + 1 : at + 2] == b"-" and at + 2 < n:
                    low, high = sorted((pattern[at], pattern[at + 2]))
                    members.update(range(low, high + 1))
                    at += 3
                else:
                    members.add(pattern[at])
                    at += 1
            at += 1
            yield ("set", members, negated)
        elif c == b"\\" and at < n:
            yield ("byte", pattern[at])
            at += 1
        else:
            yield ("byte", c[0])


def to_regex(pattern: bytes, ignore_case: bool = False) -> str:
    """An anchored expression that matches what the glob matches."""

    def folded(members: set[int]) -> set[int]:
        if not ignore_case:
            return members
        return {x for m in members for x in (m, *([m ^ 32] if chr(m).isascii() and chr(m).isalpha() else []))}

    def klass(members: set[int], negated: bool) -> str:
        if not members:
            return r"[\x00-\xFF]" if negated else "(?!)"
        return "[" + "^" * negated + "".join(f"\\x{m:02X}" for m in sorted(members)) + "]"

    out = []
    for kind, *rest in _tokens(pattern):
        if kind == "any":
            if not out or out[-1] != ".*":
                out.append(".*")
        elif kind == "one":
            out.append(".")
        elif kind == "set":
            out.append(klass(folded(rest[0]), rest[1]))
        else:
            both = folded({rest[0]})
            out.append(klass(both, False) if len(both) > 1 else f"\\x{rest[0]:02X}")
    return "(?s)^" + "".join(out) + r"\z"


def is_trivial(pattern: bytes) -> bool:
    """Matches every key."""
    return bool(pattern) and not pattern.strip(b"*")


def matches(key, pattern: bytes, ignore_case: bool = False) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    if is_trivial(pattern):
        return F.lit(True)
    return F.decode(k.cast("binary"), "ISO-8859-1").rlike(to_regex(pattern, ignore_case))
