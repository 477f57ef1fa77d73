"""Variable-length numbers and the Castagnoli checksum, as binary logs use them."""

from __future__ import annotations

#: Fixed value: the Castagnoli polynomial, lowest bit first.
CASTAGNOLI = 0x82F63B78


def _table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (CASTAGNOLI if c & 1 else 0)
        out.append(c)
    return out


_TABLE = _table()


def crc32c(data: bytes, before: int = 0) -> int:
    """Checksum of ``data`` behind bytes whose checksum is ``before``."""
    c = before ^ 0xFFFFFFFF
    for b in data:
        c = _TABLE[(c ^ b) & 255] ^ c >> 8
    return c ^ 0xFFFFFFFF


def write_unsigned(n: int) -> bytes:
    """Seven bits a byte, the lowest first; all but the last have the high bit."""
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_unsigned(data: bytes, at: int = 0) -> tuple[int, int]:
    """(number, place behind it); ValueError if it is cut short or over 64 bits."""
    n = 0
    for k in range(10):
        if at + k >= len(data):
            break
        b = data[at + k]
        n |= (b & 127) << 7 * k
        if b < 128:
            if n >> 64:
                break
            return n, at + k + 1
    raise ValueError("bad variable-length number")


def write_signed(n: int) -> bytes:
    """Signs alternate: 0, -1, 1, -2, ... are 0, 1, 2, 3, ..."""
    return write_unsigned(n << 1 if n >= 0 else ~(n << 1))


def read_signed(data: bytes, at: int = 0) -> tuple[int, int]:
    n, at = read_unsigned(data, at)
    return (n >> 1) ^ -(n & 1), at


def write_bytes(data: bytes) -> bytes:
    return write_unsigned(len(data)) + data


def read_bytes(data: bytes, at: int = 0) -> tuple[bytes, int]:
    n, at = read_unsigned(data, at)
    if n > len(data) - at:
        raise ValueError(f"length {n} exceeds {len(data) - at} remaining")
    return data[at : at + n], at + n
