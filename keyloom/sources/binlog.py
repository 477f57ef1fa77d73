"""Binary log segments as a relation of log records, and back.

A segment is a header and records; each has its checksum, length, kind and LSN before its
payload.  LSNs rise by one across segments.  A record that is cut short or damaged ends
the log if it lies in the last segment, and is an error in any other.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.coding import crc32c, read_bytes, read_signed, read_unsigned, write_bytes, write_signed, write_unsigned

#: The format.
MAGIC = b"RFSWAL\x01\x00"
HEADER = "<QQ"  # first LSN, time of creation in milliseconds; magic before, checksum behind
RECORD = "<IBQ"  # length of the payload, kind, LSN; checksum before
PUT, DELETE, FLUSHALL, BATCH = 1, 2, 3, 4
MAX_RECORD = 1 << 30
_START, _HEAD = len(MAGIC) + struct.calcsize(HEADER) + 4, 4 + struct.calcsize(RECORD)
_ROW = "path string, first bigint, nth bigint, lsn bigint, pos int, op string, key binary, value binary, expire_at bigint, damage string, at bigint"


def _mutation(kind: int, data: bytes, at: int):
    """((op, key, value, expire_at), place behind it) of a put or delete."""
    key, at = read_bytes(data, at)
    if kind == DELETE:
        return ("delete", key, None, None), at
    if kind != PUT:
        raise ValueError(f"bad kind {kind} of a mutation")
    expire_at, at = read_signed(data, at)
    value, at = read_bytes(data, at)
    return ("put", key, value, expire_at), at


def _payload(kind: int, data: bytes) -> list[tuple]:
    if kind == FLUSHALL:
        return [("flushall", None, None, None)]
    found, at = [], 0
    if kind == BATCH:
        n, at = read_unsigned(data)
        for _ in range(n):
            if at >= len(data):
                raise ValueError("batch cut short")
            one, at = _mutation(data[at], data, at + 1)
            found.append(one)
    else:
        one, at = _mutation(kind, data, 0)
        found.append(one)
    if at != len(data):
        raise ValueError(f"{len(data) - at} trailing bytes")
    return found


def records(data: bytes):
    """Yields (lsn, place, mutations) of a segment's records, then (None, place, damage or None).

    A segment without a right header, and a record with a right checksum that cannot be
    read, are ValueErrors: no interrupted write leaves them.
    """
    if len(data) < _START or not data.startswith(MAGIC):
        raise ValueError("bad magic")
    if crc32c(data[: _START - 4]) != int.from_bytes(data[_START - 4 : _START], "little"):
        raise ValueError("bad checksum of the header")
    at, expected = _START, 0
    while at < len(data):
        if len(data) - at < _HEAD:
            return (yield None, at, "short record header")
        size, kind, lsn = struct.unpack_from(RECORD, data, at + 4)
        end = at + _HEAD + size
        if size > MAX_RECORD:
            return (yield None, at, f"record length {size} exceeds maximum")
        if end > len(data):
            return (yield None, at, "short record payload")
        if crc32c(data[at + 4 : end]) != int.from_bytes(data[at : at + 4], "little"):
            return (yield None, at, "wrong checksum")
        if expected and lsn != expected:
            return (yield None, at, f"LSN {lsn} out of order, expected {expected}")
        yield lsn, at, _payload(kind, data[at + _HEAD : end])
        at, expected = end, lsn + 1
    yield None, at, None


def read(spark: SparkSession, folder: str, after: int = 0) -> DataFrame:
    """lsn, pos, op, key, value, expire_at of the log in ``folder`` behind ``after``.

    Segments are read in parallel.  Raises if a segment other than the last is damaged or
    if LSNs do not go on from one segment to the next; a torn tail of the last is left out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").load(folder).select("path", "content")

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                content, out, n = bytes(content), [], 0
                first = struct.unpack_from(HEADER, content, len(MAGIC))[0] if len(content) >= _START else 0
                for lsn, at, found in records(content):
                    if lsn is None:
                        out.append((path, first, n, None, None, None, None, None, None, found, at))
                        continue
                    out += [(path, first, n, lsn, pos, *m, None, at) for pos, m in enumerate(found) if lsn > after]
                    n += 1
                    if len(out) > 10_000:
                        yield _frame(out)
                        out = []
                yield _frame(out)

    rows = files.mapInPandas(run, _ROW)
    ends = rows.where("lsn IS NULL").select("path", "first", "nth", "damage", "at")
    order = Window.orderBy("first", "path")  # a row for each segment
    checked = ends.select("*", F.lead("first").over(order).alias("next"))
    wrong = checked.where("next IS NOT NULL AND (damage IS NOT NULL OR first + nth <> next)").orderBy("first").first()
    if wrong is not None:
        raise ValueError(f"{wrong['path']} at offset {wrong['at']}: {wrong['damage'] or 'the next segment does not go on from it'}")
    return rows.where("lsn IS NOT NULL").select("lsn", "pos", "op", "key", "value", "expire_at")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [part.split()[0] for part in _ROW.split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    for c in ("lsn", "pos", "expire_at"):
        frame[c] = frame[c].astype("Int64")
    return frame


def _one(op: str, key, value, expire_at) -> tuple[int, bytes]:
    if op == "put":
        return PUT, write_bytes(key) + write_signed(expire_at or 0) + write_bytes(value)
    return DELETE, write_bytes(key)


def record(lsn: int, mutations: list[tuple]) -> bytes:
    """A framed record of (op, key, value, expire_at); several become a batch."""
    if mutations[0][0] == "flushall":
        kind, payload = FLUSHALL, b""
    elif len(mutations) == 1:
        kind, payload = _one(*mutations[0])
    else:
        kind, payload = BATCH, write_unsigned(len(mutations)) + b"".join(bytes([k]) + p for k, p in (_one(*m) for m in mutations))
    body = struct.pack(RECORD, len(payload), kind, lsn) + payload
    return crc32c(body).to_bytes(4, "little") + body


def segment(first: int, created_ms: int, rows: list[tuple[int, list[tuple]]]) -> bytes:
    """A whole segment of (lsn, mutations)."""
    head = MAGIC + struct.pack(HEADER, first, created_ms)
    return head + crc32c(head).to_bytes(4, "little") + b"".join(record(lsn, m) for lsn, m in rows)


def encode(log: DataFrame, of: int = 100_000, created_ms: int = 0) -> DataFrame:
    """first, data: segments of ``of`` LSNs each; an LSN's mutations stay together."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lsn", "pos"], kind="stable")
        rows = []
        for lsn, part in pdf.groupby("lsn", sort=True):
            muts = [
                (r.op, None if r.key is None else bytes(r.key), None if r.value is None else bytes(r.value), 0 if pd.isna(r.expire_at) else int(r.expire_at))
                for r in part.itertuples(index=False)
            ]
            rows.append((int(lsn), muts))
        return pd.DataFrame({"first": [rows[0][0]], "data": [segment(rows[0][0], created_ms, rows)]})

    cut = log.select("lsn", "pos", "op", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "expire_at")
    return cut.groupBy(F.expr(f"(lsn - 1) div {of}").alias("cut")).applyInPandas(run, "first bigint, data binary")
