"""Token ids in binary shards with Elias-Fano document boundaries.

A shard is one binary block: a header, the document ids, the document boundaries and
the concatenated token ids of all its documents, in ascending doc_id order.

    magic "KTS2" | id width in bytes (2 or 4) | documents | of these without doc_id
    | ids | least doc_id | doc_ids | boundaries | ids

Doc_ids (less the least) and boundaries, the number of ids up to the end of document i,
are Elias-Fano sequences: a value is split into l low bits and a high part written in
unary, where bit (high_i + i) of a bit vector is set.  That takes about 2 + log2(u / n)
bits a value.  ``select`` finds set bit i from the nearest sample by counting bits in
bytes, so any offset is read without a 64-bit table.

Shards are rows of a Parquet table in the shared folder: executors write and read it
through Spark, so it may lie in any store that Spark can reach.

Texts are cut into pre-tokens as arrays of bytes.  A worker keeps the ids of pre-tokens
seen before, under two independent 64-bit hashes; new ones go through the library's model.
What the byte arrays can't tell for sure goes through the whole library: texts with
characters whose class has changed since Unicode 3.2 or that lie beyond the basic plane,
and texts that spell one of the tokenizer's added tokens.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops
from .common import materialise, shared_dir

MAGIC, SAMPLE = b"KTS2", 256
_HEAD = struct.Struct("<4sBxxxqqqq")
_SIZES = struct.Struct("<qBxxxxxxxqqq")
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.int64)
#: Pre-tokens, and their ids, that a Python worker keeps.
CACHE_TOKENS, CACHE_IDS = 1_500_000, 1 << 23
#: Text of a part, and parts of a table, of which the driver holds a total each.
PART_BYTES, MAX_PARTS = 16 << 20, 1 << 20


# ---------------------------------------------------------------- Elias-Fano


class EliasFano:
    """A non-decreasing sequence of n integers up to u."""

    def __init__(self, n: int, u: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.u, self.low_bits = n, u, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, np.uint32)

    @classmethod
    def encode(cls, values: np.ndarray, u: int) -> EliasFano:
        n = len(values)
        l = max(0, (int(u) // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        bits = ((v[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        at = (v >> np.uint64(l)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(at[-1]) + 1 if n else 0), dtype=np.uint8)
        high[at] = 1
        packed = lambda b: np.packbits(b.reshape(-1), bitorder="little").tobytes()
        return cls(n, u, l, packed(bits), packed(high), at[::SAMPLE].astype(np.uint32).tobytes())

    def select(self, i: int) -> int:
        """Position of set bit i of the high vector."""
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        if not left:
            return at
        first = int(self.high[byte]) >> (at % 8 + 1) << (at % 8 + 1)
        if _ONES[first] < left:
            left -= int(_ONES[first])
            step = np.cumsum(_ONES[self.high[byte + 1 : byte + 1 + 64]])
            while step[-1] < left:
                left -= int(step[-1])
                byte += 64
                step = np.cumsum(_ONES[self.high[byte + 1 : byte + 1 + 64]])
            k = int(np.searchsorted(step, left))
            left -= int(step[k - 1]) if k else 0
            byte += 1 + k
            first = int(self.high[byte])
        for bit in range(8):
            left -= first >> bit & 1
            if not left:
                return byte * 8 + bit
        raise IndexError(i)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        low, l = 0, self.low_bits
        for b in range(l):
            p = i * l + b
            low |= (int(self.low[p // 8]) >> (p % 8) & 1) << b
        return (self.select(i) - i) << l | low

    def packed(self) -> bytes:
        parts = self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()
        return _SIZES.pack(self.n, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def unpack(cls, data: bytes, at: int, u: int) -> tuple[EliasFano, int]:
        """The sequence packed at ``at``, and where it ends."""
        n, low_bits, *sizes = _SIZES.unpack_from(data, at)
        at, parts = at + _SIZES.size, []
        for size in sizes:
            parts.append(data[at : at + size])
            at += size
        return cls(n, u, low_bits, *parts), at


# -------------------------------------------------------------------- shards


def pack(doc_ids: list, ids: list[bytes], width: int) -> bytes:
    """A shard from the documents' ids, each as little-endian numbers of ``width`` bytes.

    ``doc_ids`` ascend, with those that are None before the others.
    """
    ends = np.cumsum([len(x) // width for x in ids], dtype=np.int64)
    u = int(ends[-1]) if len(ends) else 0
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    spread = np.array([d - least for d in known], dtype=np.uint64)
    names = EliasFano.encode(spread, int(spread[-1]) if len(spread) else 0)
    head = _HEAD.pack(MAGIC, width, len(ids), len(doc_ids) - len(known), u, least)
    return b"".join([head, names.packed(), EliasFano.encode(ends, u).packed(), *ids])


class Shard:
    """Reads a packed shard."""

    def __init__(self, data: bytes):
        magic, self.width, self.n, self.nameless, u, self.least = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.names, at = EliasFano.unpack(data, _HEAD.size, 0)
        self.ends, at = EliasFano.unpack(data, at, u)
        self.ids = np.frombuffer(data, dtype=np.uint16 if self.width == 2 else np.uint32, count=u, offset=at)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nameless else self.least + self.names[i - self.nameless]

    def begin(self, i: int) -> int:
        return self.ends[i - 1] if i else 0

    def document(self, i: int) -> np.ndarray:
        """The ids of document i, located by select."""
        return self.ids[self.begin(i) : self.ends[i]]


# ---------------------------------------------------------------- tokenising


#: White space of the byte-level pre-tokenizer, how it names bytes, and the
#: endings that it cuts off.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHORT_ENDINGS, _LONG_ENDINGS = [b"s", b"t", b"m", b"d"], [b"re", b"ve", b"ll"]

_BYTE_NAMES = np.arange(256, dtype="<u4")
_BYTE_NAMES[[b for b in range(256) if b not in _PRINTED]] = 256 + np.arange(256 - len(_PRINTED))
_SPACE, _LETTER, _NUMBER, _OTHER, _UNSURE = range(5)


def _kinds() -> np.ndarray:
    """Class of each character of the basic plane; unsure where Unicode versions may differ."""
    group = lambda c, data: {"L": _LETTER, "N": _NUMBER}.get(data.category(c)[0], _OTHER)
    out = np.full(1 << 16, _UNSURE, dtype=np.uint8)
    for k in range(1 << 16):
        c = chr(k)
        old = unicodedata.ucd_3_2_0.category(c)
        if old != "Cn" and (old == "Zs") == (unicodedata.category(c) == "Zs"):
            now = group(c, unicodedata)
            out[k] = now if now == group(c, unicodedata.ucd_3_2_0) else _UNSURE
    out[_WHITE] = _SPACE
    return out


_tables: dict = {}


def cut(at: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of every pre-token's first byte, places of unsure characters) of texts cut at ``at``.

    A pre-token is a run of letters, of numbers or of other characters, with a blank
    before it; or a run of white space, which leaves its last character to what follows;
    or an apostrophe and an ending, where a pre-token begins at the apostrophe.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if not _tables:
        _tables["all"] = _kinds()
        _tables["byte"] = np.r_[_tables["all"][:128], np.full(128, _UNSURE, np.uint8)]
    kind = _tables["byte"][text]
    lead = np.flatnonzero(text >= 0xC0)
    if len(lead):
        head = text[lead].astype(np.int32)
        one, two = (text[np.minimum(lead + k, n - 1)].astype(np.int32) & 63 for k in (1, 2))
        point = np.where(head < 0xE0, (head & 31) << 6 | one, (head & 15) << 12 | one << 6 | two)
        kind[lead] = np.where(head < 0xF0, _tables["all"][point & 0xFFFF], _UNSURE)
        for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            some = lead[head >= least]
            kind[some + k] = kind[some]
    first = np.zeros(n, dtype=bool)
    first[at[at < n]] = True
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(start[1:] & ~first[1:] & (kind[1:] != _SPACE) & (kind[:-1] == _SPACE)) + 1
    last = after - 1
    for _ in range(2):
        last = last - (text[last] & 0xC0 == 0x80)
    start[last] = True
    start[after[text[last] == 0x20]] = False
    sign = np.flatnonzero((text[:-1] == 0x27) & start[:-1] & ~first[1:])
    one = text[sign + 1]
    short = np.isin(one, np.frombuffer(b"".join(_SHORT_ENDINGS), np.uint8))
    beyond = np.minimum(sign + 2, n - 1)
    pair = one.astype(np.int32) << 8 | text[beyond]
    long_ = (sign + 2 < n) & ~first[beyond] & np.isin(pair, [e[0] << 8 | e[1] for e in _LONG_ENDINGS])
    for some, size in ((sign[short], 2), (sign[long_], 3)):
        start[some + 1] = False
        end = some + size
        start[end[end < n]] = True
    return np.flatnonzero(start), np.flatnonzero(kind == _UNSURE)


class Encoder:
    """A tokenizer of the library, with the ids of pre-tokens seen before."""

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), np.uint16 if width == 2 else np.uint32
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.byte_level = (
            spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        )
        self._forget()

    def _forget(self) -> None:
        self.keys, self.checks = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.begin, self.size, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.kind)

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype=self.kind)

    def texts(self, at: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of those laid end to end and cut at ``at``."""
        data = text.tobytes()
        if not self.byte_level:
            return [self._whole(data[a:e]) for a, e in zip(at[:-1], at[1:])]
        start, unsure = cut(at, text)
        odd = set(np.unique(np.searchsorted(at, unsure, side="right") - 1).tolist())
        for name in self.added:
            k = data.find(name)
            while k >= 0:
                odd.add(int(np.searchsorted(at, k, side="right")) - 1)
                k = data.find(name, k + 1)
        number = self._numbers(start, np.append(start[1:], len(text)), text)
        if number is None:  # two different pre-tokens under one hash
            return [self._whole(data[a:e]) for a, e in zip(at[:-1], at[1:])]
        size = self.size[number]
        upto = np.cumsum(size)
        place = np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.begin[number] - (upto - size), size)
        ids = self.ids[place]
        edge = np.concatenate([[0], upto])[np.searchsorted(start, at)]
        return [self._whole(data[at[d] : at[d + 1]]) if d in odd else ids[edge[d] : edge[d + 1]] for d in range(len(at) - 1)]

    def _numbers(self, start, end, text: np.ndarray) -> np.ndarray | None:
        """Which of the kept pre-tokens each one is; new ones are learned first."""
        if len(self.keys) > CACHE_TOKENS or len(self.ids) > CACHE_IDS:
            self._forget()
        key, check = (textops.range_hash(textops.prefix_hash(text, which), start, end) for which in (0, 1))
        unique, one, back = np.unique(key, return_index=True, return_inverse=True)
        check_of = check[one]
        if (check_of[back] != check).any():
            return None
        where = np.searchsorted(self.keys, unique)
        known = where < len(self.keys)
        known[known] = self.keys[where[known]] == unique[known]
        if (self.checks[where[known]] != check_of[known]).any():
            return None
        new = np.flatnonzero(~known)
        if len(new):
            names, model = _BYTE_NAMES[text].tobytes().decode("utf-32-le"), self.tokenizer.model
            found = [[t.id for t in model.tokenize(names[a:e])] for a, e in zip(start[one[new]].tolist(), end[one[new]].tolist())]
            size = np.fromiter(map(len, found), np.int64, len(found))
            begin = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), self.kind)])
            at = where[new]
            self.keys, self.checks = np.insert(self.keys, at, unique[new]), np.insert(self.checks, at, check_of[new])
            self.begin, self.size = np.insert(self.begin, at, begin), np.insert(self.size, at, size)
            where = np.searchsorted(self.keys, unique)
        return where[back]


_encoders: dict = {}


def _pieces(text: np.ndarray, limit: int = textops.CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Stretches of a long text, cut before a blank between two characters that aren't white space."""
    first, n = 0, len(text)
    ascii_ = _tables.setdefault("solid", np.array([33 <= b < 127 for b in range(256)]))
    while n - first > 2 * limit:
        part = text[first + limit - 1 : first + 2 * limit]
        good = np.flatnonzero((part[1:-1] == 0x20) & ascii_[part[:-2]] & ascii_[part[2:]])
        if not len(good):
            break
        end = first + limit + int(good[0])
        yield first, end
        first = end
    yield first, n


def encode(column: pa.Array, path: str, width: int, end_id: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from, to, ids of each text and end_id after them, packed) for ranges of a column."""
    encoder = _encoders.get((path, width))
    if encoder is None:
        encoder = _encoders[path, width] = Encoder(path, width)
    end = np.array([end_id], dtype=encoder.kind).tobytes()
    offsets, text = textops.buffers(column)
    for i, j in textops.chunks(offsets):
        at, part = offsets[i : j + 1] - offsets[i], text[offsets[i] : offsets[j]]
        if j == i + 1 and len(part) > 2 * textops.CHUNK_BYTES:
            yield i, j, [b"".join(encoder.texts(np.array([0, b - a]), part[a:b])[0].tobytes() for a, b in _pieces(part)) + end]
        else:
            yield i, j, [ids.tobytes() + end for ids in encoder.texts(at, part)]


# --------------------------------------------------------------------- Spark


def write_shards(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    end_id: int = 2,
    width: int = 2,
    part_bytes: int = PART_BYTES,
    shard_bytes: int = 8 << 20,
) -> DataFrame:
    """Tokenise and write the shards; the table: part, before, n_ids, data.

    Parts are ranges of doc_id, numbered in order, as many as the texts make up
    ``part_bytes`` (MAX_PARTS at most), and a task each; a part's documents are packed
    into blocks of about ``shard_bytes``.  ``before`` counts the ids of the part's
    earlier blocks.  Rows that repeat a doc_id are ranged by their text's hash, so that
    one id with a third of all rows is spread too.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MAX_PARTS, total // part_bytes + 1)
    order = [F.asc_nulls_first("doc_id"), F.asc("hash"), F.asc("row")]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def shards(batches):
        part, before, doc_ids, ids, size = 0, 0, [], [], 0

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (part, before, size // width)]
                + [pa.array([pack(doc_ids, ids, width)], pa.binary())],
                ["part", "before", "n_ids", "data"],
            )

        for b in batches:
            names, numbers = b.column("doc_id").to_pylist(), b.column("part").to_pylist()
            for i, j, packed in encode(b.column("text"), tokenizer, width, end_id):
                for k, x in zip(range(i, j), packed):
                    if ids and (numbers[k] != part or size + len(x) > shard_bytes):
                        yield done()
                        before = before + size // width if numbers[k] == part else 0
                        doc_ids, ids, size = [], [], 0
                    part = numbers[k]
                    doc_ids.append(names[k])
                    ids.append(x)
                    size += len(x)
        if ids:
            yield done()

    return materialise(spark, ranged.mapInArrow(shards, "part long, before long, n_ids long, data binary"), folder, "shards")


def read_shards(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards.

    ``start`` counts the ids of all documents before it.  Only the parts' totals, at
    most MAX_PARTS numbers, are summed in order on the driver.
    """
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    base = np.concatenate([[0], np.cumsum([r.n for r in totals], dtype=np.int64)])
    starts = spark.createDataFrame([(r.part, int(b)) for r, b in zip(totals, base)], "part long, base long")

    def documents(batches):
        for b in batches:
            for data, before in zip(b.column("data"), b.column("base").to_pylist()):
                shard, rows = Shard(data.as_py()), []
                for i in range(shard.n):
                    ids = shard.document(i)
                    rows.append((shard.doc_id(i), before + shard.begin(i), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                columns = zip([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                yield pa.RecordBatch.from_pydict({name: c for c, name in columns})

    located = shards.join(F.broadcast(starts), "part").select("data", (F.col("base") + F.col("before")).alias("base"))
    return located.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(spark: SparkSession, docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write ``docs`` as shards, read them back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id alone.  Null doc_ids come first; rows that
    repeat a doc_id follow each other in the order of their texts' hashes (xxhash64).  An
    empty table gives no shards and no rows.  Further columns are ignored.
    """
    return read_shards(spark, write_shards(spark, docs, tokenizer, shared_dir(spark), **options))
