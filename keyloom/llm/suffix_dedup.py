"""Suffix dedup: remove every byte covered by a string that an earlier document holds too.

Strings of ``length`` bytes are compared through sorted suffixes.  Sorting every suffix
would move the corpus many times over, so the suffix array is sparse: of the places in a
window of ``length`` bytes, the one whose GRAM bytes hash lowest is its anchor, and equal
windows have equal anchors at equal offsets.  Suffixes start at anchors.  A first
exchange of anchor hashes finds those that occur in two documents; only they go on.

Every map task sorts its suffixes, each with the bytes left of it behind its own, keeps
one of equal ones and sends the run front-coded: of each suffix only what differs from
the one before.  Runs of a slice are merged by a loser tree that knows the length of the
common prefix of each candidate with the last suffix put out.  Candidates that differ in
it are ordered without looking at a byte, others are compared behind it.

In the merged order, the windows of suffixes that share an anchor are grouped for each
offset, and each learns the smallest document that holds it.  Occurrences join these
answers; a document's spans are united and cut out of its text.  As runs hold a suffix
once a task, a passage that a third of all documents share is no larger than others.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops
from .common import materialise, shared_dir
from .textops import mix64

GRAM = 16
#: Step of a rolling hash modulo 2^64, and the step back.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bits of the filter of shared anchors, at most; beyond, more suffixes than need be are sorted.
MAX_BITS = 1 << 29
#: Spans of documents are sent to all executors up to this size, else joined by shuffle.
BROADCAST_BYTES = 16 << 20
FLUSH = 1 << 20
SLICE_BYTES = 2 << 20
#: Merged suffixes whose windows are grouped at once, about; those of one anchor stay together.
PART_ROWS = 1 << 16


def anchors(part: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, document, hash) of the anchors of all windows inside one document."""
    n, width = len(part), length - GRAM + 1
    empty = np.empty(0, np.int64)
    if n < length:
        return empty, empty, np.empty(0, np.uint64)
    sums = textops.prefix_hash(part)
    places = np.arange(n - GRAM + 1)
    h = textops.range_hash(sums, places, places + GRAM)
    del sums
    low = _sliding(h, width, np.minimum)
    # windows that reach into the next document choose no anchor
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = doc[: len(low)] == doc[length - 1 : length - 1 + len(low)]
    low = np.where(inside, low, 0)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero((h == _sliding(padded, width, np.maximum)[: len(h)]) & (h > 0))
    return chosen, doc[chosen], h[chosen]


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of x[i : i + width] for each i, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = best(x[: len(x) - step], x[step:])
        done += step
    return x


def _documents(batches):
    """(doc_ids, offsets, bytes) of pieces of the batches that fit in memory."""
    for b in batches:
        offsets, text = textops.buffers(b.column("text"))
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        for i, j in textops.chunks(offsets, 1 << 20):
            yield ids[i:j], offsets[i : j + 1] - offsets[i], text[offsets[i] : offsets[j]]


def shared_anchors(docs: DataFrame, length: int, bits: int, buckets: int) -> np.ndarray:
    """Bit field with a bit set for each anchor hash that occurs in two documents."""
    span = bits // buckets  # both are powers of two

    def count(batches):
        held, size = [], 0

        def blocks():
            key, times = np.unique(np.concatenate(held), return_counts=True)
            often = np.minimum(times, 2).astype(np.uint8)
            place = key & np.uint64(bits - 1)
            where = (place // np.uint64(span)).astype(np.int32)
            order = np.argsort(where, kind="stable")
            key, often, where = key[order], often[order], where[order]
            edge = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True])
            rows = [key[a:e].tobytes() + often[a:e].tobytes() for a, e in zip(edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(where[edge[:-1]], pa.int32()), pa.array(rows, pa.binary())], ["bucket", "data"])

        for _, at, part in _documents(batches):
            _, doc, h = anchors(part, at, length)
            if not len(h):
                continue
            order = np.lexsort((h, doc))  # a hash counts once a document
            doc, h = doc[order], h[order]
            held.append(h[np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]])
            size += len(held[-1])
            if size >= FLUSH:
                yield from blocks()
                held, size = [], 0
        if held:
            yield from blocks()

    def mark(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        keys, times = [], []
        for data in table["data"].to_pylist():
            n = len(data) // 9
            keys.append(np.frombuffer(data, np.uint64, n))
            times.append(np.frombuffer(data, np.uint8, n, 8 * n))
        key, times = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(key)
        key, times = key[order], times[order]
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        shared = key[edge][np.add.reduceat(times.astype(np.int64), edge) > 1]
        field = np.zeros(span, dtype=np.uint8)
        field[(shared & np.uint64(bits - 1)) - np.uint64(bucket * span)] = 1
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([np.packbits(field, bitorder="little").tobytes()], pa.binary())})

    found = docs.mapInArrow(count, "bucket int, data binary").groupBy("bucket").applyInArrow(mark, "bucket int, bits binary")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in found.toLocalIterator():
        out[r["bucket"] * span // 8 : (r["bucket"] + 1) * span // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _suffixes(part: np.ndarray, at: np.ndarray, length: int, field: np.ndarray):
    """(document, place, rows, identity) of the suffixes at shared anchors.

    A row has the ``length`` bytes from the anchor on, then those left of it, nearest
    first, padded with zeros at the document's ends, then how many of either there are.
    """
    place, doc, h = anchors(part, at, length)
    bit = h & np.uint64(8 * len(field) - 1)
    keep = (field[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    place, doc = place[keep], doc[keep]
    left = length - GRAM
    right_n = np.minimum(at[doc + 1] - place, length)
    left_n = np.minimum(place - at[doc], left)
    rows = np.zeros((len(place), length + left + 2), dtype=np.uint8)
    for k in range(length):
        rows[:, k] = np.where(k < right_n, part[np.minimum(place + k, len(part) - 1)], 0)
    for k in range(left):
        rows[:, length + k] = np.where(k < left_n, part[np.maximum(place - 1 - k, 0)], 0)
    rows[:, -2], rows[:, -1] = right_n, left_n
    key = np.zeros(len(place), dtype=np.uint64)
    for k in range(0, rows.shape[1], 8):
        word = np.zeros((len(place), 8), dtype=np.uint8)
        word[:, : min(8, rows.shape[1] - k)] = rows[:, k : k + 8]
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) ^ word.view(np.uint64)[:, 0])
    return doc, place, rows, key


def front_code(rows: np.ndarray) -> bytes:
    """Sorted rows as the lengths of common prefixes and the bytes behind them."""
    differs = rows[1:] != rows[:-1]
    common = np.r_[0, np.where(differs.any(1), differs.argmax(1), rows.shape[1])].astype(np.uint8) if len(rows) else np.empty(0, np.uint8)
    rest = rows[np.arange(rows.shape[1]) >= common[:, None]]
    return common.tobytes() + rest.tobytes()


class Run:
    """Reads a front-coded run: ``key`` and ``common``, its common prefix with the one before."""

    __slots__ = ("at", "common", "data", "i", "key", "lengths", "n", "width")

    def __init__(self, data: bytes, n: int, width: int):
        self.lengths, self.data, self.n, self.width = data[:n], data, n, width
        self.at, self.i, self.key = n, -1, b""
        self.advance()

    def advance(self) -> bool:
        self.i += 1
        if self.i >= self.n:
            self.key = None
            return False
        self.common = c = self.lengths[self.i]
        size = self.width - c
        self.key = self.key[:c] + self.data[self.at : self.at + size]
        self.at += size
        return True


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two keys of one size that share ``known`` bytes."""
    x, y = a[known:], b[known:]
    if x == y:
        return len(a)
    differing = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return len(a) - (differing.bit_length() + 7) // 8


def merge(runs: list[Run]):
    """(run number, place in it, common prefix with the key put out before), in key order.

    ``shared[r]`` is the common prefix of run r's next key with the last key put out.  The
    candidate that shares more comes first; at equal shares the bytes behind decide, and
    what they have in common is the loser's share with the winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    shared = [0] * k
    keys = [r.key for r in runs] + [None] * (k - len(runs))
    losers = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two run numbers; sets the loser's share."""
        if keys[a] is None:
            return b, a
        if keys[b] is None:
            return a, b
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y, known = keys[a], keys[b], shared[a]
        c = common_prefix(x, y, known)
        if c == len(x):
            winner, loser = (a, b) if a < b else (b, a)
        else:
            winner, loser = (a, b) if x[c] < y[c] else (b, a)
        shared[loser] = c
        return winner, loser

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while keys[winner] is not None:
        run = runs[winner]
        yield winner, run.i, shared[winner]
        if run.advance():
            keys[winner], shared[winner] = run.key, run.common
        else:
            keys[winner] = None
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def _alike(rows: np.ndarray, ok: np.ndarray, h: np.ndarray, group: np.ndarray, length: int, o: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows ``ok`` with equal windows at offset o side by side, whether each begins a new window).

    Hashes bring windows together, their bytes decide: where two with one hash differ, all
    are sorted by their bytes.
    """
    order = np.argsort(h, kind="stable")
    h, who = h[order], ok[order]
    new = np.r_[True, h[1:] != h[:-1]]
    pair = np.flatnonzero(~new)
    a, b = who[pair - 1], who[pair]
    x, y = rows[a], rows[b]
    differ = (x[:, : length - o] != y[:, : length - o]).any(1) | (x[:, length : length + o] != y[:, length : length + o]).any(1)
    if (differ | (group[a] != group[b])).any():
        window = np.concatenate([rows[ok, : length - o], rows[ok, length : length + o]], axis=1)
        order = np.lexsort((*window.T, group[ok]))
        who, window = ok[order], window[order]
        new = np.r_[True, (window[1:] != window[:-1]).any(1) | (group[who[1:]] != group[who[:-1]])]
    return who, new


def _answers(rows: np.ndarray, first: np.ndarray, last: np.ndarray, group: np.ndarray, length: int):
    """(row, lowest offset, highest offset, smallest document) for windows seen in an earlier one.

    rows: merged suffixes, first and last: smallest and largest document of each, group:
    number of the anchor.  A window at offset o has o bytes left of the anchor and
    length - o from it on.
    """
    left = length - GRAM
    right_n, left_n = rows[:, -2], rows[:, -1]
    # the hash of the bytes from the anchor on loses its last one from offset to offset
    ahead = mix64(group.astype(np.uint64) + np.uint64(1))
    for k in range(length):
        ahead = ahead * _STEP + rows[:, k]
    behind = np.zeros(len(rows), dtype=np.uint64)
    none = np.iinfo(np.int64).max
    since, least = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), none)
    out = []
    for o in range(left + 2):
        smallest = np.full(len(rows), none)
        if 0 < o <= left:
            ahead = (ahead - rows[:, length - o]) * _STEP_BACK
            behind = mix64(behind * _STEP ^ rows[:, length + o - 1] ^ np.uint64(o << 8))
        ok = np.flatnonzero((left_n >= o) & (right_n >= length - o)) if o <= left else np.empty(0, np.int64)
        if len(ok):
            who, new = _alike(rows, ok, mix64(ahead[ok] ^ behind[ok]), group, length, o)
            edge = np.flatnonzero(new)
            smallest[who] = np.repeat(np.minimum.reduceat(first[who], edge), np.diff(np.r_[edge, len(who)]))
        # where the answer changes, the offsets before are one row
        changed = smallest != least
        ended = np.flatnonzero(changed & (least < last))
        out.append(np.stack([ended, since[ended], np.full(len(ended), o - 1), least[ended]], axis=1))
        since[changed], least = o, smallest
    return np.concatenate(out)


def earlier_windows(docs: DataFrame, length: int, field: np.ndarray, buckets: int) -> DataFrame:
    """key, lo, hi, doc: suffixes whose windows at offsets lo..hi stand in a document before others'."""
    width = 2 * length - GRAM + 2

    def run(batches):
        held, size = [], 0

        def runs():
            ids, rows, key = (np.concatenate(c) for c in zip(*held))
            anchor = mix64(np.ascontiguousarray(rows[:, :GRAM]).view(np.uint64) @ np.array([1, 0x9E3779B97F4A7C15], dtype=np.uint64))
            where = (anchor % np.uint64(buckets)).astype(np.int32)
            named = rows.view(f"S{width}")[:, 0]
            order = np.lexsort((named, where))
            ids, rows, key, where = ids[order], rows[order], key[order], where[order]
            new = np.r_[True, (named[order][1:] != named[order][:-1]) | (where[1:] != where[:-1])]
            edge = np.flatnonzero(new)
            low, high = np.minimum.reduceat(ids, edge), np.maximum.reduceat(ids, edge)
            rows, key, where = rows[edge], key[edge], where[edge]
            cut = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True])
            data = [
                key[a:e].tobytes() + low[a:e].tobytes() + high[a:e].tobytes() + front_code(rows[a:e])
                for a, e in zip(cut[:-1], cut[1:])
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(where[cut[:-1]], pa.int32()), pa.array(np.diff(cut), pa.int32()), pa.array(data, pa.binary())],
                ["bucket", "n", "data"],
            )

        for ids, at, part in _documents(batches):
            doc, _, rows, key = _suffixes(part, at, length, field)
            if len(doc):
                held.append((ids[doc], rows, key))
                size += len(doc)
            if size >= FLUSH // 8:
                yield from runs()
                held, size = [], 0
        if size:
            yield from runs()

    def combine(table: pa.Table) -> pa.Table:
        runs, facts, starts, total = [], [], [], 0
        for n, data in zip(table["n"].to_pylist(), table["data"]):
            data = memoryview(data.as_buffer())
            facts.append(np.frombuffer(data[: 24 * n], np.int64).reshape(3, n))
            runs.append(Run(bytes(data[24 * n :]), n, width))
            starts.append(total)
            total += n
        facts = np.concatenate(facts, axis=1)
        out, place, common, rows = [], array("q"), array("q"), bytearray()

        def answer():
            """Answers for the suffixes gathered so far: whole groups of one anchor."""
            key, first, end = facts[:, np.array(place)]
            shared = np.array(common)
            group = np.cumsum(shared < GRAM)
            same = np.flatnonzero(shared < width)  # one row for each different suffix
            first, end = np.minimum.reduceat(first, same), np.maximum.reduceat(end, same)
            merged, key, group = np.frombuffer(rows, np.uint8).reshape(-1, width), key[same], group[same]
            edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            size = np.diff(np.r_[edge, len(group)])
            busy = np.flatnonzero(np.repeat(np.maximum.reduceat(end, edge) > np.minimum.reduceat(first, edge), size))
            if len(busy):
                key, group, first, end = (x[busy] for x in (key, group, first, end))
                got = _answers(merged[busy], first, end, group, length)
                out.append((key[got[:, 0]], got[:, 1].astype(np.int32), got[:, 2].astype(np.int32), got[:, 3]))

        for r, i, c in merge(runs):
            if c < GRAM and len(place) >= PART_ROWS:
                answer()
                place, common, rows = array("q"), array("q"), bytearray()
            place.append(starts[r] + i)
            common.append(c)
            if c < width:
                rows += runs[r].key
        answer()
        kinds = {"key": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "doc": pa.int64()}
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[]] * 4
        return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), columns)})

    found = docs.mapInArrow(run, "bucket int, n int, data binary")
    return found.groupBy("bucket").applyInArrow(combine, "key long, lo int, hi int, doc long")


def occurrences(docs: DataFrame, length: int, field: np.ndarray) -> DataFrame:
    """key, doc_id, place of every suffix at a shared anchor."""

    def run(batches):
        for ids, at, part in _documents(batches):
            doc, place, _, key = _suffixes(part, at, length, field)
            if len(doc):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(ids[doc].astype(np.int64)), pa.array((place - at[doc]).astype(np.int64))],
                    ["key", "doc_id", "place"],
                )

    return docs.mapInArrow(run, "key long, doc_id long, place long")


def _cut(text: bytes, starts, ends) -> tuple[int, int, bytes, list]:
    """(removed, runs, what is left, spans) of a text and overlapping spans."""
    spans = []
    for a, e in sorted(zip(starts, ends)):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([a, e])
    kept, at = [], 0
    for a, e in spans:
        kept.append(text[at:a])
        at = e
    kept.append(text[at:])
    return sum(e - a for a, e in spans), len(spans), b"".join(kept), spans


def suffix_dedup(spark: SparkSession, docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans, kept (bytes); one row for each document.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document
    with a smaller doc_id; strings lie in one document and are judged on the input.  Null
    and empty texts, and those shorter than ``length``, stay as they are.  A null doc_id
    comes after all others, and texts of null doc_ids do not hide one another; nor do
    rows that repeat a doc_id, since neither's is smaller.  An empty table gives an empty
    result.  Only doc_id and text are read.
    """
    if length < GRAM + 1 or length > 120:
        raise ValueError("length must lie between 17 and 120")
    folder = shared_dir(spark)
    last = (1 << 62) + 1
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("doc_id")
    rows = docs.select(own, F.col("text").cast("string"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(4, min(20, (max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SLICE_BYTES)).bit_length()))
    bits = min(MAX_BITS, 1 << max(20, (size // 8).bit_length()))
    field = shared_anchors(rows, length, bits, buckets)
    answers = materialise(spark, earlier_windows(rows, length, field, buckets), folder, "answers")
    met = occurrences(rows, length, field).join(answers, "key").where("doc < doc_id")
    spans = (
        met.select("doc_id", F.struct((F.col("place") - F.col("hi")).alias("a"), (F.col("place") - F.col("lo") + length).alias("e")).alias("s"))
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_set("s")).alias("spans"))
        .select("doc_id", _united("spans"))
    )
    spans = materialise(spark, spans, folder, "spans")
    held = spans.agg(F.sum(F.size("spans") * 16 + 32)).first()[0] or 0
    joined = rows.join(F.broadcast(spans) if held <= BROADCAST_BYTES else spans, "doc_id", "left")

    def cut(batches):
        for b in batches:
            ids = [None if i == last else i for i in b.column("doc_id").to_pylist()]
            out = []
            for text, found in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                data = (text or "").encode()
                n, k, kept, where = _cut(data, [s["a"] for s in found or ()], [s["e"] for s in found or ()])
                out.append((len(data), n, k, [{"a": a, "e": e} for a, e in where], kept))
            cols = list(zip(*out)) or [()] * 5
            kind = pa.list_(pa.struct([("a", pa.int64()), ("e", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], kind), pa.array(cols[4], pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
            )

    return joined.select("doc_id", "text", "spans").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<a:long,e:long>>, kept binary"
    )


def _united(column: str):
    """Sorted spans with touching ones joined."""
    kind = "array<struct<a:bigint,e:bigint>>"
    return F.expr(
        f"aggregate({column}, cast(array() as {kind}), (acc, s) -> CASE WHEN size(acc) > 0 AND s.a <= element_at(acc, -1).e "
        f"THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'e', greatest(element_at(acc, -1).e, s.e)))) "
        f"ELSE concat(acc, array(s)) END)"
    ).alias("spans")


def digest_columns(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

