"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

A document is the set of its distinct five-word shingles, as 64-bit hashes; documents
with one set are one class from the start.  Two sets link when their Jaccard similarity
reaches 3/4.  All sets order their shingles alike: counted rare ones, counted frequent
ones, then those not counted, by hash in each class.  Linked sets share a shingle among
the first n - ceil(3n/4) + 1 of each.

Small sets (light) enumerate all pairs of shingles of a prefix one longer, of which
linked sets share two; each pair is a key.  Large sets (heavy) enter the inverted lists
of their prefix shingles, which are scanned and the hits counted.  Lights within reach
of a heavy set's size enter the lists too.  The boundary is where the cost of listing
subsets meets that of scanning lists, from the sizes and list lengths of this corpus.

Candidates are pruned exactly: by size, by the shingle's position, and by the number of
hits that a link needs within both prefixes.  Survivors are verified on whole sets.

Lists over LONG members give no pairs of their own.  Each member meets the list's central
set; lists with one central set make a family, and sets of a family that are still in
different components then meet in blocks: two blocks of whole sets go to one task, which
counts common shingles and sends back links that connect what links at all, no more than
it has sets.  So a set travels once a block, not once a pair.

Everything is spread over Spark: sets travel as blocks of hashes, links and components
stay in tables, and the shared folder cuts the lineage between rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components as star_components
from . import textops
from .common import forget, materialise, shared_dir
from .textops import mix64

#: A shingle in more sets than this is frequent; a list with more members is long.
FREQUENT, LONG = 32, 64
#: Frequent shingles that every worker knows (8 bytes each); more of them only make lists longer.
MAX_KNOWN = 1 << 20
#: Bits of the filter that spares documents without candidates the verification; a full one drops nothing.
FILTER_BITS = 1 << 25
#: Sets and shingles of a block of a family, about.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 19
#: Shingles of lower hash are counted: more of a set than its prefix holds.
COUNTED = np.uint64(3 << 61)
FLUSH, SEEN = 1 << 18, 1 << 17
STAR = 512
_SEEDS = np.array([0x6A09E667F3BCC909, 0xBB67AE8584CAA73B], dtype=np.uint64)


def set_hash(shingles: np.ndarray, which: int = 0) -> int:
    """One of two independent 64-bit hashes of a set, as a signed number."""
    mixed = mix64(shingles ^ _SEEDS[which])
    h = mix64(np.array([np.add.reduce(mixed), np.bitwise_xor.reduce(mixed)], dtype=np.uint64))
    return int((mix64(h[:1] ^ (h[1:] << np.uint64(1))) + np.uint64(len(shingles))).view(np.int64)[0])


class SetId:
    """64-bit identity of a set: its first hash, or the second where sets clash in the first.

    ``bits`` shortens the first hash, so that tests can make sets clash.
    """

    def __init__(self, bits: int = 64, clashes: frozenset = frozenset()):
        self.shift, self.clashes = 64 - bits, clashes

    def first(self, shingles: np.ndarray) -> int:
        return set_hash(shingles) >> self.shift

    def __call__(self, shingles: np.ndarray) -> int:
        sid = self.first(shingles)
        return set_hash(shingles, 1) if sid in self.clashes else sid


def prefix_size(n):
    """Shingles of a set of n of which a linked set shares one."""
    return n - -(-3 * n // 4) + 1


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets link; sizes decide most failures early."""
    if 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= 75 * (len(a) + len(b) - both)


class _Blocks:
    """Gathers columns of entries and gives them out as one row for each bucket."""

    def __init__(self, buckets: int, kinds: list):
        self.buckets, self.kinds, self.held, self.size = buckets, kinds, [], 0

    def add(self, where: np.ndarray, *columns: np.ndarray):
        self.held.append((where, *columns))
        self.size += len(where)

    def flush(self):
        if not self.size:
            return
        where, *columns = (np.concatenate(c) for c in zip(*self.held))
        self.held, self.size = [], 0
        order = np.argsort(where, kind="stable")
        where = where[order]
        edge = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True])
        columns = [c[order].astype(k) for c, k in zip(columns, self.kinds)]
        data = [b"".join(c[a:e].tobytes() for c in columns) for a, e in zip(edge[:-1], edge[1:])]
        for k in range(0, len(data), 256):
            yield pa.RecordBatch.from_arrays(
                [pa.array(where[edge[:-1]][k : k + 256], pa.int32()), pa.array(data[k : k + 256], pa.binary())], ["bucket", "data"]
            )


def _unblock(column, kinds: list) -> list[np.ndarray]:
    """The columns of all blocks of a bucket."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    parts = [[] for _ in kinds]
    for data in column.to_pylist():
        n, at = len(data) // width, 0
        for part, k in zip(parts, kinds):
            part.append(np.frombuffer(data, dtype=k, count=n, offset=at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(p) for p in parts]


def profile(docs: DataFrame, set_id: SetId) -> DataFrame:
    """doc_id, text_hash, sid, other, n for each document: both hashes of its set and their number."""

    def run(batches):
        for b in batches:
            found = [(set_id.first(s), set_hash(s, 1), len(s)) if len(s) else (0, 0, 0) for _, s in textops.shingle_sets(b.column("text"))]
            sid, other, n = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), *(pa.array(c, pa.int64()) for c in (sid, other, n))],
                ["doc_id", "text_hash", "sid", "other", "n"],
            )

    return _texts(docs).mapInArrow(textops.lean(run), "doc_id long, text_hash long, sid long, other long, n long")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _apart(sets: DataFrame, bits: int) -> tuple[DataFrame, SetId]:
    """The profile with one sid for each different set, and what computes it.

    Among N sets some N * N / 2^65 pairs share a first hash, so the list of clashes that
    the driver gathers is short: a few hundred for 1e11 sets.
    """
    mixed = sets.where("n > 0").groupBy("sid").agg(F.min("other").alias("x"), F.max("other").alias("y")).where("x <> y")
    clashes = [r.sid for r in mixed.select("sid").collect()]
    if clashes:
        sets = sets.withColumn("sid", F.when((F.col("n") > 0) & F.col("sid").isin(clashes), F.col("other")).otherwise(F.col("sid")))
    return sets.drop("other"), SetId(bits, frozenset(clashes))


def frequent_shingles(docs: DataFrame, set_id: SetId, buckets: int) -> tuple[np.ndarray, float]:
    """(sorted shingles in more than FREQUENT sets, mean length of the list of an entry).

    Counted over all documents, among the shingles below COUNTED that prefixes draw on.
    At most MAX_KNOWN come back, the most frequent first; an order of shingles without
    the others is as right and merely gives longer lists.
    """

    def count(batches):
        blocks, seen = _Blocks(buckets, ["u8", "u4"]), set()

        def fold():
            tokens, times = np.unique(np.concatenate([h[1] for h in blocks.held]), return_counts=True)
            blocks.held, blocks.size = [], 0
            blocks.add((mix64(tokens) % np.uint64(buckets)).astype(np.int32), tokens, times)
            return blocks.flush()

        for b in batches:
            for _, s in textops.shingle_sets(b.column("text")):
                low = s[: np.searchsorted(s, COUNTED)]
                if len(s) and (sid := set_id(s)) not in seen:
                    if len(seen) < SEEN:
                        seen.add(sid)
                    blocks.add(low, low)
                if blocks.size >= FLUSH:
                    yield from fold()
        if blocks.size:
            yield from fold()

    def total(table: pa.Table) -> pa.Table:
        tokens, times = _unblock(table["data"], ["u8", "u4"])
        order = np.argsort(tokens)
        tokens, times = tokens[order], times[order].astype(np.int64)
        edge = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        df = np.add.reduceat(times, edge)
        often = df > FREQUENT
        rare = df[~often]
        return pa.table(
            {
                "token": pa.array(np.r_[tokens[edge][often].view(np.int64), 0], pa.int64()),
                "df": pa.array(np.r_[df[often], 0], pa.int64()),
                "entries": pa.array(np.r_[np.zeros(often.sum(), np.int64), rare.sum()], pa.int64()),
                "squares": pa.array(np.r_[np.zeros(often.sum(), np.int64), (rare * rare).sum()], pa.int64()),
            }
        )

    counted = _texts(docs).select("text").mapInArrow(textops.lean(count), "bucket int, data binary")
    totals = counted.groupBy("bucket").applyInArrow(textops.lean_group(total), "token long, df long, entries long, squares long")
    rows = totals.groupBy(F.when(F.col("df") > 0, F.col("token")).alias("token")).agg(
        F.sum("df").alias("df"), F.sum("entries").alias("entries"), F.sum("squares").alias("squares")
    )
    top = rows.orderBy(F.col("token").isNotNull(), F.desc("df"), "token").limit(MAX_KNOWN + 1).toArrow()
    token = top["token"].to_pylist()
    known = np.array([t for t in token if t is not None], dtype=np.int64).view(np.uint64)
    plain = [i for i, t in enumerate(token) if t is None]
    entries = sum(top["entries"][i].as_py() or 0 for i in plain)
    squares = sum(top["squares"][i].as_py() or 0 for i in plain)
    return np.sort(known), squares / max(entries, 1)


def boundary(sizes: dict[int, int], list_length: float, scan: float = 0.5, most: int = 64) -> int:
    """Largest size of a light set, of least cost.

    ``sizes``: number of sets by size, up to ``most``.  An entry costs 1 to send;
    scanning a list costs ``scan`` for each of its members.  A light set sends all pairs
    of its longer prefix, and its lists as well where heavy sets may reach it.
    """
    def cost(x: int) -> float:
        total = 0.0
        for n, k in sizes.items():
            p = prefix_size(n)
            lists = p * (1 + scan * list_length)
            if n > x:
                total += k * lists
            else:
                total += k * (p * (p + 1) / 2 * (1 + scan) + (lists if 4 * n >= 3 * (x + 1) else 0))
        return total

    return min(range(2, most + 1), key=lambda x: (cost(x), x))


_ENTRY = ["u8", "i8", "u4", "i4"]


def candidates(docs: DataFrame, set_id: SetId, known: np.ndarray, light: int, buckets: int) -> DataFrame:
    """kind, a, b, na, nb, hits, pa, pb: what the keys and lists bring together.

    kind 0: sets a < b that met in ``hits`` lists of at most LONG members; kind 1: sets
    that share a pair key; kind 2: an entry of a long list, with a the shingle, b the
    set, nb its size and pb its place in the set's order (-1 for a pair key).
    """

    def index(batches):
        blocks, seen = _Blocks(buckets, _ENTRY), set()
        for b in batches:
            for _, s in textops.shingle_sets(b.column("text")):
                n = len(s)
                if n < 3:  # links to another set only from 3 on
                    continue
                sid = set_id(s)
                if sid in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(sid)
                p = prefix_size(n)
                often = np.zeros(n, dtype=bool)
                if len(known):
                    at = np.searchsorted(known, s)
                    at[at == len(known)] = 0
                    often = known[at] == s
                order = np.argsort(np.where(often, 1, 2 * (s >= COUNTED)), kind="stable")[: p + 1]
                if n > light or 4 * n >= 3 * (light + 1):
                    own = s[order[:p]]
                    # members of frequent shingles' lists are spread by set, not by shingle
                    where = np.where(often[order[:p]], np.uint64(sid & (2**63 - 1)), mix64(own)) % np.uint64(buckets)
                    pos = np.arange(p)
                    pos[often[order[:p]]] += 1 << 30
                    blocks.add(where.astype(np.int32), own, np.full(p, sid), np.full(p, n), pos)
                if n <= light:
                    i, j = np.triu_indices(len(order), 1)
                    x, y = s[order][i], s[order][j]
                    key = mix64(mix64(np.minimum(x, y)) ^ np.maximum(x, y))
                    blocks.add((key % np.uint64(buckets)).astype(np.int32), key, np.full(len(key), sid), np.full(len(key), n), np.full(len(key), -1))
                if blocks.size >= FLUSH:
                    yield from blocks.flush()
        yield from blocks.flush()

    def scan(table: pa.Table) -> pa.Table:
        token, sid, n, pos = _unblock(table["data"], _ENTRY)
        hot = pos >= 1 << 30
        out = [_rows(2, token[hot].view(np.int64), sid[hot], 0, n[hot], 0, 0, pos[hot] - (1 << 30))]
        token, sid, n, pos = (c[~hot] for c in (token, sid, n, pos))
        order = np.lexsort((sid, token))
        token, sid, n, pos = (c[order] for c in (token, sid, n, pos))
        fresh = np.r_[True, (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])] if len(token) else np.zeros(0, bool)
        token, sid, n, pos = (c[fresh] for c in (token, sid, n, pos))
        edge = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True]) if len(token) else np.zeros(1, int)
        length = np.diff(edge)
        long_ = np.repeat(length > LONG, length)
        out.append(_rows(2, token[long_].view(np.int64), sid[long_], 0, n[long_], 0, 0, pos[long_]))
        pairs = []
        for size in np.unique(length[(length > 1) & (length <= LONG)]):
            first = edge[:-1][length == size]
            i, j = np.triu_indices(size, 1)
            step = max(1, (1 << 20) // len(i))
            for k in range(0, len(first), step):
                x = (first[k : k + step, None] + i).ravel()
                y = (first[k : k + step, None] + j).ravel()
                na, nb = n[x].astype(np.int64), n[y].astype(np.int64)
                subset = pos[x] < 0
                ok = (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)) & (subset | (np.maximum(na, nb) > light))
                x, y = x[ok], y[ok]
                pairs.append(np.stack([x, y]))
        if pairs:
            x, y = np.concatenate(pairs, axis=1)
            a, b, sub = sid[x], sid[y], (pos[x] < 0).astype(np.int64)
            order = np.lexsort((sub, b, a))
            a, b, sub, x, y = a[order], b[order], sub[order], x[order], y[order]
            first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (sub[1:] != sub[:-1])])
            hits = np.diff(np.r_[first, len(a)])
            x, y = x[first], y[first]
            out.append(_rows(sub[first], a[first], b[first], n[x], n[y], hits, 0, 0))
        return pa.concat_tables(out)

    entries = _texts(docs).select("text").mapInArrow(textops.lean(index), "bucket int, data binary")
    return entries.groupBy("bucket").applyInArrow(
        textops.lean_group(scan), "kind int, a long, b long, na long, nb long, hits long, pa long, pb long"
    )


def _rows(kind, a, b, na, nb, hits, pa_, pb) -> pa.Table:
    n = len(a)
    full = lambda v, t: pa.array(np.broadcast_to(np.asarray(v), n).astype(t))
    names = ["kind", "a", "b", "na", "nb", "hits", "pa", "pb"]
    return pa.table([full(v, np.int32 if i == 0 else np.int64) for i, v in enumerate((kind, a, b, na, nb, hits, pa_, pb))], names)


def _needed_hits(na: str, nb: str):
    """Hits within both prefixes that sets of these sizes need for a link."""
    behind = F.greatest(*(F.ceil(3 * F.col(n) / 4.0) - 1 for n in (na, nb)))
    return F.ceil((F.col(na) + F.col(nb)) * 3 / 7.0) - behind


def _prune(found: DataFrame) -> DataFrame:
    """Pairs (a, b) that may link, from the lists of at most LONG members.

    Shared shingles outside both prefixes number at most what lies behind a prefix, so
    the hits must make up the rest.  A set with entries in long lists may have more hits
    than were counted; its pairs all stay.
    """
    need = _needed_hits("na", "nb")
    pairs = (
        found.where("kind < 2")
        .groupBy("a", "b")
        .agg(F.max("kind").alias("sub"), F.sum("hits").alias("hits"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    )
    marked = found.where("kind = 2").select(F.col("b").alias("a")).distinct().withColumn("long", F.lit(True))
    return pairs.join(marked, "a", "left").where((F.col("sub") == 1) | F.col("long") | (F.col("hits") >= need)).select("a", "b")


def _long_entries(found: DataFrame) -> DataFrame:
    """The entries of long lists, with the number of long lists the set is in as ``kb``."""
    entries = found.where("kind = 2").select("a", "b", "nb", "pb").distinct()
    return entries.join(entries.groupBy("b").agg(F.count_if(F.col("pb") >= 0).alias("kb")), "b")


def _meets(x: str, y: str):
    """Whether two entries of a long list may be the first that linked sets share.

    Sets that also meet in a short list are paired there, so all the hits that others
    need come from long lists: each set must be in as many.
    """
    nx, ny, px, py, kx, ky = (F.col(f"{s}.{c}") for c in ("nb", "pb", "kb") for s in (x, y))
    need = F.ceil((nx + ny) * 3 / 7.0)
    fits = 4 * F.least(nx, ny) >= 3 * F.greatest(nx, ny)
    enough = F.least(kx, ky) >= _needed_hits(f"{x}.nb", f"{y}.nb")
    return fits & ((px < 0) | (enough & (1 + F.least(nx - 1 - px, ny - 1 - py) >= need)))


def _central(entries: DataFrame) -> DataFrame:
    """The central member of each long list: the one that is in most long lists.

    A set from which others were varied shares more with each of them than they share
    with each other.
    """
    often = entries.groupBy("b").agg(F.count(F.lit(1)).alias("k"))
    first = entries.join(often, "b").groupBy("a").agg(F.max(F.struct("k", "b", "nb", "pb", "kb")).alias("f"))
    return first.select("a", "f.b", "f.nb", "f.pb", "f.kb")


def _first_meetings(entries: DataFrame, central: DataFrame) -> DataFrame:
    """Pairs of a list's central member (a) with every member of the list."""
    met = entries.alias("x").join(central.alias("y"), F.col("x.a") == F.col("y.a")).where(_meets("x", "y") & (F.col("x.b") != F.col("y.b")))
    return met.select(F.col("y.b").alias("a"), F.col("x.b").alias("b")).distinct()


def _family_blocks(entries: DataFrame, central: DataFrame, labels: DataFrame) -> DataFrame:
    """family, i, j, late, sid, root: the blocks of sets that must meet, pairwise.

    A family is all members of the long lists with one central set.  Its largest
    component needn't meet itself; sets of the others (late) meet all of the family.
    """
    member = entries.select("a", "b", "nb").join(central.select("a", F.col("b").alias("family")), "a")
    member = member.select("family", "b", "nb").distinct()
    own = member.join(labels.select(F.col("v").alias("b"), "root"), "b", "left").withColumn("root", F.coalesce("root", "b"))
    sizes = own.groupBy("family", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("nb").alias("w"))
    blocks = lambda k, w: F.greatest(F.ceil(k / BLOCK_SETS), F.ceil(w / BLOCK_SHINGLES)).cast("long")
    facts = sizes.groupBy("family").agg(
        F.max(F.struct("w", "root", "k")).alias("m"), F.sum("k").alias("k"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("roots")
    )
    facts = facts.where("roots > 1").select(
        "family", F.col("m.root").alias("main"),
        blocks(F.col("k") - F.col("m.k"), F.col("w") - F.col("m.w")).alias("rows"), blocks(F.col("k"), F.col("w")).alias("columns"),
    )
    mixed = own.join(facts, "family")
    place = lambda n: F.pmod(F.xxhash64("b"), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    late = mixed.where("root <> main").select("family", place("rows").alias("i"), all_of("columns").alias("j"), F.lit(True).alias("late"), F.col("b").alias("sid"), "root")
    rest = mixed.select("family", all_of("rows").alias("i"), place("columns").alias("j"), F.lit(False).alias("late"), F.col("b").alias("sid"), "root")
    return late.unionByName(rest)


def overlaps(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets with sets, each a sorted array.

    A shingle that many sets of both sides hold is counted by a matrix product, one in
    few of them by listing its pairs; either way one count a pair of sets is kept.
    """
    out = np.zeros((len(rows), len(columns)), dtype=np.float32)
    size = [np.array([len(s) for s in side], dtype=np.int64) for side in (rows, columns)]
    token, number = np.unique(np.concatenate([*rows, *columns]), return_inverse=True)
    split = size[0].sum()
    held = [np.bincount(x, minlength=len(token)) for x in (number[:split], number[split:])]
    pairs = held[0] * held[1]
    often = pairs > out.size // 64
    shared = pairs > 0
    owner = [np.repeat(np.arange(len(n)), n) for n in size]
    entry = [number[:split], number[split:]]
    dense = np.flatnonzero(shared & often)
    for k in range(0, len(dense), 1024):
        place = np.full(len(token), -1)
        place[dense[k : k + 1024]] = np.arange(len(dense[k : k + 1024]))
        sides = []
        for o, e, n in zip(owner, entry, size):
            hit = place[e] >= 0
            m = np.zeros((len(n), min(1024, len(dense) - k)), dtype=np.float32)
            m[o[hit], place[e[hit]]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    few = shared & ~often
    side = []
    for o, e in zip(owner, entry):
        some = few[e]
        order = np.argsort(e[some], kind="stable")
        side.append((e[some][order], o[some][order]))
    (e, left), (f, right) = side
    if len(e):
        begin, times = np.searchsorted(f, e), held[1][e]
        upto = np.cumsum(times)
        at = 0
        while at < len(e):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 21), side="right")))
            t = times[at:stop]
            shift = np.repeat(begin[at:stop] - (np.cumsum(t) - t), t)
            pair = np.repeat(left[at:stop], t) * len(columns) + right[shift + np.arange(len(shift))]
            out += np.bincount(pair, minlength=out.size).reshape(out.shape)
            at = stop
    return out


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) links that connect all that ``linked`` connects, fewer than its rows and columns."""
    rows, columns, out = np.zeros(linked.shape[0], bool), np.zeros(linked.shape[1], bool), []
    for start in np.flatnonzero(linked.any(1)).tolist():
        if rows[start]:
            continue
        rows[start], queue = True, [start]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(linked[i] & ~columns)
            if not len(new):
                continue
            columns[new] = True
            out += [(i, j) for j in new.tolist()]
            part = linked[:, new]
            for k in np.flatnonzero(part.any(1) & ~rows).tolist():
                rows[k] = True
                out.append((k, int(new[part[k].argmax()])))
                queue.append(k)
    return out


def _meet(table: pa.Table) -> pa.Table:
    """Links between the late sets of a pair of blocks and the other block's, enough to connect them."""
    table = table.combine_chunks()
    late, sid, root = (table[c].to_numpy() for c in ("late", "sid", "root"))
    sides = []
    for some in (np.flatnonzero(late), np.flatnonzero(~late)):
        own, first = np.unique(sid[some], return_index=True)
        sides.append((own, root[some[first]], [np.frombuffer(table["data"][int(k)].as_py(), np.uint64) for k in some[first]]))
    (a, ra, x), (b, rb, y) = sides
    links = []
    if len(a) and len(b):
        both = overlaps(x, y)
        total = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])
        links = spanning((100 * both >= 75 * (total - both)) & (ra[:, None] != rb))
    return pa.table({"a": pa.array([int(a[i]) for i, _ in links], pa.int64()), "b": pa.array([int(b[j]) for _, j in links], pa.int64())})


def family_links(docs: DataFrame, owners: DataFrame, blocks: DataFrame) -> DataFrame:
    """Links (a, b) that connect the sets of each family that link, whichever component they were in."""
    met = _with_sets(docs, owners, blocks)
    return met.select("family", "i", "j", "late", "sid", "root", "data").groupBy("family", "i", "j").applyInArrow(textops.lean_group(_meet), "a long, b long")


def _with_sets(docs: DataFrame, owners: DataFrame, ask: DataFrame) -> DataFrame:
    """``ask`` (with column sid) with the sets as ``data``, read again from the documents that own them."""
    ask = ask.join(owners.select("sid", "own.doc_id", "own.text_hash"), "sid")
    bit = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(FILTER_BITS))
    rows = (
        ask.select(bit.alias("h"))
        .groupBy(F.expr("bitmap_bucket_number(h)").alias("k"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("bits"))
        .collect()
    )
    wanted = np.zeros(FILTER_BITS // 8 + 4096, dtype=np.uint8)
    for r in rows:
        at = r["k"] * 4096
        wanted[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)

    def sets(batches):
        seen = set()  # rows that repeat both doc_id and text are one
        for b in batches:
            # bit_position gives 0-based places inside bucket k, which covers (k - 1) * 32768 + 1 .. k * 32768
            h = b.column("h").to_numpy()
            k = np.where(h > 0, 1 + (h - 1) // 32768, -(-h // 32768))
            place = np.where(h > 0, (h - 1) % 32768, (-h) % 32768)
            keep = []
            for i in np.flatnonzero(wanted[k * 4096 + place // 8] >> (place % 8) & 1).tolist():
                row = (b.column("doc_id")[i].as_py(), b.column("text_hash")[i].as_py())
                if row not in seen:
                    keep.append(i)
                    if len(seen) < SEEN:
                        seen.add(row)
            for k in range(0, len(keep), 512):
                some = b.take(pa.array(keep[k : k + 512]))
                data = [s.tobytes() for _, s in textops.shingle_sets(some.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("text_hash"), pa.array(data, pa.binary())], ["_doc_id", "_text_hash", "data"]
                )

    found = _texts(docs).withColumn("h", bit).mapInArrow(textops.lean(sets), "_doc_id long, _text_hash long, data binary")
    return found.join(ask, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash")))


def verify(docs: DataFrame, owners: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link.

    ``owners``: sid, own (doc_id and text_hash of one document with the set).  A pair goes
    to the group of a; a group of many is split, and a's set goes to each part.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("long").alias("parts"))
    placed = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    ask = placed.select("a", "part", F.col("b").alias("sid"), F.lit(False).alias("first")).unionByName(
        placed.select("a", "part", F.col("a").alias("sid"), F.lit(True).alias("first")).distinct()
    )
    members = _with_sets(docs, owners, ask)

    def check(table: pa.Table) -> pa.Table:
        first = table["first"].to_numpy()
        data, sid = table["data"], table["sid"].to_numpy()
        if not first.any():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        own = int(np.flatnonzero(first)[0])
        a = np.frombuffer(data[own].as_py(), np.uint64)
        links = [int(sid[k]) for k in np.flatnonzero(~first) if similar(a, np.frombuffer(data[int(k)].as_py(), np.uint64))]
        return pa.table({"a": pa.array([int(sid[own])] * len(links), pa.int64()), "b": pa.array(links, pa.int64())})

    return members.select("a", "part", "sid", "first", "data").groupBy("a", "part").applyInArrow(textops.lean_group(check), "a long, b long")


def components(spark: SparkSession, links: DataFrame, folder: str, name: str) -> DataFrame:
    """v, root for every set with a link: the smallest set id of its component.

    Rounds go on until all labels are settled, however long the chains of links are.
    """
    return star_components(links, lambda df, k: materialise(spark, df, folder, f"{name}-{k}"))


def jaccard_join(spark: SparkSession, docs: DataFrame, id_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(classes, links).

    classes: doc_id, text_hash (xxhash64 of the text), n_shingles, sid (the document's
    class of equal sets), root (of its component; null for an empty set), component_id,
    the smallest doc_id reachable by links.  links: a, b, verified pairs of classes that
    connect every component; with the classes they lose no connection.

    Null and empty texts have empty sets and link with nothing: their component is their
    own doc_id.  Every row has its own set, whatever its doc_id: rows that repeat one, or
    have none, link as their texts do.  A null doc_id is never the smallest unless all of
    a component are null.  An empty table gives two empty results.  Only doc_id and text
    are read.
    """
    folder = shared_dir(spark)
    sets, set_id = _apart(materialise(spark, profile(docs, SetId(id_bits)), folder, "sets"), id_bits)
    owners = sets.where("n > 0").groupBy("sid").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("own"), F.min("doc_id").alias("smallest"), F.max("n").alias("n")
    )
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 1_000_000 + 1)
    known, list_length = frequent_shingles(docs, set_id, buckets)
    sizes = {r["n"]: r["count"] for r in owners.where("n BETWEEN 3 AND 64").groupBy("n").count().collect()}
    light = boundary(sizes, list_length)
    found = materialise(spark, candidates(docs, set_id, known, light, buckets), folder, "found")
    entries = materialise(spark, _long_entries(found), folder, "entries")
    central = None if entries.isEmpty() else materialise(spark, _central(entries), folder, "central")
    pairs = _prune(found)
    if central is not None:
        pairs = pairs.unionByName(_first_meetings(entries, central))
    links = materialise(spark, verify(docs, owners, materialise(spark, pairs, folder, "pairs")), folder, "links")
    roots = components(spark, links, folder, "first")
    if central is not None:
        blocks = materialise(spark, _family_blocks(entries, central, roots), folder, "blocks")
        if not blocks.isEmpty():
            more = materialise(spark, family_links(docs, owners, blocks), folder, "more-links")
            if not more.isEmpty():
                links = links.unionByName(more)
                roots = components(spark, links, folder, "second")
    for name in ("found", "entries", "central", "pairs", "blocks"):  # what comes back doesn't read these
        forget(spark, f"{folder}/{name}")
    classes = owners.select("sid", "smallest").join(roots.withColumnRenamed("v", "sid"), "sid", "left")
    classes = classes.withColumn("root", F.coalesce("root", "sid"))
    smallest = classes.groupBy("root").agg(F.min("smallest").alias("component_id"))
    by_class = classes.join(smallest, "root").select("sid", "root", "component_id")
    base = ["doc_id", "text_hash", F.col("n").alias("n_shingles"), "sid"]
    out = sets.where("n > 0").join(by_class, "sid").select(*base, "root", "component_id")
    empty = sets.where("n = 0").select(*base, F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return out.unionByName(empty), links
