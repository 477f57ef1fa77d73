"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

A text's lattice has an edge for every vocabulary piece at every place.  A piece's
score is the log of its Zipf rank, read off the model's own order, as a whole number of
2^-36: sums are exact whatever their order.  Characters without a piece, line breaks and
a literal U+2581 are edges of byte pieces, so that decoding gives back every text
unchanged.

Forward Viterbi scores give the best way from the start to each place.  N-best search
runs A* backwards from the end with those scores as its heuristic; they are exact, so
paths leave the queue in the order of their full scores.  A deviation worse than the n
best known ones is not queued at all.

No piece reaches from a word into the space after it or across a line break; the only
pieces with a space further on are runs of spaces.  So the lattice falls into fragments,
each a run of spaces and the word after it, up to a line break or a literal U+2581.
Texts are cut into fragments as arrays; a worker solves each different fragment once,
many of one length at a time, long ones place by place.  The N best of a text deviate
from its best only in the N - 1 fragments whose second-best costs least, found from
forward and backward scores; A* runs on these alone.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops

SPACE = "▁"
#: Cells of one array pass; a longer fragment is solved by itself.
CELLS, LONG = 1 << 16, 256
#: Characters of text looked at in one go.
PART_CHARS = 1 << 19
#: Fragments, and their ids, that a worker keeps; fragments whose N best it keeps.
CACHE_FRAGMENTS, CACHE_IDS, CACHE_PATHS = 700_000, 1 << 22, 20_000
#: One nat in scores.
UNIT = 1 << 36
_NONE = -(1 << 62)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A literal U+2581 and a line break, out of the range of characters: they match no piece.
_LITERAL, _BREAK = 0x110000 + 0x2581, 0x110000 + 0x0A


class PieceLattice:
    """The vocabulary of a SentencePiece model as a lattice builder."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of, self.byte_id, names, ids = [b""] * n, {}, [], []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
                if SPACE in piece[1:] and piece.strip(SPACE):
                    raise ValueError(f"piece {i} reaches from a word across a space: {piece}")
                names.append(piece)
                ids.append(i)
        exact = lambda x: round(float(x) * UNIT)
        self.byte_cost = exact(-np.log(n + 3) - 1)
        self.edge_of = {p: (exact(-np.log(3 + min(max(0.0, -sp.get_score(i)), n))), i) for p, i in zip(names, ids)}
        self.ids_by_name = dict(zip(names, ids))
        self.score_by_name = {p: cost / UNIT for p, (cost, _) in self.edge_of.items()}
        self.byte_score = self.byte_cost / UNIT
        self.longest = max(map(len, names), default=1)
        prefixes = sorted({p[:k] for p in names for k in range(1, len(p) + 1)})
        hashes = np.array([self._hash(p) for p in prefixes], dtype=np.uint64)
        order = np.argsort(hashes)
        found = [self.edge_of.get(p, (_NONE, -1)) for p in prefixes]
        self.hashes = hashes[order]
        self.costs = np.array([c for c, _ in found], dtype=np.int64)[order]
        self.ids = np.array([i for _, i in found], dtype=np.int32)[order]
        self.bytes_ids = np.array([self.byte_id.get(b, 0) for b in range(256)], dtype=np.uint16)
        size = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.size, self.at = size, np.cumsum(size) - size
        self.data = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    def _matches(self, points: np.ndarray):
        """For each length: flat places where a prefix of that length begins, its cost and id (-1 if no piece).

        Only places that begin some piece's prefix go on to the next length.
        """
        n, width = points.shape
        flat = points.ravel().astype(np.uint64) + np.uint64(1)
        place, h = np.arange(n * width), np.zeros(n * width, dtype=np.uint64)
        room = np.tile(np.arange(width, 0, -1), n)
        for l in range(1, min(self.longest, width) + 1):
            some = room[place] >= l
            place, h = place[some], h[some]
            h = h * _BASE + flat[place + l - 1]
            at = np.searchsorted(self.hashes, h)
            at[at == len(self.hashes)] = 0
            alive = self.hashes[at] == h
            place, h, at = place[alive], h[alive], at[alive]
            if not len(place):
                return
            yield l, place, self.costs[at], self.ids[at]

    @staticmethod
    def _bytes(points: np.ndarray) -> np.ndarray:
        """UTF-8 bytes that each character takes."""
        own = np.where(points >= 0x110000, points - 0x110000, points)
        return 1 + (own > 0x7F).astype(np.int64) + (own > 0x7FF) + (own > 0xFFFF)

    def _edges(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cost, id) by length - 1, fragment, start; _NONE and -1 where there is no edge."""
        n, width = points.shape
        found = list(self._matches(points))
        most = max([1, *(l for l, _, _, ids in found if (ids >= 0).any())])
        cost, ids = np.full((most, n * width), _NONE), np.full((most, n * width), -1, np.int32)
        for l, place, some, own in found[:most]:
            cost[l - 1, place], ids[l - 1, place] = some, own
        lone = ids[0] < 0  # a character without a piece: its bytes
        cost[0, lone] = self.byte_cost * self._bytes(points.ravel()[lone])
        return cost.reshape(most, n, width), ids.reshape(most, n, width)

    def _spelled(self, ids: np.ndarray, points: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids with bytes for each -1, their number for each of n owners)."""
        times = np.ones(len(ids), dtype=np.int64)
        lone = np.flatnonzero(ids < 0)
        if not len(lone):
            return ids.astype(np.uint16), np.bincount(owner, minlength=n)
        times[lone] = self._bytes(points[lone])
        out = np.repeat(ids, times).astype(np.uint16)
        begin = (np.cumsum(times) - times)[lone]
        own = points[lone].astype(np.int64)
        own = np.where(own >= 0x110000, own - 0x110000, own)
        for k in range(4):
            some = times[lone] > k
            left = 6 * (times[lone][some] - 1 - k)
            byte = own[some] >> left
            head = np.array([0, 0xC0, 0xE0, 0xF0])[times[lone][some] - 1]
            byte = head | byte if k == 0 else 0x80 | byte & 63
            out[begin[some] + k] = self.bytes_ids[byte]
        return out, np.bincount(owner, weights=times, minlength=n).astype(np.int64)

    def solve(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids end to end, their number, cost of the best path, loss of the second-best) of fragments of one length.

        The loss is -_NONE at least where there is one path only.
        """
        n, width = points.shape
        if width > LONG:
            return self._solve_long(points)
        cost, ids = self._edges(points)
        most = len(cost)
        best, length = np.full((n, width + 1), _NONE), np.zeros((n, width + 1), dtype=np.int16)
        best[:, 0] = 0
        for j in range(1, width + 1):
            for l in range(1, min(most, j) + 1):
                here = best[:, j - l] + cost[l - 1, :, j - l]
                better = here > best[:, j]
                best[better, j] = here[better]
                length[better, j] = l
        back = np.full((n, width + 1), _NONE)
        back[:, width] = 0
        for i in range(width - 1, -1, -1):
            for l in range(1, min(most, width - i) + 1):
                np.maximum(back[:, i], cost[l - 1, :, i] + back[:, i + l], out=back[:, i])
        on = np.zeros((n, width), dtype=np.int16)  # length of the best path's edge at its start
        live, end = np.arange(n), np.full(n, width)
        while len(live):
            l = length[live, end]
            end = end - l
            on[live, end] = l
            live, end = live[end > 0], end[end > 0]
        second = np.full(n, 2 * _NONE)
        for l in range(most):
            through = best[:, : width - l] + cost[l, :, : width - l] + back[:, l + 1 :]
            through[on[:, : width - l] == l + 1] = 2 * _NONE
            np.maximum(second, through.max(1), out=second)
        rows, at = np.nonzero(on)
        flat, count = self._spelled(ids[on[rows, at] - 1, rows, at], points[rows, at], rows, n)
        total = best[:, width]
        return flat, count, total, np.where(second < _NONE // 2, -_NONE, total - second)

    def _all_edges(self, points: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, length, cost, id) of every edge of one long fragment, by end, and where each end's begin."""
        width = len(points)
        columns = [(place, np.full(len(place), l), cost, ids) for l, place, cost, ids in self._matches(points[None, :])]
        lone = np.ones(width, dtype=bool)
        if columns:
            lone[columns[0][0][columns[0][3] >= 0]] = False
        lone = np.flatnonzero(lone)
        columns.append((lone, np.ones(len(lone), np.int64), self.byte_cost * self._bytes(points[lone]), np.full(len(lone), -1, np.int32)))
        start, length, cost, ids = (np.concatenate(c) for c in zip(*columns))
        real = cost > _NONE
        start, length, cost, ids = (c[real] for c in (start, length, cost, ids))
        order = np.lexsort((length, start + length))
        start, length, cost, ids = (c[order] for c in (start, length, cost, ids))
        return start, length, cost, ids, np.searchsorted(start + length, np.arange(width + 2))

    def _solve_long(self, group: np.ndarray):
        """``solve`` place by place, over the edges that there are."""
        found = []
        for points in group:
            width = len(points)
            start, length, cost, ids, edge = self._all_edges(points)
            best, taken = [0] * (width + 1), [0] * (width + 1)
            step = 1 << 14
            for a in range(1, width + 1, step):
                lo, hi = edge[a], edge[min(a + step, width + 1)]
                some, what, ends = start[lo:hi].tolist(), cost[lo:hi].tolist(), (edge[a : min(a + step, width + 1) + 1] - lo).tolist()
                for j in range(a, min(a + step, width + 1)):
                    top, pick = None, 0
                    for k in range(ends[j - a], ends[j - a + 1]):
                        here = best[some[k]] + what[k]
                        if top is None or here > top:
                            top, pick = here, k
                    best[j], taken[j] = top, pick + int(lo)
            order = np.lexsort((length, start))
            first = np.searchsorted(start[order], np.arange(width + 1))
            back = [0] * (width + 1)
            for e in range(width, 0, -step):
                a = max(0, e - step)
                lo, hi = first[a], first[e]
                some = order[lo:hi]
                stop, what, begins = (start + length)[some].tolist(), cost[some].tolist(), (first[a : e + 1] - lo).tolist()
                for i in range(e - 1, a - 1, -1):
                    back[i] = max(what[k] + back[stop[k]] for k in range(begins[i - a], begins[i - a + 1]))
            path, at = [], width
            while at:
                path.append(taken[at])
                at = int(start[taken[at]])
            path = np.array(path[::-1])
            through = np.array(best, dtype=np.int64)[start] + cost + np.array(back, dtype=np.int64)[start + length]
            off = np.ones(len(start), dtype=bool)
            off[path] = False
            flat, count = self._spelled(ids[path], points[start[path]], np.zeros(len(path), np.int64), 1)
            found.append((flat, int(count[0]), best[width], best[width] - int(through[off].max()) if off.any() else -_NONE))
        flat, count, total, loss = zip(*found)
        return np.concatenate(flat), np.array(count), np.array(total), np.array(loss)

    def nbest(self, points: np.ndarray, n: int) -> list[tuple[int, list[int]]]:
        """The ``n`` best paths of a fragment, as (cost, ids), best first."""
        width = len(points)
        if width == 1 and points[0] >= 0x110000:
            some = chr(points[0] - 0x110000).encode()
            return [(self.byte_cost * len(some), [self.byte_id[b] for b in some])]
        text, forward = "".join(map(chr, points.tolist())), [0] * (width + 1)
        spell = lambda c: [self.byte_id[b] for b in c.encode()]
        if width <= LONG:
            edges, get = [[] for _ in range(width + 1)], self.edge_of.get
            for j in range(1, width + 1):
                own = edges[j]
                for i in range(max(0, j - self.longest), j):
                    if one := get(text[i:j]):
                        own.append((i, *one))
                    elif j - i == 1:
                        own.append((i, self.byte_cost * len(text[i].encode()), -1))
                forward[j] = max(forward[i] + c for i, c, _ in own)
            into = edges.__getitem__
        else:
            start, length, cost, ids, edge = self._all_edges(points)
            into = lambda j: zip(*(x[edge[j] : edge[j + 1]].tolist() for x in (start, cost, ids)))
            for j in range(1, width + 1):
                forward[j] = max(forward[i] + c for i, c, _ in into(j))
        # equal bounds go on where the path is longest, so one path is followed to its start
        queue, out, tie, known = [(-forward[width], width, 0, 0, None)], [], 0, [forward[width]]
        while queue and len(out) < n:
            bound, at, _, done, path = heapq.heappop(queue)
            if not at:
                found = []
                while path:
                    i, one, path = path
                    found += [one] if one >= 0 else spell(text[i])
                out.append((done, found))
                continue
            same = False
            for i, c, one in into(at):
                now = -(done + c + forward[i])
                if now == bound and not same:
                    same = True  # the path that was known
                elif len(known) < n:
                    heapq.heappush(known, -now)
                elif -now >= known[0]:
                    heapq.heapreplace(known, -now)
                else:
                    continue
                tie += 1
                heapq.heappush(queue, (now, i, tie, done + c, (i, one, path)))
        return out

    def decode(self, ids) -> str:
        """The text of ids that ``encode`` gives."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")

    def spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes that the pieces stand for, end to end; where each piece's begin, and the end)."""
        size = self.size[ids]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        return self.data[np.arange(total) + np.repeat(self.at[ids] - (upto - size), size)], np.concatenate([[0], upto])


@lru_cache(maxsize=2)
def lattice(path: str) -> PieceLattice:
    return PieceLattice(path)


class Encoder:
    """Encodes texts with the solutions of fragments seen before.

    ``space_runs`` admits the pieces that stand for several spaces; without them each
    space is the start of a fragment of its own, and the best paths are those without runs.
    """

    def __init__(self, model: PieceLattice, space_runs: bool = False):
        self.model, self.space_runs = model, space_runs
        self._forget()

    def _forget(self) -> None:
        self.keys, self.checks, self.slots = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint16)
        self.begin, self.size, self.cost, self.loss = (np.empty(0, np.int64) for _ in range(4))
        self.paths: dict[tuple[int, int], list] = {}

    def fragments(self, at: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first characters of the fragments of texts cut at ``at``, characters as the lattice reads them)."""
        blank, literal, line = points == 0x20, points == 0x2581, points == 0x0A
        start = blank.copy()
        if self.space_runs:
            start[1:] &= ~blank[:-1]
        start |= literal | line
        start[1:] |= (literal | line)[:-1]
        start[at[at < len(points)]] = True
        read = points.copy()
        read[blank], read[literal], read[line] = 0x2581, _LITERAL, _BREAK
        return np.flatnonzero(start), read

    def _learned(self, start: np.ndarray, end: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Where the solution of each fragment is kept; new ones are solved first."""
        key, check = (textops.range_hash(textops.running(textops.mix64(points.astype(np.uint64) + np.uint64(k << 32))), start, end) for k in (1, 2))
        unique, one, back = np.unique(key, return_index=True, return_inverse=True)
        where = np.searchsorted(self.keys, unique)
        known = where < len(self.keys)
        known[known] = self.keys[where[known]] == unique[known]
        clash = (check[one][back] != check).any() or (self.checks[where[known]] != check[one][known]).any()
        if clash:  # two fragments under one hash: solve all of these anew, each by itself
            rows, slots = np.arange(len(start)), len(self.begin) + np.arange(len(start))
            self._solve(start, end, points, rows)
            return slots
        new = np.flatnonzero(~known)
        if len(new):
            slots = len(self.begin) + np.arange(len(new))
            self._solve(start, end, points, one[new])
            self.keys, self.checks = np.insert(self.keys, where[new], unique[new]), np.insert(self.checks, where[new], check[one][new])
            self.slots = np.insert(self.slots, where[new], slots)
            where = np.searchsorted(self.keys, unique)
        return self.slots[where][back]

    def _solve(self, start: np.ndarray, end: np.ndarray, points: np.ndarray, rows: np.ndarray) -> None:
        """Appends the solutions of these fragments."""
        length = (end - start)[rows]
        begin, size, cost, loss = (np.empty(len(rows), np.int64) for _ in range(4))
        ids, held = [self.ids], len(self.ids)
        order = np.argsort(length, kind="stable")
        edge = np.flatnonzero(np.r_[True, length[order][1:] != length[order][:-1], True])
        for a, e in zip(edge[:-1], edge[1:]):
            width = int(length[order[a]])
            step = max(1, CELLS // width)
            for k in range(a, e, step):
                some = order[k : min(k + step, e)]
                flat, count, total, second = self.model.solve(points[start[rows[some]][:, None] + np.arange(width)])
                ids.append(flat)
                begin[some], size[some], cost[some], loss[some] = held + np.cumsum(count) - count, count, total, second
                held += len(flat)
        self.ids = np.concatenate(ids)
        for name, more in (("begin", begin), ("size", size), ("cost", cost), ("loss", loss)):
            setattr(self, name, np.concatenate([getattr(self, name), more]))

    def texts(self, texts: list[str]) -> list[tuple]:
        """(ids, their number, cost, fragments, where they are kept, round trip) of each text; an empty one has none."""
        if len(self.keys) > CACHE_FRAGMENTS or len(self.ids) > CACHE_IDS:
            self._forget()
        out, some, size = [None] * len(texts), [], 0
        for k, t in enumerate(texts):
            if len(t) > 2 * PART_CHARS:
                out[k] = self._long(t)
                continue
            some.append(k)
            size += len(t)
            if size > PART_CHARS or k + 1 == len(texts):
                for i, row in zip(some, self._some([" " + texts[i] if texts[i] else "" for i in some])):
                    out[i] = row
                some, size = [], 0
        if some:
            for i, row in zip(some, self._some([" " + texts[i] if texts[i] else "" for i in some])):
                out[i] = row
        return out

    def _some(self, texts: list[str]) -> list[tuple]:
        """``texts`` for texts that have the blank before them already."""
        joined = "".join(texts)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        start, points = self.fragments(at, np.frombuffer(joined.encode("utf-32-le"), np.uint32))
        end = np.append(start[1:], len(points))
        slot = self._learned(start, end, points)
        size = self.size[slot]
        upto = np.cumsum(size)
        ids = self.ids[np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.begin[slot] - (upto - size), size)]
        edge = np.searchsorted(start, at)
        place = np.concatenate([[0], upto])[edge]
        cost = np.concatenate([[0], np.cumsum(self.cost[slot] / UNIT)])
        spelled, begins = self.model.spelled(ids)
        got, want, done, rows = spelled.tobytes(), joined.encode(), 0, []
        begins = begins[place].tolist()
        wide = len(want) != len(joined)
        for d, t in enumerate(texts):
            a, e = edge[d], edge[d + 1]
            length = len(t.encode()) if wide else len(t)
            same = got[begins[d] : begins[d + 1]] == want[done : done + length]
            done += length
            score = float((self.cost[slot[a:e]] / UNIT).sum()) if e - a < 1 << 16 else float(cost[e] - cost[a])
            rows.append((ids[place[d] : place[d + 1]], int(place[d + 1] - place[d]), score, (points, start[a:e], end[a:e]), slot[a:e], same))
        return rows

    def _long(self, text: str) -> tuple:
        """A long text, part by part; cut before a blank after something else, where a fragment begins."""
        step, first, parts, lead = PART_CHARS, 0, [], " "
        while first < len(text):
            end = first + step
            while 0 < (end := text.find(" ", end)) < len(text) and text[end - 1] == " ":
                end += 1
            end = end if 0 < end else len(text)
            parts += self._some([lead + text[first:end]])
            first, lead = end, ""
        shift = np.cumsum([0, *(len(p[3][0]) for p in parts)])
        units = (np.concatenate([p[3][0] for p in parts]), *(np.concatenate([p[3][k] + x for p, x in zip(parts, shift)]) for k in (1, 2)))
        ids, slot = (np.concatenate([p[k] for p in parts]) for k in (0, 4))
        return ids, len(ids), sum(p[2] for p in parts), units, slot, all(p[5] for p in parts)

    def encode(self, texts: list[str]) -> list[tuple[bytes, int, float, tuple, np.ndarray]]:
        """(packed ids, their number, score, fragments, where they are kept) of each text."""
        return [(ids.tobytes(), size, score, units, slot) for ids, size, score, units, slot, _ in self.texts(texts)]

    def nbest(self, units: tuple, slot: np.ndarray, n: int) -> list[tuple[float, dict[int, list[int]]]]:
        """The n best segmentations: (loss against the best, ids of the fragments that deviate)."""
        loss = self.loss[slot]
        some = np.flatnonzero(loss < -_NONE)
        k = min(n - 1, len(some))
        if len(some) > 4 * n:
            edge = np.partition(loss[some], k - 1)[k - 1] if k else 0
            below = some[loss[some] < edge]
            some = np.r_[below, some[loss[some] == edge][: k - len(below)]]
        else:
            some = some[np.argsort(loss[some], kind="stable")[:k]]
        choices, (points, start, end) = [], units
        for u in some.tolist():
            key = (int(slot[u]), n)
            paths = self.paths.get(key)
            if paths is None:
                paths = self.model.nbest(points[start[u] : end[u]], n)
                if end[u] - start[u] <= LONG and len(self.paths) < CACHE_PATHS:
                    self.paths[key] = paths
            choices.append((u, [(paths[0][0] - c, ids) for c, ids in paths]))
        out, queue, seen = [], [(0, (0,) * len(choices))], set()
        while queue and len(out) < n:
            lost, picks = heapq.heappop(queue)
            out.append((lost / UNIT, {u: ways[p][1] for (u, ways), p in zip(choices, picks) if p}))
            for c, p in enumerate(picks):
                nxt = (*picks[:c], p + 1, *picks[c + 1 :])
                if p + 1 < len(choices[c][1]) and nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(queue, (sum(ways[q][0] for (_, ways), q in zip(choices, nxt)), nxt))
        return out


_encoders: dict[str, Encoder] = {}


def encode_documents(docs: DataFrame, path: str, n: int = 4) -> DataFrame:
    """doc_id, ids (packed uint16), n_pieces, score, n_best, losses, round_trip.

    ``losses`` are the scores of the ``n`` best segmentations below the best one, the
    first 0; a text with fewer segmentations has fewer.  ``round_trip`` says that
    decoding the ids gave the text back.  Null and empty texts have no ids and one
    segmentation, the empty one.  Rows are encoded each by itself, repeated and null
    doc_ids too; an empty table gives an empty result; further columns are ignored.
    """

    def run(batches):
        encoder = _encoders.get(path)
        if encoder is None:
            encoder = _encoders[path] = Encoder(lattice(path), space_runs=True)
        for b in batches:
            column = b.column("text")
            for i, j in textops.chunks(textops.buffers(column)[0]):
                rows = []
                for ids, size, score, units, slot, same in encoder.texts([t or "" for t in column.slice(i, j - i).to_pylist()]):
                    best = encoder.nbest(units, slot, n)
                    rows.append((ids.tobytes(), size, round(score, 4), [round(x, 4) for x, _ in best], same))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(i, j - i),
                        pa.array(cols[0], pa.binary()),
                        pa.array(cols[1], pa.int64()),
                        pa.array(cols[2], pa.float64()),
                        pa.array([len(x) for x in cols[3]], pa.int32()),
                        pa.array(cols[3], pa.list_(pa.float64())),
                        pa.array(cols[4], pa.bool_()),
                    ],
                    ["doc_id", "ids", "n_pieces", "score", "n_best", "losses", "round_trip"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(textops.lean(run), "doc_id long, ids binary, n_pieces long, score double, n_best int, losses array<double>, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text from packed ids; null ids give a null text."""

    def run(batches):
        model = lattice(path)
        for b in batches:
            texts = [None if x is None else model.decode(np.frombuffer(x, np.uint16).tolist()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digest_columns(encoded: DataFrame) -> DataFrame:
    """The ids as their CRC-32 and the runner-up's loss as a column."""
    return encoded.select(
        "doc_id",
        "n_pieces",
        F.crc32("ids").alias("ids_crc32"),
        "score",
        "n_best",
        F.get("losses", F.lit(1)).alias("second_loss"),
        F.get("losses", F.col("n_best") - 1).alias("last_loss"),
        "round_trip",
    )
