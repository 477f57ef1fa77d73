"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").encode().translate(LOWER))
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def jaccard_components(rows):
    sets = sets_of(rows)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if x and y and 100 * both >= 75 * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def united(pairs):
    """The smallest member of each member's component."""
    found = {}
    for a, b in pairs:
        one = found.get(a, {a}) | found.get(b, {b})
        for x in one:
            found[x] = one
    return {x: min(some) for x, some in found.items()}


def suffix_removed(rows, length=50):
    first = {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


def quality_counts(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    windows = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


_SECRET = [
    re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
    re.compile(r"AKIA[A-Z0-9]+"),
    re.compile(r"[0-9a-f]+"),
]


def secret_spans(text):
    keep = [lambda m: len(m[2]) >= 12, lambda m: len(m[0]) >= 18, lambda m: len(m[0]) >= 16]
    return sorted((m.start(), k, m.end()) for k, rx in enumerate(_SECRET) for m in rx.finditer(text or "") if keep[k](m))
