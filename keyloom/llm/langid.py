"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a text's bytes, one from either side.  Their states
together label every byte position with a probability for each language, and a
document's probabilities are the mean over the positions of all its words.

Texts are read word by word: a sequence is one run of non-space bytes, with states
starting anew, so that a word's labels are the same wherever it stands.  A worker
therefore runs the network once for each different word and adds up the results for
every occurrence, whole texts always.  A run of more than ``MAX_BYTES`` is labelled in
pieces that begin and end between characters; each is read with ``CONTEXT`` bytes on
either side, which prepare the states and are labelled with their own pieces.

The network is trained here, in numpy, by backpropagation through time, on a bounded
sample of labelled documents; weights are plain arrays of fixed size.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops

#: Bounds of the training sample: documents of each language, and words of each document.
SAMPLE_DOCS, SAMPLE_WORDS = 250, 30
MAX_BYTES, CONTEXT, EMBED, HIDDEN = 24, 12, 8, 12
EPOCHS, BATCH, RATE, SEED = 5, 256, 0.01, 5
#: Rows of (doc_id, lang) that every task may get; a larger sample meets the texts by shuffle.
BROADCAST_ROWS = 100_000
#: Words whose results a worker keeps.
CACHE_WORDS = 500_000
#: Bytes of text looked at in one go; of a longer text, one part after the other.
PART_BYTES = 1 << 20

_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Gru:
    """Gated recurrent layer: u keeps the old state, r gates it into the candidate."""

    def __init__(self, rng):
        scale = 1 / np.sqrt(HIDDEN)
        self.p = {
            "wx": rng.normal(0, scale, (EMBED, 3 * HIDDEN)),
            "wh": rng.normal(0, scale, (HIDDEN, 2 * HIDDEN)),
            "wc": rng.normal(0, scale, (HIDDEN, HIDDEN)),
            "b": np.zeros(3 * HIDDEN),
        }

    def forward(self, xs: np.ndarray, mask: np.ndarray):
        """States (n, L, H) for inputs xs (n, L, 3H: already wx x + b); masked steps keep the state."""
        n, length, _ = xs.shape
        h, keep, states = np.zeros((n, HIDDEN)), [], np.zeros((n, length, HIDDEN))
        for t in range(length):
            g = _sigmoid(xs[:, t, : 2 * HIDDEN] + h @ self.p["wh"])
            u, r = g[:, :HIDDEN], g[:, HIDDEN:]
            c = np.tanh(xs[:, t, 2 * HIDDEN :] + (r * h) @ self.p["wc"])
            new = u * h + (1 - u) * c
            new = np.where(mask[:, t, None], new, h)
            keep.append((h, u, r, c))
            states[:, t] = h = new
        return states, keep

    def backward(self, d_states: np.ndarray, keep, mask: np.ndarray):
        """Gradients of the weights and of the inputs, going back through time."""
        n, length, _ = d_states.shape
        grad = {k: np.zeros_like(v) for k, v in self.p.items() if k in ("wh", "wc")}
        d_xs, d_h = np.zeros((n, length, 3 * HIDDEN)), np.zeros((n, HIDDEN))
        for t in reversed(range(length)):
            h, u, r, c = keep[t]
            d_new = (d_h + d_states[:, t]) * mask[:, t, None]
            d_pass = (d_h + d_states[:, t]) * ~mask[:, t, None]
            d_c = d_new * (1 - u) * (1 - c * c)
            d_u = d_new * (h - c) * u * (1 - u)
            d_rh = d_c @ self.p["wc"].T
            d_r = d_rh * h * r * (1 - r)
            d_g = np.concatenate([d_u, d_r], axis=1)
            grad["wc"] += (r * h).T @ d_c
            grad["wh"] += h.T @ d_g
            d_xs[:, t] = np.concatenate([d_g, d_c], axis=1)
            d_h = d_pass + d_new * u + d_rh * r + d_g @ self.p["wh"].T
        return grad, d_xs


class Network:
    """Byte embedding, two layers, a softmax at every position."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embed = rng.normal(0, 0.5, (256, EMBED))
        self.layers = [Gru(rng), Gru(rng)]
        self.out = rng.normal(0, 0.3, (2 * HIDDEN, len(languages)))
        self.bias = np.zeros(len(languages))

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.out, self.bias, *(self.layers[k].p[n] for k in (0, 1) for n in sorted(self.layers[k].p))]

    def step(self, data: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the positions and its gradients, in the order of weights()."""
        both, kept, xs = [], [], []
        for k, layer in enumerate(self.layers):
            seen, held = (data, mask) if k == 0 else (data[:, ::-1], mask[:, ::-1])
            x = self.embed[seen]
            states, keep = layer.forward(x @ layer.p["wx"] + layer.p["b"], held)
            both.append(states if k == 0 else states[:, ::-1])
            kept.append(keep)
            xs.append((seen, held, x))
        state = np.concatenate(both, axis=2)
        logit = state @ self.out + self.bias
        logit -= logit.max(2, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(2, keepdims=True)
        n = mask.sum()
        loss = -np.log(np.take_along_axis(p, label[:, None, None], 2)[:, :, 0] + 1e-12)[mask].sum() / n
        d = p.copy()
        np.put_along_axis(d, np.broadcast_to(label[:, None, None], (*mask.shape, 1)), np.take_along_axis(p, np.broadcast_to(label[:, None, None], (*mask.shape, 1)), 2) - 1, 2)
        d *= mask[:, :, None] / n
        d_out = np.einsum("nlh,nlc->hc", state, d)
        d_state = d @ self.out.T
        d_embed, found = np.zeros_like(self.embed), []
        for k, layer in enumerate(self.layers):
            seen, held, x = xs[k]
            part = d_state[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            grad, d_xs = layer.backward(part if k == 0 else part[:, ::-1], kept[k], held)
            grad["wx"] = np.einsum("nle,nlg->eg", x, d_xs)
            grad["b"] = d_xs.sum((0, 1))
            np.add.at(d_embed, seen.reshape(-1), (d_xs @ layer.p["wx"].T).reshape(-1, EMBED))
            found += [grad[name] for name in sorted(layer.p)]
        return loss, [d_embed, d_out, d.sum((0, 1)), *found]

    def train(self, sequences: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Adam over shuffled batches of sequences of like length."""
        rng = np.random.default_rng(seed)
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights()]
        data, mask = _padded(sequences)
        length = mask.sum(1)
        step = 0
        for epoch in range(epochs):
            order = np.lexsort((rng.random(len(data)), length))
            batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
            rng.shuffle(batches)
            for rows in batches:
                n = length[rows].max()
                _, grads = self.step(data[rows, :n], mask[rows, :n], labels[rows])
                step += 1
                rate = RATE * (1 - 0.9 * (step / (epochs * len(batches)))) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for w, g, (m, v) in zip(self.weights(), grads, moments):
                    g = np.clip(g, -1, 1)
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * m / (np.sqrt(v) + 1e-8)

    def frozen(self) -> tuple:
        """Arrays for ``label``: the input side of either layer as a table by byte."""
        f = np.float32
        return (
            self.languages,
            [(self.embed @ a.p["wx"] + a.p["b"]).astype(f) for a in self.layers],
            [a.p["wh"].astype(f) for a in self.layers],
            [a.p["wc"].astype(f) for a in self.layers],
            self.out.astype(f),
            self.bias.astype(f),
        )


def _padded(sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(s) for s in sequences])
    data = np.zeros((len(sequences), max(length, default=1)), dtype=np.uint8)
    mask = np.arange(data.shape[1]) < length[:, None]
    data[mask] = np.frombuffer(b"".join(sequences), np.uint8)
    return data, mask


def _between(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each place moved back to where a character begins, three bytes at most."""
    for _ in range(3):
        at = at - ((at < len(text)) & (at > 0) & (text[np.minimum(at, len(text) - 1)] & 0xC0 == 0x80))
    return at


def sequences(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(run, first, last, from, to) of the pieces of runs: bytes first to last are read, from to to labelled."""
    run = np.arange(len(start))
    if not len(start) or (end - start).max() <= MAX_BYTES:
        return run, start, end, start, end
    pieces = -(-(end - start) // MAX_BYTES)
    run = np.repeat(run, pieces)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lo = np.maximum(start[run], np.where(nth > 0, _between(text, start[run] + nth * MAX_BYTES), start[run]))
    hi = np.where(nth + 1 < pieces[run], _between(text, np.minimum(start[run] + (nth + 1) * MAX_BYTES, end[run])), end[run])
    first = np.maximum(start[run], _between(text, np.maximum(lo - CONTEXT, 0)))
    last = np.maximum(hi, _between(text, np.minimum(hi + CONTEXT, end[run])))
    whole = pieces[run] == 1
    first, last = np.where(whole, lo, first), np.where(whole, hi, last)
    some = hi > lo
    return run[some], first[some], last[some], lo[some], hi[some]


def label(frozen: tuple, data: np.ndarray, length: np.ndarray, begin=0, stop=None) -> np.ndarray:
    """Sum over the positions of each sequence of its languages' probabilities.

    data: (n, L) bytes, length: sizes from 1 to L; positions begin to stop are summed.
    """
    stop = length if stop is None else stop
    languages, tables, wh, wc, out, bias = frozen
    n, width = data.shape
    h2 = 2 * HIDDEN
    logits = np.empty((width, n, len(languages)), dtype=np.float32)
    for k in (0, 1):
        h = np.zeros((n, HIDDEN), dtype=np.float32)
        for t in range(width) if k == 0 else reversed(range(width)):
            x = tables[k][data[:, t]]
            g = h @ wh[k]
            g += x[:, :h2]
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            u, r = g[:, :HIDDEN], g[:, HIDDEN:]
            c = (r * h) @ wc[k]
            c += x[:, h2:]
            np.tanh(c, out=c)
            new = c + u * (h - c)
            h = new if k == 0 else np.where((t < length)[:, None], new, h)
            part = h @ out[k * HIDDEN : (k + 1) * HIDDEN]
            if k == 0:
                logits[t] = part + bias
            else:
                logits[t] += part
    np.exp(logits, out=logits)
    logits /= logits.sum(2, keepdims=True)
    place = np.arange(width)[:, None]
    logits *= ((place >= begin) & (place < stop))[:, :, None]
    return logits.sum(0)


class Labeller:
    """Pools position labels by document; keeps the results of words already seen."""

    def __init__(self, frozen: tuple):
        self.frozen = frozen
        self.n = len(frozen[0])
        self.keys = np.empty(0, np.uint64)
        self.sums = np.empty((0, self.n), np.float32)

    def _sums(self, text: np.ndarray, first, last, lo, hi) -> np.ndarray:
        out = np.empty((len(first), self.n), dtype=np.float32)
        size = last - first
        order = np.argsort(size, kind="stable")
        for a in range(0, len(order), 4096):
            rows = order[a : a + 4096]
            at = np.minimum(first[rows][:, None] + np.arange(int(size[rows].max())), len(text) - 1)
            out[rows] = label(self.frozen, text[at], size[rows], lo[rows] - first[rows], hi[rows] - first[rows])
        return out

    def _add(self, total: np.ndarray, letters: np.ndarray, at: np.ndarray, part: np.ndarray) -> None:
        """Adds the sums of texts laid end to end, cut at ``at``, and notes those with a letter."""
        start, end, doc = textops.words(at, part)
        run, first, last, lo, hi = sequences(part, start, end)
        doc = doc[run]
        key = textops.range_hash(textops.prefix_hash(part), first, last)
        cut = (first < lo) | (hi < last)
        key[cut] = textops.mix64(key[cut] ^ ((lo - first)[cut] << 16 | (hi - first)[cut]).astype(np.uint64))
        unique, one, back = np.unique(key, return_index=True, return_inverse=True)
        where = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), dtype=bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == unique[inside]
        sums = np.empty((len(unique), self.n), np.float32)
        sums[known] = self.sums[where[known]]
        fresh = one[~known]
        sums[~known] = self._sums(part, first[fresh], last[fresh], lo[fresh], hi[fresh])
        if len(self.keys) + len(fresh) <= CACHE_WORDS:
            self.keys = np.insert(self.keys, where[~known], unique[~known])
            self.sums = np.insert(self.sums, where[~known], sums[~known], axis=0)
        for c in range(self.n):
            total[:, c] += np.bincount(doc, sums[back, c], minlength=len(total))
        flags = np.concatenate([[0], np.cumsum(_ASCII_LETTER[part], dtype=np.int32)])
        letters |= flags[at[1:]] > flags[at[:-1]]

    def pooled(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(mean probabilities by document, whether it has a letter)."""
        offsets, text = textops.buffers(column)
        total, letters = np.zeros((len(column), self.n)), np.zeros(len(column), dtype=bool)
        for i, j in textops.chunks(offsets, PART_BYTES):
            for a, b in textops.parts(text, offsets[i], offsets[j], PART_BYTES) if j == i + 1 else ((offsets[i], offsets[j]),):
                if b > a:
                    self._add(total[i:j], letters[i:j], np.clip(offsets[i : j + 1], a, b) - a, text[a:b])
        for d in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
            letters[d] = bool(_LETTER.search(column[int(d)].as_py()))
        weight = total.sum(1, keepdims=True)
        return np.divide(total, weight, out=np.zeros_like(total), where=weight > 0), letters


_labellers: dict = {}


def held_out(doc_id):
    """Whether a document is kept from training: crc32 of its id's digits mod 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(spark: SparkSession, docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> tuple:
    """A trained network, as arrays; learns from text and lang of documents not held out.

    The sample: of every language the ``sample_docs`` documents first in hash order,
    and of each of them ``sample_words`` words drawn over its whole text.
    """
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    ids = labelled.select("doc_id", "lang").distinct()
    # one pass: a document goes on if its hash is under a threshold that leaves its language several times the sample
    count = ids.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
    key = F.xxhash64("doc_id", F.lit(SEED))
    near = ids.join(count, F.col("lang") == F.col("_lang")).where(F.pmod(key, F.lit(1 << 40)) * F.col("_n") < float((4 * sample_docs + 64) << 40))
    first = Window.partitionBy("lang").orderBy(F.pmod(key, F.lit(1 << 40)), "doc_id")
    chosen = near.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= sample_docs).select("doc_id", "lang")

    def draw(batches):
        for b in batches:
            rows, langs, ids_ = [], [], []
            for d, lang, text in zip(b.column("doc_id").to_pylist(), b.column("lang").to_pylist(), b.column("text").to_pylist()):
                found = text.encode().split()
                rng = np.random.default_rng(zlib.crc32(str(d).encode()))
                for k in np.sort(rng.permutation(len(found))[:sample_words]):
                    word = np.frombuffer(found[k], np.uint8)
                    _, first, last, _, _ = sequences(word, np.array([0]), np.array([len(word)]))
                    one = rng.integers(len(first))  # of a long run, one piece drawn over all of it
                    rows.append(found[k][first[one] : last[one]])
                    langs.append(lang)
                    ids_.append(d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids_, pa.int64()), pa.array(langs, pa.string()), pa.array(rows, pa.binary())], ["doc_id", "lang", "word"]
            )

    if count.count() * sample_docs <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    picked = labelled.select(F.col("doc_id").cast("long"), "lang", "text").join(chosen, ["doc_id", "lang"], "left_semi")
    got = picked.mapInArrow(textops.lean(draw), "doc_id long, lang string, word binary").orderBy("doc_id", "lang", "word").toArrow()
    names = sorted(set(got["lang"].to_pylist()))
    if not names:
        return (["und"], *Network(["und"]).frozen()[1:])
    words, lang = got["word"].to_pylist(), np.array([names.index(x) for x in got["lang"].to_pylist()])
    # every language counts alike: short samples are repeated
    most = np.bincount(lang).max()
    rows = np.concatenate([np.resize(np.flatnonzero(lang == k), most) for k in range(len(names))])
    network = Network(names)
    network.train([words[k] for k in rows], lang[rows])
    return network.frozen()


def language(spark: SparkSession, docs: DataFrame, frozen: tuple | None = None, carry: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score; one row for each document.

    With ``carry`` the row is instead a struct ``_row`` of all columns of ``docs``, whatever
    their names, beside held_out, lang_pred and score.

    ``und`` with score 0 where the text is null or has no letter.  Equal scores go
    to the language first by code point.  Null doc_ids aren't held out and never
    learned from.  Predictions read the text alone; without labelled documents all
    are ``und``.  An empty table gives an empty result.
    """
    frozen = frozen or fit(spark, docs)
    names = np.array([*frozen[0], "und"])
    token = zlib.crc32(b"".join(w.tobytes() for w in (*frozen[1], frozen[4])))

    def predict(text: pa.Array) -> pa.Array:
        labeller = _labellers.get(token)
        if labeller is None:
            _labellers.clear()
            labeller = _labellers[token] = Labeller(frozen)
        p, letters = labeller.pooled(text)
        textops.give_back()
        p = np.round(p, 5)
        best = p.argmax(1) if len(p) else np.zeros(0, np.int64)
        score = np.where(letters, p[np.arange(len(p)), best], 0.0)
        best = np.where(letters, best, len(names) - 1)
        return pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score)], ["lang_pred", "score"])

    # Only texts go to Python. Not deterministic as far as Catalyst is concerned: a filter on
    # the result must not be a reason to run it twice.
    found = F.arrow_udf(predict, "lang_pred string, score double").asNondeterministic()
    first = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row") if carry else F.col("doc_id").cast("long")
    rows = docs.select(first, held_out(F.col("doc_id")).alias("held_out"), found(F.col("text").cast("string")).alias("_found"))
    return rows.select("_row" if carry else "doc_id", "held_out", "_found.lang_pred", "_found.score")
