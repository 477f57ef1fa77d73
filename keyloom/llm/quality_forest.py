"""Quality rules with an isolation forest over their statistics.

Each whole text is reduced to counts (words, characters in words, symbols, repeated
lines, words in repeated 5-word windows and a few more).  Fixed rules fail the plain
cases.  An isolation forest gives every other document the mean path length over random
splits: documents that few splits isolate are anomalous.  Each tree draws its rows from
all documents labelled good, as the method has it; the box that splits fall in and the
cut-off come from every labelled document, so that at most ``max_loss`` of the documents
labelled good fall below it.

The statistics are computed once for all rows, in Arrow batches, and kept in the shared
folder; the forest is a few arrays of fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops
from .common import materialise, shared_dir

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_pipes", "n_marks", "n_lines")
#: A tree isolates TREE_ROWS rows; no two trees draw the same row while there are enough.
TREES, TREE_ROWS, DEPTH, MAX_LOSS, SEED = 100, 256, 14, 0.005, 11
#: Scores are whole numbers of this, so that they are alike on all machines.
UNIT = 10**9

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CONT = (np.arange(256) & 0xC0) == 0x80


def _per_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[at[1:]] - sums[at[:-1]]


def counts_of(column: pa.Array) -> np.ndarray:
    """One row of COUNTS for each text; null and empty texts give zeros."""
    offsets, text = textops.buffers(column)
    out = np.zeros((len(column), len(COUNTS)), dtype=np.int64)
    for i, j in textops.chunks(offsets):
        at = offsets[i : j + 1] - offsets[i]
        part = text[offsets[i] : offsets[j]]
        if not len(part):
            continue
        start, end, doc = textops.words(at, part)
        sums = textops.prefix_hash(part)
        edge = np.searchsorted(doc, np.arange(j - i + 1))
        points = np.concatenate([[0], np.cumsum(~_CONT[part])])
        o = out[i:j]
        o[:, 0] = np.diff(edge)
        o[:, 1] = np.bincount(doc, points[end] - points[start], minlength=j - i)
        o[:, 2] = _per_doc(_SYMBOL[part], at)
        o[:, 5] = _per_doc((part >= 65) & (part <= 90), at)
        o[:, 6] = _per_doc((part >= 48) & (part <= 57), at)
        o[:, 7] = _per_doc(part == 124, at)
        o[:, 8] = _per_doc(part == 33, at)
        runs = textops.window_hash(textops.range_hash(sums, start, end), 5)
        # Lines: ends at each \n and at the end of each document.
        breaks = np.flatnonzero(part == 10)
        ends = np.unique(np.concatenate([breaks, at[1:][at[1:] > at[:-1]]]))
        begins = np.concatenate([[0], ends[:-1]])
        begins = begins + (part[np.minimum(begins, len(part) - 1)] == 10) * (begins < ends)
        first = np.searchsorted(at, begins, side="right") - 1
        begins = np.maximum(begins, at[first])
        has = np.searchsorted(start, ends) > np.searchsorted(start, begins)
        begins, ends = begins[has], ends[has]
        line_doc = np.searchsorted(at, begins, side="right") - 1
        line = textops.range_hash(sums, begins, ends)
        line_edge = np.searchsorted(line_doc, np.arange(j - i + 1))
        o[:, 9] = np.diff(line_edge)
        for d in range(j - i):
            a, b = line_edge[d], line_edge[d + 1]
            if b - a > 1:
                o[d, 3] = b - a - len(np.unique(line[a:b]))
            a, b = edge[d], edge[d + 1] - 4
            if b - a > 1:
                _, back, often = np.unique(runs[a:b], return_inverse=True, return_counts=True)
                hit = often[back] > 1
                if hit.any():
                    cover = np.zeros(b - a + 5, dtype=np.int64)
                    np.add.at(cover, np.flatnonzero(hit), 1)
                    np.add.at(cover, np.flatnonzero(hit) + 5, -1)
                    o[d, 4] = int((np.cumsum(cover) > 0).sum())
    return out


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


def features(counts: np.ndarray) -> np.ndarray:
    """What the forest splits: shares of the counts, so that length says nothing by itself."""
    c = counts.astype(np.float64)
    n, chars = np.maximum(c[:, 0], 1), np.maximum(c[:, 1], 1)
    shares = [c[:, 2] / n, c[:, 3] / np.maximum(c[:, 9], 1), c[:, 4] / n, c[:, 5] / chars, c[:, 6] / chars, c[:, 7] / n, c[:, 8] / n]
    return np.sqrt(np.stack([np.minimum(chars / n, 50) / 50, *(np.minimum(s, 1) for s in shares)], axis=1))


class IsolationForest:
    """Trees as arrays: feature (-1 at a leaf), cut, children, path length at a leaf."""

    def __init__(self, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        if len(rows) < trees * tree_rows:
            drawn = [rng.permutation(len(rows))[:tree_rows] for _ in range(trees)]
        else:
            drawn = rng.permutation(len(rows))[: trees * tree_rows].reshape(trees, tree_rows)
        self.trees = [self._grow(rows[d], lo, hi, rng) for d in drawn]
        self.norm = max(_mean_path(min(tree_rows, len(rows))), 1e-9)

    @staticmethod
    def _grow(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, rng) -> tuple:
        """Cuts fall anywhere in a node's box, not just between its rows, so that space
        without rows, where the documents to be found lie, is cut off early."""
        feature, cut, left, right, path = [], [], [], [], []
        usable = np.flatnonzero(hi > lo)

        def node(part: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> int:
            me = len(feature)
            for a in (feature, cut, left, right, path):
                a.append(0)
            if depth >= DEPTH or len(part) <= 1 or not len(usable):
                feature[me], path[me] = -1, depth + _mean_path(len(part))
                return me
            f = int(rng.choice(usable))
            c = float(rng.uniform(lo[f], hi[f]))
            feature[me], cut[me] = f, c
            below, above = hi.copy(), lo.copy()
            below[f] = above[f] = c
            left[me] = node(part[part[:, f] < c], lo, below, depth + 1)
            right[me] = node(part[part[:, f] >= c], above, hi, depth + 1)
            return me

        node(rows, lo, hi, 0)
        return tuple(np.array(a) for a in (feature, cut, left, right, path))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly between 0 and 1; larger is easier to isolate."""
        total = np.zeros(len(rows))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(rows), dtype=np.int64)
            open_ = np.flatnonzero(feature[at] >= 0)
            while len(open_):
                k = at[open_]
                at[open_] = np.where(rows[open_, feature[k]] < cut[k], left[k], right[k])
                open_ = open_[feature[at[open_]] >= 0]
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def _mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _stats(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            c = counts_of(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c[:, k]) for k in range(len(COUNTS)))], ["doc_id", *COUNTS]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    )


def _scores(forest: IsolationForest, counts: np.ndarray) -> np.ndarray:
    return np.rint(forest.score(features(counts)) * UNIT).astype(np.int64)


def _batch_counts(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(c).to_numpy() for c in COUNTS], axis=1) if len(b) else np.zeros((0, len(COUNTS)), dtype=np.int64)


def _box(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest of each feature over all labelled rows."""
    n = len(features(np.zeros((1, len(COUNTS)), dtype=np.int64))[0])

    def run(batches):
        for b in batches:
            if len(b):
                x = features(_batch_counts(b))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(n), pa.int32()), pa.array(x.min(0)), pa.array(x.max(0))], ["k", "lo", "hi"]
                )

    found = labelled.select(*COUNTS).mapInArrow(run, "k int, lo double, hi double")
    rows = found.groupBy("k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("k").collect()
    return np.array([r["lo"] for r in rows]), np.array([r["hi"] for r in rows])


def _place(scored: DataFrame, rank: int) -> int:
    """The score with ``rank`` scores before it in order; counts of 1,000 ranges at a time go to the driver."""
    low, width = 0, UNIT * 1000
    while width > 1:
        width //= 1000
        rows = scored.where(F.col("score").between(low, low + 1000 * width - 1)).groupBy(F.expr(f"(score - {low}) div {width}").alias("k")).count()
        for k, n in sorted((r["k"], r["count"]) for r in rows.collect()):
            if rank < n:
                low += k * width
                break
            rank -= n
    return low


def fit(spark: SparkSession, stats: DataFrame, labels: DataFrame, max_loss: float = MAX_LOSS):
    """(forest, cut-off in units of the score) from all labelled documents.

    The trees see documents labelled good, so that what differs from them is what
    few splits isolate: every tree draws its rows, in hash order, from all of them.
    Where bad ones score clearly above the good, the cut-off lies as low as
    ``max_loss`` of the good allows, counted over all of them.  Without labelled good
    documents there is no forest and every document passes.
    """
    folder = shared_dir(spark)
    given = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = materialise(spark, stats.join(given, "doc_id"), folder, "labelled")
    good = labelled.where("quality = 1 AND n_words >= 10 AND 100 * n_repeat_words <= 20 * n_words")
    drawn = good.orderBy(F.xxhash64("doc_id", *COUNTS, F.lit(SEED)), "doc_id", *COUNTS).limit(TREES * TREE_ROWS).select(*COUNTS).toArrow()
    if not len(drawn):
        return None, UNIT
    lo, hi = _box(labelled)
    forest = IsolationForest(features(np.stack([drawn[c].to_numpy() for c in COUNTS], axis=1)), lo, hi)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_scores(forest, _batch_counts(b)))], ["score"])

    scored = materialise(spark, good.select(*COUNTS).mapInArrow(run, "score long"), folder, "scored")
    return forest, _place(scored, int(np.ceil((scored.count() - 1) * (1 - max_loss))))


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the counts, base_failed, anomaly, kept; one row for each document.

    Null and empty texts have no words and fail the base rules.  Rows repeated with
    one doc_id are judged each by itself, null doc_ids too.  Only doc_id and text of
    ``docs`` and doc_id and quality of ``labels`` are read.  A document with several
    labels counts as good only if all of them are.  An empty table gives an empty
    result.
    """
    stats = materialise(spark, _stats(docs), shared_dir(spark), "stats")
    forest, cut = fit(spark, stats, labels, **options)

    def run(batches):
        for b in batches:
            c = _batch_counts(b)
            failed = base_failed(c)
            odd = np.zeros(len(c), dtype=np.int64) if forest is None else _scores(forest, c)
            kept = ~failed & (odd <= cut)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(failed), pa.array(odd / UNIT), pa.array(kept)], [*b.schema.names, "base_failed", "anomaly", "kept"]
            )

    kinds = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, kept boolean"
    return stats.mapInArrow(run, kinds)
