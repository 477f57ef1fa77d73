"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of equal-token slots.  Slot i stands at the golden-ratio point
frac((i + 1) * phi); the point falls into one source's stretch of the cumulative
targets, so every stretch of the schedule holds each source near its share.  A
slot's rank among its source's slots names the block that fills it.

A source's documents, shuffled by a hash of their id, form one stream of tokens
that is cut into equal blocks.  Slot rank r takes block r; past the last block the
stream begins again, so a document is taken at most ``max_repeats`` times.  The
last slot of a source is cut so that exactly its target (rounded down) is taken.
Documents meet the slots in a join on source and block.

Positions come from two-level sums: documents fall into hash buckets of a source,
bucket totals are summed along the source, and a window runs inside a bucket only.
The number of buckets grows with the source's rows, so a source with a third of
all rows is spread like the others.  The schedule has about ``slots`` rows
whatever the input; blocks grow instead.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir, small_table

PHI = (math.sqrt(5) - 1) / 2
BUCKET_ROWS, MAX_BUCKETS = 256, 1 << 16
MIN_BLOCK = 64
MAX_SOURCES, SOURCE_SLOTS = 1_000_000, 16


def words_of(text):
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict, weights=(1, 2, 3), max_repeats: int = 3) -> dict:
    """Target of each source: weight shares of all tokens, none above max_repeats sizes.

    Sources take the weights in code-point order, null last, repeating.  What a
    cap cuts off goes to the others by weight until no source is above its cap.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), list(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * share > max_repeats * sizes[s]]
        if not over:
            return out | {s: weight[s] * share for s in open_}
        for s in over:
            out[s] = float(max_repeats * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def source_targets(spark: SparkSession, sized: DataFrame, weights, max_repeats) -> list[tuple]:
    """(source, n_docs, source_size, target); one a source, at most MAX_SOURCES of them, in order."""
    rows = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("t")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = targets({r.source: r.t for r in rows}, weights, max_repeats)
    return sorted(((r.source, r.n, r.t, found[r.source]) for r in rows), key=lambda r: (r[0] is None, r[0] or ""))


def mix(
    spark: SparkSession,
    docs: DataFrame,
    weights=(1, 2, 3),
    max_repeats: int = 3,
    slots: int = 1 << 16,
    seed: int = 7,
    keep: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """(taken, schedule).

    taken: doc_id, source, size, source_size, target, taken (tokens the mix takes
    of the document, repeats counted), and the columns of ``keep``.  schedule: slot, source, rank, block, pass_no,
    block_tokens, block_size.

    Null text has size 0; sizes of 0 take 0.  A null source is a source of its own,
    after all others.  Rows repeated with one doc_id follow each other in the stream
    in an order fixed by their size.  An empty table gives two empty results.  Only
    doc_id, text and source are read, and ``keep``.  There are ``slots`` slots, or
    SOURCE_SLOTS for each source if that is more; over MAX_SOURCES sources are an error,
    as the targets are worked out on the driver.
    """
    folder = shared_dir(spark)
    sized = materialise(
        spark, docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), *keep), folder, "sizes"
    )
    found = source_targets(spark, sized, weights, max_repeats)
    sources = small_table(spark, found, "source string, n_docs long, source_size long, target double")
    plan = schedule(spark, found, max(slots, SOURCE_SLOTS * len(found)))
    plan = materialise(spark, plan, folder, "schedule")
    return _taken(sized, sources, plan, seed, keep), plan


def schedule(spark: SparkSession, sources: list[tuple], slots: int) -> DataFrame:
    """The slots: slot, source, rank, block, pass_no, block_tokens, block_size.

    A slot's source is the one whose stretch of the cumulative targets holds the
    slot's golden-ratio point.  Ranks come from counts over runs of slots, then a
    window inside a run.  Points give a source its share up to a few slots; the last
    slot a source needs is cut to its target and those past it stay empty, while a
    source short of slots gets its rest at the end.
    """
    total = sum(target for *_, target in sources)
    if not total:
        return small_table(
            spark,
            [],
            "slot long, source string, rank long, block long, pass_no long, block_tokens long, block_size long",
        )
    block = max(MIN_BLOCK, math.ceil(total / slots))
    n = math.ceil(total / block)
    edges, upto = [], 0.0
    for source, _, size, target in sources:
        edges.append((source, upto / total, (upto + target) / total, size, math.floor(target)))
        upto += target
    stretch = small_table(spark, edges, "source string, lo double, hi double, source_size long, want long")
    point = F.expr(f"pmod((id + 1) * {PHI!r}D, 1D)")
    # Each point looks its source up in the sorted edges: cells of the unit interval
    # carry the stretches that touch them, so the lookup is an equi-join.
    cells = 4096
    touching = stretch.withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells))))
    )
    at = (
        spark.range(n)
        .select(F.col("id").alias("slot"), point.alias("_p"))
        .withColumn("_cell", F.floor(F.col("_p") * cells))
        .join(touching, "_cell")
        .where("_p >= lo AND _p < hi")
    )
    run = F.floor(F.col("slot") / 4096)
    at = at.withColumn("_run", run)
    by_source = Window.partitionBy("source").orderBy("_run")
    before = (
        at.groupBy("source", "_run")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(by_source) - F.col("_n"))
    )
    inside = at.withColumn("_in", F.row_number().over(Window.partitionBy("source", "_run").orderBy("slot")) - 1)
    ranked = inside.join(
        before.withColumnRenamed("source", "_s").withColumnRenamed("_run", "_r"),
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("_run") == F.col("_r")),
    ).withColumn("rank", (F.col("_before") + F.col("_in")).cast("long"))
    filled = ranked.select("slot", "source", "rank", "source_size", "want")
    # A source has ceil(size / block) blocks, the last one shorter, so it may need a
    # few slots more than its points gave it.
    blocks = F.ceil(F.col("source_size") / block)
    passes = F.floor(F.col("want") / F.col("source_size"))
    need = passes * blocks + F.ceil((F.col("want") - passes * F.col("source_size")) / block)
    have = filled.groupBy("source").agg(F.count(F.lit(1)).alias("_have"))
    short = (
        stretch.where("want > 0")
        .join(have.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
        .withColumn("_have", F.coalesce("_have", F.lit(0)))
        .withColumn("_need", need)
        .where("_have < _need")
        .withColumn("rank", F.explode(F.sequence(F.col("_have"), F.col("_need") - 1)))
        .select(F.lit(n).cast("long").alias("slot"), "source", F.col("rank").cast("long").alias("rank"), "source_size", "want")
    )
    pass_no, number = F.floor(F.col("rank") / blocks), F.pmod(F.col("rank"), blocks)
    begin = pass_no * F.col("source_size") + number * block
    length = F.least(F.lit(block).cast("long"), F.col("source_size") - number * block)
    return (
        filled.unionByName(short)
        .where(begin < F.col("want"))
        .select(
            "slot",
            "source",
            "rank",
            number.cast("long").alias("block"),
            pass_no.cast("long").alias("pass_no"),
            F.least(length, F.col("want") - begin).cast("long").alias("block_tokens"),
            F.lit(block).cast("long").alias("block_size"),
        )
    )


def _taken(sized: DataFrame, sources: DataFrame, plan: DataFrame, seed: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lay the documents out as their source's stream and join its blocks with the slots.

    A document's piece in a block is taken by every slot that takes the block whole,
    and by the one that takes its beginning only as far as that reaches.  The plan,
    summed by block, has no more rows than the schedule, which is bounded.
    """
    s = sources.withColumnRenamed("source", "_source")
    buckets = F.least(F.ceil(F.col("n_docs") / BUCKET_ROWS), F.lit(MAX_BUCKETS)).cast("long")
    keyed = (
        sized.join(F.broadcast(s), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_key", F.xxhash64("doc_id", F.lit(seed)))
        .withColumn("_bucket", F.pmod(F.shiftrightunsigned("_key", 24), buckets))
    )
    sums = keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    sums = sums.withColumn(
        "_before", F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("_sum")
    ).select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), "_before")
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size", *keep)
    laid = (
        keyed.withColumn("_in", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_at", F.col("_before") + F.col("_in"))
    )
    size = plan.agg(F.first("block_size")).first()[0] or MIN_BLOCK
    by_block = plan.groupBy(F.col("source").alias("_ps"), F.col("block").alias("_pb")).agg(
        F.collect_list("block_tokens").alias("_slots")
    )
    first, last = F.floor(F.col("_at") / size), F.floor((F.col("_at") + F.col("size") - 1) / size)
    base = ["doc_id", "source", "size", "source_size", "target", *keep]
    pieces = laid.where("size > 0").select(*base, "_at", F.explode(F.sequence(first, last)).alias("_block"))
    begin = F.greatest(F.lit(0), F.col("_at") - F.col("_block") * size)
    end = F.least(F.lit(size), F.col("_at") + F.col("size") - F.col("_block") * size)
    of_slot = F.aggregate(
        "_slots", F.lit(0).cast("long"), lambda a, x: a + F.greatest(F.lit(0), F.least(x, end) - begin).cast("long")
    )
    met = pieces.join(
        F.broadcast(by_block),
        F.col("source").eqNullSafe(F.col("_ps")) & (F.col("_block") == F.col("_pb")),
        "left",
    ).withColumn("_got", F.coalesce(of_slot, F.lit(0)))
    taken = met.groupBy(*base, "_at").agg(F.sum("_got").cast("long").alias("taken")).drop("_at")
    return taken.unionByName(laid.where("size = 0").select(*base, F.lit(0).cast("long").alias("taken")))
