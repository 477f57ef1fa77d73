"""Mutation logs: replay, recovery from a snapshot, and history as intervals.

``log`` has columns lsn, pos, op (put, delete, flushall), key, value, expire_at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import small_table


def newest(log: DataFrame, upto: int | None = None) -> DataFrame:
    """The last mutation of each key after the last flush, deletes included.

    The fold is one aggregation: partial results are combined before the shuffle, so a
    hot key costs one row a task.
    """
    rows = log if upto is None else log.where(F.col("lsn") <= upto)
    flush = rows.where("op = 'flushall'").agg(F.max(F.struct("lsn", "pos")).alias("_f"))
    after = rows.where("op <> 'flushall'").join(F.broadcast(flush)).where("_f IS NULL OR struct(lsn, pos) > _f")
    return (
        after.groupBy("key")
        .agg(F.max_by(F.struct("op", "value", "expire_at", "lsn"), F.struct("lsn", "pos")).alias("r"))
        .select("key", "r.op", "r.value", "r.expire_at", "r.lsn")
    )


def replay(log: DataFrame, upto: int | None = None) -> DataFrame:
    """The keyspace after the log, or after its records up to ``upto``."""
    return newest(log, upto).where("op = 'put'").select("key", "value", "expire_at")


def snapshot(log: DataFrame, lsn: int) -> DataFrame:
    """An image that holds everything up to ``lsn``."""
    return replay(log, lsn)


def recover(image: DataFrame, lsn: int, log: DataFrame) -> DataFrame:
    """A snapshot and the log records after it."""
    base = image.select(
        F.lit(lsn).cast("bigint").alias("lsn"), F.lit(-1).alias("pos"), F.lit("put").alias("op"), "key", "value", "expire_at"
    )
    return replay(base.unionByName(log.where(F.col("lsn") > lsn).select("lsn", "pos", "op", "key", "value", "expire_at")))


def history(log: DataFrame) -> DataFrame:
    """key, op, value, expire_at, valid_from, valid_to: a read at s sees valid_from < s <= valid_to.

    A record ends with the next one of its key or with the next flush, whichever comes
    first.  The numbers are cut into about as many cells as there are flushes, and a record
    meets the spans between flushes that reach its cell: about two, more where flushes lie in
    clumps, and never a list of all.
    """
    here = F.struct("lsn", "pos")
    flushes = log.where("op = 'flushall' AND lsn IS NOT NULL").select(here.alias("_until")).distinct()
    grid = flushes.agg(F.min("_until.lsn").alias("_first"), F.max("_until.lsn").alias("_last"), F.greatest(F.count("_until"), F.lit(1)).alias("_n"))
    grid = F.broadcast(grid.select("_first", F.expr("greatest(1L, _last div _n - _first div _n)").alias("_width")))
    spans = flushes.withColumn("_since", F.lag("_until").over(Window.orderBy("_until"))).join(grid)
    spans = spans.select("_since", "_until", F.explode(F.expr("sequence(coalesce(_since.lsn, _until.lsn) div _width, _until.lsn div _width)")).alias("_cell"))
    w = Window.partitionBy("key").orderBy("lsn", "pos")
    rows = log.where("op <> 'flushall'").withColumn("_next", F.lead("lsn").over(w))
    rows = rows.join(grid).withColumn("_cell", F.expr("lsn div _width")).withColumn("_here", here)
    rows = rows.join(spans, (rows["_cell"] == spans["_cell"]) & (F.col("_since").isNull() | (F.col("_since") <= F.col("_here"))) & (F.col("_here") < F.col("_until")), "left")
    flush = F.coalesce("_until.lsn", F.when(F.col("lsn") < F.col("_first"), F.col("_first")))
    return rows.select("key", "op", "value", "expire_at", F.col("lsn").alias("valid_from"), F.least("_next", flush).alias("valid_to"))


def dbsize_asof(log: DataFrame, lsns: list[int], now: int) -> DataFrame:
    """lsn, n: live keys after each of the given records."""
    asked = small_table(log.sparkSession, [(x,) for x in sorted(set(lsns))], "lsn bigint")
    h = history(log).where("op = 'put'").where((F.col("expire_at") == 0) | (F.col("expire_at") > now))
    met = h.join(F.broadcast(asked), (F.col("valid_from") <= F.col("lsn")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("lsn"))))
    # the history is counted where it is; it must not be the side that is sent to every task
    counts = met.groupBy("lsn").agg(F.count("key").alias("n"))
    return asked.join(counts, "lsn", "left").select("lsn", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def check(log: DataFrame) -> DataFrame:
    """lsn, problem: gaps and repeats in the numbering of records."""
    ids = log.select("lsn", "pos")
    twice = ids.groupBy("lsn", "pos").count().where("count > 1").select("lsn", F.lit("repeated").alias("problem"))
    some = ids.select("lsn").distinct()
    ends = some.agg(F.max("lsn").alias("_last"))
    gaps = (
        some.join(some.select((F.col("lsn") - 1).alias("lsn")), "lsn", "left_anti")
        .join(F.broadcast(ends))
        .where("lsn < _last")
        .select("lsn", F.lit("gap").alias("problem"))
    )
    return twice.unionByName(gaps)


def trim(log: DataFrame, lsn: int) -> DataFrame:
    """What must stay once a snapshot holds everything up to ``lsn``."""
    return log.where(F.col("lsn") > lsn)
