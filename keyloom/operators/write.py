"""Set-mode writers: each maps a keyspace and a batch of changes to a new keyspace.

Batches hold at most one change a key, unless the operator says otherwise; logs with
several go through ``plans.log`` or ``plans.commands``.  Absent keys read as null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from .read import live


def _matched(ks: DataFrame, batch: DataFrame, now: int) -> DataFrame:
    """All keys of either side: k_value, k_expire_at of the live record, and the batch's columns."""
    old = live(ks, now).select("key", F.col("value").alias("k_value"), F.col("expire_at").alias("k_expire_at"))
    return old.join(batch.withColumn("_in", F.lit(True)), "key", "full_outer")


def put_all(ks: DataFrame, batch: DataFrame) -> DataFrame:
    """MSET: batch (pos, key, value); of repeated keys the last stays; expiries are cleared."""
    last = batch.groupBy("key").agg(F.max_by("value", "pos").alias("value"))
    new = last.withColumn("expire_at", F.lit(0).cast("bigint"))
    return ks.select("key", "value", "expire_at").join(new, "key", "left_anti").unionByName(new)


def set_if(ks: DataFrame, batch: DataFrame, now: int, mode: str = "", keep_ttl: bool = False) -> DataFrame:
    """SET with NX, XX and KEEPTTL over batch (key, value, expire_at).

    Returns key, value, expire_at, old_value (null if absent) and written.
    """
    m = _matched(ks, batch, now)
    there = F.col("k_expire_at").isNotNull()
    asked = F.coalesce(F.col("_in"), F.lit(False))
    writes = asked & {"": F.lit(True), "nx": ~there, "xx": there}[mode]
    expire = F.coalesce("k_expire_at", F.lit(0)) if keep_ttl else F.coalesce("expire_at", F.lit(0))
    return m.select(
        "key",
        F.when(writes, F.col("value")).otherwise(F.col("k_value")).alias("value"),
        F.when(writes, expire).otherwise(F.col("k_expire_at")).cast("bigint").alias("expire_at"),
        F.col("k_value").alias("old_value"),
        writes.alias("written"),
    )


def setnx_all(ks: DataFrame, batch: DataFrame, now: int) -> DataFrame:
    """Inserts the keys that are not live."""
    fresh = batch.join(live(ks, now), "key", "left_anti")
    new = fresh.select("key", "value", F.lit(0).cast("bigint").alias("expire_at"))
    return live(ks, now).select("key", "value", "expire_at").unionByName(new)


def msetnx(ks: DataFrame, batch: DataFrame, now: int) -> DataFrame:
    """All of the batch (pos, key, value) if none of its keys is live, else nothing."""
    blocked = batch.join(live(ks, now), "key", "left_semi").agg((F.count(F.lit(1)) > 0).alias("_blocked"))
    last = batch.groupBy("key").agg(F.max_by("value", "pos").alias("value"))
    new = last.join(F.broadcast(blocked)).where(~F.col("_blocked")).select("key", "value", F.lit(0).cast("bigint").alias("expire_at"))
    return live(ks, now).select("key", "value", "expire_at").unionByName(new)


def delete_all(ks: DataFrame, asked: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(what stays, count n of live keys removed); a key asked twice counts once."""
    gone = asked.select("key").distinct()
    left = live(ks, now).join(gone, "key", "left_anti")
    return left, live(ks, now).join(gone, "key", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def append_all(ks: DataFrame, batch: DataFrame, now: int) -> DataFrame:
    """key, value, expire_at, n: suffixes (key, suffix) put behind the values."""
    m = _matched(ks, batch, now)
    kind = ks.schema["value"].dataType
    value = F.concat(F.coalesce(F.col("k_value"), F.lit("").cast(kind)), F.coalesce(F.col("suffix").cast(kind), F.lit("").cast(kind)))
    return m.select("key", value.alias("value"), F.coalesce("k_expire_at", F.lit(0)).cast("bigint").alias("expire_at"), F.octet_length(value).cast("bigint").alias("n"))


def incr_by(ks: DataFrame, batch: DataFrame, now: int) -> DataFrame:
    """key, value, expire_at, status: batch (key, delta) added; status is ok, not_integer or overflow.

    A missing key counts as 0; on an error the value stays.  Keys that the batch doesn't
    name stay as they are, with a null status; all keep their expiry.
    """
    m = _matched(ks, batch, now)
    old = F.when(F.col("k_value").isNull(), F.lit(0)).otherwise(exprs.strict_int(F.col("k_value").cast("string")))
    new = F.when(F.col("_in"), F.try_add(old, F.col("delta")))
    status = F.when(F.col("_in").isNull(), F.lit(None)).when(old.isNull(), "not_integer").when(new.isNull(), "overflow").otherwise("ok")
    value = F.coalesce(new.cast("string").cast(ks.schema["value"].dataType), F.col("k_value"))
    return m.select("key", value.alias("value"), F.coalesce("k_expire_at", F.lit(0)).cast("bigint").alias("expire_at"), status.alias("status"))


def set_range(ks: DataFrame, offset: int, patch: bytes, now: int) -> DataFrame:
    v = exprs.set_range(F.col("value").cast("binary"), offset, patch)
    return live(ks, now).select("key", v.alias("value"), "expire_at")


def expire(ks: DataFrame, batch: DataFrame, now: int, mode: str = "") -> DataFrame:
    """key, expire_at, applied for batch (key, deadline) under NX, XX, GT or LT.

    A key without expiry counts as one that never ends: GT never applies to it, LT
    always.  Deadlines not after ``now`` delete: expire_at is null then.
    """
    e, d = F.col("expire_at"), F.col("deadline")
    may = {
        "": F.lit(True),
        "nx": e == 0,
        "xx": e != 0,
        "gt": (e != 0) & (d > e),
        "lt": (e == 0) | (d < e),
    }[mode]
    m = live(ks, now).join(batch, "key", "left")
    applied = d.isNotNull() & may
    return m.select(
        "key",
        F.when(applied, F.when(d <= now, F.lit(None)).otherwise(d)).otherwise(e).cast("bigint").alias("expire_at"),
        applied.alias("applied"),
    )


def persist(ks: DataFrame, now: int) -> DataFrame:
    """key, expire_at (0), had_ttl."""
    return live(ks, now).select("key", F.lit(0).cast("bigint").alias("expire_at"), (F.col("expire_at") != 0).alias("had_ttl"))


def rename(ks: DataFrame, moves: DataFrame, now: int) -> DataFrame:
    """Moves (src, dst) of distinct keys: records go with their expiry and replace dst."""
    alive = live(ks, now).select("key", "value", "expire_at")
    moved = alive.join(moves, alive.key == moves.src).select(F.col("dst").alias("key"), "value", "expire_at")
    hit = moves.join(alive.select(F.col("key").alias("src")), "src", "left_semi")
    gone = hit.select(F.col("src").alias("key")).unionByName(hit.select(F.col("dst").alias("key"))).distinct()
    return alive.join(gone, "key", "left_anti").unionByName(moved)


def copy(ks: DataFrame, moves: DataFrame, now: int, replace: bool = False) -> DataFrame:
    """Copies (src, dst) with their expiry; without ``replace`` live destinations stay."""
    alive = live(ks, now).select("key", "value", "expire_at")
    made = alive.join(moves, alive.key == moves.src).select(F.col("dst").alias("key"), "value", "expire_at")
    if replace:
        return alive.join(made.select("key"), "key", "left_anti").unionByName(made)
    return alive.unionByName(made.join(alive.select("key"), "key", "left_anti"))


def flush(ks: DataFrame) -> DataFrame:
    return ks.where(F.lit(False))


def reap(ks: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(what is left, one row with n): active expiry as a batch, every expired record at once."""
    gone = (F.col("expire_at") != 0) & (F.col("expire_at") <= now)
    return ks.where(~gone), ks.where(gone).agg(F.count(F.lit(1)).alias("n"))
