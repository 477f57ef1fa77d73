"""Readers: bulk and point lookups, scans, expiry and size facts over a keyspace.

``ks`` has columns key, value, expire_at; keys may be BINARY or STRING.  ``now`` is always
given, never read from a clock.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from ..functions.glob import is_trivial, matches
from ..schema import MAX_KEYS_REPLY, SCAN_COUNT, SCAN_COUNT_MAX


def live(ks: DataFrame, now: int) -> DataFrame:
    """The visible records; the filter reaches the Parquet scan."""
    return ks.where(exprs.is_live(F.lit(now)))


def get(ks: DataFrame, key, now: int) -> DataFrame:
    """The value of one key, no row if missing."""
    return live(ks, now).where(F.col("key") == F.lit(key)).select("value")


def mget(ks: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    """pos, key, value for ``asked`` (pos, key): null for missing keys, repeats repeated.

    A plain left join: Spark broadcasts the asked keys' side or shuffles by size.
    """
    found = live(ks, now).select(F.col("key").alias("_k"), "value")
    return asked.join(found, F.col("key") == F.col("_k"), "left").select("pos", "key", "value")


def mget_array(ks: DataFrame, keys: list, now: int) -> DataFrame:
    """One row with the values of ``keys`` in order."""
    spark = ks.sparkSession
    kind = dict(ks.dtypes)["key"]
    asked = spark.createDataFrame(list(enumerate(keys)), f"pos int, key {kind}")
    rows = mget(ks, asked, now).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("r"))
    return rows.select(F.transform("r", lambda x: x["value"]).alias("values"))


def exists(ks: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    """n: how many of the asked keys are live, repeats counted."""
    return asked.join(live(ks, now).select("key"), "key").agg(F.count(F.lit(1)).alias("n"))


def type_of(ks: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    found = live(ks, now).select("key", F.lit("string").alias("type"))
    return asked.join(found, "key", "left").select(*asked.columns, F.coalesce("type", F.lit("none")).alias("type"))


def keys(ks: DataFrame, pattern: bytes, now: int, budget: int = MAX_KEYS_REPLY) -> DataFrame:
    """Live keys that match; a reply over the budget is an error, as in the protocol."""
    found = live(ks, now).select("key")
    return found if is_trivial(pattern) else found.where(matches("key", pattern))


def keys_reply(ks: DataFrame, pattern: bytes, now: int, budget: int = MAX_KEYS_REPLY) -> list:
    """The matching keys as a reply; raises where there are more than ``budget``."""
    rows = keys(ks, pattern, now).limit(budget + 1).collect()
    if len(rows) > budget:
        raise ValueError(f"KEYS matched more than {budget} keys; use SCAN instead")
    return [r["key"] for r in rows]


def scan(ks: DataFrame, now: int, start=None, count: int = SCAN_COUNT, pattern: bytes = b"*", kind: str = "string") -> DataFrame:
    """key, next_key: a page of live keys in key order from ``start`` on.

    The pattern filters after the page is cut, so a page may be empty while there is a
    next one.  ``next_key`` is null on the last page.
    """
    count = max(1, min(count, SCAN_COUNT_MAX))
    rows = live(ks, now).select("key")
    if kind != "string":
        rows = rows.where(F.lit(False))
    if start is not None:
        rows = rows.where(F.col("key") >= F.lit(start))
    page = rows.orderBy("key").limit(count + 1)
    numbered = page.agg(F.sort_array(F.collect_list("key")).alias("k"))
    out = numbered.select(
        F.explode(F.slice("k", 1, count)).alias("key"), F.when(F.size("k") > count, F.element_at("k", -1)).alias("next_key")
    )
    return out if is_trivial(pattern) else out.where(matches("key", pattern))


def cursor_of(key: bytes | None) -> str:
    """A page's cursor: the key to go on from, 0 at the end."""
    return "0" if key is None else base64.urlsafe_b64encode(bytes(key)).decode()


def key_of(cursor: str) -> bytes | None:
    if cursor == "0":
        return None
    try:
        return base64.urlsafe_b64decode(cursor.encode())
    except ValueError as error:
        raise ValueError("invalid cursor") from error


def randomkey(ks: DataFrame, now: int, seed: int) -> DataFrame:
    """Some live key, the same for a seed."""
    return live(ks, now).select("key").orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(1)


def dbsize(ks: DataFrame, now: int) -> DataFrame:
    return live(ks, now).agg(F.count(F.lit(1)).alias("n"))


def volatile(ks: DataFrame, n: int | None = None, seed: int = 0) -> DataFrame:
    """Keys with an expiry; at most ``n`` of them, drawn by hash."""
    rows = ks.where("expire_at <> 0").select("key", "expire_at")
    return rows if n is None else rows.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(n)


def shard(ks: DataFrame, number: int, of: int = 1024) -> DataFrame:
    """The keys of one hash shard."""
    return ks.where(F.pmod(F.xxhash64("key"), F.lit(of)) == number)


def ttls(ks: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    """Adds ttl and pttl (-2 missing, -1 without expiry), expiretime and pexpiretime."""
    found = live(ks, now).select("key", "expire_at")
    e = F.col("expire_at")
    never = lambda x: F.when(e.isNull(), F.lit(-2)).when(e == 0, F.lit(-1)).otherwise(x).cast("bigint")
    return asked.join(found, "key", "left").select(
        *asked.columns,
        never(exprs.ttl(F.lit(now), 1000)).alias("ttl"),
        never(e - now).alias("pttl"),
        never(F.floor(e / 1000)).alias("expiretime"),
        never(e).alias("pexpiretime"),
    )


def strlen(ks: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    found = live(ks, now).select("key", F.octet_length("value").cast("bigint").alias("n"))
    return asked.join(found, "key", "left").select(*asked.columns, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def object_encoding(ks: DataFrame, now: int) -> DataFrame:
    """key, encoding (int for strict integers, else raw), refcount, idletime."""
    number = exprs.strict_int(F.col("value").cast("string"))
    return live(ks, now).select(
        "key", F.when(number.isNotNull(), "int").otherwise("raw").alias("encoding"), F.lit(1).cast("bigint").alias("refcount"), F.lit(0).cast("bigint").alias("idletime")
    )


def memory_usage(ks: DataFrame, now: int) -> DataFrame:
    return live(ks, now).select("key", exprs.memory_usage().alias("bytes"))
