"""The registered keyspace queries and their SQL twins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from .functions import exprs
from .operators import lsm, read, stats, write
from .plans import commands, log
from .plans.table import COMMANDS, command_table
from .sources import resp
from .sources.derived import NOW, derived, duck
from .streaming import fold

QUERIES, ORACLE_SQL = {}, {}
LIVE = f"(expire_at = 0 OR expire_at > {NOW})"


def query(*tables: str, sql: str | None = None):
    """Registers a function of the derived tables; ``sql`` runs on the same ones."""

    def register(f):
        def run(spark, sf_dir):
            return f(*(derived(spark, sf_dir, t) for t in tables))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = (duck(*tables) if tables else "") + sql
        return f

    return register


# ---------------------------------------------------------------- logs

_NEWEST = "SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC, pos DESC) AS rn FROM {}"
_FOLD = "SELECT key, value, expire_at FROM (" + _NEWEST + ") WHERE rn = 1 AND op = 'put'"


@query("kv_log", sql=f"SELECT key, value, expire_at FROM ({_FOLD.format('kv_log')}) WHERE {LIVE}")
def replay_live(rows):
    return read.live(log.replay(rows), NOW)


@query("kv_log", sql=f"SELECT key, value, expire_at FROM ({_FOLD.format('kv_log WHERE lsn <= 500')})")
def replay_asof_lsn(rows):
    return log.replay(rows, 500)


@query("kv_log", sql=_FOLD.format("kv_log WHERE lsn > 400"))
def replay_with_flush(rows):
    flush = rows.where("lsn = 400").select("lsn", F.lit(1).alias("pos"), F.lit("flushall").alias("op"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), F.lit(0).cast("bigint").alias("expire_at"))
    return log.replay(rows.unionByName(flush))


@query("kv_log", sql=_FOLD.format("kv_log"))
def recover_snapshot_tail(rows):
    return log.recover(log.snapshot(rows, 600), 600, log.trim(rows, 600))


@query("kv_log", sql="SELECT key, op, lsn AS valid_from, lead(lsn) OVER (PARTITION BY key ORDER BY lsn, pos) AS valid_to FROM kv_log")
def history_intervals(rows):
    return log.history(rows).select("key", "op", "valid_from", "valid_to")


@query(
    "kv_log",
    sql=f"""SELECT a.lsn, count(h.key) AS n FROM (VALUES (CAST(100 AS BIGINT)), (500), (900)) a(lsn)
    LEFT JOIN (SELECT *, lead(lsn) OVER (PARTITION BY key ORDER BY lsn, pos) AS nxt FROM kv_log) h
    ON h.op = 'put' AND {LIVE} AND h.lsn <= a.lsn AND (nxt IS NULL OR nxt > a.lsn) GROUP BY a.lsn""",
)
def dbsize_asof(rows):
    return log.dbsize_asof(rows, [100, 500, 900], NOW)


@query("kv_log", sql="SELECT lsn, 'gap' AS problem FROM kv_log WHERE lsn % 100 = 98")
def log_gaps(rows):
    return log.check(rows.where("lsn % 100 <> 99"))


# ---------------------------------------------------------------- readers

def _asked(ks):
    n = _n()
    return ks.select("key", n.alias("n")).where(F.col("n") % 5 < 2)


@query("kv_orders", sql=f"SELECT value FROM kv_orders WHERE key = (SELECT min(key) FROM kv_orders WHERE {LIVE})")
def get_point(ks):
    first = read.live(ks, NOW).agg(F.min("key")).first()[0]
    return read.get(ks, first, NOW)


@query("kv_orders", sql=f"SELECT k.key, k.value FROM kv_orders k WHERE {LIVE} AND CAST(split_part(key, ':', 3) AS BIGINT) % 5 < 2")
def get_bulk(ks):
    return read.live(ks, NOW).join(_asked(ks).select("key"), "key").select("key", "value")


@query(
    "kv_orders",
    sql=f"""SELECT a.n AS pos, a.key, k.value FROM (SELECT key, CAST(split_part(key, ':', 3) AS BIGINT) AS n FROM kv_orders) a
    LEFT JOIN (SELECT key, value FROM kv_orders WHERE {LIVE}) k USING (key) WHERE a.n % 5 < 2""",
)
def mget_ordered(ks):
    return read.mget(ks, _asked(ks).select(F.col("n").alias("pos"), "key"), NOW)


@query("kv_orders", sql=f"SELECT 2 * count(*) AS n FROM kv_orders WHERE {LIVE} AND CAST(split_part(key, ':', 3) AS BIGINT) % 5 < 2")
def exists_count(ks):
    a = _asked(ks).select("key")
    return read.exists(ks, a.unionAll(a), NOW)


@query("kv_orders", sql=f"SELECT key, CASE WHEN {LIVE} THEN 'string' ELSE 'none' END AS type FROM kv_orders")
def type_of(ks):
    return read.type_of(ks, ks.select("key"), NOW)


def _glob(name, pattern, condition):
    def run(ks):
        return read.keys(ks, pattern, NOW)

    run.__name__ = name
    query("kv_orders", sql=f"SELECT key FROM kv_orders WHERE {LIVE} AND {condition}")(run)


_glob("keys_glob_star", b"order:*:1*", "regexp_matches(key, '^order:.*:1.*$')")
_glob("keys_glob_all", b"*", "true")
_glob("keys_glob_class", b"order:[FO]:*[0-4]", "regexp_matches(key, '^order:[FO]:.*[0-4]$')")
_glob("keys_glob_negated", b"order:[^P]:*[^0-8]", "regexp_matches(key, '^order:[^P]:.*[^0-8]$')")
_glob("keys_glob_question", b"order:?:??", "regexp_matches(key, '^order:.:..$')")

_PAGE = "SELECT key, row_number() OVER (ORDER BY key) AS rn FROM kv_orders WHERE {} AND key >= '{}'"


def _page(name, start):
    def run(ks):
        return read.scan(ks, NOW, start, 50)

    run.__name__ = name
    rows = _PAGE.format(LIVE, start or "")
    query("kv_orders", sql=f"SELECT key, (SELECT key FROM ({rows}) WHERE rn = 51) AS next_key FROM ({rows}) WHERE rn <= 50")(run)


_page("scan_page_first", None)
_page("scan_page_resume", "order:O:2")


@query("kv_orders", sql=f"SELECT count(*) AS n FROM kv_orders WHERE {LIVE}")
def dbsize(ks):
    return read.dbsize(ks, NOW)


@query("kv_orders", sql="SELECT key, expire_at FROM kv_orders WHERE expire_at <> 0")
def volatile_sample_all(ks):
    return read.volatile(ks)


def randomkey_seeded(spark, sf_dir):
    return read.randomkey(derived(spark, sf_dir, "kv_orders"), NOW, 11)


QUERIES["randomkey_seeded"] = randomkey_seeded

_TTL = f"CASE WHEN NOT {LIVE} THEN -2 WHEN expire_at = 0 THEN -1 ELSE {{}} END"


@query("kv_orders", sql=f"SELECT key, CAST({_TTL.format(f'(expire_at - {NOW} + 999) // 1000')} AS BIGINT) AS ttl, CAST({_TTL.format(f'expire_at - {NOW}')} AS BIGINT) AS pttl FROM kv_orders")
def ttl_pttl(ks):
    return read.ttls(ks, ks.select("key"), NOW).select("key", "ttl", "pttl")


@query("kv_orders", sql=f"SELECT key, CAST({_TTL.format('expire_at // 1000')} AS BIGINT) AS expiretime, CAST({_TTL.format('expire_at')} AS BIGINT) AS pexpiretime FROM kv_orders")
def expiretime(ks):
    return read.ttls(ks, ks.select("key"), NOW).select("key", "expiretime", "pexpiretime")


@query("kv_docs", sql="SELECT key, CAST(strlen(value) AS BIGINT) AS n FROM kv_docs")
def strlen_bytes(ks):
    return read.strlen(ks, ks.select("key"), NOW)


def _range_sql(expression):
    return f"SELECT key, {expression} AS part FROM (SELECT key, lower(hex(encode(value))) AS h FROM kv_docs)"


@query("kv_docs", sql=_range_sql("substr(h, 5, 20)"))
def getrange_pos(ks):
    return read.live(ks, NOW).select("key", F.lower(F.hex(exprs.get_range(F.col("value").cast("binary"), 2, 11))).alias("part"))


@query("kv_docs", sql=_range_sql("CASE WHEN length(h) <= 2 THEN h WHEN length(h) <= 14 THEN substr(h, 1, greatest(length(h) - 2, 2)) ELSE substr(h, length(h) - 13, 12) END"))
def getrange_neg(ks):
    return read.live(ks, NOW).select("key", F.lower(F.hex(exprs.get_range(F.col("value").cast("binary"), -7, -2))).alias("part"))


@query("kv_orders", sql=f"SELECT key, lower(hex(encode(rpad(value, 12, chr(0))[1:12] || 'patch' || coalesce(value[18:], '')))) AS value FROM kv_orders WHERE {LIVE}")
def setrange_pad(ks):
    return write.set_range(ks, 12, b"patch", NOW).select("key", F.lower(F.hex("value")).alias("value"))


_INT = "CASE WHEN regexp_matches(value, '^(\\+[0-9]+|-?(0|[1-9][0-9]*))$') AND strlen(value) <= 20 THEN TRY_CAST(value AS BIGINT) END"


@query("kv_numeric", sql=f"SELECT key, {_INT} AS n FROM kv_numeric")
def strict_int_parse(ks):
    return ks.select("key", exprs.strict_int("value").alias("n"))


@query("kv_numeric", sql=f"SELECT key, CASE WHEN {_INT} IS NULL THEN 'raw' ELSE 'int' END AS encoding, CAST(1 AS BIGINT) AS refcount, CAST(0 AS BIGINT) AS idletime FROM kv_numeric")
def object_encoding(ks):
    return read.object_encoding(ks, NOW)


@query("kv_docs", sql="SELECT key, CAST(strlen(key) + strlen(value) + 64 AS BIGINT) AS bytes FROM kv_docs")
def memory_usage(ks):
    return read.memory_usage(ks, NOW)


# ---------------------------------------------------------------- writers

_N = "CAST(split_part(key, ':', 3) AS BIGINT)"


def _n(key="key"):
    return F.split_part(F.col(key), F.lit(":"), F.lit(3)).try_cast("bigint")


def _batch(ks, mod, rest):
    return ks.where(_n() % mod == rest).select("key", F.concat(F.lit("new:"), F.col("value")).alias("value"), F.lit(0).cast("bigint").alias("expire_at"))


@query("kv_orders", sql=f"SELECT count(*) AS n FROM kv_orders WHERE {LIVE} AND {_N} % 4 = 1")
def del_count(ks):
    a = ks.where(_n() % 4 == 1).select("key")
    return write.delete_all(ks, a.unionAll(a), NOW)[1]


@query("kv_orders", sql=f"SELECT key, value, expire_at FROM kv_orders WHERE {LIVE} AND {_N} % 4 <> 1")
def del_remaining(ks):
    return write.delete_all(ks, ks.where(_n() % 4 == 1).select("key"), NOW)[0]


@query("kv_orders", sql=f"SELECT key, value, expire_at FROM kv_orders WHERE {LIVE} UNION ALL SELECT key, 'new:' || value, 0 FROM kv_orders WHERE NOT {LIVE} AND {_N} % 2 = 0")
def setnx_insert(ks):
    return write.setnx_all(ks, _batch(ks, 2, 0), NOW)


@query("kv_orders", sql=f"SELECT key, CASE WHEN {_N} % 2 = 0 THEN 'new:' || value ELSE value END AS value, CASE WHEN {_N} % 2 = 0 THEN 0 ELSE expire_at END AS expire_at, {_N} % 2 = 0 AS written FROM kv_orders WHERE {LIVE}")
def set_xx_update(ks):
    return write.set_if(ks, _batch(ks, 2, 0), NOW, "xx").where("value IS NOT NULL").select("key", "value", "expire_at", "written")


@query("kv_orders", sql=f"SELECT key, 'new:' || value AS value, CASE WHEN {LIVE} THEN value END AS old_value FROM kv_orders WHERE {_N} % 2 = 0")
def set_get_old(ks):
    return write.set_if(ks, _batch(ks, 2, 0), NOW).where("written").select("key", "value", "old_value")


@query("kv_orders", sql=f"SELECT key, 'new:' || value AS value, CASE WHEN {LIVE} THEN expire_at ELSE 0 END AS expire_at FROM kv_orders WHERE {_N} % 2 = 0")
def set_keepttl(ks):
    return write.set_if(ks, _batch(ks, 2, 0), NOW, keep_ttl=True).where("written").select("key", "value", "expire_at")


@query("kv_orders", sql=f"SELECT key, CASE WHEN {_N} % 3 = 1 THEN 'second' ELSE value END AS value, CASE WHEN {_N} % 3 = 1 THEN 0 ELSE expire_at END AS expire_at FROM kv_orders")
def mset_last_wins(ks):
    some = ks.where(_n() % 3 == 1).select("key")
    pairs = some.select(F.lit(0).alias("pos"), "key", F.lit("first").alias("value")).unionAll(some.select(F.lit(1), "key", F.lit("second")))
    return write.put_all(ks, pairs)


@query("kv_orders", sql=f"SELECT key, value, expire_at FROM kv_orders WHERE {LIVE} UNION ALL SELECT 'fresh:' || {_N}, 'x', 0 FROM kv_orders WHERE {_N} % 100 = 1")
def msetnx_guard(ks):
    fresh = ks.where(_n() % 100 == 1).select(F.lit(0).alias("pos"), F.concat(F.lit("fresh:"), _n()).alias("key"), F.lit("x").alias("value"))
    done = write.msetnx(ks, fresh, NOW)
    taken = ks.where(_n() % 50 == 3).select(F.lit(0).alias("pos"), "key", F.lit("y").alias("value"))
    return write.msetnx(done, taken, NOW)


@query("cmd_log", sql="SELECT key, repeat('1', CAST(count(*) AS INT)) AS value, count(*) AS n FROM cmd_log WHERE name = 'append' GROUP BY key")
def append_fold(cmds):
    folded = cmds.where("name = 'append'").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "arg"))), lambda x: x["arg"]), "").alias("suffix"))
    empty = folded.select("key", F.lit("").alias("value"), F.lit(0).cast("bigint").alias("expire_at")).where("false")
    return write.append_all(empty, folded, NOW).select("key", "value", "n")


@query("cmd_log", sql="SELECT key, CAST(count(*) AS VARCHAR) AS value, 'ok' AS status FROM cmd_log WHERE name = 'incr' GROUP BY key")
def incr_fold(cmds):
    delta = cmds.where("name = 'incr'").groupBy("key").agg(F.count(F.lit(1)).alias("delta"))
    empty = delta.select("key", F.lit("").alias("value"), F.lit(0).cast("bigint").alias("expire_at")).where("false")
    return write.incr_by(empty, delta, NOW).select("key", "value", "status")


@query(
    "kv_counters",
    sql="""SELECT key, CASE WHEN k % 3 <> 0 OR try_cast(value AS BIGINT) IS NULL THEN value ELSE CAST(CAST(value AS BIGINT) + 7 AS VARCHAR) END AS value, expire_at,
    CASE WHEN k % 3 = 0 THEN CASE WHEN try_cast(value AS BIGINT) IS NULL THEN 'not_integer' ELSE 'ok' END END AS status
    FROM (SELECT *, CAST(substr(key, 6) AS BIGINT) AS k FROM kv_counters)
    UNION ALL SELECT replace(key, 'part', 'new'), '7', 0, 'ok' FROM kv_counters WHERE CAST(substr(key, 6) AS BIGINT) % 50 = 0""",
)
def incr_binary_with_expiry(counters):
    """Counters in the canonical binary schema: some named, some not, some missing, some no numbers."""
    ks = counters.select("key", F.col("value").cast("binary").alias("value"), "expire_at")
    number = F.substring("key", 6, 20).cast("bigint")
    named = ks.where(number % 3 == 0).select("key")
    missing = ks.where(number % 50 == 0).select(F.replace("key", F.lit("part"), F.lit("new")).alias("key"))
    done = write.incr_by(ks, named.unionByName(missing).withColumn("delta", F.lit(7).cast("bigint")), NOW)
    return done.select("key", F.col("value").cast("string").alias("value"), "expire_at", "status")


_FLUSHES = "(SELECT lsn FROM kv_log WHERE lsn % 300 = 0)"
_CLOSED = f"""SELECT key, op, expire_at, lsn AS valid_from,
    least(lead(lsn) OVER (PARTITION BY key ORDER BY lsn, pos), (SELECT min(f.lsn) FROM {_FLUSHES} f WHERE f.lsn > l.lsn)) AS valid_to
    FROM kv_log l WHERE lsn % 300 <> 0"""


def _flushed(rows):
    """The log with every 300th record a flush."""
    flush = rows.where("lsn % 300 = 0").withColumn("op", F.lit("flushall"))
    return rows.where("lsn % 300 <> 0").unionByName(flush)


@query("kv_log", sql=f"SELECT key, op, valid_from, valid_to FROM ({_CLOSED})")
def history_across_flushes(rows):
    return log.history(_flushed(rows)).select("key", "op", "valid_from", "valid_to")


@query(
    "kv_log",
    sql=f"""SELECT a.lsn, count(h.key) AS n FROM (VALUES (CAST(299 AS BIGINT)), (300), (450), (600), (899)) a(lsn)
    LEFT JOIN ({_CLOSED}) h ON h.op = 'put' AND {LIVE} AND h.valid_from <= a.lsn AND (h.valid_to IS NULL OR h.valid_to > a.lsn) GROUP BY a.lsn""",
)
def dbsize_across_flushes(rows):
    return log.dbsize_asof(_flushed(rows), [299, 300, 450, 600, 899], NOW)


@query(
    "kv_numeric",
    sql=f"""SELECT key, CASE WHEN n IS NULL THEN 'not_integer' WHEN n > 0 THEN 'overflow' ELSE 'ok' END AS status,
    CASE WHEN n <= 0 THEN CAST(n + 9223372036854775807 AS VARCHAR) ELSE value END AS value FROM (SELECT key, value, {_INT} AS n FROM kv_numeric)""",
)
def incrby_overflow_flag(ks):
    return write.incr_by(ks, ks.select("key", F.lit((1 << 63) - 1).alias("delta")), NOW).select("key", "value", "status")


def _expire(name, mode, may):
    def run(ks):
        batch = ks.select("key", F.lit(NOW + 86_400_000).alias("deadline"))
        return write.expire(ks, batch, NOW, mode)

    run.__name__ = name
    query("kv_orders", sql=f"SELECT key, CASE WHEN {may} THEN {NOW + 86_400_000} ELSE expire_at END AS expire_at, {may} AS applied FROM kv_orders WHERE {LIVE}")(run)


_expire("expire_nx", "nx", "expire_at = 0")
_expire("expire_xx", "xx", "expire_at <> 0")
_expire("expire_gt", "gt", f"(expire_at <> 0 AND {NOW + 86_400_000} > expire_at)")
_expire("expire_lt", "lt", f"(expire_at = 0 OR {NOW + 86_400_000} < expire_at)")


@query("kv_orders", sql=f"SELECT key, expire_at FROM kv_orders WHERE {LIVE} AND {_N} % 2 = 1")
def expire_past_deletes(ks):
    batch = ks.where(_n() % 2 == 0).select("key", F.lit(NOW).alias("deadline"))
    return write.expire(ks, batch, NOW).where("expire_at IS NOT NULL").select("key", "expire_at")


@query("kv_orders", sql=f"SELECT key, CAST(0 AS BIGINT) AS expire_at, expire_at <> 0 AS had_ttl FROM kv_orders WHERE {LIVE}")
def persist(ks):
    return write.persist(ks, NOW)


@query(
    "kv_orders",
    sql=f"""SELECT CASE WHEN {_N} % 10 = 3 THEN concat('moved:', {_N}) ELSE key END AS key, value, expire_at FROM kv_orders WHERE {LIVE}""",
)
def rename_map(ks):
    moves = ks.where(_n() % 10 == 3).select(F.col("key").alias("src"), F.concat(F.lit("moved:"), _n()).alias("dst"))
    return write.rename(ks, moves, NOW)


@query("kv_orders", sql=f"SELECT key, value, expire_at FROM kv_orders WHERE {LIVE} UNION ALL SELECT concat('copy:', {_N}), value, expire_at FROM kv_orders WHERE {LIVE} AND {_N} % 10 = 3")
def copy_replace(ks):
    moves = ks.where(_n() % 10 == 3).select(F.col("key").alias("src"), F.concat(F.lit("copy:"), _n()).alias("dst"))
    once = write.copy(ks, moves, NOW)
    return write.copy(once, moves, NOW, replace=True)


@query("kv_orders", sql=f"SELECT key, 'new:' || value AS value, CAST(0 AS BIGINT) AS expire_at FROM kv_orders WHERE {_N} % 10 = 3")
def flush_all(ks):
    """What is written after a flush is all there is."""
    return write.put_all(write.flush(ks), _batch(ks, 10, 3).withColumn("pos", F.lit(0))).select("key", "value", "expire_at")


@query("kv_orders", sql=f"SELECT key, value, expire_at FROM kv_orders WHERE {LIVE}")
def reap_left(ks):
    return write.reap(ks, NOW)[0]


@query("kv_orders", sql=f"SELECT count(*) AS n FROM kv_orders WHERE NOT {LIVE}")
def reap_count(ks):
    return write.reap(ks, NOW)[1]


@query("kv_orders", sql=f"SELECT key, CASE WHEN {_N} % 3 = 1 THEN value || '+tail' ELSE value END AS value, expire_at, CAST(strlen(value) + CASE WHEN {_N} % 3 = 1 THEN 5 ELSE 0 END AS BIGINT) AS n FROM kv_orders WHERE {LIVE}")
def append_existing(ks):
    """Values that are there keep their expiry and grow."""
    tails = read.live(ks, NOW).where(_n() % 3 == 1).select("key", F.lit("+tail").alias("suffix"))
    return write.append_all(ks, tails, NOW).select("key", "value", "expire_at", "n")


# ---------------------------------------------------------------- runs

_RUNS = "SELECT *, row_number() OVER (PARTITION BY key ORDER BY rk) AS rn FROM lsm_runs"


@query("lsm_runs", sql=f"SELECT key, rk, is_delete, value FROM ({_RUNS}) WHERE rn = 1 AND NOT is_delete")
def lsm_merge_newest(runs):
    return lsm.merged(runs.withColumn("n", F.col("rk"))).select("key", F.col("n").alias("rk"), "is_delete", "value")


@query("lsm_runs", sql=f"SELECT key, is_delete, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rk) AS rn FROM lsm_runs WHERE rk < 2) WHERE rn = 1 AND (NOT is_delete OR key BETWEEN '00000100' AND '00000500')")
def lsm_compaction_drop(runs):
    spark = runs.sparkSession
    deeper = spark.createDataFrame([("00000100", "00000500")], "min_key string, max_key string")
    return lsm.compact(runs.where("rk < 2"), deeper).select("key", "is_delete", "value")


_FILES = """(SELECT rk + 1 AS level, min(key) AS min_key, max(key) AS max_key FROM lsm_runs GROUP BY rk, substr(key, 1, 6)
    UNION ALL SELECT rk + 1, min(key), max(key) FROM lsm_runs WHERE rk < 2 AND key > '00000150' GROUP BY rk)"""


@query("lsm_runs", sql=f"SELECT level, min_key, max_key FROM (SELECT *, lag(max_key) OVER (PARTITION BY level ORDER BY min_key, max_key) AS before FROM {_FILES}) WHERE before >= min_key")
def lsm_level_overlap_check(runs):
    """Files cut by prefix, with one more on two levels that reaches over others."""
    level, span = (F.col("rk") + 1).alias("level"), (F.min("key").alias("min_key"), F.max("key").alias("max_key"))
    files = runs.groupBy(level, F.substring("key", 1, 6).alias("p")).agg(*span).drop("p")
    wide = runs.where("rk < 2 AND key > '00000150'").groupBy(level).agg(*span)
    return lsm.overlaps(files.unionByName(wide)).select("level", "min_key", "max_key")


@query("lsm_runs", sql="SELECT rk AS level, count(*) AS entries, count_if(is_delete) AS tombstones, CAST(sum(strlen(key) + strlen(value)) AS BIGINT) AS bytes, min(key) AS min_key, max(key) AS max_key FROM lsm_runs GROUP BY rk")
def lsm_level_stats(runs):
    return runs.groupBy(F.col("rk").alias("level")).agg(
        F.count(F.lit(1)).alias("entries"), F.count_if("is_delete").alias("tombstones"),
        F.sum(F.octet_length("key") + F.octet_length("value")).alias("bytes"), F.min("key").alias("min_key"), F.max("key").alias("max_key"),
    )


def lsm_store_roundtrip(spark, sf_dir):
    """Four flushes, compaction until nothing is due, then the keyspace."""
    runs = derived(spark, sf_dir, "lsm_runs")
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp()
    store = lsm.Store(spark, f"{base}/store-{uuid.uuid4().hex}", lsm.CompactionOptions(level0_trigger=2, level1_bytes=1 << 20, file_bytes=1 << 18))
    for rank in (3, 2, 1, 0):
        rows = runs.where(F.col("rk") == rank).select(F.col("key").cast("binary").alias("key"), "is_delete", F.col("value").cast("binary").alias("value"), F.lit(0).cast("bigint").alias("expire_at"))
        store.flush(rows, 10 - rank)
        while store.compact_once(NOW):
            pass
    return store.keyspace().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


QUERIES["lsm_store_roundtrip"] = lsm_store_roundtrip
ORACLE_SQL["lsm_store_roundtrip"] = duck("lsm_runs") + f"SELECT key, value FROM ({_RUNS}) WHERE rn = 1 AND NOT is_delete"


# ---------------------------------------------------------------- statistics

_BUCKET = "CASE WHEN v < 256 THEN v ELSE 256 + (length(bin(v)) - 9) * 128 + ((v >> (length(bin(v)) - 8)) & 127) END"
_FLOOR = "CASE WHEN b < 256 THEN b ELSE (128 + (b - 256) % 128) << ((b - 256) // 128 + 1) END"
_HIST = f"(SELECT CAST({_BUCKET} AS BIGINT) AS bucket, count(*) AS n FROM samples GROUP BY 1)"


@query("kv_orders", sql=f"SELECT count_if({LIVE}) AS keys, count_if({LIVE} AND expire_at <> 0) AS expires, CAST(sum(CASE WHEN {LIVE} THEN strlen(key) + strlen(value) + 64 END) AS BIGINT) AS bytes, count_if(NOT {LIVE}) AS expired FROM kv_orders")
def stats_keyspace(ks):
    return stats.keyspace(ks, NOW)


@query("samples", sql=f"SELECT bucket, n FROM {_HIST}")
def histogram_buckets(samples):
    return stats.histogram(samples)


@query("samples", sql=f"SELECT bucket, n FROM {_HIST}")
def histogram_merge(samples):
    """Histograms of three parts, merged."""
    return stats.merge(*(stats.histogram(samples.where(F.col("l_orderkey") % 3 == k)) for k in range(3)))


_BY_LINE = f"(SELECT l_linenumber, CAST({_BUCKET} AS BIGINT) AS b, count(*) AS n FROM samples GROUP BY 1, 2)"
_REACHED = ", ".join(f"min(CASE WHEN upto >= ceil(CAST({q} AS DOUBLE) * total) THEN CAST({_FLOOR} AS BIGINT) END) AS {name}" for name, q in stats.REPORTED)


@query(
    "samples",
    sql=f"""SELECT l_linenumber, n, n / 30.0::DOUBLE AS per_sec, lo AS min, mean, hi AS max, p50, p95, p99, p999
    FROM (SELECT l_linenumber, count(*) AS n, min(v) AS lo, CAST(sum(v) AS DOUBLE) / count(*) AS mean, max(v) AS hi FROM samples GROUP BY 1)
    JOIN (SELECT l_linenumber, {_REACHED} FROM (SELECT *, sum(n) OVER (PARTITION BY l_linenumber ORDER BY b) AS upto, sum(n) OVER (PARTITION BY l_linenumber) AS total FROM {_BY_LINE}) GROUP BY 1) USING (l_linenumber)""",
)
def bench_report(samples):
    """A run's report with a row for each kind of request."""
    return stats.report(samples, "l_linenumber", 30.0)


@query("samples", sql=f"SELECT q, CAST({_FLOOR} AS BIGINT) AS value FROM (SELECT q, min(bucket) AS b FROM (SELECT bucket, sum(n) OVER (ORDER BY bucket) AS upto, sum(n) OVER () AS total FROM {_HIST}), (VALUES (CAST(0.5 AS DOUBLE)), (0.95), (0.99), (0.999)) t(q) WHERE upto >= ceil(q * total) GROUP BY q)")
def histogram_quantiles(samples):
    return stats.quantiles(stats.histogram(samples), [0.5, 0.95, 0.99, 0.999])


@query("cmd_log", sql="SELECT name, count(*) AS calls, min(now_ms) AS first_ms, max(now_ms) AS last_ms FROM cmd_log GROUP BY name")
def command_counters(cmds):
    return stats.commands(cmds)


@query("kv_orders", sql=f"SELECT count_if({LIVE}) AS hits, count_if(NOT {LIVE}) AS misses, count_if({LIVE}) / count(*) AS ratio FROM kv_orders")
def hit_ratio(ks):
    n = ks.agg(F.count_if(exprs.is_live(F.lit(NOW))).alias("hits"), F.count_if(~exprs.is_live(F.lit(NOW))).alias("misses"))
    return n.select("hits", "misses", stats.hit_ratio(F.col("hits"), F.col("misses")).alias("ratio"))


@query("cmd_log", sql="SELECT conn, count(*) AS calls, arg_max(name, seq) AS last_name, max(now_ms) - min(now_ms) AS age_ms, max(now_ms) AS idle_from FROM cmd_log GROUP BY conn")
def clients_last_command(cmds):
    return stats.clients(cmds)


# ---------------------------------------------------------------- commands

def _args(cmds):
    parts = F.array_compact(F.array("name", "key", "arg"))
    return cmds.select("conn", "seq", "now_ms", F.transform(parts, lambda x: x.cast("binary")).alias("args"))


@query("cmd_log", sql="SELECT conn, seq, key FROM cmd_log")
def getkeys_extract(cmds):
    return commands.getkeys(_args(cmds)).select("conn", "seq", F.explode("keys").alias("key")).withColumn("key", F.col("key").cast("string"))


def command_list(spark, sf_dir):
    return command_table(spark).select("name", F.col("arity").cast("bigint").alias("arity"))


QUERIES["command_list"] = command_list
ORACLE_SQL["command_list"] = "SELECT split_part(line, ' ', 1) AS name, CAST(split_part(line, ' ', 2) AS BIGINT) AS arity FROM (SELECT unnest(string_split('" + COMMANDS.strip() + "', chr(10))) AS line)"


@query("cmd_log", sql="""SELECT c.seq, CAST(max(CASE WHEN w.seq IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS n FROM cmd_log c LEFT JOIN cmd_log w
    ON w.key = c.key AND w.seq < c.seq AND w.name IN ('incr', 'append', 'set')
    AND NOT EXISTS (SELECT 1 FROM cmd_log e WHERE e.key = c.key AND e.name = 'del' AND e.seq > w.seq AND e.seq < c.seq)
    WHERE c.name = 'del' GROUP BY c.seq""")
def del_replies(cmds):
    replies, _ = commands.execute(cmds.sparkSession, _args(cmds))
    return replies.join(cmds.where("name = 'del'").select("seq"), "seq").select("seq", F.col("i").alias("n"))


def command_replies(spark, sf_dir):
    replies, _ = commands.execute(spark, _args(derived(spark, sf_dir, "cmd_log")))
    return replies.select("conn", "seq", "kind", "i", F.col("s").cast("string").alias("s"), "err")


@query(
    "cmd_log",
    sql="""SELECT key, CASE WHEN n % 4 = 0 THEN CAST(n // 4 AS VARCHAR) ELSE rtrim(CAST(CAST(n AS DECIMAL(18, 2)) / 4 AS DECIMAL(18, 2))::VARCHAR, '0') END AS value
    FROM (SELECT key, count(*) AS n FROM cmd_log WHERE name = 'incr' GROUP BY key)""",
)
def incrbyfloat_fold(cmds):
    """A log of INCRBYFLOAT key 0.25, run in order; what the keys hold at its end."""
    args = F.array(F.lit("INCRBYFLOAT"), F.col("key"), F.lit("0.25"))
    said = cmds.where("name = 'incr'").select("conn", "seq", "now_ms", F.transform(args, lambda x: x.cast("binary")).alias("args"))
    _, mutations = commands.execute(cmds.sparkSession, said)
    return commands.keyspace_after(mutations).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def resp_encode(spark, sf_dir):
    replies, _ = commands.execute(spark, _args(derived(spark, sf_dir, "cmd_log")))
    return resp.encode(replies).select("conn", "seq", F.col("data").cast("string").alias("data"))


def resp_decode(spark, sf_dir):
    line = F.concat_ws(" ", "name", "key", "arg")
    lines = derived(spark, sf_dir, "cmd_log").groupBy("conn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))), lambda x: x["l"]), "\r\n").alias("t"))
    frames = lines.select("conn", F.concat("t", F.lit("\r\n")).cast("binary").alias("data"))
    return resp.decode(frames).select("conn", "seq", F.array_join(F.transform("args", lambda a: a.cast("string")), " ").alias("line"))


def stream_fold(spark, sf_dir):
    """The whole command log as a stream, its keys' records in keyed state; the replies."""
    base = f"{(spark.conf.get('spark.checkpoint.dir', None) or 'file://' + tempfile.mkdtemp()).rstrip('/')}/stream-{uuid.uuid4().hex}"
    _args(derived(spark, sf_dir, "cmd_log")).write.parquet(f"{base}/log")
    log_stream = spark.readStream.schema("conn bigint, seq bigint, now_ms bigint, args array<binary>").parquet(f"{base}/log")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        written = fold.fold_stream(log_stream, "Append").writeStream.option("checkpointLocation", f"{base}/state").option("path", f"{base}/replies")
        written.format("parquet").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    out = spark.read.schema(fold.OUTPUT).parquet(f"{base}/replies")
    return out.select(F.col("key").cast("string").alias("key"), "conn", "seq", "kind", "i", F.col("s").cast("string").alias("s"), "err")


QUERIES |= {f.__name__: f for f in (command_replies, resp_encode, resp_decode, stream_fold)}
ORACLE_SQL["resp_decode"] = duck("cmd_log") + "SELECT conn, row_number() OVER (PARTITION BY conn ORDER BY seq) - 1 AS seq, concat_ws(' ', name, key, arg) AS line FROM cmd_log"
