"""Command logs: every command of a log gets its reply, and the log leaves a keyspace.

Commands are dealt to groups of keys.  Multi-key commands that treat their keys one by
one (MGET, DEL, EXISTS, MSET and their like) are taken apart, and their replies put
together again.  RENAME, COPY and MSETNX tie their keys together: tied keys form one
group, found as connected components.  Each group runs its commands in order; groups
run in parallel.  A flush goes to every group that has commands.

KEYS, SCAN, DBSIZE and RANDOMKEY read all keys; they are answered from the history that
the groups leave, by the interval in which each version was current.  INFO and MEMORY
STATS count this history, and the commands and replies before it.  HELLO, CLIENT and
their like run by connection; CLIENT INFO, LIST and KILL read every connection as of
their seq, from the log alone: there are no addresses, and a killed connection's later
commands stay in the log.  CONFIG commands run in one group of their own; what they set
shows in CONFIG GET and has no effect on other commands.
"""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.glob import to_regex
from ..functions.text import argument_int
from ..operators.components import components
from ..operators.read import MAX_KEYS_REPLY, SCAN_COUNT, SCAN_COUNT_MAX
from .machine import SYNTAX, Machine, info_text
from .table import command_table, key_places, table

APART = ("mget", "del", "unlink", "exists", "touch", "mset")
TIED = ("rename", "renamenx", "copy", "msetnx")
GLOBAL = ("keys", "scan", "dbsize", "randomkey")
SESSION = ("hello", "auth", "reset", "quit", "client")
_NAMES = frozenset(table())
#: Commands whose key, if any, stands behind a subcommand.
_ABOUT_KEY = ("object", "memory", "debug")
_ELEM = "array<struct<kind:string,i:bigint,s:binary>>"
_OUT = f"conn bigint, seq bigint, pos int, kind string, i bigint, s binary, err string, elems {_ELEM}, key binary, value binary, expire_at bigint, gone boolean, hits bigint, misses bigint"


def checked(cmds: DataFrame) -> DataFrame:
    """Adds name and whether the command is known and has a right number of arguments."""
    table = command_table(cmds.sparkSession)
    name = F.lower(F.decode(F.get("args", F.lit(0)), "ISO-8859-1"))
    n = F.size("args")
    ok = F.when(F.col("arity") > 0, n == F.col("arity")).otherwise(n >= -F.col("arity"))
    ok = F.coalesce(ok, F.lit(False)) & ~(F.col("name").isin("mset", "msetnx") & (n % 2 == 0))
    return cmds.withColumn("name", name).join(F.broadcast(table), "name", "left").withColumn("ok", ok)


def key_rows(cmds: DataFrame) -> DataFrame:
    """pos and key of every key of a checked command."""
    last = F.when(F.col("last_key") < 0, F.size("args") + F.col("last_key")).otherwise(F.col("last_key"))
    places = F.sequence(F.col("first_key"), last, F.col("key_step"))
    rows = cmds.where("ok AND first_key > 0").select("*", F.posexplode(places).alias("pos", "place"))
    return rows.withColumn("key", F.get("args", F.col("place")))


def getkeys(cmds: DataFrame) -> DataFrame:
    """conn, seq, keys: the keys of each command, in order."""
    rows = key_rows(checked(cmds))
    return rows.groupBy("conn", "seq").agg(F.sort_array(F.collect_list(F.struct("pos", "key"))).alias("k")).select(
        "conn", "seq", F.transform("k", lambda x: x["key"]).alias("keys")
    )


def _groups(tied: DataFrame) -> DataFrame:
    """key, grp for keys that tied commands connect: smallest key of the component."""
    first = tied.groupBy("conn", "seq").agg(F.min("key").alias("head"))
    edges = tied.join(first, ["conn", "seq"]).select(F.col("key").alias("a"), F.col("head").alias("b")).distinct()
    base = tied.sparkSession.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="keyloom-")
    folder = f"{base.rstrip('/')}/groups-{uuid.uuid4().hex}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return tied.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    return components(edges, keep).select(F.col("v").alias("key"), F.col("root").alias("grp"))


def _run_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Runs the commands of one group of keys in order."""
    pdf = pdf.sort_values(["seq", "pos"], kind="stable")
    machine, out = Machine(), []
    for row in pdf.itertuples(index=False):
        if row.seq < 0:
            machine.records[bytes(row.key)] = (bytes(row.args[1]), int(row.now_ms))
            continue
        args, now = [bytes(a) for a in row.args], int(row.now_ms)
        name, hits, misses = args[0].decode("latin-1").lower(), machine.hits, machine.misses
        if name.startswith("flush"):
            touched = list(machine.records)
        elif name in _ABOUT_KEY:
            touched = args[2:3]
        else:
            touched = [args[k] for k in key_places(name, len(args)) if k < len(args)] if name in _NAMES else []
        before, session = {k: machine.records.get(k) for k in touched}, (machine.client, machine.proto)
        machine.conn = int(row.conn)
        kind, i, s, err, elems = machine.run(args, now)
        if session != (machine.client, machine.proto):
            out.append((row.conn, row.seq, -3, None, machine.proto, machine.client, None, None, None, None, None, False, 0, 0))
        if row.pos >= 0:
            elems = [(k, n, b) for k, n, b, _, _ in elems] if elems is not None else None
            out.append((row.conn, row.seq, row.pos, kind, i, s, err, elems, None, None, None, False, machine.hits - hits, machine.misses - misses))
        for key, old in before.items():
            new = machine.records.get(key)
            if old != new:
                v, e = new or (None, 0)
                out.append((row.conn, row.seq, -2, None, None, None, None, None, key, v, e, new is None, 0, 0))
    names = ["conn", "seq", "pos", "kind", "i", "s", "err", "elems", "key", "value", "expire_at", "gone", "hits", "misses"]
    frame = pd.DataFrame(out, columns=names)
    for c in ("i", "expire_at"):
        frame[c] = frame[c].astype("Int64")
    return frame


def execute(spark: SparkSession, cmds: DataFrame, ks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(replies, mutations) of commands (conn, seq, now_ms, args), run in the order of seq.

    ``mutations``: seq, key, value, expire_at, gone; folding them over ``ks`` gives the new
    keyspace.  seq must be unique and not negative.
    """
    rows = checked(cmds)
    # OBJECT, MEMORY USAGE and DEBUG OBJECT read the key behind their subcommand
    second = F.lower(F.get("args", F.lit(1)).cast("string"))
    about = F.col("ok") & (F.size("args") > 2) & ((F.col("name") == "object") | ((F.col("name") == "memory") & (second == "usage")) | ((F.col("name") == "debug") & (second == "object")))
    for c, n in (("first_key", 2), ("last_key", 2), ("key_step", 1)):
        rows = rows.withColumn(c, F.when(about, n).otherwise(F.col(c)))
    told = F.col("ok") & ((F.col("name") == "info") | ((F.col("name") == "memory") & (second == "stats")))
    seen = F.col("ok") & (F.col("name") == "client") & second.isin("info", "list", "kill")
    rows = rows.withColumn("path", F.when(told, "facts").when(seen, "clients").when(F.col("ok") & F.col("name").isin(*GLOBAL), "keys").otherwise("run")).cache()
    keyed = key_rows(rows.where("path = 'run'"))
    tied = keyed.where(F.col("name").isin(*TIED))
    present = {(r["path"], r["name"]) for r in rows.where("ok").select("path", "name").distinct().collect()}
    paths = {path for path, _ in present}
    untied = spark.createDataFrame([], "key binary, grp binary")
    groups = _groups(tied) if {name for _, name in present} & set(TIED) else untied
    apart = F.col("name").isin(*APART)
    one = (
        F.when(F.col("name") == "mset", F.array(F.lit(b"mset"), F.col("key"), F.get("args", F.col("place") + 1)))
        .when(apart, F.array(F.get("args", F.lit(0)), F.col("key")))
        .otherwise(F.col("args"))
    )
    single = keyed.where(apart | (F.col("pos") == 0)).select("conn", "seq", "pos", "now_ms", one.alias("args"), "key")
    single = single.join(groups, "key", "left").withColumn("grp", F.coalesce("grp", "key"))
    start = None
    if ks is not None:
        start = ks.join(groups, "key", "left").select(
            F.lit(-1).cast("bigint").alias("conn"), F.lit(-1).cast("bigint").alias("seq"), F.lit(0).alias("pos"),
            F.col("expire_at").alias("now_ms"), F.array(F.lit(b"set"), F.col("value")).alias("args"), "key", F.coalesce("grp", "key").alias("grp"),
        )
    flush = rows.where("ok AND name IN ('flushall', 'flushdb')").select("conn", "seq", F.lit(-1).alias("pos"), "now_ms", "args")
    known = single.select("grp").distinct() if start is None else single.select("grp").union(start.select("grp")).distinct()
    wiped = flush.crossJoin(F.broadcast(known)).select("conn", "seq", "pos", "now_ms", "args", F.lit(None).cast("binary").alias("key"), "grp")
    cols = ["conn", "seq", "pos", "now_ms", "args", "key", "grp"]
    work = single.select(cols).unionByName(wiped.select(cols))
    if start is not None:
        work = work.unionByName(start.select(cols))
    done = work.groupBy("grp").applyInPandas(_run_group, _OUT).cache()
    parts = done.where("pos >= 0").join(rows.select("conn", "seq", "name"), ["conn", "seq"])
    whole = parts.where(~F.col("name").isin(*APART)).select("conn", "seq", "kind", "i", "s", "err", "elems")
    again = parts.where(F.col("name").isin(*APART)).groupBy("conn", "seq", "name").agg(
        F.sum("i").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "elems"))).alias("r")
    )
    joined = again.select(
        "conn",
        "seq",
        F.when(F.col("name") == "mget", "array").when(F.col("name") == "mset", "status").otherwise("int").alias("kind"),
        F.when(~F.col("name").isin("mget", "mset"), F.col("n")).alias("i"),
        F.when(F.col("name") == "mset", F.lit(b"OK")).alias("s"),
        F.lit(None).cast("string").alias("err"),
        F.when(F.col("name") == "mget", F.flatten(F.transform("r", lambda x: x["elems"]))).alias("elems"),
    )
    loose = rows.where("NOT ok OR (first_key = 0 AND path = 'run')")
    # sessions by connection, settings together, the rest spread
    by = F.when(F.col("ok") & F.col("name").isin(*SESSION), F.concat(F.lit("c"), F.col("conn").cast("string")))
    by = by.when(F.col("ok") & (F.col("name") == "config"), F.lit("config")).otherwise(F.pmod(F.xxhash64("seq"), F.lit(1024)).cast("string"))
    loose = loose.select("conn", "seq", F.lit(0).alias("pos"), "now_ms", "args", F.lit(None).cast("binary").alias("key"), by.cast("binary").alias("grp"))
    free = loose.groupBy("grp").applyInPandas(_run_group, _OUT)
    bare = free.where("pos >= 0").select("conn", "seq", "kind", "i", "s", "err", "elems")
    mutations = done.where("pos = -2").select("seq", "key", "value", "expire_at", "gone")
    answered = whole.unionByName(joined).unionByName(bare)
    replies = answered
    if "keys" in paths:
        replies = replies.unionByName(_global_reads(rows.where("path = 'keys'"), mutations, ks))
    if "clients" in paths:
        replies = replies.unionByName(_clients(rows, rows.where("path = 'clients'"), free.where("pos = -3")))
    if "facts" in paths:
        replies = replies.unionByName(_info(rows, rows.where("path = 'facts'"), answered, parts, mutations, ks))
    return replies, mutations


def _info(rows: DataFrame, asked: DataFrame, replies: DataFrame, parts: DataFrame, mutations: DataFrame, ks: DataFrame | None) -> DataFrame:
    """Replies of INFO, from the keyspace at its seq and from what came before it."""
    at = F.broadcast(asked.select(F.col("seq").alias("at"), F.col("now_ms").alias("now")))
    earlier = F.col("seq") < F.col("at")
    arity, n = F.col("arity"), F.size("args")
    fits = F.coalesce(F.when(arity > 0, n == arity).otherwise(n >= -arity) & arity.isNotNull(), F.lit(False))
    log = rows.select("conn", "seq", "name", fits.alias("fits"))
    calls = log.where("fits").join(at, earlier).groupBy("at", "name").agg(F.count(F.lit(1)).alias("n"))
    calls = calls.groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("calls"))
    other = log.join(at, F.col("seq") <= F.col("at")).groupBy("at").agg(
        F.countDistinct("conn").alias("conns"), F.count_if(~F.col("fits") & earlier).alias("rejected")
    )
    failed = replies.where("kind = 'error'").join(at, earlier).groupBy("at").agg(F.count(F.lit(1)).alias("failed"))
    found = parts.join(at, earlier).groupBy("at").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
    held = _versions(mutations, ks).join(at, earlier & (F.col("until").isNull() | (F.col("until") >= F.col("at"))))
    held = held.where((F.col("expire_at") == 0) | (F.col("expire_at") > F.col("now"))).groupBy("at").agg(
        F.count(F.lit(1)).alias("keys"), F.count_if(F.col("expire_at") != 0).alias("expires"), F.sum("bytes").alias("bytes")
    )
    facts = asked.select("conn", "seq", "name", F.transform(F.slice("args", 2, F.size("args")), lambda x: F.lower(x.cast("string"))).alias("sections"), F.col("seq").alias("at"))
    for part in (calls, other, failed, found, held):
        facts = facts.join(part, "at", "left")
    facts = facts.na.fill(0, ["rejected", "failed", "hits", "misses", "keys", "expires", "bytes"])

    @F.udf("binary")
    def text(sections, row):
        return info_text(sections, {**row.asDict(), "calls": row.calls or {}}).encode()

    names = ["calls", "conns", "rejected", "failed", "hits", "misses", "keys", "expires", "bytes"]
    pairs = (("keys.count", "keys"), ("keys.volatile", "expires"), ("dataset.bytes", "bytes"))
    counted = F.array(*(x for title, c in pairs for x in (_element("bulk", s=F.lit(title).cast("binary")), _element("int", i=F.col(c)))))
    info = F.col("name") == "info"
    return facts.select(
        "conn", "seq", F.when(info, "verbatim").otherwise("map").alias("kind"), F.when(~info, 3).cast("bigint").alias("i"),
        F.when(info, text("sections", F.struct(*names))).alias("s"), F.lit(None).cast("string").alias("err"), F.when(~info, counted).cast(_ELEM).alias("elems"),
    )


def _element(kind: str, i=None, s=None):
    """One element of a reply."""
    none = F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), (none if i is None else i).cast("bigint").alias("i"), (none if s is None else s).cast("binary").alias("s"))


def _client_reply(conn, now, args, seen):
    """CLIENT INFO, LIST or KILL over (conn, name, proto, first_ms, last_ms, last, calls) of all connections."""
    what, rest = bytes(args[1]).lower(), [bytes(a) for a in args[2:]]

    def line(c):
        name = bytes(c.client or b"").decode("utf-8", "replace")
        return f"id={c.conn} addr= laddr= name={name} age={(now - c.first_ms) // 1000} idle={(now - c.last_ms) // 1000} db=0 resp={c.proto or 2} cmd={c.last or 'NULL'} numcmds={c.calls}"

    if what == b"info":
        return ("bulk", None, line(next(c for c in seen if c.conn == conn)).encode(), None)
    if what == b"list":
        return ("bulk", None, "".join(line(c) + "\n" for c in sorted(seen, key=lambda c: c.conn)).encode(), None)
    if len(rest) == 1:
        return ("error", None, None, "ERR No such client address in client list")
    if len(rest) % 2:
        return ("error", None, None, SYNTAX)
    left, others = list(seen), True
    for option, value in zip(rest[::2], rest[1::2]):
        option = option.lower()
        if option == b"id":
            if not value.isdigit():
                return ("error", None, None, "ERR client-id should be greater than 0")
            left = [c for c in left if c.conn == int(value)]
        elif option in (b"addr", b"laddr"):
            left = [] if value else left
        elif option == b"skipme":
            others = value.lower() == b"yes"
        elif option == b"maxage":
            if not value.isdigit():
                return ("error", None, None, SYNTAX)
            left = [c for c in left if (now - c.first_ms) // 1000 >= int(value)]
        elif option not in (b"type", b"user"):
            return ("error", None, None, SYNTAX)
    return ("int", sum(c.conn != conn or not others for c in left), None, None)


def _clients(rows: DataFrame, asked: DataFrame, sessions: DataFrame) -> DataFrame:
    """Replies of CLIENT INFO, LIST and KILL, from each connection's commands up to their seq."""
    at = F.broadcast(asked.select(F.col("seq").alias("at")))
    known = F.when(F.col("arity").isNotNull(), F.col("name"))
    facts = rows.select("conn", "seq", "now_ms", known.alias("name")).join(at, F.col("seq") <= F.col("at")).groupBy("at", "conn").agg(
        F.min("now_ms").alias("first_ms"), F.max("now_ms").alias("last_ms"), F.max_by("name", "seq").alias("last"), F.count(F.lit(1)).alias("calls")
    )
    named = sessions.select("conn", "seq", "i", "s").join(at, F.col("seq") <= F.col("at")).groupBy("at", "conn").agg(
        F.max_by("s", "seq").alias("client"), F.max_by("i", "seq").alias("proto")
    )
    each = facts.join(named, ["at", "conn"], "left").groupBy("at").agg(
        F.collect_list(F.struct("conn", "client", "proto", "first_ms", "last_ms", "last", "calls")).alias("seen")
    )
    reply = F.udf(_client_reply, "struct<kind:string,i:bigint,s:binary,err:string>")
    made = asked.join(each, F.col("seq") == F.col("at")).select("conn", "seq", reply("conn", "now_ms", "args", "seen").alias("r"))
    return made.select("conn", "seq", "r.*", F.lit(None).cast(_ELEM).alias("elems"))


def _versions(mutations: DataFrame, ks: DataFrame | None) -> DataFrame:
    """seq, key, expire_at, bytes, until: the versions of each key and the seq that ended them."""
    size = (F.octet_length("key") + F.octet_length("value") + 64).cast("bigint").alias("bytes")
    versions = mutations.select("seq", "key", "expire_at", "gone", size)
    if ks is not None:
        versions = versions.unionByName(ks.select(F.lit(-1).cast("bigint").alias("seq"), "key", "expire_at", F.lit(False).alias("gone"), size))
    return versions.withColumn("until", F.lead("seq").over(Window.partitionBy("key").orderBy("seq"))).where("NOT gone").drop("gone")


def _read_options(name, args):
    """What a KEYS or SCAN asks for; a SCAN of another type than string has size 0."""
    args = [bytes(a) for a in args]
    if name == "keys":
        return (None, 0, 0, to_regex(args[1]))
    if name != "scan":
        return (None, 0, 0, None)
    if not (args[1].isdigit() and int(args[1]) < 1 << 64):
        return ("ERR invalid cursor", 0, 0, None)
    size, glob, kind, rest = SCAN_COUNT, b"*", b"string", args[2:]
    while rest:
        option = rest.pop(0).lower()
        if option not in (b"match", b"count", b"type") or not rest:
            return (SYNTAX, 0, 0, None)
        value = rest.pop(0)
        if option == b"match":
            glob = value
        elif option == b"type":
            kind = value.lower()
        else:
            size = argument_int(value)
            if size is None or size < 1:
                return (SYNTAX, 0, 0, None)
            size = min(size, SCAN_COUNT_MAX)
    return (None, min(int(args[1]), (1 << 63) - 1), size if kind == b"string" else 0, to_regex(glob))


def _global_reads(asked: DataFrame, mutations: DataFrame, ks: DataFrame | None) -> DataFrame:
    """Replies of reads of all keys, from the versions that were current at their seq.

    A SCAN pages through the keys by hash: its cursor is the hash to go on from, so pages
    of one keyspace are disjoint and a key that stays is met once.  Of each page a task
    sends at most the keys that SCAN's COUNT may name.
    """
    options = F.udf(_read_options, "struct<err:string,start:bigint,size:int,rx:string>")
    reads = asked.select("conn", F.col("seq").alias("at"), "now_ms", "name", options("name", "args").alias("o")).select("conn", "at", "now_ms", "name", "o.*")
    reads = reads.persist()
    h = _versions(mutations, ks).alias("h")
    met = h.join(
        F.broadcast(reads.where("err IS NULL").drop("conn")),
        (F.col("h.seq") < F.col("at"))
        & (F.col("until").isNull() | (F.col("until") >= F.col("at")))
        & ((F.col("expire_at") == 0) | (F.col("expire_at") > F.col("now_ms"))),
    ).withColumn("mark", F.xxhash64("key").bitwiseAND(F.lit((1 << 63) - 1)))
    fits = F.rlike(F.decode("key", "ISO-8859-1"), F.col("rx"))
    listed = F.sort_array(F.collect_list("key")).alias("found")
    total = met.where("name = 'dbsize'").groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    some = met.where("name = 'randomkey'").groupBy("at").agg(F.min_by("key", F.struct(F.xxhash64("key", "at"), "key")).alias("some"))
    hits = met.where(F.col("name") == "keys").where(fits).select("at", "key")
    few = hits.groupBy("at").agg(F.count(F.lit(1)).alias("hits"))
    matched = hits.join(F.broadcast(few.where(F.col("hits") <= MAX_KEYS_REPLY).select("at")), "at").groupBy("at").agg(listed)
    place = F.row_number().over(Window.partitionBy("at").orderBy("mark", "key"))
    page = met.where("name = 'scan' AND size > 0 AND mark >= start").select("at", "key", "mark", "size", "rx").withColumn("place", place)
    page = page.where(F.col("place") <= SCAN_COUNT_MAX + 1).where("place <= size + 1")
    paged = page.groupBy("at").agg(
        F.max(F.when(F.col("place") == F.col("size") + 1, F.col("mark"))).alias("next"),
        F.sort_array(F.collect_list(F.when((F.col("place") <= F.col("size")) & fits, F.col("key")))).alias("page"),
    )
    out = reads
    for part in (total, some, few, matched, paged):
        out = out.join(part, "at", "left")
    name, nothing = F.col("name"), F.array().cast("array<binary>")
    keys = F.coalesce(F.when(name == "keys", F.col("found")).otherwise(F.col("page")), nothing)
    shown = F.transform(keys, lambda k: _element("bulk", s=k)).cast(_ELEM)
    cursor = _element("bulk", s=F.coalesce("next", F.lit(0).cast("bigint")).cast("string"))
    too_many = (name == "keys") & (F.col("hits") > MAX_KEYS_REPLY)
    err = F.coalesce("err", F.when(too_many, F.lit(f"ERR KEYS matched more than {MAX_KEYS_REPLY} keys; use SCAN instead")))
    kind = F.when(err.isNotNull(), "error").when(name == "dbsize", "int").when(name == "randomkey", F.when(F.col("some").isNull(), "null").otherwise("bulk")).otherwise("array")
    return out.select(
        "conn",
        F.col("at").alias("seq"),
        kind.alias("kind"),
        F.when(err.isNotNull(), None).when(name == "dbsize", F.coalesce("n", F.lit(0))).when(name == "scan", 2).cast("bigint").alias("i"),
        F.when(name == "randomkey", F.col("some")).alias("s"),
        err.alias("err"),
        F.when(err.isNull() & (name == "keys"), shown)
        .when(err.isNull() & (name == "scan"), F.concat(F.array(cursor, _element("array", i=F.size(keys))).cast(_ELEM), shown))
        .alias("elems"),
    )


def keyspace_after(mutations: DataFrame, ks: DataFrame | None = None) -> DataFrame:
    rows = mutations.select("key", "seq", "value", "expire_at", "gone")
    if ks is not None:
        rows = rows.unionByName(ks.select("key", F.lit(-1).cast("bigint").alias("seq"), "value", "expire_at", F.lit(False).alias("gone")))
    last = rows.groupBy("key").agg(F.max_by(F.struct("value", "expire_at", "gone"), "seq").alias("r"))
    return last.where("NOT r.gone").select("key", "r.value", "r.expire_at")
