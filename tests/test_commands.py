import random

from keyloom.plans import commands
from keyloom.plans.machine import Machine
from keyloom.plans.table import key_places, table
from keyloom.sources import resp

START = 1_700_000_000_000
KEYS = [f"k{i}".encode() for i in range(10)]


def say(*args, now=START, m=None):
    return (m or Machine()).run([a if isinstance(a, bytes) else str(a).encode() for a in args], now)


def test_table():
    t = table()
    assert len(t) == 67 and key_places("mset", 5) == [1, 3] and key_places("del", 4) == [1, 2, 3] and key_places("ping", 1) == []


def test_set_options():
    m = Machine()
    assert say("SET", "k", "1", "NX", "XX", m=m)[3] == "ERR syntax error"
    assert say("SET", "k", "1", "EX", "0", m=m)[3] == "ERR invalid expire time in 'set' command"
    assert say("SET", "k", "1", "EX", "abc", m=m)[3] == "ERR syntax error"
    assert say("SET", "k", "1", "XX", m=m)[0] == "null"
    assert say("SET", "k", "1", "PX", "100", m=m)[2] == b"OK"
    assert say("SET", "k", "2", "KEEPTTL", "GET", m=m)[2] == b"1" and m.records[b"k"] == (b"2", START + 100)
    assert say("GET", "k", now=START + 100, m=m)[0] == "null"


def test_expire_chain():
    m = Machine({b"k": (b"v", START + 100_000)})
    assert [say("EXPIRE", "k", n, f, m=m)[1] for n, f in ((50, "NX"), (50, "XX"), (10, "GT"), (500, "GT"), (10, "LT"))] == [0, 1, 0, 1, 1]
    assert say("EXPIRE", "k", 1, "NX", "XX", m=m)[0] == "error"
    assert say("EXPIRE", "k", -1, m=m)[1] == 1 and not m.records


def test_numbers_and_ranges():
    m = Machine({b"n": (b"9223372036854775807", 0), b"f": (b"10.5", 0), b"z": (b"007", 0)})
    assert say("INCR", "n", m=m)[3] == "ERR increment or decrement would overflow"
    assert say("INCR", "z", m=m)[3] == "ERR value is not an integer or out of range"
    assert say("INCRBYFLOAT", "f", "0.1", m=m)[2] == b"10.6" and say("INCRBYFLOAT", "f", "-0.6", m=m)[2] == b"10"
    assert say("SETRANGE", "s", 5, "world", m=m)[1] == 10 and m.records[b"s"][0] == b"\0" * 5 + b"world"
    assert say("COPY", "none", "x", m=m)[:2] == ("int", 0) and say("RENAME", "none", "x", m=m)[3] == "ERR no such key"
    assert say("TTL", "n", m=m)[1] == -1 and say("TTL", "none", m=m)[1] == -2
    assert "unknown command" in say("bogus", "1", m=m)[3] and "wrong number" in say("get", m=m)[3]


def _random_command(rng):
    k = lambda: rng.choice(KEYS)
    return rng.choice(
        [
            [b"SET", k(), rng.choice([b"1", b"x"]), *rng.choice([[], [b"NX"], [b"EX", b"1"], [b"GET"]])],
            [b"get", k()], [b"incr", k()], [b"append", k(), b"7"], [b"del", k(), k(), k()], [b"mget", k(), k(), k()],
            [b"mset", k(), b"a", k(), b"5"], [b"msetnx", k(), b"a", k(), b"5"], [b"expire", k(), rng.choice([b"1", b"-1", b"5"])],
            [b"rename", k(), k()], [b"copy", k(), k(), b"REPLACE"], [b"exists", k(), k()], [b"dbsize"], [b"keys", b"k*"], [b"ttl", k()],
            [b"ping"], [b"get"], [b"bogus"], *([[b"flushall"]] if rng.random() < 0.1 else []),
        ]
    )


def test_log_of_commands_equals_one_machine(spark):
    rng = random.Random(5)
    rows = [(i % 3, i, START + i * 100, _random_command(rng)) for i in range(250)]
    m, want = Machine(), {}
    for _, seq, now, args in rows:
        if args[0] == b"dbsize":
            want[seq] = ("int", sum(m.look(k, now) is not None for k in list(m.records)), None, None, None)
        elif args[0] == b"keys":
            want[seq] = ("array", None, None, None, [("bulk", None, k) for k in sorted(k for k in list(m.records) if m.look(k, now))])
        else:
            r = m.run(args, now)
            want[seq] = (*r[:4], None if r[4] is None else [e[:3] for e in r[4]])
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    replies, mutations = commands.execute(spark, spark.createDataFrame(rows, "conn bigint, seq bigint, now_ms bigint, args array<binary>"))
    b = lambda x: None if x is None else bytes(x)
    got = {
        r.seq: (r.kind, r.i, b(r.s), r.err, None if r.elems is None else [(e.kind, e.i, b(e.s)) for e in r.elems]) for r in replies.collect()
    }
    assert got == want
    now = rows[-1][2]
    live = lambda d: {k: v for k, v in d.items() if v[1] == 0 or v[1] > now}
    after = {bytes(r.key): (bytes(r.value), r.expire_at) for r in commands.keyspace_after(mutations).collect()}
    assert live(after) == live(m.records)


def test_a_long_chain_of_renames_is_one_group(spark):
    keys = [f"r{i:04d}".encode() for i in range(600)]
    random.Random(9).shuffle(keys)
    rows = [(0, 0, START, [b"set", keys[0], b"v"])] + [(0, i + 1, START, [b"rename", a, b]) for i, (a, b) in enumerate(zip(keys, keys[1:]))]
    rows.append((0, len(rows), START, [b"get", keys[-1]]))
    replies, mutations = commands.execute(spark, spark.createDataFrame(rows, "conn bigint, seq bigint, now_ms bigint, args array<binary>"))
    got = {r.seq: bytes(r.s) if r.s is not None else r.err for r in replies.collect()}
    assert got == {**{k: b"OK" for k in range(len(rows) - 1)}, len(rows) - 1: b"v"}
    assert [bytes(r.key) for r in commands.keyspace_after(mutations).collect()] == [keys[-1]]


def test_every_command_of_the_table_gets_a_reply(spark):
    argued = {"command": [b"info", b"GET", b"nope"], "memory": [b"usage", b"k"], "object": [b"encoding", b"k"], "copy": [b"k", b"k2"], "select": [b"0"], "debug": [b"object", b"k"], "config": [b"get", b"max*"], "client": [b"list"], "scan": [b"0"]}
    rows = [(0, 0, START, [b"set", b"k", b"1"]), (1, 1, START, [b"get", b"k"]), (1, 2, START, [b"exists", b"k", b"none"]), (1, 3, START, [b"bogus"])]
    rows += [(1, 4, START, [b"incr", b"k", b"1"]), (2, 5, START, [b"set", b"x", b"yz", b"px", b"100"]), (2, 6, START, [b"incr", b"x"]), (0, 7, START, [b"INFO"]), (0, 8, START + 100, [b"info", b"Keyspace"])]
    rows += [(0, 9, START, [b"command", b"getkeys", b"mset", b"a", b"1", b"b", b"2"]), (0, 10, START, [b"command", b"docs", b"ping"]), (0, 11, START, [b"command"])]
    for name, (arity, *_) in table().items():
        rows.append((3, len(rows), START, [name.encode(), *argued.get(name, [b"1"] * (abs(arity) - 1))]))
    ks = spark.createDataFrame([(b"old", b"abc", 0)], "key binary, value binary, expire_at bigint")
    replies, _ = commands.execute(spark, spark.createDataFrame(rows, "conn bigint, seq bigint, now_ms bigint, args array<binary>"), ks)
    got = {r.seq: r for r in replies.collect()}
    assert sorted(got) == [r[1] for r in rows] and not [r for r in got.values() if r.err and "unknown command" in r.err and r.seq != 3]
    assert bytes(got[8].s) == b"# Keyspace\r\ndb0:keys=2,expires=0,avg_ttl=0\r\n"
    text = bytes(got[7].s).decode()
    assert got[7].kind == "verbatim" and "db0:keys=3,expires=1,avg_ttl=0" in text and "used_memory_dataset:203\r\n" in text
    for line in ("total_commands_processed:5", "total_commands_failed:3", "total_commands_rejected:2", "keyspace_hits:2", "keyspace_misses:1", "connected_clients:3", "cmdstat_set:calls=2"):
        assert line + "\r\n" in text, line
    elems = lambda seq: [(e.kind, e.i if e.s is None else bytes(e.s)) for e in got[seq].elems]
    assert elems(9) == [("bulk", b"a"), ("bulk", b"b")] and (got[11].i, len([e for e in elems(11) if e == ("array", 10)])) == (67, 67)
    wire = {r.seq: bytes(r.data) for r in resp.encode(replies).where("seq IN (10, 12)").collect()}
    assert wire[10].startswith(b"*2\r\n$4\r\nping\r\n*6\r\n$7\r\nsummary\r\n") and wire[10].endswith(b"$5\r\narity\r\n:-1\r\n")
    info = resp.encode(replies).where(f"seq = {next(r[1] for r in rows if r[3][:2] == [b'command', b'info'])}").first()
    assert bytes(info.data) == b"*2\r\n*10\r\n$3\r\nget\r\n:2\r\n*2\r\n+readonly\r\n+fast\r\n:1\r\n:1\r\n:1\r\n*0\r\n*0\r\n*0\r\n*0\r\n*-1\r\n"


def test_commands_about_sessions_settings_and_all_keys(spark):
    said = [
        (1, "hello 3 setname bob"), (2, "client setname al"), (1, "client getname"), (2, "set k 12"), (2, "object encoding k"), (1, "object freq k"),
        (1, "memory usage k"), (1, "memory usage none"), (2, "debug object k"), (1, "memory stats"), (1, "client info"), (2, "client list"), (2, "client kill id 1"),
        (2, "client kill skipme no"), (1, "config set loglevel warn"), (2, "config get LOG* maxc*"), (2, "config set port 1"), (2, "config set nope 1"),
        (1, "reset"), (1, "client getname"), (3, "scan x"), (3, "scan 0 count 0"), (3, "scan 0 type hash"), (3, "hello 9"), (3, "randomkey"),
        (3, "memory stats"), (3, "client id"),
    ]
    rows = [(c, k, START + 1000 * k, [w.encode() for w in line.split()]) for k, (c, line) in enumerate(said)]
    replies, _ = commands.execute(spark, spark.createDataFrame(rows, "conn bigint, seq bigint, now_ms bigint, args array<binary>"))
    wire = {r.seq: bytes(r.data) for r in resp.encode(replies).collect()}
    got = {line: wire[k] for k, (_, line) in enumerate(said)}
    assert sorted(wire) == list(range(len(said)))
    assert wire[2] == b"$3\r\nbob\r\n" and wire[19] == b"$-1\r\n" and got["hello 3 setname bob"].startswith(b"*14\r\n$6\r\nserver\r\n")
    assert got["object encoding k"] == b"$3\r\nint\r\n" and b"LFU" in got["object freq k"] and got["memory usage k"] == b":67\r\n"
    assert got["memory usage none"] == b"$-1\r\n" and b"serializedlength:2 " in got["debug object k"]
    assert wire[9] == b"*6\r\n$10\r\nkeys.count\r\n:1\r\n$13\r\nkeys.volatile\r\n:0\r\n$13\r\ndataset.bytes\r\n:67\r\n" == wire[25]
    assert got["client info"].endswith(b"id=1 addr= laddr= name=bob age=10 idle=0 db=0 resp=3 cmd=client numcmds=7\r\n")
    assert got["client list"].count(b"\n") == 4 and b"id=2 addr= laddr= name=al age=10 " in got["client list"]
    assert got["client kill id 1"] == b":1\r\n" and got["client kill skipme no"] == b":2\r\n" and got["client id"] == b":3\r\n"
    assert got["config get LOG* maxc*"] == b"*4\r\n$8\r\nloglevel\r\n$4\r\nwarn\r\n$10\r\nmaxclients\r\n$5\r\n10000\r\n"
    assert b"not modifiable" in got["config set port 1"] and b"Unknown option" in got["config set nope 1"]
    assert got["scan x"] == b"-ERR invalid cursor\r\n" and got["scan 0 count 0"] == b"-ERR syntax error\r\n"
    assert got["scan 0 type hash"] == b"*2\r\n$1\r\n0\r\n*0\r\n" and got["hello 9"].startswith(b"-NOPROTO") and got["randomkey"] == b"$1\r\nk\r\n"


def test_scan_pages_meet_every_key_once(spark):
    ks = spark.createDataFrame([(f"k{i}".encode(), b"v", 0) for i in range(57)], "key binary, value binary, expire_at bigint")
    cursor, met, pages = b"0", [], 0
    while pages == 0 or cursor != b"0":
        cmd = [(0, 0, START, [b"scan", cursor, b"count", b"10", b"match", b"k[1-9]*"])]
        replies, _ = commands.execute(spark, spark.createDataFrame(cmd, "conn bigint, seq bigint, now_ms bigint, args array<binary>"), ks)
        row = replies.first()
        cursor, keys = bytes(row.elems[0].s), [bytes(e.s) for e in row.elems[2:]]
        assert row.i == 2 and row.elems[1].i == len(keys) <= 10
        met, pages = met + keys, pages + 1
    assert pages == 6 and sorted(met) == sorted(f"k{i}".encode() for i in range(1, 57))
