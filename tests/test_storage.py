import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions import coding
from keyloom.operators import lsm, read
from keyloom.plans import log
from keyloom.sources import binlog, config, resp, storage
from keyloom.streaming import fold

NOW = 1_700_000_000_000


def _log(spark, rows):
    return spark.createDataFrame(rows, "lsn bigint, pos int, op string, key string, value string, expire_at bigint")


def test_replay_flush_and_batches(spark):
    rows = _log(spark, [(1, 0, "put", "a", "1", 0), (2, 0, "put", "b", "1", 0), (3, 0, "flushall", None, None, 0), (4, 0, "put", "a", "2", 0), (4, 1, "put", "a", "3", 5), (5, 0, "put", "c", "x", 0), (6, 0, "delete", "c", None, 0)])
    assert [tuple(r) for r in log.replay(rows).collect()] == [("a", "3", 5)]
    for s in range(7):
        whole = sorted(map(tuple, log.replay(rows).collect()))
        assert sorted(map(tuple, log.recover(log.snapshot(rows, s), s, log.trim(rows, s)).collect())) == whole
    assert log.check(rows).count() == 0
    assert {r.problem for r in log.check(rows.where("lsn <> 2")).collect()} == {"gap"}


def test_snapshot_and_log_files(spark, tmp_path):
    ks = spark.createDataFrame([(b"river", b"long", 0), (b"nothing", b"", 7), (b"\x01raw\xfe", bytes(range(256)), -4)], "key binary, value binary, expire_at bigint")
    storage.write_snapshot(ks, f"file://{tmp_path}/s", 9, NOW)
    image, facts = storage.read_snapshot(spark, f"file://{tmp_path}/s")
    assert facts["lsn"] == 9 and sorted(map(tuple, image.collect())) == sorted(map(tuple, ks.collect()))
    (folder,) = (tmp_path / "s").glob("image-*")
    image.limit(1).write.mode("append").parquet(f"file://{folder}/data")
    with pytest.raises(ValueError):
        storage.read_snapshot(spark, f"file://{tmp_path}/s")


def _run(spark, keys, value, dead=False):
    return spark.createDataFrame([(f"key:{i:06d}".encode(), dead, None if dead else f"{value}-{i}".encode(), 0) for i in keys], lsm.RUN)


def test_store_newest_wins_and_nothing_returns(spark, tmp_path):
    store = lsm.Store(spark, f"file://{tmp_path}/lsm", lsm.CompactionOptions(level0_trigger=2, level1_bytes=1 << 20, file_bytes=1 << 12))
    want = {}
    for k, (keys, dead) in enumerate([(range(300), False), (range(0, 300, 2), True), (range(100, 200), False), (range(150, 160), True)]):
        store.flush(_run(spark, keys, f"r{k}", dead), k + 1)
        want = {x: v for x, v in want.items() if not (dead and x in keys)} | ({} if dead else {i: f"r{k}-{i}" for i in keys})
        while store.compact_once(NOW):
            pass
        got = {int(bytes(r.key)[4:]): bytes(r.value).decode() for r in store.keyspace().collect()}
        assert got == want
    assert bytes(store.get(b"key:000100", NOW).first().value) == b"r2-100"
    assert [bytes(r.key) for r in store.scan(b"key:000150", 3, NOW).collect()] == [b"key:000160", b"key:000161", b"key:000162"]
    store.manifest().validate()
    assert store.stats().count() >= 1
    before = store.manifest()
    store.flush_all(9)
    assert store.keyspace().count() == 0 and store.keyspace(before).count() == len(want)
    store.sweep()


def test_scan_pages_cover_all_keys(spark):
    ks = spark.createDataFrame([(f"s{i:03d}".encode(), b"v", 5 if i % 7 == 0 else 0) for i in range(60)], "key binary, value binary, expire_at bigint")
    seen, cursor = [], "0"
    for _ in range(20):
        rows = read.scan(ks, NOW, read.key_of(cursor), 7).collect()
        seen += [bytes(r.key) for r in rows]
        cursor = read.cursor_of(rows[0].next_key)
        if cursor == "0":
            break
    assert seen == sorted(bytes(r.key) for r in ks.where("expire_at = 0").collect())
    with pytest.raises(ValueError):
        read.keys_reply(ks, b"*", NOW, budget=3)


def test_stream_resumes_between_batches(spark, tmp_path):
    rows = [(0, i, NOW + i, [b"incr", f"c{i % 5}".encode()]) for i in range(40)]
    schema = "conn bigint, seq bigint, now_ms bigint, args array<binary>"
    for part in (0, 1):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = fold.fold_stream(stream).writeStream.foreachBatch(lambda b, n: b.write.mode("append").parquet(f"{tmp_path}/out"))
        q.outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = {r.seq: r.i for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {i: i // 5 + 1 for i in range(40)}


def test_ingest_into_runs(spark, tmp_path):
    rows = spark.createDataFrame([(i + 1, 0, "delete" if i % 4 == 3 else "put", f"k{i % 6}".encode(), None if i % 4 == 3 else str(i).encode(), 0) for i in range(30)], "lsn bigint, pos int, op string, key binary, value binary, expire_at bigint")
    storage.append_log(rows, f"file://{tmp_path}/log")
    store = lsm.Store(spark, f"file://{tmp_path}/store")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/log")
    fold.ingest(stream, store, f"{tmp_path}/ck", NOW).awaitTermination()
    assert sorted(map(tuple, store.keyspace().collect())) == sorted(map(tuple, log.replay(rows).collect()))


def test_ingest_of_late_records(spark, tmp_path):
    """A second batch whose records have lower numbers than the first."""
    schema = "lsn bigint, pos int, op string, key binary, value binary, expire_at bigint"
    store = lsm.Store(spark, f"file://{tmp_path}/store")
    for rows in ([(10, 0, "put", b"a", b"1", 0)], [(4, 0, "put", b"late", b"2", 0), (5, 0, "put", b"late", b"3", 0)]):
        storage.append_log(spark.createDataFrame(rows, schema), f"file://{tmp_path}/log")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/log")
        fold.ingest(stream, store, f"{tmp_path}/ck", NOW).awaitTermination()
    assert sorted((bytes(r.key), bytes(r.value)) for r in store.keyspace().collect()) == [(b"a", b"1"), (b"late", b"3")]


def test_manifests_are_replaced_whole(spark, tmp_path):
    store = lsm.Store(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([(b"a", False, b"1", 0)], lsm.RUN)
    for n in range(3):
        store.flush(rows, n)
    (tmp_path / "store" / "part-torn").write_text("{")
    assert store._manifests() == [1, 2, 3] and len(store.manifest().files) == 3
    gone = store.sweep()
    assert "part-torn" in gone and store._manifests() == [3] and store.manifest().last_lsn == 2
    with pytest.raises(ValueError):
        store.install(lsm.Manifest(files=[lsm.RunFile(1, n, "x", 1, 1, "00", "ff") for n in (1, 2)]))
    assert len(store.manifest().files) == 3


def test_snapshot_survives_a_broken_one(spark, tmp_path):
    ks = spark.createDataFrame([(b"k1", b"v", 0), (b"", b"", 9)], "key binary, value binary, expire_at bigint")
    storage.write_snapshot(ks, f"file://{tmp_path}/s", 3, NOW)
    (tmp_path / "s" / "part-broken").mkdir()
    assert storage.read_snapshot(spark, f"file://{tmp_path}/s")[1]["lsn"] == 3
    storage.write_snapshot(ks.limit(1), f"file://{tmp_path}/s", 5, NOW)
    image, facts = storage.read_snapshot(spark, f"file://{tmp_path}/s")
    assert facts["lsn"] == 5 and image.count() == 1 and len(list((tmp_path / "s").glob("image-*"))) == 1


def test_frames(spark):
    data = b"*2\r\n$3\r\nGET\r\n$1\r\na\r\nPING  x\r\n\r\n*1\r\n$4\r\nPI"
    assert resp.requests(data)[0] == [[b"GET", b"a"], [b"PING", b"x"]]
    with pytest.raises(resp.BadFrame):
        resp.requests(b"*1\r\n!3\r\nGET\r\n")
    assert resp.reply_bytes("bool", 1, None, None, None, 3) == b"#t\r\n" and resp.reply_bytes("bool", 1, None, None, None) == b":1\r\n"
    frames = spark.createDataFrame([(1, data)], "conn bigint, data binary")
    assert resp.decode(frames).where(F.col("err").isNull()).count() == 2


def test_coding():
    assert coding.crc32c(b"123456789") == 0xE3069283 == coding.crc32c(b"6789", coding.crc32c(b"12345"))
    for n in (0, 1, 127, 128, 300, (1 << 63) - 1, (1 << 64) - 1):
        assert coding.read_unsigned(b"x" + coding.write_unsigned(n), 1) == (n, 1 + len(coding.write_unsigned(n)))
    for n in (0, -1, 1, -64, 64, -(1 << 63), (1 << 63) - 1):
        assert coding.read_signed(coding.write_signed(n))[0] == n
    assert coding.write_signed(-1) == b"\x01" and coding.write_unsigned(300) == b"\xac\x02"
    for bad in (b"", b"\x80", b"\xff" * 10 + b"\x01", b"\xff" * 9 + b"\x02"):
        with pytest.raises(ValueError):
            coding.read_unsigned(bad)
    with pytest.raises(ValueError):
        coding.read_bytes(b"\x05abc")


def test_binary_log_round_trip_and_torn_tail(spark, tmp_path):
    rows = [(1, 0, "put", "a", "1", 0), (2, 0, "put", "b", "1", -5), (2, 1, "delete", "a", None, None), (3, 0, "flushall", None, None, None), (4, 0, "delete", "c", None, None), (5, 0, "put", "ü", "", NOW)]
    parts = sorted(binlog.encode(_log(spark, rows), 2).collect(), key=lambda r: r.first)
    assert [r.first for r in parts] == [1, 3, 5]

    def write(*datas):
        for old in tmp_path.glob("*.wal"):
            old.unlink()
        for k, data in enumerate(datas):
            (tmp_path / f"{k:020d}.wal").write_bytes(data)
        found = binlog.read(spark, f"file://{tmp_path}").collect()
        return sorted((r.lsn, r.pos, r.op, r.key and bytes(r.key).decode(), None if r.value is None else bytes(r.value).decode(), r.expire_at) for r in found)

    datas = [bytes(r.data) for r in parts]
    assert write(*datas) == rows
    assert [r.lsn for r in binlog.read(spark, f"file://{tmp_path}", 3).collect()] == [4, 5]
    for torn in (datas[1][:-1], datas[1][:-3], datas[1] + b"\0" * 5, datas[1][:-1] + b"!"):
        got = write(datas[0], torn)
        assert got == (rows[:5] if torn.startswith(datas[1]) else rows[:4])
        with pytest.raises(Exception, match="offset"):
            write(datas[0], torn, datas[2])
    with pytest.raises(Exception, match="go on"):
        write(datas[0], datas[2])
    with pytest.raises(Exception, match="bad magic"):
        write(b"nonsense" * 10)


def test_settings(spark):
    assert [config.size(t) for t in ("7", " 64MB ", "1k", "2 kb", "3g")] == [7, 64 << 20, 1000, 2048, 3 * 10**9]
    for bad in ("", "x", "-1", "1.5mb", "1tb"):
        with pytest.raises(ValueError):
            config.size(bad)
    text = "# a comment\n\nport 7000\nSAVE 60 5\nsave 10 1\nappendonly no\nproto-max-bulk-len 1mb\n"
    got = config.settings(text, {"KEYLOOM_MAXCLIENTS": "9", "OTHER": "x"}, loglevel="warn")
    assert (got["bind"], got["port"], got["save"], got["appendonly"], got["proto-max-bulk-len"], got["maxclients"], got["loglevel"]) == (":7000", "7000", "60 5 10 1", "no", "1048576", "9", "warn")
    assert config.directives("save")["save"] == "" and len(config.DEFAULTS) == 21
    for bad in ("nope 1", "port 1\nmaxclients x", "databases 2", "storage-engine disk", "appendfsync often"):
        with pytest.raises(ValueError, match="line"):
            config.directives(bad)


def test_replies_are_read_back(spark):
    data = b"+OK\r\n:-7\r\n$3\r\na\r\n\r\n*2\r\n*1\r\n#t\r\n$-1\r\n|1\r\n+k\r\n:1\r\n%1\r\n+a\r\n,1.5\r\n_\r\n=7\r\ntxt:abc\r\n$9\r\ncut"
    found, used = resp.replies(data)
    assert [r[0] for r in found] == [("status", None, b"OK"), ("int", -7, None), ("bulk", None, b"a\r\n"), ("array", 2, None), ("map", 1, None), ("null", None, None), ("verbatim", None, b"txt:abc")]
    assert found[3][1:] == [("array", 1, None), ("bool", 1, None), ("null", None, None)] and found[4][1:] == [("status", None, b"a"), ("double", None, b"1.5")]
    assert data[used:] == b"$9\r\ncut"
    for bad in (b"?x\r\n", b":x\r\n", b"+ab\n", b"$600000000\r\n", b"*1\r\n" * 66 + b"+x\r\n", b",x\r\n"):
        with pytest.raises(resp.BadFrame):
            resp.replies(bad)
    frames = spark.createDataFrame([(1, b"+a\r\n:5\r\n?\r\n"), (2, b"*1\r\n$1\r\nx\r\n")], "conn bigint, data binary")
    got = sorted((r.conn, r.seq, r.kind, r.i, r.err is not None, r.elems and len(r.elems)) for r in resp.decode_replies(frames).collect())
    assert got == [(1, 0, "status", None, False, None), (1, 1, "int", 5, False, None), (1, 2, None, None, True, None), (2, 0, "array", 1, False, 1)]
    asked = spark.createDataFrame([(1, b"PING\r\n*1\r\n$x\r\n")], "conn bigint, data binary")
    assert [(r.seq, r.args and [bytes(a) for a in r.args], r.err is None) for r in resp.decode(asked).orderBy("seq").collect()] == [(0, [b"PING"], True), (1, None, False)]


def test_store_calls(spark, tmp_path):
    store = lsm.Store(spark, f"file://{tmp_path}/calls", lsm.CompactionOptions(level0_trigger=2, level0_stop=2, level1_bytes=1 << 11, file_bytes=1 << 9))
    rows = lambda keys, v, e=0: spark.createDataFrame([(f"k{i:03d}".encode(), v, e) for i in keys], "key binary, value binary, expire_at bigint")
    store.put(rows(range(60), b"a"), 1, NOW)
    store.put(rows(range(50, 70), b"b", NOW), 2, NOW - 1)
    assert store.exact_len(NOW - 1) == 70 and store.exact_len(NOW) == 50 and store.estimated_len() == 80
    assert store.delete(rows([0, 0, 1, 55, 99], b""), 3, NOW) == 2
    assert store.estimated_len() < 80  # two runs were waiting, so the writer compacted them first
    batch = [(0, "put", b"k000", b"x", 0), (1, "delete", b"k000", None, 0), (0, "delete", b"k001", None, 0), (1, "put", b"k001", b"y", 0)]
    store.write(spark.createDataFrame(batch, "pos int, op string, key binary, value binary, expire_at bigint"), 4, NOW)
    assert store.get(b"k000", NOW).count() == 0 and bytes(store.get(b"k001", NOW).first().value) == b"y"
    start, met = b"", []
    while start is not None:
        page, start = store.page(start, 20, NOW)
        met += [bytes(r.key) for r in page.collect()]
    assert met == [f"k{i:03d}".encode() for i in range(1, 50)]


def test_compaction_goes_round(spark, tmp_path):
    files = [lsm.RunFile(1, n, f"run-{n}/f", 100, 1, f"{n}0", f"{n}9") for n in (3, 1, 2)]
    store, manifest = lsm.Store(spark, f"file://{tmp_path}/r", lsm.CompactionOptions(level1_bytes=10)), lsm.Manifest(files=files)
    order = []
    for _ in range(4):
        _, (one,), _ = store.pick(manifest)
        order.append(one.number)
        manifest.picked["1"] = one.max_key
    assert order == [1, 2, 3, 1]


def test_compactions_move_what_is_over_at_once(spark, tmp_path):
    """Files take the room of their keys, and a level goes below its budget in one compaction."""
    store = lsm.Store(spark, f"file://{tmp_path}/many", lsm.CompactionOptions(level0_trigger=1, level1_bytes=30_000, file_bytes=1 << 12))
    store.flush(_run(spark, range(2000), "a"), 1)
    assert store.compact_once(NOW)
    assert len(store.manifest().level(1)) > 10 and sum(f.size for f in store.manifest().files) < 200_000
    store.flush(_run(spark, range(0, 2000, 3), "b", True), 2)
    met = 0
    while store.compact_once(NOW):
        met += 1
        store.manifest().validate()
    levels = [sum(f.size for f in store.manifest().level(n)) for n in (0, 1, 2)]
    assert met <= 4 and levels[0] == 0 and levels[1] <= 30_000 and levels[2] > 0
    want = {f"key:{i:06d}": f"a-{i}" for i in range(2000) if i % 3}
    assert {bytes(r.key).decode(): bytes(r.value).decode() for r in store.keyspace().collect()} == want
    # a batch stays between neighbours: files of the level below that lie in its gaps go with it
    files = [lsm.RunFile(1, n, f"run-{n}/f", 100, 1, f"{n}0", f"{n}2") for n in range(1, 6)]
    files += [lsm.RunFile(2, 10 + n, f"run-{10 + n}/f", 1, 1, f"{n}5", f"{n}7") for n in range(1, 6)]
    some = lsm.Store(spark, f"file://{tmp_path}/r", lsm.CompactionOptions(level1_bytes=250))
    level, inputs, below = some.pick(lsm.Manifest(picked={"1": "12"}, files=files), batch=True)
    assert (level, [f.number for f in inputs], [f.number for f in below]) == (1, [2, 3, 4], [12, 13])
    assert [f.number for f in some.pick(lsm.Manifest(picked={"1": "42"}, files=files), batch=True)[1]] == [5]


def test_history_among_many_flushes(spark):
    """Flushes in clumps, twice, inside a batch, before and after all else; each record meets few of them."""
    rnd = random.Random(3)
    far = [-(1 << 63), -7, 0, 1 << 40, (1 << 63) - 1]
    rows = {(rnd.choice([rnd.randrange(-40, 400), rnd.randrange(10_000, 10_020), rnd.choice(far)]), rnd.randrange(3)): rnd.random() < 0.4 for _ in range(400)}
    marks = sorted(k for k, is_flush in rows.items() if is_flush)
    puts = sorted(k for k, is_flush in rows.items() if not is_flush)
    key = {k: f"k{rnd.randrange(9)}" for k in puts}
    made = [(*k, "put", key[k], "v", 0) for k in puts] + [(*k, "flushall", None, None, 0) for k in marks + marks[:5]]
    for flushes in (marks, marks[40:41], []):
        df = _log(spark, [r for r in made if r[2] == "put" or r[:2] in set(flushes)])
        want = [(key[k], k[0], min((o[0] for o in [*puts, *flushes] if o > k and (o in flushes or key[o] == key[k])), default=None)) for k in puts]
        assert sorted(tuple(r) for r in log.history(df).select("key", "valid_from", F.coalesce("valid_to", F.lit(-1))).collect()) == sorted((a, b, -1 if c is None else c) for a, b, c in want)
    # no row holds all flushes
    assert "collect_list" not in log.history(df)._jdf.queryExecution().optimizedPlan().toString()


def test_dbsize_keeps_the_history_in_place(spark):
    """Only the numbers asked for are sent to every task; a number asked for twice is answered once."""
    rows = _log(spark, [(n, 0, "flushall" if n % 5 == 0 else "put", None if n % 5 == 0 else f"k{n}", "v", 0) for n in range(1, 41)])
    sizes = log.dbsize_asof(rows, [0, 4, 4, 5, 13, 40], NOW)
    assert sorted(map(tuple, sizes.collect())) == [(0, 0), (4, 4), (5, 0), (13, 3), (40, 0)]
    nested = [line for line in sizes._jdf.queryExecution().sparkPlan().toString().splitlines() if "NestedLoop" in line and "valid_from" in line]
    assert nested and all("BuildRight, Inner" in line for line in nested)
    assert log.dbsize_asof(rows, [], NOW).count() == 0
