"""Log-structured storage on sorted Parquet runs: manifest, reads, flush and compaction.

A run is a set of Parquet files sorted by key with columns key, is_delete, value,
expire_at.  The manifest is a JSON document that names the files of each level with their
key ranges; it is replaced as a whole, and a reader holds on to the one it began with.
Level 0 holds overlapping runs, newer ones in front; deeper levels don't overlap.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import SCAN_COUNT_MAX
from ..sources.storage import small_table

RUN = "key binary, is_delete boolean, value binary, expire_at bigint"


@dataclass
class CompactionOptions:
    level0_trigger: int = 4
    level0_stop: int = 12
    level1_bytes: int = 64 << 20
    level_factor: int = 10
    file_bytes: int = 64 << 20
    levels: int = 7


@dataclass
class RunFile:
    level: int
    number: int
    path: str
    size: int
    entries: int
    min_key: str  # hexadecimal
    max_key: str


@dataclass
class Manifest:
    next_number: int = 1
    last_lsn: int = 0
    last_batch: int = -1
    picked: dict[str, str] = field(default_factory=dict)  # by level: largest key of the file compacted last
    files: list[RunFile] = field(default_factory=list)

    def level(self, n: int) -> list[RunFile]:
        """Files newest first on level 0, by smallest key below."""
        mine = [f for f in self.files if f.level == n]
        return sorted(mine, key=lambda f: -f.number if n == 0 else f.min_key)

    def validate(self) -> None:
        for n in range(1, 1 + max((f.level for f in self.files), default=0)):
            row = self.level(n)
            for a, b in zip(row, row[1:]):
                if b.min_key <= a.max_key:
                    raise ValueError(f"files {a.number} and {b.number} overlap on level {n}")


def newest_wins(runs: DataFrame, key: str = "key", rank: str = "rk") -> DataFrame:
    """The row of lowest rank of each key, tombstones included."""
    return (
        runs.groupBy(key)
        .agg(F.min_by(F.struct(*[c for c in runs.columns if c != key]), rank).alias("r"))
        .select(key, "r.*")
    )


def merged(runs: DataFrame, key: str = "key", rank: str = "rk") -> DataFrame:
    """What a reader sees of several runs: the newest version unless it is a tombstone."""
    return newest_wins(runs, key, rank).where(~F.col("is_delete"))


def compact(runs: DataFrame, deeper: DataFrame, now: int | None = None, key: str = "key", rank: str = "rk") -> DataFrame:
    """The merge of ``runs``; drops tombstones and expired records that hide nothing deeper.

    ``deeper``: min_key, max_key of files below.  Their ranges are few, as a file holds
    millions of keys, and meet the keys in a range join.
    """
    rows = newest_wins(runs, key, rank)
    dead = F.col("is_delete")
    if now is not None and "expire_at" in rows.columns:
        dead = dead | ((F.col("expire_at") != 0) & (F.col("expire_at") <= now))
    hidden = rows.where(dead).join(deeper, (F.col("min_key") <= F.col(key)) & (F.col(key) <= F.col("max_key")), "left_semi")
    return rows.where(~dead).unionByName(hidden)


class Store:
    """A store in a folder that Spark can write."""

    def __init__(self, spark: SparkSession, folder: str, options: CompactionOptions | None = None):
        self.spark, self.folder, self.options = spark, folder.rstrip("/"), options or CompactionOptions()
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._fs_path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        path = self._fs_path(self.folder)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def _manifests(self) -> list[int]:
        """Numbers of the manifests there are, the newest last."""
        return sorted(int(n.removeprefix("MANIFEST-")) for n in self._names() if re.fullmatch("MANIFEST-[0-9]+", n))

    def manifest(self) -> Manifest:
        there = self._manifests()
        if not there:
            return Manifest()
        text = self.spark.read.text(f"{self.folder}/MANIFEST-{there[-1]}", wholetext=True).first()[0]
        raw = json.loads(text)
        return Manifest(**raw | {"files": [RunFile(**f) for f in raw["files"]]})

    def install(self, manifest: Manifest) -> None:
        """Make this the store's manifest in one step: a whole file gets the next number by a rename.

        Readers take the highest number, so a crash leaves the old manifest or the new one.
        Older ones stay until ``sweep``.
        """
        manifest.validate()
        part = f"{self.folder}/part-{uuid.uuid4().hex}"
        out = self.fs.create(self._fs_path(part))
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()
        target = self._fs_path(f"{self.folder}/MANIFEST-{max(self._manifests(), default=0) + 1}")
        if self.fs.exists(target) or not self.fs.rename(self._fs_path(part), target):
            raise OSError("another writer installed a manifest meanwhile")

    def write_run(self, rows: DataFrame, level: int, manifest: Manifest) -> list[RunFile]:
        """Range-partitioned sorted files of about ``file_bytes`` each, with their facts."""
        number = manifest.next_number
        path = f"{self.folder}/run-{number:08d}"
        size, keys = rows.agg(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 16), F.count(F.lit(1))).first()
        if not size:
            return []
        files = max(1, -(-size // self.options.file_bytes))
        (
            rows.repartitionByRange(int(files), "key")
            .sortWithinPartitions("key")
            .write.mode("overwrite")
            .option("parquet.bloom.filter.enabled#key", "true")
            # without a number of keys every file gets a filter of 1 MB
            .option("parquet.bloom.filter.expected.ndv#key", str(-(-keys // files)))
            .parquet(path)
        )
        facts = (
            self.spark.read.schema(RUN)
            .parquet(path)
            .groupBy(F.col("_metadata.file_path").alias("p"))
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.lower(F.hex(F.min("key"))).alias("lo"),
                F.lower(F.hex(F.max("key"))).alias("hi"),
                F.max("_metadata.file_size").alias("size"),
            )
            .collect()
        )
        facts.sort(key=lambda r: r["lo"])
        found = [RunFile(level, number + i, r["p"], r["size"], r["n"], r["lo"], r["hi"]) for i, r in enumerate(facts)]
        manifest.next_number = number + len(found)
        return found

    def flush(self, delta: DataFrame, lsn: int, batch: int | None = None) -> None:
        """Write one sorted run of the newest mutations as a level-0 run; ``batch`` numbers it for ``ingest``."""
        manifest = self.manifest()
        rows = delta.select("key", "is_delete", "value", "expire_at")
        manifest.files += self.write_run(rows, 0, manifest)
        manifest.last_lsn = max(manifest.last_lsn, lsn)
        manifest.last_batch = manifest.last_batch if batch is None else batch
        self.install(manifest)

    def read(self, manifest: Manifest | None = None, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        """All versions with their rank, from the files whose range meets [start, end]."""
        manifest = manifest or self.manifest()
        lo, hi = (start or b"").hex(), None if end is None else end.hex()
        wanted = [f for f in manifest.files if f.max_key >= lo and (hi is None or f.min_key <= hi)]
        if not wanted:
            return small_table(self.spark, [], RUN + ", rk bigint")
        # newest level-0 file first, then deeper levels; one scan with a rank by file
        ranks = {f.path: (f.level, -f.number if f.level == 0 else 0) for f in wanted}
        order = {v: k for k, v in enumerate(sorted(set(ranks.values())))}
        table = small_table(self.spark, [(p, order[v]) for p, v in ranks.items()], "p string, rk bigint")
        rows = self.spark.read.schema(RUN).parquet(*ranks).withColumn("p", F.col("_metadata.file_path"))
        if start is not None:
            rows = rows.where(F.col("key") >= F.lit(start))
        if end is not None:
            rows = rows.where(F.col("key") <= F.lit(end))
        return rows.join(F.broadcast(table), "p").drop("p")

    def keyspace(self, manifest: Manifest | None = None) -> DataFrame:
        return merged(self.read(manifest)).select("key", "value", "expire_at")

    def get(self, key: bytes, now: int) -> DataFrame:
        found = merged(self.read(None, key, key).where(F.col("key") == F.lit(key)))
        return found.where((F.col("expire_at") == 0) | (F.col("expire_at") > now)).select("value")

    def live(self, now: int, start: bytes | None = None) -> DataFrame:
        rows = merged(self.read(None, start)).where((F.col("expire_at") == 0) | (F.col("expire_at") > now))
        return rows.select("key", "value", "expire_at")

    def scan(self, start: bytes, limit: int, now: int) -> DataFrame:
        """A page in key order; ``limit`` is held between 1 and 100,000."""
        return self.live(now, start).orderBy("key").limit(max(1, min(limit, SCAN_COUNT_MAX)))

    def page(self, start: bytes, limit: int, now: int) -> tuple[DataFrame, bytes | None]:
        """(page, key to go on from): the latter is None behind the last page."""
        limit = max(1, min(limit, SCAN_COUNT_MAX))
        last = self.live(now, start).select("key").orderBy("key").limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("key")).first()
        return self.scan(start, limit, now), bytes(last["key"]) if last["n"] > limit else None

    def exact_len(self, now: int) -> int:
        return self.live(now).count()

    def estimated_len(self) -> int:
        """Entries that the manifest counts: versions, tombstones and expired records too."""
        return sum(f.entries for f in self.manifest().files)

    def write(self, mutations: DataFrame, lsn: int, now: int) -> None:
        """Append a batch (pos, op, key, value, expire_at) as one run, later positions over earlier ones.

        A writer that finds ``level0_stop`` runs waiting compacts first.
        """
        while len({f.path.rpartition("/")[0] for f in self.manifest().level(0)}) >= self.options.level0_stop and self.compact_once(now):
            pass
        last = mutations.groupBy("key").agg(F.max_by(F.struct("op", "value", "expire_at"), "pos").alias("m"))
        gone = F.col("m.op") == "delete"
        self.flush(last.select("key", gone.alias("is_delete"), F.when(~gone, F.col("m.value")).alias("value"), F.coalesce("m.expire_at", F.lit(0)).cast("bigint").alias("expire_at")), lsn)

    def put(self, rows: DataFrame, lsn: int, now: int) -> None:
        """Write key, value, expire_at; of a key named twice any one row stays."""
        self.write(rows.select(F.lit(0).alias("pos"), F.lit("put").alias("op"), "key", "value", "expire_at"), lsn, now)

    def delete(self, keys: DataFrame, lsn: int, now: int) -> int:
        """Delete keys; the number of them that were live, each counted once."""
        keys = keys.select("key").distinct()
        n = self.live(now).join(keys, "key", "left_semi").count()
        self.write(keys.select(F.lit(0).alias("pos"), F.lit("delete").alias("op"), "key", F.lit(None).cast("binary").alias("value"), F.lit(0).cast("bigint").alias("expire_at")), lsn, now)
        return n

    def flush_all(self, lsn: int) -> None:
        """A run of tombstones for every key."""
        rows = merged(self.read()).select("key", F.lit(True).alias("is_delete"), F.lit(None).cast("binary").alias("value"), F.lit(0).cast("bigint").alias("expire_at"))
        self.flush(rows, lsn)

    def pick(self, manifest: Manifest, batch: bool = False) -> tuple[int, list[RunFile], list[RunFile]] | None:
        """(level, its inputs, overlapping files below) of the most overdue compaction.

        A ``batch`` takes the files that would go one after another, up to the level's last,
        until the rest is within the level's budget.
        """
        scores = {0: len({f.path.rpartition("/")[0] for f in manifest.level(0)}) / self.options.level0_trigger}
        budgets = {n: self.options.level1_bytes * self.options.level_factor ** (n - 1) for n in range(1, self.options.levels - 1)}
        for n, budget in budgets.items():
            scores[n] = sum(f.size for f in manifest.level(n)) / budget
        level = max(scores, key=lambda n: (scores[n], -n))
        if scores[level] < 1 or (level and scores[level] <= 1):
            return None
        inputs = manifest.level(level)
        if level:  # round robin: the first file behind the one that went last, or the first of all
            behind = manifest.picked.get(str(level), "")
            first = next((i for i, f in enumerate(inputs) if f.max_key > behind), 0)
            over, last = sum(f.size for f in inputs) - inputs[first].size - budgets[level], first + 1
            while batch and over > 0 and last < len(inputs):
                over, last = over - inputs[last].size, last + 1
            inputs = inputs[first:last]
        lo, hi = min(f.min_key for f in inputs), max(f.max_key for f in inputs)
        return level, inputs, [f for f in manifest.level(level + 1) if f.min_key <= hi and lo <= f.max_key]

    def compact_once(self, now: int) -> bool:
        """One compaction if any is due; old files stay for readers of older manifests."""
        manifest = self.manifest()
        due = self.pick(manifest, batch=True)
        if due is None:
            return False
        level, inputs, below = due
        part = Manifest(manifest.next_number, manifest.last_lsn, files=inputs + below)
        if level:
            manifest.picked[str(level)] = inputs[-1].max_key
        deeper = [(bytes.fromhex(f.min_key), bytes.fromhex(f.max_key)) for f in manifest.files if f.level > level + 1]
        ranges = small_table(self.spark, deeper, "min_key binary, max_key binary")
        # kept until it is written: the size, the bounds of the files and the files are a pass each
        rows = compact(self.read(part), ranges, now).select("key", "is_delete", "value", "expire_at").persist()
        gone = {f.number for f in inputs + below}
        try:
            new = self.write_run(rows, level + 1, manifest)
        finally:
            rows.unpersist()
        manifest.files = [f for f in manifest.files if f.number not in gone] + new
        self.install(manifest)
        return True

    def sweep(self) -> list[str]:
        """Delete runs that the manifest no longer names; call when no reader is left."""
        named = {f.path.rpartition("/")[0].rpartition("/")[2] for f in self.manifest().files}
        last, gone = f"MANIFEST-{max(self._manifests(), default=0)}", []
        for name in self._names():
            if (name.startswith("run-") and name not in named) or (name.startswith(("MANIFEST-", "part-")) and name != last):
                self.fs.delete(self._fs_path(f"{self.folder}/{name}"), True)
                gone.append(name)
        return gone

    def stats(self) -> DataFrame:
        """level, files, bytes, entries."""
        rows = [(f.level, f.size, f.entries) for f in self.manifest().files]
        table = self.spark.createDataFrame(rows, "level int, size bigint, entries bigint")
        return table.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sum("entries").alias("entries"))


def overlaps(files: DataFrame) -> DataFrame:
    """Pairs of neighbouring files of a level below 0 whose ranges meet (level, min_key, max_key)."""
    w = Window.partitionBy("level").orderBy("min_key", "max_key")
    return files.where("level > 0").withColumn("before", F.lag("max_key").over(w)).where("before >= min_key")
