"""Exact dedup as a stateful stream over content digests.

Every text is normalised (A-Z lower-cased, null taken as empty) and reduced to
a SHA-256 digest.  A Structured Streaming aggregation keyed by the digest keeps,
in RocksDB state that never expires, the group's size, its stable identifier
(the largest doc_id) and a locator of the content that stays (file and row).
Partial aggregation runs before the shuffle, so a digest that a third of all
rows share costs one row for each map task.

A store is a folder that holds the state with its checkpoint, the arrivals and what
changed in each micro-batch.  An arrival that comes later meets the state that earlier
ones left.  Without a folder of its own a run starts with an empty store.

A digest seen before is a hit.  The whole texts of an arrival's hits, and those that the
locators kept before name, are then compared byte for byte: distinct texts are taken by
digest *and* text, pre-aggregated on the map side, and a digest with several is a clash.
The texts of a clash are told apart by the text itself.  A bitmap of the hits, of fixed
size, spares other rows the shuffle.

Everything on the path is DataFrame and SQL code.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, shared_dir, small_table

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bits of the filter for hits (4 MB); a full one drops nothing.
FILTER_BITS = 1 << 25


@contextmanager
def _rocksdb(spark: SparkSession):
    """Run with disk-backed state of bounded memory, then restore the settings."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": _ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # many small stores: each would set aside megabytes for its log otherwise
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def normalised(docs: DataFrame) -> DataFrame:
    """Adds norm_text and its digest as ``_digest``; null texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("_norm", ascii_lower(text)).withColumn("_digest", F.unhex(F.sha2("_norm", 256)))


def _locator():
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )


def drain(spark: SparkSession, stream: DataFrame, folder: str) -> T.StructType:
    """Run what is new in ``stream`` (columns doc_id, text) through the store's keyed state.

    The state of a digest: ``_digest, group_size, stays`` where ``stays`` is the struct
    (doc_id, file, row) of the row that stays.  Each micro-batch writes the keys it
    changed under its own batch number, so a batch that is run again after a failure
    replaces its own output.  Returns the schema of these rows.
    """
    keyed = normalised(stream.select("doc_id", "text", _locator().alias("_at"))).select(
        "_digest", F.struct("doc_id", "_at.file", "_at.row").alias("_row")
    )
    state = keyed.groupBy("_digest").agg(F.count(F.lit(1)).alias("group_size"), F.max("_row").alias("stays"))

    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changed/batch={number}")

    with _rocksdb(spark):
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/stream")
            .trigger(availableNow=True)
            .foreachBatch(changed)
            .start()
        )
        query.awaitTermination()
    return T.StructType([*state.schema.fields, T.StructField("batch", T.LongType())])


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of the store; empty where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return small_table(spark, [], schema)


def _latest(changed: DataFrame) -> DataFrame:
    """The state from its changes: both values only grow, hence a key's newest is its maximum."""
    return changed.groupBy("_digest").agg(F.max("group_size").alias("group_size"), F.max("stays").alias("stays"))


def _in_place(spark: SparkSession, docs: DataFrame) -> str | None:
    """The folder or file that ``docs`` is a plain read of, all of it and nothing else; else None."""
    files = set(docs.inputFiles())
    if not files or docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return None
    if len(files) == 1 and min(files).endswith(".parquet"):
        folder, _, name = min(files).rpartition("/")
        return f"{folder}/{{{name}}}"  # a stream reads one file by a pattern only
    folders = {f.rpartition("/")[0] for f in files}
    if len(folders) > 1:
        return None
    path = folders.pop()
    return path if set(spark.read.schema(docs.schema).parquet(path).inputFiles()) == files else None


def _marked(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows whose digest may be among ``hits``, by a bitmap that every task gets."""
    h = F.pmod(F.xxhash64("_digest"), F.lit(FILTER_BITS)).alias("_h")
    marks = hits.select(h).groupBy(F.expr("bitmap_bucket_number(_h)").alias("_k")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(_h))").alias("_bits")
    )
    met = rows.withColumn("_h", h).withColumn("_p", F.expr("bitmap_bit_position(_h)")).join(
        F.broadcast(marks), F.expr("bitmap_bucket_number(_h)") == F.col("_k")
    )
    byte = "cast(conv(hex(substring(_bits, cast(_p div 8 as int) + 1, 1)), 16, 10) as int)"
    return met.where(F.expr(f"getbit({byte}, cast(_p % 8 as int)) = 1"))


def exact_dedup(spark: SparkSession, docs: DataFrame, folder: str | None = None) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    ``folder``: a store in shared storage.  ``docs`` are then its next arrival, and the
    result tells of all documents that have arrived.  Without it the store is new.

    ``keep_id`` is the largest doc_id among equal texts; exactly one row of a
    group has ``kept``, the one the state's locator names, so that repeated rows
    with one doc_id lose all but one.  Null doc_ids sort below all others.
    Null text is the empty text.  An empty table gives an empty result; further
    columns of ``docs`` are ignored, whatever their names.
    """
    source = arrival = _in_place(spark, docs) if folder is None else None
    folder = folder or shared_dir(spark)
    wanted = docs.select("doc_id", "text")
    if source is None:
        source, arrival = f"{folder}/rows/*", f"{folder}/rows/{uuid.uuid4().hex}"
        wanted.write.parquet(arrival)
    read = lambda path: normalised(spark.read.schema(wanted.schema).parquet(path).withColumn("_at", _locator()))
    stream = spark.readStream.schema(wanted.schema).parquet(source)
    at = T.StructType([T.StructField("doc_id", wanted.schema["doc_id"].dataType), T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])
    fields = [("_digest", T.BinaryType()), ("group_size", T.LongType()), ("stays", at), ("batch", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    before = _stored(spark, f"{folder}/changed", schema).agg(F.max("batch")).first()[0]
    drain(spark, stream, folder)
    changed = _stored(spark, f"{folder}/changed", schema)
    batches = [r.batch for r in changed.select("batch").distinct().collect()]
    state = _latest(changed) if len(batches) > 1 else changed.drop("batch")
    hits = changed.where(F.col("group_size") > 1).where(F.col("batch") > (-1 if before is None else before))
    content = _marked(read(arrival), hits).select("_digest", "_norm")
    if before is not None:  # what the locators named when this arrival came
        old = _latest(changed.where(F.col("batch") <= before)).join(hits.select("_digest"), "_digest", "left_semi")
        named = old.select(F.col("stays.file").alias("_file"), F.col("stays.row").alias("_row"))
        whole = read(source)
        content = content.unionByName(
            whole.join(named, (F.col("_at.file") == F.col("_file")) & (F.col("_at.row") == F.col("_row"))).select("_digest", "_norm")
        )
    texts = content.distinct().groupBy("_digest").count().where("count > 1").select("_digest")
    texts.write.mode("overwrite").parquet(f"{folder}/clashes/batch={max(batches, default=0)}")
    clashing = spark.read.schema("_digest binary, batch long").parquet(f"{folder}/clashes").select("_digest").distinct()
    full = read(source)
    out = _verdicts(full.drop("_norm", "text").join(state, "_digest"))
    if not clashing.isEmpty():  # different texts under one digest: the text itself is the key
        apart = full.join(clashing, "_digest", "left_semi")
        groups = apart.groupBy("_digest", "_norm").agg(
            F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "_at.file", "_at.row")).alias("stays")
        )
        light = full.drop("_norm", "text").join(clashing, "_digest", "left_anti")
        out = _verdicts(light.join(state, "_digest")).unionByName(_verdicts(apart.join(groups, ["_digest", "_norm"])))
    return out


def _verdicts(joined: DataFrame) -> DataFrame:
    return joined.select(
        "doc_id",
        F.col("stays.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        ((F.col("_at.file") == F.col("stays.file")) & (F.col("_at.row") == F.col("stays.row"))).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )
