"""Log and snapshot folders as Parquet, tables of the driver's rows."""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import KS, LOG


def small_table(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A table of rows that the driver has, as a part of the plan.

    From a list of rows Spark makes an RDD of pickled ones, which starts a second daemon
    and set of Python workers on every executor, beside those of the operators.
    """
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    fields = to_arrow_schema(schema)
    columns = zip(*rows) if rows else ([] for _ in fields)
    return spark.createDataFrame(pa.table([pa.array(list(c), f.type) for c, f in zip(columns, fields)], schema=fields), schema)


def append_log(log: DataFrame, folder: str) -> None:
    log.select("lsn", "pos", "op", "key", "value", "expire_at").write.mode("append").parquet(folder)


def read_log(spark: SparkSession, folder: str, after: int = 0) -> DataFrame:
    """Records after ``after``; the filter is pushed to the files' statistics."""
    return spark.read.schema(LOG).parquet(folder).where(F.col("lsn") > after)


def _images(spark: SparkSession, folder: str) -> list[str]:
    """Names of the whole images in a folder, the newest last; those being written begin with ``part-``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(n for n in names if n.startswith("image-"))


def write_snapshot(ks: DataFrame, folder: str, lsn: int, created_at_ms: int) -> None:
    """Image and facts in a folder of their own, which gets its name when both are complete; older ones go after that."""
    spark = ks.sparkSession
    before = _images(spark, folder)
    part = f"{folder}/part-{uuid.uuid4().hex}"
    ks.select("key", "value", "expire_at").write.parquet(f"{part}/data")
    keys = spark.read.parquet(f"{part}/data").count()
    facts = json.dumps({"lsn": lsn, "created_at_ms": created_at_ms, "keys": keys})
    spark.createDataFrame([(facts,)], "value string").coalesce(1).write.text(f"{part}/meta")
    number = int(before[-1].partition("-")[2]) + 1 if before else 1
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.rename(path(part), path(f"{folder}/image-{number:012d}")):
        raise OSError("the snapshot could not be put in place")
    for name in before:
        fs.delete(path(f"{folder}/{name}"), True)


def read_snapshot(spark: SparkSession, folder: str, verify: bool = True) -> tuple[DataFrame, dict]:
    """(image, facts) of the newest snapshot; refuses an image with another number of keys than its facts say."""
    there = _images(spark, folder)
    if not there:
        raise FileNotFoundError(f"no snapshot in {folder}")
    folder = f"{folder}/{there[-1]}"
    facts = json.loads(spark.read.text(f"{folder}/meta").first()[0])
    image = spark.read.schema(KS).parquet(f"{folder}/data")
    if verify and (n := image.count()) != facts["keys"]:
        raise ValueError(f"snapshot holds {n} keys, its facts say {facts['keys']}")
    return image, facts
