"""Shared pieces of the training-data operators: shared storage and table reads."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import small_table  # noqa: F401

WORD_SEPARATORS = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the session's ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder stands in, which only a
    local master may use: on a cluster other machines could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="keyloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/keyloom-{uuid.uuid4().hex}"
    for made in _scratch:
        made.append(folder)
    return folder


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Delete, at the end, the shared folders that operators made inside: their results must be written by then."""
    made: list[str] = []
    _scratch.append(made)
    try:
        yield
    finally:
        _scratch.remove(made)
        for folder in made:
            forget(spark, folder)


def materialise(spark: SparkSession, df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, cutting its lineage."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, folder: str) -> None:
    """Delete a shared folder that no later step reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text):
    """Lower-case A-Z alone; every other character stays.

    ``lower`` agrees on pure ASCII and is much faster there; other texts take
    the character map.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )
