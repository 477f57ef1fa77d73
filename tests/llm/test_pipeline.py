import os
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
import corpus_pipeline
from keyloom.llm import exact_dedup, mixing
from keyloom.llm.common import read_documents, small_table
from tests.conftest import SMALL

from . import brute

ROOT = Path(__file__).resolve().parents[2]


def test_stages_take_effect(spark, tmp_path):
    docs = read_documents(spark, SMALL)
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.collect()
        seen[name] = (before, after)
        if name != "sentencepiece":
            assert docs.columns == columns
    before, after = seen["exact_dedup"]
    last = {}
    for i, t in before:
        key = (t or "").translate({65 + k: 97 + k for k in range(26)})
        last[key] = max(last.get(key, -1), i)
    assert sorted(r.doc_id for r in after) == sorted(last.values())
    before, after = seen["near_duplicates"]
    assert sorted(r.doc_id for r in after) == sorted(i for i, (_, c) in brute.jaccard_components(before).items() if i == c)
    before, after = seen["sentencepiece"]
    assert len(before) == len(after) and all(r.round_trip for r in after)


def test_stages_on_odd_tables(spark):
    schema = read_documents(spark, SMALL).schema
    rows = [(1, "Hello there, world", "en", "a", 1), (1, "Hello there, world", "en", "a", 1), (None, None, None, None, None), (2, "", "en", None, 0), (3, "Der Hund", None, "b", 8)]
    for data in (rows, []):
        df = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, SMALL).collect()


def test_repeated_ids_are_rows_of_their_own(spark):
    """Rows that share a doc_id, or have none, but differ in text keep their own fate."""
    schema = read_documents(spark, SMALL).schema
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a, "en", "s", 1), (2, a + " z", "en", "s", 1), (2, b, "en", "s", 1), (None, c, "en", "t", 1), (None, c + " z", "en", "t", 1), (None, "", "en", "t", 0)]
    df = spark.createDataFrame(rows, schema)
    near = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.drop_near_copies(spark, df, SMALL).collect())
    assert [(i, t) for i, t in near if t in (a, b, "")] == [("1", a), ("2", b), ("None", "")] and len(near) == 4
    taken = {}
    for r in corpus_pipeline.mix(spark, df.withColumn("_text_hash", F.xxhash64("text")), keep=("_text_hash",))[0].collect():
        taken[r._text_hash] = round(r.taken / r.size) if r["size"] else 1
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    mixed = [r.text for r in corpus_pipeline.mix_sources(spark, df, SMALL).collect()]
    assert {t: mixed.count(t) for t in hashes} == {t: taken[h] for t, h in hashes.items()}


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names


def test_small_tables_start_no_further_workers(spark, tmp_path):
    """Tables of the driver's rows are part of the plan, not RDDs that a second set of Python workers unpickles."""
    rows = [("a", 3, 30, 15.0), (None, 2, 20, 35.0)]
    sources = "source string, n_docs long, source_size long, target double"
    made = small_table(spark, rows, sources)
    assert [tuple(r) for r in made.collect()] == rows
    assert small_table(spark, [], sources).collect() == [] and small_table(spark, [], sources).schema == made.schema
    schema = T.StructType.fromDDL("_digest binary, stays struct<doc_id: bigint, file: string>")
    stored = exact_dedup._stored(spark, f"{tmp_path}/none", schema)
    assert stored.schema == schema and stored.collect() == []
    for df in (made, stored, mixing.schedule(spark, rows, 64), mixing.schedule(spark, [], 64)):
        assert "ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()


def test_workers_give_memory_back():
    """A Python worker keeps little of what its tasks took: it lives on through the later stages."""
    anon = "sum(int(x.split()[1]) for x in open('/proc/self/smaps') if x.startswith('Anonymous:')) >> 10"
    code = f"""
import pyarrow as pa
from keyloom.llm import textops
batches = [pa.RecordBatch.from_arrays([pa.array(range(20000))], ["id"])] * 3

def run(batches):
    for b in batches:
        held = [bytearray(1000) + bytes([k % 256]) for k in range(100000)]
        yield len(held)

before = {anon}
for _ in textops.lean(run)(batches):
    pass
print(({anon}) - before)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)})
    assert int(got.stdout) < 30, got.stderr
