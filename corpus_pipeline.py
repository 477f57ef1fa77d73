"""The corpus pipeline: five stages from raw documents to encoded, mixed ones.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import ascii_lower, forget, materialise, scratch, shared_dir
from keyloom.llm.exact_dedup import exact_dedup
from keyloom.llm.jaccard_join import jaccard_join
from keyloom.llm.langid import language
from keyloom.llm.mixing import mix
from keyloom.llm.piece_lattice import encode_documents
from keyloom.llm.queries import tokenizer_file

#: A prediction below this is no better than a guess between the languages.
MIN_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is a mere guess."""
    found = language(spark, docs, carry=True)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select("_row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of equal texts, the document with the largest doc_id, once."""
    kept = exact_dedup(spark, docs).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    own = F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256)
    left = docs.withColumn("_own_sha", own).join(
        kept, F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("_own_sha") == F.col("_kept_sha")), "left_semi"
    )
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["doc_id", "_own_sha"])
    return left.drop("_own_sha")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of similar texts, that with the smallest doc_id.

    Of several rows with that doc_id one stays; documents without a word all stay.
    """
    classes, _ = jaccard_join(spark, docs)
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    first = classes.where("root IS NOT NULL").groupBy("root").agg(F.min(row).alias("row")).select("row.doc_id", "row.text_hash")
    chosen = first.unionByName(classes.where("root IS NULL").select("doc_id", "text_hash").distinct())
    chosen = chosen.select(F.col("doc_id").alias("_kept_id"), F.col("text_hash").alias("_kept_hash"))
    keyed = docs.withColumn("_text_hash", F.xxhash64("text"))
    left = keyed.join(chosen, F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("_text_hash") == F.col("_kept_hash")), "left_semi")
    if not classes.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["doc_id", "_text_hash"])
    return left.drop("_text_hash")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents as the mix takes them.

    A document comes as often as its taken tokens make up its size, rounded, so a
    source's sum stays near its target; one without words takes none and stays once.
    Rows count each by itself, those that repeat a doc_id or are null too.
    """
    row = ["doc_id", "source", "_text_hash"]
    keyed = docs.withColumn("_text_hash", F.xxhash64("text"))
    taken, _ = mix(spark, keyed, keep=("_text_hash",))
    whole = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size"), 0)).cast("int")
    times = taken.select(*row, whole.alias("_times"))
    if not keyed.groupBy(*row).count().where("count > 1").isEmpty():  # rows alike: one takes the first count, one the next
        keyed = keyed.withColumn("_alike", F.row_number().over(Window.partitionBy(*row).orderBy(*docs.columns)))
        times = times.withColumn("_alike", F.row_number().over(Window.partitionBy(*row).orderBy("_times")))
        row = [*row, "_alike"]
    times = times.where("_times > 0").select("_times", *(F.col(c).alias(f"_of_{c}") for c in row))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in row]
    repeated = keyed.join(times, same).withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return repeated.select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document, with its best segmentations' scores."""
    return encode_documents(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_duplicates", drop_near_copies),
    ("source_mix", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Trained and iterative stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's rows."""
    folder = shared_dir(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = materialise(spark, stage(spark, docs, sf_dir), folder, name)
        if before:
            forget(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
