"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from .common import read_documents
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_join
from .langid import language
from .mixing import mix
from .piece_lattice import digest_columns as piece_digests
from .piece_lattice import encode_documents
from .quality_forest import quality
from .secret_scan import digest_columns, secret_scan
from .suffix_dedup import digest_columns as suffix_digests
from .suffix_dedup import suffix_dedup
from .token_store import token_store
from .url_filter import url_filter


def op1_jaccard_join(spark, sf_dir):
    classes, _ = jaccard_join(spark, read_documents(spark, sf_dir))
    return classes.select("doc_id", "n_shingles", "component_id")


URL_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


def op2_url_filter(spark, sf_dir):
    return url_filter(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op3_secret_scan(spark, sf_dir):
    return digest_columns(secret_scan(spark, read_documents(spark, sf_dir)))


def tokenizer_file(name):
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_token_store(spark, sf_dir):
    return token_store(spark, read_documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op5_pieces(spark, sf_dir):
    return piece_digests(encode_documents(read_documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model")))


def op6_suffix_dedup(spark, sf_dir):
    return suffix_digests(suffix_dedup(spark, read_documents(spark, sf_dir)))


def op7_quality(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality(spark, read_documents(spark, sf_dir), labels).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "anomaly",
    )


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup(spark, read_documents(spark, sf_dir))


def op9_mixing(spark, sf_dir):
    taken, _ = mix(spark, read_documents(spark, sf_dir))
    return taken.select("doc_id", "size", "source_size", "target", "taken", "source")


def op10_language(spark, sf_dir):
    return language(spark, read_documents(spark, sf_dir))


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_url_filter": op2_url_filter,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_store": op4_token_store,
    "op5_pieces": op5_pieces,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality": op7_quality,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mixing": op9_mixing,
    "op10_language": op10_language,
}

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op8_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {_NORM} AS t FROM documents)""",
}
