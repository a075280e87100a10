"""A training corpus from raw documents: quality, exact copies, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns documents with
their columns; the last returns the token ids of every text. ``run`` writes each stage as Parquet in the shared
folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import byte_bpe, exact_dedup, mixing, near_dedup, quality_gam
from geoloom.llm.common import ready, table
from geoloom.llm.queries import tokenizer_file
from geoloom.session import settle


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, does not reject."""
    ready(spark)
    return quality_gam.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts: the one with the largest doc_id."""
    ready(spark)
    return exact_dedup.drop_duplicates(docs, as_read=True)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word Jaccard similarity of 0.8 or more: the one with the largest doc_id, as in exact dedup."""
    ready(spark)
    return near_dedup.one_of_each(docs, as_read=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated towards shares that follow the square root of their sizes, and shuffled."""
    ready(spark)
    return mixing.mix(docs).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text (little-endian, unsigned, 32 bits), their digest, and that of the bytes they decode to."""
    import public_tokenizers

    ready(spark)
    return byte_bpe.tokens(docs, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", without_copies),
    ("SimHash near-dedup", without_near_copies),  # SimHash variants and min-hashes, see near_dedup.py
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", encoded),
]

#: A fitted model and linked components have no SQL twin; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
