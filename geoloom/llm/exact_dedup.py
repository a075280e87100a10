"""Exact duplicates with the frequent texts split off.

A Misra-Gries summary of the digests (bounded counters, merged over tasks) names every digest that can make
up more than ``support`` of the rows. Those are counted exactly, and the verified ones, at most 1 / support
rows, are broadcast: their rows are settled where they are read. All other digests are grouped by a shuffle.
Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geoloom.llm.common import free, named, stay, with_rows
from geoloom.session import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text with A-Z in lower case; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), 256)


def frequent(rows: DataFrame, support: float) -> DataFrame:
    """Rows digest, group_size, top (key and row of the one that stays) of the verified frequent digests."""
    names = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest")).where("digest IS NOT NULL")
    return settle(_groups(rows.join(F.broadcast(names), "digest", "left_semi")).where("group_size > 1"))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("key", "row")).alias("top"))


def classes(rows: DataFrame, support: float = 1 / 512) -> DataFrame:
    """Add group_size and top to rows of row, key, digest."""
    heavy = F.broadcast(frequent(rows, support))  # at most 1 / support rows
    hot = rows.join(heavy, "digest")
    rest = rows.join(heavy.select("digest"), "digest", "left_anti")
    return hot.unionByName(rest.join(_groups(rest), "digest"))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", support: float = 1 / 512) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the row with the largest key stays. Null texts are
    empty, null keys are smaller than all others, of equal rows exactly one (the last read) stays, other columns are
    not read, and an empty table gives no rows.
    """
    rows = settle(docs.select(F.monotonically_increasing_id().alias("row"), named(key).alias("key"), digest(named(text)).alias("digest")))
    return classes(rows, support).select("key", F.col("top.key").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"),
                                         F.col("digest").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", support: float = 1 / 512, as_read: bool = False) -> DataFrame:
    """The documents that stay, with all their columns; ``as_read`` as in ``common.with_rows``."""
    (row,) = free(docs, "row")
    stored = with_rows(docs, row, as_read)
    rows = settle(stored.select(F.col(row).alias("row"), named(key).alias("key"), digest(named(text)).alias("digest")))
    return stay(stored, classes(rows, support).where("row = top.row").select("row"), row, docs.columns)
