"""Bounded training rows for the classifiers here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether a row is kept for evaluation: crc32 of its id as text; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, target: str, modulus: int, remainder: int, most: int) -> DataFrame:
    """doc_id, text and label of at most ``most`` rows that are not held out.

    The bound takes the rows with the least hash of their id, so that it does
    not follow the table's order. An id with several labels has the largest.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(target).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~is_held_out(F.col("doc_id"), modulus, remainder))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")  # ``most`` rows of 12 bytes
