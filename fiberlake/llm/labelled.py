"""A bounded sample of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(modulus: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves the remainder."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, label: str, training: Column, most: int) -> DataFrame:
    """Texts and labels (column y) of at most `most` training rows of each class, drawn by a hash of the doc_id.

    A doc_id with several labels counts as 1 if any is. The bound is the caller's parameter; the drawn ids are broadcast (at most 2 * most of them), so that no text is shuffled.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).where(training).groupBy("doc_id").agg(F.max("y").alias("y"))
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    return documents.select("doc_id", "text").join(F.broadcast(drawn[0].union(drawn[1])), "doc_id").select("text", "y")
