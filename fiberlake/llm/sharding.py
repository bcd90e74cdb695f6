"""Sharding: a Feistel permutation of global row numbers, with cycle walking.

Row numbers 0..n-1 (ascending doc_id, then content) are permuted by an unbalanced Feistel network on an a x b grid with
a*b slightly above n; numbers that leave 0..n-1 walk on along their cycle. Shard and slot of a row are then
``permuted % shards`` and ``permuted // shards``: reproducible from the seed, computable for any row number, and shard
sizes differ by one row at most. Only DataFrame functions are used.

Nulls: a null text counts 8 bytes and CRC 0; null doc_ids sort first. Repeated rows get row numbers (and shards) of
their own. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiberlake.llm.common import Ordering

ROUNDS = 4
#: Walks that are planned for large tables. A step leaves 0..n-1 with probability below 2/sqrt(n), so 16 fail in a row less than once in 10**27.
WALKS = 16


def grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(n))
    return a, -(-n // a) if n else 1


def feistel(x: Column, n: int, seed: int) -> Column:
    """A bijection of 0..a*b-1."""
    a, b = grid(n)
    state = lambda left, right: F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(s: Column, k: Column) -> Column:
        left = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], k, F.lit(0)), F.lit(a)), F.lit(a))
        return state(left, F.pmod(s["r"] + F.pmod(F.xxhash64(left, k, F.lit(1)), F.lit(b)), F.lit(b)))

    keys = F.array(*[F.lit(seed * 1_000 + i) for i in range(ROUNDS)])
    return F.aggregate(keys, state(x % a, F.floor(x / F.lit(a))), step, lambda s: s["l"] + s["r"] * F.lit(a))


def permuted(x: Column, n: int, seed: int) -> Column:
    """A bijection of 0..n-1 by cycle walking; it never returns a number outside."""
    a, b = grid(n)
    walks = (a * b - n + 1) if n < 10_000 else WALKS
    once = F.transform(F.array(x), lambda v: feistel(v, n, seed))
    walk = lambda v: F.aggregate(F.sequence(F.lit(1), F.lit(walks)), v, lambda acc, _: F.when(acc < n, acc).otherwise(feistel(acc, n, seed)))
    done = F.transform(once, lambda v: F.when(v < n, v).otherwise(walk(v)))
    return F.get(F.transform(done, lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))), F.lit(0))


def shard(df: DataFrame, key: str, shards: int, seed: int = 1, ties: list | None = None) -> DataFrame:
    """df with row_number, shard int and slot long. ties order rows of one key; the first is a long column without nulls. The driver gets one row for each range bucket; the shuffle carries df's columns, so pass narrow ones."""
    if shards < 1:
        raise ValueError("shards must be positive")
    ties = ties or []
    order = Ordering(df, key, *ties[:1])
    n = order.rows
    put = order.numbered(df, ties[1:])
    to = permuted(F.col("row_number"), n, seed) if n else F.lit(0).cast("long")
    return put.withColumn("_to", to).withColumn("shard", (F.col("_to") % shards).cast("int")).withColumn("slot", F.floor(F.col("_to") / F.lit(shards))).drop("_to")


def document_shards(documents: DataFrame, shards: int = 24, seed: int = 1) -> DataFrame:
    narrow = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(8)).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
    )
    put = shard(narrow, "doc_id", shards, seed, ["text_crc32", "size"])
    return put.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
