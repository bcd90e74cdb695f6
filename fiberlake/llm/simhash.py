"""SimHash near-duplicates by anchor points.

Plan:
1. Each text becomes a 64-bit fingerprint: bit i is set if more than half of its shingles' hashes have it. Equal
   fingerprints are one point, so copies cost one aggregation.
2. Anchors: of two differing bits at most one lies in one of the fingerprint's halves. Each half of 32 bits has a covering
   code of its own: 31 bits in the Hamming code [31, 26] (every word is at most one bit from exactly one code word), the
   last bit free. So the covering radius is 1, and the threshold within a half is 1.
3. A point goes to every anchor of each half within covering radius plus threshold (2 bits): to the anchor next to it, its
   home, and to at most 16 others. Two points with at most one differing bit in a half meet at the home of either.
4. At each anchor points are compared with those at home there; links are pairs with 2 or fewer differing bits.
5. An anchor of more than CROWD points isn't compared. Its points are sent on to the 65 fingerprints within one bit of
   them: whole fingerprints as anchors, covering radius 0. Two points are linked just if their balls of one bit
   meet, and points that meet are within two bits, so the smallest of at most 65 leads the others: linear, nothing compared.
6. Connected components of the links, in Spark.

Words: runs of non-blank characters, A-Z lower-cased; a text of fewer than three words is one shingle. Null, empty and blank
texts have fingerprint zero, which is linked like any other. Links hold between rows: repeated rows are each returned, and rows of
one doc_id with different texts are points of their own. Rows with a null doc_id link nothing and have no
component. An empty table gives an empty result; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiberlake.llm import tokens
from fiberlake.llm.common import cut
from fiberlake.llm.near_duplicates import components

SEED, WORDS = 42, 3
#: Points of an anchor that are compared with its own at most.
CROWD = 512
#: Shingles whose bits are added up at once.
PIECE = 1 << 14
HALF, CODE = 32, 31


def fingerprint(text: bytes, k: int = WORDS) -> int:
    """SimHash of a text's runs of k words, repeats included; its bits are those set in over half of the XXH64 hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    width = min(k, len(words))
    stop = (stops[width - 1 :] - 1).tolist()
    start = [0, *stops[: len(stop) - 1].tolist()]
    set_bits = np.zeros(64, np.int64)
    for lo in range(0, len(stop), PIECE):
        part = range(lo, min(lo + PIECE, len(stop)))
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[start[i] : stop[i]], SEED) for i in part), np.uint64, len(part))
        set_bits += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(stop), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, point (the fingerprint's 64 bits as a long)."""

    @F.pandas_udf("long")
    def point(texts: pd.Series) -> pd.Series:
        tokens.give_back()
        return pd.Series(np.array([fingerprint(t) for t in tokens.as_bytes(texts)], np.uint64).view(np.int64))

    return documents.select("doc_id", point("text").alias("point"))


def syndromes(halves: np.ndarray) -> np.ndarray:
    """Of the low CODE bits: the place (from 1) of the bit that leads to the nearest code word, 0 at one."""
    out = np.zeros(len(halves), np.uint64)
    for place in range(1, CODE + 1):
        out ^= ((halves >> np.uint64(place - 1)) & np.uint64(1)) * np.uint64(place)
    return out


def anchors_near(halves: np.ndarray) -> np.ndarray:
    """A row of anchors for each half: first its home, then the others at 2 bits or fewer; where there are fewer, home again.

    One bit short of a code word, the pairs of flipped places with the point's syndrome as exclusive or lead to the others, and the free bit
    makes one more; at a code word, only the free bit does.
    """
    one = np.uint64(1)
    s = syndromes(halves)
    home = halves ^ np.where(s > 0, one << np.maximum(s, one) - one, np.uint64(0))
    out = [home, home ^ (one << np.uint64(CODE))]
    for a in range(1, CODE + 1):
        b = s ^ np.uint64(a)
        pair = (s > 0) & (b > a)
        out.append(np.where(pair, halves ^ (one << np.uint64(a - 1)) ^ (one << np.maximum(b, one) - one), home))
    return np.stack(out, 1)


def at_anchors(points: DataFrame) -> DataFrame:
    """anchor (of either half), point, home: each point at all of its anchors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf["point"].to_numpy(np.int64).view(np.uint64)
            for half in (0, 1):
                near = anchors_near((x >> np.uint64(HALF * half)) & np.uint64((1 << HALF) - 1))
                kept = near != near[:, :1]
                kept[:, 0] = True
                i, j = np.nonzero(kept)
                yield pd.DataFrame({"anchor": (near[i, j] | np.uint64(half << HALF)).view(np.int64), "point": x[i].view(np.int64), "home": j == 0})

    return points.select("point").mapInPandas(run, "anchor long, point long, home boolean")


def links(points: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, b: links that connect all points (distinct) within two bits of each other."""
    put = at_anchors(points)
    filled = cut(put.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    calm, crowded = filled.where(F.col("n") <= crowd).select("anchor"), filled.where(F.col("n") > crowd).select("anchor")
    kept = put.join(calm, "anchor")
    own = kept.where("home").select(F.col("anchor").alias("_at"), F.col("point").alias("a"))
    near = own.join(kept.select("anchor", F.col("point").alias("b")), (F.col("_at") == F.col("anchor")) & (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    sent = put.join(crowded, "anchor", "left_semi").select("point").distinct()
    ball = sent.select("point", F.explode(F.concat(F.array("point"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("point").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))).alias("at"))
    led = ball.groupBy("at").agg(F.collect_list("point").alias("all")).where(F.size("all") > 1).select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")
    return near.union(led)


def classes(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """point, component_id (smallest doc_id that links reach) of all points. prints: doc_id, point."""
    first = cut(prints.where("doc_id is not null").groupBy("point").agg(F.min("doc_id").alias("first")))
    joined = cut(components(links(first, crowd)).withColumnRenamed("doc_id", "_point"))
    met = first.join(joined, first.point == F.col("_point"), "left").select("point", "first", F.coalesce("component", "point").alias("_class"))
    least = met.groupBy("_class").agg(F.min("first").alias("component_id"))
    return met.join(least, "_class").select("point", "component_id")


def as_hex(point: Column) -> Column:
    return F.lpad(F.lower(F.hex(point)), 16, "0")


def simhash_near_duplicates(documents: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    prints = cut(fingerprints(documents))
    found = classes(prints, crowd).withColumnRenamed("point", "_point")
    known = F.col("doc_id").isNotNull()
    return prints.join(found, prints.point == F.col("_point"), "left").select("doc_id", as_hex(F.col("point")).alias("fingerprint"), F.when(known, F.col("component_id")).alias("component_id"))
