"""Document fingerprints by winnowing, in DataFrame functions only.

A text is cut into tokens: runs of letters, runs of digits, and each other sign by itself; so are the letters of scripts
that don't part words. Where a token begins depends on the characters beside it only, so an inserted character changes
its own token and no later one. Each run of ``k`` tokens is hashed (from its k token hashes: functions of arrays carry no
state from one place to the next), and of each window of ``w`` neighbouring hashes the smallest is selected, the
rightmost where several are equal. Any passage of at least ``k + w - 1`` equal tokens in two texts therefore selects a
common hash. A selected item is kept as one long: 39 bits of hash, then 24 bits that count down with the position, so
that the plain minimum of a window is the rightmost smallest hash.

Null and blank texts have no fingerprint (an empty array); a text of fewer than k tokens has the hash of all of them.
Two empty fingerprints have likeness 1, an empty one and another 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiberlake.llm.common import Ordering, let

K, W = 4, 8
#: Scripts whose words aren't parted by blanks: each letter is a token.
UNPARTED = "IsHan IsHiragana IsKatakana IsThai IsLao IsKhmer IsMyanmar".split()
TOKEN = r"[\p{L}\p{M}&&[^%s]]+|\p{N}+|\S" % "".join(rf"\p{{{x}}}" for x in UNPARTED)
POSITIONS = 1 << 24


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """array<bigint> of selected items in order of position."""

    def grams(h: Column) -> Column:
        at = lambda i, j: F.get(h, i + j)
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0))),
            lambda i: F.shiftrightunsigned(F.xxhash64(*[at(i, j) for j in range(k)]), 25) * POSITIONS + (POSITIONS - 1 - i % POSITIONS),
        )

    def select(g: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(g) - w, F.lit(0))), lambda j: F.array_min(F.slice(g, j + 1, F.lit(w)))))

    hashes = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    return let(hashes, lambda h: F.when(F.size(h) == 0, F.expr("cast(array() as array<bigint>)")).otherwise(let(grams(h), select)))


def hashes(items: Column) -> Column:
    return F.array_distinct(F.transform(items, lambda x: F.shiftright(x, 24)))


def positions(items: Column) -> Column:
    """Token positions of the selected k-grams (exact within 16 million tokens, then modulo that)."""
    return F.transform(items, lambda x: (F.lit(POSITIONS - 1) - F.pmod(x, F.lit(POSITIONS))).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of selected hashes."""
    of = lambda x, y: let(F.size(F.array_intersect(x, y)).cast("double"), lambda n: F.when(F.size(x) + F.size(y) == 0, F.lit(1.0)).otherwise(n / (F.size(x) + F.size(y) - n)))
    return let(hashes(a), lambda x: let(hashes(b), lambda y: of(x, y)))


def digest(items: Column) -> Column:
    """A string that is equal for equal fingerprints (hashes and positions)."""
    return F.sha2(F.array_join(F.transform(items, lambda x: F.hex(x)), ","), 256)


def fingerprints(documents: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, and the selected hashes with their positions for each document."""
    return documents.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), winnow(F.col("text"), k, w).alias("_f")).select("doc_id", "n_chars", F.transform(F.col("_f"), lambda x: F.shiftright(x, 24)).alias("hashes"), positions(F.col("_f")).alias("positions"))


def with_next(df: DataFrame, key: str, tie: str, columns: list[str]) -> DataFrame:
    """df with next_<column> of the following row by the key and the tie-breaker (a long), the first row following the last. The first of columns is the widest.

    Rows are dealt to ordered buckets; the first rows of a bucket also go to the bucket before it, so that each bucket
    finds its followers by itself and rows move once.
    """
    order = Ordering(df, key, tie, columns[0])
    n = len(order.first)
    if not n:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    here = F.struct(F.col("_b").alias("b"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(F.col("_b") - 1, F.lit(n)).cast("int").alias("b"), F.lit(True).alias("guest"))
    dealt = df.withColumn("_b", order.bucket()).withColumn("_to", F.explode(F.when(order.is_first(F.col("_b")), F.array(here, before)).otherwise(F.array(here))))
    w = Window.partitionBy("_to.b").orderBy("_to.guest", order.sort_key(), order.sort_tie(), columns[0])
    out = dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).where(~F.col("_to.guest"))
    return out.drop("_b", "_to")


def edited_fingerprints(documents: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of each text and of its edited text: its last half replaced by the first code points of the next document."""
    own = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.char_length("text").alias("n"), winnow(F.col("text"), k, w).alias("f"))
    both = with_next(own.withColumn("tie", F.xxhash64("text")), "doc_id", "tie", ["text", "f"])
    half = F.floor(F.col("n") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = both.select("doc_id", F.col("n").cast("long").alias("n_chars"), "f", "next_f", edited.alias("edited"))
    both = both.select("doc_id", "n_chars", "f", "next_f", F.sha2(F.col("edited"), 256).alias("edited_sha256"), winnow(F.col("edited"), k, w).alias("e"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", digest(F.col("f")).alias("fingerprint"), digest(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("next_f")).alias("near_next"), F.size("f").cast("long").alias("n_selected"),
    )
