"""WARC records and a Merkle audit of their fixity.

Pages become WARC response records, laid out one after the other in archives of ARCHIVE records by global row number, so
that no archive grows with the input. A replica is audited without comparing its records one by one: each record is a
leaf (its hash, and the range of offsets that it fills), FAN neighbouring nodes are hashed into a parent that covers
their ranges, up to one root for each archive. Roots of two replicas are compared first, then only the children of nodes
that differ, level by level. Records are measured and hashed where they are read; only sizes and hashes are sorted
and numbered. All steps are DataFrame joins and aggregations; trees are cut in the shared checkpoint folder, since each
level reads them.

Places are the primary's: a directory gives each record's identity (page_id, key, and a number among equal ones) its archive and
place, and a replica's records are placed by it. A record that the replica has lost leaves its place empty and moves no other;
one that only the replica has gets a place after the primary's last. So an archive without damage keeps its root, whatever
happened elsewhere.

Null url or html count as empty. Repeated rows are records of their own, told apart by their number. A record that only one
replica has is reported as missing in the other, with the offset and length that it has where it is. An empty table has no roots and no damage.
Columns other than page_id, url and html aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiberlake.llm.common import Ordering, cut

ARCHIVE, FAN = 4_096, 16
LEVELS = 3  # FAN ** LEVELS == ARCHIVE


def records(pages: DataFrame) -> DataFrame:
    """page_id, key (stands for the page's url and html), record (a WARC response record; hashes and offsets are of its UTF-8 bytes)."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", F.xxhash64(url, html).alias("key"), F.concat(head, html, F.lit("\r\n\r\n")).alias("record"))


def measured(recs: DataFrame) -> DataFrame:
    """page_id, key, size, hash: what an audit needs of a record. Only these narrow rows are moved."""
    return recs.select("page_id", "key", F.octet_length("record").cast("long").alias("size"), F.sha2("record", 256).alias("hash"))


def identified(slim: DataFrame) -> DataFrame:
    """slim with row_number (by page_id and key) and copy (from 0 among records of one page_id and key)."""
    numbered = Ordering(slim, "page_id", "key").numbered(slim, [])
    first = numbered.groupBy("page_id", "key").agg(F.min("row_number").alias("_first")).select(F.col("page_id").alias("_id"), F.col("key").alias("_key"), "_first")
    met = numbered.join(first, numbered.page_id.eqNullSafe(F.col("_id")) & (numbered.key == F.col("_key")))
    return met.select("page_id", "key", "size", "hash", "row_number", (F.col("row_number") - F.col("_first")).alias("copy"))


def _at(place: Column) -> list[Column]:
    return [F.floor(place / F.lit(ARCHIVE)).alias("archive"), (place % ARCHIVE).cast("int").alias("no")]


def placed(slim: DataFrame) -> DataFrame:
    """The primary's records with copy, archive and no (place in the archive)."""
    return cut(identified(slim).select("page_id", "key", "copy", "size", "hash", *_at(F.col("row_number"))))


def placed_like(slim: DataFrame, primary: DataFrame) -> DataFrame:
    """A replica's records at the places of the primary's (placed) records; those that the primary lacks come after its last, by page_id, key and copy."""
    own = cut(identified(slim))
    directory = primary.select(F.col("page_id").alias("_id"), F.col("key").alias("_key"), F.col("copy").alias("_copy"), "archive", "no")
    met = own.join(directory, own.page_id.eqNullSafe(F.col("_id")) & (own.key == F.col("_key")) & (own["copy"] == F.col("_copy")), "left")
    known = met.where("archive is not null").select("page_id", "key", "copy", "size", "hash", "archive", "no")
    strange = cut(met.where("archive is null").select("page_id", "key", "copy", "size", "hash"))
    after = Ordering(strange, "page_id", "key").numbered(strange, ["copy"]).withColumn("_place", F.col("row_number") + F.lit(primary.count()))
    return known.unionByName(after.select("page_id", "key", "copy", "size", "hash", *_at(F.col("_place"))))


def leaves(put: DataFrame) -> DataFrame:
    """archive, level 0, node, hash, lo, hi (range of offsets), page_id."""
    w = Window.partitionBy("archive").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    return put.withColumn("hi", F.sum("size").over(w)).select("archive", F.lit(0).alias("level"), F.col("no").alias("node"), "hash", (F.col("hi") - F.col("size")).alias("lo"), "hi", "page_id")


def tree(put: DataFrame) -> DataFrame:
    """put: placed records. All nodes of the archives' trees: a parent hashes its children's places, hashes and lengths in order of offset."""
    out = level = cut(leaves(put))
    for k in range(1, LEVELS + 1):
        child = F.concat_ws(":", F.col("node"), F.col("hash"), F.col("hi") - F.col("lo"))
        level = (
            level.withColumn("_c", child)
            .groupBy("archive", F.floor(F.col("node") / F.lit(FAN)).cast("int").alias("parent"))
            .agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "_c"))), lambda s: s["_c"]), ","), 256).alias("hash"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .select("archive", F.lit(k).alias("level"), F.col("parent").alias("node"), "hash", "lo", "hi", F.lit(None).cast("long").alias("page_id"))
        )
        level = cut(level)
        out = out.unionByName(level)
    return out


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Damaged records by descent into mismatching branches. primary, replica: trees."""
    def side(t: DataFrame, level: int, p: str) -> DataFrame:
        return t.where(F.col("level") == level).select("archive", "node", *[F.col(c).alias(f"{p}_{c}") for c in ("hash", "lo", "hi", "page_id")])

    open_nodes = None
    for level in range(LEVELS, -1, -1):
        a, b = side(primary, level, "p"), side(replica, level, "r")
        if open_nodes is not None:
            up = open_nodes.withColumnRenamed("node", "_up")
            a = a.withColumn("_up", F.floor(F.col("node") / F.lit(FAN)).cast("int")).join(up, ["archive", "_up"], "left_semi").drop("_up")
            b = b.withColumn("_up", F.floor(F.col("node") / F.lit(FAN)).cast("int")).join(up, ["archive", "_up"], "left_semi").drop("_up")
        differ = a.join(b, ["archive", "node"], "full_outer").where(~F.col("p_hash").eqNullSafe(F.col("r_hash")))
        open_nodes = cut(differ.select("archive", "node")) if level else differ
    state = F.when(F.col("r_hash").isNull(), "missing in replica").when(F.col("p_hash").isNull(), "missing in primary").when(F.col("p_hi") - F.col("p_lo") != F.col("r_hi") - F.col("r_lo"), "length").otherwise("content")
    return open_nodes.select(F.coalesce("p_page_id", "r_page_id").alias("page_id"), F.col("archive").cast("long").alias("archive"), F.col("node").cast("long").alias("record_no"), F.coalesce("p_lo", "r_lo").alias("offset"), F.coalesce(F.col("p_hi") - F.col("p_lo"), F.col("r_hi") - F.col("r_lo")).alias("length"), F.col("p_hash").alias("primary_sha256"), F.col("r_hash").alias("replica_sha256"), state.alias("damage"))


def damaged_copy(recs: DataFrame) -> DataFrame:
    """A replica with known damage, for drills: the last character changed where page_id % 97 = 13, cut in half where page_id % 389 = 7, lost where page_id % 499 = 3, there twice where page_id % 701 = 9, and joined by one of its own (a negative page_id) where page_id % 599 = 5."""
    r, n = F.col("record"), F.char_length("record")
    flipped = F.concat(F.substring(r, F.lit(1), n - 5), F.lit("~"), F.substring(r, n - 3, F.lit(4)))
    changed = recs.withColumn("record", F.when(F.col("page_id") % 389 == 7, F.substring(r, F.lit(1), F.floor(n / 2).cast("int"))).when(F.col("page_id") % 97 == 13, flipped).otherwise(r))
    own = F.col("page_id")
    ids = F.when(own % 499 == 3, F.array().cast("array<bigint>")).when(own % 701 == 9, F.array(own, own)).when(own % 599 == 5, F.array(own, -own - 1)).otherwise(F.array(own))
    return changed.withColumn("page_id", F.explode(ids))
