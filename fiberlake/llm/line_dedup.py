"""Line de-duplication across documents by range-partitioned hashes.

A line's key is the line stripped of ASCII blanks with A-Z lower-cased; keys of fewer than ``least`` code points are
left alone. Hashes of the keys (128 bits) go to range partitions by (hash, document) and are sorted there by document
and position, so a hash that a third of all documents hold is spread over many partitions. Each task streams its
rows in batches: the first document of a run of equal hashes keeps its lines. Only the first and the last run of a batch
can go on in a neighbouring batch or partition; their rows are passed on undecided and settled against the smallest
document of their hash (a pre-aggregated minimum). The result is a compressed bitmap for each text that loses lines, its bits set
where a line goes; texts are moved only to apply it.

A null or empty text is one empty line. Rows of one doc_id are one holder: they lose no line to each other, each loses
the lines that an earlier document holds. Null doc_ids count as one holder that comes last. Bitmaps belong to a holder and a text, so
many rows without an id are as many groups as they have texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiberlake.llm.common import cut, shuffle_width
from fiberlake.llm.tokens import give_back

BLANK = b" \t\n\x0b\x0c\r"
NO_ID = 2**63 - 1


def line_keys(text: bytes, least: int) -> Iterator[tuple[int, bytes]]:
    """(position, key) of the lines whose keys count."""
    for i, line in enumerate(text.split(b"\n")):
        key = line.strip(BLANK).lower()
        if len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least):
            yield i, key


def hashed_lines(documents: DataFrame, least: int) -> DataFrame:
    """h1, h2 (hash of the key), doc_id, row (tells texts of one doc_id apart), at (line number)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            give_back()
            ids, rows, ats, hashes = [], [], [], bytearray()
            for doc, row, text in zip(pdf["doc_id"], pdf["row"], pdf["text"]):
                raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
                for at, key in line_keys(raw, least):
                    ids.append(doc)
                    rows.append(row)
                    ats.append(at)
                    hashes += xxhash.xxh3_128_digest(key)
            both = np.frombuffer(bytes(hashes), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"h1": both[:, 0], "h2": both[:, 1], "doc_id": np.array(ids, np.int64), "row": np.array(rows, np.int64), "at": np.array(ats, np.int32)})

    kept = documents.select(holder().alias("doc_id"), row_key().alias("row"), "text")
    return kept.mapInPandas(run, "h1 long, h2 long, doc_id long, row long, at int")


def holder() -> Column:
    return F.coalesce("doc_id", F.lit(NO_ID))


def row_key() -> Column:
    """Tells texts of one holder apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows sorted by hash, document and position: rows to drop (sure), and all rows of runs at a batch's ends (not sure)."""
    for pdf in batches:
        if not len(pdf):
            continue
        h1, h2, doc = (pdf[c].to_numpy() for c in ("h1", "h2", "doc_id"))
        new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        run, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        ends = (run == 0) | (run == run[-1])
        yield pdf.assign(sure=~ends)[ends | (doc != doc[starts][run])]


def dropped_lines(documents: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, row, at: the lines that an earlier document holds."""
    lines = hashed_lines(documents, least)
    ordered = lines.repartitionByRange(4 * shuffle_width(documents.sparkSession), "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "row", "at")
    told = cut(ordered.mapInPandas(stream, "h1 long, h2 long, doc_id long, row long, at int, sure boolean"))
    undecided = told.where("not sure")
    firsts = undecided.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last")
    late = undecided.join(firsts, ["h1", "h2"]).where("doc_id <> first")
    return told.where("sure").select("doc_id", "row", "at").union(late.select("doc_id", "row", "at"))


def bitmaps(documents: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, row, dropped (deflated bits of the lines to drop): one row for each text that loses lines."""

    def pack(ats: pd.Series) -> pd.Series:
        out = []
        for a in ats:
            bits = np.zeros(int(max(a)) + 1, np.uint8)
            bits[np.asarray(a)] = 1
            out.append(zlib.compress(np.packbits(bits).tobytes()))
        return pd.Series(out, dtype=object)

    packed = F.pandas_udf(pack, "binary")
    return dropped_lines(documents, least).groupBy("doc_id", "row").agg(F.collect_set("at").alias("ats")).select("doc_id", "row", packed("ats").alias("dropped"))


def keep(text: str, dropped: bytes | None) -> tuple[int, int, str]:
    """(lines, dropped lines, text of the others)."""
    lines = text.split("\n")
    if dropped is None:
        return len(lines), 0, text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(dropped), np.uint8))
    left = [x for i, x in enumerate(lines) if i >= len(bits) or not bits[i]]
    return len(lines), len(lines) - len(left), "\n".join(left)


def line_dedup(documents: DataFrame, least: int = 10, digest: bool = False) -> DataFrame:
    """document (a struct of the documents' columns, its text the kept lines), n_lines, n_dropped; digest: doc_id, n_lines, n_dropped, kept_sha256."""
    maps = bitmaps(documents, least).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "dropped")
    keyed = (documents.select("doc_id", "text") if digest else documents).select(F.struct("*").alias("_d"), holder().alias("_id"), row_key().alias("_row"))
    met = keyed.join(maps, ["_id", "_row"], "left")

    def apply(texts: pd.Series, maps: pd.Series) -> pd.DataFrame:
        out = []
        for text, dropped in zip(texts, maps):
            n, gone, left = keep(text if isinstance(text, str) else "", dropped)
            out.append((n, gone, hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest() if digest else left))
        give_back()
        return pd.DataFrame(out, columns=["n", "gone", "left"])

    applied = F.pandas_udf(apply, "n long, gone long, left string")
    met = met.select("_d", applied("_d.text", "dropped").alias("_out"))
    n = [F.col("_out.n").alias("n_lines"), F.col("_out.gone").alias("n_dropped")]
    if digest:
        return met.select("_d.doc_id", *n, F.col("_out.left").alias("kept_sha256"))
    return met.select(F.col("_d").withField("text", F.col("_out.left")).alias("document"), *n)
