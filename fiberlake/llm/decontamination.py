"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some positions of a window of tokens and ignore the others, so a passage whose words were partly
replaced still shares hashes with the benchmark item. Hashes of all windows of all documents are joined with those of
the items; around each hit, document and item are compared token by token on the hit's diagonal. The best run (+1 for an
equal token, -PENALTY for another) is reported if it is long and equal enough; otherwise the whole overlap, from its first
to its last equal token, if it has IDENTITY of the item's tokens; of overlaps that share tokens of a document, the fullest.
Items of fewer than SHORTEST tokens must be there token by token (their mask ignores no position). The masks miss no such place: any IDENTITY of 5 to 10
tokens holds one of SHORT_MASKS, and of 11 to 23 tokens one of LONG_MASKS; longer ones can be cut into stretches of 12 to
23, of which one is as equal as the whole.

Seeds that one word repeated makes are kept as runs, and each diagonal is compared once, so that repetitive texts take time in
proportion to their diagonals.

The item index is broadcast in blocks of at most BLOCK_BYTES of item text (an index takes about 20 bytes for each byte of text); a larger
benchmark takes more passes over the documents. Documents are never shuffled. Items without tokens are in no document; null and empty texts have no overlap; repeated rows are reported
once each; null ids are returned as null. Case and composition of characters don't count, in any script; positions are
those of the folded text's tokens.
"""

from __future__ import annotations

import bisect
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiberlake.llm import tokens

#: Fixed masks: 1 is compared, 0 ignored. For items of fewer than LONG tokens, and for others.
SHORT_MASKS = ("1111", "11011", "10111", "11101", "111001")
LONG_MASKS = ("11111", "110111", "101111", "111011", "111101", "11010011")
LONG = 11
SHORTEST, LEAST_MATCHED, IDENTITY, PENALTY = 5, 13, 0.75, 2
BLOCK_BYTES, BITS = 4 << 20, 22
#: Hits, and then tokens, that are compared at once.
PIECE = 1 << 19
#: Hits that are held before they are made distinct and compared.
MOST_HITS = 1 << 22


def folded(text: str) -> str:
    """Canonical caseless form; tokens.words folds ASCII by itself."""
    return text if text.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).casefold())


def masked(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each window's compared tokens."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(int(mask, 2)), np.uint64)
    c = tokens._P ** np.arange(len(mask) + 2, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j, bit in enumerate(mask):
            if bit == "1":
                out += h[j : j + n] * c[j + 1]
        return tokens.mix(out)


def masks_of(n: int) -> tuple[str, ...]:
    """The masks that are applied to an item of n tokens."""
    return LONG_MASKS if n >= LONG else SHORT_MASKS if n >= SHORTEST else ("1" * n,) if n else ()


class Index:
    """Seeds of some items."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids, self.items = ids, []
        ends = tokens.separators(True)
        for t in texts:
            self.items.append(tokens.words([t], ends)[0])
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate([*self.items, np.empty(0, np.uint64)])
        self.least = np.where(self.sizes < SHORTEST, self.sizes, np.minimum(LEAST_MATCHED, np.ceil(IDENTITY * self.sizes).astype(np.int64)))
        self.masks = sorted({m for x in self.items for m in masks_of(len(x))})
        seeds, item, at = [], [], []
        for i, x in enumerate(self.items):
            for mask in masks_of(len(x)):
                s = masked(x, mask)
                seeds.append(s)
                item.append(np.full(len(s), i, np.int32))
                at.append(np.arange(len(s), dtype=np.int32))
        none = np.empty(0, np.int32)
        seeds = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        self.seeds, self.item, self.at, self.run = in_runs(seeds, np.concatenate(item) if item else none, np.concatenate(at) if at else none)
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[(self.seeds >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Distinct rows (text, item, diagonal, equal tokens, overlap's tokens) with enough equal tokens, for texts' tokens h[start:stop]. Each diagonal is compared once, however many seeds hit it."""
        found, kept = [np.empty((0, 3), np.int64)], []
        for mask in self.masks:
            s = masked(h, mask)
            if not len(s):
                continue
            p = np.flatnonzero(self.bits[(s >> np.uint64(64 - BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.seeds, s[p], "left"), np.searchsorted(self.seeds, s[p], "right")
            doc = np.searchsorted(stops, p, "right")
            ok = (hi > lo) & (p + len(mask) <= stops[np.minimum(doc, len(stops) - 1)])
            p, lo, n, doc = p[ok], lo[ok], (hi - lo)[ok], doc[ok]
            # neighbouring places with one seed, as a run of one word makes them, are one place with a length
            goes_on = (p[1:] == p[:-1] + 1) & (s[p[1:]] == s[p[:-1]]) & (doc[1:] == doc[:-1])
            first = np.flatnonzero(np.concatenate(([True], ~goes_on))) if len(p) else p
            length = np.diff(np.append(first, len(p)))
            p, lo, n, doc = p[first], lo[first], n[first], doc[first]
            for i, j in pieces(n):
                m = n[i:j]
                k = np.repeat(lo[i:j], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                d, longest = np.repeat(doc[i:j], m), np.repeat(length[i:j], m) + self.run[k] - 1
                low = np.repeat(p[i:j] - starts[doc[i:j]], m) - self.at[k] - self.run[k] + 1
                for a, b in pieces(longest):
                    far = np.arange(longest[a:b].sum()) - np.repeat(np.cumsum(longest[a:b]) - longest[a:b], longest[a:b])
                    found.append(distinct(np.repeat(d[a:b], longest[a:b]), np.repeat(self.item[k[a:b]], longest[a:b]), np.repeat(low[a:b], longest[a:b]) + far))
                if sum(map(len, found)) > MOST_HITS:
                    kept.append(self.equal_enough(distinct(*np.concatenate(found).T), h, starts, stops))
                    found = found[:1]
        kept.append(self.equal_enough(distinct(*np.concatenate(found).T), h, starts, stops))
        return np.unique(np.concatenate(kept), axis=0) if len(kept) > 1 else kept[0]

    def equal_enough(self, rows: np.ndarray, h: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The rows (text, item, diagonal) on whose whole diagonal as many tokens are equal as any result needs."""
        doc, item, diagonal = rows.T
        a = np.maximum(0, -diagonal)
        n = np.minimum(self.sizes[item], stops[doc] - starts[doc] - diagonal) - a
        left, right = starts[doc] + diagonal + a, self.offsets[item] + a
        equal = np.zeros(len(rows), np.int64)
        for i, j in pieces(n):
            m = n[i:j]
            first = np.cumsum(m) - m
            step = np.arange(m.sum()) - np.repeat(first, m)
            same = h[np.repeat(left[i:j], m) + step] == self.flat[np.repeat(right[i:j], m) + step]
            equal[i:j] = np.add.reduceat(same, first, dtype=np.int64)
        return np.column_stack((rows, equal, n))[equal >= self.least[item]]


def distinct(doc: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """Distinct rows (text, item, diagonal)."""
    if not len(doc):
        return np.empty((0, 3), np.int64)
    order = np.lexsort((diagonal, item, doc))
    rows = np.column_stack((doc, item, diagonal)).astype(np.int64)[order]
    return rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(1)))]


def in_runs(seeds: np.ndarray, item: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(seed, item, first place, places) by seed: neighbouring places of an item with one seed are one row."""
    order = np.lexsort((at, item, seeds))
    seeds, item, at = seeds[order], item[order], at[order]
    if not len(seeds):
        return seeds, item, at, at
    first = np.flatnonzero(np.concatenate(([True], (seeds[1:] != seeds[:-1]) | (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1))))
    return seeds[first], item[first], at[first], np.diff(np.append(first, len(seeds))).astype(np.int32)


def pieces(sizes: np.ndarray):
    """Runs (first, last + 1) of sizes that add up to about PIECE."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PIECE, "right")))
        yield i, j
        i = j


def best_run(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, length, matches) of the run with the most matches less PENALTY times mismatches, the first of equal ones."""
    gain = np.concatenate(([0], np.cumsum(np.where(equal, 1, -PENALTY))))
    low = np.minimum.accumulate(gain)
    end = int(np.argmax(gain - low))
    begin = int(np.flatnonzero(gain[: end + 1] == low[end])[-1])
    return begin, end - begin, int(equal[begin:end].sum())


def verified(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int, int] | None:
    """(document start, item start, length, matches) if the overlap around a hit counts."""
    a = max(0, -diagonal)
    b = min(len(item), len(doc) - diagonal)
    equal = doc[a + diagonal : b + diagonal] == item[a:b]
    start, n, same = best_run(equal)
    if same >= LEAST_MATCHED and same >= IDENTITY * n:
        return a + diagonal + start, a + start, n, same
    at = np.flatnonzero(equal)
    if len(at) >= (IDENTITY if len(item) >= SHORTEST else 1) * len(item):
        start, n = int(at[0]), int(at[-1] - at[0]) + 1
        return a + diagonal + start, a + start, n, len(at)
    return None


def apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The overlaps of a document and an item without those that share document tokens with a fuller one (then an earlier one)."""
    out: list[tuple[int, int, int, int]] = []
    for x in sorted(set(found), key=lambda x: (-x[3], x[0], x[1], x[2])):
        i = bisect.bisect(out, x)
        if (i == 0 or out[i - 1][0] + out[i - 1][2] <= x[0]) and (i == len(out) or x[0] + x[2] <= out[i][0]):
            out.insert(i, x)
    return out


def search(x: Index, texts: list[bytes]) -> Iterator[tuple[int, int, list[tuple[int, int, int, int]]]]:
    """(text number, item number, overlaps) for each text and item that have any."""
    ends = tokens.separators(True)
    for lo, hi in tokens.slices(texts):
        h, counts, _ = tokens.words(texts[lo:hi], ends)
        stops = np.cumsum(counts)
        starts = stops - counts
        found: dict[tuple[int, int], list] = {}
        for d, i, diagonal, equal, n in x.hits(h, starts, stops).tolist():
            if equal == n:
                # nothing to weigh up where all tokens are equal
                a = max(0, -diagonal)
                found.setdefault((d, i), []).append((a + diagonal, a, n, n))
            elif got := verified(h[starts[d] : stops[d]], x.items[i], diagonal):
                found.setdefault((d, i), []).append(got)
        for (d, i), each in found.items():
            yield lo + d, i, apart(each)


def indexes(spark: SparkSession, benchmark: DataFrame) -> Iterator[Broadcast]:
    """The item index, in blocks of BLOCK_BYTES of text or less."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        rows = sorted(rows, key=lambda r: (r.item_id is not None, r.item_id or 0, r.text))
        yield spark.sparkContext.broadcast(Index([r.item_id for r in rows], as_tokens(r.text for r in rows)))


def as_tokens(texts) -> list[bytes]:
    return tokens.as_bytes(folded(t) if isinstance(t, str) else None for t in texts)


def overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, n_tokens, n_matched: all overlaps of each document and item; those of one item don't share tokens of the document."""
    schema = "doc_id long, item_id long, doc_start int, item_start int, n_tokens int, n_matched int"

    def against(index: Broadcast) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x = index.value
            for pdf in batches:
                tokens.give_back()
                doc_ids = [None if pd.isna(i) else int(i) for i in pdf["doc_id"]]
                out = [(doc_ids[d], x.ids[i], *got) for d, i, each in search(x, as_tokens(pdf["text"])) for got in each]
                yield pd.DataFrame({c.split()[0]: pd.array([r[k] for r in out], dtype="Int64" if k < 2 else "int32") for k, c in enumerate(schema.split(", "))})

        return documents.select("doc_id", "text").mapInPandas(run, schema)

    return reduce(DataFrame.union, map(against, indexes(documents.sparkSession, benchmark)))


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no passage of the benchmark; columns stay. Each row is judged by its own text, whatever its id, so nothing is joined or moved."""

    def clean(index: Broadcast) -> Column:
        @F.pandas_udf("boolean")
        def free(texts: pd.Series) -> pd.Series:
            out = np.ones(len(texts), bool)
            out[[d for d, _, _ in search(index.value, as_tokens(texts))]] = False
            tokens.give_back()
            return pd.Series(out)

        return free("text")

    return reduce(lambda df, index: df.where(clean(index)), indexes(documents.sparkSession, benchmark), documents)
