"""Near-duplicate documents: MinHash with tensored banding, every link confirmed on whole shingle sets.

Plan:
1. Each text becomes its set of distinct k-word shingles (64-bit hashes). Equal sets are collapsed to their smallest
   document, so that exact copies cost one aggregation.
2. Tensored banding: two collections of ``m`` sub-keys, each made of ``rows`` minhashes. Every pair of a sub-key of the
   first with one of the second is a table key: m*m keys of 2*rows minhashes from only 2*m*rows hash functions.
3. Each key's smallest document leads its members (a partial aggregation, then a join that Spark may split by skew).
   Only (leader, member) rows are made: never all pairs of a key.
4. Every member is compared exactly with its leader: work and data in proportion to the members. Jaccard distance is a
   metric, so a member further from the leader than twice the allowed distance links with none of the leader's.
5. Connected components of these links are classes. Leaders whose members all ended in one class are done. Of the others,
   members that are not linked to their leader are compared with each other, and the nearer ones with the linked ones, as
   far as they are of different classes, in blocks of bounded total set size.
6. Links found there join classes, again by connected components.

Components are found by labels that hang onto smaller ones in Spark; labels are tables in the shared checkpoint folder.
A pair at the threshold shares no key with probability below 0.0005 for the default parameters. Nothing is capped: a
leader with many unlinked members gets more blocks, and all pairs of blocks that can hold a link are visited.

Null, empty and blank texts have an empty set and are linked with nothing. Repeated rows are each returned; where rows of
one doc_id have different texts, they are one document, and the set with the smallest key stands for its links. Rows with
a null doc_id are in no class (component_id null) and are kept. Ties of equal sets go to the smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiberlake.llm import tokens
from fiberlake.llm.common import cut
from fiberlake.operators import rounds

#: Shingles and sets of one block of members at most, on average; two blocks meet in one task.
BLOCK_SHINGLES, BLOCK_SETS = 400_000, 1_000
#: As a power of two: the largest filter that is broadcast (8 MB). With more ids, ids are joined to the texts instead.
FILTER_BITS = 26
#: What a member is to its leader: too far to link with those that are linked, neither, or linked.
FAR, BETWEEN, LINKED = 0, 1, 2
SEED = 20_24
#: Stands for a null doc_id inside tasks.
NO_ID = 2**63 - 1


def plan_tables(threshold: float, miss: float = 2e-4) -> tuple[int, int]:
    """(rows of a sub-key, sub-keys of a collection): a pair at the threshold finds no equal sub-key in a collection with at most the given probability."""
    rows = 3 if threshold >= 0.84 else 2
    return rows, int(np.ceil(np.log(miss) / np.log(1 - threshold**rows)))


def sub_keys(shingles: np.ndarray, rows: int, m: int) -> np.ndarray:
    """2*m sub-keys (uint64) of a set: the first m are one collection, the rest the other."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(1, 2**63, 2 * m * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(2 * m, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(2 * m):
            for j in range(rows):
                x = shingles * a[i * rows + j]
                out[i] = (out[i] ^ (x ^ (x >> np.uint64(32))).min()) * tokens._P
    return tokens.mix(out)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two longs that stand for a set."""
    with np.errstate(over="ignore"):
        return int(tokens.mix(s).sum(dtype=np.uint64).view(np.int64)), int(tokens.mix(s + tokens._P).sum(dtype=np.uint64).view(np.int64))


def word_sets(texts, k: int) -> Iterator[np.ndarray]:
    raw = tokens.as_bytes(texts)
    ends = tokens.separators(False)
    for lo, hi in tokens.slices(raw):
        hashes, counts, _ = tokens.words(raw[lo:hi], ends)
        at = 0
        for c in counts:
            yield tokens.shingles(hashes[at : at + c], k)
            at += c


def summarise(documents: DataFrame, k: int, rows: int, m: int) -> DataFrame:
    """doc_id, n_shingles, set_key (two longs that stand for the set), keys (2*m sub-keys as bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens.give_back()
            out = []
            for s in word_sets(pdf["text"], k):
                if len(s):
                    out.append((len(s), *set_key(s), sub_keys(s, rows, m).tobytes()))
                else:
                    out.append((0, 0, 0, b""))
            n, one, two, keys = zip(*out) if out else ((), (), (), ())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "n_shingles": np.array(n, np.int64), "k1": np.array(one, np.int64), "k2": np.array(two, np.int64), "keys": pd.Series(keys, dtype=object)})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, n_shingles long, k1 long, k2 long, keys binary")


def table_keys(reps: DataFrame, m: int) -> DataFrame:
    """doc_id, key: the m*m tensored table keys of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = np.arange(m * m, dtype=np.uint64)
        for pdf in batches:
            tokens.give_back()
            for lo in range(0, len(pdf), 2_000):
                part = pdf.iloc[lo : lo + 2_000]
                subs = np.frombuffer(b"".join(part["keys"]), np.uint64).reshape(len(part), 2 * m)
                with np.errstate(over="ignore"):
                    keys = tokens.mix(subs[:, :m, None] * tokens._P + subs[:, None, m:]).reshape(len(part), -1)
                    keys = tokens.mix(keys + pair * tokens._P)
                yield pd.DataFrame({"doc_id": np.repeat(part["doc_id"].to_numpy(np.int64), m * m), "key": keys.reshape(-1).view(np.int64)})

    return reps.select("doc_id", "keys").mapInPandas(run, "doc_id long, key long")


def id_filter(ids: DataFrame, n: int) -> np.ndarray:
    """Bits that are set for each of the n doc_ids of ids and for few others: 16 bits an id.

    The bits are gathered in Spark by word; the driver gets FILTER_BITS / 64 rows at most.
    """
    bits = 1 << max(10, (16 * n).bit_length())
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = ids.select(at.alias("at")).groupBy(F.floor(F.col("at") / F.lit(64)).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("b"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.collect():
        out[r.w] = r.b
    return out.view(np.uint64)


def shingle_sets(documents: DataFrame, k: int, ids: DataFrame) -> DataFrame:
    """doc_id, shingles (sorted 64-bit hashes as bytes) of the documents in ids (doc_id, k1, k2).

    As long as a filter of the ids stays within FILTER_BITS, it is broadcast and drops nearly all other texts before they
    are read by Python, and no text is shuffled. Beyond, texts and ids meet in a join first. An exact semi-join follows.
    """
    n = ids.count()
    docs = documents.select("doc_id", "text")
    bits = None
    if (16 * n).bit_length() <= FILTER_BITS:
        bits = documents.sparkSession.sparkContext.broadcast(id_filter(ids, n))
        docs = docs.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(64 * len(bits.value))))
    else:
        docs = docs.join(ids.select("doc_id"), "doc_id", "left_semi").withColumn("at", F.lit(0).cast("long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens.give_back()
            if bits is not None:
                at = pdf["at"].to_numpy(np.int64)
                pdf = pdf[(bits.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1]
            sets = list(word_sets(pdf["text"], k))
            one, two = zip(*map(set_key, sets)) if sets else ((), ())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "k1": np.array(one, np.int64), "k2": np.array(two, np.int64), "shingles": pd.Series([s.tobytes() for s in sets], dtype=object)})

    sets = docs.mapInPandas(run, "doc_id long, k1 long, k2 long, shingles binary")
    return sets.join(ids, ["doc_id", "k1", "k2"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "shingles")


def linked(shared: np.ndarray, size: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Exact: 100 * |intersection| >= percent * |union|."""
    return 100 * shared >= percent * (size + sizes - shared)


class Sets:
    """Sets of one block, their elements renumbered, so that one set is counted against all in one pass."""

    def __init__(self, blobs: list[bytes]):
        arrays = [np.frombuffer(b, np.uint64) for b in blobs]
        self.sizes = np.array([len(a) for a in arrays], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        values, self.ids = np.unique(np.concatenate(arrays), return_inverse=True)
        self.mark = np.zeros(len(values), np.int64)

    def of(self, i: int) -> np.ndarray:
        return self.ids[self.starts[i] : self.starts[i] + self.sizes[i]]

    def shared(self, i: int) -> np.ndarray:
        self.mark[self.of(i)] = 1
        out = np.add.reduceat(self.mark[self.ids], self.starts)
        self.mark[self.of(i)] = 0
        return out


def block_links(classes: np.ndarray, blobs: list[bytes], kinds: np.ndarray, rows: np.ndarray, cols: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Classes joined by links between rows and cols (marks of the sets of a block, the same ones or disjoint)."""
    sets, label, out = Sets(blobs), classes.copy(), []
    for i in np.flatnonzero(rows):
        other = cols & (label != label[i]) & (100 * sets.sizes >= percent * sets.sizes[i]) & (100 * sets.sizes[i] >= percent * sets.sizes)
        if cols[i]:
            other[:i] = False
        if kinds[i] == FAR:
            other &= kinds != LINKED
        if not other.any():
            continue
        for j in np.flatnonzero(other & linked(sets.shared(i), sets.sizes[i], sets.sizes, percent)):
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((int(classes[i]), int(classes[j])))
    return out


def against_leaders(led: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """leader, doc_id, n_shingles, kind of each member, by exact comparison with its leader."""
    heads = sets.select(F.col("doc_id").alias("leader"), F.col("shingles").alias("head"))
    met = led.join(sets, "doc_id").join(heads, "leader")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kinds = np.empty(len(pdf), np.int8)
            for i, (own, head) in enumerate(zip(pdf["shingles"], pdf["head"])):
                a, b = np.frombuffer(own, np.uint64), np.frombuffer(head, np.uint64)
                n = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                union = len(a) + len(b) - n
                kinds[i] = LINKED if 100 * n >= percent * union else BETWEEN if 100 * n >= (2 * percent - 100) * union else FAR
            yield pdf[["leader", "doc_id", "n_shingles"]].assign(kind=kinds)

    return met.select("leader", "doc_id", "n_shingles", "shingles", "head").mapInPandas(run, "leader long, doc_id long, n_shingles long, kind byte")


def linked_classes(led: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """doc_id, component (its smallest doc_id) of every document with a link. led: leader, doc_id, n_shingles (without the leader itself)."""
    star = cut(against_leaders(led, sets, percent))
    first = cut(components(star.where(F.col("kind") == LINKED).select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))))
    classed = star.join(first, "doc_id", "left").select("leader", "doc_id", "n_shingles", "kind", F.coalesce("component", "doc_id").alias("class"))
    second = cut(components(among(cut(classed), sets, percent)))
    moved = first.join(second.select(F.col("doc_id").alias("component"), F.col("component").alias("_to")), "component", "left").select("doc_id", F.coalesce("_to", "component").alias("component"))
    return moved.union(second.join(first, "doc_id", "left_anti").select("doc_id", "component"))


def among(star: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: classes that links between members of one leader join. star: leader, doc_id, n_shingles, kind, class."""
    loose, between = F.col("kind") != LINKED, F.col("kind") == BETWEEN
    parts = lambda which: F.greatest(F.ceil(F.sum(F.when(which, F.col("n_shingles"))) / BLOCK_SHINGLES), F.ceil(F.count(F.when(which, 1)) / BLOCK_SETS)).cast("int")
    work = star.groupBy("leader").agg(parts(loose).alias("r"), F.coalesce(parts(~loose), F.lit(0)).alias("c"), F.count(F.when(loose, 1)).alias("_loose"), F.count(F.when(between, 1)).alias("_between"), F.min("class").alias("_a"), F.max("class").alias("_z"))
    work = work.withColumn("c", F.when(F.col("_between") > 0, F.col("c")).otherwise(0)).where("_a <> _z and _loose > 0 and (_loose > 1 or c > 0)")
    # a table of its own, so that Spark may split the members of one leader among tasks
    dealt = star.join(cut(work.select("leader", "r", "c")), "leader").withColumn("part", F.pmod(F.xxhash64("doc_id", "leader"), F.when(loose, F.col("r")).otherwise(F.greatest("c", F.lit(1)))).cast("int"))
    # loose parts are 0 to r - 1 and meet each other once; linked ones are r to r + c - 1 and meet the loose ones
    span = lambda a, b, x, y: f"if({b} > {a}, transform(sequence({a}, {b} - 1), i -> struct({x} as x, {y} as y)), cast(array() as array<struct<x: int, y: int>>))"
    as_loose = F.expr(f"concat({span('part', 'r', 'part', 'i')}, {span('0', 'part', 'i', 'part')}, {span('r', f'if(kind = {BETWEEN}, r + c, r)', 'part', 'i')})")
    as_linked = F.expr(span("0", "if(c > 0, r, 0)", "i", "r + part"))
    met = dealt.withColumn("at", F.explode(F.when(loose, as_loose).otherwise(as_linked)))
    met = met.select("leader", "doc_id", "kind", "class", F.col("at.x").alias("x"), F.col("at.y").alias("y"), F.when(loose, F.col("part")).otherwise(F.col("r") + F.col("part")).alias("part")).join(sets, "doc_id")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, x, y = key
        pdf = pdf.sort_values("doc_id")
        part = pdf["part"].to_numpy()
        found = block_links(pdf["class"].to_numpy(np.int64), list(pdf["shingles"]), pdf["kind"].to_numpy(), part == x, part == y, percent) if len(pdf) > 1 else []
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return met.groupBy("leader", "x", "y").applyInPandas(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """doc_id, component (smallest reachable) of every document that has a link. Stays in Spark; ends when no label changes."""
    return rounds.components(links).select(F.col("node").alias("doc_id"), F.col("label").alias("component"))


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept (it is the smallest doc_id of its class).

    Links: word shingles of k words, 100 * |intersection| >= percent * |union|; words are runs of non-blank characters
    with A-Z lower-cased.
    """
    rows, m = plan_tables(percent / 100)
    docs = documents.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    seen = cut(summarise(docs, k, rows, m))
    full = seen.where(f"n_shingles > 0 and doc_id <> {NO_ID}")
    equal = full.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    reps = full.join(equal.select(F.col("rep").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"], "left_semi")
    # one set for each document, also where rows of one doc_id have different texts
    reps = reps.groupBy("doc_id").agg(F.min(F.struct("k1", "k2", "n_shingles", "keys")).alias("r")).select("doc_id", "r.*")
    keyed = table_keys(reps, m)
    leaders = cut(keyed.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader <> last").select("key", "leader"))
    led = keyed.join(leaders, "key").where("doc_id <> leader").select("leader", "doc_id").distinct()
    led = cut(led.join(reps.select("doc_id", "n_shingles"), "doc_id").select("leader", "doc_id", "n_shingles"))
    involved = led.select("doc_id").union(led.select("leader")).distinct()
    sets = cut(shingle_sets(docs, k, cut(reps.join(involved, "doc_id", "left_semi").select("doc_id", "k1", "k2"))))
    classes = linked_classes(led, sets, percent)
    by_set = equal.join(classes, equal.rep == classes.doc_id, "left").select("k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("_c"))
    out = seen.join(by_set, ["k1", "k2", "n_shingles"], "left")
    known = F.col("doc_id") != NO_ID
    component = F.when((F.col("n_shingles") > 0) & known, F.coalesce("_c", "doc_id")).otherwise(F.col("doc_id"))
    return out.select(F.when(known, F.col("doc_id")).alias("doc_id"), "n_shingles", F.when(known, component).alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def drop_near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without all but the first of each class; columns stay."""
    gone = near_duplicates(documents, k, percent).where("not kept").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti")
