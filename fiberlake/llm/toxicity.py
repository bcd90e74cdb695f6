"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its words (A-Z lower-cased, cut at ASCII signs and blanks) and the words' first bytes (inflected
insults share them), hashed to BUCKETS numbers; a term that occurs twice or more is a second term as well. The machine adds a weight for each term and an interaction
<v_i, v_j> for each pair of terms, which catches an insult that is one only beside a mention of a group. Terms that tell
the classes of the sample apart enter the machine; all others have weight 0. They are counted and chosen in Spark.

Null counts as empty text. Without labels of both classes every score is 0. The fit uses at most SAMPLE labelled rows of
each class; the model has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiberlake.llm import tokens
from fiberlake.llm.common import cut
from fiberlake.llm.labelled import sample
from fiberlake.llm.linear import FactorizationMachine, best_cut, sigmoid

SAMPLE, BITS, TERMS, FACTORS, THRESHOLD = 4_000, 22, 2_048, 4, 0.7
BUCKETS = 1 << BITS
PREFIXES = (4, 6)
FOLDS = 2
LEAST_Z = 2.5


def again(term: np.ndarray) -> np.ndarray:
    """The number that says that a term occurs at least twice (a bijection of the buckets)."""
    return (term * 0x9E3B1 + 0x5A17D) & (BUCKETS - 1)


def terms(texts: list[bytes], wanted: np.ndarray | None = None, needed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term) for each distinct term of each text; only terms marked in wanted (needed marks those and the terms that they repeat)."""
    ends, docs = tokens.separators(True), []
    for lo, hi in tokens.slices(texts):
        hashes, counts, heads = tokens.words(texts[lo:hi], ends, PREFIXES)
        owner = np.repeat(np.arange(lo, hi, dtype=np.int64), counts)
        for h in (hashes, *heads):
            term = (h >> np.uint64(64 - BITS)).astype(np.int64)
            if wanted is not None:
                hit = needed[term]
                docs.append(owner[hit] * BUCKETS + term[hit])
            else:
                docs.append(owner * BUCKETS + term)
    pairs, counts = np.unique(np.concatenate(docs) if docs else np.empty(0, np.int64), return_counts=True)
    more = pairs[counts > 1]
    pairs = np.unique(np.concatenate((pairs, more - more % BUCKETS + again(more % BUCKETS))))
    if wanted is not None:
        pairs = pairs[wanted[pairs % BUCKETS]]
    return pairs // BUCKETS, pairs % BUCKETS


class Model:
    def __init__(self, chosen: np.ndarray, machine: FactorizationMachine):
        self.chosen, self.machine, self.cut = chosen, machine, 0.0
        self.wanted = np.zeros(BUCKETS, bool)
        self.wanted[chosen] = True
        self.needed = self.wanted | self.wanted[again(np.arange(BUCKETS))]

    def score(self, texts: list[bytes]) -> np.ndarray:
        """0 to 1; THRESHOLD at the cut."""
        docs, ids = terms(texts, self.wanted, self.needed)
        return sigmoid(self.machine.margin(docs, np.searchsorted(self.chosen, ids), len(texts)) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD)))


def fit(chosen: np.ndarray, docs: np.ndarray, ids: np.ndarray, y: np.ndarray) -> Model:
    """docs, ids: the chosen terms of the sampled documents. The cut is found on margins from machines that have not seen the document (FOLDS of them), since those of the final one are too sure of its own sample."""
    ids, n = np.searchsorted(chosen, ids), len(y)
    fold, margins = np.arange(n) % FOLDS, np.zeros(n)
    for k in range(FOLDS):
        seen = fold != k
        part, place = seen[docs], np.cumsum(seen) - 1
        machine = FactorizationMachine(len(chosen), FACTORS)
        machine.fit(place[docs[part]], ids[part], y[seen].astype(float))
        margins[~seen] = machine.margin(docs, ids, n)[~seen]
    machine = FactorizationMachine(len(chosen), FACTORS)
    machine.fit(docs, ids, y.astype(float))
    model = Model(chosen, machine)
    model.cut = best_cut(margins, y)
    return model


def telling_terms(rows: DataFrame, n0: int, n1: int) -> DataFrame:
    """term: at most TERMS that tell the classes apart, those of the largest z. rows: ids, y of the sampled documents, n0 and n1 of each class."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for y in (0, 1):
                found = [np.frombuffer(x, np.int32) for x in pdf["ids"][pdf["y"] == y]]
                term, n = np.unique(np.concatenate([np.empty(0, np.int32), *found]), return_counts=True)
                yield pd.DataFrame({"term": term, "a": n * y, "b": n * (1 - y)})

    held = rows.mapInPandas(count, "term int, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    p, q = F.col("a") / F.lit(float(n1)), F.col("b") / F.lit(float(n0))
    # separation in standard errors of the difference of the two shares; a term must be in three documents
    z = F.abs(p - q) / F.sqrt((p + q + F.lit(1e-9)) * F.lit(1 / n1 + 1 / n0))
    return held.where("a + b >= 3").withColumn("z", z).where(F.col("z") > LEAST_Z).orderBy(F.col("z").desc(), "term").limit(TERMS).select("term")


def train(documents: DataFrame, labels: DataFrame, training: Column, most: int = SAMPLE) -> Model | None:
    """The driver gets the chosen terms, and of each sampled document those of them that it has: 2 * most rows of TERMS numbers at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 200):
                part = pdf.iloc[lo : lo + 200]
                docs, ids = terms(tokens.as_bytes(part["text"]))
                cuts = np.searchsorted(docs, np.arange(len(part) + 1))
                yield pd.DataFrame({"ids": [ids[i:j].astype(np.int32).tobytes() for i, j in zip(cuts, cuts[1:])], "y": part["y"].array})
            tokens.give_back()

    rows = cut(sample(documents, labels, "toxic", training, most).mapInPandas(run, "ids binary, y int"))
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        return None
    chosen = np.sort(np.array([r.term for r in telling_terms(rows, n[0], n[1]).collect()], np.int64))
    if not len(chosen):
        return None

    def only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(ids=[np.intersect1d(np.frombuffer(x, np.int32), chosen).astype(np.int32).tobytes() for x in pdf["ids"]])

    kept = sorted(rows.mapInPandas(only, "ids binary, y int").collect(), key=lambda r: (r.y, bytes(r.ids)))
    each = [np.frombuffer(r.ids, np.int32) for r in kept]
    docs = np.repeat(np.arange(len(each)), [len(x) for x in each])
    return fit(chosen, docs, np.concatenate(each).astype(np.int64), np.array([r.y for r in kept]))


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """document (a struct of the documents' columns) and score double."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts)) if held.value is None else held.value.score(tokens.as_bytes(texts))
        tokens.give_back()
        return pd.Series(out)

    return documents.select(F.struct("*").alias("document"), scored("text").alias("score"))
