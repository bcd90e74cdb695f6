"""How far the sources of a language differ in their use of terms.

Plan:
1. Terms: one bytes.translate lowers A-Z and blanks the separators, bytes.split parts the terms, a Counter for each
   document gives its frequencies. Tasks add them up by language, source and term before anything is shuffled.
2. Occurrences and documents are added up by one shuffle on (language, term); a term's sources lie side by side there, so its
   documents over all sources need no second one. Terms in ``least`` documents or more are kept.
3. Smoothed shares are whole numbers, p = 1 + floor(SCALE * (count + ADD) / (N + ADD * V)), in decimals: exact at any size.
4. Distance of two sources: sums of abs(p - q) over all kept terms, held or not. Terms are dealt to blocks of SPREAD, sources to
   blocks of ABREAST; each task adds up the distances of its block's sources over its block's terms, as dense numbers of
   bounded size, and Spark adds up the blocks. No pair of rows is made for a term.
5. Terms that a source uses more than its language does: ranks by a window with a limit, which Spark applies before its shuffle.

Terms are runs of letters and of characters beyond ASCII. Null text, lang and source count as empty. Each row is a
document, also a repeated one. A language without kept terms has distances 0 and no term rows; a group without terms
has N = 0; a group that is its language's only one has no pairs. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiberlake.llm import tokens
from fiberlake.llm.common import cut

LEAST, TOP = 30, 50
SCALE, ADD = 1_000_000_000, 5
#: Distinct terms that a task holds before it passes their counts on.
HELD = 200_000
#: Terms and sources of a block.
SPREAD, ABREAST = 4_096, 256
#: A-Z to a-z, every other ASCII character but a-z to a blank, bytes beyond ASCII as they are.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs; several rows of a term, one for each time a task passes it on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], tuple[dict[bytes, int], Counter]] = {}
        size = 0

        def counted() -> Iterator[pd.DataFrame]:
            for (lang, source), (n, docs) in held.items():
                text = lambda values: pd.Series(values, dtype=object)
                yield pd.DataFrame({"lang": text([lang] * len(n)), "source": text([source] * len(n)), "term": text([t.decode("utf-8", "replace") for t in n]), "n": np.fromiter(n.values(), np.int64, len(n)), "docs": np.fromiter((docs[t] for t in n), np.int64, len(n))})
            held.clear()

        for pdf in batches:
            tokens.give_back()
            for lang, source, text in zip(pdf["lang"], pdf["source"], tokens.as_bytes(pdf["text"])):
                of_doc = Counter(text.translate(TABLE).split())
                n, docs = held.setdefault((lang, source), ({}, Counter()))
                before = len(n)
                for t, c in of_doc.items():
                    n[t] = n.get(t, 0) + c
                docs.update(iter(of_doc))
                size += len(n) - before
                if size > HELD:
                    yield from counted()
                    size = 0
        yield from counted()

    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return documents.select(blank("lang"), blank("source"), "text").mapInPandas(run, "lang string, source string, term string, n long, docs long")


def kept_terms(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, n: occurrences in each source that holds the term, of the terms in ``least`` documents of the language or more."""
    dealt = term_counts(documents).repartition("lang", "term")
    summed = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return summed.withColumn("docs", F.sum("docs").over(Window.partitionBy("lang", "term"))).where(F.col("docs") >= least).select("lang", "source", "term", "n")


def share(n: Column, total: Column, v: Column) -> Column:
    """The smoothed share as a whole number; decimals hold the products of any counts."""
    whole = lambda c: c.cast("decimal(18,0)")
    return F.when(v > 0, 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(n + ADD), whole(total + ADD * v)))


def pair_distances(groups: DataFrame, kept: DataFrame, spread: int = SPREAD, abreast: int = ABREAST) -> DataFrame:
    """lang, a, b (a < b), value: distances of all pairs of a language's sources. groups: lang, source, v, s (sources of the language), total."""
    block = groups.select("lang", "source", "v", "total", F.ceil(F.col("v") / spread).cast("int").alias("_terms"), F.ceil(F.col("s") / abreast).cast("int").alias("_sources"), share(F.lit(0), F.col("total"), F.col("v")).alias("base")).where("v > 0")
    block = block.withColumn("_own", F.pmod(F.xxhash64("source"), F.col("_sources")).cast("int"))
    held = kept.join(block, ["lang", "source"]).select("lang", "source", "base", "_own", "_sources", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), F.pmod(F.xxhash64("term"), F.col("_terms")).cast("int").alias("at"))
    # every source is in every block of terms, also one that holds none of them
    bare = block.select("lang", "source", "base", "_own", "_sources", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), F.explode(F.sequence(F.lit(0), F.col("_terms") - 1)).alias("at"))
    met = held.unionByName(bare).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_sources") - 1)))
    met = met.select("lang", "at", F.least("_own", "other").alias("i"), F.greatest("_own", "other").alias("j"), "_own", "source", "term", "base", "p")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lang, _, i, j = key
        sources, own = np.unique(pdf["source"].to_numpy(object), return_inverse=True)
        own_block, base = np.zeros(len(sources), np.int64), np.zeros(len(sources), np.int64)
        own_block[own], base[own] = pdf["_own"], pdf["base"]
        holds = pdf["term"].notna().to_numpy()
        term, names = pd.factorize(pdf["term"][holds])
        p = np.repeat(base[:, None], len(names), 1)
        p[own[holds], term] = pdf["p"][holds]
        out = []
        for a in np.flatnonzero(own_block == i):
            others = np.flatnonzero(own_block == j)
            if i == j:
                others = others[others > a]
            if len(others):
                value = np.abs(p[others] - p[a]).sum(1) - len(names) * np.abs(base[others] - base[a])
                out.append((np.full(len(others), a), others, value))
        a, b, value = map(np.concatenate, zip(*out)) if out else [np.empty(0, np.int64)] * 3
        return pd.DataFrame({"lang": pd.Series([lang] * len(a), dtype=object), "a": sources[a], "b": sources[b], "value": value})

    found = met.groupBy("lang", "at", "i", "j").applyInPandas(run, "lang string, a string, b string, value long")
    summed = found.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("held"))
    side = lambda s: block.select(F.col("lang"), F.col("source").alias(s), F.col("base").alias(f"{s}_base"), *([F.col("v")] if s == "a" else []))
    return summed.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"]).select("lang", "a", "b", (F.col("held") + F.col("v") * F.abs(F.col("a_base") - F.col("b_base"))).alias("value"))


def divergence(documents: DataFrame, least: int = LEAST, top: int = TOP, spread: int = SPREAD, abreast: int = ABREAST) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: distances to the language's other sources, and the ``top`` terms by which a source exceeds its language."""
    kept = cut(kept_terms(documents, least))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    present = documents.select(blank("lang"), blank("source")).distinct()
    langs = present.groupBy("lang").agg(F.count(F.lit(1)).alias("s"))
    by_term = kept.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    of_lang = by_term.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    groups = cut(present.join(langs, "lang").join(of_lang, "lang", "left").join(totals, ["lang", "source"], "left").select("lang", "source", "s", zero("v"), zero("lang_total"), zero("total")))

    measured = pair_distances(groups, kept, spread, abreast).unionByName(silent_pairs(groups))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("w")
    pairs = measured.select("lang", "value", ways).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")

    used = kept.withColumn("all", F.sum("n").over(Window.partitionBy("lang", "term"))).join(groups, ["lang", "source"])
    excess = share(F.col("n"), F.col("total"), F.col("v")) - share(F.col("all"), F.col("lang_total"), F.col("v"))
    terms = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess.alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))


def silent_pairs(groups: DataFrame) -> DataFrame:
    """lang, a, b (a < b), value 0: pairs of sources of languages without kept terms. They are part of the result, all of them."""
    silent = groups.where("v = 0").select("lang", "source")
    a, b = silent.withColumnRenamed("source", "a"), silent.withColumnRenamed("source", "b")
    return a.join(b, "lang").where("a < b").select("lang", "a", "b", F.lit(0).cast("long").alias("value"))
