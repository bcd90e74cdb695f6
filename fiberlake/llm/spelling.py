"""Spelling variants: words within one edit, found by an index of variable-length grams.

Plan:
1. Words and their occurrences are counted inside tasks and added up in Spark.
2. Frequency-pruned dictionary: occurrences of the words' grams of LEVELS letters are added up. Grams of more than
   ``limit`` occurrences are the dictionary's inner nodes: a gram that is one of them is read on to the next level. limit
   is the smallest power of two, LIST or more, that leaves DICTIONARY inner nodes or fewer, so the broadcast is bounded.
3. Decomposition: at each place of a word the variable gram that starts there and the one that ends there: the shortest of
   LEVELS that isn't an inner node, else all letters up to the word's end.
4. Affected grams: an edit touches the grams that span its spot and no others. Of the unaffected ones, the nearest on the
   left and the nearest on the right are the two lists that are merged: their hash, with the letters before and after the
   spot, is a key. Each word has a key for every letter that may be replaced or deleted, and for every gap. Two words
   at one edit share the key of its spot, since they differ nowhere else.
5. Words of one key are compared letter by letter, at the first place where they differ, so each pair is found once.

A key's list is short by construction: if one of its grams ends inside the word, no more than ``limit`` words hold
that gram; otherwise the key is the whole word but for one letter, and the alphabet bounds the list. No list depends
on how often a word occurs.

Words: maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased. Null texts have none; an empty table gives an
empty result; a null doc_id counts as an empty one where runs are altered; repeated rows count each; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiberlake.llm import tokens
from fiberlake.llm.common import cut

#: Letters of grams, shortest first.
LEVELS = (4, 6, 8, 12)
#: Words of one list at most, as long as the dictionary has room.
LIST, DICTIONARY = 64, 1 << 20
#: Longer words travel by their hash.
SHOWN = 96
#: Distinct words that a task holds before it passes their counts on; letters that are decomposed at once.
HELD, PIECE = 200_000, 1 << 17
_P = tokens._P


def altered(doc_id, run: bytes, modulus: int) -> bytes:
    """The run (Latin-1, lower case) without the letter that its document's hash picks, for one run in ``modulus``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(b"%s:" % str(doc_id).encode() if doc_id is not None else b":"))
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % modulus == 0 else run


def word_counts(documents: DataFrame, least: int = 7, often: int = 2, modulus: int | None = None) -> DataFrame:
    """word, n: words of ``least`` letters or more that occur ``often`` or more. modulus: alter one run in so many (a drill)."""
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, int] = {}

        def counted() -> pd.DataFrame:
            out = pd.DataFrame({"word": pd.Series([w.decode("latin-1") for w in held], dtype=object), "n": np.fromiter(held.values(), np.int64, len(held))})
            held.clear()
            return out

        for pdf in batches:
            tokens.give_back()
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                found = runs.findall(text) if isinstance(text, str) else []
                if not found:
                    continue
                for word, n in Counter("\n".join(found).encode("latin-1").lower().split(b"\n")).items():
                    if modulus:
                        word = altered(doc_id, word, modulus)
                    if len(word) >= least:
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield counted()
        if held:
            yield counted()

    docs = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return docs.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


class Letters:
    """Letters of some words side by side, and hashes of their stretches."""

    def __init__(self, words: list[str]):
        raw = [w.encode("latin-1") for w in words]
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.first = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        self.word = np.repeat(np.arange(len(raw)), self.size)
        self.at = np.arange(len(self.raw)) - self.first[self.word]

    def grams(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the stretches of so many letters inside words."""
        n = len(self.raw) - length + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        start = np.flatnonzero(self.at[:n] + length <= self.size[self.word[:n]])
        with np.errstate(over="ignore"):
            h = np.full(len(start), np.uint64(length), np.uint64)
            for j in range(length):
                h = (h ^ self.raw[start + j]) * _P
                h ^= h >> np.uint64(29)
        return start, tokens.mix(h)

    def whole(self, backwards: bool) -> np.ndarray:
        """Hash of each word's letters before a place, or from it on; places are numbered word by word, with one more after the last letter."""
        place = (self.size[self.word] - 1 - self.at if backwards else self.at).astype(np.uint64)
        with np.errstate(over="ignore"):
            each = tokens.mix(tokens.mix(self.raw + np.uint64(7)) + place * _P)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)))
            # places of word k begin at first[k] + k
            owner = np.repeat(np.arange(len(self.size)), self.size + 1)
            at = np.arange(len(owner)) - owner
            return total[(self.first + self.size)[owner]] - total[at] if backwards else total[at] - total[self.first[owner]]


def slices(words: list[str]) -> Iterator[tuple[int, int]]:
    """Runs (first, last + 1) of words of about PIECE letters; a longer word is alone."""
    first = size = 0
    for i, w in enumerate(words):
        if size and size + len(w) > PIECE:
            yield first, i
            first, size = i, 0
        size += len(w)
    if first < len(words):
        yield first, len(words)


def gram_counts(words: DataFrame) -> DataFrame:
    """gram (hash), n: occurrences of the grams of each level."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens.give_back()
            texts = list(pdf["word"])
            for lo, hi in slices(texts):
                letters = Letters(texts[lo:hi])
                gram, n = np.unique(np.concatenate([letters.grams(x)[1] for x in LEVELS]), return_counts=True)
                yield pd.DataFrame({"gram": gram.view(np.int64), "n": n.astype(np.int64)})

    return words.select("word").mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def dictionary(words: DataFrame, least: int = LIST, most: int = DICTIONARY) -> np.ndarray:
    """Sorted hashes of the inner nodes: grams of more occurrences than the limit, ``most`` at most."""
    counts = cut(gram_counts(words).where(F.col("n") > least))
    sizes = {int(r.power): r["count"] for r in counts.groupBy(F.floor(F.log2(F.col("n") - 1)).alias("power")).count().collect()}
    power = least.bit_length() - 1
    while sum(n for p, n in sizes.items() if p >= power) > most:
        power += 1
    rows = counts.where(F.col("n") > (1 << power)).select("gram").toPandas()
    return np.sort(rows["gram"].to_numpy(np.int64).view(np.uint64))


def held_by(sorted_hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(sorted_hashes):
        return np.zeros(len(h), bool)
    return sorted_hashes[np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)] == h


def spots(words: list[str], inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word number, letters before the spot, is it a gap, key) of all spots where the words can be edited."""
    x = Letters(words)
    owner = np.repeat(np.arange(len(words)), x.size + 1)
    place = np.arange(len(owner)) - (x.first + np.arange(len(words)))[owner]
    left, right = x.whole(False), x.whole(True)
    for length in reversed(LEVELS):
        start, h = x.grams(length)
        leaf = ~held_by(inner, h)
        start, h = start[leaf], h[leaf]
        # place p of word k stands at first[k] + k + p
        left[start + x.word[start] + length], right[start + x.word[start]] = h, h
    n = x.size[owner]
    letter = np.flatnonzero(place < n)
    with np.errstate(over="ignore"):
        key = lambda a, b, before, after: tokens.mix(tokens.mix(left[a] + before.astype(np.uint64) * _P) + right[b] * _P + after.astype(np.uint64))
        gap = np.arange(len(owner))
        keys = np.concatenate((key(letter, letter + 1, place[letter], (n - place)[letter] - 1), key(gap, gap, place, n - place)))
    return np.concatenate((owner[letter], owner)), np.concatenate((place[letter], place)), np.repeat([False, True], (len(letter), len(owner))), keys


def keyed(words: DataFrame, inner: np.ndarray) -> DataFrame:
    """key, name (the word; # and its hash if it is long), n, at (letters before the spot), gap."""
    shared = words.sparkSession.sparkContext.broadcast(inner)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens.give_back()
            texts, n = list(pdf["word"]), pdf["n"].to_numpy()
            names = np.array([w if len(w) <= SHOWN else "#" + hashlib.sha256(w.encode()).hexdigest() for w in texts], object)
            for lo, hi in slices(texts):
                owner, at, gap, key = spots(texts[lo:hi], shared.value)
                yield pd.DataFrame({"key": key.view(np.int64), "name": names[lo:hi][owner], "n": n[lo:hi][owner], "at": at.astype(np.int32), "gap": gap})

    return words.select("word", "n").mapInPandas(run, "key long, name string, n long, at int, gap boolean")


def one_edit(a: Column, b: Column, at: Column, gap: Column) -> Column:
    """b is a with the letter after its first ``at`` ones replaced or, at a gap of b, deleted, and a and b differ there first."""
    rest = F.substring(b, F.when(gap, at + 1).otherwise(at + 2), F.length(b))
    return (F.substring(a, F.lit(1), at) == F.substring(b, F.lit(1), at)) & (F.substring(a, at + 2, F.length(a)) == rest) & (F.substring(a, at + 1, F.lit(1)) != F.substring(b, at + 1, F.lit(1)))


def near_words(words: DataFrame, least: int = LIST, most: int = DICTIONARY) -> DataFrame:
    """word, near, n (of near): each word with each word at one edit. words: word, n, distinct."""
    keys = keyed(words, dictionary(words, least, most)).repartition("key")
    lists = keys.groupBy("key").agg(F.collect_list(F.struct("name", "n", "at", "gap")).alias("list")).where(F.size("list") > 1)
    met = cut(lists.select("list", F.explode(F.filter("list", lambda x: ~x["gap"])).alias("a")).select("a", F.explode(F.filter("list", lambda x: candidate(F.col("a"), x))).alias("b")))
    is_long = F.col("a.name").startswith("#") | F.col("b.name").startswith("#")
    big = words.where(F.length("word") >= SHOWN).select(F.when(F.length("word") > SHOWN, F.concat(F.lit("#"), F.sha2("word", 256))).otherwise(F.col("word")).alias("name"), "word")
    named = lambda df, side: df.join(big.select(F.col("name").alias(f"{side}_name"), F.col("word").alias(f"{side}_word")), F.col(f"{side}.name") == F.col(f"{side}_name"))
    exact = named(named(met.where(is_long), "a"), "b").where(one_edit(F.col("a_word"), F.col("b_word"), F.col("a.at"), F.col("b.gap")))
    columns = lambda a, b: [F.col(a).alias("a"), F.col("a.n").alias("a_n"), F.col(b).alias("b"), F.col("b.n").alias("b_n"), F.col("b.gap").alias("gap")]
    pairs = met.where(~is_long).select(*columns("a.name", "b.name")).union(exact.select(*columns("a_word", "b_word")))
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("n")), F.when(F.col("gap"), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("n"))))
    return pairs.select(F.explode(F.filter(ways, lambda w: w.isNotNull())).alias("w")).select("w.*")


def candidate(a: Column, b: Column) -> Column:
    """Whether b, of a's list, is at one edit from a; of long words only their hashes are known here, so they may be."""
    long_a, long_b = a["name"].startswith("#"), b["name"].startswith("#")
    told = F.when(long_a & long_b, F.lit(True)).when(long_a | long_b, b["gap"]).otherwise(one_edit(a["name"], b["name"], a["at"], b["gap"]))
    return (a["name"] != b["name"]) & (a["at"] == b["at"]) & told


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last form that forms lead to. forms: word, form. Each form occurs more often than its word, so chains end."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        met = at.join(ahead, at.root == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved"))
        met = cut(met)
        at = met.select("word", "root")
        if not met.where("_moved").limit(1).count():
            return at


def variants(words: DataFrame, ratio: int = 10, least: int = LIST, most: int = DICTIONARY) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word. words: word, n, distinct.

    form: the near word of largest n (of several the first in code-point order), if that is ``ratio`` times the word's or more; root: the word to
    which forms lead, the word itself without any.
    """
    words = cut(words)
    near = near_words(words, least, most).groupBy(F.col("word").alias("_w")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), "near")).alias("best"))
    met = words.join(near, words.word == F.col("_w"), "left")
    fits = -F.col("best.m") >= ratio * F.col("n")
    out = cut(met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")))
    last = roots(out.where("form is not null")).select(F.col("word").alias("_w"), "root")
    return out.join(last, out.word == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
