"""Byte-level BPE: overlapping chunk encoding, and decoding by concatenating raw bytes.

Every text is cut into chunks of CHUNK code points that overlap. Each chunk is pre-tokenised by itself. Inside an overlap,
the earlier chunk's pre-token boundaries and the later one's agree from some place on; there the streams are stitched. If
they agree nowhere (one pre-token fills the overlap), the rest is pre-tokenised from the last sure boundary. Then each
pre-token is encoded, with a bounded cache, by merging its lowest-ranked pair.

Texts of more than LONG code points are first cut into spans of that length, which overlap as well; spans are rows of
their own, dealt to all executors, and their streams are stitched in the same way.

Null counts as empty; an empty text has no tokens. Long texts meet their spans by a hash of the text, so equal ones share
them. The pattern must match every code point, as those of byte-level vocabularies do. Ranks and pattern are parameters;
the vocabulary file is read on the driver and broadcast: its size is that of the vocabulary, whatever the input.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiberlake.llm.tokens import give_back

CHUNK, OVERLAP = 1_024, 48
#: Code points of a span; texts above are cut into spans, each a row.
LONG = 65_536
#: Pre-tokens before a chunk's end whose boundaries the cut may have moved.
UNSURE = 2
CACHE = 70_000
NONE = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a .tiktoken file on the driver: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the pair of lowest rank is merged first, the leftmost of equal ones."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > 100:
        return _merge_long(piece, ranks)
    rank = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [rank(a + b, NONE) for a, b in zip(parts, parts[1:])]
    while pairs and (low := min(pairs)) != NONE:
        i = pairs.index(low)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = rank(parts[i] + parts[i + 1], NONE)
        if i:
            pairs[i - 1] = rank(parts[i - 1] + parts[i], NONE)
    return [ranks[x] for x in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap, O(n log n)."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts at i
    prev = list(range(-1, n - 1))
    live = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not live[i] or end[i] >= stop or end[i] >= n or end[end[i]] != stop:
            continue
        gone = end[i]
        live[gone] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    return [ranks[piece[i : end[i]]] for i in range(n) if live[i]]


def chunks(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """(begin, end) of the chunks of a text of n code points; each begins `overlap` before its predecessor's end."""
    out, at = [], 0
    while True:
        out.append((at, min(n, at + size)))
        if at + size >= n:
            return out
        at += size - overlap


def meeting(left: list[str], end: int, right: list[str], begin: int) -> tuple[int, int] | None:
    """(pre-tokens of left, pre-tokens of right to leave out) where two streams share a boundary; None if they never do.

    left ends at place `end` of the text, right begins at `begin`. A match of the pattern depends on the text from its
    start on only, so all boundaries of a chunk from a true one on are true, but for the last UNSURE.
    """
    seen, at = {}, begin
    for k, s in enumerate(right):
        seen[at] = k
        if at > end:
            break
        at += len(s)
    else:
        seen[at] = len(right)
    at = end
    for i in range(len(left), 0, -1):
        if at <= begin:
            return None
        if i <= len(left) - UNSURE and at in seen:
            return i, seen[at]
        at -= len(left[i - 1])
    return None


def joined(find: Callable[[str], list[str]], text: str, parts: Iterator[tuple[int, list[str]]]) -> list[str]:
    """All pre-tokens from the chunks' (begin, pre-tokens). Where streams don't meet, the rest is pre-tokenised from the last sure boundary."""
    done: list[str] = []
    end = 0
    for begin, own in parts:
        stop = begin + sum(map(len, own))
        if done:
            met = meeting(done, end, own, begin)
            if met is None:
                return done[:-UNSURE] + find(text[end - sum(map(len, done[-UNSURE:])) :])
            del done[met[0] :]
            own = own[met[1] :]
        done += own
        end = stop
    return done


def pretokenise(find: Callable[[str], list[str]], text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """All pre-tokens of a text, chunk by chunk."""
    if len(text) <= size:
        return find(text)
    return joined(find, text, ((begin, find(text[begin:end])) for begin, end in chunks(len(text), size, overlap)))


def narrow(pattern: str) -> re.Pattern | None:
    """The pattern for texts of code points below 0x300, with its Unicode classes spelt out: the standard library matches those faster. None if it uses other classes."""
    known = {"L": lambda c: unicodedata.category(c)[0] == "L", "N": lambda c: unicodedata.category(c)[0] == "N", "s": lambda c: c in " \t\n\r\f\v\x85\xa0"}
    spelt = {k: "".join(f"\\u{i:04x}" for i in range(0x300) if test(chr(i))) for k, test in known.items()}
    out, inside, at = [], False, 0
    for m in re.finditer(r"\\p\{(\w+)\}|\\(.)|([\[\]])", pattern):
        out.append(pattern[at : m.start()])
        at = m.end()
        name = m[1] or m[2]
        if m[3]:
            inside = m[3] == "["
            out.append(m[3])
        elif name in spelt and (m[1] or name == "s"):
            out.append(spelt[name] if inside else f"[{spelt[name]}]")
        elif name == "S" and not m[1] and not inside:
            out.append(f"[^{spelt['s']}]")
        elif m[1] or name.isalnum():
            return None
        else:
            out.append(m[0])
    return re.compile("".join(out) + pattern[at:])


WIDE = re.compile("[^\x00-\u02ff]")


class Codec:
    """Encodes with a cache of pre-tokens; lives in one task's worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.cache, self.older = ranks, regex.compile(pattern), {}, {}
        self.narrow = narrow(pattern)
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            self.token[i] = t
        self.decimal = [str(i) for i in range(len(self.token))]

    def piece(self, s: str) -> tuple[int, ...]:
        """Ids of a pre-token. Two generations of at most CACHE entries: what was used lately outlives a change."""
        got = self.cache.get(s)
        if got is None:
            got = self.older.get(s)
            if got is None:
                got = tuple(merge(s.encode("utf-8", "surrogatepass"), self.ranks))
            if len(s) <= 64:
                if len(self.cache) >= CACHE:
                    self.cache, self.older = {}, self.cache
                self.cache[s] = got
        return got

    def finder(self, text: str) -> Callable[[str], list[str]]:
        plain = self.narrow is not None and (text.isascii() or not WIDE.search(text))
        return (self.narrow if plain else self.pattern).findall

    def encode(self, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        return self.ids(pretokenise(self.finder(text), text, size, overlap))

    def ids(self, pieces: list[str]) -> list[int]:
        cached, piece, out = self.cache.get, self.piece, []
        for s in pieces:
            got = cached(s)
            out += piece(s) if got is None else got
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def encode(documents: DataFrame, ranks_path: str, pattern: str, long: int = LONG, chunk: int = CHUNK, overlap: int = OVERLAP, digest: bool = False) -> DataFrame:
    """document (a struct of the documents' columns), ids (array<int>) and decoded (binary), n_chunks; digest: doc_id, n_tokens, ids_sha256, decoded_sha256, n_chunks."""
    ranks = documents.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    docs = documents.select("doc_id", "text") if digest else documents
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string, n_chunks int" if digest else "ids array<int>, decoded binary, n_chunks int"
    made = [x.split()[0] for x in schema.split(", ")]

    def row(codec: Codec, ids: list[int], n: int) -> tuple:
        raw = codec.decode(ids)
        return (len(ids), hashlib.sha256(",".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), n) if digest else (ids, raw, n)

    @F.pandas_udf(schema)
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(ranks.value, pattern)
        for texts in batches:
            yield pd.DataFrame([row(codec, codec.encode(t, chunk, overlap), n_chunks(len(t), chunk, overlap)) for t in texts], columns=made)
        del codec
        give_back()

    @F.pandas_udf("array<string>")
    def cut_up(texts: pd.Series) -> pd.Series:
        return pd.Series([[t[begin:end] for begin, end in chunks(len(t), long, overlap)] for t in texts], dtype=object)

    @F.pandas_udf("array<int>")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec({}, pattern)
        for spans in batches:
            yield pd.Series([[len(s) for s in pretokenise(codec.finder(t), t, chunk, overlap)] for t in spans], dtype=object)

    @F.pandas_udf(schema)
    def from_spans(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        codec = Codec(ranks.value, pattern)
        for texts, parts in batches:
            out = []
            for t, ps in zip(texts, parts):
                spans = ((p["no"] * (long - overlap), sliced(t, p["no"] * (long - overlap), p["lengths"])) for p in ps)
                n = sum(n_chunks(end - begin, chunk, overlap) for begin, end in chunks(len(t), long, overlap))
                out.append(row(codec, codec.ids(joined(codec.finder(t), t, spans)), n))
            yield pd.DataFrame(out, columns=made)

    text = F.coalesce("text", F.lit(""))
    given = docs.select(F.struct("*").alias("document"), text.alias("_t"), (F.char_length(text) > long).alias("_long"))
    short = given.where("not _long").select("document", whole("_t").alias("_o"))
    lengthy = given.where("_long").withColumn("_key", F.sha2("_t", 256))
    spans = lengthy.select("_key", F.posexplode(cut_up("_t")).alias("no", "_c")).repartition("_key", "no")
    found = spans.select("_key", "no", lengths("_c").alias("lengths"))
    parts = found.groupBy("_key", "no").agg(F.first("lengths").alias("lengths")).groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("no", "lengths"))).alias("_p"))
    out = short.unionByName(lengthy.join(parts, "_key").select("document", from_spans("_t", "_p").alias("_o")))
    return out.select("document.doc_id", "_o.*") if digest else out.select("document", "_o.*")


def n_chunks(n: int, size: int, overlap: int) -> int:
    return 1 + max(0, -(-(n - size) // (size - overlap)))


def sliced(text: str, begin: int, sizes) -> list[str]:
    """The pre-tokens of a span from their lengths."""
    ends = list(accumulate(map(int, sizes), initial=begin))
    return [text[a:b] for a, b in zip(ends, ends[1:])]
