"""Vectorised hashing of words inside tasks: numpy over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

#: Bytes of texts that are hashed together; a longer text is hashed alone.
SLICE = 1 << 18
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
_P = np.uint64(0x9E3779B97F4A7C55)


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers for later stages, several to an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits (constants of the splitmix64 generator)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Masks of the first n bytes of eight.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def separators(punctuation: bool) -> np.ndarray:
    """Which bytes end a word: blanks, and ASCII characters other than letters and digits if asked for."""
    out = np.zeros(256, bool)
    out[list(BLANKS)] = True
    if punctuation:
        out[[i for i in range(128) if not chr(i).isalnum()]] = True
    return out


def slices(texts: list[bytes]):
    """Runs of texts (first, last + 1) of about SLICE bytes."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def words(texts: list[bytes], ends: np.ndarray, prefixes: tuple[int, ...] = ()):
    """(hash of each word, words of each text, hashes of the words' first bytes for each of prefixes, 8 at most); A-Z count as a-z.

    A word is read as numbers of eight bytes. Each number is mixed with its place by itself before they are added up, so
    that no repetitive pattern cancels out as it does in a polynomial modulo 2**64.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    inside = ~ends[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    per_text = np.diff(np.searchsorted(begin, np.concatenate(([0], np.cumsum(lens)))))
    if not len(begin):
        none = np.empty(0, np.uint64)
        return none, per_text, [none for _ in prefixes]
    size = end - begin
    pieces = (size + 7) >> 3
    first = np.cumsum(pieces) - pieces
    place = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    at = np.repeat(begin, pieces) + 8 * place
    room = np.minimum(np.repeat(end, pieces) - at, 8)
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    number = np.lib.stride_tricks.sliding_window_view(padded, 8)[at].copy().view("<u8")[:, 0].astype(np.uint64)
    number &= _LOW[room]
    with np.errstate(over="ignore"):
        out = np.add.reduceat(mix(mix(number ^ _P) + place.astype(np.uint64) * _P), first)
        out = mix(out + size.astype(np.uint64) * _P)
        heads = [mix((number[first] & _LOW[np.minimum(size, p)]) + np.uint64(p) * _P) for p in prefixes]
    return out, per_text, heads


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the distinct runs of k words of one text, ascending; of fewer words the whole sequence is one."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, np.uint64(width), np.uint64)
        for j in range(width):
            out = mix(out * _P + hashes[j : n - width + 1 + j])
    return np.unique(out)


def as_bytes(column) -> list[bytes]:
    """UTF-8 of a column of texts; null counts as empty."""
    return [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b"" for x in column]
