"""Plain versions of the operators' contracts, for tests."""

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingle_set(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def components(docs, k, percent):
    """{doc_id: (n_shingles, component)}; compares all documents that share a shingle."""
    sets = {i: shingle_set(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    from collections import Counter

    for i, s in sets.items():
        shared = Counter(j for x in s for j in holders[x] if j > i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def line_dedup(docs, least=10):
    """{doc_id: (n_lines, n_dropped, kept text)}"""
    first, several = {}, {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            key = line.strip(BLANK).translate(LOWER)
            if len(key) >= least:
                first[key] = min(first.get(key, i), i)
                several.setdefault(key, set()).add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = []
        for line in lines:
            key = line.strip(BLANK).translate(LOWER)
            if not (len(key) >= least and len(several[key]) > 1 and first[key] != i):
                keep.append(line)
        out[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def crc(text):
    return zlib.crc32(text.encode())


def spelling_words(docs, least=7, often=2, modulus=31):
    """{word: n}"""
    from collections import Counter

    out = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = crc(f"{'' if i is None else i}:{run}")
            if modulus and h % modulus == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= often}


def variants(words, ratio=10):
    """{word: (form, root, n, n_near, form_n)}; tries every edit of every word."""
    letters = sorted({c for w in words for c in w})
    near = {}
    for w in words:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        near[w] = [x for x in edits - {w} if x in words]
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] is not None else None)
    return out


def simhash(text, k=3):
    import xxhash

    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reached(points):
    """{point: smallest id that links of 2 bits or fewer reach}; points: (id, point), ids not null."""
    first = {}
    for i, p in points:
        first[p] = min(first.get(p, i), i)
    left, out = set(first), {}
    while left:
        group = todo = {left.pop()}
        while todo:
            todo = {q for q in left if any((p ^ q).bit_count() <= 2 for p in todo)}
            left -= todo
            group = group | todo
        out |= dict.fromkeys(group, min(first[p] for p in group))
    return out
