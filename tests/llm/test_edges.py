"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import re

import numpy as np
import public_tokenizers
import pytest
import regex

import corpus_pipeline
from fiberlake.llm import bpe, decontamination, fingerprints, html_text, line_dedup, near_duplicates, quality, sharding, toxicity, warc
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, document string, key string, `a.b` string, _id string"
LONG = "word and another one\n" * 30_000


def frame(spark, rows):
    full = [(i, t, None, None, None if t is None else len(t), "x", "y", "z", "w", "v") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


ROWS = [(5, None), (3, ""), (9, " \t\n "), (1, "one"), (2, LONG), (2, LONG), (None, "lost and found again"), (None, None), (7, "a b c d e f g h i j k l m"), (8, "a b c d e f g h i j k l m"), (2**60, "Straße ÉÈ\n\n日本語テキスト 🙂🙂 end")]


@pytest.fixture(scope="module")
def edge(spark):
    return frame(spark, ROWS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, []).cache()


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())


WANT = sorted((i is None, i or 0) for i, _ in ROWS)


def test_sharding(edge, none):
    rows = sharding.document_shards(edge, 4).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == WANT
    assert sorted(r.row_number for r in rows) == list(range(len(ROWS)))
    assert {r.size for r in rows if r.doc_id == 5} == {8} and {r.text_crc32 for r in rows if r.doc_id == 5} == {0}
    assert len({(r.shard, r.slot) for r in rows}) == len(ROWS)
    assert sharding.document_shards(none, 4).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 10_007])
def test_permutation_is_a_bijection(spark, n):
    df = spark.range(n).select(sharding.permuted(__import__("pyspark.sql.functions", fromlist=["col"]).col("id"), n, 7).alias("p"))
    got = [r.p for r in df.collect()]
    assert sorted(got) == list(range(n))
    assert n < 1000 or got != list(range(n))


def test_fingerprints(edge, none):
    rows = fingerprints.edited_fingerprints(edge).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == WANT
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[5].fingerprint == by[3].fingerprint and by[5].n_chars == 0 and by[5].edited_sha256 == brute.sha("")
    assert by[7].fingerprint == by[8].fingerprint and by[7].near_next == 1.0
    last = by[2**60]
    first = [t for i, t in ROWS if i is None]  # null ids sort first, the smaller text before
    n = last.n_chars
    assert last.edited_sha256 == brute.sha(ROWS[-1][1][: n - n // 2] + sorted(t or "" for t in first)[0][: n // 2])
    assert fingerprints.edited_fingerprints(none).count() == 0


def test_winnowing_against_brute_force(spark):
    from pyspark.sql import functions as F

    text = " ".join(np.random.default_rng(1).choice(["ab", "cd,", "éf", "gh12", "abcdefghijkl", "日本語", "(!"], 300))
    cut_up = regex.findall(r"[[\p{L}\p{M}]--\p{Han}]+|\p{N}+|\S", text, flags=regex.V1)
    assert {"cd", ",", "gh", "12", "語", "("} <= set(cut_up)
    h = [r.h for r in spark.createDataFrame([(t,) for t in cut_up], "t string").select(F.xxhash64("t").alias("h")).collect()]
    k, w = 4, 8
    grams = spark.createDataFrame([tuple(h[i : i + k]) for i in range(len(h) - k + 1)], ", ".join(f"a{j} long" for j in range(k)))
    g = [r.g for r in grams.select(F.shiftrightunsigned(F.xxhash64(*grams.columns), 25).alias("g")).collect()]
    want = []
    for i in range(len(g) - w + 1):
        low = min(g[i : i + w])
        at = max(j for j in range(i, i + w) if g[j] == low)
        if not want or want[-1] != (low, at):
            want.append((low, at))
    got = fingerprints.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert list(zip(got.hashes, got.positions)) == want


def test_winnowing_guarantee_without_blanks(spark):
    """A passage without blanks shares a hash wherever it stands, and an inserted sign costs its surroundings only."""
    rng = np.random.default_rng(2)
    passage = "".join(chr(0x4E00 + i) for i in rng.integers(0, 2000, fingerprints.K + fingerprints.W - 1))
    other = lambda n: "".join(chr(0x5E00 + i) for i in rng.integers(0, 2000, n))
    long = other(400)
    docs = [(0, other(50) + passage + other(51)), *[(i, other(20 + i) + passage + other(9)) for i in range(1, 10)], (10, long), (11, long[:200] + "x" + long[200:])]
    got = {r.doc_id: set(r.hashes) for r in fingerprints.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[0] & got[i] for i in range(1, 10))
    assert len(got[10] & got[11]) > 0.9 * len(got[10])


def test_near_duplicates(edge, none):
    rows = near_duplicates.near_duplicates(edge, 3, 85).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == WANT
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is not None}
    assert by[7] == (11, 7, True) and by[8] == (11, 7, False)
    assert by[5] == (0, 5, True) and by[3] == (0, 3, True) and by[9] == (0, 9, True) and by[1] == (1, 1, True)
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert near_duplicates.near_duplicates(none, 3, 85).count() == 0
    assert near_duplicates.drop_near_duplicates(edge, 3, 85).columns == edge.columns


def test_near_copies_in_one_large_group(spark, monkeypatch):
    """Chains, ties and unlinked copies of one text, over several blocks."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(90)]
    docs = []
    for i in range(160):
        t = list(words)
        for j in rng.choice(90, rng.integers(0, 6), replace=False):
            t[j] = f"x{rng.integers(0, 40)}"
        docs.append((1000 - i, " ".join(t)))
    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", 2_000)
    got = near_duplicates.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()
    want = brute.components(docs, 3, 85)
    assert len({c for _, c in want.values()}) > 5
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_line_dedup(spark, edge, none):
    rows = line_dedup.line_dedup(edge, digest=True).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == WANT
    by = {r.doc_id: (r.n_lines, r.n_dropped) for r in rows if r.doc_id is not None}
    assert by[5] == (1, 0) and by[3] == (1, 0) and by[8] == (1, 1) and by[7] == (1, 0) and by[2] == (30_001, 0)
    assert line_dedup.line_dedup(none, digest=True).count() == 0
    assert line_dedup.line_dedup(edge).select("document.*").columns == edge.columns


def test_line_dedup_of_a_hot_line(spark):
    hot = "the same line everywhere"
    docs = [(i, f"own line number {i}\n{hot}\n{'short' if i % 2 else hot.upper()}") for i in range(500, 0, -1)]
    rows = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), digest=True).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in rows} == {i: (n, d, brute.sha(t)) for i, (n, d, t) in brute.line_dedup(docs).items()}


def test_bpe(spark, edge, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    want = {}
    from tests.llm.test_queries import reference_encoding

    enc = reference_encoding()
    for i, t in ROWS:
        want.setdefault(i, []).append(enc.encode_ordinary(t or ""))
    for limits in ({}, {"long": 15, "chunk": 12, "overlap": 5}):
        rows = bpe.encode(edge, path, public_tokenizers.PATTERN, **limits).collect() if not limits else bpe.encode(edge.where("doc_id is null or doc_id <> 2"), path, public_tokenizers.PATTERN, **limits).collect()
        for r in rows:
            doc_id = r.document.doc_id
            assert list(r.ids) in want[doc_id]
            assert bytes(r.decoded).decode() in [t or "" for i, t in ROWS if i == doc_id]
        assert len(rows) == len(ROWS) - (2 if limits else 0)
    assert bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0


def test_chunks_stitch_everywhere():
    codec = bpe.Codec(bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    rng = np.random.default_rng(5)
    for _ in range(3_000):
        text = "".join(rng.choice(list("ab'sre  \n\t1.,é"), rng.integers(0, 50)))
        want = regex.findall(public_tokenizers.PATTERN, text)
        size = int(rng.integers(8, 20))
        overlap = int(rng.integers(2, 7))
        assert bpe.pretokenise(codec.finder(text), text, size, overlap) == want
        assert bpe.n_chunks(len(text), size, overlap) == len(bpe.chunks(len(text), size, overlap))
    giant = "x" * 3_000 + " yo" * 50
    assert codec.encode(giant, size=100, overlap=10) == bpe.merge(b"x" * 3_000, codec.ranks) + codec.encode(" yo" * 50)


def test_classifiers(spark, edge, none):
    labels = spark.createDataFrame([(1, 1, 0, "q"), (7, 0, 1, "q"), (8, 0, 1, "q"), (5, None, None, "q"), (77, 1, 1, "q"), (None, 1, 1, "q")], "doc_id long, quality int, toxic int, text string")
    from pyspark.sql import functions as F

    for module, neutral in ((quality, 0.5), (toxicity, 0.0)):
        model = module.train(edge, labels, F.lit(True))
        rows = module.score(edge, model).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
        assert {r.document["a.b"] for r in rows} == {"w"}
        assert module.train(none, labels, F.lit(True)) is None and module.train(edge, labels.limit(0), F.lit(True)) is None
        assert {r.score for r in module.score(edge, None).collect()} == {neutral}
        assert module.score(none, model).count() == 0


def test_factorization_machine_against_all_pairs():
    """Margins and the gradient's descent against sums over all pairs of terms."""
    from fiberlake.llm.linear import FactorizationMachine

    rng = np.random.default_rng(4)
    fm = FactorizationMachine(12, 3)
    fm.w0, fm.w = 0.3, rng.normal(size=12)
    present = rng.random((40, 12)) < 0.3
    docs, terms = np.nonzero(present)
    want = [0.3 + sum(fm.w[i] for i in t) + sum(fm.v[i] @ fm.v[j] for i in t for j in t if i < j) for t in (np.flatnonzero(p) for p in present)]
    assert np.allclose(fm.margin(docs, terms, 40), want)


def test_bradley_terry_against_gradient():
    """At the fitted weights the gradient of the pairwise logistic loss vanishes, and order follows a planted score."""
    from fiberlake.llm.linear import bradley_terry, sigmoid

    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3))
    y = (x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=400) > 0).astype(int)
    w = bradley_terry(x, y, 4_000, steps=2_000)
    good, bad = x[y == 1], x[y == 0]
    d = (good[:, None] - bad[None]).reshape(-1, 3)
    assert np.abs(-(d * sigmoid(-(d @ w))[:, None]).mean(0) + 1e-3 * w).max() < 0.02
    assert w[0] > 2 * abs(w[2]) and w[1] < 0


def test_scores_against_a_plain_version(spark, sf):
    """op10's scores by dictionaries of terms in place of arrays."""
    from fiberlake.llm import tokens
    from fiberlake.llm.labelled import held_out

    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.train(docs, labels, ~held_out(3, 1))
    place = {int(t): i for i, t in enumerate(model.chosen)}
    for r in toxicity.score(docs.limit(200), model).collect():
        counts = {}
        for word in regex.findall(rb"[0-9A-Za-z\x80-\xff]+", (r.document.text or "").encode()):
            word = word.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
            h, _, heads = tokens.words([word], tokens.separators(True), toxicity.PREFIXES)
            for x in (h, *heads):
                t = int(x[0] >> np.uint64(64 - toxicity.BITS))
                counts[t] = counts.get(t, 0) + 1
        held = {place[t] for t in counts if t in place} | {place[t2] for t, n in counts.items() if n > 1 and (t2 := int(toxicity.again(t))) in place}
        m = model.machine
        margin = m.w0 + sum(m.w[i] for i in held) + sum(m.v[i] @ m.v[j] for i in held for j in held if i < j)
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(margin - model.cut + np.log(7 / 3), -40, 40)))) < 1e-9


def test_factorization_machine_learns_a_pair():
    """Terms 0 and 1 are harmless alone; together they are toxic."""
    from fiberlake.llm.linear import FactorizationMachine, sigmoid

    rng = np.random.default_rng(1)
    present = rng.random((600, 5)) < 0.4
    y = (present[:, 0] & present[:, 1]).astype(float)
    docs, terms = np.nonzero(present)
    fm = FactorizationMachine(5, 4)
    fm.fit(docs, terms, y)
    right = ((sigmoid(fm.margin(docs, terms, 600)) > 0.5) == (y == 1)).mean()
    assert right > 0.97


def test_decontamination(spark, edge, none):
    item = " ".join(f"token{i}" for i in range(30))
    broken = " ".join("other" if i in (9, 21) else f"token{i}" for i in range(30))
    docs = frame(spark, ROWS + [(100, f"before {item} after"), (101, f"x {broken} y"), (102, item.upper()), (102, item.upper()), (103, "token3 token4 token5 unrelated")])
    bench = spark.createDataFrame([(1, item, "k"), (2, None, "k"), (3, "", "k"), (4, "a", "k"), (5, "a b c d e f", "k"), (None, "one two three four five six seven", "k")], "item_id long, text string, key string")
    rows = decontamination.overlaps(docs, bench).collect()
    got = {(r.doc_id, r.item_id): (r.doc_start, r.n_tokens, r.n_matched) for r in rows}
    assert got[100, 1] == (1, 30, 30) and got[101, 1] == (1, 30, 28) and got[102, 1] == (0, 30, 30) and (103, 1) not in got
    assert got[7, 4] == (0, 1, 1)
    assert got[7, 5] == (0, 6, 6) and got[8, 5] == (0, 6, 6)
    assert {d for d, _ in got} == {100, 101, 102, 7, 8}
    left = decontamination.decontaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, _ in ROWS} - {7, 8} | {103}
    hit = frame(spark, [(None, item), (1, item), (1, "clean"), (2, f"{item} between {item}")])
    assert [r.text for r in decontamination.decontaminated(hit, bench).collect()] == ["clean"]
    twice = sorted(r.doc_start for r in decontamination.overlaps(hit, bench).collect() if r.doc_id == 2)
    assert twice == [0, 31]
    assert decontamination.overlaps(none, bench).count() == 0 and decontamination.overlaps(docs, bench.limit(0)).count() == 0


def test_decontamination_in_any_case(spark):
    import unicodedata

    item = " ".join(f"éñtoken{i} straße{i} źdźbło{i}" for i in range(7))
    docs = [(1, item), (2, item.upper()), (3, unicodedata.normalize("NFD", item)), (4, unicodedata.normalize("NFD", item.upper())), (5, item.replace("é", "e"))]
    bench = spark.createDataFrame([(1, item.title())], "item_id long, text string")
    got = {r.doc_id: (r.doc_start, r.n_tokens, r.n_matched) for r in decontamination.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert {i: got[i] for i in (1, 2, 3, 4)} == {i: (0, 21, 21) for i in (1, 2, 3, 4)} and got.get(5, (0, 0, 0))[2] < 21
    assert {r.doc_id for r in decontamination.decontaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()} <= {5}


def test_decontamination_of_reworded_items():
    """Every place of up to three replaced words that leaves three quarters of an item (all of one of fewer than SHORTEST words)."""
    from itertools import combinations

    from fiberlake.llm import tokens

    for n in range(1, 19):
        words = [f"t{j}" for j in range(n)]
        index = decontamination.Index([n], [" ".join(words).encode()])
        gone = [c for k in range(4) for c in combinations(range(n), k)]
        texts = [" ".join(["before", *(f"other{j}" if j in c else w for j, w in enumerate(words)), "after"]).encode() for c in gone]
        h, counts, _ = tokens.words(texts, tokens.separators(True))
        stops = np.cumsum(counts)
        starts = stops - counts
        found = {int(d) for d, i, diagonal, _, _ in index.hits(h, starts, stops) if decontamination.verified(h[starts[d] : stops[d]], index.items[i], int(diagonal))}
        allowed = n // 4 if n >= decontamination.SHORTEST else 0
        assert {d for d, c in enumerate(gone) if len(c) <= allowed} <= found
        assert all(len(c) <= allowed or n - len(c) >= decontamination.LEAST_MATCHED for c in (gone[d] for d in found))


def test_masks_miss_no_place():
    from itertools import combinations

    for n in range(decontamination.SHORTEST, 24):
        masks = decontamination.masks_of(n)
        held = [int(m, 2) << a for m in masks for a in range(n - len(m) + 1)]
        for gone in combinations([1 << i for i in range(n)], n // 4):
            left = (1 << n) - 1 - sum(gone)
            assert any(left & x == x for x in held), (n, gone)


def test_decontamination_in_blocks(spark, edge, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join("abcdefghijklm"[i : i + 5])) for i in range(9)], "item_id long, text string")
    whole = sorted(map(tuple, decontamination.overlaps(edge, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 40)
    assert sorted(map(tuple, decontamination.overlaps(edge, bench).collect())) == whole and whole


PAGES = "page_id long, url string, html string, text string, host string"


def test_decontamination_of_repeated_words():
    """Runs of one word, and of two in turn, are searched in time that grows with their diagonals."""
    import time

    for item, text, seconds in ((["a"] * 200, ["a"] * 20_000, 0.5), (["a", "b"] * 100, ["a", "b"] * 10_000, 5), (["a"] * 60 + ["b"] * 4 + ["a"] * 60, ["a"] * 5_000 + ["b"] * 3 + ["a"] * 5_000, 5)):
        x = decontamination.Index([1], [" ".join(item).encode()])
        began = time.time()
        ((_, _, found),) = decontamination.search(x, [" ".join(text).encode()])
        assert time.time() - began < seconds
        spans = sorted(found)
        assert all(a[0] + a[2] <= b[0] for a, b in zip(spans, spans[1:])) and max(f[3] for f in found) >= min(0.9 * len(item), len(text))


def test_decontamination_of_substituted_passages_on_a_table(spark, sf):
    """Items with every sixth word replaced, planted in documents of the given table: held against a plain search of all places."""
    import random

    rng = random.Random(4)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 4000").orderBy("doc_id").limit(120).collect()]
    planted = []
    for k, (i, text) in enumerate(docs):
        j, passage = items[k % len(items)]
        words = passage.split()
        for at in rng.sample(range(len(words)), len(words) // 6):
            words[at] = f"zz{at}"
        own = text.split()
        planted.append((i, " ".join(own[: len(own) // 2] + words + own[len(own) // 2 :])))
    a = spark.createDataFrame(planted, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.overlaps(a, b).collect()}
    sure = {(i, items[k % len(items)][0]) for k, (i, _) in enumerate(docs)}
    assert sure <= got
    # no other pair that a plain search of all places finds is missed
    fold = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", decontamination.folded(t).lower()) if w]
    words = {j: fold(t) for j, t in items}
    for i, text in planted[:40]:
        x = fold(text)
        for j, y in words.items():
            most = max((sum(p == q for p, q in zip(x[d:], y)) for d in range(len(x) - len(y) + 1)), default=0)
            if len(y) >= decontamination.SHORTEST and most >= decontamination.IDENTITY * len(y):
                assert (i, j) in got


def test_hashes_of_rests_tell_repetitive_blocks_apart():
    """Complementary Thue-Morse blocks collide in any polynomial modulo a power of two."""
    import numpy as np

    h = np.array([1, 2], np.uint64)
    for n in (1_024, 2_048, 4_096):
        bits = np.bitwise_count(np.arange(n, dtype=np.uint64)) & 1
        one, other = h[bits], h[1 - bits]
        both = np.concatenate((one, other, one))
        r = html_text.rests(both, np.repeat([n, 2 * n, 3 * n], n))
        assert r[0] != r[n] and (r[:n] == r[2 * n :]).all() and len(set(r[: 2 * n].tolist())) > 2 * n - 8


def test_line_dedup_of_many_rows_without_ids(spark):
    """Each of 100,000 rows without an id is judged by its own text, and nothing is gathered for all of them."""
    from pyspark.sql import functions as F

    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a line that all rows hold\nown line number "), "id").alias("text"))
    docs = docs.union(spark.createDataFrame([(5, "a line that all rows hold")], "doc_id long, text string"))
    out = line_dedup.line_dedup(docs).select("document.*", "n_dropped")
    assert out.where("doc_id is null and n_dropped = 1 and text like 'own line number%'").count() == 100_000
    assert [tuple(r) for r in out.where("doc_id = 5").collect()] == [(5, "a line that all rows hold", 0)]


def test_numbers_of_one_key_come_from_many_buckets(spark):
    from fiberlake.llm.common import Ordering

    rows = spark.range(20_000).selectExpr("cast(null as long) as k", "hash(id) as t", "id")
    order = Ordering(rows, "k", "t")
    assert len(order.first) > 2
    got = order.numbered(rows, ["id"]).orderBy("row_number").select("row_number", "t").collect()
    assert [r.row_number for r in got] == list(range(20_000)) and [r.t for r in got] == sorted(r.t for r in got)


def test_warc(spark):
    page = lambda i: f"<p>page {i} é</p>"
    rows = [(i, f"http://h/{i}", page(i), "t", "h") for i in range(40)] + [(None, None, None, "t", "h"), (3, None, "", "t", "h"), (3, None, "", "t", "h")]
    pages = spark.createDataFrame(rows, PAGES)
    put = warc.placed(warc.measured(warc.records(pages))).cache()
    assert put.count() == 43
    same = warc.audit(warc.tree(put), warc.tree(put))
    assert same.count() == 0
    hurt = put.selectExpr("page_id", "archive", "no", "if(no = 17, size + 1, size) as size", "if(no in (17, 30), sha2(hash, 256), hash) as hash").where("no <> 42")
    found = sorted((r.record_no, r.damage) for r in warc.audit(warc.tree(put), warc.tree(hurt)).collect())
    assert found == [(17, "length"), (30, "content"), (42, "missing in replica")]
    nothing = warc.placed(warc.measured(warc.records(pages.limit(0))))
    assert nothing.count() == 0 and warc.audit(warc.tree(nothing), warc.tree(nothing)).count() == 0


@pytest.mark.parametrize("lost,added,doubled", [(0, None, None), (5_000, None, None), (None, True, None), (None, None, 17), (4_100, True, 4_099)])
def test_warc_lost_added_and_doubled_records(spark, lost, added, doubled):
    """Whatever a replica loses or gains before it is numbered, only those records are reported, and untouched archives keep their roots."""
    pages = spark.range(9_000).selectExpr("id as page_id", "concat('http://h/', id) as url", "concat('<p>', id % 7, '</p>') as html")
    put = warc.placed(warc.measured(warc.records(pages)))
    own = [(i, 1) for i in range(9_000) if i != lost] + ([(-4, 1)] if added else []) + ([(doubled, 1)] if doubled is not None else [])
    replica = spark.createDataFrame(own, "page_id long, one int").selectExpr("page_id", "concat('http://h/', page_id) as url", "concat('<p>', page_id % 7, '</p>') as html")
    trees = [warc.tree(put), warc.tree(warc.placed_like(warc.measured(warc.records(replica)), put))]
    got = sorted((r.damage, r.page_id, r.record_no + r.archive * warc.ARCHIVE) for r in warc.audit(*trees).collect())
    want = [("missing in replica", lost, lost)] if lost is not None else []
    strange = ([-4] if added else []) + ([doubled] if doubled is not None else [])
    want += [("missing in primary", i, 9_000 + k) for k, i in enumerate(strange)]
    assert got == sorted(want)
    roots = [{r.archive: r.hash for r in t.where(f"level = {warc.LEVELS}").collect()} for t in trees]
    hit = {w[2] // warc.ARCHIVE for w in want}
    assert {a for a in roots[0] if roots[0][a] == roots[1].get(a)} == set(roots[0]) - hit


def test_warc_with_repeated_and_missing_ids(spark):
    """Rows of one page_id, or of none, keep their places in a damaged replica."""
    rows = [(1, f"http://h/{i}", f"<p>{i}</p>", "t", "h") for i in range(30)] + [(None, None, f"<p>{i}</p>", "t", "h") for i in range(30)]
    recs = warc.records(spark.createDataFrame(rows, PAGES))
    hurt = recs.selectExpr("page_id", "key", "if(record like '%<p>7</p>%', concat(record, 'x'), record) as record")
    put = warc.placed(warc.measured(recs))
    sides = [warc.tree(put), warc.tree(warc.placed_like(warc.measured(hurt), put))]
    assert sorted(r.damage for r in warc.audit(*sides).collect()) == ["length", "length"]


def test_html(spark):
    menu = "Home News Sport Weather Travel Food Contact"
    pages = [
        (1, "http://a.org/1", f"<html><body><div>{menu}</div><p>First story of the day, told at length &amp; with care.</p></body></html>", "t", "h"),
        (2, "http://a.org/2", f"<html><body><div>{menu}</div><p>Second story, quite another one about other things.</p></body></html>", "t", "h"),
        (3, "http://b.org/1", "<header>top</header><article><h1>Title&nbsp;&lt;x&gt;</h1><p>one<br>two <b>three</b><!-- no --><script>var a='<p>';</script><div class='ad-banner'>buy</div><section id=comments><article>said</article></section><p>four</article><footer>end</footer>", "t", "h"),
        (4, None, None, "t", "h"), (5, "", "", "t", "h"), (5, "", "", "t", "h"), (6, "x", "a < b and c > d &#x41;&eacute; <p", "t", "h"), (7, "http://c.org", "<p>" + "long text here " * 20_000, "t", "h"),
    ]
    df = spark.createDataFrame(pages, PAGES)
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got[1] == "First story of the day, told at length & with care." and got[2] == "Second story, quite another one about other things."
    assert got[3] == "Title <x>\none two three\nfour"
    assert got[4] == "" and got[5] == "" and got[6].startswith("a < b and c > d Aé") and len(got[7]) == 20_000 * 15 - 1
    assert html_text.extract(df).count() == len(pages) and html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<div class='content-sidebar-wrap'>{}</div>", "<div class=has-sidebar>{}</div>", "<div class='site sidebar'>{}</div>", "<form id=aspnetForm>{}</form>", "<div id=search><div class=widget>{}</div></div>",
        "{}<section id=comments><article><p>said</article></section>", "<div class=widget>{}<section id=comments><article><p>said</article></section></div>", "{}<article class=comment><p>said</article>",
    ],
)
@pytest.mark.parametrize("tag", ["<article>", "<main class=search-page>", "<main class=search>"])
def test_html_layout_wrappers(page, tag):
    body = f"{tag}<h1>Title</h1><section id='related-work'><p>Earlier work</section><div class='ad-slot-1'>buy</div><div class='related-posts'>more</div><p>end</{tag[1:].split('>')[0].split()[0]}>"
    found = html_text.blocks("<nav>menu</nav><body class='has-sidebar'>" + page.format(body) + "<footer>foot</footer>")
    assert [t for inside, _, t in found if inside] == ["Title", "Earlier work", "end"]
    assert {t for inside, kind, t in found if kind == html_text.STRUCTURE} >= {"menu", "buy", "more", "foot"}


def test_html_repeats_inside_the_article(spark):
    """A line in the articles of most pages of a host goes; passages that few share, and copies of an article, stay."""
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(20))
    shared = "a passage of several words that two of the pages share"
    pages = [(i, f"http://a.org/{i}", f"<article><h1>Title {i}</h1><p>{own(i)}<p>{shared if i < 2 else own(100 + i)}<p>Share this story with all of your friends</article>") for i in range(5)]
    pages += [(10 + i, f"http://b.org/{i}", f"<article><h1>Same</h1><p>{own(50)}</article>") for i in range(4)]
    pages += [(20 + i, f"http://c.org/{i}", f"<article><p>{own(60 + i)}<p>Share this story</article>") for i in range(2)]
    got = {r.page_id: r.text.split("\n") for r in html_text.extract(spark.createDataFrame(pages + pages[:1], "page_id long, url string, html string")).collect()}
    assert all(got[i] == [f"Title {i}", own(i), shared if i < 2 else own(100 + i)] for i in range(5))
    assert all(got[10 + i] == ["Same", own(50)] for i in range(4))
    assert all(got[20 + i] == [own(60 + i), "Share this story"] for i in range(2))


def test_pipeline(spark, tmp_path):
    insult = "idiot moron scum"
    clean = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(20, 60)]
    bad = [(i, f"{insult} " + " ".join(f"b{i}x{j}" for j in range(20))) for i in range(60, 90)]
    item = " ".join(f"bench{j}" for j in range(25))
    copy = (200, clean[0][1])
    lines = [(300, "shared line of some length\nfirst of its own kind here"), (301, "shared line of some length\nsecond of its own kind here")]
    rows = ROWS + clean + bad + [copy, (201, f"intro {item}")] + lines
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(20, 90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == [c.strip("`") for c in (x.rsplit(" ", 1)[0] for x in SCHEMA.split(", "))], name
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert not set(kept) & {i for i, _ in bad} and {i for i, _ in clean} - set(kept) == set()
    assert 200 not in kept and 201 not in kept and kept[300] == lines[0][1] and kept[301] == "second of its own kind here"
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in out.collect()}[301][1] == brute.sha("second of its own kind here")


def test_a_group_of_100_000_copies(spark):
    """Near copies of one text: links in linear work, and no member left out."""
    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(120)]
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit(" ".join(words[:60])), F.concat(F.lit("own"), F.col("id")), F.lit(" ".join(words[60:]))).alias("text"))
    docs = docs.union(spark.range(100_000, 100_050).select("id", F.concat_ws(" ", *[F.concat(F.lit(f"x{i}y"), F.col("id")) for i in range(20)])))
    out = near_duplicates.near_duplicates(docs, 3, 85).groupBy("component_id").count().collect()
    assert sorted(r["count"] for r in out) == [1] * 50 + [100_000]
