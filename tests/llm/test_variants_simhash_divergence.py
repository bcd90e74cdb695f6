"""Spelling variants, SimHash anchors and source divergence: against brute force, on crowds, and on odd tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fiberlake.llm import divergence, simhash, spelling
from fiberlake.llm.queries import ORACLES, QUERIES
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, word string, n long, point long, key string"


def odd_rows():
    """Nulls everywhere, empty and blank texts, repeated rows, one id with two texts, clashing columns."""
    text = "Colour colours coloured neighbour neighbours; the neighbourhood. " * 5
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, text.replace("our", "or"), "en", "b"), (2, "other words stand here", "en", None), (None, text, None, "b"), (None, None, None, None), (3, None, "fr", "a"), (4, "", "fr", "b"), (5, " \n ", "fr", ""), (6, "É" * 40 + " " + "é" * 39, "fr", "b"), (7, "É" * 40 + " " + "é" * 39, "fr", "b")]
    return [(*r, "w", 5, 0, "k") for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def as_variants(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_spelling_query(spark, sf, docs):
    want = brute.variants(brute.spelling_words(docs))
    assert as_variants(QUERIES["op11_spelling_variants"](spark, sf)) == want
    assert any(v[0] for v in want.values()) and any(v[3] > 3 for v in want.values())


@pytest.mark.parametrize("least,most", [(1, 1 << 20), (64, 1 << 20), (1, 0)])
def test_grams_of_any_dictionary_find_all_near_words(spark, least, most):
    """Few letters and many words, so that grams are inner nodes at every level; with most = 0 none is."""
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 14))): rng.choice([2, 3, 40, 41, 4_000]) for _ in range(1_500)}
    words |= {w[:k] + rng.choice("abé") + w[k:]: 2 for w in list(words)[:300] for k in (0, len(w) // 2, len(w))}
    words |= {"a" * k: k for k in range(90, 103)} | {"a" * 96 + "b" * 200: 7, "a" * 96 + "c" + "b" * 199: 70, "a" * 97 + "b" * 200: 700}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert as_variants(spelling.variants(df, least=least, most=most)) == brute.variants(words)


def test_dictionary_is_bounded(spark):
    words = spark.range(3_000).select(F.concat(F.lit("interest"), F.lpad(F.conv("id", 10, 16), 4, "q")).alias("word"), F.lit(2).alias("n"))
    counts = {r.gram: r.n for r in spelling.gram_counts(words).collect()}
    for most in (0, 3, 20, 10_000):
        inner = spelling.dictionary(words, 4, most)
        assert len(inner) <= most and (most < 10_000 or len(inner) == sum(n > 4 for n in counts.values()))


def test_spelling_on_odd_rows(spark, odd):
    got = as_variants(spelling.variants(spelling.word_counts(odd, modulus=31)))
    assert got == brute.variants(brute.spelling_words([r[:2] for r in odd_rows()]))
    assert as_variants(spelling.variants(spelling.word_counts(odd.limit(0)))) == {}


def test_simhash_query(spark, sf, docs):
    rows = QUERIES["op12_simhash_near_duplicates"](spark, sf).collect()
    points = {i: brute.simhash(t) for i, t in docs}
    reach = brute.reached([(i, p) for i, p in points.items()])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{p:016x}", reach[p]) for i, p in points.items()}
    assert len({r.component_id for r in rows}) < len(rows)


@pytest.mark.parametrize("crowd", [0, 6, 512])
def test_anchors_find_all_links(spark, crowd):
    """Fingerprints in clouds of few bits around some centres; small crowds send most of them on."""
    rng = random.Random(3)
    points = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        bits = rng.sample(range(64), 9)
        for _ in range(60):
            points.add(centre ^ sum(1 << b for b in bits if rng.random() < 0.3))
    points |= {0, 1, 3, 7, (1 << 64) - 1, 1 << 63, (1 << 63) | (1 << 31)}
    rows = list(enumerate(sorted(points, key=lambda p: p * 0x9E3779B97F4A7C15 % (1 << 64))))
    signed = [(k, p - (1 << 64) if p >> 63 else p) for k, p in rows]
    found = simhash.classes(spark.createDataFrame(signed, "doc_id long, point long"), crowd).collect()
    assert {r.point % (1 << 64): r.component_id for r in found} == brute.reached(rows)


def test_anchors_cover():
    x = np.random.default_rng(1).integers(0, 1 << 32, 500, dtype=np.uint64)
    near = simhash.anchors_near(x)
    assert not simhash.syndromes(near.reshape(-1)).any()
    assert (np.bitwise_count(near[:, 0] ^ x) <= 1).all() and (np.bitwise_count(near ^ x[:, None]) <= 2).all()
    for bit in range(32):
        moved = simhash.anchors_near(x ^ np.uint64(1 << bit))[:, 0]
        assert (near == moved[:, None]).any(1).all()


def test_simhash_on_odd_rows(spark, odd):
    rows = simhash.simhash_near_duplicates(odd).collect()
    source = [r[:2] for r in odd_rows()]
    reach = brute.reached([(i, brute.simhash(t)) for i, t in source if i is not None])
    want = [(i, f"{brute.simhash(t):016x}", None if i is None else reach[brute.simhash(t)]) for i, t in source]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert simhash.simhash_near_duplicates(odd.limit(0)).collect() == []


def plain_divergence(docs, least, top):
    """docs: (text, lang, source)."""
    import re
    from collections import Counter, defaultdict

    term, n, held, sources = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        found = term.findall((text or "").translate(brute.LOWER))
        sources[lang].add(source)
        n[lang, source].update(found)
        held[lang].update(set(found))
    out = set()
    for lang in sources:
        kept = [t for t, c in held[lang].items() if c >= least]
        share = lambda counts: {t: 1 + 1_000_000_000 * (counts[t] + 5) // (sum(counts[x] for x in kept) + 5 * len(kept)) for t in kept}
        whole = share(sum((n[lang, s] for s in sources[lang]), Counter()))
        p = {s: share(n[lang, s]) for s in sources[lang]}
        for s in sources[lang]:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources[lang] if o != s]
            terms = [(p[s][t] - whole[t], t) for t in kept if n[lang, s][t] > 0 and p[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for k, (v, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.add((lang, s, part, item, v, k + 1))
    return out


@pytest.mark.parametrize("least,top,spread,abreast", [(2, 3, 7, 2), (1, 50, 4_096, 256), (1_000, 5, 3, 1)])
def test_divergence_blocks(spark, least, top, spread, abreast):
    rng = random.Random(8)
    bag = [rng.choice(["the", "Of", "é", "naïve", "x1y", "日本", "a-b"]) + rng.choice(["", "s", "ness"]) for _ in range(30)]
    docs = [(" ".join(rng.choices(bag[: rng.randint(1, 30)], k=rng.randint(0, 30))), rng.choice(["en", "fr", None]), rng.choice([None, "a", "b", "c", "d", "é"])) for _ in range(200)]
    docs += [(None, "de", "a"), ("", "de", "b"), ("word", "it", "a"), ("12 34", "it", "b")]
    df = spark.createDataFrame([(1, t, lang, s, "w", 5, 0, "k") for t, lang, s in docs], DOCS)
    got = divergence.divergence(df, least, top, spread, abreast).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == plain_divergence(docs, least, top)


def test_divergence_on_odd_rows(spark, odd):
    got = divergence.divergence(odd, 2, 50).collect()
    assert set(map(tuple, got)) == plain_divergence([(r[1], r[2], r[3]) for r in odd_rows()], 2, 50)
    assert divergence.divergence(odd.limit(0)).collect() == []


def test_shares_hold_any_count(spark):
    row = spark.range(1).select(divergence.share(F.lit(10**15), F.lit(3 * 10**15), F.lit(10**6)).alias("p")).first()
    assert row.p == 1 + 10**9 * (10**15 + 5) // (3 * 10**15 + 5 * 10**6)


def test_divergence_against_sql(spark):
    from tests.compare import connection, rows_of

    sf = "/root/testdata/sf0.001"
    _, got, want = rows_of(spark, sf, connection(sf), QUERIES["op13_source_divergence"], ORACLES["op13_source_divergence"])
    assert got == want and want
