"""The registered queries on the given tables, against brute force, exact round trips and held-out labels."""

import hashlib
import html
import re

import public_tokenizers
import pytest
import tiktoken

from fiberlake.llm import bpe
from fiberlake.llm.queries import ORACLES, QUERIES
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_sharding(spark, sf, docs):
    rows = QUERIES["op1_feistel_sharding"](spark, sf).collect()
    text = dict(docs)
    assert sorted(r.doc_id for r in rows) == sorted(text)
    slots = {}
    for r in rows:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, brute.crc(text[r.doc_id]), "rows", None)
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = QUERIES["op1_feistel_sharding"](spark.newSession(), sf).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


@pytest.mark.parametrize("name,label,modulus,remainder", [("op2_pairwise_quality", "quality", 4, 2), ("op10_toxicity", "toxic", 3, 1)])
def test_classifiers(spark, name, label, modulus, remainder):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES[name](spark, sf).collect()}
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    assert all(r.held_out == (brute.crc(str(r.doc_id)) % modulus == remainder) for r in rows.values())
    truth = [(r[label], rows[r.doc_id].predicted) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    right = {y: [p == y for t, p in truth if t == y] for y in (0, 1)}
    # some of the given labels contradict the texts
    assert all(sum(v) / len(v) > 0.89 for v in right.values()), {y: (sum(v), len(v)) for y, v in right.items()}


def test_decontamination_finds_all_exact_passages(spark, sf, docs):
    found = {(r.doc_id, r.item_id): r for r in QUERIES["op3_spaced_seed_decontamination"](spark, sf).collect()}
    norm = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.translate(brute.LOWER))) + " "
    items = {r.item_id: norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    whole = {(i, j) for i, t in docs for j, x in items.items() if x in norm(t)}
    assert whole and whole <= set(found)
    for i, j in whole:
        assert found[i, j].n_matched == len(items[j].split())
    for (i, j), r in found.items():  # what is found is a run of the item's words
        a, b = norm(dict(docs)[i]).split()[r.doc_start :][: r.n_tokens], items[j].split()[r.item_start :][: r.n_tokens]
        assert sum(x == y for x, y in zip(a, b)) == r.n_matched


def test_fingerprints(spark, sf, docs):
    rows = {r.doc_id: r for r in QUERIES["op4_winnowing_fingerprints"](spark, sf).collect()}
    order = sorted(docs)
    by_text = {}
    for k, (i, t) in enumerate(order):
        nxt, n = order[(k + 1) % len(order)][1], len(t)
        edited = t[: n - n // 2] + nxt[: n // 2]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (n, brute.sha(edited))
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        by_text.setdefault(t, set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert len({x for s in by_text.values() for x in s}) > 0.99 * len(by_text)
    long = [r for r in rows.values() if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in long) > 0.98 * len(long)


def test_near_duplicates(spark, sf, docs):
    rows = QUERIES["op5_minhash_near_duplicates"](spark, sf).collect()
    want = brute.components(docs, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_line_dedup(spark, sf, docs):
    rows = QUERIES["op6_line_dedup"](spark, sf).collect()
    want = {i: (n, d, brute.sha(t)) for i, (n, d, t) in brute.line_dedup(docs).items()}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in rows} == want


def reference_encoding():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, sf, docs):
    rows = {r.doc_id: r for r in QUERIES["op7_byte_bpe"](spark, sf).collect()}
    enc = reference_encoding()
    for i, t in docs:
        ids = enc.encode_ordinary(t)
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), brute.sha(",".join(map(str, ids))), hashlib.sha256(t.encode()).hexdigest())


def test_warc_audit(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    con.execute("set timezone='UTC'")
    want = con.execute(ORACLES["op8_warc_fixity_audit"])
    cols = [c[0] for c in want.description]
    got = QUERIES["op8_warc_fixity_audit"](spark, sf)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(tuple, got.select(*[f"`{c}`" for c in cols]).collect())) == sorted(want.fetchall())


def test_main_text(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op9_html_main_text"](spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in want if b)
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))
        assert 0 <= r.n_repeated <= r.n_outside


@pytest.mark.parametrize("name", ["op5_minhash_near_duplicates", "op6_line_dedup"])
def test_against_sql(spark, name):
    from tests.compare import connection, rows_of

    sf = "/root/testdata/sf0.001"
    columns, got, want = rows_of(spark, sf, connection(sf), QUERIES[name], ORACLES[name])
    assert got == want and want
