"""Registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiberlake.llm import bpe, decontamination, divergence, fingerprints, html_text, line_dedup, near_duplicates, quality, sharding, simhash, spelling, toxicity, warc
from fiberlake.llm.common import table
from fiberlake.llm.labelled import held_out

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(table(spark, sf_dir, "documents"), shards=24, seed=1)


def _scored(module, label: str, modulus: int, remainder: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = module.train(docs, table(spark, sf_dir, "labels"), ~held_out(modulus, remainder))
    out = module.score(docs, model)
    return out.select("document.doc_id", held_out(modulus, remainder, "document.doc_id").alias("held_out"), "score", (F.col("score") >= module.THRESHOLD).cast("int").alias("predicted"))


def op2_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(quality, "quality", 4, 2, spark, sf_dir)


def op3_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), least=10, digest=True)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, digest=True)


def op8_warc_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = warc.records(table(spark, sf_dir, "pages"))
    primary = warc.placed(warc.measured(recs))
    replica = warc.placed_like(warc.measured(warc.damaged_copy(recs)), primary)
    return warc.audit(warc.tree(primary), warc.tree(replica))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(toxicity, "toxic", 3, 1, spark, sf_dir)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), least=7, often=2, modulus=31), ratio=10)


def op12_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_duplicates(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"), least=30, top=50)


QUERIES = {f.__name__: f for f in (op1_feistel_sharding, op2_pairwise_quality, op3_spaced_seed_decontamination, op4_winnowing_fingerprints, op5_minhash_near_duplicates, op6_line_dedup, op7_byte_bpe, op8_warc_fixity_audit, op9_html_main_text, op10_toxicity, op11_spelling_variants, op12_simhash_near_duplicates, op13_source_divergence)}

_RECORD = """'WARC/1.0' || e'\\r\\n' || 'WARC-Type: response' || e'\\r\\n' || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e'\\r\\n' || 'WARC-Target-URI: ' || coalesce(url, '') || e'\\r\\n' || 'Content-Length: ' || strlen(coalesce(html, '')) || e'\\r\\n\\r\\n' || coalesce(html, '') || e'\\r\\n\\r\\n'"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    # all pairs of documents that share a shingle, and everything that links reach
    "op5_minhash_near_duplicates": f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') ws from documents),
s as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')] else [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)] end) sh from w),
x as (select doc_id, len(sh) n, unnest(sh) h from s),
pairs as (select a.doc_id a, b.doc_id b from x a join x b on a.h = b.h and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach as (select doc_id a, doc_id b from documents union select r.a, p.b from reach r join pairs p on p.a = r.b)
select s.doc_id, len(sh)::bigint n_shingles, c component_id, c = s.doc_id kept from s join (select a, min(b) c from reach group by a) r on r.a = s.doc_id""",
    "op6_line_dedup": """
with l as (select doc_id, i, ls[i] line, translate(trim(ls[i], e' \\t\\n\\x0b\\x0c\\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from (select doc_id, ls, unnest(range(1, len(ls) + 1)) i from (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents))),
f as (select k, min(doc_id) first from l where length(k) >= 10 group by k having count(distinct doc_id) > 1),
d as (select l.*, f.first is not null and f.first <> doc_id gone from l left join f on f.k = l.k)
select doc_id, count(*) n_lines, count(*) filter (where gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) kept_sha256 from d group by doc_id""",
    "op13_source_divergence": f"""
with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source, {_LOWER} t from documents),
o as (select r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term from d),
k as (select lang, term, count(*) n from o group by lang, term having count(distinct r) >= 30),
v as (select lang, count(*)::hugeint v, sum(n)::hugeint total from k group by lang),
g as (select distinct lang, source from d),
c as (select g.lang, g.source, k.term, k.n all_n, count(o.r)::hugeint n from g join k on k.lang = g.lang left join o on o.lang = g.lang and o.source = g.source and o.term = k.term group by all),
t as (select *, sum(n) over (partition by lang, source)::hugeint total from c),
p as (select t.*, 1 + 1000000000 * (t.n + 5) // (t.total + 5 * v.v) p, 1 + 1000000000 * (t.all_n::hugeint + 5) // (v.total + 5 * v.v) q from t join v on v.lang = t.lang),
pairs as (select g.lang, g.source, h.source item, coalesce(sum(abs(a.p - b.p)), 0) "value" from g join g h on h.lang = g.lang and h.source <> g.source left join p a on a.lang = g.lang and a.source = g.source left join p b on b.lang = a.lang and b.source = h.source and b.term = a.term group by all),
r as (select lang, source, 'pair' part, item, "value", row_number() over (partition by lang, source order by "value" desc, item) rank from pairs
union all select * from (select lang, source, 'term' part, term item, p - q, row_number() over (partition by lang, source order by p - q desc, term) rank from p where n > 0 and p > q) where rank <= 50)
select lang, source, part, item, "value"::bigint "value", rank::int rank from r""",
    # every record is hashed on both sides and compared; the audit must find the same by descent
    "op8_warc_fixity_audit": f"""
with r as (select page_id, page_id as id, row_number() over (order by page_id, url, html) - 1 as n, {_RECORD} as record from pages),
d as (select *, case when id % 389 = 7 then left(record, (length(record) // 2)::int) when id % 97 = 13 then left(record, length(record) - 5) || '~' || right(record, 4) else record end as damaged from r),
x as (select page_id, n, damaged, 0 as k from d where id % 499 <> 3 union all select page_id, null, damaged, 1 from d where id % 701 = 9 union all select -page_id - 1, null, damaged, 0 from d where id % 599 = 5),
b as (select page_id, coalesce(n, (select count(*) from r) - 1 + row_number() over (partition by n is null order by page_id, k)) as n, damaged as record from x),
s as (select *, n // 4096 as archive, strlen(record) as size, sum(strlen(record)) over (partition by n // 4096 order by n) as hi from r),
t as (select *, n // 4096 as archive, strlen(record) as size, sum(strlen(record)) over (partition by n // 4096 order by n) as hi from b)
select coalesce(s.page_id, t.page_id) as page_id, coalesce(s.archive, t.archive) as archive, coalesce(s.n, t.n) % 4096 as record_no, coalesce(s.hi - s.size, t.hi - t.size)::bigint as "offset", coalesce(s.size, t.size)::bigint as length, sha256(s.record) as primary_sha256, sha256(t.record) as replica_sha256,
case when t.n is null then 'missing in replica' when s.n is null then 'missing in primary' when s.size <> t.size then 'length' else 'content' end as damage from s full outer join t on s.n = t.n where s.record is distinct from t.record""",
}
