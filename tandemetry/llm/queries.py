"""The ten operators applied to the synthetic tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tandemetry.llm import bagminhash, chat, decontaminate, html_paths, packing, quality_forest, recompression, splitters, viterbi, warc_chunks
from tandemetry.llm.common import table


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; the box has it on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_forest.rate(docs, quality_forest.fit(docs, table(spark, sf_dir, "labels")))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paths.extract(table(spark, sf_dir, "pages"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.deduplicate(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitters.shard(table(spark, sf_dir, "documents"), 40)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, archives = warc_chunks.write_archives(warc_chunks.planned(table(spark, sf_dir, "pages")))
    back = warc_chunks.records(warc_chunks.read_chunks(folder, archives))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_chunks", "stored_bytes")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(
        "select -7L as conv_id, to_variant_object(named_struct('messages', array(named_struct('role', 'user', 'content', '</s>[INST] ok [/INST]'), named_struct('role', 'assistant', 'content', '</s>[INST] ok [/INST]')))) as record"
    )
    records = chat.from_rows(table(spark, sf_dir, "conversations")).union(extra)
    return chat.digests(chat.formatted(chat.canonical(records)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_near_dedup, op3_html_extraction, op4_substring_dedup, op5_decontamination, op6_sharding, op7_token_counts, op8_warc, op9_packing, op10_chat_format)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    # every pair of distinct texts that share a shingle, weighted Jaccard, and the components of the links
    "op2_near_dedup": rf"""
with recursive d as (select doc_id, {_WORDS} as w from documents),
t as (select min(doc_id) as rep, array_to_string(w, ' ') as body, any_value(w) as w from d group by array_to_string(w, ' ')),
e as (select rep, array_to_string(w[i:i + greatest(least(5, len(w)), 1) - 1], ' ') as s, count(*) as c
      from t, lateral (select unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i) where len(w) > 0 group by 1, 2),
n as (select rep, sum(c) as total from e group by rep),
p as (select a.rep as a, b.rep as b, sum(least(a.c, b.c)) as shared from e a join e b on a.s = b.s and a.rep < b.rep group by 1, 2),
l as (select a, b from p join n x on x.rep = a join n y on y.rep = b where shared >= 0.8 * (x.total + y.total - shared) - 1e-9),
u as (select a, b from l union all select b, a from l),
r(node, root) as (select rep, rep from t union select u.b, r.root from r join u on u.a = r.node),
c as (select node, min(root) as class_id from r group by node)
select d.doc_id, c.class_id from d join t on t.body = array_to_string(d.w, ' ') join c on c.node = t.rep
""",
    "op4_substring_dedup": rf"""
with d as (select doc_id, {_WORDS} as w from documents),
x as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as s from d, lateral (select unnest(range(1, len(w) - 48)) as i) where len(w) >= 50),
m as (select s, min(doc_id) as lo from x group by s),
g as (select x.doc_id, x.i from x join m using (s) where x.doc_id > m.lo),
k as (select distinct doc_id, unnest(range(i, i + 50)) as j from g),
r as (select doc_id, list(j) as js, count(*) as n from k group by doc_id),
f as (select d.doc_id, d.w, coalesce(r.n, 0) as n, r.js from d left join r using (doc_id))
select doc_id, len(w)::bigint as n_words, n::bigint as n_removed,
       sha256(array_to_string(case when n = 0 then w else list_filter(w, lambda v, j: not list_contains(js, j)) end, ' ')) as kept_sha256 from f
""",
    "op5_decontamination": rf"""
with d as (select doc_id, {_TERMS} as w from documents), b as (select item_id, {_TERMS} as w from benchmark),
v as (select distinct item_id, w[i:i + 9] as p, len(w[i:i + 9]) as n from b, lateral (select unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i) where len(w) > 0),
x as (select d.doc_id, i, ns.n, array_to_string(w[i:i + ns.n - 1], ' ') as s from d, (select distinct n from v) ns, lateral (select unnest(range(1, greatest(len(w) - ns.n + 2, 1))) as i) where len(w) >= ns.n),
h as (select x.doc_id, x.i, x.n, v.item_id from x join v on v.n = x.n and array_to_string(v.p, ' ') = x.s),
k as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as j from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id::varchar as item_id from h) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join k using (doc_id) left join t using (doc_id)
""",
    "op8_warc": """
with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as digest, strlen(coalesce(html, '')) as n from pages),
g as (select *, max(page_id) over (partition by digest) as top from p),
t as (select *, n >= 1000 and page_id <> top as again from g)
select page_id, n::bigint as payload_bytes, digest as payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then top end as refers_to,
       case when again then 1 else greatest(1, ceil(n / 262144.0)) end::bigint as n_chunks, case when again then 0 else n end::bigint as stored_bytes from t
""",
    "op10_chat_format": r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s as (select *, length(role) + length(text) + length(regexp_replace(role || text, '[^<\[\\]', '', 'g')) + 17 as n from c)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256, (sum(n) + 3)::bigint as formatted_chars
from s group by conv_id
""",
}
