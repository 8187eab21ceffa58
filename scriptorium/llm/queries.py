"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm.alignment import piece_tokenizer, token_alignment
from scriptorium.llm.decontaminate import contamination
from scriptorium.llm.embedding_join import near_duplicates
from scriptorium.llm.infilling import fill_in_middle
from scriptorium.llm.langid import language_id
from scriptorium.llm.ngram_join import jaccard_components
from scriptorium.llm.ogg import ogg_texts
from scriptorium.llm.packing import pack
from scriptorium.llm.preferences import preferences
from scriptorium.llm.records import tokens_to_records
from scriptorium.llm.secrets import scan
from scriptorium.llm.tokens import default_tokenizer
from scriptorium.llm.toxicity import toxicity
from scriptorium.llm.warc import archive
from scriptorium.session import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_to_records(table(spark, sf_dir, "documents"), default_tokenizer(), end_id=0).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer(), end_id=2, capacity=1024)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_texts(table(spark, sf_dir, "documents"))


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences(table(spark, sf_dir, "conversations"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents"), default_tokenizer(), piece_tokenizer())


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_records": op2_token_records,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_secret_scan": op5_secret_scan,
    "op6_warc": op6_warc,
    "op7_decontamination": op7_decontamination,
    "op8_ogg_media": op8_ogg_media,
    "op9_preferences": op9_preferences,
    "op10_language_id": op10_language_id,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_token_alignment": op12_token_alignment,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}
#: Words of a text, and every run of ten words, against the windows of the items.
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard": r"""
with recursive d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, array_to_string(w[k:k + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as k from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * k >= 75 * (p.n + q.n - k)),
b as (select x, y from e union all select y, x from e),
r as (select doc_id as node, doc_id as root from d union select b.y, r.root from r join b on r.node = b.x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id
from d left join n on d.doc_id = n.doc_id join (select node, min(root) as component_id from r group by node) m on m.node = d.doc_id""",
    "op6_warc": """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as digest from pages),
f as (select digest, min(page_id) as first from p where n >= 100 group by digest)
select page_id, n as payload_bytes, p.digest as payload_digest, case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
  case when first = page_id then null else first end as refers_to
from p left join f on p.digest = f.digest""",
    "op9_preferences": """
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
c as (
  select conv_id, list(struct_pack(role := role, text := text) order by turn, role, text) as turns,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0) as written from t group by conv_id),
lead as (
  select turns[1] as head, arg_min(conv_id, (-written, conv_id)) as chosen_id, count(*) as n from c group by turns[1] having count(*) > 1),
ends as (
  select conv_id, turns, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) as last from c),
pairs as (
  select 'same_prompt' as made, l.chosen_id, r.conv_id as rejected_id, ch.turns as chosen, r.turns as rejected
  from c r join lead l on r.turns[1] = l.head join c ch on ch.conv_id = l.chosen_id where r.turns <> ch.turns
  union all
  select 'other_reply', a.conv_id, b.conv_id, a.turns[1:a.last], list_concat(a.turns[1:a.last - 1], [struct_pack(role := 'assistant', text := b.turns[b.last].text)])
  from ends a join ends b on b.conv_id = a.conv_id + 1 where a.last is not null and b.last is not null and a.turns[a.last].text <> b.turns[b.last].text),
cut as (
  select *, cast(coalesce(list_min(list_filter(range(1, 1 + least(len(chosen), len(rejected))), lambda i: chosen[i] <> rejected[i])) - 1, least(len(chosen), len(rejected))) as integer) as prompt_turns from pairs),
parts as (
  select *, chosen[prompt_turns + 1:] as cr, rejected[prompt_turns + 1:] as rr from cut)
select made, chosen_id, rejected_id, prompt_turns,
  array_to_string(list_transform(chosen[1:prompt_turns], lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), '') as prompt,
  array_to_string(list_transform(cr, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), '') as chosen_completion,
  array_to_string(list_transform(list_filter(range(1, len(cr) + 1), lambda i: cr[i].role = 'assistant'), lambda i:
    cast(list_sum(list_transform(cr[1:i], lambda x: length(x.role) + 5)) + coalesce(list_sum(list_transform(cr[1:i - 1], lambda x: length(x.text) + 8)), 0) as bigint) || ':' ||
    cast(list_sum(list_transform(cr[1:i], lambda x: length(x.role) + 5 + length(x.text) + 8)) as bigint)), ',') as chosen_mask,
  array_to_string(list_transform(rr, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), '') as rejected_completion,
  array_to_string(list_transform(list_filter(range(1, len(rr) + 1), lambda i: rr[i].role = 'assistant'), lambda i:
    cast(list_sum(list_transform(rr[1:i], lambda x: length(x.role) + 5)) + coalesce(list_sum(list_transform(rr[1:i - 1], lambda x: length(x.text) + 8)), 0) as bigint) || ':' ||
    cast(list_sum(list_transform(rr[1:i], lambda x: length(x.role) + 5 + length(x.text) + 8)) as bigint)), ',') as rejected_mask
from parts""",
    "op7_decontamination": r"""
with d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
i as (
  select cast(item_id as varchar) as item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
iw as (
  select distinct item, least(10, len(w)) as n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') as win
  from (select item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as k from i where len(w) > 0)),
sizes as (select distinct n from iw),
dw as (
  select doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, sizes where len(w) >= n)),
m as (select doc_id, k, dw.n, item from dw join iw on dw.n = iw.n and dw.win = iw.win),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from m) group by doc_id),
t as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as s from (select distinct doc_id, item from m) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  coalesce(t.s, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h on d.doc_id = h.doc_id left join t on d.doc_id = t.doc_id""",
    "op11_fill_in_middle": r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u,
    sha256('42:' || coalesce(cast(doc_id as varchar), '')) as s from documents),
h as (
  select doc_id, t, u, len(u) as n, ('0x' || s[1:8])::bigint % (len(u) + 1) as x, ('0x' || s[9:16])::bigint % (len(u) + 1) as y,
    ('0x' || s[17:24])::bigint % 100 as r, ('0x' || s[25:32])::bigint % 100 as o from d),
f as (
  select doc_id, t, n, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r >= 50 then 'plain' when o < 80 then 'spm' else 'psm' end as form,
    array_to_string(u[1:least(x, y)], '') as p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') as m, array_to_string(u[greatest(x, y) + 1:], '') as q from h)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'spm' then '<S>' || q || '<P>' || p || '<M>' || m else '<P>' || p || '<S>' || q || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from f""",
    "op13_embedding_near_dedup": """
with recursive v as (
  select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
u as (
  select *, label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0 as usable from v),
w as (select r, vec_id, label, e, sqrt(list_dot_product(e, e)) as norm from u where usable),
l as (
  select a.r as x, b.r as y from w a join w b on a.label = b.label and a.r <> b.r and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
n as (select x, count(*) as n_links from l group by x),
c as (select r as node, vec_id as root from u union select l.y, c.root from c join l on c.node = l.x),
m as (select node, min(root) as component_id from c group by node)
select vec_id, coalesce(n_links, 0) as n_links, component_id, coalesce(vec_id = component_id, false) as kept
from u left join n on n.x = u.r join m on m.node = u.r""",
}
