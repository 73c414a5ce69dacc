"""The SQL of this subpackage's queries, where SQL can express them."""

_P3 = r"""
with latest as (
  select sample_id, max_by(t, registered_at) as t from table_signatures t where sample_id is not null group by sample_id
), cleaned as (
  select sample_id, t.source_id as source_id, regexp_replace(lower(t.role), '[^a-z]', '', 'g') as r,
    nullif(regexp_extract(lower(trim(t.table_sha256, E' \t\n\r')), '^(?:sha256:|0x)?0*([1-9a-f][0-9a-f]*)$', 1), '') as tk,
    nullif(regexp_extract(lower(trim(t.structure_sha256, E' \t\n\r')), '^(?:sha256:|0x)?0*([1-9a-f][0-9a-f]*)$', 1), '') as st,
    nullif(regexp_extract(lower(trim(t.perceptual_hash, E' \t\n\r')), '^(?:sha256:|0x)?0*([1-9a-f][0-9a-f]*)$', 1), '') as ph
  from latest
), s as (
  select sample_id, source_id, tk, st, case when length(ph) <= 16 then ('0x' || ph)::ubigint end as bits,
    case when r in ('train', 'training') then 'train' when r in ('development', 'dev', 'validation', 'val') then 'development' when r in ('holdout', 'test') then 'holdout' end as role
  from cleaned
), pairs as (
  select a.sample_id as x, b.sample_id as y, b.role, b.source_id, 'exact' as overlap_kind from s a join s b on a.tk = b.tk where a.role = 'train' and b.role <> 'train'
  union all
  select a.sample_id, b.sample_id, b.role, b.source_id, 'near' from s a join s b on a.st = b.st
  where a.role = 'train' and b.role <> 'train' and bit_count(xor(a.bits, b.bits)) <= 3 and a.tk is distinct from b.tk
  union all
  select a.sample_id, b.sample_id, b.role, b.source_id, 'near' from s a join s b on a.st = b.st
  where a.role = 'train' and b.role <> 'train' and bit_count(xor(a.bits, b.bits)) <= 3 and a.tk is null and b.tk is null
)
"""

_P4 = r"""
with recursive latest as (
  select sample_id, max_by(t.identity, revised_at) as i from table_records t where sample_id is not null group by sample_id
), keys as (
  select sample_id as s, f, lower(trim(k, E' \t\n\r')) as k from (
    select sample_id, 1 as f, i.document_cluster_id as k from latest
    union all select sample_id, 2, i.counterfactual_pair_id from latest
    union all select sample_id, 3, i.generative_family_key from latest
  ) where k is not null
), links as (
  select s, f, k from keys where regexp_replace(k, '^(document-|pair-)', '') not in ('', 'n/a', 'none', 'unknown')
    and k not in ('', 'n/a', 'none', 'unknown') and not regexp_matches(regexp_replace(k, '^(document-|pair-)', ''), '^0+$')
), edges as (
  select distinct l.s as a, h.hub as b from links l join (select f, k, min(s) as hub from links group by all having count(distinct s) > 1) h using (f, k)
), undirected as (select a, b from edges union select b, a from edges),
reach as (
  select a as s, a as r from undirected
  union
  select e.a, x.r from reach x join undirected e on e.b = x.s
), groups as (select s, min(r) as root from reach group by s)
"""

# DuckDB has no compatibility forms: of these, full-width ones are folded, as the test texts hold hardly any others.
_WIDE, _NARROW = ("".join(chr(first + k) for k in range(94)) for first in (0xFF01, 0x21))
_P7 = r"""
with folded as (
  select kind, id, lang, lower(strip_accents(translate(regexp_replace(nfc_normalize(regexp_replace(t, '[\p{Cf}]+', '', 'g')), '[\p{M}\p{Cf}]+', '', 'g'), {wide}, {narrow}))) as t from (
    select kind, id, lang, regexp_replace(regexp_replace(text, '</?[A-Za-z][A-Za-z0-9]*\b[^<>]*>', '', 'g'), '[-‐‑' || chr(173) || '][ \t]*\r?\n\s*', '', 'g') as t
    from (select 'd' as kind, doc_id as id, lang, text from documents where text is not null union all select 'i', item_id, lang, text from eval_items where text is not null)
  )
), words as (select kind, id, lang, regexp_extract_all(t, '[\p{L}\p{N}]+') as w from folded),
grams as (select kind, id, array_to_string(w[i:i + 11], ' ') as g from (select kind, id, w, unnest(range(1, len(w) - 10)) as i from words where not (kind = 'i' and lower(lang[1:2]) in ('zh', 'ja')))),
chars as (select kind, id, array_to_string(w, '') as s from words where kind = 'd' or lower(lang[1:2]) in ('zh', 'ja')),
found as (
  select d.id as doc_id, i.id as item_id from grams d join (select * from grams where kind = 'i') i using (g) where d.kind = 'd'
  union
  select d.id, i.id from (select id, unnest(list_transform(range(1, length(s) - 22), lambda k: substr(s, k, 24))) as g from chars where kind = 'd' and length(s) >= 24 and regexp_matches(s, '[\p{Han}\p{Hiragana}\p{Katakana}]')) d
  join (select id, unnest(list_transform(range(1, length(s) - 22), lambda k: substr(s, k, 24))) as g from chars where kind = 'i' and length(s) >= 24) i using (g)
)
""".replace("{wide}", f"'{_WIDE}'").replace("{narrow}", "'" + _NARROW.replace("'", "''") + "'")

SQL = {
    "p3_found": _P3 + "select least(x, y) as sample_a, greatest(x, y) as sample_b, overlap_kind from pairs",
    "p3_overlap_counts": _P3 + "select role, source_id, overlap_kind, count(*) as n_pairs, count(distinct y) as n_samples from pairs group by all",
    "p4_found": _P4 + "select root as group_first, s as sample_id from groups where s <> root",
    "p7_found": _P7 + "select doc_id, item_id from found",
    "p7_leaks_by_suite": _P7 + "select suite, e.lang as lang, count(distinct item_id) as n_items, count(distinct doc_id) as n_docs from found join eval_items e using (item_id) group by suite, e.lang",
}
