"""Queries of split isolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import hashing
from gridloom.operators import isolate, nested
from gridloom.session import cut
from gridloom.sources.tables import table


def _sigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolate.signature_rows(table(spark, sf_dir, "table_signatures"), nested.latest)


def exact_cross_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolate.exact_overlaps(_sigs(spark, sf_dir))


def family_cross_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolate.family_overlaps(_sigs(spark, sf_dir))


def dup_member_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolate.duplicate_members(_sigs(spark, sf_dir))


def near_cross_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolate.near_overlaps(_sigs(spark, sf_dir))


def isolation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolate.audit(cut(_sigs(spark, sf_dir)))


def duplicate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over table, image and pixel digests."""
    return isolate.duplicate_components(cut(_sigs(spark, sf_dir)), isolate.HARD_SIGNALS)


def duplicate_components_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over all six digests."""
    return isolate.duplicate_components(cut(_sigs(spark, sf_dir)))


def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = nested.latest(table(spark, sf_dir, "table_records"), "sample_id", "revised_at", ["category", "role"])
    return isolate.role_counts(last.select("category", isolate.role_name(F.col("role")).alias("role")), "category", "role")


def pair_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = nested.latest(table(spark, sf_dir, "table_records"), "sample_id", "revised_at", ["identity", "role", "gold"])
    return isolate.pair_completeness(last.select("sample_id", F.col("identity.counterfactual_pair_id").alias("pair_id"), isolate.role_name(F.col("role")).alias("role"), F.col("gold.semantic_state_sha256").alias("gold_sha")))


def signature_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest over each sample's signals."""
    return _sigs(spark, sf_dir).select("sample_id", hashing.row_sha256(*[F.col(s) for s in isolate.SIGNALS]).alias("signature_sha256"))


QUERIES = {q.__name__: q for q in (exact_cross_role, family_cross_role, dup_member_stats, near_cross_role, isolation_audit, duplicate_components, duplicate_components_all, role_counts, pair_completeness, signature_digest)}

_D = "case when regexp_matches(regexp_replace(lower(trim(t.{0}, E' \\t\\n\\r')), '^(sha256:|0x)', ''), '[^0]') then regexp_replace(lower(trim(t.{0}, E' \\t\\n\\r')), '^(sha256:|0x)', '') end as {0}"
_SIGS = (
    "with recursive latest as (select sample_id, max_by(t, registered_at) as t from table_signatures t where sample_id is not null group by sample_id), s as (select sample_id, lower(trim(t.role, E' \\t\\n\\r')) as role, t.families as families, "
    + ", ".join(_D.format(c) for c in ("perceptual_hash", *isolate.SIGNALS))
    + " from latest), long as ("
    + " union all ".join(f"select sample_id, role, '{c}' as signal, {c} as value from s where {c} is not null" for c in isolate.SIGNALS)
    + ")"
)
_FAMILY = _SIGS + ", f as (select role, unnest(map_keys(families)) as signal, unnest(map_values(families)) as value from s)"
_EXACT = "select signal, value, string_agg(distinct role, ',' order by role) as roles, array_to_string(list_sort(list(distinct sample_id))[:8], ',') as sample_ids from long where signal in ('image_sha256', 'pixel_sha256', 'table_sha256') group by all having count(distinct role) > 1"
_NEAR = """select a.sample_id as first, b.sample_id as second, bit_count(xor(('0x' || a.perceptual_hash)::ubigint, ('0x' || b.perceptual_hash)::ubigint)) as distance,
  coalesce(a.text_sha256 = b.text_sha256, false) as text_same, coalesce(a.structure_sha256 = b.structure_sha256 and a.geometry_sha256 = b.geometry_sha256, false) as grid_same
from s a join s b on a.sample_id < b.sample_id and a.role <> b.role and (a.text_sha256 = b.text_sha256 or (a.structure_sha256 = b.structure_sha256 and a.geometry_sha256 = b.geometry_sha256))
where bit_count(xor(('0x' || a.perceptual_hash)::ubigint, ('0x' || b.perceptual_hash)::ubigint)) <= 2"""
_FAM = "select signal, value, string_agg(distinct role, ',' order by role) as roles from f where value is not null group by all having count(distinct role) > 1"
_ROLES = "with latest as (select sample_id, max_by(t, revised_at) as t from table_records t where sample_id is not null group by sample_id), r as (select t.category as category, lower(trim(t.role, E' \\t\\n\\r')) as role, t.identity.counterfactual_pair_id as pair_id, t.gold.semantic_state_sha256 as g from latest)"

SQL = {
    "exact_cross_role": _SIGS + _EXACT,
    "family_cross_role": _FAMILY + _FAM,
    "dup_member_stats": _SIGS + "select signal, coalesce(sum(n) filter (n > 1), 0)::bigint as n_members from (select signal, value, count(*) as n from long group by all) group by signal",
    "near_cross_role": _SIGS + _NEAR,
    "isolation_audit": _FAMILY + f", e as ({_EXACT}), fo as ({_FAM}), n as ({_NEAR}), c as (select (select count(*) from s) as n_signatures, (select count(*) from e) as n_exact, (select count(*) from fo) as n_family, (select count(*) from n) as n_near) select *, case when n_exact + n_family + n_near = 0 then 'PASS' else 'FAIL' end as status from c",
    "duplicate_components": _SIGS + """, h as (select sample_id, signal || value as v from long where signal in ('image_sha256', 'pixel_sha256', 'table_sha256')),
edges as (select distinct h.sample_id as a, m.hub as b from h join (select v, min(sample_id) as hub from h group by v having count(*) > 1) m using (v)),
undirected as (select a, b from edges union select b, a from edges),
reach as (select sample_id as x, sample_id as y from s union select r.x, u.b from reach r join undirected u on u.a = r.y),
least_ as (select x as sample_id, min(y) as component from reach group by x)
select sample_id, component, count(*) over (partition by component) as component_size from least_""",
    "duplicate_components_all": _SIGS + """, h as (select sample_id, signal || value as v from long),
edges as (select distinct h.sample_id as a, m.hub as b from h join (select v, min(sample_id) as hub from h group by v having count(*) > 1) m using (v)),
undirected as (select a, b from edges union select b, a from edges),
reach as (select sample_id as x, sample_id as y from s union select r.x, u.b from reach r join undirected u on u.a = r.y),
least_ as (select x as sample_id, min(y) as component from reach group by x)
select sample_id, component, count(*) over (partition by component) as component_size from least_""",
    "role_counts": _ROLES + "select category, role, grouping(category, role)::int as level, count(*) as n from r group by grouping sets ((category), (role), (category, role), ())",
    "pair_completeness": _ROLES + "select pair_id, count(*) as n, count(*) = 2 and count(distinct role) = 1 and count(distinct g) = 1 as complete from r where pair_id is not null group by pair_id",
    "signature_digest": _SIGS + "select sample_id, sha256(" + " || ';' || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in isolate.SIGNALS) + ") as signature_sha256 from s",
}
