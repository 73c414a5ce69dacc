"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import nested, schema_drift
from gridloom.operators.orphans import Orphans, parents_of, references_of, track_orphans
from gridloom.session import cut
from gridloom.sources.tables import table


def _drift(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = table(spark, sf_dir, "release_files")
    parsed = cut(schema_drift.read_lines(files, table(spark, sf_dir, "release_lines")))
    return files, parsed, schema_drift.changes(files, parsed)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir)[2].select("file_id", "change_kind", "old_path", "new_path")


def p1_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counted records as one table."""
    files, parsed, changed = _drift(spark, sf_dir)
    return schema_drift.unify(files, parsed, cut(changed))


def p1_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column to which each path of each file belongs: the compiled projections."""
    files, parsed, changed = _drift(spark, sf_dir)
    return schema_drift.lineages(files, cut(changed), parsed)


def p1_unified_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of the one table, in long form; numbers as JSON states them."""
    files, parsed, changed = _drift(spark, sf_dir)
    cells = schema_drift.unified_cells(files, parsed, cut(changed))
    return cells.withColumn("value", F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v"), "value"))


DOC = ["sample_id", "table_state"]


def _nodes(spark: SparkSession, sf_dir: str, items: tuple[str, ...] | None = None) -> DataFrame:
    return nested.shred(nested.states(table(spark, sf_dir, "table_records")), DOC, "doc", items=items)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = nested.states(table(spark, sf_dir, "table_records"), links_only=True)
    return nested.document_links(docs, DOC, "doc")


def p2_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat cells of both states; ``parent`` is the label of the object around the cell, ``attrs`` its scalar members as JSON."""
    return nested.cells(_nodes(spark, sf_dir, items=()), DOC).withColumn("attrs", F.to_json("attrs"))


def p2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat tokens of both states."""
    return nested.tokens(_nodes(spark, sf_dir, items=()), DOC).withColumn("attrs", F.to_json("attrs"))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of ``p2_found``, from the flat tables by joins on their labels and ids."""
    docs = nested.states(table(spark, sf_dir, "table_records"), links_only=True)
    nodes = cut(nested.shred(docs, DOC, "doc", keep=nested.LINKS, items=("token_ids",)))
    return nested.token_links(nodes, DOC)


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat records: the scalar members of each sample's latest revision."""
    cols = ["schema_release", "dataset_release", "role", "gate_label", "category", "phenomenon", "revised_at"]
    return nested.latest(table(spark, sf_dir, "table_records"), "sample_id", "revised_at", cols)


def p2_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat identities of the latest revisions, with the nested generative components spread out."""
    last = nested.latest(table(spark, sf_dir, "table_records"), "sample_id", "revised_at", ["identity"])
    parts, span = "identity.generative_components", "identity.generative_components.structure.span_profile"
    return last.select(
        "sample_id", "identity.generation_seed", "identity.document_cluster_id", "identity.source_family_id", "identity.template_family_id", "identity.content_family_id",
        "identity.renderer_family_id", "identity.font_family_id", "identity.counterfactual_pair_id", "identity.counterfactual_group_id", "identity.generative_family_key",
        F.col("identity.family_nonce").cast("string").alias("family_nonce"), F.col("identity.base_seed").cast("string").alias("base_seed"), f"{parts}.structure.rows", f"{parts}.structure.columns", f"{parts}.structure.header_depth",
        f"{span}.horizontal", f"{span}.vertical", f"{parts}.content.namespace", F.col(f"{parts}.content.phenomenon").alias("content_phenomenon"),
    )


def p2_node_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of flat tables: rows and attributes per schema path."""
    return nested.tables(_nodes(spark, sf_dir), DOC).withColumn("attrs", F.array_join("attrs", ","))


def _orphans(spark: SparkSession, sf_dir: str) -> Orphans:
    tokens = references_of(table(spark, sf_dir, "candidate_tokens"), "candidate_tokens", "candidate_id", "observed_at", "token_index", "arrived_at")
    cells = references_of(table(spark, sf_dir, "raw_cells"), "raw_cells", "cell_key", "built_at", "ocr_token_indexes")
    return track_orphans(parents_of(table(spark, sf_dir, "table_manifest")), tokens.unionByName(cells))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).orphans.select("ref_table", "ref_id", "ref_field", "token_index", "orphan_state")


def p5_orphans_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per referring table, month of use, field and state."""
    return _orphans(spark, sf_dir).orphans.groupBy("ref_table", F.date_format("used", "yyyy-MM").alias("month"), "ref_field", "orphan_state").agg(F.count("*").alias("n_orphans"))


def p5_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references known at the end of each month, per table and month of use; ``pending`` ones may still find their parent."""
    snaps = _orphans(spark, sf_dir).snapshots
    return snaps.select(F.date_format("until", "yyyy-MM").alias("known_month"), "ref_table", F.date_format("period", "yyyy-MM").alias("used_month"), "orphan_state", "n")


_P5_SQL = r"""
with parents as (
  select lower(trim(sample_id, E' \t\n\r')) as key, registered_at as reg, withdrawn_at as gone, coalesce(len(ocr_tokens), 0) as n
  from table_manifest where sample_id is not null and registered_at is not null
), one as (
  select key, reg, max_by(struct_pack(gone := gone, n := n), struct_pack(g := coalesce(gone, timestamp '9999-12-31'), n := n)) as v
  from parents group by key, reg
), refs as (
  select distinct 'candidate_tokens' as ref_table, candidate_id as ref_id, 'token_index' as f, lower(trim(sample_id, E' \t\n\r')) as key,
    coalesce(observed_at, timestamp '9999-12-31') as used, [token_index] as idxs
  from candidate_tokens where sample_id is not null
  union
  select distinct 'raw_cells', cell_key, 'ocr_token_indexes', lower(trim(sample_id, E' \t\n\r')), coalesce(built_at, timestamp '9999-12-31'), coalesce(ocr_token_indexes, [])
  from raw_cells where sample_id is not null
), probed as (
  select r.*, o.v, o.reg, k.key is not null as known
  from refs r asof left join one o on r.key = o.key and r.used >= o.reg
  left join (select distinct key from one) k on k.key = r.key
), orphans as (
  select ref_table, ref_id, 'sample_id' as ref_field, -1 as token_index,
    case when not known then 'missing' when reg is null then 'later' else 'deleted' end as orphan_state, used
  from probed where reg is null or v.gone <= used
  union
  select ref_table, ref_id, f, i, 'missing', used
  from (select ref_table, ref_id, f, used, v, unnest(idxs) as i from probed where reg is not null and (v.gone is null or v.gone > used))
  where i is not null and (i < 0 or i >= v.n)
)
"""

_P5_SNAPSHOTS_SQL = r"""
with one as (
  select lower(trim(sample_id, E' \t\n\r')) as key, registered_at as reg, max(struct_pack(g := coalesce(withdrawn_at, timestamp '9999-12-31'), n := coalesce(len(ocr_tokens), 0))) as v
  from table_manifest where sample_id is not null and registered_at is not null group by all
), refs as (
  select distinct 'candidate_tokens' as ref_table, candidate_id as id, lower(trim(sample_id, E' \t\n\r')) as key, observed_at as used, coalesce(arrived_at, observed_at) as came, [token_index] as idxs from candidate_tokens where sample_id is not null
  union
  select distinct 'raw_cells', cell_key, lower(trim(sample_id, E' \t\n\r')), built_at, built_at, coalesce(ocr_token_indexes, []) from raw_cells where sample_id is not null
), months as (
  select distinct date_trunc('month', t) as m from (select came as t from refs union all select reg from one union all select v.g from one where v.g < timestamp '9999-01-01')
), firsts as (select key, min(date_trunc('month', reg)) as m from one group by key),
judged as (
  select r.*, f.m as first_m, o.reg, o.v, case when o.reg is null then 'later' when o.v.g <= r.used then 'deleted' when len(list_filter(idxs, lambda i: i is not null and (i < 0 or i >= o.v.n))) > 0 then 'lacking' else 'ok' end as final
  from refs r asof left join one o on r.key = o.key and r.used >= o.reg left join firsts f on f.key = r.key
), known as (
  select m.m, j.ref_table, date_trunc('month', j.used) as p, case when first_m is null or first_m > m.m then 'pending' else final end as state from judged j join months m on date_trunc('month', j.came) <= m.m
)
select strftime(m, '%Y-%m') as known_month, ref_table, strftime(p, '%Y-%m') as used_month, state as orphan_state, count(*) as n from known where state <> 'ok' group by all
"""

_P1_CTE = r"""
with recursive files as (
  select distinct file_id, stream_id, trim(schema_release) as release, written_at,
    case when regexp_matches(schema_release, '\d{4}\.\d\d\.\d\d\.\d+\s*$')
      then regexp_extract(schema_release, '(\d{4})\.(\d\d)\.(\d\d)\.\d+\s*$', 1) || regexp_extract(schema_release, '\d{4}\.(\d\d)\.\d\d\.\d+\s*$', 1)
        || regexp_extract(schema_release, '\d{4}\.\d\d\.(\d\d)\.\d+\s*$', 1) || lpad(regexp_extract(schema_release, '\.(\d+)\s*$', 1), 2, '0') end as number
  from release_files
), docs as (
  select l.file_id, l.line_id, f.release, f.number, case when json_valid(l.body) then l.body::json end as doc from release_lines l join files f using (file_id)
), leaf as (
  select d.file_id, d.line_id, replace(substr(n.fullkey, 3), '"', '') as path, n.type, n.value::varchar as value,
    trim(json_extract_string(n.value, '$')) in (d.release, d.number) as states
  from (select * from docs where json_type(doc) = 'OBJECT') d, lateral (select * from json_tree(d.doc)) n
  where n.type not in ('OBJECT', 'NULL') and not contains(n.fullkey, '[')
), kept as (
  select * from leaf where (file_id, line_id) in (select (file_id, line_id) from leaf where states)
), schema as (
  select file_id, path, list_sort(list(distinct case type when 'VARCHAR' then 'string' when 'DOUBLE' then 'number' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' else 'integer' end)) as types, bool_or(states) as states
  from kept group by all
), pairs as (
  select * from (select file_id, lag(file_id) over (partition by stream_id order by written_at, file_id) as prev_id from files) where prev_id is not null
), old as (select p.file_id, p.prev_id, s.path, s.types, s.states from pairs p join schema s on s.file_id = p.prev_id),
new as (select p.file_id, p.prev_id, s.path, s.types, s.states from pairs p join schema s on s.file_id = p.file_id),
gone as (select * from old where (file_id, path) not in (select (file_id, path) from new)),
came as (select * from new where (file_id, path) not in (select (file_id, path) from old)),
samples as (select distinct file_id, value as sample from kept where path = 'sample_id'),
shared as (select p.file_id, p.prev_id, a.sample from pairs p join samples a on a.file_id = p.file_id join samples b on b.file_id = p.prev_id and a.sample = b.sample),
cells as (select k.file_id, k.path, k.value, s.value as sample from kept k join kept s on s.line_id = k.line_id and s.file_id = k.file_id and s.path = 'sample_id'),
gone_values as (
  select g.file_id, g.path, list_sort(list(distinct h.sample || h.value)) as held from gone g join shared s on s.file_id = g.file_id join cells h on h.file_id = s.prev_id and h.sample = s.sample and h.path = g.path group by all
), came_values as (
  select g.file_id, g.path, list_sort(list(distinct h.sample || h.value)) as held from came g join shared s on s.file_id = g.file_id join cells h on h.file_id = s.file_id and h.sample = s.sample and h.path = g.path group by all
), renamed as (
  select g.file_id, g.path as old_path, c.path as new_path from gone_values g join came_values c on c.file_id = g.file_id and c.held = g.held
  union
  select g.file_id, g.path, c.path from gone g join came c using (file_id) where g.states and c.states
)
"""

_P1_SQL = _P1_CTE + r"""
select file_id, 'renamed' as change_kind, old_path, new_path from renamed
union all
select file_id, 'removed', path, '' from gone where (file_id, path) not in (select (file_id, old_path) from renamed)
union all
select file_id, 'added', '', path from came where (file_id, path) not in (select (file_id, new_path) from renamed)
union all
select o.file_id, 'retyped', o.path, o.path from old o join new n on n.file_id = o.file_id and n.path = o.path where n.types <> o.types
"""

# Names of one column: those that renames connect, in any stream.
_P1_COLUMNS = r""", edges as (select old_path as a, new_path as b from renamed union select new_path, old_path from renamed),
reach as (select path as a, path as b from (select distinct path from schema) union select r.a, e.b from reach r join edges e on e.a = r.b),
counts as (select path, count(*) as n from schema group by path),
names as (select r.a as path, arg_max(r.b, struct_pack(n := c.n, order_ := -c.place)) as "column" from reach r join (select *, row_number() over (order by path) as place from counts) c on c.path = r.b group by r.a)
"""

_LATEST_SQL = """
latest as (
  select sample_id, max_by(t, revised_at) as t from table_records t where sample_id is not null group by sample_id
)
"""

_P2_SQL = "with " + _LATEST_SQL + r""", docs as (
  select sample_id, 'gold' as table_state, to_json(t.gold) as doc from latest
  union all
  select sample_id, 'prior', case when json_valid(t.prior_json) then t.prior_json::json end from latest
), nodes as (
  select d.sample_id, d.table_state, n.id, n.parent, n.key, n.type, n.value, n.atom
  from docs d, lateral (select * from json_tree(d.doc)) n
), objects as (
  select o.sample_id, o.table_state, o.id, o.parent, p.key as collection, p.type as collection_type,
    coalesce(json_extract_string(o.value, '$.token_id'), case when p.key = 'tokens' and p.type = 'OBJECT' then o.key end) as token_id,
    json_extract_string(o.value, '$.cell_id') as cell_id, json_extract_string(o.value, '$.owner_cell_id') as owner, p.parent as above
  from nodes o left join nodes p on p.sample_id = o.sample_id and p.table_state = o.table_state and p.id = o.parent
  where o.type = 'OBJECT'
), t as (select * from objects where token_id is not null), c as (select * from objects where cell_id is not null and token_id is null),
listed as (
  select i.sample_id, i.table_state, json_extract_string(i.value, '$') as token_id, a.parent as cell
  from nodes i join nodes a on a.sample_id = i.sample_id and a.table_state = i.table_state and a.id = i.parent and a.key = 'token_ids'
  where i.type not in ('OBJECT', 'ARRAY', 'NULL')
)
select c.sample_id, c.table_state, c.cell_id, l.token_id from c join listed l on l.sample_id = c.sample_id and l.table_state = c.table_state and l.cell = c.id
  semi join t on t.sample_id = c.sample_id and t.table_state = c.table_state and t.token_id = l.token_id
union
select c.sample_id, c.table_state, c.cell_id, t.token_id from c join t on t.sample_id = c.sample_id and t.table_state = c.table_state and (t.above = c.id or t.owner = c.cell_id)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_unified": p1_unified,
    "p1_lineages": p1_lineages,
    "p1_unified_cells": p1_unified_cells,
    "p2_found": p2_found,
    "p2_cells": p2_cells,
    "p2_tokens": p2_tokens,
    "p2_links": p2_links,
    "p2_records": p2_records,
    "p2_identities": p2_identities,
    "p2_node_tables": p2_node_tables,
    "p5_found": p5_found,
    "p5_orphans_by_month": p5_orphans_by_month,
    "p5_snapshots": p5_snapshots,
}

SQL = {
    "p1_found": _P1_SQL,
    "p1_lineages": _P1_CTE + _P1_COLUMNS + 'select file_id, path, "column" from schema join names using (path)',
    "p1_unified_cells": _P1_CTE + _P1_COLUMNS + """select file_id, line_id, "column", json_extract_string(value::json, '$') as value from kept join names using (path)""",
    "p2_found": _P2_SQL,
    "p2_links": _P2_SQL,
    "p2_identities": "with " + _LATEST_SQL + """select sample_id, i.generation_seed, i.document_cluster_id, i.source_family_id, i.template_family_id, i.content_family_id, i.renderer_family_id, i.font_family_id,
  i.counterfactual_pair_id, i.counterfactual_group_id, i.generative_family_key, i.family_nonce::varchar as family_nonce, i.base_seed::varchar as base_seed, i.generative_components.structure."rows" as "rows", i.generative_components.structure."columns" as "columns",
  i.generative_components.structure.header_depth as header_depth, i.generative_components.structure.span_profile.horizontal as horizontal, i.generative_components.structure.span_profile.vertical as vertical,
  i.generative_components.content.namespace as namespace, i.generative_components.content.phenomenon as content_phenomenon from (select sample_id, t.identity as i from latest)""",
    "p2_records": "with " + _LATEST_SQL + "select sample_id, t.schema_release, t.dataset_release, t.role, t.gate_label, t.category, t.phenomenon, t.revised_at from latest",
    "p5_found": _P5_SQL + "select ref_table, ref_id, ref_field, token_index, orphan_state from orphans",
    "p5_snapshots": _P5_SNAPSHOTS_SQL,
    "p5_orphans_by_month": _P5_SQL + "select ref_table, strftime(used, '%Y-%m') as month, ref_field, orphan_state, count(*) as n_orphans from orphans group by all",
}
