"""Queries of the grid algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.text import normalize_text
from gridloom.operators import grid
from gridloom.plans import views
from gridloom.sources.tables import table


def grid_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots, overlaps, holes and status of every table of raw cells."""
    return grid.validate_rows(views.raw_cell_rows(spark, sf_dir), "table_id").select("table_id", "n_cells", "n_slots", "n_negative", "n_overlaps", "n_holes", "status")


def gold_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation of the gold grids, with messages."""
    gold = views.gold_tables(spark, sf_dir).select("table_id", "gold")
    return grid.validate(gold, "gold").select("table_id", "n_cells", "n_slots", "n_overlaps", "n_holes", F.array_join("errors", "; ").alias("errors"), "status")


def table_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = views.gold_tables(spark, sf_dir)
    return gold.select("table_id", grid.n_rows(F.col("gold")).alias("n_rows"), grid.n_cols(F.col("gold")).alias("n_cols"))


def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = views.gold_tables(spark, sf_dir)
    return gold.select("table_id", F.posexplode("gold").alias("idx", "c")).select("table_id", "idx", "c.row", "c.col", "c.rowspan", "c.colspan", "c.text", "c.tag")


def occupied_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each slot of the gold grids with the last cell that holds it."""
    s = grid.slots(F.col("gold"))
    last = F.filter("s", lambda x, i: (i == F.size("s") - 1) | (F.get("s", i + 1)["row"] != x["row"]) | (F.get("s", i + 1)["col"] != x["col"]))
    return views.gold_tables(spark, sf_dir).select("table_id", s.alias("s")).select("table_id", F.inline_outer(last)).where("row is not null").withColumnRenamed("idx", "owner")


def _legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.is_legal(views.gold_tables(spark, sf_dir).select("table_id", "gold"), "gold").withColumn("owner", grid.owners(F.col("gold")))


def merge_right_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legal(spark, sf_dir).select("table_id", F.inline_outer(grid.merge_right(F.col("owner"), F.col("n_rows"), F.col("n_cols")))).where("row is not null")


def merge_down_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legal(spark, sf_dir).select("table_id", F.inline_outer(grid.merge_down(F.col("owner"), F.col("n_rows"), F.col("n_cols")))).where("row is not null")


def header_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legal(spark, sf_dir).select("table_id", F.inline_outer(grid.header_mask(F.col("gold"), F.col("owner"), F.col("n_cols")))).where("row is not null")


def cell_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = views.raw_and_gold(spark, sf_dir)
    return both.select("table_id", F.inline_outer(grid.difference(F.col("raw"), F.col("gold")))).where("row is not null")


def topology_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = views.raw_and_gold(spark, sf_dir)
    return both.select("table_id", grid.same_topology(F.col("raw"), F.col("gold")).alias("same_topology"))


def raw_gold_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = grid.raw_gold_diff(views.raw_and_gold(spark, sf_dir))
    return diff.select("table_id", F.size("raw").alias("raw_cells"), F.size("gold").alias("gold_cells"), "keep", "update", "removed", "added")


def classify_raw_to_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.classify(views.raw_and_gold(spark, sf_dir)).select("table_id", *grid.CLASSES)


def strict_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topology, normalised text and tag of every gold cell."""
    gold = views.gold_tables(spark, sf_dir).select("table_id", "gold").withColumn("t", grid.normalized_texts(F.col("gold")))
    return gold.select("table_id", F.posexplode(grid.strict_keys(F.col("gold"), F.col("t"))).alias("idx", "k")).select("table_id", "idx", "k.*")


def normalize_text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest of every document's text without white space, in NFKC."""
    docs = table(spark, sf_dir, "documents").select("doc_id", normalize_text(F.col("text")).alias("t"))
    return docs.select("doc_id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))


def structure_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = views.gold_tables(spark, sf_dir)
    return gold.select("table_id", F.sha2(grid.structure_text(F.col("rows"), F.col("columns"), F.col("gold")), 256).alias("structure_sha256"))


def semantic_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of structure and texts, without geometry and tokens."""
    gold = views.gold_tables(spark, sf_dir)
    return gold.select("table_id", F.sha2(grid.semantic_text(F.col("rows"), F.col("columns"), F.col("gold")), 256).alias("semantic_sha256"))


QUERIES = {
    q.__name__: q
    for q in (grid_validation_report, gold_validation, table_shape, canonical_order, occupied_slots, merge_right_mask, merge_down_mask, header_mask, cell_difference, topology_equality, raw_gold_diff, classify_raw_to_gold, strict_keys, structure_sha, semantic_sha)
} | {"normalize_text": normalize_text_documents}

_GOLD = "with " + views.GOLD
_SLOTS = _GOLD + """, shape as (
  select table_id, max("row" + rowspan) as n_rows, max(col + colspan) as n_cols, count(*) as n_cells from gold group by table_id
), slot as (
  select table_id, idx, tag, r, unnest(range(col, col + colspan)) as c from (select *, unnest(range("row", "row" + rowspan)) as r from gold)
), held as (select table_id, r, c, max(idx) as owner, count(*) as n from slot group by all),
legal as (
  select table_id, n_rows, n_cols from shape join (select table_id, count(*) as n_slots, max(n) as most, min(least(r, c)) as least_at from held group by table_id) using (table_id)
  where most = 1 and least_at >= 0 and n_slots = n_rows * n_cols
)
"""

SQL = {
    "grid_validation_report": r"""
with cells as (
  select lower(trim(sample_id, E' \t\n\r')) as table_id, row_start as r0, col_start as c0, greatest(1, row_end - row_start) as rs, greatest(1, col_end - col_start) as cs
  from (select distinct on (cell_key) * from raw_cells) where sample_id is not null
), per as (
  select table_id, count(*) as n_cells, max(r0 + rs) as n_rows, max(c0 + cs) as n_cols, count(*) filter (r0 < 0 or c0 < 0) as n_negative from cells group by table_id
), slot as (
  select table_id, r, unnest(range(c0, c0 + cs)) as c from (select *, unnest(range(r0, r0 + rs)) as r from cells)
), held as (select table_id, r, c, count(*) as n from slot group by all),
s as (select table_id, count(*) as n_slots, sum(n - 1)::bigint as n_overlaps, count(*) filter (r >= 0 and c >= 0) as inside from held group by table_id)
select table_id, n_cells, n_slots, n_negative, n_overlaps, greatest(n_rows * n_cols - inside, 0)::bigint as n_holes,
  case when n_negative + n_overlaps + greatest(n_rows * n_cols - inside, 0) = 0 then 'PASS' else 'FAIL' end as status
from per join s using (table_id)
""",
    "gold_validation": _SLOTS + """, over as (
  select table_id, idx, lag(idx) over (partition by table_id, r, c order by idx) as other, r, c from slot
), texts as (
  select table_id, 1 as kind, idx as a, r, c, 'cell[' || idx || '] overlaps cell[' || other || '] at (' || r || ', ' || c || ')' as m from over where other is not null
), sums as (
  select table_id, n_cells, n_rows * n_cols - inside as n_holes, n_slots, n_overlaps
  from shape join (select table_id, count(*) as n_slots, sum(n - 1)::bigint as n_overlaps, count(*) filter (r >= 0 and c >= 0) as inside from held group by table_id) using (table_id)
), messages as (
  select table_id, string_agg(m, '; ' order by kind, a, r, c) as errors from (
    select * from texts union all select table_id, 2, 0, 0, 0, 'grid has ' || n_holes || ' holes' from sums where n_holes > 0
  ) group by table_id
)
select l.table_id, coalesce(n_cells, 0) as n_cells, coalesce(n_slots, 0) as n_slots, coalesce(n_overlaps, 0) as n_overlaps, coalesce(n_holes, 0) as n_holes, coalesce(errors, '') as errors,
  case when errors is null then 'PASS' else 'FAIL' end as status
from (select table_id from latest where t.gold is not null) l left join sums using (table_id) left join messages using (table_id)
""",
    "table_shape": _GOLD + """select l.table_id, coalesce(max("row" + rowspan), 0) as n_rows, coalesce(max(col + colspan), 0) as n_cols
from (select table_id from latest where t.gold is not null) l left join gold using (table_id) group by l.table_id""",
    "canonical_order": _GOLD + 'select table_id, idx, "row", col, rowspan, colspan, text, tag from gold',
    "occupied_slots": _SLOTS + 'select table_id, r as "row", c as col, owner from held',
    "merge_right_mask": _SLOTS + 'select a.table_id, a.r as "row", a.c as col, (a.owner = b.owner)::int as same from held a join legal using (table_id) join held b on b.table_id = a.table_id and b.r = a.r and b.c = a.c + 1',
    "merge_down_mask": _SLOTS + 'select a.table_id, a.r as "row", a.c as col, (a.owner = b.owner)::int as same from held a join legal using (table_id) join held b on b.table_id = a.table_id and b.r = a.r + 1 and b.c = a.c',
    "header_mask": _SLOTS + "select s.table_id, r as \"row\", c as col, (tag = 'th')::int as header from slot s join legal using (table_id)",
    "cell_difference": views.BOTH + """select 'remove_prior_cell' as kind, * from (select distinct table_id, "row", col, rowspan, colspan from r except select table_id, "row", col, rowspan, colspan from g)
union all select 'add_gold_cell', * from (select distinct table_id, "row", col, rowspan, colspan from g except select table_id, "row", col, rowspan, colspan from r)""",
    "topology_equality": views.BOTH + """, diff as (
  (select table_id, "row", col, rowspan, colspan from r except select table_id, "row", col, rowspan, colspan from g)
  union all (select table_id, "row", col, rowspan, colspan from g except select table_id, "row", col, rowspan, colspan from r)
) select table_id, table_id not in (select table_id from diff) as same_topology from pairs""",
    "raw_gold_diff": views.BOTH + """, rl as (select * from r qualify row_number() over (partition by table_id, "row", col, rowspan, colspan order by idx desc) = 1),
gl as (select * from g qualify row_number() over (partition by table_id, "row", col, rowspan, colspan order by idx desc) = 1),
j as (
  select coalesce(a.table_id, b.table_id) as table_id, a.norm = b.norm and a.tag = b.tag as same, a.table_id is null as only_gold, b.table_id is null as only_raw
  from rl a full join gl b on a.table_id = b.table_id and a."row" = b."row" and a.col = b.col and a.rowspan = b.rowspan and a.colspan = b.colspan
)
select p.table_id, (select count(*) from r where r.table_id = p.table_id) as raw_cells, (select count(*) from g where g.table_id = p.table_id) as gold_cells,
  count(*) filter (same) as keep, count(*) filter (not same) as "update", count(*) filter (only_raw) as removed, count(*) filter (only_gold) as added
from pairs p left join j using (table_id) group by p.table_id""",
    "classify_raw_to_gold": views.BOTH + """, hits as (
  select a.table_id, a.idx as i, b.idx as j from r a join g b on a.table_id = b.table_id and a."row" < b."row" + b.rowspan and b."row" < a."row" + a.rowspan and a.col < b.col + b.colspan and b.col < a.col + a.colspan
), splits as (select distinct table_id from (select table_id, i from hits group by all having count(*) > 1)),
merges as (select distinct table_id from (select table_id, j from hits group by all having count(*) > 1)),
keys as (
  (select table_id, "row", col, rowspan, colspan, norm, tag from r except select table_id, "row", col, rowspan, colspan, norm, tag from g)
  union all (select table_id, "row", col, rowspan, colspan, norm, tag from g except select table_id, "row", col, rowspan, colspan, norm, tag from r)
), gl as (select * from g qualify row_number() over (partition by table_id, "row", col, rowspan, colspan order by idx desc) = 1),
headers as (
  select distinct a.table_id from r a join gl b on a.table_id = b.table_id and a."row" = b."row" and a.col = b.col and a.rowspan = b.rowspan and a.colspan = b.colspan where a.tag <> b.tag
), rs as (select table_id, max("row" + rowspan) as nr, max(col + colspan) as nc from r group by all),
gs as (select table_id, max("row" + rowspan) as nr, max(col + colspan) as nc, count(*) as n, bool_or(norm = '') as e, bool_or(rowspan > 1 or colspan > 1) as s from g group by all)
select p.table_id, p.table_id not in (select table_id from keys) as identity, rs.nr < coalesce(gs.nr, 0) as missing_row_separator, rs.nr > coalesce(gs.nr, 0) as extra_row_separator,
  rs.nc < coalesce(gs.nc, 0) as missing_column_separator, rs.nc > coalesce(gs.nc, 0) as extra_column_separator,
  p.table_id in (select table_id from splits) as split_needed, p.table_id in (select table_id from merges) as merge_needed,
  p.table_id in (select table_id from splits) and p.table_id in (select table_id from merges) as mixed_split_merge,
  coalesce(gs.e, false) as empty_cells, coalesce(gs.s, false) as spanning_cells, coalesce(gs.n, 0) > 50 as large_table, coalesce(gs.nr, 0) > 32 as long_table,
  p.table_id in (select table_id from headers) as header_change
from pairs p join rs using (table_id) left join gs using (table_id)""",
    "strict_keys": _GOLD + 'select table_id, idx, "row", col, rowspan, colspan, norm as text, tag from gold',
    "structure_sha": _GOLD + """select l.table_id, sha256(concat_ws('|', t.gold.rows, t.gold.columns, coalesce(s, ''))) as structure_sha256
from latest l left join (select table_id, string_agg(concat_ws(',', "row", col, rowspan, colspan, tag), ';' order by idx) as s from gold group by table_id) using (table_id) where t.gold is not null""",
    "semantic_sha": _GOLD + """select l.table_id, sha256(concat_ws('|', t.gold.rows, t.gold.columns, coalesce(s, ''), coalesce(x, ''))) as semantic_sha256
from latest l left join (select table_id, string_agg(concat_ws(',', "row", col, rowspan, colspan, tag), ';' order by idx) as s, string_agg(length(text) || ':' || text, ';' order by idx) as x from gold group by table_id) using (table_id) where t.gold is not null""",
}
