"""Queries of the supervision labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import grid, labels
from gridloom.plans import views

#: Extent of the images of gold tables, whose own size isn't stored.
WIDTH = HEIGHT = 1000.0


def _boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    legal = grid.is_legal(views.gold_tables(spark, sf_dir).select("table_id", "gold"), "gold")
    made = labels.add_boundaries(labels.add_boundaries(legal, "gold", "n_rows", "row", F.lit(HEIGHT), "rb"), "gold", "n_cols", "col", F.lit(WIDTH), "cb")
    axes = F.array(F.struct(F.lit("row").alias("axis"), F.col("rb").alias("b")), F.struct(F.lit("col").alias("axis"), F.col("cb").alias("b")))
    return made.select("table_id", F.inline(axes)).select("table_id", "axis", F.inline_outer("b"))


def boundary_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median cell edge at every boundary of every legal gold grid."""
    return _boundaries(spark, sf_dir).select("table_id", "axis", "index", F.round("median", 6).alias("median"), "reliable")


def boundary_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boundaries(spark, sf_dir).select("table_id", "axis", "index", F.round("position", 6).alias("position"), "source")


def ios_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a raw and a gold cell whose overlap over the smaller reaches the threshold."""
    both = views.raw_and_gold(spark, sf_dir)
    raw, gold = F.col("raw"), F.col("gold")
    boxes = both.select("table_id", labels.logical_boxes(raw, grid.n_rows(raw), grid.n_cols(raw)).alias("rb"), labels.logical_boxes(gold, grid.n_rows(gold), grid.n_cols(gold)).alias("gb"))
    pairs = F.flatten(F.transform("rb", lambda a, i: F.transform("gb", lambda b, j: F.struct(i.alias("raw_idx"), j.alias("gold_idx"), labels.intersection_over_smaller(a, b).alias("ios")))))
    return boxes.select("table_id", F.inline_outer(F.filter(pairs, lambda p: p["ios"] >= labels.ALIGNED))).where("ios is not null").withColumn("ios", F.round("ios", 6))


def residual_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment and the splits and updates of every raw cell."""
    return residual_cell_edits(spark, sf_dir).drop("merge_right", "merge_down", "keep_structure")


def residual_cell_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edits of every raw cell, with those of the merge trees."""
    cells = labels.residual_edits(views.raw_and_gold(spark, sf_dir)).select("table_id", F.inline_outer("raw_cells")).where("raw_index is not null")
    return cells.withColumn("matched", F.array_join(F.transform("matched", lambda x: x.cast("string")), ","))


def residual_merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.residual_edits(views.raw_and_gold(spark, sf_dir)).select("table_id", F.inline_outer("merge_edges")).where("gold_index is not null")


def residual_table_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.residual_edits(views.raw_and_gold(spark, sf_dir)).select("table_id", "table_action", "needs_structure_edit", "needs_text_edit", "needs_header_edit")


def token_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw cell in which each token of the manifest lies, as an anchor in its table's grid, or -1."""
    cells = views.raw_cell_rows(spark, sf_dir)
    tables = cells.groupBy("table_id").agg(grid.canonical_cells(F.collect_list(F.struct("row", "col", "rowspan", "colspan", "text", "tag", "bbox", F.lit(None).cast("double").alias("confidence")))).alias("cells"))
    joined = views.manifest(spark, sf_dir).select("table_id", "ocr_tokens").join(tables, "table_id")
    placed = labels.assign_tokens(joined.withColumn("n_cols", grid.n_cols(F.col("cells"))), "ocr_tokens", "cells", F.col("n_cols"), "anchors")
    return placed.select("table_id", F.posexplode("anchors").alias("token_index", "anchor"))


def structure_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label bundle of every legal gold grid, arrays as JSON."""
    gold = views.gold_tables(spark, sf_dir).select("table_id", "gold", F.col("tokens").alias("ocr_tokens"))
    made = labels.structure_labels(gold, F.lit(WIDTH), F.lit(HEIGHT))
    names = ["owner", "merge_right", "merge_down", "header", "row_boundaries", "column_boundaries", "row_separators", "column_separators", "missing_row_separators", "missing_column_separators", "pointer", "primitive_grid", "header_policy", "cell_crops", "cell_payload"]
    return made.select("table_id", "n_rows", "n_cols", *[F.to_json(n).alias(n) for n in names])


QUERIES = {q.__name__: q for q in (boundary_median, boundary_interpolated, ios_alignment, residual_flags, residual_cell_edits, residual_merge_edges, residual_table_action, token_assignment, structure_labels)}

_EDGES = "with " + views.GOLD + """, shape as (
  select table_id, max("row" + rowspan) as n_rows, max(col + colspan) as n_cols from gold group by table_id
), held as (
  select table_id, r, unnest(range(col, col + colspan)) as c from (select *, unnest(range("row", "row" + rowspan)) as r from gold)
), legal as (
  select table_id, n_rows, n_cols from shape join (select table_id, count(*) as n, count(distinct (r, c)) as d, min(least(r, c)) as m from held group by table_id) using (table_id)
  where n = d and m >= 0 and n = n_rows * n_cols
), boxed as (select * from gold join legal using (table_id) where len(bbox) >= 4),
edges as (
  select table_id, 'row' as axis, "row" as i, round_even(bbox[2], 6) / 1000.0 as p from boxed
  union all select table_id, 'row', "row" + rowspan, round_even(bbox[4], 6) / 1000.0 from boxed
  union all select table_id, 'col', col, round_even(bbox[1], 6) / 1000.0 from boxed
  union all select table_id, 'col', col + colspan, round_even(bbox[3], 6) / 1000.0 from boxed
), places as (
  select table_id, 'row' as axis, unnest(range(0, n_rows + 1)) as i, n_rows as n from legal
  union all select table_id, 'col', unnest(range(0, n_cols + 1)), n_cols from legal
), direct as (
  select table_id, axis, i, n, median(p) as v from places left join edges using (table_id, axis, i) group by all
)
"""

_BOXES = views.BOTH + """, rs as (select table_id, max("row" + rowspan) as nr, max(col + colspan) as nc from r group by all),
gs as (select table_id, max("row" + rowspan) as nr, max(col + colspan) as nc from g group by all),
rb as (select r.*, col / nc::double as x0, "row" / nr::double as y0, (col + colspan) / nc::double as x1, ("row" + rowspan) / nr::double as y1 from r join rs using (table_id)),
gb as (select g.*, col / nc::double as x0, "row" / nr::double as y0, (col + colspan) / nc::double as x1, ("row" + rowspan) / nr::double as y1 from g join gs using (table_id)),
over as (
  select a.table_id, a.idx as i, b.idx as j, a.norm as rn, b.norm as gn,
    greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))
      / greatest(1e-9, least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0))) as s,
    power((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2, 2) + power((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2, 2) as d
  from rb a join gb b using (table_id)
)"""

_ACTION = views.BOTH + """, gl as (select * from g qualify row_number() over (partition by table_id, "row", col, rowspan, colspan order by idx desc) = 1),
diff as (
  (select table_id, "row", col, rowspan, colspan from r except select table_id, "row", col, rowspan, colspan from g)
  union all (select table_id, "row", col, rowspan, colspan from g except select table_id, "row", col, rowspan, colspan from r)
), m as (
  select a.table_id, bool_or(a.norm <> b.norm) as t, bool_or(a.tag <> b.tag) as h
  from r a join gl b on a.table_id = b.table_id and a."row" = b."row" and a.col = b.col and a.rowspan = b.rowspan and a.colspan = b.colspan group by a.table_id
)
select table_id, case when e or t or h then 'EDIT' else 'KEEP' end as table_action, e as needs_structure_edit, t as needs_text_edit, h as needs_header_edit
from (select p.table_id, p.table_id in (select table_id from diff) as e, coalesce(m.t, false) as t, coalesce(m.h, false) as h from pairs p left join m using (table_id))
"""

SQL = {
    "boundary_median": _EDGES + 'select table_id, axis, i as "index", round(v, 6) as median, v is not null as reliable from direct',
    "boundary_interpolated": _EDGES + """, filled as (
  select *, last_value(case when v is not null then i end ignore nulls) over w as li, last_value(v ignore nulls) over w as lv,
    first_value(case when v is not null then i end ignore nulls) over u as ri, first_value(v ignore nulls) over u as rv
  from direct window w as (partition by table_id, axis order by i rows between unbounded preceding and current row), u as (partition by table_id, axis order by i rows between current row and unbounded following)
), values_ as (
  select *, case when lv is null and rv is null then i / n::double when lv is null then rv when rv is null or li = ri then lv
    else lv * (1 - (i - li) / (ri - li)::double) + rv * ((i - li) / (ri - li)::double) end as x from filled
), raised as (select *, max(x - i * 1e-5) over (partition by table_id, axis order by i) + i * 1e-5 as y from values_)
select table_id, axis, i as "index", round(case when i = n then 1.0 when i = 0 then 0.0 else least(1.0, greatest(0.0, y)) end, 6) as position,
  case when i in (0, n) then 'crop_boundary_completion' when v is not null then 'physical_bbox' else 'logical_interpolated' end as source from raised""",
    "ios_alignment": _BOXES + "select table_id, i as raw_idx, j as gold_idx, round(s, 6) as ios from over where s >= 0.55",
    "residual_table_action": _ACTION,
    "token_assignment": r"""
with cells as (
  select lower(trim(sample_id, E' \t\n\r')) as table_id, row_start as r0, col_start as c0, greatest(1, row_end - row_start) as rs, greatest(1, col_end - col_start) as cs,
    trim(coalesce(text, '')) as text, case when lower(tag) = 'th' then 'th' else 'td' end as tag, geometry.bbox as b
  from (select distinct on (cell_key) * from raw_cells) where sample_id is not null
), ordered as (
  select *, row_number() over (partition by table_id order by r0, c0, rs, cs, text, tag, b nulls first) as idx, max(c0 + cs) over (partition by table_id) as n_cols from cells
), m as (
  select table_id, i - 1 as token_index, x.bbox as t from (
    select lower(trim(sample_id, E' \t\n\r')) as table_id, max_by(ocr_tokens, registered_at) as o from table_manifest where sample_id is not null group by 1
  ), lateral (select unnest(o) as x, generate_subscripts(o, 1) as i)
), k as (select *, case when len(b) >= 4 then b else [0.0, 0.0, 0.0, 0.0] end as bb from ordered),
scored as (
  select m.table_id, m.token_index, k.idx, k.r0 * k.n_cols + k.c0 as anchor,
    greatest(0, least(t[3], bb[3]) - greatest(t[1], bb[1])) * greatest(0, least(t[4], bb[4]) - greatest(t[2], bb[2]))
      + case when bb[1] <= (t[1] + t[3]) / 2 and (t[1] + t[3]) / 2 <= bb[3] and bb[2] <= (t[2] + t[4]) / 2 and (t[2] + t[4]) / 2 <= bb[4] then 1e12 else 0 end as s
  from m join k using (table_id)
)
select table_id, token_index, coalesce(arg_max(anchor, (s, -idx)) filter (s > 0), -1) as anchor from scored group by all
""",
}
SQL["residual_flags"] = _BOXES + """, aligned as (select table_id, i, j from over where s >= 0.55),
lone as (select table_id, idx as i from r where (table_id, idx) not in (select (table_id, i) from aligned)),
by_text as (select table_id, i, arg_max(j, (s, -j)) as j from over semi join lone using (table_id, i) where rn <> '' and rn = gn group by all),
by_any as (select table_id, i, arg_max(j, (s, -j)) as j from over semi join lone using (table_id, i) where s > 0 and (table_id, i) not in (select (table_id, i) from by_text) group by all),
own as (select * from aligned union select * from by_text union select * from by_any),
rest as (select table_id, idx as j from g where (table_id, idx) not in (select (table_id, j) from own)),
late_text as (select table_id, j, arg_max(i, (s, -i)) as i from over semi join rest using (table_id, j) where gn <> '' and rn = gn group by all),
late_near as (select table_id, j, arg_min(i, (d, i)) as i from over semi join rest using (table_id, j) where (table_id, j) not in (select (table_id, j) from late_text) group by all),
matches as (select table_id, i, j from own union select table_id, i, j from late_text union select table_id, i, j from late_near),
m as (
  select m.table_id, m.i, string_agg(m.j::varchar, ',' order by m.j) as matched, count(distinct (g."row", g."row" + g.rowspan)) > 1 as split_row, count(distinct (g.col, g.col + g.colspan)) > 1 as split_column
  from matches m join g on g.table_id = m.table_id and g.idx = m.j group by all
), gl as (select * from g qualify row_number() over (partition by table_id, "row", col, rowspan, colspan order by idx desc) = 1)
select r.table_id, r.idx as raw_index, r."row" || ':' || r.col as anchor, coalesce(m.split_row, false) as split_row, coalesce(m.split_column, false) as split_column,
  coalesce(gl.tag <> r.tag, false) as header_update, coalesce(gl.norm <> r.norm, false) as text_update, coalesce(m.matched, '') as matched
from r left join m on m.table_id = r.table_id and m.i = r.idx
left join gl on gl.table_id = r.table_id and gl."row" = r."row" and gl.col = r.col and gl.rowspan = r.rowspan and gl.colspan = r.colspan
"""
