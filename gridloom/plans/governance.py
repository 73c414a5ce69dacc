"""Queries of candidate governance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.text import fold_key
from gridloom.operators import govern, grid
from gridloom.plans import views
from gridloom.sources.tables import table

POLICY = govern.Policy("prior-to-gold", provenance=False)
THRESHOLD, LIMIT, RECOGNIZER = 0.7, 50, "recog-server-5"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prior state as raw table, the gold state as candidate; neither states tokens by index."""
    def as_table(cells, with_box):
        cell = lambda c: F.struct(F.concat_ws("-", c["row"], c["col"], c["rowspan"], c["colspan"]).alias("cell_id"), c["row"].alias("row_start"), (c["row"] + c["rowspan"]).alias("row_end"), c["col"].alias("col_start"), (c["col"] + c["colspan"]).alias("col_end"), c["text"].alias("text"), c["tag"].alias("tag"), (c["bbox"] if with_box else F.lit(None).cast("array<double>")).alias("bbox"), F.lit(None).cast("array<int>").alias("tokens"))
        return F.transform(cells, cell)

    gold = views.gold_tables(spark, sf_dir).select("table_id", F.struct("rows", F.col("columns").alias("cols"), as_table(F.col("gold"), True).alias("cells")).alias("cand"))
    raw = views.prior_tables(spark, sf_dir).select("table_id", F.struct(grid.n_rows(F.col("raw")).alias("rows"), grid.n_cols(F.col("raw")).alias("cols"), as_table(F.col("raw"), False).alias("cells")).alias("raw"))
    return raw.join(gold, "table_id").withColumn("ocr", F.lit(None).cast("array<string>"))


def candidate_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of each gold state as a candidate for its prior state."""
    return govern.validate_candidates(_pairs(spark, sf_dir), POLICY).select("table_id", F.explode("issues").alias("issue"))


def _grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = views.raw_cell_rows(spark, sf_dir)
    cell = F.struct("cell_id", "row_start", "row_end", "col_start", "col_end", "text", "tag", "bbox", F.col("ocr_token_indexes").alias("tokens"))
    tables = cells.groupBy("table_id").agg(F.max("row_end").alias("rows"), F.max("col_end").alias("cols"), F.array_sort(F.collect_list(F.struct("cell_key", cell.alias("c")))).alias("cs"))
    raw = tables.select("table_id", F.struct("rows", "cols", F.transform("cs", lambda x: x["c"]).alias("cells")).alias("raw"))
    tokens = views.manifest(spark, sf_dir).select("table_id", F.transform("ocr_tokens", lambda t: t["text"]).alias("ocr"))
    return raw.join(tokens, "table_id", "left").withColumn("cand", F.col("raw"))


def grounding_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the tables of raw cells under the token-grounded policy, with the manifest's tokens."""
    policy = govern.Policy("grounded", text="OCR_GROUNDED", provenance=False)
    return govern.validate_candidates(_grounded(spark, sf_dir), policy).select("table_id", F.explode("issues").alias("issue"))


def candidate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on each gold state as a candidate; its gain is the share of cells that change, evidence is lacking for tables of fewer than two cells."""
    sha = lambda c: F.sha2(F.to_json(F.transform(c["cells"], lambda x: F.struct(x["row_start"], x["row_end"], x["col_start"], x["col_end"], x["text"], x["tag"]))), 256)
    key = lambda c: F.transform(c["cells"], lambda x: F.struct(x["row_start"], x["row_end"], x["col_start"], x["col_end"], x["tag"]))
    judged = govern.validate_candidates(_pairs(spark, sf_dir), POLICY).withColumn("raw_sha", sha(F.col("raw"))).withColumn("cand_sha", sha(F.col("cand")))
    n = F.size("cand.cells")
    gain = F.when(n >= 2, F.size(F.array_except(key(F.col("cand")), key(F.col("raw")))) / n)
    evidence = judged.withColumn("gain", gain).withColumn("gain_source", F.when(n >= 2, "NONTERMINAL_DEVELOPMENT")).withColumn("protocol_id", F.lit("share-of-changed-cells"))
    return govern.decide(evidence, POLICY).select("table_id", "decision", F.array_join("reasons", ",").alias("reasons"), "rollback_exact")


def explicit_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit candidates in which each row of a raw table is one cell."""
    cells = views.raw_cell_rows(spark, sf_dir).select("table_id", F.col("cell_key").cast("string").alias("cell_id"), "tag", "bbox", F.coalesce("ocr_token_indexes", F.array().cast("array<int>")).alias("tokens"), "row_start", "row_end", "col_start", "col_end")
    tokens = views.manifest(spark, sf_dir).select("table_id", F.transform("ocr_tokens", lambda t: F.struct(t["text"].alias("text"), t["bbox"].alias("bbox"))).alias("ocr"))
    parts = cells.groupBy("table_id", "row_start").agg(F.max("row_end").alias("row_end"), F.min("col_start").alias("col_start"), F.max("col_end").alias("col_end"), F.array_sort(F.collect_list("cell_id")).alias("source_cell_ids"))
    parts = parts.withColumn("cell_id", F.format_string("row-%04d", "row_start")).withColumn("tokens", F.lit(None).cast("array<int>"))
    made, refused = govern.explicit_candidates(cells.drop("row_start", "row_end", "col_start", "col_end"), tokens, parts)
    done = made.groupBy("table_id").agg(F.count("*").alias("n_cells"), F.sum(F.size("tokens")).alias("n_tokens"))
    return done.withColumn("outcome", F.lit("BUILT")).unionByName(refused.select("table_id", F.lit(None).cast("bigint").alias("n_cells"), F.lit(None).cast("bigint").alias("n_tokens"), F.col("reason").alias("outcome")))


def assemble_table_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a heading, the prior table and a note, in which the gold table takes the table's place."""
    gold = views.gold_tables(spark, sf_dir).select("table_id", F.to_json(F.struct(F.struct(F.col("gold").alias("cells")).alias("canonical_table"))).alias("output"))
    raw = views.prior_tables(spark, sf_dir).select("table_id", F.to_json("raw").alias("raw"))
    block = lambda kind, body: F.struct(F.lit(kind).alias("type"), body.alias("body"))
    pages = raw.join(gold, "table_id").withColumn("blocks", F.array(block("heading", F.col("table_id")), block("table", F.col("raw")), block("paragraph", F.concat(F.lit("note on "), F.col("table_id"))))).withColumn("table_index", F.lit(1))
    return govern.assemble_table_only(pages).select("table_id", "status", "frozen", F.col("frozen_after").alias("frozen_sha256"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "candidate_tokens").where("sample_id is not null").dropDuplicates(["candidate_id"])
    return rows.withColumn("table_id", fold_key(F.col("sample_id")))


def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the candidate tokens against the manifest."""
    return govern.audit_sidecars(views.manifest(spark, sf_dir), _candidates(spark, sf_dir), THRESHOLD, LIMIT, RECOGNIZER)


def view_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return govern.view_histogram(_candidates(spark, sf_dir))


def eligible_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tokens of each table with a confidence below the threshold."""
    return views.manifest(spark, sf_dir).select("table_id", F.posexplode(govern.eligible_tokens(F.col("ocr_tokens"), THRESHOLD, LIMIT)).alias("ordinal", "token_index"))


def forbidden_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior states and event properties that name a forbidden field at any depth."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), govern.has_forbidden_field(F.col("props")).alias("forbidden"))
    priors = table(spark, sf_dir, "table_records").select(F.col("sample_id").alias("id"), govern.has_forbidden_field(F.col("prior_json")).alias("forbidden"))
    return events.unionByName(priors).groupBy("id").agg(F.max("forbidden").alias("forbidden"))


def route_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance issues of every table of the manifest as a candidate of the explicit route: the digest of its image may be lacking."""
    raw = views.manifest(spark, sf_dir).select("table_id", F.struct(F.col("table_id").alias("sample_id"), F.col("image.input_image_sha256").alias("input_image_sha256")).alias("raw"))
    p = raw.withColumn("p", govern.route_provenance("explicit-topology", "structure-candidate", F.col("raw"), F.sha2("table_id", 256)))
    p = p.withColumn("p", F.struct("p.*", F.to_json("p").alias("json")))
    # The issues are a column before they are exploded: of a generator that reads fields of a struct, Catalyst loses the projection to these two columns.
    issues = p.select("table_id", F.filter(govern.provenance_issues(F.col("p")), lambda x: x.isNotNull()).alias("issues"))
    return issues.select("table_id", F.explode("issues").alias("issue"))


def explicit_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision of the explicit route on each table of raw cells as its own candidate, with its provenance."""
    image = views.manifest(spark, sf_dir).select("table_id", F.col("image.input_image_sha256").alias("digest"))
    both = _grounded(spark, sf_dir).join(image, "table_id", "left")
    source = F.struct(F.col("table_id").alias("sample_id"), F.col("digest").alias("input_image_sha256"))
    p = both.withColumn("p", govern.route_provenance("explicit-topology", "structure-candidate", source, F.sha2("table_id", 256)))
    p = p.withColumn("provenance", F.struct("p.*", F.to_json("p").alias("json"))).withColumn("raw_sha", F.lit("raw")).withColumn("cand_sha", F.lit("candidate"))
    p = p.withColumn("gain", F.lit(0.1)).withColumn("gain_source", F.lit("NONTERMINAL_DEVELOPMENT")).withColumn("protocol_id", F.lit("fixed-gain"))
    return govern.select_explicit(p).select("table_id", "decision", F.array_join("reasons", ",").alias("reasons"))


QUERIES = {q.__name__: q for q in (route_issues, explicit_decision, candidate_issues, grounding_issues, candidate_decision, explicit_candidate, assemble_table_only, issue_counts, view_histogram, eligible_tokens, forbidden_fields)}

_CAND = r"""
with c as (select * from (select distinct on (candidate_id) *, lower(trim(sample_id, E' \t\n\r')) as table_id from candidate_tokens) where sample_id is not null),
m as (select lower(trim(sample_id, E' \t\n\r')) as table_id, max_by(table_manifest, registered_at) as t from table_manifest where sample_id is not null group by 1),
tok as (select table_id, generate_subscripts(t.ocr_tokens, 1) - 1 as token_index, unnest(t.ocr_tokens) as s from m)
"""
_OK_TOKEN = "isfinite(s.confidence) and s.confidence < 0.7 and len(s.bbox) >= 4"
_ISSUES = views.BOTH + """, rt as (select table_id, string_agg(norm, chr(1) order by norm) as t from r group by table_id),
gt as (select table_id, string_agg(norm, chr(1) order by norm) as t, count(*) as n, max("row" + rowspan) as nr, max(col + colspan) as nc, sum(rowspan * colspan) as area,
  count(distinct ("row", col, rowspan, colspan)) as ids, bool_or(not coalesce(len(bbox) = 4 and bbox[3] > bbox[1] and bbox[4] > bbox[2], false)) as nobox, min(least("row", col)) as low from g group by table_id),
slots as (select table_id, count(distinct (a, b)) as taken from (select table_id, a, unnest(range(col, col + colspan)) as b from (select *, unnest(range("row", "row" + rowspan)) as a from g)) group by table_id),
d as (select p.table_id, t.gold.rows as rows_, t.gold.columns as cols_ from pairs p join latest using (table_id)),
j as (select d.*, gt.*, rt.t as raw_t, s.taken, coalesce(gt.nr = rows_ and gt.nc = cols_ and rows_ > 0 and cols_ > 0, false) as shaped from d left join gt on gt.table_id = d.table_id left join rt on rt.table_id = d.table_id left join slots s on s.table_id = d.table_id),
issues as (
  select j.table_id, 'CANONICAL_CELLS_MISSING' as issue from j where n is null
  union all select j.table_id, 'CANONICAL_SHAPE_INVALID' from j where not shaped
  union all select j.table_id, 'CELL_ID_DUPLICATED' from j where ids < n
  union all select j.table_id, 'CELL_INTERVAL_INVALID' from j where low < 0
  union all select j.table_id, 'CANONICAL_GRID_OVERLAP' from j where taken < area
  union all select j.table_id, 'GEOMETRY_MISSING_OR_INVALID' from j where nobox
  union all select j.table_id, 'CANONICAL_GRID_INCOMPLETE' from j where shaped and taken <> rows_ * cols_
  union all select j.table_id, 'RAW_TEXT_MULTISET_CHANGED' from j where t is distinct from raw_t
)
"""

_GROUND = r"""
with c as (
  select lower(trim(sample_id, E' \t\n\r')) as table_id, cell_key, cell_id, row_start as r0, row_end as r1, col_start as c0, col_end as c1, text, geometry.bbox as b, ocr_token_indexes as tk
  from (select distinct on (cell_key) * from raw_cells) where sample_id is not null
), m as (
  select lower(trim(sample_id, E' \t\n\r')) as table_id, max_by(table_manifest, registered_at).ocr_tokens as o from table_manifest where sample_id is not null group by 1
), n as (
  select c.*, o, coalesce(r0 >= 0 and c0 >= 0 and r1 > r0 and c1 > c0, false) as legal, coalesce(len(b) = 4 and isfinite(b[1]) and isfinite(b[2]) and isfinite(b[3]) and isfinite(b[4]) and b[3] > b[1] and b[4] > b[2], false) as boxed,
    coalesce(tk is not null and len(list_filter(tk, lambda x: x is null or x < 0)) = 0, false) as owned, coalesce(len(list_filter(tk, lambda x: x >= len(o))) > 0, false) as outside,
    regexp_replace(replace(coalesce(text, ''), '²', '2'), '\s+', '', 'g') as norm,
    regexp_replace(replace(array_to_string(list_transform(tk, lambda x: coalesce(o[x + 1].text, '')), ''), '²', '2'), '\s+', '', 'g') as said
  from c left join m using (table_id)
), t as (
  select table_id, max(r1) as nr, max(c1) as nc, count(*) as n, count(distinct cell_id) + count(*) filter (cell_id is null) as ids, bool_or(not legal) as illegal, bool_or(legal and not boxed) as nobox, bool_or(owned) as active, bool_and(owned) as whole,
    bool_or(o is not null and outside) as out_, bool_or(o is not null and not outside and norm <> said) as odd, len(flatten(list(tk))) as used, len(list_distinct(flatten(list(tk)))) as used_once,
    sum((r1 - r0) * (c1 - c0)) filter (legal) as area, bool_or(r0 is null or r1 is null or c0 is null or c1 is null) as gap
  from n group by table_id
), s as (select table_id, count(distinct (a, x)) as taken from (select table_id, a, unnest(range(c0, c1)) as x from (select *, unnest(range(r0, r1)) as a from n where legal)) group by table_id),
j as (select t.*, coalesce(s.taken, 0) as taken, coalesce(not gap and nr > 0 and nc > 0, false) as shaped from t left join s using (table_id))
select table_id, 'CANONICAL_SHAPE_INVALID' as issue from j where not shaped
union all select table_id, 'CELL_ID_DUPLICATED' from j where ids < n
union all select table_id, 'CELL_INTERVAL_INVALID' from j where illegal
union all select table_id, 'CANONICAL_GRID_OVERLAP' from j where taken < area
union all select table_id, 'GEOMETRY_MISSING_OR_INVALID' from j where nobox
union all select table_id, 'CANONICAL_GRID_INCOMPLETE' from j where shaped and taken <> nr::bigint * nc
union all select table_id, 'TOKEN_OWNERSHIP_PARTIAL' from j where active and not whole
union all select table_id, 'TOKEN_OWNERSHIP_REQUIRED' from j where not active
union all select table_id, unnest(['RAW_TOKEN_OWNERSHIP_DUPLICATED', 'CANDIDATE_TOKEN_OWNERSHIP_DUPLICATED']) from j where active and whole and used_once < used
union all select table_id, 'TOKEN_INDEX_OUT_OF_RANGE' from j where active and whole and out_
union all select table_id, 'CANDIDATE_TEXT_NOT_OCR_GROUNDED' from j where active and whole and odd
"""

_ROUTE = r"""select lower(trim(sample_id, E' \t\n\r')) as table_id, 'PROVENANCE_INPUT_IMAGE_SHA256_MISSING' as issue from table_manifest where sample_id is not null
group by 1 having coalesce(trim(max_by(table_manifest, registered_at).image.input_image_sha256, E' \t\n\r'), '') = ''"""

SQL = {
    "route_issues": _ROUTE,
    "explicit_decision": "with g as (" + _GROUND + "), tables as (select distinct lower(trim(sample_id, E' \\t\\n\\r')) as table_id from raw_cells where sample_id is not null), known as (select lower(trim(sample_id, E' \\t\\n\\r')) as k from table_manifest where sample_id is not null), p as (" + _ROUTE + """),
i as (select table_id, issue from g union select table_id, issue from p union select table_id, 'PROVENANCE_INPUT_IMAGE_SHA256_MISSING' from tables where table_id not in (select k from known)),
codes as (select table_id, string_agg(issue, ',' order by issue) as codes from (select table_id, issue from i union select table_id, 'VALIDATION_FAILED' from i) group by table_id)
select table_id, case when codes is null then 'ACCEPT' else 'ROLLBACK' end as decision, coalesce(codes, 'VALID_AND_POSITIVE_EXPECTED_GAIN') as reasons from tables left join codes using (table_id)""",
    "grounding_issues": _GROUND,
    "candidate_decision": _ISSUES + """, rs as (select table_id, string_agg(concat_ws(chr(1), "row", rowspan, col, colspan, text, tag), chr(2) order by idx) as s from r group by table_id),
gs as (select table_id, string_agg(concat_ws(chr(1), "row", rowspan, col, colspan, text, tag), chr(2) order by idx) as s, count(*) as n from g group by table_id),
new as (select table_id, count(*) as k from (select table_id, "row", rowspan, col, colspan, tag from g except select table_id, "row", rowspan, col, colspan, tag from r) group by table_id),
i as (select table_id, string_agg(issue, ',' order by issue) as codes from (select table_id, issue from issues union all select distinct table_id, 'VALIDATION_FAILED' from issues) group by table_id),
f as (select p.table_id, rs.s is not distinct from gs.s as same, codes, coalesce(gs.n, 0) as n, coalesce(new.k, 0) as k from pairs p left join rs using (table_id) left join gs using (table_id) left join new using (table_id) left join i using (table_id)),
dec as (select table_id, case when same then 'PASS_THROUGH' when codes is not null or n < 2 or k = 0 then 'ROLLBACK' else 'ACCEPT' end as decision,
  case when same then 'IDENTICAL_STATE' when codes is not null then codes when n < 2 then 'EXPECTED_GAIN_MISSING' when k = 0 then 'EXPECTED_GAIN_INSUFFICIENT' else 'VALID_AND_POSITIVE_EXPECTED_GAIN' end as reasons from f)
select table_id, decision, reasons, decision <> 'ACCEPT' as rollback_exact from dec""",
    "assemble_table_only": views.BOTH + """select table_id, 'PASS' as status, true as frozen,
  sha256('[{"type":"heading","body":"' || table_id || '"},{"type":"paragraph","body":"note on ' || table_id || '"}]') as frozen_sha256 from pairs""",
    "candidate_issues": _ISSUES + "select * from issues",
    "eligible_tokens": _CAND + f"select table_id, row_number() over (partition by table_id order by token_index) - 1 as ordinal, token_index from tok where {_OK_TOKEN} qualify ordinal < 50",
    "view_histogram": _CAND + "select coalesce(len(candidates), -1) as n_views, count(*) as n from c group by 1",
    "issue_counts": _CAND + f""", k as (
  select c.*, m.t.image.width as w, m.t.image.height as h, coalesce(len(m.t.ocr_tokens), 0) as n_ocr, tok.s as s, absolute_bbox as b, coalesce(len(absolute_bbox) >= 4, false) as okb
  from c join m using (table_id) left join tok on tok.table_id = c.table_id and tok.token_index = c.token_index
), v as (select * from k where token_index >= 0 and token_index < n_ocr),
i as (
  select 'invalid_token_index' as issue from k where not coalesce(token_index >= 0 and token_index < n_ocr, false)
  union all select case when not coalesce(isfinite(source_confidence) and source_confidence < 0.7, false) then 'source_confidence_not_below_threshold'
    when not coalesce(isfinite(s.confidence), false) then 'invalid_frozen_source_confidence' when abs(source_confidence - s.confidence) > 1e-6 then 'source_confidence_mismatch' end from v
  union all select 'source_text_mismatch' from v where coalesce(source_text, '') <> coalesce(s.text, '')
  union all select 'invalid_bbox' from v where not okb
  union all select 'degenerate_bbox' from v where okb and (b[3] <= b[1] or b[4] <= b[2])
  union all select 'bbox_out_of_image' from v where okb and (b[1] < 0 or b[2] < 0 or b[3] > coalesce(w, 0) or b[4] > coalesce(h, 0))
  union all select 'bbox_source_mismatch' from v where okb and not coalesce(len(s.bbox) >= 4 and abs(b[1] - s.bbox[1]) <= 1e-6 and abs(b[2] - s.bbox[2]) <= 1e-6 and abs(b[3] - s.bbox[3]) <= 1e-6 and abs(b[4] - s.bbox[4]) <= 1e-6, false)
  union all select 'candidate_views_not_list' from v where candidates is null
  union all select 'view_contract_mismatch' from v where list_transform(candidates, lambda x: x.view) <> ['tight', 'padded']
  union all select 'invalid_recognition_confidence' from (select unnest(candidates) as x from v) where not coalesce(isfinite(x.confidence), false)
  union all select 'recognizer_model_mismatch' from (select unnest(candidates) as x from v) where x.model_id is distinct from 'recog-server-5'
  union all select 'missing_sidecar' from m where table_id not in (select table_id from c)
  union all select 'sidecar_not_in_manifest' from (select distinct table_id from c) where table_id not in (select table_id from m)
  union all select 'maximum_candidates_exceeded' from (select table_id from c where table_id in (select table_id from m) group by 1 having count(*) > 50)
  union all select 'eligible_token_sequence_mismatch' from (select distinct coalesce(a.table_id, e.table_id) as table_id from
    (select table_id, token_index, count(*) as n from v group by all) a full join
    (select table_id, token_index from tok where {_OK_TOKEN} qualify row_number() over (partition by table_id order by token_index) <= 50) e
    on a.table_id = e.table_id and a.token_index = e.token_index where a.n is null or e.table_id is null or a.n > 1) where table_id in (select table_id from c)
)
select issue, count(*) as n from i where issue is not null group by 1
union all select 'duplicate_token_index', sum(n - 1)::bigint from (select count(*) as n from v group by table_id, token_index having count(*) > 1) having sum(n - 1) > 0
""",
    "forbidden_fields": """select id, max(f) as forbidden from (
  select event_id::varchar as id, exists (select 1 from json_tree(props) x where x.key in ('gold_text', 'target_text')) as f from events
  union all select sample_id, coalesce((select bool_or(x.key in ('gold_text', 'target_text')) from json_tree(case when json_valid(prior_json) then prior_json::json end) x), false) from table_records
) group by id""",
}
