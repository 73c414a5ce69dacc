"""Queries of corpus planning, generation and sealing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.hashing import deterministic_label
from gridloom.functions.text import fold_key
from gridloom.operators import corpus, generate, grid, latent, nested, plan, seal
from gridloom.plans import views
from gridloom.session import cut
from gridloom.sources.tables import table

SEED = 202608131000000
#: So many seeds follow SEED; two of 100,000 requests share one in 1 of 200 corpora.
SEEDS = 1_000_000_000_000


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = nested.latest(table(spark, sf_dir, "table_records"), "sample_id", "revised_at", ["category", "phenomenon", "role"])
    return last.where("category is not null and phenomenon is not null").withColumn("role", fold_key(F.col("role")))


def stable_member_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the stable order of their category."""
    return plan.stable_order(_members(spark, sf_dir), [], ["sample_id"]).select("sample_id", "category", "phenomenon", "ordinal", "key", "rank")


def pair_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th hard keep of each role with its k-th single edit."""
    m = _members(spark, sf_dir)
    return plan.pair_zip(m.where("category = 'hard_keep'"), m.where("category = 'single_minimal_edit'"), ["role"], "sample_id")


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).where(F.col("category").isin(*plan.CATEGORIES) & F.col("role").isin(*plan.ROLES))


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coverage like the latest records: as many of each category, phenomenon and role, but as many single edits in a role as it has hard keeps.

    So every hard keep can have its counterfactual. The edits of a role are shared among
    phenomena in proportion to all records that are single edits, by greatest remainder.
    """
    n = _known(spark, sf_dir).groupBy("category", "phenomenon", "role").agg(F.count("*").alias("n"))
    wanted = n.where("category = 'hard_keep'").groupBy("role").agg(F.sum("n").alias("want"))
    edits = n.where("category = 'single_minimal_edit'").groupBy("category", "phenomenon").agg(F.sum("n").alias("n"))
    edits = edits.withColumn("role", F.explode(F.array(*[F.lit(r) for r in plan.ROLES]))).join(wanted, "role")
    have = F.sum("n").over(Window.partitionBy("role"))
    edits = edits.withColumn("have", have).withColumn("whole", F.expr("(n * want) div have")).withColumn("over", F.expr("(n * want) % have"))
    place = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("over"), "phenomenon"))
    lacking = F.col("want") - F.sum("whole").over(Window.partitionBy("role"))
    edits = edits.withColumn("n", F.col("whole") + F.when(place <= lacking, 1).otherwise(0)).select("category", "phenomenon", "role", "n")
    counts = n.where("category != 'single_minimal_edit'").unionByName(edits.where("n > 0"))
    gate = F.when(F.col("category").endswith("keep"), "KEEP").otherwise("EDIT")
    per = [F.coalesce(F.sum(F.when(F.col("role") == r, F.col("n"))), F.lit(0)).cast("int").alias(f"{r}_count") for r in plan.ROLES]
    return cut(counts.groupBy("category", gate.alias("gate_label"), "phenomenon").agg(F.sum("n").cast("int").alias("requested_count"), *per))


def coverage_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.expand_coverage(_coverage(spark, sf_dir))


def coverage_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.quotas(plan.expand_coverage(_coverage(spark, sf_dir)))


def _families(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    requests = plan.expand_coverage(_coverage(spark, sf_dir))
    specs = cut(latent.family_specs(requests).withColumn("family_id", F.format_string("family-%09d", "family_index")))
    return requests, specs.where("hard is not null"), specs.where("hard is null")


def counterfactual_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs each edge of phenomena has."""
    return plan.pair_members(plan.expand_coverage(_coverage(spark, sf_dir))).groupBy("hard", "edit").agg(F.count("*").alias("n"), F.min("hard_rank").alias("first_hard"), F.max("edit_rank").alias("last_edit"))


def role_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, pairs, singles = _families(spark, sf_dir)
    return plan.assign_roles(pairs.select("family_id", "hard", "edit"), singles.select("family_id", "category", "phenomenon"), requests)


def role_assignment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members per category, phenomenon and role: the quotas, if the assignment is right."""
    requests, pairs, singles = _families(spark, sf_dir)
    roles = plan.assign_roles(pairs.select("family_id", "hard", "edit"), singles.select("family_id", "category", "phenomenon"), requests)
    kinds = F.array(F.struct(F.lit("hard_keep").alias("category"), F.col("hard").alias("phenomenon")), F.struct(F.lit("single_minimal_edit").alias("category"), F.col("edit").alias("phenomenon")))
    members = pairs.select("family_id", F.inline(kinds)).unionByName(singles.select("family_id", "category", "phenomenon"))
    return members.join(roles, "family_id").groupBy("category", "phenomenon", "role").agg(F.count("*").alias("n"))


def _latent(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    requests = plan.expand_coverage(_coverage(spark, sf_dir))
    return cut(latent.create_plan(requests, SEED, "planned")), requests


def latent_plan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the latent plan per category, phenomenon and role, and how many distinct families and signatures they have."""
    families, _ = _latent(spark, sf_dir)
    one = F.inline(F.array(F.struct(F.element_at("members", 1)["category"].alias("category"), F.col("generative_family_key").alias("key"))))
    keys = families.select(one).groupBy("category").agg(F.countDistinct("key").alias("n_keys"))
    members = latent.member_rows(families).groupBy("category", "phenomenon", "role").agg(F.count("*").alias("n"), F.countDistinct("family_id").alias("n_families"))
    return members.join(keys, "category", "left").withColumn("n_keys", F.coalesce("n_keys", F.lit(0)))


def latent_plan_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine checks of the latent plan."""
    return latent.audit_plan(*_latent(spark, sf_dir))


def _record_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage of the latest records: how many of each category and phenomenon the roles hold."""
    known = _known(spark, sf_dir)
    gate = F.when(F.col("category").endswith("keep"), "KEEP").otherwise("EDIT")
    counts = [F.count_if(F.col("role") == r).cast("int").alias(f"{r}_count") for r in plan.ROLES]
    return known.groupBy("category", gate.alias("gate_label"), "phenomenon").agg(F.count("*").cast("int").alias("requested_count"), *counts)


def corpus_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates of the corpus of the latent plan; its records are generated, not written."""
    families, requests = _latent(spark, sf_dir)
    recs = cut(corpus.records(families))
    checks = corpus.gates(recs, requests)
    return spark.createDataFrame(sorted(checks.items()), "gate string, passed boolean")


def corpus_record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the corpus of the latent plan per category, phenomenon, role and gate."""
    families, _ = _latent(spark, sf_dir)
    return corpus.records(families).groupBy("category", "phenomenon", "role", "gate_label").agg(F.count("*").alias("n"))


def generated_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and prior grids of the records' coverage, one seed per request, with their difference."""
    rows = plan.expand_coverage(_record_coverage(spark, sf_dir))
    seeded = rows.withColumn("base_seed", F.lit(SEED) + F.abs(F.xxhash64("category", "phenomenon", "role", "ordinal")) % SEEDS)
    made = generate.generate(seeded.repartition(spark.sparkContext.defaultParallelism))
    canonical = lambda c: grid.canonical_cells(F.transform(c, lambda x: F.struct(*[x[n].alias(n) for n in ("row", "col", "rowspan", "colspan", "text", "tag", "bbox")], F.lit(None).cast("double").alias("confidence"))))
    made = made.withColumn("g", canonical(F.col("gold"))).withColumn("p", canonical(F.col("prior")))
    checked = grid.validate(made, "g")
    return checked.select("base_seed", "category", "phenomenon", "rows", "columns", F.size("g").alias("n_gold"), F.size("p").alias("n_prior"), "status", F.size(grid.difference(F.col("p"), F.col("g"))).alias("n_difference"), F.array_join("operations", ",").alias("operations"), "error")


def deterministic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by digest for every line of the order table."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", deterministic_label(F.col("o_orderkey"), F.lit(0), F.lit(1)).alias("label"))
    return rows


def record_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule each record with both states breaks, if any."""
    both = views.raw_and_gold(spark, sf_dir)
    last = nested.latest(table(spark, sf_dir, "table_records"), "sample_id", "revised_at", ["gate_label", "gold"]).select(F.col("sample_id").alias("table_id"), "gate_label", "gold.cells", "gold.tokens")
    key = lambda c: F.sha2(F.to_json(c), 256)
    facts = grid.validate(grid.validate(both, "gold").select("table_id", "raw", "gold", "raw_keys", "gold_keys", F.col("status").alias("gold_status")), "raw").withColumn("prior_status", F.col("status"))
    facts = facts.select("table_id", "gold_status", "prior_status", key(F.col("gold_keys")).alias("gold_sha"), key(F.col("raw_keys")).alias("prior_sha"), F.size(grid.difference(F.col("raw"), F.col("gold"))).alias("n_difference"))
    joined = facts.join(last, "table_id").withColumn("tokens_valid", seal.tokens_valid(F.col("cells"), F.col("tokens"))).withColumn("geometry_valid", seal.geometry_valid(F.col("cells"), F.col("tokens")))
    return seal.record_contract(joined).select("table_id", "gate_label", "violation")


def manifest_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order-free checksum over the structures of the gold grids."""
    gold = views.gold_tables(spark, sf_dir)
    return seal.order_free_checksum(gold, F.concat("table_id", F.lit("\t"), grid.structure_text(F.col("rows"), F.col("columns"), F.col("gold"))))


QUERIES = {q.__name__: q for q in (coverage_expand, coverage_quotas, stable_member_order, pair_zip, counterfactual_pairs, role_assignment, role_assignment_counts, latent_plan_counts, latent_plan_checks, corpus_gates, corpus_record_counts, generated_tables, deterministic_labels, record_contract, manifest_checksum)}

_MEMBERS = r"with m as (select sample_id, t.category as category, t.phenomenon as phenomenon, lower(trim(t.role, E' \t\n\r')) as role from (select sample_id, max_by(table_records, revised_at) as t from table_records where sample_id is not null group by sample_id) where t.category is not null and t.phenomenon is not null)"

_COVER = _MEMBERS + """, n as (
  select category, phenomenon, role, count(*) as n from m where category in ('exact_keep', 'hard_keep', 'single_minimal_edit', 'complex_correction') and role in ('train', 'development', 'holdout') group by all
), e as (
  select phenomenon, role, (n * want) // have as whole, (n * want) % have as over_, want
  from (select phenomenon, sum(n)::bigint as n, (sum(sum(n)) over ())::bigint as have from n where category = 'single_minimal_edit' group by phenomenon), (select role, sum(n)::bigint as want from n where category = 'hard_keep' group by role)
), q as (
  select * from n where category <> 'single_minimal_edit'
  union all
  select 'single_minimal_edit', phenomenon, role, whole + (row_number() over (partition by role order by over_ desc, phenomenon) <= want - sum(whole) over (partition by role))::int from e
), req as (select category, case when ends_with(category, 'keep') then 'KEEP' else 'EDIT' end as gate_label, phenomenon, role, unnest(range(n::bigint)) as ordinal from q where n > 0)
"""

# Members of a category and role in stable order: the k-th of its phenomenon has the digest of that.
_EDGES = _COVER + """, k as (
  select category, phenomenon, role, sha256('{"category":"' || category || '","namespace":"component-first-family-pairing-2026.08.12.7","ordinal":' || ordinal || ',"phenomenon":"' || phenomenon || '"}') as key
  from req where category in ('hard_keep', 'single_minimal_edit')
), o as (select *, row_number() over (partition by category, role order by key) as i from k),
edges as (select a.phenomenon as hard, b.phenomenon as edit, count(*) as n from o a join o b on a.role = b.role and a.i = b.i where a.category = 'hard_keep' and b.category = 'single_minimal_edit' group by all)
"""

SQL = {
    "coverage_expand": _COVER + "select category, gate_label, phenomenon, role, ordinal from req",
    "coverage_quotas": _COVER + "select category, phenomenon, role, count(*) as n from req group by all",
    "role_assignment_counts": _COVER + "select category, phenomenon, role, count(*) as n from req group by all",
    "latent_plan_counts": _COVER + """, f as (select category, count(*) as n_keys from req where category <> 'single_minimal_edit' group by all)
select category, phenomenon, role, count(*) as n, count(*) as n_families, coalesce(any_value(n_keys), 0) as n_keys from req left join f using (category) group by category, phenomenon, role""",
    "corpus_record_counts": _COVER + "select category, phenomenon, role, gate_label, count(*) as n from req group by all",
    "counterfactual_pairs": _EDGES + """select hard, edit, n, coalesce(sum(n) over (partition by hard order by edit rows between unbounded preceding and 1 preceding), 0)::bigint as first_hard,
  (sum(n) over (partition by edit order by hard) - 1)::bigint as last_edit from edges""",
    "stable_member_order": _MEMBERS + """, o as (select *, row_number() over (partition by category, phenomenon order by sample_id) - 1 as ordinal from m),
k as (select *, sha256('{"category":"' || category || '","namespace":"component-first-family-pairing-2026.08.12.7","ordinal":' || ordinal || ',"phenomenon":"' || phenomenon || '"}') as key from o)
select sample_id, category, phenomenon, ordinal, key, row_number() over (partition by category order by key) - 1 as rank from k""",
    "pair_zip": _MEMBERS + """, a as (select role, sample_id, row_number() over (partition by role order by sample_id) - 1 as i from m where category = 'hard_keep'),
b as (select role, sample_id, row_number() over (partition by role order by sample_id) - 1 as i from m where category = 'single_minimal_edit')
select a.role, a.sample_id as left_id, b.sample_id as right_id, a.i as pair_index from a join b on a.role = b.role and a.i = b.i""",
    "record_contract": views.BOTH + """, cells as (select table_id, unnest(t.gold.cells) as c from latest), tokens as (select table_id, unnest(t.gold.tokens) as k from latest),
v as (
  select s, table_id, count(*) as n, count(distinct (a, b)) as d, min(least(a, b)) as low, max(a) + 1 as nr, max(b) + 1 as nc
  from (select s, table_id, a, unnest(range(col, col + colspan)) as b from (select 'g' as s, table_id, col, colspan, unnest(range("row", "row" + rowspan)) as a from g union all select 'r', table_id, col, colspan, unnest(range("row", "row" + rowspan)) from r)) group by all
), bad as (select distinct table_id from v where n > d or low < 0 or d < nr * nc),
keys as (select a.table_id, a.s = b.s as same from (select table_id, string_agg(concat_ws(chr(1), "row", col, rowspan, colspan, norm, tag), chr(2) order by idx) as s from r group by table_id) a
  join (select table_id, string_agg(concat_ws(chr(1), "row", col, rowspan, colspan, norm, tag), chr(2) order by idx) as s from g group by table_id) b using (table_id)),
diff as (
  (select table_id, "row", col, rowspan, colspan from r except select table_id, "row", col, rowspan, colspan from g)
  union all (select table_id, "row", col, rowspan, colspan from g except select table_id, "row", col, rowspan, colspan from r)
), odd as (
  select table_id from (select table_id, count(*) as n, count(distinct k.token_id) as d from tokens group by table_id) where d < n
  union select table_id from tokens where coalesce(k.owner_cell_id, '') not in (select c.cell_id from cells where cells.table_id = tokens.table_id)
), flat as (
  select table_id from (select table_id, c.bbox as b from cells union all select table_id, k.bbox from tokens) where not coalesce(len(b) = 4 and b[3] > b[1] and b[4] > b[2], false)
)
select p.table_id, l.t.gate_label as gate_label, case when p.table_id in (select table_id from bad) then 'CANONICAL_VALIDATION_FAILED'
  when l.t.gate_label = 'KEEP' and not coalesce(keys.same, false) then 'KEEP_NOT_IDENTITY' when l.t.gate_label = 'EDIT' and keys.same then 'EDIT_NOT_REPLAYABLE'
  when l.t.gate_label = 'KEEP' and p.table_id in (select table_id from diff) then 'KEEP_EXPLICIT_DIFF_NOT_EMPTY' when l.t.gate_label = 'EDIT' and p.table_id not in (select table_id from diff) then 'EDIT_EXPLICIT_DIFF_EMPTY'
  when p.table_id in (select table_id from odd) then 'TOKEN_OWNERSHIP_INVALID' when p.table_id in (select table_id from flat) then 'GEOMETRY_INVALID' end as violation
from pairs p join latest l using (table_id) left join keys using (table_id)""",
    "deterministic_labels": "select o_orderkey, 'S' || upper(substr(sha256('cell-text|' || o_orderkey || '|0|1'), 1, 10)) || '-R1-C2' as label from orders",
    "manifest_checksum": "with " + views.GOLD + """, lines as (
  select sha256(l.table_id || chr(9) || concat_ws('|', t.gold.rows, t.gold.columns, coalesce(s, ''))) as d
  from latest l left join (select table_id, string_agg(concat_ws(',', "row", col, rowspan, colspan, tag), ';' order by idx) as s from gold group by table_id) using (table_id) where t.gold is not null
), leaves as (select substr(d, 1, 3) as leaf, count(*) as n, sha256(string_agg(d, '' order by d)) as d from lines group by 1)
select coalesce(sum(n), 0)::bigint as n_lines, sha256(string_agg(leaf || d, '' order by leaf)) as sha256 from leaves""",
}
