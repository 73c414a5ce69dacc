"""Views of the stored tables on which the table operators run, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.text import fold_key
from gridloom.operators import grid, nested
from gridloom.sources.tables import table

DOC = ["sample_id", "table_state"]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.shred(nested.states(table(spark, sf_dir, "table_records")), DOC, "doc")


def gold_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_id, rows, columns, gold, tokens) of each sample's latest revision that has a gold state; gold is canonical. No shuffle but that of the revisions."""
    last = nested.latest(table(spark, sf_dir, "table_records"), "sample_id", "revised_at", ["gold"]).where("gold is not null")
    return last.select(F.col("sample_id").alias("table_id"), "gold.rows", "gold.columns", grid.canonical_cells(F.col("gold.cells")).alias("gold"), F.col("gold.tokens").alias("tokens"))


def prior_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_id, raw): the canonical cells of the prior state, whatever its shape."""
    last = nested.latest(table(spark, sf_dir, "table_records"), "sample_id", "revised_at", ["prior_json"])
    cells = nested.cells(nested.shred(last, ["sample_id"], "prior_json", items=()), ["sample_id"])
    a = lambda k: F.col("attrs")[k]
    n = lambda k: a(k).try_cast("int")
    cell = F.struct(
        F.coalesce(n("row_start"), n("row")).alias("row"),
        F.coalesce(n("col_start"), n("col")).alias("col"),
        F.coalesce(n("row_end") - n("row_start"), n("rowspan")).alias("rowspan"),
        F.coalesce(n("col_end") - n("col_start"), n("colspan")).alias("colspan"),
        a("text").alias("text"),
        a("tag").alias("tag"),
        F.lit(None).cast("array<double>").alias("bbox"),
        F.lit(None).cast("double").alias("confidence"),
    )
    return cells.groupBy(F.col("sample_id").alias("table_id")).agg(grid.canonical_cells(F.collect_list(cell), geometry=False).alias("raw"))


def raw_and_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_id, raw, gold, raw_keys, gold_keys) of samples with both states, without geometry."""
    gold = gold_tables(spark, sf_dir).select("table_id", grid.canonical_cells(F.col("gold"), geometry=False).alias("gold"))
    both = prior_tables(spark, sf_dir).join(gold, "table_id")
    texts = both.withColumn("__rt", grid.normalized_texts(F.col("raw"))).withColumn("__gt", grid.normalized_texts(F.col("gold")))
    return texts.withColumn("raw_keys", grid.strict_keys(F.col("raw"), F.col("__rt"))).withColumn("gold_keys", grid.strict_keys(F.col("gold"), F.col("__gt"))).drop("__rt", "__gt")


def raw_cell_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw cells as span cells, each delivery once: table_id, cell_key and the cell's columns. Cells without sample are left out."""
    return table(spark, sf_dir, "raw_cells").where("sample_id is not null").dropDuplicates(["cell_key"]).select(
        fold_key(F.col("sample_id")).alias("table_id"), "cell_key", "cell_id", F.col("row_start").alias("row"), F.col("col_start").alias("col"),
        (F.col("row_end") - F.col("row_start")).alias("rowspan"), (F.col("col_end") - F.col("col_start")).alias("colspan"),
        "row_start", "row_end", "col_start", "col_end", "text", "tag", F.col("geometry.bbox").alias("bbox"), "ocr_token_indexes",
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_id, image, ocr_tokens): the manifest row of each sample registered last."""
    rows = table(spark, sf_dir, "table_manifest").withColumn("sample_id", fold_key(F.col("sample_id")))
    return nested.latest(rows, "sample_id", "registered_at", ["image", "ocr_tokens"]).withColumnRenamed("sample_id", "table_id")


# SQL. The texts here hold one character that NFKC changes, U+00B2.
LATEST = """
latest as (
  select sample_id as table_id, max_by(t, revised_at) as t from table_records t where sample_id is not null group by sample_id
)"""

GOLD = (
    LATEST
    + """, gold_rows as (
  select table_id, coalesce(c.row, 0) as "row", coalesce(c.col, 0) as col, greatest(1, coalesce(c.rowspan, 1)) as rowspan, greatest(1, coalesce(c.colspan, 1)) as colspan,
    trim(coalesce(c.text, '')) as text, case when lower(c.tag) = 'th' then 'th' else 'td' end as tag, c.bbox as bbox
  from (select table_id, unnest(t.gold.cells) as c from latest) where c is not null
), gold as (
  select *, regexp_replace(replace(text, '²', '2'), '\\s+', '', 'g') as norm,
    row_number() over (partition by table_id order by "row", col, rowspan, colspan, text, tag) - 1 as idx from gold_rows
)"""
)

PRIOR = r""", docs as (
  select table_id, case when json_valid(t.prior_json) then t.prior_json::json end as doc from latest
), objects as (
  select d.table_id, n.value as o from docs d, lateral (select * from json_tree(d.doc)) n
  where n.type = 'OBJECT' and json_extract_string(n.value, '$.cell_id') is not null and json_extract_string(n.value, '$.token_id') is null
), raw_rows as (
  select table_id, coalesce((o->>'$.row_start')::int, (o->>'$.row')::int, 0) as "row", coalesce((o->>'$.col_start')::int, (o->>'$.col')::int, 0) as col,
    greatest(1, coalesce((o->>'$.row_end')::int - (o->>'$.row_start')::int, (o->>'$.rowspan')::int, 1)) as rowspan,
    greatest(1, coalesce((o->>'$.col_end')::int - (o->>'$.col_start')::int, (o->>'$.colspan')::int, 1)) as colspan,
    trim(coalesce(o->>'$.text', '')) as text, case when lower(o->>'$.tag') = 'th' then 'th' else 'td' end as tag
  from objects
), raw as (
  select *, regexp_replace(replace(text, '²', '2'), '\s+', '', 'g') as norm,
    row_number() over (partition by table_id order by "row", col, rowspan, colspan, text, tag) - 1 as idx from raw_rows
)"""

#: Both states of samples that have both.
BOTH = (
    "with "
    + GOLD
    + PRIOR
    + """, pairs as (
  select table_id from (select table_id from latest where t.gold is not null) semi join raw using (table_id)
), r as (select * from raw semi join pairs using (table_id)), g as (select * from gold semi join pairs using (table_id))
"""
)
