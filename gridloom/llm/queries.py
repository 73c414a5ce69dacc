"""Queries of the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import components as comp
from gridloom.llm import leaks, overlap, packing, sentences
from gridloom.llm.sql import SQL  # noqa: F401
from gridloom.session import cut
from gridloom.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlap.overlaps(table(spark, sf_dir, "table_signatures"))
    return pairs.select(F.least("train_sample", "other_sample").alias("sample_a"), F.greatest("train_sample", "other_sample").alias("sample_b"), "overlap_kind")


def p3_overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs and samples per role and source of the development or holdout sample."""
    return overlap.overlap_counts(table(spark, sf_dir, "table_signatures"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = comp.components(cut(comp.key_links(table(spark, sf_dir, "table_records"))))
    return groups.where("sample != root").select(F.col("root").alias("group_first"), F.col("sample").alias("sample_id"))


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new role of every sample."""
    records = table(spark, sf_dir, "table_records")
    groups = comp.components(cut(comp.key_links(records)))
    samples = records.where("sample_id is not null").select(F.col("sample_id").alias("sample")).distinct()
    placed = comp.assign_roles(samples, groups, table(spark, sf_dir, "split_targets"))
    return placed.select(F.col("sample").alias("sample_id"), "group_first", "group_size", "role")


def p4_split_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples per new role against the target."""
    n = p4_splits(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n_samples"), F.countDistinct("group_first").alias("n_groups"))
    return n.join(table(spark, sf_dir, "split_targets"), "role", "left")


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container and place of each text or piece, for each kind of container."""
    lengths = cut(packing.token_lengths(table(spark, sf_dir, "documents")))
    return packing.pack(lengths, table(spark, sf_dir, "pack_capacity"))


def p6_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unused space per kind of container."""
    return packing.fill_report(p6_packing(spark, sf_dir), table(spark, sf_dir, "pack_capacity"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_leaks_by_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items and leaking documents per suite and language of the items."""
    items = table(spark, sf_dir, "eval_items")
    pairs = leaks.find_leaks(table(spark, sf_dir, "documents"), items)
    return pairs.join(items.select("item_id", "suite", "lang"), "item_id").groupBy("suite", "lang").agg(F.countDistinct("item_id").alias("n_items"), F.countDistinct("doc_id").alias("n_docs"))


def p7_decontaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with leaked spans cut out."""
    return leaks.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf_dir, "documents"))


def p8_units_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units and their mean length per language as the documents state it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("lang").alias("lang")).distinct()
    return p8_found(spark, sf_dir).join(docs, "doc_id").groupBy("lang").agg(F.count("*").alias("n_units"), F.avg(F.col("end_char") - F.col("start_char")).alias("mean_chars"))


QUERIES = {
    "p3_found": p3_found,
    "p3_overlap_counts": p3_overlap_counts,
    "p4_found": p4_found,
    "p4_splits": p4_splits,
    "p4_split_shares": p4_split_shares,
    "p6_packing": p6_packing,
    "p6_fill_report": p6_fill_report,
    "p7_found": p7_found,
    "p7_leaks_by_suite": p7_leaks_by_suite,
    "p7_decontaminated": p7_decontaminated,
    "p8_found": p8_found,
    "p8_units_by_lang": p8_units_by_lang,
}
