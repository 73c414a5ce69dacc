"""Building a corpus from a latent plan, and verifying what was built.

Records are generated and read back as tables; gates are aggregations over them. A corpus
is a folder with ``records`` (Parquet), ``roles`` (JSON lines), ``signatures``, a
``report`` and ``sums``; nothing in it is ever overwritten.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import generate, isolate, latent, seal
from gridloom.session import cut
from gridloom.sources import files

GATES = ("count", "categories", "roles", "pairs", "overlap", "contract", "replay")


def records(families: DataFrame) -> DataFrame:
    """The records of a plan: one per member, with gold and prior grids, digests, gate and the keys of its family."""
    members = families.select("family_id", "counterfactual_group_id", "role", "base_seed", "shared_phenomenon", "gold_category", "generative_family_key", F.inline("members"))
    made = generate.generate(members.repartition(members.sparkSession.sparkContext.defaultParallelism))
    gate = F.when(F.col("category").endswith("keep"), "KEEP").otherwise("EDIT")
    return made.withColumn("gate_label", gate).withColumn("document_cluster_id", F.concat(F.lit("document-"), "generative_family_key"))


def signatures(recs: DataFrame) -> DataFrame:
    """The signature of each record, as ``isolate`` reads them. Nothing is drawn, so image, pixels and perceptual hash are null."""
    none = F.lit(None).cast("string")
    families = F.create_map(F.lit("generative_family_key"), F.col("generative_family_key"), F.lit("document_cluster_id"), F.col("document_cluster_id"))
    return recs.select("sample_id", "role", none.alias("perceptual_hash"), none.alias("image_sha256"), none.alias("pixel_sha256"), F.col("gold_sha256").alias("table_sha256"), "structure_sha256", "text_sha256", "geometry_sha256", families.alias("families"))


def contract_faults(recs: DataFrame) -> DataFrame:
    """Records that break their gate: keeps that differ from gold, edits that don't, corruptions that failed."""
    same = F.col("gold_sha256") == F.col("prior_sha256")
    return recs.where(F.coalesce(F.when(F.col("gate_label") == "KEEP", ~same).otherwise(same), F.lit(True)) | F.col("error").isNotNull())


def line(recs: DataFrame) -> Column:
    """What of a record the corpus' digest covers."""
    names = ["sample_id", "role", "category", "gate_label", "phenomenon", "family_id", "counterfactual_group_id", "base_seed", "gold_sha256", "prior_sha256", "structure_sha256", "geometry_sha256", "text_sha256"]
    return F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})


def gates(recs: DataFrame, requests: DataFrame) -> dict[str, bool]:
    """The gates of a corpus but ``replay``."""
    differ = lambda *by: not recs.groupBy(*by).agg(F.count("*").alias("a")).join(requests.groupBy(*by).agg(F.count("*").alias("b")), list(by), "full").where("a is distinct from b").isEmpty()
    pairs = isolate.pair_completeness(recs.select("sample_id", F.col("counterfactual_group_id").alias("pair_id"), "role", F.col("gold_sha256").alias("gold_sha")))
    return {
        "count": recs.count() == requests.count(),
        "categories": not differ("category"),
        "roles": not differ("role"),
        "pairs": pairs.where("not complete").isEmpty(),
        "overlap": isolate.audit(signatures(recs)).first()["status"] == "PASS",
        "contract": contract_faults(recs).isEmpty(),
    }


def build(families: DataFrame, requests: DataFrame, path: str) -> dict:
    """Writes the corpus of a plan to a path that must not exist and returns its report; raises, after writing, if a gate fails.

    Every record is made twice, and the two are compared (``replay``). Digests don't
    depend on the order or number of files.
    """
    spark = families.sparkSession
    plan = cut(families)
    files.write_new(records(plan), f"{path}/records")
    recs = spark.read.parquet(f"{path}/records")
    digest = seal.order_free_checksum(recs, line(recs)).first()
    again = seal.order_free_checksum(records(plan), line(recs)).first()
    files.write_role_lines(recs.withColumn("counterfactual_group_id", F.col("counterfactual_group_id")), f"{path}/roles")
    files.write_new(signatures(recs), f"{path}/signatures")
    checks = {**gates(recs, requests), "replay": digest["sha256"] == again["sha256"]}
    counts = {r.role: r.n for r in recs.groupBy("role").agg(F.count("*").alias("n")).collect()}
    report = {"requested": requests.count(), "generated": digest["n_lines"], "role_counts": counts, "records_sha256": digest["sha256"], "checks": checks, "status": "PASS" if all(checks.values()) else "FAIL"}
    files.write_report(report, f"{path}/report", spark)
    files.write_checksums(seal.checksums(spark, path).where("path not rlike '(^|/)[._]'"), f"{path}/sums")
    if report["status"] != "PASS":
        raise RuntimeError(f"corpus failed: {[c for c, ok in checks.items() if not ok]}")
    return report


def verify(spark: SparkSession, path: str, requests: DataFrame) -> dict:
    """What was built, looked at anew: files whose digests differ (``mismatches``), gates and digest that disagree with the report, records without their role line, ``status``."""
    sums = spark.read.text(f"{path}/sums").select(F.regexp_extract("value", r"^(\S+)  ", 1).alias("sha256"), F.regexp_extract("value", r"^\S+  (.*)$", 1).alias("path"))
    bad = [r.path for r in seal.verify_checksums(spark, path, sums).where("status != 'MATCH'").select("path").collect()]
    recs = spark.read.parquet(f"{path}/records")
    report = json.loads("".join(r.value for r in spark.read.text(f"{path}/report").collect()))
    checks = gates(recs, requests)
    digest = seal.order_free_checksum(recs, line(recs)).first()
    roles = spark.read.schema("sample_id string, role string").json(f"{path}/roles")
    unlisted = recs.select("sample_id", "role").exceptAll(roles).unionByName(roles.exceptAll(recs.select("sample_id", "role"))).count()
    disagree = sorted([c for c, ok in checks.items() if ok != report["checks"].get(c)] + ([] if digest["sha256"] == report["records_sha256"] else ["records_sha256"]))
    good = not bad and not disagree and not unlisted and all(checks.values()) and report["status"] == "PASS"
    return {"mismatches": bad, "disagreements": disagree, "unlisted": unlisted, "checks": checks, "status": "PASS" if good else "FAIL"}
