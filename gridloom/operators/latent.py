"""Latent plans: families of a corpus with their seeds, components and roles, before any table is made.

A family is a counterfactual pair or a single record. Families get a seed each such that
no two share a signature, then roles under the quotas of the coverage. A plan is a
DataFrame of one row per family; it is audited by nine checks, written as JSON lines with
its audit and checksums, and verified by auditing anew what was written.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.ranking import ranked_in_order
from gridloom.operators import generate, isolate, plan, seal
from gridloom.session import cut
from gridloom.sources import files

PAIRED = ("hard_keep", "single_minimal_edit")
MEMBERS = "array<struct<category:string,phenomenon:string,sample_index:bigint,sample_id:string>>"
PLAN = (
    "family_index bigint, family_id string, counterfactual_group_id string, role string, base_seed bigint, family_nonce int, shared_phenomenon string, gold_category string, "
    f"members {MEMBERS}, rows int, columns int, " + ", ".join(f"{s} string" for s in generate.SIGNATURES) + ", component_id string, component_size bigint, terminal_inputs_used boolean"
)
CHECKS = ("record_count", "category_counts", "role_counts", "phenomenon_role_counts", "family_single_role", "component_single_role", "counterfactual_groups", "cross_role_signature_overlap", "terminal_nonuse")


def family_specs(requests: DataFrame) -> DataFrame:
    """(family_index, hard, edit, category, phenomenon, shared_phenomenon): families in order, without roles - pairs by their edge, then singles by category and phenomenon.

    For a pair category and phenomenon are null; for a single hard and edit are. Raises
    ValueError if the paired categories' counts differ in a role.
    """
    pairs = plan.pair_members(requests)
    none = F.lit(None).cast("string")
    singles = requests.where(~F.col("category").isin(*PAIRED)).groupBy("category", "phenomenon").agg(F.count("*").cast("int").alias("n"))
    singles = singles.select("category", "phenomenon", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    rows = pairs.select(F.lit(0).alias("kind"), F.col("edge").alias("place"), F.col("edge_rank").alias("k"), "hard", "edit", none.alias("category"), none.alias("phenomenon"), F.concat_ws(" ", "hard", "edit").alias("shared_phenomenon"))
    rows = rows.unionByName(singles.select(F.lit(1).alias("kind"), plan.category_rank(F.col("category")).alias("place"), "k", none.alias("hard"), none.alias("edit"), "category", "phenomenon", F.col("phenomenon").alias("shared_phenomenon")))
    return ranked_in_order(rows.withColumn("all", F.lit(0)), ["all"], ["kind", "place", "shared_phenomenon", "k"], "family_index").drop("all", "kind", "place", "k")


def create_plan(requests: DataFrame, seed_start: int, dataset: str, assets: tuple[dict, ...] = ({},)) -> DataFrame:
    """The plan (columns: PLAN) for requests (category, gate_label, phenomenon, role, ordinal).

    Raises if quotas cannot be met, if a family runs out of seeds, or if two families
    are linked by a signature all the same.
    """
    spark = requests.sparkSession
    specs = cut(family_specs(requests))
    gold_category = F.coalesce("category", F.lit(PAIRED[1]))
    seeded = generate.isolate_families(specs.select("family_index", F.col("shared_phenomenon").alias("phenomenon"), gold_category.alias("category")), seed_start, assets=assets)
    made = specs.join(seeded.drop("phenomenon", "category"), "family_index").withColumn("family_id", F.concat(F.lit("family-"), "generative_family_key"))
    made = cut(made.withColumn("gold_category", gold_category))
    pairs = made.where("hard is not null").select("family_id", "hard", "edit")
    singles = made.where("hard is null").select("family_id", "category", "phenomenon")
    roles = plan.assign_roles(pairs, singles, requests)
    linked = isolate.duplicate_components(made.select(F.col("family_id").alias("sample_id"), F.lit(None).cast("string").alias("role"), *generate.SIGNATURES), generate.SIGNATURES)
    refused = F.when(F.col("component_size") > 1, F.raise_error(F.lit("families of a plan are linked by a signature")).cast("string"))
    linked = linked.select(F.col("sample_id").alias("family_id"), F.coalesce(refused, F.concat(F.lit("component-"), F.sha2(F.to_json(F.array("sample_id")), 256))).alias("component_id"), "component_size")
    # Pairs come first and have two members each, so a member's index follows from its family's.
    n_pairs = pairs.count()
    first = F.when(F.col("hard").isNotNull(), 2 * F.col("family_index")).otherwise(F.col("family_index") + n_pairs)
    member = lambda c, p, k: F.struct(c.alias("category"), p.alias("phenomenon"), (first + k).cast("bigint").alias("sample_index"), F.format_string(f"{dataset}-%06d", (first + k).cast("bigint")).alias("sample_id"))
    both = F.array(member(F.lit(PAIRED[0]), F.col("hard"), 0), member(F.lit(PAIRED[1]), F.col("edit"), 1))
    one = F.array(member(F.col("category"), F.col("phenomenon"), 0))
    done = made.join(roles, "family_id").join(linked, "family_id").withColumn("members", F.when(F.col("hard").isNotNull(), both).otherwise(one))
    done = done.withColumn("counterfactual_group_id", F.when(F.col("hard").isNotNull(), F.concat(F.lit("counterfactual-"), "generative_family_key"))).withColumn("terminal_inputs_used", F.lit(False)).withColumnRenamed("nonce", "family_nonce")
    return done.select(*spark.createDataFrame([], PLAN).columns)


def member_rows(families: DataFrame) -> DataFrame:
    return families.select("family_id", "component_id", "role", F.inline("members"))


def overlaps(families: DataFrame, shown: int = 8) -> DataFrame:
    """(signal, value, roles, family_ids): signatures of a plan found in more than one role, with the first families by index."""
    rows = families.select("role", "family_index", "family_id", F.inline(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("value")) for s in generate.SIGNATURES]))).where("value is not null")
    met = rows.groupBy("signal", "value").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.countDistinct("role").alias("n")).where("n > 1").drop("n")
    rank = F.row_number().over(Window.partitionBy("signal", "value").orderBy("family_index"))
    first = rows.join(met.select("signal", "value"), ["signal", "value"], "left_semi").withColumn("rank", rank).where(F.col("rank") <= shown)
    first = first.groupBy("signal", "value").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "family_id"))), lambda x: x["family_id"]), ",").alias("family_ids"))
    return met.join(first, ["signal", "value"])


def audit_plan(families: DataFrame, requests: DataFrame) -> DataFrame:
    """(check, passed, n): the nine checks of a plan against the requests it is for, n the number of faults.

    Counts are compared as tables, so a category, role or phenomenon that only one side
    has is a fault; an empty plan for no requests passes.
    """
    members = member_rows(families)

    def differ(*by: str) -> DataFrame:
        if not by:
            ones = members.select(F.lit(1).alias("n")).unionByName(requests.select(F.lit(-1).alias("n")))
            return ones.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).where("n != 0")
        have = members.groupBy(*by).agg(F.count("*").alias("a"))
        want = requests.groupBy(*by).agg(F.count("*").alias("b"))
        same = F.lit(True)
        for c in by:
            same &= have[c].eqNullSafe(want[c])
        return have.join(want, same, "full").where("a is distinct from b")

    torn = lambda c: families.groupBy(c).agg(F.min("role").alias("a"), F.max("role").alias("b"), F.count("role").alias("k"), F.count("*").alias("n")).where("a is distinct from b or k < n or a is null")
    categories = F.array_sort(F.transform("members", lambda m: m["category"]))
    unpaired = families.where("counterfactual_group_id is not null").where(F.coalesce(F.array_distinct(categories) != F.array(*[F.lit(c) for c in PAIRED]), F.lit(True)))
    faults = [differ(), differ("category"), differ("role"), differ("category", "phenomenon", "role"), torn("family_id"), torn("component_id"), unpaired, overlaps(families), families.where(F.coalesce("terminal_inputs_used", F.lit(True)))]
    found = None
    for name, rows in zip(CHECKS, faults):
        part = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), (F.col("n") == 0).alias("passed"), "n")
        found = part if found is None else found.unionByName(part)
    return found


def summary(families: DataFrame, requests: DataFrame) -> dict:
    """The audit as a report: counts, faults by check, and the overall status."""
    audited = {r.check: r.n for r in audit_plan(families, requests).collect()}
    counts = lambda *by: {"::".join(map(str, r[:-1])): r[-1] for r in member_rows(families).groupBy(*by).agg(F.count("*").alias("n")).collect()}
    return {
        "requested_records": requests.count(),
        "planned_records": member_rows(families).count(),
        "planned_families": families.count(),
        "category_counts": counts("category"),
        "role_counts": counts("role"),
        "category_role_counts": counts("category", "role"),
        "phenomenon_role_counts": counts("category", "phenomenon", "role"),
        "checks": {c: audited[c] == 0 for c in CHECKS},
        "status": "PASS" if not any(audited.values()) else "FAIL",
        "terminal_inputs_used": False,
    }


def _digest(families: DataFrame) -> str:
    return seal.order_free_checksum(families, F.to_json(F.struct(*sorted(families.columns)), {"ignoreNullFields": "false"})).first()["sha256"]


def write_plan(families: DataFrame, requests: DataFrame, path: str) -> dict:
    """Writes ``plan`` (JSON lines), ``audit`` and ``sums`` below a path that must not exist; raises, after writing, if a check fails."""
    spark = families.sparkSession
    held = cut(families)
    files.write_jsonl(held, f"{path}/plan")
    report = {**summary(held, requests), "plan_sha256": _digest(held)}
    files.write_report(report, f"{path}/audit", spark)
    files.write_checksums(seal.checksums(spark, path).where("path not rlike '(^|/)[._]'"), f"{path}/sums")
    if report["status"] != "PASS":
        raise RuntimeError(f"plan failed: {[c for c, ok in report['checks'].items() if not ok]}")
    return report


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """A plan's families from JSON lines; blank lines are skipped."""
    return spark.read.schema(PLAN).json(path)


def verify_plan(spark: SparkSession, path: str, requests: DataFrame) -> dict:
    """The audit made anew from what was written: ``mismatches`` (files whose digest differs or that are gone), ``disagreements`` with the builder's report, ``status``."""
    sums = spark.read.text(f"{path}/sums").select(F.regexp_extract("value", r"^(\S+)  ", 1).alias("sha256"), F.regexp_extract("value", r"^\S+  (.*)$", 1).alias("path"))
    bad = [r.path for r in seal.verify_checksums(spark, path, sums).where("status != 'MATCH'").select("path").collect()]
    families = read_plan(spark, f"{path}/plan")
    again = {**summary(families, requests), "plan_sha256": _digest(families)}
    built = json.loads("".join(r.value for r in spark.read.text(f"{path}/audit").collect()))
    disagree = sorted(k for k in again if again[k] != built.get(k))
    return {**again, "mismatches": bad, "disagreements": disagree, "status": "PASS" if again["status"] == "PASS" and not bad and not disagree else "FAIL"}
