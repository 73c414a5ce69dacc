"""Sealing: checksums, their verification, and the gate before training."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources import files

#: Hex digits of a line's digest that choose its leaf; more digits for more lines.
LEAF_DIGITS = 3


def order_free_checksum(df: DataFrame, line: Column, digits: int = LEAF_DIGITS) -> DataFrame:
    """One row (n_lines, sha256) over lines, whatever their order and partitions.

    A two-level hash tree: lines go to leaves by their digest, a leaf is the digest of its
    lines' digests in order, the root that of the leaves. No task sees more than a leaf.
    """
    lines = df.select(F.sha2(line, 256).alias("d"))
    leaves = lines.groupBy(F.substring("d", 1, digits).alias("leaf")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"))
    root = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("leaf", "d"))), lambda x: F.concat(x["leaf"], x["d"])), ""), 256)
    return leaves.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"), root.alias("sha256"))


def checksums(spark: SparkSession, root: str, leave_out: str = "SHA256SUMS") -> DataFrame:
    """(path, sha256, bytes) of every file below a folder but the checksum file itself, paths relative."""
    found = files.binary(spark, root)
    return found.where(F.col("path") != leave_out).select("path", F.sha2("content", 256).alias("sha256"), "bytes")


def verify_checksums(spark: SparkSession, root: str, expected: DataFrame) -> DataFrame:
    """(path, expected, actual, status): MATCH, MISMATCH, MISSING for each of ``expected`` (path, sha256)."""
    actual = checksums(spark, root, "").select("path", F.col("sha256").alias("actual"))
    joined = expected.select("path", F.lower("sha256").alias("expected")).join(actual, "path", "left")
    status = F.when(F.col("actual").isNull(), "MISSING").when(F.col("actual") == F.col("expected"), "MATCH").otherwise("MISMATCH")
    return joined.withColumn("status", status)


def verify_seals(spark: SparkSession, root: str) -> DataFrame:
    """(seal, artifact, expected, actual, crlf, status) of the ``.sha256`` and ``.seal.json`` files of a folder."""
    seals = files.seals(spark, root)
    stored = files.binary(spark, root).select(F.col("path").alias("artifact"), F.sha2("content", 256).alias("actual"), (F.instr(F.decode("content", "ISO-8859-1"), "\r\n") > 0).alias("crlf"))
    joined = seals.join(stored, "artifact", "left")
    status = F.when(F.col("actual").isNull(), "MISSING").when(F.col("actual") == F.col("expected"), "MATCH").otherwise("MISMATCH")
    return joined.withColumn("status", status)


def seal_status(verified: DataFrame) -> str:
    """A mismatch outranks a missing artifact."""
    seen = {r[0] for r in verified.select("status").distinct().collect()}
    return "BLOCKED_CONTENT_MISMATCH" if "MISMATCH" in seen else "BLOCKED_MISSING_ARTIFACT" if "MISSING" in seen else "PASS"


def train_ready(spark: SparkSession, corpus: str) -> str:
    """``READY``, or the first reason why training may not start."""
    texts = {r.path: r.text for r in files.texts(spark, corpus, "TRAIN_READY_SEAL.json").collect()}
    if "TRAIN_READY_SEAL.json" not in texts:
        return "TRAIN_READY_SEAL_MISSING"
    seal = json.loads(texts["TRAIN_READY_SEAL.json"])
    manifest = seal.get("manifest") or {}
    path, sha = manifest.get("path"), manifest.get("sha256")
    gates = [
        (seal.get("status") == "TRAIN_READY_SEALED", "TRAIN_READY_STATUS_INVALID"),
        (seal.get("training_authorized") is True, "TRAINING_AUTHORIZATION_MISSING"),
        (isinstance(path, str) and isinstance(sha, str), "TRAIN_READY_MANIFEST_REFERENCE_INVALID"),
    ]
    for held, reason in gates:
        if not held:
            return reason
    if not files.safe_path(path):
        return "TRAIN_READY_MANIFEST_REFERENCE_INVALID"
    actual = [r.sha256 for r in checksums(spark, corpus).where(F.col("path") == path).collect()]
    gates = [
        (bool(actual), "TRAIN_READY_MANIFEST_MISSING"),
        (actual[:1] == [sha], "TRAIN_READY_MANIFEST_HASH_MISMATCH"),
        (seal.get("builder_verifier_agree") is True, "INDEPENDENT_VERIFIER_NOT_CONFIRMED"),
        (seal.get("all_hard_gates_passed") is True, "HARD_GATES_NOT_CONFIRMED"),
    ]
    return next((reason for held, reason in gates if not held), "READY")


def record_contract(df: DataFrame) -> DataFrame:
    """``df`` with ``violation``: the first rule a record breaks, or null.

    Columns: gate_label, gold_status and prior_status (of the grids), gold_sha, prior_sha,
    n_difference, tokens_valid, geometry_valid.
    """
    same = F.col("gold_sha") == F.col("prior_sha")
    keep, edit = F.col("gate_label") == "KEEP", F.col("gate_label") == "EDIT"
    rule = (
        F.when((F.col("gold_status") != "PASS") | (F.col("prior_status") != "PASS"), "CANONICAL_VALIDATION_FAILED")
        .when(keep & ~same, "KEEP_NOT_IDENTITY")
        .when(edit & same, "EDIT_NOT_REPLAYABLE")
        .when(keep & (F.col("n_difference") > 0), "KEEP_EXPLICIT_DIFF_NOT_EMPTY")
        .when(edit & (F.col("n_difference") == 0), "EDIT_EXPLICIT_DIFF_EMPTY")
        .when(~F.col("tokens_valid"), "TOKEN_OWNERSHIP_INVALID")
        .when(~F.col("geometry_valid"), "GEOMETRY_INVALID")
    )
    return df.withColumn("violation", rule)


def tokens_valid(cells: Column, tokens: Column) -> Column:
    """Token ids are unique and every owner is a cell of the table; no tokens are valid."""
    ids = F.transform(F.coalesce(tokens, F.array()), lambda t: t["token_id"])
    owners = F.array_distinct(F.transform(F.coalesce(tokens, F.array()), lambda t: F.coalesce(t["owner_cell_id"], F.lit(""))))
    return (F.size(F.array_distinct(ids)) == F.size(ids)) & (F.size(F.array_except(owners, F.transform(F.coalesce(cells, F.array()), lambda c: c["cell_id"]))) == 0)


def geometry_valid(cells: Column, tokens: Column) -> Column:
    """Every cell and token has a box of four numbers and positive area."""
    boxes = F.concat(F.transform(F.coalesce(cells, F.array()), lambda c: c["bbox"]), F.transform(F.coalesce(tokens, F.array()), lambda t: t["bbox"]))
    return F.forall(boxes, lambda b: F.coalesce((F.size(b) == 4) & F.forall(b, lambda v: v.isNotNull()) & (F.get(b, F.lit(2)) > F.get(b, F.lit(0))) & (F.get(b, F.lit(3)) > F.get(b, F.lit(1))), F.lit(False)))
