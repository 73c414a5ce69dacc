"""File sources and sinks."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.text import strip

COVERAGE = "category string, gate_label string, phenomenon string, requested_count int, train_count int, development_count int, holdout_count int, counterfactual_pair_required boolean, primary_risk string"


def _relative(root: str) -> Column:
    clean = re.escape(re.sub(r"^file:/*", "/", root).rstrip("/"))
    return F.regexp_replace(F.regexp_replace(F.col("path"), "^file:/*", "/"), f"^{clean}/", "")


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """A coverage matrix from CSV with a header; types are given, not inferred."""
    return spark.read.csv(path, schema=COVERAGE, header=True, enforceSchema=False)


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, broken ones are kept in ``_corrupt``."""
    given = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark.read.schema(T.StructType([*given.fields, T.StructField("_corrupt", T.StringType())])).json(path, columnNameOfCorruptRecord="_corrupt")


def json_directory(spark: SparkSession, root: str, key: str = "sample_id") -> DataFrame:
    """(path, key, text, issue) of the ``*.json`` files of a folder.

    issue: ``invalid_sidecar_json`` (broken, or no object), ``missing_sample_id``,
    ``duplicate_sample_id`` (all files of a key but the first by path), or null.
    """
    from pyspark.sql.window import Window

    found = texts(spark, root, "*.json").withColumn("v", F.try_parse_json("text"))
    whole = F.col("v").isNotNull() & F.ltrim("text").startswith("{")
    found = found.withColumn("key", F.when(whole, F.try_variant_get("v", f"$.{key}", "string")))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("path"))
    issue = F.when(~whole, "invalid_sidecar_json").when(F.coalesce("key", F.lit("")) == "", "missing_sample_id").when(F.col("nth") > 1, "duplicate_sample_id")
    return found.withColumn("nth", nth).select("path", "key", "text", issue.alias("issue"))


def texts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, text) of whole files, paths relative to the folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return found.select(_relative(root).alias("path"), F.decode("content", "UTF-8").alias("text"))


def binary(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content, bytes) of files at any depth, paths relative to the folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return found.select(_relative(root).alias("path"), "content", F.col("length").alias("bytes"))


def seals(spark: SparkSession, root: str) -> DataFrame:
    """(seal, artifact, expected) from ``.sha256`` lines (digest, space, name) and ``.seal.json`` files."""
    a = texts(spark, root, "*.sha256").withColumn("line", strip(F.col("text"))).where("line != ''")
    lines = a.select(F.col("path").alias("seal"), F.trim(F.regexp_extract("line", r"^\S+\s+(.*)$", 1)).alias("artifact"), F.regexp_extract("line", r"^(\S+)", 1).alias("expected"))
    b = texts(spark, root, "*.seal.json").withColumn("v", F.try_parse_json("text"))
    objects = b.select(F.col("path").alias("seal"), F.try_variant_get("v", "$.artifact", "string").alias("artifact"), F.try_variant_get("v", "$.artifact_sha256", "string").alias("expected"))
    return lines.unionByName(objects.where("artifact is not null and expected is not null"))


def safe_path(path: str) -> bool:
    """Relative under POSIX and Windows rules, and without ``..``."""
    return bool(path) and not re.match(r"^([/\\]|[A-Za-z]:)", path) and ".." not in re.split(r"[/\\]", path)


def safe_path_column(path: Column) -> Column:
    return F.coalesce((path != "") & ~path.rlike(r"^([/\\]|[A-Za-z]:)") & ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)"), F.lit(False))


def check_assets(spark: SparkSession, root: str, inventory: DataFrame) -> DataFrame:
    """``inventory`` (path, sha256, bytes) with ``status``: OK, HOST_PATH_PROHIBITED, ASSET_MISSING, SIZE_MISMATCH or HASH_MISMATCH."""
    stored = binary(spark, root).select("path", F.sha2("content", 256).alias("__sha"), F.col("bytes").alias("__bytes"))
    status = F.when(~safe_path_column(F.col("path")), "HOST_PATH_PROHIBITED").when(F.col("__sha").isNull(), "ASSET_MISSING").when(F.col("__bytes") != F.col("bytes"), "SIZE_MISMATCH").when(F.col("__sha") != F.lower("sha256"), "HASH_MISMATCH").otherwise("OK")
    return inventory.join(stored, "path", "left").withColumn("status", status).drop("__sha", "__bytes")


def write_new(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes, and fails if the path exists."""
    df.write.format(form).mode("errorifexists").save(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with nulls stated, to a new path."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_role_lines(records: DataFrame, path: str) -> None:
    """The role assignment: ids, role, category, gate and group of each record."""
    write_jsonl(records.select("sample_id", "role", "category", "gate_label", "document_cluster_id", "counterfactual_group_id"), path)


def write_checksums(sums: DataFrame, path: str) -> None:
    """``digest  path`` lines in order of path, as one text file: one line per file of a corpus."""
    sums.orderBy("path").select(F.concat("sha256", F.lit("  "), "path").alias("value")).coalesce(1).write.mode("errorifexists").text(path)


def write_report(report: dict, path: str, spark: SparkSession) -> None:
    """A report of one row as a JSON file."""
    spark.createDataFrame([(json.dumps(report, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
