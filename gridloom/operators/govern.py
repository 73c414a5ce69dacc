"""Candidate governance: what keeps a proposed table from replacing its raw table, and audits of recognition sidecars."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.hashing import is_finite
from gridloom.functions.text import SPACE

#: One record's table: interval cells; ocr_token_indexes is null where ownership isn't stated.
TABLE = "struct<rows:int,cols:int,cells:array<struct<cell_id:string,row_start:int,row_end:int,col_start:int,col_end:int,text:string,tag:string,bbox:array<double>,tokens:array<int>>>>"
CELLS = "array<struct<cell_id:string,row_start:int,row_end:int,col_start:int,col_end:int,text:string,tag:string,bbox:array<double>,tokens:array<int>>>"
# Fields and words of provenance, forbidden fields, and the views of a candidate.
PROVENANCE_FIELDS = ("sample_id", "producer", "producer_release", "purpose", "input_image_sha256")
FORBIDDEN_WORDS = ("private-evaluation", "restricted-evaluation")
FORBIDDEN_FIELDS = ("gold_text", "target_text")
VIEW_NAMES = ("tight", "padded")


@dataclass(frozen=True)
class Policy:
    """What a candidate must keep. text: ``FROZEN_RAW`` or ``OCR_GROUNDED``."""

    policy_id: str
    minimum_gain: float = 0.0
    text: str = "FROZEN_RAW"
    complete_grid: bool = True
    geometry: bool = True
    provenance: bool = True


EXPLICIT = Policy("explicit-topology-only", text="OCR_GROUNDED")
COMPLETE_TABLE = Policy("complete-table-only", text="OCR_GROUNDED")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _plain(texts: pd.Series) -> pd.Series:
    """NFKC without white space; null as ''."""
    import unicodedata

    drop = re.compile(r"\s+")
    return texts.map(lambda a: None if a is None else [drop.sub("", t if t.isascii() else unicodedata.normalize("NFKC", t)) if t else "" for t in a])


def plain_texts(texts: Column) -> Column:
    return _plain(texts)


def valid_box(b: Column) -> Column:
    """Exactly four finite coordinates of positive area."""
    return F.coalesce((F.size(b) == 4) & F.forall(b, is_finite) & (F.get(b, 2) > F.get(b, 0)) & (F.get(b, 3) > F.get(b, 1)), F.lit(False))


def shape_issues(cand: Column, policy: Policy) -> Column:
    """Issue codes of the candidate's grid and geometry, nulls for those that don't hold."""
    cells = cand["cells"]
    n = F.coalesce(F.size(cells), F.lit(0))
    whole = lambda c: c["row_start"].isNotNull() & c["row_end"].isNotNull() & c["col_start"].isNotNull() & c["col_end"].isNotNull()
    legal = lambda c: F.coalesce(whole(c) & (c["row_start"] >= 0) & (c["col_start"] >= 0) & (c["row_end"] > c["row_start"]) & (c["col_end"] > c["col_start"]), F.lit(False))
    top = lambda k: F.greatest(F.coalesce(F.array_max(F.transform(cells, lambda c: c[k])), F.lit(0)), F.lit(0))
    shaped = F.coalesce((n > 0) & (cand["rows"] > 0) & (cand["cols"] > 0) & F.forall(cells, whole) & (top("row_end") == cand["rows"]) & (top("col_end") == cand["cols"]), F.lit(False))
    ids = F.transform(cells, lambda c, i: F.coalesce(c["cell_id"], i.cast("string")))
    good = F.filter(cells, legal)
    area = F.aggregate(good, F.lit(0).cast("bigint"), lambda a, c: a + (c["row_end"] - c["row_start"]).cast("bigint") * (c["col_end"] - c["col_start"]))
    slots = F.array_distinct(F.flatten(F.transform(good, lambda c: F.flatten(F.transform(F.sequence(c["row_start"], c["row_end"] - 1), lambda r: F.transform(F.sequence(c["col_start"], c["col_end"] - 1), lambda k: F.struct(r, k)))))))
    taken = F.size(slots)
    code = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), name)
    codes = [
        code(n == 0, "CANONICAL_CELLS_MISSING"),
        code(~shaped, "CANONICAL_SHAPE_INVALID"),
        code(F.size(F.array_distinct(ids)) < n, "CELL_ID_DUPLICATED"),
        code(F.exists(cells, lambda c: ~legal(c)), "CELL_INTERVAL_INVALID"),
        code(taken < area, "CANONICAL_GRID_OVERLAP"),
    ]
    if policy.geometry:
        codes.append(code(F.exists(good, lambda c: ~valid_box(c["bbox"])), "GEOMETRY_MISSING_OR_INVALID"))
    if policy.complete_grid:
        codes.append(code(shaped & (taken != cand["rows"].cast("bigint") * cand["cols"]), "CANONICAL_GRID_INCOMPLETE"))
    return F.array(*codes)


def provenance_issues(p: Column) -> Column:
    """p: struct of the provenance fields, restricted_evaluation_visible and json (its whole text)."""
    code = lambda cond, name: F.when(F.coalesce(cond, F.lit(True)), name)
    blank = lambda f: F.regexp_replace(F.coalesce(p[f], F.lit("")), SPACE, "") == ""
    held = F.array(
        *[code(blank(f), f"PROVENANCE_{f.upper()}_MISSING") for f in PROVENANCE_FIELDS],
        F.when(F.coalesce(p["restricted_evaluation_visible"], F.lit(True)), "PROVENANCE_RESTRICTED_EVALUATION_VISIBILITY_NOT_FALSE"),
        F.when(F.lower(F.coalesce(p["json"], F.lit(""))).rlike("|".join(FORBIDDEN_WORDS)), "PROVENANCE_RESTRICTED_EVALUATION_REFERENCE_FORBIDDEN"),
    )
    return F.when(p.isNull(), F.array(F.lit("PROVENANCE_MISSING"))).otherwise(held)


def text_issues(raw: Column, cand: Column, raw_texts: Column, cand_texts: Column, ocr: Column, said_texts: Column, policy: Policy) -> Column:
    """Issue codes of tokens and texts. *_texts: the cells' texts normalised, in order; ocr: the token texts, or null; said_texts: what each candidate cell's tokens say, normalised."""
    rc, cc = raw["cells"], cand["cells"]
    owned = lambda c: F.coalesce(c["tokens"].isNotNull() & F.forall(c["tokens"], lambda t: F.coalesce(t >= 0, F.lit(False))), F.lit(False))
    both = F.concat(F.coalesce(rc, F.array()), F.coalesce(cc, F.array()))
    active, whole = F.exists(both, owned), F.forall(both, owned)
    flat = lambda cells: F.flatten(F.transform(cells, lambda c: c["tokens"]))
    rf, cf = F.coalesce(flat(rc), F.array()), F.coalesce(flat(cc), F.array())
    on = active & whole
    code = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), name)
    outside = lambda c: F.exists(c["tokens"], lambda t: t >= F.size(ocr))
    said = F.transform(cc, lambda c, i: ~outside(c) & (F.get(said_texts, i) != F.get(cand_texts, i)))
    codes = [
        code(active & ~whole, "TOKEN_OWNERSHIP_PARTIAL"),
        code(on & (F.size(F.array_distinct(rf)) < F.size(rf)), "RAW_TOKEN_OWNERSHIP_DUPLICATED"),
        code(on & (F.size(F.array_distinct(cf)) < F.size(cf)), "CANDIDATE_TOKEN_OWNERSHIP_DUPLICATED"),
        code(on & (F.array_sort(rf) != F.array_sort(cf)), "TOKEN_COVERAGE_CHANGED"),
        code(on & ocr.isNotNull() & F.exists(cc, outside), "TOKEN_INDEX_OUT_OF_RANGE"),
        code(on & ocr.isNotNull() & F.exists(said, lambda x: F.coalesce(x, F.lit(False))), "CANDIDATE_TEXT_NOT_OCR_GROUNDED"),
    ]
    if policy.text == "OCR_GROUNDED":
        codes.append(code(~active, "TOKEN_OWNERSHIP_REQUIRED"))
    else:
        # An incomplete ownership ends the examination: no text issue then.
        codes.append(code(~(active & ~whole) & (F.array_sort(F.coalesce(raw_texts, F.array())) != F.array_sort(F.coalesce(cand_texts, F.array()))), "RAW_TEXT_MULTISET_CHANGED"))
    return F.array(*codes)


def validate_candidates(df: DataFrame, policy: Policy) -> DataFrame:
    """``df`` (raw, cand: TABLE; ocr: token texts or null; provenance if the policy asks for it) with ``issues``, sorted, each once."""
    texts = lambda c: plain_texts(F.transform(F.coalesce(c["cells"], F.array()), lambda x: F.coalesce(x["text"], F.lit(""))))
    step = df.withColumn("__rt", texts(F.col("raw"))).withColumn("__ct", texts(F.col("cand"))).withColumn("__ot", plain_texts(F.transform(F.coalesce("cand.cells", F.array().cast(CELLS)), lambda c: F.array_join(F.transform(c["tokens"], lambda i: F.get("ocr", i)), ""))))
    parts = [shape_issues(F.col("cand"), policy), text_issues(F.col("raw"), F.col("cand"), F.col("__rt"), F.col("__ct"), F.col("ocr"), F.col("__ot"), policy)]
    if policy.provenance:
        parts.append(provenance_issues(F.col("provenance")))
    return step.withColumn("issues", F.array_sort(F.array_distinct(F.filter(F.concat(*parts), lambda x: x.isNotNull())))).drop("__rt", "__ct", "__ot")


def decide(df: DataFrame, policy: Policy) -> DataFrame:
    """``df`` (raw_sha, cand_sha, issues, gain, gain_source, protocol_id) with ``decision`` and ``reasons``.

    In this order: no candidate, the identical state, failed validation, no evidence of
    gain, invalid evidence, a gain not above the minimum; else the candidate is accepted.
    """
    c = F.col
    invalid = F.coalesce((c("gain_source") != "NONTERMINAL_DEVELOPMENT") | (F.regexp_replace(c("protocol_id"), SPACE, "") == ""), F.lit(True)) | ~is_finite(c("gain"))
    steps = [
        (c("cand_sha").isNull(), "ROLLBACK", F.array(F.lit("CANDIDATE_MISSING"))),
        (c("cand_sha") == c("raw_sha"), "PASS_THROUGH", F.array(F.lit("IDENTICAL_STATE"))),
        (F.size("issues") > 0, "ROLLBACK", F.array_sort(F.concat(F.array(F.lit("VALIDATION_FAILED")), c("issues")))),
        (c("gain").isNull() & c("gain_source").isNull(), "ROLLBACK", F.array(F.lit("EXPECTED_GAIN_MISSING"))),
        (invalid, "ROLLBACK", F.array(F.lit("EXPECTED_GAIN_EVIDENCE_INVALID"))),
        (c("gain") <= policy.minimum_gain, "ROLLBACK", F.array(F.lit("EXPECTED_GAIN_INSUFFICIENT"))),
    ]
    decision, reasons = F.lit("ACCEPT"), F.array(F.lit("VALID_AND_POSITIVE_EXPECTED_GAIN"))
    for cond, d, r in reversed(steps):
        decision, reasons = F.when(cond, d).otherwise(decision), F.when(cond, r).otherwise(reasons)
    return df.withColumn("decision", decision).withColumn("reasons", reasons).withColumn("rollback_exact", decision != "ACCEPT").withColumn("output_sha", F.when(decision == "ACCEPT", c("cand_sha")).otherwise(c("raw_sha")))


def explicit_candidates(cells: DataFrame, tokens: DataFrame, partitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate cells that partition a raw table's tokens anew, and the tables refused.

    cells: (table_id, cell_id, tag, bbox, tokens); tokens: (table_id, ocr: array of
    (text, bbox)); partitions: (table_id, cell_id, row_start, row_end, col_start, col_end,
    source_cell_ids, tokens - null for all tokens of the sources). Returns (candidates,
    refused): candidates (table_id, cell_id, intervals, text, tag, tokens, bbox,
    source_cell_ids), refused (table_id, reason). Every token must be owned once, on both
    sides, and each candidate cell bound by exactly the sources of its tokens; its box is
    the sources' if it takes all their tokens, else its tokens'; it is a header if all
    sources are.
    """
    owned = cells.select("table_id", F.col("cell_id").alias("source"), F.col("tag").alias("source_tag"), F.col("bbox").alias("source_box"), F.col("tokens").alias("source_tokens"))
    raw = cells.groupBy("table_id").agg(F.sort_array(F.flatten(F.collect_list("tokens"))).alias("raw_tokens"), F.count("*").alias("n"), F.countDistinct("cell_id").alias("ids"))
    parts = partitions.withColumnRenamed("tokens", "declared").withColumn("__n", F.size("source_cell_ids"))
    joined = parts.select("*", F.explode("source_cell_ids").alias("source")).join(owned, ["table_id", "source"])
    box = lambda f, i: f(F.get("source_box", F.lit(i)))
    by = ["table_id", "cell_id", "row_start", "row_end", "col_start", "col_end", "source_cell_ids", "declared", "__n"]
    bound = joined.groupBy(*by).agg(
        F.flatten(F.collect_list("source_tokens")).alias("allowed"),
        F.collect_list("source_tokens").alias("each"),
        F.every(F.col("source_tag") == "th").alias("head"),
        F.array(box(F.min, 0), box(F.min, 1), box(F.max, 2), box(F.max, 3)).alias("whole"),
        F.count("*").alias("known"),
    )
    made = bound.withColumn("tokens", F.array_sort(F.coalesce("declared", "allowed"))).join(tokens, "table_id", "left")
    t = F.col("tokens")
    inside = F.filter(t, lambda i: (i >= 0) & (i < F.size("ocr")))
    edge = lambda f, i: f(F.transform(inside, lambda k: F.get(F.get("ocr", k)["bbox"], F.lit(i))))
    small = F.array(edge(F.array_min, 0), edge(F.array_min, 1), edge(F.array_max, 2), edge(F.array_max, 3))
    takes_all = F.size(F.array_except("allowed", t)) == 0
    made = made.withColumn("bbox", F.when(takes_all, F.col("whole")).otherwise(small)).withColumn("text", F.array_join(F.transform(inside, lambda k: F.coalesce(F.get("ocr", k)["text"], F.lit(""))), "")).withColumn("tag", F.when(F.col("head"), "th").otherwise("td"))
    wrong = (
        F.when((F.col("__n") == 0) | (F.size(F.array_distinct("source_cell_ids")) < F.col("__n")), "SOURCES_NOT_UNIQUE")
        .when(F.col("known") < F.col("__n"), "SOURCE_UNKNOWN")
        .when((F.size(t) == 0) | (F.size(F.array_distinct(t)) < F.size(t)), "TOKENS_NOT_UNIQUE")
        .when(F.size(F.array_except(t, "allowed")) > 0, "TOKEN_NOT_OWNED_BY_SOURCES")
        .when(F.exists("each", lambda e: ~F.arrays_overlap(e, t)), "SOURCES_DO_NOT_BIND_TOKENS")
        .when(F.size(inside) < F.size(t), "TOKEN_OUT_OF_RANGE")
    )
    made = made.withColumn("wrong", wrong)
    per = made.groupBy("table_id").agg(F.min("wrong").alias("wrong"), F.sort_array(F.flatten(F.collect_list("tokens"))).alias("used"))
    lost = partitions.select("table_id", "cell_id").join(made.select("table_id", "cell_id"), ["table_id", "cell_id"], "left_anti").select("table_id").distinct().withColumn("lost", F.lit(True))
    judged = per.join(raw, "table_id", "full").join(lost, "table_id", "left").join(tokens.select("table_id", F.size("ocr").alias("n_ocr")), "table_id", "left")
    judged = judged.join(partitions.select("table_id").distinct(), "table_id", "left_semi")
    reason = (
        F.when(F.col("n") > F.col("ids"), "RAW_CELL_IDS_NOT_UNIQUE")
        .when(F.size(F.array_distinct("raw_tokens")) < F.size("raw_tokens"), "RAW_TOKENS_DUPLICATED")
        .when(F.coalesce(F.array_sort("raw_tokens") != F.when(F.col("n_ocr") > 0, F.sequence(F.lit(0), F.col("n_ocr") - 1)).otherwise(F.array().cast("array<int>")), F.lit(True)), "RAW_TOKENS_DO_NOT_COVER")
        .when(F.col("lost"), "SOURCE_UNKNOWN")
        .when(F.col("wrong").isNotNull(), F.col("wrong"))
        .when(F.size(F.array_distinct("used")) < F.size("used"), "TOKENS_DUPLICATED")
        .when(F.coalesce(F.col("used") != F.col("raw_tokens"), F.lit(True)), "TOKENS_DO_NOT_COVER")
    )
    judged = judged.select("table_id", reason.alias("reason"))
    out = made.join(judged.where("reason is null").select("table_id"), "table_id", "left_semi")
    return out.select("table_id", "cell_id", "row_start", "row_end", "col_start", "col_end", "text", "tag", "tokens", "bbox", "source_cell_ids"), judged.where("reason is not null")


def assemble_table_only(pages: DataFrame) -> DataFrame:
    """``pages`` (blocks: array of (type, body), table_index, output) with one table block replaced, ``status`` and digests of the frozen rest.

    Refused: an index outside of the page, a block that is no table, an output that is no
    table or holds page blocks. The other blocks are the same before and after.
    """
    n, k = F.col("blocks"), F.col("table_index")
    rest = lambda b: F.sha2(F.to_json(F.filter(b, lambda x, i: i != k)), 256)
    out = F.try_parse_json("output")
    status = (
        F.when(n.isNull(), "PAGE_BLOCKS_MISSING")
        .when(k.isNull() | (k < 0) | (k >= F.size(n)), "TABLE_INDEX_OUT_OF_RANGE")
        .when(F.coalesce(F.get(n, k)["type"] != "table", F.lit(True)), "BLOCK_IS_NO_TABLE")
        .when(F.try_variant_get(out, "$.blocks", "variant").isNotNull(), "FULL_PAGE_OUTPUT_FORBIDDEN")
        .when(F.try_variant_get(out, "$.canonical_table", "variant").isNull(), "OUTPUT_IS_NO_TABLE")
        .otherwise("PASS")
    )
    swapped = F.transform(n, lambda b, i: F.when(i == k, F.struct(b["type"].alias("type"), F.col("output").alias("body"))).otherwise(b))
    step = pages.withColumn("status", status).withColumn("after", F.when(F.col("status") == "PASS", swapped).otherwise(n))
    return step.withColumn("frozen_before", rest(n)).withColumn("frozen_after", rest(F.col("after"))).withColumn("frozen", F.col("frozen_before") == F.col("frozen_after")).withColumn("page_sha256", F.sha2(F.to_json("after"), 256))


@F.pandas_udf(T.BooleanType())
def _has_field(texts: pd.Series) -> pd.Series:
    import json

    def has(t):
        try:
            stack = [json.loads(t)] if isinstance(t, str) else []
        except (ValueError, RecursionError):
            return False
        while stack:
            x = stack.pop()
            if isinstance(x, dict):
                if any(f in x for f in FORBIDDEN_FIELDS):
                    return True
                stack.extend(x.values())
            elif isinstance(x, list):
                stack.extend(x)
        return False

    return texts.map(has)


def has_forbidden_field(json_text: Column) -> Column:
    """Whether a forbidden field name occurs at any depth of JSON text; texts without the name as text are not parsed."""
    maybe = F.coalesce(json_text.rlike("|".join(FORBIDDEN_FIELDS)), F.lit(False))
    return F.when(maybe, _has_field(F.when(maybe, json_text))).otherwise(F.lit(False))


def finite_box(b: Column) -> Column:
    """At least four coordinates, the first four finite."""
    return F.coalesce((F.size(b) >= 4) & F.forall(F.slice(b, 1, 4), is_finite), F.lit(False))


def eligible_tokens(ocr: Column, threshold: float, limit: int) -> Column:
    """Indexes, in order, of the first ``limit`` tokens with a finite confidence below the threshold and a finite box.

    A negative limit takes that many from the end, as a slice does.
    """
    ok = F.filter(F.transform(ocr, lambda t, i: F.when(is_finite(t["confidence"]) & (t["confidence"] < threshold) & finite_box(t["bbox"]), i)), lambda i: i.isNotNull())
    return F.slice(ok, F.lit(1), F.lit(limit)) if limit >= 0 else F.slice(ok, F.lit(1), F.greatest(F.size(ok) + limit, F.lit(0)))


def token_issues(threshold: float, recognizer: str) -> Column:
    """Issue codes of one candidate token against ``source`` (its manifest token), width and height; columns as in the sidecar, ``n_ocr`` tokens in the manifest."""
    c = F.col
    code = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), name)
    box, sbox = c("absolute_bbox"), c("source.bbox")
    ok_box = finite_box(box)
    low = is_finite(c("source_confidence")) & (c("source_confidence") < threshold)
    at = lambda i: F.get(box, F.lit(i))
    same = finite_box(sbox) & F.forall(F.zip_with(F.slice(box, 1, 4), F.slice(sbox, 1, 4), lambda a, b: F.abs(a - b) <= 1e-6), lambda x: F.coalesce(x, F.lit(False)))
    views = F.transform("candidates", lambda v: v["view"])
    known = F.array(
        F.when(~F.coalesce(low, F.lit(False)), "source_confidence_not_below_threshold").when(~is_finite(c("source.confidence")), "invalid_frozen_source_confidence").when(F.abs(c("source_confidence") - c("source.confidence")) > 1e-6, "source_confidence_mismatch"),
        code(F.coalesce(c("source_text"), F.lit("")) != F.coalesce(c("source.text"), F.lit("")), "source_text_mismatch"),
        F.when(~ok_box, "invalid_bbox"),
        code(ok_box & ((at(2) <= at(0)) | (at(3) <= at(1))), "degenerate_bbox"),
        code(ok_box & ((at(0) < 0) | (at(1) < 0) | (at(2) > F.coalesce(c("width"), F.lit(0))) | (at(3) > F.coalesce(c("height"), F.lit(0)))), "bbox_out_of_image"),
        F.when(ok_box & ~F.coalesce(same, F.lit(False)), "bbox_source_mismatch"),
        F.when(c("candidates").isNull(), "candidate_views_not_list"),
        code(c("candidates").isNotNull() & (views != F.array(*[F.lit(v) for v in VIEW_NAMES])), "view_contract_mismatch"),
    )
    per_view = F.flatten(F.transform(F.coalesce("candidates", F.array()), lambda v: F.array(F.when(~is_finite(v["confidence"]), "invalid_recognition_confidence"), F.when(~F.coalesce(v["model_id"] == recognizer, F.lit(False)), "recognizer_model_mismatch"))))
    bad = c("token_index").isNull() | (c("token_index") < 0) | (c("token_index") >= F.coalesce(c("n_ocr"), F.lit(0)))
    return F.filter(F.when(bad, F.array(F.lit("invalid_token_index"))).otherwise(F.concat(known, per_view)), lambda x: x.isNotNull())


def audit_sidecars(manifest: DataFrame, candidates: DataFrame, threshold: float, limit: int, recognizer: str) -> DataFrame:
    """(issue, n) over all candidate tokens and tables.

    manifest: (table_id, image, ocr_tokens), one row per table; candidates: (table_id,
    token_index, ...) as in the sidecars. Token issues are counted before the shuffle.
    Table issues: ``missing_sidecar``, ``sidecar_not_in_manifest``,
    ``maximum_candidates_exceeded``, ``duplicate_token_index`` (once per repeat) and
    ``eligible_token_sequence_mismatch`` (the candidates' indexes are not just the
    eligible ones).
    """
    facts = manifest.select("table_id", F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.size("ocr_tokens").alias("n_ocr"), "ocr_tokens")
    tokens = facts.select("table_id", "width", "height", "n_ocr", F.posexplode_outer("ocr_tokens").alias("token_index", "source"))
    known = candidates.join(facts.select("table_id", "width", "height", "n_ocr"), "table_id")
    joined = known.join(tokens.select("table_id", "token_index", "source"), ["table_id", "token_index"], "left")
    found = joined.select(F.explode(token_issues(threshold, recognizer)).alias("issue"))
    inside = known.where("token_index >= 0 and token_index < n_ocr")
    per = candidates.groupBy("table_id").agg(F.count("*").alias("n"))
    repeats = inside.groupBy("table_id", "token_index").agg(F.count("*").alias("n"))
    again = repeats.where("n > 1").select((F.col("n") - 1).alias("n"), F.lit("duplicate_token_index").alias("issue"))
    eligible = facts.select("table_id", F.explode(eligible_tokens(F.col("ocr_tokens"), threshold, limit)).alias("token_index")).withColumn("expected", F.lit(1))
    both = per.join(facts.select("table_id"), "table_id", "left_semi").select("table_id").distinct()
    diff = repeats.join(eligible, ["table_id", "token_index"], "full").where("n is null or expected is null or n > 1").select("table_id").distinct().join(both, "table_id", "left_semi")
    one = lambda df, name: df.select(F.lit(name).alias("issue"))
    single = (
        found.unionByName(one(facts.join(per, "table_id", "left_anti"), "missing_sidecar"))
        .unionByName(one(per.join(facts, "table_id", "left_anti"), "sidecar_not_in_manifest"))
        .unionByName(one(per.join(facts.select("table_id"), "table_id", "left_semi").where(F.col("n") > limit), "maximum_candidates_exceeded"))
        .unionByName(one(diff, "eligible_token_sequence_mismatch"))
    )
    counts = single.groupBy("issue").agg(F.count("*").alias("n")).unionByName(again.groupBy("issue").agg(F.sum("n").alias("n")))
    return counts.groupBy("issue").agg(F.sum("n").alias("n"))


def select_explicit(df: DataFrame) -> DataFrame:
    """Issues and decision on explicit candidates, under the policy of that route (``validate_candidates``, ``decide``)."""
    return decide(validate_candidates(df, EXPLICIT), EXPLICIT)


def select_complete_table(df: DataFrame) -> DataFrame:
    """Issues and decision on candidates that are a model's complete table, under the policy of that route."""
    return decide(validate_candidates(df, COMPLETE_TABLE), COMPLETE_TABLE)


# The provenance a sidecar must state, whatever its run.
SIDECAR_PROVENANCE = {
    "gold_trigger_visible_to_proposal": False,
    "gold_text_visible_to_recognizer": False,
    "gold_geometry_visible_to_recognizer": False,
    "candidate_text_frozen_before_gold_matching": True,
    "restricted_evaluation_visible": False,
    "crop_geometry_source": "frozen_paddleocr_token_bbox_only",
    "logical_projection_bbox_forbidden": True,
    "role": "public_training_candidates_only",
    "trigger_source": "frozen_ocr_token_confidence",
}
# Members of provenance that repeat what the run's audit states, and the names there.
AUDITED_PROVENANCE = {
    "candidate_proposal_policy": "candidate_proposal_policy",
    "candidate_proposal_mode": "candidate_proposal_mode",
    "proposal_gate_threshold": "proposal_gate_threshold",
    "token_confidence_threshold": "token_confidence_threshold",
    "maximum_candidates_per_table": "maximum_candidates_per_table",
    "frozen_config_sha256": "frozen_config_sha256",
    "model_artifact_sha256": "model_artifact_sha256",
    "geometry_checkpoint_sha256": "geometry_checkpoint_sha256",
}
IMAGE_DIGEST = "input_image_sha256"


def _states(v: Column, path: str, expected) -> Column:
    """Whether a variant states just this value at a path; nothing and null state None."""
    held = F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant(held)
    if expected is None:
        return held.isNull() | (kind == "VOID")
    if isinstance(expected, bool):
        same = (kind == "BOOLEAN") & (F.try_variant_get(v, path, "boolean") == expected)
    elif isinstance(expected, (int, float)):
        same = kind.rlike("^(BIGINT|DOUBLE|DECIMAL)") & (F.try_variant_get(v, path, "double") == float(expected))
    else:
        same = (kind == "STRING") & (F.try_variant_get(v, path, "string") == str(expected))
    return F.coalesce(same, F.lit(False))


def audit_files(manifest: DataFrame, sidecars: DataFrame, audit: dict) -> DataFrame:
    """(issue, n): issues of whole sidecar files, beside those of their tokens (``audit_sidecars``).

    manifest: (table_id, image), rows as they came; sidecars: (path, key, text, issue) from
    ``files.json_directory``; audit: what the run states of itself. Provenance is compared
    member by member; an absent one is null.
    """
    given = {**SIDECAR_PROVENANCE, **{name: audit.get(a) for name, a in AUDITED_PROVENANCE.items()}}
    rows = manifest.groupBy("table_id").agg(F.count("*").alias("n"), F.first(f"image.{IMAGE_DIGEST}", ignorenulls=True).alias("digest"))
    whole = sidecars.where("issue is null").select(F.col("key").alias("table_id"), "text", F.try_parse_json("text").alias("v"))
    met = whole.join(rows, "table_id")
    code = lambda cond, name: F.when(F.coalesce(cond, F.lit(True)), name)
    own = [code(~_states(F.col("v"), f"$.provenance.{name}", value), f"provenance_{name}_mismatch") for name, value in given.items()]
    said = F.try_variant_get("v", f"$.provenance.{IMAGE_DIGEST}", "string")
    own.append(code(~said.eqNullSafe(F.col("digest")), f"provenance_{IMAGE_DIGEST}_mismatch"))
    listed = F.try_variant_get("v", "$.token_candidates", "array<variant>")
    own.append(F.when(has_forbidden_field(F.col("text")), "forbidden_target_field"))
    own.append(F.when(listed.isNull(), "token_candidates_not_list").when(~F.coalesce(F.try_variant_get("v", "$.proposal_count", "bigint") == F.size(listed), F.lit(False)), "proposal_count_mismatch"))
    found = met.select(F.explode(F.filter(F.array(*own), lambda x: x.isNotNull())).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))
    again = rows.where("n > 1").agg(F.sum(F.col("n") - 1).alias("n")).where("n > 0").select(F.lit("duplicate_manifest_sample_id").alias("issue"), "n")
    return found.unionByName(again).unionByName(sidecars.where("issue is not null").groupBy("issue").agg(F.count("*").alias("n")))


def integrity_checks(manifest: DataFrame, sidecars: DataFrame, candidates: DataFrame, audit: dict, expected_tables: int, recognizer: str) -> DataFrame:
    """(check, passed): the seven checks over a folder of sidecars. candidates: their tokens, as in ``audit_sidecars``."""
    issues = audit_files(manifest, sidecars, audit).unionByName(audit_sidecars(manifest.dropDuplicates(["table_id"]), candidates, float(audit.get("token_confidence_threshold", -1.0)), int(audit.get("maximum_candidates_per_table", -1)), recognizer))
    held = {r.issue: r.n for r in issues.groupBy("issue").agg(F.sum("n").alias("n")).collect()}
    keys = sidecars.where("issue is null").select(F.col("key").alias("table_id")).distinct()
    views = {r.n_views: r.n for r in view_histogram(candidates).collect()}
    checks = {
        "candidate_audit_pass": audit.get("status") == "PASS",
        "manifest_count": manifest.count() == expected_tables,
        "unique_sidecar_count": keys.count() == expected_tables,
        "all_sidecars_match_manifest": keys.join(manifest, "table_id", "left_anti").isEmpty() and manifest.join(keys, "table_id", "left_anti").isEmpty(),
        "zero_semantic_issues": not any(held.values()),
        "candidate_pool_nonempty": bool(views),
        "two_views_per_candidate": set(views) <= {2},
    }
    return manifest.sparkSession.createDataFrame(list(checks.items()), "check string, passed boolean")


def view_histogram(candidates: DataFrame) -> DataFrame:
    """(n_views, n): candidate tokens by their number of views; null views count as -1."""
    return candidates.groupBy(F.coalesce(F.size("candidates"), F.lit(-1)).alias("n_views")).agg(F.count("*").alias("n"))


def complete_candidates(df: DataFrame) -> DataFrame:
    """``df`` (output: JSON text of a model) with ``table``, its table as JSON, and ``status``.

    The table is the member ``canonical_table``, or else the whole output; it must be an
    object with a list of cells. An output with page members is refused whole.
    """
    v = F.try_parse_json("output")
    inner = F.try_variant_get(v, "$.canonical_table", "variant")
    whole = F.coalesce(inner, v)
    page = F.try_variant_get(v, "$.blocks", "variant").isNotNull() | F.try_variant_get(v, "$.page", "variant").isNotNull()
    listed = F.try_variant_get(whole, "$.cells", "array<variant>").isNotNull()
    status = F.when(page, "FULL_PAGE_OUTPUT_FORBIDDEN").when(F.coalesce(listed, F.lit(False)), "PASS").otherwise("OUTPUT_IS_NO_TABLE")
    return df.withColumn("status", status).withColumn("table", F.when(status == "PASS", F.to_json(whole)))


def route_provenance(producer: str, purpose: str, raw: Column, raw_sha: Column, release: str = "2026.08.12") -> Column:
    """The provenance of a candidate made from a raw table: raw is a struct with sample_id and input_image_sha256."""
    return F.struct(
        F.coalesce(raw["sample_id"], F.lit("")).alias("sample_id"),
        F.lit(producer).alias("producer"),
        F.lit(release).alias("producer_release"),
        F.lit(purpose).alias("purpose"),
        F.coalesce(raw["input_image_sha256"], F.lit("")).alias("input_image_sha256"),
        F.lit(False).alias("restricted_evaluation_visible"),
        raw_sha.alias("raw_state_sha256"),
    )


def replay(candidates: DataFrame, raw: DataFrame) -> DataFrame:
    """The raw rows to which candidates (table_id, raw_state_sha256) return, with ``bound``: whether the raw state (table_id, state, sha) is the one they were made from."""
    joined = candidates.select("table_id", "raw_state_sha256").join(raw, "table_id")
    bound = F.coalesce(F.col("raw_state_sha256") == F.col("sha"), F.lit(False))
    return joined.select("table_id", F.when(bound, F.col("state")).alias("state"), bound.alias("bound"))
