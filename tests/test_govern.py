import datetime
import json

from pyspark.sql import functions as F

import gridloom
from gridloom.operators import govern
from gridloom.plans import governance
from gridloom.sources import files

BASE = (1, 2, [("a", 0, 1, 0, 1, "A", "td", [0.0, 0.0, 10.0, 10.0], [0]), ("b", 0, 1, 1, 2, "B", "td", [10.0, 0.0, 20.0, 10.0], [1])])
PROV = ("s", "p", "1", "use", "x" * 64, False, '{"a":1}')
SCHEMA = f"id string, raw {govern.TABLE}, cand {govern.TABLE}, ocr array<string>, provenance struct<sample_id:string,producer:string,producer_release:string,purpose:string,input_image_sha256:string,restricted_evaluation_visible:boolean,json:string>"


def change(**kw):
    rows, cols, cells = BASE
    return (kw.get("rows", rows), kw.get("cols", cols), kw.get("cells", cells))


def issues(spark, cand, policy=govern.Policy("t"), prov=PROV, ocr=("A", "B"), raw=BASE):
    df = spark.createDataFrame([("x", raw, cand, list(ocr) if ocr else None, prov)], SCHEMA)
    return govern.validate_candidates(df, policy).first().issues


def edit(i, **kw):
    names = ["cell_id", "row_start", "row_end", "col_start", "col_end", "text", "tag", "bbox", "tokens"]
    cells = [list(c) for c in BASE[2]]
    for k, v in kw.items():
        cells[i][names.index(k)] = v
    return change(cells=[tuple(c) for c in cells])


def test_clean(spark):
    assert issues(spark, BASE) == []


def test_grid_issues(spark):
    assert issues(spark, edit(1, col_start=0)) == ["CANONICAL_GRID_OVERLAP"]
    assert "CANONICAL_SHAPE_INVALID" in issues(spark, change(rows=2))
    assert issues(spark, change(cells=[]))[:2] == ["CANONICAL_CELLS_MISSING", "CANONICAL_SHAPE_INVALID"]
    assert issues(spark, edit(1, cell_id="a")) == ["CELL_ID_DUPLICATED"]
    assert issues(spark, edit(1, cell_id=None)) == []
    assert issues(spark, edit(0, cell_id="1") [:2] + ([edit(0, cell_id="1")[2][0], edit(1, cell_id=None)[2][1]],)) == ["CELL_ID_DUPLICATED"]
    assert "CELL_INTERVAL_INVALID" in issues(spark, edit(0, row_end=0))
    assert issues(spark, edit(0, bbox=[0.0, 0.0, float("nan"), 1.0])) == ["GEOMETRY_MISSING_OR_INVALID"]


def test_token_issues(spark):
    assert issues(spark, edit(1, tokens=[], text="q"), govern.EXPLICIT) == ["CANDIDATE_TEXT_NOT_OCR_GROUNDED", "TOKEN_COVERAGE_CHANGED"]
    assert issues(spark, edit(1, tokens=None)) == ["TOKEN_OWNERSHIP_PARTIAL"]
    assert "CANDIDATE_TOKEN_OWNERSHIP_DUPLICATED" in issues(spark, edit(1, tokens=[0]))
    assert "TOKEN_INDEX_OUT_OF_RANGE" in issues(spark, BASE, ocr=("A",))
    none = change(cells=[(*c[:8], None) for c in BASE[2]])
    assert issues(spark, none, govern.EXPLICIT, raw=none) == ["TOKEN_OWNERSHIP_REQUIRED"]
    assert issues(spark, none, raw=none, ocr=None) == []


def test_tokens_that_compose(spark):
    """Tokens are joined before they are normalised: a mark at the begin of one composes with the end of the one before."""
    cells = change(cells=[(*BASE[2][0][:5], "\u00e9", *BASE[2][0][6:8], [0, 1])])
    cells = (1, 1, cells[2])
    assert issues(spark, cells, govern.EXPLICIT, ocr=("e", "\u0301"), raw=cells) == []


def test_routes(spark):
    assert gridloom.select_explicit is govern.select_explicit and set(gridloom.__all__) <= set(dir(gridloom))
    df = spark.createDataFrame([("x", BASE, BASE, ["A", "B"], PROV, "r", "c", 0.5, "NONTERMINAL_DEVELOPMENT", "p")], SCHEMA + ", raw_sha string, cand_sha string, gain double, gain_source string, protocol_id string")
    for select in (govern.select_explicit, govern.select_complete_table):
        assert select(df).first().decision == "ACCEPT" and select(df.withColumn("cand_sha", F.lit(None).cast("string"))).first().decision == "ROLLBACK"
        assert select(df.withColumn("ocr", F.array(F.lit("Z"), F.lit("B")))).first().decision == "ROLLBACK"


def test_sidecar_files(spark, tmp_path):
    audit = {"status": "PASS", "candidate_proposal_policy": "low", "candidate_proposal_mode": None, "proposal_gate_threshold": 0.5, "token_confidence_threshold": 0.7, "maximum_candidates_per_table": 5, "frozen_config_sha256": "c", "model_artifact_sha256": "m"}
    stated = {**govern.SIDECAR_PROVENANCE, **{k: audit.get(v) for k, v in govern.AUDITED_PROVENANCE.items()}, "input_image_sha256": "i"}
    views = [{"view": "tight", "text": "A", "confidence": 0.5, "model_id": "r"}, {"view": "padded", "text": "A", "confidence": 0.5, "model_id": "r"}]
    token = {"token_index": 0, "source_text": "A", "source_confidence": 0.2, "absolute_bbox": [0, 0, 5, 5], "candidates": views}
    base = {"sample_id": "t", "proposal_count": 1, "token_candidates": [token], "provenance": stated}
    schema = "table_id string, token_index int, source_text string, source_confidence double, absolute_bbox array<double>, candidates array<struct<view:string,text:string,confidence:double,model_id:string>>"
    tokens = spark.createDataFrame([("t", 0, "A", 0.2, [0.0, 0.0, 5.0, 5.0], [tuple(v.values()) for v in views])], schema)
    manifest = spark.createDataFrame([("t", (10, 10, "i"), [("A", 0.2, [0.0, 0.0, 5.0, 5.0])])], "table_id string, image struct<width:int,height:int,input_image_sha256:string>, ocr_tokens array<struct<text:string,confidence:double,bbox:array<double>>>")

    def found(doc, m=manifest):
        (tmp_path / "a.json").write_text(json.dumps(doc))
        return {r.issue: r.n for r in govern.audit_files(m, files.json_directory(spark, str(tmp_path)), audit).collect()}

    assert found(base) == {}
    checks = govern.integrity_checks(manifest, files.json_directory(spark, str(tmp_path)), tokens, audit, 1, "r").collect()
    assert len(checks) == 7 and all(c.passed for c in checks)
    assert found(base | {"provenance": {}}).keys() == {f"provenance_{k}_mismatch" for k, v in stated.items() if v is not None}
    assert found(base | {"provenance": stated | {"logical_projection_bbox_forbidden": "true", "token_confidence_threshold": 0.8, "candidate_proposal_mode": "x", "input_image_sha256": "j"}}).keys() == {f"provenance_{k}_mismatch" for k in ("logical_projection_bbox_forbidden", "token_confidence_threshold", "candidate_proposal_mode", "input_image_sha256")}
    assert found(base | {"x": [{"gold_text": 1}], "proposal_count": 3}) == {"forbidden_target_field": 1, "proposal_count_mismatch": 1}
    assert found(base | {"token_candidates": {}}) == {"token_candidates_not_list": 1}
    assert found(base, manifest.union(manifest)) == {"duplicate_manifest_sample_id": 1}
    (tmp_path / "b.json").write_text("{broken")
    assert found(base) == {"invalid_sidecar_json": 1}
    failed = {c.check for c in govern.integrity_checks(manifest, files.json_directory(spark, str(tmp_path)), tokens.limit(0), audit | {"status": "FAIL"}, 2, "r").collect() if not c.passed}
    assert failed == {"candidate_audit_pass", "manifest_count", "unique_sidecar_count", "zero_semantic_issues", "candidate_pool_nonempty"}


def test_provenance(spark):
    assert issues(spark, BASE, prov=None) == ["PROVENANCE_MISSING"]
    assert issues(spark, BASE, prov=(" ", *PROV[1:5], True, "Private-Evaluation set")) == ["PROVENANCE_RESTRICTED_EVALUATION_REFERENCE_FORBIDDEN", "PROVENANCE_RESTRICTED_EVALUATION_VISIBILITY_NOT_FALSE", "PROVENANCE_SAMPLE_ID_MISSING"]


def test_decisions(spark):
    dev = "NONTERMINAL_DEVELOPMENT"
    rows = [("a", None, [], 1.0, dev, "p"), ("a", "a", ["X"], None, None, None), ("a", "b", ["X"], 1.0, dev, "p"), ("a", "b", [], None, None, None), ("a", "b", [], 1.0, "other", "p"), ("a", "b", [], float("nan"), dev, "p"), ("a", "b", [], 0.0, dev, "p"), ("a", "b", [], 0.1, dev, "p")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw_sha string, cand_sha string, issues array<string>, gain double, gain_source string, protocol_id string")
    got = [(r.decision, r.reasons[-1]) for r in govern.decide(df, govern.Policy("t")).orderBy("i").collect()]
    assert got == [("ROLLBACK", "CANDIDATE_MISSING"), ("PASS_THROUGH", "IDENTICAL_STATE"), ("ROLLBACK", "X"), ("ROLLBACK", "EXPECTED_GAIN_MISSING"), ("ROLLBACK", "EXPECTED_GAIN_EVIDENCE_INVALID"), ("ROLLBACK", "EXPECTED_GAIN_EVIDENCE_INVALID"), ("ROLLBACK", "EXPECTED_GAIN_INSUFFICIENT"), ("ACCEPT", "VALID_AND_POSITIVE_EXPECTED_GAIN")]


def test_explicit(spark):
    cells = spark.createDataFrame([("t", c[0], "th", c[7], c[8]) for c in BASE[2]], "table_id string, cell_id string, tag string, bbox array<double>, tokens array<int>")
    ocr = spark.createDataFrame([("t", [("A", [1.0, 1.0, 2.0, 2.0]), ("B", [11.0, 1.0, 12.0, 2.0])])], "table_id string, ocr array<struct<text:string,bbox:array<double>>>")
    part = "table_id string, cell_id string, row_start int, row_end int, col_start int, col_end int, source_cell_ids array<string>, tokens array<int>"
    run = lambda rows: [x.collect() for x in govern.explicit_candidates(cells, ocr, spark.createDataFrame(rows, part))]
    made, refused = run([("t", "m", 0, 1, 0, 2, ["a", "b"], None)])
    assert not refused and (made[0].text, made[0].tag, made[0].bbox, made[0].tokens) == ("AB", "th", [0.0, 0.0, 20.0, 10.0], [0, 1])
    for rows, why in (
        ([("t", "m", 0, 1, 0, 1, ["a"], None)], "TOKENS_DO_NOT_COVER"),
        ([("t", "m", 0, 1, 0, 2, ["a", "z"], None)], "SOURCE_UNKNOWN"),
        ([("t", "m", 0, 1, 0, 2, ["z"], None)], "SOURCE_UNKNOWN"),
        ([("t", "m", 0, 1, 0, 2, ["a", "a"], None)], "SOURCES_NOT_UNIQUE"),
        ([("t", "m", 0, 1, 0, 2, ["a", "b"], [0])], "SOURCES_DO_NOT_BIND_TOKENS"),
        ([("t", "m", 0, 1, 0, 2, ["a"], [1])], "TOKEN_NOT_OWNED_BY_SOURCES"),
    ):
        made, refused = run(rows)
        assert not made and [r.reason for r in refused] == [why]


def test_assembly(spark):
    block = [("p", "x"), ("table", "{}"), ("f", "y")]
    rows = [(0, block, 1, '{"canonical_table": {}}'), (1, block, 0, '{"canonical_table": {}}'), (2, block, 7, "{}"), (3, block, 1, '{"canonical_table": {}, "blocks": []}'), (4, block, 1, "{}"), (5, None, 1, "{}")]
    df = spark.createDataFrame(rows, "i int, blocks array<struct<type:string,body:string>>, table_index int, output string")
    got = govern.assemble_table_only(df).orderBy("i").collect()
    assert [r.status for r in got] == ["PASS", "BLOCK_IS_NO_TABLE", "TABLE_INDEX_OUT_OF_RANGE", "FULL_PAGE_OUTPUT_FORBIDDEN", "OUTPUT_IS_NO_TABLE", "PAGE_BLOCKS_MISSING"]
    assert got[0].frozen and got[0].after[1].body == rows[0][3] and got[0].after[0].body == "x"


def test_sidecars(spark):
    manifest = spark.createDataFrame([("t", (100, 100), [("A", 0.2, [0.0, 0.0, 5.0, 5.0]), ("B", 0.9, [0.0, 0.0, 5.0, 5.0]), ("C", 0.3, [0.0, 0.0, 5.0, 5.0])]), ("none", (1, 1), [])], "table_id string, image struct<width:int,height:int>, ocr_tokens array<struct<text:string,confidence:double,bbox:array<double>>>")
    schema = "table_id string, token_index int, source_text string, source_confidence double, absolute_bbox array<double>, candidates array<struct<view:string,text:string,confidence:double,model_id:string>>"
    views = [("tight", "A", 0.5, "m"), ("padded", "", 0.5, "m")]
    audit = lambda rows: {r.issue: r.n for r in govern.audit_sidecars(manifest, spark.createDataFrame(rows, schema), 0.5, 9, "m").collect()}
    clean = [("t", 0, "A", 0.2, [0.0, 0.0, 5.0, 5.0], views), ("t", 2, "C", 0.3, [0.0, 0.0, 5.0, 5.0], views)]
    assert audit(clean) == {"missing_sidecar": 1}
    got = audit([("t", 0, "Z", 0.6, [0.0, 0.0, 500.0, 5.0], [("tight", "A", None, "q")]), ("t", 0, "A", 0.2, None, None), ("t", 9, "", 0.1, None, None), ("u", 0, "", 0.1, None, None)])
    assert got == {"missing_sidecar": 1, "sidecar_not_in_manifest": 1, "invalid_token_index": 1, "duplicate_token_index": 1, "source_confidence_not_below_threshold": 1, "source_text_mismatch": 1, "bbox_out_of_image": 1, "bbox_source_mismatch": 1, "view_contract_mismatch": 1, "invalid_recognition_confidence": 1, "recognizer_model_mismatch": 1, "invalid_bbox": 1, "candidate_views_not_list": 1, "eligible_token_sequence_mismatch": 1}
    tokens = manifest.where("table_id = 't'").select(govern.eligible_tokens(F.col("ocr_tokens"), 0.5, 1).alias("a"), govern.eligible_tokens(F.col("ocr_tokens"), 0.5, -1).alias("b"), govern.eligible_tokens(F.col("ocr_tokens"), -1.0, 5).alias("c")).first()
    assert (tokens.a, tokens.b, tokens.c) == ([0], [0], [])


def test_forbidden(spark):
    docs = ['{"a": [{"gold_text": 1}]}', '{"a": "gold_text"}', "{broken gold_text", None, '{"target_text": null}']
    got = [r[0] for r in spark.createDataFrame([(d,) for d in docs], "d string").select(govern.has_forbidden_field(F.col("d"))).collect()]
    assert got == [True, False, False, False, True]


def test_complete_and_replay(spark):
    outputs = ['{"canonical_table": {"cells": []}}', '{"cells": [1]}', '{"cells": [], "page": 1}', '{"cells": 1}', "{x", None, "[]"]
    got = [(r.status, r.table) for r in govern.complete_candidates(spark.createDataFrame([(o,) for o in outputs], "output string")).collect()]
    assert got == [("PASS", '{"cells":[]}'), ("PASS", '{"cells":[1]}'), ("FULL_PAGE_OUTPUT_FORBIDDEN", None)] + [("OUTPUT_IS_NO_TABLE", None)] * 4
    raw = spark.createDataFrame([("t", "state", "s"), ("u", "state", "s")], "table_id string, state string, sha string")
    made = spark.createDataFrame([("t", "s"), ("u", "x")], "table_id string, raw_state_sha256 string")
    assert {tuple(r) for r in govern.replay(made, raw).collect()} == {("t", "state", True), ("u", None, False)}
    p = spark.createDataFrame([((None, "i"),)], "p struct<sample_id:string,input_image_sha256:string>").select(govern.route_provenance("m", "u", F.col("p"), F.lit("h")).alias("o")).first().o
    assert (p.sample_id, p.producer, p.restricted_evaluation_visible) == ("", "m", False)


def route_manifest(spark, path):
    """A manifest whose latest rows lack the digest for b, c and d; the query over it."""
    schema = "sample_id string, image struct<width:int,height:int,input_image_sha256:string>, ocr_tokens array<struct<text:string,confidence:double,bbox:array<double>>>, registered_at timestamp, withdrawn_at timestamp"
    day = lambda n: datetime.datetime(2026, 1, n)
    rows = [("A", (1, 1, "x" * 64), [], day(1), None), ("b", (1, 1, None), [], day(1), None), ("c", (1, 1, " \t"), None, day(1), None), (" D", None, [], day(2), None), ("d", (1, 1, "y" * 64), [], day(1), None), ("e", (1, 1, ""), [], day(1), None), ("E", (1, 1, "z" * 64), [], day(2), None), (None, None, [], day(1), None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/table_manifest.parquet")
    return governance.route_issues(spark, str(path))


ROUTE_ISSUES = [(t, "PROVENANCE_INPUT_IMAGE_SHA256_MISSING") for t in ("b", "c", "d")]


def test_route_issues(spark, tmp_path):
    assert sorted(map(tuple, route_manifest(spark, tmp_path).collect())) == ROUTE_ISSUES


def test_route_issues_are_written(spark, tmp_path):
    route_manifest(spark, tmp_path).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.columns == ["table_id", "issue"] and sorted(map(tuple, out.collect())) == ROUTE_ISSUES
