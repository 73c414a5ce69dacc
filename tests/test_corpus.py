import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gridloom.functions import ranking
from gridloom.operators import corpus, generate, isolate, latent, plan, seal
from gridloom.sources import files

COVER = [("hard_keep", "KEEP", "a", 3, 2, 1, 0), ("hard_keep", "KEEP", "b", 3, 1, 1, 1), ("single_minimal_edit", "EDIT", "x", 4, 2, 1, 1), ("single_minimal_edit", "EDIT", "y", 2, 1, 1, 0), ("exact_keep", "KEEP", "p", 5, 3, 2, 0), ("complex_correction", "EDIT", "q", 0, 0, None, 0)]
SCHEMA = "category string, gate_label string, phenomenon string, requested_count int, train_count int, development_count int, holdout_count int"


def test_expansion_and_quotas(spark):
    rows = plan.expand_coverage(spark.createDataFrame(COVER, SCHEMA))
    assert rows.count() == 17 and rows.where("phenomenon = 'q'").count() == 0
    assert {(r.phenomenon, r.role): r.n for r in plan.quotas(rows).collect()}[("p", "train")] == 3
    with pytest.raises(Exception, match="counts of coverage differ"):
        plan.expand_coverage(spark.createDataFrame([("c", "K", "p", 2, 1, 0, 0)], SCHEMA)).collect()
    assert plan.expand_coverage(spark.createDataFrame([], SCHEMA)).count() == 0


def test_flow():
    edges = {("a", "x"): 2, ("a", "y"): 1, ("b", "x"): 2}
    got = plan.select_flow(edges, {"a": 2, "b": 1}, {"x": 2, "y": 1})
    assert sum(n for (a, _), n in got.items() if a == "a") == 2 and sum(n for (_, b), n in got.items() if b == "y") == 1
    assert all(0 <= n <= edges[e] for e, n in got.items())
    with pytest.raises(ValueError):
        plan.select_flow(edges, {"a": 1}, {"x": 2})
    with pytest.raises(ValueError):
        plan.select_flow(edges, {"b": 1}, {"y": 1})


def test_roles_meet_quotas(spark):
    requests = plan.expand_coverage(spark.createDataFrame(COVER, SCHEMA))
    pairs = plan.pair_members(requests).withColumn("family_id", F.format_string("%s%s%d", "hard", "edit", "edge_rank"))
    assert pairs.count() == 6 and pairs.select("hard", "hard_rank").distinct().count() == 6 and pairs.select("edit", "edit_rank").distinct().count() == 6
    singles = spark.createDataFrame([(f"p{i}", "exact_keep", "p") for i in range(5)], "family_id string, category string, phenomenon string")
    roles = plan.assign_roles(pairs, singles, requests)
    members = pairs.select("family_id", F.explode(F.array("hard", "edit")).alias("phenomenon")).unionByName(singles.drop("category")).join(roles, "family_id")
    got = {(r.phenomenon, r.role): r["count"] for r in members.groupBy("phenomenon", "role").count().collect()}
    assert got == {(r.phenomenon, r.role): r.n for r in plan.quotas(requests).collect()}
    with pytest.raises(ValueError):
        plan.pair_members(requests.where("phenomenon != 'y'"))


def test_order_key_is_canonical_json(spark):
    want = hashlib.sha256(json.dumps({"namespace": plan.PAIRING, "category": "c", "phenomenon": "ü", "ordinal": 3}, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert spark.range(1).select(plan.order_key(F.lit("c"), F.lit("ü"), F.lit(3))).first()[0] == want


@pytest.mark.parametrize("phenomenon", ["missing_merge", "extra_split", "span_extent_error", "row_or_column_assignment_error", "over_merge", "header_band", "mixed_spans", "empty_cells"])
def test_generation(phenomenon):
    for cols in (2, 3, 5, 14):
        g = generate.gold(7, 7, cols, phenomenon, "single_minimal_edit")
        held = [(r, c) for x in g.cells for r in range(x.row, x.row + x.rowspan) for c in range(x.col, x.col + x.colspan)]
        assert len(held) == len(set(held)) == 7 * cols
        assert sorted(t for x in g.cells for t in x.tokens) == sorted(g.tokens)
        assert g.sha() == generate.gold(7, 7, cols, phenomenon, "single_minimal_edit").sha()
        try:
            p, ops = generate.prior(g, phenomenon, "single_minimal_edit")
        except ValueError:
            continue
        assert ops and p.sha() != g.sha()


def test_isolated_families(spark):
    families = spark.createDataFrame([(i, "plain", "exact_keep") for i in range(6)] + [(i, "header_band", "hard_keep") for i in range(6, 12)], "family_index int, phenomenon string, category string")
    got = sorted(generate.isolate_families(families, 1000).collect())
    assert len(got) == 12 and all(len({f[s] for f in got}) == 12 for s in generate.SIGNATURES)
    # One family after another, each with the first seed that no signature before it forbids.
    used = set()
    for i, r in enumerate(got):
        tries = (generate.signatures(1000 + 100_000 * i + k, r.phenomenon, r.category) for k in range(100))
        k, own = next((k, s) for k, t in enumerate(tries) if not (s := {(n, t[n]) for n in generate.SIGNATURES}) & used)
        used |= own
        assert (r.nonce, r.base_seed) == (k, 1000 + 100_000 * i + k)
    assert generate.isolate_families(families.limit(0), 1000).count() == 0


def test_families_that_collide(spark, monkeypatch):
    # Shapes are few here: most first seeds collide, and all families still differ.
    monkeypatch.setattr(generate, "signatures", lambda seed, p, c, assets: {"rows": 1, "columns": 1, **dict.fromkeys(generate.SIGNATURES, str(seed % 7 if seed % 100_000 < 7 else seed))})
    families = spark.createDataFrame([(i, "p", "c") for i in range(9)], "family_index int, phenomenon string, category string")
    got = generate.isolate_families(families, 0).collect()
    assert len({r.structure_sha256 for r in got}) == 9


def test_latent_plan(spark, tmp_path):
    requests = plan.expand_coverage(spark.createDataFrame(COVER, SCHEMA))
    families = latent.create_plan(requests, 5000, "d")
    path = str(tmp_path / "plan")
    report = latent.write_plan(families, requests, path)
    assert report["status"] == "PASS" and report["planned_records"] == 17 and report["planned_families"] == 11
    again = latent.verify_plan(spark, path, requests)
    assert again["status"] == "PASS" and not again["mismatches"] and not again["disagreements"]
    with pytest.raises(Exception, match="exists"):
        latent.write_plan(families, requests, path)
    held = latent.read_plan(spark, f"{path}/plan")
    members = latent.member_rows(held)
    assert sorted(r.sample_index for r in members.select("sample_index").collect()) == list(range(17))
    # Each fault shows in its own check.
    faults = lambda df, req=requests: {r.check for r in latent.audit_plan(df, req).where("not passed").collect()}
    assert faults(held) == set()
    assert "record_count" in faults(held.where("family_index > 0"))
    assert {"role_counts", "phenomenon_role_counts"} <= faults(held.withColumn("role", F.lit("train")))
    assert faults(held.withColumn("terminal_inputs_used", F.col("family_index") == 0)) == {"terminal_nonuse"}
    assert faults(held.withColumn("structure_sha256", F.lit("x"))) == {"cross_role_signature_overlap"}
    assert faults(held.withColumn("component_id", F.lit("x"))) == {"component_single_role"}
    assert faults(held.withColumn("family_id", F.lit("x"))) == {"family_single_role"}
    assert "counterfactual_groups" in faults(held.withColumn("members", F.transform("members", lambda m: F.struct(F.lit("hard_keep").alias("category"), m["phenomenon"], m["sample_index"], m["sample_id"]))))
    assert latent.verify_plan(spark, path, requests.where("phenomenon != 'p'"))["disagreements"]
    assert latent.overlaps(held.withColumn("text_sha256", F.lit("t"))).select("signal", "roles").collect() == [("text_sha256", "development,holdout,train")]


def test_corpus(spark, tmp_path):
    requests = plan.expand_coverage(spark.createDataFrame(COVER, SCHEMA))
    families = latent.create_plan(requests, 7000, "d")
    path = str(tmp_path / "corpus")
    report = corpus.build(families, requests, path)
    assert report["status"] == "PASS" and report["generated"] == 17 and all(report["checks"][g] for g in corpus.GATES)
    assert corpus.verify(spark, path, requests)["status"] == "PASS"
    recs = spark.read.parquet(f"{path}/records")
    pairs = recs.where("counterfactual_group_id is not null").groupBy("counterfactual_group_id").agg(F.countDistinct("gold_sha256").alias("g"), F.countDistinct("prior_sha256").alias("p")).collect()
    assert len(pairs) == 6 and all((r.g, r.p) == (1, 2) for r in pairs)
    gates = lambda df, req=requests: {g for g, ok in corpus.gates(df, req).items() if not ok}
    assert gates(recs.limit(16)) >= {"count", "categories", "roles"}
    assert gates(recs.withColumn("prior_sha256", F.col("gold_sha256"))) == {"contract"}
    assert "overlap" in gates(recs.withColumn("gold_sha256", F.lit("x")).withColumn("prior_sha256", F.when(F.col("gate_label") == "KEEP", "x").otherwise("y")))
    assert "pairs" in gates(recs.withColumn("counterfactual_group_id", F.coalesce("counterfactual_group_id", F.lit("lone"))))
    with pytest.raises(Exception, match="exists"):
        corpus.build(families, requests, path)
    # A seed whose corruption is impossible fails the corpus; it is not replaced.
    with pytest.raises(RuntimeError, match="contract"):
        corpus.build(latent.create_plan(requests, 5000, "d"), requests, str(tmp_path / "failed"))
    part = next((tmp_path / "corpus" / "roles").glob("part-*.json"))
    part.with_name(f".{part.name}.crc").unlink()
    part.write_text(part.read_text().replace("train", "holdout"))
    again = corpus.verify(spark, path, requests)
    assert again["status"] == "FAIL" and again["mismatches"] and again["unlisted"]


def test_ranks_in_order(spark):
    rows = [(i % 3 if i % 2 else 0, f"k{i * 7 % 50:02d}") for i in range(50)]
    df = spark.createDataFrame(rows + [(None, "z")], "g int, k string")
    for size in (1000, 5):
        got = {(r.g, r.k): r["rank"] for r in ranking.ranked_in_order(df, ["g"], ["k"], rows=size).collect()}
        want = {(g, k): sorted(x for h, x in rows if h == g).index(k) for g, k in rows}
        assert got == {**want, (None, "z"): 0}
        by_hash = ranking.ranked(df.where("g is not null"), "g", ["k"], rows=size).collect()
        assert all(sorted(r["rank"] for r in by_hash if r.g == g) == list(range(sum(h == g for h, _ in rows))) for g in range(3))


def test_isolation(spark):
    zero, one = "0" * 15 + "1", "8" + "0" * 14 + "1"
    row = lambda i, role, h, t, s, g: (i, role, h, i, i, i, s, t, g, {"fam": "f"})
    rows = [row("a", "train", zero, "t", "s1", "g1"), row("b", "dev", one, "t", "s2", "g2"), row("c", "dev", "f" * 16, "t", "s1", "g1"), row("d", "train", zero, None, "s1", None), row("e", "dev", None, "t", "s", "g")]
    sigs = spark.createDataFrame(rows, "sample_id string, role string, perceptual_hash string, image_sha256 string, pixel_sha256 string, table_sha256 string, structure_sha256 string, text_sha256 string, geometry_sha256 string, families map<string,string>")
    assert [(r.first, r.second, r.distance) for r in isolate.near_overlaps(sigs).collect()] == [("a", "b", 1)]
    assert isolate.exact_overlaps(sigs).count() == 0 and isolate.family_overlaps(sigs).count() == 1
    assert {r.signal: r.n_members for r in isolate.duplicate_members(sigs).collect()}["text_sha256"] == 4
    same = sigs.withColumn("table_sha256", F.lit("x"))
    assert [(r.roles, r.sample_ids) for r in isolate.exact_overlaps(same).collect()] == [("dev,train", "a,b,c,d,e")]
    assert {r.component for r in isolate.duplicate_components(same, ("table_sha256",)).collect()} == {"a"}
    chain = spark.createDataFrame([(f"{i:03d}", "r", f"v{i // 2}", f"w{(i + 1) // 2}") for i in range(40)], "sample_id string, role string, x string, y string")
    assert {(r.component, r.component_size) for r in isolate.duplicate_components(chain, ("x", "y")).collect()} == {("000", 40)}
    assert isolate.audit(sigs).first().status == "FAIL" and isolate.audit(sigs.limit(0)).first().status == "PASS"


def test_components_over_all_signals(spark, tmp_path):
    from gridloom.plans import isolation

    row = lambda i, s, t, g: (i, "train", "1", f"i{i}", f"p{i}", f"t{i}", s, t, g, {"fam": "f"}, 1)
    rows = [row("a", "s1", "t1", "g1"), row("b", "s1", "t2", "g2"), row("c", "s2", "t2", "g3"), row("d", "s3", "t3", "g3"), row("e", "s4", None, "g4"), row("f", "s5", None, "g5")]
    spark.createDataFrame(rows, "sample_id string, role string, perceptual_hash string, image_sha256 string, pixel_sha256 string, table_sha256 string, structure_sha256 string, text_sha256 string, geometry_sha256 string, families map<string,string>, registered_at bigint").write.parquet(str(tmp_path / "table_signatures.parquet"))
    got = isolation.QUERIES["duplicate_components_all"](spark, str(tmp_path))
    assert {(r.sample_id, r.component, r.component_size) for r in got.collect()} == {("a", "a", 4), ("b", "a", 4), ("c", "a", 4), ("d", "a", 4), ("e", "e", 1), ("f", "f", 1)}


def test_generation_grows_with_the_records(spark, tmp_path):
    from gridloom.plans import corpus

    kinds = [("exact_keep", "plain_grid", 40), ("hard_keep", "wide_span", 400), ("single_minimal_edit", "extra_merge", 5), ("other", "plain_grid", 3), ("exact_keep", None, 2)]
    rows = [(f"{c}-{p}-{i}", c, p, (" Train", "holdout")[i % 2], i) for c, p, n in kinds for i in range(n)]
    rows.append((rows[0][0], "exact_keep", "plain_grid", "train", -1))
    spark.createDataFrame(rows, "sample_id string, category string, phenomenon string, role string, revised_at bigint").write.parquet(str(tmp_path / "table_records.parquet"))
    got = corpus.QUERIES["generated_tables"](spark, str(tmp_path)).toPandas()
    assert got.groupby(["category", "phenomenon"]).size().to_dict() == {(c, p): n for c, p, n in kinds[:3]}
    assert got.base_seed.is_unique and got.error.isna().all()


def test_seals(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"x\r\n")
    good = hashlib.sha256(b"x\r\n").hexdigest()
    (tmp_path / "a.sha256").write_text(f"{good}  a.md\n")
    (tmp_path / "empty.sha256").write_text(" \n")
    (tmp_path / "n.seal.json").write_text(json.dumps({"artifact": "gone.md", "artifact_sha256": good}))
    v = seal.verify_seals(spark, str(tmp_path))
    assert {(r.artifact, r.status, r.crlf) for r in v.collect()} == {("a.md", "MATCH", True), ("gone.md", "MISSING", None)}
    assert seal.seal_status(v) == "BLOCKED_MISSING_ARTIFACT"
    (tmp_path / "z.md").write_text("0\u0420", encoding="utf-8")  # its bytes hold 0D 0A only across digits
    (tmp_path / "z.sha256").write_text("0  z.md\n")
    assert seal.verify_seals(spark, str(tmp_path)).where("artifact = 'z.md' and not crlf").count() == 1
    (tmp_path / "z.sha256").unlink()
    (tmp_path / "a.md").write_bytes(b"y")
    assert seal.seal_status(seal.verify_seals(spark, str(tmp_path))) == "BLOCKED_CONTENT_MISMATCH"


def test_train_gate(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("{}\n")
    gate = lambda: seal.train_ready(spark, str(tmp_path))
    assert gate() == "TRAIN_READY_SEAL_MISSING"
    body = {"status": "TRAIN_READY_SEALED", "training_authorized": True, "manifest": {"path": "m.jsonl", "sha256": hashlib.sha256(b"{}\n").hexdigest()}, "builder_verifier_agree": True, "all_hard_gates_passed": True}
    for change, want in (({}, "READY"), ({"status": "x"}, "TRAIN_READY_STATUS_INVALID"), ({"training_authorized": 1}, "TRAINING_AUTHORIZATION_MISSING"), ({"manifest": {"path": "../m", "sha256": "0"}}, "TRAIN_READY_MANIFEST_REFERENCE_INVALID"), ({"manifest": {"path": "q", "sha256": "0"}}, "TRAIN_READY_MANIFEST_MISSING"), ({"manifest": {"path": "m.jsonl", "sha256": "0"}}, "TRAIN_READY_MANIFEST_HASH_MISMATCH"), ({"builder_verifier_agree": None}, "INDEPENDENT_VERIFIER_NOT_CONFIRMED"), ({"all_hard_gates_passed": False}, "HARD_GATES_NOT_CONFIRMED")):
        (tmp_path / "TRAIN_READY_SEAL.json").write_text(json.dumps(body | change))
        assert gate() == want


def test_checksums(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x").write_text("1")
    files.write_checksums(seal.checksums(spark, str(tmp_path)), str(tmp_path / "out"))
    expected = spark.createDataFrame([("d/x", hashlib.sha256(b"1").hexdigest().upper()), ("d/y", "0")], "path string, sha256 string")
    assert {(r.path, r.status) for r in seal.verify_checksums(spark, str(tmp_path), expected).collect()} == {("d/x", "MATCH"), ("d/y", "MISSING")}
    df = spark.range(50).repartition(7)
    line = F.col("id").cast("string")
    assert seal.order_free_checksum(df, line).first() == seal.order_free_checksum(df.orderBy(F.desc("id")), line).first()
    assert seal.order_free_checksum(df.limit(0), line).first().n_lines == 0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for name, body in {"a": '{"sample_id": "1"}', "b": '{"sample_id": "1"}', "c": "[1]", "d": "{x", "e": "{}"}.items():
        (tmp_path / "s" / f"{name}.json").write_text(body)
    got = {r.path: r.issue for r in files.json_directory(spark, str(tmp_path / "s")).collect()}
    assert got == {"a.json": None, "b.json": "duplicate_sample_id", "c.json": "invalid_sidecar_json", "d.json": "invalid_sidecar_json", "e.json": "missing_sample_id"}
    inventory = spark.createDataFrame([("s/c.json", hashlib.sha256(b"[1]").hexdigest(), 3), ("s/c.json", "0", 3), ("s/c.json", "0", 4), ("/etc/x", "0", 1), ("C:\\x", "0", 1), ("s/../x", "0", 1), ("s/q", "0", 1)], "path string, sha256 string, bytes bigint")
    assert sorted(r.status for r in files.check_assets(spark, str(tmp_path), inventory).collect()) == ["ASSET_MISSING", "HASH_MISMATCH", "HOST_PATH_PROHIBITED", "HOST_PATH_PROHIBITED", "HOST_PATH_PROHIBITED", "OK", "SIZE_MISMATCH"]
    assert [files.safe_path(p) for p in ("a/b", "/a", "a/../b", "c:x", "")] == [True, False, False, False, False]
    files.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_jsonl(spark.range(1), str(tmp_path / "j"))
    assert files.jsonl(spark, str(tmp_path / "j"), "a int, b string").first().a == 1
    (tmp_path / "c.csv").write_text("category,gate_label,phenomenon,requested_count,train_count,development_count,holdout_count,counterfactual_pair_required,primary_risk\nk,KEEP,p,2,1,1,0,true,r\n")
    assert plan.expand_coverage(files.coverage(spark, str(tmp_path / "c.csv"))).count() == 2


def test_streaming(spark, tmp_path):
    from gridloom.streaming.ingest import ingest_jsonl

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text('{"sample_id": "1", "v": 2}\n{broken\n\n{"v": 3}\n')
    for _ in range(2):
        ingest_jsonl(spark, str(tmp_path / "in"), "sample_id string, v int", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out/good")).count() == 1
        assert spark.read.parquet(str(tmp_path / "out/bad")).count() == 2
