import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridloom.operators import orphans

T0 = datetime(2026, 1, 1)
MANIFEST = "sample_id string, registered_at timestamp_ntz, withdrawn_at timestamp_ntz, ocr_tokens array<int>"
CELLS = "cell_key bigint, sample_id string, ocr_token_indexes array<int>, built_at timestamp_ntz"


def brute(manifest, refs):
    by = {}
    for sid, at, gone, toks in manifest:
        if sid is not None and at is not None:
            by.setdefault(sid.strip().lower(), set()).add((at, gone or datetime.max, len(toks or [])))
    out = set()
    for key, sid, idxs, used in refs:
        if sid is None:
            continue
        used = used or datetime(9999, 12, 31)
        versions = sorted(by.get(sid.strip().lower(), ()))
        before = [v for v in versions if v[0] <= used]
        if not versions:
            out.add((key, "sample_id", -1, "missing"))
        elif not before:
            out.add((key, "sample_id", -1, "later"))
        elif before[-1][1] <= used:
            out.add((key, "sample_id", -1, "deleted"))
        else:
            out |= {(key, "ocr_token_indexes", i, "missing") for i in idxs or [] if i is not None and not 0 <= i < before[-1][2]}
    return out


def run(spark, manifest, refs):
    m = spark.createDataFrame(manifest, MANIFEST)
    r = spark.createDataFrame(refs, CELLS)
    got = orphans.track_orphans(orphans.parents_of(m), orphans.references_of(r, "raw_cells", "cell_key", "built_at", "ocr_token_indexes"))
    return got, {(x.ref_id, x.ref_field, x.token_index, x.orphan_state) for x in got.orphans.collect()}


def case(seed, hot):
    rng = random.Random(seed)
    at = lambda: T0 + timedelta(hours=rng.randrange(24 * 90))
    name = lambda: "HOT" if rng.random() < hot else f"s{rng.randrange(12)}"
    manifest = [(rng.choice([name(), name().upper(), f" {name()} ", None]), rng.choice([at(), at(), at(), None]), rng.choice([None, None, at()]), rng.choice([None, [], [1] * rng.randrange(6)])) for _ in range(60)]
    refs = [(i, rng.choice([name(), f"{name()} ", "zz", None]), rng.choice([None, [], [rng.randrange(-1, 7) for _ in range(3)], [0, None, 0]]), rng.choice([at(), at(), None])) for i in range(120)]
    return manifest + manifest[:5], refs + refs[:7]


@pytest.mark.parametrize("light", [32, 2])
def test_against_brute_force(spark, monkeypatch, light):
    # With 2, keys of more than two versions go by time slots; hot keys are shared out.
    monkeypatch.setattr(orphans, "LIGHT_VERSIONS", light)
    monkeypatch.setattr(orphans, "HOT_ROWS", 20)
    manifest, refs = case(light, 0.4)
    got, rows = run(spark, manifest, refs)
    assert rows == brute(manifest, refs)
    assert got.orphans.count() == len(rows)
    assert not got.snapshots.where("orphan_state = 'pending'").isEmpty()


def test_state_lasts_and_late_news_reopen(spark, tmp_path):
    home = str(tmp_path / "state")
    rng = random.Random(5)
    manifest, refs = case(3, 0.3)
    plain = lambda s: s and s.strip().lower()
    # One row for each key and time of registration; withdrawals become known in a later batch than registrations.
    rows = {(plain(s), at): (s, at, gone, toks) for s, at, gone, toks in manifest if s and at}
    batches = [([], []) for _ in range(4)]
    for s, at, gone, toks in rows.values():
        k = rng.randrange(3)
        batches[k][0].append((s, at, None, toks))
        if gone:
            batches[rng.randrange(k + 1, 4)][0].append((s, at, gone, toks))
    for r in dict((r[0], r) for r in refs).values():
        batches[rng.randrange(4)][1].append(r)
    seen = ([], [])
    for parents, used in batches:
        state = orphans.OrphanState(spark, home)  # a new object, as in a new session
        state.add(orphans.parents_of(spark.createDataFrame(parents, MANIFEST)), orphans.references_of(spark.createDataFrame(used, CELLS), "raw_cells", "cell_key", "built_at", "ocr_token_indexes"))
        seen[0].extend(parents)
        seen[1].extend(used)
        now = {(plain(s), at): (s, at, gone, toks) for s, at, gone, toks in seen[0]}  # the last news counts
        want = brute(list(now.values()), seen[1])
        assert {(x.ref_id, x.ref_field, x.token_index, x.orphan_state) for x in state.orphans().collect()} == want
        # The counts after this epoch are those of the orphans now.
        last = len(state.epochs()) - 1
        counts = {}
        for r in state.snapshots().where(F.col("epoch") == last).collect():
            counts[r.orphan_state] = counts.get(r.orphan_state, 0) + r.n
        whole = lambda k: sum(x[3] == k and x[1] == "sample_id" for x in want)
        assert (counts.get("pending", 0), counts.get("later", 0), counts.get("deleted", 0)) == (whole("missing"), whole("later"), whole("deleted"))
        assert counts.get("lacking", 0) == len({x[0] for x in want if x[1] != "sample_id"})
    assert len(state.epochs()) == 4


def test_empty_tables(spark):
    assert run(spark, [], [])[1] == set()
    assert run(spark, [], [(1, "a", [0], T0)])[1] == {(1, "sample_id", -1, "missing")}
    assert run(spark, [("a", T0, None, [1])], [])[1] == set()


def test_clashing_columns(spark):
    m = spark.createDataFrame([("a", T0, None, [1], "x", "y")], MANIFEST + ", key string, SAMPLE_ID string")
    r = spark.createDataFrame([(1, "a", [3], T0, 0, 0)], CELLS + ", used int, key int")
    got = orphans.track_orphans(orphans.parents_of(m), orphans.references_of(r, "raw_cells", "cell_key", "built_at", "ocr_token_indexes"))
    assert [(x.ref_id, x.token_index) for x in got.orphans.collect()] == [(1, 3)]
