import itertools
import json
import random
import time
from datetime import datetime

import numpy as np

from pyspark.sql import functions as F

from gridloom.operators import schema_drift as sd
from gridloom.operators import tree_edit

FILES = "file_id bigint, stream_id string, schema_release string, written_at timestamp_ntz"
LINES = "line_id bigint, file_id bigint, body string"
REL = "rec-2026.08.12.1"


def test_assignment_gains_most():
    rng = random.Random(1)
    for n, m in [(1, 1), (2, 3), (3, 2), (4, 4), (5, 3), (5, 5)]:
        gain = np.array([[rng.randrange(10) for _ in range(m)] for _ in range(n)], dtype=float)
        pairs = tree_edit.assign(gain)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        wide = gain if n <= m else gain.T
        assert sum(gain[i, j] for i, j in pairs) == max(sum(wide[i, p[i]] for i in range(len(wide))) for p in itertools.permutations(range(wide.shape[1]), len(wide)))


def test_distance_counts_operations():
    d = lambda a, b, same=(): round(tree_edit.distance(a, b, set(same))[0])
    assert d([], []) == 0
    assert d([], ["b"]) == 1
    assert d(["a.x"], ["b.x"]) == 4  # no evidence: two nodes go, two come
    assert d(["a.x"], ["b.x"], [("a.x", "b.x")]) == 1  # the object is renamed
    assert d(["a.x"], ["a.y"], [("a.x", "a.y")]) == 1
    assert d(["a.x"], ["x"], [("a.x", "x")]) == 1  # the object goes, its leaf stays
    assert d(["a.x", "a.y"], ["b.x", "c.y"], [("a.x", "b.x"), ("a.y", "c.y")]) == 3  # the object goes, two come around its leaves


def test_wide_schemas_are_quick():
    n = 2000
    old = {f"o{i % 50}.p{i}": "string" for i in range(n)}
    new = {f"o{i % 50}.{'q' if i % 3 else 'p'}{i}": "string" for i in range(n)}
    began = time.perf_counter()
    got = tree_edit.edit_script(old, new, {(f"o{i % 50}.p{i}", f"o{i % 50}.q{i}") for i in range(n) if i % 3})
    assert time.perf_counter() - began < 2
    assert [op for op, _, _ in got] == ["rename"] * sum(1 for i in range(n) if i % 3)
    # Deep objects; equal values everywhere are one assignment.
    deep = ".".join("abcdefghij" * 20)
    assert tree_edit.edit_script({deep + ".x": "string"}, {deep + ".y": "string"}, {(deep + ".x", deep + ".y")})[0][0] == "rename"
    same = {(f"a{i}", f"b{j}") for i in range(40) for j in range(40)}
    assert len(tree_edit.edit_script({f"a{i}": "string" for i in range(40)}, {f"b{i}": "string" for i in range(40)}, same)) == 40


def test_scripts():
    s = {p: "string" for p in ("id", "a.x", "a.y", "k")}
    assert tree_edit.edit_script(s, s, set()) == []
    new = {"id": "string", "a.z": "string", "k": "integer", "n": "string"}
    got = tree_edit.edit_script(s, new, {("a.x", "a.z"), ("a.x", "n"), ("a.y", "n")})
    # As many renames as can be, each path once.
    assert sorted(got) == [("move", "a.y", "n"), ("rename", "a.x", "a.z"), ("retype", "k", "k")]


def make(spark, files, lines):
    f = spark.createDataFrame(files, FILES)
    parsed = sd.read_lines(f, spark.createDataFrame(lines, LINES))
    return f, parsed, sd.changes(f, parsed)


def test_changes(spark):
    files = [(1, "s", REL, datetime(2026, 1, 1)), (2, "s", REL, datetime(2026, 1, 2)), (3, "s", REL, datetime(2026, 1, 3)), (4, "t", REL, datetime(2026, 1, 1))]
    one = [{"sample_id": f"x{i}", "rel": REL, "g": {"a": f"v{i}", "n": i, "o": None}} for i in range(3)]
    two = [{"sample_id": f"x{i}", "release": 2026081201, "h": {"a": f"v{i}"}, "g": {"n": i + 0.5}, "e": {}} for i in range(1, 4)]
    three = [{"sample_id": "q", "release": REL, "h": {"a": ["v"]}, "g": {"n": 1.5}, "l": True}]
    bodies = [(1, b) for b in one] + [(2, b) for b in two] + [(3, b) for b in three]
    lines = [(i, f, json.dumps(b)) for i, (f, b) in enumerate(bodies)]
    lines += [(90, 1, lines[0][2]), (91, 1, "{broken"), (92, 1, None), (93, 1, ""), (94, 1, "[1]"), (95, 1, '{"sample_id": "x", "rel": "rec-2026.08.12.9", "odd": 1}'), (96, 77, lines[0][2])]
    f, parsed, found = make(spark, files, lines)
    got = {(r.file_id, r.change_kind, r.old_path, r.new_path) for r in found.collect()}
    assert got == {
        (2, "renamed", "rel", "release"),
        (2, "renamed", "g.a", "h.a"),
        (2, "retyped", "g.n", "g.n"),
        (3, "retyped", "h.a", "h.a"),
        (3, "retyped", "release", "release"),
        (3, "added", "", "l"),
    }
    table = sd.unify(f, parsed, found)
    # Both names of a lineage are one column: h.a, in more files, gave its name to g.a.
    assert "g__a" not in table.columns and table.where("h__a is not null").count() == table.count()
    assert table.count() == 3 + 1 + 3 + 1
    assert [r[0] for r in table.where("line_id = 0").select("h__a").collect()] == ['"v0"']


def columns_of(spark, files, lines):
    f, parsed, found = make(spark, files, lines)
    return {(r.file_id, r.path): r.column for r in sd.lineages(f, found, parsed).collect()}, (f, parsed, found)


def test_names_that_swap_and_names_of_two_meanings(spark):
    day = lambda n: datetime(2026, 1, n)
    files = [(i, "s", REL, day(i)) for i in (1, 2, 3)] + [(i, "t", REL, day(i)) for i in (11, 12)]
    body = lambda **k: json.dumps({"sample_id": "x", "rel": REL, **k})
    # In s, b is renamed c and then a takes the name b; in t, b is what a is in s at the end.
    lines = [(1, 1, body(a="1", b="2")), (2, 2, body(a="1", c="2")), (3, 3, body(b="1", c="2")), (4, 11, body(b="7")), (5, 12, body(b="7", c="8"))]
    got, (f, parsed, found) = columns_of(spark, files, lines)
    assert got[1, "a"] == got[2, "a"] == got[3, "b"] != got[1, "b"] == got[2, "c"] == got[3, "c"]
    assert got[11, "b"] == got[12, "b"] != got[12, "c"]
    table = sd.unify(f, parsed, found)
    assert table.count() == 5
    assert {r["value"] for r in sd.unified_cells(f, parsed, found).where(F.col("column") == got[1, "a"]).where("file_id < 10").collect()} == {'"1"'}


def test_long_chains_of_renames(spark):
    files = [(i, "s", REL, datetime(2026, 1, 1 + i)) for i in range(12)]
    lines = [(i, i, json.dumps({"sample_id": "x", "rel": REL, f"n{i}": "v"})) for i in range(12)]
    got, _ = columns_of(spark, files, lines)
    assert len({got[i, f"n{i}"] for i in range(12)}) == 1


def test_great_integers_stay_whole(spark):
    files = [(1, "s", REL, datetime(2026, 1, 1))]
    body = lambda **k: json.dumps({"sample_id": "x", "rel": REL, **k})
    lines = [(1, 1, body(a=2**70, b=2**60, c=5, d=2**60)), (2, 1, body(a=1, b=0.5, c=1.5, d=3))]
    f, parsed, found = make(spark, files, lines)
    rows = {r.line_id: r for r in sd.unify(f, parsed, found).collect()}
    assert (rows[1].a, rows[1].b, rows[1].c, rows[1].d) == (str(2**70), str(2**60), 5.0, 2**60)
    assert (rows[2].a, rows[2].b, rows[2].c, rows[2].d) == ("1", "0.5", 1.5, 3)


def test_empty_and_clashing(spark):
    f, parsed, found = make(spark, [], [])
    assert found.count() == 0 and sd.unify(f, parsed, found).count() == 0
    f = spark.createDataFrame([(1, "s", REL, None, 1), (2, "s", REL, None, 2)], FILES + ", path int")
    lines = spark.createDataFrame([(1, 1, json.dumps({"sample_id": "a", "r": REL, "file_id": 5}), "x", "y")], LINES + ", leaves string, BODY string")
    parsed = sd.read_lines(f, lines)
    assert {(r.change_kind, r.old_path) for r in sd.changes(f, parsed).collect()} == {("removed", "sample_id"), ("removed", "r"), ("removed", "file_id")}
    assert "file_id_" in sd.unify(f, parsed, sd.changes(f, parsed)).columns


def test_release_forms():
    assert sd.release_number("synthetic-2026.08.12.4") == 2026081204 and sd.release_number(None) is None
    assert sd.states_release(2026081204, "x-2026.08.12.4", 2026081204) and not sd.states_release(True, "1", 1)
