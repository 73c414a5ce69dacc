import random

from pyspark.sql import functions as F

from gridloom.operators import grid, labels

CELLS = "array<struct<row:int,col:int,rowspan:int,colspan:int,text:string,tag:string,bbox:array<double>,confidence:double>>"


def tables(spark, made):
    return spark.createDataFrame([(str(i), c) for i, c in enumerate(made)], f"table_id string, cells {CELLS}").withColumn("c", grid.canonical_cells(F.col("cells")))


def cell(r, c, rs=1, cs=1, text="", tag="td", box=None, conf=None):
    return (r, c, rs, cs, text, tag, box, conf)


def brute_errors(cells):
    out, held = [], {}
    cells = sorted((r or 0, c or 0, max(1, rs or 1), max(1, cs or 1), (t or "").strip()) for r, c, rs, cs, t, *_ in cells)
    for i, (r, c, rs, cs, _) in enumerate(cells):
        if r < 0 or c < 0:
            out.append(f"cell[{i}] has negative index")
    over = []
    for i, (r, c, rs, cs, _) in enumerate(cells):
        for y in range(r, r + rs):
            for x in range(c, c + cs):
                if (y, x) in held:
                    over.append(f"cell[{i}] overlaps cell[{held[y, x]}] at ({y}, {x})")
                held[y, x] = i
    out += over
    if cells:
        rows, cols = max(r + rs for r, _, rs, _, _ in cells), max(c + cs for _, c, _, cs, _ in cells)
        holes = sum((y, x) not in held for y in range(rows) for x in range(cols))
        if holes:
            out.append(f"grid has {holes} holes")
    return out


def test_validation_against_brute_force(spark):
    rng = random.Random(5)
    made = [[cell(rng.randrange(-1, 4), rng.randrange(4), rng.choice([1, 1, 2, 0, -1, None]), rng.choice([1, 2, None])) for _ in range(rng.randrange(7))] for _ in range(80)] + [[], None]
    rows = grid.validate(tables(spark, made), "c").collect()
    for r in rows:
        want = brute_errors(made[int(r.table_id)] or [])
        assert sorted(r.errors) == sorted(want), made[int(r.table_id)]
        assert (r.status == "PASS") == (not want)
    flat = tables(spark, made).select("table_id", F.explode("cells").alias("x")).select("table_id", "x.*")
    by = {r.table_id: r for r in rows}
    for r in grid.validate_rows(flat, "table_id").collect():
        assert (r.n_slots, r.n_overlaps, r.n_holes, r.status) == (by[r.table_id].n_slots, by[r.table_id].n_overlaps, by[r.table_id].n_holes, by[r.table_id].status)


def test_canonical_defaults(spark):
    made = [[cell(None, None, 0, -3, " 　x ", "TH", [1.23456789, 2.0, 3.0, 4.0, 5.0], 0.12345675), cell(0, 0, 1, 1, None, "h", None, None)]]
    a, b = tables(spark, made).first().c
    assert (a.row, a.rowspan, a.text, a.tag, a.confidence) == (0, 1, "", "td", None)
    assert (b.colspan, b.text, b.tag, b.bbox) == (1, "x", "th", [1.234568, 2.0, 3.0, 4.0])


def test_masks_and_difference(spark):
    legal = [[cell(0, 0, 1, 2, tag="th"), cell(1, 0), cell(1, 1, text="a")]]
    t = grid.is_legal(tables(spark, legal), "c").withColumn("o", grid.owners(F.col("c")))
    r = t.select("o", grid.merge_right(F.col("o"), F.col("n_rows"), F.col("n_cols")).alias("r"), grid.merge_down(F.col("o"), F.col("n_rows"), F.col("n_cols")).alias("d"), grid.header_mask(F.col("c"), F.col("o"), F.col("n_cols")).alias("h")).first()
    assert r.o == [0, 0, 1, 2]
    assert [(x.row, x.col, x.same) for x in r.r] == [(0, 0, 1), (1, 0, 0)]
    assert [x.same for x in r.d] == [0, 0] and [x.header for x in r.h] == [1, 1, 0, 0]
    split = tables(spark, [[cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1)]]).select("table_id", F.col("c").alias("p"))
    d = tables(spark, legal).join(split, "table_id").select(grid.difference(F.col("p"), F.col("c")).alias("d")).first().d
    assert [(x.kind, x.row, x.col, x.colspan) for x in d] == [("remove_prior_cell", 0, 0, 1), ("remove_prior_cell", 0, 1, 1), ("add_gold_cell", 0, 0, 2)]
    assert grid.is_legal(tables(spark, [[cell(0, 0), cell(1, 1)], []]), "c").count() == 0


def test_boundaries(spark):
    def positions(direct):
        known = [i for i, v in enumerate(direct) if v is not None]
        out = []
        for i in range(len(direct)):
            left, right = max([k for k in known if k <= i], default=None), min([k for k in known if k >= i], default=None)
            if not known:
                v = i / max(1, len(direct) - 1)
            elif left is None or right is None or left == right:
                v = direct[right if left is None else left]
            else:
                a = (i - left) / (right - left)
                v = direct[left] * (1 - a) + direct[right] * a
            out.append(v if not out else max(v, out[-1] + 1e-5))
        return [0.0] + [min(1.0, max(0.0, v)) for v in out[1:-1]] + [1.0]

    rng = random.Random(2)
    made = [[cell(r, 0, 1, 1, box=[0.0, 100.0 * r + rng.random(), 50.0, 100.0 * (r + 1)] if rng.random() < 0.5 else None) for r in range(n)] for n in (1, 3, 5, 6, 6)]
    t = labels.add_boundaries(grid.is_legal(tables(spark, made), "c"), "c", "n_rows", "row", F.lit(1000.0), "b")
    for r in t.collect():
        edges = {}
        for row, _, _, _, _, _, box, _ in made[int(r.table_id)]:
            if box:
                edges.setdefault(row, []).append(round(box[1], 6) / 1000)
                edges.setdefault(row + 1, []).append(round(box[3], 6) / 1000)
        direct = [None if i not in edges else sum(sorted(edges[i])) / len(edges[i]) for i in range(len(r.b))]
        assert all(abs(x.position - w) < 1e-9 for x, w in zip(r.b, positions(direct)))
        assert [x.reliable for x in r.b] == [d is not None for d in direct]


def test_token_assignment(spark):
    cells = [[cell(0, 0, box=[0.0, 0.0, 10.0, 10.0]), cell(0, 1, box=[10.0, 0.0, 20.0, 10.0]), cell(1, 0, box=None)]]
    tokens = [([10.0, 4.0, 10.0, 6.0],), ([9.0, 0.0, 13.0, 10.0],), ([50.0, 50.0, 60.0, 60.0],), (None,), ([-5.0, 0.0, 4.0, 4.0],)]
    t = tables(spark, cells).withColumn("t", F.lit(None)).join(spark.createDataFrame([("0", tokens)], "table_id string, tok array<struct<bbox:array<double>>>"), "table_id")
    # On the shared edge the first cell wins; a token without box is the point 0, 0, in the first cell.
    assert labels.assign_tokens(t, "tok", "c", F.lit(2), "a").first().a == [0, 1, -1, 0, 0]


def test_merge_tree():
    boxes = [(0, 0, 1, 1), (0, 1, 1, 1), (1, 0, 1, 1), (1, 1, 1, 1), (5, 5, 1, 1)]
    assert labels.merge_tree([3, 2, 1, 0, 0], boxes) == [(0, "merge_down", 2), (0, "merge_right", 1), (2, "merge_right", 3)]
    assert labels.merge_tree([0, 4], boxes) == [] and labels.merge_tree([1], boxes) == []


def test_residual_merge(spark):
    raw, gold = [[cell(0, 0, text="a"), cell(0, 1, text="b")]], [[cell(0, 0, 1, 2, text="ab")]]
    t = tables(spark, raw).select("table_id", F.col("c").alias("raw")).join(tables(spark, gold).select("table_id", F.col("c").alias("gold")), "table_id")
    t = t.withColumn("raw_keys", grid.strict_keys(F.col("raw"), grid.normalized_texts(F.col("raw")))).withColumn("gold_keys", grid.strict_keys(F.col("gold"), grid.normalized_texts(F.col("gold"))))
    r = labels.residual_edits(t).first()
    assert [(e.source, e.action, e.target) for e in r.merge_edges] == [(0, "merge_right", 1)]
    assert [c.keep_structure for c in r.raw_cells] == [False, True] and r.table_action == "EDIT"
