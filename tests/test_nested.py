import json
import random
from datetime import datetime

from pyspark.sql import functions as F

from gridloom.operators import nested


def links(doc):
    """Token links of a document, by a plain recursive walk."""
    cells, tokens, found = set(), set(), set()

    def walk(o, cell, key=None, coll=None):
        if isinstance(o, dict):
            token = o.get("token_id", key if coll == "tokens" else None)
            named = o.get("cell_id", key if coll == "cells" else None)
            if token is not None:
                tokens.add(token)
                if cell is not None:
                    found.add((cell, token))
                if o.get("owner_cell_id") is not None:
                    found.add((o["owner_cell_id"], token))
                named = None
            elif named is not None:
                cells.add(named)
                for t in o.get("token_ids") or []:
                    if t is not None:
                        found.add((named, t))
            for k, v in o.items():
                if isinstance(v, dict) and k in ("tokens", "cells") and v and all(isinstance(x, dict) for x in v.values()):
                    for n, x in v.items():
                        walk(x, named, n, k)
                elif k != "token_ids":
                    walk(v, named)
        elif isinstance(o, list):
            for v in o:
                walk(v, cell)

    walk(doc, None)
    return {(c, t) for c, t in found if c in cells and t in tokens}


def random_doc(rng):
    token = lambda i: {"token_id": f"t{i}"} | ({"owner_cell_id": f"c{rng.randrange(5)}"} if rng.random() < 0.5 else {})
    def cell(i, depth=0):
        out = {"cell_id": f"c{i}", "text": None}
        if rng.random() < 0.5:
            out["tokens"] = [token(rng.randrange(6)) for _ in range(2)]
        if rng.random() < 0.5:
            out["token_ids"] = [f"t{rng.randrange(9)}", None]
        if depth < 3 and rng.random() < 0.4:
            out["children"] = [cell(i + 10, depth + 1)]
        return out
    doc = {"grid": [[cell(0)], [cell(1), cell(2)]], "x": {"cells": {"c3": {"row": 1}}}}
    doc["tokens"] = [token(i) for i in range(4)] if rng.random() < 0.5 else {f"t{i}": {"text": "a"} for i in range(4)}
    return doc


def test_links_against_walk(spark):
    rng = random.Random(3)
    docs = [random_doc(rng) for _ in range(40)]
    df = spark.createDataFrame([(str(i), json.dumps(d)) for i, d in enumerate(docs)], "id string, doc string")
    got = {(r.id, r.cell_id, r.token_id) for r in nested.token_links(nested.shred(df, ["id"], "doc"), ["id"]).collect()}
    assert got == {(str(i), c, t) for i, d in enumerate(docs) for c, t in links(d)}
    rows = nested.document_links(df, ["id"], "doc").collect()
    assert len(rows) == len(got) and {(r.id, r.cell_id, r.token_id) for r in rows} == got


def test_labels_and_parents(spark):
    df = spark.createDataFrame([("a", '{"p": {"q": [[{"v": 1}, 2]]}, "tokens": {"t": {"text": "x"}}}')], "id string, doc string")
    rows = {r.dewey: r for r in nested.shred(df, ["id"], "doc").collect()}
    assert {d: (r.schema_path, r.parent) for d, r in rows.items()} == {
        "0": ("$", None),
        "0.0": ("$.p", "0"),
        "0.0.0.0.0": ("$.p.q[][]", "0.0"),
        "0.0.0.0.1": ("$.p.q[][]", "0.0"),
        "0.1.0": ("$.tokens{}", "0"),
    }
    assert rows["0.1.0"].attrs["@key"] == "t"


def test_broken_empty_and_deep(spark):
    deep = "[" * 100_000 + "]" * 100_000
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "{x"), ("d", "null"), ("e", "5"), ("f", deep), (None, '{"cell_id": "c", "tokens": [{"token_id": "t"}]}')], "id string, doc string")
    nodes = nested.shred(df, ["id"], "doc")
    assert {r.id for r in nodes.where("kind = 'object'").collect()} == {None}
    assert [(r.cell_id, r.token_id) for r in nested.token_links(nodes, ["id"]).collect()] == [("c", "t")]
    assert nested.token_links(nested.shred(df.limit(0), ["id"], "doc"), ["id"]).count() == 0
    assert [tuple(r) for r in nested.document_links(df.withColumn("ID2", F.lit(1)), ["id"], "doc").collect()] == [(None, "c", "t")]
    assert nested.document_links(df.limit(0), ["id"], "doc").count() == 0


def test_long_documents_link_in_one_pass(spark):
    n = 40_000  # every link would once look through all cells
    doc = {"cells": [{"cell_id": f"c{i}", "token_ids": [f"t{i}"]} for i in range(n)], "tokens": [{"token_id": f"t{i}", "owner_cell_id": f"c{i + 1}"} for i in range(n)]}
    df = spark.createDataFrame([("a", json.dumps(doc))], "id string, doc string")
    assert nested.document_links(df, ["id"], "doc").count() == 2 * n - 1
    assert nested.token_links(nested.shred(df, ["id"], "doc"), ["id"]).count() == 2 * n - 1


def test_latest(spark):
    at = datetime(2026, 1, 1)
    df = spark.createDataFrame([("a", at, 1), ("a", None, 2), ("a", at, 1), (None, at, 3), ("b", None, 4)], "k string, at timestamp_ntz, v int")
    assert {(r.k, r.v) for r in nested.latest(df, "k", "at", ["v"]).collect()} == {("a", 1), ("b", 4)}
    clash = df.withColumn("K2", F.lit(0)).toDF("k", "at", "v", "AT")
    assert nested.latest(clash, "k", "at", ["v"]).count() == 2
