"""Deeply nested records as flat tables that keep parent-child links.

Every node of a JSON document gets a Dewey label: the ordinals of the members and
elements on the way to it, joined by dots (the root is ``0``). The label of the parent
is the label without its last components, so no parent key has to be stored or joined
for. Nodes with the same schema path (names, ``[]`` per array level, ``{}`` for a
collection keyed by id) form one table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import pick

NODE_SCHEMA = "dewey string, schema_path string, kind string, name string, value string, attrs map<string,string>"
#: Members whose object value is a collection keyed by id.
KEYED = ("tokens", "cells")
KEY = "@key"


_encode = json.JSONEncoder(ensure_ascii=False).encode


def _text(v) -> str:
    return v if isinstance(v, str) else _encode(v)


def label_nodes(doc, keyed: tuple[str, ...] = KEYED, keep: frozenset[str] | None = None, items: frozenset[str] | None = None) -> list[tuple]:
    """(dewey, schema_path, kind, name, value, attrs) of each object and of each scalar that is an array element.

    An object's scalar members are its attrs, all or those to ``keep``; null members are
    left out. items: the names of arrays whose scalars are wanted as nodes, by default all. The walk keeps its own stack, so depth is bounded by memory only.
    """
    out: list[tuple] = []
    stack = [("0", "$", "", doc, None)]
    while stack:
        dewey, path, name, node, key = stack.pop()
        if isinstance(node, dict):
            attrs = [] if key is None else [(KEY, key)]
            for i, (k, v) in enumerate(node.items()):
                at = f"{dewey}.{i}"
                if isinstance(v, dict) and k in keyed and v and all(isinstance(x, dict) for x in v.values()):
                    stack.extend((f"{at}.{j}", f"{path}.{k}{{}}", k, x, n) for j, (n, x) in enumerate(v.items()))
                elif isinstance(v, (dict, list)):
                    stack.append((at, f"{path}.{k}", k, v, None))
                elif v is not None and (keep is None or k in keep):
                    attrs.append((k, _text(v)))
            out.append((dewey, path, "object", name, None, attrs))
        elif isinstance(node, list):
            wanted = items is None or name in items
            stack.extend((f"{dewey}.{i}", path + "[]", name, v, None) for i, v in enumerate(node) if wanted or isinstance(v, (dict, list)))
        elif node is not None:
            out.append((dewey, path, "item", name, _text(node), []))
    return out


def parse_json(text: str | None):
    """The document, or None for null, broken or endlessly nested text."""
    if text is None:
        return None
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def shred(df: DataFrame, keys: list[str], json_col: str, keyed: tuple[str, ...] = KEYED, keep: tuple[str, ...] | None = None, items: tuple[str, ...] | None = None) -> DataFrame:
    """One row per node of ``json_col``: ``keys`` and the columns of NODE_SCHEMA, with ``parent``.

    Null, empty and broken texts give no rows; a scalar document gives one item. Equal
    members of an object count as in JSON text, the last wins. Key columns may hold nulls.
    keep: the scalar members wanted, items: the arrays whose scalars are, by default all.
    """
    slim = pick(df, *keys, json_col).withColumnRenamed(json_col, "__json")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]) + ", " + NODE_SCHEMA
    kept_members, kept_items = (None if x is None else frozenset(x) for x in (keep, items))
    columns = ["dewey", "schema_path", "kind", "name", "value", "attrs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[tuple] = []
                of: list[int] = []
                for i, text in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    doc = parse_json(text)
                    if doc is not None:
                        nodes = label_nodes(doc, keyed, kept_members, kept_items)
                        rows += nodes
                        of += [i] * len(nodes)
                take = pa.array(of, pa.int32())
                kept = [part.column(k).take(take) for k in range(part.num_columns - 1)]
                *flat, attrs = zip(*rows) if rows else ((),) * 6
                offsets = np.cumsum([0, *map(len, attrs)], dtype=np.int32)
                pairs = [a for held in attrs for a in held]
                made = [pa.array(c, pa.string()) for c in flat]
                made.append(pa.MapArray.from_arrays(pa.array(offsets), pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string())))
                yield pa.RecordBatch.from_arrays(kept + made, names=[*part.schema.names[:-1], *columns])

    return slim.mapInArrow(run, schema).withColumn("parent", parent_label(F.col("dewey"), F.col("schema_path")))


def parent_label(dewey: Column, schema_path: Column) -> Column:
    """The label of the nearest object above, by truncation; null for the root.

    A member is one component below its object; every array level in between, and the
    level of a keyed collection, is one more.
    """
    tail = F.regexp_extract(schema_path, r"((?:\[\]|\{\})*)$", 1)
    drop = (F.length(tail) / 2).cast("int") + 1
    parts = F.split(dewey, r"\.")
    up = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - drop, F.lit(0))), ".")
    return F.when(~schema_path.rlike(r"^\$(\[\])*$"), up)


def tables(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and attribute names per schema path: the catalogue of the flat tables. Recursive paths keep their depth."""
    return nodes.groupBy("schema_path", "kind").agg(F.count("*").alias("n_rows"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("attrs"))))).alias("attrs"))


def latest(records: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """The row of each key last by ``at``; rows without key are left out.

    Aggregated before the shuffle, so a key with a third of all rows is one row per task.
    Rows of one instant: the one whose content has the greatest hash; ``columns`` hold no maps. A null ``at`` comes first.
    """
    content = F.struct(*[F.col(c) for c in columns])
    order = F.struct(F.col(at), F.xxhash64(*[F.col(c) for c in columns]))
    return pick(records, key, at, *columns).where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(content, order).alias("__row")).select(key, "__row.*")


#: Members that link tokens and cells.
LINKS = ("cell_id", "token_id", "owner_cell_id")


def states(records: DataFrame, links_only: bool = False) -> DataFrame:
    """(sample_id, table_state, doc) of the latest revision of each sample: the typed gold state and the prior state's text.

    links_only: of the gold state just what links tokens and cells; the scan then reads no
    other of its columns.
    """
    records = pick(records, "sample_id", "gold", "prior_json", "revised_at")
    pair = lambda a, b, n, m: F.zip_with(a, b, lambda x, y: F.struct(x.alias(n), y.alias(m)))
    slim = F.struct(pair("gold.cells.cell_id", "gold.cells.token_ids", "cell_id", "token_ids").alias("cells"), pair("gold.tokens.token_id", "gold.tokens.owner_cell_id", "token_id", "owner_cell_id").alias("tokens"))
    last = latest(records.withColumn("gold_json", F.to_json(slim if links_only else F.col("gold"))), "sample_id", "revised_at", ["gold_json", "prior_json"])
    both = F.array(F.struct(F.lit("gold").alias("table_state"), F.col("gold_json").alias("doc")), F.struct(F.lit("prior").alias("table_state"), F.col("prior_json").alias("doc")))
    return last.select("sample_id", F.inline(both)).where("doc is not null")


def is_cell() -> Column:
    return (F.col("kind") == "object") & cell_name().isNotNull() & token_name().isNull()


def is_token() -> Column:
    return (F.col("kind") == "object") & token_name().isNotNull()


def cell_name() -> Column:
    return F.coalesce(F.col("attrs")["cell_id"], F.when(F.col("schema_path").endswith(".cells{}"), F.col("attrs")[KEY]))


def token_name() -> Column:
    return F.coalesce(F.col("attrs")["token_id"], F.when(F.col("schema_path").endswith(".tokens{}"), F.col("attrs")[KEY]))


def cells(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Flat table of cells: keys, dewey, parent, cell_id and the attributes."""
    return nodes.where(is_cell()).select(*keys, "dewey", "parent", "schema_path", cell_name().alias("cell_id"), "attrs")


def tokens(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Flat table of tokens: keys, dewey, parent, token_id, the named owner and the attributes."""
    return nodes.where(is_token()).select(*keys, "dewey", "parent", "schema_path", token_name().alias("token_id"), F.col("attrs")["owner_cell_id"].alias("owner_cell_id"), "attrs")


def token_links(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cell_id, token_id): tokens that belong to a cell, each pair once.

    A cell lists a token (an item below its ``token_ids``), holds it (a token whose parent
    label is the cell's), or the token names the cell. Both ends must be described in the
    same document; links to nothing are dropped. Joins on document and label, or document
    and id, so neither long documents nor many links of one are held together.
    """
    doc = F.struct(*keys).alias("doc")
    listed = F.when((F.col("kind") == "item") & (F.col("name") == "token_ids"), F.col("value"))
    rows = nodes.select(doc, "dewey", "parent", F.when(is_cell(), cell_name()).alias("cell"), F.when(is_token(), token_name()).alias("token"), F.when(is_token(), F.col("attrs")["owner_cell_id"]).alias("owner"), listed.alias("listed"))
    cells_at = rows.where("cell is not null").select("doc", F.col("dewey").alias("parent"), "cell")
    described = rows.where("token is not null").select("doc", "token").distinct()
    ends = rows.where("cell is null").select("doc", "parent", F.coalesce("token", "listed").alias("token"), "owner").where("token is not null")
    placed = ends.join(cells_at, ["doc", "parent"]).select("doc", "cell", "token")
    named = ends.select("doc", F.col("owner").alias("cell"), "token").where("cell is not null").join(cells_at.select("doc", "cell").distinct(), ["doc", "cell"], "left_semi")
    links = placed.unionByName(named).distinct().join(described, ["doc", "token"], "left_semi")
    return links.select(*[F.col(f"doc.`{k}`").alias(k) for k in keys], F.col("cell").alias("cell_id"), F.col("token").alias("token_id"))


def _parent(dewey: str, path: str) -> str:
    """As ``parent_label``."""
    at = len(path)
    drop = 1
    while path[at - 2 : at] in ("[]", "{}"):
        drop += 1
        at -= 2
    return dewey.rsplit(".", drop)[0]


def link_nodes(nodes: list[tuple]) -> set[tuple[str, str]]:
    """(cell_id, token_id) of the nodes of one document, by the rules of ``token_links``, in one pass over their labels."""
    at: dict[str, str] = {}
    described, ends = set(), []
    for dewey, path, kind, name, value, attrs in nodes:
        if kind == "item":
            if name == "token_ids":
                ends.append((dewey, path, value, None))
            continue
        own = dict(attrs)
        token = own.get("token_id", own.get(KEY) if path.endswith(".tokens{}") else None)
        if token is not None:
            described.add(token)
            ends.append((dewey, path, token, own.get("owner_cell_id")))
        elif (cell := own.get("cell_id", own.get(KEY) if path.endswith(".cells{}") else None)) is not None:
            at[dewey] = cell
    named = set(at.values())
    found = set()
    for dewey, path, token, owner in ends:
        if token in described:
            if (cell := at.get(_parent(dewey, path))) is not None:
                found.add((cell, token))
            if owner in named:
                found.add((owner, token))
    return found


def document_links(df: DataFrame, keys: list[str], json_col: str, keyed: tuple[str, ...] = KEYED) -> DataFrame:
    """``token_links`` straight from documents: a document's nodes are labelled and linked where it is read, so nothing is shuffled. Each row is a document of its own."""
    slim = pick(df, *keys, json_col).withColumnRenamed(json_col, "__json")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]) + ", cell_id string, token_id string"
    keep = frozenset(LINKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                of, links = [], []
                for i, text in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    doc = parse_json(text)
                    if isinstance(doc, (dict, list)):
                        found = link_nodes(label_nodes(doc, keyed, keep, frozenset(["token_ids"])))
                        links += found
                        of += [i] * len(found)
                take = pa.array(of, pa.int32())
                cells_, tokens_ = zip(*links) if links else ((), ())
                yield pa.RecordBatch.from_arrays([part.column(k).take(take) for k in range(part.num_columns - 1)] + [pa.array(cells_, pa.string()), pa.array(tokens_, pa.string())], names=[*part.schema.names[:-1], "cell_id", "token_id"])

    return slim.mapInArrow(run, schema)
