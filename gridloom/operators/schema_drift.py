"""Schemas that drift between the files of a stream.

Each file's schema is the set of leaf paths of its records. Between a file and the one
written before it in its stream, the mapping of a tree edit distance gives the script of
adds, deletes, renames, moves and retypes (``tree_edit``); evidence for renames is
equality of values in the samples both files hold, found by comparing order-free
fingerprints, so nothing is compared pairwise. The scripts of a stream, followed from file
to file, compile into one projection per file, under which all records form one table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.columns import pick
from gridloom.operators.nested import parse_json
from gridloom.operators.tree_edit import edit_script
from gridloom.session import cut

#: Kinds of change as they are reported.
KINDS = {"add": "added", "delete": "removed", "rename": "renamed", "move": "renamed", "retype": "retyped"}
LEAF = "array<struct<path:string,type:string,value:string,states:boolean>>"


def type_name(v) -> str:
    return "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "number" if isinstance(v, float) else "string" if isinstance(v, str) else "array"


def leaves(doc: dict) -> dict[str, object]:
    """Leaf path -> value that is not null. Arrays are values; objects are entered."""
    out: dict[str, object] = {}
    stack = [("", doc)]
    while stack:
        at, node = stack.pop()
        for k, v in node.items():
            path = f"{at}.{k}" if at else k
            if isinstance(v, dict):
                stack.append((path, v))
            elif v is not None:
                out[path] = v
    return out


_ENCODER = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":"))
_quoted = json.encoder.encode_basestring


def canonical(v) -> str:
    """A value as text; numbers that are equal have the same text."""
    if isinstance(v, str):
        return _quoted(v)
    if isinstance(v, float) and v.is_integer():
        v = int(v)
    return _ENCODER.encode(v)


def release_number(release: str | None) -> int | None:
    """``...-2026.08.12.4`` as the number 2026081204: date, then two digits of the release."""
    m = re.search(r"(\d{4})\.(\d{1,2})\.(\d{1,2})\.(\d{1,2})\s*$", release or "")
    return m and int("{:04d}{:02d}{:02d}{:02d}".format(*map(int, m.groups())))


def states_release(v, release: str, number: int | None) -> bool:
    if isinstance(v, bool) or v is None:
        return False
    if isinstance(v, str):
        return v.strip() == release or (number is not None and v.strip() == str(number))
    return isinstance(v, (int, float)) and number is not None and v == number


def read_lines(files: DataFrame, lines: DataFrame, sample_path: str = "sample_id") -> DataFrame:
    """Counted lines (stream_id, file_id, line_id, sample, leaves): bodies that are JSON objects stating their file's release.

    Null, broken and empty bodies, other JSON values, lines of another release, and lines
    of unknown files do not count.
    """
    joined = pick(lines, "file_id", "line_id", "body").join(pick(files, "file_id", "stream_id", "schema_release").distinct(), "file_id")
    joined = joined.select("stream_id", "file_id", "line_id", "schema_release", "body")
    schema = f"stream_id {joined.schema['stream_id'].dataType.simpleString()}, file_id {joined.schema['file_id'].dataType.simpleString()}, line_id {joined.schema['line_id'].dataType.simpleString()}, sample string, leaves {LEAF}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, samples, offsets = [], [], [0]
            paths, types, values, states = [], [], [], []
            for i, (release, body) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                doc = parse_json(body)
                if not isinstance(doc, dict) or release is None:
                    continue
                number, own = release_number(release), release.strip()
                found = leaves(doc)
                said = [states_release(v, own, number) for v in found.values()]
                if not any(said):
                    continue
                keep.append(i)
                sample = found.get(sample_path)
                samples.append(None if sample is None else str(sample))
                paths += found
                types += map(type_name, found.values())
                values += map(canonical, found.values())
                states += said
                offsets.append(len(paths))
            entries = pa.StructArray.from_arrays([pa.array(paths, pa.string()), pa.array(types, pa.string()), pa.array(values, pa.string()), pa.array(states, pa.bool_())], names=["path", "type", "value", "states"])
            taken = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), taken.column(2), pa.array(samples, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)], names=["stream_id", "file_id", "line_id", "sample", "leaves"])

    return joined.mapInArrow(run, schema)


def file_pairs(files: DataFrame) -> DataFrame:
    """(stream_id, file_id, prev_id): each file and the one of its stream written before it; ties by file_id, a null time first."""
    w = Window.partitionBy("stream_id").orderBy("written_at", "file_id")
    return pick(files, "stream_id", "file_id", "written_at").distinct().withColumn("prev_id", F.lag("file_id").over(w)).where("prev_id is not null").drop("written_at")


def changes(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """(stream_id, file_id, prev_id, op, change_kind, old_path, new_path): the edit script of each pair of files.

    parsed: from ``read_lines``. A stream's first file has no changes; a file without
    counted lines has an empty schema. Repeated lines change nothing. A rename needs at
    least one value in the shared samples, except that of the path stating the release.
    """
    pairs = cut(file_pairs(files))
    rows = parsed.select("file_id", "sample", F.inline("leaves"))
    schemas = cut(rows.groupBy("file_id", "path").agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias("type"), F.max("states").alias("states")))
    old = pairs.join(schemas.withColumnRenamed("file_id", "prev_id"), "prev_id").select("file_id", "prev_id", "path", F.col("type").alias("old_type"), F.col("states").alias("old_states"))
    new = pairs.join(schemas, "file_id").select("file_id", "prev_id", "path", F.col("type").alias("new_type"), F.col("states").alias("new_states"))
    # Leaves that stay as they are map to themselves: equal subtrees are dropped here.
    both = cut(old.join(new, ["file_id", "prev_id", "path"], "full").where("old_type is distinct from new_type"))
    gone = both.where("new_type is null").select("file_id", "prev_id", "path", F.col("old_states").alias("states"))
    came = both.where("old_type is null").select("file_id", "prev_id", "path", F.col("new_states").alias("states"))

    # Values of vanished and new paths in the samples that both files hold.
    samples = parsed.where("sample is not null").select("file_id", "sample").distinct()
    shared = pairs.join(samples, "file_id").join(samples.withColumnRenamed("file_id", "prev_id"), ["prev_id", "sample"]).select("file_id", "prev_id", "sample")
    values = rows.where("sample is not null").select("file_id", "sample", "path", F.xxhash64("sample", "value").alias("h"))

    def fingerprints(paths: DataFrame, side: str) -> DataFrame:
        held = values.withColumnRenamed("file_id", side).join(paths, [side, "path"])
        held = held.join(shared, ["file_id", "prev_id", "sample"], "left_semi").select("file_id", "path", "h").distinct()
        return held.groupBy("file_id", "path").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("total"), F.bit_xor("h").alias("bits"))

    equal = fingerprints(gone, "prev_id").withColumnRenamed("path", "p").join(fingerprints(came, "file_id").withColumnRenamed("path", "q"), ["file_id", "n", "total", "bits"]).select("file_id", "p", "q")
    stating = gone.where("states").select("file_id", F.col("path").alias("p")).join(came.where("states").select("file_id", F.col("path").alias("q")), "file_id")
    same = equal.unionByName(stating).distinct()

    empty = F.lit(None).cast("string")
    facts = both.select("file_id", "path", "old_type", "new_type", empty.alias("q")).unionByName(same.select("file_id", F.col("p").alias("path"), empty.alias("old_type"), empty.alias("new_type"), "q"))

    def script(group: pd.DataFrame) -> pd.DataFrame:
        facts = group[group.q.isna()]
        old = {p: t for p, t in zip(facts.path, facts.old_type) if isinstance(t, str)}
        new = {p: t for p, t in zip(facts.path, facts.new_type) if isinstance(t, str)}
        pairs = group[group.q.notna()]
        ops = edit_script(old, new, set(zip(pairs.path, pairs.q)))
        return pd.DataFrame([(group.file_id.iloc[0], op, KINDS[op], p, q) for op, p, q in ops], columns=["file_id", "op", "change_kind", "old_path", "new_path"])

    kind = files.schema["file_id"].dataType.simpleString()
    # The scripts are small to move and long to make: parts by number, which aren't merged by size.
    parts = max(2 * files.sparkSession.sparkContext.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = facts.repartition(parts, "file_id").groupBy("file_id").applyInPandas(script, f"file_id {kind}, op string, change_kind string, old_path string, new_path string")
    return pairs.join(found, "file_id")


def lineages(files: DataFrame, changed: DataFrame, parsed: DataFrame) -> DataFrame:
    """(file_id, path, column): the column of the one table to which each path of each file belongs.

    The scripts are followed from file to file of a stream: a path that comes begins a
    lineage, one renamed or moved goes on with the lineage its old path had before. So a
    name may mean one thing in one stream, or in some files, and another elsewhere.
    Lineages with a name in common are then merged, those with the most files first,
    unless some file has paths of both. A column takes the name under which most files
    have it and that no other column has.

    Lineages grow with changes, not with records, and are followed in tables, by doubling.
    To the driver come the distinct sets of names that lineages have had, and which of
    those with names in common meet in a file: both grow with the variety of names only.
    """
    spark = files.sparkSession
    w = Window.partitionBy("stream_id").orderBy("written_at", "file_id")
    order = pick(files, "stream_id", "file_id", "written_at").distinct().withColumn("at", F.row_number().over(w)).select("stream_id", "file_id", "at")
    present = parsed.select("stream_id", "file_id", F.explode("leaves.path").alias("path")).distinct()
    first = present.join(order.where("at = 1").select("file_id"), "file_id", "left_semi").select("stream_id", "file_id", F.lit(None).cast("string").alias("old_path"), F.col("path").alias("new_path"))
    begun = changed.where("change_kind in ('added', 'renamed')").select("stream_id", "file_id", F.when(F.col("change_kind") == "renamed", F.col("old_path")).alias("old_path"), "new_path")
    starts = first.unionByName(begun).join(order, ["stream_id", "file_id"]).select("stream_id", "at", "old_path", "new_path", F.struct("at", "new_path").alias("id"))
    starts = cut(starts)

    def before(rows: DataFrame) -> DataFrame:
        """rows (stream_id, path, t) with ``id``, the last start of that path at a time up to t."""
        events = starts.select("stream_id", F.col("new_path").alias("path"), F.col("at").alias("t"), F.lit(0).alias("kind"), "id", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[3:]])
        events = events.unionByName(rows.select(*rows.columns[:3], F.lit(1).alias("kind"), F.lit(None).cast(starts.schema["id"].dataType).alias("id"), *rows.columns[3:]))
        upto = Window.partitionBy("stream_id", "path").orderBy("t", "kind")
        return events.withColumn("id", F.last("id", ignorenulls=True).over(upto)).where("kind = 1").drop("kind")

    renamed = before(starts.where("old_path is not null").select("stream_id", F.col("old_path").alias("path"), (F.col("at") - 1).alias("t"), F.col("id").alias("own")))
    follow = cut(starts.where("old_path is null").select("stream_id", "id", F.col("id").alias("root")).unionByName(renamed.select("stream_id", F.col("own").alias("id"), F.coalesce("id", "own").alias("root"))))
    while True:
        up = follow.select("stream_id", F.col("id").alias("root"), F.col("root").alias("up"))
        stepped = cut(follow.join(up, ["stream_id", "root"], "left").select("stream_id", "id", "root", F.coalesce("up", "root").alias("up")))
        follow = stepped.select("stream_id", "id", F.col("up").alias("root"))
        if stepped.where("root != up").isEmpty():
            break
    placed = before(present.join(order, ["stream_id", "file_id"]).select("stream_id", "path", F.col("at").alias("t"), "file_id"))
    placed = cut(placed.join(follow, ["stream_id", "id"]).select("stream_id", "file_id", "path", "root"))
    names = placed.groupBy("stream_id", "root", "path").agg(F.count("*").alias("n")).groupBy("stream_id", "root").agg(F.array_sort(F.collect_list("path")).alias("names"), F.array_sort(F.collect_list(F.struct("path", "n"))).alias("held"))
    names = cut(names)
    sums = names.select("names", F.inline("held")).groupBy("names", "path").agg(F.sum("n").alias("n")).groupBy("names").agg(F.map_from_entries(F.collect_list(F.struct("path", "n"))).alias("held"))
    kinds = sorted((tuple(r.names), r.held) for r in sums.collect())
    # Sets of names that are connected through shared names; only within those do files matter.
    group = list(range(len(kinds)))

    def top(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    of_name: dict[str, list[int]] = {}
    for i, (ns, _) in enumerate(kinds):
        for n in ns:
            of_name.setdefault(n, []).append(i)
    for held in of_name.values():
        for i in held[1:]:
            group[top(i)] = top(held[0])
    table = spark.createDataFrame([(list(ns), i, top(i)) for i, (ns, _) in enumerate(kinds)], "names array<string>, kind int, component int")
    tagged = cut(placed.join(names.select("stream_id", "root", "names"), ["stream_id", "root"]).join(table, "names").select("file_id", "path", "root", "kind", "component"))
    big = [i for i in range(len(kinds)) if sum(top(j) == top(i) for j in {k for n in kinds[i][0] for k in of_name[n]}) > 1]
    side = tagged.where(F.col("kind").isin(big)) if big else tagged.limit(0)
    meet = side.select("file_id", "component", F.col("kind").alias("a"), F.col("root").alias("ra")).join(side.select("file_id", "component", F.col("kind").alias("b"), F.col("root").alias("rb")), ["file_id", "component"]).where("a <= b and ra != rb").select("a", "b").distinct()
    apart = {(r.a, r.b) for r in meet.collect()}
    members: list[set[int]] = [{i} for i in range(len(kinds))]
    links = sorted({(-min(kinds[i][1][n], kinds[j][1][n]), i, j) for n, held in of_name.items() for i in held for j in held if i < j})
    for _, i, j in links:
        a, b = members[i], members[j]
        if a is not b and not any((min(x, y), max(x, y)) in apart for x in a for y in b):
            a |= b
            for x in b:
                members[x] = a
    column, taken = {}, set()
    classes = sorted({min(m): m for m in members}.values(), key=lambda m: (-sum(sum(kinds[i][1].values()) for i in m), min(m)))
    for m in classes:
        weight: dict[str, int] = {}
        for i in m:
            for n, k in kinds[i][1].items():
                weight[n] = weight.get(n, 0) + k
        name = next((n for n in sorted(weight, key=lambda n: (-weight[n], n)) if n not in taken), None)
        k = 2
        while name is None or name in taken:
            name = f"{min(weight)}~{k}"
            k += 1
        taken.add(name)
        for i in m:
            column[i] = name
    chosen = spark.createDataFrame(sorted(column.items()), "kind int, column string")
    return tagged.join(chosen, "kind").select("file_id", "path", "column")


def unify(files: DataFrame, parsed: DataFrame, changed: DataFrame) -> DataFrame:
    """All counted records as one table: stream_id, file_id, line_id, sample and a column per lineage.

    Each file's script is compiled into a map from its paths to columns, and the map is
    the file's projection. Columns named like paths, with ``__`` for dots; a name
    that is taken (as in names that differ by case only) gets a trailing ``_``. They are
    typed if all files agree (bigint, double, boolean, text), else JSON text: so are
    integers beyond 64 bits, and integers beyond 2^53 in a column that also holds numbers
    with a point, as no type of Spark holds them whole.
    """
    columns = cut(lineages(files, changed, parsed))
    wide = lambda bits: F.coalesce(F.max(F.when(F.col("type") == "integer", F.coalesce(F.abs(F.col("value").try_cast("decimal(38,0)")) >= F.lit(str(2**bits)).cast("decimal(38,0)"), F.lit(True)))), F.lit(False))
    kinds = parsed.select("file_id", F.inline("leaves")).groupBy("file_id", "path", "type").agg(wide(63).alias("beyond"), wide(53).alias("inexact"))
    kinds = kinds.join(columns, ["file_id", "path"]).groupBy("column").agg(F.collect_set("type").alias("types"), F.max("beyond").alias("beyond"), F.max("inexact").alias("inexact")).orderBy("column").collect()
    projection = columns.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "column"))).alias("to"))
    # One map a record: a file has at most one path of each column.
    named = parsed.join(projection, "file_id", "left").withColumn("cells", F.map_from_entries(F.transform("leaves", lambda x: F.struct(F.col("to")[x["path"]], x["value"]))))

    def col(name: str, types: list[str], beyond: bool, inexact: bool):
        v = F.try_element_at("cells", F.lit(name))
        if types == ["string"]:
            return F.from_json(F.concat(F.lit('{"v":'), v, F.lit("}")), "v string")["v"]
        if types == ["boolean"]:
            return v.try_cast("boolean")
        if types == ["integer"] and not beyond:
            return v.try_cast("bigint")
        if types == ["number"] or (types == ["integer", "number"] and not inexact):
            return v.try_cast("double")
        return v

    fixed = ["stream_id", "file_id", "line_id", "sample"]
    taken, out = {f.lower() for f in fixed}, []
    for r in kinds:
        name = r["column"].replace(".", "__")
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(col(r["column"], sorted(r["types"]), r["beyond"], r["inexact"]).alias(name))
    return named.select(*fixed, *out)


def unified_cells(files: DataFrame, parsed: DataFrame, changed: DataFrame) -> DataFrame:
    """The table of ``unify`` in long form: (file_id, line_id, column, value), value as JSON text."""
    columns = lineages(files, changed, parsed)
    return parsed.select("file_id", "line_id", F.inline("leaves")).join(columns, ["file_id", "path"]).select("file_id", "line_id", "column", "value")
