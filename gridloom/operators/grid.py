"""Grid algebra as expressions over a table's array of cells.

A table is one row; its cells are an array of structs. All operators here are column
expressions on that array, so they need no shuffle and run where the table lies.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.text import SPACE, strip

CELL = "struct<row:int,col:int,rowspan:int,colspan:int,text:string,tag:string,bbox:array<double>,confidence:double>"
CELLS = f"array<{CELL}>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it.

    A column used once within a lambda would be inlined there by the optimizer, and be
    evaluated for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def canonical_cell(c: Column, geometry: bool = True) -> Column:
    """One cell with defaults: row and col 0, spans at least 1, stripped text, tag ``td`` unless ``th``.

    With geometry, the first four box coordinates and the confidence are rounded to 6
    places, half to even; a missing confidence stays null and is never a score.
    """
    fields = [
        F.coalesce(c["row"].cast("int"), F.lit(0)).alias("row"),
        F.coalesce(c["col"].cast("int"), F.lit(0)).alias("col"),
        F.greatest(F.lit(1), F.coalesce(c["rowspan"].cast("int"), F.lit(1))).alias("rowspan"),
        F.greatest(F.lit(1), F.coalesce(c["colspan"].cast("int"), F.lit(1))).alias("colspan"),
        strip(F.coalesce(c["text"], F.lit(""))).alias("text"),
        F.when(F.lower(c["tag"]) == "th", "th").otherwise("td").alias("tag"),
        (F.transform(F.slice(c["bbox"], 1, 4), lambda x: F.bround(x, 6)) if geometry else F.lit(None).cast("array<double>")).alias("bbox"),
        (F.bround(c["confidence"], 6) if geometry else F.lit(None).cast("double")).alias("confidence"),
    ]
    return F.struct(*fields)


def canonical_cells(cells: Column, geometry: bool = True) -> Column:
    """Canonical cells in the order of (row, col, rowspan, colspan, text, tag); a null array is empty, null cells are left out."""
    made = F.transform(F.filter(cells, lambda c: c.isNotNull()), lambda c: canonical_cell(c, geometry))
    return F.coalesce(F.array_sort(made), F.array().cast(CELLS))


def from_interval(c: Column) -> Column:
    """A cell given by half-open intervals as a span cell; an empty interval gets span 1."""
    return F.struct(
        c["row_start"].alias("row"),
        c["col_start"].alias("col"),
        (c["row_end"] - c["row_start"]).alias("rowspan"),
        (c["col_end"] - c["col_start"]).alias("colspan"),
        c["text"].alias("text"),
        c["tag"].alias("tag"),
        c["geometry"]["bbox"].alias("bbox"),
        F.lit(None).cast("double").alias("confidence"),
    )


def topology_key(c: Column) -> Column:
    return F.struct(c["row"].alias("row"), c["col"].alias("col"), c["rowspan"].alias("rowspan"), c["colspan"].alias("colspan"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_all(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda a: None if a is None else [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in a])


def normalized_texts(cells: Column) -> Column:
    """The cells' texts in NFKC without white space, in order; one Arrow call per batch of tables."""
    return F.transform(_nfkc_all(F.transform(cells, lambda c: F.coalesce(c["text"], F.lit("")))), lambda t: F.regexp_replace(t, f"{SPACE}+", ""))


def strict_keys(cells: Column, texts: Column) -> Column:
    """Topology, normalised text and tag of each cell; texts from ``normalized_texts``."""
    return F.zip_with(cells, texts, lambda c, t: F.struct(c["row"].alias("row"), c["col"].alias("col"), c["rowspan"].alias("rowspan"), c["colspan"].alias("colspan"), t.alias("text"), c["tag"].alias("tag")))


def n_rows(cells: Column) -> Column:
    """Greatest row + rowspan, 0 for no cells; the span is not clamped."""
    return F.coalesce(F.array_max(F.transform(cells, lambda c: c["row"] + F.when(F.coalesce(c["rowspan"], F.lit(0)) == 0, 1).otherwise(c["rowspan"]))), F.lit(0))


def n_cols(cells: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(cells, lambda c: c["col"] + F.when(F.coalesce(c["colspan"], F.lit(0)) == 0, 1).otherwise(c["colspan"]))), F.lit(0))


def slots(cells: Column) -> Column:
    """(row, col, idx) of every slot of every canonical cell, by row, col and cell."""
    of = lambda c, i: F.flatten(F.transform(F.sequence(c["row"], c["row"] + c["rowspan"] - 1), lambda r: F.transform(F.sequence(c["col"], c["col"] + c["colspan"] - 1), lambda k: F.struct(r.alias("row"), k.alias("col"), i.alias("idx")))))
    return F.array_sort(F.flatten(F.transform(cells, of)))


def overlaps(slots_: Column) -> Column:
    """(idx, other, row, col) for each slot a cell takes that an earlier one holds; other is the latest earlier holder."""
    at = lambda i: F.get(slots_, i)
    pairs = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(slots_) - 1, F.lit(1))), lambda i: (at(i)["row"] == at(i - 1)["row"]) & (at(i)["col"] == at(i - 1)["col"])), lambda i: F.struct(at(i)["idx"].alias("idx"), at(i - 1)["idx"].alias("other"), at(i)["row"].alias("row"), at(i)["col"].alias("col")))
    return F.array_sort(pairs)


def validate(df: DataFrame, cells: str, require_complete: bool = True) -> DataFrame:
    """``df`` with n_cells, n_rows, n_cols, n_slots, n_negative, n_overlaps, n_holes, errors and status.

    ``cells`` is canonical. errors are the messages, in order; a table without cells has
    none. Holes count slots of the table's rectangle that no cell holds.
    """
    c, s = F.col(cells), F.col("__slots")
    step = df.withColumn("__slots", slots(c)).withColumn("n_cells", F.size(c)).withColumn("n_rows", n_rows(c)).withColumn("n_cols", n_cols(c))
    inside = F.array_distinct(F.transform(F.filter(s, lambda x: (x["row"] >= 0) & (x["col"] >= 0)), lambda x: F.struct(x["row"], x["col"])))
    step = step.withColumn("__over", overlaps(s))
    negative = F.filter(F.transform(c, lambda x, i: F.when((x["row"] < 0) | (x["col"] < 0), i)), lambda i: i.isNotNull())
    step = step.withColumn("n_slots", F.size(F.array_distinct(F.transform(s, lambda x: F.struct(x["row"], x["col"]))))).withColumn("n_negative", F.size(negative)).withColumn("n_overlaps", F.size("__over"))
    holes = F.greatest(F.col("n_rows") * F.col("n_cols") - F.size(inside), F.lit(0)) if require_complete else F.lit(0)
    step = step.withColumn("n_holes", F.when(F.col("n_cells") > 0, holes).otherwise(0))
    messages = F.concat(
        F.transform(negative, lambda i: F.format_string("cell[%d] has negative index", i)),
        F.transform("__over", lambda o: F.format_string("cell[%d] overlaps cell[%d] at (%d, %d)", o["idx"], o["other"], o["row"], o["col"])),
        F.when(F.col("n_holes") > 0, F.array(F.format_string("grid has %d holes", F.col("n_holes")))).otherwise(F.array().cast("array<string>")),
    )
    return step.withColumn("errors", messages).withColumn("status", F.when(F.size("errors") == 0, "PASS").otherwise("FAIL")).drop("__slots", "__over")


def is_legal(df: DataFrame, cells: str) -> DataFrame:
    """Only tables with at least one cell and no errors."""
    return validate(df, cells).where("status = 'PASS' and n_cells > 0")


def owners(cells: Column) -> Column:
    """Owner of each slot of a legal grid, row by row: cell indexes."""
    return F.transform(slots(cells), lambda s: s["idx"])


def merge_right(owner: Column, rows: Column, cols: Column) -> Column:
    """(row, col, same) for neighbours within a row of a legal grid, same = 1 where one cell holds both."""
    return _neighbours(owner, rows, cols - 1, cols, F.lit(1))


def merge_down(owner: Column, rows: Column, cols: Column) -> Column:
    return _neighbours(owner, rows - 1, cols, cols, cols)


def _range(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _neighbours(owner: Column, rows: Column, cols: Column, width: Column, step: Column) -> Column:
    return F.flatten(F.transform(_range(rows), lambda r: F.transform(_range(cols), lambda c: F.struct(r.alias("row"), c.alias("col"), (F.get(owner, r * width + c) == F.get(owner, r * width + c + step)).cast("int").alias("same")))))


def header_mask(cells: Column, owner: Column, cols: Column) -> Column:
    """(row, col, header) of each slot, 1 where the holder's tag is ``th``."""
    return F.transform(owner, lambda o, i: F.struct(F.floor(i / cols).cast("int").alias("row"), (i % cols).cast("int").alias("col"), (F.get(cells, o)["tag"] == "th").cast("int").alias("header")))


def difference(prior: Column, gold: Column) -> Column:
    """(kind, row, col, rowspan, colspan): topologies only in prior (``remove_prior_cell``), then only in gold (``add_gold_cell``), each sorted."""
    p = F.array_distinct(F.transform(prior, topology_key))
    g = F.array_distinct(F.transform(gold, topology_key))
    named = lambda a, kind: F.transform(F.array_sort(a), lambda k: F.struct(F.lit(kind).alias("kind"), k["row"].alias("row"), k["col"].alias("col"), k["rowspan"].alias("rowspan"), k["colspan"].alias("colspan")))
    return F.concat(named(F.array_except(p, g), "remove_prior_cell"), named(F.array_except(g, p), "add_gold_cell"))


def same_topology(prior: Column, gold: Column) -> Column:
    return F.size(difference(prior, gold)) == 0


def _last_by_topology(keys: Column) -> Column:
    """Strict keys, for each topology the last one only."""
    return F.filter(keys, lambda k, i: ~F.exists(F.slice(keys, i + 2, F.size(keys)), lambda o: topology_key(o) == topology_key(k)))


def raw_gold_diff(df: DataFrame) -> DataFrame:
    """keep, update, removed, added by topology and content, of canonical ``raw`` and ``gold`` with ``raw_keys`` and ``gold_keys`` (strict). Of cells with one topology the last counts."""
    step = df.withColumn("__r", _last_by_topology(F.col("raw_keys"))).withColumn("__g", _last_by_topology(F.col("gold_keys")))
    top = lambda c: F.transform(c, topology_key)
    return (
        step.withColumn("keep", F.size(F.array_intersect("__r", "__g")))
        .withColumn("update", F.size(F.array_intersect(top("__r"), top("__g"))) - F.col("keep"))
        .withColumn("removed", F.size(F.array_except(top("__r"), top("__g"))))
        .withColumn("added", F.size(F.array_except(top("__g"), top("__r"))))
        .drop("__r", "__g")
    )


#: Cells beyond which a table is large, rows beyond which it is long.
LARGE_CELLS, LONG_ROWS = 50, 32


def classify(df: DataFrame) -> DataFrame:
    """The thirteen classes of the step from canonical ``raw`` to canonical ``gold`` with strict ``raw_keys`` and ``gold_keys``."""
    raw, gold = F.col("raw"), F.col("gold")
    crosses = lambda a, b: F.exists(a, lambda x: F.size(F.filter(b, lambda y: (x["row"] < y["row"] + y["rowspan"]) & (y["row"] < x["row"] + x["rowspan"]) & (x["col"] < y["col"] + y["colspan"]) & (y["col"] < x["col"] + x["colspan"]))) > 1)
    last_tag = lambda x: F.element_at(F.transform(F.filter(gold, lambda g: topology_key(g) == topology_key(x)), lambda g: g["tag"]), -1)
    has = lambda x: F.exists(gold, lambda g: topology_key(g) == topology_key(x))
    a, b = F.array_distinct("raw_keys"), F.array_distinct("gold_keys")
    return (
        df.withColumn("identity", (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0))
        .withColumn("missing_row_separator", n_rows(raw) < n_rows(gold))
        .withColumn("extra_row_separator", n_rows(raw) > n_rows(gold))
        .withColumn("missing_column_separator", n_cols(raw) < n_cols(gold))
        .withColumn("extra_column_separator", n_cols(raw) > n_cols(gold))
        .withColumn("split_needed", crosses(raw, gold))
        .withColumn("merge_needed", crosses(gold, raw))
        .withColumn("mixed_split_merge", F.col("split_needed") & F.col("merge_needed"))
        .withColumn("empty_cells", F.exists("gold_keys", lambda k: k["text"] == ""))
        .withColumn("spanning_cells", F.exists(gold, lambda c: (c["rowspan"] > 1) | (c["colspan"] > 1)))
        .withColumn("large_table", F.size(gold) > LARGE_CELLS)
        .withColumn("long_table", n_rows(gold) > LONG_ROWS)
        .withColumn("header_change", F.exists(raw, lambda x: F.when(has(x), x["tag"] != last_tag(x)).otherwise(F.lit(False))))
    )


CLASSES = ["identity", "missing_row_separator", "extra_row_separator", "missing_column_separator", "extra_column_separator", "split_needed", "merge_needed", "mixed_split_merge", "empty_cells", "spanning_cells", "large_table", "long_table", "header_change"]


def structure_text(rows: Column, cols: Column, cells: Column) -> Column:
    """A table's structure as text of integers and tags, for digests without leaving the JVM."""
    return F.concat_ws("|", rows.cast("string"), cols.cast("string"), F.array_join(F.transform(cells, lambda c: F.concat_ws(",", c["row"], c["col"], c["rowspan"], c["colspan"], c["tag"])), ";"))


def semantic_text(rows: Column, cols: Column, cells: Column) -> Column:
    """Structure and texts; geometry and tokens are left out. Texts are length-prefixed."""
    return F.concat_ws("|", structure_text(rows, cols, cells), F.array_join(F.transform(cells, lambda c: F.concat(F.length(c["text"]).cast("string"), F.lit(":"), c["text"])), ";"))


def validate_rows(cells: DataFrame, key: str) -> DataFrame:
    """Validation of tables whose cells are rows (key, row, col, rowspan, colspan): counts and status per table.

    Slots are counted before they are shuffled and no table is gathered, so a table with a
    third of all cells is no hot spot.
    """
    clean = cells.select(key, F.coalesce("row", F.lit(0)).alias("row"), F.coalesce("col", F.lit(0)).alias("col"), F.greatest(F.lit(1), F.coalesce("rowspan", F.lit(1))).alias("rowspan"), F.greatest(F.lit(1), F.coalesce("colspan", F.lit(1))).alias("colspan"))
    per = clean.groupBy(key).agg(
        F.count("*").alias("n_cells"),
        F.max(F.col("row") + F.col("rowspan")).alias("n_rows"),
        F.max(F.col("col") + F.col("colspan")).alias("n_cols"),
        F.sum(((F.col("row") < 0) | (F.col("col") < 0)).cast("bigint")).alias("n_negative"),
    )
    taken = clean.select(key, "col", "colspan", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1)).alias("r"))
    taken = taken.select(key, "r", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1)).alias("c"))
    held = taken.groupBy(key, "r", "c").agg(F.count("*").alias("n"))
    held = held.groupBy(key).agg(F.count("*").alias("n_slots"), F.sum(F.col("n") - 1).alias("n_overlaps"), F.sum(((F.col("r") >= 0) & (F.col("c") >= 0)).cast("bigint")).alias("inside"))
    out = per.join(held, key).withColumn("n_holes", F.greatest(F.col("n_rows").cast("bigint") * F.col("n_cols") - F.col("inside"), F.lit(0)))
    return out.withColumn("status", F.when(F.col("n_negative") + F.col("n_overlaps") + F.col("n_holes") == 0, "PASS").otherwise("FAIL")).drop("inside")
