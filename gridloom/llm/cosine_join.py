"""Weighted cosine join over inverted lists, with maximum-weight and residual-norm pruning.

Vectors are rows (id, term, weight) of unit length. Terms are ordered by document
frequency, most frequent first. A prefix of a vector whose dot product with any vector of
the other side stays below the threshold - by the greatest weights of its terms there, or
by its own norm, whichever is less - is left out of the inverted lists: any pair that
reaches the threshold still meets in some list, and the longest lists are those left out.
Pairs met are pruned by what their unlisted parts could add at most, and the rest get
their exact dot product. All joins are merge joins (``session.merged``): lists grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.session import cut, merged

EPS = 1e-9


def _lists(own: DataFrame, stats: DataFrame, other_max: str, threshold: float) -> DataFrame:
    """own with ``rest``, the most that the unlisted prefix can add to a dot product; listed rows only."""
    upto = Window.partitionBy("id").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    rows = own.join(merged(stats), "term").withColumn("reach", F.least(F.sum(F.col("weight") * F.col(other_max)).over(upto), F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(upto))))
    rows = rows.withColumn("listed", F.col("reach") >= threshold - EPS)
    rest = F.coalesce(F.max(F.when(~F.col("listed"), F.col("reach"))).over(Window.partitionBy("id")), F.lit(0.0))
    return rows.withColumn("rest", rest).where("listed").select("id", "term", "weight", "rest")


def cosine_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id, cosine) of all pairs with cosine of ``threshold`` (above 0) or more, each once.

    left, right: (id, term, weight), each (id, term) once, weights above 0, the squares of
    a vector's weights summing to 1. Terms of one side only still count for the norms.
    Empty sides give an empty result.
    """
    a = left.groupBy("term").agg(F.count("*").alias("na"), F.max("weight").alias("max_left"))
    b = right.groupBy("term").agg(F.count("*").alias("nb"), F.max("weight").alias("max_right"))
    # Terms that one side lacks add nothing to any dot product: they are never listed.
    # Cut, as each side needs another column of them: the lists would be counted for each anew.
    stats = cut(a.join(merged(b), "term").select("term", (F.col("na") + F.col("nb")).alias("df"), "max_left", "max_right"))
    x = _lists(left, stats, "max_right", threshold).select(F.col("id").alias("left_id"), "term", F.col("weight").alias("wx"), F.col("rest").alias("rx"))
    y = _lists(right, stats, "max_left", threshold).select(F.col("id").alias("right_id"), "term", F.col("weight").alias("wy"), F.col("rest").alias("ry"))
    met = x.join(merged(y), "term").groupBy("left_id", "right_id").agg(F.sum(F.col("wx") * F.col("wy")).alias("dot"), F.max(F.greatest("rx", "ry")).alias("rest"))
    kept = cut(met.where(F.col("dot") + F.col("rest") >= threshold - EPS))
    # Without a rest the dot product is whole; the others' vectors are joined in full.
    whole = kept.where("rest = 0").select("left_id", "right_id", "dot")
    pairs = kept.where("rest > 0").select("left_id", "right_id")
    lt = left.select(F.col("id").alias("left_id"), "term", F.col("weight").alias("wx"))
    rt = right.select(F.col("id").alias("right_id"), "term", F.col("weight").alias("wy"))
    dots = pairs.join(merged(lt), "left_id").join(merged(rt), ["right_id", "term"]).groupBy("left_id", "right_id").agg(F.sum(F.col("wx") * F.col("wy")).alias("dot"))
    exact = whole.unionByName(dots)
    return exact.where(F.col("dot") >= threshold - EPS).select("left_id", "right_id", F.col("dot").alias("cosine"))
