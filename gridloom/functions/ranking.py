"""Ranks within values, without sorting a hot value in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.session import cut

#: Rows that are sorted together, about.
ROWS = 500_000


def _placed(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows, each with a part ``__b`` of its value, ranked: parts in order of their number, rows of a part in ``order``."""
    counts = rows.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__b").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*by, "__b").orderBy(*order)
    same = F.col("__b") == F.col("__at")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__by{i}"))
    joined = rows.withColumn("__r", F.row_number().over(within) - 1).join(starts, same)
    return joined.withColumn(name, (F.col("__start") + F.col("__r")).cast("bigint")).drop("__b", "__r", "__at", "__start", *[f"__by{i}" for i in range(len(by))])


def ranked(df: DataFrame, by: str, order: list[str], rows: int = ROWS) -> DataFrame:
    """``df`` with ``rank``, from 0, among the rows of equal ``by``, in the order of a hash of ``order``.

    A value's rows are spread by the hash over as many buckets as its count asks for; the
    counts per bucket, a small table, give each bucket's first rank, and only a bucket is
    sorted in one task. ``order`` must tell the rows of a value apart. ``df`` is read three times.
    """
    keyed = df.withColumn("__h", F.xxhash64(*order))
    sizes = keyed.groupBy(by).agg(F.ceil(F.count("*") / rows).alias("__k"))
    return _placed(keyed.join(sizes, by).withColumn("__b", F.pmod("__h", "__k")).drop("__k"), [by], ["__h", *order], "rank").drop("__h")


def ranked_in_order(df: DataFrame, by: list[str], order: list[str], name: str = "rank", rows: int = ROWS) -> DataFrame:
    """``df`` with ``name``, the place from 0 among the rows of equal ``by`` in the order of the columns ``order``.

    Rows are cut into ranges of values and order, of about equal size, so that a value
    with a third of all rows lies in many of them; only a range is sorted in one task.
    The ranges come from a sample and are written down, so a lost task cannot change them.
    """
    spark = df.sparkSession
    held = cut(df)
    parts = max(spark.sparkContext.defaultParallelism, -(-held.count() // rows))
    ranges = cut(held.repartitionByRange(parts, *by, *order).withColumn("__b", F.spark_partition_id()))
    return _placed(ranges, by, order, name)
