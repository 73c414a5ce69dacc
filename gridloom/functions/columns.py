"""Choosing columns of tables that may hold more, under any names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with just these columns, by exact name; other columns may share a name but for case, or repeat one (the first counts)."""
    have = df.columns
    lowered = [c.lower() for c in have]
    if all(lowered.count(n.lower()) == 1 for n in names):
        return df.select(*[F.col(f"`{n}`") for n in names])
    renamed = df.toDF(*[f"__{i}" for i in range(len(have))])
    at = lambda n: have.index(n) if n in have else lowered.index(n.lower())
    return renamed.select(*[F.col(f"__{at(n)}").alias(n) for n in names])
