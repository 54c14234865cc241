"""Ordinals of a sorted key (e.g. file order), computed without a single-partition window."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.session import materialized


def ordinals(df: DataFrame, col: str, out: str) -> DataFrame:
    """(col, out) for the distinct values of ``col``; out grows with the sort order (with gaps).

    A range-partitioned sort numbers each partition's rows above the one
    before; nothing leaves the JVM.  The table is checkpointed, as a later
    evaluation could cut the ranges elsewhere.
    """
    keys = df.select(col).distinct().orderBy(col)
    return materialized(keys.withColumn(out, F.monotonically_increasing_id()))
