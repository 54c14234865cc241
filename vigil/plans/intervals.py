"""First enclosing interval of a point, without pairing points and intervals.

Intervals of a key may overlap or nest in any number.  Where only the first
one (by start) that holds a point is wanted, each interval matters just on
the part that no earlier interval reaches: from the largest end before it to
its own end.  These parts are disjoint, so one as-of lookup by start, with a
test of the end, finds the interval; its cost does not depend on how many
intervals cover a point.
"""
from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.plans.prefix import asof, running


def first_enclosing(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, start: str, end: str,
                    payload: Sequence[str], out: str, block_of: Callable[[Column], Column]) -> DataFrame:
    """points plus ``out`` = struct of ``payload`` of the first interval [start, end] that holds the point, or null.

    Starts are unique within a key.  ``block_of`` maps a position to its block
    and must be monotone.
    """
    keys = list(keys)
    iv = intervals.select(*keys, F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"),
                          F.struct(*payload).alias("_p"))
    iv = running(iv, keys, ["_s"], block_of(F.col("_s")), F.col("_e"), "_reached", how="max", inclusive=False)
    iv = iv.withColumn("_from", F.greatest(F.col("_s"), F.col("_reached") + 1)).filter("_from <= _e")
    found = asof(points, iv, keys, F.col(point).cast("long"), F.col("_from"), F.struct("_e", "_p"), "_hit", block_of,
                 direction="backward", strict=False)
    hit = F.when(F.col(point) <= F.col("_hit")["_e"], F.col("_hit")["_p"])
    return found.withColumn(out, hit).drop("_hit")
