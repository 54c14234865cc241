"""Blocked two-level scans.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key to
one task; with one hot file, name or user holding a third of the data that
task is the whole job.  The helpers here split each key's ordered rows into
blocks of bounded width and compute

1. one partial aggregate per (key, block)                (groupBy, map-side combine)
2. the carry into each block from the earlier blocks      (window over the small block table)
3. the running value inside each block                    (window over (key, block))

so no window partition holds more than one block or one key's block table.
The join in step 3 is on (key, block); the in-block window reuses its
hash partitioning, so the large side is shuffled once.
"""
from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UNB = Window.unboundedPreceding


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
            value: Column, out: str, how: str = "sum", inclusive: bool = True,
            descending: bool = False) -> DataFrame:
    """Add ``out`` = running aggregate of ``value`` over ``order`` within ``keys``.

    how='sum'  : running sum (nulls count as 0)
    how='max'  : largest value so far (null before the first)
    how='last' : last non-null value (carry forward)
    ``block`` must be monotone (non-decreasing) in ``order``; ``inclusive``
    decides whether the current row takes part; ``descending`` runs the scan
    from the end (giving "next" instead of "previous").
    """
    keys = list(keys)
    d = df.withColumn("_blk", block).withColumn("_val", value)
    okey = F.struct(*[F.col(c) for c in order])
    if how == "sum":
        per_blk = d.groupBy(*keys, "_blk").agg(F.sum("_val").alias("_bv"))
    elif how == "max":
        per_blk = d.groupBy(*keys, "_blk").agg(F.max("_val").alias("_bv"))
    elif how == "last":
        pick = F.min_by if descending else F.max_by
        per_blk = d.groupBy(*keys, "_blk").agg(
            pick("_val", F.when(F.col("_val").isNotNull(), okey)).alias("_bv"))
    else:
        raise ValueError(how)
    blk_order = F.col("_blk").desc() if descending else F.col("_blk").asc()
    wb = Window.partitionBy(*keys).orderBy(blk_order).rowsBetween(_UNB, -1)
    if how == "sum":
        carry = per_blk.select(*keys, "_blk", F.coalesce(F.sum("_bv").over(wb), F.lit(0)).alias("_carry"))
    elif how == "max":
        carry = per_blk.select(*keys, "_blk", F.max("_bv").over(wb).alias("_carry"))
    else:
        carry = per_blk.select(*keys, "_blk", F.last("_bv", ignorenulls=True).over(wb).alias("_carry"))
    j = d.join(carry, on=[*keys, "_blk"], how="inner")
    ocols = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    wr = Window.partitionBy(*keys, "_blk").orderBy(*ocols).rowsBetween(_UNB, 0 if inclusive else -1)
    if how == "sum":
        res = F.col("_carry") + F.coalesce(F.sum("_val").over(wr), F.lit(0))
    elif how == "max":
        res = F.greatest(F.col("_carry"), F.max("_val").over(wr))
    else:
        res = F.coalesce(F.last("_val", ignorenulls=True).over(wr), F.col("_carry"))
    return j.withColumn(out, res).drop("_blk", "_val", "_carry")


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_pos: Column,
         right_pos: Column, value: Column, out: str, block_of: Callable[[Column], Column],
         direction: str = "backward", strict: bool = True) -> DataFrame:
    """For each left row, the ``value`` of the nearest right row with equal keys.

    backward: largest right_pos  < left_pos (<= when not strict)
    forward : smallest right_pos > left_pos (>= when not strict)
    Implemented as one union + blocked carry-forward, so neither a hot key
    nor a long run of left rows ends up in one window partition.
    """
    keys = list(keys)
    fwd = direction == "forward"
    # tie order at equal position: decides whether an equal right row is visible
    left_tie, right_tie = (0, 1) if (strict != fwd) else (1, 0)
    lcols = left.columns
    lq = left.withColumn("_pos", left_pos).withColumn("_tie", F.lit(left_tie)).withColumn("_side", F.lit(0))
    rq = right.select(*[F.col(k) for k in keys], right_pos.alias("_pos"), F.lit(right_tie).alias("_tie"),
                      F.lit(1).alias("_side"), value.alias("_v"))
    u = lq.unionByName(rq, allowMissingColumns=True)
    r = running(u, keys, ["_pos", "_tie"], block_of(F.col("_pos")), F.col("_v"), out,
                how="last", inclusive=True, descending=fwd)
    return r.filter(F.col("_side") == 0).select(*lcols, out)
