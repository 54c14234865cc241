"""File profile (F21, A7, W7): per-file structure counts, first functions and classes."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.detect import findings_array, prepared
from vigil.operators.facts import is_class_line, is_function_line

#: Lines of a piece of a file in which functions are ranked first.
PIECE_LINES = 4096


def file_profile(annotated: DataFrame) -> DataFrame:
    """(path, language, n_lines, n_functions, n_classes, n_imports, n_calls, n_findings) of annotated lines.

    Every count is a property of a line, so one pass and one partial
    aggregation per file give them all.
    """
    def n(c):
        return F.sum(c.cast("long"))
    return prepared(annotated).groupBy("path", "language").agg(
        F.count("*").alias("n_lines"), n(is_function_line()).alias("n_functions"), n(is_class_line()).alias("n_classes"),
        n(F.size("imports")).alias("n_imports"), n(F.size("calls")).alias("n_calls"),
        n(F.size(findings_array())).alias("n_findings"))


def first_functions(functions: DataFrame, n: int = 20) -> DataFrame:
    """The first n functions of each file by line.

    Ranked inside pieces of a file first, so a file with very many functions
    is not one window partition; at most n of each piece are ranked again.
    """
    inner = Window.partitionBy("path", "_piece").orderBy("line")
    d = functions.withColumn("_piece", F.floor(F.col("line") / F.lit(PIECE_LINES)))
    d = d.withColumn("_rn", F.row_number().over(inner)).filter(F.col("_rn") <= n)
    d = d.withColumn("_rn", F.row_number().over(Window.partitionBy("path").orderBy("line")))
    return d.filter(F.col("_rn") <= n).drop("_rn", "_piece")
