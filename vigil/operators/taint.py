"""Taint points (G5, G6), source-to-sink candidates (G7, X2) and the sensitive-sink catalogue."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import catalog as C


def taint_points(lines: DataFrame) -> DataFrame:
    """taint_points(path, line, kind, label, pattern_ord): every source / sink pattern hitting a line.

    Several rows per line are kept (one per matching pattern); one narrow pass.
    """
    def entries(kind, table):
        return [F.when(F.col("text").rlike(p), F.struct(F.lit(kind).alias("kind"), F.lit(lbl).alias("label"),
                                                          F.lit(k).alias("pattern_ord")))
                for k, (p, lbl) in enumerate(table)]
    arr = F.filter(F.array(*entries("source", C.TAINT_SOURCES), *entries("sink", C.TAINT_SINKS)),
                   lambda e: e.isNotNull())
    return lines.select("path", "line", F.explode(arr).alias("t")).select("path", "line", "t.*")


def call_sinks(calls: DataFrame) -> DataFrame:
    """G8 (catalogue data): calls whose last name segment is a listed sink of the file's language.

    Returns (path, language, line, call_ord, name, sink_kind); a name listed
    under several kinds yields one row per kind.
    """
    last = F.element_at(F.split(F.col("name"), r"\.|->|::", -1), -1)
    out = None
    for lang, kinds in C.SENSITIVE_SINKS.items():
        arr = F.filter(F.array(*[F.when(last.isin(*names) | F.col("name").isin(*names), F.lit(kind))
                                 for kind, names in kinds.items() if names]), lambda k: k.isNotNull()) \
            if any(kinds.values()) else F.array().cast("array<string>")
        out = F.when(F.col("language") == lang, arr) if out is None else out.when(F.col("language") == lang, arr)
    out = out.otherwise(F.array().cast("array<string>"))
    return calls.select("path", "language", "line", "call_ord", "name", F.explode(out).alias("sink_kind"))


def taint_candidates(points: DataFrame, functions: DataFrame) -> DataFrame:
    """X2 (extension of G7): every sink with the nearest source at or above it in the same function.

    (path, fn_id, function, source_line, source_label, sink_line, sink_label).
    One row per sink, not per pair: a function full of both stays linear.
    Two sources on one line: the later pattern counts.
    """
    from vigil.operators.graph import LINE_BLOCK, enclosing_function
    from vigil.plans.prefix import asof
    d = enclosing_function(points, functions, "_fn").filter("_fn IS NOT NULL")
    d = d.select("path", F.col("_fn.fn_id").alias("fn_id"), F.col("_fn.name").alias("function"), "line", "kind", "label", "pattern_ord")
    sources = d.filter("kind = 'source'").groupBy("path", "fn_id", "line").agg(F.max_by("label", "pattern_ord").alias("label"))
    sinks = d.filter("kind = 'sink'").select("path", "fn_id", "function", F.col("line").alias("sink_line"), F.col("label").alias("sink_label"))
    found = asof(sinks, sources, ["path", "fn_id"], F.col("sink_line").cast("long"), F.col("line").cast("long"),
                 F.struct("line", "label"), "_source", lambda p: F.floor(p / F.lit(LINE_BLOCK)), direction="backward", strict=False)
    return found.filter("_source IS NOT NULL").select(
        "path", "fn_id", "function", F.col("_source.line").alias("source_line"), F.col("_source.label").alias("source_label"),
        "sink_line", "sink_label")
