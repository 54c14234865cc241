"""Call graph (G1-G3), counts (A5) and bounded reachability.

nodes: one per function.  edges: for every call on a line of kind 'other',
  caller = the first function (in file order) whose [line, end_line] holds
           the call line                       (disjoint ranges, one as-of)
  callee = the last definition of the call's exact name among the files read
           so far (file order = path order), the call's own file included
                                               (blocked as-of on name)
Calls without a caller or without a callee give no edge; edges are not
deduplicated.  The caller's name travels with its range and the callee's is
the call's own, so named edges need no join on ids.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.plans.intervals import first_enclosing
from vigil.plans.ordinals import ordinals
from vigil.plans.prefix import asof
from vigil.session import materialized

LINE_BLOCK = 1024           # lines per block of the caller lookup
FILE_BLOCK = 4096           # files per block of the name as-of


def _line_block(line):
    return F.floor(line / F.lit(LINE_BLOCK))


def call_nodes(functions: DataFrame) -> DataFrame:
    return functions.select(F.col("fn_id").alias("node_id"), "name",
                            F.when(F.col("is_method"), "method").otherwise("function").alias("type"),
                            F.col("path").alias("file"), "line")


def enclosing_function(points: DataFrame, functions: DataFrame, out: str) -> DataFrame:
    """points(path, line, ...) plus ``out`` = struct(fn_id, name) of the first function whose lines hold the point."""
    return first_enclosing(points, functions, ["path"], "line", "line", "end_line", ["fn_id", "name"], out, _line_block)


def resolved(functions: DataFrame, calls: DataFrame, strict_order: bool = True) -> DataFrame:
    """calls(language, name, path, ...) whose exact name is defined, plus ``to_id``, the definition.

    strict_order=True resolves a name to the last definition among files up to
    the calling file (reading order); False uses the whole corpus' last one.
    """
    # definitions are reduced to the last one per (name, file) before the lookup;
    # names resolve within one language (one graph per language, built in one job)
    last_def = functions.groupBy("language", "name", "path").agg(F.max_by("fn_id", "line").alias("to_id"))
    names = ["language", "name"]
    if not strict_order:
        return calls.join(last_def.groupBy(*names).agg(F.max_by("to_id", "path").alias("to_id")), names)
    order = ordinals(functions.select("path"), "path", "file_ord")
    # a calling file defines the caller, so every calling file has an ordinal
    defs = last_def.join(order, "path")
    want = calls.select(*names, "path").distinct().join(order, "path")
    found = asof(want, defs, names, F.col("file_ord"), F.col("file_ord"), F.col("to_id"), "to_id",
                 lambda p: F.floor(p / F.lit(FILE_BLOCK)), direction="backward", strict=False)
    return calls.join(found.select(*names, "path", "to_id"), [*names, "path"]).filter("to_id IS NOT NULL")


def call_edges(functions: DataFrame, calls: DataFrame, strict_order: bool = True) -> DataFrame:
    """edges(from_id, from_name, to_id, to_name, path, language, line, call_ord); names as in resolved()."""
    fns = functions.select("fn_id", "path", "language", "name", "line", "end_line")
    c = enclosing_function(calls.select("path", "language", "line", "call_ord", "name"), fns, "_caller")
    e = resolved(fns, c.filter("_caller IS NOT NULL"), strict_order)
    return e.select(F.col("_caller.fn_id").alias("from_id"), F.col("_caller.name").alias("from_name"), "to_id",
                    F.col("name").alias("to_name"), "path", "language", "line", "call_ord")


def counts(**tables: DataFrame) -> DataFrame:
    """A5: one row (name, n) per table, e.g. counts(nodes=..., edges=..., sources=..., sinks=...)."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int = 10, checkpoint_every: int = 3) -> DataFrame:
    """X1 (extension): (src, dst, depth) of nodes within max_depth calls of the start nodes, shortest depth.

    starts: a ``src`` column of node ids, the entry points of interest; the
    result has at most starts x nodes rows.  The pairs are checkpointed every
    few rounds to cut lineage.
    """
    e = edges.select(F.col("from_id").alias("_a"), F.col("to_id").alias("_b")).distinct()
    frontier = starts.select("src").distinct().withColumn("dst", F.col("src"))
    seen = None
    for d in range(1, max_depth + 1):
        nxt = frontier.join(e, F.col("dst") == F.col("_a")).select("src", F.col("_b").alias("dst")).distinct()
        if seen is not None:
            nxt = nxt.join(seen.select("src", "dst"), ["src", "dst"], "left_anti")
        found = nxt.withColumn("depth", F.lit(d))
        seen = found if seen is None else seen.unionByName(found)
        frontier = nxt
        if d % checkpoint_every == 0:
            seen, frontier = materialized(seen), materialized(frontier)
            if frontier.isEmpty():
                break
    return seen
