"""Taint flows across functions (G7 and X2, the part that needs the call graph).

A flow leads from a source line to a sink line through names:

* inside a function, a line hands every name of its right-hand side on to the
  name it assigns, every name of a returned expression on to the function's
  result, and every name on a sink line to that sink;
* a call hands the names of its k-th argument on to the callee's k-th
  parameter, and the callee's result on to what its line assigns, returns or
  sinks.  A call's arguments count as part of its line, so the result of any
  call carries them (known or not), as is usual where a callee is not read.

Two summaries of a function result: what its return carries (from sources in
it and below it) and which of its parameters reach a sink.  A flow therefore
first climbs through returns and then descends through parameters; it never
leaves a function that it entered through a parameter by another caller's
return.  ``hops`` counts the function boundaries crossed, at most max_hops.

Both summaries are one fixpoint over one edge table: every name keeps its
nearest source (fewest hops; then path, line and label), once for each of the
two phases, and a round moves only what changed.  Rows grow with names and
sinks, never with (source, sink) pairs.  Names are read from whole lines, text
in quotes included, as templates name variables there; an attribute (after a
dot) is no name.  Lines outside of functions take no part, as in the call graph.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import catalog as C
from vigil.operators import facts
from vigil.operators.graph import enclosing_function, resolved
from vigil.plans.ordinals import ordinals
from vigil.session import materialized

#: A name that no dot precedes.
NAME = r"(?:^|[^.\w])([A-Za-z_]\w*)"
#: name = expression, after modifiers, a type or a colon type; not a comparison, an attribute or an element.
ASSIGNMENT = r"^(?:[\w.<>\[\],?*&]+\s+)*\$?([A-Za-z_]\w*)\s*(?::\s*[\w.<>\[\], |]+)?\s*(?::|\+|\.)?=([^=>].*)$"
RETURN = r"^return\b"
#: Stand for a function's result and, before a line number, for a sink; no name looks like these.
RESULT, SINK = "<return>", "#"
#: Edges of one name that are held in one part; names with more have theirs joined apart.
MOST_HELD = 100_000


def _names(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NAME), 1))


def _labels(text: Column, table) -> Column:
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(label)) for p, label in table]), lambda x: x.isNotNull())


def _first_source(text: Column) -> Column:
    """The first source label that matches; one pattern of all tells most texts, which match none."""
    some = "|".join(f"(?:{p})" for p, _ in C.TAINT_SOURCES)
    return F.when(text.rlike(some), F.get(_labels(text, C.TAINT_SOURCES), 0))


def read_lines(annotated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fact_lines() of the lines, those of them that can move a value), read in one pass over the texts.

    The second is (path, language, line, target, names, returns, source, sinks,
    calls), no text.  names: those of the right-hand side where the line
    assigns, else all; the source is the first label that matches.  Kept rows
    are generated, not filtered: a filter would be pushed down with copies of
    all patterns.
    """
    t, x, moving = F.col("trimmed"), F.col("text"), F.col("kind").isin("other", "arrow")
    structure, fields = facts.fact_fields()
    a = facts.with_braces(annotated).select(
        "path", "language", "line", "trimmed", "calls", F.when(structure, F.struct(*fields)).alias("fact"),
        F.when(moving, F.nullif(F.regexp_extract(t, ASSIGNMENT, 1), F.lit(""))).alias("target"), F.when(moving, t.rlike(RETURN)).alias("returns"),
        F.when(moving, _first_source(x)).alias("source"), F.when(moving, _labels(x, C.TAINT_SINKS)).alias("sinks"))
    moves = F.expr("target IS NOT NULL OR returns OR source IS NOT NULL OR size(sinks) > 0 OR size(calls) > 0")
    value = F.when(F.col("target").isNotNull(), F.regexp_extract(t, ASSIGNMENT, 2)).otherwise(t)
    # an argument is a piece of its line, so it holds a source only where the line does
    given = lambda p: F.when(F.col("source").isNotNull(), _first_source(p))
    args = F.transform("calls", lambda c: F.struct(c["name"].alias("name"), F.transform(c["arguments"], lambda p: F.struct(
        _names(p).alias("names"), given(p).alias("source"))).alias("arguments")))
    flow = F.struct(F.col("target"), _names(value).alias("names"), F.col("returns"), F.col("source"), F.col("sinks"), args.alias("calls"))
    flow = F.when(moves, flow).alias("flow")
    both = materialized(a.select("path", "language", "line", F.inline(F.when(F.col("fact").isNotNull() | moves, F.array(F.struct("fact", flow))))))
    lines = both.filter("fact IS NOT NULL").select("path", "language", "line", "fact.*")
    return (lines.unionByName(facts.file_ends(annotated), allowMissingColumns=True),
            both.filter("flow IS NOT NULL").select("path", "language", "line", "flow.*"))


def _uses() -> Column:
    """What a line feeds: the name it assigns, the result of its function, its sink."""
    parts = F.array(F.col("target"), F.when(F.col("returns"), F.lit(RESULT)),
                    F.when(F.size("sinks") > 0, F.concat(F.lit(SINK), F.col("line").cast("string"))))
    return F.filter(parts, lambda x: x.isNotNull())


def flow_graph(lines: DataFrame, functions: DataFrame, strict_order: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seeds, edges, sinks) of read_lines()' second and functions(with parameters).

    seeds(fn, name, phase, label), edges(fn, name, to_fn, to_name, kind) with
    kind 'in', 'up' or 'down', sinks(fn, name, function, path, line, label).
    """
    fns = functions.select("fn_id", "path", "language", "name", "line", "end_line")
    placed = enclosing_function(lines, fns, "_fn").filter("_fn IS NOT NULL")
    placed = materialized(placed.select("path", "language", "line", F.col("_fn.fn_id").alias("fn"), F.col("_fn.name").alias("function"),
                                        F.array_except("names", F.array("target")).alias("names"), _uses().alias("uses"),
                                        "source", "sinks", "calls"))

    def label(hops, source):
        return F.struct(F.lit(hops).alias("hops"), F.col("path").alias("path"), F.col("line").alias("line"), source.alias("label"))

    seeds = placed.filter("source IS NOT NULL").select("fn", F.explode("uses").alias("name"), F.lit(0).alias("phase"),
                                                       label(0, F.col("source")).alias("label"))
    inside = placed.select("fn", F.explode("names").alias("name"), "uses") \
        .select("fn", "name", F.col("fn").alias("to_fn"), F.explode("uses").alias("to_name"), F.lit("in").alias("kind"))
    calls = placed.filter(F.size("calls") > 0).select("path", "language", "line", "fn", "uses", F.explode("calls").alias("call"))
    calls = resolved(fns, calls.select("path", "language", "line", "fn", "uses", F.col("call.name").alias("name"),
                                       F.col("call.arguments").alias("arguments")), strict_order)
    up = calls.select(F.col("to_id").alias("fn"), F.lit(RESULT).alias("name"), F.col("fn").alias("to_fn"),
                      F.explode("uses").alias("to_name"), F.lit("up").alias("kind"))
    parameters = functions.select(F.col("fn_id").alias("to_id"), F.posexplode("parameters").alias("k", "p")) \
        .select("to_id", "k", F.col("p.name").alias("to_name"))
    handed = calls.select("path", "line", "fn", "to_id", F.posexplode("arguments").alias("k", "a")).join(parameters, ["to_id", "k"])
    down = handed.select("fn", F.explode("a.names").alias("name"), F.col("to_id").alias("to_fn"), "to_name", F.lit("down").alias("kind"))
    given = handed.filter("a.source IS NOT NULL").select(F.col("to_id").alias("fn"), F.col("to_name").alias("name"), F.lit(1).alias("phase"),
                                                         label(1, F.col("a.source")).alias("label"))
    sinks = placed.filter(F.size("sinks") > 0).select("fn", F.concat(F.lit(SINK), F.col("line").cast("string")).alias("name"), "function",
                                                      "path", "line", F.explode("sinks").alias("label"))
    edges = inside.unionByName(up).unionByName(down).distinct()
    return seeds.unionByName(given), edges, sinks


def _numbered(seeds: DataFrame, edges: DataFrame, wanted: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(seeds, edges, nodes, sources) with numbers for names and labels, as rounds compare and move them many times.

    seeds(node, phase, hops, source), edges(node, to_node, kind), nodes(fn, name, node), sources(at, source); a
    source's number is its place in the order of (path, line, label).  Names that
    nothing can reach get none, nor do those that lead nowhere and are not wanted.
    """
    seeds, edges = materialized(seeds), materialized(edges)
    ends = [edges.select("fn", "name", F.lit(False).alias("fed"), F.lit(True).alias("leads")),
            edges.select(F.col("to_fn").alias("fn"), F.col("to_name").alias("name"), F.lit(True).alias("fed"), F.lit(False).alias("leads")),
            seeds.select("fn", "name", F.lit(True).alias("fed"), F.lit(False).alias("leads"))]
    nodes = ends[0].unionByName(ends[1]).unionByName(ends[2]).groupBy("fn", "name").agg(F.max("fed").alias("fed"), F.max("leads").alias("leads"))
    nodes = nodes.filter(F.col("fed") & (F.col("leads") | wanted)).select("fn", "name", F.monotonically_increasing_id().alias("node"))
    nodes = materialized(nodes)
    seeds = seeds.select("fn", "name", "phase", F.col("label.hops").alias("hops"), F.struct("label.path", "label.line", "label.label").alias("at"))
    seeds = materialized(seeds.join(nodes, ["fn", "name"]).select("node", "phase", "hops", "at"))
    sources = ordinals(seeds, "at", "source")
    seeds = seeds.join(sources, "at").select("node", "phase", "hops", "source")
    to = nodes.select(F.col("fn").alias("to_fn"), F.col("name").alias("to_name"), F.col("node").alias("to_node"))
    edges = edges.join(nodes, ["fn", "name"]).join(to, ["to_fn", "to_name"]).select("node", "to_node", "kind")
    return seeds, edges, nodes, sources


def _held(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(held, hot): edges parted and sorted by their begin once, for all rounds, and those of names with very many.

    A held name's edges lie in one part; hot ones stay apart, for joins that
    Spark may split.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = edges.repartition(n, "node").sortWithinPartitions("node").persist()
    hot = materialized(held.groupBy("node").count().filter(F.col("count") > MOST_HELD).select("node"))
    if hot.isEmpty():
        return held, None
    apart = materialized(held.join(hot, "node", "left_semi"))
    rest = held.join(hot, "node", "left_anti").repartition(n, "node").sortWithinPartitions("node").persist()
    rest.count()
    held.unpersist()
    return rest, apart


def _fixpoint(seeds: DataFrame, edges: DataFrame, max_hops: int, wanted: Column) -> tuple[DataFrame, DataFrame, Callable[[DataFrame, str, str], DataFrame]]:
    """(state, nodes, labelled): state(node, climbed, descended) with ranks, nodes(fn, name, node), and what adds
    the label struct(hops, path, line, label) of a rank column to rows, null for no rank.

    A rank is hops * 2^k + the source's number, so the smaller one is nearer.
    """
    seeds, edges, nodes, sources = _numbered(seeds, edges, wanted)
    last = sources.agg(F.max("source")).first()[0] or 0
    hop = 1 << int(last).bit_length()
    # a hop takes a round: more hops than the ranks have room for are never made
    limit = min(max_hops + 1, (1 << 62) // hop) * hop
    rank = F.col("hops") * F.lit(hop) + F.col("source")
    state = seeds.groupBy("node").agg(F.min(F.when(F.col("phase") == 0, rank)).alias("climbed"),
                                      F.min(F.when(F.col("phase") == 1, rank)).alias("descended"))
    state = materialized(state.withColumn("up_new", F.col("climbed").isNotNull()).withColumn("down_new", F.col("descended").isNotNull()))

    def labelled(rows, column, out):
        at = sources.select(F.col("source").alias("_source"), "at")
        found = rows.withColumn("_source", F.col(column) % hop).join(at, "_source", "left")
        hops = F.expr(f"CAST({column} DIV {hop} AS INT)")
        return found.withColumn(out, F.when(F.col(column).isNotNull(), F.struct(hops.alias("hops"), "at.path", "at.line", "at.label"))).drop("_source", "at")

    held, hot = _held(edges)
    while True:
        moved = state.filter("up_new OR down_new")
        if moved.isEmpty():
            held.unpersist()
            return state.select("node", "climbed", "descended"), nodes, labelled
        # a label that came down is of no use where one at least as near climbed: that one goes wherever it can
        useful = F.col("down_new") & (F.col("climbed").isNull() | (F.col("descended") < F.col("climbed")))
        moved = moved.select("node", F.when(F.col("up_new"), F.col("climbed")).alias("_up"), F.when(useful, F.col("descended")).alias("_down"))
        step = held.join(moved, "node")
        if hot is not None:
            step = step.unionByName(hot.join(moved, "node"))
        kind = F.col("kind")
        up = F.when(kind == "in", F.col("_up")).when(kind == "up", F.col("_up") + hop)
        down = F.when(kind == "in", F.col("_down")).when(kind == "down", F.least("_up", "_down") + hop)
        step = step.select(F.col("to_node").alias("node"), *[F.when(c < limit, c).alias(n) for c, n in ((up, "up"), (down, "down"))])
        new = step.filter("up IS NOT NULL OR down IS NOT NULL").groupBy("node").agg(F.min("up").alias("up"), F.min("down").alias("down"))
        both = state.select("node", "climbed", "descended").unionByName(new, allowMissingColumns=True)
        both = both.groupBy("node").agg(*[F.min(c).alias(c) for c in ("climbed", "descended", "up", "down")])

        def better(new, old):
            return F.col(new).isNotNull() & (F.col(old).isNull() | (F.col(new) < F.col(old)))
        state = materialized(both.select(
            "node", F.least("climbed", "up").alias("climbed"), F.least("descended", "down").alias("descended"),
            better("up", "climbed").alias("up_new"), better("down", "descended").alias("down_new")))


def nearest_sources(seeds: DataFrame, edges: DataFrame, max_hops: int = 10) -> DataFrame:
    """(fn, name, climbed, descended): the nearest source label of every name that one reaches, per phase.

    Semi-naive: a round joins only the labels that changed in the one before
    with edges that were parted once.  The state is written to the checkpoint
    folder each round; ends when no label changes.
    """
    state, nodes, labelled = _fixpoint(seeds, edges, max_hops, F.lit(True))
    found = state.join(nodes, "node")
    for c in ("climbed", "descended"):
        found = labelled(found.withColumnRenamed(c, "_rank"), "_rank", c).drop("_rank")
    return found.select("fn", "name", "climbed", "descended")


def taint_flows(lines: DataFrame, functions: DataFrame, strict_order: bool = False, max_hops: int = 10) -> DataFrame:
    """Every sink that a source reaches, with the nearest one.

    (path, fn_id, function, sink_line, sink_label, source_path, source_line, source_label, hops)
    """
    seeds, edges, sinks = flow_graph(lines, functions, strict_order)
    wanted = F.col("name").startswith(SINK)
    state, nodes, labelled = _fixpoint(seeds, edges, max_hops, wanted)
    ends = sinks.join(nodes.filter(wanted), ["fn", "name"])
    found = labelled(ends.join(state.select("node", F.least("climbed", "descended").alias("_rank")), "node"), "_rank", "s")
    return found.select("path", F.col("fn").alias("fn_id"), "function", F.col("line").alias("sink_line"), F.col("label").alias("sink_label"),
                        F.col("s.path").alias("source_path"), F.col("s.line").alias("source_line"), F.col("s.label").alias("source_label"),
                        F.col("s.hops").alias("hops"))
