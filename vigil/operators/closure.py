"""Everything that many start functions reach, over strongly connected components (X1, G4 without a depth bound).

1. The part of the graph that any start reaches, as one set of nodes.
2. Its strongly connected components.  Edges from a node that nothing leads to,
   or to one that leads nowhere, lie on no cycle and are taken off, round by
   round, as long as that shrinks the graph; nodes that keep no edge are alone.
   What is left is parted by forward and backward colouring: every node learns the smallest colour among the nodes that reach it and among
   those that it reaches.  Where both are one colour, that colour's node and
   the node reach each other.  Nodes of one component agree in both, so edges
   between nodes that differ are cut; the rest is coloured anew, in another
   random order, until no edge is left.  A pass settles at least the node of
   the smallest colour of every piece, and halves long chains on average.
3. The closure over the components' acyclic graph, layer by layer: a pair of
   components is found once, at its fewest steps.  All starts and all ends of a
   component share its pairs, so a cycle of n functions costs one row, not n x n.

Colours spread and layers grow semi-naively: a round joins only what the last
one changed, and every round is written to the checkpoint folder.  Tables meet in
sort-merge joins: rounds are many, and a broadcast in each would pass all of them
through the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.session import materialized


#: A round that takes off less than this share of the edges is the last one before the colouring.
LEAST_TRIMMED = 1 / 16


def _merge(df: DataFrame) -> DataFrame:
    """df as a side of a join that nothing is broadcast for."""
    return df.hint("merge")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """(a, b) without repeats and null ends, of a table with from_id and to_id."""
    return edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).dropna().distinct()


def reached_nodes(pairs: DataFrame, starts: DataFrame) -> DataFrame:
    """(node): the starts and all nodes that one of them reaches over pairs (a, b)."""
    seen = frontier = materialized(starts.select(F.col("src").alias("node")).dropna().distinct())
    while not frontier.isEmpty():
        new = frontier.join(_merge(pairs), F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        frontier = materialized(new.join(_merge(seen), "node", "left_anti"))
        seen = materialized(seen.unionByName(frontier))
    return seen


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _trimmed(pairs: DataFrame) -> DataFrame:
    """pairs without most edges that lie on no cycle: their begin has no edge in or their end no edge out."""
    n = pairs.count()
    while n:
        led_to, leading = pairs.select(F.col("b").alias("a")).distinct(), pairs.select(F.col("a").alias("b")).distinct()
        pairs = materialized(pairs.join(_merge(led_to), "a", "left_semi").join(_merge(leading), "b", "left_semi").select("a", "b"))
        before, n = n, pairs.count()
        if before - n <= LEAST_TRIMMED * before:
            break
    return pairs


def _colours(nodes: DataFrame, pairs: DataFrame, salt: int) -> DataFrame:
    """(node, ahead, back): smallest colour among the nodes that reach a node and among those that it reaches, itself included."""
    both = pairs.select("a", "b", F.lit(True).alias("along")).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"),
                                                                                        F.lit(False).alias("along")))
    both = materialized(both)
    own = F.struct(F.xxhash64(F.lit(salt), "node").alias("order"), F.col("node").alias("of"))
    state = nodes.select("node", own.alias("ahead"), own.alias("back"), F.lit(True).alias("ahead_new"), F.lit(True).alias("back_new"))
    state = materialized(state)
    while True:
        moved = state.filter("ahead_new OR back_new")
        if moved.isEmpty():
            return state.select("node", "ahead", "back")
        sent = moved.join(_merge(both), F.col("node") == F.col("a")).filter(F.when(F.col("along"), F.col("ahead_new")).otherwise(F.col("back_new")))
        sent = sent.groupBy(F.col("b").alias("node")).agg(F.min(F.when(F.col("along"), F.col("ahead"))).alias("ahead_in"),
                                                           F.min(F.when(~F.col("along"), F.col("back"))).alias("back_in"))
        all_ = state.select("node", "ahead", "back").unionByName(sent, allowMissingColumns=True).groupBy("node") \
            .agg(*[F.min(c).alias(c) for c in ("ahead", "back", "ahead_in", "back_in")])
        state = materialized(all_.select("node", F.least("ahead", "ahead_in").alias("ahead"), F.least("back", "back_in").alias("back"),
                                         F.coalesce(F.col("ahead_in") < F.col("ahead"), F.lit(False)).alias("ahead_new"),
                                         F.coalesce(F.col("back_in") < F.col("back"), F.lit(False)).alias("back_new")))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge (from_id, to_id); component is the smallest node of it."""
    pairs = materialized(distinct_edges(edges))
    nodes, pairs = materialized(_nodes(pairs)), pairs.filter("a <> b")
    alone, settled, salt = [], [], 0
    while True:
        pairs = _trimmed(pairs)
        linked = materialized(_nodes(pairs))
        alone.append(nodes.join(_merge(linked), "node", "left_anti").select("node", F.col("node").alias("component")))
        if linked.isEmpty():
            break
        coloured = materialized(_colours(linked, pairs, salt))
        settled.append(coloured.filter("ahead = back").select("node", F.col("ahead.of").alias("root")))
        rest = materialized(coloured.filter("ahead <> back").select("node", F.struct("ahead", "back").alias("piece")))
        if rest.isEmpty():
            break
        a, b = (_merge(rest.select(F.col("node").alias(c), F.col("piece").alias("piece_" + c))) for c in "ab")
        pairs = materialized(pairs.join(a, "a").join(b, "b").filter("piece_a = piece_b").select("a", "b"))
        nodes, salt = rest.select("node"), salt + 1
    out = alone[0]
    for part in alone[1:]:
        out = out.unionByName(part)
    if settled:
        cycles = settled[0]
        for part in settled[1:]:
            cycles = cycles.unionByName(part)
        least = cycles.groupBy("root").agg(F.min("node").alias("component"))
        out = out.unionByName(cycles.join(_merge(least), "root").select("node", "component"))
    return out


def component_closure(edges: DataFrame, starts: DataFrame, max_layers: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, reach) of the part that the starts (src) reach.

    members(node, component); reach(src_component, dst_component, layer): a pair
    of components at the fewest steps between components, layer 0 for a
    component that holds a cycle (its nodes reach each other and themselves).
    """
    pairs = materialized(distinct_edges(edges))
    part = reached_nodes(pairs, starts)
    pairs = materialized(pairs.join(_merge(part.select(F.col("node").alias("a"))), "a", "left_semi"))  # their ends are reached, too
    members = strong_components(pairs.select(F.col("a").alias("from_id"), F.col("b").alias("to_id")))
    alone = part.select("node", F.col("node").alias("component")).join(_merge(members), "node", "left_anti")
    members = materialized(members.unionByName(alone))
    ends = [_merge(members.select(F.col("node").alias(c), F.col("component").alias(c + "_c"))) for c in "ab"]
    steps = materialized(pairs.join(ends[0], "a").join(ends[1], "b").select(F.col("a_c").alias("up"), F.col("b_c").alias("down")).distinct())
    first = starts.select(F.col("src").alias("node")).dropna().distinct().join(_merge(members), "node").select(F.col("component").alias("src_component"))
    first = materialized(first.distinct())
    cyclic = steps.filter("up = down").select(F.col("up").alias("src_component"))
    reach = materialized(first.join(_merge(cyclic), "src_component", "left_semi").select("src_component", F.col("src_component").alias("dst_component"),
                                                                                 F.lit(0).alias("layer")))
    steps = steps.filter("up <> down")
    frontier, layer = (first.select("src_component", F.col("src_component").alias("dst_component"))), 0
    while not frontier.isEmpty() and (max_layers is None or layer < max_layers):
        layer += 1
        new = frontier.join(_merge(steps), F.col("dst_component") == F.col("up")).select("src_component", F.col("down").alias("dst_component")).distinct()
        new = new.join(_merge(reach.select("src_component", "dst_component")), ["src_component", "dst_component"], "left_anti")
        frontier = materialized(new)
        reach = materialized(reach.unionByName(frontier.withColumn("layer", F.lit(layer))))
    return members, reach


def reach_layers(edges: DataFrame, starts: DataFrame, max_layers: int | None = None) -> DataFrame:
    """(src, dst, layer): every function that a start reaches by at least one call, with the fewest component steps."""
    members, reach = component_closure(edges, starts, max_layers)
    first = starts.select(F.col("src")).dropna().distinct().join(_merge(members.select(F.col("node").alias("src"), F.col("component").alias("src_component"))), "src")
    ends = members.select(F.col("node").alias("dst"), F.col("component").alias("dst_component"))
    return first.join(_merge(reach), "src_component").join(_merge(ends), "dst_component").select("src", "dst", "layer")
