"""Connected components of an edge table: local contraction, then alternating star steps.

First each task contracts the edges of its partition to a forest of stars.
Then large-star and small-star steps alternate (every node links to the
smallest neighbour it knows) until the edges no longer change.  Every step is
written to the shared folder.  Links with a null end and from a node to itself
are no links; repeated links count once; an empty table gives no rows.  Hubs are joined through sort-merge joins over
plain shuffles, whose large partitions Spark splits.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.shared import written


def local_forest(batches, weight: bool = False):
    """Edges (a, b) of a task -> (node, smallest node of its local component)."""
    import pyarrow as pa
    parent: dict[int, int] = {}

    def root(x):
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if root(x) != x]
    for i in range(0, len(nodes), 10_000):
        part = nodes[i:i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["a", "b"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = written(edges.groupBy("a").agg(F.min("b").alias("m")))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return written(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (id, component): every linked node with the smallest node it reaches."""
    links = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    stars = written(links.mapInArrow(local_forest, "a long, b long").distinct())
    state = _state(stars)
    while state[0]:
        stars = _small_star(_large_star(stars))
        before, state = state, _state(stars)
        if state == before:
            break
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component"))
