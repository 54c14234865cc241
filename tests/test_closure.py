"""Strongly connected components and layered closure against a search on small graphs."""
import random
from collections import deque

import pytest

from vigil.operators import closure
from vigil.operators.closure import component_closure, reach_layers, strong_components


def after(edges, start):
    """node -> fewest steps (at least one) from start."""
    out, todo = {}, deque([(start, 0)])
    while todo:
        node, d = todo.popleft()
        for a, b in edges:
            if a == node and b not in out:
                out[b] = d + 1
                todo.append((b, d + 1))
    return out


def brute_components(edges):
    nodes = sorted({x for e in edges for x in e})
    reach = {n: set(after(edges, n)) | {n} for n in nodes}
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


def brute_layers(edges, starts):
    comp = {**{s: s for s in starts}, **brute_components(edges)}
    links = {(comp[a], comp[b]) for a, b in edges if comp[a] != comp[b]}
    out = set()
    for s in starts:
        steps = {**after(links, comp[s]), comp[s]: 0}
        out |= {(s, d, steps[comp[d]]) for d in after(edges, s)}
    return out


def frames(spark, edges, starts):
    e = spark.createDataFrame([*edges, *list(edges)[:2], ("n0", None), (None, "n1")], "from_id string, to_id string")
    return e, spark.createDataFrame([(s,) for s in [*starts, *starts[:1], None]], "src string")


def cycle(*names):
    return set(zip(names, names[1:] + names[:1]))


@pytest.mark.parametrize("edges, starts", [
    ({(f"n{a}", f"n{b}") for a, b in (random.Random(i).choices(range(14), k=2) for i in range(22))}, ["n1", "n4", "absent"]),
    (cycle("a", "b", "c") | cycle("d", "e") | {("c", "d"), ("e", "f"), ("f", "f"), ("x", "a")}, ["x", "a", "d", "f"]),
    ({(f"k{i:02}", f"k{i + 1:02}") for i in range(12)} | {("k12", "k05")}, ["k00", "k06"]),
])
def test_graphs_against_search(spark, edges, starts):
    e, s = frames(spark, edges, starts)
    assert {r.node: r.component for r in strong_components(e).collect()} == brute_components(edges)
    got = [tuple(r) for r in reach_layers(e, s).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_layers(edges, starts)


def test_long_chains_are_trimmed_and_nothing_is_broadcast(spark, monkeypatch):
    edges = {(f"t{i}", f"t{i // 2}") for i in range(1, 16)} | cycle("r1", "r2", "r3") | {("t0", "r1"), ("r3", "s0"), ("s0", "s1"), ("s1", "s1")}
    coloured, colours = [], closure._colours
    monkeypatch.setattr(closure, "_colours", lambda nodes, *more: coloured.append(nodes.count()) or colours(nodes, *more))
    e, s = frames(spark, edges, ["t15", "t5"])
    found = strong_components(e)
    assert {r.node: r.component for r in found.collect()} == brute_components(edges)
    assert coloured == [3]  # the ring; the trees above and below it are gone
    layers = reach_layers(e, s)
    assert {tuple(r) for r in layers.collect()} == brute_layers(edges, ["t15", "t5"])
    assert "Broadcast" not in found._jdf.queryExecution().toString() + layers._jdf.queryExecution().toString()


def test_a_cycle_is_one_row(spark):
    n = 60
    e, s = frames(spark, cycle(*[f"c{i:03}" for i in range(n)]) | {("c007", "end")}, [f"c{i:03}" for i in range(n)])
    members, reach = component_closure(e, s)
    assert {tuple(r) for r in reach.collect()} == {("c000", "c000", 0), ("c000", "end", 1)}
    assert members.count() == n + 1 and reach_layers(e, s).count() == n * (n + 1)
    assert reach_layers(e, s, max_layers=0).count() == n * n


def test_no_edges_and_no_starts(spark):
    e, s = frames(spark, set(), [])
    assert reach_layers(e, s).count() == 0 and strong_components(e).count() == 0
    e, s = frames(spark, {("a", "b")}, ["a"])
    assert reach_layers(e, s.limit(0)).count() == 0
