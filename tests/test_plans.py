"""Blocked scans and as-of lookups against brute force."""
import random

from pyspark.sql import functions as F

from vigil.plans.intervals import first_enclosing
from vigil.plans.ordinals import ordinals
from vigil.plans.prefix import asof, running


def test_running_sum_matches_bruteforce(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 2), i, rnd.choice([1, -1, 2])) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    out = running(df, ["k"], ["o"], F.floor(F.col("o") / 16), F.col("v"), "s").collect()
    exp = {}
    acc = {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        acc[k] = acc.get(k, 0) + v
        exp[(k, o)] = acc[k]
    assert {(r.k, r.o): r.s for r in out} == exp


def test_asof_backward_and_forward(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 3)], "k int, p int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 9, "c")], "k int, p int, v string")
    blk = lambda c: F.floor(c / 4)
    b = asof(left, right, ["k"], F.col("p"), F.col("p"), F.col("v"), "o", blk, "backward", strict=True)
    assert {(r.k, r.p): r.o for r in b.collect()} == {(1, 5): None, (1, 10): "b", (2, 3): None}
    b2 = asof(left, right, ["k"], F.col("p"), F.col("p"), F.col("v"), "o", blk, "backward", strict=False)
    assert {(r.k, r.p): r.o for r in b2.collect()}[(1, 5)] == "a"
    f = asof(left, right, ["k"], F.col("p"), F.col("p"), F.col("v"), "o", blk, "forward", strict=True)
    assert {(r.k, r.p): r.o for r in f.collect()} == {(1, 5): "b", (1, 10): None, (2, 3): "c"}


def test_running_max_matches_bruteforce(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.randint(0, 500)) for i in range(200)]
    df = spark.createDataFrame(rows, "o int, v int").withColumn("k", F.lit(1))
    out = running(df, ["k"], ["o"], F.floor(F.col("o") / 16), F.col("v"), "m", how="max", inclusive=False).collect()
    assert {r.o: r.m for r in out} == {i: max((v for j, v in rows if j < i), default=None) for i, _ in rows}


def test_first_enclosing_matches_bruteforce(spark):
    rnd = random.Random(3)
    ivs = {s: (s, min(400, s + rnd.choice([0, 3, 40, 399]))) for s in rnd.sample(range(400), 60)}
    iv = spark.createDataFrame([("a", s, e, f"i{s}") for s, e in ivs.values()], "path string, s int, e int, id string")
    pts = spark.createDataFrame([("a", p) for p in range(420)] + [("b", 1)], "path string, line int")
    got = first_enclosing(pts, iv, ["path"], "line", "s", "e", ["id"], "hit", lambda c: F.floor(c / 8))
    for r in got.collect():
        want = min((s for s, e in ivs.values() if s <= r.line <= e), default=None) if r.path == "a" else None
        assert (r.hit.id if r.hit else None) == (f"i{want}" if want is not None else None)


def test_ordinals_follow_the_order(spark):
    words = [f"p{i * 37 % 101:03d}" for i in range(101)] * 2
    rows = ordinals(spark.createDataFrame([(w,) for w in words], "path string"), "path", "o").collect()
    assert len(rows) == 101 and [r.path for r in sorted(rows, key=lambda r: r.o)] == sorted(set(words))
