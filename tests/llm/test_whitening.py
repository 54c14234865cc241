"""Embedding whitening (op12) against numpy's own eigendecomposition and whole-number sums."""
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from vigil.llm import whitening as W
from vigil.llm.queries import op12_whitening


def test_rank_one_updates_with_ties_and_zeros():
    rng = np.random.default_rng(0)
    for _ in range(120):
        d = rng.integers(1, 12)
        matrix, values, vectors = np.zeros((d, d)), np.zeros(d), np.eye(d)
        for _ in range(15):
            v = rng.normal(size=d) * 10.0 ** rng.integers(-6, 4)
            if rng.random() < .3:
                v[rng.random(d) < .5] = 0
            if rng.random() < .2:
                v = np.round(v)
            rho = 10.0 ** rng.integers(-3, 3)
            matrix += rho * np.outer(v, v)
            values, vectors = W.rank_one(values, vectors, rho, v)
            want = np.linalg.eigvalsh(matrix)
            size = max(want.max(), 1e-300)
            assert np.abs(values - want).max() <= 1e-12 * size
            assert np.abs(vectors @ vectors.T - np.eye(d)).max() < 1e-12
            assert np.abs(vectors.T @ np.diag(values) @ vectors - matrix).max() <= 1e-11 * size


def test_secular_roots_of_close_poles():
    for d, w in [([0, 1e-9, 1.0], [1e-12, 1.0, 1e-3]), ([1, 2, 3, 4], [1e-20, 1e-14, 1e4, 1]), ([5.0], [2.0]), ([0, 1e-14, 1], [1, 1, 1])]:
        d, w = np.array(d, float), np.array(w, float)
        values, _ = W.secular_roots(d, w)
        want = np.linalg.eigvalsh(np.diag(d) + np.outer(np.sqrt(w), np.sqrt(w)))
        assert np.allclose(values, want, rtol=0, atol=1e-13 * want.max())


def test_spectra_of_parts_combine():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(700, 9)) * np.arange(1, 10) + 1000)
    parts = []
    for part in np.array_split(x, 5):
        s = W.Spectrum(9)
        for block in np.array_split(part, 4):
            s.add(block)
        parts.append(W.Spectrum.from_bytes(s.to_bytes(), 9))
    for other in parts[1:]:
        parts[0].merge(other)
    c = x - x.mean(0)
    assert parts[0].n == 700 and np.allclose(parts[0].mean, x.mean(0), rtol=1e-13)
    assert np.allclose(parts[0].values, np.linalg.eigvalsh(c.T @ c), rtol=1e-10)


def brute(rows, components=16):
    """(vec_id, component) -> (n, deviation, |whitened|, explained), from exact sums and numpy."""
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [(i, tuple(int(np.floor(64 * float(c))) + 1000000 for c in v)) for i, v in good]
    lengths = defaultdict(set)
    for _, v in x:
        lengths[len(v)].add(v)
    if not lengths:
        return []
    dims = max(lengths, key=lambda k: (len(lengths[k]), k))
    fit = sorted(lengths[dims])
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = {v: np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums)]) for v in fit}
    c = np.array([centred[v] for v in fit])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    out = []
    for i, v in x:
        if len(v) == dims:
            deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums))
            for k in range(min(components, dims)):
                live = values.sum() > 0 and values[k] > 1e-12 * values.sum()
                out.append((i, k + 1, n, deviation, abs(centred[v] @ vectors[:, k]) / values[k] ** .5 if live else None,
                            (values[k] / values.sum() if live else 0.0) if values.sum() > 0 else None))
    return out


def check(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[3])
    got = sorted(((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in got), key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for g, w in zip(got, want):
        assert (g[4] is None) == (w[4] is None) and (g[5] is None) == (w[5] is None)
        assert w[4] is None or abs(abs(g[4]) - w[4]) < 1e-9
        assert w[5] is None or abs(g[5] - w[5]) < 1e-11


SCHEMA = "vec_id long, embedding array<float>, label int, x int, id string, part int, state string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 1, "a", 2, "b") for i, v in rows], SCHEMA)


def f32(a):
    return [float(x) for x in np.float32(a)]


def test_rows_match_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_ROWS", 16)
    monkeypatch.setattr(W, "FAN", 2)
    rng = np.random.default_rng(4)
    rows = [(i, f32(rng.normal(size=20) * np.linspace(.2, 3, 20))) for i in range(300)]
    rows += [(i + 1000, rows[i % 3][1]) for i in range(200)]  # many copies of a few
    rows += [(5, rows[5][1]), (None, rows[6][1]), (None, None), (2000, None), (2001, []), (2002, [1.0]), (2003, [0.0] * 19 + [None]),
             (2004, [0.0] * 19 + [float("nan")]), (2005, [0.0] * 19 + [float("-inf")]), (2006, [0.0] * 20), (2007, [-0.001] * 20)]
    table(spark, rows).repartition(7).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op12_whitening(spark, str(tmp_path)).collect()
    check(got, brute(rows))
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-10
    by = defaultdict(dict)
    for r in got:  # one sign per component: projections of equal vectors agree
        by[r.component].setdefault(r.deviation, set()).add(r.whitened)
    assert all(max(s) - min(s) < 1e-9 for c in by.values() for s in c.values())


@pytest.mark.parametrize("rows", [
    [(1, [1.0, 2.0, 3.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [0.5]), (2, [0.25]), (3, [7.0])],
    [(i, [float(i), 2.0 * i, 1.0, -float(i)]) for i in range(9)], [(1, None), (2, [])], [], [(1, [1e5, 0.0]), (2, [-1e7, 3.0]), (3, [0.0, 0.0])],
    [(1, [1e30, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 5.0])],
])
def test_small_and_degenerate_tables(spark, rows):
    want = brute([(i, v) for i, v in rows if not v or all(abs(c) < 2 ** 46 for c in v)])
    df = table(spark, rows) if rows else table(spark, [(1, None)]).limit(0)
    check(W.whiten(df).collect(), want)


def test_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = W.whiten(df).collect()
    check(got, brute([(r.vec_id, r.embedding) for r in df.collect()]))
    assert got[0].identity_error < 1e-10


def test_large_numbers_stay_exact():
    model = W.Whitening(10 ** 9, [10 ** 15 + 7, 5], np.ones(2), np.eye(2))
    x = np.array([[1000000 + 3, 2 ** 40], [5, 6]])
    exact = [sum((10 ** 9 * int(a) - s) ** 2 for a, s in zip(row, model.sums)) for row in x]
    assert model.deviations(model.offsets(x)) == [e if e < 2 ** 63 else None for e in exact]
