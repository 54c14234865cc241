"""Periodic runs (op13) against a brute-force search."""
import hashlib
import random
import zlib

import pytest

from vigil.llm import periodic_runs as P
from vigil.llm.queries import op13_runs


def brute_runs(w):
    """(start, length, period) of every run: all periods, all stretches, smallest period of each."""
    least = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(12, 2 * q):
                least.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in least.items())


def brute_row(doc_id, text, plant):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2]))).encode()),
            sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def random_words(rng):
    k, n = rng.choice([1, 2, 2, 3, 5, 50]), rng.choice([0, 3, 11, 12, 13, 30, 100, 300])
    w = [b"%d" % rng.randrange(k) for _ in range(n)]
    if n and rng.random() < .5:
        a = rng.randrange(n)
        p = rng.randrange(1, n + 1 - a)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


@pytest.mark.parametrize("batch", [5, 1000, 1 << 18])
def test_runs_of_random_words(batch, monkeypatch):
    monkeypatch.setattr(P, "CANDIDATES", batch)
    rng = random.Random(batch)
    for _ in range(60):
        docs = [random_words(rng) for _ in range(rng.randrange(1, 8))]
        for w, got in zip(docs, P.runs_of_texts(docs)):
            assert [tuple(r) for r in got.tolist()] == brute_runs(w)


def test_common_extensions():
    import numpy as np
    rng = np.random.default_rng(0)
    w = np.concatenate([rng.integers(0, 2, 400), np.tile(rng.integers(0, 3, 7), 60), [9]])
    lce = P.CommonExtensions(w)
    i, j = rng.integers(0, len(w) - 1, (2, 3000))
    i, j = i[i != j], j[i != j]
    want = []
    for a, b in zip(i.tolist(), j.tolist()):
        n = 0
        while max(a, b) + n < len(w) and w[a + n] == w[b + n]:
            n += 1
        want.append(n)
    assert lce(i, j).tolist() == want


@pytest.fixture(scope="module")
def rows(corpus):
    rng = random.Random(9)
    extra = [(2000 + i, b" ".join(random_words(rng)).decode()) for i in range(150)]
    extra += [(3000, "a b c " * 4000), (3001, " ".join(f"w{i % 1700}" for i in range(5000))), (3002, "Ä " * 12), (3003, "Ä " * 11),
              (3003, "Ä " * 11), (None, "x y " * 9), (None, None), (-5, "one two " * 14), (3004, "a\tb\n" * 6)]
    return list(corpus) + extra


def test_rows_match_brute_force(spark, rows, tmp_path):
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, runs int, __p int, collapsed string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(repr, map(tuple, op13_runs(spark, str(tmp_path)).collect())))
    assert got == sorted(repr(brute_row(i, t, True)) for i, t in rows)
    plain = P.run_digests(P.find_runs(df)).collect()
    assert sorted(map(repr, map(tuple, plain))) == sorted(repr(brute_row(i, t, False)) for i, t in rows)


def test_no_documents(spark, no_docs):
    assert P.run_digests(P.find_runs(P.tiled_tails(no_docs))).count() == 0


def test_collapsed_text_keeps_one_period(spark):
    df = spark.createDataFrame([("k", "see here " + "la di da " * 5 + "end")], "name string, body string")
    r = P.find_runs(df, "name", "body").first()
    assert r.collapsed == "see here la di da end" and [tuple(x) for x in r.runs] == [(2, 15, 3)] and r.name == "k"
