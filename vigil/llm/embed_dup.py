"""Embedding near-duplicates (9): random-hyperplane signs, exact cosine, connected components.

Equal vectors are one class with a count.  The classes' vectors get a sign code
in each of several tables; the number of bits follows the number of classes, the
number of tables follows from the chance that a pair at the threshold shares no
code, which stays below MISS.  Inside a bucket all cosines are taken in double
precision, block by block; a pair that shares several buckets counts in the
first table only.  A bucket of more than BLOCK_ROWS vectors is dealt out as
pairs of blocks, so no task holds more than two blocks of it at once.  A bucket
yields link counts and the edges of a spanning forest, never its pairs.

Vectors that are null, empty, zero, or hold null or non-finite components, and
rows without a vec_id, link with nothing.  Vectors of different lengths do not
link.  A cosine of exactly the threshold, as double precision gives it, is a
link.  Every row is a vector of its own, also where a vec_id repeats; an empty
table gives no rows; extra columns are ignored.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.components import connected_components
from vigil.llm.shared import written

#: Rows of a bucket's block; classes that a bucket holds on average; chance to miss a pair at the threshold.
BLOCK_ROWS, BUCKET_ROWS, MISS = 2048, 256, 1e-6
SEED = 20240229


def plan(n: int, threshold: float) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = min(62, max(4, math.ceil(math.log2(max(n, 1) / BUCKET_ROWS))) if n > BUCKET_ROWS else 4)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-same))


def codes(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Sign code of every vector in every table."""
    planes = np.random.default_rng([SEED, vectors.shape[1]]).standard_normal((vectors.shape[1], bits * tables))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _unit(rows: list) -> np.ndarray:
    x = np.stack(rows)
    # scaled by the largest component first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(column) -> list[np.ndarray]:
    """Rows of a list<double> column without a copy per component."""
    flat, edges = column.flatten().to_numpy(), np.cumsum([0, *column.value_lengths().to_pylist()])
    return [flat[a:b] for a, b in zip(edges[:-1], edges[1:])]


def _coded(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    schema = "bucket long, id long, dims int, tbl int, code long"

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            ids, data = batch.column("id").to_numpy(zero_copy_only=False), _vectors(batch.column("vector"))
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(data):
                by_size.setdefault(len(v), []).append(i)
            for dims, at in by_size.items():
                for lo in range(0, len(at), 2048):
                    some = at[lo:lo + 2048]
                    c = codes(_unit([data[i] for i in some]), bits, tables)
                    table = np.broadcast_to(np.arange(tables, dtype=np.int32), c.shape)
                    key = _bucket(c, table, dims)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.ravel()), pa.array(np.repeat(ids[some], tables)),
                         pa.array(np.full(c.size, dims, np.int32)), pa.array(table.ravel()), pa.array(c.ravel())],
                        ["bucket", "id", "dims", "tbl", "code"])

    return classes.mapInArrow(run, schema)


def _bucket(code: np.ndarray, table: np.ndarray, dims: int) -> np.ndarray:
    from vigil.llm.shared import mixed
    x = mixed(code.astype(np.uint64) + np.uint64(dims * 0x9E3779B97F4A7C15 % (1 << 64)))
    return mixed(x ^ table.astype(np.uint64)).view(np.int64)


def _links(rows: DataFrame, threshold: float, bits: int, tables: int) -> DataFrame:
    """Link counts (a, a, n) and forest edges (a, b, 0) of rows sorted by bucket and pair of blocks."""

    def group(ids, counts, side, table, vectors):
        import pyarrow as pa
        x = _unit(vectors)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        n_links, parent = np.zeros(len(ids), np.int64), list(range(len(ids)))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        within = not len(right)
        other = left if within else right
        for lo in range(0, len(left), 512):
            some = left[lo:lo + 512]
            i, j = np.nonzero(x[some] @ x[other].T >= threshold)
            i, j = some[i], other[j]
            if within:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            if table:  # pairs that met in an earlier table count there
                both = np.union1d(i, j)
                before = codes(x[both], bits, tables)[:, :table]
                met = np.zeros(len(i), bool)
                pi, pj = np.searchsorted(both, i), np.searchsorted(both, j)
                for t in range(table):
                    met |= before[pi, t] == before[pj, t]
                i, j = i[~met], j[~met]
            np.add.at(n_links, i, counts[j])
            np.add.at(n_links, j, counts[i])
            for a, b in zip(i.tolist(), j.tolist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        some = np.flatnonzero(n_links)
        tied = [k for k in range(len(ids)) if root(k) != k]
        a = np.concatenate([ids[some], ids[tied]]).astype(np.int64)
        b = np.concatenate([ids[some], ids[[root(k) for k in tied]]]).astype(np.int64)
        n = np.concatenate([n_links[some], np.zeros(len(tied), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

    def run(batches):
        held, now = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[:-1]), _vectors(batch.columns[-1])):
                if row[:3] != now:
                    if len(held) > 1:
                        yield group(*_columns(held))
                    held, now = [], row[:3]
                held.append(row)
        if len(held) > 1:
            yield group(*_columns(held))

    def _columns(held):
        return (np.array([r[3] for r in held]), np.array([r[4] for r in held]), np.array([r[5] for r in held]),
                held[0][6], [r[7] for r in held])

    return rows.select("bucket", "lo", "hi", "id", "n", "side", "tbl", "vector").mapInArrow(run, "a long, b long, n long")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding)."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    sound = F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    key = F.when(sound, F.struct(F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")))
    rows = rows.select("vec_id", key.alias("key"), "v")
    own = written(rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("n"), F.any_value("v").alias("v")))
    bits, tables = plan(own.count(), threshold)
    classes = own.select("id", F.col("v").alias("vector"))
    coded = written(_coded(classes, bits, tables))
    met = written(coded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
                  .withColumn("n_blocks", F.ceil(F.col("size") / BLOCK_ROWS).cast("int")))
    placed = coded.join(met, "bucket")
    block = F.pmod(F.xxhash64("id", "bucket"), F.col("n_blocks")).cast("int")
    placed = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    placed = placed.select("bucket", "id", "tbl", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                           (F.col("block") > F.col("other")).cast("int").alias("side"))
    placed = placed.join(own.select("id", "n", F.col("v").alias("vector")), "id")
    dealt = placed.repartition(F.col("bucket"), F.col("lo"), F.col("hi")).sortWithinPartitions("bucket", "lo", "hi", "id")
    links = written(_links(dealt, threshold, bits, tables))
    counts = links.filter("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_other"))
    component = connected_components(links.filter("n = 0").select("a", "b"))
    per_class = written(own.join(counts, "id", "left").join(component, "id", "left").select(
        "key", (F.col("n") - 1 + F.coalesce("n_other", F.lit(0))).alias("n_links"),
        F.coalesce("component", "id").alias("component_id")))
    out = rows.select("vec_id", "key").join(per_class, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id"),
                      F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
