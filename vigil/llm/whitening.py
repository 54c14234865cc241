"""Embedding whitening (12): incremental eigendecomposition by rank-one updates, then a distributed Rayleigh-Ritz step.

1. Entries become whole numbers x = floor(SCALE c) + SHIFT.  The fit list is
   each distinct x-vector once, written to the shared folder.
2. Every task keeps count, mean and spectrum (eigenvalues and eigenvectors of
   the scatter about the mean) of its part of the fit list.  Vectors come in
   blocks: a block's centred rows are turned by a QR step into at most as many
   rows as there are dimensions, of the same scatter, and each of these rows,
   then the weighted difference of the means, is a rank-one update.
3. A rank-one update diagonalises D + rho z z'.  Entries of z that are
   negligible and eigenvalues that are equal to rounding are deflated; the
   others' new values are the roots of the secular equation, found for all at
   once by rational interpolation inside brackets.  Eigenvectors follow from
   the z that the roots are exact for (Loewner), so they stay orthogonal.
4. Spectra of tasks are combined FAN at a time, in rounds: each pair (value,
   vector) of one is a rank-one update of the other, and so are the means'
   difference.  No task or driver holds more than FAN spectra at once.
5. The combined vectors are only a good basis.  Every task projects its centred
   vectors onto it; the sum of the projections' scatters, again by rounds, is
   diagonalised and turns the basis into eigenvectors to double precision.

Dropped: null and empty vectors, vectors with a null or non-finite entry or one
of 2**46 or more, and those whose length is not the most frequent one of the fit
list (ties: the greater).  Repeated rows weigh once in the fit and each gets its
rows; null ids stay.  Components without variance (ties of all vectors, fewer
vectors than components) have a null ``whitened`` and an ``explained`` of 0, of
null if nothing varies.  Components of equal variance span the same space in any
basis of it.  Fewer dimensions than components give as many as there are.  Extra
columns are ignored; an empty table gives no rows.  ``deviation`` is null where
its exact value does not fit a long.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.shared import written

SCALE, SHIFT = 64, 1_000_000
LARGEST = float(2 ** 46)
#: Vectors that a task turns into rank-one updates at a time, and spectra that are combined at a time.
BLOCK_ROWS, FAN = 2048, 16
#: Whole numbers are summed in two parts of this many low bits and the rest, so that no sum leaves a long.
LOW_BITS = 26
EPS = float(np.finfo(np.float64).eps)
#: A component of less than this share of all variance has none.
NO_VARIANCE = 1e-12


def secular_roots(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + z z' with w = z**2 > 0 and d strictly rising: (values, [j, i] -> d[i] - value j).

    Root j lies between d[j] and d[j + 1] (the last below d + sum(w)) and is
    measured from the nearer of the two, so the differences keep their digits.
    """
    n = len(d)
    upper = np.append(d[1:], d[-1] + w.sum())
    gap = upper - d
    index = np.arange(n)
    left = np.tri(n)  # [j, i]: pole i lies left of root j
    last, follow = index == n - 1, np.minimum(index + 1, n - 1)
    apart = d[None, :] - d[:, None]
    t = gap / 2
    right = (1 + (w / (apart - t[:, None])).sum(1) < 0) & ~last
    origin = np.where(right, upper, d)
    low, high = np.where(right, -t, 0.0), np.where(right, 0.0, np.where(last, gap, t))
    from_origin = apart[np.where(right, follow, index)]
    t = (low + high) / 2
    ones = np.ones(n)
    for _ in range(100):
        away = from_origin - t[:, None]
        terms = w / away
        slopes = terms / away
        all_sum, left_sum = terms @ ones, np.einsum("ij,ij->i", terms, left)
        left_slope = np.einsum("ij,ij->i", slopes, left)
        right_sum, right_slope = all_sum - left_sum, slopes @ ones - left_slope
        f = 1 + all_sum
        np.copyto(low, t, where=f < 0)
        np.copyto(high, t, where=f >= 0)
        a, b = away[index, index], away[index, follow]
        # the poles on either side stand for all terms of their side: c + p / (a - x) + r / (b - x) = 0
        b[-1], right_sum[-1], right_slope[-1] = 1.0, 0.0, 0.0
        p, r = left_slope * a * a, right_slope * b * b
        c = f - left_slope * a - right_slope * b
        half, product = c * (a + b) + p + r, a * b * f
        root = np.sqrt(np.maximum(half * half - 4 * product * c, 0))
        step = np.where(half <= 0, (half - root) / (2 * c), 2 * product / (half + root))
        step[-1] = a[-1] + p[-1] / c[-1]
        new = t + step
        np.copyto(new, (low + high) / 2, where=~((new > low) & (new < high)))
        done = (np.abs(f) <= 8 * n * EPS * (1 + np.abs(left_sum) + np.abs(right_sum))) | (np.abs(new - t) <= 2 * EPS * np.abs(new))
        np.copyto(t, new, where=~done)
        if done.all():
            break
    return origin + t, from_origin - t[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, rho: float, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of A + rho v v' (rho > 0) from that of A: rising values, vectors in rows."""
    z = vectors @ v * np.sqrt(rho)
    tolerance = 8 * EPS * max(float(np.abs(values).max(initial=0)), float(z @ z))
    if tolerance == 0:
        return values, vectors
    values = values.copy()
    live = np.flatnonzero(np.abs(z) * np.sqrt(z @ z) > tolerance)
    if not len(live):
        return values, vectors
    a, b = live[:-1], live[1:]
    if (np.abs((values[b] - values[a]) * z[a] * z[b]) <= tolerance * (z[a] ** 2 + z[b] ** 2)).any():
        vectors = vectors.copy()
        kept, at = [], live[0]
        for k in live[1:]:  # equal values: turn the two vectors so that one of them has no part in v
            size = np.hypot(z[at], z[k])
            c, s = z[k] / size, z[at] / size
            if abs((values[k] - values[at]) * c * s) <= tolerance:
                z[k], z[at] = size, 0
                vectors[at], vectors[k] = c * vectors[at] - s * vectors[k], s * vectors[at] + c * vectors[k]
                values[at], values[k] = c * c * values[at] + s * s * values[k], s * s * values[at] + c * c * values[k]
            else:
                kept.append(at)
            at = k
        live = np.array([*kept, at])
    d, w = values[live], z[live] ** 2
    order = np.argsort(d, kind="stable")
    live, d, w = live[order], d[order], w[order]
    with np.errstate(all="ignore"):  # a step that is not a number is replaced by halving the bracket
        roots, away = secular_roots(d, w)
    # the z of which the roots are the exact eigenvalues: products of differences, each paired with one of nearly its size
    ratio = -away
    between = d[:, None] - d[None, :]
    np.fill_diagonal(between, 1.0)
    exact = np.sqrt(np.abs((ratio / between).prod(0))) * np.sign(z[live])
    turned = exact / away
    turned /= np.sqrt((turned * turned).sum(1))[:, None]
    vectors = vectors.copy()
    vectors[live] = turned @ vectors[live]
    values[live] = roots
    order = np.argsort(values, kind="stable")
    return values[order], vectors[order]


class Spectrum:
    """Count, mean, and eigenvalues and eigenvectors (rows) of the scatter about the mean."""

    def __init__(self, dims: int):
        self.n, self.mean = 0, np.zeros(dims)
        self.values, self.vectors = np.zeros(dims), np.eye(dims)

    def _update(self, rho: float, v: np.ndarray) -> None:
        if rho > 0:
            self.values, self.vectors = rank_one(self.values, self.vectors, rho, v)

    def _joined(self, n: int, mean: np.ndarray) -> None:
        self._update(self.n * n / (self.n + n), mean - self.mean)
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n

    def add(self, rows: np.ndarray) -> None:
        """A block of vectors, one in a row."""
        mean = rows.mean(0)
        for row in np.linalg.qr(rows - mean, mode="r"):
            self._update(1.0, row)
        self._joined(len(rows), mean)

    def merge(self, other: "Spectrum") -> None:
        for value, vector in zip(other.values.tolist(), other.vectors):
            self._update(value, vector)
        self._joined(other.n, other.mean)

    def to_bytes(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.values, self.vectors.ravel()]).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, dims: int) -> "Spectrum":
        flat = np.frombuffer(data)
        out = cls(dims)
        out.n, out.mean, out.values = int(flat[0]), flat[1:1 + dims], flat[1 + dims:1 + 2 * dims]
        out.vectors = flat[1 + 2 * dims:].reshape(dims, dims)
        return out


def vectors(df: DataFrame, *keep: str, vector: str = "embedding") -> DataFrame:
    """(keep..., x array<long>): the vectors of finite entries as whole numbers; the others go."""
    broken = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= LARGEST))
    rows = df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).filter(~broken)
    return rows.select(*keep, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long")).alias("x"))


def _matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _tasks(fit: DataFrame, dims: int, start: Callable, add: Callable, finish: Callable) -> DataFrame:
    """One (part, state) row per task that has vectors: add(state, block of vectors) over its blocks."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        state, waiting, n = start(), [], 0
        any_rows = False
        for batch in batches:
            rows = _matrix(batch.column("x"), dims)
            any_rows = any_rows or len(rows) > 0
            waiting.append(rows)
            n += len(rows)
            if n >= BLOCK_ROWS:
                rows = np.concatenate(waiting)
                for a in range(0, len(rows) - BLOCK_ROWS + 1, BLOCK_ROWS):
                    add(state, rows[a:a + BLOCK_ROWS])
                waiting = [rows[len(rows) - len(rows) % BLOCK_ROWS:]]
                n = len(waiting[0])
        if n:
            add(state, np.concatenate(waiting))
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([finish(state)], pa.binary())],
                                             ["part", "state"])
    return fit.mapInArrow(run, "part long, state binary")


def _combined(states: DataFrame, merge: Callable) -> bytes | None:
    """All states merged, FAN in a task and round; the last round's single state comes to the driver."""
    def run(table):
        import pyarrow as pa
        order = np.argsort(table.column("part").to_numpy())
        data = [table.column("state")[int(k)].as_py() for k in order]
        out = merge(data) if len(data) > 1 else data[0]
        return pa.table({"part": pa.array([table.column("part")[int(order[0])].as_py() // FAN], pa.int64()), "state": pa.array([out], pa.binary())})

    states = written(states)
    while states.count() > 1:
        states = written(states.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(run, "part long, state binary"))
    row = states.first()
    return bytes(row.state) if row else None


def _summed(data: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(b) for b in data], axis=0).tobytes()


def _summed_whole(data: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(b, np.int64) for b in data], axis=0).tobytes()


class Whitening:
    """A fitted model: count n, sums per dimension, eigenvalues by falling size and their vectors in rows."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray):
        self.n, self.sums, self.values, self.vectors = n, sums, values, vectors
        self.dims, self.trace = len(sums), float(values.sum())
        self.varied = values > NO_VARIANCE * self.trace if self.trace > 0 else np.zeros(len(values), bool)
        self.error = None

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n x - sums, exactly: as long where that is sure to fit, else as Python's whole numbers."""
        if self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums)) < 2 ** 62:
            return self.n * x - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def deviations(self, offsets: np.ndarray) -> list:
        most = int(np.abs(offsets).max(initial=0))
        if most * most * self.dims < 2 ** 63:
            return (offsets * offsets).sum(1).tolist()
        exact = (offsets.astype(object) ** 2).sum(1).tolist()
        return [e if e < 2 ** 63 else None for e in exact]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.offsets(x).astype(np.float64) / self.n

    def whiten(self, centred: np.ndarray, components: int) -> np.ndarray:
        """Projections over the roots of the eigenvalues; not a number where there is no variance."""
        k = min(components, self.dims)
        scale = np.where(self.varied[:k], np.sqrt(np.where(self.varied[:k], self.values[:k], 1)), np.nan)
        return centred @ self.vectors[:k].T / scale


def fit(df: DataFrame, vector: str = "embedding", components: int = 16) -> Whitening | None:
    """The whitening of the distinct x-vectors; None if there are none."""
    rows = written(vectors(df, vector=vector).distinct())
    lengths = rows.groupBy(F.size("x").alias("dims")).count()
    head = lengths.orderBy(F.col("count").desc(), F.col("dims").desc()).first()
    if head is None:
        return None
    dims, n = head["dims"], head["count"]
    rows = rows.filter(F.size("x") == dims)

    def start():
        return Spectrum(dims), np.zeros(2 * dims, np.int64)

    def add(state, x):
        state[0].add((x - SHIFT).astype(np.float64))
        state[1][:dims] += (x >> LOW_BITS).sum(0)
        state[1][dims:] += (x & (1 << LOW_BITS) - 1).sum(0)

    def finish(state):
        return state[1].tobytes() + state[0].to_bytes()

    def merge(data):
        first = Spectrum.from_bytes(data[0][16 * dims:], dims)
        for other in data[1:]:
            first.merge(Spectrum.from_bytes(other[16 * dims:], dims))
        return _summed_whole([b[:16 * dims] for b in data]) + first.to_bytes()

    state = _combined(_tasks(rows, dims, start, add, finish), merge)
    parts = np.frombuffer(state[:16 * dims], np.int64).tolist()
    sums = [(high << LOW_BITS) + low for high, low in zip(parts[:dims], parts[dims:])]
    rough = Spectrum.from_bytes(state[16 * dims:], dims)
    basis = np.linalg.qr(rough.vectors[::-1].T)[0].T  # rows, by falling value, orthonormal to rounding
    rough = Whitening(n, sums, rough.values[::-1] / n, basis)

    def project(state, x):
        y = rough.centred(x) @ basis.T
        state += y.T @ y

    scatter = _combined(_tasks(rows, dims, lambda: np.zeros((dims, dims)), project, lambda s: s.tobytes()), _summed)
    values, turn = np.linalg.eigh(np.frombuffer(scatter).reshape(dims, dims) / n)
    model = Whitening(n, sums, np.maximum(values[::-1], 0), turn[:, ::-1].T @ basis)
    k = min(components, dims)

    def spread(state, x):
        y = np.nan_to_num(model.whiten(model.centred(x), k))
        state[:k] += y.T @ y
        state[k] += y.sum(0)

    seen = _combined(_tasks(rows, dims, lambda: np.zeros((k + 1, k)), spread, lambda s: s.tobytes()), _summed)
    seen = np.frombuffer(seen).reshape(k + 1, k) / n
    error = np.abs(seen[:k] - np.outer(seen[k], seen[k]) - np.eye(k))[np.ix_(model.varied[:k], model.varied[:k])]
    model.error = float(error.max()) if error.size else None
    return model


def whiten(df: DataFrame, model: Whitening | None = None, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) per remaining row and component."""
    model = fit(df, vector, components) if model is None else model
    kind = df.schema[key].dataType
    schema = "id string, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        rows = df.sparkSession.createDataFrame([], schema)
    else:
        k = min(components, model.dims)
        explained = (model.values[:k] * model.varied[:k] / model.trace).tolist() if model.trace > 0 else [None] * k

        def run(batches):
            import pyarrow as pa
            for batch in batches:
                x = _matrix(batch.column("x"), model.dims)
                m = len(x)
                if not m:
                    continue
                offsets = model.offsets(x)
                y = model.whiten(offsets.astype(np.float64) / model.n, k)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)), pa.array(model.deviations(offsets), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(y.ravel(), mask=np.isnan(y.ravel())), pa.array(explained * m, pa.float64()),
                    pa.array([model.error] * (m * k), pa.float64())],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        rows = vectors(df.withColumn(key, F.col(key).cast("string")), F.col(key).alias("id"), vector=vector)
        rows = rows.filter(F.size("x") == model.dims).mapInArrow(run, schema)
    return rows.select(F.col("id").cast(kind).alias(key), "component", "n", "deviation", "whitened", "explained", "identity_error")
