"""Whitening of vectors: distributed centred scatter, cyclic Jacobi rotations on the driver, a broadcast matrix."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import _shared as S

#: Integers of larger magnitude are refused: their sums and squares would no longer be exact in 64 bits.
LARGEST = 1 << 40
#: An eigenvalue of at most this share of the trace, times the dimension, is rounding noise: its component is not whitened.
NOISE = 2.0**-50


def complete(vector: str) -> Column:
    """Not null, and no entry is null, NaN or infinite."""
    x = F.col(vector)
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def integers(table: DataFrame, id_col: str, vector_col: str, scale: int = 256, largest: int = LARGEST) -> DataFrame:
    """(id, x): the complete vectors of table with each entry c, as double, turned into the long floor(scale * c).

    Raises an error in the job if an integer's magnitude exceeds `largest`."""
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.coalesce(complete("v"), F.lit(False)))

    def one(c: Column) -> Column:
        fits = F.abs(c) * scale < float(largest)
        return F.when(fits, F.floor(c * scale).cast("long")).otherwise(F.raise_error(F.lit(f"vector entry beyond {largest} / {scale}")).cast("long"))

    return rows.select("id", F.transform("v", one).alias("x"))


def _groups(column: pa.Array):
    """(places, matrix) of the lists of each length in a batch."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values, starts = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.append(0, sizes))[:-1]
    for d in np.unique(sizes):
        if d:
            at = np.flatnonzero(sizes == d)
            yield int(d), at, values[starts[at][:, None] + np.arange(d)]


def sums(vectors: DataFrame, column: str, kind: str = "long") -> dict[int, tuple[int, list]]:
    """{length: (count, sums by dimension)} of an array column; a row for each task, length and dimension is shuffled."""

    def partial(batches):
        total: dict = {}
        for b in batches:
            for d, at, x in _groups(b.column(0)):
                n, s = total.get(d, (0, 0))
                total[d] = n + len(at), s + x.sum(axis=0)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([s.tolist() for _, s in total.values()], pa.list_(pa.int64() if kind == "long" else pa.float64()))], ["d", "n", "s"])

    parts = vectors.select(column).mapInArrow(partial, f"d long, n long, s array<{kind}>")
    got = parts.select("d", "n", F.posexplode("s").alias("i", "s")).groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    out: dict[int, tuple[int, list]] = {}
    for r in sorted(got, key=lambda r: (r.d, r.i)):
        out.setdefault(r.d, (r.n, []))[1].append(r.s)
    return out


def scatter(vectors: DataFrame, column: str, means: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """{length: sum of (x - mean)(x - mean)^T} of an array column, centred before multiplying.

    Each task adds up one matrix for each length and gives its rows; rows of one number are added in one group, so a group holds
    as many rows as there are tasks. The driver gets one matrix for each length."""
    shared = vectors.sparkSession.sparkContext.broadcast(means)

    def partial(batches):
        total: dict = {}
        for b in batches:
            for d, _, x in _groups(b.column(0)):
                y = x - shared.value[d]
                total[d] = total.get(d, 0) + y.T @ y
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int64()), pa.array(range(d), pa.int64()), pa.array(m.tolist(), pa.list_(pa.float64()))], ["d", "i", "row"])

    def added(t: pa.Table) -> pa.Table:
        _, _, rows = next(_groups(t.column("row")))
        return pa.table([t.column("d").slice(0, 1), t.column("i").slice(0, 1), pa.array([rows.sum(axis=0).tolist()], pa.list_(pa.float64()))], names=["d", "i", "row"])

    schema = "d long, i long, row array<double>"
    got = vectors.select(column).mapInArrow(partial, schema).groupBy("d", "i").applyInArrow(added, schema).collect()
    out: dict[int, np.ndarray] = {}
    for r in got:
        out.setdefault(r.d, np.zeros((r.d, r.d)))[r.i] = r.row
    return {d: (m + m.T) / 2 for d, m in out.items()}


def jacobi(matrix: np.ndarray, sweeps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by cyclic Jacobi rotations.

    A sweep meets each pair of rows once, in the order of a round-robin tournament, so that the rotations of one step share no row
    and are made together. A pair is at rest when its off-diagonal entry is below the rounding of the root of the product of
    the two diagonal ones, which keeps small eigenvalues accurate; the end is a sweep without a rotation. The sign of an
    eigenvector makes its largest entry positive.
    """
    a = np.array(matrix, dtype=float)
    d = len(a)
    v = np.eye(d)
    least = 2.0**-105 * abs(np.trace(a))
    seats = list(range(d + d % 2))
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(min(x, y), max(x, y)) for x, y in zip(seats[:half], reversed(seats[half:])) if max(x, y) < d]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            off, pp, qq = a[p, q], a[p, p], a[q, q]
            go = np.abs(off) > np.maximum(2.0**-53 * np.sqrt(np.abs(pp * qq)), least)
            if not go.any():
                continue
            turned = True
            p, q, off, pp, qq = p[go], q[go], off[go], pp[go], qq[go]
            theta = (qq - pp) / (2 * off)
            t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            for m in (a, v):
                x, y = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * x - s * y, s * x + c * y
            x, y = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
            a[p, p], a[q, q] = pp - t * off, qq + t * off
            a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    else:
        raise RuntimeError(f"Jacobi rotations did not settle in {sweeps} sweeps")
    e = np.diag(a).copy()
    order = np.argsort(-e, kind="stable")
    v = v[:, order]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0) if d else v
    return e[order], v


@dataclass
class Whitening:
    """What was fitted on vectors of one length: count and sums of the fit list, eigenvalues and eigenvectors, and the check on it."""

    n: int
    sums: list
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def live(self, k: int) -> np.ndarray:
        """Which of the first k components have an eigenvalue above the rounding noise."""
        return self.values[:k] > NOISE * len(self.values) * self.trace

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """The first k whitened components; NaN where the eigenvalue is noise."""
        scale = np.where(self.live(k), 1 / np.sqrt(np.where(self.live(k), self.values[:k], 1)), np.nan)
        return (x - self.mean) @ self.vectors[:, :k] * scale

    def deviation(self, x: np.ndarray) -> list:
        """Sum over dimensions of (n x - S)^2, exact; None where it does not fit in 64 bits."""
        bound = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if len(self.sums) * bound * bound < 1 << 63:
            y = self.n * x - np.array(self.sums, dtype=np.int64)
            return (y * y).sum(axis=1).tolist()
        s = np.array(self.sums, dtype=object)
        return [z if (z := int(((self.n * r - s) ** 2).sum())) < 1 << 63 else None for r in x.astype(object)]


def fit(rows: DataFrame, components: int | None = 4) -> dict[int, Whitening]:
    """{length: Whitening} of the distinct x of rows; three passes over the written fit list, by sums, scatter and check."""
    listed = S.written(rows.select("x").distinct(), "fit-list")
    models: dict[int, Whitening] = {}
    first = sums(listed, "x")
    means = {d: np.array([s / n for s in ss]) for d, (n, ss) in first.items()}
    for d, m in (scatter(listed, "x", means) if first else {}).items():
        n, ss = first[d]
        values, vectors = jacobi(m / n)
        models[d] = Whitening(n, ss, values, vectors, float(np.trace(m / n)))
    # The check: the whitened fit list has the identity as its covariance. It is told by length of x, so lengths are kept apart.
    shared = rows.sparkSession.sparkContext.broadcast(dict(models))
    for d, model in models.items():
        k = min(d, components or d)
        live = model.live(k)
        if not live.any():
            continue

        def white(batches, d=d, k=k, live=live):
            for b in batches:
                for length, _, x in _groups(b.column(0)):
                    if length == d:
                        yield pa.RecordBatch.from_arrays([pa.array(shared.value[d].project(x, k)[:, live].tolist(), pa.list_(pa.float64()))], ["w"])

        w = listed.where(F.size("x") == d).mapInArrow(white, "w array<double>")
        wide = int(live.sum())
        n, ss = sums(w, "w", "double")[wide]
        cov = scatter(w, "w", {wide: np.array(ss) / n})[wide] / n
        model.identity_error = float(np.abs(cov - np.eye(wide)).max())
    S.forget(listed)
    return models


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int | None = 4, scale: int = 256) -> DataFrame:
    """One row per complete vector: id, n, deviation, whitened and explained (arrays of up to `components` values), identity_error.

    Entries become integers floor(scale * c); the fit list holds each distinct integer vector once, so copies weigh no more than one
    (equal vectors meet in a partial aggregation, so a hot one costs one row a task). Its sums are exact. 1. Each task adds the
    products of its centred vectors to one matrix; the matrices are added row by row. 2. The driver turns the d x d
    covariance by cyclic Jacobi rotations until nothing is left off the diagonal (jacobi). 3. Eigenvectors over the roots of
    their eigenvalues, sorted, are broadcast, d x d numbers, and each row is projected where it lies: no shuffle of the table.
    identity_error is the largest absolute entry of the covariance of the whitened fit list, measured in a pass of its own, less the identity.

    Vectors that are null or hold null, NaN or infinite entries give no row; empty ones have no component and give none either.
    Vectors of different lengths are fitted apart, each length on its own list. Null and repeated ids are rows like any other.
    A component whose eigenvalue is zero up to rounding (constant or dependent dimensions, a single vector) has whitened null, and is
    left out of identity_error; explained is null where all vectors are equal. deviation is null beyond 2**63 - 1. An integer
    beyond 2**40 raises an error. An empty table gives an empty result; other columns are not read.
    """
    rows = integers(table, id_col, vector_col, scale)
    models = fit(rows, components)
    shared = table.sparkSession.sparkContext.broadcast(models)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for d, at, x in _groups(b.column(1)):
                m = shared.value[d]
                k = min(d, components or d)
                w = m.project(x, k)
                white = [[None if z != z else z for z in r] for r in w.tolist()]
                share = [float(e / m.trace) if m.trace > 0 else None for e in m.values[:k]]
                f, count = pa.list_(pa.float64()), len(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([m.n] * count, pa.int64()), pa.array(m.deviation(x), pa.int64()), pa.array(white, f), pa.array([share] * count, f), pa.array([m.identity_error] * count, pa.float64())], ["id", "n", "deviation", "whitened", "explained", "identity_error"])

    out = rows.mapInArrow(run, f"id {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    return out.withColumnRenamed("id", id_col)


def by_component(white: DataFrame) -> DataFrame:
    """A row for each vector and component, numbered from 1 by falling eigenvalue."""
    keep = [c for c in white.columns if c not in ("whitened", "explained")]
    each = white.select(*keep, F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "z"))
    return each.select(*keep, (F.col("i") + 1).cast("int").alias("component"), F.col("z.whitened").alias("whitened"), F.col("z.explained").alias("explained"))
