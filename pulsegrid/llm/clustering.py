"""k-means of integer vectors with Drake's adaptive bounds, exact in every assignment."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import _shared as S
from pulsegrid.llm.whitening import _groups, integers

#: Bounds are kept this share on the safe side of what doubles can hold.
SLACK = 1e-9
#: Integers of larger magnitude are refused: a squared distance would no longer fit in 64 bits.
LARGEST = 1 << 27


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, pair by pair, as exact integers."""
    z = x - y
    return np.einsum("ij,ij->i", z, z)


def table_of_squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All squared distances of the rows of x and c, exact: in doubles while every sum stays below 2**53, else in integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = float if 4 * x.shape[1] * most * most < 1 << 53 else np.int64
    a, b = x.astype(kind), c.astype(kind)
    return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype(np.int64)


class Bounds:
    """What is stored for a block of vectors: the centroid and the squared distance, `near` other centroids with lower bounds of
    their distances, in rising order of these, and one lower bound for all the rest."""

    def __init__(self, cluster: np.ndarray, distance: np.ndarray, near: np.ndarray, low: np.ndarray, rest: np.ndarray) -> None:
        self.cluster, self.distance, self.near, self.low, self.rest = cluster, distance, near, low, rest
        self.used = np.zeros(len(cluster), dtype=np.int64)

    @classmethod
    def scanned(cls, x: np.ndarray, c: np.ndarray, keep: int) -> Bounds:
        """From the distances to all centroids; of equal ones the smaller number comes first."""
        d = table_of_squares(x, c)
        order = np.argsort(d, axis=1, kind="stable")
        root = np.sqrt(np.take_along_axis(d, order, axis=1)) * (1 - SLACK)
        keep = min(keep, len(c) - 1)
        rest = root[:, keep + 1] if len(c) > keep + 1 else np.full(len(x), np.inf)
        return cls(order[:, 0].astype(np.int64), np.take_along_axis(d, order[:, :1], axis=1)[:, 0], order[:, 1 : keep + 1], root[:, 1 : keep + 1], rest)

    def moved(self, x: np.ndarray, c: np.ndarray, drift: np.ndarray, keep: int) -> Bounds:
        """The bounds after the centroids have moved by `drift` to c, with `keep` neighbours stored.

        The distance to the own centroid is taken anew. Where the bound of the rest is not above it, all centroids are scanned; else
        only those neighbours are measured whose bound is not above it, and the nearest, of equal ones the smaller number, takes over."""
        self.low = self.low - drift[self.near] * (1 + SLACK)
        self.rest = self.rest - drift.max(initial=0) * (1 + SLACK)
        self.distance = squares(x, c[self.cluster])
        reach = np.sqrt(self.distance) * (1 + SLACK)
        whole = self.rest <= reach
        row, place = np.nonzero((self.low <= reach[:, None]) & ~whole[:, None])
        who = self.near[row, place]
        d = squares(x[row], c[who])
        self.low[row, place] = np.sqrt(d) * (1 - SLACK)
        self.used = np.bincount(row, minlength=len(x))
        order = np.lexsort((who, d, row))
        best = order[np.append(True, row[order][1:] != row[order][:-1])] if len(order) else order
        r, p, w, e = row[best], place[best], who[best], d[best]
        better = (e < self.distance[r]) | (e == self.distance[r]) & (w < self.cluster[r])
        r, p, w, e = r[better], p[better], w[better], e[better]
        self.near[r, p], self.low[r, p] = self.cluster[r], np.sqrt(self.distance[r]) * (1 - SLACK)
        self.cluster[r], self.distance[r] = w, e
        order = np.argsort(self.low, axis=1, kind="stable")
        self.near, self.low = np.take_along_axis(self.near, order, axis=1), np.take_along_axis(self.low, order, axis=1)
        if keep < self.near.shape[1]:
            self.rest = np.minimum(self.rest, self.low[:, keep])
            self.near, self.low = self.near[:, :keep], self.low[:, :keep]
        at = np.flatnonzero(whole)
        if len(at):
            new = Bounds.scanned(x[at], c, self.near.shape[1])
            self.cluster[at], self.distance[at], self.near[at], self.low[at], self.rest[at] = new.cluster, new.distance, new.near, new.low, new.rest
            self.used[at] = -1
        return self

    def arrow(self, ids: pa.Array, x: pa.Array) -> pa.RecordBatch:
        def lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
            offsets = pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32())
            return pa.ListArray.from_arrays(offsets, pa.array(m.reshape(-1), kind))

        return pa.RecordBatch.from_arrays([ids, x, pa.array(self.cluster, pa.int32()), pa.array(self.distance, pa.int64()), lists(self.near, pa.int32()), lists(self.low, pa.float64()), pa.array(self.rest, pa.float64()), pa.array(self.used, pa.int32())], NAMES)


NAMES = ["id", "x", "cluster", "distance", "near", "low", "rest", "used"]


def _assigned(rows: DataFrame, kind: str, c: np.ndarray, drift: np.ndarray | None, keep: int, what: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((c, drift))

    def run(batches):
        c, drift = shared.value
        for big in batches:
            for start in range(0, big.num_rows, 4096):
                b = big.slice(start, 4096)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, -1)
                if drift is None:
                    held = Bounds.scanned(x, c, keep)
                else:
                    n = b.num_rows
                    near, low = (b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for i in (4, 5))
                    cluster = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                    held = Bounds(cluster, b.column(3).to_numpy(zero_copy_only=False), near.astype(np.int64), low.copy(), b.column(6).to_numpy(zero_copy_only=False)).moved(x, c, drift, keep)
                yield held.arrow(b.column(0), b.column(1))

    schema = f"id {kind}, x array<int>, cluster int, distance long, near array<int>, low array<double>, rest double, used int"
    return S.written(rows.mapInArrow(run, schema), what)


def _cluster_sums(state: DataFrame) -> tuple[dict[int, tuple[int, list]], int]:
    """{cluster: (count, sums)}, and how many neighbours a vector needed at most; a row for each task, cluster and dimension is shuffled."""

    def partial(batches):
        total: dict = {}
        most = 0
        for b in batches:
            cluster, used = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            most = max(most, int(used.max(initial=0)))
            for _, at, x in _groups(b.column(1)):
                who, index = np.unique(cluster[at], return_inverse=True)
                s = np.zeros((len(who), x.shape[1]), dtype=np.int64)
                np.add.at(s, index, x)
                for j, (a, n) in enumerate(zip(who.tolist(), np.bincount(index).tolist(), strict=True)):
                    old = total.get(a, (0, 0))
                    total[a] = old[0] + n, old[1] + s[j]
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([s.tolist() for _, s in total.values()], pa.list_(pa.int64())), pa.array([most] * len(total), pa.int32())], ["cluster", "n", "s", "most"])

    parts = state.select("cluster", "x", "used").mapInArrow(partial, "cluster int, n long, s array<long>, most int")
    got = parts.select("cluster", "n", "most", F.posexplode("s").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("most").alias("most")).collect()
    out: dict[int, tuple[int, list]] = {}
    for r in sorted(got, key=lambda r: (r.cluster, r.i)):
        out.setdefault(r.cluster, (r.n, []))[1].append(r.s)
    return out, max((r.most for r in got), default=0)


def cluster(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 40, rounds: int = 5, salt: str = "2:", scale: int = 256) -> DataFrame:
    """One row per kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly `dims` entries, none null, NaN or infinite; an entry c becomes the integer floor(scale * c). Centroids
    start as the k vectors of lowest sha256 of `salt` and id, in the order of these. A round assigns every vector to the
    nearest centroid (of equally near ones the smaller number) and moves each centroid that has vectors to the componentwise
    floor of their mean; after the last round vectors are assigned once more. All distances and means are exact integers.

    A vector stores lower bounds for its nearest other centroids, k / 4 at first, and one bound for all the rest (Drake). When the
    centroids have moved, the bounds are lowered by as much; a vector measures only the neighbours whose bound does not rule
    them out, and scans all centroids only where the bound of the rest doesn't either. How many neighbours are stored follows from how
    many were needed at most in the round, down to k / 8. Bounds, vectors and assignments are a table in the shared folder,
    written anew in each round, so a lost executor costs its tasks only; the table before is deleted. Tasks send one row for each
    cluster and dimension; the driver holds k x dims numbers. Nothing is grouped by vector, so hot vectors and clusters are no matter.

    Null ids come last in the order of the start, by vector; rows that share an id stand in the order of their vectors. With fewer
    than k vectors there are as many centroids as vectors; equal centroids are allowed, the larger number then stays empty and
    stands still. Repeated rows are vectors like any other. Integers beyond 2**27 raise an error. No kept vector gives an empty
    result; other columns are not read.
    """
    spark = table.sparkSession
    rows = integers(table.where(F.size(vector_col) == dims), id_col, vector_col, scale, LARGEST)
    rows = rows.select("id", F.col("x").cast("array<int>").alias("x"))
    kind = rows.schema["id"].dataType.simpleString()
    mark = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(mark.asc_nulls_last(), "x").limit(k).collect()
    c = np.array([r.x for r in first], dtype=np.int64).reshape(-1, dims)
    keep = max(1, len(c) // 4)
    least = max(1, len(c) // 8)
    if not len(c):
        return spark.createDataFrame([], f"{id_col} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state = _assigned(rows, kind, c, None, keep, "bounds")
    for _ in range(rounds):
        means, most = _cluster_sums(state)
        new = c.copy()
        for j, (n, s) in means.items():
            new[j] = [v // n for v in s]
        drift = np.sqrt(squares(new, c))
        keep, c = max(least, min(keep, most or keep)), new
        after = _assigned(state, kind, c, drift, keep, "bounds")
        S.forget(state)
        state = after
    inertia = {r.cluster: r.s for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    totals = spark.createDataFrame([(j, s, sum(inertia.values()), digests[j]) for j, s in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = state.select(F.col("id").alias(id_col), "cluster", "distance").join(F.broadcast(totals), "cluster")  # at most k rows
    return out.select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
