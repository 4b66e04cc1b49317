"""Embedding near-dedup by a forest of random-projection trees with spill."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import _shared as S


@dataclass
class Tree:
    """Nodes in order: direction and threshold of each, and its two children; a child below 0 is the leaf -child - 1."""

    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray

    def leaves(self, vectors: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves a vector falls into: rows within `spill` of a threshold go both ways."""
        if not len(self.thresholds):
            return np.arange(len(vectors)), np.zeros(len(vectors), dtype=np.int64)
        rows, leaves = [], []
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), -node - 1))
                continue
            x = vectors[at] @ self.directions[node] - self.thresholds[node]
            for side, go in ((0, x <= spill), (1, x >= -spill)):
                if go.any():
                    todo.append((int(self.children[node, side]), at[go]))
        return np.concatenate(rows), np.concatenate(leaves)


def grow(sample: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """Splits the sample at the median of its projection on a random direction, again and again, until `leaf` rows are left."""
    directions, thresholds, children = [], [], []
    n_leaves = 0

    def split(at: np.ndarray, depth: int) -> int:
        nonlocal n_leaves
        d = rng.standard_normal(sample.shape[1])
        d /= np.linalg.norm(d)
        x = sample[at] @ d
        t = float(np.median(x)) if len(at) else 0.0
        left, right = at[x <= t], at[x > t]
        if len(at) <= leaf or depth >= 40 or not len(left) or not len(right):
            n_leaves += 1
            return -n_leaves
        me = len(thresholds)
        directions.append(d)
        thresholds.append(t)
        children.append([0, 0])
        children[me] = [split(left, depth + 1), split(right, depth + 1)]
        return me

    split(np.arange(len(sample)), 0)
    dims = sample.shape[1]
    return Tree(np.array(directions).reshape(-1, dims), np.array(thresholds), np.array(children, dtype=np.int64).reshape(-1, 2))


def usable(vector: str = "embedding") -> F.Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    x = F.col(vector)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & good & F.exists(x, lambda v: v != 0)


def _matrix(lists: pa.ListArray, at: np.ndarray, dims: int) -> np.ndarray:
    """The lists at these places, all of `dims` numbers, as rows."""
    starts = np.cumsum(np.append(0, lists.value_lengths().to_numpy(zero_copy_only=False)))[:-1]
    return lists.flatten().to_numpy(zero_copy_only=False)[starts[at][:, None] + np.arange(dims)]


def _down(shared, spill: float, whole: bool):
    """(c, k, label, copies, v) -> a row for each leaf of each tree: its place, and if `whole` the vector and the leaves before it."""

    def run(batches):
        for big in batches:
            for start in range(0, big.num_rows, 1024):
                b = big.slice(start, 1024)
                lists = b.column(4)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                for d in np.unique(sizes):
                    at = np.flatnonzero(sizes == d)
                    x = _matrix(lists, at, int(d))
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                    trees = shared.value.get(int(d)) or [Tree(np.zeros((0, d)), np.zeros(0), np.zeros((0, 2)))]
                    got = [tree.leaves(unit, spill / np.sqrt(d)) for tree in trees]
                    row = np.concatenate([r for r, _ in got])
                    entry = np.concatenate([leaf.astype(np.int64) | t << 32 for t, (_, leaf) in enumerate(got)])
                    order = np.lexsort((entry, row))
                    row, entry = row[order], entry[order]
                    tree, leaf = pa.array(int(d) << 32 | entry >> 32 << 24, pa.int64()), pa.array(entry & (1 << 32) - 1, pa.int64())
                    pick = pa.array(at[row])
                    if not whole:
                        yield pa.RecordBatch.from_arrays([b.column(2).take(pick), tree, leaf], ["label", "tree", "leaf"])
                        continue
                    first = np.searchsorted(row, row)
                    held = np.arange(len(row)) - first
                    offset = np.append(0, np.cumsum(held))
                    flat = entry[np.arange(offset[-1]) - np.repeat(offset[:-1] - first, held)]
                    before = pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pa.array(flat, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*(b.column(i).take(pick) for i in range(5)), tree, leaf, before], ["c", "k", "label", "copies", "v", "tree", "leaf", "before"])

    return run


def _bits(before: pa.ListArray) -> np.ndarray:
    """A row of bits for each list: which of the entries that several lists hold it has."""
    sizes = before.value_lengths().to_numpy(zero_copy_only=False)
    entries, number, count = np.unique(before.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    keep = count[number] > 1
    width = -(-max(int((count > 1).sum()), 1) // 64) * 64
    held = np.zeros((len(sizes), width), dtype=bool)
    held[np.repeat(np.arange(len(sizes)), sizes)[keep], place[number[keep]]] = True
    return np.packbits(held, axis=1).view(np.uint64)


def _compare(cosine: float):
    """The classes of a leaf, or of two blocks of one -> (c, k, others, root) of each class that links with another there: how many
    rows it links with that it has not met in a leaf before this one, and the smallest class that links lead to within the leaf."""

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("k").to_numpy(), table.column("c").to_numpy()))
        table = table.take(pa.array(order)).combine_chunks()
        n, dims = table.num_rows, table.column("tree")[0].as_py() >> 32
        c, k, copies, mine = (table.column(x).to_numpy() for x in ("c", "k", "copies", "mine"))
        m = _matrix(table.column("v").chunk(0), np.arange(n), dims)
        met = _bits(table.column("before").chunk(0))
        norm = np.linalg.norm(m, axis=1)
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        one, two = np.flatnonzero(mine == x), np.flatnonzero(mine == y)
        others, root = np.zeros(n), np.arange(n)
        for i in range(0, len(one), 512):
            rows = one[i : i + 512]
            dots = m[rows] @ m[two].T / norm[rows, None] / norm[two]
            a, b = np.nonzero(dots >= cosine - 1e-9)
            near = dots[a, b] < cosine + 1e-9
            p, q = rows[a], two[b]
            if x == y:
                p, q, near = (z[p < q] for z in (p, q, near))
            for j in range(0, len(p), 1 << 16):
                u, v, close = p[j : j + (1 << 16)], q[j : j + (1 << 16)], near[j : j + (1 << 16)]
                if close.any():  # the sum in one order, whatever the pair's place in a leaf
                    s, t = u[close], v[close]
                    good = ~close
                    good[close] = np.einsum("ij,ij->i", m[s], m[t]) / (norm[s] * norm[t]) >= cosine
                    u, v = u[good], v[good]
                fresh = ~(met[u] & met[v]).any(axis=1)
                others += np.bincount(u[fresh], copies[v[fresh]], n) + np.bincount(v[fresh], copies[u[fresh]], n)
                while True:
                    s, t = root[u], root[v]
                    apart = s != t
                    if not apart.any():
                        break
                    s, t, u, v = s[apart], t[apart], u[apart], v[apart]
                    np.minimum.at(root, np.maximum(s, t), np.minimum(s, t))
                    while (root[root] != root).any():
                        root = root[root]
        joined = np.bincount(root, minlength=n)[root] > 1
        return pa.table([pa.array(z[joined]) for z in (c, k, others.astype(np.int64), c[root])], names=["c", "k", "others", "root"])

    return run


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, trees: int = 8, leaf: int = 256, spill: float = 0.28, sample_rows: int = 20_000, block: int = 1024, seed: int = 5) -> DataFrame:
    """One row per row of table: id, n_links, component_id, kept. Rows link when their labels are equal and not null and the
    cosine, in double precision, is at least `cosine`; component_id is the smallest id reachable, kept says that it is the own one.

    Equal vectors of a label become one class. A forest is grown on a bounded sample (the `sample_rows` classes of lowest hash) by
    recursive random splits; then every class goes down every tree, both ways within `spill` / sqrt(dimension) of a threshold, and is
    compared within (label, tree, leaf). The leaf size in the sample shrinks with sample / classes, so that leaves hold near `leaf`
    classes of the whole table. A leaf of more than `block` classes is compared block by block in tasks of their own, all
    blocks with all, so no task holds a leaf of unbounded size. Pairs are decided in double precision and never leave their task:
    it gives each class its number of links and one link to the smallest class that it is joined with there. A class carries
    the leaves it falls into before this one, and a pair is counted in the first leaf that both share, so once.

    Null ids, and vectors that are null, zero, empty or hold null or non-finite components, link with nothing. Vectors of
    different lengths do not link. Rows with equal ids are one vertex of the components; n_links counts rows. Projections of a pair
    at 0.98 differ by a standard deviation of 0.2 / sqrt(dimension), so one split parts it with a probability near 1 % or less, and
    eight trees find nearly all pairs; the tests measure recall against brute force.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(usable("v"), F.lit(False)))
    keyed = rows.where("ok").withColumn("key", F.unhex(F.sha2(F.concat_ws("|", "label", F.array_join(F.col("v").cast("array<string>"), ",")), 256)))
    classes = S.with_group(keyed.select("id", "label", "key", "v"), ["label", "key"], "id", low="rep", size="copies")
    classes = S.written(classes.withColumn("k", F.xxhash64("key")).drop("key"), "vectors")
    first = S.written(classes.where("id = rep").select(F.col("id").alias("c"), "k", "label", "copies", "v").dropDuplicates(["c", "k", "label"]), "classes")

    total = first.count()
    sample = first.orderBy(F.xxhash64(F.lit(seed), "c"), "c", "k").limit(sample_rows).select("v").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r.v), []).append(r.v)
    forest: dict[int, list[Tree]] = {}
    for dims, got in by_dim.items():
        x = np.array(got)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        size = max(8, int(leaf * min(1.0, len(sample) / max(1, total))))
        rng = np.random.default_rng([seed, dims])
        forest[dims] = [grow(x, size, rng) for _ in range(trees)]
    shared = spark.sparkContext.broadcast(forest)  # at most trees x sample_rows / 4 nodes

    where = ["label", "tree", "leaf"]
    sizes = first.mapInArrow(_down(shared, spill, False), "label string, tree long, leaf long").groupBy(*where).agg(F.count(F.lit(1)).alias("n"))
    over = S.written(sizes.where(F.col("n") > block).select(*where, F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large-leaves")
    placed = first.mapInArrow(_down(shared, spill, True), "c long, k long, label string, copies long, v array<double>, tree long, leaf long, before array<long>")
    placed = placed.join(S.small(over, over.count(), 100_000), where, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("c"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumns({"x": F.least("mine", "other"), "y": F.greatest("mine", "other")}).drop("blocks", "other")
    found = S.written(placed.groupBy(*where, "x", "y").applyInArrow(_compare(cosine), "c long, k long, others long, root long"), "links")

    degree = found.groupBy(F.col("c").alias("rep"), "k").agg(F.sum("others").alias("others"))
    parts = S.components(found.where("c <> root").select(F.col("c").alias("u"), F.col("root").alias("v")))
    joined = classes.select("id", "rep", "k", "copies").join(degree, ["rep", "k"], "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    joined = joined.select("id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = joined.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
