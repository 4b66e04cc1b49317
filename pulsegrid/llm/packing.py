"""Best-fit packing by the configuration linear program over the length histogram."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.llm import _shared as S
from pulsegrid.llm import tokens as T


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """The pieces of each document's ids (with the end id): id, piece, start, length, ids_crc32.

    A document of at most `limit` ids is one piece; a longer one is cut into pieces of `limit`, of which the first may be
    shorter. Null and empty texts are the end id alone. No shuffle.
    """
    vocabulary = T.vocabulary_path(vocabulary)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["row", "piece", "start", "length", "ids_crc32"]

    def cut(batches):
        enc = T.made(T.Encoder, vocabulary)
        end = np.array([end_id], dtype=enc.kind).tobytes()
        for b in T.by_chars(batches, 1, T.BATCH_BYTES, 512):
            out = []
            for row, raw in enumerate(enc.batch(b.column(1).to_pylist())):
                ids = np.frombuffer(raw + end, dtype=enc.kind).astype("<u4")
                first = (len(ids) - 1) % limit + 1
                for p, start in enumerate([0, *range(first, len(ids), limit)]):
                    part = ids[start : first if p == 0 else start + limit]
                    out.append((row, p, start, len(part), zlib.crc32(part.tobytes())))
            row, *rest = zip(*out, strict=True)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *map(pa.array, rest, kinds)], ["id", *names[1:]])

    return rows.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long")


class Knapsack:
    """The multisets of lengths within `limit` of the greatest price: an unbounded knapsack by dynamic programming over the capacity."""

    def __init__(self, price: np.ndarray, limit: int, lengths: np.ndarray):
        self.price, self.limit, self.lengths = price, limit, lengths
        self.upto = np.searchsorted(lengths, np.arange(limit + 1), side="right")
        self.best = np.zeros(limit + 1)
        for room in range(int(lengths[0]), limit + 1):
            k = self.upto[room]
            self.best[room] = max(self.best[room - 1], float((self.best[room - lengths[:k]] + price[:k]).max()))

    def pattern(self, share: np.ndarray, rng: np.random.Generator, slack: float = 1e-4) -> dict[int, int]:
        """A random one of the best patterns (to within slack a step), {index: times}: each step takes a length in proportion to its share."""
        room, out = self.limit, {}
        while room >= self.lengths[0]:
            k = self.upto[room]
            gain = self.best[room - self.lengths[:k]] + self.price[:k]
            upto = np.cumsum(np.where(gain >= self.best[room] - slack, share[:k], 0.0))
            if upto[-1] > 0:
                i = int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))
            elif self.best[room - 1] >= self.best[room] - slack:
                room -= 1
                continue
            else:
                i = int(np.argmax(gain))
            out[i] = out.get(i, 0) + 1
            room -= int(self.lengths[i])
        return out


def fractional(counts: dict[int, int], limit: int, rounds: int = 160, draws: int = 64, step: float = 0.7, eps: float = 0.3, rest: float = 0.005, seed: int = 0) -> tuple[list[tuple[dict[int, int], float]], float]:
    """A fractional solution of the configuration program, as ({length: times}, weight), and a lower bound on the number of sequences.

    The program asks for the least total weight of patterns that cover the count of every length. Each round prices a length by its
    size, times a weight that falls by the factor exp(-eps * share covered); the knapsack finds the best patterns at these prices,
    and `draws` of them get `step` of the weight that the scarcest of their lengths can still take (a whole copy, if there is
    one). By duality the counts at the round's prices, over the best pattern's price, are a lower bound. It ends when less than
    `rest` of the tokens is uncovered, when the best patterns would leave 3 % of a sequence empty, or after `rounds`; what is
    uncovered then is left to the rounding. The work depends on the number of lengths, not of items.
    """
    lengths = np.array(sorted(x for x, n in counts.items() if n), dtype=np.int64)
    if not len(lengths):
        return [], 0.0
    asked = np.array([counts[int(x)] for x in lengths], dtype=np.float64)
    rng = np.random.default_rng(seed)
    total, left, low, out = float(lengths @ asked), asked.copy(), 0.0, []
    for _ in range(rounds):
        live = np.flatnonzero(left > 1e-9)
        if lengths @ left <= rest * total:
            break
        prices = lengths / limit * np.exp(eps * (left / asked - 1))
        size, need = lengths[live], left[live]
        sack = Knapsack(prices[live], limit, size)
        if len(live) == len(lengths):
            low = max(low, float(prices @ asked) / sack.best[limit])
        before = len(out)
        for _ in range(draws):
            pattern = sack.pattern(need * (size / limit) ** 30, rng)  # long pieces first, they fit in the fewest patterns
            at, times = np.fromiter(pattern, dtype=np.int64), np.fromiter(pattern.values(), dtype=np.float64)
            most = float((need[at] / times).min())
            weight = max(step * most, min(1.0, most))
            if weight <= 1e-9 or size[at] @ times < 0.97 * limit:
                continue
            need[at] -= times * weight
            out.append(({int(size[i]): int(t) for i, t in zip(at, times, strict=True)}, weight))
        left[live] = need
        if len(out) == before:
            break
    return out, max(low, total / limit)


def plan(counts: dict[int, int], limit: int) -> tuple[list[tuple[dict[int, int], int]], str]:
    """Patterns ({length: times}, copies) that hold exactly `counts` items of each length, and what made them: "program", or "best fit" where
    best-fit decreasing alone needs fewer sequences than the rounded program.

    The fractional solution is rounded: the weights of equal patterns add up, each pattern gets the whole copies in its weight and in what
    rounding has lost so far, but never more than the lengths have left. What no pattern took is packed best-fit decreasing
    over the histogram."""
    weights: dict[tuple, float] = {}
    for pattern, weight in fractional(counts, limit)[0]:
        key = tuple(sorted(pattern.items()))
        weights[key] = weights.get(key, 0.0) + weight
    left, out, lost = dict(counts), [], 0.0
    for key, weight in weights.items():
        copies = min(int(weight + lost + 1e-9), *(left[x] // t for x, t in key))
        lost += weight - copies
        if copies:
            out.append((dict(key), copies))
            for x, t in key:
                left[x] -= t * copies
    if min(left.values(), default=0) < 0:
        raise ValueError("more pieces were packed than there are")
    out += best_fit(left, limit)
    plain = best_fit(counts, limit)
    return (plain, "best fit") if sum(k for _, k in plain) < sum(k for _, k in out) else (out, "program")


def best_fit(counts: dict[int, int], limit: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on the histogram: bins of equal content are handled together."""
    open_bins: dict[int, list[tuple[dict[int, int], int]]] = {}
    done: list[tuple[dict[int, int], int]] = []
    for size in sorted((x for x, n in counts.items() if n), reverse=True):
        n = counts[size]
        for room in sorted(r for r in open_bins if r >= size):
            if n == 0:
                break
            kept = []
            for pattern, copies in open_bins.pop(room):
                times = room // size
                full, odd = (copies, 0) if n >= copies * times else divmod(n, times)
                for k, t in ((full, times), (1, odd)):
                    if k and t:
                        now = pattern | {size: pattern.get(size, 0) + t}
                        open_bins.setdefault(room - t * size, []).append((now, k)) if room - t * size != room else None
                        n -= k * t
                        copies -= k
                if copies:
                    kept.append((pattern, copies))
            if kept:
                open_bins.setdefault(room, []).extend(kept)
        times = limit // size
        for k, t in ((n // times, times), (1, n % times)):
            if k and t:
                open_bins.setdefault(limit - t * size, []).append(({size: t}, k))
    for group in open_bins.values():
        done += group
    return done


def runs(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """For each length, where its n-th piece goes: rows (length, first rank, times in a sequence, first sequence, offset), sorted."""
    out, used, sequence = [], {}, 0
    for pattern, copies in patterns:
        offset = 0
        for size, times in sorted(pattern.items(), reverse=True):
            out.append((size, used.get(size, 0), times, sequence, offset))
            used[size] = used.get(size, 0) + times * copies
            offset += size * times
        sequence += copies
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def pack(cut: DataFrame, limit: int = 2048, buckets: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (id, piece, length, ...) with lengths 1 to `limit`; cut is read several times, so give a written table.
    Columns of these two names are replaced.

    The histogram (at most `limit` rows) and the plan are on the driver. Pieces of one length are numbered without gathering
    them: a hash of id and piece deals them into buckets, a window numbers each bucket, and the buckets' counts add up.
    Repeated ids are items of their own. An empty table gives an empty result.
    """
    spark, cut = cut.sparkSession, cut.drop("sequence_id", "offset")
    counts = {int(r.length): int(r.n) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 1 <= x <= limit for x in counts):
        raise ValueError("a piece is longer than a sequence, or empty")
    table = runs(plan(counts, limit)[0])
    buckets = buckets or 4 * S.partitions(spark)
    dealt = cut.withColumn("__b", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sums = dealt.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("n"))
    before = sums.select("length", "__b", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranked = dealt.withColumn("__r", F.row_number().over(W.partitionBy("length", "__b").orderBy("id", "piece")) - 1).join(before, ["length", "__b"])
    ranked = ranked.withColumn("__r", (F.col("__r") + F.col("__before")).cast("long")).drop("__b", "__before")
    key = table[:, 0] * (1 << 44) + table[:, 1] if len(table) else np.zeros(0, dtype=np.int64)
    shared = spark.sparkContext.broadcast((key, table))  # bounded by the number of lengths and patterns
    at_length, at_rank = ranked.columns.index("length"), ranked.columns.index("__r")

    def assign(batches):
        keys, t = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            size, rank = b.column(at_length).to_numpy(zero_copy_only=False), b.column(at_rank).to_numpy(zero_copy_only=False)
            row = t[np.searchsorted(keys, size * (1 << 44) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            seq, off = row[:, 3] + nth // row[:, 2], row[:, 4] + nth % row[:, 2] * size
            keep = [i for i in range(b.num_columns) if i != at_rank]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*[b.schema.names[i] for i in keep], "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "__r")
    return ranked.mapInArrow(assign, f"{fields}, sequence_id long, offset long")
