"""Authors who mention a ticker near each other in time: all pairs of them, and links enough to tell who is connected."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Mentions of a range of authors, and pairs of mentions that two ranges have, about; a ticker with more is cut into ranges.
MENTIONS, PAIRS = 131_072, 32_000_000
#: Pairs in a batch, about; mentions in the sample for each range.
BATCH, SAMPLED = 1_000_000, 64
#: Partitions at most.
MOST_PARTS = 10_000


def _mentions(rows: DataFrame) -> DataFrame:
    at = F.unix_micros(F.col("created_utc").cast("timestamp"))
    return rows.select("ticker", "author", at.alias("at")).where("ticker is not null and author is not null and at is not null")


def _bounds(at: DataFrame, micros: int, mentions: int, pairs: int) -> list:
    """(ticker, bounds) of the tickers to be cut: the authors, from a sample by hash, at which the second and further ranges begin."""
    picked = F.when(F.pmod(F.xxhash64("ticker", "author", "at"), F.lit(max(1, mentions // SAMPLED))) == 0, F.col("author"))
    slots = at.groupBy("ticker", (F.col("at") - F.pmod("at", F.lit(micros))).alias("slot"), picked.alias("author")).agg(F.count(F.lit(1)).alias("n"))
    sizes = slots.groupBy("ticker").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") ** 2).alias("pairs"), F.sort_array(F.collect_list("author")).alias("authors"))
    out = []
    for x in sizes.where((F.col("n") > mentions) | (F.col("pairs") > pairs)).collect():
        n, k = len(x.authors), max(-(-x.n // mentions), isqrt(int(x.pairs // pairs)) + 1)
        out.append((x.ticker, sorted({x.authors[n * i // k] for i in range(1, k) if n})))
    return out


def _neighbours(micros: int):
    """Of one ticker and two ranges of authors, or one: each author of the first with those of the second who are near."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).select(["author", "at", "first"]).sort_by("at").combine_chunks()
        if not rows.num_rows:
            return
        ticker, one = key[0], key[1].as_py() == key[2].as_py()
        # Authors are numbered by their first mention, so that neighbours stand in the order of time.
        coded = rows["author"].combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        names, code, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64), rows["at"].to_numpy()
        first = rows["first"].to_numpy(zero_copy_only=False)
        a, b = (slice(None), slice(None)) if one else (first, ~first)
        rank = np.empty(len(names), np.int64)
        rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        x, t, y, u = code[a], at[a], code[b], at[b]
        by = np.argsort(x, kind="stable")
        x, t = x[by], t[by]
        low, high = np.searchsorted(u, t - micros, "left"), np.searchsorted(u, t + micros, "right")
        # What an author's earlier mentions have reached is not read again.
        low[1:] = np.where(x[1:] == x[:-1], np.maximum(low[1:], high[:-1]), low[1:])
        ends = np.append(np.flatnonzero(x[1:] != x[:-1]) + 1, len(x)) if len(x) else np.zeros(0, np.int64)
        done = np.append(0, np.cumsum(high - low))
        p = 0
        while p < len(x):
            q = int(ends[max(np.searchsorted(done[ends], done[p] + BATCH, "right") - 1, np.searchsorted(ends, p, "right"))])
            long = (high - low)[p:q]
            own = np.append(True, x[p + 1 : q] != x[p : q - 1])
            whose, line = x[p:q][own], np.repeat(np.cumsum(own) - 1, long)
            other = y[np.repeat(low[p:q] - (done[p:q] - done[p]), long) + np.arange(len(line))]
            if one:
                later = rank[other] > rank[whose[line]]
                line, other = line[later], other[later]
            pair = line * len(names) + other
            pair = np.sort(pair.astype(np.int32) if len(whose) * len(names) < 2**31 else pair)
            pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
            cuts = np.searchsorted(pair, np.arange(len(whose) + 1, dtype=np.int64) * len(names))
            near = names.take(pa.array(pair - np.repeat(np.arange(len(whose)) * len(names), np.diff(cuts))))
            yield pa.RecordBatch.from_arrays([pa.repeat(ticker, len(whose)), names.take(pa.array(whose)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), near)], ["ticker", "a", "near"])
            p = q

    return run


def near_pairs(rows: DataFrame, seconds: int = 1800, mentions: int = MENTIONS, pairs: int = PAIRS) -> DataFrame:
    """(ticker, a, b) of authors a < b who mention a ticker within so many seconds of each other, to the microsecond.

    There may be as many pairs as the square of the authors, so no pair is shuffled: a ticker's authors are cut into ranges of about
    `mentions` mentions, or fewer if they would have more than `pairs` pairs, and each two ranges meet in one group, which gives each of
    its pairs once. A mention is sent once for each range of its ticker; a task holds the mentions of two ranges and gives its pairs
    batch by batch. The driver gets the bounds of the ranges, at most a few for each `mentions` mentions."""
    at, micros = _mentions(rows), seconds * 1_000_000
    bounds = _bounds(at, micros, mentions, pairs)
    i, j = F.least("block", "other"), F.greatest("block", "other")
    if bounds:
        cut = F.broadcast(at.sparkSession.createDataFrame(bounds, at.select("ticker", F.array("author").alias("bounds")).schema))
        blocks = at.join(cut, "ticker", "left").withColumn("bounds", F.coalesce("bounds", F.array().cast(cut.schema["bounds"].dataType)))
        blocks = blocks.withColumn("block", F.size(F.filter("bounds", lambda x: x <= F.col("author")))).withColumn("other", F.explode(F.sequence(F.lit(0), F.size("bounds"))))
    else:
        blocks = at.withColumns({"block": F.lit(0), "other": F.lit(0)})
    sent = blocks.select("ticker", i.alias("i"), j.alias("j"), (F.col("block") == i).alias("first"), "author", "at")
    # So many partitions whatever the bytes of the mentions: the work is in the pairs.
    groups = sum((len(x) + 1) * (len(x) + 2) // 2 for _, x in bounds)
    sent = sent.repartition(max(min(MOST_PARTS, groups), int(at.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "ticker", "i", "j")
    kinds = dict(at.dtypes)
    found = sent.groupBy("ticker", "i", "j").applyInArrow(_neighbours(micros), f"ticker {kinds['ticker']}, a {kinds['author']}, near array<{kinds['author']}>")
    return found.select("ticker", "a", F.explode("near").alias("b"))


def near_links(rows: DataFrame, seconds: int = 1800) -> DataFrame:
    """(ticker, a, b): some of the pairs of near_pairs, at most two for each author and slot of time, that connect the same authors.

    Those of a slot are all near each other: each is linked with the smallest. Two slots that follow are connected if the last mention of the
    one is near the first of the other."""
    at, micros = _mentions(rows), seconds * 1_000_000
    at = at.withColumn("slot", F.col("at") - F.pmod("at", F.lit(micros)))
    slots = at.groupBy("ticker", "slot").agg(F.min("author").alias("least"), F.min_by("author", "at").alias("first"), F.min("at").alias("begins"), F.max_by("author", "at").alias("last"), F.max("at").alias("ends"))
    inside = at.select("ticker", "slot", "author").distinct().join(slots.select("ticker", "slot", "least"), ["ticker", "slot"]).select("ticker", F.col("least").alias("a"), F.col("author").alias("b"))
    after = slots.select("ticker", (F.col("slot") - micros).alias("slot"), "first", "begins")
    across = slots.select("ticker", "slot", "last", "ends").join(after, ["ticker", "slot"]).where(F.col("begins") - F.col("ends") <= micros)
    across = across.select("ticker", F.least("first", "last").alias("a"), F.greatest("first", "last").alias("b"))
    return inside.unionByName(across).where("a <> b").distinct()
