"""Communities of a weighted graph by modularity: local moves, then contraction, as rounds of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.numeric import r
from pulsegrid.operators.steps import saved

#: Weights are taken as whole multiples of this, so that sums don't depend on the order of rows and ties are real.
UNIT = 1e-6


def _exact(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def _moves(edges: DataFrame, state: DataFrame, total: int) -> DataFrame:
    """(node, to): for each node that gains by it the community to move to; of equally good ones the smallest name.

    A move of u from c to d raises modularity by 2 / total^2 of [total * (w(u,d) - w(u,c)) - k(u) * (K(d) - K(c) + k(u))], where
    w are weights to members other than u, k is a node's and K a community's weight: whole numbers, compared exactly. A node that is
    alone joins another that is alone only if that one's name is smaller, so that two don't change places."""
    tot = state.groupBy("comm").agg(F.sum("k").alias("tot"), F.count(F.lit(1)).alias("size"))
    near = edges.join(state.select(F.col("node").alias("v"), F.col("comm").alias("to")), "v").groupBy("u", "to").agg(F.sum("w").alias("w"))
    near = near.join(tot.withColumnRenamed("comm", "to"), "to").join(state.join(tot.select("comm", F.col("size").alias("mine")), "comm").select(F.col("node").alias("u"), "k", "comm", "mine"), "u")
    near = near.where((F.col("size") > 1) | (F.col("mine") > 1) | (F.col("to") <= F.col("comm")))
    own = F.col("to") == F.col("comm")
    rest = F.col("tot") - F.when(own, F.col("k")).otherwise(0)
    scored = near.withColumn("gain", F.lit(total).cast("decimal(19,0)") * _exact(F.col("w")) - _exact(F.col("k")) * _exact(rest))
    # A node with no other member of its own community beside it keeps the gain of leaving it empty-handed.
    alone = state.join(tot.drop("size"), "comm").select(F.col("node").alias("u"), (-_exact(F.col("k")) * _exact(F.col("tot") - F.col("k"))).alias("bare"))
    best = scored.groupBy("u").agg(F.max_by(F.when(own, F.col("gain")), F.when(own, 1).otherwise(0)).alias("stay"), F.max(F.when(~own, F.col("gain"))).alias("top"))
    best = best.join(alone, "u").where(F.col("top") > F.coalesce("stay", "bare")).select("u", "top")
    picked = scored.where(~own).join(best, "u").where(F.col("gain") == F.col("top"))
    return picked.groupBy(F.col("u").alias("node")).agg(F.min("to").alias("to"))


def _quality(edges: DataFrame, state: DataFrame, total: int, loops: int) -> int:
    """Modularity times total^2, a whole number: total * (weight within communities, both ways) - sum of the squares of their weights."""
    within = edges.join(state.select(F.col("node").alias("u"), F.col("comm").alias("a")), "u").join(state.select(F.col("node").alias("v"), F.col("comm").alias("b")), "v")
    inside = within.where("a = b").select(F.col("w").cast("decimal(38,0)").alias("w"), F.lit(1).alias("part"))
    squares = state.groupBy("comm").agg(_exact(F.sum("k")).alias("t")).select((F.col("t") * F.col("t")).cast("decimal(38,0)").alias("w"), F.lit(2).alias("part"))
    got = {x.part: int(x.s) for x in inside.unionByName(squares).groupBy("part").agg(F.sum("w").alias("s")).collect()}
    return total * (got.get(1, 0) + loops) - got.get(2, 0)


def communities(edges: DataFrame, seed: int = 42, patience: int = 2, least: float = 1e-4) -> tuple[DataFrame, float]:
    """(a, b, weight) of an undirected graph -> ((node, community), modularity). A community is named by one of its nodes.

    Level by level. Every node starts alone. In a round half of the nodes (by crc32 of 'seed:level:pair of rounds:node', the even ones, then the odd) move at
    once, each to the neighbouring community that raises modularity most, of equal ones to the smallest name. A round that raises the
    modularity of the whole stands, another is undone; after `patience` rounds running that raise it by less than `least` the level
    is done. Then communities become nodes, weights within them loops, and the next level begins, until a level moves nothing. Weights are
    whole multiples of 1e-6 (smaller ones vanish) and all comparisons exact, so the partition follows from the graph and the seed.

    Loops and weights of at most 0 are left out; parallel edges add up, in either direction. An empty graph has no communities
    and modularity 0. A hub's edges are summed by community before they meet; the driver holds three numbers a round, and
    levels and rounds are tables in the shared folder.
    """
    e = edges.where("a <> b and weight > 0").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.round(F.col("weight") / UNIT).cast("long").alias("w"))
    one = e.groupBy("u", "v").agg(F.sum("w").alias("w")).where("w > 0")
    both = saved(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")))
    total = int(both.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("s")).first().s)
    names = saved(both.select(F.col("u").alias("node"), F.col("u").alias("comm")).distinct())
    loops = both.select(F.col("u").alias("node"), F.lit(0).cast("long").alias("loop")).distinct()
    level, quality = 0, 0
    while True:
        weight = both.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("s"))
        state = saved(loops.join(weight, "node", "left").select("node", (F.coalesce("s", F.lit(0)) + F.col("loop")).alias("k"), "loop", F.col("node").alias("comm")))
        looped = int(state.agg(F.coalesce(F.sum("loop"), F.lit(0)).alias("s")).first().s)
        quality = _quality(both, state, total, looped)
        turn, idle, moved = 0, 0, False
        while idle < patience and total:
            half = F.crc32(F.concat(F.lit(f"{seed}:{level}:{turn // 2}:"), F.col("node").cast("string")).cast("binary")) % 2 == turn % 2
            moves = _moves(both, state, total).where(half)
            after = saved(state.join(moves, "node", "left").select("node", "k", "loop", F.coalesce("to", "comm").alias("comm")))
            now = _quality(both, after, total, looped)
            turn += 1
            idle = 0 if now - quality >= least * total * total else idle + 1
            if now > quality:
                state, quality, moved = after, now, True
        if not moved:
            break
        step = state.select(F.col("node").alias("comm"), F.col("comm").alias("to"))
        names = saved(names.join(step, "comm").select("node", F.col("to").alias("comm")))
        joined = both.join(state.select(F.col("node").alias("u"), F.col("comm").alias("a")), "u").join(state.select(F.col("node").alias("v"), F.col("comm").alias("b")), "v")
        merged = saved(joined.groupBy("a", "b").agg(F.sum("w").alias("w")))
        old = state.groupBy("comm").agg(F.sum("loop").alias("s"))
        inside = merged.where("a = b").select(F.col("a").alias("comm"), "w")
        loops = saved(old.join(inside, "comm", "left").select(F.col("comm").alias("node"), (F.col("s") + F.coalesce("w", F.lit(0))).alias("loop")))
        both = saved(merged.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"), "w"))
        level += 1
    return names.select("node", F.col("comm").alias("community")), quality / total / total if total else 0.0


def lift_edges(threads: DataFrame, top: int | None = 60, min_shared: int = 3, min_lift: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(thread, ticker), each once -> (edges a, b, weight; freq ticker, freq) of the `top` most frequent tickers (all if None).

    Tickers that share at least `min_shared` threads are linked with their lift, shared * threads / (freq a * freq b), if
    that is at least `min_lift`. Pairs within a thread are bounded by the threads' size: give it threads that are."""
    freq = threads.groupBy("ticker").agg(F.count(F.lit(1)).alias("freq"))
    n = threads.agg(F.countDistinct("thread").alias("n"))
    kept = freq if top is None else freq.orderBy(F.desc("freq"), "ticker").limit(top)
    rows = threads.join(kept.select("ticker"), "ticker", "left_semi")
    a, b = rows.select("thread", F.col("ticker").alias("a")), rows.select("thread", F.col("ticker").alias("b"))
    pairs = a.join(b, "thread").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_shared)
    out = pairs.join(freq.select(F.col("ticker").alias("a"), F.col("freq").alias("fa")), "a").join(freq.select(F.col("ticker").alias("b"), F.col("freq").alias("fb")), "b").crossJoin(F.broadcast(n))
    lift = F.col("c") * F.col("n") / (F.col("fa") * F.col("fb")).cast("double")
    return out.where(lift >= min_lift).select("a", "b", lift.alias("weight")), freq


def clusters(threads: DataFrame, top: int | None = 60, min_shared: int = 3, seed: int = 42) -> DataFrame:
    """Groups of at least two tickers that are spoken of together: tickers (most frequent first), size, total_mentions, modularity of
    the whole partition; ordered by total_mentions, falling, then by the first ticker."""
    edges, freq = lift_edges(threads, top, min_shared)
    parts, q = communities(edges, seed)
    rows = parts.join(freq.withColumnRenamed("ticker", "node"), "node")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("f"), "node")))
    out = rows.groupBy("community").agg(ranked.alias("m"), F.count(F.lit(1)).alias("size"), F.sum("freq").alias("total_mentions")).where("size >= 2")
    out = out.select(F.array_join(F.transform("m", lambda x: x["node"]), ",").alias("tickers"), "size", "total_mentions", r(F.lit(q), 6).alias("modularity"))
    return out.orderBy(F.desc("total_mentions"), "tickers")
