"""Reply-network ranks and lead-lag between series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.functions.numeric import r
from pulsegrid.operators.steps import cut


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float | None = None) -> DataFrame:
    """(src, dst, weight) -> node, rank, repliers (distinct src). Rank flows in proportion to weight; the rank of nodes without
    out-edges is spread over all. Every fifth round is checkpointed. Edges are hashed by source once a round; nothing is collected
    but the number of nodes, the rank that dangles and a round's change.

    Without a tolerance, exactly `rounds` rounds. With one, until the ranks change by less than nodes * tolerance in sum, every
    round checkpointed; an error if `rounds` rounds don't suffice."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = cut(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    nodes = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().join(out.select(F.col("src").alias("node"), F.lit(False).alias("dangles")), "node", "left").withColumn("dangles", F.coalesce("dangles", F.lit(True))))
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    settled = tolerance is None or not n
    for i in range(rounds):
        if tolerance is not None and settled:
            break
        before = ranks
        sent = share.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangles"), F.col("rank"))), F.lit(0.0)).alias("loose"))
        new = nodes.join(sent.withColumnRenamed("dst", "node"), "node", "left").crossJoin(F.broadcast(loose))
        ranks = new.select("node", "dangles", ((1 - damping) / max(n, 1) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / max(n, 1))).alias("rank"))
        if i % 5 == 4 or tolerance is not None:
            ranks = cut(ranks)
        if tolerance is not None:
            change = ranks.join(before.select("node", F.col("rank").alias("was")), "node").agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
            settled = change < n * tolerance
    if not settled:
        raise RuntimeError(f"PageRank did not settle in {rounds} rounds")
    repliers = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("repliers"))
    return ranks.join(repliers, "node", "left").select("node", r(F.col("rank"), 5).alias("rank"), F.coalesce("repliers", F.lit(0)).cast("long").alias("repliers"))


def lead_lag(mentions: DataFrame, top: int = 20, lags: int = 5, least: float = 0.5, min_mentions: int | None = None) -> DataFrame:
    """Which tickers precede which others: the lag (in observed dates) of greatest correlation, the smallest of equal ones.

    The tickers are those with at least `min_mentions` mentions, however many; if that is None, the `top` most mentioned only.
    Days without a mention count 0; a constant series has correlation 0. The series are tickers x dates rows.
    """
    daily = mentions.groupBy("ticker", F.to_date("created_utc").alias("date")).agg(F.count(F.lit(1)).alias("x"))
    total = daily.groupBy("ticker").agg(F.sum("x").alias("n"))
    chosen = (total.orderBy(F.desc("n"), "ticker").limit(top) if min_mentions is None else total.where(F.col("n") >= min_mentions)).select("ticker")
    dates = daily.select("date").distinct().select("date", F.row_number().over(W.orderBy("date")).alias("ord"))
    grid = F.broadcast(chosen).crossJoin(dates).join(daily, ["ticker", "date"], "left").select("ticker", "ord", F.coalesce("x", F.lit(0)).cast("double").alias("x"))
    a = grid.select(F.col("ticker").alias("a"), F.col("x").alias("p"), "ord", F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag")).withColumn("to", F.col("ord") + F.col("lag"))
    b = grid.select(F.col("ticker").alias("b"), F.col("x").alias("q"), F.col("ord").alias("to"))
    s = a.join(b, "to").where("a <> b").groupBy("a", "b", "lag").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum(F.expr("p * p")).alias("pp"), F.sum(F.expr("q * q")).alias("qq"), F.sum(F.expr("p * q")).alias("pq"))
    corr = F.coalesce(F.expr("(n * pq - p * q) / sqrt(nullif((n * pp - p * p) * (n * qq - q * q), 0))"), F.lit(0.0))
    best = s.withColumn("corr", r(corr, 6)).groupBy("a", "b").agg(F.max(F.struct("corr", (-F.col("lag")).alias("minus"))).alias("m"))
    return best.select("a", "b", (-F.col("m.minus")).cast("long").alias("lag"), F.col("m.corr").alias("corr")).where(F.col("corr") >= least)


def linked(pairs: DataFrame) -> DataFrame:
    """(ticker, author, part) for links (ticker, a, b): part is the smallest author reachable. Labels fall to the smallest neighbour's and
    its label's label until nothing changes; each round is a checkpoint."""
    both = cut(pairs.unionByName(pairs.select("ticker", F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy("ticker", F.col("a").alias("author")).agg(F.least(F.min("b"), F.first("a")).alias("part")))
    while True:
        near = both.join(labels.select("ticker", F.col("author").alias("b"), F.col("part").alias("theirs")), ["ticker", "b"]).groupBy("ticker", F.col("a").alias("author")).agg(F.min("theirs").alias("theirs"))
        step = labels.join(near, ["ticker", "author"]).select("ticker", "author", "part", F.least("part", "theirs").alias("low"))
        jump = step.join(labels.select("ticker", F.col("author").alias("low"), F.col("part").alias("further")), ["ticker", "low"], "left")
        after = cut(jump.select("ticker", "author", "part", F.least("low", F.coalesce("further", "low")).alias("new")))
        if after.where("new <> part").isEmpty():
            return labels
        labels = after.select("ticker", "author", F.col("new").alias("part"))
