"""Sessions, as-of returns, event studies and series over (ticker, date, close)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.functions.numeric import r, ratio


def sessions(prices: DataFrame, ahead: list[int] = (), back: list[int] = ()) -> DataFrame:
    """prices with the session's number per ticker and the close some sessions later or earlier: one sort serves all."""
    w = W.partitionBy("ticker").orderBy("date")
    cols = {"ord": F.row_number().over(w)} | {f"next_{h}": F.lead("close", h).over(w) for h in ahead} | {f"prev_{h}": F.lag("close", h).over(w) for h in back}
    return prices.withColumns(cols)


def as_of(events: DataFrame, series: DataFrame, columns: list[str], strictly_after: bool) -> DataFrame:
    """Each event (ticker, date) with the columns of its first session after the date, or of its last session on or before it.

    Events and sessions are put in one sorted list per ticker, and the nearest session's row is carried along: one shuffle, and
    no pairs of events and sessions."""
    keep = F.struct(F.col("date").alias("session"), *columns)
    kept = [c for c in events.columns if c not in ("ticker", "date")]
    a = series.select("ticker", "date", keep.alias("s"), F.lit(0).alias("kind"), *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in kept])
    b = events.select("ticker", "date", F.lit(None).cast(a.schema["s"].dataType).alias("s"), F.lit(1).alias("kind"), *kept)
    # Going back in time, the sessions met before an event are later; those of its own day come after it.
    w = W.partitionBy("ticker").orderBy(F.col("date").desc(), F.col("kind").desc()) if strictly_after else W.partitionBy("ticker").orderBy("date", "kind")
    found = F.last("s", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return a.unionByName(b).withColumn("found", found).where("kind = 1").select("ticker", "date", *kept, "found.*")


def forward_return(events: DataFrame, prices: DataFrame, horizon: int) -> DataFrame:
    """close[i + h] / close[i] - 1 from the first session strictly after the event; null past the end or at a price of 0."""
    s = sessions(prices, ahead=[horizon]).select("ticker", "date", "close", F.col(f"next_{horizon}").alias("exit"))
    out = as_of(events, s, ["close", "exit"], strictly_after=True)
    return out.withColumn("ret", F.when(F.col("close") > 0, F.col("exit") / F.col("close") - 1)).drop("close", "exit")


def trailing_return(events: DataFrame, prices: DataFrame, sessions_back: int) -> DataFrame:
    s = sessions(prices, back=[sessions_back]).select("ticker", "date", "close", F.col(f"prev_{sessions_back}").alias("base"))
    out = as_of(events, s, ["close", "base"], strictly_after=False)
    return out.withColumn("ret", F.when(F.col("base") > 0, F.col("close") / F.col("base") - 1)).drop("close", "base")


def net(ret: Column, market: Column, side: int, horizon: int, half_spread_bps: float, borrow_bps: float) -> Column:
    """side * (return - market), less twice the half spread, and the borrow fee of a short."""
    cost = 2 * half_spread_bps / 1e4 + (borrow_bps * horizon / 1e4 if side < 0 else 0.0)
    return side * (ret - market) - F.lit(cost)


def study(trades: DataFrame, value: str, horizon: int, by: list[str]) -> DataFrame:
    """Count, mean, share of wins, t and yearly Sharpe; spread is of the whole population, 0 counts as 1e-9."""
    v = F.col(value)
    out = trades.where(v.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("m"), F.stddev_pop(v).alias("sd"), F.avg(F.when(v > 0, 1.0).otherwise(0.0)).alias("win")).where("n >= 2")
    sd = F.coalesce(F.nullif(F.round("sd", 12), F.lit(0.0)), F.lit(1e-9))
    return out.select(*by, "n", r(F.col("m"), 6).alias("mean"), r(F.col("win"), 4).alias("win"), r(F.col("m") / (sd / F.sqrt("n")), 4).alias("t"), r(F.col("m") / sd * (252 / horizon) ** 0.5, 4).alias("sharpe"))


def benchmark(prices: DataFrame) -> DataFrame:
    return prices.groupBy("date").agg(F.avg("close").alias("close")).select(F.lit("SPY").alias("ticker"), "date", "close")


def trend_state(prices: DataFrame, slow: int, fast: int) -> DataFrame:
    """+1 above both averages in order, -1 below both in reverse order, else 0; 0 while the history is shorter than `slow`."""
    w = W.partitionBy("ticker").orderBy("date")
    s, f = F.avg("close").over(w.rowsBetween(-(slow - 1), 0)), F.avg("close").over(w.rowsBetween(-(fast - 1), 0))
    t = prices.withColumns({"slow": r(s, 6), "fast": r(f, 6), "ord": F.row_number().over(w), "c": r(F.col("close"), 6)})
    up, down = (F.col("c") > F.col("slow")) & (F.col("fast") >= F.col("slow")), (F.col("c") < F.col("slow")) & (F.col("fast") <= F.col("slow"))
    return t.select("ticker", "date", F.when(F.col("ord") < slow, 0).when(up, 1).when(down, -1).otherwise(0).cast("int").alias("state"))


def drawdown(prices: DataFrame) -> DataFrame:
    """Total return and the deepest fall from a running peak, per ticker."""
    w = W.partitionBy("ticker").orderBy("date")
    d = prices.withColumn("peak", F.max("close").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("dd", (F.col("peak") - F.col("close")) / F.col("peak"))
    return d.groupBy("ticker").agg(F.count(F.lit(1)).alias("days"), r(F.max_by("close", "date") / F.min_by("close", "date") - 1, 6).alias("total"), r(F.max("dd"), 6).alias("max_dd"))


def squeeze(volume: DataFrame, min_days: int) -> DataFrame:
    """z of a ticker's latest short ratio against its own days before."""
    w = W.partitionBy("ticker").orderBy(F.desc("date"))
    v = volume.withColumn("n", F.row_number().over(w))
    rest = F.when(F.col("n") > 1, F.col("short_ratio"))
    out = v.groupBy("ticker").agg(F.max(F.when(F.col("n") == 1, F.col("short_ratio"))).alias("latest"), F.avg(rest).alias("m"), F.stddev_pop(rest).alias("sd"), F.count(F.lit(1)).alias("days")).where(F.col("days") >= min_days)
    return out.select("ticker", "days", r(F.col("latest"), 4).alias("latest"), r(ratio(F.col("latest") - F.col("m"), F.round("sd", 9)), 3).alias("z"))


def squeeze_ranked(volume: DataFrame, min_days: int, min_z: float, min_volume: float, fresh_days: int, limit: int) -> DataFrame:
    """Tickers whose latest short ratio is at least `min_z` above their own past, with enough volume that day, not older than `fresh_days`
    before the last day of all; a spread of 0 counts as 1e-9. Greatest z first."""
    w = W.partitionBy("ticker").orderBy(F.desc("date"))
    v = volume.withColumn("n", F.row_number().over(w))
    first, rest = F.col("n") == 1, F.when(F.col("n") > 1, F.col("short_ratio"))
    g = v.groupBy("ticker").agg(F.count(F.lit(1)).alias("days"), F.max("date").alias("last"), F.max(F.when(first, F.col("short_ratio"))).alias("latest"), F.max(F.when(first, F.col("volume"))).alias("vol"), F.avg(rest).alias("m"), F.stddev_pop(rest).alias("sd")).where(F.col("days") >= min_days)
    sd = F.when(F.round("sd", 9) == 0, F.lit(1e-9)).otherwise(F.round("sd", 9))
    g = g.withColumn("x", (F.col("latest") - F.col("m")) / sd).crossJoin(F.broadcast(volume.agg(F.max("date").alias("end"))))
    g = g.where((F.col("x") >= min_z) & (F.col("vol") >= min_volume) & (F.col("last") >= F.date_sub("end", fresh_days)))
    return g.select("ticker", "days", r(F.col("latest"), 4).alias("latest"), r(F.col("x"), 3).alias("z")).orderBy(F.desc("z"), "ticker").limit(limit)


def random_null(events: DataFrame, prices: DataFrame, horizon: int, draws: int) -> DataFrame:
    """Where the events' mean return lies among means of as many random sessions of the same tickers; the draws come from an
    integer formula of event id and draw, so they repeat anywhere. The formula takes ids modulo the ticker's sessions, so equal
    remainders are counted first. Work: sessions times draws at most, whatever the number of events."""
    s = sessions(prices, ahead=[horizon]).select("ticker", "ord", (F.col(f"next_{horizon}") / F.col("close") - 1).alias("ret")).where("ret is not null")
    n = s.groupBy("ticker").agg(F.max("ord").alias("n"))
    actual = forward_return(events, prices, horizon).agg(F.avg("ret").alias("actual"))
    alike = events.join(n, "ticker").groupBy("ticker", "n", F.pmod(F.col("id"), F.col("n")).alias("id")).agg(F.count(F.lit(1)).alias("c"))
    picks = alike.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select("ticker", "i", "c", (1 + (F.col("id") * 7919 + F.col("i") * 104729 + 12345) % F.col("n")).alias("ord"))
    means = picks.join(s, ["ticker", "ord"]).groupBy("i").agg((F.sum(F.col("c") * F.col("ret")) / F.sum("c")).alias("m"))
    return means.crossJoin(F.broadcast(actual)).agg(F.count(F.lit(1)).alias("draws"), r(F.avg(F.when(F.col("m") < F.col("actual"), 1.0).otherwise(0.0)), 4).alias("percentile"), r(F.first("actual"), 6).alias("actual"))
