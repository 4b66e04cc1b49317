"""Simulated trades on daily bars, screens over features, and the lines of the signal feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.functions.numeric import r


def short_grid(events: DataFrame, bars: DataFrame, stops: list[float], holds: list[int], cost: float = 0.0) -> DataFrame:
    """Mean result of short trades for each (stop, hold): entry at the open of the first session after the event, exit at the stop's
    price in the first session whose high reaches it, else at the close of the hold's last session. Trades whose hold passes the
    last bar are left out. An event meets at most max(holds) bars; the configurations are explodes of those rows."""
    ses = bars.withColumn("ord", F.row_number().over(W.partitionBy("ticker").orderBy("date")))
    last = ses.groupBy("ticker").agg(F.max("ord").alias("last"))
    # The next session of a ticker and date, found once per distinct pair by a running minimum.
    marks = ses.select("ticker", "date", "ord").unionByName(events.select("ticker", "date").distinct().withColumn("ord", F.lit(None).cast("int")))
    after = F.min("ord").over(W.partitionBy("ticker").orderBy(F.unix_date("date")).rangeBetween(1, W.unboundedFollowing))
    entry = marks.withColumn("entry", after).where("ord is null").select("ticker", "date", "entry").where("entry is not null")
    hold = F.explode(F.array(*map(F.lit, holds))).alias("hold")
    trades = events.join(entry, ["ticker", "date"]).join(last, "ticker").select("id", "ticker", "entry", "last", hold).where(F.col("entry") + F.col("hold") - 1 <= F.col("last"))
    steps = trades.select("id", "ticker", "entry", "hold", F.explode(F.sequence("entry", F.col("entry") + F.col("hold") - 1)).alias("ord"))
    path = steps.join(ses.select("ticker", "ord", "open", "high", "close"), ["ticker", "ord"]).groupBy("id", "ticker", "hold").agg(F.min_by("open", "ord").alias("price"), F.max("high").alias("high"), F.max_by("close", "ord").alias("out"))
    stop = F.explode(F.array(*map(F.lit, stops))).alias("stop")
    res = path.select("hold", "price", "high", "out", stop).withColumn("ret", F.when(F.col("high") >= F.col("price") * (1 + F.col("stop")), -F.col("stop")).otherwise((F.col("price") - F.col("out")) / F.col("price")) - cost)
    return res.groupBy("stop", "hold").agg(F.count(F.lit(1)).alias("n"), r(F.avg("ret"), 6).alias("mean"), r(F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)), 4).alias("win"))


def conviction(features: DataFrame, per_author: float = 2, mentions: int = 5) -> DataFrame:
    """Rows of features over the floor with a tier: 1 is per author >= 3 and at least 10 mentions, 2 at least 10 mentions, 3 the rest."""
    t = F.when((F.col("per_author") >= 3) & (F.col("mentions") >= 10), 1).when(F.col("mentions") >= 10, 2).otherwise(3)
    return features.where((F.col("per_author") >= per_author) & (F.col("mentions") >= mentions)).select("ticker", "date", "mentions", "per_author", t.cast("int").alias("tier"))


def distribution_short(features: DataFrame, trailing: DataFrame, blocked: list[str], sentiment: float = 0.4, per_author: float = 2, mentions: int = 10) -> DataFrame:
    """Concentrated, euphoric ticker-days whose trailing return is below 0; trailing: (ticker, date, ret)."""
    f = features.where((F.col("per_author") >= per_author) & (F.col("mentions") >= mentions) & (F.col("sentiment") >= sentiment) & ~F.col("ticker").isin(blocked))
    return f.join(trailing.where("ret < 0"), ["ticker", "date"]).select("ticker", "date", "mentions", "sentiment", r(F.col("ret"), 6).alias("ret"))


def froth(features: DataFrame, per_author: float = 2, mentions: int = 5) -> DataFrame:
    hit = (F.col("per_author") >= per_author) & (F.col("mentions") >= mentions)
    return features.groupBy("date").agg(F.sum(F.when(hit, 1).otherwise(0)).cast("long").alias("froth"))


def universe(mentions: DataFrame, communities: list[str], share: float, least: int) -> DataFrame:
    """Tickers with at least `least` mentions, of which at least `share` come from the communities."""
    inside = F.avg(F.when(F.col("subreddit").isin(communities), 1.0).otherwise(0.0))
    out = mentions.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), inside.alias("raw")).where((F.col("raw") >= share) & (F.col("n") >= least))
    return out.select("ticker", "n", r(F.col("raw"), 4).alias("share"))


def signal_lines(signals: DataFrame, columns: list[str], empty: str = "# flat") -> DataFrame:
    """One comma-separated line a signal; the one line `empty` if there is none. Null fields are empty."""
    lines = signals.select(F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), ",").alias("line"))
    none = lines.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(empty).alias("line"))
    return lines.unionByName(none)
