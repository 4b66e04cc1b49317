"""Rollups, trends and bursts over the mention table (ticker, subreddit, author, created_utc, sentiment_score, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.functions.numeric import count_if, r, ratio, share

GONE = ("deleted", "suspended")
BOTS = ("[deleted]", "AutoModerator")


def _as_of(as_of: str):
    return F.lit(as_of).cast("timestamp_ntz")


def since(m: DataFrame, as_of: str, hours: int, skip: int = 0) -> DataFrame:
    """Rows of the `hours` before as_of, or before `skip` hours before it."""
    end = _as_of(as_of) - F.expr(f"INTERVAL {skip} HOURS")
    return m.where((F.col("created_utc") >= end - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("created_utc") < end))


def daily_rollup(m: DataFrame) -> DataFrame:
    return m.groupBy("subreddit", "ticker", F.to_date("created_utc").alias("date")).agg(F.count(F.lit(1)).alias("mentions"), r(F.avg("sentiment_score"), 4).alias("avg_sentiment"))


def trending(m: DataFrame, as_of: str, hours: int, limit: int) -> DataFrame:
    """The most mentioned tickers of the window, then by change against the window before it; a ticker absent there had 0."""
    now = since(m, as_of, hours).groupBy("ticker").agg(F.count(F.lit(1)).alias("mentions"), r(F.avg("sentiment_score"), 4).alias("avg_sentiment"), F.countDistinct("author").alias("authors"))
    now = now.orderBy(F.desc("mentions"), "ticker").limit(limit)
    before = since(m, as_of, hours, hours).groupBy("ticker").agg(F.count(F.lit(1)).alias("prev"))
    out = now.join(before, "ticker", "left").withColumn("prev", F.coalesce("prev", F.lit(0)).cast("long"))
    return out.withColumn("velocity_change", F.col("mentions") - F.col("prev"))


def entity_sentiment(m: DataFrame, by: list[str]) -> DataFrame:
    return m.groupBy(*by).agg(
        F.count(F.lit(1)).alias("mentions"),
        r(F.avg("sentiment_score"), 4).alias("avg_sentiment"),
        count_if(F.col("sentiment_score") > 0.05).alias("positive"),
        count_if(F.col("sentiment_score") < -0.05).alias("negative"),
        F.countDistinct("author").alias("authors"),
    )


def timeseries(m: DataFrame, ticker: str) -> DataFrame:
    """A leading $ and the case of the ticker don't matter."""
    return m.where(F.col("ticker") == ticker.upper().lstrip("$")).groupBy(F.to_date("created_utc").alias("date")).agg(F.count(F.lit(1)).alias("mentions"), r(F.avg("sentiment_score"), 4).alias("avg_sentiment"))


def pump_suspects(m: DataFrame, authors: DataFrame, as_of: str, hours: int, min_mentions: int) -> DataFrame:
    """Unknown authors count as neither gone nor young; bots and null authors are left out."""
    rows = since(m, as_of, hours).where(~F.col("author").isin(*BOTS)).join(authors, F.col("author") == F.col("username"), "left")
    out = rows.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("mentions"),
        F.countDistinct("author").alias("authors"),
        r(F.count(F.lit(1)) / F.countDistinct("author"), 2).alias("per_author"),
        r(share(F.col("account_status").isin(*GONE)), 3).alias("gone_frac"),
        r(share(F.col("account_status") == "suspended"), 3).alias("suspended_frac"),
        r(share(F.col("account_age_days") <= 365), 3).alias("young_frac"),
        r(F.avg("sentiment_score"), 4).alias("avg_sentiment"),
    )
    out = out.where(F.col("mentions") >= min_mentions)
    return out.withColumn("suspicion", r(F.col("per_author") * (0.5 + F.col("gone_frac") + 0.5 * F.col("young_frac")), 6))


def fresh_burst(m: DataFrame, as_of: str, hours: int, baseline_days: int, min_mentions: int, multiple: float) -> DataFrame:
    """Tickers whose daily rate in the window is `multiple` times the baseline's, or that have no baseline (fresh)."""
    days = hours / 24
    recent = since(m, as_of, hours).groupBy("ticker").agg(F.count(F.lit(1)).alias("rc"), F.countDistinct("author").alias("authors")).where(F.col("rc") >= min_mentions)
    base = since(m, as_of, int(baseline_days * 24 - hours), hours).groupBy("ticker").agg(F.count(F.lit(1)).alias("bc"))
    out = recent.join(base, "ticker", "left").withColumn("bc", F.coalesce("bc", F.lit(0)).cast("long"))
    burst = (F.col("rc") / F.lit(days)) / F.nullif(F.col("bc") / F.lit(max(baseline_days - days, 1.0)), F.lit(0.0))
    out = out.withColumns({"fresh": F.col("bc") == 0, "burst": r(burst, 3), "per_author": r(ratio(F.col("rc"), F.col("authors")), 2)})
    return out.where(F.col("fresh") | (burst >= multiple))


def momentum(m: DataFrame) -> DataFrame:
    """z of the last day's count against all active days, that one included; tickers silent on the last day of all get null."""
    daily = m.groupBy("ticker", F.to_date("created_utc").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    last = daily.agg(F.max("d").alias("last"))
    out = daily.crossJoin(F.broadcast(last)).groupBy("ticker").agg(F.sum("n").cast("long").alias("total"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), F.max(F.when(F.col("d") == F.col("last"), F.col("n"))).alias("latest"))
    return out.select("ticker", "total", r(F.col("mean"), 3).alias("mean"), r(F.col("sd"), 3).alias("sd"), "latest", r(ratio(F.col("latest") - F.col("mean"), F.col("sd")), 3).alias("z"))


def momentum_ranked(m: DataFrame, min_total: int, limit: int) -> DataFrame:
    """momentum of tickers with at least `min_total` mentions that were mentioned on the last day of all, with their mean sentiment; greatest z first."""
    sent = m.groupBy("ticker").agg(r(F.avg("sentiment_score"), 4).alias("avg_sentiment"))
    out = momentum(m).where((F.col("total") >= min_total) & F.col("latest").isNotNull()).join(sent, "ticker")
    return out.select("ticker", "total", "mean", "latest", "z", "avg_sentiment").orderBy(F.col("z").desc_nulls_last(), F.desc("total"), "ticker").limit(limit)


def fresh_pumps(m: DataFrame, authors: DataFrame, as_of: str, hours: int, baseline_days: int, min_mentions: int, min_per_author: float, multiple: float, limit: int) -> DataFrame:
    """fresh_burst without bots, for tickers with at least `min_per_author` mentions an author, with the shares of gone and young authors; fresh ones
    first, then by mentions per author times mentions."""
    own = m.where(~F.col("author").isin(*BOTS))
    rows = since(own, as_of, hours).join(authors, F.col("author") == F.col("username"), "left")
    more = rows.groupBy("ticker").agg(r(share(F.col("account_status").isin(*GONE)), 3).alias("gone_frac"), r(share(F.col("account_age_days") <= 365), 3).alias("young_frac"), r(F.avg("sentiment_score"), 4).alias("avg_sentiment"))
    out = fresh_burst(own, as_of, hours, baseline_days, min_mentions, multiple).where(F.col("rc") >= min_per_author * F.col("authors")).join(more, "ticker")
    return out.orderBy(F.desc("fresh"), F.desc(F.col("per_author") * F.col("rc")), "ticker").limit(limit)


def coordination_scan(m: DataFrame, per_author: float, few: int, few_share: float) -> DataFrame:
    out = m.groupBy("ticker", "subreddit").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("author").alias("a"))
    return out.where((F.col("n") >= per_author * F.col("a")) & (F.col("a") <= F.greatest(F.lit(float(few)), few_share * F.col("n"))))


def propagation(m: DataFrame) -> DataFrame:
    """Per ticker and community: first mention, count, whole days after the ticker's first community."""
    first = m.groupBy("ticker", "subreddit").agg(F.min("created_utc").alias("first_seen"), F.count(F.lit(1)).alias("mentions"))
    origin = F.min("first_seen").over(W.partitionBy("ticker"))
    return first.select("ticker", "subreddit", "mentions", F.date_diff(F.to_date("first_seen"), F.to_date(origin)).cast("long").alias("days_after"))


def tracked(m: DataFrame, least: int) -> DataFrame:
    return m.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def prescience(m: DataFrame, least: int = 5) -> DataFrame:
    """How early each author is in a ticker's crowd: 1 - (mentions before theirs) / mentions; ties count as after."""
    w = W.partitionBy("ticker")
    ranked = m.select("ticker", "author", (F.rank().over(w.orderBy("created_utc")) - 1).alias("before"), F.count(F.lit(1)).over(w).alias("n")).where(F.col("n") >= least)
    first = ranked.groupBy("ticker", "author").agg((1 - F.min("before") / F.first("n")).alias("early"))
    return first.groupBy("author").agg(r(F.avg("early"), 4).alias("earliness"), F.count(F.lit(1)).alias("tickers"))


def cooccurrence(m: DataFrame, cap: int, support: int, lift: float) -> DataFrame:
    """(thread, ticker) rows -> pairs of tickers that share a thread, with lift, those that share most first, then by lift. Threads of more
    than `cap` tickers are left out before pairing, so no thread gives more than cap * (cap - 1) / 2 pairs."""
    threads = m.select("thread", "ticker").distinct()
    size = threads.groupBy("thread").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= cap)
    clean = threads.join(size.select("thread"), "thread", "left_semi")
    freq = clean.groupBy("ticker").agg(F.count(F.lit(1)).alias("f"))
    n = clean.agg(F.countDistinct("thread").alias("n"))
    a, b = clean.select("thread", F.col("ticker").alias("a")), clean.select("thread", F.col("ticker").alias("b"))
    pairs = a.join(b, "thread").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= support)
    out = pairs.join(freq.select(F.col("ticker").alias("a"), F.col("f").alias("fa")), "a").join(freq.select(F.col("ticker").alias("b"), F.col("f").alias("fb")), "b").crossJoin(F.broadcast(n))
    raw = F.col("c") * F.col("n") / (F.col("fa") * F.col("fb")).cast("double")
    return out.where(raw >= lift).select("a", "b", "c", r(raw, 3).alias("lift")).orderBy(F.desc("c"), F.desc("lift"), "a", "b")
