"""Point-in-time features: calendar-range windows over observed days that end the day before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.functions.numeric import count_if, r, ratio, share


def _trailing(days: int):
    return W.partitionBy("ticker").orderBy("day").rangeBetween(-days, -1)


def feature_daily(m: DataFrame, authors: DataFrame, min_total: int = 20) -> DataFrame:
    """One row per ticker and active day of tickers with at least `min_total` mentions in all. Mentions are summed by author first, so
    breadth, concentration and HHI come from one pass, the authors' table meets these sums only, and the totals come from the windows."""
    by_author = m.groupBy("ticker", F.to_date("created_utc").alias("date"), "author").agg(F.count(F.lit(1)).alias("c"), F.sum("sentiment_score").alias("s"))
    known = authors.select("username", (F.col("account_age_days") <= 365).alias("young"), F.col("account_status").isin("deleted", "suspended").alias("gone"))
    by_author = by_author.join(known, F.col("author") == F.col("username"), "left")
    daily = by_author.groupBy("ticker", "date").agg(
        F.sum("c").cast("long").alias("mentions"), F.count(F.lit(1)).alias("breadth"), F.max("c").alias("top"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.sum("s").alias("s"),
        F.sum(F.when(F.col("young"), F.col("c")).otherwise(0)).alias("young"), F.sum(F.when(F.col("gone"), F.col("c")).otherwise(0)).alias("gone"),
    )
    n = F.col("mentions").cast("double")
    daily = daily.withColumns({"day": F.date_diff("date", F.lit("1970-01-01").cast("date")), "sentiment": F.col("s") / n})
    w7, w14, all_days = _trailing(7), _trailing(14), W.partitionBy("ticker").orderBy("day")
    f = daily.withColumns(
        {
            "vel": ratio(n, F.avg("mentions").over(w7)),
            "z": ratio(n - F.avg("mentions").over(w14), r(F.stddev_pop("mentions").over(w14), 6)),
            "delta": F.col("sentiment") - F.avg("sentiment").over(w7),
            "first": F.min("date").over(W.partitionBy("ticker")),
            "total": F.sum("mentions").over(W.partitionBy("ticker")),
        }
    )
    f = f.withColumn("accel", F.col("vel") - F.lag("vel").over(all_days)).where(F.col("total") >= min_total)
    return f.select(
        "ticker", "date", "mentions", "breadth",
        r(n / F.col("breadth"), 4).alias("per_author"), r(F.col("top") / n, 4).alias("concentration"), r(F.col("squares") / (n * n), 4).alias("hhi"),
        r(F.col("sentiment"), 4).alias("sentiment"), r(F.col("vel"), 4).alias("vel"), r(F.col("accel"), 4).alias("accel"),
        r(F.col("z"), 4).alias("mentions_z"), r(F.col("delta"), 4).alias("sent_delta"), r(F.col("young") / n, 4).alias("young_frac"), r(F.col("gone") / n, 4).alias("gone_frac"),
        F.date_diff("date", "first").cast("long").alias("novelty_days"),
    )


def aggregate_daily(m: DataFrame, authors: DataFrame) -> DataFrame:
    """The market's day, from posts only."""
    rows = m.where("source_type = 'post'").join(authors, F.col("author") == F.col("username"), "left")
    s = F.col("sentiment_score")
    day = rows.groupBy(F.to_date("created_utc").alias("date")).agg(
        F.count(F.lit(1)).alias("total_mentions"), F.countDistinct("ticker").alias("tickers"), F.countDistinct("author").alias("authors"), r(F.avg(s), 4).alias("mkt_sent"),
        r(share(s > 0.3), 4).alias("bull_frac"), r(share(s < 0), 4).alias("bear_frac"), r(share(F.col("account_age_days") <= 365), 4).alias("young_frac"), r(share(F.col("account_status").isin("deleted", "suspended")), 4).alias("gone_frac"),
    )
    return day.withColumn("rrai_raw", r(F.coalesce("bull_frac", F.lit(0.0)) - F.coalesce("bear_frac", F.lit(0.0)), 4))


def trailing_percentile(daily: DataFrame, window: int, min_history: int, min_mentions: int) -> DataFrame:
    """Share of the last `window` valid days, the day included, with a value not above the day's; null on thin days and short history.

    One row a day: the single ordered window holds as many rows as there are days."""
    valid = daily.where(F.col("rrai_raw").isNotNull() & (F.col("total_mentions") >= min_mentions))
    seen = F.collect_list("rrai_raw").over(W.orderBy("date").rowsBetween(-(window - 1), 0))
    ranked = valid.withColumn("seen", seen).select("date", F.when(F.size("seen") >= min_history, F.size(F.filter("seen", lambda x: x <= F.col("rrai_raw"))) / F.size("seen")).alias("p"))
    return daily.join(ranked, "date", "left").select("date", "rrai_raw", r(F.col("p"), 4).alias("rrai_pct"))


def recruitment(m: DataFrame) -> DataFrame:
    """Authors a day and how many of them are new to the ticker, with trailing means and z over the 14 days before."""
    days = m.where(F.col("author").isNotNull()).select("ticker", "author", F.to_date("created_utc").alias("date")).distinct()
    first = days.withColumn("first", F.min("date").over(W.partitionBy("ticker", "author")))
    daily = first.groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("auth"), count_if(F.col("date") == F.col("first")).alias("new_auth"))
    daily = daily.withColumns({"day": F.date_diff("date", F.lit("1970-01-01").cast("date")), "new_frac": F.col("new_auth") / F.col("auth")})
    w = _trailing(14)
    return daily.select("ticker", "date", "auth", "new_auth", r(F.col("new_frac"), 4).alias("new_frac"), r(F.avg("new_frac").over(w), 4).alias("new_frac_trail"), r(F.avg("new_auth").over(w), 4).alias("new_auth_trail"), r(ratio(F.col("new_auth") - F.avg("new_auth").over(w), r(F.stddev_pop("new_auth").over(w), 6)), 4).alias("new_z"))
