"""Lookups, work lists, predicates and small reports over posts, comments, mentions, authors and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.functions.numeric import r


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """One row, or an empty table if there is none."""
    return rows.where(F.col(key) == F.lit(value))


def jobs(log: DataFrame, target: str | None = None, status: str | None = None) -> DataFrame:
    """Jobs of a target and status, the latest first."""
    for name, value in (("target", target), ("status", status)):
        if value is not None:
            log = log.where(F.col(name) == value)
    return log.orderBy(F.col("started").desc_nulls_last(), "id")


def matches(rows: DataFrame, pattern: str, columns: list[str]) -> DataFrame:
    """Rows of which any of the columns holds the regular expression, in any case of ASCII letters; null holds nothing."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).rlike("(?i)" + pattern), F.lit(False))
    return rows.where(hit)


def equal_in_any_case(column: Column, value: str) -> Column:
    return F.lower(column) == value.lower()


def board_search(posts: DataFrame, text: str, min_score: int = 0, kind: str | None = None, author: str | None = None, order: str = "score", limit: int = 50) -> DataFrame:
    """The board's search: literal text in title or body, optional lower bound of the score if it is above 0, type and author; the `limit` first."""
    low = F.concat_ws(" ", F.lower("title"), F.lower("selftext"))
    out = posts.where(F.contains(low, F.lit(text.lower())))
    if min_score > 0:
        out = out.where(F.col("score") >= min_score)
    if kind:
        out = out.where(F.col("post_type") == kind)
    if author:
        out = out.where(F.contains(F.lower("author"), F.lit(author.lower())))
    return out.orderBy(F.col(order).desc_nulls_last(), "id").limit(limit)


def without_emotes(text: Column) -> Column:
    """Image links to emotes become [emote: name]."""
    return F.regexp_replace(text, r"!\[[^\]]*\]\(emote\|([^)]+)\)", "[emote: $1]")


def fetch_policy(created: Column, as_of: str, new_hours: int = 48) -> Column:
    """How a post's replies are read: all of them, ten deep, while it is new; else the best, three deep, from a score of 5. No date counts as old."""
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp_ntz")) - F.unix_timestamp(created)) / 3600
    new = F.coalesce(age <= new_hours, F.lit(False))
    return F.struct(F.when(~new, F.lit("top")).alias("sort"), F.when(new, 10).otherwise(3).alias("max_depth"), F.when(new, 0).otherwise(5).alias("min_score"))


def grown(posts: DataFrame, stored: DataFrame) -> DataFrame:
    """Posts whose comments must be read again: the count is above what was stored, or there are comments but no stored row."""
    out = posts.join(stored.select(F.col("post_id").alias("id"), "stored_count", "stored_rows"), "id", "left")
    rows, count = F.coalesce("stored_rows", F.lit(0)), F.coalesce("stored_count", F.lit(0))
    return out.where((F.col("num_comments") > count) | ((F.col("num_comments") > 0) & (rows == 0)))


def sector_class(sector: Column, avoid: list[str], preferred: list[str], weak: list[str]) -> Column:
    return F.when(sector.isNull(), "?").when(sector.isin(avoid), "AVOID").when(sector.isin(preferred), "PREFERRED").when(sector.isin(weak), "WEAK").otherwise("OK")


def micro_to_mid(cap: Column, most: float = 10e9) -> Column:
    """An unknown capitalisation counts as small."""
    return cap.isNull() | (cap < most)


def price_tier(price: Column) -> Column:
    return F.when(price.isNull(), "?").when(price < 2, "SKIP").when(price < 5, "THIN").when(price <= 50, "TRADE").otherwise("VERIFY")


def not_in(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose key isn't among the known; a null among these hides nothing."""
    return rows.join(known.select(F.col(known_key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")


def refresh_list(posts: DataFrame, comments: DataFrame, since: str, limit: int) -> DataFrame:
    """Posts from a date on with their number of stored comments (0 if none), the newest first."""
    stored = comments.groupBy(F.col("post_id").alias("id")).agg(F.count(F.lit(1)).alias("stored"))
    recent = posts.where(F.col("created_utc") >= F.lit(since).cast("timestamp_ntz"))
    out = recent.join(stored, "id", "left").select("id", "num_comments", F.coalesce("stored", F.lit(0)).cast("long").alias("stored"), "created_utc")
    return out.orderBy(F.desc("created_utc"), "id").limit(limit)


def sources(posts: DataFrame) -> DataFrame:
    return posts.groupBy("subreddit").agg(F.count(F.lit(1)).alias("posts"), F.min("created_utc").alias("first"), F.max("created_utc").alias("last"))


def daily_counts(posts: DataFrame, targets: list[str]) -> DataFrame:
    return posts.where(F.col("subreddit").isin(targets)).groupBy(F.col("subreddit").alias("target"), F.to_date("created_utc").alias("date")).agg(F.count(F.lit(1)).alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each table with its row count."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def stale_authors(authors: DataFrame, mentions: DataFrame, as_of: str, days: int, limit: int) -> DataFrame:
    """Authors not known as gone whose check is missing or older than `days`, those mentioned last first; never mentioned ones come last."""
    last = mentions.groupBy(F.col("author").alias("username")).agg(F.max("created_utc").alias("last_mention"))
    cut = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    due = authors.where(~F.coalesce(F.col("account_status").isin("deleted", "suspended"), F.lit(False)) & (F.col("checked_at").isNull() | (F.col("checked_at") < cut)))
    return due.join(last, "username", "left").select("username", "last_mention").orderBy(F.col("last_mention").desc_nulls_last(), "username").limit(limit)


def author_ages(authors: DataFrame, names: DataFrame) -> DataFrame:
    """Ages of the authors named; unknown authors are not in the result."""
    return authors.join(names.select(F.col("author").alias("username")).distinct(), "username", "left_semi").select("username", "account_age_days")


def profile_queue(mentions: DataFrame, posts: DataFrame, profiled: DataFrame, bots: list[str], off_topic: list[str], limit: int) -> DataFrame:
    """Authors without a profile: those of mentions outside off-topic communities first, by count, then other posters by theirs."""
    first = mentions.where(~F.col("subreddit").isin(off_topic)).groupBy("author").agg(F.count(F.lit(1)).alias("act")).withColumn("pri", F.lit(0))
    other = posts.groupBy("author").agg(F.count(F.lit(1)).alias("act")).withColumn("pri", F.lit(1))
    ranked = first.unionByName(other).where(F.col("author").isNotNull() & ~F.col("author").isin(bots))
    ranked = ranked.groupBy("author").agg(F.min("pri").alias("pri"), F.max("act").alias("act"))
    return not_in(ranked, "author", profiled, "username").orderBy("pri", F.desc("act"), "author").limit(limit)


def board_totals(posts: DataFrame) -> DataFrame:
    """The board's tiles: counts, sums, means and distinct authors."""
    return posts.agg(F.count(F.lit(1)).alias("posts"), F.sum("score").cast("long").alias("score"), r(F.avg("score"), 4).alias("avg_score"), F.sum("num_comments").cast("long").alias("comments"), F.countDistinct("author").alias("authors"), F.countDistinct(F.to_date("created_utc")).alias("days"))


def busy_days_authors(mentions: DataFrame, least: int, profiled: DataFrame) -> DataFrame:
    """Distinct authors without a profile of the ticker-days with at least `least` mentions."""
    days = mentions.groupBy("ticker", F.to_date("created_utc").alias("date")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rows = mentions.withColumn("date", F.to_date("created_utc")).join(days.select("ticker", "date"), ["ticker", "date"], "left_semi")
    return not_in(rows.where("author is not null").select("author").distinct(), "author", profiled, "username")


def cloud_sizes(counts: DataFrame) -> DataFrame:
    """Words with sizes from 10 to 100 by their share of the greatest count."""
    top = counts.agg(F.max("n").alias("__top"))
    return counts.crossJoin(F.broadcast(top)).select("word", "n", F.floor(10 + F.col("n") / F.col("__top") * 90).cast("int").alias("size"))


def threads(mentions: DataFrame, comments: DataFrame) -> DataFrame:
    """Mentions with their thread: the post itself, or the post of the comment; a mention of an unknown comment has none and is dropped."""
    c = comments.select(F.col("comment_id").alias("__c"), F.col("post_id").cast("string").alias("__post"))
    out = mentions.join(c, (F.col("source_type") == "comment") & (F.col("source_id") == F.col("__c")), "left")
    out = out.withColumn("thread", F.when(F.col("source_type") == "post", F.col("source_id")).otherwise(F.col("__post")))
    return out.where("thread is not null").drop("__c", "__post")


def clean_threads(rows: DataFrame, most: int = 15) -> DataFrame:
    """(thread, ticker) of threads with at most `most` distinct tickers."""
    pairs = rows.select("thread", "ticker").distinct()
    size = pairs.groupBy("thread").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= most)
    return pairs.join(size.select("thread"), "thread", "left_semi")


def job_records(events: DataFrame) -> DataFrame:
    """The state of each job from its log of starts and ends: running until it ends, then its status and duration in seconds."""
    out = events.groupBy("job").agg(F.min(F.when(F.col("kind") == "start", F.col("at"))).alias("started"), F.max(F.when(F.col("kind") != "start", F.struct("at", "kind"))).alias("end"))
    seconds = F.unix_timestamp("end.at") - F.unix_timestamp("started")
    return out.select("job", "started", F.coalesce("end.kind", F.lit("running")).alias("status"), seconds.cast("long").alias("seconds"))


def latest(rows: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """Each key's row with the greatest order; a tie goes to the smaller `tie`."""
    w = W.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), tie)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def hot_and_old(rows: DataFrame, order: str, thirds: str = "third") -> DataFrame:
    """Adds which third of the rows in this order a row is in (1 to 3; the last takes the remainder). Rows are counted per value
    of the order first, so that no task sorts them all."""
    per = rows.groupBy(order).agg(F.count(F.lit(1)).alias("__c"))
    before = per.select(order, (F.sum("__c").over(W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)) - F.col("__c")).alias("__before"))
    total = rows.agg(F.count(F.lit(1)).alias("__total"))
    w = W.partitionBy(order).orderBy(*[c for c in rows.columns if c != order])
    out = rows.withColumn("__i", F.row_number().over(w)).join(before, order).crossJoin(F.broadcast(total))
    k = F.floor(F.col("__total") / 3)
    at = F.col("__before") + F.col("__i") - 1
    return out.withColumn(thirds, F.when(at < k, 1).when(at < 2 * k, 2).otherwise(3)).drop("__i", "__before", "__total")
