"""Search, rollups, text enrichment and keyed merges over posts and comments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.functions import text as T
from pulsegrid.functions.numeric import r, share


def search(posts: DataFrame, query: str | None = None, subreddit: str | None = None, author: str | None = None, min_score: int | None = None, post_type: str | None = None, limit: int = 100) -> DataFrame:
    """AND of the predicates that are given, newest first; 0 is a threshold like any other."""
    out = posts
    if query is not None:
        out = out.where(T.contains(F.col("title"), query) | T.contains(F.col("selftext"), query))
    for column, value in (("subreddit", subreddit), ("author", author), ("post_type", post_type)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if min_score is not None:
        out = out.where(F.col("score") >= min_score)
    return out.orderBy(F.desc("created_utc"), "id").limit(limit)


def search_comments(comments: DataFrame, query: str, min_score: int = 0, limit: int = 100) -> DataFrame:
    return comments.where(T.contains(F.col("body"), query) & (F.col("score") >= min_score)).orderBy(F.desc("score"), "comment_id").limit(limit)


def group_stats(posts: DataFrame) -> DataFrame:
    return posts.groupBy("subreddit").agg(F.count(F.lit(1)).alias("posts"), r(F.avg("score"), 4).alias("avg_score"), F.max("score").alias("max_score"), F.sum("num_comments").cast("long").alias("comments"))


def type_distribution(posts: DataFrame) -> DataFrame:
    return posts.groupBy("subreddit", "post_type").agg(F.count(F.lit(1)).alias("n"))


def top_authors(posts: DataFrame, limit: int = 10) -> DataFrame:
    return posts.where("author <> '[deleted]'").groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.sum("score").cast("long").alias("score")).orderBy(F.desc("n"), F.desc("score"), "author").limit(limit)


def hourly_activity(posts: DataFrame) -> DataFrame:
    return posts.groupBy(F.date_format("created_utc", "HH").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def group_summary(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Groups without comments have 0; the span is in days."""
    n = comments.join(posts.select(F.col("id").alias("post_id"), "subreddit"), "post_id").groupBy("subreddit").agg(F.count(F.lit(1)).alias("comment_count"))
    seconds = F.unix_seconds(F.max("created_utc").cast("timestamp")) - F.unix_seconds(F.min("created_utc").cast("timestamp"))
    out = posts.groupBy("subreddit").agg(F.count(F.lit(1)).alias("posts"), r(seconds / 86400, 1).alias("span_days"))
    return out.join(n, "subreddit", "left").withColumn("comment_count", F.coalesce("comment_count", F.lit(0)).cast("long"))


def engagement(posts: DataFrame) -> DataFrame:
    return posts.groupBy("post_type").agg(F.count(F.lit(1)).alias("n"), F.sum("score").cast("long").alias("score"), r(F.avg("num_comments"), 4).alias("avg_comments"), r(share((F.col("score") > 0) | (F.col("num_comments") > 0)), 4).alias("engagement_rate"))


def posting_times(posts: DataFrame) -> DataFrame:
    return posts.groupBy(F.date_format("created_utc", "EEEE").alias("weekday"), F.hour("created_utc").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum("score").cast("long").alias("total"), r(F.avg("score"), 3).alias("avg_score"))


def keyword_alerts(posts: DataFrame, keywords: list[str]) -> DataFrame:
    """Posts that hold any keyword, with those they hold in the order given."""
    body = F.lower(F.concat_ws(" ", "title", "selftext"))
    hits = F.filter(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(body, k))
    return posts.select("id", F.array_join(hits, ",").alias("matched")).where("matched <> ''")


def keep_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; rows with a null key are dropped."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("first"))
    return first.select(key, "first.*")


def keyword_counts(posts: DataFrame, stop: list[str], limit: int) -> DataFrame:
    w = posts.select(F.explode(T.words(F.col("selftext"), 3)).alias("word")).where(~F.col("word").isin(stop))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(limit)


def lexicon_sentiment(posts: DataFrame, positive: list[str], negative: list[str], intensifiers: list[str]) -> DataFrame:
    score = T.lexicon_score(T.words(F.col("selftext")), positive, negative, intensifiers)
    return posts.select("id", score.alias("raw")).select("id", r(F.col("raw"), 3).alias("score"), T.label(F.col("raw")).alias("label"))


def merge(target: DataFrame, source: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """Keyed upsert: new keys are inserted whole; of known keys the columns in `update` change (all but the keys if None), the
    others stay. The last of equal source keys is not defined, so they must be distinct. Merging twice changes nothing."""
    update = [c for c in target.columns if c not in keys] if update is None else update
    t = target.withColumn("__t", F.lit(True)).alias("t")
    s = source.select(*target.columns).withColumn("__s", F.lit(True)).alias("s")
    both = t.join(s, reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]), "full_outer")

    def pick(c: str):
        new = F.col("s.__s").isNotNull() if c in update else F.col("t.__t").isNull()
        return F.when(new, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)

    return both.select(*[pick(c) for c in target.columns])


def stamped_status(target: DataFrame, source: DataFrame, now) -> DataFrame:
    """Upsert of (username, status): checked is stamped always, changed only when the status differs or is new."""
    j = target.alias("t").join(source.alias("s"), "username", "full_outer")
    seen, differs = F.col("s.status").isNotNull(), ~F.col("t.status").eqNullSafe(F.col("s.status"))
    return j.select("username", F.coalesce("s.status", "t.status").alias("status"), F.when(seen, now).otherwise(F.col("t.checked_at")).alias("checked_at"), F.when(seen & differs, now).otherwise(F.col("t.changed_at")).alias("changed_at"))


def reply_edges(comments: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """Who replies to whom: (src, dst, weight); replies to oneself, to deleted authors and to missing parents are dropped.

    A parent t1_ is a comment, t3_ a post; without posts, replies to posts give no edge."""
    parent = comments.select(F.concat(F.lit("t1_"), "comment_id").alias("parent_id"), F.col("author").alias("dst"))
    if posts is not None:
        parent = parent.unionByName(posts.select(F.concat(F.lit("t3_"), F.col("id").cast("string")).alias("parent_id"), F.col("author").alias("dst")))
    e = comments.select("parent_id", F.col("author").alias("src")).join(parent, "parent_id")
    return e.where("src <> dst and src <> '[deleted]' and dst <> '[deleted]'").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def top_similar(vectors: DataFrame, query_id: int, k: int) -> DataFrame:
    """The k vectors of greatest cosine to one vector, itself excluded; sums in double precision."""

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = v.where(F.col("vec_id") == query_id).select(F.col("v").alias("q")).limit(1)
    sim = dot(F.col("v"), F.col("q")) / (F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("q"), F.col("q"))))
    return v.where(F.col("vec_id") != query_id).crossJoin(F.broadcast(q)).select("vec_id", r(sim, 6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(k)


def job_stats(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("target").agg(F.count(F.lit(1)).alias("jobs"), *[F.sum(F.when(F.col("status") == s, 1).otherwise(0)).cast("long").alias(s) for s in ("completed", "running", "failed")])


def latest_per_key(rows: DataFrame, key: str, order: list) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")
