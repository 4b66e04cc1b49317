"""Domain views over the driver's tables; each has the same rule in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mentions(spark: SparkSession, sf_dir: str, concentrated: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    ticker = F.concat(F.lit("C"), F.lpad((k % 25).cast("string"), 2, "0")) if concentrated else F.concat(F.lit("T"), F.lpad(k.cast("string"), 2, "0"))
    user = F.col("user_id") % 7 if concentrated else F.col("user_id")
    return e.select(
        ticker.alias("ticker"),
        F.when(F.col("event_id") % 2 == 0, "post").otherwise("comment").alias("source_type"),
        F.col("event_id").cast("string").alias("source_id"),
        F.col("event_type").alias("subreddit"),
        F.concat(F.lit("u"), user.cast("string")).alias("author"),
        F.col("ts").alias("created_utc"),
        F.floor("value").cast("long").alias("score"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50) / 100)).alias("sentiment_score"),
    )


def _mentions_sql(concentrated: bool) -> str:
    k = "CAST(json_extract_string(props, '$.k') AS INT)"
    ticker = f"'C' || lpad(CAST({k} % 25 AS VARCHAR), 2, '0')" if concentrated else f"'T' || lpad(CAST({k} AS VARCHAR), 2, '0')"
    user = "user_id % 7" if concentrated else "user_id"
    return f"""SELECT {ticker} AS ticker, CASE WHEN event_id % 2 = 0 THEN 'post' ELSE 'comment' END AS source_type,
 CAST(event_id AS VARCHAR) AS source_id, event_type AS subreddit, 'u' || ({user}) AS author, ts AS created_utc,
 CAST(floor(value) AS BIGINT) AS score, greatest(-1.0e0, least(1.0e0, (value - 50) / 100)) AS sentiment_score FROM events"""


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("username"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 5).alias("account_age_days"),
        F.when(F.col("c_mktsegment") == "BUILDING", "deleted").when(F.col("c_mktsegment") == "MACHINERY", "suspended").otherwise("active").alias("account_status"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """close in whole cents summed exactly, so that both engines agree to the last bit."""
    m = table(spark, sf_dir, "events")
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    return m.groupBy(F.concat(F.lit("T"), F.lpad(F.get_json_object("props", "$.k"), 2, "0")).alias("ticker"), F.to_date("ts").alias("date")).agg((100 + cents / (100.0 * F.count(F.lit(1)))).alias("close"))


def prices_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cents = F.sum(F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long"))
    return li.groupBy(F.concat(F.lit("P"), (F.col("l_partkey") % 50).cast("string")).alias("ticker"), F.to_date("l_shipdate").alias("date")).agg((cents / (100.0 * F.count(F.lit(1)))).alias("close"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("subreddit"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("selftext"),
        (F.col("n_chars") % 100).cast("long").alias("score"),
        (F.col("doc_id") % 7).cast("long").alias("num_comments"),
        F.element_at(F.array(*map(F.lit, ("text", "link", "image", "video", "gallery"))), (F.col("doc_id") % 5 + 1).cast("int")).alias("post_type"),
        F.concat(F.lit("u"), (F.col("doc_id") % 150).cast("string")).alias("author"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("doc_id") * 37).cast("int"))).alias("created_utc"),
        "lang",
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")
    return c.select(
        F.col("conv_id").alias("post_id"),
        F.concat_ws("_", conv, turn.cast("string")).alias("comment_id"),
        F.when(turn == 0, F.concat(F.lit("t3_"), conv)).otherwise(F.concat(F.lit("t1_"), conv, F.lit("_"), (turn - 1).cast("string"))).alias("parent_id"),
        F.concat("role", (F.col("conv_id") % 13).cast("string")).alias("author"),
        F.col("text").alias("body"),
        turn.cast("int").alias("depth"),
        F.length("text").cast("long").alias("score"),
    )


#: Common table expressions for DuckDB.
SQL = {
    "mentions": _mentions_sql(False),
    "mentions_conc": _mentions_sql(True),
    "authors": """SELECT 'u' || c_custkey AS username, CASE WHEN c_acctbal >= 0 THEN c_acctbal / 5 END AS account_age_days,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'deleted' WHEN 'MACHINERY' THEN 'suspended' ELSE 'active' END AS account_status FROM customer""",
    "prices": """SELECT 'T' || lpad(json_extract_string(props, '$.k'), 2, '0') AS ticker, CAST(ts AS DATE) AS date,
 100 + CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (100.0e0 * count(*)) AS close FROM events GROUP BY 1, 2""",
    "prices_long": """SELECT 'P' || (l_partkey % 50) AS ticker, CAST(l_shipdate AS DATE) AS date,
 CAST(sum(CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT)) AS DOUBLE) / (100.0e0 * count(*)) AS close FROM lineitem GROUP BY 1, 2""",
    "posts": """SELECT doc_id AS id, source AS subreddit, substr(text, 1, 60) AS title, text AS selftext, CAST(n_chars % 100 AS BIGINT) AS score,
 CAST(doc_id % 7 AS BIGINT) AS num_comments, ['text', 'link', 'image', 'video', 'gallery'][CAST(doc_id % 5 + 1 AS INT)] AS post_type,
 'u' || (doc_id % 150) AS author, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id * 37 AS INT)) AS created_utc, lang FROM documents""",
    "comments": """SELECT conv_id AS post_id, conv_id || '_' || turn AS comment_id,
 CASE WHEN turn = 0 THEN 't3_' || conv_id ELSE 't1_' || conv_id || '_' || (turn - 1) END AS parent_id,
 role || (conv_id % 13) AS author, text AS body, CAST(turn AS INT) AS depth, CAST(length(text) AS BIGINT) AS score FROM conversations""",
}


def with_views(sql: str, *names: str) -> str:
    """A body that begins with a comma adds expressions of its own."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + sql.strip()
