"""Queries on feeds, keyed writes, graphs, phrase search, trades and screens, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.numeric import r
from pulsegrid.operators import features, fulltext, graph, market, posts, trades, writes
from pulsegrid.plans import catalog
from pulsegrid.sources import feeds
from pulsegrid.sources import fixtures as S

def bars(spark, d):
    """Open and close of a ticker-day are the prices of its first and last line, low and high the extremes."""
    li = S.table(spark, d, "lineitem").select(F.concat(F.lit("P"), (F.col("l_partkey") % 50).cast("string")).alias("ticker"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), F.struct("l_orderkey", "l_linenumber").alias("at"))
    return li.groupBy("ticker", "date").agg(F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"))


_BARS = """SELECT 'P' || (l_partkey % 50) AS ticker, CAST(l_shipdate AS DATE) AS date, arg_min(l_extendedprice / l_quantity, l_orderkey * 10 + l_linenumber) AS open,
 max(l_extendedprice / l_quantity) AS high, arg_max(l_extendedprice / l_quantity, l_orderkey * 10 + l_linenumber) AS close FROM lineitem GROUP BY 1, 2"""


def _json_posts(spark, d):
    p = S.posts(spark, d)
    url = F.when(F.col("id") % 4 == 0, "https://i.redd.it/x").when(F.col("id") % 4 == 1, "https://h/x.PNG").otherwise("https://h/x")
    line = F.to_json(F.struct(F.col("id").cast("string").alias("id"), "title", url.alias("url"), "score", "selftext", (F.col("id") * 61.5).alias("created_utc"), (F.col("id") % 3 == 0).alias("is_self"), (F.col("id") % 11 == 0).alias("is_video"), (F.col("id") % 7 == 0).alias("is_gallery")))
    return feeds.posts_from_json(p.select(line.alias("value"))).select("id", "score", "post_type", "has_media", F.sha2("selftext", 256).alias("selftext_sha256"), (F.unix_micros("created_utc") / 1e6).alias("seconds"))


def _pipe(spark, d):
    li = S.table(spark, d, "lineitem")
    v = li.groupBy((F.col("l_partkey") % 50).alias("k"), F.to_date("l_shipdate").alias("date")).agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("s"), F.sum("l_quantity").alias("t"))
    lines = v.select(F.concat_ws("|", F.date_format("date", "yyyyMMdd"), F.concat(F.lit("P"), F.col("k").cast("string")), F.col("s").cast("string"), F.lit("0"), F.col("t").cast("string")).alias("value"))
    head = spark.range(1).select(F.lit("Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market").alias("value"))
    return feeds.short_volume_lines(lines.unionByName(head))


def _prices(spark, d):
    p = S.prices(spark, d)
    rows = p.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct((F.unix_date("date").cast("long") * 86400 + 3600).alias("t"), F.when(F.dayofmonth("date") % 7 > 0, F.col("close")).alias("c")))).alias("z"))
    return feeds.price_arrays(rows.select("ticker", F.col("z.t").alias("t"), F.col("z.c").alias("c")), "ticker", "t", "c").withColumn("close", r(F.col("close"), 6))


def _totals(spark, d):
    p = S.posts(spark, d)
    one = lambda x: x.groupBy("subreddit").agg(F.sum("score").alias("total"), F.max("created_utc").alias("seen"))
    return writes.add_totals(one(p.where("id % 3 = 0")), one(p.where("id % 3 > 0")), ["subreddit"], ["total"], ["seen"]).select("subreddit", F.col("total").cast("long").alias("total"), F.date_format("seen", "yyyy-MM-dd HH:mm").alias("seen"))


def _updated(spark, d):
    p = S.posts(spark, d).select("id", "num_comments", "score")
    new = p.where("id % 2 = 0").select("id", (F.col("num_comments") + 10).alias("num_comments"), F.when(F.col("id") % 4 == 0, F.lit(-1).cast("long")).alias("score"))
    return writes.point_update(p, new, "id")


def _deleted(spark, d):
    c, m = S.comments(spark, d), S.table(spark, d, "labels")
    stay, gone = writes.cascade_delete(S.posts(spark, d), F.col("subreddit") == "src3", {"comments": (c, "post_id"), "labels": (m, "doc_id")})
    keys = {"posts": "id", "comments": "post_id", "labels": "doc_id"}
    left = reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("left"), F.sum(keys[name]).cast("long").alias("ids")).select(F.lit(name).alias("name"), "left", "ids") for name, df in stay.items()])
    return gone.join(left, "name")


def _window(spark, d):
    m = S.mentions(spark, d)
    one = lambda x: x.groupBy(F.to_date("created_utc").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return writes.replace_window(one(m), one(m.where("score >= 20")), "date", F.lit("2024-01-15").cast("date"))


def _closed(spark, d):
    o = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"), F.col("o_totalprice").alias("net"))
    new = o.where("id % 2 = 0 or id % 3 = 0").select("id", F.lit("closed").alias("status"), F.lit(0.0).alias("net"))
    return writes.close_open(o.where("id % 3 > 0"), new, ["id"])


def _features(spark, d):
    return features.feature_daily(S.mentions(spark, d, True), S.authors(spark, d))


def _spec(spark, d):
    f = _features(spark, d).withColumn("key", F.concat(F.lit("T"), F.substring("ticker", 2, 2)))
    back = market.trailing_return(f.select(F.col("key").alias("ticker"), "date").distinct(), S.prices(spark, d), 5).select(F.concat(F.lit("C"), F.substring("ticker", 2, 2)).alias("ticker"), "date", "ret")
    return trades.distribution_short(f, back, ["C03"], 0.1)


def _lines(spark, d):
    s = trades.conviction(_features(spark, d)).where("tier = 1")
    return trades.signal_lines(s, ["ticker", "date", "mentions", "tier"])


QUERIES = {
    "json_posts": _json_posts,
    "pipe_short_volume": _pipe,
    "price_arrays": _prices,
    "additive_upsert": _totals,
    "point_update": _updated,
    "cascade_delete_counts": _deleted,
    "window_replace": _window,
    "guarded_close": _closed,
    "conviction_tiers": lambda s, d: trades.conviction(_features(s, d)),
    "distribution_short": _spec,
    "froth_count": lambda s, d: trades.froth(_features(s, d)),
    "universe_by_share": lambda s, d: trades.universe(S.mentions(s, d), ["click", "view"], 0.4, 50),
    "signal_lines": _lines,
}


def queries() -> dict:
    return dict(QUERIES)


def _r(x: str, d: int) -> str:
    return f"round({x} + 1e-9, {d})"


def oracle_sql() -> dict[str, str]:
    v = S.with_views
    known = catalog.oracle_sql()
    f = known["feature_daily_concentrated"]
    tier = "CASE WHEN per_author >= 3 AND mentions >= 10 THEN 1 WHEN mentions >= 10 THEN 2 ELSE 3 END"
    kind = "CASE WHEN id % 11 = 0 THEN 'video' WHEN id % 7 = 0 THEN 'gallery' WHEN id % 4 < 2 THEN 'image' WHEN id % 3 = 0 THEN 'text' ELSE 'link' END"
    return {
        "json_posts": v(f", t AS (SELECT id, score, selftext, {kind} AS post_type FROM posts) SELECT CAST(id AS VARCHAR) AS id, score, post_type, post_type IN ('image', 'video', 'gallery') AS has_media, sha256(selftext) AS selftext_sha256, id * 61.5e0 AS seconds FROM t", "posts"),
        "pipe_short_volume": f"""WITH t AS (SELECT 'P' || (l_partkey % 50) AS ticker, CAST(l_shipdate AS DATE) AS date, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS short_volume, sum(l_quantity) AS total_volume FROM lineitem GROUP BY 1, 2)
 SELECT *, {_r('short_volume / total_volume', 4)} AS short_ratio FROM t""",
        "price_arrays": v(f"SELECT ticker, date, {_r('close', 6)} AS close FROM prices WHERE day(date) % 7 > 0", "prices"),
        "additive_upsert": v("SELECT subreddit, CAST(sum(score) AS BIGINT) AS total, strftime(max(created_utc), '%Y-%m-%d %H:%M') AS seen FROM posts GROUP BY 1", "posts"),
        "point_update": v("SELECT id, CASE WHEN id % 2 = 0 THEN num_comments + 10 ELSE num_comments END AS num_comments, CASE WHEN id % 4 = 0 THEN -1 ELSE score END AS score FROM posts", "posts"),
        "cascade_delete_counts": v(""", g AS (SELECT id FROM posts WHERE subreddit = 'src3'), r AS (SELECT 'posts' AS name, id FROM posts UNION ALL SELECT 'comments', post_id FROM comments UNION ALL SELECT 'labels', doc_id FROM labels), m AS (SELECT *, id IN (SELECT id FROM g) AS gone FROM r)
 SELECT name, count(*) FILTER (WHERE gone) AS deleted, count(*) FILTER (WHERE NOT gone) AS "left", CAST(sum(id) FILTER (WHERE NOT gone) AS BIGINT) AS ids FROM m GROUP BY 1""", "posts", "comments"),
        "window_replace": v("SELECT CAST(created_utc AS DATE) AS date, count(*) AS n FROM mentions WHERE CAST(created_utc AS DATE) < DATE '2024-01-15' OR score >= 20 GROUP BY 1", "mentions"),
        "guarded_close": """SELECT o_orderkey AS id, CASE WHEN hit OR o_orderstatus <> 'O' THEN 'closed' ELSE 'open' END AS status, CASE WHEN hit THEN 0 ELSE o_totalprice END AS net
 FROM (SELECT *, o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 AND o_orderstatus = 'O' AS hit FROM orders)""",
        "conviction_tiers": f"SELECT ticker, date, mentions, per_author, {tier} AS tier FROM ({f}) WHERE per_author >= 2 AND mentions >= 5",
        "distribution_short": v(f""", ses AS (SELECT ticker, date, close, lag(close, 5) OVER (PARTITION BY ticker ORDER BY date) AS prv FROM prices), f AS ({f}),
 j AS (SELECT f.*, (SELECT arg_max(CASE WHEN prv > 0 THEN close / prv - 1 END, s.date) FROM ses s WHERE s.ticker = 'T' || substr(f.ticker, 2, 2) AND s.date <= f.date AND prv IS NOT NULL) AS ret FROM f WHERE per_author >= 2 AND mentions >= 10 AND sentiment >= 0.1 AND ticker <> 'C03')
 SELECT ticker, date, mentions, sentiment, {_r('ret', 6)} AS ret FROM j WHERE ret < 0""", "prices"),
        "froth_count": f"SELECT date, count(*) FILTER (WHERE per_author >= 2 AND mentions >= 5) AS froth FROM ({f}) GROUP BY 1",
        "universe_by_share": v(f", t AS (SELECT ticker, count(*) AS n, avg(CASE WHEN subreddit IN ('click', 'view') THEN 1.0e0 ELSE 0.0e0 END) AS x FROM mentions GROUP BY 1) SELECT ticker, n, {_r('x', 4)} AS share FROM t WHERE x >= 0.4 AND n >= 50", "mentions"),
        "signal_lines": f"SELECT ticker || ',' || date || ',' || mentions || ',1' AS line FROM ({f}) WHERE per_author >= 3 AND mentions >= 10",
    }
