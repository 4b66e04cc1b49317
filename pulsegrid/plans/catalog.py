"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import text as T
from pulsegrid.operators import features, market, mentions, posts
from pulsegrid.sources import fixtures as S

AS_OF = S.AS_OF
#: A lexicon of words that are frequent in the driver's invented prose.
POSITIVE, NEGATIVE, INTENSIFIERS = ["the", "of"], ["and", "to"], ["in", "is"]
STOP = ["the", "and", "that", "der", "die", "les", "des"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_daily(S.mentions(spark, sf_dir), S.authors(spark, sf_dir), min_total=5)


def _jobs(spark, d):
    o = S.table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return o.select(F.col("o_orderpriority").alias("target"), status.alias("status"))


def net_study(e, p):
    own = market.forward_return(e, p, 3).withColumnRenamed("ret", "g")
    spy = market.forward_return(e.select(F.lit("SPY").alias("ticker"), "date").distinct(), market.benchmark(p), 3).select("date", F.col("ret").alias("mkt"))
    trades = own.join(spy, "date", "left").withColumn("net", market.net(F.col("g"), F.col("mkt"), -1, 3, 75.0, 5.0))
    return market.study(trades.withColumn("side", F.lit(-1)), "net", 3, ["side"])


def _short_volume(spark, d):
    li = S.table(spark, d, "lineitem")
    v = li.groupBy(F.concat(F.lit("P"), (F.col("l_partkey") % 50).cast("string")).alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("s"), F.sum("l_quantity").alias("t"))
    return v.select("ticker", "date", F.round(F.col("s") / F.col("t") + 1e-9, 4).alias("short_ratio"))


def _symbols():
    return ["IT", "IN", "ON", "OF", "TH", "RE"]


def capitals(p):
    """The whole text in capitals, every third with a cash mark in front, as text."""
    text = F.concat(F.when(F.col("id") % 3 == 0, F.lit("$")).otherwise(F.lit("")), F.translate(F.coalesce("selftext", F.lit("")), T.LOWER, T.UPPER))
    return p.withColumn("text", text)


def ticker_rows(p):
    return capitals(p).select("id", F.array_join(T.tickers(F.col("text"), _symbols(), ["THE"], ["IT"]), ",").alias("tickers"))


def _merged(spark, d):
    p = S.posts(spark, d).select("id", "title", "score", "num_comments")
    old = p.where("id % 3 <> 0")
    new = p.where("id % 2 = 0 or id % 3 = 0").select("id", F.lit("changed").alias("title"), (F.col("score") + 1000).alias("score"), "num_comments")
    return posts.merge(old, new, ["id"], ["score"])


QUERIES = {
    "feature_daily": lambda s, d: features.feature_daily(S.mentions(s, d), S.authors(s, d)),
    "feature_daily_concentrated": lambda s, d: features.feature_daily(S.mentions(s, d, True), S.authors(s, d)),
    "aggregate_daily": lambda s, d: features.aggregate_daily(S.mentions(s, d), S.authors(s, d)),
    "rrai_percentile": lambda s, d: features.trailing_percentile(features.aggregate_daily(S.mentions(s, d), S.authors(s, d)), 10, 5, 20),
    "recruitment_features": lambda s, d: features.recruitment(S.mentions(s, d)),
    "daily_rollup": lambda s, d: mentions.daily_rollup(S.mentions(s, d)),
    "trending_mentions": lambda s, d: mentions.trending(S.mentions(s, d), AS_OF, 72, 20),
    "entity_sentiment": lambda s, d: mentions.entity_sentiment(S.mentions(s, d), ["ticker"]),
    "entity_sentiment_by_group": lambda s, d: mentions.entity_sentiment(S.mentions(s, d), ["ticker", "subreddit"]),
    "entity_timeseries": lambda s, d: mentions.timeseries(S.mentions(s, d), "$t07"),
    "pump_suspects": lambda s, d: mentions.pump_suspects(S.mentions(s, d), S.authors(s, d), AS_OF, 24 * 14, 10),
    "fresh_burst": lambda s, d: mentions.fresh_burst(S.mentions(s, d), AS_OF, 48, 14, 3, 1.2),
    "momentum_zscore": lambda s, d: mentions.momentum(S.mentions(s, d)),
    "coordination_scan": lambda s, d: mentions.coordination_scan(S.mentions(s, d, True), 5.0, 5, 0.2),
    "propagation": lambda s, d: mentions.propagation(S.mentions(s, d)),
    "tracked_tickers": lambda s, d: mentions.tracked(S.mentions(s, d), 100),
    "prescience_rank": lambda s, d: mentions.prescience(S.mentions(s, d)),
    "search_posts": lambda s, d: posts.search(S.posts(s, d), "the", min_score=10, post_type="link").select("id", "subreddit", "score"),
    "search_comments": lambda s, d: posts.search_comments(S.comments(s, d), "the", 20).select("comment_id", "score"),
    "group_stats": lambda s, d: posts.group_stats(S.posts(s, d)),
    "group_type_distribution": lambda s, d: posts.type_distribution(S.posts(s, d)),
    "group_top_authors": lambda s, d: posts.top_authors(S.posts(s, d)),
    "hourly_activity": lambda s, d: posts.hourly_activity(S.posts(s, d)),
    "group_summary": lambda s, d: posts.group_summary(S.posts(s, d), S.comments(s, d)),
    "engagement_by_type": lambda s, d: posts.engagement(S.posts(s, d)),
    "posting_times": lambda s, d: posts.posting_times(S.posts(s, d)),
    "keyword_alerts": lambda s, d: posts.keyword_alerts(S.posts(s, d), ["tion of", "zzz", "The "]),
    "dedupe_keep_first": lambda s, d: posts.keep_first(S.posts(s, d), "selftext", ["id"]).select("id"),
    "job_stats": lambda s, d: posts.job_stats(_jobs(s, d)),
    "merge_upsert": _merged,
    "cosine_topk": lambda s, d: posts.top_similar(S.table(s, d, "embeddings"), 0, 10),
    "sma_trend": lambda s, d: market.trend_state(S.prices_long(s, d), 200, 50),
    "equity_drawdown": lambda s, d: market.drawdown(S.prices_long(s, d)),
    "squeeze_screen": lambda s, d: market.squeeze(_short_volume(s, d), 20),
}


def queries() -> dict:
    return dict(QUERIES)


def _r(x: str, d: int) -> str:
    return f"round({x} + 1e-9, {d})"


def _feature_sql(view: str, min_total: int) -> str:
    w = lambda n: f"OVER (PARTITION BY ticker ORDER BY day RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return S.with_views(f"""
, busy AS (SELECT ticker FROM {view} GROUP BY ticker HAVING count(*) >= {min_total}),
a AS (SELECT ticker, CAST(created_utc AS DATE) AS date, author, count(*) AS c, sum(sentiment_score) AS s,
 count(*) FILTER (WHERE account_age_days <= 365) AS young, count(*) FILTER (WHERE account_status IN ('deleted', 'suspended')) AS gone
 FROM {view} m LEFT JOIN authors ON author = username WHERE ticker IN (SELECT ticker FROM busy) GROUP BY 1, 2, 3),
d AS (SELECT ticker, date, CAST(sum(c) AS BIGINT) AS mentions, count(*) AS breadth, max(c) AS top, sum(c * c) AS squares, sum(s) / sum(c) AS sentiment,
 sum(young) AS young, sum(gone) AS gone, date_diff('day', DATE '1970-01-01', date) AS day FROM a GROUP BY 1, 2),
f AS (SELECT *, mentions / nullif(avg(mentions) {w(7)}, 0) AS vel, (mentions - avg(mentions) {w(14)}) / nullif({_r(f'stddev_pop(mentions) {w(14)}', 6)}, 0) AS z,
 sentiment - avg(sentiment) {w(7)} AS delta, min(date) OVER (PARTITION BY ticker) AS first FROM d)
SELECT ticker, date, mentions, breadth, {_r('mentions / breadth', 4)} AS per_author, {_r('top / mentions', 4)} AS concentration,
 {_r('squares / (mentions * mentions)', 4)} AS hhi, {_r('sentiment', 4)} AS sentiment, {_r('vel', 4)} AS vel,
 {_r('vel - lag(vel) OVER (PARTITION BY ticker ORDER BY day)', 4)} AS accel, {_r('z', 4)} AS mentions_z, {_r('delta', 4)} AS sent_delta,
 {_r('young / mentions', 4)} AS young_frac, {_r('gone / mentions', 4)} AS gone_frac, date_diff('day', first, date) AS novelty_days FROM f""", view, "authors")


_AGG = f"""SELECT CAST(created_utc AS DATE) AS date, count(*) AS total_mentions, count(DISTINCT ticker) AS tickers, count(DISTINCT author) AS authors,
 {_r('avg(sentiment_score)', 4)} AS mkt_sent, {_r('avg(CASE WHEN sentiment_score > 0.3 THEN 1.0e0 ELSE 0.0e0 END)', 4)} AS bull_frac,
 {_r('avg(CASE WHEN sentiment_score < 0 THEN 1.0e0 ELSE 0.0e0 END)', 4)} AS bear_frac, {_r('avg(CASE WHEN account_age_days <= 365 THEN 1.0e0 ELSE 0.0e0 END)', 4)} AS young_frac,
 {_r("avg(CASE WHEN account_status IN ('deleted', 'suspended') THEN 1.0e0 ELSE 0.0e0 END)", 4)} AS gone_frac
 FROM mentions LEFT JOIN authors ON author = username WHERE source_type = 'post' GROUP BY 1"""
_SENT = f"""count(*) AS mentions, {_r('avg(sentiment_score)', 4)} AS avg_sentiment, count(*) FILTER (WHERE sentiment_score > 0.05) AS positive,
 count(*) FILTER (WHERE sentiment_score < -0.05) AS negative, count(DISTINCT author) AS authors FROM mentions"""
_T = f"TIMESTAMP '{AS_OF}'"
_HIT = "CASE WHEN x[1] IN ('the', 'of') THEN 1.0e0 WHEN x[1] IN ('and', 'to') THEN -1.0e0 ELSE 0.0e0 END * CASE WHEN x[2] IN ('in', 'is') THEN 1.5e0 ELSE 1.0e0 END"
_FWD = """SELECT e.id, e.ticker, e.date, s.date AS session, CASE WHEN s.close > 0 THEN s.nxt / s.close - 1 END AS ret
 FROM e LEFT JOIN LATERAL (SELECT min(p.date) AS d FROM ses p WHERE p.ticker = e.ticker AND p.date > e.date) q ON true LEFT JOIN ses s ON s.ticker = e.ticker AND s.date = q.d"""
_SES = "SELECT *, lead(close, 3) OVER (PARTITION BY ticker ORDER BY date) AS nxt, lag(close, 5) OVER (PARTITION BY ticker ORDER BY date) AS prv, row_number() OVER (PARTITION BY ticker ORDER BY date) AS ord FROM prices"


def oracle_sql() -> dict[str, str]:
    v = S.with_views
    return {
        "feature_daily": _feature_sql("mentions", 20),
        "feature_daily_concentrated": _feature_sql("mentions_conc", 20),
        "aggregate_daily": v(f"SELECT *, {_r('coalesce(bull_frac, 0) - coalesce(bear_frac, 0)', 4)} AS rrai_raw FROM ({_AGG})", "mentions", "authors"),
        "rrai_percentile": v(f""", g AS (SELECT *, {_r('coalesce(bull_frac, 0) - coalesce(bear_frac, 0)', 4)} AS rrai_raw FROM ({_AGG})),
 l AS (SELECT date, rrai_raw, list(rrai_raw) OVER (ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS seen FROM g WHERE total_mentions >= 20)
 SELECT g.date, g.rrai_raw, {_r('CASE WHEN len(seen) >= 5 THEN len(list_filter(seen, lambda x: x <= g.rrai_raw)) / len(seen) END', 4)} AS rrai_pct FROM g LEFT JOIN l ON g.date = l.date""", "mentions", "authors"),
        "recruitment_features": v(f""", u AS (SELECT DISTINCT ticker, author, CAST(created_utc AS DATE) AS date FROM mentions WHERE author IS NOT NULL),
 f AS (SELECT *, min(date) OVER (PARTITION BY ticker, author) AS first FROM u),
 d AS (SELECT ticker, date, count(*) AS auth, count(*) FILTER (WHERE date = first) AS new_auth, date_diff('day', DATE '1970-01-01', date) AS day FROM f GROUP BY 1, 2),
 e AS (SELECT *, new_auth / auth AS new_frac FROM d)
 SELECT ticker, date, auth, new_auth, {_r('new_frac', 4)} AS new_frac, {_r('avg(new_frac) OVER w', 4)} AS new_frac_trail, {_r('avg(new_auth) OVER w', 4)} AS new_auth_trail,
 {_r(f"(new_auth - avg(new_auth) OVER w) / nullif({_r('stddev_pop(new_auth) OVER w', 6)}, 0)", 4)} AS new_z FROM e
 WINDOW w AS (PARTITION BY ticker ORDER BY day RANGE BETWEEN 14 PRECEDING AND 1 PRECEDING)""", "mentions"),
        "daily_rollup": v(f"SELECT subreddit, ticker, CAST(created_utc AS DATE) AS date, count(*) AS mentions, {_r('avg(sentiment_score)', 4)} AS avg_sentiment FROM mentions GROUP BY 1, 2, 3", "mentions"),
        "trending_mentions": v(f""", n AS (SELECT ticker, count(*) AS mentions, {_r('avg(sentiment_score)', 4)} AS avg_sentiment, count(DISTINCT author) AS authors FROM mentions
 WHERE created_utc >= {_T} - INTERVAL 72 HOURS AND created_utc < {_T} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20),
 p AS (SELECT ticker, count(*) AS prev FROM mentions WHERE created_utc >= {_T} - INTERVAL 144 HOURS AND created_utc < {_T} - INTERVAL 72 HOURS GROUP BY 1)
 SELECT n.*, coalesce(prev, 0) AS prev, mentions - coalesce(prev, 0) AS velocity_change FROM n LEFT JOIN p USING (ticker)""", "mentions"),
        "entity_sentiment": v(f"SELECT ticker, {_SENT} GROUP BY 1", "mentions"),
        "entity_sentiment_by_group": v(f"SELECT ticker, subreddit, {_SENT} GROUP BY 1, 2", "mentions"),
        "entity_timeseries": v(f"SELECT CAST(created_utc AS DATE) AS date, count(*) AS mentions, {_r('avg(sentiment_score)', 4)} AS avg_sentiment FROM mentions WHERE ticker = 'T07' GROUP BY 1", "mentions"),
        "pump_suspects": v(f""", s AS (SELECT ticker, count(*) AS mentions, count(DISTINCT author) AS authors, {_r('count(*) / count(DISTINCT author)', 2)} AS per_author,
 {_r("avg(CASE WHEN account_status IN ('deleted', 'suspended') THEN 1.0e0 ELSE 0.0e0 END)", 3)} AS gone_frac, {_r("avg(CASE WHEN account_status = 'suspended' THEN 1.0e0 ELSE 0.0e0 END)", 3)} AS suspended_frac,
 {_r('avg(CASE WHEN account_age_days <= 365 THEN 1.0e0 ELSE 0.0e0 END)', 3)} AS young_frac, {_r('avg(sentiment_score)', 4)} AS avg_sentiment
 FROM mentions LEFT JOIN authors ON author = username WHERE created_utc >= {_T} - INTERVAL 336 HOURS AND created_utc < {_T} AND author NOT IN ('[deleted]', 'AutoModerator') GROUP BY 1 HAVING count(*) >= 10)
 SELECT *, {_r('per_author * (0.5e0 + gone_frac + 0.5e0 * young_frac)', 6)} AS suspicion FROM s""", "mentions", "authors"),
        "fresh_burst": v(f""", n AS (SELECT ticker, count(*) AS rc, count(DISTINCT author) AS authors FROM mentions WHERE created_utc >= {_T} - INTERVAL 48 HOURS AND created_utc < {_T} GROUP BY 1 HAVING count(*) >= 3),
 b AS (SELECT ticker, count(*) AS bc FROM mentions WHERE created_utc >= {_T} - INTERVAL 336 HOURS AND created_utc < {_T} - INTERVAL 48 HOURS GROUP BY 1),
 j AS (SELECT ticker, rc, authors, coalesce(bc, 0) AS bc, (rc / 2.0e0) / nullif(coalesce(bc, 0) / 12.0e0, 0) AS burst FROM n LEFT JOIN b USING (ticker))
 SELECT ticker, rc, authors, bc, bc = 0 AS fresh, {_r('burst', 3)} AS burst, {_r('rc / authors', 2)} AS per_author FROM j WHERE bc = 0 OR burst >= 1.2""", "mentions"),
        "momentum_zscore": v(f""", d AS (SELECT ticker, CAST(created_utc AS DATE) AS d, count(*) AS n FROM mentions GROUP BY 1, 2),
 g AS (SELECT ticker, CAST(sum(n) AS BIGINT) AS total, avg(n) AS mean, stddev_pop(n) AS sd, max(n) FILTER (WHERE d = (SELECT max(d) FROM d)) AS latest FROM d GROUP BY 1)
 SELECT ticker, total, {_r('mean', 3)} AS mean, {_r('sd', 3)} AS sd, latest, {_r('(latest - mean) / nullif(sd, 0)', 3)} AS z FROM g""", "mentions"),
        "coordination_scan": v("SELECT ticker, subreddit, count(*) AS n, count(DISTINCT author) AS a FROM mentions_conc GROUP BY 1, 2 HAVING count(*) >= 5 * count(DISTINCT author) AND count(DISTINCT author) <= greatest(5.0e0, 0.2e0 * count(*))", "mentions_conc"),
        "propagation": v(""", f AS (SELECT ticker, subreddit, min(created_utc) AS s, count(*) AS mentions FROM mentions GROUP BY 1, 2)
 SELECT ticker, subreddit, mentions, date_diff('day', CAST(min(s) OVER (PARTITION BY ticker) AS DATE), CAST(s AS DATE)) AS days_after FROM f""", "mentions"),
        "tracked_tickers": v("SELECT ticker, count(*) AS n FROM mentions GROUP BY 1 HAVING count(*) >= 100", "mentions"),
        "prescience_rank": v(f""", k AS (SELECT ticker, author, rank() OVER (PARTITION BY ticker ORDER BY created_utc) - 1 AS b, count(*) OVER (PARTITION BY ticker) AS n FROM mentions),
 f AS (SELECT ticker, author, 1 - min(b) / any_value(n) AS early FROM k WHERE n >= 5 GROUP BY 1, 2) SELECT author, {_r('avg(early)', 4)} AS earliness, count(*) AS tickers FROM f GROUP BY 1""", "mentions"),
        "search_posts": v("SELECT id, subreddit, score FROM posts WHERE (contains(lower(title), 'the') OR contains(lower(selftext), 'the')) AND score >= 10 AND post_type = 'link' ORDER BY created_utc DESC, id LIMIT 100", "posts"),
        "search_comments": v("SELECT comment_id, score FROM comments WHERE contains(lower(body), 'the') AND score >= 20 ORDER BY score DESC, comment_id LIMIT 100", "comments"),
        "group_stats": v(f"SELECT subreddit, count(*) AS posts, {_r('avg(score)', 4)} AS avg_score, max(score) AS max_score, CAST(sum(num_comments) AS BIGINT) AS comments FROM posts GROUP BY 1", "posts"),
        "group_type_distribution": v("SELECT subreddit, post_type, count(*) AS n FROM posts GROUP BY 1, 2", "posts"),
        "group_top_authors": v("SELECT author, count(*) AS n, CAST(sum(score) AS BIGINT) AS score FROM posts WHERE author <> '[deleted]' GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10", "posts"),
        "hourly_activity": v("SELECT strftime(created_utc, '%H') AS hour, count(*) AS n FROM posts GROUP BY 1", "posts"),
        "group_summary": v(f""", n AS (SELECT subreddit, count(*) AS c FROM comments JOIN posts ON post_id = id GROUP BY 1)
 SELECT p.subreddit, count(*) AS posts, {_r('(epoch(max(created_utc)) - epoch(min(created_utc))) / 86400', 1)} AS span_days, coalesce(any_value(c), 0) AS comment_count FROM posts p LEFT JOIN n USING (subreddit) GROUP BY 1""", "posts", "comments"),
        "engagement_by_type": v(f"SELECT post_type, count(*) AS n, CAST(sum(score) AS BIGINT) AS score, {_r('avg(num_comments)', 4)} AS avg_comments, {_r('avg(CASE WHEN score > 0 OR num_comments > 0 THEN 1.0e0 ELSE 0.0e0 END)', 4)} AS engagement_rate FROM posts GROUP BY 1", "posts"),
        "posting_times": v(f"SELECT dayname(created_utc) AS weekday, hour(created_utc) AS hour, count(*) AS n, CAST(sum(score) AS BIGINT) AS total, {_r('avg(score)', 3)} AS avg_score FROM posts GROUP BY 1, 2", "posts"),
        "keyword_alerts": v("""SELECT * FROM (SELECT id, array_to_string(list_filter(['tion of', 'zzz', 'the '], lambda k: contains(lower(title || ' ' || selftext), k)), ',') AS matched FROM posts) WHERE matched <> ''""", "posts"),
        "dedupe_keep_first": v("SELECT min(id) AS id FROM posts WHERE selftext IS NOT NULL GROUP BY selftext", "posts"),
        "job_stats": """SELECT o_orderpriority AS target, count(*) AS jobs, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'O') AS running,
 count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS failed FROM orders GROUP BY 1""",
        "merge_upsert": v("SELECT id, CASE WHEN id % 3 = 0 THEN 'changed' ELSE title END AS title, CASE WHEN id % 2 = 0 OR id % 3 = 0 THEN score + 1000 ELSE score END AS score, num_comments FROM posts", "posts"),
        "cosine_topk": f"SELECT vec_id, {_r('list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))', 6)} AS similarity FROM embeddings WHERE vec_id <> 0 ORDER BY 2 DESC, 1 LIMIT 10",
        "sma_trend": v(f""", w AS (SELECT ticker, date, {_r('close', 6)} AS c, row_number() OVER o AS n, {_r('avg(close) OVER (o ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)', 6)} AS slow, {_r('avg(close) OVER (o ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)', 6)} AS fast FROM prices_long WINDOW o AS (PARTITION BY ticker ORDER BY date))
 SELECT ticker, date, CASE WHEN n < 200 THEN 0 WHEN c > slow AND fast >= slow THEN 1 WHEN c < slow AND fast <= slow THEN -1 ELSE 0 END AS state FROM w""", "prices_long"),
        "equity_drawdown": v(f""", w AS (SELECT *, max(close) OVER (PARTITION BY ticker ORDER BY date) AS peak FROM prices_long)
 SELECT ticker, count(*) AS days, {_r('arg_max(close, date) / arg_min(close, date) - 1', 6)} AS total, {_r('max((peak - close) / peak)', 6)} AS max_dd FROM w GROUP BY 1""", "prices_long"),
        "squeeze_screen": f"""WITH v AS (SELECT 'P' || (l_partkey % 50) AS ticker, CAST(l_shipdate AS DATE) AS date, {_r("sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity)", 4)} AS x FROM lineitem GROUP BY 1, 2),
 n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM v)
 SELECT ticker, count(*) AS days, {_r('max(x) FILTER (WHERE n = 1)', 4)} AS latest, {_r('(max(x) FILTER (WHERE n = 1) - avg(x) FILTER (WHERE n > 1)) / nullif(round(stddev_pop(x) FILTER (WHERE n > 1), 9), 0)', 3)} AS z FROM n GROUP BY 1 HAVING count(*) >= 20""",
    }
