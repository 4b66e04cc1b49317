"""Studies of all events and orders, text of all documents, the reply graph, co-mentions and lead-lag, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import fulltext, graph, lookups, market, mentions, posts, trades
from pulsegrid.plans import board, catalog, services
from pulsegrid.sources import fixtures as S

#: Draws of the null, as in the reference's random_null.
DRAWS = 1000


def events(spark, d):
    return S.mentions(spark, d).select("ticker", F.to_date("created_utc").alias("date"), F.col("source_id").cast("long").alias("id"))


def orders(spark, d):
    o = S.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("P"), (F.col("o_custkey") % 50).cast("string")).alias("ticker"), F.to_date("o_orderdate").alias("date"))


def _returns(found):
    return found.select("id", "ticker", "session", F.round(F.col("ret") + 1e-9, 6).alias("ret"))


def _sentiment(spark, d):
    return posts.lexicon_sentiment(S.posts(spark, d), catalog.POSITIVE, catalog.NEGATIVE, catalog.INTENSIFIERS)


QUERIES = {
    "forward_return": lambda s, d: _returns(market.forward_return(events(s, d), S.prices(s, d), 3)),
    "trailing_return": lambda s, d: _returns(market.trailing_return(events(s, d), S.prices(s, d), 5)),
    "event_study_net": lambda s, d: catalog.net_study(events(s, d), S.prices(s, d)),
    "random_null_percentile": lambda s, d: market.random_null(events(s, d), S.prices(s, d), 3, DRAWS),
    "short_stop_grid": lambda s, d: trades.short_grid(orders(s, d), services.bars(s, d), [0.1, 0.25, 0.5], [3, 5, 10]),
    "ticker_extract": lambda s, d: catalog.ticker_rows(S.posts(s, d)),
    "keyword_counts": lambda s, d: posts.keyword_counts(S.posts(s, d), catalog.STOP, 50),
    "lexicon_sentiment": _sentiment,
    "sentiment_distribution": lambda s, d: _sentiment(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")),
    "phrase_search": lambda s, d: fulltext.phrase_search(S.posts(s, d), ["title", "selftext"], '"of the"'),
    "reply_edges": lambda s, d: posts.reply_edges(S.comments(s, d), S.posts(s, d)),
    "reply_pagerank": lambda s, d: graph.pagerank(posts.reply_edges(S.comments(s, d), S.posts(s, d)), rounds=100, tolerance=1e-6),
    "cooccurrence_lift": lambda s, d: mentions.cooccurrence(lookups.threads(board._threaded(s, d), S.comments(s, d)), 15, 3, 1.3),
    "lead_lag": lambda s, d: graph.lead_lag(S.mentions(s, d), lags=5, least=0.2, min_mentions=10),
}


def queries() -> dict:
    return dict(QUERIES)


_E = "e AS (SELECT ticker, CAST(created_utc AS DATE) AS date, CAST(source_id AS BIGINT) AS id FROM mentions)"
#: Lower case of ASCII letters only: the engines differ on others.
_ASCII = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    """The null draws, the stop grid and PageRank have none: tests hold them against brute force."""
    v, r, ses, fwd = S.with_views, catalog._r, catalog._SES, catalog._FWD
    # A word is a run of letters, digits and underscores that is all a-z.
    words = "list_filter(regexp_extract_all(" + _ASCII.format(x="coalesce(selftext, '')") + r", '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]+') AND length(w) >= {n})"
    low = _ASCII.format(x="concat_ws(' ', title, selftext)")
    toks = f"list_filter(regexp_split_to_array({low}, '[^a-z0-9]+'), lambda w: w <> '')"
    sentiment = v(f""", t AS (SELECT id, {words.format(n=1)} AS w FROM posts),
 p AS (SELECT id, len(w) AS n, list_sum(list_transform(list_zip(w, list_concat([''], w[:-2])), lambda x: {catalog._HIT})) AS s FROM t),
 q AS (SELECT id, greatest(-1.0e0, least(1.0e0, coalesce(5.0e0 * s / nullif(n, 0), 0))) AS raw FROM p)
 SELECT id, {r('raw', 3)} AS score, CASE WHEN raw > 0.1 THEN 'positive' WHEN raw < -0.1 THEN 'negative' ELSE 'neutral' END AS label FROM q""", "posts")
    return {
        "forward_return": v(f", {_E}, ses AS ({ses}) SELECT id, ticker, session, {r('ret', 6)} AS ret FROM ({fwd})", "mentions", "prices"),
        "trailing_return": v(f""", {_E}, ses AS ({ses}) SELECT e.id, e.ticker, s.date AS session, {r('CASE WHEN s.prv > 0 THEN s.close / s.prv - 1 END', 6)} AS ret
 FROM e LEFT JOIN LATERAL (SELECT max(p.date) AS d FROM ses p WHERE p.ticker = e.ticker AND p.date <= e.date) q ON true LEFT JOIN ses s ON s.ticker = e.ticker AND s.date = q.d""", "mentions", "prices"),
        "event_study_net": v(f""", {_E}, ses AS ({ses}), spy AS (SELECT date, avg(close) AS close FROM prices GROUP BY 1),
 sp AS (SELECT date, close, lead(close, 3) OVER (ORDER BY date) AS nxt FROM spy),
 f AS ({fwd}), m AS (SELECT f.*, (SELECT nxt / close - 1 FROM sp WHERE sp.date > f.date ORDER BY sp.date LIMIT 1) AS mkt FROM f),
 t AS (SELECT -1 * (ret - mkt) - (0.015e0 + 0.0015e0) AS net FROM m WHERE ret IS NOT NULL AND mkt IS NOT NULL)
 SELECT -1 AS side, count(*) AS n, {r('avg(net)', 6)} AS mean, {r('avg(CASE WHEN net > 0 THEN 1.0e0 ELSE 0.0e0 END)', 4)} AS win,
 {r('avg(net) / (stddev_pop(net) / sqrt(count(*)))', 4)} AS t, {r('avg(net) / stddev_pop(net) * sqrt(84)', 4)} AS sharpe FROM t""", "mentions", "prices"),
        "ticker_extract": v(f""", t AS (SELECT id, CASE WHEN id % 3 = 0 THEN '$' ELSE '' END || translate(coalesce(selftext, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS x FROM posts),
 l AS (SELECT id, list_distinct(list_concat(list_transform(list_filter(regexp_extract_all(x, '\\$[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '.[A-Z]{{1,5}}') AND w <> '$THE'), lambda w: w[2:]),
 list_filter(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ('IN', 'ON', 'OF', 'TH', 'RE')))) AS l FROM t)
 SELECT id, array_to_string(list_sort(l), ',') AS tickers FROM l""", "posts"),
        "keyword_counts": v(f", w AS (SELECT unnest({words.format(n=3)}) AS word FROM posts) SELECT word, count(*) AS n FROM w WHERE word NOT IN ({', '.join(repr(x) for x in catalog.STOP)}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50", "posts"),
        "lexicon_sentiment": sentiment,
        "sentiment_distribution": f"SELECT label, count(*) AS n FROM ({sentiment}) GROUP BY 1",
        "phrase_search": v(f""", t AS (SELECT id, {toks} AS w FROM posts), h AS (SELECT id, len(w) AS l, (length(x) - length(replace(x, ' of  the ', ''))) // 9 AS f FROM (SELECT *, ' ' || array_to_string(w, '  ') || ' ' AS x FROM t)),
 s AS (SELECT count(*) AS n, count(*) FILTER (WHERE f > 0) AS hits, avg(l) AS mean FROM h)
 SELECT id, {r('greatest(1e-6, ln((n - hits + 0.5e0) / (hits + 0.5e0))) * f * 2.2e0 / (f + 1.2e0 * (0.25e0 + 0.75e0 * l / mean))', 6)} AS score FROM h, s WHERE f > 0 ORDER BY 2 DESC, 1 LIMIT 50""", "posts"),
        "reply_edges": v(""", a AS (SELECT 't1_' || comment_id AS parent_id, author FROM comments UNION ALL SELECT 't3_' || id, author FROM posts)
 SELECT c.author AS src, a.author AS dst, count(*) AS weight FROM comments c JOIN a USING (parent_id) WHERE c.author <> a.author GROUP BY 1, 2""", "comments", "posts"),
        "cooccurrence_lift": v(f""", t AS (SELECT DISTINCT thread, ticker FROM ({board._THREADS}) WHERE thread IS NOT NULL),
 c AS (SELECT * FROM t WHERE thread IN (SELECT thread FROM t GROUP BY thread HAVING count(*) <= 15)),
 q AS (SELECT ticker, count(*) AS f FROM c GROUP BY 1), n AS (SELECT count(DISTINCT thread) AS n FROM c),
 p AS (SELECT a.ticker AS a, b.ticker AS b, count(*) AS c FROM c a JOIN c b ON a.thread = b.thread AND a.ticker < b.ticker GROUP BY 1, 2 HAVING count(*) >= 3)
 SELECT a, b, c, {r('c * n / CAST(x.f * y.f AS DOUBLE)', 3)} AS lift FROM p JOIN q x ON a = x.ticker JOIN q y ON b = y.ticker, n WHERE c * n / CAST(x.f * y.f AS DOUBLE) >= 1.3""", "mentions", "comments"),
        "lead_lag": v(f""", d AS (SELECT ticker, CAST(created_utc AS DATE) AS date, count(*) AS x FROM mentions GROUP BY 1, 2), k AS (SELECT ticker FROM d GROUP BY 1 HAVING sum(x) >= 10),
 o AS (SELECT date, row_number() OVER (ORDER BY date) AS ord FROM (SELECT DISTINCT date FROM d)),
 g AS (SELECT k.ticker, ord, CAST(coalesce(x, 0) AS DOUBLE) AS x FROM k CROSS JOIN o LEFT JOIN d ON d.ticker = k.ticker AND d.date = o.date),
 c AS (SELECT a.ticker AS a, b.ticker AS b, lag, count(*) AS n, sum(a.x) AS p, sum(b.x) AS q, sum(a.x * a.x) AS pp, sum(b.x * b.x) AS qq, sum(a.x * b.x) AS pq
 FROM g a, (SELECT unnest(range(1, 6)) AS lag), g b WHERE b.ord = a.ord + lag AND a.ticker <> b.ticker GROUP BY 1, 2, 3),
 z AS (SELECT a, b, lag, {r('coalesce((n * pq - p * q) / sqrt(nullif((n * pp - p * p) * (n * qq - q * q), 0)), 0)', 6)} AS corr FROM c)
 SELECT a, b, lag, corr FROM z WHERE corr >= 0.2 QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY corr DESC, lag) = 1""", "mentions"),
    }
