"""Queries on lookups, work lists, predicates and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.functions import text as T
from pulsegrid.operators import lookups as L
from pulsegrid.operators import posts, writes
from pulsegrid.plans import catalog
from pulsegrid.sources import fixtures as S

AS_OF = S.AS_OF
BOTS = ["[deleted]", "AutoModerator"]


def _jobs(s, d):
    o = S.table(s, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("target"), status.alias("status"), F.to_date("o_orderdate").alias("started"))


_JOBS = """SELECT o_orderkey AS id, o_orderpriority AS target, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
 CAST(o_orderdate AS DATE) AS started FROM orders"""


def _checked(s, d):
    """Authors with the time of their last check: never for every fifth."""
    n = F.substring("username", 2, 9).cast("int")
    return S.authors(s, d).withColumn("checked_at", F.when(n % 5 > 0, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz") - F.make_dt_interval(n % 40)))


_CHECKED = "SELECT *, CASE WHEN CAST(substr(username, 2) AS INT) % 5 > 0 THEN TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(substr(username, 2) AS INT) % 40) END AS checked_at FROM authors"


def _threaded(s, d):
    """Mentions whose sources are posts and comments of the tables."""
    m = S.mentions(s, d)
    n = F.col("source_id").cast("long")
    where = F.when(F.col("source_type") == "post", (n % 900).cast("string")).otherwise(F.concat_ws("_", (n % 150).cast("string"), (n % 7).cast("string")))
    return m.withColumn("source_id", where)


_THREADED = """SELECT * REPLACE (CASE WHEN source_type = 'post' THEN CAST(CAST(source_id AS BIGINT) % 900 AS VARCHAR)
 ELSE (CAST(source_id AS BIGINT) % 150) || '_' || (CAST(source_id AS BIGINT) % 7) END AS source_id) FROM mentions"""
_THREADS = f"""SELECT m.*, CASE WHEN source_type = 'post' THEN source_id ELSE CAST(post_id AS VARCHAR) END AS thread FROM ({_THREADED}) m
 LEFT JOIN comments ON source_type = 'comment' AND comment_id = source_id"""


def _grown(s, d):
    stored = S.comments(s, d).groupBy("post_id").agg(F.count(F.lit(1)).alias("stored_rows")).withColumn("stored_count", F.col("stored_rows"))
    return L.grown(S.posts(s, d), stored).select("id", "num_comments")


def _emotes(s, d):
    p = S.posts(s, d)
    return p.select("id", L.without_emotes(F.concat(F.lit("a ![img](emote|t5|"), F.col("id").cast("string"), F.lit(") "), F.coalesce("title", F.lit("")))).alias("title"))


def _policy(s, d):
    p = S.posts(s, d).withColumn("c", F.when(F.col("id") % 9 > 0, F.col("created_utc") + F.make_dt_interval(F.lit(29))))
    return p.select("id", L.fetch_policy(F.col("c"), AS_OF).alias("p")).select("id", "p.*")


def _classes(s, d):
    c = S.table(s, d, "customer")
    sector = F.when(F.col("c_nationkey") > 2, F.col("c_mktsegment"))
    cap = F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal") * 2e6)
    return c.select(F.col("c_custkey").alias("id"), L.sector_class(sector, ["BUILDING"], ["MACHINERY", "AUTOMOBILE"], ["FURNITURE"]).alias("class"), L.micro_to_mid(cap).alias("small"))


def _tiers(s, d):
    return S.table(s, d, "part").groupBy(L.price_tier(F.when(F.col("p_partkey") % 10 > 0, (F.col("p_partkey") % 700) / 10)).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def _purged(s, d):
    """The tickers found in all texts by the old lists, and texts that are gone: taken out and set aside where the stricter lists of today find
    them no more in the text that is there."""
    p = catalog.capitals(S.posts(s, d))
    facts = p.select("id", F.explode(T.tickers(F.col("text"), catalog._symbols(), ["THE"], ["IT"])).alias("ticker"))
    kept, gone = writes.revalidated(facts, p.where("lang <> 'fr' or lang is null").select("id", "text"), "id", T.tickers(F.col("text"), catalog._symbols(), ["THE"], ["IT", "ON", "TH"]), "ticker")
    return kept.withColumn("fate", F.lit("kept")).unionByName(gone.withColumn("fate", F.lit("purged"))).groupBy("ticker", "fate").agg(F.count(F.lit(1)).alias("n"))


def _job_log(s, d):
    o = S.table(s, d, "orders").select(F.col("o_orderkey").alias("job"), F.to_timestamp_ntz(F.to_date("o_orderdate").cast("string")).alias("at"), "o_orderstatus")
    ends = o.where("o_orderstatus <> 'O'").select("job", (F.col("at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("job") % 500).cast("int"))).alias("at"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("kind"))
    return L.job_records(o.select("job", "at", F.lit("start").alias("kind")).unionByName(ends)).select("job", "status", "seconds")


def _rebuilt(s, d):
    """The rollup is written anew over an older one, and read back."""
    from pulsegrid.operators import mentions, steps

    path = f"{steps.folder(s)}/rollup-{__import__('uuid').uuid4().hex}"
    S.mentions(s, d).limit(5).groupBy("ticker").count().write.parquet(path)
    mentions.daily_rollup(S.mentions(s, d)).write.mode("overwrite").parquet(path)
    return s.read.parquet(path)


QUERIES = {
    "post_by_id": lambda s, d: L.by_key(S.posts(s, d), "id", 5).select("id", "title", "score"),
    "job_filter": lambda s, d: L.jobs(_jobs(s, d), "1-URGENT", "failed").select("id", "started"),
    "text_match": lambda s, d: L.matches(S.posts(s, d), "qu[ie]", ["title", "selftext"]).select("id"),
    "board_search": lambda s, d: L.board_search(S.posts(s, d), "an", 10, "link", "U1").select("id", "score"),
    "group_any_case": lambda s, d: S.posts(s, d).where(L.equal_in_any_case(F.col("subreddit"), "SRC3")).groupBy("subreddit").agg(F.count(F.lit(1)).alias("n")),
    "emote_titles": _emotes,
    "fetch_policy": _policy,
    "grown_posts": _grown,
    "sector_classes": _classes,
    "price_tiers": _tiers,
    "unembedded_posts": lambda s, d: L.not_in(S.posts(s, d), "id", S.table(s, d, "embeddings"), "vec_id").select("id"),
    "refresh_list": lambda s, d: L.refresh_list(S.posts(s, d), S.comments(s, d), "2024-01-03 00:00:00", 200),
    "source_list": lambda s, d: L.sources(S.posts(s, d)),
    "daily_post_counts": lambda s, d: L.daily_counts(S.posts(s, d), ["src1", "src3"]),
    "table_counts": lambda s, d: L.table_counts({t: S.table(s, d, t) for t in ("documents", "conversations", "events", "customer", "labels")}),
    "stale_authors": lambda s, d: L.stale_authors(_checked(s, d), S.mentions(s, d), AS_OF, 14, 100),
    "author_ages": lambda s, d: L.author_ages(S.authors(s, d), S.mentions(s, d).where("ticker = 'T07'")),
    "profile_queue": lambda s, d: L.profile_queue(S.mentions(s, d), S.posts(s, d), S.authors(s, d).where("substring(username, 2, 9) % 2 = 0"), BOTS, ["click"], 300),
    "board_totals": lambda s, d: L.board_totals(S.posts(s, d)),
    "busy_day_authors": lambda s, d: L.busy_days_authors(S.mentions(s, d), 8, S.authors(s, d).where("substring(username, 2, 9) % 3 = 0")),
    "cloud_sizes": lambda s, d: L.cloud_sizes(posts.keyword_counts(S.posts(s, d), ["the"], 60)),
    "mention_threads": lambda s, d: L.threads(_threaded(s, d), S.comments(s, d)).groupBy("thread").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ticker").alias("tickers")),
    "clean_threads": lambda s, d: L.clean_threads(L.threads(_threaded(s, d), S.comments(s, d)), 15),
    "job_records": _job_log,
    "rollup_rebuild": _rebuilt,
    "purge_counts": _purged,
    "latest_mention": lambda s, d: L.latest(S.mentions(s, d).withColumn("n", F.col("source_id").cast("long")), ["ticker"], "created_utc", "n").select("ticker", "source_id"),
    "top_posts": lambda s, d: S.posts(s, d).orderBy(F.desc("score"), "id").limit(10).select("id", "score"),
    "recent_posts": lambda s, d: S.posts(s, d).orderBy(F.desc("created_utc"), "id").limit(10).select("id"),
    "author_posts": lambda s, d: S.posts(s, d).where(L.equal_in_any_case(F.col("author"), "U7")).orderBy(F.desc("created_utc"), "id").select("id"),
    "largest_by_comments": lambda s, d: S.posts(s, d).orderBy(F.desc("num_comments"), F.desc("score"), "id").limit(10).select("id", "num_comments"),
    "mention_events": lambda s, d: S.mentions(s, d).select("ticker", F.to_date("created_utc").alias("date")).dropDuplicates(),
    "candidate_texts": lambda s, d: S.posts(s, d).select(F.lit("post").alias("kind"), F.col("id").cast("string").alias("id"), F.length(F.concat_ws(" ", "title", "selftext")).alias("n")).unionByName(S.comments(s, d).select(F.lit("comment").alias("kind"), F.col("comment_id").alias("id"), F.length("body").alias("n"))),
    "silent_authors": lambda s, d: S.authors(s, d).select("username").exceptAll(S.mentions(s, d).select(F.col("author").alias("username")).distinct()),
    "thirds_by_price": lambda s, d: L.hot_and_old(S.table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").groupBy("third").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low")),
    "same_texts": lambda s, d: S.posts(s, d).groupBy(T.normalised_key(F.col("selftext")).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("n").agg(F.count(F.lit(1)).alias("texts")),
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    v = S.with_views
    return {
        "post_by_id": v("SELECT id, title, score FROM posts WHERE id = 5", "posts"),
        "job_filter": f"SELECT id, started FROM ({_JOBS}) WHERE target = '1-URGENT' AND status = 'failed'",
        "text_match": v("SELECT id FROM posts WHERE coalesce(regexp_matches(title, 'qu[ie]', 'i'), false) OR coalesce(regexp_matches(selftext, 'qu[ie]', 'i'), false)", "posts"),
        "board_search": v("SELECT id, score FROM posts WHERE contains(lower(concat_ws(' ', title, selftext)), 'an') AND score >= 10 AND post_type = 'link' AND contains(author, 'u1') ORDER BY score DESC, id LIMIT 50", "posts"),
        "group_any_case": v("SELECT subreddit, count(*) AS n FROM posts WHERE lower(subreddit) = 'src3' GROUP BY 1", "posts"),
        "emote_titles": v("SELECT id, 'a [emote: t5|' || id || '] ' || coalesce(title, '') AS title FROM posts", "posts"),
        "fetch_policy": v(""", a AS (SELECT id, id % 9 > 0 AND epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(created_utc + INTERVAL 29 DAY) <= 48 * 3600 AS fresh FROM posts)
 SELECT id, CASE WHEN NOT fresh THEN 'top' END AS sort, CASE WHEN fresh THEN 10 ELSE 3 END AS max_depth, CASE WHEN fresh THEN 0 ELSE 5 END AS min_score FROM a""", "posts"),
        "grown_posts": v("SELECT id, num_comments FROM posts WHERE num_comments > (SELECT count(*) FROM comments WHERE post_id = id)", "posts", "comments"),
        "sector_classes": """SELECT c_custkey AS id, CASE WHEN c_nationkey <= 2 THEN '?' WHEN c_mktsegment = 'BUILDING' THEN 'AVOID' WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN 'PREFERRED'
 WHEN c_mktsegment = 'FURNITURE' THEN 'WEAK' ELSE 'OK' END AS class, c_custkey % 4 = 0 OR c_acctbal < 5000 AS small FROM customer""",
        "price_tiers": """SELECT CASE WHEN p_partkey % 10 = 0 THEN '?' WHEN p_partkey % 700 < 20 THEN 'SKIP' WHEN p_partkey % 700 < 50 THEN 'THIN' WHEN p_partkey % 700 <= 500 THEN 'TRADE' ELSE 'VERIFY' END AS tier,
 count(*) AS n FROM part GROUP BY 1""",
        "unembedded_posts": "SELECT doc_id AS id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)",
        "refresh_list": v("SELECT id, num_comments, (SELECT count(*) FROM comments WHERE post_id = id) AS stored, created_utc FROM posts WHERE created_utc >= TIMESTAMP '2024-01-03 00:00:00' ORDER BY created_utc DESC, id LIMIT 200", "posts", "comments"),
        "source_list": v("SELECT subreddit, count(*) AS posts, min(created_utc) AS first, max(created_utc) AS last FROM posts GROUP BY 1", "posts"),
        "daily_post_counts": v("SELECT subreddit AS target, CAST(created_utc AS DATE) AS date, count(*) AS n FROM posts WHERE subreddit IN ('src1', 'src3') GROUP BY 1, 2", "posts"),
        "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in ("documents", "conversations", "events", "customer", "labels")),
        "stale_authors": v(f""", k AS ({_CHECKED}) SELECT username, (SELECT max(created_utc) FROM mentions WHERE author = username) AS last_mention FROM k
 WHERE account_status = 'active' AND (checked_at IS NULL OR checked_at < TIMESTAMP '2024-01-17 00:00:00') ORDER BY last_mention DESC NULLS LAST, username LIMIT 100""", "mentions", "authors"),
        "author_ages": v("SELECT username, account_age_days FROM authors WHERE username IN (SELECT author FROM mentions WHERE ticker = 'T07')", "mentions", "authors"),
        "profile_queue": v(""", a AS (SELECT author, 0 AS pri, count(*) AS act FROM mentions WHERE subreddit <> 'click' GROUP BY 1 UNION ALL SELECT author, 1, count(*) FROM posts GROUP BY 1),
 g AS (SELECT author, min(pri) AS pri, max(act) AS act FROM a GROUP BY 1)
 SELECT author, pri, act FROM g WHERE author NOT IN (SELECT username FROM authors WHERE CAST(substr(username, 2) AS INT) % 2 = 0) ORDER BY pri, act DESC, author LIMIT 300""", "mentions", "posts", "authors"),
        "board_totals": v("SELECT count(*) AS posts, CAST(sum(score) AS BIGINT) AS score, round(avg(score) + 1e-9, 4) AS avg_score, CAST(sum(num_comments) AS BIGINT) AS comments, count(DISTINCT author) AS authors, count(DISTINCT CAST(created_utc AS DATE)) AS days FROM posts", "posts"),
        "busy_day_authors": v(""", b AS (SELECT ticker, CAST(created_utc AS DATE) AS d FROM mentions GROUP BY 1, 2 HAVING count(*) >= 8)
 SELECT DISTINCT author FROM mentions m JOIN b ON b.ticker = m.ticker AND b.d = CAST(created_utc AS DATE) WHERE author NOT IN (SELECT username FROM authors WHERE CAST(substr(username, 2) AS INT) % 3 = 0)""", "mentions", "authors"),
        "cloud_sizes": v(r""", w AS (SELECT unnest(list_filter(regexp_extract_all(translate(coalesce(selftext, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]{3,}'))) AS word FROM posts),
 n AS (SELECT word, count(*) AS n FROM w WHERE word <> 'the' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60) SELECT word, n, CAST(floor(10 + n / max(n) OVER () * 90) AS INT) AS size FROM n""", "posts"),
        "mention_threads": v(f"SELECT thread, count(*) AS n, count(DISTINCT ticker) AS tickers FROM ({_THREADS}) WHERE thread IS NOT NULL GROUP BY 1", "mentions", "comments"),
        "clean_threads": v(f", t AS (SELECT DISTINCT thread, ticker FROM ({_THREADS}) WHERE thread IS NOT NULL) SELECT * FROM t WHERE thread IN (SELECT thread FROM t GROUP BY 1 HAVING count(*) <= 15)", "mentions", "comments"),
        "job_records": "SELECT o_orderkey AS job, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, CASE WHEN o_orderstatus <> 'O' THEN o_orderkey % 500 END AS seconds FROM orders",
        "rollup_rebuild": v("SELECT subreddit, ticker, CAST(created_utc AS DATE) AS date, count(*) AS mentions, round(avg(sentiment_score) + 1e-9, 4) AS avg_sentiment FROM mentions GROUP BY 1, 2, 3", "mentions"),
        "purge_counts": v(f""", t AS (SELECT id, lang, CASE WHEN id % 3 = 0 THEN '$' ELSE '' END || translate(coalesce(selftext, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS x FROM posts),
 c AS (SELECT id, lang, unnest(list_transform(list_filter(regexp_extract_all(x, '\\$[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '.[A-Z]{{1,5}}') AND w <> '$THE'), lambda w: w[2:])) AS ticker FROM t),
 b AS (SELECT id, lang, unnest(list_filter(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ('IN', 'ON', 'OF', 'TH', 'RE'))) AS ticker FROM t),
 f AS (SELECT * FROM c UNION SELECT * FROM b),
 g AS (SELECT f.*, coalesce(lang, '') <> 'fr' AND ticker IN ('ON', 'TH') AND (id, ticker) NOT IN (SELECT (id, ticker) FROM c) AS purged FROM f)
 SELECT ticker, CASE WHEN purged THEN 'purged' ELSE 'kept' END AS fate, count(*) AS n FROM g GROUP BY 1, 2""", "posts"),
        "latest_mention": v("SELECT ticker, source_id FROM mentions QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY created_utc DESC, CAST(source_id AS BIGINT)) = 1", "mentions"),
        "top_posts": v("SELECT id, score FROM posts ORDER BY score DESC, id LIMIT 10", "posts"),
        "recent_posts": v("SELECT id FROM posts ORDER BY created_utc DESC, id LIMIT 10", "posts"),
        "author_posts": v("SELECT id FROM posts WHERE author = 'u7'", "posts"),
        "largest_by_comments": v("SELECT id, num_comments FROM posts ORDER BY num_comments DESC, score DESC, id LIMIT 10", "posts"),
        "mention_events": v("SELECT DISTINCT ticker, CAST(created_utc AS DATE) AS date FROM mentions", "mentions"),
        "candidate_texts": v("SELECT 'post' AS kind, CAST(id AS VARCHAR) AS id, length(concat_ws(' ', title, selftext)) AS n FROM posts UNION ALL SELECT 'comment', comment_id, length(body) FROM comments", "posts", "comments"),
        "silent_authors": v("SELECT username FROM authors EXCEPT SELECT author FROM mentions", "mentions", "authors"),
        "thirds_by_price": """WITH t AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER () // 3 AS k FROM orders)
 SELECT CASE WHEN i < k THEN 1 WHEN i < 2 * k THEN 2 ELSE 3 END AS third, count(*) AS n, min(o_totalprice) AS low FROM t GROUP BY 1""",
        "same_texts": v(r", k AS (SELECT substr(regexp_replace(trim(lower(selftext)), '\s+', ' ', 'g'), 1, 300) AS key, count(*) AS n FROM posts GROUP BY 1 HAVING count(*) > 1) SELECT n, count(*) AS texts FROM k GROUP BY 1", "posts"),
    }
