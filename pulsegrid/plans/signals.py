"""Queries on live states, screens, authors and coordination, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import features, market, mentions, signals, studies
from pulsegrid.plans import catalog
from pulsegrid.sources import fixtures as S

AS_OF = S.AS_OF


def _percentiles(s, d):
    p = features.trailing_percentile(features.aggregate_daily(S.mentions(s, d), S.authors(s, d)), 10, 5, 20)
    return p.select("date", F.col("rrai_pct").alias("pct"))


def _vix(s, d):
    return S.prices(s, d).where("ticker = 'T00'").select("date", (F.col("close") / 8).alias("close"))


def state(s, d):
    return signals.capitulation(_percentiles(s, d), _vix(s, d), low=1.0, least_vix=10.0)


def fear_attention(s, d):
    """Daily attention to a set of tickers."""
    return S.mentions(s, d).where(F.startswith("ticker", F.lit("T0"))).groupBy(F.lit("fear").alias("ticker"), F.to_date("created_utc").alias("date")).agg(F.count(F.lit(1)).alias("volume"))


def _strategy(s, d):
    z = studies.trailing_z(fear_attention(s, d), "volume", 30, 10).agg(F.max_by("z", "date").alias("z"))
    rows = [("SPY", "index", True), ("QQQ", "index", True), ("AUDJPY", "fx", False), ("GOLD", "metal", False)]
    return signals.strategy_signals(state(s, d), s.createDataFrame(rows, "symbol string, asset string, gated boolean"), z)


def _universes(s, d):
    t = S.mentions(s, d, True).select("ticker").distinct()
    n = F.substring("ticker", 2, 2).cast("int")
    return t.where(n % 2 == 0).select(F.lit("smallcap").alias("universe"), "ticker").unionByName(t.where(n % 3 == 0).select(F.lit("biotech").alias("universe"), "ticker"))


RULES = [
    ("smallcap_pump_fade", "short", "per_author >= 2 AND mentions >= 8", "smallcap", 40, 12),
    ("biotech_catalyst", "long", "per_author >= 1.5 AND mentions >= 5", "biotech", 60, 8),
    ("attention_fade", "short", "mentions_z >= 0.5 AND concentration <= 0.5 AND breadth >= 3", None, 40, 10),
]


def _features(s, d):
    return features.feature_daily(S.mentions(s, d, True), S.authors(s, d))


def profiles(s, d):
    c = S.table(s, d, "customer")
    extra = c.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("username"), F.floor(F.abs("c_acctbal") * 3).cast("long").alias("total_karma"), (F.col("c_custkey") % 10 == 0).alias("is_mod"), (F.col("c_custkey") % 3 > 0).alias("fetched"))
    return S.authors(s, d).join(extra, "username")


def _calls(s, d):
    return S.mentions(s, d).select(F.col("source_id").alias("id"), "author", "ticker", F.to_date("created_utc").alias("date"))


def _hits(s, d):
    return signals.hit_rate(studies.return_from(_calls(s, d), S.prices(s, d), 5))


def _credible(s, d):
    m = S.mentions(s, d)
    activity = S.posts(s, d).select("author", F.col("created_utc").alias("at"))
    return signals.credibility(m, activity, profiles(s, d), mentions.prescience(m), _hits(s, d))


def _texts(s, d):
    """The mentions of two weeks with the texts they stand in: of posts title and body, of comments the body."""
    m = mentions.since(S.mentions(s, d, True), S.AS_OF, 14 * 24)
    n = F.col("source_id").cast("long")
    key = F.when(F.col("source_type") == "post", (n % 900).cast("string")).otherwise(F.concat_ws("_", (n % 150).cast("string"), (n % 7).cast("string")))
    posted = S.posts(s, d).select(F.lit("post").alias("source_type"), F.col("id").cast("string").alias("key"), F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("selftext", F.lit(""))).alias("text"))
    said = S.comments(s, d).select(F.lit("comment").alias("source_type"), F.col("comment_id").alias("key"), F.col("body").alias("text"))
    return m.withColumn("key", key).join(posted.unionByName(said), ["source_type", "key"], "left").drop("key")


def _by_universe(s, d):
    e = S.mentions(s, d, True).select("source_id", "ticker", F.col("sentiment_score").alias("x"))
    return signals.by_universe(e, _universes(s, d), "x")


QUERIES = {
    "capitulation_state": state,
    "fear_attention": lambda s, d: fear_attention(s, d).select("date", "volume"),
    "strategy_signals": _strategy,
    "screens": lambda s, d: signals.screens(_features(s, d), _universes(s, d), RULES),
    "calendar_overlay": lambda s, d: S.mentions(s, d).select(F.to_date("created_utc").alias("date")).distinct().select("date", signals.calendar_overlay(F.col("date")).alias("o")).select("date", "o.*"),
    "results_by_universe": _by_universe,
    "author_hit_rate": _hits,
    "author_credibility": _credible,
    "near_author_pairs": lambda s, d: signals.near_pairs(S.mentions(s, d), 3600),
    "coordination_detail": lambda s, d: signals.coordination(_texts(s, d), S.authors(s, d), 1800),
    "momentum_ranked": lambda s, d: mentions.momentum_ranked(S.mentions(s, d), 20, 30),
    "pump_ranked": lambda s, d: mentions.pump_suspects(S.mentions(s, d), S.authors(s, d), AS_OF, 24 * 14, 10).orderBy(F.desc("suspicion"), "ticker").limit(30),
    "fresh_pump_ranked": lambda s, d: mentions.fresh_pumps(S.mentions(s, d), S.authors(s, d), AS_OF, 48, 14, 3, 1.0, 1.2, 20),
    "squeeze_ranked": lambda s, d: market.squeeze_ranked(catalog._short_volume(s, d).join(_total_volume(s, d), ["ticker", "date"]), 20, 0.5, 20.0, 30, 15),
    "distribution_events": lambda s, d: _distribution(s, d),
}


def _total_volume(s, d):
    li = S.table(s, d, "lineitem")
    return li.groupBy(F.concat(F.lit("P"), (F.col("l_partkey") % 50).cast("string")).alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").cast("double").alias("volume"))


def _distribution(s, d):
    """Concentrated, euphoric ticker-days that fell over five sessions and whose trail of new authors is known."""
    f = _features(s, d).join(features.recruitment(S.mentions(s, d, True)).select("ticker", "date", "new_frac_trail"), ["ticker", "date"]).where("new_frac_trail is not null")
    tr = market.trailing_return(f.select(F.concat(F.lit("T"), F.substring("ticker", 2, 2)).alias("ticker"), "date").distinct(), S.prices(s, d), 5).select(F.concat(F.lit("C"), F.substring("ticker", 2, 2)).alias("ticker"), "date", "ret")
    hit = (F.col("per_author") >= 1.5) & (F.col("mentions") >= 10) & (F.col("sentiment") >= 0.0) & ~F.col("ticker").isin("C03")
    return f.where(hit).join(tr.where("ret < 0"), ["ticker", "date"]).select("ticker", "date", "mentions", "new_frac_trail")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    v = S.with_views
    known = catalog.oracle_sql()
    f, pct = known["feature_daily_concentrated"], known["rrai_percentile"]
    state_sql = v(f""", p AS (SELECT date, rrai_pct AS pct FROM ({pct}) WHERE rrai_pct IS NOT NULL), x AS (SELECT arg_max(close / 8, date) AS vix FROM prices WHERE ticker = 'T00'),
 l AS (SELECT max(date) AS as_of, arg_max(pct, date) AS p FROM p)
 SELECT as_of, round(p + 1e-9, 4) AS pct, round(vix + 1e-9, 2) AS vix, vix >= 10 AS vix_gate, p <= 1.0e0 AND vix >= 10 AS active, round(greatest(0.0e0, least(1.0e0, (0.2e0 - p) / 0.2e0)) + 1e-9, 2) AS strength,
 p >= 0.85e0 AS euphoria, round(greatest(0.0e0, least(1.0e0, (p - 0.8e0) / 0.2e0)) + 1e-9, 2) AS strength_e FROM l, x""", "prices")
    fear = "SELECT CAST(created_utc AS DATE) AS date, count(*) AS volume FROM mentions WHERE ticker LIKE 'T0%' GROUP BY 1"
    uni = """SELECT 'smallcap' AS universe, t AS ticker FROM (SELECT DISTINCT ticker AS t FROM mentions_conc) WHERE CAST(substr(t, 2) AS INT) % 2 = 0
 UNION ALL SELECT 'biotech', t FROM (SELECT DISTINCT ticker AS t FROM mentions_conc) WHERE CAST(substr(t, 2) AS INT) % 3 = 0"""
    order = "ORDER BY date DESC, mentions_z DESC NULLS LAST, ticker"

    def screen(name, side, condition, universe, looked, given):
        keep = f" WHERE ticker IN (SELECT ticker FROM u WHERE universe = '{universe}')" if universe else ""
        return f"SELECT * FROM (SELECT '{name}' AS screen, '{side}' AS side, ticker, date FROM (SELECT * FROM f WHERE {condition} AND date >= (SELECT max(date) FROM f) - 4 {order} LIMIT {looked}){keep} {order} LIMIT {given})"

    hits = """SELECT author, count(*) AS scored, round(avg(ret) + 1e-9, 4) AS avg_return, round(avg(CASE WHEN ret > 0 THEN 1.0e0 ELSE 0 END) + 1e-9, 3) AS win_rate
 FROM (SELECT m.author, s.nxt / s.close - 1 AS ret FROM mentions m ASOF JOIN (SELECT *, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) AS nxt FROM prices) s ON m.ticker = s.ticker AND CAST(m.created_utc AS DATE) <= s.date) WHERE ret IS NOT NULL GROUP BY 1"""
    pairs = """SELECT DISTINCT a.ticker, a.author AS a, b.author AS b FROM {m} a JOIN {m} b ON a.ticker = b.ticker AND a.author < b.author AND abs(epoch(a.created_utc) // 1 - epoch(b.created_utc) // 1) <= {n}"""
    seven = "CAST(created_utc AS DATE)"
    return {
        "capitulation_state": state_sql,
        "fear_attention": v(fear, "mentions"),
        "strategy_signals": v(f""", st AS ({state_sql}), fe AS ({fear}), z AS (SELECT date, CASE WHEN count(*) OVER w < 10 THEN 0 ELSE (volume - avg(volume) OVER w) / CASE WHEN round(stddev_pop(volume) OVER w, 9) = 0 THEN 1 ELSE round(stddev_pop(volume) OVER w, 9) END END AS z FROM fe WINDOW w AS (ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
 i AS (SELECT * FROM (VALUES ('SPY', 'index', true), ('QQQ', 'index', true), ('AUDJPY', 'fx', false), ('GOLD', 'metal', false)) t(symbol, asset, gated))
 SELECT symbol, asset, 'long' AS side, strength, 10 AS horizon_days FROM st, i WHERE active AND (NOT gated OR (SELECT round(arg_max(z, date) + 1e-9, 4) FROM z) >= 0.5)""", "mentions"),
        "screens": v(f", f AS ({f}), u AS ({uni}) " + " UNION ALL ".join(screen(*x) for x in RULES), "mentions_conc"),
        "calendar_overlay": v(f""", t AS (SELECT DISTINCT {seven} AS date FROM mentions) SELECT date, CASE WHEN day(date) <= 3 OR day(date) >= 26 THEN 'turn_of_month' ELSE 'mid_month' END AS flag,
 CASE WHEN month(date) IN (2, 3, 9) THEN 'weak' ELSE 'ok' END AS seasonal, CASE WHEN month(date) IN (2, 3, 9) THEN 'risk-off tilt' WHEN day(date) <= 3 OR day(date) >= 26 THEN 'risk-on tilt' ELSE 'neutral' END AS bias FROM t""", "mentions"),
        "results_by_universe": v(f", u AS ({uni}) SELECT universe, count(*) AS n, round(avg(sentiment_score) + 1e-9, 6) AS mean FROM mentions_conc JOIN u USING (ticker) GROUP BY 1", "mentions_conc"),
        "author_hit_rate": v(hits, "mentions", "prices"),
        "author_credibility": v(f""", h AS ({hits}), e AS ({known["prescience_rank"]}),
 m AS (SELECT author, count(*) AS n, count(DISTINCT ticker) AS tickers, count(DISTINCT subreddit) AS subs, stddev_pop(sentiment_score) AS sd, avg(sentiment_score) AS mean FROM mentions GROUP BY 1),
 s AS (SELECT author, (epoch(max(created_utc)) - epoch(min(created_utc))) / 86400 AS span FROM posts GROUP BY 1),
 c AS (SELECT username, account_age_days AS age, CAST(floor(abs(c_acctbal) * 3) AS BIGINT) AS karma, c_custkey % 10 = 0 AS is_mod, c_custkey % 3 > 0 AS fetched FROM authors JOIN customer ON username = 'u' || c_custkey),
 x AS (SELECT m.*, span, age, karma, is_mod, fetched, earliness, coalesce(scored >= 5, false) AS ok, avg_return FROM m LEFT JOIN s USING (author) LEFT JOIN c ON username = m.author LEFT JOIN e ON e.author = m.author LEFT JOIN h ON h.author = m.author),
 y AS (SELECT author, n, list_filter([CASE WHEN ok AND avg_return > 0.02 THEN 'positive track record' END, CASE WHEN earliness >= 0.6 AND n >= 5 THEN 'early mover' END, CASE WHEN is_mod THEN 'moderator' END,
 CASE WHEN age > 730 THEN 'account >2y' END, CASE WHEN karma > 10000 THEN 'high karma' END, CASE WHEN tickers >= 8 THEN 'diverse coverage' END], lambda q: q IS NOT NULL) AS a,
 list_filter([CASE WHEN ok AND avg_return < -0.02 THEN 'negative track record' END, CASE WHEN span < 2 AND n >= 5 THEN 'burst activity' END, CASE WHEN tickers = 1 AND n >= 5 THEN 'single-ticker' END,
 CASE WHEN round(sd, 9) < 0.05 AND mean > 0.3 AND n >= 5 THEN 'uniformly bullish' END, CASE WHEN subs = 1 AND n >= 5 THEN 'single-subreddit' END, CASE WHEN age < 30 THEN 'account <30d' END, CASE WHEN karma < 50 THEN 'very low karma' END], lambda q: q IS NOT NULL) AS b,
 round(least(1.0e0, least(n, 20) / 20 * 0.5e0 + CASE WHEN fetched THEN 0.3e0 ELSE 0 END + CASE WHEN ok THEN 0.2e0 ELSE 0 END) + 1e-9, 2) AS confidence FROM x),
 w AS (SELECT *, greatest(-1.0e0, least(1.0e0, round(coalesce(list_sum(list_transform(a, lambda q: CASE q WHEN 'positive track record' THEN 0.35e0 WHEN 'early mover' THEN 0.25e0 WHEN 'moderator' THEN 0.15e0 ELSE 0.1e0 END)), 0)
 - coalesce(list_sum(list_transform(b, lambda q: CASE q WHEN 'negative track record' THEN 0.4e0 WHEN 'burst activity' THEN 0.3e0 WHEN 'single-ticker' THEN 0.25e0 WHEN 'uniformly bullish' THEN 0.2e0 WHEN 'very low karma' THEN 0.1e0 ELSE 0.15e0 END)), 0) + 1e-9, 3))) AS score FROM y)
 SELECT author, n, score, confidence, CASE WHEN score >= 0.4 AND confidence >= 0.5 THEN 'qualify_in' WHEN score <= -0.4 AND confidence >= 0.4 THEN 'qualify_out' ELSE 'neutral' END AS verdict,
 array_to_string(a, ',') AS in_flags, array_to_string(b, ',') AS out_flags FROM w""", "mentions", "prices", "posts", "authors"),
        "near_author_pairs": v(pairs.format(m="mentions", n=3600), "mentions"),
        "coordination_detail": v(f""", x1 AS (SELECT 'post' AS source_type, CAST(id AS VARCHAR) AS key, coalesce(title, '') || ' ' || coalesce(selftext, '') AS text FROM posts UNION ALL SELECT 'comment', comment_id, body FROM comments),
 x2 AS (SELECT *, CASE WHEN source_type = 'post' THEN CAST(CAST(source_id AS BIGINT) % 900 AS VARCHAR) ELSE (CAST(source_id AS BIGINT) % 150) || '_' || (CAST(source_id AS BIGINT) % 7) END AS key FROM mentions_conc
 WHERE created_utc >= TIMESTAMP '{AS_OF}' - INTERVAL 336 HOURS AND created_utc < TIMESTAMP '{AS_OF}'),
 t AS (SELECT x2.* EXCLUDE (key), nullif(substr(trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g')), 1, 300), '') AS text FROM x2 LEFT JOIN x1 USING (source_type, key)), p AS ({pairs.format(m="t", n=1800)}),
 q AS (SELECT ticker, a, b FROM p UNION SELECT ticker, b, a FROM p UNION SELECT ticker, a, a FROM p UNION SELECT ticker, b, b FROM p),
 q2 AS (SELECT DISTINCT x.ticker, x.a, y.b FROM q x JOIN q y ON x.ticker = y.ticker AND x.b = y.a), q4 AS (SELECT DISTINCT x.ticker, x.a, y.b FROM q2 x JOIN q2 y ON x.ticker = y.ticker AND x.b = y.a),
 q8 AS (SELECT DISTINCT x.ticker, x.a, y.b FROM q4 x JOIN q4 y ON x.ticker = y.ticker AND x.b = y.a),
 k AS (SELECT ticker, max(c) AS cluster FROM (SELECT ticker, a, count(*) AS c FROM q8 GROUP BY 1, 2) GROUP BY 1),
 n AS (SELECT ticker, count(*) AS n, count(DISTINCT author) AS authors FROM t GROUP BY 1),
 h AS (SELECT ticker, max(c) AS peak FROM (SELECT ticker, date_trunc('hour', created_utc), count(*) AS c FROM t GROUP BY 1, 2) GROUP BY 1),
 d AS (SELECT ticker, sum(c) FILTER (WHERE c > 1) / sum(c) AS dup FROM (SELECT ticker, text, count(*) AS c FROM t WHERE text IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
 g AS (SELECT ticker, avg(CASE WHEN account_age_days < 30 THEN 1.0e0 ELSE 0 END) AS fresh FROM (SELECT DISTINCT ticker, author FROM t) JOIN authors ON username = author WHERE account_age_days IS NOT NULL GROUP BY 1),
 x AS (SELECT n.ticker, n, authors, n / authors AS pa, peak / n AS burst, coalesce(dup, 0) AS dup, coalesce(cluster, 0) / authors AS dense, fresh FROM n JOIN h USING (ticker) LEFT JOIN d USING (ticker) LEFT JOIN k USING (ticker) LEFT JOIN g USING (ticker)),
 y AS (SELECT *, CAST(pa >= 5 AS INT) + CAST(burst >= 0.5 AND n >= 10 AS INT) + CAST(dup >= 0.2 AS INT) + CAST(dense >= 0.5 AND authors >= 4 AS INT) + CAST(coalesce(fresh >= 0.4, false) AND authors >= 4 AS INT) AS marks FROM x)
 SELECT ticker, n, authors, round(pa + 1e-9, 1) AS per_author, round(burst + 1e-9, 2) AS burst, round(dup + 1e-9, 2) AS duplicate, round(dense + 1e-9, 2) AS cluster, round(fresh + 1e-9, 2) AS fresh, marks, marks >= 2 AS suspected FROM y""", "mentions_conc", "authors", "posts", "comments"),
        "momentum_ranked": v(f""", d AS (SELECT ticker, {seven} AS d, count(*) AS n, sum(sentiment_score) AS s FROM mentions GROUP BY 1, 2), l AS (SELECT max(d) AS last FROM d),
 g AS (SELECT ticker, CAST(sum(n) AS BIGINT) AS total, avg(n) AS mean, stddev_pop(n) AS sd, max(n) FILTER (WHERE d = last) AS latest, sum(s) / sum(n) AS sent FROM d, l GROUP BY 1 HAVING sum(n) >= 20)
 SELECT ticker, total, round(mean + 1e-9, 3) AS mean, latest, round((latest - mean) / nullif(sd, 0) + 1e-9, 3) AS z, round(sent + 1e-9, 4) AS avg_sentiment FROM g WHERE latest IS NOT NULL ORDER BY z DESC NULLS LAST, total DESC, ticker LIMIT 30""", "mentions"),
        "pump_ranked": f"SELECT * FROM ({known['pump_suspects']}) ORDER BY suspicion DESC, ticker LIMIT 30",
        "fresh_pump_ranked": v(f""", r AS (SELECT ticker, count(*) AS rc, count(DISTINCT author) AS authors, avg(CASE WHEN account_status IN ('deleted', 'suspended') THEN 1.0e0 ELSE 0 END) AS gone,
 avg(CASE WHEN account_age_days <= 365 THEN 1.0e0 ELSE 0 END) AS young, avg(sentiment_score) AS sent FROM mentions LEFT JOIN authors ON username = author
 WHERE created_utc >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOURS AND created_utc < TIMESTAMP '{AS_OF}' AND author NOT IN ('[deleted]', 'AutoModerator') GROUP BY 1 HAVING count(*) >= 3 AND count(*) >= count(DISTINCT author)),
 b AS (SELECT ticker, count(*) AS bc FROM mentions WHERE created_utc >= TIMESTAMP '{AS_OF}' - INTERVAL 336 HOURS AND created_utc < TIMESTAMP '{AS_OF}' - INTERVAL 48 HOURS AND author NOT IN ('[deleted]', 'AutoModerator') GROUP BY 1),
 j AS (SELECT r.*, coalesce(bc, 0) AS bc, (rc / 2.0e0) / nullif(coalesce(bc, 0) / 12.0e0, 0) AS x FROM r LEFT JOIN b USING (ticker))
 SELECT ticker, rc, authors, bc, bc = 0 AS fresh, round(x + 1e-9, 3) AS burst, round(rc / authors + 1e-9, 2) AS per_author, round(gone + 1e-9, 3) AS gone_frac, round(young + 1e-9, 3) AS young_frac, round(sent + 1e-9, 4) AS avg_sentiment
 FROM j WHERE bc = 0 OR x >= 1.2 ORDER BY bc = 0 DESC, round(rc / authors + 1e-9, 2) * rc DESC, ticker LIMIT 20""", "mentions", "authors"),
        "squeeze_ranked": f"""WITH v AS (SELECT 'P' || (l_partkey % 50) AS ticker, CAST(l_shipdate AS DATE) AS date, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) + 1e-9, 4) AS x, sum(l_quantity) AS vol FROM lineitem GROUP BY 1, 2),
 n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM v),
 g AS (SELECT ticker, count(*) AS days, max(date) AS last, max(x) FILTER (WHERE n = 1) AS latest, max(vol) FILTER (WHERE n = 1) AS vol, avg(x) FILTER (WHERE n > 1) AS m, round(stddev_pop(x) FILTER (WHERE n > 1), 9) AS sd FROM n GROUP BY 1 HAVING count(*) >= 20),
 z AS (SELECT *, (latest - m) / CASE WHEN sd = 0 THEN 1e-9 ELSE sd END AS z FROM g)
 SELECT ticker, days, round(latest, 4) AS latest, round(z + 1e-9, 3) AS z FROM z WHERE z >= 0.5 AND vol >= 20 AND last >= (SELECT max(date) FROM v) - 30 ORDER BY round(z + 1e-9, 3) DESC, ticker LIMIT 15""",
        "distribution_events": v(f""", f AS ({f}), nf AS ({known["recruitment_features"].replace("FROM mentions", "FROM mentions_conc")}), ses AS (SELECT ticker, date, close, lag(close, 5) OVER (PARTITION BY ticker ORDER BY date) AS prv FROM prices),
 j AS (SELECT f.*, new_frac_trail FROM f JOIN nf USING (ticker, date) WHERE new_frac_trail IS NOT NULL AND per_author >= 1.5 AND f.mentions >= 10 AND sentiment >= 0 AND ticker <> 'C03')
 SELECT j.ticker, j.date, j.mentions, new_frac_trail FROM j ASOF JOIN ses s ON s.ticker = 'T' || substr(j.ticker, 2, 2) AND j.date >= s.date WHERE s.prv > 0 AND s.close / s.prv - 1 < 0""", "prices", "mentions_conc"),
    }
