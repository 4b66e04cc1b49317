"""Queries on studies of calls and trades, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.operators import features, market, studies
from pulsegrid.plans import catalog, services
from pulsegrid.sources import fixtures as S

#: Sessions that a call is held.
H = 5


def calls(s, d):
    """A call for each order: author, ticker, date and sentiment."""
    o = S.table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("P"), (F.col("o_custkey") % 50).cast("string")).alias("ticker"), F.to_date("o_orderdate").alias("date"), F.concat(F.lit("a"), (F.col("o_custkey") % 40).cast("string")).alias("author"), ((F.col("o_orderkey") % 21 - 10) / 10).alias("sentiment"), "o_totalprice")


def returns(s, d, h=H):
    return market.forward_return(calls(s, d), S.prices_long(s, d), h)


def excess_calls(s, d):
    """Each call's return over the mean return of its date, with the sign of its sentiment; a sentiment within 0.1 of 0 takes no side."""
    t = returns(s, d)
    mkt = t.groupBy("date").agg(F.avg("ret").alias("mkt"))
    side = F.when(F.col("sentiment") > 0.1, 1).when(F.col("sentiment") < -0.1, -1)
    return t.join(mkt, "date").withColumn("ex", side * (F.col("ret") - F.col("mkt")))


def trades(s, d):
    return returns(s, d).where("ret is not null").withColumn("net", -F.col("ret") - 0.004).withColumn("side", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))


def _features(s, d):
    return features.feature_daily(S.mentions(s, d, True), S.authors(s, d))


def _events(s, d):
    loose = [(n, k, c.replace(">= 3 ", ">= 1.5 ").replace("z >= 2", "z >= 0.5").replace("<= 0.15", "<= 0.6").replace("breadth >= 8", "breadth >= 3")) for n, k, c in studies.GATES]
    return studies.gated(_features(s, d), loose)


def _slate(s, d):
    e = _events(s, d).withColumn("ticker", F.concat(F.lit("T"), F.substring("ticker", 2, 2)))
    p = S.prices(s, d)
    mkt = market.forward_return(e.select("date").distinct().withColumn("ticker", F.lit("SPY")), market.benchmark(p), 3).select("date", F.col("ret").alias("mkt"))
    return studies.slate(e, p, mkt, 3, 75.0, 8.0)


def _spy(s, d):
    p = S.prices_long(s, d)
    return p.groupBy("date").agg(F.avg("close").alias("close")).withColumn("ticker", F.lit("SPY"))


def _volume(s, d):
    return catalog._short_volume(s, d)


def _configs(s):
    rows = [(f"{t}-{a}-{x}-{h}", t, a, x, h) for t in (True, False) for a in (3, 5) for x in (1.5, 3.0) for h in (5, 11)]
    return s.createDataFrame(rows, "config string, turn boolean, arm int, stop double, hold int")


def triggers(s, d):
    return calls(s, d).where("sentiment >= 0.9").select("ticker", "date").distinct()


def simulated(s, d, first=None, last=None):
    t, b = triggers(s, d), services.bars(s, d)
    if last:
        t, b = t.where(F.col("date") < last), b.where(F.col("date") < last)
    if first:
        t, b = t.where(F.col("date") >= first), b.where(F.col("date") >= first)
    return studies.simulate(b, t, _configs(s))


def _rounded(df):
    return df.select("ticker", "config", "n", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("win", "pf", "net_pct", "maxdd_pct")])


def _null(s, d):
    """The share of draws of random trigger days (as many as there are) whose mean net lies below the actual one; draws by hash."""
    t, b, one = triggers(s, d), services.bars(s, d), _configs(s).limit(1).select(F.lit("actual").alias("config"), F.lit(True).alias("turn"), F.lit(5).alias("arm"), F.lit(3.0).alias("stop"), F.lit(11).alias("hold"))
    draws = 20
    n = t.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    days = b.select("ticker", "date").join(n, "ticker").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    w = W.partitionBy("ticker", "i").orderBy(F.xxhash64("ticker", "date", "i"), "date")
    picked = days.withColumn("k", F.row_number().over(w)).where("k <= n").select("ticker", "date", F.concat(F.lit("draw"), F.col("i")).alias("config"))
    configs = picked.select("config").distinct().unionByName(one.select("config")).crossJoin(one.drop("config"))
    got = studies.simulate(b, picked.unionByName(t.withColumn("config", F.lit("actual"))), configs, least=1).groupBy("config").agg(F.avg("net_pct").alias("m"))
    actual = got.where("config = 'actual'").select(F.col("m").alias("actual"))
    return got.where("config <> 'actual'").crossJoin(F.broadcast(actual)).agg(F.count(F.lit(1)).alias("draws"), F.round(F.avg(F.when(F.col("m") < F.col("actual"), 1.0).otherwise(0.0)), 4).alias("percentile"))


def _r(c, n=6):
    return F.round(F.col(c) + 1e-9, n).alias(c)


QUERIES = {
    "return_from_day": lambda s, d: studies.return_from(calls(s, d), S.prices_long(s, d), H).select("id", "date", "session", _r("ret")),
    "gated_events": _events,
    "strategy_slate": _slate,
    "directional_excess": lambda s, d: excess_calls(s, d).select("id", _r("ex")),
    "excess_over_drift": lambda s, d: studies.excess(returns(s, d), S.prices_long(s, d), H),
    "trade_ledger": lambda s, d: studies.ledger(trades(s, d), "net", ["side"], H),
    "yearly_results": lambda s, d: market.study(trades(s, d).withColumn("year", F.year("date")), "net", H, ["year"]),
    "author_persistence": lambda s, d: studies.persistence(returns(s, d)),
    "clustered_by_date": lambda s, d: studies.clustered(trades(s, d), "net", ["side"]),
    "walk_forward_fade": lambda s, d: studies.walk_forward(excess_calls(s, d), 10, 30, 0.004, 0.0, 0.005),
    "trailing_gate": lambda s, d: studies.trailing_gate(trades(s, d), ["ticker"], "net", 10, 0.0).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("taken").cast("int")).cast("long").alias("taken")),
    "calendar_effects": lambda s, d: studies.calendar(_spy(s, d), H),
    "true_range": lambda s, d: studies.atr(services.bars(s, d), 14),
    "trailing_z": lambda s, d: studies.trailing_z(_volume(s, d), "short_ratio", 30, 10),
    "k_step_change": lambda s, d: studies.change(S.prices_long(s, d), "close", 5),
    "froth_index": lambda s, d: studies.froth_index(S.prices_long(s, d), 10, 0.05, 10),
    "short_ratio_before": lambda s, d: studies.mean_before(calls(s, d), _volume(s, d), "short_ratio", 10).select("id", _r("mean", 4)),
    "followed_by_filing": lambda s, d: studies.followed(calls(s, d).where("id % 2 = 0"), calls(s, d).where("id % 2 = 1"), 3, 9).select("id", "hit"),
    "mentions_around": lambda s, d: studies.count_around(calls(s, d).select("id", "ticker", "date"), calls(s, d).groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("n")), 5).select("id", "around"),
    "threshold_sweep": lambda s, d: studies.sweep(trades(s, d), "net", {"sentiment": [-0.5, 0.0, 0.5], "o_totalprice": [50_000.0, 150_000.0]}),
    "put_payoff": lambda s, d: trades(s, d).withColumn("put", studies.option_net(F.col("ret"), 0.05)).groupBy("ticker").agg(F.round(F.avg("put") + 1e-9, 6).alias("put")),
    "trades_per_day": lambda s, d: trades(s, d).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ticker").alias("tickers")),
    "bar_simulation": lambda s, d: _rounded(simulated(s, d)),
    "grid_out_of_sample": lambda s, d: studies.best_in_sample(simulated(s, d, last="1996-01-01"), simulated(s, d, first="1996-01-01"), 5),
    "simulation_null": _null,
}


def queries() -> dict:
    return dict(QUERIES)


_CALLS = """SELECT o_orderkey AS id, 'P' || (o_custkey % 50) AS ticker, CAST(o_orderdate AS DATE) AS date, 'a' || (o_custkey % 40) AS author,
 (o_orderkey % 21 - 10) / 10.0e0 AS sentiment, o_totalprice FROM orders"""
_BASE = f"""calls AS ({_CALLS}), ses AS (SELECT *, lead(close, {H}) OVER w AS nxt, lag(close, 10) OVER w AS back, row_number() OVER w AS ord FROM prices_long WINDOW w AS (PARTITION BY ticker ORDER BY date)),
 rets AS (SELECT calls.*, s.date AS session, CASE WHEN s.close > 0 THEN s.nxt / s.close - 1 END AS ret FROM calls ASOF LEFT JOIN ses s ON calls.ticker = s.ticker AND calls.date < s.date),
 trades AS (SELECT *, -ret - 0.004e0 AS net, CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS side FROM rets WHERE ret IS NOT NULL),
 exc AS (SELECT *, CASE WHEN sentiment > 0.1 THEN 1 WHEN sentiment < -0.1 THEN -1 END * (ret - avg(ret) OVER (PARTITION BY date)) AS ex FROM rets)"""
_STUDY = "count(*) AS n, round(avg(net) + 1e-9, 6) AS mean, round(avg(CASE WHEN net > 0 THEN 1.0e0 ELSE 0.0e0 END) + 1e-9, 4) AS win, round(avg(net) / (stddev_pop(net) / sqrt(count(*))) + 1e-9, 4) AS t"


def oracle_sql() -> dict[str, str]:
    """The simulations have none: tests hold them against a plain loop."""

    def v(body: str, *more: str) -> str:
        return S.with_views(f", {_BASE}{body}", "prices_long", *more)

    f = catalog.oracle_sql()["feature_daily_concentrated"]
    hits = " UNION ALL ".join(f"SELECT '{n}' AS strategy, {k} AS side, ticker, date FROM f WHERE {c}" for n, k, c in (
        ("pump_long", 1, "per_author >= 1.5 AND mentions >= 10 AND mentions_z >= 0.5"), ("dump_fade", -1, "per_author >= 1.5 AND mentions >= 10 AND accel < 0"),
        ("organic", 1, "mentions_z >= 0.5 AND concentration <= 0.6 AND breadth >= 3"), ("fade_organic", -1, "mentions_z >= 0.5 AND concentration <= 0.6 AND breadth >= 3"),
        ("deletion", -1, "per_author >= 1.5 AND mentions >= 10 AND gone_frac >= 0.10")))
    return {
        "return_from_day": S.with_views(f", {_BASE} SELECT c.id, c.date, s.date AS session, round(CASE WHEN s.close > 0 THEN s.nxt / s.close - 1 END + 1e-9, 6) AS ret FROM calls c ASOF LEFT JOIN ses s ON c.ticker = s.ticker AND c.date <= s.date", "prices_long"),
        "gated_events": f"WITH f AS ({f}) {hits}",
        "strategy_slate": S.with_views(f""", f AS ({f}), e AS (SELECT strategy, side, 'T' || substr(ticker, 2, 2) AS ticker, date FROM ({hits})),
 ses AS (SELECT *, lead(close, 3) OVER (PARTITION BY ticker ORDER BY date) AS nxt FROM prices),
 spy AS (SELECT date, close, lead(close, 3) OVER (ORDER BY date) AS nxt FROM (SELECT date, avg(close) AS close FROM prices GROUP BY 1)),
 g AS (SELECT e.*, s.nxt / s.close - 1 AS ret FROM e ASOF LEFT JOIN ses s ON e.ticker = s.ticker AND e.date < s.date),
 m AS (SELECT g.*, p.nxt / p.close - 1 AS mkt FROM g ASOF LEFT JOIN spy p ON g.date < p.date),
 t AS (SELECT strategy, side * (ret - mkt) - (0.015e0 + CASE WHEN side < 0 THEN 0.0024e0 ELSE 0 END) AS net FROM m WHERE ret - mkt IS NOT NULL)
 SELECT strategy, {_STUDY}, round(avg(net) / stddev_pop(net) * sqrt(84) + 1e-9, 4) AS sharpe FROM t GROUP BY 1 HAVING count(*) >= 2""", "prices"),
        "directional_excess": v(" SELECT id, round(ex + 1e-9, 6) AS ex FROM exc"),
        "excess_over_drift": v(""", dr AS (SELECT ticker, avg(nxt / close - 1) AS drift FROM ses GROUP BY 1), o AS (SELECT ticker, count(*) AS n, avg(ret) AS m FROM rets WHERE ret IS NOT NULL GROUP BY 1)
 SELECT ticker, n, round(m + 1e-9, 6) AS mean, round(drift + 1e-9, 6) AS drift, round(m - drift + 1e-9, 6) AS excess FROM o JOIN dr USING (ticker)"""),
        "trade_ledger": v(""", e AS (SELECT *, product(1 + 0.1e0 * net) OVER (PARTITION BY side ORDER BY date, id) AS eq FROM trades),
 p AS (SELECT *, greatest(1, max(eq) OVER (PARTITION BY side ORDER BY date, id)) AS peak FROM e)
 SELECT side, count(*) AS n, round(avg(net) * 100 + 1e-9, 4) AS net, round(100 * avg(CASE WHEN net > 0 THEN 1.0e0 ELSE 0 END) + 1e-9, 2) AS win, round(avg(net) / (stddev_pop(net) / sqrt(count(*))) + 1e-9, 4) AS t,
 round(sum(net) FILTER (WHERE net > 0) / -sum(net) FILTER (WHERE net <= 0) + 1e-9, 4) AS pf, round(avg(net) / stddev_pop(net) * sqrt(50.4) + 1e-9, 4) AS sharpe, round(max((peak - eq) / peak) * 100 + 1e-9, 4) AS maxdd,
 round((product(1 + 0.1e0 * net) - 1) * 100 + 1e-9, 3) AS total, round(avg(net) FILTER (WHERE net > 0) * 100 + 1e-9, 4) AS avgwin, round(-avg(net) FILTER (WHERE net <= 0) * 100 + 1e-9, 4) AS avgloss FROM p GROUP BY 1"""),
        "yearly_results": v(f" SELECT year(date) AS year, {_STUDY}, round(avg(net) / stddev_pop(net) * sqrt(50.4) + 1e-9, 4) AS sharpe FROM trades GROUP BY 1 HAVING count(*) >= 2"),
        "author_persistence": v(""", c AS (SELECT author, ret, row_number() OVER (PARTITION BY author ORDER BY date, id) AS i, count(*) OVER (PARTITION BY author) AS n FROM rets WHERE ret IS NOT NULL),
 p AS (SELECT author, avg(ret) FILTER (WHERE i <= n // 2) AS p1, avg(ret) FILTER (WHERE i > n // 2) AS p2 FROM c WHERE n >= 20 GROUP BY 1),
 k AS (SELECT *, row_number() OVER (ORDER BY p1 DESC, author) AS rank, count(*) OVER () AS m, greatest(count(*) OVER () // 5, 5) AS q FROM p)
 SELECT count(*) AS authors, round(covar_pop(p1, p2) / (stddev_pop(p1) * stddev_pop(p2)) + 1e-9, 4) AS corr, round(avg(p2) FILTER (WHERE rank <= q) * 100 + 1e-9, 4) AS top, round(avg(p2) FILTER (WHERE rank > m - q) * 100 + 1e-9, 4) AS bottom FROM k"""),
        "clustered_by_date": v(", m AS (SELECT side, date, avg(net) AS m FROM trades GROUP BY 1, 2) SELECT side, count(*) AS days, round(avg(m) + 1e-9, 6) AS mean, round(avg(m) / (stddev_pop(m) / sqrt(count(*))) + 1e-9, 4) AS t FROM m GROUP BY 1"),
        "walk_forward_fade": v(""", k AS (SELECT ex, count(*) OVER w AS k, avg(ex) OVER w AS past FROM (SELECT *, date_diff('day', DATE '1970-01-01', date) AS day FROM exc WHERE ex IS NOT NULL)
 WINDOW w AS (PARTITION BY author ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 30 PRECEDING)),
 n AS (SELECT 'fade_all' AS cohort, -ex - 0.004e0 AS net FROM k WHERE k >= 10 UNION ALL SELECT 'fade_bad', -ex - 0.004e0 FROM k WHERE k >= 10 AND past < 0 UNION ALL SELECT 'follow_good', ex - 0.004e0 FROM k WHERE k >= 10 AND past > 0.005e0)
 SELECT cohort, count(*) AS n, round(avg(net) * 100 + 1e-9, 4) AS net, round(100 * avg(CASE WHEN net > 0 THEN 1.0e0 ELSE 0 END) + 1e-9, 2) AS win, round(avg(net) / (stddev_pop(net) / sqrt(count(*))) + 1e-9, 4) AS t FROM n GROUP BY 1"""),
        "trailing_gate": v(""", g AS (SELECT ticker, row_number() OVER w AS i, avg(net) OVER (PARTITION BY ticker ORDER BY date, id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS m FROM trades WINDOW w AS (PARTITION BY ticker ORDER BY date, id))
 SELECT ticker, count(*) AS n, count(*) FILTER (WHERE i <= 10 OR m >= 0) AS taken FROM g GROUP BY 1"""),
        "calendar_effects": v(f""", spy AS (SELECT date, avg(close) AS close FROM prices_long GROUP BY 1), s AS (SELECT date, lead(close, {H}) OVER (ORDER BY date) / close - 1 AS ret,
 row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date) <= 3 OR row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date DESC) <= 3 AS turn,
 (SELECT x FROM (SELECT unnest(range(15, 22)) AS x) WHERE isodow(date_trunc('month', date) + to_days(CAST(x - 1 AS INT))) = 5) AS friday FROM spy),
 b AS (SELECT ret, 'turn' AS effect, CASE WHEN turn THEN 'turn' ELSE 'rest' END AS bucket FROM s UNION ALL SELECT ret, 'opex', CASE WHEN day(date) BETWEEN friday - 4 AND friday THEN 'opex' ELSE 'rest' END FROM s
 UNION ALL SELECT ret, 'weekday', substr(dayname(date), 1, 3) FROM s WHERE isodow(date) < 6 UNION ALL SELECT ret, 'month', strftime(date, '%m') FROM s)
 SELECT effect, bucket, count(*) AS n, round(avg(ret) + 1e-9, 6) AS mean, round(avg(CASE WHEN ret > 0 THEN 1.0e0 ELSE 0 END) + 1e-9, 4) AS win, round(avg(ret) / (stddev_pop(ret) / sqrt(count(*))) + 1e-9, 4) AS t
 FROM b WHERE ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10"""),
        "true_range": f"""WITH b AS ({services._BARS.replace("max(l_extendedprice / l_quantity) AS high,", "max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,")}),
 t AS (SELECT ticker, date, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, row_number() OVER w AS i FROM b WINDOW w AS (PARTITION BY ticker ORDER BY date))
 SELECT ticker, date, round(CASE WHEN i > 15 THEN avg(tr) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) END + 1e-9, 6) AS atr FROM t""",
        "trailing_z": f"""WITH x AS ({_VOLUME}), s AS (SELECT *, count(*) OVER w AS n, avg(v) OVER w AS m, round(stddev_pop(v) OVER w, 9) AS sd FROM x WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
 SELECT ticker, date, round(CASE WHEN n < 10 THEN 0 ELSE (v - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END END + 1e-9, 4) AS z FROM s""",
        "k_step_change": S.with_views("SELECT ticker, date, round(close - lag(close, 5) OVER (PARTITION BY ticker ORDER BY date) + 1e-9, 6) AS change FROM prices_long", "prices_long"),
        "froth_index": v(" SELECT date, count(back) AS n, CASE WHEN count(back) >= 10 THEN round(avg(CASE WHEN close / back - 1 > 0.05e0 THEN 1.0e0 ELSE 0 END) FILTER (WHERE back IS NOT NULL) + 1e-9, 4) END AS froth FROM ses GROUP BY 1"),
        "short_ratio_before": v(f""", x AS ({_VOLUME}), s AS (SELECT ticker, date, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY date) > 10 THEN avg(v) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS m FROM x)
 SELECT id, round(m + 1e-9, 4) AS mean FROM calls c ASOF LEFT JOIN s ON c.ticker = s.ticker AND c.date >= s.date"""),
        "followed_by_filing": v(" SELECT id, EXISTS (SELECT 1 FROM calls o WHERE o.id % 2 = 1 AND o.ticker = c.ticker AND o.date BETWEEN c.date + 3 AND c.date + 9) AS hit FROM calls c WHERE id % 2 = 0"),
        "mentions_around": v(" SELECT c.id, count(*) AS around FROM calls c JOIN calls o ON o.ticker = c.ticker AND o.date BETWEEN c.date - 5 AND c.date + 5 GROUP BY 1"),
        "threshold_sweep": v(""", l AS (SELECT 'sentiment' AS c, unnest([-0.5e0, 0.0e0, 0.5e0]) AS x UNION ALL SELECT 'o_totalprice', unnest([50000.0e0, 150000.0e0]))
 SELECT c AS "column", x AS "limit", count(*) AS n, round(avg(net) + 1e-9, 6) AS mean FROM l JOIN trades ON CASE c WHEN 'sentiment' THEN sentiment ELSE o_totalprice END >= x GROUP BY 1, 2"""),
        "put_payoff": v(" SELECT ticker, round(avg(greatest(0.0e0, -ret) - 0.05e0) + 1e-9, 6) AS put FROM trades GROUP BY 1"),
        "trades_per_day": v(" SELECT date, count(*) AS n, count(DISTINCT ticker) AS tickers FROM trades GROUP BY 1"),
    }


_VOLUME = """SELECT 'P' || (l_partkey % 50) AS ticker, CAST(l_shipdate AS DATE) AS date,
 round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) + 1e-9, 4) AS v FROM lineitem GROUP BY 1, 2"""
