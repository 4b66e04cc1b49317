"""Live states, screens, author credibility and coordination detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.functions import text as T
from pulsegrid.functions.numeric import r, ratio
from pulsegrid.operators import graph
from pulsegrid.operators.near import near_links, near_pairs  # noqa: F401


def capitulation(percentiles: DataFrame, vix: DataFrame, low: float = 0.15, high: float = 0.85, least_vix: float = 18.0) -> DataFrame:
    """One row: the latest known percentile of retail mood, whether fear holds (and the volatility index allows it) or euphoria, and
    their strengths in 0..1. percentiles: (date, pct); vix: (date, close); without a close the gate is open."""
    last = percentiles.where("pct is not null").agg(F.max_by("pct", "date").alias("pct"), F.max("date").alias("as_of"))
    v = vix.agg(F.max_by("close", "date").alias("vix"))
    gate = F.col("vix").isNull() | (F.col("vix") >= least_vix)
    clamp = lambda x: r(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 2)
    out = last.crossJoin(F.broadcast(v))
    return out.select("as_of", r(F.col("pct"), 4).alias("pct"), r(F.col("vix"), 2).alias("vix"), gate.alias("vix_gate"), F.coalesce((F.col("pct") <= low) & gate, F.lit(False)).alias("active"), clamp((0.20 - F.col("pct")) / 0.20).alias("strength"), F.coalesce(F.col("pct") >= high, F.lit(False)).alias("euphoria"), clamp((F.col("pct") - 0.80) / 0.20).alias("strength_e"))


def strategy_signals(state: DataFrame, instruments: DataFrame, fear: DataFrame, least_fear: float = 0.5, horizon: int = 10) -> DataFrame:
    """While fear holds, a long signal for each instrument; gated ones need the fear attention's z as well. instruments: symbol, asset, gated;
    fear: one row with z."""
    out = state.where("active").crossJoin(F.broadcast(instruments)).crossJoin(F.broadcast(fear))
    out = out.where(~F.col("gated") | (F.col("z") >= least_fear))
    return out.select("symbol", "asset", F.lit("long").alias("side"), "strength", F.lit(horizon).alias("horizon_days"))


def recent(features: DataFrame, condition: str, days: int = 4, limit: int = 40) -> DataFrame:
    """Ticker-days of the last `days` days of all that meet the condition, the latest and most unusual first."""
    last = features.agg(F.max("date").alias("__last"))
    rows = features.where(condition).crossJoin(F.broadcast(last)).where(F.col("date") >= F.date_sub("__last", days)).drop("__last")
    return rows.orderBy(F.desc("date"), F.col("mentions_z").desc_nulls_last(), "ticker").limit(limit)


def screens(features: DataFrame, universes: DataFrame, rules: list[tuple[str, str, str, str | None, int, int]]) -> DataFrame:
    """(screen, side, ticker, date) for each rule: name, side, condition, universe or None, rows looked at, rows given. universes: (universe, ticker)."""
    out = None
    for name, side, condition, universe, looked, given in rules:
        rows = recent(features, condition, limit=looked)
        if universe:
            rows = rows.join(F.broadcast(universes.where(F.col("universe") == universe).select("ticker").distinct()), "ticker", "left_semi")
        rows = rows.orderBy(F.desc("date"), F.col("mentions_z").desc_nulls_last(), "ticker").limit(given).select(F.lit(name).alias("screen"), F.lit(side).alias("side"), "ticker", "date")
        out = rows if out is None else out.unionByName(rows)
    return out


def calendar_overlay(day: Column) -> Column:
    """The season's tilt on a day: near the turn of the month, and the weak months."""
    turn = (F.dayofmonth(day) <= 3) | (F.dayofmonth(day) >= 26)
    weak = F.month(day).isin(2, 3, 9)
    bias = F.when(weak, "risk-off tilt").when(turn, "risk-on tilt").otherwise("neutral")
    return F.struct(F.when(turn, "turn_of_month").otherwise("mid_month").alias("flag"), F.when(weak, "weak").otherwise("ok").alias("seasonal"), bias.alias("bias"))


def by_universe(events: DataFrame, universes: DataFrame, value: str) -> DataFrame:
    """Count and mean of the events of each universe; an event counts in each universe that its ticker is in."""
    out = events.where(F.col(value).isNotNull()).join(universes, "ticker").groupBy("universe")
    return out.agg(F.count(F.lit(1)).alias("n"), r(F.avg(value), 6).alias("mean"))


def hit_rate(calls: DataFrame) -> DataFrame:
    """Per author the scored calls, their mean forward return and the share above 0. calls: author, ret."""
    return calls.where("ret is not null").groupBy("author").agg(F.count(F.lit(1)).alias("scored"), r(F.avg("ret"), 4).alias("avg_return"), r(F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)), 3).alias("win_rate"))


#: Flags for and against an author with their weights, fixed values.
IN_WEIGHTS = {"positive track record": 0.35, "early mover": 0.25, "moderator": 0.15, "account >2y": 0.10, "high karma": 0.10, "diverse coverage": 0.10}
OUT_WEIGHTS = {"negative track record": 0.40, "burst activity": 0.30, "single-ticker": 0.25, "uniformly bullish": 0.20, "single-subreddit": 0.15, "account <30d": 0.15, "very low karma": 0.10}


def credibility(mentions: DataFrame, activity: DataFrame, authors: DataFrame, prescience: DataFrame, hits: DataFrame) -> DataFrame:
    """Score, confidence and verdict of all authors of mentions, from flags whose weights add up.

    activity: (author, at) of posts and comments; authors: username, account_age_days, total_karma, is_mod, fetched; prescience: (author,
    earliness); hits: see hit_rate. Unknown attributes set no flag."""
    m = mentions.where("author is not null").groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ticker").alias("tickers"), F.countDistinct("subreddit").alias("subs"), F.coalesce(F.stddev_pop("sentiment_score"), F.lit(0.0)).alias("sd"), F.coalesce(F.avg("sentiment_score"), F.lit(0.0)).alias("mean"))
    span = activity.groupBy("author").agg(((F.unix_timestamp(F.max("at")) - F.unix_timestamp(F.min("at"))) / 86400).alias("span"))
    x = m.join(span, "author", "left").join(authors.withColumnRenamed("username", "author"), "author", "left").join(prescience.select("author", "earliness"), "author", "left").join(hits, "author", "left")
    enough, scored = F.col("n") >= 5, F.coalesce(F.col("scored") >= 5, F.lit(False))
    flags = {
        "positive track record": scored & (F.col("avg_return") > 0.02), "early mover": (F.col("earliness") >= 0.6) & enough, "moderator": F.col("is_mod"),
        "account >2y": F.col("account_age_days") > 730, "high karma": F.col("total_karma") > 10000, "diverse coverage": F.col("tickers") >= 8,
        "negative track record": scored & (F.col("avg_return") < -0.02), "burst activity": (F.col("span") < 2) & enough, "single-ticker": (F.col("tickers") == 1) & enough,
        "uniformly bullish": (F.round("sd", 9) < 0.05) & (F.col("mean") > 0.3) & enough, "single-subreddit": (F.col("subs") == 1) & enough, "account <30d": F.col("account_age_days") < 30,
        "very low karma": F.col("total_karma") < 50,
    }

    def names(of: dict) -> Column:
        return F.array_join(F.array_compact(F.array(*[F.when(flags[f], F.lit(f)) for f in of])), ",")

    total = sum((F.when(flags[f], w).otherwise(0.0) for f, w in IN_WEIGHTS.items()), F.lit(0.0)) - sum((F.when(flags[f], w).otherwise(0.0) for f, w in OUT_WEIGHTS.items()), F.lit(0.0))
    sure = F.least(F.col("n"), F.lit(20)) / 20 * 0.5 + F.when(F.col("fetched"), 0.3).otherwise(0.0) + F.when(scored, 0.2).otherwise(0.0)
    x = x.withColumns({"score": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r(total, 3))), "confidence": r(F.least(F.lit(1.0), sure), 2)})
    verdict = F.when((F.col("score") >= 0.4) & (F.col("confidence") >= 0.5), "qualify_in").when((F.col("score") <= -0.4) & (F.col("confidence") >= 0.4), "qualify_out").otherwise("neutral")
    return x.select("author", "n", "score", "confidence", verdict.alias("verdict"), names(IN_WEIGHTS).alias("in_flags"), names(OUT_WEIGHTS).alias("out_flags"))


def coordination(rows: DataFrame, ages: DataFrame, seconds: int = 1800) -> DataFrame:
    """Per ticker: mentions per author, share of the busiest hour, share of repeated texts, the largest group of authors linked by
    near mentions as a share of all, share of fresh accounts among known ages, and how many of the five marks it bears; two make it suspected.

    rows: ticker, author, created_utc, text (of the window that is meant); ages: username, account_age_days. Null authors count as mentions of
    nobody: a ticker that has no others has 0 authors, and its mentions count as of one. Texts are equal by normalised_key; empty and null
    ones are none."""
    rows = rows.withColumn("text", F.nullif(T.normalised_key(F.col("text")), F.lit("")))
    by = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("author").alias("authors"))
    hour = rows.where("created_utc is not null").groupBy("ticker", F.date_trunc("hour", "created_utc").alias("h")).agg(F.count(F.lit(1)).alias("c")).groupBy("ticker").agg(F.max("c").alias("peak"))
    texts = rows.where("text is not null").groupBy("ticker", "text").agg(F.count(F.lit(1)).alias("c")).groupBy("ticker").agg(F.sum("c").alias("texts"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("same"))
    parts = graph.linked(near_links(rows, seconds)).groupBy("ticker", "part").agg(F.count(F.lit(1)).alias("c")).groupBy("ticker").agg(F.max("c").alias("cluster"))
    known = rows.select("ticker", "author").distinct().join(ages.select(F.col("username").alias("author"), "account_age_days"), "author").where("account_age_days is not null")
    fresh = known.groupBy("ticker").agg(F.avg(F.when(F.col("account_age_days") < 30, 1.0).otherwise(0.0)).alias("fresh"))
    x = by.join(hour, "ticker", "left").join(texts, "ticker", "left").join(parts, "ticker", "left").join(fresh, "ticker", "left")
    mpa, burst = F.col("n") / F.greatest("authors", F.lit(1)), F.coalesce(F.col("peak") / F.col("n"), F.lit(0.0))
    dup, dense = F.coalesce(ratio(F.col("same"), F.col("texts")), F.lit(0.0)), F.coalesce(ratio(F.col("cluster"), F.col("authors")), F.lit(0.0))
    marks = [mpa >= 5, (burst >= 0.5) & (F.col("n") >= 10), dup >= 0.2, (dense >= 0.5) & (F.col("authors") >= 4), F.coalesce((F.col("fresh") >= 0.4) & (F.col("authors") >= 4), F.lit(False))]
    score = sum((x.cast("int") for x in marks), F.lit(0))
    return x.select("ticker", "n", "authors", r(mpa, 1).alias("per_author"), r(burst, 2).alias("burst"), r(dup, 2).alias("duplicate"), r(dense, 2).alias("cluster"), r(F.col("fresh"), 2).alias("fresh"), score.alias("marks"), (score >= 2).alias("suspected"))


def first_rows(rows: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """The `most` first rows of each group in the order: the group limit is pushed below the window."""
    w = W.partitionBy(by).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
