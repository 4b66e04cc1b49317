"""Signals of the whole market's day: conditions on the daily aggregate, and sets of days of capitulation. One row a day goes through one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.functions.numeric import r, ratio
from pulsegrid.operators import market

# The bounds of low and high percentiles, and of a change in five steps.
LOW, HIGH, CHANGE = 0.15, 0.85, 0.08


def with_froth(daily: DataFrame, froth: DataFrame) -> DataFrame:
    """daily with the froth (date, froth) of its date, 0 where there is none."""
    return daily.join(froth.select("date", "froth"), "date", "left").withColumn("froth", F.coalesce("froth", F.lit(0)).cast("long"))


def trailing_rank(value: Column, window: int, least: int) -> Column:
    """Share of the last `window` rows by date, the row included, with a value not above the row's; null with fewer than `least` rows."""
    seen = F.collect_list(value).over(W.orderBy("date").rowsBetween(-(window - 1), 0))
    return F.when(F.size(seen) >= least, F.size(F.filter(seen, lambda x: x <= value)) / F.size(seen))


def candidates(daily: DataFrame, window: int = 90, least: int = 30) -> DataFrame:
    """(name, side, date) of ten conditions on days with a percentile: date, tickers, froth, bull_frac, bear_frac, rrai_raw, rrai_pct.

    Levels are of the percentile itself and of trailing ranks of froth a ticker (0 without tickers) and of the bullish and bearish
    shares, where null counts as 0; changes are of rrai_raw over five such days."""
    rows = daily.where("rrai_pct is not null").withColumns({"froth_share": F.coalesce(ratio(F.col("froth"), F.col("tickers")), F.lit(0.0)), "bull": F.coalesce("bull_frac", F.lit(0.0)), "bear": F.coalesce("bear_frac", F.lit(0.0))})
    rows = rows.withColumns({"change": F.col("rrai_raw") - F.lag("rrai_raw", 5).over(W.orderBy("date")), **{f"{c}_rank": trailing_rank(F.col(c), window, least) for c in ("froth_share", "bull", "bear")}})
    low, high = F.col("rrai_pct") <= LOW, F.col("rrai_pct") >= HIGH
    up, down = F.col("change") > CHANGE, F.col("change") < -CHANGE
    frothy = F.col("froth_share_rank") >= HIGH
    rules = [
        ("capitulation_long", low, 1), ("euphoria_short", high, -1),
        ("rrai_up_momentum_long", up, 1), ("rrai_up_fade_short", up, -1), ("rrai_down_momentum_short", down, -1), ("rrai_down_fade_long", down, 1),
        ("froth_high_short", frothy, -1), ("froth_high_long", frothy, 1), ("bear_extreme_long", F.col("bear_rank") >= HIGH, 1), ("bull_extreme_short", F.col("bull_rank") >= HIGH, -1),
    ]
    hits = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"))) for name, rule, side in rules]))
    return rows.select("date", F.explode(hits).alias("h")).select("h.name", "h.side", "date")


def fear_z(volume: DataFrame, window: int = 30, least: int = 10) -> DataFrame:
    """(date, z): how far a day's volume is above the mean of the `window` days before it, in their standard deviations (of 1 if they don't vary);
    0 for the first `least` days."""
    w = W.orderBy("date").rowsBetween(-window, -1)
    sd = F.stddev_pop("volume").over(w)
    z = (F.col("volume") - F.avg("volume").over(w)) / F.when(F.round(sd, 9) == 0, 1.0).otherwise(sd)
    return volume.select("date", r(F.when(F.row_number().over(W.orderBy("date")) <= least, 0.0).otherwise(z), 6).alias("z"))


def uptrend(prices: DataFrame, slow: int = 200, fast: int = 50) -> DataFrame:
    """(date, up): the close is above its slow mean and the fast mean is not below that; never before `slow` closes went by."""
    w = W.orderBy("date")
    s, f = (r(F.avg("close").over(w.rowsBetween(-(n - 1), 0)), 6) for n in (slow, fast))
    return prices.select("date", ((F.row_number().over(w) > slow) & (r(F.col("close"), 6) > s) & (f >= s)).alias("up"))


def capitulation_sets(daily: DataFrame, vix: DataFrame, volume: DataFrame, prices: DataFrame, least_vix: float = 18.0, least_fear: float = 0.5) -> DataFrame:
    """(name, date): days with a percentile of at most LOW (baseline), and of these the ones with an index of at least `least_vix` as of the day
    (vixgated), with fear of at least `least_fear` (fear), in an uptrend (trend), and both (trendfear).

    daily: date, rrai_pct; vix: date, close; volume: date, volume; prices: date, close of one series. As of a day is its last row on or before it; none
    counts as no fear, no uptrend, and an index of 0."""
    caps = daily.where(F.col("rrai_pct") <= LOW).select(F.lit("M").alias("ticker"), "date").distinct()
    for series, column in ((vix.select("date", F.col("close").alias("vix")), "vix"), (fear_z(volume), "z"), (uptrend(prices), "up")):
        caps = market.as_of(caps, series.withColumn("ticker", F.lit("M")), [column], strictly_after=False).drop("session")
    scared, up = F.coalesce("z", F.lit(0.0)) >= least_fear, F.coalesce("up", F.lit(False))
    sets = {"baseline": F.lit(True), "vixgated": F.coalesce("vix", F.lit(0.0)) >= least_vix, "fear": scared, "trend": up, "trendfear": up & scared}
    return caps.select("date", F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in sets.items()]))).alias("name")).select("name", "date")
