"""Studies of calls and trades: gates, costs, ledgers, persistence, calendar effects, exits bar by bar, and their nulls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.functions.numeric import r
from pulsegrid.operators import market

DAY = "1970-01-01"


def day(column: str = "date") -> Column:
    return F.date_diff(F.col(column), F.lit(DAY).cast("date"))


def return_from(events: DataFrame, prices: DataFrame, horizon: int) -> DataFrame:
    """As forward_return, but an event's own day may be the entry."""
    out = market.forward_return(events.withColumn("date", F.date_sub("date", 1)), prices, horizon)
    return out.withColumn("date", F.date_add("date", 1))


#: Entry rules over the daily features: (strategy, side, condition).
GATES = [
    ("pump_long", 1, "per_author >= 3 AND mentions >= 10 AND mentions_z >= 2"),
    ("dump_fade", -1, "per_author >= 3 AND mentions >= 10 AND accel < 0"),
    ("organic", 1, "mentions_z >= 2 AND concentration <= 0.15 AND breadth >= 8"),
    ("fade_organic", -1, "mentions_z >= 2 AND concentration <= 0.15 AND breadth >= 8"),
    ("deletion", -1, "per_author >= 3 AND mentions >= 10 AND gone_frac >= 0.10"),
]


def gated(features: DataFrame, gates: list[tuple[str, int, str]]) -> DataFrame:
    """(strategy, side, ticker, date) for each rule that a ticker-day meets; the features are read once."""
    hits = F.array_compact(F.array(*[F.when(F.expr(c), F.struct(F.lit(n).alias("strategy"), F.lit(s).alias("side"))) for n, s, c in gates]))
    return features.select("ticker", "date", F.explode(hits).alias("g")).select("g.*", "ticker", "date")


def slate(events: DataFrame, prices: DataFrame, benchmark: DataFrame, horizon: int, half_spread_bps: float, borrow_bps: float) -> DataFrame:
    """A study of each strategy's events, net of the benchmark and of costs; benchmark: (date, mkt) of the events' dates."""
    t = market.forward_return(events, prices, horizon).join(benchmark, "date", "left")
    cost = 2 * half_spread_bps / 1e4 + F.when(F.col("side") < 0, borrow_bps * horizon / 1e4).otherwise(0.0)
    return market.study(t.withColumn("net", F.col("side") * (F.col("ret") - F.col("mkt")) - cost), "net", horizon, ["strategy"])


def excess(trades: DataFrame, prices: DataFrame, horizon: int) -> DataFrame:
    """Mean of the trades' returns per ticker over the ticker's mean return of all sessions (its drift)."""
    s = market.sessions(prices, ahead=[horizon])
    drift = s.groupBy("ticker").agg(F.avg(F.when(F.col("close") > 0, F.col(f"next_{horizon}") / F.col("close") - 1)).alias("drift"))
    own = trades.where("ret is not null").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("m"))
    return own.join(drift, "ticker").select("ticker", "n", r(F.col("m"), 6).alias("mean"), r(F.col("drift"), 6).alias("drift"), r(F.col("m") - F.col("drift"), 6).alias("excess"))


def running(rows: DataFrame, by: list[str], chunk: Column, order: list[str], value: Column) -> DataFrame:
    """Adds running (sum of value up to the row) and peak (greatest running sum so far, 0 at first).

    Chunks follow the order; a chunk is summed and its own peak taken in one task, and only one row for each chunk goes through
    the window of a whole group."""
    rows = rows.withColumn("__chunk", chunk)
    inside = W.partitionBy(*by, "__chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__s", F.sum(value).over(inside)).withColumn("__p", F.max("__s").over(inside))
    last = rows.groupBy(*by, "__chunk").agg(F.max("__p").alias("top"), F.sum(value).alias("sum"))
    w = W.partitionBy(*by).orderBy("__chunk")
    last = last.withColumn("__from", F.coalesce(F.sum("sum").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    last = last.withColumn("__old", F.greatest(F.coalesce(F.max(F.col("top") + F.col("__from")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)), F.lit(0.0)))
    out = rows.join(last.drop("top", "sum"), [*by, "__chunk"])
    return out.withColumns({"running": F.col("__from") + F.col("__s"), "peak": F.greatest(F.col("__old"), F.col("__from") + F.col("__p"))}).drop("__chunk", "__s", "__p", "__from", "__old")


def _parts(factor: Column) -> tuple[Column, Column]:
    """A factor as the logarithm of its size, -10^6 for 0, and whether it turns the sign."""
    return F.when(factor == 0, -1e6).otherwise(F.log(F.abs(factor))), (factor < 0).cast("int")


def equity(rows: DataFrame, by: list[str], chunk: Column, order: list[str], factor: Column) -> DataFrame:
    """Adds the running product of the factors as size (its logarithm) and negative, and peak, the logarithm of the greatest product so
    far, 1 at first. Products are logarithms and signs, so long runs neither overflow nor vanish.

    Chunks follow the order. Within a chunk a product is known up to the chunk's start, so the greatest one is kept for either sign
    there; one row for each chunk goes through the window of a whole group and says which of the two it is."""
    size, turn = _parts(factor)
    rows = rows.withColumns({"__chunk": chunk, "__size": size, "__turn": turn})
    inside = W.partitionBy(*by, "__chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"__s": F.sum("__size").over(inside), "__t": F.sum("__turn").over(inside) % 2})
    rows = rows.withColumns({f"__top{i}": F.max(F.when(F.col("__t") == i, F.col("__s"))).over(inside) for i in (0, 1)})
    last = rows.groupBy(*by, "__chunk").agg(F.sum("__size").alias("sum"), F.sum("__turn").alias("turns"), *[F.max(f"__top{i}").alias(f"top{i}") for i in (0, 1)])
    w = W.partitionBy(*by).orderBy("__chunk")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    last = last.withColumns({"__from": F.coalesce(F.sum("sum").over(before), F.lit(0.0)), "__sign": F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2})
    last = last.withColumn("top", F.when(F.col("__sign") == 0, F.col("top0")).otherwise(F.col("top1")) + F.col("__from"))
    last = last.withColumn("__old", F.greatest(F.lit(0.0), F.max("top").over(before)))
    out = rows.join(last.select(*by, "__chunk", "__from", "__sign", "__old"), [*by, "__chunk"])
    own = F.when(F.col("__sign") == 0, F.col("__top0")).otherwise(F.col("__top1")) + F.col("__from")
    out = out.withColumns({"size": F.col("__from") + F.col("__s"), "negative": (F.col("__sign") + F.col("__t")) % 2 == 1, "peak": F.greatest(F.col("__old"), own)})
    return out.drop("__chunk", "__size", "__turn", "__s", "__t", "__top0", "__top1", "__from", "__sign", "__old")


def ledger(trades: DataFrame, value: str, by: list[str], horizon: int, fraction: float = 0.10) -> DataFrame:
    """Trades (date, id, value) of each group: count, mean net and share of wins in percent, t, profit factor (null without
    losses), yearly Sharpe, greatest drawdown and total of an equity that stakes a fixed fraction, mean win and loss.

    A trade that loses more than the whole equity turns it negative, as the product of 1 + fraction * value does, and the next
    such one turns it back; a drawdown then exceeds 100 percent."""
    v = F.col(value)
    rows = equity(trades.where(v.isNotNull()), by, F.date_trunc("month", "date"), ["date", "id"], 1 + fraction * v)
    size, turn = _parts(1 + fraction * v)
    left = F.exp(F.col("size") - F.col("peak"))
    win, loss = F.when(v > 0, v), F.when(v <= 0, -v)
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("m"), F.stddev_pop(v).alias("sd"), F.count(win).alias("wins"), F.sum(win).alias("won"), F.sum(loss).alias("lost"), F.avg(win).alias("aw"), F.avg(loss).alias("al"), F.max(F.when(F.col("negative"), 1 + left).otherwise(1 - left)).alias("dd"), (F.exp(F.sum(size)) * F.when(F.sum(turn) % 2 == 1, -1.0).otherwise(1.0)).alias("eq")).where("n >= 2")
    sd = F.coalesce(F.nullif(F.round("sd", 12), F.lit(0.0)), F.lit(1e-9))
    return out.select(*by, "n", r(F.col("m") * 100, 4).alias("net"), r(100 * F.col("wins") / F.col("n"), 2).alias("win"), r(F.col("m") / (sd / F.sqrt("n")), 4).alias("t"), r(F.col("won") / F.nullif("lost", F.lit(0.0)), 4).alias("pf"), r(F.col("m") / sd * (252 / horizon) ** 0.5, 4).alias("sharpe"), r(F.col("dd") * 100, 4).alias("maxdd"), r((F.col("eq") - 1) * 100, 3).alias("total"), r(F.coalesce("aw", F.lit(0.0)) * 100, 4).alias("avgwin"), r(F.coalesce("al", F.lit(0.0)) * 100, 4).alias("avgloss"))


def persistence(calls: DataFrame, least: int = 10) -> DataFrame:
    """Do authors who did well in the first half of their calls do well in the second? One row: authors with at least `least` calls in
    each half, the correlation of the halves' means, and the second half's mean of the best and worst fifth by the first."""
    w = W.partitionBy("author").orderBy("date", "id")
    rows = calls.where("ret is not null").withColumns({"i": F.row_number().over(w), "n": F.count(F.lit(1)).over(W.partitionBy("author"))}).where(F.col("n") >= 2 * least)
    half = F.col("i") <= F.floor(F.col("n") / 2)
    pairs = rows.groupBy("author").agg(F.avg(F.when(half, F.col("ret"))).alias("p1"), F.avg(F.when(~half, F.col("ret"))).alias("p2"))
    place = pairs.withColumns({"rank": F.row_number().over(W.orderBy(F.desc("p1"), "author")), "n": F.count(F.lit(1)).over(W.partitionBy())})
    k = F.greatest(F.floor(F.col("n") / 5), F.lit(5))
    sd = F.greatest(F.stddev_pop("p1"), F.lit(1e-9)) * F.greatest(F.stddev_pop("p2"), F.lit(1e-9))
    return place.agg(F.count(F.lit(1)).alias("authors"), r(F.covar_pop("p1", "p2") / sd, 4).alias("corr"), r(F.avg(F.when(F.col("rank") <= k, F.col("p2"))) * 100, 4).alias("top"), r(F.avg(F.when(F.col("rank") > F.col("n") - k, F.col("p2"))) * 100, 4).alias("bottom"))


def clustered(trades: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean and t over dates, each date's mean being one observation."""
    per = trades.where(F.col(value).isNotNull()).groupBy(*by, "date").agg(F.avg(value).alias("m"))
    out = per.groupBy(*by).agg(F.count(F.lit(1)).alias("days"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd")).where("days >= 2")
    return out.select(*by, "days", r(F.col("mean"), 6).alias("mean"), r(F.col("mean") / (F.greatest("sd", F.lit(1e-9)) / F.sqrt("days")), 4).alias("t"))


def walk_forward(calls: DataFrame, least: int, mature_days: int, cost: float, bad: float, good: float) -> DataFrame:
    """Each call against its author's mean of calls that had matured by then (at least `least` of them): fade all, fade those below
    `bad`, follow those above `good`. calls: author, date, ex (directional excess return)."""
    w = W.partitionBy("author").orderBy("day").rangeBetween(W.unboundedPreceding, -mature_days)
    known = calls.where("ex is not null").withColumn("day", day()).withColumns({"k": F.count("ex").over(w), "past": F.avg("ex").over(w)}).where(F.col("k") >= least)
    fade, follow = -F.col("ex") - cost, F.col("ex") - cost
    cohorts = F.array_compact(F.array(F.struct(F.lit("fade_all").alias("cohort"), fade.alias("net")), F.when(F.col("past") < bad, F.struct(F.lit("fade_bad").alias("cohort"), fade.alias("net"))), F.when(F.col("past") > good, F.struct(F.lit("follow_good").alias("cohort"), follow.alias("net")))))
    out = known.select(F.explode(cohorts).alias("c")).select("c.*").groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.avg("net").alias("m"), F.stddev_pop("net").alias("sd"), F.avg(F.when(F.col("net") > 0, 1.0).otherwise(0.0)).alias("win"))
    return out.select("cohort", "n", r(F.col("m") * 100, 4).alias("net"), r(F.col("win") * 100, 2).alias("win"), r(F.col("m") / (F.greatest("sd", F.lit(1e-9)) / F.sqrt("n")), 4).alias("t"))


def trailing_gate(ledger_rows: DataFrame, by: list[str], value: str, window: int, least: float) -> DataFrame:
    """Rows taken when the mean of the `window` results before is at least `least`; the first `window` of a group always pass."""
    o = W.partitionBy(*by).orderBy("date", "id")
    before = F.avg(value).over(o.rowsBetween(-window, -1))
    return ledger_rows.withColumn("taken", (F.row_number().over(o) <= window) | (before >= least))


def calendar(prices: DataFrame, horizon: int, edge: int = 3, least: int = 10) -> DataFrame:
    """Forward returns of one series by turn of the month (first and last `edge` sessions), week of the options' expiry (up to four days
    before the third Friday), weekday and month; buckets of at least `least`. One row a day is held in one window."""
    s = market.sessions(prices, ahead=[horizon]).withColumn("ret", F.when(F.col("close") > 0, F.col(f"next_{horizon}") / F.col("close") - 1))
    month = W.partitionBy("ticker", F.date_trunc("month", "date"))
    turn = (F.row_number().over(month.orderBy("date")) <= edge) | (F.row_number().over(month.orderBy(F.desc("date"))) <= edge)
    first = F.trunc("date", "month")
    friday = F.dayofmonth(F.next_day(F.date_sub(first, 1), "Fri")) + 14
    opex = (F.dayofmonth("date") <= friday) & (friday - F.dayofmonth("date") <= 4)
    weekday = F.date_format("date", "E")
    s = s.withColumn("b", F.array(*[F.struct(F.lit(n).alias("effect"), x.alias("bucket")) for n, x in (("turn", F.when(turn, "turn").otherwise("rest")), ("opex", F.when(opex, "opex").otherwise("rest")), ("weekday", weekday), ("month", F.date_format("date", "MM")))]))
    out = s.where("ret is not null").select("ret", F.explode("b").alias("b")).select("ret", "b.*").where("effect <> 'weekday' or bucket not in ('Sat', 'Sun')")
    out = out.groupBy("effect", "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("m"), F.stddev_pop("ret").alias("sd"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("win")).where(F.col("n") >= least)
    return out.select("effect", "bucket", "n", r(F.col("m"), 6).alias("mean"), r(F.col("win"), 4).alias("win"), r(F.col("m") / (F.greatest("sd", F.lit(1e-9)) / F.sqrt("n")), 4).alias("t"))


def atr(bars: DataFrame, period: int) -> DataFrame:
    """Mean true range of the `period` bars before each; null with fewer than period + 1 bars before."""
    o = W.partitionBy("ticker").orderBy("date")
    prev = F.lag("close").over(o)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    out = bars.withColumn("tr", tr).withColumns({"i": F.row_number().over(o), "a": F.avg("tr").over(o.rowsBetween(-period, -1))})
    return out.select("ticker", "date", r(F.when(F.col("i") > period + 1, F.col("a")), 6).alias("atr"))


def trailing_z(series: DataFrame, value: str, window: int, least: int) -> DataFrame:
    """z of each day against the `window` days before it, 0 with fewer than `least` of them; a spread of 0 counts as 1."""
    o = W.partitionBy("ticker").orderBy("date").rowsBetween(-window, -1)
    m, sd, n = F.avg(value).over(o), F.round(F.stddev_pop(value).over(o), 9), F.count(value).over(o)
    z = F.when(n < least, F.lit(0.0)).otherwise((F.col(value) - m) / F.when(sd == 0, 1.0).otherwise(sd))
    return series.select("ticker", "date", r(z, 4).alias("z"))


def change(series: DataFrame, value: str, steps: int) -> DataFrame:
    o = W.partitionBy("ticker").orderBy("date")
    return series.select("ticker", "date", r(F.col(value) - F.lag(value, steps).over(o), 6).alias("change"))


def froth_index(prices: DataFrame, sessions_back: int, rise: float, least: int) -> DataFrame:
    """Per date the share of tickers that rose more than `rise` over the sessions before; null with fewer than `least` priced."""
    s = market.sessions(prices, back=[sessions_back])
    x = F.when(F.col(f"prev_{sessions_back}") > 0, F.col("close") / F.col(f"prev_{sessions_back}") - 1)
    out = s.withColumn("x", x).groupBy("date").agg(F.count("x").alias("n"), F.avg(F.when(F.col("x").isNotNull(), F.when(F.col("x") > rise, 1.0).otherwise(0.0))).alias("share"))
    return out.select("date", "n", r(F.when(F.col("n") >= least, F.col("share")), 4).alias("froth"))


def mean_before(events: DataFrame, series: DataFrame, value: str, rows: int) -> DataFrame:
    """Mean of the `rows` values before the last one on or before the event's date; null if there are fewer."""
    o = W.partitionBy("ticker").orderBy("date")
    s = series.withColumns({"i": F.row_number().over(o), "m": F.avg(value).over(o.rowsBetween(-rows, -1))}).select("ticker", "date", F.when(F.col("i") > rows, F.col("m")).alias("mean"))
    return market.as_of(events, s, ["mean"], strictly_after=False)


def followed(events: DataFrame, others: DataFrame, low: int, high: int) -> DataFrame:
    """events with hit: is there another event of the ticker from `low` to `high` days after? Both sides are keyed by blocks of days as
    long as the band, so that a ticker with very many events is not joined as one group."""
    width = high - low + 1
    days = others.select("ticker", day().alias("__day"), F.floor(day() / width).alias("__b")).distinct()
    near = events.withColumn("__from", day() + low).withColumn("__b", F.explode(F.array_distinct(F.array(F.floor((day() + low) / width), F.floor((day() + high) / width)))))
    hits = near.join(days, ["ticker", "__b"]).where((F.col("__day") >= F.col("__from")) & (F.col("__day") <= F.col("__from") + (high - low))).select("id").distinct().withColumn("hit", F.lit(True))
    return events.join(hits, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def count_around(events: DataFrame, daily: DataFrame, days: int) -> DataFrame:
    """events with the number of mentions from `days` before to `days` after; daily: (ticker, date, n)."""
    near = daily.select("ticker", "n", F.explode(F.sequence(F.date_sub("date", days), F.date_add("date", days))).alias("date"))
    around = near.groupBy("ticker", "date").agg(F.sum("n").alias("around"))
    return events.join(around, ["ticker", "date"], "left").withColumn("around", F.coalesce("around", F.lit(0)).cast("long"))


def sweep(trades: DataFrame, value: str, limits: dict[str, list[float]]) -> DataFrame:
    """Mean and count of the trades at or above each limit of each column, one at a time; the trades are read once."""
    hits = F.flatten(F.array(*[F.array(*[F.when(F.col(c) >= x, F.struct(F.lit(c).alias("column"), F.lit(float(x)).alias("limit"))) for x in xs]) for c, xs in limits.items()]))
    rows = trades.where(F.col(value).isNotNull()).select(value, F.explode(F.array_compact(hits)).alias("h")).select(value, "h.*")
    return rows.groupBy("column", "limit").agg(F.count(F.lit(1)).alias("n"), r(F.avg(value), 6).alias("mean"))


def option_net(ret: Column, premium: float) -> Column:
    """A put bought at a premium, as shares of the price: what it pays less the premium."""
    return F.greatest(F.lit(0.0), -ret) - premium


class Exits:
    """One position at a time over the bars of one series, as a state machine that is fed bar by bar.

    A trigger arms for `arm` bars; while armed, the position opens at a bar's open if the bar before closed up (or at
    once without `turn`) and the mean true range is known. It ends at the stop if a later bar's low reaches it, else
    at the close of the bar that completes `hold`. Results are in shares of the equity at a risk of `risk` a trade."""

    def __init__(self, turn: bool, arm: int, stop: float, hold: int, period: int, risk: float = 0.01):
        self.turn, self.arm, self.stop, self.hold, self.period, self.risk = turn, arm, stop, hold, period, risk

    def results(self, bars: pd.DataFrame, triggers: set) -> Iterator[tuple]:
        """bars in order: date, open, high, low, close, atr -> (entry date, exit date, result)."""
        waiting, entry = None, None
        rows = list(bars.itertuples(index=False))
        for i in range(2, len(rows)):
            bar, prior, older = rows[i], rows[i - 1], rows[i - 2]
            if entry is not None:
                opened, price, level, unit, age = entry
                hit = bar.low <= level
                if hit or age + 1 >= self.hold:
                    gain = (level if hit else bar.close) / price - 1
                    size = self.stop * unit / price if self.stop > 0 else 0.01
                    yield opened, bar.date, gain / size * self.risk
                    entry = None
                else:
                    entry = (opened, price, level, unit, age + 1)
                continue
            if bar.date in triggers:
                waiting = 0
            if waiting is None:
                continue
            waiting += 1
            if not self.turn or prior.close > older.close:
                if i >= self.period + 1 and bar.atr > 0:
                    entry, waiting = (bar.date, bar.open, bar.open - self.stop * bar.atr, bar.atr, 0), None
            elif waiting > self.arm:
                waiting = None


def with_range(bars: DataFrame, period: int) -> DataFrame:
    """bars with the mean true range known at each bar's open; 0 where it isn't."""
    o = W.partitionBy("ticker").orderBy("date")
    prev = F.lag("close").over(o)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    return bars.withColumn("tr", tr).withColumn("atr", F.coalesce(F.avg("tr").over(o.rowsBetween(-period, -1)), F.lit(0.0))).drop("tr")


def simulate(bars: DataFrame, triggers: DataFrame, configs: DataFrame, period: int = 14, least: int = 5) -> DataFrame:
    """Each ticker's bars under each configuration (config, turn, arm, stop, hold): trades, share of wins, profit factor (null without
    losses), net and greatest drawdown in percent; fewer than `least` trades give the count alone.

    triggers: (ticker, date), or with a column config for triggers of that configuration only. One task holds one ticker's bars
    under one configuration, some thousands of rows."""
    keys = ["ticker", "config"] if "config" in triggers.columns else ["ticker"]
    days = triggers.groupBy(*keys).agg(F.collect_set("date").alias("days"))
    series = with_range(bars, period).groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "open", "high", "low", "close", "atr"))).alias("bars"))
    jobs = series.crossJoin(F.broadcast(configs)).join(days, keys).repartition("ticker", "config")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for x in frame.itertuples(index=False):
                series = pd.DataFrame([b if isinstance(b, dict) else b.asDict() for b in x.bars])
                got = [g for _, _, g in Exits(x.turn, x.arm, x.stop, x.hold, period).results(series, set(x.days))]
                if len(got) < least:
                    out.append((x.ticker, x.config, len(got), None, None, None, None))
                    continue
                equity, peak, worst = 1.0, 1.0, 0.0
                for g in got:
                    equity *= 1 + g
                    peak = max(peak, equity)
                    worst = max(worst, (peak - equity) / peak)
                lost = -sum(g for g in got if g <= 0)
                out.append((x.ticker, x.config, len(got), 100 * sum(g > 0 for g in got) / len(got), sum(g for g in got if g > 0) / lost if lost else None, 100 * (equity - 1), 100 * worst))
            yield pd.DataFrame(out, columns=["ticker", "config", "n", "win", "pf", "net_pct", "maxdd_pct"])

    return jobs.mapInPandas(run, "ticker string, config string, n long, win double, pf double, net_pct double, maxdd_pct double")


def best_in_sample(results: DataFrame, later: DataFrame, least: int) -> DataFrame:
    """Per ticker the configuration of the greatest net in the first period with at least `least` trades, and its result in the second."""
    w = W.partitionBy("ticker").orderBy(F.desc("net_pct"), "config")
    best = results.where(F.col("n") >= least).withColumn("k", F.row_number().over(w)).where("k = 1").select("ticker", "config", "n", r(F.col("net_pct"), 4).alias("net_pct"))
    return best.join(later.select("ticker", "config", F.col("n").alias("later_n"), r(F.col("net_pct"), 4).alias("later_net")), ["ticker", "config"], "left")
