"""The bar simulation against a plain loop, written from its description."""

import collections

from pulsegrid.operators import studies as O
from pulsegrid.plans import services, studies

SMALL = "/root/testdata/sf0.001"


def loop(bars, triggers, turn, arm, stop, hold, period=14):
    out, state, since, pos = [], "flat", 0, None
    ranges = [None] + [max(b.high - b.low, abs(b.high - a.close), abs(b.low - a.close)) for a, b in zip(bars, bars[1:])]
    for i in range(2, len(bars)):
        if state == "in":
            pos["held"] += 1
            stopped = bars[i].low <= pos["stop"]
            if stopped or pos["held"] == hold:
                end = pos["stop"] if stopped else bars[i].close
                out.append((end / pos["price"] - 1) / (stop * pos["unit"] / pos["price"]) * 0.01)
                state = "flat"
            continue
        if bars[i].date in triggers:
            state, since = "armed", 0
        if state != "armed":
            continue
        since += 1
        if turn and bars[i - 1].close <= bars[i - 2].close:
            if since > arm:
                state = "flat"
        elif i > period:
            unit = sum(ranges[i - period : i]) / period
            pos, state = {"price": bars[i].open, "unit": unit, "stop": bars[i].open - stop * unit, "held": 0}, "in"
    return out


def test_simulation(spark):
    bars, days = collections.defaultdict(list), collections.defaultdict(set)
    for b in sorted(services.bars(spark, SMALL).collect(), key=lambda b: (b.ticker, b.date)):
        bars[b.ticker].append(b)
    t = studies.calls(spark, SMALL).where("sentiment >= 0.5").select("ticker", "date").distinct()
    for r in t.collect():
        days[r.ticker].add(r.date)
    configs = studies._configs(spark)
    got = {(r.ticker, r.config): r for r in O.simulate(services.bars(spark, SMALL), t, configs, least=1).collect()}
    assert len(got) == sum(1 for k in days if k in bars) * configs.count()
    traded = 0
    for c in configs.collect():
        for k in days:
            if k not in bars:
                continue
            want = loop(bars[k], days[k], c.turn, c.arm, c.stop, c.hold)
            r = got[k, c.config]
            assert r.n == len(want)
            if want:
                traded += 1
                equity = 1.0
                for x in want:
                    equity *= 1 + x
                assert abs(r.net_pct - 100 * (equity - 1)) < 1e-6 and abs(r.win - 100 * sum(x > 0 for x in want) / len(want)) < 1e-9
    assert traded > 100


def test_null_draws_repeat(spark):
    a, b = (studies.queries()["simulation_null"](spark, SMALL).first() for _ in range(2))
    assert a == b and a.draws == 20 and 0 <= a.percentile <= 1
