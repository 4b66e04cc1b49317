"""Hand-computed cases: edges of windows, as-of joins, merges, text."""

import datetime as dt

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pulsegrid.functions import text as T
from pulsegrid.operators import features, market, posts, signals, studies

D = dt.date


def test_as_of_is_strictly_after_or_on_or_before(spark):
    prices = spark.createDataFrame([("A", D(2024, 1, d), float(d)) for d in (2, 3, 5, 8)], "ticker string, date date, close double")
    events = spark.createDataFrame([("A", D(2024, 1, 3), 1), ("A", D(2024, 1, 4), 2), ("A", D(2024, 1, 8), 3), ("B", D(2024, 1, 3), 4)], "ticker string, date date, id int")
    after = {r.id: r.ret for r in market.forward_return(events, prices, 1).collect()}
    assert after == {1: 8 / 5 - 1, 2: 8 / 5 - 1, 3: None, 4: None}
    back = {r.id: r.ret for r in market.trailing_return(events, prices, 1).collect()}
    assert back == {1: 3 / 2 - 1, 2: 3 / 2 - 1, 3: 8 / 5 - 1, 4: None}


def test_features_never_look_ahead(spark):
    rows = [("A", dt.datetime(2024, 1, d), f"u{i}", float(i % 3 - 1)) for d in (1, 2, 4, 13) for i in range(d % 5 + 1)]
    schema = "ticker string, created_utc timestamp_ntz, author string, sentiment_score double"
    authors = spark.createDataFrame([("u0", 100.0, "deleted")], "username string, account_age_days double, account_status string")
    whole = features.feature_daily(spark.createDataFrame(rows, schema), authors, 1).collect()
    part = features.feature_daily(spark.createDataFrame([r for r in rows if r[1].day <= 4], schema), authors, 1).collect()
    assert {r for r in whole if r.date <= D(2024, 1, 4)} == set(part)
    last = next(r for r in whole if r.date == D(2024, 1, 13))
    assert last.vel is None and last.novelty_days == 12  # no active day among the seven before


def test_merge_freezes_and_repeats(spark):
    schema = "id int, title string, score int"
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 0)], schema)
    new = spark.createDataFrame([(2, "x", 20), (3, "c", 3)], schema)
    once = posts.merge(old, new, ["id"], ["score"])
    want = {(1, "a", 1), (2, "b", 20), (3, "c", 3), (None, "n", 0)}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in posts.merge(once, new, ["id"], ["score"]).collect()} == want


def test_status_is_stamped_when_it_changes(spark):
    old = spark.createDataFrame([("a", "active", 1, 1), ("b", "active", 1, 1), ("c", "deleted", 1, 1)], "username string, status string, checked_at int, changed_at int")
    new = spark.createDataFrame([("a", "active"), ("b", "suspended"), ("d", "active")], "username string, status string")
    got = {r.username: tuple(r)[1:] for r in posts.stamped_status(old, new, F.lit(9)).collect()}
    assert got == {"a": ("active", 9, 1), "b": ("suspended", 9, 9), "c": ("deleted", 1, 1), "d": ("active", 9, 9)}


def test_tickers_and_lexicon(spark):
    df = spark.createDataFrame([("buy $gme and GME, OPEN not $OPEN DD",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(T.tickers(F.col("t"), ["GME", "OPEN", "DD"], ["DD"], ["OPEN"])).collect()]
    assert got == [["GME", "OPEN"], [], None]
    w = T.words(F.col("t"))
    df = spark.createDataFrame([("very good x",), ("good very",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(T.lexicon_score(w, ["good"], ["bad"], ["very"])).collect()]
    assert got == [1.0, 1.0, 0.0, 0.0]


def test_ledger_of_losses_beyond_the_whole_equity(spark):
    rng = np.random.default_rng(6)
    rows = [("a", f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", i, float(x)) for i, x in enumerate(rng.choice([0.5, -0.4, 2.0, -12.0, -30.0, -10.0], 150, p=[0.4, 0.3, 0.2, 0.05, 0.04, 0.01]))]
    rows += [("b", f"2024-01-{1 + i:02d}", i, x) for i, x in enumerate((-12.0, 0.1, -12.0, 0.1, 3.0))]
    df = spark.createDataFrame(rows, "side string, date string, id long, net double").withColumn("date", F.to_date("date"))
    for got in studies.ledger(df, "net", ["side"], 10).collect():
        eq, peak, worst = 1.0, 1.0, 0.0
        for x in (r[3] for r in rows if r[0] == got.side):
            eq *= 1 + 0.1 * x
            peak = max(peak, eq)
            worst = max(worst, (peak - eq) / peak)
        assert abs(got.maxdd - worst * 100) < 1e-3 * max(1, worst) and abs(got.total - (eq - 1) * 100) < 2e-3 * max(1, abs(eq))


def test_near_pairs_count_parts_of_a_second(spark):
    rows = [("T", "a", "2024-01-01 00:00:00.400"), ("T", "b", "2024-01-01 01:00:00.900"), ("T", "c", "2024-01-01 01:00:00.400"), ("T", "d", "2024-01-01 02:00:00.900001")]
    df = spark.createDataFrame(rows, "ticker string, author string, at string")
    for kind in ("timestamp", "timestamp_ntz"):
        got = signals.near_pairs(df.withColumn("created_utc", F.col("at").cast(kind)), 3600)
        assert {tuple(r) for r in got.collect()} == {("T", "a", "c"), ("T", "b", "c")}


def _near(rows, micros):
    """All pairs, by a plain loop; names in the order of their bytes."""
    known = [r for r in rows if None not in r]
    return {(k, *sorted((x, y), key=str.encode)) for k, x, t in known for m, y, u in known if k == m and x != y and abs(t - u) <= micros}


def _near_rows(n, authors, seed):
    rng = np.random.default_rng(seed)
    names = [f"{"ué_ZA~\u00ff\uff21\U0001f600"[i % 9]}{i}" for i in range(authors)]
    pick = lambda of, some: None if rng.random() < 0.03 else of[int(rng.integers(some))]
    # Before and after 1970, with many at the same moment and many exactly one window apart.
    return [(pick(["T", "U", "V"], 3), pick(names, authors), None if rng.random() < 0.03 else int(rng.integers(-20, 20)) * 30_000_000 + int(rng.integers(0, 2))) for _ in range(n)]


def _near_frame(spark, rows):
    return spark.createDataFrame(rows, "ticker string, author string, at long").select("ticker", "author", F.timestamp_micros("at").alias("created_utc"))


def _shuffled(df):
    """Rows that the exchanges of a plan have written, after collect() without adaptive execution."""
    def of(node):
        own = node.metrics().apply("shuffleRecordsWritten").value() if node.nodeName() == "Exchange" else 0
        return own + sum(of(node.children().apply(i)) for i in range(node.children().size()))

    return of(df._jdf.queryExecution().executedPlan())


def test_near_pairs_by_ranges_of_authors(spark):
    for n, authors, seed in ((0, 1, 1), (300, 40, 2), (300, 250, 3)):
        rows = _near_rows(n, authors, seed)
        want = _near(rows, 60_000_000)
        assert n == 0 or len(want) > 500
        for limits in ({}, {"mentions": 30}, {"pairs": 50}):
            got = [tuple(r) for r in signals.near_pairs(_near_frame(spark, rows), 60, **limits).collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_near_pairs_in_batches(spark, monkeypatch):
    from pulsegrid.operators import near

    rows = _near_rows(400, 60, 4)
    run, names = near._neighbours(60_000_000), ["author", "at", "first"]
    want = _near(rows, 60_000_000)
    for batch in (1, 50, 10_000):
        monkeypatch.setattr(near, "BATCH", batch)
        got = []
        for k in "TUV":
            one = [(x, t, True) for m, x, t in rows if m == k and None not in (x, t)]
            for b in run((pa.scalar(k), pa.scalar(0), pa.scalar(0)), iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*one)], names)])):
                got += [(r["ticker"], r["a"], x) for r in b.to_pylist() for x in r["near"]]
        assert len(got) == len(set(got)) and set(got) == want


def test_near_pairs_are_not_shuffled(spark):
    rows = [("T", f"u{i}", i) for i in range(300)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = signals.near_pairs(_near_frame(spark, rows), 60)
        assert len(df.collect()) == 300 * 299 // 2
        assert _shuffled(df) <= 2 * len(rows)
        links = signals.near_links(_near_frame(spark, rows), 60)
        assert len(links.collect()) == 299
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_near_links_connect_what_near_pairs_do(spark):
    def parts(pairs):
        part = {}
        for k, a, b in pairs:
            x, y = part.setdefault((k, a), {(k, a)}), part.setdefault((k, b), {(k, b)})
            if x is not y:
                x |= y
                part |= dict.fromkeys(y, x)
        return {frozenset(x) for x in part.values()}

    for n, authors, seed, seconds in ((300, 250, 5, 60), (60, 50, 6, 30), (60, 50, 7, 1), (40, 8, 8, 30)):
        rows = _near_rows(n, authors, seed)
        want = _near(rows, seconds * 1_000_000)
        got = {tuple(r) for r in signals.near_links(_near_frame(spark, rows), seconds).collect()}
        assert got <= want and parts(got) == parts(want) and len(got) <= 2 * n


def test_coordination_of_nobody(spark):
    rows = [("X", None, "2024-01-01 00:00:00", "Same  Text\n"), ("X", None, "2024-01-01 00:10:00", " same text"), ("Y", "u1", "2024-01-01 00:00:00", None), ("Y", None, None, "")]
    df = spark.createDataFrame(rows, "ticker string, author string, at string, text string").select("ticker", "author", F.to_timestamp("at").alias("created_utc"), "text")
    ages = spark.createDataFrame([("u1", 5.0)], "username string, account_age_days double")
    got = {r.ticker: r for r in signals.coordination(df, ages).collect()}
    assert (got["X"].authors, got["X"].per_author, got["X"].duplicate, got["X"].cluster) == (0, 2.0, 1.0, 0.0)
    assert (got["Y"].authors, got["Y"].n, got["Y"].duplicate, got["Y"].fresh) == (1, 2, 0.0, 1.0)
