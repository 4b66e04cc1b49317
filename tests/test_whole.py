"""The queries over all rows: against SQL where they have it, else against brute force."""

import bisect
import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import text as T
from pulsegrid.operators import fulltext, graph, lookups, mentions, posts
from pulsegrid.plans import board, whole
from pulsegrid.sources import fixtures as S
from tests.parity import differences

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(whole.oracle_sql()))
def test_matches_sql(spark, name):
    assert differences(spark, SF, whole.queries()[name], whole.oracle_sql()[name]) == []


def test_every_event_and_order_is_there(spark):
    assert whole.queries()["forward_return"](spark, SF).count() == S.table(spark, SF, "events").count()
    assert whole.queries()["trailing_return"](spark, SF).count() == S.table(spark, SF, "events").count()
    assert whole.orders(spark, SF).count() == S.table(spark, SF, "orders").count()


def test_null_draws(spark):
    series = collections.defaultdict(list)
    for r in sorted(S.prices(spark, SMALL).collect(), key=lambda r: (r.ticker, r.date)):
        series[r.ticker].append((r.date, r.close))
    rets = {t: [b[1] / a[1] - 1 for a, b in zip(x, x[3:])] for t, x in series.items()}
    events = whole.events(spark, SMALL).collect()
    at = [(bisect.bisect_right([x[0] for x in series[e.ticker]], e.date), e.ticker) for e in events]
    actual = np.mean([rets[t][i] for i, t in at if i < len(rets[t])])
    live = [e for e in events if rets[e.ticker]]
    means = [np.mean([rets[e.ticker][(e.id * 7919 + i * 104729 + 12345) % len(rets[e.ticker])] for e in live]) for i in range(whole.DRAWS)]
    got = whole.queries()["random_null_percentile"](spark, SMALL).first()
    assert got.draws == whole.DRAWS and abs(got.actual - actual) < 2e-6
    assert abs(got.percentile - np.mean([m < actual for m in means])) < 1e-4


def test_stop_grid(spark):
    from pulsegrid.plans import services

    bars = collections.defaultdict(list)
    for r in sorted(services.bars(spark, SMALL).collect(), key=lambda r: (r.ticker, r.date)):
        bars[r.ticker].append(r)
    dates = {t: [r.date for r in x] for t, x in bars.items()}
    want = collections.defaultdict(list)
    for e in whole.orders(spark, SMALL).collect():
        i = bisect.bisect_right(dates.get(e.ticker, []), e.date)
        for hold in (3, 5, 10):
            path = bars[e.ticker][i : i + hold]
            if len(path) == hold:
                high = max(b.high for b in path)
                for stop in (0.1, 0.25, 0.5):
                    want[stop, hold].append(-stop if high >= path[0].open * (1 + stop) else (path[0].open - path[-1].close) / path[0].open)
    got = {(r.stop, r.hold): r for r in whole.queries()["short_stop_grid"](spark, SMALL).collect()}
    assert {k: r.n for k, r in got.items()} == {k: len(x) for k, x in want.items()} and min(map(len, want.values())) > 1000
    for k, x in want.items():
        assert abs(got[k]["mean"] - np.mean(x)) < 2e-6 and abs(got[k].win - np.mean([y > 0 for y in x])) < 2e-4


def test_documents_of_all_languages_are_there(spark):
    docs = S.table(spark, SF, "documents").count()
    assert whole.queries()["lexicon_sentiment"](spark, SF).count() == docs
    assert whole.queries()["ticker_extract"](spark, SF).count() == docs
    assert sum(r.n for r in whole.queries()["sentiment_distribution"](spark, SF).collect()) == docs


def test_only_ascii_letters_are_folded(spark):
    df = spark.createDataFrame([(1, "The \u212aey of THE"), (2, None), (3, "\u0130t OF tHe")], "id int, t string")
    assert [r[0] for r in df.select(T.words(F.col("t"))).collect()] == [["the", "of", "the"], [], ["of", "the"]]
    assert sorted(r.id for r in fulltext.phrase_search(df, ["t"], "of the").collect()) == [1, 3]


def test_words_stand_alone(spark):
    df = spark.createDataFrame([("covid19 snake_case great2 good \u00fcber na\u00efve Day-one",)], "t string")
    assert df.select(T.words(F.col("t"))).first()[0] == ["good", "day", "one"]


def test_replies_to_posts(spark):
    c = spark.createDataFrame([("1", "t3_7", "a"), ("2", "t1_1", "b"), ("3", "t3_8", "a"), ("4", "t3_9", "b"), ("5", "t3_7", "[deleted]")], "comment_id string, parent_id string, author string")
    p = spark.createDataFrame([(7, "x"), (8, "a"), (9, "[deleted]")], "id long, author string")
    assert sorted(map(tuple, posts.reply_edges(c, p).collect())) == [("a", "x", 1), ("b", "a", 1)]
    assert [tuple(r) for r in posts.reply_edges(c).collect()] == [("b", "a", 1)]


def test_pagerank_settles(spark):
    edges = [("a", "b", 3), ("b", "a", 1), ("b", "c", 1), ("c", "d", 2), ("d", "e", 1), ("e", "c", 1), ("f", "a", 5), ("g", "h", 1)]
    nodes = sorted({x for e in edges for x in e[:2]})
    n, at = len(nodes), {x: i for i, x in enumerate(nodes)}
    m = np.zeros((n, n))
    for s, d, w in edges:
        m[at[d], at[s]] += w
    out = m.sum(axis=0)
    m = np.where(out > 0, m / np.where(out > 0, out, 1), 1 / n)
    exact = np.linalg.solve(np.eye(n) - 0.85 * m, np.full(n, 0.15 / n))
    x, rounds, change = np.full(n, 1 / n), 0, 1.0
    while change >= n * 1e-6:
        new = 0.15 / n + 0.85 * m @ x
        x, change, rounds = new, np.abs(new - x).sum(), rounds + 1
    assert rounds > 12
    df = spark.createDataFrame(edges, "src string, dst string, weight long")
    got = {r.node: r["rank"] for r in graph.pagerank(df, rounds=100, tolerance=1e-6).collect()}
    assert all(abs(got[v] - x[at[v]]) < 6e-6 and abs(got[v] - exact[at[v]]) < 1e-4 for v in nodes)
    with pytest.raises(RuntimeError):
        graph.pagerank(df, rounds=12, tolerance=1e-6)
    assert graph.pagerank(df.limit(0), tolerance=1e-6).count() == 0


def test_threads_of_up_to_fifteen_tickers_count(spark):
    m = lookups.threads(board._threaded(spark, SF), S.comments(spark, SF))
    assert m.groupBy("thread").agg(F.countDistinct("ticker").alias("k")).where("k between 7 and 15").count() > 0
    rows = [(f"u{i}", f"T{k}") for i in range(3) for k in range(15)] + [("v", f"X{k}") for k in range(16)]
    assert mentions.cooccurrence(spark.createDataFrame(rows, "thread string, ticker string"), 15, 3, 1.0).count() == 15 * 14 // 2


def test_lead_lag_takes_every_ticker_with_enough_mentions(spark):
    got = whole.queries()["lead_lag"](spark, SF).collect()
    assert len({r.a for r in got} | {r.b for r in got}) > 20
