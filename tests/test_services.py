"""Hand-computed cases of feeds, keyed writes, graphs, search, trades and streams."""

import datetime as dt

from pyspark.sql import functions as F

from pulsegrid.operators import fulltext, graph, trades, writes
from pulsegrid.sources import feeds
from pulsegrid.streaming import ingest

D = dt.date


def test_lines_and_json_that_do_not_parse_are_left_out(spark):
    lines = spark.createDataFrame([("Date|Symbol|a|b|Total",), ("20240102|A|1|0|4|X",), ("20240102|B|1|0|0",), ("x",), (None,)], "value string")
    assert [(r.ticker, r.date, r.short_ratio) for r in feeds.short_volume_lines(lines).collect()] == [("A", D(2024, 1, 2), 0.25)]
    lines = spark.createDataFrame([('{"id":"a","is_self":true,"url":"x.JPG"}',), ("{",), ("{}",), (None,)], "value string")
    assert [(r.id, r.post_type, r.score) for r in feeds.posts_from_json(lines).collect()] == [("a", "image", 0)]


def test_closed_rows_never_reopen(spark):
    schema = "id int, status string, net double"
    log = spark.createDataFrame([(1, "open", None), (2, "closed", 0.5), (3, "open", None)], schema)
    new = spark.createDataFrame([(1, "closed", 0.1), (2, "open", None), (3, "open", 9.0), (4, "open", None)], schema)
    once = writes.close_open(log, new, ["id"])
    want = [(1, "closed", 0.1), (2, "closed", 0.5), (3, "open", None), (4, "open", None)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, writes.close_open(once, new, ["id"]).collect())) == want


def test_facts_without_a_source_stay(spark):
    facts = spark.createDataFrame([("A", 1), ("B", 1), ("A", 2)], "ticker string, source_id int")
    src = spark.createDataFrame([(1, "A C")], "source_id int, text string")
    kept, removed = writes.revalidated(facts, src, "source_id", F.split("text", " "), "ticker")
    assert sorted(map(tuple, kept.collect())) == [("A", 1), ("A", 2)] and [tuple(r) for r in removed.collect()] == [("B", 1)]


def test_phrase_and_empty_inputs(spark):
    df = spark.createDataFrame([(1, "Of the of THE"), (2, "the of"), (3, ""), (4, None)], "id int, text string")
    assert [r.id for r in fulltext.phrase_search(df, ["text"], '"of the"').collect()] == [1]
    assert fulltext.phrase_search(df, ["text"], '""').count() == 0
    none = spark.createDataFrame([], "src string, dst string, weight long")
    assert graph.pagerank(none, rounds=2).count() == 0
    assert [r.line for r in trades.signal_lines(none, ["src"]).collect()] == ["# flat"]


def test_a_stop_is_hit_at_the_first_high(spark):
    bars = spark.createDataFrame([("A", D(2024, 1, i), 10.0, h, 9.0, c) for i, h, c in ((1, 10.0, 10.0), (2, 10.5, 10.0), (3, 13.0, 8.0), (4, 10.0, 5.0))], "ticker string, date date, open double, high double, low double, close double")
    events = spark.createDataFrame([(1, "A", D(2024, 1, 1)), (2, "A", D(2024, 1, 4)), (3, "B", D(2024, 1, 1))], "id int, ticker string, date date")
    got = {(r.stop, r.hold): (r.n, r["mean"]) for r in trades.short_grid(events, bars, [0.2, 0.5], [1, 3]).collect()}
    assert got == {(0.2, 1): (1, 0.0), (0.5, 1): (1, 0.0), (0.2, 3): (1, -0.2), (0.5, 3): (1, 0.5)}


def test_streams_drop_repeats_and_count_windows(spark, tmp_path):
    rows = [("a", "T", dt.datetime(2024, 1, 1, 0, 10), 1.0), ("a", "T", dt.datetime(2024, 1, 1, 0, 20), 1.0), ("b", "T", dt.datetime(2024, 1, 1, 1, 10), 0.0)]
    schema = "id string, ticker string, created_utc timestamp, sentiment_score double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination(60)
        return spark.table(name).collect()

    assert sorted(r.id for r in run(ingest.unseen(read(), "id", "created_utc"), "unseen", "append")) == ["a", "b"]
    assert sorted(r.mentions for r in run(ingest.windowed_mentions(read(), "1 hour", None, "1 hour"), "counts", "update")) == [1, 2]
