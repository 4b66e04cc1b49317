"""Stored tables, streams, feeds, samplers and the facade: against SQL where they have it, else against plain loops."""

import collections
import json
import os
import random
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from pulsegrid import facade, plugins
from pulsegrid.functions import valence
from pulsegrid.operators import communities, draws, fulltext, index
from pulsegrid.plans import stores
from pulsegrid.sources import fixtures as S
from pulsegrid.sources import cursor, files, markup, replies, tables
from pulsegrid.streaming import state
from tests.parity import differences

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(stores.oracle_sql()))
def test_matches_sql(spark, name):
    assert differences(spark, SF, stores.queries()[name], stores.oracle_sql()[name]) == []


def louvain(edges, seed=42, patience=2, least=1e-4):
    """The rule of communities(), node by node."""
    w = collections.Counter()
    for a, b, x in edges:
        if a != b and x > 0:
            w[min(a, b), max(a, b)] += int(np.floor(x / communities.UNIT + 0.5))
    near = collections.defaultdict(dict)
    for (a, b), x in w.items():
        near[a][b] = near[b][a] = x
    loops, names, total, level = dict.fromkeys(near, 0), {n: n for n in near}, 2 * sum(w.values()), 0
    while True:
        k = {n: sum(near[n].values()) + loops[n] for n in loops}
        comm = {n: n for n in loops}

        def quality(comm, near=near, loops=loops, k=k):
            inside = sum(x for a in near for b, x in near[a].items() if comm[a] == comm[b]) + sum(loops.values())
            tot = collections.Counter()
            for n, c in comm.items():
                tot[c] += k[n]
            return total * inside - sum(x * x for x in tot.values())

        now, turn, idle, moved = quality(comm), 0, 0, False
        while idle < patience and total:
            tot, size = collections.Counter(), collections.Counter(comm.values())
            for n, c in comm.items():
                tot[c] += k[n]
            new = dict(comm)
            for n in comm:
                if zlib.crc32(f"{seed}:{level}:{turn // 2}:{n}".encode()) % 2 != turn % 2:
                    continue
                to = collections.Counter()
                for m, x in near[n].items():
                    to[comm[m]] += x
                gain = {c: total * x - k[n] * (tot[c] - (k[n] if c == comm[n] else 0)) for c, x in to.items()}
                gain = {c: g for c, g in gain.items() if size[c] > 1 or size[comm[n]] > 1 or c <= comm[n]}
                stay = gain.pop(comm[n], -k[n] * (tot[comm[n]] - k[n]))
                if gain and max(gain.values()) > stay:
                    new[n] = min(c for c, g in gain.items() if g == max(gain.values()))
            after, turn = quality(new), turn + 1
            idle = 0 if after - now >= least * total * total else idle + 1
            if after > now:
                comm, now, moved = new, after, True
        if not moved:
            return names, now / total / total if total else 0.0
        names = {n: comm[c] for n, c in names.items()}
        merged, inner = collections.defaultdict(collections.Counter), collections.Counter()
        for a in near:
            for b, x in near[a].items():
                if comm[a] == comm[b]:
                    inner[comm[a]] += x
                else:
                    merged[comm[a]][comm[b]] += x
        for n, x in loops.items():
            inner[comm[n]] += x
        loops = {c: inner[c] for c in set(comm.values())}
        near = collections.defaultdict(dict, {c: dict(m) for c, m in merged.items()})
        level += 1


def test_communities(spark):
    rnd = random.Random(1)
    edges = [(f"n{i}", f"n{j}", rnd.random() + 0.5) for i in range(48) for j in range(i) if rnd.random() < (0.6 if i % 4 == j % 4 else 0.04)]
    noise = [("n1", "n1", 9.0), ("n1", "n2", -3.0), ("lone", "lone", 1.0)]
    df = spark.createDataFrame(edges[::2] + [(b, a, x) for a, b, x in edges[1::2]] + noise, "a string, b string, weight double")
    parts, q = communities.communities(df)
    got = {r.node: r.community for r in parts.collect()}
    want, quality = louvain(edges + noise)
    assert got == want and q == quality
    assert all((got[f"n{i}"] == got[f"n{j}"]) == (i % 4 == j % 4) for i in range(48) for j in range(i))
    total = 2 * sum(x for *_, x in edges)
    k = collections.Counter()
    for a, b, x in edges:
        k[a] += x
        k[b] += x
    by = collections.Counter()
    for n, c in got.items():
        by[c] += k[n]
    assert abs(q - (2 * sum(x for a, b, x in edges if got[a] == got[b]) / total - sum((x / total) ** 2 for x in by.values()))) < 1e-6
    parts, q = communities.communities(df.limit(0))
    assert parts.count() == 0 and q == 0


def test_clusters(spark):
    rows = [(f"t{i}", x) for i in range(4) for x in ("A", "B", "C")] + [(f"u{i}", x) for i in range(3) for x in ("D", "E")] + [("v", "F"), ("v", "A"), ("w", "D")]
    got = communities.clusters(spark.createDataFrame(rows, "thread string, ticker string"), top=None, min_shared=3).collect()
    assert [(r.tickers, r["size"], r.total_mentions) for r in got] == [("A,B,C", 3, 13), ("D,E", 2, 7)]


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a b a", "b"), (2, None, ""), (3, "A, b! a-b", None), (4, "a", "b"), (5, "aa aa aa aa aa", "x"), (6, "b a", "a a b"), (7, "K a b", "b a b a")], "id long, title string, selftext string")
    ix = index.PhraseIndex(spark, str(tmp_path / "ix"), ["title", "selftext"], buckets=4)
    with pytest.raises(FileNotFoundError):
        ix.search("a")
    ix.build(docs.where("id < 4"))
    ix.append(docs)
    ix.append(docs.where("id > 2"))
    phrases = ["a", "a b", "b a b", "aa aa", "a a", "no such", "", "k a", '"A B"']

    def check():
        for p in phrases:
            assert ix.search(p).collect() == fulltext.phrase_search(docs, ["title", "selftext"], p).collect(), p

    check()
    postings, _ = ix._entries(spark.createDataFrame([(8, "a b", "")], "id long, title string, selftext string"))
    postings.write.mode("append").partitionBy("bucket").parquet(ix._place(ix.generation, "postings"))  # a batch that died before its lengths
    check()
    ix.append(spark.createDataFrame([(8, "a b", "")], docs.schema))
    assert {(r.id, r.f) for r in ix.occurrences("a b").collect()} >= {(8, 1), (1, 3)}
    ix.compact()
    ix.vacuum()
    assert ix._generations() == [1] and ix.occurrences("a b").where("id = 8").count() == 1
    ix.build(docs.where("id <> 1"))
    assert 1 not in {r.id for r in ix.search("a").collect()}


def _shuffles(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") + df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_index_moves_postings_once(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b {i} a", "c") for i in range(20)], "id long, title string, selftext string")
    ix = index.PhraseIndex(spark, str(tmp_path / "ix"), ["title", "selftext"], buckets=2, parts=2)
    for part in ix._entries(docs):
        assert _shuffles(part) == 0
    assert {r.term: (list(r.positions), r.id) for r in ix._entries(docs.where("id = 7"))[0].collect()} == {"a": ([0, 3], 7), "b": ([1], 7), "7": ([2], 7), "c": ([4], 7)}
    ix.build(docs.where("id < 10"))
    given, real = [], index.PhraseIndex._entries
    monkeypatch.setattr(index.PhraseIndex, "_entries", lambda self, d: given.append(d) or real(self, d))
    ix.append(docs.where("id >= 10"))
    ix.append(docs)
    assert len(given) == 1 and _shuffles(given[0]) == 0
    more = spark.createDataFrame([(i, "a b", "") for i in (3, 30, 31)], docs.schema)
    ix.append(more)
    ix.compact()
    assert sorted((r.id, r.f) for r in ix.occurrences("a b").collect()) == [(i, 1) for i in [*range(20), 30, 31]]


def _events(spark, path, seed):
    """Events of authors in files whose order isn't that of time, and which repeat some rows."""
    rnd = random.Random(seed)
    rows = [(f"u{rnd.randrange(6)}", rnd.choice(["active", "active", "suspended", "deleted"]), 1_700_000_000 + 3600 * i) for i in range(120)]
    mixed = rows + rnd.sample(rows, 20)
    rnd.shuffle(mixed)
    for i in range(4):
        df = spark.createDataFrame(mixed[i::4], "username string, status string, s long").select("username", "status", F.timestamp_seconds("s").alias("at"))
        df.coalesce(1).write.mode("append").parquet(path)
    return rows


def test_status_of_a_stream_out_of_order(spark, tmp_path):
    rows = _events(spark, str(tmp_path / "in"), 5)
    want = {}
    for name, status, s in sorted(rows, key=lambda r: r[2]):
        old = want.get(name)
        want[name] = (status, s, s if old is None or old[0] != status else old[2])
    table = tables.KeyedTable(spark, str(tmp_path / "t"), ["username"], state.STATUS, 4)
    stream = lambda: state.status_transitions(state.table_stream(spark, str(tmp_path / "in"), 1), "30 days")
    for _ in range(2):  # the second run goes on where the first ended
        state.into_table(stream(), table, str(tmp_path / "c"), "checked_at")
        got = {r.username: (r.status, r.a, r.b) for r in table.read().select("username", "status", F.unix_seconds("checked_at").alias("a"), F.unix_seconds("changed_at").alias("b")).collect()}
        assert got == want
    state.into_table(stream(), table, str(tmp_path / "again"), "checked_at")  # replayed from the start into the same table
    assert table.read().count() == len(want)


def test_timers_settle_and_forget():
    rows = [(3, "b"), (1, "a"), (2, "a"), (5, "b"), (4, "c")]
    assert state._fold(None, None, None, rows) == ("b", 5, 5)
    assert state._fold(*state._fold(None, None, None, sorted(rows)[:3]), sorted(rows)[3:]) == ("b", 5, 5)
    assert state._fold("b", 1, 1, [(2, "b")]) == ("b", 2, 1)


class _State:
    """A value or list of a key's state, as far as the processor uses it; counts its calls."""

    def __init__(self):
        self.held, self.calls = None, 0

    def exists(self):
        return self.held is not None

    def get(self):
        self.calls += 1
        return iter(self.held) if isinstance(self.held, list) else self.held

    def update(self, x):
        self.held = tuple(x)

    def put(self, x):
        self.held = list(x)

    def appendList(self, x):  # noqa: N802
        self.held = (self.held or []) + list(x)

    def clear(self):
        self.held = None


def test_an_author_has_one_timer_and_few_entries():
    class Handle:
        timers, states, registered = set(), {}, 0

        def getValueState(self, name, schema):  # noqa: N802
            return self.states.setdefault(name, _State())

        getListState = getValueState  # noqa: N815

        def registerTimer(self, at):  # noqa: N802
            self.timers.add(at)
            self.registered += 1

        def deleteTimer(self, at):  # noqa: N802
            self.timers.remove(at)

    class Times:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    rnd, handle = random.Random(3), Handle()
    p = state.StatusTransitions()
    p.init(handle)
    rows = [(1000 * i, rnd.choice("ab")) for i in range(1, 3001)]
    late = rnd.sample(rows, 3000)
    give = lambda part, ms: next(p.handleInputRows(("u",), iter([pd.DataFrame({"at_us": [a for a, _ in part], "status": [x for _, x in part]})]), Times(ms)))
    give(late[:2000], 0)
    assert handle.registered == 1 and len(handle.states["waiting"].held) <= 2
    assert tuple(give(late[2000:] + late[:50], 0).iloc[0])[1:] == state._fold(None, None, None, rows)
    assert len(handle.timers) == 1 and handle.registered <= 2 and len(handle.states["waiting"].held) <= 4
    more = [(1000 * i, "c") for i in range(2500, 3500)]
    assert tuple(give(more, 2499).iloc[0])[1:] == state._fold(None, None, None, rows + more)
    assert handle.states["settled"].held[1] == 2_499_000 and handle.timers == {3500}
    handle.timers.clear()
    assert not list(p.handleExpiredTimer(("u",), Times(3500), None)) and not handle.timers
    assert handle.states["settled"].held == state._fold(None, None, None, rows + more) and not handle.states["waiting"].exists()


def test_growth_and_alerts_of_a_replayed_stream(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(rnd.randrange(5), rnd.randrange(50), 1_700_000_000 + 7200 * i) for i in range(90)]
    for i in range(3):
        spark.createDataFrame(rows[30 * i : 30 * i + 30], "id long, num_comments long, s long").select("id", "num_comments", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {}
    for i, n, s in rows:
        born, most, times, _ = want.get(i, (s, 0, 0, 0))
        if n > most and s <= born + 3 * 86400:
            most, times = n, times + 1
        want[i] = (born, most, times, s)
    table = tables.KeyedTable(spark, str(tmp_path / "t"), ["id"], state.GROWTH, 4)
    state.into_table(state.growing_threads(state.table_stream(spark, str(tmp_path / "in"), 1), 3, "30 days"), table, str(tmp_path / "c"), "num_comments")
    got = {r.id: (r.num_comments, r.refreshes) for r in table.read().collect()}
    assert {i: g[0] for i, g in got.items()} == {i: v[1] for i, v in want.items()}
    posts = spark.createDataFrame([(1, "Moon", None), (2, "x", "to the MOON"), (3, "y", "z")], "id long, title string, selftext string")
    for _ in range(2):
        posts.coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    seen = []
    state.run(state.new_alerts(state.table_stream(spark, str(tmp_path / "p"), 1), ["moon"]), lambda b, _: seen.extend(map(tuple, b.collect())), str(tmp_path / "pc"))
    assert sorted(seen) == [(1, "moon"), (2, "moon")]


def test_keyed_table_touches_only_its_buckets(spark, tmp_path):
    t = tables.KeyedTable(spark, str(tmp_path / "t"), ["k"], "k long, v string, at long", 8)
    assert t.read().count() == 0
    t.merge(spark.createDataFrame([(i, f"a{i}", 1) for i in range(40)], "k long, v string, at long"), newest="at")
    times = {p: os.stat(p).st_mtime_ns for p in map(str, (tmp_path / "t").glob("bucket=*/*.parquet"))}
    t.merge(spark.createDataFrame([(3, "old", 0), (3, "new", 2), (3, "newer", 5)], "k long, v string, at long"), newest="at")
    kept = {p: os.stat(p).st_mtime_ns for p in map(str, (tmp_path / "t").glob("bucket=*/*.parquet"))}
    assert sum(kept.get(p) == x for p, x in times.items()) == len(times) - 1
    assert {r.k: r.v for r in t.read().collect()} == {i: "newer" if i == 3 else f"a{i}" for i in range(40)}
    t.merge(spark.createDataFrame([(3, "late", 4)], "k long, v string, at long"), newest="at")
    t.merge(spark.createDataFrame([], "k long, v string, at long"))
    assert t.read().where("k = 3").first().v == "newer" and t.read().count() == 40


def test_snapshot_rewrites_only_touched_months(spark, tmp_path):
    rows = spark.createDataFrame([(t, f"2024-{m:02d}-{d:02d}", float(m)) for t in "AB" for m in range(1, 6) for d in (1, 20)] + [("C", None, 0.0)], "ticker string, date string, close double").withColumn("date", F.to_date("date"))
    snap = tables.Snapshot(spark, str(tmp_path / "s"))
    assert not snap.exists() and snap.read("p", rows).count() == 21
    with pytest.raises(FileNotFoundError):
        snap.read("p")
    assert [tuple(r) for r in snap.build({"p": rows, "gone": None}).collect()] == [("p", 21)] and snap.exists("p") and not snap.exists("gone")
    before = {p: os.stat(p).st_mtime_ns for p in map(str, (tmp_path / "s" / "p").glob("month=*/*.parquet"))}
    new = rows.where("date >= '2024-04-10' and date < '2024-05-01'").withColumn("close", F.lit(9.0))
    assert snap.replace_window("p", new, "2024-03-10") == ["2024-03", "2024-04", "2024-05"]
    after = {p: os.stat(p).st_mtime_ns for p in map(str, (tmp_path / "s" / "p").glob("month=*/*.parquet"))}
    assert all(after.get(p) == x for p, x in before.items() if re.search("month=(2024-0[12]|none)", p)) and not any("2024-05" in p for p in after)
    got = sorted((r.ticker, str(r.date), r.close) for r in snap.read("p").collect())
    old = [(r.ticker, str(r.date), r.close) for r in rows.collect() if r.date is None or str(r.date) < "2024-03-10"]
    assert got == sorted(old + [(t, "2024-04-20", 9.0) for t in "AB"])


def test_replies_twelve_deep(spark):
    deep = []
    for i in range(12, -1, -1):
        deep = [{"kind": "t1", "data": {"id": f"c{i}", "score": i - 3 if i % 2 else 9, "replies": {"data": {"children": deep}} if deep else ""}}, {"kind": "more", "data": {"id": "m", "replies": {"data": {"children": [{"kind": "t1", "data": {"id": "lost"}}]}}}}]
    rows = spark.createDataFrame([("k", json.dumps(deep)), ("broken", "nope"), ("none", None), ("empty", "[]")], "post string, l string")
    got = {(r.comment_id, r.depth) for r in replies.flattened(rows, "post", "l", 10, 0).collect()}
    assert got == {(f"c{i}", i) for i in range(11) if i % 2 == 0 or i >= 3}
    assert replies.flattened(rows, "post", "l", 20, -99).count() == 13 and replies.flattened(rows.limit(0), "post", "l").count() == 0


def test_broken_markup_is_set_aside(spark, tmp_path):
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title> a &amp; b </title><link href="http://l/1"/><published>2024-01-02T03:04:05+00:00</published></entry><entry><title>two</title><published>bad</published></entry></feed>'
    good, bad = markup.feed_posts(spark.createDataFrame([(feed,), ("<feed><entry>",), (None,), ("<feed></feed>",)], "value string"))
    assert sorted((r.title, r.permalink, str(r.created_utc)) for r in good.collect()) == [(" a & b ", "http://l/1", "2024-01-02 03:04:05"), ("two", None, "None")]
    assert [r.raw for r in bad.collect()] == ["<feed><entry>"]
    (tmp_path / "f.xml").write_text(feed)
    good, bad = markup.feed_files(spark, str(tmp_path))
    assert good.count() == 2 and bad.count() == 0
    form = "<ownershipDocument><nonDerivativeTable><nonDerivativeTransaction><transactionCoding><transactionCode> {c} </transactionCode></transactionCoding><transactionAmounts><transactionShares><footnoteId id='F1'/><value> {n}</value></transactionShares></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"
    rows = [("T", "4", "2024-01-03", "1", "x.xml", form.format(c="P", n=5)), ("T", "4/A", "2024-01-02", "2", "x.xml", form.format(c="P", n=5)), ("T", "4", "2024-01-03", "3", "x.xml", form.format(c="P", n=1)), ("U", "4", "2024-01-01", "4", "x.xml", form.format(c="P", n=0)), ("V", "4", "2024-01-01", "5", "x.xml", form.format(c="S", n=9)), ("W", "4", "2024-01-01", "6", "x.htm", form.format(c="P", n=9)), ("X", "3", "2024-01-01", "7", "x.xml", form.format(c="P", n=9)), ("Y", "4", "2024-01-01", "8", "x.xml", form[:90]), ("Z", "4", "2024-01-01", "9", "x.xml", form.format(c="P", n="many"))]
    filings = spark.createDataFrame(rows, "ticker string, form string, filing_date string, accession string, primary_doc string, xml string")
    good, bad = markup.purchase_dates(filings)
    assert [tuple(r) for r in good.collect()] == [("T", "2024-01-02"), ("T", "2024-01-03")] and [r.ticker for r in bad.collect()] == ["Y"]
    assert [tuple(r) for r in markup.purchase_dates(filings, limit=1)[0].collect()] == [("T", "2024-01-03")]
    uneven = spark.createDataFrame([("t", ["4", "S-3"], ["d1", "d2", "d3"], ["a"], ["x"]), ("n", None, None, None, None)], "t string, f array<string>, d array<string>, a array<string>, p array<string>")
    assert [tuple(r) for r in markup.listed_filings(uneven, "t", ["f", "d", "a", "p"]).collect()] == [("T", "4", "d1", "a", "x")]


def score(text, lexicon):
    """The steps of valence(), word by word."""
    punct = r"[!-/:-@\[-`{-~]"
    tokens = [w for w in re.split(r"\s+", re.sub(rf"(?<!\S){punct}+|{punct}+(?!\S)", "", text or "")) if w]
    low = [w.lower() for w in tokens]
    loud = [w == w.upper() and w != w.lower() for w in tokens]
    mixed = 0 < sum(loud) < len(tokens)
    but = low.index("but") if "but" in low else None

    def away(v, by):
        return v + by if v > 0 else v - by if v < 0 else v

    s = 0.0
    for i, w in enumerate(low):
        if w not in lexicon:
            continue
        v = away(lexicon[w], valence.CAPITALS if mixed and loud[i] else 0)
        for back in (1, 2, 3):
            j = i - back
            if j >= 0 and low[j] not in lexicon:
                b = valence.BOOST if low[j] in valence.STRONGER else -valence.BOOST if low[j] in valence.WEAKER else 0
                v = away(v, (b + (valence.CAPITALS if b and mixed and loud[j] else 0)) * valence.NEARER[back - 1])
                v *= valence.TURN if low[j] in valence.NEGATIONS or low[j].endswith("n't") else 1
        s += v * (1 if but is None or i == but else 0.5 if i < but else 1.5)
    n, q = (text or "").count("!"), (text or "").count("?")
    s = away(s, min(n, 4) * valence.MARK + (valence.DOUBTS if q > 3 else q * valence.DOUBT if q > 1 else 0))
    return s / (s * s + valence.SPREAD) ** 0.5


def test_finance_sentiment(spark):
    rnd = random.Random(7)
    lexicon = {**valence.GENERAL, **valence.FINANCE}
    pool = ["moon", "crash", "sell", "good", "bad", "not", "isn't", "VERY", "very", "slightly", "but", "the", "a", "it!", "why?", "(MOON)", "CRASH...", "So", "never", "of"]
    texts = [" ".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 14))) + rnd.choice(["", "!", "!!!!!", "??", "?????"]) for _ in range(400)] + [None, "", " ", "...", "moon", "MOON", "word " * 3000 + "moon"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(4)
    got = {r.id: r.v for r in df.select("id", valence.valence(F.col("t")).alias("v")).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] - score(t, lexicon)) <= 5.0001e-5, t
    told = {r.id: (r.x.score, r.x.label) for r in df.select("id", valence.finance_sentiment(F.col("t")).alias("x")).collect()}
    assert all(told[i] == (got[i], "positive" if got[i] >= 0.05 else "negative" if got[i] <= -0.05 else "neutral") for i in got if got[i])
    plain = df.sparkSession.createDataFrame([("neither here",)], "t string").select(valence.finance_sentiment(F.col("t")).alias("x")).first().x
    assert tuple(plain) == (0.0, "neutral")
    rows = {r.id: r for r in stores.queries()["finance_sentiment"](spark, SMALL).collect()}
    for r in S.posts(spark, SMALL).select("id", stores.slang(F.col("selftext")).alias("t")).collect():
        assert abs(rows[r.id].score - score(r.t, lexicon)) < 2e-4 or score(r.t, lexicon) == 0


def test_a_text_is_worked_out_once(spark):
    df = spark.createDataFrame([("a moon!",)], "t string").select(valence.finance_sentiment(F.regexp_replace("t", "marker", "")).alias("x"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("marker") == 1


def test_only_rows_near_the_threshold_are_ranked(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(20000)], "id long, net double")
    one = spark.range(1, 3).withColumnRenamed("id", "draw")
    got = {r.draw: r for r in draws._draws(df, one, 8000, 20000, 42, 6.0).collect()}
    for d in (1, 2):
        want = [float(i % 7) for i in sorted(range(20000), key=lambda i: (hashed(42, d, i), i))[:8000]]
        assert (got[d].taken, got[d].c) == (8000, 8000) and abs(got[d].m - np.mean(want)) < 1e-9
    plan = draws._draws(df, one, 8000, 20000, 42, 6.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.rindex("Aggregate")  # rows are summed below the window


def hashed(*longs):
    h = 42
    for x in longs:
        h = xxhash.xxh64(struct.pack("<q", x), seed=h).intdigest()
    return h - (1 << 64) if h >= 1 << 63 else h


@pytest.mark.parametrize(("n", "k", "draws_"), [(300, 40, 1000), (30, 30, 20), (50, 7, 50)])
def test_selection_null(spark, n, k, draws_):
    rnd = random.Random(n)
    rows = [(i, None if rnd.random() < 0.1 else rnd.gauss(0, 1), i < k) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, net double, c boolean")
    got = draws.selection_null(df, F.col("c"), draws_, 42)
    nets = {i: x for i, x, _ in rows}
    means = []
    for d in range(1, draws_ + 1):
        x = [nets[i] for i in sorted(nets, key=lambda i: (hashed(42, d, i), i))[:k] if nets[i] is not None]
        if len(x) >= 5:
            means.append(np.mean(x))
    means.sort()
    actual = np.mean([x for _, x, c in rows if c and x is not None])
    r = got.first()
    assert (r.n, r.draws) == (k, len(means)) and abs(r.actual - actual) < 2e-6
    assert abs(r.median - means[len(means) // 2]) < 2e-6 and abs(r.p95 - means[int(len(means) * 0.95)]) < 2e-6
    assert abs(r.percentile - 100 * np.mean([m < actual - 1e-12 for m in means])) < 0.011
    few = draws.selection_null(df.where("id < 3"), F.col("c"), 5).first()
    assert few.actual is None and few.draws == 0 and few.percentile is None
    assert draws.selection_null(df.limit(0), F.col("c"), 5).first().draws == 0


def test_short_draws_are_made_again(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i), i < 20) for i in range(100)], "id long, net double, c boolean")
    want = draws.selection_null(df, F.col("c"), 30).first()
    real = draws._draws
    monkeypatch.setattr(draws, "_draws", lambda u, d, k, n, seed, slack: real(u, d, k, n, seed, -4.5 if slack == 6.0 else slack))
    assert draws.selection_null(df, F.col("c"), 30).first() == want


def test_a_second_sample_adds_nothing(spark):
    rows = [(i, "s", f"u{i % 5}", f"2024-01-0{1 + i % 3} 00:{i % 60:02d}:00", (i % 7 - 3) / 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, subreddit string, author string, at string, sentiment double").select("id", "subreddit", "author", F.col("at").cast("timestamp").alias("created_utc"), "sentiment")
    none = spark.createDataFrame([], "date date, total_mentions long")
    got = draws.sampled_days(df, none, 100)
    assert [r.total_mentions for r in got.collect()] == [100] * 3
    assert draws.sampled_days(df, got, 100).count() == 0
    left = got.withColumn("total_mentions", F.when(F.dayofmonth("date") != 2, F.col("total_mentions")))
    assert [str(r.date) for r in draws.sampled_days(df, left, 100).collect()] == ["2024-01-02"]


def test_cursor_stops_and_splits_alike(spark, tmp_path):
    asked = []

    def pages(rows):
        def fetch(before, limit):
            asked.append(before)
            return sorted((r for r in rows if r["created"] < before), key=lambda r: -r["created"])[:limit]

        return fetch

    rows = [{"id": i, "created": 10 * i} for i in range(10)]
    assert [r["id"] for r in cursor.walk(pages(rows), 1000, 0, 3)] == list(range(9, -1, -1)) and asked == [1000, 70, 40, 10]
    asked.clear()
    assert [r["id"] for r in cursor.walk(pages(rows), 1000, 45, 3)] == [9, 8, 7, 6, 5] and len(asked) == 2  # the cutoff
    assert list(cursor.walk(lambda before, limit: [], 1000, 0, 3)) == []
    stuck = [{"id": 1, "created": 2000}]
    assert len(list(cursor.walk(lambda before, limit: stuck, 1000, 0, 3))) == 1  # nothing older than asked for: no progress
    start = 1_672_531_200  # 2023-01-01
    data = [(str(i), start + (i * 7919) % (365 * 86_400), "a", None) for i in range(800)] + [(f"t{i}", start + 5 * 86_400, "b", "tie") for i in range(40)]
    cursor.write_store(spark.createDataFrame(data, "id string, created long, author string, body string"), str(tmp_path / "s"))
    want = sorted(r[0] for r in data if r[1] < start + 334 * 86_400)
    for each, parts in ((12, 1), (1, 11)):
        got = cursor.read_archive(spark, str(tmp_path / "s"), "2023-01-01", "2023-12-01", each, 25)
        assert got.rdd.getNumPartitions() == parts and sorted(r.id for r in got.collect()) == want
    assert cursor.read_archive(spark, str(tmp_path / "s"), "2020-01-01", "2020-02-01").count() == 0


def test_folders_of_csv(spark, tmp_path):
    assert files.read_folders(spark, str(tmp_path / "none")) is None
    for name, text in (("a", 'id,title,score,created_utc\n1,"two\nlines, ""quoted""",5,2024-01-02\n2,x y,many,2024-02-01\n'), ("b", "id,title\n3,(x.y)\n"), ("empty", None)):
        (tmp_path / "d" / name).mkdir(parents=True)
        if text:
            (tmp_path / "d" / name / "posts.csv").write_text(text)
    rows = files.read_folders(spark, str(tmp_path / "d"))

    def ids(**k):
        return [r.id for r in files.search(rows, **k).collect()]

    assert {(r.id, r.source, r.title) for r in rows.collect()} == {("1", "a", 'two\nlines, "quoted"'), ("2", "a", "x y"), ("3", "b", "(x.y)")}
    assert ids()[0] == "1" and len(ids()) == 3 and len(ids(limit=2)) == 2 and ids(ascending=True)[-1] == "1"
    assert ids(query="(X.Y)") == ["3"] and sorted(ids(query="X.Y", regex=True)) == ["2", "3"] and ids(query="x", column="title", author="nobody", post_type="t") != []
    assert ids(min_score=1) == ["1"] and ids(max_score=4) == [] and sorted(ids(start="2024-01-15")) == ["2"] and ids(end="2024-01-15") == ["1"]
    new = spark.createDataFrame([("k1", "b"), ("k1", "a"), (None, "z"), ("k2", 'say "hi"\nthere')], "k string, t string")
    for _ in range(2):
        files.append_csv(new, str(tmp_path / "out"), "k")
    assert sorted((r.k, r.t) for r in spark.read.options(**files.CSV).csv(str(tmp_path / "out")).collect()) == [("k1", "a"), ("k2", 'say "hi"\nthere')]
    assert files.exported(spark, str(tmp_path / "nowhere")).count() == 0
    events = spark.createDataFrame([("s", -1, "B", "2024-01-02"), ("s", -1, "A", "2024-01-03"), ("s", -1, "A", "2024-01-03")], "strategy string, side int, ticker string, d string").withColumn("date", F.to_date("d"))
    files.signal_dates(events, str(tmp_path / "sig"))
    lines = [x for f in sorted((tmp_path / "sig").glob("part-*")) for x in f.read_text().splitlines() if not x.startswith("strategy")]
    assert lines == ["s,-1,A,2024-01-03", "s,-1,B,2024-01-02"]


class Loud(plugins.Plugin):
    name = "loud"

    def process_posts(self, posts):
        return posts.withColumn("title", F.upper("title"))


class Broken(plugins.Plugin):
    name = "broken"

    def process_posts(self, posts):
        return posts.withColumn("title", F.lit("gone")).select("title", "no_such_column")


def test_plugins(spark, tmp_path):
    (tmp_path / "b_second.py").write_text("from pulsegrid.plugins import Plugin\nclass Second(Plugin):\n    name = 'second'\n    def process_posts(self, p):\n        return p\nclass Off(Plugin):\n    name = 'off'\n    enabled = False\nclass Also(Plugin):\n    name = 'also'\n")
    (tmp_path / "a_first.py").write_text("from pulsegrid.plugins import Plugin, SentimentTagger\nclass First(Plugin):\n    name = 'first'\n")
    (tmp_path / "c_bad.py").write_text("raise RuntimeError('no')\n")
    (tmp_path / "_skipped.py").write_text("raise RuntimeError('never read')\n")
    found, failed = plugins.load(tmp_path)
    assert [p.name for p in found] == ["first", "second", "also"] and failed == [("c_bad.py", "RuntimeError: no")]
    posts = spark.createDataFrame([(2, "/a", "good good bad the the the"), (1, "/a", "Good"), (3, None, "x"), (4, "", "y"), (5, "/b", None)], "id long, permalink string, title string").withColumn("selftext", F.lit(None).cast("string"))
    comments = spark.createDataFrame([("c", 1, "bad"), ("c", 0, "good"), (None, 1, "x")], "comment_id string, post_id long, body string")
    p, c, report = plugins.run(posts, comments, [plugins.Deduplicator(), Broken(), plugins.KeywordExtractor(), plugins.SentimentTagger(), Loud()])
    assert sorted((r.id, r.title, r.keywords, r.sentiment_label) for r in p.collect()) == [(1, "GOOD", "good", "positive"), (5, None, "", "neutral")]
    assert [(r.comment_id, r.post_id, r.sentiment_label) for r in c.collect()] == [("c", 0, "positive")]
    assert [(r.name, r.applied) for r in report.orderBy("place").collect()] == [("deduplicator", True), ("broken", False), ("keyword_extractor", True), ("sentiment_tagger", True), ("loud", True)]


ALLOWED = ["select count(*) c from posts", "WITH x AS (SELECT subreddit, score FROM posts) SELECT * FROM x WHERE score > (SELECT avg(score) FROM posts)", "select 'drop table LIMIT' a from posts", "SELECT p.id FROM posts p JOIN comments c ON p.id = c.post_id ORDER BY 1 LIMIT 2", "select 1 as one", "(select id from posts) union all (select post_id from comments)"]
REFUSED = ["drop table posts", "select 1; select 2", "insert into posts select * from posts", "select * from parquet.`/root/testdata/sf0.001/region.parquet`", "select * from other", "select reflect('java.lang.System', 'getenv', 'HOME') from posts", "select * from range(5)", "select * from posts where id in (select id from hidden)", "set a=1", "create view v as select 1", "explain select 1", "with x as (select * from hidden) select * from x", "select (select max(x) from hidden) from posts", "select * from posts, lateral (select * from hidden)", "select * from default.posts", "", "cache table posts", "select * from posts where exists (select 1 from hidden)"]


def test_sql_is_judged_by_its_plan(spark):
    board = facade.Board(spark, {n: getattr(S, n)(spark, SMALL) for n in ("posts", "comments", "mentions", "authors")}, S.AS_OF)
    for q in ALLOWED:
        assert board.sql(q, 3).count() <= 3, q
    assert board.sql(ALLOWED[3], 100).count() == 2 and board.sql(ALLOWED[2]).count() == 100
    for q in REFUSED:
        with pytest.raises(facade.Refused):
            board.sql(q)
    for n in (0, 1001):
        with pytest.raises(facade.Refused):
            board.sql("select 1", n)
    assert board.ask("/posts/{id}", id=5).count() == board.ask("/posts/5").count() == 1
    with pytest.raises(KeyError):
        board.ask("/nowhere/5/x")
    for path in ("/info", "/posts", "/comments", "/subreddits", "/subreddits/summary", "/subreddits/src1/stats", "/tickers/trending", "/tickers/T01/timeseries", "/analytics/momentum", "/analytics/pump-suspects", "/graph/propagation/T01", "/grafana/search"):
        assert board.ask(path).columns
    assert board.ask("/query", statement="select id from posts").count() == 100
