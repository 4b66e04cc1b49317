"""Queries on stored tables: indexes, snapshots, streams into keyed tables, nested and marked-up feeds, samplers, plug-ins, SQL; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pulsegrid import facade, plugins
from pulsegrid.functions import valence
from pulsegrid.operators import communities, draws, features, index, lookups, macro, posts
from pulsegrid.operators.steps import folder
from pulsegrid.plans import board, studies, whole
from pulsegrid.sources import fixtures as S
from pulsegrid.sources import cursor, files, markup, replies, tables
from pulsegrid.streaming import state

ALERTS = ["tion of", "zzz", "The "]
#: Frequent words of the invented prose stand for words of trade.
SLANG = {"the": "moon", "of": "not", "and": "CRASH", "le": "very", "la": "sell", "de": "good", "to": "but", "les": "slightly"}


def _place(s, what: str) -> str:
    return f"{folder(s)}/{what}-{uuid.uuid4().hex}"


def _clusters(s, d):
    threads = lookups.clean_threads(lookups.threads(board._threaded(s, d), S.comments(s, d)))
    return communities.clusters(threads, top=None, min_shared=2)


def _indexed(s, d):
    """Built on half of the posts, the others appended twice, then compacted."""
    ix, p = index.PhraseIndex(s, _place(s, "index"), ["title", "selftext"], buckets=16), S.posts(s, d)
    ix.build(p.where("id % 2 = 0"))
    ix.append(p.where("id % 2 = 1"))
    ix.append(p)
    ix.compact()
    ix.vacuum()
    return ix.search('"of the"')


def _post_stream(s, d):
    """The fixture's posts, as a stream of the documents' files."""
    docs = state.table_stream(s, f"{d}/documents.parquet")
    return docs.select(F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("selftext"))


def _streamed_index(s, d):
    ix = index.PhraseIndex(s, _place(s, "index"), ["title", "selftext"], buckets=16)
    state.into_index(_post_stream(s, d), ix, _place(s, "stream"))
    return ix.search('"of the"')


def _streamed_alerts(s, d):
    table = tables.KeyedTable(s, _place(s, "alerts"), ["id"], "id long, matched string")
    state.into_table(state.new_alerts(_post_stream(s, d), ALERTS), table, _place(s, "stream"))
    return table.read()


def _checks(events):
    """An author's status at each event."""
    status = F.when(F.col("value") > 60, "suspended").when(F.col("value") < 10, "deleted").otherwise("active")
    return events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"))


def _streamed_status(s, d):
    table = tables.KeyedTable(s, _place(s, "status"), ["username"], state.STATUS)
    state.into_table(state.status_transitions(_checks(state.table_stream(s, f"{d}/events.parquet"))), table, _place(s, "stream"), "checked_at")
    return table.read().select("username", "status", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("checked_at", "changed_at")])


def _counts(events):
    return events.select(F.get_json_object("props", "$.k").cast("long").alias("id"), F.floor("value").cast("long").alias("num_comments"), F.col("ts").cast("timestamp").alias("at"))


def _streamed_growth(s, d):
    table = tables.KeyedTable(s, _place(s, "growth"), ["id"], state.GROWTH)
    state.into_table(state.growing_threads(_counts(state.table_stream(s, f"{d}/events.parquet"))), table, _place(s, "stream"), "num_comments")
    return table.read().select("id", "num_comments", "refreshes", F.col("at").cast("timestamp_ntz").alias("at"))


def _nested(s, d):
    """Each conversation as one listing, every turn hanging below the one before; each seventh conversation's third turn is a stub, which ends it."""
    c = S.table(s, d, "conversations")
    stub = (F.col("conv_id") % 7 == 0) & (F.col("turn") == 2)
    score = F.when(F.col("turn") % 3 == 1, -5).otherwise(F.length("text") % 40).cast("long")
    own = F.struct(F.concat_ws("_", "conv_id", "turn").alias("id"), F.lit("p").alias("parent_id"), F.col("role").alias("author"), F.col("text").alias("body"), score.alias("score"), (F.col("turn") * 60.0).alias("created_utc"))
    turn = F.struct("turn", F.when(stub, "more").otherwise("t1").alias("kind"), F.to_json(own, {"ignoreNullFields": "false"}).alias("data"))
    rows = c.groupBy("conv_id").agg(F.reverse(F.array_sort(F.collect_list(turn))).alias("turns"))

    def wrap(inner, t):
        below = F.when(inner == "", '""').otherwise(F.concat(F.lit('{"kind":"Listing","data":{"children":'), inner, F.lit("}}")))
        return F.concat(F.lit('[{"kind":"'), t["kind"], F.lit('","data":'), F.substring(t["data"], F.lit(1), F.length(t["data"]) - 1), F.lit(',"replies":'), below, F.lit("}}]"))

    listing = F.aggregate("turns", F.lit(""), wrap)
    out = replies.flattened(rows.select(F.col("conv_id").alias("post"), listing.alias("listing")), "post", "listing", max_depth=10, min_score=3)
    return out.select("post", "comment_id", "author", "score", "depth", F.length("body").alias("chars"), F.unix_seconds("created_utc").alias("at"))


def _escaped(text):
    """As text of an element, without what XML can't hold."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿\r]", " ")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _feed(s, d):
    """Posts in feeds of twenty."""
    p = S.posts(s, d).where("title is not null")
    entry = F.concat(F.lit("<entry><title>"), _escaped(F.col("title")), F.lit('</title><link rel="alternate" href="http://b/'), F.col("id").cast("string"), F.lit('"/><published>'), F.date_format("created_utc", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00</published></entry>"))
    feeds = p.groupBy(F.floor(F.col("id") / 20)).agg(F.concat(F.lit('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>'), F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("value"))
    good, _ = markup.feed_posts(feeds)
    return good.select("permalink", F.length("title").alias("chars"), F.col("created_utc").cast("timestamp_ntz").alias("created_utc"), "post_type", "source")


def _form4(s, d):
    """Each order as a filing, its lines as transactions: returned ones are purchases."""
    t = F.concat(F.lit("<nonDerivativeTransaction><transactionCoding><transactionCode>"), F.when(F.col("l_returnflag") == "R", "P").otherwise("S"), F.lit("</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>"), (F.col("l_quantity") - 10).cast("string"), F.lit("</value></transactionShares></transactionAmounts></nonDerivativeTransaction>"))
    lines = S.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("<ownershipDocument><nonDerivativeTable>"), F.array_join(F.collect_list(t), ""), F.lit("</nonDerivativeTable></ownershipDocument>")).alias("xml"))
    form = F.element_at(F.array(*map(F.lit, ("4", "4/A", "S-3", "SC 13D"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    o = S.table(s, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(F.concat(F.lit("C"), (F.col("o_custkey") % 40).cast("string")).alias("ticker"), form.alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filing_date"), F.col("o_orderkey").cast("string").alias("accession"), F.when(F.col("o_orderkey") % 5 == 0, "a.txt").otherwise("a.xml").alias("primary_doc"), "xml")


def _listed(s, d):
    """The same filings as parallel arrays a ticker, as the feed lists them."""
    f = _form4(s, d)
    one = F.struct("filing_date", "accession", "form", "primary_doc")
    arrays = f.groupBy("ticker").agg(F.array_sort(F.collect_list(one)).alias("a"))
    rows = arrays.select(F.lower("ticker").alias("t"), *[F.col(f"a.{c}").alias(c) for c in ("form", "filing_date", "accession", "primary_doc")])
    return markup.listed_filings(rows, "t", ["form", "filing_date", "accession", "primary_doc"])


def _snapshot(s, d):
    """Prices as a snapshot; from a date on they are replaced by doubled ones of even days."""
    snap, p = tables.Snapshot(s, _place(s, "snapshot")), S.prices_long(s, d)
    snap.build({"prices": p, "absent": None})
    snap.replace_window("prices", p.where(F.dayofmonth("date") % 2 == 0).withColumn("close", F.col("close") * 2), "1996-03-15")
    return snap.read("prices").groupBy("ticker", F.year("date").cast("int").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close") + 1e-9, 4).alias("total"))


def _board(s, d):
    return facade.Board(s, {n: getattr(S, n)(s, d) for n in ("posts", "comments", "mentions", "authors")}, S.AS_OF)


BOARD_SQL = "SELECT subreddit, count(*) AS n, max(score) AS top FROM posts WHERE score >= (SELECT avg(score) FROM posts) GROUP BY subreddit"


def slang(text):
    for a, b in SLANG.items():
        text = F.regexp_replace(text, rf"(?<!\S){a}(?!\S)", b)
    return text


def _finance(s, d):
    return S.posts(s, d).select("id", valence.finance_sentiment(slang(F.col("selftext"))).alias("x")).select("id", "x.*")


def _selection(s, d):
    """Is the mean net of the surest calls better than that of as many calls drawn from all?"""
    t = studies.trades(s, d)
    return draws.selection_null(t.select(F.col("id").cast("long").alias("id"), "net", "sentiment"), F.col("sentiment") >= 0.95)


def _sampled(s, d):
    e = S.mentions(s, d).select("source_id", "subreddit", "author", "created_utc", F.col("sentiment_score").alias("sentiment")).withColumn("id", F.col("source_id").cast("long"))
    known = e.where(F.dayofmonth("created_utc") == 3).groupBy(F.to_date("created_utc").alias("date")).agg(F.count(F.lit(1)).alias("total_mentions"))
    return draws.sampled_days(e, known, 20)


def _archive(s, d):
    """All orders as an archive in days, read back from 1993 on by a cursor, three months to a task."""
    o, path = S.table(s, d, "orders"), _place(s, "archive")
    cursor.write_store(o.select(F.col("o_orderkey").cast("string").alias("id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created"), F.concat(F.lit("a"), (F.col("o_custkey") % 40).cast("string")).alias("author"), F.col("o_orderpriority").alias("body")), path, 1)
    return cursor.read_archive(s, path, "1993-01-01", "1998-07-15", 3, 50)


def _folders(s, d):
    """Posts in a folder of CSV for each community, one without the column of types; searched in all of them."""
    root, p = _place(s, "csv"), S.posts(s, d).select("id", "subreddit", "title", "selftext", "score", "post_type", "author")
    for name in (f"src{i}" for i in range(20)):
        part = p.where(F.col("subreddit") == name).drop("subreddit")
        (part.drop("post_type") if name == "src2" else part).write.options(**files.CSV).csv(f"{root}/{name}/posts.csv")
    out = files.search(files.read_folders(s, root), "AN", min_score=20, max_score=80, limit=None)
    return out.select(F.col("id").cast("long").alias("id"), "source", F.col("score").cast("long").alias("score"), "post_type", F.sha2("selftext", 256).alias("h"))


def _appended(s, d):
    """Posts added to a file in three overlapping steps."""
    path, p = _place(s, "csv"), S.posts(s, d).select("id", "author", "score", "selftext")
    for rule in ("score < 60", "score >= 30", "score is not null"):
        files.append_csv(p.where(rule), path, "id")
    got = s.read.options(**files.CSV).csv(path)
    return got.select(F.col("id").cast("long").alias("id"), "author", F.col("score").cast("long").alias("score"), F.sha2("selftext", 256).alias("h"))


def _exported(s, d):
    """Tables with all columns as text are exported with their kinds; what is listed is what was written."""
    out, p = _place(s, "export"), S.posts(s, d).select("id", "subreddit", F.col("score").cast("string").alias("score"), F.date_format("created_utc", "yyyy-MM-dd HH:mm:ss").alias("created_utc"), F.when(F.col("id") % 2 == 0, "true").alias("has_media"))
    written = files.export({"posts": p, "comments": S.comments(s, d), "nothing": p.limit(0), "absent": None}, out, "20240131")
    total = s.read.parquet(f"{out}/db_posts_20240131").agg(F.sum("score").cast("long").alias("score"), F.sum(F.col("has_media").cast("int")).cast("long").alias("media"), F.max("created_utc").cast("timestamp_ntz").alias("last"))
    listed = files.exported(s, out).select(F.regexp_extract("name", "db_(.*)_20240131", 1).alias("name"), (F.col("bytes") > 0).alias("there"))
    return written.select("name", "rows").join(listed, "name").crossJoin(F.broadcast(total))


def _media(s, d):
    n = F.col("doc_id")
    url = F.when(n % 5 == 0, "https://i.redd.it/x.PNG?s=1").when(n % 5 == 1, "https://youtu.be/x").when(n % 5 == 2, "https://h/a.gif").otherwise("https://h/x")
    video = F.struct(F.struct(F.concat(F.lit("https://v/"), n.cast("string"), F.lit("?a=1")).alias("fallback_url")).alias("reddit_video"))
    preview = F.struct(F.when(n % 3 == 0, F.array(F.struct(F.struct(F.lit("https://p/1?x=1&amp;y=2").alias("url")).alias("source")))).alias("images"))
    items = F.struct(F.array(F.struct(F.lit("m2").alias("media_id")), F.struct(F.lit("gone").alias("media_id")), F.struct(F.lit("m1").alias("media_id"))).alias("items"))
    known = F.create_map(*[x for k in ("m1", "m2") for x in (F.lit(k), F.struct(F.struct(F.concat(F.lit(f"https://g/{k}?&amp;"), F.coalesce("source", F.lit("none"))).alias("u")).alias("s")))])
    line = F.to_json(F.struct(n.cast("string").alias("id"), url.alias("url"), (n % 4 == 0).alias("is_video"), (n % 7 == 0).alias("is_gallery"), video.alias("media"), preview.alias("preview"), items.alias("gallery_data"), known.alias("media_metadata")))
    return files.media_urls(S.table(s, d, "documents").select(line.alias("value"))).select("id", *[F.array_join(c, " ").alias(c) for c in ("images", "videos", "galleries")])


def _market(s, d):
    """The market's days from the orders' calls, with their percentile over 90 days and the froth of days on which a ticker is called twice."""
    c = studies.calls(s, d)
    m = c.select("ticker", F.lit("post").alias("source_type"), "author", F.col("date").cast("timestamp_ntz").alias("created_utc"), F.col("sentiment").alias("sentiment_score"))
    daily = features.aggregate_daily(m, S.authors(s, d)).select("date", "total_mentions", "tickers", "bull_frac", "bear_frac", "rrai_raw")
    twice = c.groupBy("date", "ticker").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("date").agg(F.count(F.lit(1)).alias("froth"))
    pct = features.trailing_percentile(daily, 90, 30, 3).select("date", "rrai_pct")
    return macro.with_froth(daily, twice).join(pct, "date")


def _capitulations(s, d):
    o = S.table(s, d, "orders")
    vix = o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.round(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / (100.0 * F.count(F.lit(1))) / 9000, 6).alias("close")).where(F.dayofmonth("date") % 3 > 0)
    volume = S.table(s, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.count(F.lit(1)).cast("double").alias("volume"))
    return macro.capitulation_sets(_market(s, d), vix, volume, studies._spy(s, d))


def _kept(s, d):
    c = S.comments(s, d).withColumn("created_utc", F.col("depth"))
    p = S.posts(s, d).select("id", F.when(F.col("id") % 11 == 0, 600).otherwise(F.col("num_comments")).alias("num_comments"))
    done = p.where("id % 13 = 0").select(F.col("id").alias("post_id"))
    tickered = p.where("id % 2 = 0").select(F.col("id").alias("post_id"))
    kept, log = draws.kept_comments(p, c, tickered, done, F.contains("body", F.lit("la")), newest=2, floor=300, mega_floor=500)
    return log.join(kept.groupBy("post_id").agg(F.sum("score").cast("long").alias("score")), "post_id", "left")


def _plugged(s, d):
    p = S.posts(s, d).withColumn("permalink", F.concat(F.lit("/r/"), (F.col("id") - F.col("id") % 3).cast("string")))
    out, _, _ = plugins.run(p, S.comments(s, d), [plugins.Deduplicator(), plugins.KeywordExtractor(), plugins.SentimentTagger()])
    return out.select("id", "permalink", "keywords")


QUERIES = {
    "ticker_clusters": _clusters,
    "indexed_phrase_search": _indexed,
    "streamed_phrase_search": _streamed_index,
    "streamed_alerts": _streamed_alerts,
    "streamed_status": _streamed_status,
    "streamed_growth": _streamed_growth,
    "nested_replies": _nested,
    "feed_entries": _feed,
    "insider_purchases": lambda s, d: markup.purchase_dates(_form4(s, d))[0],
    "stake_filings": lambda s, d: markup.filing_dates(_listed(s, d), markup.ACTIVIST),
    "offering_filings": lambda s, d: markup.filing_dates(_listed(s, d), markup.OFFERING),
    "snapshot_window": _snapshot,
    "board_sql": lambda s, d: _board(s, d).sql(BOARD_SQL),
    "chart_points": lambda s, d: _board(s, d).ask("/grafana/query", targets=["src1", None, "src4"]),
    "ticker_sentiment_route": lambda s, d: _board(s, d).ask("/tickers/$t07/sentiment", window_hours=240),
    "finance_sentiment": _finance,
    "selection_null": _selection,
    "sampled_days": _sampled,
    "kept_comments": _kept,
    "archive_by_cursor": _archive,
    "macro_candidates": lambda s, d: macro.candidates(_market(s, d)),
    "capitulation_sets": _capitulations,
    "csv_folders_search": _folders,
    "csv_append": _appended,
    "parquet_export": _exported,
    "media_urls": _media,
    "plugin_chain": _plugged,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Clusters, finance sentiment and the selection null have none: tests hold them against plain loops."""
    v = S.with_views
    phrase = whole.oracle_sql()["phrase_search"]
    form4 = """f AS (SELECT 'C' || (o_custkey % 40) AS ticker, ['4', '4/A', 'S-3', 'SC 13D'][o_orderkey % 4 + 1] AS form, strftime(o_orderdate, '%Y-%m-%d') AS filing_date,
 o_orderkey % 5 <> 0 AS xml, o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""
    status = "CASE WHEN value > 60 THEN 'suspended' WHEN value < 10 THEN 'deleted' ELSE 'active' END"
    words = whole._ASCII.format(x="coalesce(title, '') || ' ' || coalesce(selftext, '')")
    days = f"""c AS ({studies._CALLS}), a AS (SELECT date, count(*) AS n, count(DISTINCT ticker) AS tickers, round(avg(CASE WHEN sentiment > 0.3 THEN 1.0e0 ELSE 0 END) + 1e-9, 4) AS bull,
 round(avg(CASE WHEN sentiment < 0 THEN 1.0e0 ELSE 0 END) + 1e-9, 4) AS bear FROM c GROUP BY 1), b AS (SELECT *, round(bull - bear + 1e-9, 4) AS raw FROM a),
 l AS (SELECT date, raw, list(raw) OVER (ORDER BY date ROWS 89 PRECEDING) AS seen FROM b WHERE n >= 3),
 p AS (SELECT date, CASE WHEN len(seen) >= 30 THEN round(len(list_filter(seen, lambda x: x <= raw)) / CAST(len(seen) AS DOUBLE) + 1e-9, 4) END AS pct FROM l),
 f AS (SELECT date, count(*) AS froth FROM (SELECT date, ticker FROM c GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
 day AS (SELECT b.*, pct, coalesce(froth, 0) / CAST(tickers AS DOUBLE) AS share FROM b LEFT JOIN p USING (date) LEFT JOIN f USING (date))"""
    rank = "CASE WHEN len(list({x}) OVER w) >= 30 THEN len(list_filter(list({x}) OVER w, lambda q: q <= {x})) / CAST(len(list({x}) OVER w) AS DOUBLE) END"
    return {
        "macro_candidates": f"""WITH {days}, r AS (SELECT date, pct, raw - lag(raw, 5) OVER (ORDER BY date) AS chg, {rank.format(x="share")} AS rf, {rank.format(x="bull")} AS rb, {rank.format(x="bear")} AS rr
 FROM day WHERE pct IS NOT NULL WINDOW w AS (ORDER BY date ROWS 89 PRECEDING)),
 k AS (SELECT date, unnest([CASE WHEN pct <= 0.15 THEN 'capitulation_long' END, CASE WHEN pct >= 0.85 THEN 'euphoria_short' END, CASE WHEN chg > 0.08 THEN 'rrai_up_momentum_long' END, CASE WHEN chg > 0.08 THEN 'rrai_up_fade_short' END,
 CASE WHEN chg < -0.08 THEN 'rrai_down_momentum_short' END, CASE WHEN chg < -0.08 THEN 'rrai_down_fade_long' END, CASE WHEN rf >= 0.85 THEN 'froth_high_short' END, CASE WHEN rf >= 0.85 THEN 'froth_high_long' END,
 CASE WHEN rr >= 0.85 THEN 'bear_extreme_long' END, CASE WHEN rb >= 0.85 THEN 'bull_extreme_short' END]) AS name FROM r)
 SELECT name, CASE WHEN name LIKE '%long' THEN 1 ELSE -1 END AS side, date FROM k WHERE name IS NOT NULL""",
        "capitulation_sets": S.with_views(f""", {days}, x AS (SELECT date, close FROM (SELECT CAST(o_orderdate AS DATE) AS date, round(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (100.0e0 * count(*)) / 9000, 6) AS close FROM orders GROUP BY 1) WHERE day(date) % 3 > 0),
 v AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1),
 z AS (SELECT date, round(CASE WHEN row_number() OVER (ORDER BY date) <= 10 THEN 0 ELSE (n - avg(n) OVER w) / CASE WHEN round(stddev_pop(n) OVER w, 9) = 0 THEN 1 ELSE stddev_pop(n) OVER w END END + 1e-9, 6) AS z FROM v WINDOW w AS (ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
 y AS (SELECT date, avg(close) AS close FROM prices_long GROUP BY 1),
 u AS (SELECT date, row_number() OVER (ORDER BY date) > 200 AND round(close + 1e-9, 6) > round(avg(close) OVER s + 1e-9, 6) AND round(avg(close) OVER g + 1e-9, 6) >= round(avg(close) OVER s + 1e-9, 6) AS up
 FROM y WINDOW s AS (ORDER BY date ROWS 199 PRECEDING), g AS (ORDER BY date ROWS 49 PRECEDING)),
 e AS (SELECT day.date, x.close AS vix, coalesce(z, 0) >= 0.5 AS fear, coalesce(up, false) AS up FROM day ASOF LEFT JOIN x ON day.date >= x.date ASOF LEFT JOIN z ON day.date >= z.date ASOF LEFT JOIN u ON day.date >= u.date WHERE pct <= 0.15),
 k AS (SELECT date, unnest(['baseline', CASE WHEN coalesce(vix, 0) >= 18 THEN 'vixgated' END, CASE WHEN fear THEN 'fear' END, CASE WHEN up THEN 'trend' END, CASE WHEN up AND fear THEN 'trendfear' END]) AS name FROM e) SELECT name, date FROM k WHERE name IS NOT NULL""", "prices_long"),
        "indexed_phrase_search": phrase,
        "streamed_phrase_search": phrase,
        "streamed_alerts": v("""SELECT * FROM (SELECT id, array_to_string(list_filter(['tion of', 'zzz', 'the '], lambda k: contains(lower(title || ' ' || selftext), k)), ',') AS matched FROM posts) WHERE matched <> ''""", "posts"),
        "streamed_status": f"""WITH e AS (SELECT 'u' || user_id AS username, {status} AS status, ts FROM events),
 l AS (SELECT *, lag(status) OVER (PARTITION BY username ORDER BY ts, status) AS before FROM e)
 SELECT username, arg_max(status, ts) AS status, max(ts) AS checked_at, max(ts) FILTER (WHERE before IS NULL OR before <> status) AS changed_at FROM l GROUP BY 1""",
        "streamed_growth": """WITH e AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS id, CAST(floor(value) AS BIGINT) AS n, ts FROM events),
 b AS (SELECT *, min(ts) OVER (PARTITION BY id) AS born FROM e), o AS (SELECT * FROM b WHERE ts <= born + INTERVAL 14 DAY),
 m AS (SELECT *, coalesce(max(n) OVER (PARTITION BY id ORDER BY ts, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS most FROM o)
 SELECT id, max(n) AS num_comments, count(*) AS refreshes, max(ts) AS at FROM m WHERE n > most GROUP BY 1""",
        "nested_replies": """WITH c AS (SELECT *, CASE WHEN turn % 3 = 1 THEN -5 ELSE length(text) % 40 END AS score FROM conversations)
 SELECT conv_id AS post, conv_id || '_' || turn AS comment_id, role AS author, CAST(score AS BIGINT) AS score, CAST(turn AS INT) AS depth, CAST(length(text) AS INT) AS chars, CAST(turn * 60 AS BIGINT) AS at
 FROM c WHERE turn <= 10 AND score >= 3 AND NOT (conv_id % 7 = 0 AND turn >= 2)""",
        "feed_entries": v("SELECT 'http://b/' || id AS permalink, CAST(length(title) AS INT) AS chars, created_utc, 'unknown' AS post_type, 'Monitor-RSS' AS source FROM posts WHERE title IS NOT NULL", "posts"),
        "insider_purchases": f"WITH {form4} SELECT DISTINCT ticker, filing_date FROM f JOIN lineitem ON l_orderkey = o_orderkey WHERE form IN ('4', '4/A') AND xml AND l_returnflag = 'R' AND l_quantity > 10",
        "stake_filings": f"WITH {form4} SELECT DISTINCT ticker, filing_date FROM f WHERE form IN ('SC 13D', 'SC 13D/A')",
        "offering_filings": f"WITH {form4} SELECT DISTINCT ticker, filing_date FROM f WHERE form = 'S-3'",
        "snapshot_window": v("""SELECT ticker, CAST(year(date) AS INT) AS year, count(*) AS n, round(sum(close * CASE WHEN date >= DATE '1996-03-15' THEN 2 ELSE 1 END) + 1e-9, 4) AS total
 FROM prices_long WHERE date < DATE '1996-03-15' OR day(date) % 2 = 0 GROUP BY 1, 2""", "prices_long"),
        "board_sql": v(BOARD_SQL, "posts"),
        "chart_points": v("SELECT subreddit AS target, CAST(created_utc AS DATE) AS time, count(*) AS value FROM posts WHERE subreddit IN ('src1', 'src4') GROUP BY 1, 2", "posts"),
        "ticker_sentiment_route": v(f"""SELECT ticker, subreddit, count(*) AS mentions, round(avg(sentiment_score) + 1e-9, 4) AS avg_sentiment, count(*) FILTER (WHERE sentiment_score > 0.05) AS positive,
 count(*) FILTER (WHERE sentiment_score < -0.05) AS negative, count(DISTINCT author) AS authors FROM mentions WHERE ticker = 'T07' AND created_utc >= TIMESTAMP '{S.AS_OF}' - INTERVAL 240 HOUR AND created_utc < TIMESTAMP '{S.AS_OF}' GROUP BY 1, 2""", "mentions"),
        "sampled_days": v(""", k AS (SELECT *, CAST(created_utc AS DATE) AS date, CAST(source_id AS BIGINT) AS id, sentiment_score AS x FROM mentions WHERE day(created_utc) <> 3),
 f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY date, subreddit ORDER BY created_utc, id) <= 20)
 SELECT date, count(*) AS total_mentions, count(DISTINCT author) AS authors, round(avg(x) + 1e-9, 4) AS mkt_sent, round(avg(CASE WHEN x > 0.3 THEN 1.0e0 ELSE 0 END) + 1e-9, 4) AS bull_frac,
 round(avg(CASE WHEN x < 0 THEN 1.0e0 ELSE 0 END) + 1e-9, 4) AS bear_frac, round((count(*) FILTER (WHERE x > 0.3) - count(*) FILTER (WHERE x < 0)) / CAST(count(*) AS DOUBLE) + 1e-9, 4) AS rrai_raw FROM f GROUP BY 1""", "mentions"),
        "kept_comments": v(""", t AS (SELECT id, id % 11 = 0 OR num_comments >= 500 AS mega FROM posts WHERE id % 13 <> 0),
 c AS (SELECT c.*, mega FROM comments c JOIN t ON post_id = id WHERE mega OR id % 2 = 0 QUALIFY NOT mega OR row_number() OVER (PARTITION BY post_id ORDER BY depth DESC, comment_id DESC) <= 2),
 k AS (SELECT post_id, score FROM c WHERE body NOT IN ('', '[removed]', '[deleted]') AND (score >= CASE WHEN mega THEN 500 ELSE 300 END OR contains(body, 'la')))
 SELECT id AS post_id, count(post_id) AS kept, CAST(sum(score) AS BIGINT) AS score FROM t LEFT JOIN k ON id = post_id GROUP BY 1""", "posts", "comments"),
        "csv_folders_search": v("SELECT id, subreddit AS source, score, CASE WHEN subreddit <> 'src2' THEN post_type END AS post_type, sha256(selftext) AS h FROM posts WHERE score BETWEEN 20 AND 80 AND (contains(lower(title), 'an') OR contains(lower(selftext), 'an'))", "posts"),
        "csv_append": v("SELECT id, author, score, sha256(selftext) AS h FROM posts", "posts"),
        "parquet_export": v(""", t AS (SELECT CAST(sum(score) AS BIGINT) AS score, count(*) FILTER (WHERE id % 2 = 0) AS media, max(date_trunc('second', created_utc)) AS last FROM posts),
 n AS (SELECT 'posts' AS name, count(*) AS rows FROM posts UNION ALL SELECT 'comments', count(*) FROM comments) SELECT n.*, true AS there, t.* FROM n, t""", "posts", "comments"),
        "media_urls": """SELECT CAST(doc_id AS VARCHAR) AS id,
 array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'https://i.redd.it/x.PNG?s=1' WHEN doc_id % 5 = 2 THEN 'https://h/a.gif' END, CASE WHEN doc_id % 5 = 0 THEN 'https://i.redd.it/x.PNG?s=1' END, CASE WHEN doc_id % 3 = 0 THEN 'https://p/1?x=1&y=2' END], lambda u: u IS NOT NULL), ' ') AS images,
 array_to_string(list_filter([CASE WHEN doc_id % 4 = 0 THEN 'https://v/' || doc_id END, CASE WHEN doc_id % 5 = 1 THEN 'https://youtu.be/x' END], lambda u: u IS NOT NULL), ' ') AS videos,
 CASE WHEN doc_id % 7 = 0 THEN 'https://g/m2?&' || coalesce(source, 'none') || ' https://g/m1?&' || coalesce(source, 'none') ELSE '' END AS galleries FROM documents""",
        "archive_by_cursor": """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(epoch(o_orderdate) AS BIGINT) AS created, 'a' || (o_custkey % 40) AS author, o_orderpriority AS body
 FROM orders WHERE o_orderdate >= TIMESTAMP '1993-01-01' AND o_orderdate < TIMESTAMP '1998-07-15'""",
        "plugin_chain": v(f""", p AS (SELECT *, '/r/' || (id - id % 3) AS permalink FROM posts QUALIFY row_number() OVER (PARTITION BY id - id % 3 ORDER BY id) = 1),
 w AS (SELECT id, unnest(list_filter(regexp_extract_all({words}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]+') AND length(w) >= 3)) AS word FROM p),
 c AS (SELECT id, word, count(*) AS n FROM w GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, word) <= 5)
 SELECT p.id, permalink, coalesce(k, '') AS keywords FROM p LEFT JOIN (SELECT id, string_agg(word, ',' ORDER BY n DESC, word) AS k FROM c GROUP BY 1) c USING (id)""", "posts"),
    }
