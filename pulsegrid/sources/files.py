"""Posts in folders of CSV files, exports, and the media a post points to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import lookups
from pulsegrid.sources import tables

#: Quotes within a field are doubled, fields may hold line breaks, and blanks at the ends stay.
CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
ENDINGS = [".jpg", ".jpeg", ".png", ".gif", ".webp"]


def read_folders(spark: SparkSession, root: str, file: str = "posts.csv", tag: str = "source") -> DataFrame | None:
    """The file of each folder below root, with the folder's name as `tag`; folders without it are skipped, None if no folder has it. All
    columns are strings; a column that a file lacks is null."""
    names = [n for n in tables.children(spark, root) if tables.there(spark, f"{root}/{n}/{file}")]
    parts = [spark.read.options(**CSV).csv(f"{root}/{n}/{file}").withColumn(tag, F.lit(n)) for n in names]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def search(rows: DataFrame, query: str | None = None, column: str | None = None, regex: bool = False, min_score: int | None = None, max_score: int | None = None, start: str | None = None, end: str | None = None, post_type: str | None = None, author: str | None = None, order: str = "score", ascending: bool = False, limit: int | None = 50) -> DataFrame:
    """Rows by text (in `column`, or any of title, selftext and body; literal unless `regex`), score, date, type and author, in order.

    A filter on a column that the rows don't have is passed over, and so is an order by one. Scores are compared as numbers, dates as
    they are written; what is no number or null fails a bound."""
    have = set(rows.columns)
    out = rows
    if query:
        fields = [column] if column in have else [c for c in ("title", "selftext", "body") if c in have]
        hit = reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False)) for c in fields], F.lit(False))
        out = lookups.matches(out, query, fields) if regex else out.where(hit)
    for name, test in (("score", lambda c: (c.try_cast("double") >= min_score) if min_score is not None else None), ("score", lambda c: (c.try_cast("double") <= max_score) if max_score is not None else None), ("created_utc", lambda c: (c >= start) if start else None), ("created_utc", lambda c: (c <= end) if end else None), ("post_type", lambda c: (c == post_type) if post_type else None), ("author", lambda c: (c == author) if author else None)):
        if name in have and (wanted := test(F.col(name))) is not None:
            out = out.where(wanted)
    if order in have:
        key = F.coalesce(F.col(order).try_cast("double"), F.lit(float("-inf")))
        out = out.orderBy(*([key.asc(), F.col(order).asc()] if ascending else [key.desc(), F.col(order).desc()]), *[c for c in ("source", "id") if c in have])
    return out if limit is None else out.limit(limit)


def append_csv(rows: DataFrame, path: str, key: str) -> None:
    """Adds the rows whose key is not in the file yet, the first of equal keys by all columns; rows without a key are left out. Doing it twice
    changes nothing. The folder at path holds a file for each task that wrote."""
    spark = rows.sparkSession
    new = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*[c for c in rows.columns if c != key])).alias("first")).select(key, "first.*").select(*rows.columns)
    if tables.there(spark, path):
        new = new.join(spark.read.options(**CSV).csv(path).select(F.col(key).alias("__k")), new[key].cast("string") == F.col("__k"), "left_anti")
    new.write.mode("append").options(**CSV).csv(path)


def export(of: dict[str, DataFrame | None], out: str, stamp: str, source: str = "db") -> DataFrame:
    """Each table as Parquet at out/source_table_stamp: (name, path, rows); empty and missing tables are skipped. Strings in columns of counts
    become integers (0 if they are no number), dates in created_utc timestamps (null if they are none), is_ and has_ columns booleans."""
    done = []
    for name, df in of.items():
        if df is None or df.isEmpty():
            continue
        typed = {}
        for c, kind in df.dtypes:
            if kind == "string" and c in ("score", "num_comments", "num_crossposts", "total_awards"):
                typed[c] = F.coalesce(F.col(c).try_cast("double").try_cast("int"), F.lit(0))
            elif kind == "string" and c == "created_utc":
                typed[c] = F.try_to_timestamp(c)
            elif kind == "string" and c.startswith(("is_", "has_")):
                typed[c] = F.coalesce(F.col(c).try_cast("boolean"), F.lit(False))
        path = f"{out}/{source}_{name}_{stamp}"
        df.withColumns(typed).write.mode("overwrite").parquet(path)
        done.append((name, path))
    spark = next((df.sparkSession for df in of.values() if df is not None), None) or SparkSession.active()
    counts = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), F.lit(p).alias("path"), "rows") for n, p in done]
    return reduce(DataFrame.unionByName, counts, spark.createDataFrame([], "name string, path string, rows long"))


def exported(spark: SparkSession, out: str) -> DataFrame:
    """(name, files, bytes, modified) of what export() wrote there; contents are not read."""
    if not tables.children(spark, out):
        return spark.createDataFrame([], "name string, files long, bytes long, modified timestamp")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(out).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -2)
    return files.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified"))


def signal_dates(events: DataFrame, path: str) -> None:
    """strategy, side, ticker and date of signals as CSV, in this order, a file without an end of its own for each task."""
    events.select("strategy", "side", "ticker", F.date_format("date", "yyyy-MM-dd").alias("date")).distinct().repartitionByRange("strategy", "ticker", "date").sortWithinPartitions("strategy", "ticker", "date", "side").write.mode("overwrite").options(**CSV).csv(path)


POST = """struct<id string, url string, is_video boolean, is_gallery boolean, media struct<reddit_video struct<fallback_url string>>,
 preview struct<images array<struct<source struct<url string>>>>, gallery_data struct<items array<struct<media_id string>>>, media_metadata map<string, struct<s struct<u string>>>>"""


def media_urls(lines: DataFrame, column: str = "value") -> DataFrame:
    """(id, images, videos, galleries) of posts in JSON. Images: the address if it holds the ending of one, again if it is on the image host, then
    the previews'. Videos: the post's own without its query, then an address of the two video hosts. Galleries: the items' addresses in
    their order. &amp; in addresses is &; what is missing is left out."""
    p = lines.select(F.from_json(column, POST).alias("p")).select("p.*").where("id is not null")
    url = F.coalesce("url", F.lit(""))
    low = F.lower(url)

    def plain(u: Column) -> Column:
        return F.replace(u, F.lit("&amp;"), F.lit("&"))

    def some(c: Column) -> Column:
        return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda u: u.isNotNull() & (u != ""))

    image = reduce(lambda a, b: a | b, [F.contains(low, F.lit(e)) for e in ENDINGS])
    tube = F.contains(url, F.lit("youtube.com")) | F.contains(url, F.lit("youtu.be"))
    own = F.array(F.when(image, url), F.when(F.contains(url, F.lit("i.redd.it")), url))
    items = F.when(F.col("is_gallery"), F.transform("gallery_data.items", lambda i: plain(F.try_element_at("media_metadata", i["media_id"])["s"]["u"])))
    videos = F.array(F.when(F.col("is_video"), F.substring_index("media.reddit_video.fallback_url", "?", 1)), F.when(tube, url))
    return p.select("id", some(F.concat(own, F.coalesce(F.transform("preview.images", lambda i: plain(i["source"]["url"])), F.array().cast("array<string>")))).alias("images"), some(videos).alias("videos"), some(items).alias("galleries"))
