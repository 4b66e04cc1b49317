"""Raw feeds to rows: posts in JSON, pipe-delimited daily files, arrays of prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.numeric import r

POST = "id string, title string, selftext string, url string, score long, num_comments long, is_self boolean, is_video boolean, is_gallery boolean, created_utc double"


def post_type() -> Column:
    """Video before gallery before image (by the link's ending or host) before text before link."""
    image = F.col("url").rlike(r"(?i)\.(jpg|jpeg|png|gif|webp)$") | F.contains("url", F.lit("i.redd.it"))
    return F.when(F.col("is_video"), "video").when(F.col("is_gallery"), "gallery").when(image, "image").when(F.col("is_self"), "text").otherwise("link")


def posts_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """One post per JSON object; what does not parse, or has no id, is left out."""
    p = lines.select(F.from_json(column, POST).alias("p")).select("p.*").where("id is not null")
    kind = post_type()
    return p.select("id", "title", "selftext", "url", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("num_comments", F.lit(0)).alias("num_comments"), kind.alias("post_type"), kind.isin("image", "video", "gallery").alias("has_media"), F.timestamp_seconds("created_utc").alias("created_utc"))


def short_volume_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """date|symbol|short|exempt|total|... lines; headers, short lines and totals of 0 are left out."""
    f = F.split(column, r"\|")
    num = lambda i: F.try_element_at(f, F.lit(i)).try_cast("double")
    rows = lines.where(F.size(f) >= 5).select(F.try_element_at(f, F.lit(2)).alias("ticker"), F.try_to_date(F.try_element_at(f, F.lit(1)), "yyyyMMdd").alias("date"), num(3).alias("short_volume"), num(5).alias("total_volume"))
    rows = rows.where("total_volume > 0 and short_volume is not null and date is not null")
    return rows.withColumn("short_ratio", r(F.col("short_volume") / F.col("total_volume"), 4))


def price_arrays(rows: DataFrame, ticker: str, stamps: str, closes: str) -> DataFrame:
    """Parallel arrays of epoch seconds and closes to (ticker, date, close); null closes are left out, the shorter array decides."""
    z = rows.select(F.col(ticker).alias("ticker"), F.explode(F.arrays_zip(F.col(stamps).alias("t"), F.col(closes).alias("c"))).alias("z"))
    return z.where("z.t is not null and z.c is not null").select("ticker", F.to_date(F.timestamp_seconds("z.t")).alias("date"), F.col("z.c").cast("double").alias("close"))
