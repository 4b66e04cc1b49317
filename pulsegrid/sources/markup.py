"""Feeds and filings in XML, and listings of filings as parallel arrays, to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.operators.steps import saved

# Forms by what they tell.
OFFERING = ["424B5", "424B3", "424B4", "424B2", "424B1", "424B7", "S-1", "S-1/A", "S-3", "S-3/A", "S-3ASR", "F-1", "F-1/A", "F-3", "FWP", "EFFECT"]
INSIDER = ["4", "4/A"]
ACTIVIST = ["SC 13D", "SC 13D/A"]
PASSIVE = ["SC 13G", "SC 13G/A"]
INSTITUTIONAL = ["13F-HR", "13F-HR/A"]

#: An entry of an Atom feed as far as a post takes it; _href is the attribute of link.
ENTRY = "title string, published string, link array<struct<_href: string>>"
FEED = "entry array<struct<title: string, published: string, link: array<struct<_href: string>>>>, _corrupt_record string"

#: Of form 4, the transactions that are no derivatives: code and shares.
FORM4 = """nonDerivativeTable struct<nonDerivativeTransaction: array<struct<transactionCoding: struct<transactionCode: string>,
 transactionAmounts: struct<transactionShares: struct<value: string>>>>>, _corrupt_record string"""

#: Values are taken as they stand, blanks included; names of namespaces are dropped.
PARSER = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "attributePrefix": "_"}


def _post() -> list[Column]:
    """The columns of ENTRY as a post: what a feed does not tell is empty, 0 or unknown."""
    link, empty = F.try_element_at("link", F.lit(1))["_href"], F.lit("")
    known = {"id": empty, "title": F.col("title"), "author": empty, "created_utc": F.try_to_timestamp(F.btrim("published")), "permalink": link, "url": link, "score": F.lit(0).cast("long"), "num_comments": F.lit(0).cast("long"), "selftext": empty, "post_type": F.lit("unknown"), "has_media": F.lit(False), "source": F.lit("Monitor-RSS")}
    return [c.alias(name) for name, c in known.items()]


def feed_posts(feeds: DataFrame, xml: str = "value") -> tuple[DataFrame, DataFrame]:
    """(posts, rejected) of whole Atom feeds, one in each row: a post for each entry, in any order.

    A feed that is no well-formed XML is set aside whole, as raw; a null one and one without entries give nothing. An entry
    without a link has a null permalink; a time that can't be read is null."""
    parsed = feeds.where(F.col(xml).isNotNull()).select(F.col(xml).alias("raw"), F.from_xml(F.col(xml), FEED, PARSER).alias("f"))
    good = parsed.where("f._corrupt_record is null").select(F.explode("f.entry").alias("e")).select("e.*")
    return good.select(*_post()), parsed.where("f._corrupt_record is not null").select("raw")


def feed_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(posts, rejected) of files of feeds below a path. Entries are the rows of the XML reader, which splits files by them, so a
    large file is read by many tasks; what was parsed is written as a table, and an entry that can't be is set aside with its text."""
    rows = saved(spark.read.format("xml").options(**PARSER).option("rowTag", "entry").schema(f"{ENTRY}, _corrupt_record string").load(path), "entries")
    return rows.where("_corrupt_record is null").select(*_post()), rows.where("_corrupt_record is not null").select(F.col("_corrupt_record").alias("raw"))


def listed_filings(rows: DataFrame, ticker: str, arrays: list[str]) -> DataFrame:
    """Parallel arrays (form, filing date, accession, document) to (ticker, form, filing_date, accession, primary_doc); the shortest
    array decides how many, as in a zip."""
    forms, dates, numbers, documents = arrays
    n = F.array_min(F.array(*[F.size(F.coalesce(c, F.array().cast("array<string>"))) for c in arrays]))
    z = rows.select(F.upper(ticker).alias("ticker"), F.explode(F.slice(F.arrays_zip(F.col(forms).alias("form"), F.col(dates).alias("filing_date"), F.col(numbers).alias("accession"), F.col(documents).alias("primary_doc")), 1, n)).alias("z"))
    return z.select("ticker", "z.*")


def filing_dates(filings: DataFrame, forms: list[str] | None = None) -> DataFrame:
    """(ticker, filing_date): the distinct dates on which a ticker filed one of the forms, of any form if None, in order."""
    rows = filings if forms is None else filings.where(F.col("form").isin(forms))
    return rows.select("ticker", "filing_date").distinct().orderBy("ticker", "filing_date")


def purchase_dates(filings: DataFrame, xml: str = "xml", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((ticker, filing_date), rejected) of insiders' filings with their XML: the distinct dates, in order, of filings with an open-market
    purchase (code P) of more than 0 shares among the transactions that are no derivatives.

    Only forms 4 and 4/A with a document that ends in .xml count, of each ticker the latest `limit` if one is given (by date,
    then accession, falling). A filing that is no well-formed XML is set aside; shares that are no number count as none."""
    rows = filings.where(F.col("form").isin(INSIDER) & F.col("primary_doc").endswith(".xml"))
    if limit is not None:
        rows = rows.withColumn("__n", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("filing_date"), F.desc("accession")))).where(F.col("__n") <= limit).drop("__n")
    parsed = rows.withColumn("f", F.from_xml(F.col(xml), FORM4, PARSER))

    def bought(t: Column) -> Column:
        shares = F.btrim(t["transactionAmounts"]["transactionShares"]["value"]).try_cast("double")
        return (F.btrim(t["transactionCoding"]["transactionCode"]) == "P") & (shares > 0)

    hit = parsed.where(F.col("f._corrupt_record").isNull() & F.exists("f.nonDerivativeTable.nonDerivativeTransaction", bought))
    return hit.select("ticker", "filing_date").distinct().orderBy("ticker", "filing_date"), parsed.where("f._corrupt_record is not null").select("ticker", "accession", F.col(xml).alias("raw"))
