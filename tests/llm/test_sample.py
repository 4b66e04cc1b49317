"""The language sample keeps its bound and its cover whatever the ids are."""

import collections

from pyspark.sql import functions as F

from pulsegrid.llm import language_id

SF = "/root/testdata/sf0.01"


def test_sample_of_null_repeated_and_copied_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    langs = {r.lang for r in docs.where("lang is not null").select("lang").distinct().collect()}
    copies = docs.where("lang = 'en' and doc_id < 40").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("i")
    for ids in (F.lit(None).cast("long"), F.lit(7).cast("long"), F.col("doc_id")):
        got = collections.Counter(r[0] for r in language_id.sample(docs.withColumn("doc_id", ids).unionByName(copies), "doc_id", "text", "lang", 60, 12))
        assert set(got) == langs and all(20 < n < 100 for n in got.values()), got
    assert language_id.sample(docs.limit(0), "doc_id", "text", "lang", 60, 12) == []
    assert language_id.fit(docs.where("lang is null")) is None
