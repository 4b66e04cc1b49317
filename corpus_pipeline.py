"""A training corpus from documents in four stages: language, exact copies, near copies, sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and the
next stage reads that. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import _shared as S
from pulsegrid.llm import exact_dedup, language_id, ngram_join, packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if no language can be told: it has no letter. No document with letters is rejected for its score.
UNKNOWN = "und"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the classifier can tell; it is learned from the labelled documents of this input.

    If none can be learned from, no language is told and documents with a letter stay."""
    model = language_id.fit(docs)
    if model is None:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    return language_id.predict(docs.select(*COLUMNS), model).where(F.col("lang_pred") != UNKNOWN).select(*COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of equal texts, and one row of those that share it.

    Rows without a doc_id are in no group; of those with equal texts one is kept."""
    kept = exact_dedup.exact_dedup(docs).where("kept").select(exact_dedup.row_key(digest=F.col("text_sha256")).alias("row_key"))
    rows = docs.select(*COLUMNS, exact_dedup.row_key().alias("row_key"))
    return rows.join(kept, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group linked by five-word n-grams at a Jaccard similarity of 0.8 or more.

    If a doc_id is null or repeated, one row of equal doc_id and text is taken and the rows are numbered in the order of their
    doc_id, nulls last; the numbers then stand for the ids."""
    rows, key = docs.select(*COLUMNS), "doc_id"
    if not rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty():
        one = rows.withColumn("row_key", exact_dedup.row_key()).dropDuplicates(["row_key"])
        # After a global sort these numbers rise with it; written, they stay as they are.
        rows, key = S.written(one.orderBy(F.col("doc_id").asc_nulls_last(), "row_key").withColumn("row", F.monotonically_increasing_id()), "rows"), "row"
    classes = ngram_join.jaccard_classes(rows, id_col=key, words=5, percent=80)
    kept = classes.where(F.col(key) == F.col("component_id")).select(key)
    return rows.join(kept, key, "left_semi").select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of at most 2048; one row for each piece."""
    cut = S.written(packing.pieces(docs), "pieces")
    return packing.pack(cut).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", known_language), ("exact_dedup", without_copies), ("ngram_jaccard_join", without_near_copies), ("best_fit_packing", sequences)]

#: Language ID and token packing can't be put in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = S.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
