"""Exact dedup by progressive refinement: length, then prefix hash, then the hash of the whole content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import _shared as S


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of white space becomes one blank."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), S.SPACE + "+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256, broadcast_rows: int = 2_000_000) -> DataFrame:
    """One row per row of docs: id, keep_id (smallest id of its equal texts), group_size, kept, text_sha256 (of the normalised text).

    1. Rows are counted by length of the normalised text. 2. Rows whose length occurs again are counted by the hash of
    their first `prefix` characters. 3. Only rows whose length and prefix occur again are grouped by the hash of their full
    content (SHA-256). A row finds its group by id and that hash, so it gets its own. Steps pass ids and hashes, not texts; a step's surviving keys are broadcast when they were counted to be at
    most `broadcast_rows`, else they are joined by shuffle.

    Null and empty texts are equal to each other. Rows with a null id form no group: they are kept, with keep_id null.
    Repeated ids are rows of their own: each counts, and all rows with the kept id are kept. Other columns are not read;
    an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"))
    known = rows.where("id is not null").withColumn("len", F.length("t"))
    lengths = known.groupBy("len").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("len")
    # Lengths are bounded by the longest text, not by the number of texts; the count is taken all the same.
    lengths = S.written(lengths, "lengths")
    again = known.join(S.small(lengths, lengths.count(), broadcast_rows), "len", "left_semi")
    heads = again.withColumn("head", F.xxhash64(F.substring("t", 1, prefix)))
    keys = heads.groupBy("len", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("len", "head")
    keys = S.written(keys, "prefixes")
    suspects = known.withColumn("head", F.xxhash64(F.substring("t", 1, prefix))).join(S.small(keys, keys.count(), broadcast_rows), ["len", "head"], "left_semi")
    hashed = S.written(suspects.select("id", "len", F.unhex(F.sha2("t", 256)).alias("sha")), "hashes")
    groups = S.with_group(hashed, ["len", "sha"], "id").where("group_size > 1").select("id", "sha", "keep_id", "group_size").distinct()
    out = rows.select("id", F.unhex(F.sha2("t", 256)).alias("sha")).join(groups, ["id", "sha"], "left")
    keep = F.coalesce("keep_id", "id")
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("id") == keep, F.lit(True)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def row_key(id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None) -> Column:
    """Equal for rows with equal ids, null ones included, and equal normalised texts; digest is text_sha256 if that is known."""
    known = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    return F.concat(F.sha2(normalised(F.col(text_col)), 256) if digest is None else digest, known)
