"""Line dedup in DataFrame operations only: range-partitioned line hashes, first occurrences, per-document keep bitmaps."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.llm import _shared as S

BLANKS = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    """Null counts as empty; an empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Per document with lines to drop: id, text_hash, n_dropped, keep (the compressed bitmap: the lines at which it turns, see flips).

    A key of at least `min_chars` code points in at least `min_docs` documents keeps its lines in the largest id that holds it
    and loses all others. 1. One pass over the texts writes a row for each line with such a key: the key's 128-bit hash, the id,
    the position; the id's hash gives it one of a few salts. 2. The rows are range-partitioned by (hash, salt) and sorted by
    (hash, salt, id, position), largest id first: a window streams over each run without another exchange, marks each
    document's first occurrence of the line, and so numbers the run's documents and meets its largest id in its first row. A very frequent
    line spans as many runs, in as many tasks, as there are salts; the runs' counts are summed per partition before
    they are shuffled. 3. The rows of lines that repeat too often give each document its bitmap. Texts are never shuffled.

    The repeated hashes are broadcast if their counted size is at most `broadcast_bytes`, else joined by shuffle, where
    adaptive execution splits a frequent hash. Null ids hold no key: their lines stay. Rows with one id are one document as to
    counting, and each of them loses its lines at the positions of its own; a bitmap belongs to (id, hash of text). All
    steps are linear in the lines, but for the sort.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.translate(F.col(text_col), string.ascii_uppercase, string.ascii_lowercase).alias("t"))
    long_lines = rows.where(F.length("t") >= min_chars).select("id", "text_hash", F.posexplode(F.split("t", "\n", -1)).alias("pos", "line")).where(F.length("line") >= min_chars)
    keys = long_lines.withColumn("line", F.btrim("line", F.lit(BLANKS))).where(F.length("line") >= min_chars)
    n = S.partitions(docs.sparkSession)
    salt = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(2 * n)).cast("int")
    hashed = S.written(keys.select(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), salt.alias("salt"), "id", "text_hash", "pos"), "lines")

    run = ["h", "h2", "salt"]
    stream = W.partitionBy(*run).orderBy(F.col("id").desc(), "text_hash", "pos")
    first = F.coalesce(F.lag("id").over(stream) != F.col("id"), F.lit(True))
    ranged = hashed.select(*run, "id", "text_hash", "pos").repartitionByRange(n, *run).withColumn("first", first)
    often = ranged.where("first").groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs)
    often = S.written(often.select("h", "h2", "last"), "often")
    drops = hashed.join(S.small(often, 32 * often.count(), broadcast_bytes), ["h", "h2"]).where("id < last").select("id", "text_hash", "pos").distinct()
    # Neighbours in one run of dropped lines have the same difference of position and rank.
    own = W.partitionBy("id", "text_hash").orderBy("pos")
    islands = drops.withColumn("island", F.col("pos") - F.row_number().over(own)).groupBy("id", "text_hash", "island").agg(F.min("pos").alias("a"), (F.max("pos") + 1).alias("b"))
    ends = islands.groupBy("id", "text_hash").agg(F.sum(F.col("b") - F.col("a")).cast("long").alias("n_dropped"), F.array_sort(F.collect_list(F.array("a", "b"))).alias("runs"))
    return ends.select("id", "text_hash", "n_dropped", flips(F.col("runs")).alias("keep"))


def flips(runs: Column) -> Column:
    """[[2, 4], [7, 8]] -> [2, 4, 7, 8]: the bitmap begins with kept lines and turns at these positions; an empty one keeps all."""
    return F.flatten(runs)


def kept_slices(keep: Column, lines: Column) -> Column:
    """The kept stretches of an array of lines, joined; linear in the lines, for each stretch is copied once."""
    starts = F.sequence(F.lit(0), F.size(keep), F.lit(2))

    def stretch(i: Column) -> Column:
        a = F.when(i == 0, F.lit(0)).otherwise(F.get(keep, i - 1))
        b = F.coalesce(F.get(keep, i), F.size(lines))
        return F.slice(lines, a + 1, b - a)

    return F.flatten(F.transform(starts, stretch))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """docs with text replaced by what its bitmap keeps, and n_lines, n_dropped (columns of these names are replaced).

    Bitmaps are broadcast if their counted size is at most `broadcast_bytes`, else joined by shuffle."""
    bitmaps = bitmaps.select(F.col("id").alias("__id"), F.col("text_hash").alias("__h"), F.col("n_dropped").alias("__n"), F.col("keep").alias("__keep"))
    size = bitmaps.agg(F.sum(40 + 4 * F.size("__keep"))).first()[0] or 0
    rows = docs.drop("n_lines", "n_dropped").withColumn("__lines", lines(F.col(text_col)))
    joined = rows.join(S.small(bitmaps, size, broadcast_bytes), (F.col(id_col) == F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__h")), "left")
    kept = F.when(F.col("__keep").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(kept_slices(F.col("__keep"), F.col("__lines")), "\n"))
    return joined.withColumns({"n_lines": F.size("__lines").cast("long"), "n_dropped": F.coalesce("__n", F.lit(0)).cast("long"), text_col: kept}).drop("__id", "__h", "__n", "__keep", "__lines")
