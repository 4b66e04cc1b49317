"""Phrase search ranked by BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.numeric import r
from pulsegrid.functions.text import ascii_lower


def phrase_search(rows: DataFrame, columns: list[str], phrase: str, id_col: str = "id", limit: int = 50, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The rows whose columns hold the whole input as one phrase (letters and digits, any case, quotes ignored), best first.

    BM25 with the phrase as its one term; a weight of a phrase in most rows is held at 1e-6. Rows without a token count in the
    averages. Occurrences are counted without overlap; a phrase
    without a token finds nothing."""
    words = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in phrase.lower()).split()]
    tokens = F.filter(F.split(ascii_lower(F.concat_ws(" ", *columns)), "[^a-z0-9]+"), lambda w: w != "")
    # Two blanks between tokens, so that neighbouring occurrences don't share one.
    want = " " + "  ".join(words) + " "
    lined = rows.select(id_col, F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" ")).alias("s"))
    length = F.when(F.col("s") == "  ", 0).otherwise(F.size(F.split("s", "  ")))
    found = (F.length("s") - F.length(F.replace("s", F.lit(want), F.lit("")))) / len(want) if words else F.lit(0)
    seen = lined.select(id_col, length.alias("len"), found.cast("long").alias("f"))
    total = seen.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("f") > 0, 1).otherwise(0)).alias("hits"), F.avg("len").alias("mean"))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("hits") + 0.5) / (F.col("hits") + 0.5)))
    score = idf * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return seen.where("f > 0").crossJoin(F.broadcast(total)).select(id_col, r(score, 6).alias("score")).orderBy(F.desc("score"), id_col).limit(limit)
