"""Nested reply listings in JSON to flat rows, level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.steps import cut

#: What one listing child holds; replies stay text, for their depth is not known.
CHILD = "struct<kind string, data struct<id string, parent_id string, author string, body string, score long, created_utc double, is_submitter boolean, replies string>>"


def flattened(threads: DataFrame, key: str, listing: str, max_depth: int = 3, min_score: int = 0) -> DataFrame:
    """(key, comment_id, parent_id, author, body, score, created_utc, depth, is_submitter) of all replies down to `max_depth`, the top
    level being 0, with a score of at least `min_score`.

    `listing` is a JSON array of children. What hangs below a reply of low score is still read; children of another kind than t1
    are skipped with all below them. A missing score is 0, a missing body empty, a missing time the epoch. Text that is not a
    JSON array, and replies that are not an object ("" in the feed), have no children.

    Each level is one parse and one explode of what is left of the level above, written as a checkpoint, until no reply is left or
    the depth is reached; so the text below a level is read once for it, and a thread's replies are dealt out anew.
    """
    level = threads.select(F.col(key).alias(key), F.col(listing).alias("__l"))
    found = []
    for depth in range(max_depth + 1):
        children = F.from_json("__l", f"array<{CHILD}>")
        rows = level.select(key, F.explode(children).alias("c")).where("c.kind = 't1'").select(key, "c.data.*")
        rows = cut(rows)
        found.append(rows.select(key, F.col("id").alias("comment_id"), "parent_id", "author", F.coalesce("body", F.lit("")).alias("body"), F.coalesce("score", F.lit(0)).alias("score"), F.timestamp_seconds(F.coalesce("created_utc", F.lit(0.0))).alias("created_utc"), F.lit(depth).alias("depth"), F.coalesce("is_submitter", F.lit(False)).alias("is_submitter")))
        level = rows.select(key, F.get_json_object("replies", "$.data.children").alias("__l")).where("__l is not null")
        if depth == max_depth or level.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).where(F.col("score") >= min_score)
