"""Keyed changes to tables, as DataFrames of the new state; the caller writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_totals(target: DataFrame, source: DataFrame, keys: list[str], totals: list[str], latest: list[str]) -> DataFrame:
    """Upsert that adds the totals and keeps the greatest of `latest`; one aggregation, no join."""
    both = target.unionByName(source)
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in totals], *[F.max(c).alias(c) for c in latest])


def point_update(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Sets the columns of `changes` that are not null; keys that the target lacks are ignored."""
    new = [c for c in changes.columns if c != key]
    j = target.alias("t").join(changes.alias("c"), key, "left")
    return j.select(*[F.coalesce(f"c.{c}", f"t.{c}").alias(c) if c in new else F.col(c if c == key else f"t.{c}") for c in target.columns])


def cascade_delete(posts: DataFrame, doomed: Column, dependents: dict[str, tuple[DataFrame, str]], id_col: str = "id") -> tuple[dict[str, DataFrame], DataFrame]:
    """Deletes posts and the rows that hang on them: (what stays, by name; one row (name, deleted) per table).

    dependents: name -> (rows, column with the post's id). Rows with a null post id stay; so do posts for which `doomed` is null."""
    gone = posts.where(F.coalesce(doomed, F.lit(False))).select(F.col(id_col).alias("__id")).distinct()
    stay = {"posts": posts.where(~F.coalesce(doomed, F.lit(False)))}
    counts = posts.where(F.coalesce(doomed, F.lit(False))).agg(F.count(F.lit(1)).alias("deleted")).select(F.lit("posts").alias("name"), "deleted")
    for name, (rows, key) in dependents.items():
        stay[name] = rows.join(gone, rows[key] == gone["__id"], "left_anti")
        hit = rows.join(gone, rows[key] == gone["__id"], "left_semi").agg(F.count(F.lit(1)).alias("deleted"))
        counts = counts.unionByName(hit.select(F.lit(name).alias("name"), "deleted"))
    return stay, counts


def replace_window(old: DataFrame, new: DataFrame, date_col: str, cutoff) -> DataFrame:
    """Rows of old before the cutoff, and rows of new from it on."""
    return old.where(F.col(date_col) < cutoff).unionByName(new.select(*old.columns).where(F.col(date_col) >= cutoff))


def close_open(log: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Inserts unseen keys; of known ones only open rows change, and only to closed. Doing it twice changes nothing."""
    rest = [c for c in log.columns if c not in keys]
    j = log.withColumn("__l", F.lit(True)).alias("l").join(updates.select(*log.columns).withColumn("__u", F.lit(True)).alias("u"), keys, "full_outer")
    take = F.col("l.__l").isNull() | (F.col("u.__u") & (F.col("l.status") == "open") & (F.col("u.status") == "closed"))
    return j.select(*keys, *[F.when(take, F.col(f"u.{c}")).otherwise(F.col(f"l.{c}")).alias(c) for c in rest]).select(*log.columns)


def revalidated(facts: DataFrame, sources: DataFrame, source_key: str, found: Column, value: str) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): a fact goes if its source is there and `found` (an array computed on the source) lacks its value.
    Facts without a source stay."""
    s = sources.select(F.col(source_key).alias("__k"), found.alias("__found"))
    j = facts.join(s, facts[source_key] == s["__k"], "left")
    gone = F.col("__k").isNotNull() & ~F.coalesce(F.array_contains("__found", F.col(value)), F.lit(False))
    return j.where(~gone).select(*facts.columns), j.where(gone).select(*facts.columns)
