"""Sharding by a two-pass external shuffle, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.llm import _shared as S

#: Rows equal in all columns are taken apart by their place when there are more than this.
TWINS = 1000


def shard_of(key: Column, shards: int, seed: int = 0) -> Column:
    """Rendezvous hashing: the shard whose seeded hash with the key is highest; one more shard takes rows only into itself. A null key is a key like any other."""
    return F.array_max(F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s")) for s in range(shards)]))["s"]


def two_pass_shuffle(rows: DataFrame, key: str, shards: int = 16, seed: int = 7, bucket_bytes: int = 16 << 20, twins: int = TWINS) -> DataFrame:
    """rows with shard, slot (gapless from 0 within a shard) and grown_shard (with one shard more); law: key.

    Pass 1 scatters the records by seeded hashes: the key's shard, and within it one of as many buckets as keep a bucket
    near `bucket_bytes`, by the measured size of all columns; each bucket is a partition of its own, named by its number. Pass 2
    sorts one bucket at a time and puts it in random order by the Fisher-Yates shuffle of Spark's shuffle(array, seed), whose
    seed there is `seed` plus the partition's number. So the order follows from the rows, `seed`, `shards` and `bucket_bytes`
    alone, not from the cluster or its settings. A bucket's first slot is the number of rows in the buckets before it.

    The bucket comes from a hash of the whole row and so parts repeated keys and repeated texts. Rows equal in all columns
    can't be told apart by it; if more than `twins` are equal, these go by their place in the scan too, so that they fill
    no bucket, and on such a table alone the order may differ between runs. Memory holds a bucket, or the longest row. Null keys
    and values are allowed; an empty table gives an empty result. Columns named shard, slot or grown_shard in rows are replaced.
    """
    rows = rows.drop("shard", "slot", "grown_shard")
    columns = rows.columns
    widths = [F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.simpleString() in ("string", "binary") else F.lit(8) for f in rows.schema]
    hashed = rows.withColumn("__h", F.xxhash64(F.lit(seed + 1), *columns))
    counted = S.written(hashed.groupBy("__h").agg(F.count(F.lit(1)).alias("n"), F.sum(sum(widths, F.lit(16)).cast("long")).alias("bytes")), "row-hashes")
    per_shard = max(1, -(-int(counted.agg(F.sum("bytes")).first()[0] or 0) // (bucket_bytes * shards)))
    hot = counted.where(F.col("n") > twins).select("__h")
    if n_hot := hot.count():
        hot = S.small(hot, n_hot, 1_000_000)
        moved = hashed.join(hot, "__h", "left_semi").withColumn("__h", F.xxhash64("__h", F.monotonically_increasing_id()))
        hashed = S.written(hashed.join(hot, "__h", "left_anti").unionByName(moved), "rows")
    placed = hashed.select(F.struct(*columns).alias("r"), shard_of(F.col(key), shards, seed).alias("shard"), shard_of(F.col(key), shards + 1, seed).alias("grown_shard"), F.pmod("__h", F.lit(per_shard)).alias("part"))
    placed = placed.withColumn("b", (F.col("shard") * per_shard + F.col("part")).cast("int")).drop("part")
    bucket = placed.repartitionById(shards * per_shard, "b").groupBy("b").agg(F.array_sort(F.collect_list(F.struct("r", "grown_shard"))).alias("all"))
    bucket = bucket.withColumns({"mixed": F.shuffle("all", F.lit(seed)), "shard": F.floor(F.col("b") / per_shard).cast("int")})
    counts = placed.groupBy("shard", "b").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.col("b").alias("__b"), F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # One row for each bucket: broadcast, so that the buckets stay in their partitions.
    out = bucket.join(F.broadcast(before), F.col("b") == F.col("__b")).select("shard", "before", F.posexplode("mixed").alias("i", "x"))
    return out.select("x.r.*", "shard", (F.col("before") + F.col("i")).cast("long").alias("slot"), "x.grown_shard")


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Writes the result of two_pass_shuffle as Parquet, a folder for each shard and in it a file for each bucket, in the order of the slots."""
    shuffled.write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, columns: DataFrame) -> DataFrame:
    """The shards written from a table with these columns."""
    return spark.read.schema(columns.schema).parquet(path).select(columns.columns)
