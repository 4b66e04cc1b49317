"""What the operators share: the folder all executors see, written steps, skew-safe group lookups, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local master without one gets a folder of this machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pulsegrid-"))
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get()


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: the lineage ends there, and it survives any executor."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by written()."""
    for df in tables:
        spark = df.sparkSession
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate, for a file scan the size of the files, and no job runs; where it has none, the texts are measured."""
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if known < 1 << 60:
        return known
    sizes = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    return int(df.agg(F.sum(sum(sizes, F.lit(16 * len(df.columns))).cast("long"))).first()[0] or 0)


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcasts a side that was counted and is within the limit; beyond it Spark joins by shuffle."""
    return F.broadcast(df) if rows <= limit else df


def with_group(rows: DataFrame, keys: list[str], id_col: str, low: str = "keep_id", size: str = "group_size") -> DataFrame:
    """Adds the smallest id and the row count of each row's group, whatever the group's size.

    A group is cut into salts by a hash of the id. Each salt is summed before the shuffle, the at most `salts` sums of a
    group meet in one window, and each row finds its group's totals by (keys, salt); so no task holds a whole group.
    """
    salts = 2 * partitions(rows.sparkSession)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int"))
    sums = salted.groupBy(*keys, "__salt").agg(F.min(id_col).alias("__low"), F.count(F.lit(1)).alias("__n"))
    w = W.partitionBy(*keys)
    total = sums.select(*keys, "__salt", F.min("__low").over(w).alias(low), F.sum("__n").over(w).cast("long").alias(size))
    return salted.join(total, [*keys, "__salt"]).drop("__salt")


def lowest_neighbour(edges: DataFrame) -> DataFrame:
    """edges (u, v), any number per u: adds m, the smallest of u and its v; salted as in with_group."""
    salts = 2 * partitions(edges.sparkSession)
    salted = edges.withColumn("__salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
    sums = salted.groupBy("u", "__salt").agg(F.min("v").alias("__low"))
    total = sums.select("u", "__salt", F.least("u", F.min("__low").over(W.partitionBy("u"))).alias("m"))
    return salted.join(total, ["u", "__salt"]).drop("__salt")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links between ids -> (id, component_id) for each id with a link; component_id is the smallest id reached.

    Large-star and small-star steps in turn until nothing changes, which is after some multiple of the logarithm of the largest
    component; each step is a written table, so neither links nor components ever meet in one place. No link gives an empty
    result.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = lowest_neighbour(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = lowest_neighbour(large)
        star = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        star = written(star, "stars")
        mark = star.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        forget(now)
        now = star
        if mark == before or not mark.n:
            break
        before = mark
    ends = now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return ends.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
