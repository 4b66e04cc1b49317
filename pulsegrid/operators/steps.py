"""Cuts lineage between the rounds of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only a local master gets one of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        base = sc.getConf().get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="pulsegrid-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder."""
    folder(df.sparkSession)
    return df.checkpoint()


def saved(df: DataFrame, what: str = "step") -> DataFrame:
    """df as a table in the shared folder. Unlike a checkpoint it carries no constraints over, which grow from round to round."""
    path = f"{folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by saved()."""
    for df in tables:
        spark = df.sparkSession
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
