"""Tables kept as partitioned Parquet: snapshots that are rewritten by the month, keyed tables that are merged by the bucket."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import posts
from pulsegrid.operators.steps import folder, forget


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def there(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    p, fs = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _staged(df: DataFrame) -> DataFrame:
    """df written aside, so that what it reads may be replaced."""
    spark = df.sparkSession
    path = f"{folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrites the partitions that df has rows for, and leaves all others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


class Snapshot:
    """Read-only copies of hot tables for studies, sorted by ticker and date and partitioned by month where they have a date."""

    def __init__(self, spark: SparkSession, path: str, sort: tuple[str, ...] = ("ticker", "date")) -> None:
        self.spark, self.path, self.sort = spark, path.rstrip("/"), sort

    def _place(self, table: str) -> str:
        return f"{self.path}/{table}"

    def _month(self) -> Column:
        return F.coalesce(F.date_format(F.col("date").cast("date"), "yyyy-MM"), F.lit("none"))

    def _dealt(self, df: DataFrame) -> DataFrame:
        """Range partitions by the sort columns, so that files hold runs of tickers and scans skip by their bounds; a month and
        a ticker with many rows spread over as many partitions as their dates need."""
        keys = [c for c in self.sort if c in df.columns]
        if "date" in df.columns:
            df = df.withColumn("month", self._month())
            keys = ["month", *keys]
        return df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df

    def build(self, tables: dict[str, DataFrame | None]) -> DataFrame:
        """Rebuilds the snapshot; tables that are None are skipped. (name, rows) of what was written. A column `month` is the snapshot's own."""
        done = []
        for name, df in tables.items():
            if df is None:
                continue
            out = self._dealt(df).write.mode("overwrite")
            (out.partitionBy("month") if "date" in df.columns else out).parquet(self._place(name))
            done.append(self.read(name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows"))
        return self._together(done)

    def _together(self, parts: list[DataFrame]) -> DataFrame:
        out = self.spark.createDataFrame([], "name string, rows long")
        for p in parts:
            out = out.unionByName(p)
        return out

    def exists(self, table: str | None = None) -> bool:
        """Whether the table's last write ended; without a name, whether any table's did."""
        names = [table] if table else children(self.spark, self.path)
        return any(there(self.spark, f"{self._place(n)}/_SUCCESS") for n in names)

    def read(self, table: str, fallback: DataFrame | None = None) -> DataFrame:
        """The table; if it isn't there the fallback, or FileNotFoundError without one."""
        if not self.exists(table):
            if fallback is None:
                raise FileNotFoundError(f"no snapshot of {table} in {self.path}: call build() first")
            return fallback
        return self.spark.read.parquet(self._place(table)).drop("month")

    def replace_window(self, table: str, new: DataFrame, cutoff: str) -> list[str]:
        """Rows from the cutoff (a date) on become those of new; only the months from the cutoff's on are read and written again. Months
        left without a row are deleted. Returns the months rewritten or deleted. Rows without a date stay."""
        path, first = self._place(table), cutoff[:7]
        held = [m.removeprefix("month=") for m in children(self.spark, path) if m.startswith("month=")]
        touched = {m for m in held if m >= first and m != "none"}
        rows = self.spark.read.parquet(path)
        old = rows.where((F.col("month") >= first) & (F.col("month") != "none") & (F.col("date") < F.lit(cutoff).cast("date"))).drop("month")
        staged = _staged(self._dealt(old.unionByName(new.select(*old.columns).where(F.col("date") >= F.lit(cutoff).cast("date")))))
        months = {r.month for r in staged.select("month").distinct().collect()}
        _replace_partitions(staged.sortWithinPartitions("month", *[c for c in self.sort if c in staged.columns]), path, "month")
        for m in touched - months:
            delete(self.spark, f"{path}/month={m}")
        forget(staged)
        return sorted(touched | months)


class KeyedTable:
    """A table with unique keys, in buckets by a hash of these; a merge rewrites the buckets it touches and no other.

    Merging the same rows twice changes nothing, so it is a sink that may be given a batch again (foreachBatch)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 16) -> None:
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path.rstrip("/"), keys, schema, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        if not there(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        # The schema is given, so no file is opened to learn it, and an empty folder is an empty table.
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path).drop("bucket")

    def merge(self, rows: DataFrame, update: list[str] | None = None, newest: str | None = None) -> None:
        """Upsert by posts.merge: new keys whole, of known ones the columns in `update`. Of rows with one key the one with the greatest
        `newest` counts; with it, a row older than what the table holds changes nothing."""
        names = self.spark.createDataFrame([], self.schema).columns
        rows = rows.select(*names)
        if newest:
            rest = [c for c in names if c not in self.keys and c != newest]
            top = rows.groupBy(*self.keys).agg(F.max(F.struct(newest, *rest)).alias("__m"))
            rows = top.select(*self.keys, "__m.*").select(*names)
        rows = _staged(rows.withColumn("bucket", self._bucket()))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most `buckets`
        if not touched:
            forget(rows)
            return
        old = self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path).where(F.col("bucket").isin(touched)).drop("bucket") if there(self.spark, self.path) else self.spark.createDataFrame([], self.schema)
        new = rows.drop("bucket")
        if newest:
            known = old.select(*self.keys, F.col(newest).alias("__held"))
            new = new.join(known, self.keys, "left").where(F.col("__held").isNull() | (F.col(newest) >= F.col("__held"))).select(*names)
        after = _staged(posts.merge(old, new, self.keys, update).withColumn("bucket", self._bucket()).repartition("bucket"))
        _replace_partitions(after, self.path, "bucket")
        forget(rows, after)
