"""Reading an archive by a cursor: pages from new to old, as a data source whose windows are read side by side."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A page: rows with a time in seconds under `created`, the newest first, all before the time asked for.
Fetch = Callable[[int, int], list[dict]]


def walk(fetch: Fetch, before: int, cutoff: int, limit: int) -> Iterator[dict]:
    """All rows from before `before` down to `cutoff` inclusive. It ends with an empty page, with a page that holds nothing older than the
    one before (no progress), or with the first row before the cutoff."""
    while before > cutoff:
        page = fetch(before, limit)
        if not page:
            return
        for row in page:
            if row["created"] >= cutoff:
                yield row
        oldest = min(row["created"] for row in page)
        if oldest >= before or oldest < cutoff:
            return
        before = oldest


class DayStore:
    """An archive on a shared folder: a Parquet file or more for each day, day=<number of the day>. page() gives at most `limit` rows, and more
    only where several share the last row's second, so that a cursor in seconds loses none. One day is in memory at a time."""

    def __init__(self, path: str) -> None:
        self.days = sorted(int(p.name.removeprefix("day=")) for p in Path(path).glob("day=*"))
        self.path, self.held, self.rows = path, None, []

    def _day(self, day: int) -> list[dict]:
        if self.held != day:
            self.held = day
            self.rows = sorted((r for f in Path(self.path, f"day={day}").glob("*.parquet") for r in pq.ParquetFile(f).read().to_pylist()), key=lambda r: (-r["created"], str(r["id"])))
        return self.rows

    def page(self, before: int, limit: int) -> list[dict]:
        out: list[dict] = []
        for day in (d for d in reversed(self.days) if d * 86_400 < before):
            rows = self._day(day)
            for row in rows[bisect.bisect_right(rows, -before, key=lambda r: -r["created"]) :]:
                if len(out) >= limit and row["created"] != out[-1]["created"]:
                    return out
                out.append(row)
            if len(out) >= limit:
                return out
        return out


@dataclass
class Window(InputPartition):
    """Seconds from `first` up to, but not with, `end`."""

    first: int
    end: int


def months(since: str, until: str, each: int) -> list[Window]:
    """Windows of `each` calendar months from a date up to another, that one excluded; the first and last may be shorter."""
    start, end = (datetime.fromisoformat(x).replace(tzinfo=UTC) for x in (since, until))
    edges, at = [start], datetime(start.year, start.month, 1, tzinfo=UTC)
    while True:
        n = at.month - 1 + each
        at = datetime(at.year + n // 12, n % 12 + 1, 1, tzinfo=UTC)
        if at >= end:
            break
        edges.append(at)
    return [Window(int(a.timestamp()), int(b.timestamp())) for a, b in zip(edges, [*edges[1:], end], strict=True) if a < b]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.path, self.limit, self.columns = options["path"], int(options.get("pagesize", 100)), schema.names
        self.windows = months(options["since"], options["until"], int(options.get("months", 1)))

    def partitions(self) -> list[Window]:
        return self.windows

    def read(self, partition: Window) -> Iterator[tuple]:
        store = DayStore(self.path)
        for row in walk(store.page, partition.end, partition.first, self.limit):
            yield tuple(row.get(c) for c in self.columns)


class Archive(DataSource):
    """spark.read.format("pulsegrid_archive"), options path, since, until (dates), months (to a partition), pagesize."""

    @classmethod
    def name(cls) -> str:
        return "pulsegrid_archive"

    def schema(self) -> str:
        return "id string, created bigint, author string, body string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options, schema)


def write_store(rows: DataFrame, path: str, files: int = 4) -> None:
    """Rows (id, created in seconds, ...) as a DayStore; a day is dealt over `files` files by the hash of the id."""
    rows.withColumn("day", F.floor(F.col("created") / 86_400).cast("long")).repartition("day", F.pmod(F.xxhash64("id"), F.lit(files))).write.partitionBy("day").parquet(path)


def read_archive(spark: SparkSession, path: str, since: str, until: str, each: int = 1, page: int = 100) -> DataFrame:
    """The archive's rows from `since` up to, but not with, `until`; one task for each window of `each` months, no row twice."""
    spark.dataSource.register(Archive)
    local = path.removeprefix("file:").replace("///", "/", 1)
    return spark.read.format("pulsegrid_archive").options(path=local, since=since, until=until, months=str(each), pagesize=str(page)).load()

