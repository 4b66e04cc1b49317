"""Keyed state over event time: status transitions, growing threads, alerts, an index that follows its table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulsegrid.operators import posts
from pulsegrid.operators.index import PhraseIndex
from pulsegrid.sources.tables import KeyedTable

STATUS = "username string, status string, checked_at timestamp, changed_at timestamp"
GROWTH = "id long, num_comments long, refreshes long, at timestamp"
#: What transformWithState needs of its store.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _fold(status, checked, changed, rows: Iterable[tuple]) -> tuple:
    """The state after (at, status) rows in the order of their times: checked always, changed where the status differs."""
    for at, new in sorted(rows):
        changed = at if new != status or changed is None else changed
        status, checked = new, at
    return status, checked, changed


class StatusTransitions(StatefulProcessor):
    """Stamps each author's status. Rows that may still be overtaken by earlier ones wait in a list; a timer settles them when the
    watermark has passed them, so the stamps are those of the order of time, whatever the order of arrival. The state as it stands,
    with the waiting rows, is given out at every change. An author's rows of a batch and a status wait as one entry of the list, and an
    author has one timer, at the newest waiting row: a call or an entry for each row would cost more than all else."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "status string, checked long, changed long")
        self.waiting = handle.getListState("waiting", "status string, at array<long>")
        self.timer = handle.getValueState("timer", "at long")

    def _held(self) -> tuple:
        return tuple(self.settled.get()) if self.settled.exists() else (None, None, None)

    def _wait(self, rows: set[tuple], more: bool) -> None:
        """These (at, status) rows wait: besides what waits already, or instead of it."""
        by: dict = {}
        for at, status in rows:
            by.setdefault(status, []).append(at)
        if more:
            self.waiting.appendList(list(by.items()))
        elif by:
            self.waiting.put(list(by.items()))
        else:
            self.waiting.clear()

    def _settle(self, watermark_ms: int, new: set[tuple] = frozenset()) -> tuple:
        """The state with all rows, after those that the watermark has passed are settled."""
        old = {(at, r[0]) for r in self.waiting.get() for at in r[1]} if self.waiting.exists() else set()
        rows = old | new
        due = {r for r in rows if r[0] // 1000 <= watermark_ms}
        state, left = self._held(), rows - due
        if due:
            state = _fold(*state, due)
            self.settled.update(state)
            self._wait(left, False)
        elif new - old:
            self._wait(new - old, True)
        self._wake(max(at for at, _ in left) // 1000 + 1 if left else None)
        return _fold(*state, left)

    def _wake(self, at: int | None) -> None:
        """The author's one timer is at this time."""
        set_to = self.timer.get()[0] if self.timer.exists() else None
        if at == set_to:
            return
        if set_to is not None:
            self.handle.deleteTimer(set_to)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = {(int(at), status) for part in rows for at, status in zip(part["at_us"], part["status"], strict=True)}
        status, checked, changed = self._settle(timerValues.getCurrentWatermarkInMs(), new)
        yield pd.DataFrame({"username": [key[0]], "status": [status], "checked_us": [checked], "changed_us": [changed]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()  # it is gone by itself
        self._settle(timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def status_transitions(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """(username, status, at) -> the author's row of STATUS at every change. Rows later than `delay` behind the newest are dropped by the watermark."""
    rows = stream.withWatermark("at", delay).withColumn("at_us", F.unix_micros("at"))
    out = rows.groupBy("username").transformWithStateInPandas(StatusTransitions(), "username string, status string, checked_us long, changed_us long", "Update", "EventTime")
    return out.select("username", "status", F.timestamp_micros("checked_us").alias("checked_at"), F.timestamp_micros("changed_us").alias("changed_at"))


class GrowingThreads(StatefulProcessor):
    """Gives out a thread when its count of comments is above all counts before, while it is at most `days` old by its first sight; then a
    timer drops its state."""

    def __init__(self, days: int) -> None:
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.most = handle.getValueState("most", "count long, refreshes long, born long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = sorted((int(at), int(n)) for part in rows for at, n in zip(part["at_us"], part["num_comments"], strict=True))
        count, refreshes, born = self.most.get() if self.most.exists() else (0, 0, seen[0][0])
        end, last = born + self.days * 86_400_000_000, None
        for at, n in seen:
            if n > count and at <= end:
                count, refreshes, last = n, refreshes + 1, at
        self.most.update((count, refreshes, born))
        self.handle.registerTimer(end // 1000 + 1)
        if last is not None:
            yield pd.DataFrame({"id": [key[0]], "num_comments": [count], "refreshes": [refreshes], "at_us": [last]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.most.clear()
        yield pd.DataFrame({"id": [], "num_comments": [], "refreshes": [], "at_us": []}).astype("int64")

    def close(self) -> None:
        pass


def growing_threads(stream: DataFrame, days: int = 14, delay: str = "1 day") -> DataFrame:
    """(id, num_comments, at) -> rows of GROWTH for threads that must be read again: the greatest count so far, how many rises led to it, and when."""
    rows = stream.withWatermark("at", delay).withColumn("at_us", F.unix_micros("at"))
    out = rows.groupBy("id").transformWithStateInPandas(GrowingThreads(days), "id long, num_comments long, refreshes long, at_us long", "Update", "EventTime")
    return out.select("id", "num_comments", "refreshes", F.timestamp_micros("at_us").alias("at"))


def new_alerts(stream: DataFrame, keywords: list[str]) -> DataFrame:
    """Alerts of posts whose id was not seen before; the ids seen are the state, and it is kept."""
    return posts.keyword_alerts(stream.dropDuplicates(["id"]), keywords)


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a stream over all that is there now, with `each` as its sink. Started again on the same checkpoint it goes on behind what was
    finished; a batch that was cut short is given to `each` again, which must bear it."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def into_table(stream: DataFrame, table: KeyedTable, checkpoint: str, newest: str | None = None) -> None:
    """Every batch is merged into the table: repeated batches and repeated keys change nothing."""
    run(stream, lambda batch, _: table.merge(batch, newest=newest), checkpoint)


def into_index(stream: DataFrame, index: PhraseIndex, checkpoint: str) -> None:
    """Every batch's new documents are added to the index, which is built by the first."""

    def each(batch: DataFrame, _: int) -> None:
        repeats = not batch.groupBy(index.id_col).count().where("count > 1").isEmpty()
        rows = batch.dropDuplicates([index.id_col]) if repeats else batch  # which moves whole texts
        if index._generations():
            index.append(rows)
        else:
            index.build(rows)

    run(stream, each, checkpoint)


def table_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The files of a Parquet table, which may be one file, as a stream of all of its columns."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # As a pattern that matches the path alone, for a stream takes a plain path to be a folder.
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(f"{path[:-1]}[{path[-1]}]")
