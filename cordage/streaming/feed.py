"""A stream source of the changes of a folder, and a debounce that waits by the clock.

``ChangeFeed`` lists a folder on the driver at every trigger, as file sources do, and compares the list with the one before. Each difference
gets a number, which is the stream's offset, and a file of that number in the ``log`` folder: the changes and the list after them. A query that
starts again from its checkpoint reads the changes after its last batch from there; those that happened while it was down are found by the
next comparison. Executors get the rows themselves and open no files.

``quiet`` keeps one pending change per project. Each further change resets the project's timer; when it runs out, the last change is emitted
once. It needs the RocksDB state store (``with_timers``).
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from fnmatch import fnmatch

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cordage.streaming.watch import SOURCE_FILES, analysis_of, change_events, impact_of

FEED = "ts timestamp, path string, change string"
#: Changes handed to one task.
PART = 10_000


class _Part(InputPartition):
    def __init__(self, rows: list[tuple[float, str, str]]):
        self.rows = rows


class ChangeReader(DataSourceStreamReader):
    """Options: path, log, endings (comma-separated; source files if not given), existing (true: the files found at first count as created)."""

    def __init__(self, options: dict):
        self.folder, self.log = options["path"], options["log"]
        self.endings = tuple(e.strip().lower() for e in options.get("endings", ",".join(SOURCE_FILES)).split(","))
        self.existing = str(options.get("existing", "false")).lower() == "true"
        self.fresh = True

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in os.listdir(self.log) if fnmatch(n, "[0-9]*.json"))

    def _load(self, number: int) -> dict:
        with open(f"{self.log}/{number:012d}.json") as f:
            return json.load(f)

    def _store(self, number: int, content: dict) -> None:
        draft = f"{self.log}/.{os.getpid()}.draft"
        with open(draft, "w") as f:
            json.dump(content, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(draft, f"{self.log}/{number:012d}.json")

    def _listed(self) -> dict[str, list[int]]:
        found, open_folders = {}, [self.folder]
        while open_folders:
            try:
                with os.scandir(open_folders.pop()) as entries:
                    for e in entries:
                        if e.is_dir(follow_symlinks=False):
                            open_folders.append(e.path)
                        elif e.name.lower().endswith(self.endings):
                            s = e.stat()
                            found[e.path] = [s.st_mtime_ns, s.st_size]
            except FileNotFoundError:
                pass  # gone since it was listed: the next comparison has it as deleted
        return found

    def _begun(self) -> list[int]:
        """The numbers there are; at first the folder's list is stored as number 0."""
        os.makedirs(self.log, exist_ok=True)
        if not self._numbers():
            self._store(0, {"changes": [], "files": {} if self.existing else self._listed()})
        return self._numbers()

    def initialOffset(self) -> dict:
        return {"number": self._begun()[0]}

    def latestOffset(self) -> dict:
        newest = self._begun()[-1]
        before, after = self._load(newest)["files"], self._listed()
        now = time.time()
        changes = [(v[0] / 1e9, p, "modified" if p in before else "created") for p, v in after.items() if before.get(p) != v]
        changes += [(now, p, "deleted") for p in before if p not in after]
        # A query's first batch after a start runs even without changes: timers that ran out while it was down wait for a batch.
        if changes or self.fresh:
            self.fresh = False
            newest += 1
            self._store(newest, {"changes": sorted(changes), "files": after})
        return {"number": newest}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows = [tuple(c) for n in range(start["number"] + 1, end["number"] + 1) for c in self._load(n)["changes"]]
        return [_Part(rows[i : i + PART]) for i in range(0, len(rows), PART)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for at, path, change in partition.rows:
            yield datetime.fromtimestamp(at, tz=timezone.utc), path, change

    def commit(self, end: dict) -> None:
        for n in self._numbers():
            if n < end["number"]:
                os.remove(f"{self.log}/{n:012d}.json")


class ChangeFeed(DataSource):
    """ts, path, change (created, modified, deleted) of a folder's source files."""

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return FEED

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChangeReader(dict(self.options))


def changes_of(spark: SparkSession, folder: str, log: str, **options: str) -> DataFrame:
    """The stream of ``ChangeFeed``; ``log`` is a folder of the driver that outlives it and belongs to this one stream."""
    spark.dataSource.register(ChangeFeed)
    return spark.readStream.format("change_feed").option("log", log).options(**options).load(folder)


#: As the state holds them: times in microseconds, and cls as name (a row's field can't be called cls in Python).
QUIET = "project string, name string, path string, changes long, started long, last long"


class _Pending(StatefulProcessor):
    """One row of state and one timer per project."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "name string, path string, changes long, started long, last long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        name, path, changes, started, last, due = self.pending.get() if self.pending.exists() else (None, None, 0, None, None, None)
        for r in rows:
            changes += 1
            started = r.ts if started is None or r.ts < started else started
            if last is None or (r.ts, r.path) >= (last, path):
                name, path, last = r.name, r.path, r.ts
        if due is not None:
            self.handle.deleteTimer(due)
        due = timerValues.getCurrentProcessingTimeInMs() + self.gap_ms
        self.handle.registerTimer(due)
        self.pending.update((name, path, changes, started, last, due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.pending.exists():
            return
        name, path, changes, started, last, _ = self.pending.get()
        self.pending.clear()
        yield Row(project=key[0], name=name, path=path, changes=changes, started=started, last=last)

    def close(self) -> None:
        pass


def with_timers(spark: SparkSession) -> None:
    """Sets the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def quiet(changes: DataFrame, gap_ms: int = 1000) -> DataFrame:
    """project, cls, path, changes, started, last: the last change of each project (columns project, ts, path, cls) after ``gap_ms`` without another.

    Timers survive a restart; those due go off with the first batch, which ``ChangeFeed`` begins at once and other sources with their next row.
    Rows without a time or path are left out; a null project is one of its own. Of changes at one time the greatest path is the last.
    """
    rows = changes.filter("ts IS NOT NULL AND path IS NOT NULL").select("project", F.unix_micros("ts").alias("ts"), "path", F.col("cls").alias("name"))
    rest = rows.groupBy("project").transformWithState(_Pending(gap_ms), QUIET, "Update", "processingTime")
    return rest.select("project", F.col("name").alias("cls"), "path", "changes", F.timestamp_micros("started").alias("started"), F.timestamp_micros("last").alias("last"))


def watch_folder(spark: SparkSession, folder: str, log: str, edges: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, project: str = "", gap_ms: int = 1000,
                 classes: list[str] | None = None, depth: int = 3, tests: DataFrame | None = None, issues: DataFrame | None = None):
    """Start a query that watches a folder: created and modified source files, debounced, and per micro-batch the analysis of what came to rest
    (``analysis_of`` with ``tests`` and ``issues``, else ``impact_of``) for ``sink``. The sink must be idempotent by batch number."""
    with_timers(spark)
    files = changes_of(spark, folder, log).filter("change <> 'deleted'")
    rest = quiet(change_events(files, classes).withColumn("project", F.lit(project)), gap_ms)

    def each(batch: DataFrame, number: int) -> None:
        found = batch.persist()
        try:
            if not found.isEmpty():
                changes = found.select("cls", "changes")
                whole = tests is not None and issues is not None
                sink(analysis_of(changes, edges, tests, issues, depth) if whole else impact_of(changes, edges, depth), number)
        finally:
            found.unpersist()

    return rest.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(each).start()
