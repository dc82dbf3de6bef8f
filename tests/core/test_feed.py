"""Changes of a folder as a stream, and the debounce by timers, over restarts."""

import os
import time

import pytest
from pyspark.sql import functions as F

from cordage.streaming import feed as W

pytest.importorskip("google.protobuf", reason="timers need protobuf")


def put(folder, name, text="x"):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write(text)


def until(query, true, seconds=60):
    end = time.time() + seconds
    while time.time() < end and not true():
        if query.exception():
            raise query.exception()
        time.sleep(0.2)
    assert true()


def test_feed_gives_each_change_once(spark, tmp_path):
    folder, log, seen = f"{tmp_path}/src", f"{tmp_path}/log", []
    put(folder, "Old.cs")

    def start():
        rows = W.changes_of(spark, folder, log)
        return rows.writeStream.option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(lambda df, n: seen.extend((os.path.basename(r.path), r.change) for r in df.collect())).start()

    q = start()
    q.processAllAvailable()
    assert seen == []  # what was there before the watch began is no change
    put(f"{folder}/deep", "New.CPP")
    put(folder, "notes.txt")
    q.processAllAvailable()
    put(folder, "Old.cs", "longer")
    q.processAllAvailable()
    assert seen == [("New.CPP", "created"), ("Old.cs", "modified")]
    q.stop()
    put(folder, "Late.h")
    os.remove(f"{folder}/Old.cs")
    q = start()
    q.processAllAvailable()
    q.stop()
    assert sorted(seen[2:]) == [("Late.h", "created"), ("Old.cs", "deleted")]
    assert len(os.listdir(log)) <= 3


def test_the_same_offsets_give_the_same_rows(tmp_path):
    folder, log = f"{tmp_path}/src", f"{tmp_path}/log"
    reader = W.ChangeReader({"path": folder, "log": log})
    first = reader.initialOffset()
    put(folder, "A.cs")
    end = reader.latestOffset()
    rows = lambda: [r[1:] for p in W.ChangeReader({"path": folder, "log": log}).partitions(first, end) for r in reader.read(p)]
    before = rows()
    put(folder, "B.cs")
    reader.latestOffset()
    assert rows() == before == [(f"{folder}/A.cs", "created")]
    assert reader.latestOffset() == {"number": end["number"] + 1}  # nothing new: no new number
    existing = W.ChangeReader({"path": folder, "log": f"{tmp_path}/log2", "existing": "true"})
    assert existing.initialOffset() == {"number": 0} and len(existing.partitions({"number": 0}, existing.latestOffset())[0].rows) == 2


def test_only_the_last_of_a_burst_and_none_lost_by_a_restart(spark, tmp_path):
    W.with_timers(spark)
    source, seen = f"{tmp_path}/in", []

    def event(n, project, cls, second):
        row = spark.createDataFrame([(project, f"2024-01-01 00:00:{second:02d}", f"{cls}.cs", cls)], "project string, ts string, path string, cls string")
        row.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)

    event(0, "a", "P", 1)

    def start(gap):
        rows = spark.readStream.schema("project string, ts timestamp, path string, cls string").parquet(source)
        return W.quiet(rows, gap).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(lambda df, n: seen.extend((r.project, r.cls, r.changes) for r in df.collect())).start()

    def taken(q, rows):
        until(q, lambda: sum(p["numInputRows"] for p in q.recentProgress) >= rows)

    q = start(8000)
    taken(q, 1)
    event(1, "a", "Q", 3)
    event(2, "b", "Z", 2)
    event(3, "a", "R", 2)  # arrives later, happened earlier
    taken(q, 4)
    assert seen == []
    q.stop()
    event(4, "c", "N", 9)  # the first batch after the restart
    q = start(8000)
    until(q, lambda: {p for p, _, _ in seen} >= {"a", "b"})
    q.stop()
    assert sorted(r for r in seen if r[0] != "c") == [("a", "Q", 3), ("b", "Z", 1)]


def test_a_pending_change_comes_after_a_restart_without_another(spark, tmp_path):
    folder, seen = f"{tmp_path}/src", []
    os.makedirs(folder)
    edges = spark.createDataFrame([("X", "P")], "src string, dst string")

    def start():
        return W.watch_folder(spark, folder, f"{tmp_path}/log", edges, lambda df, n: seen.extend(map(tuple, df.collect())), f"{tmp_path}/cp", gap_ms=6000)

    q = start()
    until(q, lambda: len(q.recentProgress) > 0)
    put(folder, "P.cs")
    until(q, lambda: any(p["numInputRows"] for p in q.recentProgress))
    q.stop()
    assert seen == []
    q = start()
    until(q, lambda: bool(seen))
    q.stop()
    assert seen == [("P", 1, 1)]


def test_watching_a_folder(spark, tmp_path):
    folder, seen = f"{tmp_path}/src", {}
    os.makedirs(folder)
    edges = spark.createDataFrame([("X", "P"), ("Y", "X")], "src string, dst string")
    tests = spark.createDataFrame([("PTest",), ("Unit",)], "stem string")
    issues = spark.createDataFrame([("P", "Error"), ("P", "Info")], "cls string, severity string")
    q = W.watch_folder(spark, folder, f"{tmp_path}/log", edges, lambda df, n: seen.update({r.cls: tuple(r[1:]) for r in df.collect()}), f"{tmp_path}/cp", gap_ms=1500, tests=tests, issues=issues)
    until(q, lambda: len(q.recentProgress) > 0)
    put(folder, "N@Other.cs")
    put(folder, "P.cs")
    os.utime(f"{folder}/P.cs", (time.time() + 1, time.time() + 1))
    until(q, lambda: bool(seen))
    q.stop()
    assert seen == {"P": (2, 2, 1, 2, 1)}
