"""Debounced changes, in a batch and in a stream."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cordage.streaming import watch as W

T0 = datetime(2024, 1, 1)
EVENTS = [(0.0, "P"), (0.4, "Q"), (0.9, "P"), (5.0, "R")]


def events(spark, rows=EVENTS):
    return spark.createDataFrame([(T0 + timedelta(seconds=s), f"/src/{c}@x.cs") for s, c in rows], "ts timestamp, path string")


def test_batch(spark):
    changes = W.change_events(events(spark))
    assert [(r.cls, r.changes) for r in W.debounced(changes).orderBy("started").collect()] == [("P", 3), ("R", 1)]
    each = {(r.cls, r.changes) for r in W.debounced(changes, per_class=True).collect()}
    assert each == {("P", 2), ("Q", 1), ("R", 1)}
    assert W.change_events(events(spark), ["q"]).count() == 1


def test_stream(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    events(spark).write.parquet(src)
    # A later change moves the watermark beyond the bursts.
    events(spark, [(60.0, "Z")]).write.mode("append").parquet(src)
    stream = spark.readStream.schema("ts timestamp, path string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(src)
    edges = spark.createDataFrame([("X", "P"), ("Y", "X")], "src string, dst string")
    seen = {}

    def sink(df, number):
        seen.update({r.cls: (r.changes, r.affected) for r in df.collect()})

    q = W.watch(W.change_events(stream), edges, sink, f"file://{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert seen.get("P") in {(3, 2)} and seen.get("R") == (1, 0)


def test_impact(spark):
    edges = spark.createDataFrame([("X", "P")], "src string, dst string")
    changes = spark.createDataFrame([("P", 2), ("N", 1)], "cls string, changes long")
    assert {tuple(r) for r in W.impact_of(changes, edges).collect()} == {("P", 2, 1), ("N", 1, 0)}
    assert F.lit is not None


def test_bursts_across_ranges(spark):
    """Many changes over many ranges of time, against one pass in order."""
    import random

    rng = random.Random(4)
    at, rows = 0.0, []
    for i in range(400):
        at += rng.choice([0.1, 0.3, 0.9, 1.0, 2.5])
        rows.append((round(at, 1), f"C{i}"))
    want, last = [], None
    for t, c in rows:
        if last is None or round(t - last, 1) >= 1.0:
            want.append([c, 0])
        want[-1] = [c, want[-1][1] + 1]
        last = t
    got = W.debounced(W.change_events(events(spark, rows)).repartition(7)).orderBy("started").collect()
    assert [[r.cls, r.changes] for r in got] == want
    assert W.debounced(W.change_events(events(spark, rows)).limit(0)).count() == 0


def test_analysis(spark):
    edges = spark.createDataFrame([("X", "P"), ("Y", "X")], "src string, dst string")
    changes = spark.createDataFrame([("P", 2), ("N", 1)], "cls string, changes long")
    tests = spark.createDataFrame([("PTest",), ("XYZ",), ("Other",)], "stem string")
    issues = spark.createDataFrame([("P", "Error"), ("P", "Info"), ("X", "Error")], "cls string, severity string")
    got = {r.cls: r[1:] for r in W.analysis_of(changes, edges, tests, issues).collect()}
    assert got == {"P": (2, 2, 2, 2, 1), "N": (1, 0, 0, 0, 0)}


def test_stream_gives_the_whole_analysis(spark, tmp_path):
    """With tests and issues, a batch's rows are those of ``analysis_of``; a query that starts again from its checkpoint gives no row twice."""
    src = f"file://{tmp_path}/in"
    events(spark).write.parquet(src)
    events(spark, [(60.0, "Z")]).write.mode("append").parquet(src)
    edges = spark.createDataFrame([("X", "P"), ("Y", "X")], "src string, dst string")
    tests = spark.createDataFrame([("PTest",), ("Unit",)], "stem string")
    issues = spark.createDataFrame([("P", "Error"), ("P", "Info")], "cls string, severity string")
    seen = []

    def run():
        stream = spark.readStream.schema("ts timestamp, path string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(src)
        q = W.watch(W.change_events(stream), edges, lambda df, n: seen.extend((r.cls, r.affected, r.tests, r.issues, r.errors) for r in df.collect()), f"file://{tmp_path}/cp", tests=tests, issues=issues)
        q.processAllAvailable()
        q.stop()

    run()
    first = sorted(seen)
    assert ("P", 2, 1, 2, 1) in first and ("R", 0, 0, 0, 0) in first
    run()
    assert sorted(seen) == first
