"""Watching changes: debounce bursts, then analyse what changed.

``debounced`` works on a batch or a stream of change events (ts, cls, and other columns). In a stream it needs a watermark, so that a
burst is emitted once it can't grow any more; events later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cordage.operators.graph import levels
from cordage.operators.reports import name_pairs
from cordage.plans.iterate import cut

SOURCE_FILES = (".cs", ".cpp", ".h", ".hpp")


def change_events(raw: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """ts, path, cls from (ts, path): changes of source files, of the given classes (letters in either case) only."""
    from cordage.functions.text import class_of_file

    ends = F.lower("path").rlike(r"\.(cs|cpp|h|hpp)$")
    rows = raw.filter(ends).select("ts", "path", class_of_file(F.col("path")).alias("cls"))
    return rows.filter(F.lower("cls").isin(*[c.lower() for c in classes])) if classes else rows


def debounced(events: DataFrame, gap: str = "1 second", watermark: str | None = None, per_class: bool = False, by: str = "ts") -> DataFrame:
    """cls, changes, started, ended: of every burst (changes closer than ``gap``) the last class changed, or with ``per_class`` every class.

    Without ``per_class`` a burst is one group; it is as large as the longest stretch without a pause. A batch is dealt by ranges of time, and
    bursts that cross a seam are joined there; a stream has one global state, as the pause it waits for is global.
    """
    last = F.max_by("cls", F.struct("ts", by) if by != "ts" else F.col("ts")).alias("cls")
    if not (events.isStreaming or per_class):
        rows = _bursts(events, gap, by)
        ended = F.timestamp_seconds(F.unix_micros(F.max("ts").cast("timestamp")) / F.lit(1e6) + F.lit(_seconds(gap)))
        out = rows.groupBy("burst").agg(last, F.count("*").alias("changes"), F.min("ts").alias("started"), ended.cast(events.schema["ts"].dataType).alias("ended"))
        return out.select("cls", "changes", "started", "ended")
    rows = events.withWatermark("ts", watermark) if watermark else events
    # Session windows of a stream need a key beside the window: without classes, one that is always 0.
    keys = [F.session_window("ts", gap).alias("w"), F.col("cls") if per_class else F.pmod(F.hash("cls"), F.lit(1)).alias("all")]
    out = rows.groupBy(*keys).agg(*([] if per_class else [last]), F.count("*").alias("changes"))
    return out.select("cls", "changes", F.col("w.start").alias("started"), F.col("w.end").alias("ended"))


def _seconds(gap: str) -> float:
    number, unit = gap.split()
    return float(number) * {"millisecond": 0.001, "second": 1, "minute": 60, "hour": 3600}[unit.rstrip("s")]


def _bursts(events: DataFrame, gap: str, by: str) -> DataFrame:
    """Adds burst: a number that changes in order of time wherever ``gap`` or more has passed."""
    order = ["ts", by] if by != "ts" else ["ts"]
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    ranged = cut(events.withColumn("_at", at).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order)
    pause = int(_seconds(gap) * 1e6)
    rows = ranged.withColumn("_new", F.coalesce((F.col("_at") - F.lag("_at").over(inside) >= pause).cast("long"), F.lit(0)))
    # One row per range: whether a pause lies before it, and how many bursts began before it.
    seams = rows.groupBy("_part").agg(F.min("_at").alias("low"), F.max("_at").alias("high"), F.sum("_new").alias("n"))
    whole = Window.orderBy("_part")
    seams = seams.withColumn("first", F.coalesce((F.col("low") - F.lag("high").over(whole) >= pause).cast("long"), F.lit(0)))
    earlier = F.coalesce(F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.sum("first").over(whole.rowsBetween(Window.unboundedPreceding, 0))
    within = F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_within", within).join(seams.select("_part", earlier.alias("_earlier")), "_part").select(*events.columns, (F.col("_earlier") + F.col("_within")).alias("burst"))


def analysis_of(changes: DataFrame, edges: DataFrame, tests: DataFrame, issues: DataFrame, depth: int = 3) -> DataFrame:
    """cls, changes, affected, tests, issues, errors: what a change reaches, test files (stem) named for it or for what it reaches, and the lint issues (cls, severity) of its class."""
    starts = changes.select(F.col("cls").alias("start")).distinct()
    reached = cut(levels(edges, starts, depth, reverse=True).select("start", F.col("name").cast("string").alias("name")))
    affected = reached.groupBy(F.col("start").alias("cls")).agg(F.count("*").alias("affected"))
    scope = reached.unionByName(starts.select("start", F.col("start").cast("string").alias("name")))
    named = name_pairs(tests, scope.select(F.col("name").alias("cls"))).withColumnRenamed("cls", "name")
    per_test = scope.join(named, "name").groupBy(F.col("start").alias("cls")).agg(F.countDistinct("stem").alias("tests"))
    linted = issues.groupBy("cls").agg(F.count("*").alias("issues"), F.count_if(F.col("severity") == "Error").alias("errors"))
    rows = changes.select("cls", "changes").join(affected, "cls", "left").join(per_test, "cls", "left").join(linted, "cls", "left")
    return rows.na.fill(0, ["affected", "tests", "issues", "errors"])


def impact_of(changes: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """cls, changes, affected: how many types a change reaches."""
    starts = changes.select(F.col("cls").alias("start")).distinct()
    reached = levels(edges, starts, depth, reverse=True).groupBy(F.col("start").alias("cls")).agg(F.count("*").alias("affected"))
    return changes.join(reached, "cls", "left").select("cls", "changes", F.coalesce("affected", F.lit(0)).alias("affected"))


def watch(events: DataFrame, edges: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, gap: str = "1 second", watermark: str = "5 seconds", depth: int = 3, tests: DataFrame | None = None, issues: DataFrame | None = None):
    """Start a query that gives every micro-batch's analysis to ``sink``: with ``tests`` (stem) and ``issues`` (cls, severity) that of
    ``analysis_of``, else the impact alone. The sink must be idempotent by batch number."""
    bursts = debounced(events, gap, watermark)

    def each(batch: DataFrame, number: int) -> None:
        changes = batch.select("cls", "changes")
        whole = tests is not None and issues is not None
        sink(analysis_of(changes, edges, tests, issues, depth) if whole else impact_of(changes, edges, depth), number)

    return bursts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each).start()
