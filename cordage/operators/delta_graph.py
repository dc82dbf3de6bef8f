"""A graph kept on disk by signed changes: a commit takes the edges of the changed files only and folds them into stored edges, coupling and cycles.

Each commit adds one segment ``seg=`` of Parquet files that never change, dealt by hash into ``bucket=`` folders:

* ``files``: file, src, dst, kind, n: the change of the edge's number in its file, by file;
* ``links``: way, node, other, kind, n: the change of the number of files' edges, by source (way out) and once more by target (way in);
* ``scores``: name, n: the change of the coupling score: distinct (src, dst, kind) into the name, without inheritance and edges to itself;
* ``members``: name, component, size, n: rows of strong components that came (1) or went (-1).

What stands at a version is the sum over its segments. A commit reads of older segments the buckets of the changed files, of the touched edges' ends, and for cycles
those that a search from the new edges meets: a component changes only if it holds a new edge, or lost an inner one. So the nodes that new edges' targets
reach and that reach new edges' sources, with the components that lost an edge, are solved anew by themselves; all others keep their rows.
Solving takes rounds by the diameter, and the driver holds their plans. A store whose edges and coupling alone are asked for is made without ``members``.

Nulls: rows without file, src, dst or kind are left out. An edge that a file holds several times counts once. Rows of files that are not named as changed
are left out. An empty change commits an empty segment; an empty graph has no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cordage.operators.graph import strong_components
from cordage.plans.iterate import cut, tidy
from cordage.plans.versions import commit, current, manifest

#: Kinds of edges that coupling leaves out.
UNCOUPLED = ("Inheritance",)
BUCKETS = 64


def _bucket(c: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


class Store:
    """The graph at ``path``; names of nodes have the type ``key``, which with the number of buckets, and whether ``members`` are kept, holds from the first commit on."""

    def __init__(self, spark: SparkSession, path: str, key: str = "string", buckets: int = BUCKETS, members: bool = True):
        first = manifest(spark, path, 1) if current(spark, path) else {}
        self.spark, self.path = spark, path
        self.key, self.buckets, self.members = first.get("key", key), first.get("buckets", buckets), first.get("members", members if not first else True)
        k = self.key
        self._schemas = {
            "files": f"file string, src {k}, dst {k}, kind string, n long",
            "links": f"node {k}, other {k}, kind string, n long, way string",
            "scores": f"name {k}, n long",
            "members": f"name {k}, component {k}, size long, n long",
        }

    def version(self) -> int:
        return current(self.spark, self.path)

    def segments(self, version: int | None = None) -> list[str]:
        return manifest(self.spark, self.path, version).get("segments", [])

    def _rows(self, what: str, segments: list[str], where: Column | None = None) -> DataFrame:
        """Rows of the segments. Segment, bucket and way are folders, so a condition on them leaves files out."""
        if not segments:
            return self.spark.createDataFrame([], self._schemas[what])
        schema = f"{self._schemas[what]}, seg string, bucket int"
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{what}").filter(F.col("seg").isin(segments))
        rows = rows if where is None else rows.filter(where)
        return rows.drop("seg", "bucket")

    def _summed(self, what: str, segments: list[str], where: Column | None = None) -> DataFrame:
        rows = self._rows(what, segments, where)
        return rows.groupBy(*[c for c in rows.columns if c != "n"]).agg(F.sum("n").alias("n")).filter("n != 0")

    def _of(self, names: DataFrame) -> Column:
        """The condition for the buckets of the names (their first column); at most as many numbers as buckets come to the driver."""
        met = names.select(_bucket(names.columns[0], self.buckets).alias("b")).distinct().collect()
        return F.col("bucket").isin([r.b for r in met]) if met else F.lit(False)

    def _write(self, rows: DataFrame, what: str, by: str, seg: str) -> None:
        also = ["way"] if what == "links" else []
        dealt = rows.withColumn("seg", F.lit(seg)).withColumn("bucket", _bucket(by, self.buckets))
        # Ranges split a bucket that is large; sorted inside, so that statistics of a file leave its parts out.
        ranged = dealt.repartitionByRange(*also, "bucket", by).sortWithinPartitions(*also, "bucket", by)
        with tidy(self.spark):
            ranged.write.mode("append").partitionBy("seg", *also, "bucket").parquet(f"{self.path}/{what}")

    def edges(self, version: int | None = None) -> DataFrame:
        """src, dst, kind of the version, each once."""
        return self._summed("links", self.segments(version), F.col("way") == "out").select(F.col("node").alias("src"), F.col("other").alias("dst"), "kind")

    def coupling(self, version: int | None = None) -> DataFrame:
        """name, score of every name with a score above 0."""
        return self._summed("scores", self.segments(version)).select("name", F.col("n").alias("score"))

    def components(self, version: int | None = None) -> DataFrame:
        """name, component (its least name), size of every name on a cycle of any length."""
        self._keeps_members()
        return self._summed("members", self.segments(version)).select("name", "component", "size")

    def fold(self, changed: DataFrame, edges: DataFrame, base: int | None = None) -> int:
        """Commits the new edges (file, src, dst, kind) of the ``changed`` files (file): new, edited, or deleted ones, which have no edges left.

        Returns the new version. ``base`` is the version the caller has read (the newest if not given). Conflict, and nothing changed, if another
        writer has committed since; the segment then is in no version.
        """
        base = self.version() if base is None else base
        old = self.segments(base)
        seg = f"s{uuid.uuid4().hex}"
        files = cut(changed.select(F.col("file").cast("string").alias("file")).filter("file IS NOT NULL").distinct())
        self._write(self._file_changes(files, edges, old), "files", "file", seg)
        mine = [seg]
        delta = self._rows("files", mine).groupBy("src", "dst", "kind").agg(F.sum("n").alias("n")).filter("n != 0")
        out = delta.select(F.col("src").alias("node"), F.col("dst").alias("other"), "kind", "n", F.lit("out").alias("way"))
        into = delta.select(F.col("dst").alias("node"), F.col("src").alias("other"), "kind", "n", F.lit("in").alias("way"))
        self._write(out.unionByName(into), "links", "node", seg)
        # What this commit changed of edges, as facts: they came, or went.
        moved = cut(self._moved(mine, old))
        coupled = moved.filter(~F.col("kind").isin(*UNCOUPLED) & (F.col("src") != F.col("dst")))
        scores = coupled.groupBy(F.col("dst").alias("name")).agg(F.sum("change").cast("long").alias("n")).filter("n != 0")
        self._write(scores, "scores", "name", seg)
        if self.members:
            self._write(self._member_changes(moved, old, mine), "members", "name", seg)
        return commit(self.spark, self.path, base, {"segments": old + mine, "key": self.key, "buckets": self.buckets, "members": self.members})

    def _keeps_members(self) -> None:
        if not self.members:
            raise ValueError(f"{self.path} was made without members: its components are not kept")

    def _file_changes(self, files: DataFrame, edges: DataFrame, old: list[str]) -> DataFrame:
        now = edges.select(F.col("file").cast("string").alias("file"), F.col("src").cast(self.key).alias("src"), F.col("dst").cast(self.key).alias("dst"), "kind")
        now = now.dropna().distinct().join(files, "file", "left_semi").withColumn("n", F.lit(1).cast("long"))
        before = self._summed("files", old, self._of(files)).join(files, "file", "left_semi").withColumn("n", -F.col("n"))
        both = now.unionByName(before)
        return both.groupBy("file", "src", "dst", "kind").agg(F.sum("n").alias("n")).filter("n != 0")

    def _moved(self, mine: list[str], old: list[str]) -> DataFrame:
        """src, dst, kind, change: edges that no file held and one does now (1), or the other way round (-1)."""
        delta = self._rows("links", mine, F.col("way") == "in").drop("way")
        touched = self._of(delta.select("node"))
        stood = self._rows("links", old, (F.col("way") == "in") & touched).drop("way")
        stood = stood.join(delta.select("node", "other", "kind"), ["node", "other", "kind"], "left_semi").withColumn("was", F.col("n"))
        both = stood.unionByName(delta.withColumn("was", F.lit(0).cast("long")))
        sums = both.groupBy("node", "other", "kind").agg(F.sum("n").alias("n"), F.sum("was").alias("was"))
        change = (F.col("n") > 0).cast("int") - (F.col("was") > 0).cast("int")
        return sums.select(F.col("other").alias("src"), F.col("node").alias("dst"), "kind", change.alias("change")).filter("change != 0")

    def _steps(self, names: DataFrame, way: str, segments: list[str]) -> DataFrame:
        """node, other: edges of the version at the names (column name), read from their buckets."""
        rows = self._rows("links", segments, (F.col("way") == way) & self._of(names)).join(names.withColumnRenamed("name", "node"), "node", "left_semi")
        return rows.filter("node != other").groupBy("node", "other", "kind").agg(F.sum("n").alias("n")).filter("n > 0").select("node", "other").distinct()

    def _reached(self, starts: DataFrame, way: str, segments: list[str], inside: DataFrame | None = None) -> DataFrame:
        """name: the starts and all that they reach, in ``inside`` only if it is given. A round reads what the round before met."""
        seen = frontier = cut(starts if inside is None else starts.join(inside, "name", "left_semi"))
        while not frontier.isEmpty():
            onward = self._steps(frontier, way, segments).select(F.col("other").alias("name")).distinct().join(seen, "name", "left_anti")
            frontier = cut(onward if inside is None else onward.join(inside, "name", "left_semi"))
            # One table of all names met, so that plans don't grow with the rounds.
            seen = cut(seen.unionByName(frontier))
        return seen

    def _member_changes(self, moved: DataFrame, old: list[str], mine: list[str]) -> DataFrame:
        was, now = self._summed("members", old).drop("n"), old + mine
        ends = moved.filter("src != dst")
        place = was.select("name", "component")
        inner = ends.filter("change < 0").join(place.select(F.col("name").alias("src"), F.col("component").alias("a")), "src").join(place.select(F.col("name").alias("dst"), F.col("component").alias("b")), "dst")
        broken = inner.filter("a = b").select(F.col("a").alias("component")).distinct()
        lost = was.join(broken, "component", "left_semi").select("name")
        came = ends.filter("change > 0")
        into, out = came.select(F.col("dst").alias("name")).distinct(), came.select(F.col("src").alias("name")).distinct()
        # In a first commit all edges are new: both ways from them is all that has edges both in and out.
        between = self._reached(out, "in", now, self._reached(into, "out", now)) if old else into.intersect(out)
        again = cut(between.union(lost).distinct())
        if again.isEmpty():
            return self._rows("members", [])
        steps = self._steps(again, "out", now).join(again.select(F.col("name").alias("other")), "other", "left_semi")
        solved = strong_components(steps.select(F.col("node").alias("src"), F.col("other").alias("dst")))
        gone = was.join(again, "name", "left_semi")
        both = solved.select("name", "component", "size", F.lit(1).cast("long").alias("n")).unionByName(gone.select("name", "component", "size", F.lit(-1).cast("long").alias("n")))
        return both.groupBy("name", "component", "size").agg(F.sum("n").alias("n")).filter("n != 0")

    def coupling_changes(self, before: int, after: int) -> DataFrame:
        """name, before, after, delta of every name whose score differs. The change is read from the segments between; scores from the buckets it touches."""
        old, new = self.segments(before), self.segments(after)
        since = [s for s in new if s not in old]
        delta = cut(self._summed("scores", since).select("name", F.col("n").alias("delta")))
        stood = self._summed("scores", old, self._of(delta)).select("name", F.col("n").alias("before"))
        rows = delta.join(stood, "name", "left").select("name", F.coalesce("before", F.lit(0)).cast("long").alias("before"), "delta")
        return rows.select("name", "before", (F.col("before") + F.col("delta")).alias("after"), "delta")

    def cycle_changes(self, before: int, after: int) -> DataFrame:
        """name, component, size, change: rows of components that are in one of the versions only, added or removed. Only the segments between are read."""
        self._keeps_members()
        old, new = self.segments(before), self.segments(after)
        rows = self._summed("members", [s for s in new if s not in old])
        return rows.select("name", "component", "size", F.when(F.col("n") > 0, "added").otherwise("removed").alias("change"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, change (added, edited, deleted) of two lists of files with fingerprints (file, fingerprint). A fingerprint that is null differs from every other."""
    a, b = (d.select("file", "fingerprint", F.lit(True).alias("there")).alias(n) for d, n in ((before, "a"), (after, "b")))
    rows = a.join(b, "file", "full")
    change = F.when(F.col("a.there").isNull(), "added").when(F.col("b.there").isNull(), "deleted").when(F.coalesce(F.col("a.fingerprint") != F.col("b.fingerprint"), F.lit(True)), "edited")
    return rows.select("file", change.alias("change")).filter("change IS NOT NULL")
