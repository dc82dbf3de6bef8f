"""The stored graph against full rebuilds after each of a series of commits, and what a commit reads."""

import random
import shutil
import time
import uuid
from pathlib import Path

import pytest

from cordage.operators import delta_graph
from cordage.operators.delta_graph import Store, changed_files
from cordage.plans import catalog
from cordage.plans.iterate import cut, shared_folder
from cordage.plans.versions import Conflict

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
EDGES = "file string, src string, dst string, kind string"


def store(spark, buckets=4):
    return Store(spark, f"{shared_folder(spark)}/test-graph-{uuid.uuid4().hex}", buckets=buckets)


def put(spark, s, files):
    rows = [(f, *e) for f, es in files.items() for e in es]
    return s.fold(spark.createDataFrame([(f,) for f in files], "file string"), spark.createDataFrame(rows, EDGES))


def scores(edges):
    found = {}
    for a, b, k in edges:
        if k != "Inheritance" and a != b:
            found[b] = found.get(b, 0) + 1
    return found


def components(edges):
    step = {}
    for a, b, _ in edges:
        step.setdefault(a, set()).add(b)

    def reach(x):
        seen, todo = set(), list(step.get(x, ()))
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += step.get(n, ())
        return seen

    to = {n: reach(n) for n in step}
    classes = {n: sorted({n} | {m for m in to[n] if n in to.get(m, ())}) for n in step}
    return {(n, c[0], len(c)) for n, c in classes.items() if len(c) > 1}


def same(s, files, version=None):
    edges = {e for es in files.values() for e in es}
    assert {tuple(r) for r in s.edges(version).collect()} == edges
    assert {r.name: r.score for r in s.coupling(version).collect()} == scores(edges)
    assert {tuple(r) for r in s.components(version).collect()} == components(edges)


def test_commits_equal_full_rebuilds(spark):
    r, s = random.Random(7), store(spark)
    node = lambda: f"n{r.randrange(16):02d}"
    made = lambda: {(node(), node(), r.choice(["Field", "Inheritance"])) for _ in range(r.randint(0, 3))}
    files = {f"f{i}": made() for i in range(8)}
    versions = [dict(files)]
    put(spark, s, files)
    for _ in range(2):
        change = {f"f{r.randrange(10)}": made() for _ in range(2)}
        change[r.choice(sorted(files))] = set()
        files.update(change)
        put(spark, s, change)
        versions.append(dict(files))
    for i, v in enumerate(versions, 1):
        same(s, v, i)
    before, after = (scores({e for es in v.values() for e in es}) for v in (versions[0], versions[-1]))
    moved = {n: (before.get(n, 0), after.get(n, 0)) for n in before.keys() | after.keys() if before.get(n) != after.get(n)}
    assert {x.name: (x.before, x.after) for x in s.coupling_changes(1, len(versions)).collect()} == moved


def test_cycle_closed_across_files_and_opened_again(spark):
    s = store(spark)
    files = {"a": {("x", "y", "Field")}, "b": {("y", "z", "Field")}, "c": {("p", "q", "Field"), ("q", "p", "Field")}}
    put(spark, s, files)
    files["d"] = {("z", "x", "Field")}
    assert put(spark, s, {"d": files["d"]}) == 2
    same(s, files)
    assert {(r.name, r.change) for r in s.cycle_changes(1, 2).collect()} == {(n, "added") for n in "xyz"}
    # The same edge in a second file: taking one away changes nothing.
    files["e"] = {("z", "x", "Field")}
    put(spark, s, {"e": files["e"]})
    del files["d"]
    put(spark, s, {"d": set()})
    same(s, files)
    assert s.cycle_changes(2, 4).count() == 0 and s.coupling_changes(2, 4).count() == 0
    del files["e"]
    put(spark, s, {"e": set()})
    same(s, files)
    assert {(r.name, r.change) for r in s.cycle_changes(4, 5).collect()} == {(n, "removed") for n in "xyz"}


def test_buckets_of_unchanged_files_are_not_read(spark):
    s = store(spark, buckets=16)
    put(spark, s, {f"f{i}": {(f"a{i}", f"b{i}", "Field")} for i in range(40)})
    first = s.segments()[0]
    name = spark.createDataFrame([("f3",)], "file string")
    where = s._of(name)
    scanned = s._rows("files", [first], where)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scanned and "bucket" in scanned.split("PartitionFilters", 1)[1]
    # The folders of files in other buckets can go: the commit does not notice.
    place = s.path.removeprefix("file://")
    own = {r[0] for r in name.selectExpr("cast(pmod(xxhash64(file), 16L) as int)").collect()}
    for folder in Path(f"{place}/files/seg={first}").glob("bucket=*"):
        if int(folder.name[7:]) not in own:
            shutil.rmtree(folder)
    put(spark, s, {"f3": {("a3", "c", "Field")}})
    assert {(r.src, r.dst) for r in s.edges().collect()} == {(f"a{i}", f"b{i}") for i in range(40) if i != 3} | {("a3", "c")}


def test_a_store_without_members_solves_no_components(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("components are solved")

    monkeypatch.setattr(delta_graph, "strong_components", refused)
    s = Store(spark, f"{shared_folder(spark)}/test-graph-{uuid.uuid4().hex}", buckets=4, members=False)
    put(spark, s, {"a": {("x", "y", "Field"), ("y", "x", "Field")}})
    put(spark, s, {"b": {("z", "y", "Field")}})
    edges = {("x", "y", "Field"), ("y", "x", "Field"), ("z", "y", "Field")}
    again = Store(spark, s.path)
    assert {tuple(r) for r in again.edges().collect()} == edges
    assert {r.name: r.score for r in again.coupling().collect()} == scores(edges)
    assert {tuple(r) for r in again.coupling_changes(1, 2).collect()} == {("y", 1, 2, 1)}
    for asked in (again.components, lambda: again.cycle_changes(1, 2)):
        with pytest.raises(ValueError):
            asked()


def test_delta_coupling_solves_no_components(spark, sf, monkeypatch):
    def refused(*_):
        raise AssertionError("components are solved")

    monkeypatch.setattr(delta_graph, "strong_components", refused)
    monkeypatch.setattr(catalog, "_graphs", {})
    assert catalog.QUERIES["delta_coupling"](spark, sf).count() > 0


def test_shuffle_files_go_with_what_is_written(spark):
    assert spark.conf.get(CLEANUP) == "false"
    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    # What other tests have left goes when it goes; only new files count.
    before = set(local.rglob("shuffle_*.data"))
    made = cut(spark.range(1000).repartition(7))
    wait = time.time() + 20
    while set(local.rglob("shuffle_*.data")) - before and time.time() < wait:
        time.sleep(0.2)
    assert not set(local.rglob("shuffle_*.data")) - before and spark.conf.get(CLEANUP) == "false"
    assert made.count() == 1000


def test_empty_null_repeated_and_foreign_rows(spark):
    s = store(spark)
    assert put(spark, s, {}) == 1
    same(s, {})
    rows = [("a", "x", "y", "Field"), ("a", "x", "y", "Field"), ("a", None, "y", "Field"), ("other", "x", "z", "Field"), (None, "x", "z", "Field"), ("a", "x", "x", "Field")]
    s.fold(spark.createDataFrame([("a",), ("a",), (None,)], "file string"), spark.createDataFrame(rows, EDGES).selectExpr("*", "1 AS n"))
    same(s, {"a": {("x", "y", "Field"), ("x", "x", "Field")}})


def test_of_two_writers_one_wins(spark):
    s = store(spark)
    put(spark, s, {"a": {("x", "y", "Field")}})
    put(spark, s, {"b": {("x", "z", "Field")}})
    with pytest.raises(Conflict):
        s.fold(spark.createDataFrame([("c",)], "file string"), spark.createDataFrame([("c", "q", "z", "Field")], EDGES), base=1)
    same(s, {"a": {("x", "y", "Field")}, "b": {("x", "z", "Field")}})


def test_changed_files(spark):
    a = spark.createDataFrame([("same", "1"), ("gone", "1"), ("new text", "1"), ("unknown", None)], "file string, fingerprint string")
    b = spark.createDataFrame([("same", "1"), ("come", "1"), ("new text", "2"), ("unknown", None)], "file string, fingerprint string")
    assert {tuple(r) for r in changed_files(a, b).collect()} == {("gone", "deleted"), ("new text", "edited"), ("come", "added"), ("unknown", "edited")}
