"""Hand-computed graphs."""

import random

import pytest
from pyspark.sql import functions as F

from cordage.operators import compose as C
from cordage.operators import graph as G
from cordage.operators import reports as R
from cordage.operators import search as S
from cordage.plans import bindings, catalog

FX1 = [("A", "B", "Field", "b1"), ("A", "B", "Field", "b2"), ("A", "B", "Parameter", "m(x)"), ("B", "C", "Property", "c"), ("C", "A", "Field", "a"), ("C", "D", "Inheritance", ""), ("D", "E", "Field", "e"), ("X", "A", "Field", "a"), ("A", "A", "Field", "self"), ("Foo_PROTO", "E", "Field", "p")]


def edges(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "src string, dst string, kind string, member string, ord long")


@pytest.fixture(scope="module")
def fx1(spark):
    nodes = spark.createDataFrame([(n,) for n in ("A", "B", "C", "D", "E", "X", "Foo_PROTO")], "name string")
    return G.remove_generated(nodes, edges(spark, FX1), F.col("name").endswith("_PROTO"))


def pairs(df):
    return {tuple(r) for r in df.collect()}


def start(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "start string")


def test_dedupe(fx1):
    rows = G.dedupe_edges(fx1[1]).collect()
    assert len(rows) == 7
    assert next(r.member for r in rows if (r.src, r.dst, r.kind) == ("A", "B", "Field")) == "b1"


def test_coupling(fx1):
    assert pairs(G.coupling(*fx1)) == {("A", 2), ("B", 2), ("C", 1), ("E", 1), ("D", 0), ("X", 0)}
    assert ("D", 1) in pairs(G.coupling(*fx1, exclude_kinds=()))
    assert [tuple(r) for r in G.ranked(G.coupling(*fx1)).orderBy("rank").collect()] == [(1, "A", 2), (2, "B", 2), (3, "C", 1), (4, "E", 1)]


def test_dead_cycles_isolated(fx1):
    nodes, e = fx1
    assert pairs(G.dead_nodes(nodes, e)) == {("X",)}
    assert [r.path for r in G.cycles(e, 4).collect()] == [["A", "B", "C"]]
    assert G.direct_cycles(e).count() == 0
    assert G.without_isolated(nodes, e).count() == 6
    assert pairs(G.cycle_members(G.cycles(e, 4))) == {("A", 1), ("B", 1), ("C", 1)}


def brute_cycles(edges, most):
    step, found = {}, {}
    for a, b in set(edges):
        if a != b:
            step.setdefault(a, set()).add(b)

    def onward(path):
        for n in step.get(path[-1], ()):
            if n == path[0] and len(path) > 1:
                found[frozenset(path)] = min(found.get(frozenset(path), path), path)
            elif n > path[0] and n not in path and len(path) < most:
                onward([*path, n])

    for a in step:
        onward([a])
    return sorted(found.values())


@pytest.mark.parametrize(("most", "turn_rows"), [(2, 10), (3, 10), (4, 8_000_000), (4, 10), (5, 10)])
def test_cycles_from_halves_in_turns(spark, monkeypatch, most, turn_rows):
    monkeypatch.setattr(G, "TURN_EDGES", 0)
    monkeypatch.setattr(G, "TURN_ROWS", turn_rows)
    r = random.Random(most)
    rows = [(r.randrange(12), r.randrange(12)) for _ in range(40)]
    e = spark.createDataFrame(rows, "src long, dst long")
    turns = G._cycle_turns(*(e.filter("src != dst").distinct().toDF(*names).select("at", "next") for names in (("at", "next"), ("next", "at"))))
    assert (turns > 1) == (turn_rows == 10)
    found = G.cycles(e, most)
    assert sorted(x.path for x in found.collect()) == brute_cycles(rows, most)
    assert all(x.length == len(x.path) for x in found.collect())


def test_cycles_put_no_three_step_paths_together(spark):
    # Through four layers of 20 nodes lead 160,000 paths of three steps and 16,000 of two; none comes back in four.
    layer = lambda a, b: [(a * 100 + i, b * 100 + j) for i in range(20) for j in range(20)]
    rows = [(0, 100 + i) for i in range(20)] + layer(1, 2) + layer(2, 3) + layer(3, 4) + [(400 + i, 500) for i in range(20)] + [(500, 0)]
    e = spark.createDataFrame(rows, "src long, dst long")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    assert G.cycles(e, 4).count() == 0
    made = []
    for x in range(before, store.executionsCount()):
        run = store.executionsList().apply(x)
        values = store.executionMetrics(run.executionId())
        nodes = store.planGraph(run.executionId()).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(i) for i in range(metrics.size())):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    made.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    assert made and max(made) < 100_000


def test_health_report_looks_for_cycles_once(spark, sf, monkeypatch):
    real, asked = G.cycles, []
    monkeypatch.setattr(G, "cycles", lambda *a: asked.append(a) or real(*a))
    rows = {r.metric: r.value for r in catalog.QUERIES["health_report"](spark, sf).collect()}
    assert len(asked) == 1
    cycles = [r.length for r in real(bindings.type_edges(spark, sf), 4).collect()]
    assert (rows["direct_cycles"], rows["other_cycles"]) == (sum(n <= 2 for n in cycles), sum(n > 2 for n in cycles))


@pytest.mark.parametrize("name", ["lint_sections", "watch_lint_summary"])
def test_lint_is_the_same_with_cycles_in_many_turns(spark, sf, monkeypatch, name):
    # The smallest tables hardly have cycles.
    sf = sf.replace("sf0.001", "sf0.01")
    whole = pairs(catalog.QUERIES[name](spark, sf))
    assert name != "lint_sections" or "GEN-ARCH-001" in {r[0] for r in whole}
    asked = []
    monkeypatch.setattr(G, "_cycle_turns", lambda *_: asked.append(1) or 3)
    assert pairs(catalog.QUERIES[name](spark, sf)) == whole
    assert asked


def test_impact(fx1, spark):
    _, e = fx1
    assert pairs(G.levels(e, start(spark, "A"), 3, reverse=True).select("name", "depth")) == {("C", 1), ("X", 1), ("B", 2)}
    assert pairs(G.levels(e, start(spark, "A"), 9, reverse=True).select("name", "depth")) == {("C", 1), ("X", 1), ("B", 2)}
    found = {("<".join(r.path), r.recursive) for r in G.impact_paths(e, start(spark, "A"), 3).collect()}
    assert found == {("A<C", False), ("A<X", False), ("A<C<B", False), ("A<C<B<A", True)}


@pytest.mark.parametrize(("depth", "reverse"), [(1, True), (2, False), (3, True), (4, False)])
def test_reach_counts_in_turns_equal_levels(spark, monkeypatch, depth, reverse):
    r = random.Random(depth)
    rows = [(r.randrange(50), r.randrange(50)) for _ in range(80)] + [(70, 71), (71, 70), (72, 72)]
    e = spark.createDataFrame(rows, "src long, dst long")
    some = spark.createDataFrame([(i,) for i in range(0, 90, 2)] + [(70,), (70,)], "start long")
    levels = G.levels(e, some.distinct(), depth, reverse=reverse).groupBy("start").agg(F.count("*"), F.max("depth"))
    expected = pairs(levels)
    assert pairs(G.reach_counts(e, some, depth, reverse)) == expected
    monkeypatch.setattr(G, "levels", None)
    monkeypatch.setattr(G, "TURN_IDS", 0)
    monkeypatch.setattr(G, "TURN_ROWS", 20)
    assert G._reach_turns(e.filter("src != dst").distinct().toDF("name", "next"), some, depth) > 1
    counted = G.reach_counts(e, some, depth, reverse)
    assert pairs(counted) == expected and counted.count() == len(expected)


def test_risk_of_many_starts_makes_no_pairs(spark, monkeypatch):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("X", "A"), ("D", "E")], "src string, dst string")
    nothing = spark.createDataFrame([], "name string")
    monkeypatch.setattr(G, "levels", None)
    monkeypatch.setattr(G, "TURN_IDS", 0, raising=False)
    monkeypatch.setattr(G, "TURN_ROWS", 2, raising=False)
    found = C.risk(e, start(spark, "A", "C", "E", "X", "Z"), spark.createDataFrame([("E",)], "name string"), nothing)
    assert pairs(found) == {("A", 3, 2, 0, 0), ("C", 3, 3, 0, 0), ("E", 1, 1, 1, 0), ("X", 0, 0, 0, 0), ("Z", 0, 0, 0, 0)}


def test_paths(fx1, spark):
    _, e = fx1
    assert G.shortest_paths(e, start(spark, "X"), F.col("name") == "E", 10).first().path == ["X", "A", "B", "C", "D", "E"]
    assert G.shortest_paths(e, start(spark, "E"), F.col("name") == "A", 10).count() == 0
    same = G.shortest_paths(e, start(spark, "A"), F.col("name") == "A", 3).first()
    assert (same.path, same.length) == (["A"], 0)


def test_hierarchy(spark):
    bases = spark.createDataFrame([("A", "Base"), ("A", "IFoo"), ("B", "A"), ("C", "A"), ("Base", "Ext")], "name string, base string")
    primary = bases.filter("base != 'IFoo'").withColumnRenamed("base", "parent")
    assert [r.ancestor for r in G.ancestor_chain(primary, start(spark, "B"), 20).orderBy("depth").collect()] == ["A", "Base", "Ext"]
    assert pairs(G.descendants(bases, start(spark, "Base"), 5).select("name", "depth")) == {("A", 1), ("B", 2), ("C", 2)}
    assert pairs(G.descendants(bases, start(spark, "A"), 5).select("name")) == {("B",), ("C",)}
    loop = spark.createDataFrame([("P", "Q"), ("Q", "P")], "name string, parent string")
    assert [r.ancestor for r in G.ancestor_chain(loop, start(spark, "P"), 20).orderBy("depth").collect()] == ["Q", "P"]
    roots = spark.createDataFrame([("Ext", "ability")], "name string, kind string")
    assert G.kind_by_ancestor(primary, start(spark, "B"), roots).first()[:] == ("B", "ability", 3)


def test_snapshots(fx1, spark):
    nodes, e = fx1
    after_n = nodes.unionByName(spark.createDataFrame([("N",)], "name string"))
    after_e = e.filter("NOT (src = 'C' AND dst = 'A')").unionByName(edges(spark, [("N", "A", "Field", ""), ("E", "D", "Field", "")]))
    assert pairs(G.snapshot_nodes(nodes, after_n)) == {("N", "added")}
    key = lambda x: G.cycles(x, 4).select(G.cycle_key(F.col("path")).alias("name"))
    assert pairs(G.snapshot_nodes(key(e), key(after_e))) == {("D → E", "added"), ("A → B → C", "removed")}
    assert [tuple(r) for r in G.coupling_movers(G.coupling(nodes, e), G.coupling(after_n, after_e)).collect()] == [("D", 0, 1, 1)]


def test_related(spark):
    e = spark.createDataFrame([("S", "T", "inherits"), ("S", "T", "depends_on"), ("T", "U", "uses_asset")], "src string, dst string, relation string")
    assert pairs(G.related(e, start(spark, "S"), 2).select("name", "relation", "depth")) == {("T", "depends_on", 1), ("U", "uses_asset", 2)}
    assert pairs(G.related(e, start(spark, "S"), 1).select("name")) == {("T",)}
    old = e.select(F.col("src").alias("source"), F.col("dst").alias("target"))
    assert S.replace_edges(old, old.limit(0)).count() == 3


def test_ambiguous_calls(spark):
    methods = spark.createDataFrame([("Foo", "run"), ("Bar", "run"), ("Baz", "only")], "cls string, name string")
    calls = spark.createDataFrame([("Foo", "only"), ("Foo", "run")], "caller_cls string, callee_method string")
    assert pairs(G.resolve_calls(calls, methods).select("callee_method", "callee_cls")) == {("only", "Baz"), ("run", "Foo")}


def test_unused(spark):
    assets = spark.createDataFrame([("g1", "a.prefab"), ("g2", "b.mat"), ("g3", "Resources/c.png"), ("g4", "d.wav")], "guid string, path string")
    refs = [spark.createDataFrame([(g,)], "guid string") for g in ("g1", "g2")]
    assert pairs(R.unused(assets, refs, "guid", F.col("path").startswith("Resources/")).select("path")) == {("d.wav",)}


def test_lookup(spark):
    names = spark.createDataFrame([("UHealth",), ("AHero",), ("Plain",)], "name string")
    wanted = spark.createDataFrame([("Health",), ("UPlain",), ("hero",), ("None",)], "wanted string")
    assert pairs(R.lookup(names, wanted)) == {("Health", "UHealth"), ("UPlain", "Plain"), ("hero", "AHero")}
    assert R.exact_or_unique(names, "heal").first().name == "UHealth" and R.exact_or_unique(names, "h").count() == 0


def test_fragments_merge(spark):
    rows = [("P", "a.cs", "N1", ["Q"], ["x"]), ("P", "b.cs", "N2", ["Q", "R"], ["y"]), ("Z", "c.cs", "", None, None)]
    got = {r.name: (r.namespace, r.base_types, r.members, r.fragments) for r in G.merge_fragments(spark.createDataFrame(rows, "name string, file_path string, namespace string, base_types array<string>, members array<string>")).collect()}
    assert got == {"P": ("N1", ["Q", "R"], ["x", "y"], 2), "Z": ("", [], [], 1)}


def test_super_calls(spark):
    """The nearest definition above the caller: its own does not count, a far one is found, an unknown method has none, a ring of bases ends."""
    parents = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D"), ("X", "Y"), ("Y", "X")], "name string, parent string")
    methods = spark.createDataFrame([("A", "f"), ("B", "g"), ("C", "f"), ("D", "f"), ("D", "g"), ("D", "h"), ("X", "k")], "cls string, name string")
    calls = spark.createDataFrame([("A", "f"), ("A", "f"), ("A", "g"), ("B", "g"), ("B", "h"), ("D", "f"), ("A", "no"), ("Y", "k"), ("X", "f")], "caller_cls string, callee_method string")
    got = sorted(tuple(r) for r in G.super_calls(calls, methods, parents).na.fill("-", ["callee_cls"]).na.fill(0, ["steps"]).collect())
    assert got == [("A", "f", "C", 2), ("A", "f", "C", 2), ("A", "g", "B", 1), ("A", "no", "-", 0), ("B", "g", "D", 2), ("B", "h", "D", 2), ("D", "f", "-", 0), ("X", "f", "-", 0), ("Y", "k", "X", 1)]
    assert G.super_calls(calls.limit(0), methods, parents).count() == 0
