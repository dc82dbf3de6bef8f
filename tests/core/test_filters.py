"""Noise, access, line numbers, name pairs and components, against hand-made and brute-force answers."""

import random

import pytest
from pyspark.sql import functions as F

from cordage.operators import filters as X
from cordage.operators import graph as G
from cordage.operators import reports as R


def test_noise(spark):
    rows = [("Hero", "Fire"), ("Mathf", "Abs"), ("System.IO", "Read"), ("UnityEngine.UI", "Draw"), ("UnityEngine.CustomUI", "Draw"), (None, "Go"), ("Hero", "get_X"), ("Hero", "ToList"), ("Hero", "Invoke")]
    df = spark.createDataFrame(rows, "callee_cls string, callee_method string")
    assert {tuple(r) for r in X.without_noise(df).collect()} == {("Hero", "Fire"), ("UnityEngine.CustomUI", "Draw"), (None, "Go"), ("Hero", "Invoke")}


def test_namespaces_and_access(spark):
    nodes = spark.createDataFrame([("A", "Game.Core"), ("B", "game.ui"), ("C", None), ("D", "")], "name string, namespace string")
    assert {r.name for r in X.in_namespace(nodes, "GAME").collect()} == {"A", "B"}
    assert {tuple(r) for r in X.namespaces(nodes, nodes.limit(1)).collect()} == {("Game.Core", 2), ("game.ui", 1), ("(None)", 2)}
    members = spark.createDataFrame([("A", "public"), ("A", "protected"), ("A", None), ("A", "internal")], "cls string, access string")
    assert X.by_access(members).first()[:] == ("A", 1, 1, 2)


def test_lines_and_tiers(spark):
    text = "ab\n\ncd\r\ne"
    for offset in range(len(text)):
        assert spark.range(1).select(X.line_of(F.lit(text), F.lit(offset))).first()[0] == text[:offset].count("\n") + 1
    tiers = {v: spark.range(1).select(X.engine_tier(F.lit(v))).first()[0] for v in ("5.3.1", "5.8", "4.27", "6")}
    assert tiers == {"5.3.1": "validated", "5.8": "experimental", "4.27": "unsupported", "6": "unknown"}


def test_keep_first(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 5)], "k int, v string, ord int")
    assert {tuple(r) for r in X.keep_first(df, ["k"], ["ord"]).collect()} == {(1, "a", 1), (2, "c", 5)}


def test_name_pairs(spark):
    rng = random.Random(2)
    name = lambda: "".join(rng.choice("aAbBc") for _ in range(rng.randrange(7)))
    left, right = sorted({name() for _ in range(60)}), sorted({name() for _ in range(40)})
    df = lambda names, c: spark.createDataFrame([(n,) for n in names], f"{c} string")
    want = {(s, c) for s in left for c in right if s and c and (s.lower() in c.lower() or c.lower() in s.lower())}
    assert {tuple(r) for r in R.name_pairs(df(left, "stem"), df(right, "cls")).collect()} == want
    got = {r.stem: r.matched for r in R.name_matches(df(left, "stem"), df(right, "cls")).collect()}
    assert got == {s: min((c for t, c in want if t == s), default="") for s in left}


def reach(edges):
    nodes, out = {x for e in edges for x in e}, {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            a = todo.pop()
            for u, v in edges:
                if u == a and v not in seen:
                    seen.add(v)
                    todo.append(v)
        out[n] = seen
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(55)} | {(100, 101), (101, 102), (102, 103), (103, 104), (104, 105), (105, 100)})
    edges = [e for e in edges if e[0] != e[1]]
    to = reach(edges)
    groups = {n: {m for m in to[n] if n in to[m]} for n in to}
    want = {(n, min(g), len(g)) for n, g in groups.items() if g}
    df = spark.createDataFrame(edges, "src int, dst int")
    assert {tuple(r) for r in G.strong_components(df).collect()} == want and (100, 100, 6) in want
    assert G.strong_components(df.filter("src < 0")).count() == 0
