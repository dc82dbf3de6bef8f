"""Compositions: reports about one type, a project's health, the difference of two snapshots, and reading sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cordage.operators import graph as G
from cordage.plans.iterate import cut


def describe(members: DataFrame, methods: DataFrame, edges: DataFrame, parents: DataFrame, name: str, depth: int = 3) -> DataFrame:
    """section, item: fields, methods, outgoing and incoming references and ancestors of a type."""
    cls = F.col("cls") == name
    starts = edges.sparkSession.createDataFrame([(name,)], "start string")
    up = G.ancestor_chain(parents, starts, depth).select(F.lit("ancestor").alias("section"), F.concat_ws(" ", F.col("depth").cast("string"), "ancestor").alias("item"))
    rows = [
        members.filter(cls).select(F.lit("field").alias("section"), F.concat_ws(": ", "name", "type").alias("item")),
        methods.filter(cls).select(F.lit("method").alias("section"), F.col("name").alias("item")),
        edges.filter(F.col("src") == name).select(F.lit("out").alias("section"), F.col("dst").alias("item")).distinct(),
        edges.filter(F.col("dst") == name).select(F.lit("in").alias("section"), F.col("src").alias("item")).distinct(),
    ]
    for r in rows:
        up = up.unionByName(r)
    return up


def health(nodes: DataFrame, edges: DataFrame, issues: DataFrame, max_len: int = 4, found: DataFrame | None = None) -> DataFrame:
    """metric, value: types, references, dead types, direct and other cycles, highest coupling, issues by severity. found: the cycles, where they are known already."""
    found = G.cycles(edges, max_len) if found is None else found
    one = lambda df, m: df.agg(F.count("*").alias("value")).select(F.lit(m).alias("metric"), "value")
    parts = [
        one(nodes, "types"), one(edges, "references"), one(G.dead_nodes(nodes, edges), "dead"), one(found.filter("length <= 2"), "direct_cycles"), one(found.filter("length > 2"), "other_cycles"),
        G.coupling(nodes, edges).agg(F.max("score").alias("value")).select(F.lit("highest_coupling").alias("metric"), "value"),
        # The rules' plan is long: it runs by itself, so that the driver doesn't hold it with the others.
        cut(issues.groupBy(F.concat(F.lit("issues_"), F.lower("severity")).alias("metric")).agg(F.count("*").alias("value"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def risk(edges: DataFrame, starts: DataFrame, issues: DataFrame, assets: DataFrame, depth: int = 3) -> DataFrame:
    """start, affected, deepest, issues, assets: how far a change reaches, and what is known about the type (issues, assets: name)."""
    reach = G.reach_counts(edges, starts, depth, reverse=True)
    count = lambda df, c: df.groupBy(F.col("name").alias("start")).agg(F.count("*").alias(c))
    rows = starts.select("start").distinct().join(reach, "start", "left").join(count(issues, "issues"), "start", "left").join(count(assets, "assets"), "start", "left")
    return rows.na.fill(0, ["affected", "deepest", "issues", "assets"])


def gate(new_cycles: DataFrame, allowed: int = 0) -> DataFrame:
    """new_cycles, passed: whether a snapshot brings more cycles than are allowed."""
    return new_cycles.agg(F.count("*").alias("new_cycles")).withColumn("passed", F.col("new_cycles") <= allowed)


def new_cycle_classes(new_cycles: DataFrame, scores: DataFrame, limit: int = 5) -> DataFrame:
    """name, score of the types on new cycles (path) that most depends on. The limit is the feature."""
    on = new_cycles.select(F.explode("path").alias("name")).distinct()
    return on.join(scores, "name").orderBy(F.desc("score"), "name").limit(limit)


def flow_counts(flow: DataFrame, known: DataFrame) -> DataFrame:
    """nodes, edges, leaves, unresolved of a call flow (src, dst); unresolved: nodes that are not known (name)."""
    nodes = flow.select(F.col("src").alias("name")).union(flow.select("dst")).distinct()
    leaves = nodes.join(flow.select(F.col("src").alias("name")), "name", "left_anti")
    strange = nodes.join(known.select("name"), "name", "left_anti")
    a = nodes.agg(F.count("*").alias("nodes")).join(flow.select("src", "dst").distinct().agg(F.count("*").alias("edges")))
    return a.join(leaves.agg(F.count("*").alias("leaves"))).join(strange.agg(F.count("*").alias("unresolved")))


def compact_flow(calls: DataFrame, most: int = 40) -> DataFrame:
    """src, dst among the first ``most`` calls by ord, each once. The limit comes first and is the feature."""
    return calls.orderBy("ord").limit(most).groupBy("src", "dst").agg(F.min("ord").alias("ord"))


def return_types(methods: DataFrame, known: DataFrame) -> DataFrame:
    """cls, name, return_type: the first known class (by ord) that a method returns."""
    rows = methods.join(known.select(F.col("name").alias("return_type")).distinct(), "return_type", "left_semi")
    return rows.groupBy("cls", "name").agg(F.min_by("return_type", "ord").alias("return_type"))


def accessor_hints(calls: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """accessor, property, uses: chains A.B.method() on names A that are no known types, used ``least`` times or more."""
    chain = F.regexp_extract_all("body_text", F.lit(r"\b([A-Z]\w*\.[A-Z]\w*)\.\w+\s*\("), F.lit(1))
    rows = calls.select(F.explode(chain).alias("c")).select(F.split("c", r"\.")[0].alias("accessor"), F.split("c", r"\.")[1].alias("property"))
    rows = rows.join(known.select(F.col("name").alias("accessor")).distinct(), "accessor", "left_anti")
    return rows.groupBy("accessor", "property").agg(F.count("*").alias("uses")).filter(F.col("uses") >= least)


def with_accessors(members: DataFrame, hints: dict[str, dict[str, str]]) -> DataFrame:
    """Members (cls, name, type) and what hints add, after indexing."""
    rows = [(c, p, t) for c, ps in hints.items() for p, t in ps.items()]
    return members.select("cls", "name", "type").unionByName(members.sparkSession.createDataFrame(rows, "cls string, name string, type string"))


def defined_elsewhere(methods: DataFrame, method: Column, limit: int = 10) -> DataFrame:
    """cls of other classes that have a method of this name. The limit is the feature."""
    return methods.filter(F.col("name") == method).select("cls").distinct().orderBy("cls").limit(limit)


def read_source(files: DataFrame, types: DataFrame, name: str, most: int) -> DataFrame:
    """part_index, total_parts, path, text of all files that declare a type; ``most`` characters in all: the limit is the feature."""
    parts = files.join(types.filter(F.col("name") == name).select(F.col("file_path").alias("path")).distinct(), "path")
    order = Window.orderBy("path")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = parts.withColumns({"part_index": F.row_number().over(order), "total_parts": F.count("*").over(Window.partitionBy()), "left": F.greatest(F.lit(most) - before, F.lit(0)).cast("int")})
    return rows.select("part_index", "total_parts", "path", F.left("text", F.col("left")).alias("text"))


def method_source(methods: DataFrame, cls: str, name: str) -> DataFrame:
    return methods.filter((F.col("cls") == cls) & (F.col("name") == name)).select("file_path", "body_text")


def context_page(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """line, pos: a Markdown page of a project's hubs and cycles. The limit is the feature."""
    ranked = G.ranked(G.coupling(nodes, edges), 1, top).select(F.concat(F.lit("- "), F.col("name").cast("string"), F.lit(": "), F.col("score").cast("string")).alias("line"), F.col("rank").alias("pos"))
    loops = G.direct_cycles(edges).select(F.concat(F.lit("- "), F.col("a").cast("string"), F.lit(" ↔ "), F.col("b").cast("string")).alias("line"), F.lit(10_000_000).cast("long").alias("pos"))
    heads = nodes.sparkSession.createDataFrame([("# Most depended on", 0), ("# Direct cycles", 9_999_999)], "line string, pos long")
    return heads.unionByName(ranked).unionByName(loops).orderBy("pos", "line")
