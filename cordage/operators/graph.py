"""Operators over type_node (name, namespace, file_path, base_types) and type_edge (src, dst, kind, member, ord).

Every operator takes and returns DataFrames. Traversals move a frontier by joins on node keys: a round joins only what
the round before reached, and visited nodes leave by an anti join, so that work follows edges, not paths. Up to LAZY_ROUNDS rounds are one
plan; longer ones are cut by checkpoints. Only operators that return paths grow with the number of paths, and say so.
"""

from __future__ import annotations

from functools import reduce
from itertools import count
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cordage.plans.iterate import cut, numbered, placed
from cordage.plans.versions import delete

LAZY_ROUNDS = 4
#: Rows that one turn of a search puts together at once: so many times the edges, and so many at least.
TURN_EDGES, TURN_ROWS = 2, 8_000_000
#: Nodes reached, as numbers in arrays, that one turn puts together: so many times the edges, and at most so many of one start.
TURN_IDS, START_IDS = 8, 4_000_000


def dedupe_edges(edges: DataFrame, keys=("src", "dst", "kind"), drop_self: bool = True) -> DataFrame:
    """One edge per key, the first by ``ord``; edges from a node to itself go."""
    rows = edges.filter("src != dst") if drop_self else edges
    return rows.groupBy(*keys).agg(F.min_by("member", "ord").alias("member"), F.min("ord").alias("ord"))


def remove_generated(nodes: DataFrame, edges: DataFrame, generated: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes for which ``generated`` holds go, with all their edges."""
    gone = nodes.filter(generated).select("name")
    kept = nodes.join(gone, "name", "left_anti")
    left = edges.join(gone.withColumnRenamed("name", "src"), "src", "left_anti").join(gone.withColumnRenamed("name", "dst"), "dst", "left_anti")
    return kept, left


def coupling(nodes: DataFrame, edges: DataFrame, exclude_kinds=("Inheritance",), dedupe=("src", "dst", "kind"), drop_self: bool = True) -> DataFrame:
    """name, score: incoming edges of every node, 0 included; edges to unknown nodes don't count."""
    rows = edges.filter(~F.col("kind").isin(*exclude_kinds)) if exclude_kinds else edges
    rows = rows.filter("src != dst") if drop_self else rows
    rows = rows.select(*dedupe).distinct() if dedupe else rows
    scores = rows.groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("score"))
    return nodes.select("name").distinct().join(scores, "name", "left").select("name", F.coalesce("score", F.lit(0)).cast("long").alias("score"))


def ranked(scores: DataFrame, min_score: int = 1, limit: int | None = None) -> DataFrame:
    """rank, name, score from the highest score on, ties by name. 0 or None: no limit."""
    rows = scores.filter(F.col("score") >= min_score)
    order = [F.desc("score"), F.col("name")]
    if not limit:
        return numbered(rows.select("name", "score"), order, "rank").select("rank", "name", "score")
    # The limit is the feature, and bounds the rows that are numbered together.
    return rows.orderBy(*order).limit(limit).select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), "name", "score")


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of every group."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("nth", nth.cast("long")).filter(F.col("nth") <= k)


def dead_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an incoming edge of any kind; sources outside count, edges to itself don't."""
    return nodes.join(edges.filter("src != dst").select(F.col("dst").alias("name")), "name", "left_anti")


def kind_degrees(edges: DataFrame) -> DataFrame:
    """kind, edges, sources, targets."""
    return edges.groupBy("kind").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


def referrers(edges: DataFrame) -> DataFrame:
    """name, referrer: who refers to a node, each once."""
    return edges.filter("src != dst").select(F.col("dst").alias("name"), F.col("src").alias("referrer")).distinct()


def direct_cycles(edges: DataFrame) -> DataFrame:
    """a, b (a < b): nodes that refer to each other."""
    e = edges.select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(back, ["src", "dst"], "left_semi").filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def trimmed(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Edges between nodes that have both incoming and outgoing ones, so tried ``rounds`` times: all that can be on a cycle stay."""
    e, path = placed(edges.filter("src != dst").select("src", "dst").distinct())
    for _ in range(rounds):
        # A round reads its edges four times: they are made once, and those of the round before go.
        both = e.select(F.col("src").alias("name")).intersect(e.select("dst"))
        before = path
        e, path = placed(e.join(both.withColumnRenamed("name", "dst"), "dst", "left_semi").join(both.withColumnRenamed("name", "src"), "src", "left_semi").select("src", "dst"))
        delete(e.sparkSession, before)
    return e


def _halves(first: DataFrame, step: DataFrame, name: str, steps: int) -> list[DataFrame]:
    """Of 1 to ``steps`` steps from each start over greater nodes: start and the nodes of the path in columns name1, name2 and on. first: start, name1; step: at, next."""
    paths = [first]
    for k in range(2, steps + 1):
        last, new = paths[-1], F.col("next") > F.col("start")
        for i in range(1, k - 1):
            new = new & (F.col("next") != F.col(f"{name}{i}"))
        onward = last.join(step, F.col(f"{name}{k - 1}") == F.col("at")).filter(new)
        paths.append(onward.select(*last.columns, F.col("next").alias(f"{name}{k}")))
    return paths


def _closed(ahead: DataFrame, behind: list[DataFrame], k: int, kind) -> DataFrame:
    """path: cycles of an ahead half of ``k`` steps (f1 and on) and halves of k - 1 or k steps back (b1 and on) that meet at its last node."""
    inner = [f"t{i}" for i in range(1, k)]
    backs = []
    for b in behind:
        m = len(b.columns) - 1
        way = [F.col(f"b{i}") for i in range(m - 1, 0, -1)] + [F.lit(None).cast(kind)] * (k - m)
        backs.append(b.select("start", F.col(f"b{m}").alias(f"f{k}"), *[c.alias(t) for c, t in zip(way, inner, strict=True)]))
    rows = ahead.join(reduce(DataFrame.unionAll, backs), ["start", f"f{k}"])
    for t in inner:
        rows = rows.filter(F.col(t).isNull() | ~F.col(t).isin(*[F.col(f"f{i}") for i in range(1, k)]))
    return rows.select(F.array_compact(F.array("start", *[f"f{i}" for i in range(1, k + 1)], *inner)).alias("path"))


def cycles(edges: DataFrame, max_len: int = 4) -> DataFrame:
    """path (from the least node on), length: all simple cycles of 2 to ``max_len`` nodes, of those with the same nodes the least path.

    A cycle is put together from two halves, one on from its least node and one back from it, which meet: the work grows with the number of
    simple paths of half that length over greater nodes. Least nodes are dealt to turns, so that what a turn shuffles stays near the edges' own size.
    """
    e = trimmed(edges)
    on = e.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    back = e.select(F.col("dst").alias("at"), F.col("src").alias("next"))
    kind = dict(e.dtypes)["src"]
    turns = _cycle_turns(on, back) if max_len > 2 else 1
    found = []
    for turn in range(turns):
        mine = F.col("at") < F.col("next")
        mine = mine & (F.pmod(F.xxhash64("at"), F.lit(turns)) == turn) if turns > 1 else mine
        # A third of the paths start at their least node, either way.
        ahead = _halves(on.filter(mine).select(F.col("at").alias("start"), F.col("next").alias("f1")), on, "f", (max_len + 1) // 2)
        behind = _halves(back.filter(mine).select(F.col("at").alias("start"), F.col("next").alias("b1")), back, "b", max_len // 2)
        every = [_closed(a, [behind[m - 1] for m in (k - 1, k) if 1 <= m and 2 <= k + m <= max_len], k, kind) for k, a in enumerate(ahead, 1)]
        # Cycles of the same nodes have the same least node, and so the same turn.
        best = reduce(DataFrame.unionAll, every).groupBy(F.array_sort("path").alias("nodes")).agg(F.min("path").alias("path"))
        found.append(cut(best.select("path", F.size("path").cast("long").alias("length"))))
    return reduce(DataFrame.unionAll, found)


def _cycle_turns(on: DataFrame, back: DataFrame) -> int:
    """Turns by the number of two-step paths: about two thirds of it are halves of cycles."""
    n = on.groupBy("at").agg(F.count("*").alias("n")).join(back.groupBy("at").agg(F.count("*").alias("m")), "at")
    found = n.agg(F.sum("n").alias("edges"), F.sum(F.col("n") * F.col("m")).alias("paths")).first()
    return max(1, ceil(2 * (found.paths or 0) / 3 / max(TURN_EDGES * (found.edges or 0), TURN_ROWS)))


def strong_components(edges: DataFrame) -> DataFrame:
    """name, component (its least node), size, of every node that is on a cycle of any length.

    Each node takes the least node that reaches it; those that reach that node back are its component. They leave, and so on with the rest.
    Rounds grow with the length of shortest paths, not with cycles; the driver sees whether rows are left.
    """
    left, found = trimmed(edges), None
    while not left.isEmpty():
        nodes = left.select(F.col("src").alias("name")).union(left.select("dst")).distinct()
        color = cut(nodes.withColumn("color", F.col("name")))
        while True:
            came = left.join(color.select(F.col("name").alias("src"), "color"), "src").groupBy(F.col("dst").alias("name")).agg(F.min("color").alias("least"))
            after = cut(color.join(cut(came), "name", "left").select("name", F.least("color", "least").alias("color"), F.coalesce(F.col("least") < F.col("color"), F.lit(False)).alias("moved")))
            color, moved = after.select("name", "color"), after.filter("moved")
            if moved.isEmpty():
                break
        inside = left.join(color.select(F.col("name").alias("src"), "color"), "src").join(color.select(F.col("name").alias("dst"), F.col("color").alias("other")), "dst").filter("color = other")
        roots = color.filter("name = color").select(F.col("name").alias("start"))
        back = levels(inside.select("src", "dst"), roots, None, reverse=True).select("name", F.col("start").alias("component"))
        members = cut(back.unionByName(roots.select(F.col("start").alias("name"), F.col("start").alias("component"))))
        found = members if found is None else found.unionByName(members)
        gone = members.select("name")
        left = trimmed(left.join(gone.withColumnRenamed("name", "src"), "src", "left_anti").join(gone.withColumnRenamed("name", "dst"), "dst", "left_anti"))
    if found is None:
        return left.select(F.col("src").alias("name"), F.col("dst").alias("component"), F.lit(0).cast("long").alias("size"))
    sizes = cut(found.groupBy("component").agg(F.count("*").alias("size")).filter("size > 1"))
    return found.join(sizes, "component").select("name", "component", "size")


def cycle_key(path: Column) -> Column:
    """The cycle's distinct nodes, sorted, joined by arrows."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(path)), lambda x: x.cast("string")), " → ")


def cycle_members(found: DataFrame) -> DataFrame:
    """name, cycles: how many cycles a node is on."""
    return found.select(F.explode("path").alias("name")).groupBy("name").agg(F.count("*").alias("cycles"))


def induced(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges between the given nodes (column name)."""
    n = names.select("name").distinct()
    return edges.join(n.withColumnRenamed("name", "src"), "src", "left_semi").join(n.withColumnRenamed("name", "dst"), "dst", "left_semi").select(*edges.columns)


def without_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that some edge touches."""
    ends = edges.select(F.col("src").alias("name")).union(edges.select(F.col("dst").alias("name"))).distinct()
    return nodes.join(ends, "name", "left_semi")


def levels(edges: DataFrame, starts: DataFrame, depth: int | None, reverse: bool = False) -> DataFrame:
    """start, name, depth: what is reached from each start (column start) in 1 to ``depth`` steps (None: any number), at the fewest; the start itself is left out."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    # Every round joins the edges: they are made once.
    step = cut(edges.filter("src != dst").select(F.col(a).alias("name"), F.col(b).alias("next")).distinct())
    seen = starts.select("start", F.col("start").alias("name"), F.lit(0).alias("depth")).distinct()
    frontier, lazy = seen, depth is not None and depth <= LAZY_ROUNDS
    for d in count(1) if depth is None else range(1, depth + 1):
        reached = frontier.join(step, "name").select("start", F.col("next").alias("name")).distinct()
        frontier = reached.join(seen.select("start", "name"), ["start", "name"], "left_anti").withColumn("depth", F.lit(d))
        if not lazy:
            frontier = cut(frontier)
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0").select("start", "name", F.col("depth").cast("long").alias("depth"))


def reach_counts(edges: DataFrame, starts: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """start, affected, deepest: of each start that reaches any, how many nodes ``levels`` finds in 1 to ``depth`` steps, and the most steps that one of them takes.

    Many starts reach many times as many nodes as there are edges. Then their pairs are not made at once: the nodes reached are dealt to turns,
    so that what a turn shuffles stays near the edges' own size, and each start's counts are summed over the turns.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step, path = placed(edges.filter("src != dst").select(F.col(a).alias("name"), F.col(b).alias("next")).distinct())
    asked = starts.select("start").distinct()
    turns = _reach_turns(step, asked, depth)
    if turns > 1:
        found = _counted_in_turns(step, depth, turns).join(asked, "start", "left_semi")
    else:
        reached = levels(step.select(F.col("name").alias("src"), F.col("next").alias("dst")), asked, depth)
        found = reached.groupBy("start").agg(F.count("*").alias("affected"), F.max("depth").alias("deepest"))
    delete(step.sparkSession, path)
    return found


def _reach_turns(step: DataFrame, starts: DataFrame, depth: int) -> int:
    """Turns by the number of walks: bounds of the pairs in all, and of those of one start, which are put together in one place."""
    back = step.select(F.col("next").alias("at"), F.col("name").alias("head"))
    walks = step.groupBy("name").agg(F.count("*").cast("double").alias("walks"))
    out = walks
    for _ in range(depth - 1):
        onward = back.join(out, back.at == out.name).groupBy(F.col("head").alias("name")).agg(F.sum("walks").alias("more"))
        out = walks.join(onward, "name", "left").select("name", (F.col("walks") + F.coalesce("more", F.lit(0.0))).alias("walks"))
    each = out.join(starts.select(F.col("start").alias("name")), "name", "left_semi")
    found = each.agg(F.sum("walks").alias("pairs"), F.max("walks").alias("most")).join(step.agg(F.count("*").alias("edges"))).first()
    return max(1, ceil((found.pairs or 0) / max(TURN_IDS * found.edges, TURN_ROWS)), ceil((found.most or 0) / START_IDS))


def _counted_in_turns(step: DataFrame, depth: int, turns: int) -> DataFrame:
    """start, affected, deepest of every node. A turn takes the nodes of its share as arrays from their own neighbours on from node to node, one step at a time."""
    spark, sizes = step.sparkSession, [f"n{k}" for k in range(1, depth + 1)]
    zeros = [F.lit(0).cast("long").alias(n) for n in sizes]
    # Where a node's array goes next: to all that lead to it.
    heads, heads_path = placed(step.groupBy(F.col("next").alias("name")).agg(F.collect_list("name").alias("heads")))
    total, total_path = None, None
    for turn in range(turns):
        mine = step.filter(F.pmod(F.xxhash64("next"), F.lit(turns)) == turn)
        near = mine.groupBy("name").agg(F.collect_list("next").alias("ids"))
        near = near.select("name", "ids", F.size("ids").cast("long").alias("n1"), *zeros[1:])
        near, near_path = placed(near)
        for k in range(2, depth + 1):
            sent = near.select("name", "ids").join(heads, "name").select(F.explode("heads").alias("name"), "ids", *zeros)
            rows = near.unionByName(sent)
            if k == depth and total is not None:
                rows = rows.unionByName(total.select("name", F.array().cast(dict(near.dtypes)["ids"]).alias("ids"), *sizes))
            met = rows.groupBy("name").agg(F.collect_list("ids").alias("ids"), *[F.sum(n).alias(n) for n in sizes])
            ids = F.array_remove(F.array_distinct(F.flatten("ids")), F.col("name"))
            met = met.select("name", ids.alias("ids"), *sizes)
            own = F.size("ids").cast("long")
            met = met.select("name", "ids", *[(F.col(n) + own).alias(n) if n == f"n{k}" else F.col(n) for n in sizes])
            before = near_path
            near, near_path = placed(met.select("name", *sizes) if k == depth else met)
            delete(spark, before)
        if depth == 1:
            both = near.select("name", *sizes) if total is None else near.select("name", *sizes).unionByName(total)
            before = near_path
            near, near_path = placed(both.groupBy("name").agg(*[F.sum(n).alias(n) for n in sizes]))
            delete(spark, before)
        if total_path:
            delete(spark, total_path)
        total, total_path = near, near_path
    delete(spark, heads_path)
    deepest = F.lit(1)
    for k in range(2, depth + 1):
        deepest = F.when(F.col(f"n{k}") > F.col(f"n{k - 1}"), k).otherwise(deepest)
    return total.filter(F.col(sizes[-1]) > 0).select(F.col("name").alias("start"), F.col(sizes[-1]).alias("affected"), deepest.cast("long").alias("deepest"))


def impact_paths(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """path, depth, recursive: every reverse path of up to ``depth`` steps. One that comes back to a node of its own is marked and goes no further.

    Grows with the number of paths.
    """
    step = edges.filter("src != dst").select(F.col("dst").alias("at"), F.col("src").alias("next")).distinct()
    live = starts.select(F.col("start").alias("at"), F.array("start").alias("path"))
    found = []
    for d in range(1, depth + 1):
        onward = live.join(step, "at").select("next", F.concat("path", F.array("next")).alias("path"), F.array_contains("path", F.col("next")).alias("recursive"))
        found.append(onward.select("path", F.lit(d).cast("long").alias("depth"), "recursive"))
        live = onward.filter("NOT recursive").select(F.col("next").alias("at"), "path")
    return reduce(DataFrame.unionAll, found)


def shortest_paths(edges: DataFrame, starts: DataFrame, target: Column, depth: int = 10) -> DataFrame:
    """start, path, length of the shortest path to a node for which ``target`` (over column name) holds; of several the least path."""
    step = cut(edges.select(F.col("src").alias("name"), F.col("dst").alias("next")).distinct())
    frontier = starts.select("start", F.col("start").alias("name"), F.array("start").alias("path")).distinct()
    seen, hits = frontier.select("start", "name"), [frontier.filter(target)]
    for _ in range(depth):
        frontier = frontier.filter(~target)
        onward = frontier.join(step, "name").select("start", F.col("next").alias("name"), F.concat("path", F.array("next")).alias("path"))
        onward = onward.groupBy("start", "name").agg(F.min("path").alias("path")).join(seen, ["start", "name"], "left_anti")
        frontier = cut(onward) if depth > LAZY_ROUNDS else onward
        if depth > LAZY_ROUNDS and frontier.isEmpty():
            break
        hits.append(frontier.filter(target))
        seen = seen.unionByName(frontier.select("start", "name"))
    best = reduce(DataFrame.unionAll, hits).groupBy("start").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("m"))
    return best.select("start", F.col("m.path").alias("path"), (F.col("m.n") - 1).cast("long").alias("length"))


def ancestor_chain(parents: DataFrame, starts: DataFrame, depth: int = 20) -> DataFrame:
    """start, depth, ancestor up the primary base (parents: name, parent; one row per name), until a name repeats or has no parent."""
    live = starts.select("start", F.col("start").alias("name"), F.array("start").alias("path"))
    found = []
    for d in range(1, depth + 1):
        live = live.join(parents, "name").filter(F.col("parent").isNotNull()).select("start", F.col("parent").alias("name"), F.concat("path", F.array("parent")).alias("path"), F.array_contains("path", F.col("parent")).alias("again"))
        if depth > LAZY_ROUNDS:
            live = cut(live)
            if live.isEmpty():
                break
        found.append(live.select("start", F.lit(d).cast("long").alias("depth"), F.col("name").alias("ancestor")))
        live = live.filter("NOT again").drop("again")
    if not found:
        return live.select("start", F.lit(0).cast("long").alias("depth"), F.col("name").alias("ancestor")).limit(0)
    return reduce(DataFrame.unionAll, found)


def descendants(bases: DataFrame, starts: DataFrame, depth: int | None) -> DataFrame:
    """start, name, depth: subtypes by any base (bases: name, base), each at its least depth."""
    return levels(bases.select(F.col("base").alias("src"), F.col("name").alias("dst")), starts, depth)


def kind_by_ancestor(parents: DataFrame, starts: DataFrame, roots: DataFrame, depth: int = 20) -> DataFrame:
    """start, kind of the nearest ancestor (or itself) that roots (name, kind) names."""
    up = ancestor_chain(parents, starts, depth).unionByName(starts.select("start", F.lit(0).cast("long").alias("depth"), F.col("start").alias("ancestor")))
    known = up.join(roots, up.ancestor == roots.name)
    return known.groupBy("start").agg(F.min(F.struct("depth", "kind")).alias("m")).select("start", F.col("m.kind").alias("kind"), F.col("m.depth").alias("depth"))


def call_flow(calls: DataFrame, starts: DataFrame, depth: int, focus: Column | None = None) -> DataFrame:
    """src, dst, depth: calls reached from the starts while ``depth`` lasts; a callee outside ``focus`` (over column name) is a leaf."""
    reached = levels(calls, starts, depth - 1) if depth > 1 else starts.select("start", F.col("start").alias("name"), F.lit(0).cast("long").alias("depth")).limit(0)
    if focus is not None:
        step = calls.withColumn("name", F.col("src")).filter(focus).drop("name")
        step = step.unionByName(calls.join(starts.select(F.col("start").alias("src")).distinct(), "src", "left_semi").select(*calls.columns)).distinct()
        reached = levels(step, starts, depth - 1) if depth > 1 else reached
        calls = step
    at = reached.unionByName(starts.select("start", F.col("start").alias("name"), F.lit(0).cast("long").alias("depth")))
    least = at.groupBy("name").agg(F.min("depth").alias("depth"))
    return calls.select(F.col("src").alias("name"), "dst").distinct().join(least, "name").select(F.col("name").alias("src"), "dst", (F.col("depth") + 1).cast("long").alias("depth"))


def related(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, name, relation, depth: first discovery over edges (src, dst, relation), of relations at one depth the least."""
    at = levels(edges, starts, depth).unionByName(starts.select("start", F.col("start").alias("name"), F.lit(0).cast("long").alias("depth")))
    into = edges.filter("src != dst").select(F.col("src").alias("before"), F.col("dst").alias("name"), "relation").distinct()
    came = at.filter("depth > 0").join(into, "name").join(at.select("start", F.col("name").alias("before"), F.col("depth").alias("d")), ["start", "before"]).filter("d = depth - 1")
    return came.groupBy("start", "name", "depth").agg(F.min("relation").alias("relation")).select("start", "name", "relation", "depth")


def neighbourhood(edges: DataFrame, starts: DataFrame, depth: int, most: int = 50) -> DataFrame:
    """The induced edges among a start and the first ``most`` nodes around it, by depth, then name. The limit is the feature."""
    near = levels(edges, starts, depth)
    nth = F.row_number().over(Window.partitionBy("start").orderBy("depth", "name"))
    kept = near.withColumn("nth", nth).filter(F.col("nth") < most).select("name").union(starts.select(F.col("start").alias("name"))).distinct()
    return induced(edges, kept)


def snapshot_nodes(before: DataFrame, after: DataFrame) -> DataFrame:
    """name, change (added, removed)."""
    b, a = before.select("name").distinct(), after.select("name").distinct()
    return a.join(b, "name", "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(a, "name", "left_anti").withColumn("change", F.lit("removed")))


def coupling_movers(before: DataFrame, after: DataFrame, limit: int = 10) -> DataFrame:
    """name, before, after, delta of the scores that moved most. The limit is the feature."""
    b, a = before.select("name", F.col("score").alias("before")), after.select("name", F.col("score").alias("after"))
    rows = b.join(a, "name", "full").select("name", F.coalesce("before", F.lit(0)).cast("long").alias("before"), F.coalesce("after", F.lit(0)).cast("long").alias("after"))
    moved = rows.withColumn("delta", F.col("after") - F.col("before")).filter("delta != 0")
    return moved.orderBy(F.abs("delta").desc(), "name").limit(limit)


def resolve_calls(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """Adds callee_cls: the method's owner where it has exactly one, else the caller's own class (calls: caller_cls, callee_method; methods: cls, name)."""
    owners = methods.groupBy(F.col("name").alias("callee_method")).agg(F.countDistinct("cls").alias("owners"), F.min("cls").alias("owner"))
    one = owners.filter("owners = 1").select("callee_method", "owner")
    return calls.join(one, "callee_method", "left").withColumn("callee_cls", F.coalesce("owner", "caller_cls")).drop("owner")


def super_calls(calls: DataFrame, methods: DataFrame, parents: DataFrame, depth: int = 20) -> DataFrame:
    """Adds callee_cls and steps: the nearest ancestor of the caller's class (up the primary base, at least one step) that defines the method; both null where none does.

    calls: caller_cls, callee_method; methods: cls, name; parents: name, parent, one row per name. A class and method that call often are looked up once.
    """
    asked = cut(calls.select("caller_cls", "callee_method").distinct())
    chain = ancestor_chain(parents, asked.select(F.col("caller_cls").alias("start")).distinct(), depth)
    defined = methods.select(F.col("cls").alias("ancestor"), F.col("name").alias("callee_method")).distinct()
    found = asked.join(chain.withColumnRenamed("start", "caller_cls"), "caller_cls").join(defined, ["ancestor", "callee_method"])
    nearest = found.groupBy("caller_cls", "callee_method").agg(F.min(F.struct(F.col("depth").alias("steps"), F.col("ancestor").alias("callee_cls"))).alias("m"))
    return calls.join(nearest.select("caller_cls", "callee_method", "m.callee_cls", "m.steps"), ["caller_cls", "callee_method"], "left")


def method_callers(calls: DataFrame, cls: Column, method: Column) -> DataFrame:
    """The first call (by ord) of every caller to the method; a call without a class matches any."""
    hits = calls.filter((F.col("callee_method") == method) & (F.col("callee_cls").isNull() | (F.col("callee_cls") == cls)))
    nth = F.row_number().over(Window.partitionBy("caller_cls", "caller_method").orderBy("ord"))
    return hits.withColumn("nth", nth).filter("nth = 1").drop("nth")


def call_multiplicity(calls: DataFrame) -> DataFrame:
    """src, dst, multiplicity, condition of the first call (by ord)."""
    return calls.groupBy("src", "dst").agg(F.count("*").alias("multiplicity"), F.min_by("condition", "ord").alias("condition"))


def switch_dispatch(calls: DataFrame) -> DataFrame:
    """src, expr, targets: switch conditions that lead from one place to more than one target."""
    rows = calls.filter(F.col("condition").startswith("switch: ")).groupBy("src", F.substring("condition", 9, 1 << 30).alias("expr"))
    return rows.agg(F.array_sort(F.collect_set("dst")).alias("targets")).filter(F.size("targets") > 1)


def bridge_edges(methods: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Edges (src, dst) within a class from one method to its counterpart by rule, for methods (cls, name) that have both."""
    rules = methods.sparkSession.createDataFrame(pairs, "name string, to string")
    m = methods.select("cls", "name").distinct()
    return m.join(F.broadcast(rules), "name").join(m.select("cls", F.col("name").alias("to")), ["cls", "to"]).select(F.concat_ws(".", "cls", "name").alias("src"), F.concat_ws(".", "cls", "to").alias("dst"))


def chain_edges(events: DataFrame, chain: str = "chain", most: int = 8) -> DataFrame:
    """src, dst, pos: an event's call chain as successive edges from the event on, ``most`` links at most (the limit is the rule's)."""
    rows = events.select("event", F.posexplode(F.concat(F.array("event"), F.slice(chain, 1, most))).alias("pos", "dst"))
    linked = rows.withColumn("src", F.lag("dst").over(Window.partitionBy("event").orderBy("pos")))
    return linked.filter(F.col("src").isNotNull()).select("event", "src", "dst", "pos")


def merge_fragments(types: DataFrame) -> DataFrame:
    """One row per name from partial fragments: first namespace and file by file_path, bases in order without repeats, members all."""
    frag = F.sort_array(F.collect_list(F.struct("file_path", "namespace", "base_types", "members")))
    rows = types.groupBy("name").agg(frag.alias("f"))
    return rows.select("name", F.col("f")[0]["namespace"].alias("namespace"), F.col("f")[0]["file_path"].alias("file_path"), F.array_distinct(F.flatten(F.transform("f", lambda x: F.coalesce(x["base_types"], F.array().cast("array<string>"))))).alias("base_types"), F.flatten(F.transform("f", lambda x: F.coalesce(x["members"], F.array().cast("array<string>")))).alias("members"), F.size("f").cast("long").alias("fragments"))
